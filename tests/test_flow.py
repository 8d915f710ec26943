"""The flow from yearly files to predictions, stored models, and what a plan must not have."""

import datetime as dt
import math
import sys
import types

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, LessThan

from gridspark.functions import calendar
from gridspark.operators import clean, climatology, fields, normalize, sampling, tasks
from gridspark.operators.sampling import Sampling
from gridspark.plans import metrics, placement, predictors, runs
from gridspark.plans.flow import Flow, lengths
from gridspark.sources import tables
from gridspark.sources.netcdf import NetcdfReader, NetcdfSource


def grid(spark):
    return spark.createDataFrame([(k, 40.0 + k // 4, -90.0 + k % 4, k != 5, float(k)) for k in range(12)], "cell_id int, lat double, lon double, mask boolean, depth double")


def value(year: int, day: int, k: int) -> float:
    return 10 * math.sin(day / 9) + (k // 4) + 0.5 * math.cos(k + year * 3 + day / 5)


def observations(spark, gap=None):
    rows = []
    for year in (2007, 2008, 2009):
        for day in range(0, 40):
            for k in range(12):
                rows.append((dt.datetime(year, 1, 1) + dt.timedelta(days=day), k, None if (year, day, k) == gap else math.nan if gap and (year, day, k) == (2008, 3, 4) else value(year, day, k)))
    return spark.createDataFrame(rows, "time timestamp_ntz, cell_id int, sst double")


def test_gap_before_fill(spark):
    """A missing day's anomaly is the fill value less a climatology that counts it; nothing is rounded."""
    df = spark.createDataFrame([("2007-01-01", 1.95029), ("2008-01-01", None), ("2009-01-01", 0.00001)], "time string, sst double").withColumn("time", F.col("time").cast("timestamp_ntz"))
    got = {r["time"].year: (r["clim"], r["anom"]) for r in climatology.anomalies(clean.fill(df, "sst"), "sst").collect()}
    mean = (1.95029 - 0.009 + 0.00001) / 3
    assert all(got[y] == pytest.approx((mean, v - mean), abs=1e-15) for y, v in ((2007, 1.95029), (2008, -0.009), (2009, 0.00001)))
    assert climatology.climatology(df.where("sst > 1"), "sst").first()["clim"] == 1.95029


def test_flow_trains_stores_and_predicts(spark, tmp_path):
    obs = observations(spark, gap=(2009, 7, 3))
    for year in (2007, 2008, 2009):
        obs.where(F.year("time") == year).write.parquet(str(tmp_path / f"G_{year}.parquet"))
    run = Flow(spark, grid(spark), layers=("mask", "depth")).load(str(tmp_path / "G_{date}.parquet"), 2007, 2010, "2007-01-01", "2009-12-31")
    assert run.series.count() == 3 * 40 * 12 and set(run.scaling) == {"sst", "lat", "lon", "mask", "depth"}
    assert run.cells.agg(F.min("x1"), F.max("x1"), F.min("x2"), F.max("x2")).first() == (0.0, 1.0, 0.0, 1.0)

    out = str(tmp_path / "out")
    found = run.train(out, lengths([0.05, 0.6, 0.2]), ("2007-01-01", "2007-02-28"), ("2008-01-01", "2008-02-28"), 5, (2, 9)).orderBy("epoch").collect()
    errors = [r["val_rmse"] for r in found]
    assert len(found) == 3 and all(r["loss"] > 0 for r in found)
    assert [r["is_best"] for r in found] == [e < min([math.inf, *errors[:k]]) for k, e in enumerate(errors)]
    best = run.best(out)
    assert best.length == [0.05, 0.6, 0.2][max(k for k, r in enumerate(found) if r["is_best"])]
    assert runs.load(spark, f"{out}/metrics").count() == 3
    other = Flow(spark, grid(spark))
    other.load_scaling(f"{out}/scaling")
    assert other.scaling == run.scaling

    # the error by hand: same tasks, kernel means, units of the series
    points = run.generate_tasks(run.dates("2008-01-01", "2008-02-28", 5), (2, 9), 0).toPandas()
    assert points[points.role == "target"].groupby("date").size().tolist() == [12] * 8
    context = points[(points.role == "context") & (points.set_idx == 0)]
    assert context.groupby("date").size().between(2, 8).all()
    assert points[points.set_idx > 0].date.isna().all() and len(points[points.set_idx > 0]) == 24
    width, errs = run.scaling["sst"][2], []
    for date, t in points[points.role == "target"].groupby("date"):
        c = context[context.date == date]
        for _, r in t.iterrows():
            w = np.exp(-((c.x1 - r.x1) ** 2 + (c.x2 - r.x2) ** 2) / (2 * 0.6**2))
            errs.append(width * ((w * c.y).sum() / w.sum() - r.y))
    assert errors[1] == pytest.approx(np.sqrt(np.mean(np.square(errs))))

    stations = spark.createDataFrame([(7, 40.5, -89.5)], "target_id int, lat double, lon double")
    days = run.dates("2009-01-03", "2009-01-05")
    got = run.predict(predictors.GaussianProcess(0.5), days, stations, Sampling(n=5, fixed=True)).collect()
    assert len(got) == 3 and all(r["std"] > 0 and r["lat"] == 40.5 for r in got)
    assert run.predict(predictors.SetConv(0.5), days).count() == 36
    masked = run.generate_tasks(days, None, mask=grid(spark).where("mask"))
    assert masked.where("role = 'context' and set_idx = 0").count() == 33
    kept = tasks.load(masked)
    assert kept.is_cached and kept.unpersist().count() == masked.count()


def test_flow_with_stored_climatology_and_raw_values(spark):
    obs = observations(spark)
    stored = climatology.climatology(obs, "sst", ("cell_id",)).where("doy <= 30")
    run = Flow(spark, grid(spark)).load(obs, stored=stored)
    assert run.series.count() == 1440 and run.series.where("y is null").count() == 3 * 10 * 12  # not cut; days it lacks are null
    raw = Flow(spark, grid(spark)).load(obs, use_anomalies=False, fit_start="2007-01-01", fit_end="2007-01-10")
    mean = np.mean([value(2007, d, k) for d in range(10) for k in range(12)])
    assert raw.scaling["sst"][1] == pytest.approx(mean)
    with pytest.raises(ValueError):
        Flow(spark, grid(spark)).load(obs.withColumn("sst", F.lit(None).cast("double")))
    with pytest.raises(ValueError):
        Flow(spark, grid(spark)).load(obs.drop("cell_id"))


def test_stored_predictors(spark, tmp_path):
    for p in (predictors.SetConv(1.5), predictors.SetConv(1.5, 3.0), predictors.GaussianProcess(0.5, 0.1, 20)):
        assert predictors.predictor_of(predictors.store(spark, p)) == p
    for version, best in ((1, True), (2, False), (3, True)):
        assert runs.save_if_best(predictors.store(spark, predictors.SetConv(float(version))), str(tmp_path / "p"), version, best) == best
    assert predictors.predictor_of(runs.load_best(spark, str(tmp_path / "p"))) == predictors.SetConv(3.0)
    built = tasks.build([(grid(spark).select("cell_id", F.col("lat").alias("x1"), F.col("lon").alias("x2"), F.col("depth").alias("y")), Sampling())], None, spark.createDataFrame([(dt.date(2020, 1, 1),)], "date date"))
    runs.save(built, str(tmp_path / "deep" / "tasks"))
    assert runs.load(spark, str(tmp_path / "deep" / "tasks")).exceptAll(built).count() == 0


def test_samples_at_some_targets(spark):
    """With a subsample the drawn targets have the joint draw, the rest the mean that follows from it."""
    rng = np.random.default_rng(2)
    x, y = rng.random((4, 2)) * 4, rng.standard_normal(4)
    context = spark.createDataFrame([(1, float(a), float(b), float(v)) for (a, b), v in zip(x, y)], "date int, x1 double, x2 double, y double")
    at = rng.random((9, 2)) * 4
    targets = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(at)], "target_id int, x1 double, x2 double")
    got = predictors.gp_predict(context, targets, 1.0, samples=2, seed=5, subsample=4).orderBy("target_id").toPandas()
    some = [0, 4, 8]
    order = np.lexsort((y, x[:, 1], x[:, 0]))
    mean, cov = predictors.gp_posterior(x[order], y[order], at[some], 1.0, 1e-2, joint=True)
    drawn = np.random.default_rng(5).standard_normal((3, 2))
    values, vectors = np.linalg.eigh(cov)
    there = mean + (vectors * np.sqrt(np.maximum(values, 0))) @ drawn[:, 0]
    assert np.allclose(got["sample_1"][some], there)
    rest = predictors.gp_posterior(np.concatenate((x[order], at[some])), np.concatenate((y[order], there)), at, 1.0, 1e-2)[0]
    assert np.allclose(np.delete(got["sample_1"].to_numpy(), some), np.delete(rest, some))


def test_placement_in_blocks_equals_one_matrix(spark, monkeypatch):
    rng = np.random.default_rng(3)
    place = rng.random((30, 2)) * 5
    cells = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(place)], "cell_id int, x1 double, x2 double")
    points = {d: rng.random((6, 2)) * 5 for d in (1, 2)}
    context = spark.createDataFrame([(d, float(a), float(b)) for d, p in points.items() for a, b in p], "date int, x1 double, x2 double")
    monkeypatch.setattr(placement, "BLOCK", 7)
    picks, field = placement.greedy(context, cells, cells, 2, 1.2)
    k = lambda a, b: np.exp(-((a[:, None] - b[None]) ** 2).sum(-1) / (2 * 1.2**2))
    chosen = []
    for r in picks.orderBy("iteration").collect():
        scores = {}
        for c in set(range(30)) - set(chosen):
            left = []
            for p in points.values():
                x = np.concatenate((p, place[[*chosen, c]]))
                left.append(np.sqrt(np.maximum(1 - np.einsum("ij,jk,ik->i", k(place, x), np.linalg.inv(k(x, x) + 0.01 * np.eye(len(x))), k(place, x)), 0)).mean())
            scores[c] = np.mean(left)
        best = min(scores, key=lambda c: (round(scores[c], 12), c))
        assert r["cell_id"] == best and r["score"] == pytest.approx(scores[best])
        chosen.append(best)
    assert field.count() == 30 + 29
    monkeypatch.setattr(placement, "CANDIDATES", 10)
    with pytest.raises(ValueError):
        placement.greedy(context, cells, cells, 1, 1.2)
    monkeypatch.setattr(placement, "CONTEXT", 5)
    monkeypatch.setattr(placement, "CANDIDATES", 100)
    with pytest.raises(Exception, match="context points"):
        placement.greedy(context, cells, cells, 1, 1.2)


def test_nearest_cell_takes_each_axis_by_itself(spark):
    cells = spark.createDataFrame([(0, 1.0, 1.0), (1, 3.0, 9.0), (2, 1.0, 5.0)], "cell_id int, lat double, lon double")
    assert fields.nearest_cell(cells, 1.2, 4.0).first()["cell_id"] == 2
    assert fields.nearest_cell(cells, 2.9, 4.9).count() == 0  # no cell at latitude 3 and longitude 5


def test_times_know_no_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.sql("select timestamp_ntz'2024-03-10 02:30:00.123456' as t")  # an hour that this zone lacks
        row = df.select(calendar.from_mjd(calendar.to_mjd(F.col("t"))).alias("back"), calendar.to_mjd(F.col("t")).alias("mjd"), calendar.parse(F.lit("2024-03-10 02:30:00")).alias("parsed"), calendar.parse(F.lit("no")).alias("none")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert row["back"] == dt.datetime(2024, 3, 10, 2, 30, 0, 123456) and row["parsed"] == dt.datetime(2024, 3, 10, 2, 30) and row["none"] is None
    assert row["mjd"] == pytest.approx(60379 + 2.5 / 24 + 0.123456 / 86400, abs=1e-10)
    assert df.select(calendar.format_date(F.col("t"), "yyyy-MM-dd HH:mm")).first()[0] == "2024-03-10 02:30"


def test_readers_by_glob_and_keys(spark, tmp_path):
    for y in (2007, 2008):
        spark.createDataFrame([(f"{y}-05-01", 1, math.nan), (f"{y}-05-02", 1, 2.0)], "time string, cell_id int, sst double").withColumn("time", F.col("time").cast("timestamp_ntz")).write.parquet(str(tmp_path / f"f_{y}.parquet"))
    assert tables.read_glob(spark, str(tmp_path / "f_20*.parquet"), keys=("time", "cell_id")).where("sst is null").count() == 2
    assert tables.read_glob(spark, str(tmp_path / "f_200[7].parquet")).count() == 2
    with pytest.raises(ValueError):
        tables.read_glob(spark, str(tmp_path / "f_20*.parquet"), keys=("cell_id",))
    tables.write_years(tables.read_glob(spark, str(tmp_path / "f_20*.parquet")), str(tmp_path / "all"))
    warm = tables.read_years(spark, str(tmp_path / "all/year={date}"), 2007, 2009, clean=True).where("sst > 1")
    plan = warm._jdf.queryExecution().executedPlan().toString()
    assert warm.count() == 2 and "PushedFilters: [IsNotNull(sst), GreaterThan(sst,1.0)]" in plan
    clim = spark.createDataFrame([(1, 2, math.nan)], "doy int, cell_id int, clim double")
    clim.write.parquet(str(tmp_path / "clim"))
    assert tables.read_climatology(spark, str(tmp_path / "clim")).first()["clim"] is None


def test_anomalies_of_a_bucketed_table_shuffle_nothing(spark):
    spark.sql("drop table if exists by_cell")
    tables.write_by_cell(observations(spark), "by_cell", 4)
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = climatology.anomalies(spark.table("by_cell"), "sst", ("cell_id",))
        assert found.count() == 1440
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("drop table by_cell")


class Variable:
    def __init__(self, data, units=None):
        self.data, self.units = data, units

    def __getitem__(self, at):
        return self.data[at]

    def __len__(self):
        return len(self.data)


class File(dict):
    def __enter__(self):
        return self

    def __exit__(self, *_):
        return False


def test_netcdf_grids_as_batches(spark, monkeypatch):
    """The reader library is not here; a stand-in has its calls."""
    sst = np.ma.masked_greater(np.arange(12, dtype=np.float32).reshape(2, 2, 3), 10)
    sst[0, 0, 1] = np.nan
    data = File(time=Variable(np.array([0, 1]), "days"), lat=Variable(np.array([41.0, 42.0])), lon=Variable(np.array([-88.0, -87.0, -86.0])), sst=Variable(sst), crs=Variable(np.zeros((2, 2, 3))), ice=Variable(np.ones((2, 2, 3))))
    stand_in = types.ModuleType("netCDF4")
    stand_in.Dataset = lambda path: data
    stand_in.num2date = lambda raw, units, **_: dt.datetime(2007, 1, 1) + dt.timedelta(days=int(raw))
    monkeypatch.setitem(sys.modules, "netCDF4", stand_in)
    options = {"path": "x.nc", "variables": "sst, crs, ice", "dropVariables": "crs"}
    source = NetcdfSource(options)
    assert source.schema().endswith("lon double, `sst` double, `ice` double") and source.schema().startswith("time timestamp_ntz")
    reader = source.reader(None)
    assert [(p.start, p.stop) for p in reader.partitions()] == [(0, 2)]
    batches = list(reader.read(reader.partitions()[0]))
    assert len(batches) == 2 and isinstance(batches[0], pa.RecordBatch)
    rows = batches[0].to_pylist()
    assert rows[1] == {"time": dt.datetime(2007, 1, 1), "cell_id": 1, "i_lat": 0, "i_lon": 1, "lat": 41.0, "lon": -87.0, "sst": None, "ice": 1.0} and rows[5]["sst"] == 5.0
    last = list(NetcdfReader({"path": "x.nc", "variable": "sst", "decodetimes": "false"}).read(reader.partitions()[0]))[1].to_pylist()
    assert [r["value"] for r in last] == [6.0, 7.0, 8.0, 9.0, 10.0, None] and last[0]["time"] == 1.0
    assert NetcdfSource({"variable": "sst", "decodeTimes": "false"}).schema().startswith("time double")
    with pytest.raises(ValueError):
        NetcdfSource({}).schema()


def test_netcdf_files_are_planned_by_time(monkeypatch):
    """Files of years that conditions rule out are never opened; steps come in runs; shared times raise."""
    opened = []

    def dataset(path):
        opened.append(path)
        year = int(path[2:6])
        days = [(dt.datetime(year, 6, 1) - dt.datetime(2000, 1, 1)).days + k for k in range(20)]
        return File(time=Variable(np.array(days), "days"), lat=Variable(np.array([41.0])), lon=Variable(np.array([-88.0, -87.0])), sst=Variable(np.ma.asarray([[[k + 0.5, year]] for k in range(20)])))

    stand_in = types.ModuleType("netCDF4")
    stand_in.Dataset = dataset
    stand_in.num2date = lambda raw, units, **_: dt.datetime(2000, 1, 1) + dt.timedelta(days=int(raw))
    monkeypatch.setitem(sys.modules, "netCDF4", stand_in)
    options = {"path": "G_{date}.nc", "startYear": "2007", "endYear": "2012", "variable": "sst"}
    reader = NetcdfSource(options).reader(None)
    filters = [GreaterThanOrEqual(("time",), dt.datetime(2008, 6, 15)), LessThan(("time",), dt.datetime(2009, 6, 3)), GreaterThan(("lat",), 3.0)]
    assert list(reader.pushFilters(filters)) == filters  # Spark applies them again
    planned = reader.partitions()
    assert opened == ["G_2008.nc", "G_2009.nc"]
    assert [(p.path, p.start, p.stop) for p in planned] == [("G_2008.nc", 14, 20), ("G_2009.nc", 0, 2)]
    rows = [r for p in planned for b in reader.read(p) for r in b.to_pylist()]
    assert len(rows) == 16 and rows[0]["time"] == dt.datetime(2008, 6, 15) and rows[-1]["value"] == 2009.0
    every = NetcdfSource({**options, "stepsPerPartition": "7"}).reader(None).partitions()
    assert [(p.start, p.stop) for p in every[:3]] == [(0, 7), (7, 14), (14, 20)] and len(every) == 15
    exact = NetcdfSource(options).reader(None)
    list(exact.pushFilters([EqualTo(("time",), dt.date(2010, 6, 4))]))
    assert [(p.path, p.start, p.stop) for p in exact.partitions()] == [("G_2010.nc", 3, 4)]
    with pytest.raises(ValueError, match="share times"):
        NetcdfSource({"path": "G_2007.nc, a_2007.nc", "variable": "sst"}).reader(None).partitions()
    monkeypatch.setattr(NetcdfReader, "files", lambda self: [("G_2007.nc", 2008)])
    with pytest.raises(ValueError, match="beyond 2008"):
        NetcdfSource(options).reader(None).partitions()


def test_small_operators(spark):
    cells = grid(spark)
    assert fields.rename(cells, {"lat": "latitude"}).columns[1] == "latitude"
    for f in (lambda: fields.rename(cells, {"no": "x"}), lambda: fields.require_names(cells, "time", "lat"), lambda: metrics.rmse_of_tasks(spark.createDataFrame([(1, 2, 3.0)], "date int, cell_id int, mean double"), cells, ["date"], 50)):
        with pytest.raises(ValueError):
            f()
    assert clean.apply_function(cells, "depth", lambda v: v * 2).agg(F.sum("depth")).first()[0] == 132.0
    assert sampling.sample(spark.createDataFrame([(1, c) for c in range(5)], "date int, cell_id int"), Sampling(low=3, high=3)).count() == 3
    many = spark.range(20_000).select(F.col("id").alias("epoch"), (-F.col("id") % 7 + F.when(F.col("id") % 5000 == 0, -F.col("id")).otherwise(0)).cast("double").alias("rmse"))
    got = {r["epoch"]: r["is_best"] for r in metrics.best_so_far(many).collect()}
    least = math.inf
    for r in many.orderBy("epoch").collect():
        assert got[r["epoch"]] == (r["rmse"] < least)
        least = min(least, r["rmse"])
    assert [c for c in metrics.best_so_far(many.withColumn("run", F.lit("a")), run="run").columns] == ["epoch", "rmse", "run", "is_best"]
    unit = normalize.params(normalize.fit(cells, ("lat",), "unit"))
    assert unit["lat"] == ("unit", 40.0, 42.0)
