"""Hand-made frames for the semantic traps."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.functions import calendar
from gridspark.operators import clean, climatology, fields, mesh, normalize, sampling
from gridspark.operators.sampling import Sampling
from gridspark.plans import metrics, placement, predictors, runs
from gridspark.sources import tables
from gridspark.streaming.append import append_days


def times(spark, rows, schema="time string, sst double"):
    return spark.createDataFrame(rows, schema).withColumn("time", F.col("time").cast("timestamp_ntz"))


def test_ice_and_fill(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 0.2), (3, 0.1), (4, math.nan), (5, None)], "k int, sst double")
    assert [r[0] for r in df.orderBy("k").select(clean.ice_indicator(F.col("sst"))).collect()] == [0, 1, 1, None, None]
    assert [r["sst"] for r in clean.fill(df, "sst").orderBy("k").collect()] == [1.0, 0.2, 0.1, -0.009, -0.009]
    assert clean.validity(df.where("k > 3"), "sst").first()["valid"] is False
    with pytest.raises(ValueError):
        clean.require_valid(df.where("k > 3"), "sst")
    assert tables.nan_to_null(df).where("sst is null").count() == 2


def test_leap_years_and_order_of_window(spark):
    df = times(spark, [("2007-03-01", 1.0), ("2008-02-29", 3.0), ("2008-03-01", 5.0), ("2008-12-31", 7.0)])
    got = {r["time"].date().isoformat(): (r["doy"], r["anom"]) for r in climatology.anomalies(df, "sst").collect()}
    assert got == {"2007-03-01": (60, -1.0), "2008-02-29": (60, 1.0), "2008-03-01": (61, 0.0), "2008-12-31": (366, 0.0)}
    cut = climatology.anomalies(df, "sst", start="2007-01-01", end="2007-12-31").collect()
    assert [r["anom"] for r in cut] == [-1.0]  # the climatology has all years
    stored = climatology.climatology(df, "sst").where("doy < 366")
    assert climatology.anomalies(df, "sst", clim=stored).where("anom is null").count() == 1


def test_slices_and_nearest(spark):
    df = times(spark, [("2015-01-01 12:00:00", 1.0), ("2015-01-02 12:00:00", 2.0), ("2015-01-04 12:00:00", 3.0)])
    assert fields.time_slice(df, "2015-01-01", "2015-01-02").count() == 2
    assert fields.nearest_time(df, "2015-01-03 12:00:00").first()["sst"] == 2.0
    cells = spark.createDataFrame([(0, 1.0, 1.0), (1, 3.0, 1.0), (2, 1.0, 5.0)], "cell_id int, lat double, lon double")
    assert [r["cell_id"] for r in fields.nearest_cell(cells, 2.0, 0.0).collect()] == [0]
    with pytest.raises(ValueError):
        fields.drop_strict(cells, "no")
    with pytest.raises(ValueError):
        fields.squeeze(cells, "lat")


def test_years_and_readers(spark, tmp_path):
    assert tables.years(2007, 2009) == [2007, 2008] and tables.years(2007, 2009, True) == [2007, 2008, 2009]
    for y in (2007, 2008):
        times(spark, [(f"{y}-05-01", math.nan)]).withColumn("crs", F.lit(1)).write.parquet(str(tmp_path / f"f_{y}.parquet"))
    got = tables.read_years(spark, str(tmp_path / "f_{date}.parquet"), 2007, 2009, drop=("crs", "none"))
    assert got.columns == ["time", "sst", "year"] and got.where("sst is null").count() == 2
    (tmp_path / "s.csv").write_text("Latitude (dec deg),Longitude (dec deg)\n41.5,-87\n,\n42,-86.25\n")
    assert tables.read_stations(spark, str(tmp_path / "s.csv"), "Latitude (dec deg)", "Longitude (dec deg)").count() == 2
    runs.log_metrics(spark.createDataFrame([(1, 0.5)], "epoch int, loss double"), str(tmp_path / "m"), "a")
    runs.log_metrics(spark.createDataFrame([(2, 0.4)], "epoch int, loss double"), str(tmp_path / "m"), "a")
    assert runs.load(spark, str(tmp_path / "m")).count() == 2


def test_append_stream(spark, tmp_path):
    times(spark, [("2015-01-01", 1.0), ("2016-01-01", 2.0)]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("time timestamp_ntz, sst double").parquet(str(tmp_path / "in"))
    append_days(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert {r["year"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {2015, 2016}


def test_calendar_and_mesh(spark):
    row = spark.range(1).select(calendar.from_mjd(F.lit(58545.0)).alias("t"), calendar.wrap_longitude(F.lit(272.0)).alias("lon")).first()
    assert row["t"] == dt.datetime(2019, 3, 3) and row["lon"] == -88.0
    assert calendar.dates(spark, "2015-01-01", "2015-01-11", 5).count() == 3
    tri = spark.createDataFrame([(0, [1, 2, 3]), (1, [2, 3, 4])], "elem_id int, nv array<int>")
    assert [r["nv"] for r in mesh.triangles(tri).orderBy("elem_id").collect()] == [[0, 1, 2], [1, 2, 3]]


def test_normalise(spark):
    df = spark.createDataFrame([(k, float(k * k)) for k in range(10)], "k int, v double")
    for method in normalize.METHODS:
        fitted = normalize.params(normalize.fit(df.where("k < 5"), ("v",), method))
        back = normalize.apply(normalize.apply(df, fitted), fitted, back=True)
        assert np.allclose([r["v"] for r in back.orderBy("k").collect()], [k * k for k in range(10)])
    assert normalize.params(normalize.fit(df, ("v",), "min_max"))["v"] == ("min_max", 0.0, 81.0)


def test_sampling(spark):
    df = spark.createDataFrame([(d, c) for d in range(3) for c in range(5)], "date int, cell_id int")
    for n, size in ((0, 0), (3, 9), (9, 15)):
        assert sampling.sample(df, Sampling(n=n)).count() == size
    fixed = sampling.sample(df, Sampling(n=2, fixed=True)).groupBy("cell_id").count().collect()
    assert len(fixed) == 2 and all(r["count"] == 3 for r in fixed)
    assert sampling.sample(df.repartition(7), Sampling(n=2, seed=5)).exceptAll(sampling.sample(df, Sampling(n=2, seed=5))).count() == 0
    assert sampling.sample(df, Sampling(cells=(1, 2))).count() == 6


def test_metrics(spark):
    pred = spark.createDataFrame([("a", 0, 3.0), ("b", 1, 1.0), ("b", 2, 1.0), ("b", 3, 1.0)], "task string, cell int, mean double")
    truth = pred.select("task", "cell", F.lit(0.0).alias("y"))
    assert metrics.rmse(pred, truth, ["task", "cell"]).first()["rmse"] == pytest.approx(math.sqrt(3))
    best = metrics.best_so_far(spark.createDataFrame([(k, v) for k, v in enumerate([0.5, 0.4, 0.4, math.nan, 0.3])], "epoch int, rmse double"))
    assert [r["is_best"] for r in best.orderBy("epoch").collect()] == [True, True, False, False, True]


def test_predictors_and_placement(spark):
    x = np.array([[0.0, 0], [1, 2], [3, 1], [4, 4], [2, 3]])
    y = np.arange(5.0)
    mean, std = predictors.gp_posterior(x, y, x, 1.0, 0.0)
    assert np.allclose(mean, y, atol=1e-5) and np.allclose(std, 0, atol=1e-4)
    context = spark.createDataFrame([(1, float(a), float(b), float(v)) for (a, b), v in zip(x, y)], "date int, x1 double, x2 double, y double")
    targets = spark.createDataFrame([(0, 1.0, 1.0), (1, 3.0, 3.0)], "target_id int, x1 double, x2 double")
    got = predictors.setconv(context, targets, 1.0).orderBy("target_id").collect()
    for r, t in zip(got, ([1, 1], [3, 3])):
        w = np.exp(-((x - t) ** 2).sum(1) / 2)
        assert r["mean"] == pytest.approx((w @ y) / w.sum()) and r["density"] == pytest.approx(w.sum())
    assert predictors.tune(context, targets.select(F.lit(1).alias("date"), "target_id", F.lit(1.0).alias("y")), targets, [0.5, 1.0])[1][0] == 1.0
    _, cov = predictors.gp_posterior(x, y, x + 0.5, 1.0, 0.1, joint=True)
    assert np.allclose(np.sqrt(np.diag(cov)), predictors.gp_posterior(x, y, x + 0.5, 1.0, 0.1)[1])
    drawn = predictors.gp_predict(context, targets, 1.0, samples=2).collect()
    assert len(drawn) == 2 and all(abs(r["sample_1"] - r["mean"]) < 6 * r["std"] + 1e-6 for r in drawn)
    line = spark.createDataFrame([(k, float(k), 0.0) for k in range(11)], "cell_id int, x1 double, x2 double")
    picks, field = placement.greedy(context.limit(1), line, line, 3, 1.5)
    rows = picks.orderBy("iteration").collect()
    assert len({r["cell_id"] for r in rows}) == 3 and field.count() == 11 + 10 + 9
    assert rows[0]["score"] >= rows[1]["score"] >= rows[2]["score"]


def test_setconv_over_whole_dates(spark):
    import numpy as np

    from gridspark.plans import catalogue

    sf = "/root/testdata/sf0.001"
    daily = catalogue._daily(spark, sf).toPandas()
    for name, points in (("setconv_predict", catalogue._grid_targets(spark, sf).toPandas()[["target_id", "x1", "x2"]].values), ("setconv_offgrid", [(0, 4.2, 3.3), (1, 8.6, 1.1)])):
        got = {(r["date"], int(r["target_id"])): (r["mean"], r["density"]) for r in catalogue.QUERIES[name](spark, sf).collect()}
        assert len(got) == daily["date"].nunique() * len(points)
        for date, d in daily.groupby("date"):
            for k, x1, x2 in points:
                w = np.exp(-((d["x1"] - x1) ** 2 + (d["x2"] - x2) ** 2) / 4.5)
                assert np.allclose(got[str(date), int(k)], ((w * d["y"]).sum() / w.sum(), w.sum()), atol=2e-6)


def test_setconv_keeps_targets_out_of_reach(spark):
    context = spark.createDataFrame([(1, 0.0, 0.0, 2.0)], "date int, x1 double, x2 double, y double")
    targets = spark.createDataFrame([(0, 0.0, 0.0), (1, 50.0, 50.0)], "target_id int, x1 double, x2 double")
    got = {r["target_id"]: (r["mean"], r["density"]) for r in predictors.setconv(context, targets, 1.0, reach=3.0, every=True).collect()}
    assert got == {0: (2.0, 1.0), 1: (None, 0.0)}
