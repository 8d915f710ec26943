"""Kernel sums, training, read-out and nearest neighbours against plain computations."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.operators.sampling import Sampling, sample
from gridspark.plans import metrics, neighbours, predictors, readout, smoothing, training
from gridspark.plans.flow import Flow, lengths
from tests.test_flow import grid, observations

SPAN = ("2007-01-01", "2007-02-09"), ("2008-01-01", "2008-02-09")


def points(seed: int, dates: int = 3, n: int = 60):
    """Context with repeated places, a null value and a date without context; targets on and off its lines."""
    rng = np.random.default_rng(seed)
    context = [(d, float(rng.integers(0, 9) / 8), float(rng.integers(0, 7) / 6), float(rng.standard_normal())) for d in range(dates - 1) for _ in range(n)]
    places = [*rng.random((20, 2)), (0.5, 0.5), (0.125, 1.0)]
    targets = [(d, k, float(a), float(b)) for d in range(dates) for k, (a, b) in enumerate(places)]
    return [*context, (0, 0.1, 0.1, None)], targets


def frames(spark, context, targets):
    return spark.createDataFrame(context, "date int, x1 double, x2 double, y double").repartition(4), spark.createDataFrame(targets, "date int, target_id int, x1 double, x2 double")


def by_hand(context, targets, l1, l2):
    out = {}
    for d, k, a, b in targets:
        mine = np.array([c[1:] for c in context if c[0] == d and c[3] is not None]).reshape(-1, 3)
        q1, q2 = ((mine[:, 0] - a) / l1) ** 2, ((mine[:, 1] - b) / l2) ** 2
        w, y = np.exp(-(q1 + q2) / 2), mine[:, 2]
        out[d, k] = [(w * y).sum(), w.sum(), (w * q1 * y).sum(), (w * q1).sum(), (w * q2 * y).sum(), (w * q2).sum()]
    return out


@pytest.mark.parametrize("reach", [None, 9.0])
def test_kernel_sums(spark, reach):
    context, targets = points(1)
    want = by_hand(context, targets, 0.2, 0.35)
    for gradient in (True, False):
        got = smoothing.kernel_sums(*frames(spark, context, targets), 0.2, 0.35, reach, gradient).collect()
        assert len(got) == len(targets)
        for r in got:
            n = 6 if gradient else 2
            assert np.allclose(list(r)[2:], want[r["date"], r["target_id"]][:n], rtol=1e-9, atol=1e-9)


def test_a_million_cells(spark):
    """A full grid at all its cells, without pairs; at some cells against the plain sum."""
    n = 1000
    cells = spark.range(n * n).select(F.lit(1).alias("date"), F.col("id").alias("target_id"), (F.floor(F.col("id") / n) / n).alias("x1"), (F.col("id") % n / F.lit(n)).alias("x2"), F.sin("id").alias("y"))
    found = predictors.SetConv(0.01).predict(cells, cells.drop("y"))
    assert found.count() == n * n
    ids = np.arange(n * n)
    at = ids // n / n, ids % n / n
    for r in found.where("target_id in (0, 500500, 999999, 123456)").collect():
        k = r["target_id"]
        w = np.exp(-((at[0] - at[0][k]) ** 2 + (at[1] - at[1][k]) ** 2) / (2 * 0.01**2))
        assert r["mean"] == pytest.approx((w * np.sin(ids)).sum() / w.sum(), abs=1e-9)


def test_lines_beyond_the_bound(monkeypatch):
    monkeypatch.setattr(smoothing, "LINE", 4)
    with pytest.raises(ValueError, match="a line of"):
        smoothing._bounded(5)



def test_every_predictor_gives_every_target(spark):
    """Dates without context have the prior."""
    context, targets = points(3)
    c, w = frames(spark, context, targets)
    layer = spark.createDataFrame([(a / 4, b / 4, float(a * b)) for a in range(5) for b in range(5)], "x1 double, x2 double, y double")
    for p, std in ((predictors.SetConv(0.2), None), (predictors.SetConv(0.2, 0.5), None), (predictors.Kernel(0.2, 0.3, 0.5), None), (predictors.Kernel(0.2, 0.3, 0.5, 8.0), None), (predictors.GaussianProcess(0.3), 1.0), (neighbours.NearestProcess(0.3, 0.01, 5), 1.0), (readout.LayerReadout(0.2, 0.3, 0.5, (0.0, 1.0, 0.0, 0.0, 0.0), 0.7), 0.7)):
        found = p.predict(c, w, [layer]).collect()
        assert len(found) == len(targets) and all(r["mean"] is not None for r in found)
        assert {(r["mean"], r["std"]) for r in found if r["date"] == 2} == {(0.0, std)}
        assert predictors.predictor_of(predictors.store(spark, p)) == p


def test_gradient_is_that_of_the_loss(spark):
    context, targets = points(4)
    c, w = frames(spark, context, targets)
    w = w.withColumn("y", F.sin(F.col("x1") * 5) + F.col("x2"))
    start = predictors.Kernel(0.2, 0.3, 0.4)
    n, loss, *slopes = training.gradient(c, w, start)
    assert n == 3
    for k, name in enumerate(("length1", "length2", "prior")):
        ends = [training.gradient(c, w, predictors.Kernel(**{**start.parameters(), name: getattr(start, name) * math.exp(s * 1e-5)}))[1] for s in (1, -1)]
        assert slopes[k] == pytest.approx((ends[0] - ends[1]) / 2e-5, rel=1e-5, abs=1e-9)
    state = training.step(training.begin(start), tuple(slopes), 0.1)
    assert [x - math.log(v) for x, v in zip(state.log, (0.2, 0.3, 0.4))] == pytest.approx([-0.1 * np.sign(g) for g in slopes], abs=1e-4)


def test_training_lowers_the_loss_and_goes_on_where_it_stopped(spark, tmp_path):
    start = predictors.Kernel(0.05, 0.05, 1.0, 8.0)
    def run(folder, epochs, size=None):
        return Flow(spark, grid(spark)).load(observations(spark), anomaly_start="2007-01-01", anomaly_end="2009-12-31").fit(str(folder), start, epochs, 0.2, size, *SPAN, 5, (4, 9)).orderBy("epoch").collect()
    whole = run(tmp_path / "a", 4)
    flow = Flow(spark, grid(spark)).load(observations(spark), anomaly_start="2007-01-01", anomaly_end="2009-12-31")
    same = flow.generate_tasks(flow.dates(*SPAN[0], 1), (4, 9), seed=99)
    last = predictors.Kernel(*(whole[-1][n] for n in ("length1", "length2", "prior")), 8.0)
    assert flow.training_loss(last, same) < 0.97 * flow.training_loss(start, same)
    first = run(tmp_path / "b", 2)
    rest = run(tmp_path / "b", 4)
    assert [r["epoch"] for r in rest] == [3, 4]
    for x, y in zip(whole, first + rest):
        assert [v for v in x] == pytest.approx([v for v in y], rel=1e-9)
    assert run(tmp_path / "b", 4) == []
    best = predictors.predictor_of(training.runs.load_best(spark, str(tmp_path / "a/predictor")))
    least = min(whole, key=lambda r: r["val_rmse"])
    assert best.length1 == pytest.approx(least["length1"]) and best.reach == 8.0
    assert training.runs.load(spark, str(tmp_path / "b/metrics")).count() == 4
    batched = run(tmp_path / "c", 1, 3)  # 8 tasks: three steps
    assert len(batched) == 1 and training.load(spark, str(tmp_path / "c"), start).steps == 3


def test_readout_equals_ridge_and_layers_matter(spark):
    flow = Flow(spark, grid(spark), layers=("mask", "depth")).load(observations(spark), anomaly_start="2007-01-01", anomaly_end="2009-12-31")
    kernel = predictors.Kernel(0.3, 0.3, 0.2)
    model = flow.fit_readout(kernel, SPAN[0], 5, (0, 6), ridge=0.01)
    tasks = flow.generate_tasks(flow.dates(*SPAN[0], 5), (0, 6), seed=1)
    context, targets = flow._meetings(tasks)
    rows = readout.channels(context, targets.drop("y"), kernel, flow.layer_frames()).join(targets, ["date", "target_id"]).toPandas()
    x, y = rows[[f"f{k}" for k in range(7)]].to_numpy(), rows["y"].to_numpy()
    want = np.linalg.solve(x.T @ x + 0.01 * len(x) * np.diag([0.0] + [1.0] * 6), x.T @ y)
    assert np.allclose(model.weights, want, atol=1e-8)
    assert model.deviation == pytest.approx(np.sqrt(np.mean((x @ want - y) ** 2)))
    other = [frame.withColumn("y", -F.col("y")) for frame in flow.layer_frames()]
    one, two = (model.predict(context, targets, layers).toPandas().sort_values(["date", "target_id"])["mean"].to_numpy() for layers in (flow.layer_frames(), other))
    assert (np.abs(one - two) > 1e-9).mean() > 0.5
    with pytest.raises(ValueError):
        model.predict(context, targets, [])


def test_nearest_by_growing_cells(spark):
    rng = np.random.default_rng(6)
    context = [(1, float(a), float(b), float(k)) for k, (a, b) in enumerate(rng.random((200, 2)) ** 3)] + [(1, 0.5, 0.5, float(k)) for k in range(40)] + [(2, 0.3, 0.3, 1.0), (2, 0.9, 0.1, None)]
    targets = [(d, k, float(a), float(b)) for d in (1, 2, 3) for k, (a, b) in enumerate([*rng.random((30, 2)), (9.0, -9.0)])]
    found = {(r["date"], r["target_id"]): [tuple(p) for p in r["near"]] for r in neighbours.nearest(*frames(spark, context, targets), 7).collect()}
    for d, k, a, b in targets:
        all_of = sorted(((x - a) ** 2 + (y - b) ** 2, x, y, v) for e, x, y, v in context if e == d and v is not None)
        mine = found.get((d, k), [])
        assert len(mine) == len(all_of[:7]) and np.allclose(mine, all_of[:7])
    none = spark.createDataFrame([], "date int, x1 double, x2 double, y double")
    assert neighbours.nearest(none, frames(spark, context, targets)[1], 7).count() == 0


def test_nearest_process_equals_the_whole_one(spark):
    context, targets = points(7, n=25)
    c, w = frames(spark, context, targets)
    whole = {(r["date"], r["target_id"]): r for r in predictors.GaussianProcess(0.3, 0.05).predict(c, w).collect()}
    for r in neighbours.NearestProcess(0.3, 0.05, 100).predict(c, w).collect():
        assert [r["mean"], r["std"]] == pytest.approx([whole[r["date"], r["target_id"]][n] for n in ("mean", "std")], abs=1e-7)


def test_tasks_without_context_count(spark):
    run = Flow(spark, grid(spark)).load(observations(spark), anomaly_start="2007-01-01", anomaly_end="2009-12-31")
    tasks = run.generate_tasks(run.dates(*SPAN[1], 1), (0, 2), seed=3)
    empty = tasks.where("role = 'target'").select("date").distinct().join(tasks.where("role = 'context'").select("date"), "date", "left_anti")
    assert 0 < empty.count() < 40
    for p in (predictors.SetConv(0.3), predictors.GaussianProcess(0.3)):
        found = metrics.rmse(run.predicted(p, tasks), run.truth(tasks), ["date", "cell_id"]).first()
        assert (found["n"], found["n_null"]) == (480, 0)
    assert run.training_loss(predictors.SetConv(0.3), tasks) > 0


def test_sampling_cuts_before_it_sorts(spark):
    df = spark.createDataFrame([(dt.date(2020, 1, d), c) for d in (1, 2) for c in range(30)], "date date, cell_id int")
    drawn = sample(df, Sampling(low=0, high=6, seed=1))
    assert "WindowGroupLimit" in drawn._jdf.queryExecution().executedPlan().toString()
    assert sample(df, Sampling(low=0, high=1)).count() == 0 and sample(df, Sampling(low=3, high=3)).count() == 6


def test_flow_on_twenty_thousand_cells(spark):
    """The flow of the README, predictions on all cells from all cells."""
    cells = spark.range(20_000).select(F.col("id").alias("cell_id"), (F.floor(F.col("id") / 200) / 100.0 + 41).alias("lat"), (F.col("id") % 200 / 100.0 - 88).alias("lon"))
    days = spark.createDataFrame([(dt.datetime(2007, 1, d),) for d in (1, 2, 3)], "time timestamp_ntz")
    obs = cells.crossJoin(days).select("time", "cell_id", (F.sin(F.col("lat") * F.dayofyear("time")) + F.cos("lon")).alias("sst"))
    run = Flow(spark, cells).load(obs, use_anomalies=False)
    found = run.train(None, lengths([0.05, 0.2]), ("2007-01-01", "2007-01-02"), ("2007-01-03", "2007-01-03"), 1, (20, 60)).collect()
    assert all(r["loss"] > 0 and r["val_rmse"] > 0 for r in found)
    assert run.predict(predictors.SetConv(0.05), run.dates("2007-01-03", "2007-01-03")).where("mean is not null").count() == 20_000
