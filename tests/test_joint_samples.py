"""Fields drawn tile by tile against the whole process."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.plans import joint_samples, predictors

LENGTH, NOISE = 0.2, 0.05


def unit(seed, date, target_id, samples):
    """In place of normal values: the n-th sample is 1 at target n, so the samples are a root of the covariance."""
    out = np.zeros(samples)
    out[target_id] = 1.0
    return out


def plane(n: int, seed: int = 1):
    """Targets on 3 x 2 tiles about the origin, dates 1 (context) and 2 (none)."""
    rng = np.random.default_rng(seed)
    at = rng.random((n, 2)) * (2.3, 1.5) - (0.7, 0.75)
    context = [(1, *map(float, p), float(rng.standard_normal())) for p in rng.random((30, 2)) * (2.3, 1.5) - (0.7, 0.75)]
    context += [context[0], context[0], (1, *context[1][1:3], 2.0), (1, 0.0, 0.0, None)]
    return at, context


def frames(spark, at, context):
    targets = [(d, k, float(a), float(b)) for d in (1, 2) for k, (a, b) in enumerate(at)]
    return spark.createDataFrame(context, "date int, x1 double, x2 double, y double"), spark.createDataFrame(targets, "date int, target_id int, x1 double, x2 double").repartition(5)


@pytest.mark.parametrize(("spacing", "across", "most", "alone"), [(0.5, 8, 2e-2, 3e-3), (0.25, 32, 2e-4, 2e-4)])
def test_covariance_is_that_of_the_process(spark, spacing, across, most, alone):
    """Mean and covariance that the samples stand for, worked out exactly, within the errors that the module states.

    alone: the bound of variances, which tiles do not change; the second case has no two tiles of a colour.
    """
    at, context = plane(500)
    c, w = frames(spark, at, context)
    found = joint_samples.sample_fields(c, w, LENGTH, NOISE, samples=len(at), k=100, spacing=spacing, across=across, drawn_from=unit).toPandas().sort_values(["date", "target_id"])
    assert len(found) == 2 * len(at)
    for d in (1, 2):
        mine = found[found["date"] == d]
        rows = np.array([r[1:] for r in context if r[0] == d and r[3] is not None]).reshape(-1, 3)
        mean, cov = predictors.gp_posterior(rows[:, :2], rows[:, 2], at, LENGTH, NOISE, joint=True)
        names = [f"sample_{s}" for s in range(1, len(at) + 1)]
        root = mine[names].to_numpy()
        silent = np.median(root, axis=1)  # a sample of a target that is no knot: all zero
        assert np.abs(silent - mean).max() < 1e-6
        root = root - silent[:, None]
        assert np.abs(mine["mean"].to_numpy() - mean).max() < 1e-6
        off = np.abs(root @ root.T - cov)
        assert off.max() < most and np.diag(off).max() < alone


def test_rows_do_not_depend_on_partitions_or_chunks(spark, monkeypatch):
    at, context = plane(300, 2)
    c, w = frames(spark, at, context)
    draw = lambda *a: joint_samples.sample_fields(*a, LENGTH, NOISE, samples=2, seed=5).toPandas().sort_values(["date", "target_id"]).to_numpy()
    first = draw(c, w)
    monkeypatch.setattr(joint_samples, "CHUNK", 7)
    assert np.allclose(first, draw(c.repartition(3), w.repartition(2)), atol=1e-9)
    monkeypatch.setattr(joint_samples, "_small", lambda sizes: False)
    assert np.allclose(first, draw(c, w), atol=1e-9)
    other = joint_samples.sample_fields(c, w, LENGTH, NOISE, samples=2, seed=6).toPandas().sort_values(["date", "target_id"]).to_numpy()
    assert np.abs(first[:, 3:] - other[:, 3:]).max() > 0.1 and np.allclose(first[:, 2], other[:, 2])


def test_spread_of_many_samples(spark):
    """Normal values as they are drawn: deviations near those of the process."""
    at, context = plane(60, 3)
    c, w = frames(spark, at, context)
    found = joint_samples.sample_fields(c, w, LENGTH, NOISE, samples=1500, k=100).toPandas().sort_values(["date", "target_id"])
    for d in (1, 2):
        rows = np.array([r[1:] for r in context if r[0] == d and r[3] is not None]).reshape(-1, 3)
        mean, std = predictors.gp_posterior(rows[:, :2], rows[:, 2], at, LENGTH, NOISE)
        mine = found[found["date"] == d].iloc[:, 3:].to_numpy()
        assert np.abs(mine.mean(1) - mean).max() < 0.15 and np.abs(mine.std(1) - std).max() < 0.15


def test_empty_inputs(spark):
    at, context = plane(20)
    c, w = frames(spark, at, context)
    assert joint_samples.sample_fields(c, w.limit(0), LENGTH).count() == 0
    prior = joint_samples.sample_fields(c.limit(0), w, LENGTH, samples=2)
    assert prior.count() == 40 and prior.where("mean <> 0").count() == 0
    with pytest.raises(ValueError):
        joint_samples.sample_fields(c, w, LENGTH, samples=0)


def test_a_grid_too_large_for_one_covariance(spark):
    """Forty thousand cells with all of them as context: close to the values, one row a cell."""
    n = 200
    cells = spark.range(n * n).select(F.lit(1).alias("date"), F.col("id").alias("target_id"), (F.floor(F.col("id") / n) / n).alias("x1"), (F.col("id") % n / F.lit(n)).alias("x2"))
    seen = cells.withColumn("y", F.sin(F.col("x1") * 9) * F.cos(F.col("x2") * 7))
    found = joint_samples.sample_fields(seen, cells.drop("y"), 0.1, 1e-2, samples=2).join(seen, ["date", "target_id"])
    worst = found.agg(F.count("*").alias("n"), F.max(F.abs(F.col("sample_1") - F.col("y"))).alias("off"), F.avg(F.abs(F.col("sample_1") - F.col("sample_2"))).alias("apart")).first()
    assert worst["n"] == n * n and worst["off"] < 0.5 and 0 < worst["apart"] < 0.2
