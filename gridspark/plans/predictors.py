"""Predictors of mean (and deviation) at cells or points from a task's context."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.plans.smoothing import kernel_sums

#: Targets at most that may meet the whole context; also the bound of what is broadcast.
TARGETS = 10_000
JOINT_TARGETS = 2_000


def setconv(context: DataFrame, targets: DataFrame, length: float, reach: float | None = None, by: tuple[str, ...] = ("date",), every: bool = False) -> DataFrame:
    """Kernel mean sum(w y) / sum(w) with w = exp(-d2 / (2 length2)), and density sum(w).

    context: by, x1, x2, y; targets: target_id, x1, x2. With a reach (a bound of the distance), both sides are cut in
    squares of that size and joined on neighbouring squares, so no target meets the whole context. A target without
    context in reach has no row, or with `every` one of density 0 and null mean for each date of the context.
    """
    t = targets.select("target_id", F.col("x1").alias("t1"), F.col("x2").alias("t2"))
    c = context.where(F.col("y").isNotNull())
    d2 = F.pow(F.col("x1") - F.col("t1"), 2) + F.pow(F.col("x2") - F.col("t2"), 2)
    if reach is None:
        if t.limit(TARGETS + 1).count() > TARGETS:
            raise ValueError(f"more than {TARGETS} targets need a reach; smooth() takes a grid of any size")
        pairs = c.crossJoin(F.broadcast(t))
    else:
        square = lambda x: F.floor(x / F.lit(reach))
        near = t.withColumn("i", F.explode(F.array(*[square(F.col("t1")) + k for k in (-1, 0, 1)]))).withColumn("j", F.explode(F.array(*[square(F.col("t2")) + k for k in (-1, 0, 1)])))
        pairs = c.withColumns({"i": square(F.col("x1")), "j": square(F.col("x2"))}).join(near, ["i", "j"]).where(d2 <= reach * reach)
    w = F.exp(-d2 / F.lit(2 * length * length))
    found = pairs.groupBy(*by, "target_id").agg((F.sum(w * F.col("y")) / F.sum(w)).alias("mean"), F.sum(w).alias("density"))
    if not every:
        return found
    all_rows = c.select(*by).distinct().crossJoin(t.select("target_id").distinct())
    return all_rows.join(found, [*by, "target_id"], "left").fillna(0.0, ["density"])


def gp_posterior(x: np.ndarray, y: np.ndarray, at: np.ndarray, length: float, noise: float, scale: float = 1.0, joint: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation (joint: covariance) of a Gaussian process with a squared exponential kernel.

    No context gives the prior.
    """
    kernel = lambda a, b: scale * np.exp(-((a[:, None, :] - b[None, :, :]) ** 2).sum(-1) / (2 * length**2))
    if len(x):
        low = np.linalg.cholesky(kernel(x, x) + (noise + 1e-10) * np.eye(len(x)))
        half = np.linalg.solve(low, kernel(at, x).T)
        mean = half.T @ np.linalg.solve(low, y)
    else:
        half, mean = np.zeros((1, len(at))), np.zeros(len(at))
    if joint:
        return mean, kernel(at, at) - half.T @ half
    return mean, np.sqrt(np.maximum(scale - (half**2).sum(0), 0.0))


def gp_predict(context: DataFrame, targets: DataFrame, length: float, noise: float = 1e-2, samples: int = 0, seed: int = 0, most: int = 500, subsample: int = 1) -> DataFrame:
    """date, target_id, mean, std (and sample_1.. drawn jointly): one small Cholesky for each date.

    subsample: draw samples at every so manieth target only (in the order of target_id), and give the other targets
    the mean that follows from the context and the drawn values. It is what drawing target by target, each value
    joining the context of the next, comes to for a Gaussian process, at a fraction of the cost.

    For sampled context: `most` points a date at most, beyond which it raises (use setconv for whole grids). The
    context of each date is a group of that size; the targets (TARGETS at most, JOINT_TARGETS with samples, whose
    covariance is a square of that size) are sent to all tasks, as a list of stations is.
    """
    bound = min(JOINT_TARGETS * subsample, TARGETS) if samples else TARGETS
    if targets.limit(bound + 1).count() > bound:
        raise ValueError(f"gp_predict takes {bound} targets")
    points = targets.select("target_id", "x1", "x2").orderBy("target_id").toPandas()
    at, kind = points[["x1", "x2"]].to_numpy(float), targets.schema["target_id"].dataType.simpleString()
    extra = "".join(f", sample_{k + 1} double" for k in range(samples))

    def solve(key: tuple[Any, ...], group: pd.DataFrame) -> pd.DataFrame:
        group = group.dropna(subset=["y"]).sort_values(["x1", "x2", "y"])
        if len(group) > most:
            raise ValueError(f"{len(group)} context points; gp_predict takes {most}")
        mean, std = gp_posterior(group[["x1", "x2"]].to_numpy(float), group["y"].to_numpy(float), at, length, noise)
        out = pd.DataFrame({"date": key[0], "target_id": points["target_id"], "mean": mean, "std": std})
        if samples:
            x, y, some = group[["x1", "x2"]].to_numpy(float), group["y"].to_numpy(float), np.arange(0, len(at), subsample)
            start, cov = gp_posterior(x, y, at[some], length, noise, joint=True)
            values, vectors = np.linalg.eigh(cov)
            root = vectors * np.sqrt(np.maximum(values, 0.0))
            drawn = np.random.default_rng(seed).standard_normal((len(some), samples))
            for k in range(samples):
                values_there = start + root @ drawn[:, k]
                field = values_there if subsample == 1 else gp_posterior(np.concatenate((x, at[some])), np.concatenate((y, values_there)), at, length, noise)[0]
                if subsample > 1:
                    field[some] = values_there
                out[f"sample_{k + 1}"] = field
        return out

    date = context.schema["date"].dataType.simpleString()
    return context.select("date", "x1", "x2", "y").groupBy("date").applyInPandas(solve, f"date {date}, target_id {kind}, mean double, std double{extra}")


class Predictor(Protocol):
    """What the flow needs of a model: date, target_id, mean, std for every row of `wanted`.

    context: date, x1, x2, y; wanted: date, target_id, x1, x2 (a target has one place on all dates). A date without context has the prior: mean 0 (in model
    space), and deviation 1 where the model has one. layers: static frames (x1, x2, y), for models that use them.
    """

    def predict(self, context: DataFrame, wanted: DataFrame, layers: Sequence[DataFrame] = ()) -> DataFrame: ...

    def parameters(self) -> dict[str, float | None]: ...


@dataclass(frozen=True)
class SetConv:
    """The kernel mean over the whole context (context of any size), or over what lies within a reach (sampled context).

    It has no deviation (std is null).
    """

    length: float
    reach: float | None = None

    def predict(self, context: DataFrame, wanted: DataFrame, layers: Sequence[DataFrame] = ()) -> DataFrame:
        found = kernel_sums(context, wanted, self.length, self.length, None if self.reach is None else self.reach / self.length)
        mean = F.coalesce(F.col("signal") / F.nullif("density", F.lit(0.0)), F.lit(0.0))
        return found.select("date", "target_id", mean.alias("mean"), F.lit(None).cast("double").alias("std"))

    def parameters(self) -> dict[str, float | None]:
        return {"length": self.length, "reach": self.reach}


@dataclass(frozen=True)
class Kernel:
    """The kernel mean with a length for each axis, drawn to the prior mean 0 as if `prior` points had said so.

    sum(w y) / (sum(w) + prior): far from all context it tends to 0. Its first three parameters are what training learns.
    reach, in lengths: how far context counts, for sampled context; without it all of it, for context of any size.
    """

    length1: float
    length2: float
    prior: float = 0.0
    reach: float | None = None

    def predict(self, context: DataFrame, wanted: DataFrame, layers: Sequence[DataFrame] = ()) -> DataFrame:
        found = kernel_sums(context, wanted, self.length1, self.length2, self.reach)
        return found.select("date", "target_id", self.mean().alias("mean"), F.lit(None).cast("double").alias("std"))

    def mean(self) -> Column:
        weight = F.col("density") + F.lit(self.prior)
        return F.when(weight > 0, F.col("signal") / weight).otherwise(0.0)

    def parameters(self) -> dict[str, float | None]:
        return {"length1": self.length1, "length2": self.length2, "prior": self.prior, "reach": self.reach}


@dataclass(frozen=True)
class GaussianProcess:
    """Mean and deviation from a sampled context."""

    length: float
    noise: float = 1e-2
    most: int = 500

    def predict(self, context: DataFrame, wanted: DataFrame, layers: Sequence[DataFrame] = ()) -> DataFrame:
        found = gp_predict(context, wanted.select("target_id", "x1", "x2").dropDuplicates(["target_id"]), self.length, self.noise, most=self.most)
        joined = wanted.select("date", "target_id").join(found, ["date", "target_id"], "left")
        return joined.select("date", "target_id", F.coalesce("mean", F.lit(0.0)).alias("mean"), F.coalesce("std", F.lit(1.0)).alias("std"))

    def parameters(self) -> dict[str, float | None]:
        return {"length": self.length, "noise": self.noise, "most": float(self.most)}


def store(spark: SparkSession, predictor: Predictor) -> DataFrame:
    """One row that predictor_of() turns back: kind, parameters."""
    return spark.createDataFrame([(type(predictor).__name__, {k: float(v) for k, v in predictor.parameters().items() if v is not None})], "kind string, parameters map<string,double>")


def predictor_of(stored: DataFrame) -> Predictor:
    row = stored.first()
    found = dict(row["parameters"])
    if row["kind"] == "SetConv":
        return SetConv(**found)
    if row["kind"] == "LayerReadout":
        from gridspark.plans.readout import readout_of

        return readout_of(found)
    if row["kind"] == "NearestProcess":
        from gridspark.plans.neighbours import NearestProcess

        return NearestProcess(**{**found, "k": int(found["k"])})
    if row["kind"] == "Kernel":
        return Kernel(**found)
    if row["kind"] == "GaussianProcess":
        return GaussianProcess(**{**found, "most": int(found.get("most", 500))})
    raise ValueError(f"unknown predictor {row['kind']}")


def tune(context: DataFrame, truth: DataFrame, targets: DataFrame, lengths: list[float]) -> list[tuple[float, float]]:
    """(length, pooled error) of each kernel length on held-out truth (date, target_id, y)."""
    from gridspark.plans.metrics import rmse

    return [(s, rmse(setconv(context, targets, s), truth, ["date", "target_id"]).first()["rmse"]) for s in lengths]
