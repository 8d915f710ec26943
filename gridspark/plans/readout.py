"""A linear read-out over channels of all context sets, fitted by ridge regression.

The channels of a target are: 1; the kernel mean of the date's sampled context and its density (how much context there
is, 0 to 1); each static layer (mask, depth) as the kernel carries it to the target, and its product with the mean. So a
shallow cell may answer to its neighbours in another way than a deep one. The fit is one aggregate: the sums of products
of all channels over all targets of all tasks, (channels + 1)**2 numbers, whatever the rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.plans.predictors import Kernel
from gridspark.plans.smoothing import kernel_sums, smooth


def channels(context: DataFrame, wanted: DataFrame, kernel: Kernel, layers: Sequence[DataFrame]) -> DataFrame:
    """date, target_id, f0, f1, ... for every row of wanted; a target keeps its place on all dates."""
    sums = kernel_sums(context, wanted, kernel.length1, kernel.length2, kernel.reach)
    weight = F.col("density") + F.lit(kernel.prior)
    out = sums.select("date", "target_id", F.lit(1.0).alias("f0"), kernel.mean().alias("f1"), F.when(weight > 0, F.col("density") / weight).otherwise(0.0).alias("f2"))
    places = wanted.select(F.lit(0).alias("date"), "target_id", "x1", "x2").dropDuplicates(["target_id"])
    for k, layer in enumerate(layers):
        there = smooth(layer.select(F.lit(0).alias("date"), "x1", "x2", "y"), places, kernel.length1, kernel.length2)
        z = there.select("target_id", F.coalesce(F.col("signal") / F.nullif("density", F.lit(0.0)), F.lit(0.0)).alias(f"f{3 + 2 * k}"))
        out = out.join(z, "target_id").withColumn(f"f{4 + 2 * k}", F.col(f"f{3 + 2 * k}") * F.col("f1"))
    return out


def normal_equations(context: DataFrame, targets: DataFrame, kernel: Kernel, layers: Sequence[DataFrame]) -> DataFrame:
    """i, j, value: the sums of products of channels i <= j; the last number stands for y."""
    found = channels(context, targets.drop("y"), kernel, layers).join(targets.where("y is not null").select("date", "target_id", "y"), ["date", "target_id"])
    names = [c for c in found.columns if c.startswith("f")] + ["y"]
    rows = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.sum(F.col(a) * F.col(b)).alias("value")) for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]
    return found.agg(F.array(*rows).alias("rows")).select(F.explode("rows").alias("r")).select("r.*")


@dataclass(frozen=True)
class LayerReadout:
    """Mean and deviation (of what was left in training) from all context sets. The layers must be those of the fit."""

    length1: float
    length2: float
    prior: float
    weights: tuple[float, ...]
    deviation: float
    reach: float | None = None

    def predict(self, context: DataFrame, wanted: DataFrame, layers: Sequence[DataFrame] = ()) -> DataFrame:
        if len(self.weights) != 3 + 2 * len(layers):
            raise ValueError(f"{len(layers)} layers; the read-out was fitted with {(len(self.weights) - 3) // 2}")
        mean = reduce(lambda a, b: a + b, (F.col(f"f{k}") * w for k, w in enumerate(self.weights)))
        found = channels(context, wanted, Kernel(self.length1, self.length2, self.prior, self.reach), layers)
        return found.select("date", "target_id", mean.alias("mean"), F.lit(self.deviation).alias("std"))

    def parameters(self) -> dict[str, float | None]:
        return {"length1": self.length1, "length2": self.length2, "prior": self.prior, "deviation": self.deviation, "reach": self.reach} | {f"w{k}": w for k, w in enumerate(self.weights)}


def readout_of(parameters: dict[str, float]) -> LayerReadout:
    weights = tuple(parameters[f"w{k}"] for k in range(sum(name[0] == "w" for name in parameters)))
    return LayerReadout(*(parameters[n] for n in ("length1", "length2", "prior")), weights, parameters["deviation"], parameters.get("reach"))


def fit(context: DataFrame, targets: DataFrame, kernel: Kernel, layers: Sequence[DataFrame], ridge: float = 1e-3) -> LayerReadout:
    """The weights that minimise the mean square error plus ridge times their squares, that of f0 left out.

    targets: date, target_id, x1, x2, y. Without targets the weights are 0.
    """
    p = 3 + 2 * len(layers)
    full = np.zeros((p + 1, p + 1))
    for r in normal_equations(context, targets, kernel, layers).collect():  # (p + 1)(p + 2) / 2 rows
        full[r["i"], r["j"]] = full[r["j"], r["i"]] = r["value"] or 0.0
    n, gram, right = max(full[0, 0], 1.0), full[:p, :p], full[:p, p]
    penalty = ridge * n * np.diag([0.0] + [1.0] * (p - 1))
    weights = np.linalg.lstsq(gram + penalty, right, rcond=None)[0]
    left = max(full[p, p] - 2 * weights @ right + weights @ gram @ weights, 0.0) / n
    return LayerReadout(kernel.length1, kernel.length2, kernel.prior, tuple(map(float, weights)), float(np.sqrt(left)), kernel.reach)
