"""Gradient descent for the kernel predictor: gradients are grouped sums over targets and tasks, the state three numbers.

The loss is the mean over tasks of each task's mean square error. With m = S / (D + p), where S and D are the sums of
w y and of w at a target, the derivatives by log l1 and log l2 are (S' - m D') / (D + p), with the sums' own derivatives
from the same two passes, and the one by log p is -m p / (D + p). Parameters are kept as logarithms, so any step leaves
them above 0. Steps are Adam's (Kingma and Ba 2015).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridspark.plans import runs
from gridspark.plans.predictors import Kernel
from gridspark.plans.smoothing import kernel_sums

BETA1, BETA2, EPSILON = 0.9, 0.999, 1e-8
#: The least prior that a logarithm is taken of.
PRIOR = 1e-6


@dataclass(frozen=True)
class State:
    """Where training stands after some epochs: logarithms of the parameters, and Adam's two running means."""

    log: tuple[float, float, float]
    first: tuple[float, float, float] = (0.0, 0.0, 0.0)
    second: tuple[float, float, float] = (0.0, 0.0, 0.0)
    steps: int = 0
    epoch: int = 0
    best: float = float("inf")

    def kernel(self, reach: float | None = None) -> Kernel:
        return Kernel(*map(math.exp, self.log), reach)


def begin(start: Kernel) -> State:
    return State(tuple(math.log(max(x, PRIOR)) for x in (start.length1, start.length2, start.prior)))


def errors(context: DataFrame, targets: DataFrame, kernel: Kernel) -> DataFrame:
    """date, target_id, square (of the error), g1, g2, g3 (its derivatives by the logarithms of the parameters)."""
    sums = kernel_sums(context, targets, kernel.length1, kernel.length2, kernel.reach, gradient=True)
    weight = F.col("density") + F.lit(kernel.prior)
    over = lambda c: F.when(weight > 0, c / weight).otherwise(0.0)
    m = F.col("mean")
    known = sums.withColumn("mean", kernel.mean()).join(targets.where("y is not null").select("date", "target_id", "y"), ["date", "target_id"])
    slopes = [over(F.col("signal_1") - m * F.col("density_1")), over(F.col("signal_2") - m * F.col("density_2")), over(-m * F.lit(kernel.prior))]
    return known.select("date", "target_id", F.pow(m - F.col("y"), 2).alias("square"), *[(2 * (m - F.col("y")) * g).alias(f"g{k}") for k, g in enumerate(slopes, 1)])


def gradient(context: DataFrame, targets: DataFrame, kernel: Kernel) -> tuple[int, float | None, float, float, float]:
    """(tasks, loss, its three derivatives) by means within tasks, then over them: one row comes to the driver."""
    each = errors(context, targets, kernel).groupBy("date").agg(*[F.avg(c).alias(c) for c in ("square", "g1", "g2", "g3")])
    found = each.agg(F.count("*"), *[F.avg(c) for c in ("square", "g1", "g2", "g3")]).first()
    return (found[0], found[1], *(x or 0.0 for x in found[2:]))


def step(state: State, slopes: tuple[float, ...], rate: float) -> State:
    n = state.steps + 1
    first = tuple(BETA1 * m + (1 - BETA1) * g for m, g in zip(state.first, slopes))
    second = tuple(BETA2 * v + (1 - BETA2) * g * g for v, g in zip(state.second, slopes))
    log = tuple(x - rate * (m / (1 - BETA1**n)) / (math.sqrt(v / (1 - BETA2**n)) + EPSILON) for x, m, v in zip(state.log, first, second))
    return replace(state, log=log, first=first, second=second, steps=n)


def batches(points: DataFrame, size: int | None) -> Iterator[DataFrame]:
    """The tasks in batches of so many dates, in order of date; static layers, under a null date, are left out."""
    if size is None:
        yield points
        return
    dates = points.where("role = 'target'").select("date").distinct()
    numbered = dates.withColumn("batch", F.floor((F.row_number().over(Window.orderBy("date")) - 1) / size))  # a row a date
    for k in range(-(-dates.count() // size)):
        yield points.join(F.broadcast(numbered.where(F.col("batch") == k).select("date")), "date", "left_semi")  # `size` rows


def save(spark: SparkSession, state: State, output: str) -> None:
    row = asdict(state)
    runs.save(spark.createDataFrame([tuple(list(v) if isinstance(v, tuple) else v for v in row.values())], "log array<double>, first array<double>, second array<double>, steps int, epoch int, best double"), f"{output}/state/version={state.epoch}")


def load(spark: SparkSession, output: str | None, start: Kernel) -> State:
    """The state stored last, or the beginning where there is none."""
    if output is None or not runs.exists(spark, f"{output}/state"):
        return begin(start)
    row = runs.load_best(spark, f"{output}/state").first()
    return State(tuple(row["log"]), tuple(row["first"]), tuple(row["second"]), row["steps"], row["epoch"], row["best"])
