"""Nearest context points, and the Gaussian process conditioned on them alone.

The nearest points come from an exact grid join with growing cells: a target meets what lies in the nine cells about it,
and is settled once its k-th distance is no more than a cell's width, as whatever it has not met is farther off, or once
it has met all of its date's context. The others go on with cells of twice the width. So a full grid of context costs
each target some multiple of k rows, and no task sees a whole date.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridspark.sources import tables

#: Context points that the nine cells hold on average at first, as a multiple of k.
FIRST = 4
#: Targets whose systems are solved at once.
SOLVED = 512


def nearest(context: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """date, target_id, near: the k nearest context points of each target, an array of (d2, x1, x2, y) in that order.

    Fewer where a date has fewer; targets of dates without context have no row. Null y is no context. Rounds are stored
    tables, each with the targets that the round before could not settle.
    """
    place = Window.partitionBy("date", "x1", "x2").orderBy("y")
    points = context.where("y is not null").select("date", "x1", "x2", "y").withColumn("__n", F.row_number().over(place)).where(F.col("__n") <= k).drop("__n")
    sizes = points.groupBy("date").agg(F.count("*").alias("most"))
    seen = points.agg(F.count("*"), F.count_distinct("date"), F.min("x1"), F.max("x1"), F.min("x2"), F.max("x2")).first()
    kinds = {c: wanted.schema[c].dataType.simpleString() for c in ("date", "target_id")}
    if not seen[0]:
        return wanted.sparkSession.createDataFrame([], f"date {kinds['date']}, target_id {kinds['target_id']}, near array<struct<d2:double,x1:double,x2:double,y:double>>")
    wide, high = seen[3] - seen[2], seen[5] - seen[4]
    area = (wide or high or 1.0) * (high or wide or 1.0)
    width = float(np.sqrt(FIRST * k * area * seen[1] / (9 * seen[0])))
    cells = points.select(F.col("date").alias("of"), F.col("x1").alias("c1"), F.col("x2").alias("c2"), "y")
    left = wanted.select("date", "target_id", F.col("x1").alias("t1"), F.col("x2").alias("t2")).join(sizes, "date")
    done = []
    while True:
        cell = lambda c, width=width: F.floor(F.col(c) / F.lit(width))
        around = left.withColumn("i", F.explode(F.array(*[cell("t1") + d for d in (-1, 0, 1)]))).withColumn("j", F.explode(F.array(*[cell("t2") + d for d in (-1, 0, 1)])))
        met = around.join(cells.withColumns({"ci": cell("c1"), "cj": cell("c2")}), (F.col("date") == F.col("of")) & (F.col("i") == F.col("ci")) & (F.col("j") == F.col("cj")))
        d2 = F.pow(F.col("c1") - F.col("t1"), 2) + F.pow(F.col("c2") - F.col("t2"), 2)
        ranked = met.withColumn("d2", d2).withColumn("__r", F.row_number().over(Window.partitionBy("date", "target_id").orderBy("d2", "c1", "c2", "y"))).where(F.col("__r") <= k)
        lists = ranked.groupBy("date", "target_id").agg(F.array_sort(F.collect_list(F.struct("d2", F.col("c1").alias("x1"), F.col("c2").alias("x2"), "y"))).alias("near"))
        enough = (F.size("near") == F.col("most")) | ((F.size("near") == k) & (F.element_at("near", -1)["d2"] <= width * width))
        tried = tables.stored(left.join(lists, ["date", "target_id"], "left").withColumn("settled", F.coalesce(F.col("near").isNotNull() & enough, F.lit(False))))
        done.append(tried.where("settled").select("date", "target_id", "near"))
        left = tried.where("not settled").select("date", "target_id", "t1", "t2", "most")
        if left.isEmpty():
            return reduce(DataFrame.unionByName, done)
        width *= 2


def conditionals(at: np.ndarray, x: np.ndarray, y: np.ndarray, length: float, noise: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation at targets (n, 2) that have the points (n, m, 2) and values (n, m) each."""
    gaps = x[:, :, None, :] - x[:, None, :, :]
    gram = np.exp(-(gaps**2).sum(-1) / (2 * length**2)) + (noise + 1e-10) * np.eye(x.shape[1])
    to = np.exp(-((x - at[:, None, :]) ** 2).sum(-1) / (2 * length**2))
    solved = np.linalg.solve(gram, np.stack((y, to), -1))
    return (to * solved[..., 0]).sum(1), np.sqrt(np.maximum(1 - (to * solved[..., 1]).sum(1), 0))


def _predicted(batches, length: float, noise: float):
    for b in batches:
        at = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in (2, 3)], 1)
        sizes = b.column(4).value_lengths().to_numpy(zero_copy_only=False)
        flat = np.stack([b.column(4).flatten().field(n).to_numpy(zero_copy_only=False) for n in (1, 2, 3)], 1) if sizes.sum() else np.zeros((0, 3))
        begin = np.cumsum(sizes) - sizes
        mean, std = np.zeros(len(sizes)), np.ones(len(sizes))
        for m in np.unique(sizes[sizes > 0]):
            rows = np.flatnonzero(sizes == m)
            for k in range(0, len(rows), SOLVED):
                some = rows[k : k + SOLVED]
                near = flat[begin[some, None] + np.arange(m)]
                mean[some], std[some] = conditionals(at[some], near[..., :2], near[..., 2], length, noise)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(mean), pa.array(std)], names=["date", "target_id", "mean", "std"])


@dataclass(frozen=True)
class NearestProcess:
    """A Gaussian process given the k nearest context points of each target: for context of any size.

    With k at least a date's context it is the whole process; with fewer, farther points count through nearer ones only.
    """

    length: float
    noise: float = 1e-2
    k: int = 32

    def predict(self, context: DataFrame, wanted: DataFrame, layers: Sequence[DataFrame] = ()) -> DataFrame:
        near = nearest(context, wanted, self.k)
        kinds = {c: wanted.schema[c].dataType.simpleString() for c in ("date", "target_id")}
        joined = wanted.select("date", "target_id", "x1", "x2").join(near, ["date", "target_id"], "left")
        shape = F.coalesce("near", F.array().cast(near.schema["near"].dataType))
        return joined.select("date", "target_id", "x1", "x2", shape.alias("near")).mapInArrow(lambda batches: _predicted(batches, self.length, self.noise), f"date {kinds['date']}, target_id {kinds['target_id']}, mean double, std double")

    def parameters(self) -> dict[str, float | None]:
        return {"length": self.length, "noise": self.noise, "k": float(self.k)}
