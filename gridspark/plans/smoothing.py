"""Kernel sums at targets without meeting every pair: one pass along each axis.

The kernel exp(-d1**2 / (2 l1**2) - d2**2 / (2 l2**2)) is a product, so the sum over all context points of a date is taken
first along x1 within each line of equal x2, then along x2 within each line of equal target x1. A grid of n1 x n2 cells
costs n1 * n2 * (n1 + n2) multiplications in place of (n1 * n2)**2, and what a task holds is some lines. Points anywhere
are taken too, they only share fewer lines. The derivatives by the logarithms of both lengths are sums of the same form.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Points of a line, and different x1 of a date's targets, at most; a task's kernel matrix is a square of that size.
LINE = 8192


def _lists(column) -> list[tuple[np.ndarray, ...]]:
    """The fields of each row's list of structs, as arrays."""
    flat, cuts = column.flatten(), np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))[:-1]
    return list(zip(*(np.split(flat.field(i).to_numpy(zero_copy_only=False), cuts) for i in range(flat.type.num_fields)))) if len(column) else []


def _bounded(n: int) -> None:
    if n > LINE:
        raise ValueError(f"a line of {n} points; smooth takes {LINE} (give setconv a reach)")


def kernels(at: np.ndarray, x: np.ndarray, length: float, gradient: bool) -> list[np.ndarray]:
    """The kernel between two sets of coordinates and, with gradient, its derivative by the length's logarithm."""
    q = ((at[:, None] - x[None, :]) / length) ** 2
    w = np.exp(-q / 2)
    return [w, w * q] if gradient else [w]


def _along_x1(batches, length: float, gradient: bool):
    """Rows (date, t1, x2, sums...): the sums of y and of 1 (and of their derivatives) along a line, at each t1 of its date."""
    for b in batches:
        lines = zip(range(len(b)), _lists(b.column(2)), b.column(3).to_pylist())
        for at, part in groupby(lines, key=lambda r: r[2]):
            rows = list(part)
            t1 = np.array(at)
            _bounded(max(len(t1), *(len(r[1][0]) for r in rows)))
            axis = np.unique(np.concatenate([r[1][0] for r in rows]))
            shared = kernels(t1, axis, length, gradient) if len(axis) <= LINE else None  # for all lines of the batch
            for i, (x1, y, n), _ in rows:
                found = kernels(t1, x1, length, gradient) if shared is None else [w[:, np.searchsorted(axis, x1)] for w in shared]
                sums = [w @ v for w in found for v in (y, n)]
                met = np.flatnonzero(sums[1] > 0)
                own = pa.array(np.full(len(met), i))
                yield pa.RecordBatch.from_arrays([b.column(0).take(own), pa.array(t1[met]), b.column(1).take(own), *(pa.array(s[met]) for s in sums)], names=["date", "t1", "x2", *_sums(gradient)])


def _sums(gradient: bool) -> list[str]:
    return ["s", "d", "s1", "d1"] if gradient else ["s", "d"]


def _along_x2(batches, length: float, gradient: bool):
    """Rows (date, target_id, sums...) at the targets of a line of equal t1."""
    for b in batches:
        ids, flat = b.column(1).flatten().field(0), b.column(1).flatten().field(1).to_numpy(zero_copy_only=False)
        ends = np.cumsum(b.column(1).value_lengths().to_numpy(zero_copy_only=False))
        targets = zip((ends - b.column(1).value_lengths().to_numpy(zero_copy_only=False)).tolist(), ends.tolist())
        lines = _lists(pc.coalesce(b.column(2), pa.scalar([], b.column(2).type)))
        for i, ((begin, end), (x2, *sums)) in enumerate(zip(targets, lines)):
            _bounded(len(x2))
            t2, columns = flat[begin:end], []
            for k in range(0, len(t2), LINE):
                found = kernels(t2[k : k + LINE], x2, length, gradient)
                w = found[0]
                here = [w @ v for v in sums] + ([found[1] @ v for v in sums[:2]] if gradient else [])
                columns.append(here)
            out = [np.concatenate(c) for c in zip(*columns)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.full(len(t2), i))), ids.slice(begin, end - begin), *map(pa.array, out)], names=["date", "target_id", *NAMES[: len(out)]])


NAMES = ("signal", "density", "signal_1", "density_1", "signal_2", "density_2")


def smooth(context: DataFrame, wanted: DataFrame, length1: float, length2: float | None = None, gradient: bool = False) -> DataFrame:
    """date, target_id, signal (sum of w y), density (sum of w) for every row of `wanted`; 0 where a date has no context.

    context: date, x1, x2, y (null y is no context); wanted: date, target_id, x1, x2, each target once a date. With
    gradient also signal_1, density_1, signal_2, density_2: the derivatives by the logarithms of length1 and length2.
    """
    dated, kind = (wanted.schema[c].dataType for c in ("date", "target_id"))
    length2 = length1 if length2 is None else length2
    cells = context.where("y is not null").groupBy("date", "x1", "x2").agg(F.sum("y").alias("y"), F.count("*").cast("double").alias("n"))
    lines = cells.groupBy("date", "x2").agg(F.array_sort(F.collect_list(F.struct("x1", "y", "n"))).alias("line"))
    at = wanted.groupBy("date").agg(F.array_sort(F.collect_set("x1")).alias("at"))
    names = _sums(gradient)
    first = lines.join(at, "date").select("date", "x2", "line", "at").mapInArrow(lambda batches: _along_x1(batches, length1, gradient), f"date {dated.simpleString()}, t1 double, x2 double, {', '.join(f'{n} double' for n in names)}")
    across = first.groupBy("date", "t1").agg(F.array_sort(F.collect_list(F.struct("x2", *names))).alias("line"))
    targets = wanted.groupBy("date", F.col("x1").alias("t1")).agg(F.collect_list(F.struct("target_id", F.col("x2").alias("t2"))).alias("targets"))
    met = targets.join(across, ["date", "t1"], "left").select("date", "targets", "line")
    out = NAMES if gradient else NAMES[:2]
    return met.mapInArrow(lambda batches: _along_x2(batches, length2, gradient), f"date {dated.simpleString()}, target_id {kind.simpleString()}, {', '.join(f'{n} double' for n in out)}")


def within_reach(context: DataFrame, wanted: DataFrame, length1: float, length2: float, reach: float, gradient: bool = False) -> DataFrame:
    """What smooth() gives, over context within `reach` lengths alone, by meeting each target's near points.

    For sampled context: each of its points is written to nine cells of reach lengths, each target to one, and a target
    meets what shares its cell. From 8 lengths on, weights left out are under 2e-14.
    """
    cell1, cell2 = (lambda x, width=reach * length: F.floor(x / F.lit(width)) for length in (length1, length2))
    around = lambda c, cell: F.explode(F.array(*[cell(F.col(c)) + k for k in (-1, 0, 1)]))
    near = context.where("y is not null").select(F.col("date").alias("of"), F.col("x1").alias("c1"), F.col("x2").alias("c2"), "y").withColumn("i", around("c1", cell1)).withColumn("j", around("c2", cell2))
    q1, q2 = F.pow((F.col("c1") - F.col("x1")) / F.lit(length1), 2), F.pow((F.col("c2") - F.col("x2")) / F.lit(length2), 2)
    met = wanted.select("date", "target_id", "x1", "x2").join(near, (F.col("date") == F.col("of")) & (cell1(F.col("x1")) == F.col("i")) & (cell2(F.col("x2")) == F.col("j")) & (q1 + q2 <= reach * reach), "left")
    w = F.exp(-(q1 + q2) / 2)
    terms = [w * F.col("y"), w] + ([w * q * v for q in (q1, q2) for v in (F.col("y"), F.lit(1.0))] if gradient else [])
    return met.groupBy("date", "target_id").agg(*[F.coalesce(F.sum(t), F.lit(0.0)).alias(n) for n, t in zip(NAMES, terms)])


def kernel_sums(context: DataFrame, wanted: DataFrame, length1: float, length2: float, reach: float | None, gradient: bool = False) -> DataFrame:
    if reach is None:
        return smooth(context, wanted, length1, length2, gradient)
    return within_reach(context, wanted, length1, length2, reach, gradient)
