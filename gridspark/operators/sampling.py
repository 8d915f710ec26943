"""Reproducible sampling by hash order, alike in any partitioning."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Sampling:
    """How to draw a context or target set: all rows, n rows, a number from [low, high) for each task, or given cells.

    fixed: the same cells in every task.
    """

    n: int | None = None
    low: int | None = None
    high: int | None = None
    cells: tuple[int, ...] | None = None
    seed: int = 0
    fixed: bool = False


def order_key(key: Column, date: Column | None, seed: int) -> Column:
    parts = [key.cast("string"), F.lit(f":{seed}")] + ([] if date is None else [F.lit(":"), date.cast("string")])
    return F.md5(F.concat(*parts).cast("binary"))


def draws(date: Column, low: int, high: int, seed: int) -> Column:
    """A number in [low, high) for each date; low where they are equal."""
    if high <= low:
        return F.lit(low)
    return F.lit(low) + F.pmod(F.conv(F.substring(F.md5(F.concat(date.cast("string"), F.lit(f":n:{seed}")).cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(high - low)).cast("int")


def sample(df: DataFrame, how: Sampling, task: str = "date", cell: str = "cell_id") -> DataFrame:
    """Rows of each task under the sampling, without replacement; fewer than asked for gives all."""
    if how.cells is not None:
        return df.where(F.col(cell).isin(*how.cells))
    if how.n is None and how.low is None:
        return df
    date = None if how.fixed else F.col(task)
    most = F.lit(how.n) if how.n is not None else draws(F.col(task), how.low, how.high, how.seed)
    # the literal bound beside the drawn one lets each task's rows be cut before they are shuffled and sorted
    bound = how.n if how.n is not None else max(how.low, how.high - 1)
    order = Window.partitionBy(task).orderBy(order_key(F.col(cell), date, how.seed), cell)
    return df.withColumn("__k", F.row_number().over(order)).where((F.col("__k") <= bound) & (F.col("__k") <= most)).drop("__k")
