"""Prediction tasks as one long table, built for all dates at once."""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.operators.fields import within
from gridspark.operators.sampling import Sampling, sample

#: Times that are sent to all tasks at most.
TIMES = 100_000


def attach_times(static: DataFrame, times: DataFrame) -> DataFrame:
    """Every row of a layer without time under every row of a series without place (the outer product).

    The series, a row for each date, is broadcast; nothing is shuffled.
    """
    if times.limit(TIMES + 1).count() > TIMES:
        raise ValueError(f"attach_times takes {TIMES} times")
    return static.crossJoin(F.broadcast(times))


def load(tasks: DataFrame) -> DataFrame:
    """The tasks, kept from the first use on in memory or, where that is short, on disk."""
    return tasks.persist(StorageLevel.MEMORY_AND_DISK)


def build(context: list[tuple[DataFrame, Sampling]], target: tuple[DataFrame, Sampling] | None, dates: DataFrame, mask: DataFrame | None = None, repeat_static: bool = True) -> DataFrame:
    """date, role, set_idx, cell_id, x1, x2, y.

    context and target frames: (date, cell_id, x1, x2, y); a frame without date is static and joins every date, or,
    without repeat_static, is kept once, under a null date that stands for all (a grid of a million cells need not be
    written for each of thousands of dates). mask: cells (cell_id) that the first context set is drawn from.
    """
    if mask is not None and context:
        context = [(within(context[0][0], mask), context[0][1]), *context[1:]]
    sets = [("context", k, df, how) for k, (df, how) in enumerate(context)]
    if target is not None:
        sets.append(("target", 0, *target))
    parts = []
    for role, k, df, how in sets:
        if "date" in df.columns:
            dated = df.join(dates, "date", "left_semi")
        else:
            dated = dates.crossJoin(df) if repeat_static else df.withColumn("date", F.lit(None).cast(dates.schema["date"].dataType))
        parts.append(sample(dated, how).select("date", F.lit(role).alias("role"), F.lit(k).alias("set_idx"), "cell_id", "x1", "x2", F.col("y").cast("double").alias("y")))
    return reduce(DataFrame.unionByName, parts)
