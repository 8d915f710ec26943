"""A climatology that new days are merged into: each micro-batch stores its sums and counts by day of year and cell.

A state folder has `batch=N` tables, one for each micro-batch, and at times a `merged=N` table that stands for all
batches up to N. A batch that is run again overwrites its own table, so nothing counts twice; sums and counts of any
split of the rows add up to those of one pass (with a scale, exactly).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def partial(df: DataFrame, value: str, cells: tuple[str, ...] = (), time: str = "time", scale: int | None = None) -> DataFrame:
    """doy, cells, total, n; with a scale, totals of values of at most so many decimals are decimals."""
    total = F.sum(F.col(value) if scale is None else F.col(value).cast(f"decimal(18,{scale})"))
    return df.groupBy(F.dayofyear(time).alias("doy"), *cells).agg(total.alias("total"), F.count(value).alias("n"))


def merge_batch(df: DataFrame, batch_id: int, path: str, value: str, cells: tuple[str, ...] = (), time: str = "time", scale: int | None = None) -> None:
    """Store the batch's state under its number, in place of what an earlier try has left there."""
    partial(df, value, cells, time, scale).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def merge_days(stream: DataFrame, path: str, checkpoint: str, value: str, cells: tuple[str, ...] = (), time: str = "time", scale: int | None = None):
    """Start a query that merges a stream's rows into the state; each run takes what is there and ends."""
    write = lambda batch, batch_id: merge_batch(batch, batch_id, path, value, cells, time, scale)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _tables(spark: SparkSession, path: str) -> tuple[int, list[int]]:
    """The last complete merged table (-1: none) and the complete batches after it."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    whole = [n for n in names if "=" in n and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    of = lambda kind: [int(n.split("=")[1]) for n in whole if n.startswith(f"{kind}=")]
    merged = max(of("merged"), default=-1)
    return merged, sorted(n for n in of("batch") if n > merged)


def state(spark: SparkSession, path: str) -> DataFrame:
    """doy, cells, total, n of all batches together."""
    merged, after = _tables(spark, path)
    parts = ([f"{path}/merged={merged}"] if merged >= 0 else []) + [f"{path}/batch={n}" for n in after]
    if not parts:
        raise ValueError(f"no batch under {path}")
    every = reduce(DataFrame.unionByName, [spark.read.parquet(p) for p in parts])
    kind = every.schema["total"].dataType
    keys = [c for c in every.columns if c not in ("total", "n")]
    return every.groupBy(*keys).agg(F.sum("total").cast(kind).alias("total"), F.sum("n").alias("n"))


def compact(spark: SparkSession, path: str) -> int:
    """Put all batches so far into one table and return its number; the tables it stands for are no longer read."""
    merged, after = _tables(spark, path)
    if not after:
        return merged
    state(spark, path).write.mode("overwrite").parquet(f"{path}/merged={after[-1]}")
    return after[-1]


def climatology(spark: SparkSession, path: str) -> DataFrame:
    """doy, cells, clim: the means over all rows that have been merged (null where a day had no value)."""
    found = state(spark, path)
    mean = F.when(F.col("n") > 0, F.col("total").cast("double") / F.col("n"))
    return found.select(*[c for c in found.columns if c not in ("total", "n")], mean.alias("clim"))
