"""Day-of-year climatology and anomalies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.operators.fields import time_slice


def exact_mean(c: Column, scale: int | None = None) -> Column:
    """The plain mean; with a scale, for values of at most so many decimals, a sum over decimals that no partitioning alters."""
    if scale is None:
        return F.avg(c)
    return F.sum(c.cast(f"decimal(18,{scale})")).cast("double") / F.count(c)


def climatology(df: DataFrame, value: str, cells: tuple[str, ...] = (), time: str = "time", scale: int | None = None) -> DataFrame:
    """doy, cells, clim: the mean over all years, 366 over leap years alone."""
    return df.groupBy(F.dayofyear(time).alias("doy"), *cells).agg(exact_mean(F.col(value), scale).alias("clim"))


def anomalies(df: DataFrame, value: str, cells: tuple[str, ...] = (), time: str = "time", clim: DataFrame | None = None, start: str | None = None, end: str | None = None, scale: int | None = None) -> DataFrame:
    """df with clim and anom; the climatology is that of all rows, and the window is cut afterwards.

    A grouped aggregate and an equi-join: partial sums before the shuffle, and no shuffle of the rows where the
    climatology is small enough for Spark to broadcast. With a stored climatology, days it lacks have null anomalies.
    """
    clim = climatology(df, value, cells, time, scale) if clim is None else clim
    joined = df.withColumn("doy", F.dayofyear(time)).join(clim, ["doy", *cells], "left")
    out = joined.withColumn("anom", F.col(value) - F.col("clim"))
    return out if start is None else time_slice(out, start, end, time)
