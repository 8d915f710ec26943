"""Dates and times: generators, cyclic encodings, Modified Julian Days, longitudes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Modified Julian Day of 1970-01-01.
MJD_OF_EPOCH = 40587


def dates(spark: SparkSession, start: str, end: str, step_days: int = 1) -> DataFrame:
    """Every step_days-th date from start to end, both included."""
    sequence = f"sequence(to_date('{start}'), to_date('{end}'), interval {int(step_days)} days)"
    return spark.range(1).select(F.explode(F.expr(sequence)).alias("date"))


def every(time: Column, start: str, step_days: int) -> Column:
    """True on every step_days-th day from start."""
    return F.pmod(F.datediff(time, F.lit(start).cast("date")), F.lit(step_days)) == 0


def cyclic(time: Column, period: float = 365.25) -> tuple[Column, Column]:
    """Cosine and sine of the day of the year."""
    angle = F.lit(2 * math.pi) * F.dayofyear(time) / F.lit(period)
    return F.cos(angle), F.sin(angle)


def micros(time: Column) -> Column:
    """Microseconds of a time without zone since 1970-01-01 00:00; put together from its parts, so no zone has a say."""
    t = time.cast("timestamp_ntz")
    days = F.datediff(t, F.lit("1970-01-01").cast("date")).cast("long")
    minutes = (days * 24 + F.hour(t)) * 60 + F.minute(t)
    return minutes * F.lit(60_000_000) + (F.extract(F.lit("SECOND"), t) * 1_000_000).cast("long")


def to_mjd(time: Column) -> Column:
    return micros(time) / F.lit(86400e6) + F.lit(MJD_OF_EPOCH)


def from_mjd(mjd: Column) -> Column:
    seconds = (F.round((mjd - F.lit(MJD_OF_EPOCH)) * F.lit(86400e6)) / F.lit(1e6)).cast("decimal(18,6)")
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)


def parse(text: Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """A time without zone from text; null where it has another form."""
    return F.when(F.try_to_timestamp(text, F.lit(pattern)).isNotNull(), F.to_timestamp_ntz(text, F.lit(pattern)))


def format_date(time: Column, pattern: str = "yyyy-MM-dd") -> Column:
    """Text of a time. Spark formats in the session's zone, which should be UTC: a zone with summer time lacks an hour."""
    return F.date_format(time.cast("timestamp_ntz"), pattern)


def wrap_longitude(lon: Column) -> Column:
    """Degrees east of 180 as negative degrees west."""
    return F.when(lon > 180, lon - 360).otherwise(lon)
