"""Selections on time, space and grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def time_slice(df: DataFrame, start: str, end: str, time: str = "time") -> DataFrame:
    """Both ends included; an end that is a date takes in the whole day. Plain comparisons, which reach the scan."""
    first = F.lit(start).cast("timestamp_ntz")
    if len(end) == 10:
        return df.where((F.col(time) >= first) & (F.col(time) < F.expr(f"timestamp_ntz'{end}' + interval 1 day")))
    return df.where((F.col(time) >= first) & (F.col(time) <= F.lit(end).cast("timestamp_ntz")))


def box(df: DataFrame, lat: tuple[float, float], lon: tuple[float, float]) -> DataFrame:
    return df.where(F.col("lat").between(*lat) & F.col("lon").between(*lon))


def day_of_year(df: DataFrame, doy: int, time: str = "time") -> DataFrame:
    return df.where(F.dayofyear(time) == doy)


def nearest(df: DataFrame, column: str, point: Column, distance: Column | None = None) -> DataFrame:
    """Rows at the value of column nearest to the point, the lower in a tie; a grouped minimum and a semi join."""
    gap = F.abs(F.col(column) - point) if distance is None else distance
    best = df.where(F.col(column).isNotNull()).agg(F.min(F.struct(gap.alias("gap"), F.col(column).alias("at"))).alias("m")).select(F.col("m.at").alias("__at"))
    return df.join(F.broadcast(best), F.col(column) == F.col("__at"), "left_semi")  # one row


def nearest_cell(df: DataFrame, lat: float, lon: float) -> DataFrame:
    """Rows at the nearest latitude and the nearest longitude, each by itself (the lower in a tie).

    Both come from one aggregate over all rows; a grid with gaps may have no such cell, and then there are no rows.
    """
    least = [F.min(F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(c) - F.lit(p)).alias("gap"), F.col(c).alias("at"))))["at"].alias(f"__{c}") for c, p in (("lat", lat), ("lon", lon))]
    best = df.agg(*least)
    return df.join(F.broadcast(best), (F.col("lat") == F.col("__lat")) & (F.col("lon") == F.col("__lon")), "left_semi")  # one row


def exact_time(df: DataFrame, when: str, time: str = "time") -> DataFrame:
    """Rows of one time stamp; a plain comparison, which reaches the scan."""
    return df.where(F.col(time) == F.lit(when).cast("timestamp_ntz"))


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Renamed columns; a name that is not there is an error."""
    require_names(df, *names)
    return df.withColumnsRenamed(names)


def require_names(df: DataFrame, *names: str) -> DataFrame:
    """df, if it has these columns (the index names of a point table, say)."""
    missing = set(names) - set(df.columns)
    if missing:
        raise ValueError(f"no such columns: {sorted(missing)}")
    return df


def nearest_time(df: DataFrame, when: str, time: str = "time") -> DataFrame:
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return nearest(df, time, F.lit(when), F.abs(micros(F.col(time)) - micros(F.lit(when).cast("timestamp_ntz"))))


def mask_cells(static: DataFrame, mask: str = "mask") -> DataFrame:
    """Grid indices of the cells in the mask."""
    return static.where(F.col(mask).cast("boolean")).select("cell_id", "i_lat", "i_lon")


def within(df: DataFrame, cells: DataFrame) -> DataFrame:
    return df.join(cells.select("cell_id").distinct(), "cell_id", "left_semi")


def grid_of(df: DataFrame, values: str, columns: int, index: str) -> DataFrame:
    """Rows of dense arrays as tidy cells: index, cell_id, i_lat, i_lon, value."""
    flat = df.select(F.col(index), F.posexplode(values).alias("cell_id", "value"))
    return flat.select(index, "cell_id", F.expr(f"cell_id div {columns}").cast("int").alias("i_lat"), (F.col("cell_id") % columns).alias("i_lon"), F.col("value").cast("double").alias("value"))


def drop_strict(df: DataFrame, *names: str) -> DataFrame:
    return require_names(df, *names).drop(*names)


def squeeze(df: DataFrame, column: str) -> DataFrame:
    """Drop a dimension that has one value."""
    if df.select(column).distinct().limit(2).count() > 1:
        raise ValueError(f"{column} has more than one value")
    return df.drop(column)
