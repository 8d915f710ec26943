"""Readers of gridded and point data. NaN becomes NULL on the way in; cells have integer keys."""

from __future__ import annotations

import re
import tempfile
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def years(start: int, end: int, end_inclusive: bool = False) -> list[int]:
    """Years of a range whose end is left out unless end_inclusive."""
    return list(range(start, end + 1 if end_inclusive else end))


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = [f.name for f in df.schema if f.dataType.simpleString() in ("double", "float")]
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast(df.schema[c].dataType)) for c in floats}) if floats else df


def read_years(spark: SparkSession, template: str, start: int, end: int, end_inclusive: bool = False, drop: tuple[str, ...] = (), time: str = "time", clean: bool = False, keys: tuple[str, ...] = ()) -> DataFrame:
    """One Parquet file or folder for each year (template has {date}), put together; drop ignores missing columns.

    Rows have no order; keep the time column. A year column is added for partition pruning. clean: the files hold no
    NaN (write_years writes such), so conditions on values reach the scan. keys: coordinates that must not repeat (a
    pass over those columns), as when files are combined by coordinates.
    """
    paths = [template.format(date=y) for y in years(start, end, end_inclusive)]
    if not paths:
        raise ValueError("no years")
    return _prepared(spark.read.parquet(*paths), drop, time, clean, keys)


def read_glob(spark: SparkSession, pattern: str, drop: tuple[str, ...] = (), time: str = "time", clean: bool = False, keys: tuple[str, ...] = ()) -> DataFrame:
    """All Parquet files or folders of a path with *, ? or [..], as read_years reads them."""
    return _prepared(spark.read.parquet(pattern), drop, time, clean, keys)


def _prepared(raw: DataFrame, drop: tuple[str, ...], time: str, clean: bool, keys: tuple[str, ...]) -> DataFrame:
    df = raw.drop(*drop) if clean else nan_to_null(raw.drop(*drop))
    if keys and not repeated_keys(df, *keys).isEmpty():
        raise ValueError(f"coordinates {keys} repeat")
    return df if "year" in df.columns or time not in df.columns else df.withColumn("year", F.year(time))


def concat(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames by column name."""
    return reduce(DataFrame.unionByName, frames)


def repeated_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that come more than once, which combining by coordinates forbids."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def write_years(df: DataFrame, path: str) -> None:
    """Tidy Parquet partitioned by year, NaN turned to null."""
    nan_to_null(df).write.mode("overwrite").partitionBy("year").parquet(path)


def write_by_cell(df: DataFrame, table: str, buckets: int, cell: str = "cell_id") -> None:
    """A table in buckets of the cell: climatologies and anomalies by cell then shuffle nothing.

    Read it with spark.table() and spark.sql.requireAllClusterKeysForCoPartition false, as a join on (doy, cell) takes
    a partitioning by cell only then.
    """
    nan_to_null(df).write.mode("overwrite").bucketBy(buckets, cell).sortBy(cell).saveAsTable(table)


def read_stations(spark: SparkSession, path: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """CSV with a header: lat, lon as doubles; blank records go."""
    raw = spark.read.csv(path, header=True)
    blank = lambda c: F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).cast("double")
    return raw.select(blank(lat).alias("lat"), blank(lon).alias("lon")).na.drop()


def read_climatology(spark: SparkSession, path: str) -> DataFrame:
    return nan_to_null(spark.read.parquet(path)).select("doy", "cell_id", "clim")


def register_netcdf(spark: SparkSession) -> None:
    """Register the data source "netcdf" (classic files), where the reader library is there."""
    from gridspark.sources.netcdf import NetcdfSource

    spark.dataSource.register(NetcdfSource)


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """df written and read again, so that what reads it often does not work it out each time: at path, or else by
    checkpoint() in the folder of spark.checkpoint.dir (a temporary one only where that is unset and the master local)."""
    spark = df.sparkSession
    if path is not None:
        df.write.mode("overwrite").parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    shared_folder(spark)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder: that of spark.checkpoint.dir, a temporary one only where it is unset and the master local."""
    if not spark.sparkContext.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(shared or tempfile.mkdtemp(prefix="gridspark-"))
    return spark.sparkContext.getCheckpointDir()
