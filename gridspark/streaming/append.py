"""Micro-batch append of new days to a tidy table partitioned by year."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_days(stream: DataFrame, path: str, checkpoint: str, time: str = "time"):
    """Start a query that appends a stream's rows; each run takes what is there and ends."""
    dated = stream.withColumn("year", F.year(time))
    return dated.writeStream.format("parquet").partitionBy("year").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
