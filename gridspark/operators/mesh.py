"""Unstructured meshes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.functions.calendar import wrap_longitude


def nodes(df: DataFrame) -> DataFrame:
    return df.withColumn("lon", wrap_longitude(F.col("lon")))


def triangles(df: DataFrame, corners: str = "nv") -> DataFrame:
    """Corner numbers from 1 as node ids from 0."""
    return df.withColumn(corners, F.transform(corners, lambda x: x - 1))
