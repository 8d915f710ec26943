"""Stored parameters, normalisers, tasks and run metrics: plain Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def save_if_best(params: DataFrame, path: str, version: int, is_best: bool) -> bool:
    """Store parameters under their own version where the run is the best so far; older versions stay."""
    if is_best:
        save(params, f"{path}/version={version}")
    return is_best


def load_best(spark: SparkSession, path: str) -> DataFrame:
    """The parameters of the last version stored (each is better than those before)."""
    every = spark.read.parquet(path)
    return every.where(F.col("version") == every.agg(F.max("version")).first()[0]).drop("version")


def log_metrics(df: DataFrame, path: str, run_id: str) -> None:
    """Append metrics (epoch, loss, val_rmse, is_best) of a run."""
    df.withColumn("run_id", F.lit(run_id)).write.mode("append").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def predictions_for_export(pred: DataFrame) -> DataFrame:
    """mean and std under the names that they have in files."""
    return pred.withColumnsRenamed({"mean": "mn", "std": "sd"})


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
