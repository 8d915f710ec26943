"""Errors, epoch losses and the best run so far."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridspark.operators.sampling import order_key

#: Orders (epochs) that best_so_far looks through at once.
SPAN = 4096


def rmse(pred: DataFrame, truth: DataFrame, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """Root mean square of all errors pooled (or by group): rmse, n, n_null (pairs without a value)."""
    return rmse_of(pred.join(truth, keys), F.col("mean"), F.col("y"), by)


def rmse_of(df: DataFrame, mean, y, by: list[str] | None = None) -> DataFrame:
    error = mean - y
    return df.groupBy(*(by or [])).agg(F.sqrt(F.avg(error * error)).alias("rmse"), F.count(error).alias("n"), (F.count("*") - F.count(error)).alias("n_null"))


def rmse_of_tasks(pred: DataFrame, truth: DataFrame, keys: list[str], tasks: int = 50, seed: int = 0, task: str = "date") -> DataFrame:
    """rmse over `tasks` tasks drawn without replacement (by hash order); fewer tasks than that are an error."""
    ids = pred.select(task).distinct()
    drawn = ids.orderBy(order_key(F.col(task), None, seed), task).limit(tasks)
    if drawn.count() < tasks:
        raise ValueError(f"fewer than {tasks} tasks")
    return rmse(pred.join(F.broadcast(drawn), task, "left_semi"), truth, keys)  # `tasks` rows


def epoch_loss(losses: DataFrame) -> DataFrame:
    return losses.groupBy("epoch").agg(F.avg("loss").alias("loss"))


def best_so_far(runs: DataFrame, value: str = "rmse", order: str = "epoch", run: str | None = None) -> DataFrame:
    """is_best: strictly under all before it; a tie keeps the earlier and NaN or null never wins.

    order: a number. Minima are taken within stretches of SPAN of it and over the stretches before, so no task has all
    rows of a run. Without run, all rows are one run.
    """
    keys = ["__run", "__span"]
    parted = runs.withColumns({"__run": F.col(run) if run else F.lit(0), "__span": F.floor(F.col(order) / F.lit(SPAN)), "__value": F.when(F.isnan(value), None).otherwise(F.col(value))})
    earlier = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    spans = parted.groupBy(*keys).agg(F.min("__value").alias("__least")).select(*keys, F.min("__least").over(earlier("__run").orderBy("__span")).alias("__opening"))
    within = parted.withColumn("__before", F.min("__value").over(earlier(*keys).orderBy(order)))
    before = F.coalesce(F.least("__before", "__opening"), F.lit(float("inf")))
    return within.join(spans, keys).select(*runs.columns, F.coalesce(F.col("__value") < before, F.lit(False)).alias("is_best"))
