"""Missing values, validity and indicators."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands for a missing value of the gridded variable (a fixed value of the data).
FILL = -0.009
ICE_THRESHOLD = 0.2


def missing(c: Column) -> Column:
    return c.isNull() | F.isnan(c)


def fill(df: DataFrame, value: str, others: tuple[str, ...] = (), with_: float | None = FILL) -> DataFrame:
    """Fill where the value is missing; the same rows are filled in the other columns. with_ None: nulls stay."""
    gone = missing(F.col(value))
    put = F.lit(with_).cast("double")
    return df.withColumns({value: F.when(gone, put).otherwise(F.col(value)), **{c: F.when(gone, put).otherwise(F.col(c)) for c in others}})


def validity(df: DataFrame, value: str) -> DataFrame:
    """One row: n_rows, n_values, valid."""
    n = F.count(F.when(~missing(F.col(value)), 1))
    return df.agg(F.count("*").alias("n_rows"), n.alias("n_values"), ((F.count("*") > 0) & (n > 0)).alias("valid"))


def require_valid(df: DataFrame, value: str) -> DataFrame:
    if not validity(df, value).first()["valid"]:
        raise ValueError(f"{value} has no values")
    return df


def apply_function(df: DataFrame, value: str, f: Callable[[pd.Series], pd.Series], out: str | None = None) -> DataFrame:
    """A user's function of numbers over a column, in Arrow batches (f: float series to float series of that length).

    For what Column expressions cannot say; those stay in the JVM and are faster.
    """

    @F.pandas_udf("double")
    def run(column: pd.Series) -> pd.Series:
        return f(column)

    return df.withColumn(out or value, run(F.col(value).cast("double")))


def empty_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def ice_indicator(c: Column, threshold: float = ICE_THRESHOLD) -> Column:
    """0 over the threshold, 1 up to it, null where the value is missing."""
    return F.when(missing(c), F.lit(None).cast("double")).when(c > threshold, F.lit(0.0)).otherwise(F.lit(1.0))
