"""Normalisation in three steps: fit, transform, inverse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METHODS = ("mean_std", "min_max", "unit")


def fit(df: DataFrame, variables: tuple[str, ...], method: str = "mean_std") -> DataFrame:
    """var_id, method, p1, p2 in one pass: mean and population deviation, or minimum and maximum (min_max, unit)."""
    if method not in METHODS:
        raise ValueError(f"method is one of {METHODS}")
    pair = (lambda c: (F.avg(c), F.stddev_pop(c))) if method == "mean_std" else (lambda c: (F.min(c), F.max(c)))
    row = F.array(*[F.struct(F.lit(v).alias("var_id"), F.lit(method).alias("method"), pair(v)[0].cast("double").alias("p1"), pair(v)[1].cast("double").alias("p2")) for v in variables])
    return df.agg(row.alias("rows")).select(F.explode("rows").alias("r")).select("r.*")


def params(fitted: DataFrame) -> dict[str, tuple[str, float, float]]:
    """The fitted table as a dictionary: a row for each variable."""
    return {r["var_id"]: (r["method"], r["p1"], r["p2"]) for r in fitted.collect()}


def _affine(method: str, p1: float, p2: float) -> tuple[float, float]:
    """Shift and width; a width of 0 counts as 1. min_max maps to -1..1, unit to 0..1 (coordinates in model space)."""
    if method == "unit":
        return p1, (p2 - p1) or 1.0
    return (p1, p2 or 1.0) if method == "mean_std" else ((p1 + p2) / 2, (p2 - p1) / 2 or 1.0)


def transform(c: Column, method: str, p1: float, p2: float) -> Column:
    shift, width = _affine(method, p1, p2)
    return (c - F.lit(shift)) / F.lit(width)


def inverse(c: Column, method: str, p1: float, p2: float) -> Column:
    shift, width = _affine(method, p1, p2)
    return c * F.lit(width) + F.lit(shift)


def scale(c: Column, method: str, p1: float, p2: float) -> Column:
    """A deviation back in the units of the data: the width alone."""
    return c * F.lit(_affine(method, p1, p2)[1])


def apply(df: DataFrame, fitted: dict[str, tuple[str, float, float]], back: bool = False) -> DataFrame:
    f = inverse if back else transform
    return df.withColumns({v: f(F.col(v), *p) for v, p in fitted.items()})
