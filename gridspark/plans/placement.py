"""Greedy placement of new sensors where they lower the remaining deviation most."""

from __future__ import annotations

from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Candidates and targets at most; both are sent to all tasks (24 bytes each).
CANDIDATES, TARGETS = 200_000, 10_000
#: Candidates that a task scores at once: the matrix of targets and candidates is at most 10,000 x BLOCK numbers.
BLOCK = 256
#: Context points of a date at most.
CONTEXT = 500


def _bounded(df: DataFrame, most: int, what: str) -> DataFrame:
    if df.limit(most + 1).count() > most:
        raise ValueError(f"greedy placement takes {most} {what}")
    return df


def acquisition(std: DataFrame, cell: str = "cell_id", value: str = "std") -> DataFrame:
    """cell, score: each candidate's remaining deviation, averaged over targets and dates (lower is better)."""
    return std.groupBy(cell).agg(F.avg(value).alias("score"))


def deviations(context: DataFrame, place: np.ndarray, ids: np.ndarray, at: np.ndarray, chosen: list[int], kind: str, length: float, noise: float) -> DataFrame:
    """date, cell_id, std: for each date the deviation left at the targets, on average, if a candidate joined.

    Candidates are dealt out in blocks, so a date is as many groups as there are blocks; each holds the date's
    context (CONTEXT points at most, else it raises) and one block's matrix.
    """
    taken, added = set(chosen), place[chosen]
    kernel = lambda a, b: np.exp(-((a[:, None, :] - b[None, :, :]) ** 2).sum(-1) / (2 * length**2))

    def score(key: tuple[Any, ...], group: pd.DataFrame) -> pd.DataFrame:
        x = group[["x1", "x2"]].dropna().to_numpy(float)
        if len(x) > CONTEXT:
            raise ValueError(f"{len(x)} context points of a date; greedy placement takes {CONTEXT}")
        x = np.concatenate((x, added))
        own = [i for i in range(key[1] * BLOCK, min((key[1] + 1) * BLOCK, len(place))) if i not in taken]
        if len(x):
            inverse = np.linalg.inv(kernel(x, x) + noise * np.eye(len(x)))
            kc, kt = kernel(place[own], x), kernel(at, x)
            left = 1 - np.einsum("ij,jk,ik->i", kt, inverse, kt)
            var_c = 1 - np.einsum("ij,jk,ik->i", kc, inverse, kc) + noise
            cross = kernel(at, place[own]) - kt @ inverse @ kc.T
        else:
            left, var_c, cross = np.ones(len(at)), np.full(len(own), 1 + noise), kernel(at, place[own])
        std = np.sqrt(np.maximum(left[:, None] - cross**2 / var_c[None, :], 0)).mean(0)
        return pd.DataFrame({"date": key[0], "cell_id": ids[own], "std": std})

    blocks = context.sparkSession.range(-(-len(place) // BLOCK)).select(F.col("id").cast("int").alias("block"))
    dealt = context.select("date", "x1", "x2").crossJoin(F.broadcast(blocks))  # CANDIDATES / BLOCK rows
    return dealt.groupBy("date", "block").applyInPandas(score, f"date {context.schema['date'].dataType.simpleString()}, cell_id {kind}, std double")


def greedy(context: DataFrame, candidates: DataFrame, targets: DataFrame, n_new: int, length: float, noise: float = 1e-2) -> tuple[DataFrame, DataFrame]:
    """(iteration, cell_id, x1, x2, score) of the chosen cells and the scores of all candidates in each iteration.

    A candidate's score is the deviation left at the targets, averaged over targets and dates, if it joined the
    context (the lower the better; ties: the smaller id). The variance of a Gaussian process does not depend on y, so
    a candidate costs a rank-one update. Each iteration is one job; the driver holds the candidates (CANDIDATES at
    most) and their scores.
    """
    spark = context.sparkSession
    cells = _bounded(candidates.select("cell_id", "x1", "x2").dropDuplicates(["cell_id"]), CANDIDATES, "candidates").orderBy("cell_id").toPandas()
    at = _bounded(targets.select("x1", "x2"), TARGETS, "targets").toPandas().to_numpy(float)
    place, ids, kind = cells[["x1", "x2"]].to_numpy(float), cells["cell_id"].to_numpy(), candidates.schema["cell_id"].dataType.simpleString()
    chosen: list[int] = []
    picks, fields = [], []
    for iteration in range(1, min(n_new, len(ids)) + 1):
        field = acquisition(deviations(context, place, ids, at, chosen, kind, length, noise)).toPandas()  # a row for each candidate
        if not len(field):
            break
        field["key"] = field["score"].round(12)
        best = field.sort_values(["key", "cell_id"]).iloc[0]
        row = int(np.flatnonzero(ids == best["cell_id"])[0])
        chosen.append(row)
        picks.append((iteration, int(best["cell_id"]), float(place[row, 0]), float(place[row, 1]), float(best["score"])))
        fields += [(iteration, int(c), float(s)) for c, s in zip(field["cell_id"], field["score"])]
    return spark.createDataFrame(picks, "iteration int, cell_id long, x1 double, x2 double, score double"), spark.createDataFrame(fields, "iteration int, cell_id long, score double")
