"""Greedy placement in which a candidate is scored again only while a bound from its last score could still win.

Each date has a model: its points, the Cholesky factor of their kernel and the variance left at each target. A pick adds
one row to each factor and one rank-one term to the variances; nothing is factored twice. Each candidate has, by date,
its own variance and, for each tile of targets (a square of the plane), four numbers from when it was last scored there:

- `left`: the deviations that would be left in the tile with the candidate, summed (a lower bound after later picks),
- `low`: the least variance that would be left at a target of the tile (a lower bound),
- `shared`, `top`: the sum and the greatest of p2, what the candidate takes from a target's variance (upper bounds).

After a pick s, let q2 be what s took from a target and r the correlation of s and the candidate c given all before, which
is known exactly from one row of products. What s takes once c is there has |w| <= (|q| + |r p|) / sqrt(1 - r2), and what c
takes once s is there |p'| <= (|p| + |r q|) / sqrt(1 - r2). As sqrt(x) - sqrt(x - w2) = w2 / (sqrt(x) + sqrt(x - w2)), both
orders bound what is left in a tile from below: from `left` less what s takes (tight where s is far), and from what is left
with s less what c takes (tight where c is far). The sums over a tile follow by Minkowski's inequality.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.plans.placement import CONTEXT, TARGETS, _bounded
from gridspark.sources import tables

#: Candidates of a date that one task takes; its model is sent along once for each such part.
PART = 1024
#: Candidates scored at once: the matrix of targets and candidates is at most 10,000 x BLOCK numbers.
BLOCK = 256
MOST_TASKS = 10_000
#: Candidates that are first scored again after a pick; then twice as many each time.
FIRST = 64
#: What rounding may add to a bound.
SLACK = 1e-9

ENTRY = "v double, left array<double>, low array<double>, shared array<double>, top array<double>"


class _Plane:
    """The targets, sorted by tile."""

    def __init__(self, at: np.ndarray, length: float, noise: float, tiles: int) -> None:
        low, span = at.min(0), max(float(np.ptp(at, axis=0).max()), 1e-300)
        tile = np.minimum(((at - low) / span * tiles).astype(int), tiles - 1)
        number = tile[:, 0] * tiles + tile[:, 1]
        order = np.argsort(number, kind="stable")
        self.at, self.length, self.noise = at[order], length, noise
        self.starts = np.flatnonzero(np.diff(number[order], prepend=-1))
        self.sizes = np.diff(self.starts, append=len(at)).astype(float)

    def kernel(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        d2 = (a[:, None, 0] - b[None, :, 0]) ** 2
        d2 += (a[:, None, 1] - b[None, :, 1]) ** 2
        d2 /= -2 * self.length**2
        return np.exp(d2, out=d2)

    def tiled(self, how: np.ufunc, values: np.ndarray) -> np.ndarray:
        return how.reduceat(values, self.starts, axis=0)


def _factor(packed: Any, m: int) -> np.ndarray:
    full = np.zeros((m, m))
    full[np.tril_indices(m)] = packed
    return full


def _points(flat: Any) -> np.ndarray:
    return np.asarray(flat, dtype=float).reshape(-1, 2)


def _models(context: DataFrame, plane: _Plane) -> DataFrame:
    """date, x (pairs of coordinates), factor (lower triangle, row by row), var (variance left at each target)."""

    def begin(key: tuple[Any, ...], group: pd.DataFrame) -> pd.DataFrame:
        x = group[["x1", "x2"]].dropna().to_numpy(float)
        if len(x) > CONTEXT:
            raise ValueError(f"{len(x)} context points of a date; greedy placement takes {CONTEXT}")
        low = np.linalg.cholesky(plane.kernel(x, x) + plane.noise * np.eye(len(x))) if len(x) else np.zeros((0, 0))
        half = np.linalg.solve(low, plane.kernel(x, plane.at)) if len(x) else np.zeros((1, len(plane.at)))
        return pd.DataFrame({"date": [key[0]], "x": [x.ravel()], "factor": [low[np.tril_indices(len(x))]], "var": [1 - (half**2).sum(0)]})

    kind = context.schema["date"].dataType.simpleString()
    return context.select("date", "x1", "x2").groupBy("date").applyInPandas(begin, f"date {kind}, x array<double>, factor array<double>, var array<double>")


def _joined(models: DataFrame, plane: _Plane, pick: tuple[float, float]) -> DataFrame:
    """The models with the pick as a further point, and what the bounds need of it: alpha, of and the tiles' numbers.

    alpha: the pick's weights on the points before it; of: its variance with noise; took, most: sum and greatest of what
    it took from the targets' variances; rest, least, total: deviations, least variance and variance that are left.
    """
    at = np.array([pick])

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                x, var = _points(r.x), np.asarray(r.var)
                low, cross = _factor(r.factor, len(x)), plane.kernel(x, at)[:, 0]
                row = np.linalg.solve(low, cross) if len(x) else cross
                alpha = np.linalg.solve(low.T, row) if len(x) else cross
                of = float(1 - row @ row + plane.noise)
                q = (plane.kernel(plane.at, at)[:, 0] - plane.kernel(plane.at, x) @ alpha) / np.sqrt(of)
                after = var - q**2
                kept = np.maximum(after, 0)
                out.append((r.date, np.append(r.x, pick), np.concatenate((r.factor, row, [np.sqrt(of)])), after, alpha, of, plane.tiled(np.add, q**2), plane.tiled(np.maximum, q**2), plane.tiled(np.add, np.sqrt(kept)), plane.tiled(np.minimum, kept), plane.tiled(np.add, kept)))
            yield pd.DataFrame(out, columns=[*b.columns, "alpha", "of", "took", "most", "rest", "least", "total"])

    kind = models.schema["date"].dataType.simpleString()
    arrays = ", ".join(f"{c} array<double>" for c in ("took", "most", "rest", "least", "total"))
    return models.select("date", "x", "factor", "var").mapInPandas(add, f"date {kind}, x array<double>, factor array<double>, var array<double>, alpha array<double>, of double, {arrays}")


def _met(models: DataFrame, cells: DataFrame, parts: int):
    """Models and cells grouped by date and part; a model goes to each part once. cells has a part.

    The groups are small in bytes and long in work, so their partitions are numbered, not left to be put together.
    """
    tasks = min(models.count() * parts, MOST_TASKS) or 1
    each = models.withColumnsRenamed({"date": "of_date", "x": "known"}).select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("of_part"), "*")
    aliased = each.select(*[F.col(c).alias(c) for c in each.columns])  # cells may stem from the models
    return aliased.repartition(tasks, "of_date", "of_part").groupBy("of_date", "of_part").cogroup(cells.repartition(tasks, "date", "part").groupBy("date", "part"))


def _scored(models: DataFrame, cells: DataFrame, plane: _Plane, parts: int, kind: str) -> DataFrame:
    """Each candidate's entry under the models as they are."""

    def score(key: tuple[Any, ...], model: pd.DataFrame, group: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(model) and len(group):
            x, var = _points(model["known"][0]), np.asarray(model["var"][0])
            inverse = np.linalg.inv(_factor(model["factor"][0], len(x))) if len(x) else np.zeros((0, 0))
            to = plane.kernel(plane.at, x)
            for start in range(0, len(group), BLOCK):
                some = group.iloc[start : start + BLOCK]
                place = some[["x1", "x2"]].to_numpy(float)
                half = inverse @ plane.kernel(x, place)
                v = 1 - (half**2).sum(0) + plane.noise
                took = (plane.kernel(plane.at, place) - to @ (inverse.T @ half)) ** 2 / v
                after = np.maximum(var[:, None] - took, 0)
                tiles = {"left": plane.tiled(np.add, np.sqrt(after)), "low": plane.tiled(np.minimum, after), "shared": plane.tiled(np.add, took), "top": plane.tiled(np.maximum, took)}
                found.append(some.assign(v=v, fresh=True, **{c: list(t.T) for c, t in tiles.items()}))
        return pd.concat(found)[columns] if found else pd.DataFrame(columns=columns)

    columns = ["date", "part", "cell_id", "x1", "x2", "fresh", "v", "left", "low", "shared", "top"]
    return _met(models.select("date", "x", "factor", "var"), cells.select(*columns[:5]), parts).applyInPandas(score, f"{kind}, fresh boolean, {ENTRY}")


def _ratio(over: np.ndarray, under: np.ndarray) -> np.ndarray:
    return np.divide(over, under, out=np.where(over > 0, np.inf, 0.0), where=under > 0)


def bounded_entries(plane: _Plane, model: dict[str, Any], place: np.ndarray, v: np.ndarray, left: np.ndarray, low: np.ndarray, shared: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, ...]:
    """The entries (a row for each candidate, a column for each tile) once the model's pick is a point.

    model: what `_joined` gives; known: its points, the pick as the last.
    """
    x = _points(model["known"])
    took, most, rest, least, total = (np.asarray(model[c]) for c in ("took", "most", "rest", "least", "total"))
    u = (plane.kernel(place, x[-1:])[:, 0] - plane.kernel(place, x[:-1]) @ np.asarray(model["alpha"])) / np.sqrt(model["of"])
    r = np.minimum(np.abs(u) / np.sqrt(v), 1.0)[:, None]
    rest_r = np.maximum(1 - r**2, 1e-12)
    sum_w, top_w = (np.sqrt(took) + r * np.sqrt(shared)) ** 2 / rest_r, (np.sqrt(most) + r * np.sqrt(top)) ** 2 / rest_r
    sum_p, top_p = (np.sqrt(shared) + r * np.sqrt(took)) ** 2 / rest_r, (np.sqrt(top) + r * np.sqrt(most)) ** 2 / rest_r
    lost = np.minimum(_ratio(sum_w, np.sqrt(low) + np.sqrt(np.maximum(low - top_w, 0))), np.sqrt(plane.sizes * sum_w))
    gone = np.minimum(_ratio(sum_p, np.sqrt(least) + np.sqrt(np.maximum(least - top_p, 0))), np.sqrt(plane.sizes * sum_p))
    now = np.maximum(np.maximum(left - lost, rest - gone), 0)
    lower = np.maximum(np.maximum(low - top_w, least - top_p), 0)
    sum_p = np.minimum(sum_p, total)
    return v - u**2, now, lower, sum_p, np.minimum(top_p, sum_p)


def _lowered(models: DataFrame, entries: DataFrame, plane: _Plane, parts: int, kind: str) -> DataFrame:
    """The entries after the pick of the models, as bounds."""

    def lower(key: tuple[Any, ...], model: pd.DataFrame, group: pd.DataFrame) -> pd.DataFrame:
        if not len(group):
            return group
        tiles = [np.stack(group[c].to_numpy()) for c in ("left", "low", "shared", "top")]
        v, *found = bounded_entries(plane, model.iloc[0].to_dict(), group[["x1", "x2"]].to_numpy(float), group["v"].to_numpy(), *tiles)
        return group.assign(v=v, fresh=False, **{c: list(t) for c, t in zip(("left", "low", "shared", "top"), found)})

    return _met(models.drop("factor", "var"), entries, parts).applyInPandas(lower, f"{kind}, fresh boolean, {ENTRY}")


def _means(entries: DataFrame, n: int) -> DataFrame:
    """cell_id, score: the deviation left, or its bound, averaged over targets and dates."""
    of_date = F.aggregate("left", F.lit(0.0), lambda a, b: a + b)
    return entries.groupBy("cell_id").agg((F.sum(of_date) / (F.count("*") * n)).alias("score"), F.first("x1").alias("x1"), F.first("x2").alias("x2"))


def lazy_greedy(context: DataFrame, candidates: DataFrame, targets: DataFrame, n_new: int, length: float, noise: float = 1e-2, tiles: int = 8) -> tuple[DataFrame, DataFrame]:
    """(iteration, cell_id, x1, x2, score) of the chosen cells, and (iteration, candidates, scored): how many were scored.

    The picks are those of `placement.greedy`: the least deviation left at the targets, averaged over targets and dates,
    rounded to 12 places, ties to the smaller id. Context: CONTEXT points a date at most; targets: TARGETS at most, sent
    to all tasks. Candidates may be any number, and stay in tables: an entry of 4 numbers a tile for each candidate and date.
    tiles: how many lie along the longer side of the targets (their square at most in all); more of them take more room and
    let fewer candidates be scored again. No candidates, targets, dates or picks give empty tables. The first of rows with
    one cell_id by (x1, x2) counts; null ids or places are no candidates or targets.
    """
    spark = context.sparkSession
    at = _bounded(targets.select("x1", "x2").dropna(), TARGETS, "targets").orderBy("x1", "x2").toPandas().to_numpy(float)
    cells = candidates.dropna(subset=["cell_id", "x1", "x2"]).groupBy("cell_id").agg(F.min(F.struct("x1", "x2")).alias("p"))
    count = cells.count()
    picks: list[tuple[Any, ...]] = []
    reports: list[tuple[int, int, int]] = []
    chosen_shape, report_shape = f"iteration int, cell_id {candidates.schema['cell_id'].dataType.simpleString()}, x1 double, x2 double, score double", "iteration int, candidates long, scored long"
    if not count or not len(at) or n_new < 1:
        return spark.createDataFrame([], chosen_shape), spark.createDataFrame([], report_shape)
    plane, parts = _Plane(at, length, noise, tiles), -(-count // PART)
    models = tables.stored(_models(context, plane))
    placed = cells.select(F.expr(f"cast(pmod(xxhash64(cell_id), {parts}) AS int)").alias("part"), "cell_id", F.col("p.x1").cast("double").alias("x1"), F.col("p.x2").cast("double").alias("x2"))
    wanted = models.select("date").crossJoin(placed)  # every candidate is scored under every date: the task's own size
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in wanted.schema)
    entries = None
    for iteration in range(1, min(n_new, count) + 1):
        if entries is None:
            fresh = [tables.stored(_scored(models, wanted, plane, parts, kind))]
            scored = count
        else:
            models = tables.stored(_joined(models, plane, picks[-1][2:4]))
            entries = tables.stored(_lowered(models, entries.where(F.col("cell_id") != F.lit(picks[-1][1])), plane, parts, kind))
            bounds, fresh, scored, step = tables.stored(_means(entries, len(at))), [], 0, FIRST
            best, edge = float("inf"), None
            while True:
                # those scored already are the least by (bound, id), up to the edge
                beyond = F.lit(True) if edge is None else (F.col("score") > edge[0]) | ((F.col("score") == edge[0]) & (F.col("cell_id") > F.lit(edge[1])))
                some = tables.stored(bounds.where(beyond & (F.col("score") <= best + SLACK)).orderBy("score", "cell_id").limit(step))
                last = some.orderBy(F.desc("score"), F.desc("cell_id")).first()
                if last is None:
                    break
                edge = (last["score"], last["cell_id"])
                again = wanted.join(some.select("cell_id"), "cell_id", "left_semi")
                fresh.append(tables.stored(_scored(models, again, plane, parts, kind)))
                scored, step = scored + some.count(), 2 * step
                best = min(best, _means(fresh[-1], len(at)).agg(F.min("score")).first()[0])
        done = reduce(DataFrame.unionByName, fresh)
        row = _means(done, len(at)).orderBy(F.round("score", 12), "cell_id").first()
        if row is None:
            break
        reports.append((iteration, count - iteration + 1, scored))
        picks.append((iteration, row["cell_id"], row["x1"], row["x2"], row["score"]))
        entries = done if entries is None else entries.join(done.select("cell_id").distinct(), "cell_id", "left_anti").unionByName(done)
    return spark.createDataFrame(picks, chosen_shape), spark.createDataFrame(reports, report_shape)
