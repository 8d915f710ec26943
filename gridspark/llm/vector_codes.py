"""Vector codes: each part of a vector becomes the index of its nearest codebook entry (product quantisation).

Components become integers, floor(scale * x), so distances and sums are exact and no partitioning alters a result. The
codebooks are fitted over all rows by rounds of assigning and averaging; the state between rounds is a stored table with
each row's entries, so a lost executor repeats its tasks alone.

Rows are assigned by Exponion search. It starts at the row's previous entry a and goes through a's list of the other
entries, nearest first. With `own` the row's distance to a and `best` the least one so far, an entry j farther from a
than own + best is farther from the row than best (triangle inequality), and so are all that follow it in the list: the
row is done. Ties go to the lower index, so entries exactly on that radius are looked at. The first assignment has no
previous entry and starts at entry 0.

What tasks and driver hold besides a batch are the codebooks, their neighbour lists (entries**2 numbers a part) and one
partial sum for each entry: bounds that parameters set, whatever the rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import free, map_batches, stash, stashes

#: Entries of a neighbour list that are looked at before the radius is drawn closer.
STEP = 16


def neighbours(book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry all entries by (distance, index), itself or an equal one of lower index first, and the squared distances."""
    gaps = ((book[:, None, :] - book[None, :, :]) ** 2).sum(-1)
    order = np.argsort(gaps, axis=1, kind="stable")
    return order, np.take_along_axis(gaps, order, axis=1)


def nearest(x: np.ndarray, start: np.ndarray, book: np.ndarray, order: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest entry (ties: the lower index) and its squared distance, by Exponion search from `start`."""
    own = ((x - book[start]) ** 2).sum(1)
    best = own * len(book) + start  # distance and index in one number, so that one minimum decides both
    left = np.arange(len(x))
    for k in range(0, len(book), STEP):
        # rounding errs on the side of a wider radius: squares are under 2**54
        radius = np.square(np.sqrt(own[left].astype(float)) + np.sqrt((best[left] // len(book)).astype(float))) * (1 + 1e-9) + 1
        left = left[gaps[start[left], k] <= radius]
        if not len(left):
            break
        tried = order[start[left], k : k + STEP]
        found = ((x[left, None, :] - book[tried]) ** 2).sum(-1) * len(book) + tried
        best[left] = np.minimum(best[left], found.min(1))
    return best % len(book), best // len(book)


def _numbers(column, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _assigned(batches, books, lists):
    """Rows (row, v, codes) with the codes of these books, and the error."""
    width = books[0].shape[1]
    for b in batches:
        if not b.num_rows:
            continue
        v, before = _numbers(b.column(1), width * len(books)), _numbers(b.column(2), len(books))
        found = [nearest(v[:, p * width : (p + 1) * width], before[:, p], book, *lists[p]) for p, book in enumerate(books)]
        codes = pa.FixedSizeListArray.from_arrays(pa.array(np.stack([c for c, _ in found], 1).ravel(), pa.int32()), len(books)).cast(pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), codes, pa.array(sum(e for _, e in found), pa.int64())], names=["row", "v", "codes", "error"])


def _sums(batches, parts: int, entries: int, width: int):
    """A task's sums and counts for each part and entry: parts * entries rows at most."""
    sums, counts = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
    for b in batches:
        at = (_numbers(b.column(1), parts) + np.arange(parts) * entries).ravel()
        np.add.at(sums, at, _numbers(b.column(0), width))
        counts += np.bincount(at, minlength=parts * entries)
    used = np.flatnonzero(counts)
    if len(used):
        flat = pa.FixedSizeListArray.from_arrays(pa.array(sums[used].ravel()), width).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(counts[used]), flat], names=["slot", "n", "sums"])


def _refined(state: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Each entry's mean, componentwise rounded down; entries that no part has stay."""
    parts, (entries, width) = len(books), books[0].shape
    partial = map_batches(state.select("v", "codes"), lambda batches: _sums(batches, parts, entries, width), "slot long, n long, sums array<long>")
    total = partial.groupBy("slot").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(width)]).alias("sums"))
    out = [book.copy() for book in books]
    for r in total.collect():  # parts * entries rows at most
        out[r["slot"] // entries][r["slot"] % entries] = np.array(r["sums"], np.int64) // r["n"]
    return out


def compress(vectors: DataFrame, id_col: str, vector: str, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, carry: tuple[str, ...] = ()) -> tuple[DataFrame, list[np.ndarray]]:
    """(rows of id and `carry` columns with codes (array of a 0-based entry for each part) and error; the final codebooks).

    Rows whose vector is null or has a component that is null or not finite are left out; other nulls, repeated ids and
    repeated rows stay. The codebooks start as the parts of the vectors of the smallest ids (null ids last, then the
    smaller vector). With fewer rows than entries, there are as many entries as rows; without rows, none. Vectors must
    be of one length that `parts` divides, and of components for which squared distances stay under 2**62 / entries.
    The columns codes and error are appended, so `carry` must not name them.
    """
    spark, of = vectors.sparkSession, vectors[vector]
    finite = F.forall(of, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    carried = list(dict.fromkeys((id_col, *carry)))
    kept = vectors.where(of.isNotNull() & finite).select(F.struct(*[vectors[c] for c in carried]).alias("row"), of.alias("v"))
    whole = F.transform("v", lambda x: F.floor(x.cast("double") * scale))
    largest = F.array_max(F.transform("v", lambda x: F.abs(F.floor(x.cast("double") * scale).cast("double"))))
    size = kept.agg(F.count("*").alias("n"), F.min(F.size("v")).alias("least"), F.max(F.size("v")).alias("most"), F.max(largest).alias("far")).first()
    kind = vectors.select(*carried).schema.simpleString()
    if not size["n"]:
        return spark.createDataFrame([], f"row {kind}, codes array<int>, error bigint").select("row.*", "codes", "error"), [np.zeros((0, 0), np.int64)] * parts
    if size["least"] != size["most"] or size["most"] % parts or not size["most"]:
        raise ValueError(f"vectors of {size['least']} to {size['most']} components; one length that {parts} divides is needed")
    if 4 * size["most"] * (size["far"] + 1) ** 2 * entries >= 2**62 or size["n"] * (size["far"] + 1) >= 2**62:
        raise ValueError("components are too large for exact sums")
    width = size["most"] // parts
    with stashes(spark) as keep:
        state = stash(kept.select("row", F.transform(whole, lambda x: x.cast("int")).alias("v"), F.array_repeat(F.lit(0), parts).alias("codes")), "vectors")
        first = state.orderBy(F.asc_nulls_last(f"row.{id_col}"), "v").select("v").limit(entries).collect()
        seeds = np.array([r["v"] for r in first], np.int64)
        books = [seeds[:, p * width : (p + 1) * width].copy() for p in range(parts)]
        for k in range(rounds + 1):
            lists = [neighbours(book) for book in books]
            assigned = map_batches(state.select("row", "v", "codes"), lambda batches, books=books, lists=lists: _assigned(batches, books, lists), f"row {kind}, v array<int>, codes array<int>, error long")
            if k == rounds:
                done = keep(assigned.select("row", "codes", "error"), "codes")
                break
            after = stash(assigned.select("row", "v", "codes"), "vectors")
            free(state)
            state = after
            books = _refined(state, books)
    return done.select("row.*", "codes", "error"), books


def hex_codes(codes: Column) -> Column:
    """Two lowercase hex digits for each part."""
    return F.array_join(F.transform(codes, lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")


def listed(books: list[np.ndarray]) -> str:
    """All integers by part, entry and position, with commas between."""
    return ",".join(str(x) for book in books for x in book.ravel().tolist())
