"""Line dedup by pairwise alignment.

A line goes if it lies in a block that an earlier document has as well: lines that follow one another in both, with at
least BLOCK_WORDS words in all. The later of two documents is the one with the larger id, so nothing goes everywhere.

Overlapping documents are found by hashes of their shortest stretches of lines with that many words (mostly single
lines; short lines count with those before and after them). A stretch is rare or common alike: each of its later
holders is paired with its first holder alone, so a group of any size gives one pair for each of its members and
stretches, and each block that a document shares with any earlier one is shared, stretch by stretch, with documents
it is paired with. A pair's lines are aligned by patience diff, and aligned common blocks go from the later document;
a shared stretch that no rising alignment can take in (moved, or repeated in the later document) is a block by itself.

A line's hash is the 64-bit xxHash of its text without spaces at the ends; its words are runs of anything but ASCII
white space. Blank lines are lines without words. Two different lines or stretches are taken for one with a chance of
about 2**-64 for each pair.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import fresh, map_batches, stash, stashes

BLOCK_WORDS = 10
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_MIX = np.uint64(0xD6E8FEB86659FD93)


def matches(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Patience diff: matched positions of two sequences, rising in both.

    Between two matches, equal ends are matched first, then the longest rising chain of values that are unique on
    both sides; what lies between is treated alike until nothing is unique.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i >= j or k >= m:
            continue
        chain = _rising(_unique(a, i, j), _unique(b, k, m))
        if not chain:
            continue
        edges = [(i - 1, k - 1), *chain, (j, m)]
        out += chain
        todo += [(x + 1, u, y + 1, v) for (x, y), (u, v) in zip(edges, edges[1:])]
    return sorted(out)


def _unique(values: list[int], start: int, end: int) -> dict[int, int]:
    seen: dict[int, int] = {}
    for at in range(start, end):
        seen[values[at]] = -1 if values[at] in seen else at
    return {v: at for v, at in seen.items() if at >= 0}


def _rising(a: dict[int, int], b: dict[int, int]) -> list[tuple[int, int]]:
    """The longest chain of common values whose places rise on both sides (patience sorting with back links)."""
    common = sorted((at, b[v]) for v, at in a.items() if v in b)
    tops: list[int] = []
    piles: list[tuple] = []
    for x, y in common:
        p = bisect_left(tops, y)
        link = (x, y, piles[p - 1] if p else None)
        if p == len(tops):
            tops.append(y)
            piles.append(link)
        else:
            tops[p], piles[p] = y, link
    chain, link = [], piles[-1] if piles else None
    while link:
        chain.append(link[:2])
        link = link[2]
    return chain[::-1]


def blocks(found: list[tuple[int, int]], words: list[int], least: int = BLOCK_WORDS) -> list[int]:
    """Lines of the later document in matched runs (neighbours on both sides) of at least so many words."""
    out, run = [], []
    for i, k in [*found, (-2, -2)]:
        if run and (i, k) != (run[-1][0] + 1, run[-1][1] + 1):
            if sum(words[y] for _, y in run) >= least:
                out += [y for _, y in run]
            run = []
        run.append((i, k))
    return out


def stretches(hashes: np.ndarray, words: np.ndarray, least: int = BLOCK_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the shortest stretches with enough words from each line on and up to each line.

    Every line of a run of lines with enough words lies in one of these that is within the run.
    """
    n = len(hashes)
    total = np.concatenate(([0], np.cumsum(words, dtype=np.int64)))
    ends = np.searchsorted(total, total[:-1] + least)
    starts = np.searchsorted(total, total[1:] - least, side="right") - 1
    spans = np.concatenate((np.arange(n)[ends <= n] * (n + 1) + ends[ends <= n], starts[starts >= 0] * (n + 1) + np.arange(1, n + 1)[starts >= 0]))
    first, last = np.divmod(np.unique(spans), n + 1)
    sums, powers, back = np.zeros(n + 1, np.uint64), np.ones(n + 1, np.uint64), np.ones(n + 1, np.uint64)
    powers[1:], back[1:] = _BASE, _BACK
    powers, back = np.cumprod(powers, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)
    np.cumsum(hashes.astype(np.int64).view(np.uint64) * powers[:-1], dtype=np.uint64, out=sums[1:])
    mixed = (sums[last] - sums[first]) * back[first] + (last - first).astype(np.uint64)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * _MIX
    return first, last, (mixed ^ (mixed >> np.uint64(29))).view(np.int64)


def common_lines(a: np.ndarray, a_words: np.ndarray, b: np.ndarray, b_words: np.ndarray, least: int = BLOCK_WORDS) -> list[int]:
    """Lines of b in blocks that alignments with a find.

    The lines are aligned first. Then, as long as stretches that both have are left over (moved, or not unique as lines),
    the stretches themselves are aligned, each taken once on both sides, and an aligned one goes wherever b repeats it.
    Each alignment matches at least one stretch, as it is unique on both sides.
    """
    gone = np.zeros(len(b), bool)
    gone[blocks(matches(a.tolist(), b.tolist()), b_words.tolist(), least)] = True
    first, last, own = stretches(b, b_words, least)
    other = stretches(a, a_words, least)[2]
    shared = np.isin(own, other)
    first, last, own = first[shared], last[shared], own[shared]
    other = list(dict.fromkeys(other[np.isin(other, own)].tolist()))
    while True:
        covered = np.concatenate(([0], np.cumsum(gone)))
        left = np.flatnonzero(covered[last] - covered[first] < last - first)
        found = {other[i] for i, _ in matches(other, list(dict.fromkeys(own[left].tolist())))} if len(left) else set()
        if not found:
            return np.flatnonzero(gone).tolist()
        for k in left.tolist():
            if int(own[k]) in found:
                gone[first[k] : last[k]] = True


def _arrays(column) -> list[np.ndarray]:
    flat, at = column.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
    return [flat[i:j] for i, j in zip(at.tolist(), at[1:].tolist())]


def _stretches_of(batches, least: int):
    for b in batches:
        found = [np.unique(stretches(h, w, least)[2]) for h, w in zip(_arrays(b.column(1)), _arrays(b.column(2)))]
        rows = np.repeat(np.arange(len(found)), [len(x) for x in found])
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))], names=["key", "stretch"])


def _aligned(batches, least: int):
    for b in batches:
        found = [common_lines(x, v, y, w, least) for x, v, y, w in zip(*(_arrays(b.column(i)) for i in (1, 2, 3, 4)))]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int32()))], names=["key", "lines"])


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: int = BLOCK_WORDS) -> DataFrame:
    """docs with the remaining text, and columns n_lines and n_deleted.

    Rows of one id are told apart by a hash of their text, and rows equal in both are treated alike; a null id counts
    as the smallest. A null text stays null (0 lines); a text that is deleted as a whole becomes "". An empty table
    gives no rows. docs' own columns n_lines, n_deleted are replaced; other names are free.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    of, mark, gone_lines, its = fresh(docs, "id", "mark", "lines", "own")
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("mark"))
    shape = f"struct<id:{kind},mark:bigint>"
    trimmed = F.transform(F.split(F.col(text), "\n"), lambda x: F.trim(x))
    lines = F.transform(trimmed, lambda x: F.struct(F.xxhash64(x).alias("h"), F.regexp_count(x, F.lit("\\S+")).alias("w")))
    with stashes(docs.sparkSession) as keep:
        rows = stash(docs.where(F.col(text).isNotNull()).select(key.alias("key"), lines.alias("lines")).select("key", F.col("lines.h").alias("h"), F.col("lines.w").alias("w")), "lines")
        held = map_batches(rows, lambda batches: _stretches_of(batches, least), f"key {shape}, stretch long")
        held = stash(held, "stretches")
        owners = held.groupBy("stretch").agg(F.min("key").alias("owner"), F.max("key").alias("last")).where("owner < last").select("stretch", "owner")
        pairs = held.join(owners, "stretch").where(F.col("key") > F.col("owner")).select("owner", "key").distinct()
        sequences = rows.dropDuplicates(["key"])
        first = sequences.select(F.col("key").alias("owner"), F.col("h").alias("a"), F.col("w").alias("a_words"))
        aligned = pairs.join(first, "owner").join(sequences, "key").select("key", "a", "a_words", "h", "w")
        gone = map_batches(aligned, lambda batches: _aligned(batches, least), f"key {shape}, lines array<int>")
        decisions = keep(gone.groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("lines")))).alias(gone_lines)).select(F.col("key.id").alias(of), F.col("key.mark").alias(mark), gone_lines), "decisions")

    names = [c for c in docs.columns if c not in ("n_lines", "n_deleted")]
    keyed = docs.select(*[docs[c] for c in names], F.xxhash64(docs[text]).alias(its))
    # merged at every size: decisions grow with the documents, so a plan that broadcasts them says nothing of larger ones
    joined = keyed.join(decisions.hint("merge"), keyed[id_col].eqNullSafe(F.col(of)) & (F.col(its) == F.col(mark)), "left")
    n_lines = F.coalesce(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")
    before, after = F.concat(F.array(F.lit(-1)), F.col(gone_lines)), F.concat(F.col(gone_lines), F.array(n_lines.cast("int")))
    runs = F.filter(F.zip_with(before, after, lambda x, y: F.struct((x + 2).alias("start"), (y - x - 1).alias("n"))), lambda r: r["n"] > 0)
    # the array of one row binds the split lines once for all runs that stay
    left = F.transform(F.array(F.split(F.col(text), "\n")), lambda own: F.array_join(F.flatten(F.transform(runs, lambda r: F.slice(own, r["start"], r["n"]))), "\n"))[0]
    rest = [F.when(F.col(gone_lines).isNull(), keyed[c]).otherwise(left).alias(c) if c == text else keyed[c] for c in names]
    return joined.select(*rest, n_lines.alias("n_lines"), F.when(F.col(gone_lines).isNull(), 0).otherwise(F.size(gone_lines)).cast("long").alias("n_deleted"))
