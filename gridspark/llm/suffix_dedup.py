"""Repeated byte strings across a corpus, found by sorting suffixes.

A byte goes if a string of `least` bytes that covers it also starts anywhere else, in the same text or another one.
Strings that start at a place are the first `least` bytes of that place's suffix, so the places that share one stand
together when suffixes are sorted by their leading tokens. A suffix's tokens are 64-bit hashes of its first bytes; any
order of tokens serves, as only equality counts.

Suffixes are dealt out by sampled splitters (repartitionByRange over tokens and place, so equal suffixes of any number
spread over several buckets), each bucket is sorted by multikey quicksort, neighbours are compared within it, and the
first and last suffix of every bucket are compared with those of the others.

Sorting the suffixes of all places would move many times the corpus. So there are two sorts:

1. Places in runs. The GRAM-byte string with the smallest hash among those within a place's `least` bytes is the place's
   anchor (on ties the first). It depends on these bytes alone, so places with equal strings have equal anchors at equal
   offsets, and one string never starts at two places of one run, a run being the neighbouring places of one anchor. A
   run has two tokens: its anchor, and all bytes its places cover. Runs equal in both repeat as a whole. A run whose
   anchor no other run has repeats nowhere.
2. Places one by one, in runs that share their anchor only; of equal runs with that anchor, one stands for all. Tokens
   are the first GRAM bytes and the rest. Runs at the edges of a bucket of the first sort are treated alike, so what
   lies beyond the edge is not missed.

Texts cross the network twice, joined with what was found in them; a text's finds come together as a set, which a
repeated row does not lengthen. Two different strings are taken for one with a chance of about 2**-64 for each pair that
shares an anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import by_size, map_batches, shuffles_freed, stash, stashes

LEAST, GRAM = 200, 100
#: Bytes that are hashed at once; longer texts are taken in pieces.
BLOCK_BITS = 18
#: Suffixes of a bucket, about: some 60 bytes each in a task.
BUCKET = 400_000
#: Suffixes from which a part of a bucket is no longer split.
LEAF = 2048
REPEATED, TRIED = 1, 2

_SEED = np.random.default_rng(0x5AFE)
_OF = _SEED.integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)
_SIZE = (1 << BLOCK_BITS) + 1


def _powers(base: int) -> np.ndarray:
    out = np.full(_SIZE, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWERS, _INVERSE = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= _MIX
    x ^= x >> np.uint64(29)
    return x


def _sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which the hash of any stretch follows."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_OF[data] * _POWERS[: len(data)], dtype=np.uint64, out=out[1:])
    return out


def _hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return _mixed((sums[end] - sums[start]) * _INVERSE[start])


def _grams(sums: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all stretches of this size."""
    n = len(sums) - size
    return _mixed((sums[size:] - sums[:n]) * _INVERSE[:n])


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return x if size == width else np.minimum(x[: len(x) - (width - size)], x[width - size :])


def runs(data: np.ndarray, ends: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, ...]:
    """(first place, places, anchor token, token of all bytes) of each run in texts that lie one after another."""
    none = np.zeros(0, np.int64)
    places = len(data) - least + 1
    if places <= 0:
        return none, none, none, none
    sums = _sums(data)
    found = _grams(sums, gram)
    low = np.uint64((1 << BLOCK_BITS) - 1)
    at = (_sliding_min((found & ~low) | np.arange(len(found), dtype=np.uint64), least - gram + 1) & low).astype(np.int64)
    starts = np.concatenate(([0], ends[:-1]))
    # a run ends where the anchor changes, where a text ends, and where a text's last place is
    cuts = np.unique(np.concatenate((starts, np.maximum(ends - least + 1, starts), np.flatnonzero(at[1:] != at[:-1]) + 1)))
    first = cuts[cuts < places]
    text = np.searchsorted(ends, first, side="right")
    inside = first + least <= ends[text]
    last = np.append(first[1:], places)[inside]
    first = first[inside]
    whole = _hashes(sums, first, last - 1 + least) ^ (last - first).astype(np.uint64)
    return first, last - first, found[at[first]].view(np.int64), whole.view(np.int64)


def _blocks(texts, least: int) -> Iterator[tuple[np.ndarray, list]]:
    """(row number and first place of each piece, pieces): texts of a block; long ones in pieces that overlap."""
    rows, parts, size = [], [], 0
    most = 1 << BLOCK_BITS
    for i, text in enumerate(texts):
        if len(text) < least:
            continue
        for k in range(0, len(text) - least + 1, most - least + 1):
            piece = text[k : k + most]
            if size + len(piece) > most:
                yield np.array(rows), parts
                rows, parts, size = [], [], 0
            rows.append((i, k))
            parts.append(piece)
            size += len(piece)
    if rows:
        yield np.array(rows), parts


def _joined(parts: list) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts])


def _bytes_of(column) -> list[memoryview]:
    """The texts of an Arrow column, without copies."""
    if column.type in (pa.string(), pa.binary()) and len(column):
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].tolist()
        data = memoryview(column.buffers()[2] or b"")
        return [data[i:j] for i, j in zip(offsets, offsets[1:])]
    return [x.as_buffer() for x in column.cast(pa.large_binary())] if len(column) else []


def _runs_of(batches, least: int, gram: int):
    """Rows (t1, t2, id, mark, start, n)."""
    for batch in batches:
        for rows, parts in _blocks(_bytes_of(batch.column(2)), least):
            data, ends = _joined(parts)
            first, n, t1, t2 = runs(data, ends, least, gram)
            piece = np.searchsorted(ends, first, side="right")
            start = first - np.concatenate(([0], ends[:-1]))[piece] + rows[piece, 1]
            own = pa.array(rows[piece, 0])
            yield pa.RecordBatch.from_arrays([pa.array(t1), pa.array(t2), batch.column(0).take(own), batch.column(1).take(own), pa.array(start), pa.array(n)], names=["t1", "t2", "id", "mark", "start", "n"])


def multikey_quicksort(tokens: list[np.ndarray]) -> np.ndarray:
    """The order of suffixes by their tokens: split three ways by one token, go on with the next where it is equal."""
    order = np.arange(len(tokens[0]))
    todo = [(0, len(order), 0)]
    while todo:
        low, high, depth = todo.pop()
        own = order[low:high]
        if depth == len(tokens) or len(own) < 2:
            continue
        if len(own) <= LEAF:
            order[low:high] = own[np.lexsort([t[own] for t in tokens[depth:]][::-1])]
            continue
        key = tokens[depth][own]
        pivot = np.sort(key[:: max(1, len(key) // 64)])[min(len(key), 64) // 2]
        less, same, more = own[key < pivot], own[key == pivot], own[key > pivot]
        order[low:high] = np.concatenate((less, same, more))
        todo += [(low, low + len(less), depth), (low + len(less), high - len(more), depth + 1), (high - len(more), high, depth)]
    return order


def _sorted_bucket(batches) -> tuple[pa.Table, np.ndarray, np.ndarray] | None:
    """A bucket in the order of its tokens, and whether each suffix differs from the one before in t1, in t1 or t2."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return None
    bucket = pa.Table.from_batches(held).combine_chunks()
    t1, t2 = (bucket.column(i).to_numpy() for i in (0, 1))
    order = multikey_quicksort([t1, t2])
    t1, t2 = t1[order], t2[order]
    other = np.concatenate(([True], t1[1:] != t1[:-1]))
    return bucket.take(pa.array(order)), other, other | np.concatenate(([True], t2[1:] != t2[:-1]))


def _compared_runs(batches):
    """Rows (id, mark, start, n, what): REPEATED runs, TRIED ones that are to be looked at place by place, or both."""
    found = _sorted_bucket(batches)
    if found is None:
        return
    bucket, new_anchor, new_run = found
    group, same = np.cumsum(new_anchor) - 1, np.cumsum(new_run) - 1
    repeated = np.bincount(same)[same] > 1
    contested = np.bincount(group, weights=new_run) > 1
    contested[[0, -1]] = True  # what lies beyond the bucket may have the same anchor
    tried = contested[group] & (~repeated | new_run)
    what = repeated * REPEATED + tried * TRIED
    out = bucket.select(["id", "mark", "start", "n"]).append_column("what", pa.array(what.astype(np.int32)))
    yield from out.filter(pa.array(what > 0)).to_batches(65_536)


def _tried_runs(column) -> tuple[np.ndarray, ...]:
    """(row, start, n, what) of the runs of a batch's texts, in order, each once."""
    flat, row = column.flatten(), np.repeat(np.arange(len(column)), column.value_lengths().to_numpy(zero_copy_only=False))
    start, n, what = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
    order = np.lexsort((-what, start, row))
    row, start, n, what = row[order], start[order], n[order], what[order]
    once = np.concatenate(([True], (row[1:] != row[:-1]) | (start[1:] != start[:-1])))[: len(row)]
    return row[once], start[once], n[once], what[once]


def _places_of(batches, least: int, gram: int):
    """Rows (t1, t2, id, mark, place): the places of a text's tried runs; of a run that repeats anyway as -1 - place."""
    for batch in batches:
        texts = _bytes_of(batch.column(2))
        row, start, n, what = _tried_runs(batch.column(3))
        if not len(row):
            continue
        # neighbouring runs share their bytes; a block's runs are hashed at once
        apart = np.concatenate(([True], (row[1:] != row[:-1]) | (start[1:] != start[:-1] + n[:-1])))
        block = np.cumsum(n + apart * (least - 1)) // ((1 << BLOCK_BITS) - 2 * least)
        cuts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1], [True]))).tolist()
        for low, high in zip(cuts, cuts[1:]):
            opens = apart[low:high].copy()
            opens[0] = True
            first = np.flatnonzero(opens) + low
            size = np.add.reduceat(n[low:high], first - low) + least - 1
            parts = [texts[i][a : a + m] for i, a, m in zip(row[first].tolist(), start[first].tolist(), size.tolist())]
            sums = _sums(np.frombuffer(b"".join(parts), np.uint8))
            run = np.repeat(np.arange(low, high), n[low:high])
            within = np.arange(len(run)) - np.repeat(np.cumsum(n[low:high]) - n[low:high], n[low:high])
            place = start[run] + within
            stretch = np.cumsum(opens)[run - low] - 1
            at = place - start[first][stretch] + (np.cumsum(size) - size)[stretch]
            t1, t2 = _hashes(sums, at, at + gram), _hashes(sums, at + gram, at + least)
            place = np.where(what[run] == TRIED, place, -1 - place)
            own = pa.array(row[run])
            yield pa.RecordBatch.from_arrays([pa.array(t1.view(np.int64)), pa.array(t2.view(np.int64)), batch.column(0).take(own), batch.column(1).take(own), pa.array(place)], names=["t1", "t2", "id", "mark", "place"])


def _compared_places(batches):
    """Rows (t1, t2, id, mark, place, edge): repeated places, and the bucket's first and last one."""
    found = _sorted_bucket(batches)
    if found is None:
        return
    bucket, _, new = found
    same = np.cumsum(new) - 1
    told = (np.bincount(same)[same] > 1) & (bucket.column("place").to_numpy() >= 0)
    edges = bucket.take(pa.array(sorted({0, len(new) - 1})))
    for rows, edge in ((bucket.filter(pa.array(told)), False), (edges, True)):
        yield from rows.append_column("edge", pa.array(np.full(len(rows), edge))).to_batches(65_536)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that touch or overlap as one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _cut(batches):
    for batch in batches:
        texts, rows, spans, left = _bytes_of(batch.column(1)), [], [], []
        for text, found in zip(texts, batch.column(2).to_pylist()):
            gone = merged([(s["start"], s["end"]) for s in found or ()])
            edges = [0, *(x for span in gone for x in span), len(text)]
            left.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
            spans.append([{"start": a, "end": b} for a, b in gone])
            rows.append((len(text), sum(b - a for a, b in gone), len(gone)))
        counts = [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(left, pa.binary()), *counts, pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["row", "kept", "n_bytes", "n_removed", "n_spans", "spans"])


def _buckets(df: DataFrame, suffixes: float) -> int:
    return max(df.sparkSession.sparkContext.defaultParallelism, int(suffixes // BUCKET) + 1)


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """docs without the text, and kept (binary: what is left of it), n_bytes, n_removed, n_spans, spans (start, end in bytes).

    Texts are judged as they are, not as what is left of others, so both sides of a repeat go. Null texts count as empty;
    texts under `least` bytes stay whole. Rows of one id are told apart by a hash of their text; rows equal in both are
    copies of one another, so they go where they are long enough. A null id is an id. An empty table gives no rows.
    docs' own columns of the new names are replaced.
    """
    if not 0 < gram <= least <= 1 << (BLOCK_BITS - 1):
        raise ValueError("gram must be at most least, and least at most half a block")
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    body = F.coalesce(docs[text].cast("string"), F.lit(""))
    with stashes(spark) as keep, shuffles_freed(spark):
        texts = docs.select(docs[id_col].alias("id"), F.xxhash64(body).alias("mark"), body.alias("text")).where(F.octet_length("text") >= least)
        size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        where = ["id", "mark", "start"]
        rows = map_batches(texts, lambda batches: _runs_of((x for b in batches for x in by_size([b], 2)), least, gram), f"t1 long, t2 long, id {kind}, mark long, start long, n long")
        dealt = rows.repartitionByRange(_buckets(docs, size * 2 / (least - gram + 2)), "t1", "t2", *where)
        first = stash(map_batches(dealt, _compared_runs, f"id {kind}, mark long, start long, n long, what int"), "runs")

        tried = first.where(F.col("what").bitwiseAND(TRIED) != 0)
        places = tried.agg(F.sum("n")).first()[0] or 0
        own = tried.groupBy(F.col("id").alias("of"), F.col("mark").alias("its")).agg(F.collect_set(F.struct("start", "n", "what")).alias("tried"))
        met = texts.join(own.hint("merge"), F.col("id").eqNullSafe(F.col("of")) & (F.col("mark") == F.col("its"))).select("id", "mark", "text", "tried")
        suffixes = map_batches(met, lambda batches: _places_of(batches, least, gram), f"t1 long, t2 long, id {kind}, mark long, place long")
        dealt = suffixes.repartitionByRange(_buckets(docs, places), "t1", "t2", "id", "mark", "place")
        second = stash(map_batches(dealt, _compared_places, f"t1 long, t2 long, id {kind}, mark long, place long, edge boolean"), "places")

        edges = second.where("edge")
        across = edges.groupBy(F.col("t1").alias("e1"), F.col("t2").alias("e2")).agg(F.count("*").alias("met")).where("met > 1")
        across = edges.join(across, (F.col("t1") == F.col("e1")) & (F.col("t2") == F.col("e2"))).where("place >= 0")
        spans = first.where(F.col("what").bitwiseAND(REPEATED) != 0).select("id", "mark", "start", (F.col("start") + F.col("n") - 1 + least).alias("end"))
        for more in (second.where("not edge"), across):
            spans = spans.unionByName(more.select("id", "mark", F.col("place").alias("start"), (F.col("place") + least).alias("end")))
        spans = keep(spans.groupBy(F.col("id").alias("of"), F.col("mark").alias("its")).agg(F.collect_set(F.struct("start", "end")).alias("spans")), "spans")

    names = [c for c in docs.columns if c not in (text, "kept", "n_bytes", "n_removed", "n_spans", "spans")]
    whole = docs.select(F.struct(*[docs[c] for c in names]).alias("row"), docs[id_col].alias("id"), F.xxhash64(body).alias("mark"), body.alias("text"))
    joined = whole.join(spans.hint("merge"), F.col("id").eqNullSafe(F.col("of")) & (F.col("mark") == F.col("its")), "left").select("row", "text", "spans")
    shape = whole.select("row.*").schema.simpleString()
    out = map_batches(joined, lambda batches: _cut((x for b in batches for x in by_size([b], 1))), f"row {shape}, kept binary, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>")
    return out.select("row.*", "kept", "n_bytes", "n_removed", "n_spans", "spans")
