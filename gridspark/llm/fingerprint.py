"""Document fingerprints: a homomorphic hash of the multiset of paragraphs.

Each paragraph is hashed to a wide vector; a document's fingerprint is the sum of its paragraphs' vectors, lane
by lane, modulo a power of two. So it does not depend on the order of paragraphs, and paragraphs can be added or
taken away without the rest (`combine`). A vector has two kinds of lanes:

- EXACT_LANES modulo 2**64, uniform and drawn by SHAKE-128 from the paragraph's bytes: equal multisets of
  paragraphs have equal sums, others differ but for a chance of about 2**-1024;
- LIKE_LANES modulo 2**32: each byte window of WINDOW bytes of the paragraph adds +1 or -1 to the lane that its
  hash names. These sums estimate inner products of window counts, hence the likeness of two documents:
  2ab / (aa + bb), cut to 0..1. The sums are read as signed numbers.

Paragraphs are the lines of a text. The text "" has the zero fingerprint.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import by_size, fresh, map_batches

EXACT_LANES, LIKE_LANES, WINDOW = 16, 256, 16
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_POWERS = np.array([pow(int(_BASE), k, 1 << 64) for k in range(WINDOW)], dtype=np.uint64)


def vector(paragraphs: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The sum of the vectors of the paragraphs of a text in UTF-8."""
    exact = np.zeros(EXACT_LANES, dtype=np.uint64)
    if not paragraphs:
        return exact, np.zeros(LIKE_LANES, dtype=np.uint32)
    lines = paragraphs.split(b"\n")
    drawn = b"".join([hashlib.shake_128(line).digest(8 * EXACT_LANES) for line in lines])
    exact = np.frombuffer(drawn, dtype="<u8").reshape(-1, EXACT_LANES).sum(axis=0, dtype=np.uint64)
    data = np.frombuffer(paragraphs, dtype=np.uint8)
    if len(data) < WINDOW or min(map(len, lines)) < WINDOW:  # a short paragraph is one window, filled up with line breaks
        data = np.frombuffer(b"\n".join([line.ljust(WINDOW, b"\n") for line in lines]), dtype=np.uint8)
        lines = [line.ljust(WINDOW, b"\n") for line in lines]
    n = len(data) - WINDOW + 1
    wide = data.astype(np.uint64)
    hashed = np.zeros(n, dtype=np.uint64)
    for k in range(WINDOW):
        hashed += wide[k : k + n] * _POWERS[k]
    ends = np.cumsum([len(line) + 1 for line in lines])[:-1]
    if len(ends):  # windows across a line break do not count
        inside = np.ones(n, dtype=bool)
        across = (ends[:, None] - 1 - np.arange(WINDOW)[None, :]).ravel()
        inside[across[(across >= 0) & (across < n)]] = False
        hashed = hashed[inside]
    hashed ^= hashed >> np.uint64(32)
    hashed *= _MIX
    lanes = (hashed >> np.uint64(40)).astype(np.int64) % LIKE_LANES
    signs = 1 - 2 * (hashed >> np.uint64(63)).astype(np.int64)
    like = np.bincount(lanes, weights=signs, minlength=LIKE_LANES).astype(np.int64).astype(np.uint32)
    return exact, like


def to_text(print_: tuple[np.ndarray, np.ndarray]) -> str:
    return (print_[0].astype("<u8").tobytes() + print_[1].astype("<u4").tobytes()).hex()


def from_text(text: str) -> tuple[np.ndarray, np.ndarray]:
    raw = bytes.fromhex(text)
    return np.frombuffer(raw[: 8 * EXACT_LANES], dtype="<u8").copy(), np.frombuffer(raw[8 * EXACT_LANES :], dtype="<u4").copy()


def combine(a: str, b: str, sign: int = 1) -> str:
    """The fingerprint with the paragraphs of b put in (sign 1) or taken out (-1)."""
    (x, y), (u, v) = from_text(a), from_text(b)
    return to_text((x + u, y + v) if sign == 1 else (x - u, y - v))


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """1 for equal fingerprints, otherwise the estimate from the signed lanes, under 1."""
    if np.array_equal(a[0], b[0]) and np.array_equal(a[1], b[1]):
        return 1.0
    x, y = a[1].astype(np.int32).astype(float), b[1].astype(np.int32).astype(float)
    whole = x @ x + y @ y
    return float(min(max(2 * (x @ y) / whole, 0.0), np.nextafter(1.0, 0.0))) if whole else 0.0


def fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """docs with a column of fingerprints (hex). A null text counts as empty. Repeated rows get equal prints.
    A column of docs that has the new name is replaced.
    """
    names = [c for c in docs.columns if c != out]
    bound = docs.select(*[docs[c] for c in names], F.coalesce(docs[text], F.lit("")).alias(fresh(docs, "body")[0]))

    def run(batches):
        for b in by_size(batches, b_column):
            prints = [to_text(vector(t.encode("utf-8"))) for t in b.column(b_column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:b_column], pa.array(prints, pa.string())], names=[*names, out])

    b_column = len(names)
    from pyspark.sql.types import StringType, StructField, StructType

    return map_batches(bound, run, StructType([*(docs.schema[c] for c in names), StructField(out, StringType())]))


def edited(text: str, following: str, part: int = 4) -> str:
    """text with its last 1/part of code points replaced by the first as many (or all) of the following text."""
    k = len(text) // part
    return text[: len(text) - k] + following[:k]


def compare_with_edit(docs: DataFrame, rows_a_bucket: int = 500, most_buckets: int = 10_000) -> DataFrame:
    """For each document the fingerprints of its text and of an edit of it, and likenesses to the edit and the next.

    The next document is the one with the next doc_id (a number; equal ids: by text; null: lowest); the first one
    follows the last, so a lone document follows itself. Buckets of neighbouring ids are dealt out by quantiles, and
    the first row of a bucket goes to the bucket before as well, so each task has all it needs. The driver gathers
    one id for each bucket (most_buckets at most; buckets of larger tables hold more rows and are read as a stream).
    A null text counts as empty. Repeated rows are kept; an empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    key = F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf")))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), key.alias("key"))
    buckets = min(most_buckets, max(1, -(-rows.count() // rows_a_bucket)))
    cuts = np.unique(rows.approxQuantile("key", [k / buckets for k in range(1, buckets)], 0.2 / buckets)) if buckets > 1 else np.zeros(0)

    @F.pandas_udf("int")
    def bucket_of(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, k.to_numpy(), side="right").astype(np.int32))

    firsts = {r["bucket"]: r["first"] for r in rows.groupBy(bucket_of("key").alias("bucket")).agg(F.min("key").alias("first")).collect()}
    order = sorted(firsts)
    before = {firsts[b]: (b, order[i - 1]) for i, b in enumerate(order)}

    def deal(batches):
        for b in by_size(batches, 1):
            keys = b.column(2).to_numpy(zero_copy_only=False)
            own = np.searchsorted(cuts, keys, side="right")
            more = np.flatnonzero(np.isin(keys, list(before)))
            take = np.concatenate((np.arange(b.num_rows), more))
            to = np.concatenate((own, [before[keys[i]][1] for i in more])).astype(np.int32)
            taken = pa.array(take)
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(np.arange(len(take)) >= b.num_rows), b.column(0).take(taken), b.column(1).take(taken)], names=["bucket", "extra", "doc_id", "text"])

    def compare(batches):
        held = None  # the row that waits for its next: bucket, doc_id, text, vector
        done = None  # a bucket that is complete
        for b in by_size(batches, 3):
            out = [[] for _ in range(7)]
            for bucket, extra, doc_id, text in zip(*(c.to_pylist() for c in b.columns)):
                if bucket == done:
                    continue
                own = vector(text.encode("utf-8"))
                if held and held[0] == bucket:
                    _, before_id, before_text, before_vector = held
                    edit = edited(before_text, text).encode("utf-8")
                    changed = vector(edit)
                    row = (before_id, len(before_text), hashlib.sha256(edit).hexdigest(), to_text(before_vector), to_text(changed), likeness(before_vector, changed), likeness(before_vector, own))
                    for column, value in zip(out, row):
                        column.append(value)
                held = None if extra else (bucket, doc_id, text, own)
                done = bucket if extra else None
            yield pa.RecordBatch.from_arrays([pa.array(out[0], b.schema.field("doc_id").type), pa.array(out[1], pa.int64()), *(pa.array(c, pa.string()) for c in out[2:5]), *(pa.array(c, pa.float64()) for c in out[5:])], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    dealt = map_batches(rows, deal, f"bucket int, extra boolean, doc_id {kind}, text string")
    ordered = dealt.repartition("bucket").sortWithinPartitions("bucket", "extra", "doc_id", "text")
    return map_batches(ordered, compare, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
