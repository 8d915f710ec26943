"""Near copies: texts linked by the Jaccard similarity of their sets of word shingles, over SimHash and minima.

Texts of equal shingle sets are one node. Candidates are nodes whose SimHash fingerprints lie within NEAR bits, found by
the grid join of `simhash`, and nodes that share a bucket. Fingerprints of 64 bits alone cannot do: at a similarity of 0.8
some ten bits differ, a radius at which neighbouring cells of the grid are nearly all cells. So each node also has
ROWS x BANDS minima of its hashed shingles under random multiplications, and nodes that agree in the ROWS minima of a
band share a bucket. A pair of similarity s shares none with probability (1 - s**ROWS)**BANDS: 7e-10 at 0.8, less above.

Candidates are verified exactly, pair by pair, but a large group is never paired with itself: first each node meets one
smallest node of its buckets alone; then, in buckets that still hold several components, each node meets one node of
each other component; and only what is in a bucket and not in one component after that meets pair by pair. These two
joins have a lower bound in their condition, so that texts which share much and yet too little make no rows: each
node has a sketch of bits, of which every shingle turns one over; the bits in which two sketches differ are at most as
many as the shingles in which the sets differ.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import by_size, map_batches, stash, stashes
from gridspark.llm.components import components
from gridspark.llm.simhash import SEED, near_pairs, simhash, words

SIZE, LEAST = 5, 0.8
#: Bits between fingerprints of candidates.
NEAR = 2
ROWS, BANDS = 4, 40
#: Bits of a sketch, in words of 64.
SKETCH_WORDS = 16
_ODD = np.uint64(0xD6E8FEB86659FD93)
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CHUNK = 4096


def _mixed(state: np.ndarray, more: np.ndarray) -> np.ndarray:
    state = (state ^ more) * _ODD
    return state ^ (state >> np.uint64(32))


def shingles(text: str, size: int = SIZE) -> np.ndarray:
    """Hashes of the different runs of `size` words, ascending; a shorter text is one run, no words give none."""
    digest = xxhash.xxh64_intdigest
    hashed = np.array([digest(w, SEED) for w in words(text)], dtype=np.uint64)
    if not len(hashed):
        return hashed
    size = min(size, len(hashed))
    n = len(hashed) - size + 1
    out = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        out = _mixed(out, hashed[k : k + n])
    return np.unique(out)


def bands(found: np.ndarray) -> np.ndarray:
    """A bucket number for each band."""
    least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(found), _CHUNK):
        np.minimum(least, (_FACTORS[:, None] * found[None, k : k + _CHUNK]).min(axis=1), out=least)
    out = np.arange(1, BANDS + 1, dtype=np.uint64) * _ODD
    for k in range(ROWS):
        out = _mixed(out, least[k::ROWS])
    return out


def sketch(found: np.ndarray) -> np.ndarray:
    """Parities of the shingles that fall on each bit."""
    bits = 64 * SKETCH_WORDS
    at = ((found * _ODD) >> np.uint64(40)).astype(np.int64) % bits
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").view("<i8")


def text_key(text: str):
    """A hash that stands for a row's text; null counts as empty."""
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def _prints(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """id, text_key, node (number of the shingle set), n (its size), fingerprint and bands of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in by_size(batches, 2):
            sets = [shingles(t) for t in b.column(2).to_pylist()]
            nodes = pa.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], pa.uint64()).view(pa.int64())
            flat = np.concatenate([bands(s) for s in sets]).view(np.int64) if sets else np.zeros(0, np.int64)
            cut = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32()), pa.array(flat))
            prints = pa.array([simhash(t, SIZE) for t in b.column(2).to_pylist()], pa.uint64()).view(pa.int64())
            bits = np.concatenate([sketch(s) for s in sets]) if sets else np.zeros(0, np.int64)
            sketches = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * SKETCH_WORDS, pa.int32()), pa.array(bits))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), nodes, pa.array([len(s) for s in sets], pa.int64()), prints, cut, sketches], names=["id", "text_key", "node", "n", "fp", "bands", "sketch"])

    rows = docs.select(F.col(id_col).alias("id"), text_key(text).alias("text_key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return map_batches(rows, run, f"id {kind}, text_key string, node long, n long, fp long, bands array<long>, sketch array<long>")


def _similar(batches, least: float):
    """Rows (a, b, a's text, b's text) whose shingle sets have at least this similarity."""
    last = (None, None)  # b's set, as many rows in turn can have the same b
    for batch in by_size(by_size(batches, 2), 3):
        out = [], []
        for a, b, text, other in zip(*(c.to_pylist() for c in batch.columns)):
            if last[0] != b:
                last = b, shingles(other)
            own = shingles(text)
            both = len(np.intersect1d(own, last[1], assume_unique=True))
            if both >= (least - 1e-9) * (len(own) + len(last[1]) - both):
                out[0].append(a)
                out[1].append(b)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], names=["a", "b"])


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b").distinct()


def near_copies(docs: DataFrame, least: float = LEAST, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, text_key and component (a number) of every row: rows linked, over others too, by a similarity of `least`.

    Null texts count as empty, and texts without words are copies of one another. Repeated rows stay.
    """
    if least < LEAST:
        raise ValueError(f"the bands cover similarities from {LEAST} on")
    with stashes(docs.sparkSession) as keep:
        prints = keep(_prints(docs, id_col, text), "prints")
        nodes = stash(prints.groupBy("node").agg(F.min("text_key").alias("text_key"), F.min("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")).where("n > 0"), "nodes")

        members = nodes.select("node", "n", F.posexplode("bands").alias("k", "band"))
        lowest = members.groupBy("band").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("band", "lo")
        shared = stash(members.join(lowest, "band"), "shared")
        votes = shared.where("node > lo").groupBy("node", "lo").agg(F.count("*").alias("n"))
        first = votes.groupBy("node").agg(F.max_by("lo", F.struct("n", "lo")).alias("lo")).select(F.col("node").alias("x"), F.col("lo").alias("y"))
        printed = nodes.groupBy("fp").agg(F.min("node").alias("lo"))
        same = nodes.join(printed, "fp").select(F.col("node").alias("x"), F.col("lo").alias("y"))
        near = near_pairs(printed.select("fp"), NEAR).join(printed.select(F.col("fp").alias("a"), F.col("lo").alias("x")), "a").join(printed.select(F.col("fp").alias("b"), F.col("lo").alias("y")), "b").select("x", "y")
        tried = stash(_ordered(first.unionByName(same).unionByName(near)), "tried")

        wanted = shared.select("node").unionByName(tried.select(F.col("a").alias("node"))).unionByName(tried.select(F.col("b").alias("node"))).distinct().join(nodes.select("node", "text_key"), "node")
        texts = docs.select(text_key(text).alias("text_key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        held = stash(texts.join(wanted.hint("merge"), "text_key").select("node", "text").dropDuplicates(["node"]), "texts")

        def verified(pairs: DataFrame) -> DataFrame:
            ends = pairs.join(held.select(F.col("node").alias("a"), F.col("text").alias("a_text")), "a").join(held.select(F.col("node").alias("b"), F.col("text").alias("b_text")), "b")
            return stash(map_batches(ends.select("a", "b", "a_text", "b_text"), lambda batches: _similar(batches, least), "a long, b long"), "links")

        def labelled(links: DataFrame) -> DataFrame:
            return components(links, nodes.select("node", F.col("node").alias("first")))

        def unsettled(rows: DataFrame, labels: DataFrame) -> DataFrame:
            """Rows (band, k, node, n) of the buckets that hold several components."""
            at = stash(rows.select("band", "k", "node", "n").join(labels, "node", "left").select("band", "k", "node", "n", F.coalesce("component", "node").alias("component")), "members")
            several = at.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("band")
            return stash(at.join(several, "band"), "unsettled")

        def met(rows: DataFrame, others: DataFrame) -> DataFrame:
            """Pairs of a bucket in different components whose sizes and sketches allow the similarity.

            A pair comes from the first bucket it shares alone. So a node still meets one node of each component that
            it shares a bucket with: the smallest that is there, which speaks for its component wherever it is.
            """
            y = others.select(F.col("band").alias("bucket"), F.col("node").alias("y"), F.col("n").alias("m"), F.col("component").alias("other"), F.col("sketch").alias("bits"), F.col("bands").alias("buckets"))
            differ = sum((F.bit_count(F.get("sketch", F.lit(k)).bitwiseXOR(F.get("bits", F.lit(k)))) for k in range(SKETCH_WORDS)), F.lit(0))
            close = (F.least("n", "m") >= (least - 1e-9) * F.greatest("n", "m")) & (differ <= (F.col("n") + F.col("m")) * ((1 - least) / (1 + least) + 1e-9))
            earlier = F.arrays_overlap(F.slice("bands", F.lit(1), F.col("k")), F.slice("buckets", F.lit(1), F.col("k")))
            found = rows.join(y.hint("merge"), (F.col("band") == F.col("bucket")) & (F.col("component") != F.col("other")) & close & ~earlier)
            return _ordered(found.select(F.col("node").alias("x"), "y"))

        def with_sketches(rows: DataFrame) -> DataFrame:
            return stash(rows.join(nodes.select("node", "sketch", "bands"), "node"), "sketched")

        links = verified(tried)
        rest = with_sketches(unsettled(shared, labelled(links)))
        one = rest.groupBy("band", "component").agg(F.min(F.struct("node", "n", "sketch", "bands")).alias("s")).select("band", "component", "s.node", "s.n", "s.sketch", "s.bands")
        second = stash(met(rest, one).join(tried, ["a", "b"], "left_anti"), "tried")
        links = links.unionByName(verified(second))
        rest = with_sketches(unsettled(rest, labelled(links)))  # components only grow, so other buckets stay settled
        third = met(rest, rest).join(tried.unionByName(second), ["a", "b"], "left_anti")
        links = links.unionByName(verified(third))
        labels = keep(labelled(links), "labels")
    return prints.join(labels, "node", "left").select(F.col("id").alias(id_col), "text_key", F.coalesce("component", "node").alias("component"))
