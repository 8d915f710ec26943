"""SimHash near-duplicates: segment-popcount embedding and a grid range join.

A 64-bit fingerprint is embedded as the bit counts of its sixteen segments of four bits. The Manhattan distance of
two embeddings is a lower bound of the Hamming distance of the fingerprints, so all pairs within the wanted
distance lie in cells of the count grid at most that far apart. Each different fingerprint goes to its own cell and
to those within half of the distance, where all such pairs meet; they are verified exactly, in the join's condition.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import by_size, map_batches, stash
from gridspark.llm.components import components

SEGMENTS, BITS, SEED = 16, 4, 42


def words(text: str) -> list[bytes]:
    """Runs of anything but ASCII white space, A-Z lowered (bytes.lower and bytes.split know ASCII alone)."""
    return text.encode("utf-8").lower().split()


def simhash(text: str, size: int = 3) -> int:
    """Bit i is 1 if it is set in over half of the hashes of the word shingles; 0 without words."""
    w = words(text)
    if not w:
        return 0
    shingles = [b" ".join(s) for s in zip(*(w[k:] for k in range(size)))] if len(w) >= size else [b" ".join(w)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles], dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, fp (long with the fingerprint's bits) of every row; a null text has no words."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in by_size(batches, 1):
            prints = np.array([simhash(t or "") for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints, pa.int64())], names=["id", "fp"])

    return map_batches(docs.select(docs[id_col].alias("id"), docs[text].alias("text")), run, f"id {kind}, fp long")


def neighbourhood(radius: int) -> list[int]:
    """Differences of packed cells (4 bits a segment) of Manhattan length up to radius, 0 among them.

    Counts are 0..4 and differences of two sums of such stay within -7..7 for radii up to 2, so different cells
    have different packed numbers.
    """
    found = {0}
    for _ in range(radius):
        found |= {f + (sign << 4 * s) for f in found for s in range(SEGMENTS) for sign in (1, -1)}
    return sorted(found)


def cell(fp):
    """Packed bit counts of the segments."""
    out = F.lit(0).cast("long")
    for s in range(SEGMENTS):
        segment = F.shiftrightunsigned(fp, BITS * s).bitwiseAND(F.lit((1 << BITS) - 1))
        out = out + F.shiftleft(F.bit_count(segment).cast("long"), 4 * s)
    return out


def near_pairs(prints: DataFrame, distance: int = 2) -> DataFrame:
    """Pairs (a, b), a < b, of different fingerprints (column fp, all different) within the Hamming distance.

    Cells within the distance of each other have a cell between them, within half of it of both. So a fingerprint goes
    to all cells within that half, and those that meet in one are verified in the join's condition.
    """
    if not 0 < distance <= 3:
        raise ValueError("distance is 1, 2 or 3")
    at = prints.select("fp", cell(F.col("fp")).alias("cell"))

    def spread(radius: int, name: str) -> DataFrame:
        steps = F.array(*[F.lit(d).cast("long") for d in neighbourhood(radius)])
        return at.select("fp", "cell", F.explode(steps).alias("step")).select(F.col("fp").alias(name), (F.col("cell") + F.col("step")).alias("cell"))

    far, near = spread(distance - distance // 2, "a"), spread(distance // 2, "b")
    close = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    return far.join(near.hint("merge"), (far["cell"] == near["cell"]) & close).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, distance: int = 2, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable by links).

    Rows of equal fingerprints are one node, so groups of copies of any size cost one node; repeated rows stay.
    A null or empty text has the zero fingerprint and is linked like any other. An empty table gives no rows.
    """
    prints = stash(fingerprints(docs, id_col, text), "simhash")
    nodes = stash(prints.groupBy("fp").agg(F.min("id").alias("first")), "nodes")
    links = stash(near_pairs(nodes, distance), "links")
    found = components(links, nodes.select(F.col("fp").alias("node"), "first"))
    # a stored table on this side too, so that a hot fingerprint's rows can be split over tasks
    labels = stash(nodes.join(found.select(F.col("node").alias("fp"), "component"), "fp", "left").select("fp", F.coalesce("component", "first").alias("component")), "labels")
    return prints.join(labels, "fp", "left").select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
