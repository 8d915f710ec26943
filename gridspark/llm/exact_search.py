"""Exact top-k search over binary codes by incremental multi-index hashing.

A code of 64 bits is cut into SEGMENTS segments. If two codes differ in at most r * SEGMENTS + SEGMENTS - 1 bits,
some segment differs in at most r. So after all cells within r bits of a query's segments have been looked up, every
code up to that distance has been seen, and a query whose k-th verified distance is no larger is done. Radii grow
from 0; queries that are done leave.

Equal codes are one entry with their smallest ids, so a code that a third of the rows share costs one row. An upper
bound of each query's k-th distance, at first from some codes of the table and then from those verified, keeps
candidates out that cannot be among the first k; it changes no result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridspark.llm.common import stash

SEGMENTS, BITS = 4, 16
#: Codes that give each query its first bound.
PROBE_CODES = 1024
#: Parts in which a query's candidates are ranked before they are ranked together.
PARTS = 32


def sign_codes(vectors: DataFrame, id_col: str, vector: str, bits: int = 64) -> DataFrame:
    """id and code: bit i is 1 if component i is over 0 (missing and null components: 0). Null vectors have no code."""
    code = F.lit(0).cast("long")
    for i in range(bits):
        code = code.bitwiseOR(F.when(F.get(F.col(vector), F.lit(i)) > 0, F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")))
    return vectors.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), code.alias("code"))


def _segments(code) -> list:
    return [F.shiftrightunsigned(code, BITS * s).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int") for s in range(SEGMENTS)]


def _spread(codes: DataFrame, name: str) -> DataFrame:
    """A row for each segment of each code."""
    cells = F.array(*[F.struct(F.lit(s).alias("s"), v.alias("v")) for s, v in enumerate(_segments(F.col(name)))])
    return codes.select("*", F.explode(cells).alias("x")).select(*codes.columns, F.col("x.s").alias("s"), F.col("x.v").alias("v"))


def masks(radius: int) -> list[int]:
    """Segment values with exactly so many bits."""
    return [sum(1 << b for b in bits) for bits in combinations(range(BITS), radius)]


def distance(a, b):
    return F.bit_count(a.bitwiseXOR(b))


def search(codes: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, neighbour_id, distance: the k nearest codes by (distance, id) of each query, itself left out.

    codes and queries: (id, code). Fewer than k other rows give fewer neighbours; ids are taken to be different (a
    repeated id is a row like another). Null codes or ids are left out.
    """
    spark = codes.sparkSession
    rows = codes.where("id is not null and code is not null").select("id", "code")
    asked = queries.where("id is not null and code is not null").select("id", "code")
    # a query's own row takes a place, so k + 1 of each code are enough
    least = Window.partitionBy("code").orderBy("id")
    kept = stash(rows.withColumn("n", F.row_number().over(least)).where(F.col("n") <= k + 1).select("code", "id"), "codes")
    table = stash(kept.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")), "entries")
    index = stash(_spread(table.select(F.col("code").alias("b")), "b"), "index")
    targets = stash(asked.select("code").distinct(), "targets")
    active = targets.select(F.col("code").alias("a"))

    first = [r["code"] for r in table.orderBy(F.xxhash64("code")).limit(PROBE_CODES).select("code").collect()]
    if not first:
        return spark.createDataFrame([], f"query_id {_kind(queries)}, rank int, neighbour_id {_kind(codes)}, distance int")
    # the bound is the distance of the (k + 1)th of them: at least k are other rows than the query's own
    ranked_codes = F.sort_array(F.transform(_numbers(first, "bigint"), lambda c: distance(F.col("a"), c)))
    active = stash(active.select("a", F.coalesce(F.get(ranked_codes, F.lit(k)), F.lit(64)).alias("most")), "active")

    found = None
    for radius in range(BITS + 1):
        cells = _spread(active, "a").select("a", "most", "s", "v")
        probes = cells.withColumn("m", F.explode(_numbers(masks(radius), "int"))).select("a", "most", "s", F.col("v").bitwiseXOR(F.col("m")).alias("v"))
        # merged: a broadcast of the index, which Spark takes for small by its bytes on disk, would not fit a driver
        hit = probes.join(index.hint("merge"), (probes["s"] == index["s"]) & (probes["v"] == index["v"]) & (distance(probes["a"], index["b"]) <= probes["most"]))
        new = hit.select("a", "b").distinct()
        fresh = new.select("a", "b", distance(F.col("a"), F.col("b")).alias("d"))
        found = stash(fresh if found is None else found.unionByName(fresh).distinct(), f"found{radius}")
        covered = SEGMENTS * radius + SEGMENTS - 1
        # the (k + 1)th verified distance bounds the search from now on; once it is covered, the query is done
        sizes = table.select(F.col("code").alias("b"), F.size("ids").alias("n"))
        # a row for each query and distance, so a query's list has at most 65 entries however many codes it has met
        counts = found.join(sizes, "b").groupBy("a", "d").agg(F.sum("n").alias("n")).groupBy("a").agg(F.collect_list(F.struct("d", "n")).alias("ds"))
        reached = lambda x: F.aggregate("ds", F.lit(0).cast("long"), lambda acc, y: acc + F.when(y["d"] <= x["d"], y["n"]).otherwise(0)) > k  # noqa: E731, B023
        verified = counts.select("a", F.array_min(F.transform(F.filter("ds", reached), lambda x: x["d"])).alias("kth"))
        nearer = active.join(verified, "a", "left").select("a", F.least("most", F.coalesce("kth", "most")).alias("most"))
        active = stash(nearer.where(F.col("most") > covered), f"active{radius}")
        if active.isEmpty():
            break
    named = asked.select(F.col("id").alias("query_id"), F.col("code").alias("a"))
    # the first of each part, then of all: the candidates of a query that shares its cells with many meet in no single task
    part = F.pmod(F.xxhash64("neighbour_id"), F.lit(PARTS))
    listed = found.join(table.select(F.col("code").alias("b"), "ids"), "b").select("a", "d", F.explode("ids").alias("neighbour_id"))
    best = listed
    for keys in (["a", part], ["a"]):
        best = best.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("d", "neighbour_id"))).where(F.col("n") <= k + 1).drop("n")
    lists = stash(best.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("d", F.col("neighbour_id").alias("i")))).alias("near")), "lists")
    answer = named.join(lists, "a").select("query_id", F.slice(F.filter("near", lambda x: x["i"] != F.col("query_id")), 1, k).alias("near"))
    return answer.select("query_id", F.posexplode("near").alias("rank", "x")).select("query_id", (F.col("rank") + 1).alias("rank"), F.col("x.i").alias("neighbour_id"), F.col("x.d").cast("int").alias("distance"))


def _numbers(values: list[int], kind: str):
    """A constant array; one literal in the plan, however many values."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def _kind(df: DataFrame) -> str:
    return df.schema["id"].dataType.simpleString()
