"""Queries of the corpus operators over whole tables, with production parameters, and their SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.llm import byte_bpe, conversation_repair, exact_search, fingerprint, language, line_dedup, packing, quality, simhash, suffix_dedup, token_counts, toxicity, vector_codes
from gridspark.llm.common import stash, table

TOXIC_FROM = 0.7


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(toxicity.sample(docs, labels))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"), "windows", "gap")


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_with_edit(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts are the sources; paths are the languages within a source."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(quality.sample(docs, labels, ~quality.held_out()))
    found = quality.classify(docs, model, "source", "lang")
    return found.select("doc_id", quality.held_out().alias("held_out"), "host", "path", "evidence", "host_rate", "path_rate", "score", (F.col("score") >= 0.5).alias("keep"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remaining lengths and digests of every document's text."""
    left = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_lines", "n_deleted", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_counts.attribute(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ("source", "lang", "text"))
    return found.withColumnRenamed("id", "doc_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    names, prototypes = language.fit(docs, ~language.held_out())
    found = language.identify(docs, names, prototypes)
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op10_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = exact_search.sign_codes(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return exact_search.search(codes, codes.where("id % 50 = 0"), 10)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", carry=("label",))
    by_label = stash(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "labels")  # its size is known: small ones are broadcast
    digest = hashlib.sha256(vector_codes.listed(books).encode()).hexdigest()
    joined = coded.join(by_label, F.col("label").eqNullSafe(F.col("of")), "left")
    return joined.select("vec_id", vector_codes.hex_codes(F.col("codes")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversation_repair.damage(table(spark, sf_dir, "conversations"))
    found = stash(conversation_repair.summarise(rows), "summaries")
    return conversation_repair.digests(rows, found).withColumnRenamed("conv", "conv_id")


OP10_SQL = """
WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 50 = 0),
pairs AS (
  SELECT q.vec_id AS query_id, e.vec_id AS neighbour_id,
         CAST(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN (q.embedding[i] > 0) <> (e.embedding[i] > 0) THEN 1 ELSE 0 END)) AS INTEGER) AS distance
  FROM q, embeddings e WHERE q.vec_id <> e.vec_id),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, rank, neighbour_id, distance FROM ranked WHERE rank <= 10
"""


#: Every string of 200 bytes by its digest.
OP12_SQL = """
WITH d AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id, text) AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS MATERIALIZED (SELECT r, i, md5(array_slice(b, i, i + 199)) AS m FROM (SELECT r, b, unnest(range(1, octet_length(b) - 198)) AS i FROM d)),
again AS (SELECT r, i FROM w SEMI JOIN (SELECT m FROM w GROUP BY m HAVING count(*) > 1) USING (m)),
marked AS (SELECT r, i, CASE WHEN i > lag(i) OVER (PARTITION BY r ORDER BY i) + 200 THEN 1 ELSE 0 END AS new FROM again),
spans AS (SELECT r, min(i) AS a, max(i) + 200 AS z FROM (SELECT *, sum(new) OVER (PARTITION BY r ORDER BY i) AS g FROM marked) GROUP BY r, g),
gaps AS (SELECT r, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 1) AS x, a AS y FROM spans
  UNION ALL SELECT d.r, coalesce(max(z), 1), any_value(octet_length(b)) + 1 FROM d LEFT JOIN spans ON d.r = spans.r GROUP BY d.r),
kept AS (SELECT g.r, coalesce(string_agg(hex(array_slice(b, x, y - 1)), '' ORDER BY x) FILTER (y > x), '') AS h FROM gaps g JOIN d ON g.r = d.r GROUP BY g.r),
sums AS (SELECT r, CAST(sum(z - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM spans GROUP BY r)
SELECT doc_id, octet_length(b) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(h)) AS kept_sha256
FROM d JOIN kept USING (r) LEFT JOIN sums USING (r)
"""


OP5_SQL = r"""
WITH lines AS (
  SELECT doc_id, pos, raw, trim(raw, ' ') AS line, len(regexp_extract_all(raw, '[^ \t\n\x0B\f\r]+')) AS w
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL)),
sums AS (SELECT *, CAST(sum(w) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS upto FROM lines),
-- the shortest stretches of ten words from each line on, and up to each line
stretches AS (
  SELECT a.doc_id, min(b.pos) AS x, max(b.pos) AS y, string_agg(b.line, chr(10) ORDER BY b.pos) AS body
  FROM sums a JOIN sums b ON a.doc_id = b.doc_id AND b.pos >= a.pos AND (b.upto - b.w) - (a.upto - a.w) < 10
  GROUP BY a.doc_id, a.pos, a.upto, a.w HAVING max(b.upto) - (a.upto - a.w) >= 10
  UNION
  SELECT a.doc_id, min(b.pos), max(b.pos), string_agg(b.line, chr(10) ORDER BY b.pos)
  FROM sums a JOIN sums b ON a.doc_id = b.doc_id AND b.pos <= a.pos AND a.upto - b.upto < 10
  GROUP BY a.doc_id, a.pos, a.upto HAVING a.upto - min(b.upto - b.w) >= 10),
later AS (SELECT s.doc_id, x, y FROM stretches s JOIN (SELECT body, min(doc_id) AS first FROM stretches GROUP BY body) f ON s.body = f.body WHERE s.doc_id > first),
gone AS (SELECT DISTINCT l.doc_id, l.pos FROM lines l JOIN later d ON l.doc_id = d.doc_id AND l.pos BETWEEN d.x AND d.y),
kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_deleted, coalesce(string_agg(l.raw, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL), '') AS body
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id)
SELECT doc_id, n_lines, n_deleted, CAST(length(body) AS BIGINT) AS kept_chars, sha256(body) AS kept_sha256 FROM kept
UNION ALL SELECT doc_id, 0, 0, NULL, NULL FROM documents WHERE text IS NULL
"""


def _op11_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Every part against every entry, round by round; sums of squares stay exact in doubles."""
    assign = lambda k: f"""a{k} AS MATERIALIZED (SELECT s.row_id, s.p, min((xx - 2 * list_inner_product(s.x, b.x) + list_inner_product(b.x, b.x)) * {entries} + b.k) AS dk
  FROM slices s JOIN b{k} b ON s.p = b.p GROUP BY 1, 2),
e{k} AS MATERIALIZED (SELECT row_id, p, CAST(dk AS BIGINT) % {entries} AS k, CAST(dk AS BIGINT) // {entries} AS d FROM a{k})"""  # noqa: E731
    refine = lambda k: f"""m{k} AS (SELECT p, k, i, CAST(sum(c) AS BIGINT) AS total, count(*) AS n FROM (SELECT e.p, e.k, unnest(x) AS c, generate_subscripts(x, 1) AS i FROM e{k} e JOIN slices s ON e.row_id = s.row_id AND e.p = s.p) GROUP BY 1, 2, 3),
l{k} AS (SELECT p, k, list(CAST((total - ((total % n) + n) % n) // n AS DOUBLE) ORDER BY i) AS x FROM m{k} GROUP BY 1, 2),
b{k + 1} AS MATERIALIZED (SELECT b.p, b.k, coalesce(l.x, b.x) AS x FROM b{k} b LEFT JOIN l{k} l ON b.p = l.p AND b.k = l.k)"""  # noqa: E731
    steps = ",\n".join(x for k in range(rounds) for x in (assign(k), refine(k))) + ",\n" + assign(rounds)
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS row_id, vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
slices AS MATERIALIZED (SELECT *, list_inner_product(x, x) AS xx FROM (SELECT row_id, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS x FROM kept, range({parts}) t(p))),
b0 AS MATERIALIZED (SELECT p, row_id - 1 AS k, x FROM slices WHERE row_id <= {entries}),
{steps},
digest AS (SELECT sha256(coalesce(string_agg(CAST(CAST(c AS BIGINT) AS VARCHAR), ',' ORDER BY p, k, i), '')) AS sha FROM (SELECT p, k, unnest(x) AS c, generate_subscripts(x, 1) AS i FROM b{rounds})),
coded AS (SELECT row_id, string_agg(printf('%02x', k), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM e{rounds} GROUP BY 1)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, sha AS codebooks_sha256 FROM coded JOIN kept USING (row_id), digest
"""


def _op13_sql() -> str:
    """The least (cost, audit) of each of four places, row by row; s0 nothing yet, s1 after s, s2 after u, s3 after a."""
    least = lambda *x: f"list_sort([{', '.join(x)}])[1]"
    add = lambda s, cost, letter, row="''": f"{{'c': {s}.c + {cost}, 'a': {s}.a || '{letter}', 't': {s}.t || {row}}}"
    put = lambda s, role: add(s, 2, "I", f"chr(10) || '{role}:'")
    never = "{'c': 1000000, 'a': '', 't': ''}"
    keep = lambda s, role: f"CASE WHEN r.kind < 2 AND r.initial = '{role}' THEN {add(s, 'r.kind', 'K', 'chr(10) || r.role || chr(58) || r.text')} ELSE {never} END"
    turn = lambda s, role: f"CASE WHEN r.kind < 2 THEN {add(s, '2 + r.kind', 'R', f"chr(10) || '{role}:' || r.text")} ELSE {never} END"
    gone = lambda s: add(s, 3, "D")
    insert = lambda frm, rest: f"SELECT {rest}, s0, s1, {least('s2', *(put(s, 'user') for s in ('s0', 's1', 's3')))} AS s2, {least('s3', put('s2', 'assistant'))} AS s3 FROM ({frm})"
    closed = lambda frm: insert(insert(frm, "conv_id, i"), "conv_id, i")
    moved = f"""SELECT r.conv_id, r.i, {gone("d.s0")} AS s0, {least(gone("d.s1"), keep("d.s0", "s"))} AS s1,
    {least(gone("d.s2"), *(f(s, "u" if f is keep else "user") for s in ("d.s0", "d.s1", "d.s3") for f in (keep, turn)))} AS s2, {least(gone("d.s3"), keep("d.s2", "a"), turn("d.s2", "assistant"))} AS s3
    FROM d JOIN r ON d.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = d.i + 1"""
    return rf"""
WITH RECURSIVE keyed AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
drawn AS (SELECT *, xor(list_reduce(list_transform(string_split(k, ''), lambda x: CAST(ascii(x) AS BIGINT)),
  lambda c, b: list_reduce(range(8), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b)), 4294967295), 4294967295) % 20 AS z FROM keyed),
damaged AS (SELECT conv_id, turn, CASE WHEN z = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
  CASE WHEN z = 1 THEN '' WHEN z = 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text, unnest(range(CASE z WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM drawn),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth FROM damaged),
r AS MATERIALIZED (SELECT *, left(role, 1) AS initial, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 2 WHEN nth > 1 THEN 3 WHEN NOT regexp_matches(text, '[.!?][ 	-
]*\z') THEN 1 ELSE 0 END AS kind FROM seen),
every AS (SELECT DISTINCT conv_id FROM conversations),
d AS ({closed(f"SELECT conv_id, CAST(0 AS BIGINT) AS i, {{'c': 0, 'a': '', 't': ''}} AS s0, {never} AS s1, {never} AS s2, {never} AS s3 FROM every")}
  UNION ALL {closed(moved)}),
pairs AS (SELECT conv_id, initial || lead(initial) OVER (PARTITION BY conv_id ORDER BY i) AS two FROM r),
counts AS (SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (kind = 2) AS blank, count(*) FILTER (kind = 3) AS duplicate, count(*) FILTER (kind = 1) AS truncated FROM r GROUP BY 1),
wrong AS (SELECT conv_id, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal FROM pairs GROUP BY 1),
best AS (SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, {least("s0", "s3")} AS s
  FROM every e LEFT JOIN counts c ON e.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN wrong w ON e.conv_id IS NOT DISTINCT FROM w.conv_id JOIN d ON e.conv_id IS NOT DISTINCT FROM d.conv_id AND d.i = coalesce(n, 0))
SELECT conv_id, CAST(gaps AS BIGINT) AS gaps, blank, duplicate, truncated, illegal, CAST(s.c AS BIGINT) AS cost, s.a AS audit, sha256(substring(s.t, 2)) AS repaired_sha256 FROM best
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_fingerprint, op3_quality, op4_byte_bpe, op5_line_dedup, op6_packing, op7_token_counts, op8_simhash, op9_language, op10_exact_search, op11_vector_codes, op12_suffix_dedup, op13_conversation_repair)}


def oracle_sql() -> dict[str, str]:
    return {"op5_line_dedup": OP5_SQL, "op10_exact_search": OP10_SQL, "op11_vector_codes": _op11_sql(), "op12_suffix_dedup": OP12_SQL, "op13_conversation_repair": _op13_sql()}
