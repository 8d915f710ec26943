"""Operators against brute force, round trips and public libraries, awkward rows included."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridspark.llm import byte_bpe, components, exact_search, fingerprint, language, line_dedup, packing, quality, simhash, token_counts, toxicity
from gridspark.llm.queries import queries
from tests.llm.helpers import SCHEMA, awkward, prose, table

SF = "/root/testdata/sf0.001"
MULTI, WORDS = P.path("byte_bpe_multi_50k.tiktoken"), P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, awkward())


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(MULTI, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_equals_library(spark, docs, none, library):
    rows = {(r["id"], bytes(r["ids"]), bytes(r["decoded"])) for r in byte_bpe.encode(docs, MULTI, P.PATTERN).collect()}
    assert rows == {(d, np.array(library.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for d, t, *_ in awkward()}
    assert byte_bpe.encode(none, MULTI, P.PATTERN).count() == 0


def test_byte_bpe_on_random_strings(library):
    codec, rng = byte_bpe.ByteBPE(byte_bpe.read_bytes(MULTI), P.PATTERN), random.Random(5)
    texts = ["".join(rng.choice("ab cé \n\tß日.,'s　\x1c" + chr(rng.randrange(0x250, 0x1FFFF) if rng.random() < 0.05 else 65)).replace("\ud800", "") for _ in range(rng.randrange(40))) for _ in range(3000)]
    texts = [t.encode("utf-8", "ignore").decode() for t in texts] + ["abcd" * 20_000, "\U00019124a \U00019124"]
    flat, ends = codec.encode_column(pa.array(texts))
    assert [x.tolist() for x in np.split(flat, ends[:-1])] == [library.encode_ordinary(t) for t in texts]


def test_token_counts_equal_offsets_of_library(spark, docs, none):
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    found = token_counts.attribute(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, ("source", "text")).collect()
    expected = []
    for d, text, *rest in awkward():
        source = rest[1] if len(rest) > 1 else "s"
        spans, at = [], 0
        for field, value in (("source", (source or "") + "\n"), *(("text", line + "\n") for line in (text or "").split("\n"))):
            spans.append((field, at, at + len(value)))
            at += len(value)
        encoded = tokenizer.encode((source or "") + "\n" + (text or "") + "\n", add_special_tokens=False)
        counts = [0] * len(spans)
        for s, e in encoded.offsets:
            shared = [max(0, min(max(e, s + 1), y) - max(s, x)) for _, x, y in spans]
            counts[shared.index(max(shared))] += 1
        for k, ((field, x, y), n) in enumerate(zip(spans, counts)):
            expected.append((d, field, 0 if field == "source" else k - 1, x, y, n, len(encoded.ids)))
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, expected))
    assert token_counts.attribute(none, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


@pytest.mark.parametrize("weights", [None, {"a": 0.5, "b": 0.3, "c": 0.2}])
def test_round_robin_places_every_token_once(weights):
    totals = {"a": 5000, "b": 700, "c": 33}
    number, sizes, shares = packing.queues(totals, weights, 256)
    plan, seen = packing.RoundRobin(sizes, shares, 256, 64), {}
    for j, n in enumerate(sizes):
        for x in range(0, n, 37):
            for start, k, sequence, offset in plan.pieces(j, x, min(37, n - x)):
                seen.update({(sequence, offset + i): (j, x + start + i) for i in range(k)})
    assert len(seen) == sum(sizes) == len(set(seen.values()))
    lengths = np.bincount([s for s, _ in seen])
    assert all(n == 64 or n & (n - 1) == 0 for n in lengths.tolist())
    if weights is None:  # each full window holds each queue's share within a token
        for w in range(plan.windows - 1):
            for j, n in enumerate(sizes):
                assert abs(plan.sent(j, w + 1) - plan.sent(j, w) - 256 * n / sum(sizes)) < 2


def test_packing(spark, docs, none):
    tokenizer = Tokenizer.from_file(WORDS)
    ids = {}
    for d, t, *_ in awkward():
        ids.setdefault(d, []).append([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2])
    rows = packing.pack(docs, WORDS, length=64, window=256).collect()
    assert sum(r["length"] for r in rows) == sum(len(x) for xs in ids.values() for x in xs)
    for r in rows:
        cuts = [np.array(x[r["start"] : r["start"] + r["length"]], "<u4").tobytes() for x in ids[r["doc_id"]] if len(x) == r["doc_tokens"]]
        assert r["ids_crc32"] in [zlib.crc32(c) for c in cuts]
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 64
    assert packing.pack(none, WORDS).count() == 0


def test_simhash_and_links(spark, none):
    base = prose(11, 400)
    texts = [(i, base.replace("alpha1 ", "", i)) for i in range(12)] + [(100 + i, base) for i in range(30)] + awkward()
    found = simhash.near_duplicates(table(spark, texts)).collect()
    prints = []
    for d, t, *_ in texts:
        words = (t or "").encode().lower().split()
        shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        prints.append((d, sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))))
    label = {p: p for _, p in prints}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    values = sorted(label)
    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 2:
                label[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for d, p in prints:
        if d is not None:
            least[root(p)] = min(d, least.get(root(p), d))
    assert sorted(map(str, map(tuple, found))) == sorted(str((d, f"{p:016x}", least.get(root(p)))) for d, p in prints)
    assert simhash.near_duplicates(none).count() == 0


def test_simhash_pairs_of_dense_prints(spark):
    rng = random.Random(3)
    base = rng.getrandbits(63)
    values = sorted({base ^ (1 << rng.randrange(62)) ^ (1 << rng.randrange(62)) for _ in range(150)} | {rng.getrandbits(63) for _ in range(200)})
    got = {tuple(sorted(r)) for r in simhash.near_pairs(spark.createDataFrame([(v,) for v in values], "fp long")).collect()}
    assert got == {(a, b) for i, b in enumerate(values) for a in values[:i] if (a ^ b).bit_count() <= 2}


def test_fingerprints(spark, docs, none):
    a, b = "one line here is long enough\nanother line of words\nthird", "third\none line here is long enough\nanother line of words"
    f = lambda t: fingerprint.to_text(fingerprint.vector(t.encode()))
    assert f(a) == f(b) != f(a + "\nmore")
    assert fingerprint.combine(f(a), f("more")) == f(a + "\nmore")
    assert fingerprint.combine(f(a + "\nmore"), f("more"), -1) == f(a)
    rows = sorted(awkward(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    texts = [r[1] or "" for r in rows]
    edits = [t[: len(t) - len(t) // 4] + texts[(i + 1) % len(texts)][: len(t) // 4] for i, t in enumerate(texts)]
    expected = sorted((str(r[0]), len(t), hashlib.sha256(e.encode()).hexdigest(), f(t), f(e)) for r, t, e in zip(rows, texts, edits))
    for size in (1, 4, 500):
        found = fingerprint.compare_with_edit(docs, rows_a_bucket=size).collect()
        assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) for r in found) == expected
    assert fingerprint.compare_with_edit(none).count() == 0
    assert fingerprint.fingerprint(docs).count() == len(rows)


def test_patience_and_blocks():
    a, b = [1, 2, 3, 4, 9, 5], [7, 1, 2, 3, 8, 4, 5]
    assert line_dedup.matches(a, b) == [(0, 1), (1, 2), (2, 3), (3, 5), (5, 6)]
    assert line_dedup.blocks(line_dedup.matches(a, b), [5] * 7, 12) == [1, 2, 3]
    assert line_dedup.matches([1, 1, 2], [2, 1, 1]) == [(2, 0)] and line_dedup.matches([], [1]) == []


def test_line_dedup(spark, none):
    shared, own = prose(20, 60), [prose(30 + i, 25) for i in range(80)]
    texts = [(i, own[i] + "\n" + shared + "\n" + prose(200 + i, 3)) for i in range(70)]  # one passage of many holders
    texts += [(100, prose(300, 15) + "\n" + prose(301, 15)), (101, prose(302, 20) + "\n" + prose(300, 15) + "\n\n" + prose(301, 15)), (102, "short\nlines"), (103, "short\nlines")]
    texts += [(200 + i, "short\n" + prose(400, 30)) for i in range(60)] + awkward()
    df = table(spark, texts)
    found = {}
    for r in sorted(line_dedup.line_dedup(df).collect(), key=lambda r: (r["text"] is None, -r["n_lines"], -len(r["text"] or ""))):  # rows have no order
        found.setdefault(r["doc_id"], []).append(r)
    assert found[0][0]["text"] == texts[0][1]
    assert all(found[i][0]["text"] == own[i] + "\n" + prose(200 + i, 3) for i in range(1, 70))
    assert found[101][0]["text"] == prose(302, 20) + "\n"  # the blank line goes between blocks of one run or stays
    assert [found[i][0]["text"] for i in (102, 103)] == ["short\nlines"] * 2
    assert [found[200 + i][0]["text"] for i in range(60)] == [texts[74][1]] + [""] * 59  # copies go whole, as they do with fewer holders
    assert found[5][1]["text"] == "" and found[4][1]["text"] == awkward()[4][1]
    assert [r["text"] for r in found[6] if r["text"] == prose(2, 40)] == [prose(2, 40)] * 2  # equal rows are treated alike
    assert sum(map(len, found.values())) == len(texts)
    assert line_dedup.line_dedup(none).count() == 0


def test_exact_search(spark):
    rng = random.Random(4)
    codes = [(i, rng.getrandbits(64) - (1 << 63)) for i in range(300)] + [(300 + i, 77) for i in range(40)] + [(400 + i, 77 ^ (1 << rng.randrange(60))) for i in range(30)]
    df = spark.createDataFrame([*codes, (None, 5), (999, None)], "id long, code long")
    got = {(r["query_id"], r["rank"]): (r["neighbour_id"], r["distance"]) for r in exact_search.search(df, df.where("id % 20 = 0"), 5).collect()}
    expected = {}
    for q, c in codes:
        if q % 20 == 0:
            near = sorted((((c ^ d) & (2**64 - 1)).bit_count(), i) for i, d in codes if i != q)[:5]
            expected.update({(q, k + 1): (i, n) for k, (n, i) in enumerate(near)})
    assert got == expected
    few = spark.createDataFrame([(1, 5), (2, 6)], "id long, code long")
    assert [tuple(r) for r in exact_search.search(few, few, 5).orderBy("query_id").collect()] == [(1, 1, 2, 2), (2, 1, 1, 2)]
    assert exact_search.search(few.limit(0), few, 5).count() == 0


def test_language(spark, docs, none):
    letters = language.shared_profiles()
    assert letters.profile("12 ..") is None and letters.profile("") is None
    english, other = [(i, prose(500 + i, 50), "en") for i in range(40)], [(100 + i, " ".join(["über", "straße", "nicht", "schön"][j % 4] + "ung" for j in range(i + 20)), "de") for i in range(40)]
    df = table(spark, english + other)
    names, prototypes = language.fit(df, ~language.held_out())
    assert names == ["de", "en"]
    rows = language.identify(df.unionByName(docs), names, prototypes).collect()
    assert all(r["lang_pred"] == ("en" if r["doc_id"] < 100 else "de") for r in rows if r["doc_id"] is not None and (20 <= r["doc_id"] < 40 or r["doc_id"] >= 100))
    assert {r["lang_pred"] for r in rows if r["doc_id"] == 8} >= {"und"}
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert language.fit(none, F.lit(True))[0] == [] and language.identify(docs, [], prototypes[:0]).where("lang_pred <> 'und'").count() == 0


def test_toxicity(spark, docs, none):
    step = toxicity.SETTINGS.window - toxicity.SETTINGS.overlap
    assert b"".join(w[:step] for w in toxicity.windows(bytes(range(250)) * 4)[:-1]) == (bytes(range(250)) * 4)[: step * (len(toxicity.windows(bytes(range(250)) * 4)) - 1)]
    model = toxicity.fit([(i, prose(i, 80) + (" idiot scum moron " if i % 2 else " ") + prose(i + 1000, 80), i % 2) for i in range(200)])
    df = table(spark, [(i, prose(i + 5000, 100) + (" you scum and moron " if i % 2 else "") + prose(i + 9000, 40)) for i in range(40)])
    rows = toxicity.score(df.unionByName(docs), model).collect()
    seen = [r for r in rows if r["windows"] > 5 and r["doc_id"] is not None and r["doc_id"] >= 11]
    assert np.mean([(r["score"] >= 0.5) == bool(r["doc_id"] % 2) for r in seen]) > 0.9
    assert all(0 <= r["score"] <= 1 for r in rows) and len(rows) == 40 + len(awkward())
    assert toxicity.fit([]) is None and toxicity.score(docs, None).where("score > 0").count() == 0 and toxicity.score(none, model).count() == 0


def test_quality(spark, docs, none):
    model = quality.fit([(prose(i, 60), 1) for i in range(60)] + [("BUY NOW!! " * 30, 0), ("x x x x x x " * 20, 0)] * 30)
    df = table(spark, [(i, prose(i, 50), "a", "good") for i in range(50)] + [(100 + i, "BUY NOW!! " * (20 + i), "a", "bad") for i in range(50)])
    rows = quality.classify(df, model, "source", "lang").collect()
    assert all((r["score"] >= 0.5) == (r["doc_id"] < 100) for r in rows)
    rates = {r["host"]: r["host_rate"] for r in rows}
    assert rates["good"] > rates["bad"]
    assert quality.classify(docs, model, "source", "lang").count() == len(awkward()) and quality.classify(none, model, "source", "lang").count() == 0
    assert quality.classify(docs, None, "source", "lang").where("abs(score - 0.5) > 1e-6").count() == 0


@pytest.mark.parametrize("name", sorted(queries()))
def test_queries_return_every_row(spark, name):
    df = queries()[name](spark, SF)
    of, column = {"op11_vector_codes": ("embeddings", "vec_id"), "op13_conversation_repair": ("conversations", "conv_id")}.get(name, ("documents", "doc_id"))
    ids = {r[0] for r in spark.read.parquet(f"{SF}/{of}.parquet").select(column).collect()}
    if name.startswith("op10"):
        assert df.count() == 10 * spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id % 50 = 0").count()
    else:
        assert {r[0] for r in df.select(column).collect()} == ids


def test_toxicity_settings():
    """Windows of any settings cover the text; separable rows have a small cross-validated loss, too few rows none."""
    data = bytes(range(250)) * 3
    for settings in (toxicity.SETTINGS, toxicity.Settings(window=50, overlap=10), toxicity.Settings(window=7, overlap=0)):
        step, parts = settings.window - settings.overlap, toxicity.windows(data, settings)
        assert b"".join([w[:step] for w in parts[:-1]] + parts[-1:]) == data
    rows = [(i, prose(i, 60) + (" zounds knave villain" * 3 if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(120)]
    assert toxicity.cross_validated_loss(rows, toxicity.SETTINGS) < 0.3
    assert toxicity.cross_validated_loss(rows[:5], toxicity.SETTINGS) == float("inf")


def test_likeness_of_a_window_repeated_often():
    a = fingerprint.vector(b"a" * 40_000)
    b = fingerprint.vector(b"a" * 30_000 + b"b" * 10_000)
    assert fingerprint.from_text(fingerprint.to_text(a))[1].tolist() == a[1].tolist()
    assert 0.9 < fingerprint.likeness(a, b) < 1.0
    assert fingerprint.likeness(a, fingerprint.vector(fingerprint.edited("a" * 40_000, "a" * 5_000).encode())) > 0.9


def test_byte_bpe_under_another_pattern():
    """A pattern whose matches go over spaces is not cut before them."""
    pattern = r"\w+ \w+|\s+|[^\s]+"
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(MULTI, "rb"))}
    other = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    codec, rng = byte_bpe.ByteBPE(byte_bpe.read_bytes(MULTI), pattern), random.Random(6)
    texts = ["".join(rng.choice("ab cdé  \n,.x ") for _ in range(rng.randrange(30))) for _ in range(1500)] + [""]
    flat, ends = codec.encode_column(pa.array(texts))
    assert [x.tolist() for x in np.split(flat, ends[:-1])] == [other.encode_ordinary(t) for t in texts]


def test_exact_search_of_awkward_vectors(spark):
    """Null vectors have no code; short ones and null components count as not over 0; other columns are not read."""
    rows = [(0, [1.0, None, -1.0], "x"), (1, None, "x"), (2, [], "x"), (3, [1.0], "y"), (4, [0.5, 0.0, -2.0] + [0.0] * 61, "y"), (None, [1.0], "z"), (5, [-1.0] * 64 + [1.0] * 10, "z")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, code string")
    codes = exact_search.sign_codes(df, "vec_id", "embedding")
    assert {r["id"]: r["code"] for r in codes.collect()} == {0: 1, 2: 0, 3: 1, 4: 1, None: 1, 5: 0}
    found = exact_search.search(codes, codes.where("id in (0, 2)"), 2).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in found] == [(0, 1, 3, 0), (0, 2, 4, 0), (2, 1, 5, 0), (2, 2, 0, 1)]


@pytest.mark.parametrize("last", [0, 5, 1_000_000])
def test_components(spark, monkeypatch, last):
    """Chains, stars, cliques and random graphs against a search, by star rounds alone and with the last step."""
    monkeypatch.setattr(components, "LAST_EDGES", last)
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(a, b) for a in range(200, 209) for b in range(200, a)]
    links += [(rng.randrange(300, 420), rng.randrange(300, 420)) for _ in range(90)]
    links = [(a, b) for a, b in links if a != b]
    ids = sorted({x for e in links for x in e} | {999})
    name = {x: x for x in ids}
    for _ in ids:
        for a, b in links:
            name[a] = name[b] = min(name[a], name[b])
    first = {x: 5000 - x for x in ids}
    nodes = spark.createDataFrame(list(first.items()), "node long, first long")
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long").repartition(5), nodes).collect()}
    assert got == {x: min(first[y] for y in ids if name[y] == name[x]) for x in ids if x != 999}
