"""Scores against plain formulas: toxicity, quality, fingerprint likeness, packing under weights."""

import math
import random
import unicodedata
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridspark.llm import common, fingerprint, language, line_dedup, packing, quality, toxicity
from tests.llm.helpers import SCHEMA, awkward, prose, table

WORDS = P.path("word_bpe_49k.json")


def lengths(dictionary: bytes, pieces: list[bytes]) -> list[int]:
    parameters = zstandard.ZstdCompressionParameters(compression_level=3, window_log=17, chain_log=16, hash_log=16, search_log=5, min_match=4, target_length=16, strategy=zstandard.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)
    held = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return [len(zstandard.ZstdCompressor(dict_data=held, compression_params=parameters).compress(p)) for p in pieces]


def test_toxicity_scores_by_hand(spark):
    rows = [(i, prose(i, 80) + (" zounds knave villain " if i % 2 else " ") + prose(i + 1000, 80), i % 2) for i in range(120)]
    model = toxicity.fit(rows)
    assert set(model) == {"ordinary", "toxic", "threshold", "weights", "settings"}
    texts = [(i, prose(i + 3000, 60) + (" knave and villain " if i % 3 == 0 else "") + prose(i + 4000, 50)) for i in range(12)] + awkward()
    got = sorted((str(r["doc_id"]), r["windows"], r["gap"], round(r["score"], 12)) for r in toxicity.score(table(spark, texts), model).collect())
    expected, s = [], model["settings"]
    for i, text, *_ in texts:
        data, pieces, at = (text or "").encode(), [], 0
        while not pieces or at < len(data) - s.overlap:  # windows at every step, up to the one that holds the last byte
            pieces.append(data[at : at + s.window])
            at += s.window - s.overlap
        gaps = [a - b for a, b in zip(lengths(model["ordinary"], pieces), lengths(model["toxic"] + model["ordinary"], pieces))]
        hits = [g for g in gaps if g >= model["threshold"]]
        seen = [1.0, max(gaps), math.log1p(len(hits)), len(hits) / len(gaps), math.log1p(max(0.0, sum(hits)))]
        expected.append((str(i), len(pieces), float(max(gaps)), round(1 / (1 + math.exp(-sum(a * b for a, b in zip(seen, model["weights"])))), 12)))
    assert got == sorted(expected)


def test_rows_to_fit_on(spark, monkeypatch):
    """Whole texts, one for each id and class, alike in any partitioning, up to a number of characters."""
    long = "".join(f"{k:06d}" for k in range(20_000))
    docs = spark.createDataFrame([(1, long), (2, "short"), (2, "other"), (2, "other"), (3, None), (4, "four"), (5, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 1), (2, 1), (2, 0), (3, 1), (4, 7), (4, None), (5, 0), (9, 1)], "doc_id long, toxic int")
    rows = lambda d, chars=10**9: sorted(common.drawn_rows(d, labels, F.lit(True), "toxic", {1: 100, 0: 100}, chars))
    assert rows(docs) == rows(docs.repartition(5)) == [(1, long, 1), (2, "other", 0), (2, "other", 1), (5, "", 0)]
    order = sorted([(1, len(long)), (2, 5), (2, 5), (5, 0)], key=lambda r: xxhash.xxh64_intdigest(str(r[0]), 42) & ((1 << 52) - 1))
    fit, total = [], 0
    for d, n in order:
        total += n
        fit += [d] if total <= 11 else []
    assert sorted(d for d, *_ in rows(docs, 11)) == sorted(fit)


def test_language_profiles_by_hand(spark):
    """Letters as random signs, bound by turns and products, bundled by counts, compared by cosine."""
    texts = [(i, prose(i, 30) + (" école à côté" if i % 2 else ""), "fr" if i % 2 else "en") for i in range(12)] + [(20, "mixed Case", None), (21, None, "en"), (22, "123", "fr"), (23, "ça", "fr")]
    frame = table(spark, texts)

    def profile(text: str) -> np.ndarray | None:
        total = np.zeros(language.DIMENSIONS)
        words = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in text.lower()).split()
        spread = "\0" + "\0".join(words) + "\0"
        sign = lambda c: np.random.default_rng((language.SEED, ord(c))).choice(np.array([-1, 1], dtype=np.int8), language.DIMENSIONS).astype(float)
        for x, y, z in zip(spread, spread[1:], spread[2:]):
            total += np.concatenate((sign(x)[-2:], sign(x)[:-2])) * np.concatenate((sign(y)[-1:], sign(y)[:-1])) * sign(z)
        return total if any(unicodedata.category(c)[0] == "L" for c in text) else None

    names, prototypes = language.fit(frame, F.lit(True))
    bundles = {}
    for _, text, lang, *_ in texts:
        p = profile(text) if text and lang else None
        if p is not None:
            bundles.setdefault(lang, []).append(p / np.linalg.norm(p))
    assert names == sorted(bundles)
    want = np.stack([np.sum(bundles[n], axis=0) / np.linalg.norm(np.sum(bundles[n], axis=0)) for n in names])
    assert np.allclose(prototypes, want, atol=1e-6)
    for r in language.identify(frame, names, prototypes).collect():
        text = next(t for d, t, *_ in texts if d == r["doc_id"])
        p = profile(text) if text else None
        if p is None:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            cosines = want @ p / np.linalg.norm(p)
            assert r["lang_pred"] == names[int(np.argmax(cosines))] and r["score"] == pytest.approx(min(max(cosines.max(), 0), 1), abs=1e-5)


def test_most_frequent_languages_are_learned(spark, monkeypatch):
    monkeypatch.setattr(language, "LANGUAGES", 2)
    texts = [(i, prose(i, 9), lang) for i, lang in enumerate(["en"] * 3 + ["de"] * 2 + ["fr", "es"] + ["fr"])]
    assert language.fit(table(spark, texts), F.lit(True))[0] == ["de", "en"]


def test_clashing_names(spark):
    """Columns of the operators' own names, new and internal ones, in the input."""
    extra = "_id string, mark string, lines string, own string, body string, fingerprint string, score string, lang_pred string, windows string, gap string, n_lines string"
    names = [c.split()[0] for c in extra.split(", ")]
    docs = table(spark, [(1, prose(1, 30)), (2, prose(1, 30) + "\n" + prose(2, 5)), (3, None)]).drop("fp", "lines", "score")
    docs = docs.select("*", *[F.lit("mine").alias(c) for c in names])
    keep = tuple(docs.columns)
    left = line_dedup.line_dedup(docs)
    assert left.columns == [c for c in keep if c != "n_lines"] + ["n_lines", "n_deleted"]
    assert sorted((r["doc_id"], r["n_deleted"], r["mark"], r["_id"]) for r in left.collect()) == [(1, 0, "mine", "mine"), (2, 1, "mine", "mine"), (3, 0, "mine", "mine")]
    printed = fingerprint.fingerprint(docs)
    assert printed.columns == [c for c in keep if c != "fingerprint"] + ["fingerprint"] and printed.where("fingerprint = 'mine'").count() == 0
    scored = toxicity.score(docs, None, keep=keep)
    assert scored.columns[-3:] == ["score", "windows", "gap"] and len(set(scored.columns)) == len(scored.columns) and scored.where("body = 'mine' and score = 0").count() == 3
    found = language.identify(docs, *language.fit(docs, F.lit(True)), keep=keep)
    assert len(set(found.columns)) == len(found.columns) and found.where("body = 'mine' and lang_pred = 'en'").count() == 2


def brute_rates(rows: list[tuple[str, str, float]]) -> dict:
    """Rates of hosts and paths and every row's score, from the formulas; rows: host, path, probability of the evidence."""
    def strength(groups):  # (good, n, prior)
        if len(groups) < 2:
            return quality.STRONGEST
        n = sum(g[1] for g in groups)
        spread = sum(g[1] * (g[0] / g[1] - g[2]) ** 2 for g in groups) - sum(g[2] * (1 - g[2]) for g in groups)
        scale = sum(g[1] * g[2] * (1 - g[2]) for g in groups) / n
        return min(max(scale / (spread / n) - 1, quality.WEAKEST), quality.STRONGEST) if spread > 0 else quality.STRONGEST

    whole = sum(p for *_, p in rows) / len(rows)
    hosts, paths = {}, {}
    for h, q, p in rows:
        for held, key in ((hosts, h), (paths, (h, q))):
            a, b = held.get(key, (0.0, 0))
            held[key] = (a + p, b + 1)
    of_hosts = strength([(a, n, whole) for a, n in hosts.values()])
    prior = {h: (a + of_hosts * whole) / (n + of_hosts) for h, (a, n) in hosts.items()}
    of_paths = strength([(a, n, prior[h]) for (h, _), (a, n) in paths.items()])
    out = []
    for h, q, p in rows:
        host = (hosts[h][0] - p + of_hosts * whole) / (hosts[h][1] - 1 + of_hosts)
        path = (paths[h, q][0] - p + of_paths * host) / (paths[h, q][1] - 1 + of_paths)
        out.append((host, path))
    return out


def test_quality_rates_by_hand(spark):
    """Sparse sites shrink toward the global rate, a row's own part is left out, and the prior turns doubtful rows."""
    model = quality.fit([(prose(i, 60), 1) for i in range(60)] + [("BUY NOW!! " * 30, 0), ("x x x x x x " * 20, 0)] * 30)
    good, bad = prose(7, 50), "BUY NOW!! " * 20

    mixed = [" ".join([*prose(k, 40).split()[m:], *["BUY NOW!!"] * m]) for k in range(20) for m in range(1, 30)]
    doubtful = min(mixed, key=lambda t: abs(plain(model, t)[0]))
    assert abs(plain(model, doubtful)[0]) < 0.5
    texts = [(good, "fine", "a")] * 60 + [(bad, "poor", "b")] * 60 + [(doubtful, "fine", "a"), (doubtful, "poor", "b"), (doubtful, "alone", "c")] + [(good, "poor", "z"), (bad, "fine", "z")]
    df = table(spark, [(k, t, path, host) for k, (t, host, path) in enumerate(texts)])
    found = quality.classify(df, model, "source", "lang").orderBy("doc_id").collect()
    evidence = [plain(model, t) for t, *_ in texts]
    rates = brute_rates([(h, q, round(p, 9)) for (_, h, q), (_, p) in zip(texts, evidence)])
    for r, (e, _), (host, path) in zip(found, evidence, rates):
        path = min(max(path, 1e-6), 1 - 1e-6)
        assert r["evidence"] == pytest.approx(e) and r["host_rate"] == pytest.approx(host, abs=1e-7) and r["path_rate"] == pytest.approx(path, abs=1e-7)
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-(e + math.log(path / (1 - path))))), abs=1e-6)
    doubt = {r["host"]: r["score"] for r in found if r["doc_id"] in (120, 121, 122)}
    assert doubt["fine"] > 0.9 and doubt["poor"] < 0.1  # the same text, decided by its site
    whole = sum(p for _, p in evidence) / len(evidence)
    alone = next(r for r in found if r["host"] == "alone")
    assert alone["path_rate"] == pytest.approx(whole, abs=1e-6)  # nothing else is known of that site


def plain(model, text: str) -> tuple[float, float]:
    """Evidence of a text and its probability under the overall share of good texts."""
    e = float(np.clip(((np.array(quality.features(text)) - model["centre"]) / model["width"]) @ model["weights"] - model["prior"], -12, 12))
    return e, 1 / (1 + math.exp(-(e + model["prior"])))


def likeness(a: str, b: str) -> float:
    """2 ab / (aa + bb) over exact counts of the windows of each line."""
    def counts(text):
        c = Counter()
        for line in text.encode().split(b"\n") if text else []:
            line = line.ljust(fingerprint.WINDOW, b"\n")
            c.update(line[k : k + fingerprint.WINDOW] for k in range(len(line) - fingerprint.WINDOW + 1))
        return c

    x, y = counts(a), counts(b)
    whole = sum(v * v for v in x.values()) + sum(v * v for v in y.values())
    return 1.0 if a == b else 2 * sum(v * y[w] for w, v in x.items()) / whole if whole else 0.0


def test_likeness_is_near_exact_window_counts(spark):
    """The signed lanes estimate the likeness over exact counts; with 256 lanes the error is a few hundredths."""
    texts = [prose(k, 400) for k in range(20)] + [prose(3, 300) + "\n" + prose(40, 100), "z" * 1_000_000, "z" * 900_000 + "y" * 100_000, "", None, "short", prose(5, 400)]
    texts = [(i, t) for i, t in enumerate(texts)]
    plain_texts = [t or "" for _, t in texts]
    errors = []
    for r in fingerprint.compare_with_edit(table(spark, texts)).collect():
        own, following = plain_texts[r["doc_id"]], plain_texts[(r["doc_id"] + 1) % len(texts)]
        edit = fingerprint.edited(own, following)
        errors += [r["near_edited"] - likeness(own, edit), r["near_next"] - likeness(own, following)]
        if own == edit:
            assert r["near_edited"] == 1.0
    assert np.abs(errors).max() < 0.2 and np.sqrt(np.mean(np.square(errors))) < 0.06


def test_fingerprint_ids_are_numbers(spark):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        fingerprint.compare_with_edit(spark.createDataFrame([("a", "text")], "doc_id string, text string")).collect()


def covered(spark, texts, **how):
    """Pieces, after a check that each id of each document lies in exactly one and that no place is taken twice."""
    tokenizer = Tokenizer.from_file(WORDS)
    ids = {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for d, t, *_ in texts}
    rows = packing.pack(table(spark, texts), WORDS, **how).collect()
    places, seen = Counter(), {d: [0] * len(x) for d, x in ids.items()}
    for r in rows:
        assert r["doc_tokens"] == len(ids[r["doc_id"]])
        for k in range(r["length"]):
            seen[r["doc_id"]][r["start"] + k] += 1
            places[r["sequence_id"], r["offset"] + k] += 1
    assert all(n == 1 for counts in seen.values() for n in counts) and max(places.values()) == 1
    return rows, sum(map(len, ids.values()))


def test_packing_covers_every_id_once_and_meets_weights(spark):
    rng = random.Random(8)
    texts = [(k, prose(k, rng.randrange(1, 120)) if k % 17 else None, "en", f"s{k % 3}") for k in range(240)]
    rows, total = covered(spark, texts, length=64, window=1024, weights={"s0": 0.5, "s1": 0.3, "s2": 0.2})
    left = Counter()
    for r in rows:
        left[r["source"]] += r["length"]
    full = min(left[s] / w for s, w in (("s0", 0.5), ("s1", 0.3), ("s2", 0.2))) // 1024  # windows until the first queue ends
    for w in range(int(full)):
        got = Counter()
        for r in rows:
            at = r["sequence_id"] * 64 + r["offset"]
            got[r["source"]] += max(0, min(at + r["length"], (w + 1) * 1024) - max(at, w * 1024))
        assert all(abs(got[s] - 1024 * share) < 2 for s, share in (("s0", 0.5), ("s1", 0.3), ("s2", 0.2)))
    assert full >= 3 and total == sum(left.values())


def test_packing_with_many_sources(spark):
    """Hundreds of sources below two tokens a window share a queue; larger ones have their own."""
    texts = [(k, prose(k, 2), "en", f"tiny{k}") for k in range(300)] + [(1000 + k, prose(k, 150), "en", f"large{k % 3}") for k in range(60)]
    covered(spark, texts, length=64, window=256)
    covered(spark, texts, length=64, window=256, weights={"large0": 0.7, "large1": 0.3})
    names = [f"x{k}" for k in range(5000)]  # no bound on sources with a share of their own
    number, totals, _ = packing.queues({n: 100 for n in names}, None, packing.WINDOW)
    assert len(set(number.values())) == 5000 and totals == [100] * 5000


def test_packing_refuses_other_tokenizers(spark):
    with pytest.raises(ValueError, match="tokenizer must"):
        packing.pack(spark.createDataFrame([], SCHEMA), P.path("byte_bpe_50k.json"))


def test_texts_of_marks_have_no_letters(spark):
    df = table(spark, [(i, prose(i, 30), "en") for i in range(20)])
    names, prototypes = language.fit(df, F.lit(True))
    texts = [(1, "\u0301"), (2, "12 \u0903"), (3, "e\u0301"), (4, "\u4e2d"), (5, "!"), (6, None)]
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(table(spark, texts), names, prototypes).collect()}
    assert [got[k] for k in range(1, 7)] == ["und", "und", "en", "en", "und", "und"]
