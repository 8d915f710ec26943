"""The pipeline's stages on a small table with planted cases."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from gridspark.llm import near_copies  # noqa: E402
from tests.llm.helpers import awkward, prose, table  # noqa: E402


def test_stages_keep_columns_and_clean_documents(spark, tmp_path):
    toxic = " scum moron idiot "
    texts = [(i, prose(i, 120) + (toxic + prose(i + 300, 60) if i % 4 == 1 else "")) for i in range(160)]
    spark.createDataFrame([(i, 1, int(i % 4 == 1)) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    copies = [(1000, prose(2, 120)), (1001, prose(2, 120))]
    odd = [(3000 + k, r[1], *r[2:]) if r[0] is not None else r for k, r in enumerate(awkward())]
    table(spark, texts + copies + odd).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == list(corpus_pipeline.COLUMNS)
            docs.write.parquet(str(tmp_path / name))
            docs = spark.read.parquet(str(tmp_path / name))
        kept.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    clean = {i for i in range(160) if i % 4 != 1}
    assert all(clean <= ids for ids in kept)
    assert len({i for i in range(160) if i % 4 == 1} & kept[0]) <= 4
    assert not {1000, 1001} & kept[-1]
    assert 3009 not in kept[1]  # digits and marks alone
    assert docs.where("doc_id = 2").agg({"length": "sum"}).first()[0] > 120


def edit(text: str, n: int) -> str:
    """text with n words replaced, far from each other."""
    words = text.split()
    for k in range(n):
        words[(k + 1) * len(words) // (n + 1)] = f"edited{k}x{n}"
    return " ".join(words)


def test_near_dedup_links_edited_copies(spark):
    texts = [(i, prose(i, 120)) for i in range(12)]
    texts += [(100 * n + i, edit(prose(i, 120), n)) for n in (1, 2, 4, 8) for i in range(12)]
    sets = {i: set(zip(*(t.split()[k:] for k in range(5)))) for i, t in texts}
    name = {i: i for i in sets}  # brute force over all pairs
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and name[a] != name[b]:
                low, high = sorted((name[a], name[b]))
                name = {i: low if x == high else x for i, x in name.items()}
    expected = {i for i in sets if name[i] == i}
    assert 12 < len(expected) < 60 and not {100 + i for i in range(12)} & expected
    docs = table(spark, texts).select(*corpus_pipeline.COLUMNS)
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()} == expected
    groups = {}
    for r in near_copies.near_copies(docs).collect():
        groups.setdefault(r["component"], set()).add(r["doc_id"])
    assert sorted(map(sorted, groups.values())) == sorted(sorted(i for i in sets if name[i] == low) for low in expected)


def test_near_dedup_drops_rows_of_the_same_group_only(spark):
    a, b, c, d, e, f = (prose(i, 60) for i in range(6))
    texts = [(None, a), (None, b), (None, b), (None, edit(c, 1)), (3, c), (4, d), (4, e), (5, f), (5, c), (6, e)]
    left = corpus_pipeline.drop_near_copies(spark, table(spark, texts).select(*corpus_pipeline.COLUMNS), "")
    expected = [(None, a), (None, b), (3, c), (4, d), (4, e), (5, f)]
    assert sorted((str(r["doc_id"]), r["text"]) for r in left.collect()) == sorted((str(i), t) for i, t in expected)
    once = [(3, c), (5, f), (5, c)]  # no kept id comes more than once
    left = corpus_pipeline.drop_near_copies(spark, table(spark, once).select(*corpus_pipeline.COLUMNS), "")
    assert sorted((r["doc_id"], r["text"]) for r in left.collect()) == [(3, c), (5, f)]


def test_near_copies_of_large_groups_and_chains(spark):
    """Groups of many different near copies, and chains whose ends are unlike, against all pairs."""
    texts, base = [], [prose(50 + g, 80) for g in range(4)]
    for g in range(4):
        for k in range(40):
            words = base[g].split()
            words[(k * 7) % 80] = f"own{k}"
            texts.append((1000 * g + k, " ".join(words)))
    words = prose(99, 100).split()
    for k in range(30):  # a chain: each text drops two words at the front and gets two at the end
        texts.append((9000 + k, " ".join(words[2 * k :] + [f"end{i}" for i in range(2 * k)])))
    texts.append((9999, None))
    sets = {i: set(zip(*((t or "").split()[k:] for k in range(5)))) for i, t in texts}
    name = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and name[a] != name[b]:
                low, high = sorted((name[a], name[b]))
                name = {i: low if x == high else x for i, x in name.items()}
    groups = {}
    for r in near_copies.near_copies(table(spark, texts)).collect():
        groups.setdefault(r["component"], set()).add(r["doc_id"])
    assert sorted(map(sorted, groups.values())) == sorted(sorted(i for i in sets if name[i] == low) for low in set(name.values()))
    assert len({name[9000 + k] for k in range(30)}) == 1


def test_texts_of_unknown_scripts_go(spark):
    """Known languages stay, however short; of texts in scripts that no training text has, few reach the threshold."""
    import random

    rng = random.Random(4)
    known = [(i, prose(i, 60), "en") for i in range(60)] + [(100 + i, " ".join(f"über{i}ung straße nicht schön".split()[: 1 + i % 4]) + " weißt größe " * 9, "de") for i in range(60)]
    scripts = [("\u0430", 30), ("\u03b1", 24), ("\u05d0", 26), ("\u0e01", 40), ("\u4e00", 60), ("\uac00", 60)]
    other = [(1000 + k, " ".join("".join(chr(ord(a) + rng.randrange(n)) for _ in range(rng.randrange(2, 8))) for _ in range(150)), None) for k, (a, n) in enumerate(scripts * 10)]
    left = {r["doc_id"] for r in corpus_pipeline.keep_known_languages(spark, table(spark, known + other).select(*corpus_pipeline.COLUMNS), "").collect()}
    assert {i for i, *_ in known} <= left and len({i for i, *_ in other} & left) <= 6


def test_sketches_bound_the_difference():
    """Sketches differ in no more bits than the sets in shingles, and in as many where the sets are small."""
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (0, 1, 20, 300, 5000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        for changed in (0, 1, n // 10, n):
            b = np.unique(np.concatenate((a[changed:], rng.integers(0, 1 << 63, changed, dtype=np.uint64))))
            bits = int(np.bitwise_count((near_copies.sketch(a) ^ near_copies.sketch(b)).view(np.uint64)).sum())
            assert bits <= len(np.setxor1d(a, b)) and (n > 20 or bits >= len(np.setxor1d(a, b)) - 6)
