"""Repeated byte strings against a count of every string."""

import random
from collections import Counter

import numpy as np
import pytest

from gridspark.llm import suffix_dedup as sd
from tests.llm.helpers import awkward, prose

SCHEMA = "doc_id long, text string, kept string, mark long, start long, row int, n_spans string, of string, its int"


def by_hand(texts: list[bytes], least: int) -> list[tuple[bytes, list[tuple[int, int]]]]:
    n = Counter(t[i : i + least] for t in texts for i in range(len(t) - least + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - least + 1):
            if n[t[i : i + least]] > 1:
                gone[i : i + least] = True
        edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(int), [0]))))
        out.append((bytes(np.frombuffer(t, np.uint8)[~gone]), [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2])]))
    return out


def check(spark, rows: list[tuple], least: int, gram: int, parts: int = 5) -> None:
    frame = spark.createDataFrame([(d, t, "a", 1, 2, 3, "b", "c", 4) for d, t in rows], SCHEMA).repartition(parts)
    found = sd.suffix_dedup(frame, least=least, gram=gram)
    assert found.columns == ["doc_id", "mark", "start", "row", "of", "its", "kept", "n_bytes", "n_removed", "n_spans", "spans"]
    got = sorted((str(r["doc_id"]), r["n_bytes"], bytes(r["kept"]), [tuple(s) for s in r["spans"]], r["n_removed"], r["n_spans"]) for r in found.collect())
    texts = [(t or "").encode() for _, t in rows]
    want = sorted((str(d), len(t), left, spans, sum(b - a for a, b in spans), len(spans)) for (d, _), t, (left, spans) in zip(rows, texts, by_hand(texts, least)))
    assert got == want


@pytest.mark.parametrize("seed, least, gram", [(1, 12, 5), (2, 9, 9), (3, 20, 1), (4, 16, 12)])
def test_equals_a_count_of_every_string(spark, monkeypatch, seed, least, gram):
    """Few letters, so that strings recur at all offsets, within texts too; many small buckets have many edges."""
    monkeypatch.setattr(sd, "BUCKET", 60)
    rng = random.Random(seed)
    blocks = ["".join(rng.choice("abé ") for _ in range(rng.choice([3, 8, 30]))) for _ in range(30)]
    rows = [(k, "".join(rng.choice(blocks) for _ in range(rng.randrange(0, 12)))) for k in range(60)]
    check(spark, rows + [(60, "ab" * 300), (61, "b" * 50), (62, "x" * (least - 1)), (63, "q" * least)], least, gram)


def test_awkward_rows(spark):
    hot = prose(77, 120)
    rows = [(r[0], r[1]) for r in awkward()] + [(1000 + k, hot) for k in range(300)] + [(5000 + k, prose(500 + k, 30) + " " + hot[40:500] + prose(900 + k, 3)) for k in range(40)]
    check(spark, rows, 200, 100, 9)


def test_pieces_of_a_long_text(spark, monkeypatch):
    """A text of several pieces repeats one of its stretches across their edges."""
    some = prose(3, 30_000)
    text = some + prose(4, 40) + some[100_000:160_000]
    assert len(text) > 1 << sd.BLOCK_BITS
    check(spark, [(1, text), (2, prose(5, 100)), (3, some[20_000:20_300])], 200, 100)


def test_quicksort_orders_by_all_tokens():
    rng = np.random.default_rng(2)
    for n, most in ((0, 3), (1, 3), (5000, 4), (20_000, 1 << 40), (9000, 1)):
        tokens = [rng.integers(0, most, n), rng.integers(0, most, n)]
        order = sd.multikey_quicksort(tokens)
        rows = np.stack([t[order] for t in tokens], 1).tolist()
        assert rows == sorted(rows) and sorted(order.tolist()) == list(range(n))


def test_no_rows(spark):
    assert sd.suffix_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        sd.suffix_dedup(spark.createDataFrame([], SCHEMA), least=10, gram=11)
