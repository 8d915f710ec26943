"""Line dedup against a search over all pairs of documents."""

import random
import re

import numpy as np
import pytest

from gridspark.llm import line_dedup
from tests.llm.helpers import prose, table


def count(line: str) -> int:
    return len(re.findall(r"[^ \t\n\x0b\f\r]+", line))


def rest_of(texts: list[str], least: int = 10) -> list[str]:
    """Each text without the lines that lie in a run of enough words which some earlier text has too; all runs of all pairs."""
    lines = [[x.strip(" ") for x in t.split("\n")] for t in texts]
    out = []
    for d, text in enumerate(texts):
        mine, gone = lines[d], set()
        for e in range(d):
            other = lines[e]
            for i in range(len(mine)):
                for j in range(len(other)):
                    n = 0
                    while i + n < len(mine) and j + n < len(other) and mine[i + n] == other[j + n]:
                        n += 1
                    if sum(map(count, mine[i : i + n])) >= least:
                        gone.update(range(i, i + n))
        out.append("\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone) if gone else text)
    return out


def dedup(spark, texts: list[str]) -> list[str]:
    got = {r["doc_id"]: r for r in line_dedup.line_dedup(table(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        assert got[i]["n_lines"] == t.count("\n") + 1
        assert got[i]["n_lines"] - got[i]["n_deleted"] == (got[i]["text"].count("\n") + 1 if got[i]["text"] or got[i]["n_deleted"] == 0 else 0) or got[i]["text"] == ""
    return [got[i]["text"] for i in range(len(texts))]


@pytest.mark.parametrize("seed", range(4))
def test_equals_a_search_over_all_pairs(spark, seed):
    """Few different lines, so that they come moved, repeated, cut short and with up to a hundred holders."""
    rng = random.Random(seed)
    kinds = ["", "one", "two words", "a line of five words", "six words are in this line", " six words are in this line ", "this line alone has ten words and two more words"]
    kinds += [prose(900 + k, rng.choice([3, 4, 11])) for k in range(rng.choice([2, 40]))]
    texts = ["\n".join(rng.choice(kinds) for _ in range(rng.randrange(1, 9))) for _ in range(100)]
    assert dedup(spark, texts) == rest_of(texts)


@pytest.mark.parametrize("holders", [3, 40, 49, 60])
def test_runs_of_lines_with_other_first_holders(spark, holders):
    """One passage of two lines of six words, which two documents before had one each."""
    one, two = "the first line has six words", "the second line has six too"
    texts = [prose(1, 9) + "\n" + one, prose(2, 9) + "\n" + two] + [prose(10 + i, 9) + "\n" + one + "\n" + two + "\n" + prose(200 + i, 8) for i in range(holders)]
    got = dedup(spark, texts)
    assert got == rest_of(texts)
    assert got[:3] == texts[:3] and all(one not in t for t in got[3:])


@pytest.mark.parametrize("holders", [40, 60])
def test_one_rule_for_words(spark, holders):
    """Words joined by no-break spaces are one word, however many documents hold the line."""
    line = "\u00a0".join(["word"] * 12)
    texts = [prose(i, 5) + "\n" + line for i in range(holders)]
    assert dedup(spark, texts) == texts == rest_of(texts)


def test_moved_and_repeated_blocks(spark):
    p, q = prose(1, 12), prose(2, 14)
    texts = [p + "\n" + q, q + "\nown words\n" + p + "\n" + p]
    assert dedup(spark, texts) == rest_of(texts) == [texts[0], "own words"]


def test_stretches_cover_runs():
    rng = np.random.default_rng(1)
    for _ in range(50):
        words = rng.integers(0, 8, 12)
        hashes = rng.integers(0, 3, 12)
        first, last, _ = line_dedup.stretches(hashes, words, 10)
        for i in range(12):
            for j in range(i + 1, 13):
                if words[i:j].sum() >= 10:
                    inside = (first >= i) & (last <= j)
                    assert set(range(i, j)) == {k for x, y in zip(first[inside], last[inside]) for k in range(x, y)}
    assert [len(x) for x in line_dedup.stretches(np.zeros(0, np.int64), np.zeros(0, np.int64))] == [0, 0, 0]


def test_every_deletion_comes_from_an_alignment(monkeypatch):
    """Without patience diff nothing is deleted; with it, all that a search over runs finds."""
    rng = random.Random(4)
    kinds = [prose(k, rng.choice([3, 4, 6, 11])) for k in range(9)]
    texts = ["\n".join(rng.choice(kinds) for _ in range(12)) for _ in range(40)]
    lines = [t.split("\n") for t in texts]
    of = lambda own: (np.array([hash(x) for x in own]), np.array([count(x) for x in own]))
    pairs = [(a, b) for a in range(40) for b in range(a + 1, 40)]
    found = {(a, b): line_dedup.common_lines(*of(lines[a]), *of(lines[b])) for a, b in pairs}
    for (a, b), gone in found.items():
        left = "\n".join(x for k, x in enumerate(lines[b]) if k not in gone)
        assert left == (rest_of([texts[a], texts[b]])[1])
    assert sum(map(bool, found.values())) > 300
    monkeypatch.setattr(line_dedup, "matches", lambda a, b: [])
    assert not any(line_dedup.common_lines(*of(lines[a]), *of(lines[b])) for a, b in pairs)
    moved = [0, 1, 2, 3, 4, 5], [3, 4, 5, 0, 1, 2]
    monkeypatch.undo()
    words = np.full(6, 5)
    assert line_dedup.common_lines(np.array(moved[0]), words, np.array(moved[1]), words) == [0, 1, 2, 3, 4, 5]
    assert len(line_dedup.blocks(line_dedup.matches(*moved), words.tolist())) == 3  # one alignment alone takes in half of it


def test_reversed_and_repeated_lines_end_soon():
    a = np.arange(800)
    words = np.full(800, 12)
    assert line_dedup.common_lines(a, words, a[::-1].copy(), words) == list(range(800))
    again = np.tile(a[:20], 200)
    assert line_dedup.common_lines(a, words, again, np.full(4000, 12)) == list(range(4000))
