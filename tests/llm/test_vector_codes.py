"""Vector codes against plain loops over all entries."""

import math
import random

import numpy as np
import pytest

from gridspark.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, codes string, row int, v string"


def by_hand(rows: list[tuple], parts: int, entries: int, rounds: int):
    """{(id, vector): (codes, error)} and the codebooks, by integer loops."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return {}, [[] for _ in range(parts)]
    width = len(kept[0][1]) // parts
    books = [[v[p * width : (p + 1) * width] for _, v in kept[:entries]] for p in range(parts)]
    for k in range(rounds + 1):
        out = {}
        members = [[[] for _ in books[0]] for _ in books]
        for i, v in kept:
            codes, error = [], 0
            for p, book in enumerate(books):
                x = v[p * width : (p + 1) * width]
                d, j = min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(book))
                codes.append(j)
                error += d
                members[p][j].append(x)
            out[i, tuple(v)] = codes, error
        if k == rounds:
            return out, books
        books = [[[math.floor(sum(c) / len(c)) for c in zip(*members[p][j])] if members[p][j] else e for j, e in enumerate(book)] for p, book in enumerate(books)]


def random_rows(seed: int, n: int, spread: float) -> list[tuple]:
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, spread) for _ in range(8)], rng.randrange(3), "x", 1, "y") for i in range(n)]
    rows = [(i, np.float32(v).tolist(), *rest) for i, v, *rest in rows]
    return rows + [(None, rows[0][1], None, None, None, None), (3, rows[4][1], 1, "x", 1, "y"), rows[2], rows[2], (n, None, 1, "x", 1, "y"), (n + 1, [None] + rows[1][1][1:], 1, "x", 1, "y"), (n + 2, [math.nan] + rows[1][1][1:], 1, "x", 1, "y"), (n + 3, [-math.inf] + rows[1][1][1:], 1, "x", 1, "y")]


@pytest.mark.parametrize("n, entries, spread", [(150, 20, 1.0), (90, 70, 0.002), (5, 16, 0.3)])
def test_equals_plain_loops(spark, n, entries, spread):
    """A small spread makes ties and equal entries; five rows are fewer than entries."""
    rows = random_rows(n, n, spread)
    found, books = vector_codes.compress(spark.createDataFrame(rows, SCHEMA).repartition(5), "vec_id", "embedding", 2, entries, 3, carry=("label", "row", "v"))
    expected, their = by_hand(rows, 2, entries, 3)
    assert [b.tolist() for b in books] == their
    of = {(i, tuple(math.floor(1024 * x) for x in v)): 0 for i, v, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    assert set(of) == set(expected)
    got = sorted((str(r["vec_id"]), r["codes"], r["error"]) for r in found.collect())
    want = [(str(i), *expected[i, tuple(math.floor(1024 * x) for x in v)]) for i, v, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    assert got == sorted(want)
    assert found.columns == ["vec_id", "label", "row", "v", "codes", "error"]


def test_search_visits_less_and_finds_the_same():
    rng = np.random.default_rng(0)
    book = rng.integers(-500, 500, (256, 2))
    x = rng.integers(-500, 500, (2000, 2))
    order, gaps = vector_codes.neighbours(book)
    plain = ((x[:, None] - book[None]) ** 2).sum(-1)
    for start in (np.zeros(2000, np.int64), plain.argmin(1), rng.integers(0, 256, 2000)):
        entry, d = vector_codes.nearest(x, start, book, order, gaps)
        assert (entry == plain.argmin(1)).all() and (d == plain.min(1)).all()


def test_no_rows_and_refused_shapes(spark):
    found, books = vector_codes.compress(spark.createDataFrame([], SCHEMA), "vec_id", "embedding", carry=("label",))
    assert found.count() == 0 and found.columns == ["vec_id", "label", "codes", "error"] and vector_codes.listed(books) == ""
    for bad in ([(1, [1.0, 2.0]), (2, [1.0])], [(1, [1.0, 2.0, 3.0])], [(1, [1e30, 1.0, 1.0, 1.0])]):
        with pytest.raises(ValueError):
            vector_codes.compress(spark.createDataFrame(bad, "vec_id long, embedding array<double>"), "vec_id", "embedding")
