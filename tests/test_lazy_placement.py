"""Lazy greedy placement: the picks of the exhaustive one, bounds that hold, and the cases without rows."""

import numpy as np
import pytest

from gridspark.plans import lazy_placement, placement


def field(spark, rng, side=20, dates=2, most=8):
    cells = spark.createDataFrame([(k, k // side / side, k % side / side) for k in range(side * side)], "cell_id int, x1 double, x2 double")
    sizes = [1 + int(rng.integers(0, most)) for _ in range(dates)]
    context = spark.createDataFrame([(d, float(a), float(b)) for d in range(dates) for a, b in rng.random((sizes[d], 2))] + [(99, None, None)], "date int, x1 double, x2 double")
    return context, cells


def test_the_picks_are_those_of_scoring_all(spark, monkeypatch):
    context, cells = field(spark, np.random.default_rng(5))
    monkeypatch.setattr(lazy_placement, "PART", 130)  # several parts a date, of several blocks each
    monkeypatch.setattr(lazy_placement, "BLOCK", 50)
    monkeypatch.setattr(lazy_placement, "FIRST", 16)
    lazy, report = lazy_placement.lazy_greedy(context, cells, cells, 3, 0.1)
    plain = placement.greedy(context, cells, cells, 3, 0.1)[0]
    lazy, plain = lazy.orderBy("iteration").collect(), plain.orderBy("iteration").collect()
    assert [r["cell_id"] for r in lazy] == [r["cell_id"] for r in plain]
    assert [r["score"] for r in lazy] == pytest.approx([r["score"] for r in plain], abs=1e-11)
    scored = [r["scored"] for r in report.orderBy("iteration").collect()]
    assert scored[0] == 400 and max(scored[1:]) < 300


@pytest.mark.parametrize("seed", range(6))
def test_bounds_hold_after_any_picks(seed):
    """No bound of what is left in a tile is over what is left, nor are the other numbers on the wrong side."""
    rng = np.random.default_rng(seed)
    at, place = rng.random((300, 2)), rng.random((80, 2))
    length, noise = float(rng.choice([0.05, 0.2, 0.6])), 1e-2
    plane = lazy_placement._Plane(at, length, noise, 5)

    def entries(points):
        inverse = np.linalg.inv(plane.kernel(points, points) + noise * np.eye(len(points)))
        given = lambda a, b: plane.kernel(a, b) - plane.kernel(a, points) @ inverse @ plane.kernel(points, b)
        var, v = np.diag(given(plane.at, plane.at)), np.diag(given(place, place)) + noise
        p2 = given(plane.at, place) ** 2 / v
        after = np.maximum(var[:, None] - p2, 0)
        tiles = plane.tiled(np.add, np.sqrt(after)), plane.tiled(np.minimum, after), plane.tiled(np.add, p2), plane.tiled(np.maximum, p2)
        return given, var, v, [t.T for t in tiles]

    points = rng.random((6, 2))
    given, var, v, bound = entries(points)
    for pick in (place[3], place[4] + 1e-3, rng.random(2)):
        x = pick[None]
        of = given(x, x)[0, 0] + noise
        q2 = given(plane.at, x)[:, 0] ** 2 / of
        rest = np.maximum(var - q2, 0)
        alpha = np.linalg.solve(plane.kernel(points, points) + noise * np.eye(len(points)), plane.kernel(points, x))[:, 0]
        model = {"known": np.concatenate((points, x)).ravel(), "alpha": alpha, "of": of, "took": plane.tiled(np.add, q2), "most": plane.tiled(np.maximum, q2), "rest": plane.tiled(np.add, np.sqrt(rest)), "least": plane.tiled(np.minimum, rest), "total": plane.tiled(np.add, rest)}
        v, *bound = lazy_placement.bounded_entries(plane, model, place, v, *bound)
        points = np.concatenate((points, x))
        given, var, exact_v, exact = entries(points)
        assert v == pytest.approx(exact_v, abs=1e-9)
        assert (bound[0] <= exact[0] + 1e-9).all() and (bound[1] <= exact[1] + 1e-9).all()
        assert (bound[2] >= exact[2] - 1e-9).all() and (bound[3] >= exact[3] - 1e-9).all()
    assert (bound[0].sum(1) > 0.3 * exact[0].sum(1)).any()


def test_cases_without_rows_and_too_many(spark, monkeypatch):
    context, cells = field(spark, np.random.default_rng(1), side=4)
    none = cells.where("cell_id < 0")
    for c, t, n in ((none, cells, 2), (cells, none, 2), (cells, cells, 0)):
        picks, report = lazy_placement.lazy_greedy(context, c, t, n, 0.3)
        assert picks.isEmpty() and report.isEmpty()
    assert lazy_placement.lazy_greedy(context.where("date < 0"), cells, cells, 2, 0.3)[0].isEmpty()
    odd = cells.where("cell_id < 2").unionByName(cells.where("cell_id < 2")).unionByName(spark.createDataFrame([(None, 0.1, 0.1), (9, None, 0.1)], cells.schema))
    picks, report = lazy_placement.lazy_greedy(context, odd, cells, 5, 0.3)
    assert sorted(r["cell_id"] for r in picks.collect()) == [0, 1]
    monkeypatch.setattr(lazy_placement, "CONTEXT", 1)
    with pytest.raises(Exception, match="context points"):
        lazy_placement.lazy_greedy(context, cells, cells, 1, 0.3)
