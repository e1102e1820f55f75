"""Ripley's metrics of many specimens: each does in one group what larger ones do by joins, and simulations are compared as far as they are unsure."""

import math

import numpy as np
import pytest

from cytofabric.operators import spatial


def _specimens(spark):
    """Specimens of about 60, 200 and 700 cells; one without an area, one with a single cell of its label, one without a label."""
    rng = np.random.default_rng(8)
    rows = []
    for s, n in ((1, 60), (2, 200), (3, 700)):
        rows += [(s, int(x), int(y), int(k)) for (x, y), k in zip(rng.integers(0, 900, (n, 2)), rng.integers(1, 4, n), strict=True)]
    rows += [(4, i, i, 1) for i in range(9)] + [(5, 0, 0, 1), (5, 50, 0, 2), (5, 0, 50, 2), (5, 50, 50, 2)] + [(6, i % 7, i % 5, None) for i in range(30)]
    return spark.createDataFrame([(s, i, x, y, k) for i, (s, x, y, k) in enumerate(rows)], "specimen long, structure long, x int, y int, label int").repartition(3)


def _joined(*args, **kwargs):
    raise AssertionError("joined")


def _patterns(seed=3):
    """(cells, turned patterns of 1000 points of their hull, area): random, few, crowded and along a line."""
    rng = np.random.default_rng(seed)
    t = rng.random(500)
    for at in (rng.random((1000, 2)) * 1000, rng.integers(0, 1000, (120, 2)).astype(float), np.vstack([rng.normal(500, 10, (400, 2)), rng.random((60, 2)) * 1000]), np.stack([t * 1000, t * 1000 + rng.random(500) * 3], 1)):
        hull = spatial._hull(at)
        yield at, hull, [spatial._uniform(hull, 1000, [0, 5, t + 1]) for t in range(12)], spatial._area(hull)


def test_ripley_f_of_small_specimens_needs_no_join(spark, monkeypatch):
    df = _specimens(spark)
    with monkeypatch.context() as m:
        m.setattr(spatial, "SHARE", 100)  # two of the specimens are large
        want = sorted(spatial.ripley_f(df, simulations=9, points=150).collect())
    monkeypatch.setattr(spatial, "nearest", _joined)
    got = sorted(spatial.ripley_f(df, simulations=9, points=150).collect())
    assert got == want and [r.radius is None for r in got] == [False, False, False, True, True, True]


def test_f_of_simulations_is_compared_as_far_as_it_is_unsure(monkeypatch):
    """As from the distances of all points, of which few are compared with a whole pattern where the cells are few."""
    plain, met = spatial._squares_between, []
    monkeypatch.setattr(spatial, "_squares_between", lambda a, b: met.append(len(a) * len(b)) or plain(a, b))
    for at, hull, patterns, area in _patterns():
        edges, asked = np.linspace(0, math.sqrt(area / 2) / 4, 100), spatial._uniform(hull, 1000, [0, 5])
        far = lambda a, b, k: np.sort(np.sqrt(((a[:, None] - b[None]) ** 2).sum(2)), axis=1)[:, :k].ravel()
        own = spatial._f_curve(far(asked, at, 2), edges)
        want = sum((spatial._f_curve(far(asked, p, 1), edges) < own).astype(int) for p in patterns)
        met.clear()
        assert (spatial._lower("F", 5, hull, area, asked, len(at), own, range(12), 1000, 0) == want).all()
        assert len(at) != 120 or sum(met) < 0.01 * 12 * 1000 * 1000


def test_corners_of_a_hull_are_those_of_all_points(monkeypatch):
    rng = np.random.default_rng(4)
    shapes = (rng.integers(0, 30, (500, 2)), rng.random((500, 2)), np.stack([np.arange(200), np.arange(200)], 1), rng.normal(0, 1, (300, 2)) * [1e6, 1e-3], np.stack([np.cos(np.arange(300)), np.sin(np.arange(300))], 1))
    got = [spatial._hull(p.astype(float)) for p in shapes]
    monkeypatch.setattr(spatial, "_inside", lambda p: np.zeros(len(p), bool))
    assert all(np.array_equal(g, spatial._hull(p.astype(float))) for g, p in zip(got, shapes, strict=True))


@pytest.mark.parametrize("mode", ["G", "L"])
def test_ripley_curves_of_small_specimens_need_no_join(spark, monkeypatch, mode):
    df = _specimens(spark)
    for label in (None, 2):
        rows = lambda: {(r.specimen, r.at): (r.distance, r.observed, r.p) for r in spatial.ripley_gl(df, mode, label, simulations=9, points=150).collect()}
        with monkeypatch.context() as m:
            m.setattr(spatial, "SHARE", 100)
            want = rows()
        with monkeypatch.context() as m:
            m.setattr(spatial, "nearest", _joined)
            m.setattr(spatial, "pair_distance_counts", _joined)
            got = rows()
        assert got.keys() == want.keys() and {s for s, _ in got} == ({1, 2, 3, 5} if (mode, label) == ("G", 2) or (mode, label) == ("L", 2) else {1, 2, 3})
        for k, (distance, observed, p) in want.items():
            assert got[k][0] == pytest.approx(distance, abs=1e-9) and got[k][1] == (observed if observed is None else pytest.approx(observed, abs=1e-12)) and got[k][2] == pytest.approx(p, abs=1e-12)


def test_g_of_simulations_is_compared_as_far_as_it_is_unsure(monkeypatch):
    plain, met = spatial._squares_between, []
    monkeypatch.setattr(spatial, "_squares_between", lambda a, b: met.append(len(a) * len(b)) or plain(a, b))
    for at, hull, patterns, area in _patterns():
        edges = np.linspace(0, math.sqrt(area / 2) / 4, 100)
        far = lambda a, b, k: np.sort(np.sqrt(((a[:, None] - b[None]) ** 2).sum(2)), axis=1)[:, :k].ravel()
        own = spatial._f_curve(far(at[::2], at[1::2], 2), edges)
        want = sum((spatial._f_curve(far(at, p, 1), edges) < own).astype(int) for p in patterns)
        met.clear()
        assert (spatial._lower("G", 5, hull, area, at, len(at), own, range(12), 1000, 0) == want).all()
        assert len(at) != 120 or sum(met) < 0.01 * 12 * 120 * 1000


def test_l_of_simulations_is_compared_as_far_as_it_is_unsure(monkeypatch):
    """As from all pairs, of which few are met where the cells are few."""
    plain, met = spatial._squares_between, []
    monkeypatch.setattr(spatial, "_squares_between", lambda a, b: met.append(len(a) * len(b)) or plain(a, b))
    for at, hull, patterns, area in _patterns():
        reach = math.sqrt(area / 2) / 4
        level = lambda p, n=len(at), a=area, r=reach: spatial._levels(np.concatenate([[0], np.cumsum(spatial._pairs_by_distance(p, r, 99))]), n, a)
        own = level(at)
        for few in (own, own / 9):
            want = sum((level(p) < few).astype(int) for p in patterns)
            met.clear()
            assert (spatial._lower("L", 5, hull, area, at[:0], len(at), few, range(12), 1000, 0) == want).all()
            assert len(at) != 120 or sum(met) < 0.01 * 12 * 1000 * 1000
