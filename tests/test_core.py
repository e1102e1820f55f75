import hashlib
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cytofabric.functions import scalars, statistics
from cytofabric.operators import cohorts, features, gating, graphs, neighbors, populations, sampling, spatial
from cytofabric.plans import api, registry
from cytofabric.sources import ingest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    out = duckdb.connect()
    for t in TABLES:
        out.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return out


def _cell(v):
    if v is None or v != v:
        return "null"
    return f"{v:.6f}" if isinstance(v, (float, np.floating)) else str(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_agrees_with_sql(spark, db, name):
    got, want = registry.queries()[name](spark, SF).toPandas(), db.execute(registry.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    as_rows = lambda d: sorted(tuple(map(_cell, r)) for r in d[columns].astype(object).itertuples(index=False))
    assert as_rows(got) == as_rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_other_queries_run(spark, name):
    """Those without SQL give a row of the kind at least, with no column that is null throughout; what they say is tested below or is random."""
    out = registry.queries()[name](spark, SF).toPandas()
    assert len(out) and not out.isna().all().any()


@pytest.fixture(scope="module")
def cells(spark):
    rng = np.random.default_rng(4)
    rows = [(s, s * 1000 + i, int(x), int(y), int(m)) for s, n in ((1, 60), (2, 9), (3, 1), (4, 3)) for i, (x, y, m) in enumerate(zip(rng.integers(0, 60, n), rng.integers(0, 60, n), rng.integers(0, 8, n), strict=True))]
    rows += [(5, 5000 + i, 7, 7, 1) for i in range(10)]  # all in one place
    return spark.createDataFrame(rows, "specimen long, structure long, x int, y int, mask long"), rows


def _near(rows, k):
    out = set()
    for s, i, x, y, _ in rows:
        ranked = sorted(((x - u) ** 2 + (y - v) ** 2, j) for t, j, u, v, _ in rows if t == s and j != i)[:k]
        out |= {(s, i, j, d, r + 1) for r, (d, j) in enumerate(ranked)}
    return out


def test_nearest_is_brute_force(cells):
    df, rows = cells
    for k in (1, 3, 6):
        assert {tuple(r) for r in neighbors.nearest(df, k).collect()} == _near(rows, k)


def test_radius_pairs_is_brute_force(cells):
    df, rows = cells
    for r in (1, 7.5, 30):
        want = {(s, i, j) for s, i, x, y, _ in rows for t, j, u, v, _ in rows if s == t and (x - u) ** 2 + (y - v) ** 2 <= r * r}
        assert {(p.specimen, p.a, p.b) for p in neighbors.radius_pairs(df, df, r).collect()} == want


def test_proximity_grows_with_the_radius_and_is_null_without_cells(cells):
    df, _ = cells
    out = spatial.proximity(df, {"near": ((1, 0), (2, 0), 5), "far": ((1, 0), (2, 0), 25), "none": ((64, 0), (1, 0), 5)}).collect()
    assert all(r.none is None and (r.near is None or r.near <= r.far) for r in out)


def test_moran_and_enrichment_are_null_where_undefined(cells):
    df, _ = cells
    marked = df.withColumn("label", spatial.labels(F.col("mask"), [(1, 0), (2, 0)]))
    edges = neighbors.stored(spatial.neighbour_edges(marked))
    m = {r.specimen: r for r in spatial.moran(marked, edges).collect()}
    assert m[5].p is None and m[3].p is None and m[1].p is not None
    e = {r.specimen: r for r in spatial.enrichment(marked, edges).collect()}
    assert e[5].enrichment is None and e[3].enrichment is None and 0 <= e[1].enrichment <= 1


def test_enrichment_moments_are_those_of_permutations(spark):
    rng = np.random.default_rng(8)
    xy, lab = rng.integers(0, 100, (40, 2)), rng.integers(0, 2, 40)
    rows = [(1, i, int(x), int(y), int(v)) for i, ((x, y), v) in enumerate(zip(xy, lab, strict=True))]
    df = spark.createDataFrame(rows, "specimen long, structure long, x int, y int, label int")
    edges = neighbors.stored(spatial.neighbour_edges(df, 3))
    r = spatial.enrichment(df, edges, (0, 1)).first()
    ends = np.array([(e.a, e.b) for e in edges.collect()])
    sims = []
    for _ in range(4000):
        p = rng.permutation(lab)
        sims.append(((p[ends[:, 0]] == 0) & (p[ends[:, 1]] == 1)).sum())
    assert r.observed == ((lab[ends[:, 0]] == 0) & (lab[ends[:, 1]] == 1)).sum()
    assert r.z == pytest.approx((r.observed - np.mean(sims)) / np.std(sims), abs=0.15)


def test_batches_of_metrics_are_the_single_ones(spark):
    """Two labels and three, one label only, a specimen of two cells, one without neighbours of a kind."""
    from cytofabric.plans import api

    rng = np.random.default_rng(8)
    rows = [(s, s * 1000 + i, int(x), int(y), int(m)) for s, n, top in ((1, 120, 8), (2, 90, 4), (3, 2, 8), (4, 30, 1)) for i, ((x, y), m) in enumerate(zip(rng.integers(0, 200, (n, 2)), rng.integers(0, top, n), strict=True))]
    df = spark.createDataFrame(rows, "specimen long, structure long, x int, y int, mask long")
    names = ["a", "b", "c"]
    a, b, ac = (["a"], []), (["b"], ["a"]), (["a", "c"], [])
    requests = {"p1": ([a, b], "proximity", 30.0), "p2": ([b, ac], "proximity", 50.0), "o1": ([a, b], "co-occurrence", 40.0), "o2": ([ac, b], "co-occurrence", 40.0), "e1": ([a, b], "enrichment", 0.0), "e2": ([ac, a], "enrichment", 0.0), "m1": ([a], "autocorrelation", 0.0), "m2": ([ac, b], "autocorrelation", 0.0)}
    got = {(r.request, r.specimen): r.value for r in api.batch_spatial_metrics(df, names, requests).collect()}
    assert len(got) == 4 * len(requests)
    for n, (phenotypes, metric, radius) in requests.items():
        for r in api.spatial_metrics(df, names, phenotypes, metric, radius).collect():
            assert got[n, r.specimen] == (None if r.value is None else pytest.approx(r.value, abs=1e-9)), (n, r.specimen)
    assert sum(v is None for v in got.values()) > 4
    zero = {(r.request, r.specimen): r.value for r in api.batch_spatial_metrics(df, names, requests, impute_zero=True).collect()}
    assert zero == {k: 0.0 if v is None else pytest.approx(v, abs=1e-9) for k, v in got.items()}
    with pytest.raises(ValueError):
        api.batch_spatial_metrics(df, names, {"x": ([a], "ripley", 1.0)})


def test_ripley_is_the_plain_computation(spark):
    """Clustered, regular and random cells, against a numpy version over whole distance matrices."""
    rng = np.random.default_rng(2)
    corners = [(0, 0), (0, 1000), (1000, 0), (1000, 1000)]
    own = {1: rng.integers(0, 60, (40, 2)), 2: np.array([(x, y) for x in range(25, 1000, 50) for y in range(25, 1000, 50)]), 3: rng.integers(0, 1000, (120, 2)), 4: rng.integers(0, 1000, (1, 2))}
    rows = [(s, s * 1000 + i, int(x), int(y), 1) for s, at in own.items() for i, (x, y) in enumerate(at)] + [(s, s * 1000 + 900 + i, x, y, 2) for s in own for i, (x, y) in enumerate(corners)]
    rows += [(5, 5000 + i, i, i, 1) for i in range(9)]  # no area
    df = spark.createDataFrame(rows, "specimen long, structure long, x int, y int, label int").repartition(3)
    got = {r.specimen: r for r in spatial.ripley_f(df, simulations=7, points=200).collect()}
    assert got[4].radius is None and got[4].area == 1e6 and got[5].radius is None and got[5].area == 0
    hull, bins = np.array([(0, 0), (1000, 0), (1000, 1000), (0, 1000)], float), np.linspace(0, math.sqrt(1e6 / 2) / 4, 100)
    far = lambda a, b, k: np.sort(np.sqrt(((a[:, None] - np.asarray(b)[None]) ** 2).sum(2)), axis=1)[:, :k].ravel()
    curve = lambda d: np.array([0, *(np.cumsum(np.histogram(d, bins)[0]) / max(1, (d <= bins[-1]).sum()))])
    for s in (1, 2, 3):
        asked = spatial._uniform(hull, 200, [0, s])
        p = np.ones(100)
        for t in range(7):
            p += curve(far(asked, spatial._uniform(hull, 200, [0, s, t + 1]), 1)) < curve(far(asked, own[s], 2))
        p /= 8
        assert got[s].radius == pytest.approx((p * bins).sum() / p.sum(), abs=0.06)


@pytest.mark.parametrize("mode", ["G", "L"])
def test_ripley_g_and_l_are_the_plain_computation(spark, mode):
    rng = np.random.default_rng(12)
    corners = [(0, 0), (0, 1000), (1000, 0), (1000, 1000)]
    own = {1: rng.integers(0, 60, (40, 2)), 2: np.array([(x, y) for x in range(25, 1000, 90) for y in range(25, 1000, 90)]), 3: rng.integers(0, 1000, (120, 2)), 4: rng.integers(0, 1000, (1, 2))}
    other = {s: np.vstack([corners, rng.integers(0, 1000, (60, 2))]) for s in own}
    rows = [(s, s * 1000 + i, int(x), int(y), 1) for s, at in own.items() for i, (x, y) in enumerate(at)] + [(s, s * 1000 + 900 + i, int(x), int(y), 2) for s in own for i, (x, y) in enumerate(other[s])]
    rows += [(5, 5000 + i, i, i, 1) for i in range(9)]  # no area
    df = spark.createDataFrame(rows, "specimen long, structure long, x int, y int, label int").repartition(3)
    curves = spatial.ripley_gl(df, mode, 1, simulations=6, points=150)
    got = {}
    for r in curves.orderBy("at").collect():
        got.setdefault(r.specimen, []).append((r.distance, r.observed, r.p))
    assert set(got) == {1, 2, 3} and all(len(v) == 100 for v in got.values())
    hull, bins = np.array([(0, 0), (1000, 0), (1000, 1000), (0, 1000)], float), np.linspace(0, math.sqrt(1e6 / 2) / 4, 100)
    far = lambda a, b, k: np.sort(np.sqrt(((np.asarray(a)[:, None] - np.asarray(b)[None]) ** 2).sum(2)), axis=1)[:, :k].ravel()
    share = lambda d: np.array([0, *(np.cumsum(np.histogram(d, bins)[0]) / np.histogram(d, bins)[0].sum())])
    for s in (1, 2, 3):
        every = np.vstack([own[s], other[s]])

        def level(at, n=len(every)):
            d = far(at, at, len(at)).reshape(len(at), -1)
            pairs = np.array([((d < b).sum() - (len(at) if b > 0 else 0)) / 2 for b in bins])
            return np.sqrt(2 * pairs / n / (n / 1e6) / math.pi)

        p = np.ones(100)
        want = share(far(other[s], own[s], 2)) if mode == "G" else level(own[s].astype(float))
        for t in range(6):
            pattern = spatial._uniform(hull, 150, [0, s, t + 1])
            p += (share(far(every, pattern, 1)) if mode == "G" else level(pattern)) < want
        assert np.allclose([v[0] for v in got[s]], bins) and np.allclose([v[1] for v in got[s]], want, atol=1e-6)
        assert np.mean(np.abs(np.array([v[2] for v in got[s]]) - p / 7) > 1e-9) < 0.05  # equal curves may differ in their last bits
    radius = {r.specimen: r.radius for r in spatial.ripley_summary(curves).collect()}
    assert radius[2] == pytest.approx(sum(d * p for d, _, p in got[2]) / sum(p for _, _, p in got[2]), abs=0.06)
    with pytest.raises(ValueError):
        spatial.ripley_gl(df, "F")


def test_uniform_points_lie_in_the_polygon():
    h = np.array([(0, 0), (10, 0), (10, 5), (4, 9)], float)
    p = spatial._uniform(h, 2000, [1])
    side = [(h[(i + 1) % 4] - h[i])[0] * (p - h[i])[:, 1] - (h[(i + 1) % 4] - h[i])[1] * (p - h[i])[:, 0] for i in range(4)]
    assert (np.array(side) >= -1e-9).all() and abs(p[:, 0].mean() - 5.5) < 0.2  # its centroid


def test_nearest_of_a_crowd_beside_an_outlier(spark):
    """20000 cells in a corner and one far away."""
    rng = np.random.default_rng(5)
    at = np.unique(rng.integers(0, 1000, (21000, 2)), axis=0)
    rows = [(1, i, int(x), int(y)) for i, (x, y) in enumerate(at)] + [(1, 99999, 100_000, 100_000)]
    df = spark.createDataFrame(rows, "specimen long, structure long, x int, y int")
    out = {(r.a, r.rank): r.d2 for r in neighbors.nearest(df, 3).collect()}
    assert len(out) == 3 * len(rows)
    for i in rng.integers(0, len(at), 60):
        d = np.sort(((at - at[i]) ** 2).sum(1))[1:4]
        assert [out[i, r] for r in (1, 2, 3)] == d.tolist()


def brute_nearest(asked, cells, k):
    """{(specimen, a): [(d2, b), ...]} over rows (specimen, id, x, y)."""
    out = {}
    for s in {r[0] for r in asked}:
        ids, at = np.array([r[1] for r in cells if r[0] == s]), np.array([r[2:4] for r in cells if r[0] == s], float).reshape(-1, 2)
        for _, a, x, y in (r[:4] for r in asked if r[0] == s):
            d = ((at - (x, y)) ** 2).sum(1)
            order = np.lexsort((ids, d))
            out[s, a] = [(d[i], ids[i]) for i in order if ids[i] != a][:k]
    return {key: rows for key, rows in out.items() if rows}


@pytest.mark.parametrize("leaf", [8, 40, 4096])
def test_nearest_over_all_densities(spark, monkeypatch, leaf):
    """Leaves of 32 cells (at least eight times k + 1) and more: crowds, deserts, lines, cells at one place, ties on borders, specimens of one cell, no positions."""
    monkeypatch.setattr(neighbors, "LEAF_CELLS", leaf)
    monkeypatch.setattr(neighbors, "QUERIES", 100)
    rng = np.random.default_rng(4)
    spots = {
        1: rng.integers(0, 40, (500, 2)),  # ties
        2: np.vstack([rng.integers(0, 64, (600, 2)), rng.integers(500, 4096, (5, 2)), [[4096, 4096]]]),  # a crowd and a desert
        3: np.vstack([np.full((300, 2), 7), rng.integers(0, 100, (60, 2))]),  # more at one place than a leaf may hold
        4: np.column_stack([np.arange(200), np.zeros(200)]), 5: np.array([[3, 3]]), 6: np.array([[0, 0], [5, 5], [5, 5]]),
        7: np.round(rng.normal(size=(300, 2)) ** 5, 3), 8: np.array([(x, y) for x in range(16) for y in range(16)]),  # on the borders of squares
    }
    rows = [(s, int(i), float(x), float(y)) for s, at in spots.items() for i, (x, y) in zip(rng.permutation(len(at)) * 3, at, strict=True)]
    df = spark.createDataFrame([*rows, (1, 9998, None, 1.0), (1, 9999, float("nan"), 1.0)], "specimen long, structure long, x double, y double").withColumn("mark", F.col("structure") * 2).repartition(3)
    got = {}
    for r in neighbors.nearest(df, 3, keep=("mark",)).orderBy("rank").collect():
        assert (r.a_mark, r.b_mark) == (2 * r.a, 2 * r.b)
        got.setdefault((r.specimen, r.a), []).append((r.d2, r.b))
        assert r["rank"] == len(got[r.specimen, r.a])
    assert got == brute_nearest(rows, rows, 3)
    asked = [(s, -i - 1, float(x), float(y)) for s in spots for i, (x, y) in enumerate([*rng.integers(-50, 5000, (20, 2)), (7, 7), (3.5, 3.5)])]
    frame = spark.createDataFrame(asked, "specimen long, structure long, x double, y double")
    got = {}
    for r in neighbors.nearest(df, 2, queries=frame, keep=("mark",)).orderBy("rank").collect():
        assert r.b_mark == 2 * r.b
        got.setdefault((r.specimen, r.a), []).append((r.d2, r.b))
    assert got == brute_nearest(asked, rows, 2)


def test_leaves_of_a_quadtree_share_out_the_cells(spark):
    rng = np.random.default_rng(6)
    at = np.vstack([rng.integers(0, 50, (3000, 2)), rng.integers(0, 5000, (400, 2))])
    df = spark.createDataFrame([(1, i, float(x), float(y)) for i, (x, y) in enumerate(at)] + [(2, 1, 0.0, 0.0)], "specimen long, structure long, x double, y double")
    extents = df.groupBy("specimen").agg(F.count("*").alias("n"), F.min("x").alias("ox"), F.min("y").alias("oy"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.lit(1.0)).alias("span"))
    leafed, nodes, split = neighbors._quadtree(df, extents, 100)
    assert split and leafed.count() == 3401
    n = {tuple(r)[:4]: r["count"] for r in leafed.groupBy("specimen", "level", "i", "j").count().collect()}
    known = {tuple(r)[:4]: (r.n, r.leaf) for r in nodes.collect()}
    assert n == {key: v for key, (v, leaf) in known.items() if leaf} and max(n.values()) <= 100 and max(k[1] for k in n) > 7
    for (s, level, i, j), (v, leaf) in known.items():
        below = [known[s, level + 1, 2 * i + u, 2 * j + w][0] for u in (0, 1) for w in (0, 1) if (s, level + 1, 2 * i + u, 2 * j + w) in known]
        assert (sum(below) == v > 100) if not leaf else not below


def test_nearest_cells_of_given_points(cells, spark):
    df, rows = cells
    asked = spark.createDataFrame([(1, -1, 3.5, 9.25), (1, -2, 500.0, 500.0), (2, -1, 0.0, 0.0)], "specimen long, structure long, x double, y double")
    got = {(r.specimen, r.a, r["rank"]): (r.b, r.d2) for r in neighbors.nearest(df, 2, queries=asked).collect()}
    for s, i, x, y in [(1, -1, 3.5, 9.25), (1, -2, 500.0, 500.0), (2, -1, 0.0, 0.0)]:
        want = sorted(((x - u) ** 2 + (y - v) ** 2, j) for t, j, u, v, _ in rows if t == s)[:2]
        assert [got[s, i, r] for r in (1, 2)] == [(j, d) for d, j in want]


def test_counts_of_a_signature_and_its_opposite(cells):
    df, rows = cells
    out = populations.counts(df, {"yes": (1, 0), "no": (0, 1), "all": (0, 0)}).collect()
    assert all(r.yes + r.no == r["all"] == r.all_cells for r in out)
    high = populations.signature(["c63"], [], [f"c{i}" for i in range(64)])
    assert high == (-(1 << 63), 0)
    with pytest.raises(ValueError):
        populations.signature([], [], [str(i) for i in range(65)])
    with pytest.raises(KeyError):
        populations.signature(["x"], [], ["a"])
    assert populations.conjunction([(["B"], ["C"]), (["A"], [])]) == (("A", "B"), ("C",))


def test_tails():
    assert statistics.normal_cdf(1.959963985) == pytest.approx(0.975)
    assert statistics.t_two_sided(2.0, 10) == pytest.approx(0.07338803477074, rel=1e-9)
    assert statistics.t_two_sided(0.5, 3.7) == pytest.approx(1 - (1 - statistics.t_two_sided(-0.5, 3.7)))
    assert statistics.fisher_two_sided(8, 2, 1, 5) == pytest.approx(0.03496503496503, rel=1e-9)
    for a, b, c, d in ((3, 1, 1, 3), (0, 5, 5, 0), (2, 2, 2, 2)):
        n = [math.comb(a + b, k) * math.comb(c + d, a + c - k) for k in range(max(0, a - d), min(a + b, a + c) + 1)]
        own = math.comb(a + b, a) * math.comb(c + d, c)
        assert statistics.fisher_two_sided(a, b, c, d) == pytest.approx(sum(x for x in n if x <= own) / sum(n))


def test_sql_functions(spark):
    statistics.register(spark)
    r = spark.sql("select norm_cdf(0.0D) a, t_two_sided(2.0D, 10.0D) b, fisher_two_sided(8.0D, 2.0D, 1.0D, 5.0D) c, phenotype_match(5L, 1L, 2L) d").first()
    assert (round(r.a, 6), round(r.b, 6), round(r.c, 6), r.d) == (0.5, 0.073388, 0.034965, True)


@pytest.mark.parametrize(("interventions", "extraction", "want"), [
    ([], "2020-01-01", ""), (["2019-01-01"], "2020-01-01", "After interventions"), (["2021-01-01"], "2020-01-01", "Before intervention"),
    (["2019-05-01", "2021-1-1"], "2020-01-01", "Between interventions"), (["2020-01-01"], "2020-01-01", "After interventions"), (["5", "7.5"], "6", "Between interventions"),
    (["x, timepoint 10"], "y timepoint 2", "After interventions"), (["soon"], "2020-01-01", ""), (["2020-00-01"], "2020-01-01", ""),
])
def test_positions(spark, interventions, extraction, want):
    s = spark.createDataFrame([(1, 1, extraction)], "specimen long, subject long, extraction string")
    i = spark.createDataFrame([(1, d) for d in interventions], "subject long, event_date string")
    d = spark.createDataFrame([(1, "c", "late", "2022-02-02"), (1, "c", "soon", "2020-01-01")], "subject long, condition string, result string, event_date string")
    r = cohorts.clinical_position(s, i, d).first()
    assert r.position == want and r.result == ("soon" if extraction.startswith("2020") else "")


def test_quantiser_round_trip(spark):
    v = spark.range(0, 1001).select((F.col("id") / 1000).alias("v")).withColumn("b", scalars.quantise(F.col("v"))).withColumn("w", scalars.dequantise(F.col("b"))).toPandas()
    assert v.b.is_monotonic_increasing and v.b.min() == 0 and v.b.max() == 255 and ((v.w - v.v).abs() <= v.v / 30 + 0.005).all()


def test_import_of_a_bundle(spark, tmp_path):
    (tmp_path / "0.csv").write_text("XMin,XMax,YMin,YMax,A_Positive,B Positive,B Intensity\n0,4,0,2,1,0,0.5\n0,4,0,2,1,0,0.5\n-2,2,6,8,0,1,1.5\n")
    rows = ingest.cell_manifests(spark, str(tmp_path / "0.csv"))
    out = sorted((r.x, r.y, r.mask, r.intensity[1]) for r in ingest.cells_of(rows, ["B", "A"]).collect())
    assert out == [(0.0, 7.0, 2, 1.5), (2.0, 1.0, 1, 0.5)]
    with pytest.raises(ValueError):
        ingest.cell_columns(rows.columns, ["C"])
    (tmp_path / "m.tsv").write_text("File ID\tProject ID\tFile name\tSample ID\tData type\na\tp\t0.csv\ts1\tTabular cell manifest\nb\tp\tx.tsv\t\tOther\nb\tp\ty.tsv\t\tOther\n")
    m = ingest.text_table(spark, str(tmp_path / "m.tsv"), ingest.FILE_MANIFEST)
    assert [r["File name"] for r in ingest.files_of_type(m).collect()] == ["0.csv"]
    assert {r["File ID"]: r["File name"] for r in ingest.file_by_id(m).collect()} == {"a": "0.csv", "b": None}
    (tmp_path / "s.json").write_text('{"Study name": "S", "Institution": "I", "Study contact person": {"Name": "N"}, "Publications": [{"Title": "T", "Authors": ["x", "y"]}], "People": [{"Full name": "N"}]}')
    study = ingest.study_tables(spark, str(tmp_path / "s.json"))
    assert [(r.ordinality, r.author) for r in study["authors"].collect()] == [(0, "x"), (1, "y")] and study["people"].count() == 1
    ingest.export_partitioned(rows.withColumn("specimen", F.lit("s1")), str(tmp_path / "out"))
    assert (tmp_path / "out" / "specimen=s1").is_dir()
    assert len(ingest.file_digests(spark, str(tmp_path / "0.csv")).first().sha256) == 64


def test_streams(spark, tmp_path):
    from cytofabric.streaming import incremental

    src = tmp_path / "in"
    src.mkdir()
    load = lambda b: b.select("sha256", F.length("content").alias("n"))

    def run():
        files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(str(src)).select("path", "content")
        incremental.ingest_once(files, str(tmp_path / "store"), load, str(tmp_path / "cp")).awaitTermination(120)
        return spark.read.parquet(str(tmp_path / "store" / "rows")).count()

    (src / "a").write_text("one")
    (src / "b").write_text("two")
    assert run() == 2
    (src / "c").write_text("one")
    (src / "d").write_text("three")
    assert run() == 3


def test_gates_and_mixtures(spark):
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(-1.5, 0.3, 300), rng.normal(1.5, 0.4, 200)])
    df = spark.createDataFrame([("s", "c", float(x)) for x in v], "sample string, channel string, v double")
    g = gating.bimodality(gating.two_gaussians(df, 8)).first()
    assert g.m0 == pytest.approx(-1.5, abs=0.1) and g.m1 == pytest.approx(1.5, abs=0.1) and g.score > 0.5
    calls = gating.calls_from_gates(df, gating.bimodality(gating.two_gaussians(df, 8)))
    assert calls.agg(F.sum("positive")).first()[0] == pytest.approx(200, abs=3)


def test_samples_do_not_depend_on_partitions(cells):
    df, _ = cells
    one, two = ({r.structure for r in sampling.representative(d, 40).collect()} for d in (df, df.repartition(7)))
    assert one == two and len(one) == 40


def _greedy_rois(rows, hit, side, k):
    """One specimen's boxes, as the definition reads."""
    half, out = side // 2, []
    left = [(i, x, y) for i, x, y, m in rows if hit(m)]
    xs, ys = [r[1] for r in rows], [r[2] for r in rows]
    share = len(left) / len(rows) * (max(xs) - min(xs)) * (max(ys) - min(ys)) / side**2
    wanted = 1 if round(share) == 0 and share > 0.1 else round(share)
    while left and len(out) < wanted:
        near = {i: sum((x - u) ** 2 + (y - v) ** 2 <= half * half for _, u, v in left) for i, x, y in left}
        i, x, y = min(left, key=lambda r: (-near[r[0]], r[0]))
        inside = lambda u, v, x=x, y=y: abs(u - x) <= half and abs(v - y) <= half
        if sum(inside(u, v) for _, u, v, _ in rows) < k + 1:
            break
        out.append((len(out), x - half, x + half, y - half, y + half, sum(inside(u, v) for _, u, v in left)))
        left = [r for r in left if not inside(r[1], r[2])]
    return out


def test_rois_are_the_greedy_ones(spark):
    rng = np.random.default_rng(7)
    rows = []
    for s, n, wide in ((1, 300, 100), (2, 40, 200), (3, 12, 60), (4, 200, 30), (5, 1, 10)):
        at = rng.integers(0, wide, (n, 2)) if s != 4 else rng.normal(60, 12, (n, 2)).astype(int)
        rows += [(s, s * 1000 + i, int(x), int(y), int(m)) for i, ((x, y), m) in enumerate(zip(at, rng.integers(0, 4, n), strict=True))]
    df = spark.createDataFrame(rows, "specimen long, structure long, x int, y int, mask long").repartition(3)
    for side, k in ((20, 2), (30, 5)):
        got = {}
        for r in graphs.place_rois(df, F.col("mask") >= 2, side, k).collect():
            got.setdefault(r.specimen, []).append((r.roi, r.x_min, r.x_max, r.y_min, r.y_max, r.targets))
        want = {s: w for s in range(1, 6) if (w := _greedy_rois([r[1:] for r in rows if r[0] == s], lambda m: m >= 2, side, k))}
        assert {s: sorted(v) for s, v in got.items()} == want and len(want) > 1


def test_at_most_takes_so_many_of_each(spark):
    df = spark.range(3000).select((F.col("id") % 3 * (F.col("id") % 2)).alias("specimen"), F.col("id").alias("structure"))
    out = sampling.at_most(df, 600).groupBy("specimen").count().collect()
    assert {r.specimen: r["count"] for r in out} == {0: 600, 1: 500, 2: 500}


def test_split_gives_every_set_a_share(spark):
    s = spark.createDataFrame([(i, "ab"[i % 2], 1) for i in range(40)] + [(99, None, 3)], "specimen long, label string, rois int")
    out = {(r.label, r.set): r.n for r in graphs.dataset_counts(graphs.split_datasets(s)).collect()}
    assert out[None, None] == 1 and all(out[x, "train"] >= 10 and out[x, "validation"] >= 1 and out[x, "test"] >= 1 for x in "ab")


def naive_split(rows, validation, test):
    """Specimens of one label [(specimen, boxes)] in the order in which they are allotted."""
    sets = {rows[0][0]: "train"}
    if len(rows) == 2:
        sets[rows[1][0]] = ("validation", "test") if validation and test else "validation" if validation else "test" if test else "train"
        return sets
    at, have = 1, {"validation": 0, "test": 0}
    for name, p in (("validation", validation), ("test", test)):
        if p > 0 and at < len(rows):
            sets[rows[at][0]], have[name] = name, rows[at][1]
            at += 1
    boxes = sum(n for _, n in rows)
    train, valid, used = boxes * (1 - validation - test) - rows[0][1], boxes * validation - have["validation"], 0
    for specimen, n in rows[at:]:
        sets[specimen] = "train" if used < train else "validation" if used < train + valid else "test"
        used += n
    return sets


@pytest.mark.parametrize(("validation", "test"), [(0.15, 0.15), (0.2, 0.0), (0.0, 0.3), (0.0, 0.0), (0.4, 0.4)])
def test_data_sets_fill_up_in_turn(spark, validation, test):
    rng = np.random.default_rng(9)
    many = {"ten": [1] * 10, "two": [3, 4], "one": [5], "mixed": rng.integers(1, 9, 23).tolist(), "big": [2, 2, 2, 40, 2, 2, 2], "three": [1, 2, 3]}
    rows = [(f"{label}{i}", label, n) for label, ns in many.items() for i, n in enumerate(ns)] + [("x", None, 4), ("z0", "empty", 0), ("z1", "empty", 0)]
    got = {r.specimen: r.set for r in graphs.split_datasets(spark.createDataFrame(rows, "specimen string, label string, rois int"), validation, test, seed=3).collect()}
    assert got["x"] is got["z0"] is got["z1"] is None
    for label, ns in many.items():
        own = sorted(((f"{label}{i}", n) for i, n in enumerate(ns)), key=lambda r: (r[1] < 10 * np.median(ns), hashlib.md5(f"{r[0]}/3".encode()).hexdigest()))
        for specimen, want in naive_split(own, validation, test).items():
            assert got[specimen] in ([want] if isinstance(want, str) else want)
    if (validation, test) == (0.15, 0.15):
        sets = [got[f"ten{i}"] for i in range(10)]
        assert (sets.count("train"), sets.count("validation"), sets.count("test")) == (7, 2, 1)
    assert (validation, test) != (0.2, 0.0) or "test" not in {got[f"ten{i}"] for i in range(10)} | {got["two0"], got["two1"]}


def test_feature_store(spark):
    v = spark.createDataFrame([("f", 1, 1.0), ("f", 2, None), ("g", 1, float("nan"))], "feature string, subject long, value double")
    assert [(r.subject, r.value) for r in features.values_of(v, "f").collect()] == [(1, 1.0), (2, None)]
    assert features.values_of(v, "g").first().value is None
    e = spark.createDataFrame([("f", i) for i in range(1, 4)], "feature string, subject long")
    assert [tuple(r) for r in features.missing(e, v).collect()] == [("f", 3)]


def test_findings(spark):
    f = spark.createDataFrame([(1, "s", "x", "pending_review", None)], "id int, study string, background string, status string, published_at timestamp")
    f = api.set_status(api.create_finding(f, spark.createDataFrame([(2, "s", "y")], "id int, study string, background string")), 1, "published")
    assert [r.id for r in api.published_findings(f, "s").collect()] == [1]


def test_review_sets_the_time_once(spark):
    rows = [(1, "s", "x", "pending_review", None), (2, "s", "y", "pending_review", None)]
    f = spark.createDataFrame(rows, "id int, study string, background string, status string, published_at timestamp")
    decide = lambda *d: spark.createDataFrame(list(d), "id int, status string")
    for day, d in (("2024-01-01", [(1, "published"), (1, "published"), (9, "published")]), ("2024-02-01", [(1, "rejected")]), ("2024-03-01", [(1, "published"), (2, "published")])):
        f = api.review(f, decide(*d), F.lit(day).cast("timestamp"))
    assert f.columns == ["id", "study", "background", "status", "published_at"]
    assert sorted((r.id, r.status, str(r.published_at.date())) for r in f.collect()) == [(1, "published", "2024-01-01"), (2, "published", "2024-03-01")]


def test_a_feature_is_pending_until_it_has_just_its_values(spark):
    expected = spark.createDataFrame([(f, i) for f in "abcd" for i in range(2)], "feature string, subject int")
    values = spark.createDataFrame([("a", 0, 1.0), ("a", 1, None), ("b", 0, 1.0), ("d", 0, 1.0), ("d", 1, 1.0), ("d", 1, 2.0), ("e", 0, 1.0)], "feature string, subject int, value double")
    assert sorted(tuple(r) for r in features.progress(expected, values).collect()) == [("a", 2, 2, False), ("b", 2, 1, True), ("c", 2, 0, True), ("d", 2, 3, True)]


def test_exports_leave_out_what_is_asked(spark, tmp_path):
    t = {n: spark.range(2) for n in ("sample", "expression_quantification", "quantitative_feature_value", "feature_specifier")}
    assert ingest.export_tables(t, str(tmp_path / "a")) == ["feature_specifier", "quantitative_feature_value", "sample"]
    assert ingest.export_tables(t, str(tmp_path / "b"), feature_values=False) == ["feature_specifier", "sample"]
    assert ingest.export_tables(t, str(tmp_path / "c"), False, False) == ["sample"] == [p.name for p in (tmp_path / "c").iterdir()]


def test_json_artifacts_and_annotations(spark, tmp_path):
    from cytofabric.operators import metadata

    (tmp_path / "f.json").write_text('{"S": ["one", "two"], "R": []}')
    assert [tuple(r) for r in metadata.json_artifacts(spark, str(tmp_path / "f.json")).collect()] == [("S", 0, "one"), ("S", 1, "two")]
    (tmp_path / "a.json").write_text('{"groups": {"g": {"channels": ["b", "a"], "color": "red"}}, "aliases": {"x": "a"}}')
    both = metadata.json_annotations(spark, str(tmp_path / "a.json"))
    assert [tuple(r) for r in api.channel_annotations(both["groups"]).collect()] == [("g", "red", ["a", "b"])]
    assert [tuple(r) for r in both["aliases"].collect()] == [("x", "a")]
    assert metadata.method_catalogue(spark).count() == 7


def test_classes_cover_every_set(spark):
    sets = spark.createDataFrame([(3, 1), (3, 2), (1, 2), (1, 1), (1, 1), (2, 1), (7, 1)], "set_id long, structure long")
    out = {r.set_id: (r.class_id, r.class_size) for r in features.cell_set_classes(sets).collect()}
    assert out == {1: (1, 2), 3: (1, 2), 2: (2, 2), 7: (2, 2)}


def test_gating_queries_do_the_operators_whole_job(spark, monkeypatch):
    import inspect

    from cytofabric.plans import gating as plans

    given, sf = {}, "/root/testdata/sf0.001"
    for module, name in ((plans.K, "layout"), (plans.G, "two_gaussians"), (plans.G, "gate_search")):
        of = inspect.signature(getattr(module, name))

        def keep(*a, of=of, name=name, **b):
            bound = of.bind(*a, **b)
            bound.apply_defaults()
            given[name] = bound.arguments
            return spark.createDataFrame([(1, 0.0, 0.0, 1, "c", 0.0, 0.0, 0.0)], "vec_id long, x double, y double, sample int, channel string, final double, single double, mean double")

        monkeypatch.setattr(module, name, keep)
    monkeypatch.setattr(plans.G, "bimodality", lambda d: d)
    plans.k04(spark, sf), plans.i10(spark, sf), plans.i13(spark, sf)
    assert len(given["layout"]["columns"]) == 64 and given["two_gaussians"]["iterations"] == 20
    assert (given["gate_search"]["steps"], given["gate_search"]["rounds"]) == (16, 2)


def naive_gate_search(values, was, signatures, channels, steps, rounds):
    """One sample: values channel -> array, was signature -> array of bool."""
    means = {c: v.mean() for c, v in values.items()}
    gates = {c: [means[c] * 2 * i / (steps - 1) for i in range(steps)] for c in channels}

    def distance(now, some):
        total = 0.0
        for n, (positive, negative) in some.items():
            made = np.ones(len(was[n]), bool)
            for c in positive:
                made &= values[c] > now[c]
            for c in negative:
                made &= ~(values[c] > now[c])
            total += 1 - (made & was[n]).sum() / (made | was[n]).sum() if (made | was[n]).any() else 0.0
        return total / len(some)

    single = {}
    for c in channels:
        own = {n: s for n, s in signatures.items() if list(s[0]) == [c] and not s[1]}
        single[c] = min(gates[c], key=lambda g: distance({c: g}, own)) if own else means[c]  # noqa: B023
    now = dict(single)
    for _ in range(rounds):
        for c in channels:
            now[c] = min([now[c], *gates[c]], key=lambda g: distance({**now, c: g}, signatures))  # noqa: B023
    return {c: (now[c], single[c], means[c]) for c in channels}


@pytest.mark.parametrize(("steps", "rounds"), [(16, 2), (5, 1), (2, 3)])
def test_gate_search_is_the_plain_one(spark, steps, rounds):
    """Positive, negative and zero means, values on gates, a channel without a signature of its own, an empty signature."""
    rng = np.random.default_rng(10)
    signatures = {"A": (["a"], []), "B": (["b"], []), "AnotB": (["a", "c"], ["b"]), "C": (["c"], ["a"]), "none": (["b"], ["a", "c"])}
    samples = {1: (lambda n: rng.exponential(2, n)), 2: (lambda n: -rng.integers(0, 9, n).astype(float)), 3: (lambda n: rng.integers(-1, 2, n).astype(float)), 4: (lambda n: np.zeros(n))}
    rows, want = [], {}
    for s, draw in samples.items():
        values = {c: draw(150) for c in "abc"}
        was = {n: (rng.random(150) < 0.3) & (n != "none") for n in signatures}
        want |= {(s, c): v for c, v in naive_gate_search(values, was, signatures, "abc", steps, rounds).items()}
        rows += [(s, *(float(values[c][i]) for c in "abc"), *(int(was[n][i]) for n in signatures)) for i in range(150)]
    df = spark.createDataFrame(rows, "sample int, a double, b double, c double, " + ", ".join(f"is_{n} int" for n in signatures))
    got = {(r.sample, r.channel): (r.final, r.single, r["mean"]) for r in gating.gate_search(df, {n: f"is_{n}" for n in signatures}, signatures, list("abc"), steps, rounds).collect()}
    assert got.keys() == want.keys()
    for key, v in want.items():
        assert got[key] == pytest.approx(v, abs=1e-9), key


def test_roc_points_are_the_running_shares(spark):
    rng = np.random.default_rng(11)
    rows = [(f, float(v), int(x)) for f, n in (("f", 300), ("g", 7)) for v, x in zip(rng.integers(0, 40, n), rng.integers(0, 2, n), strict=True)]
    odd = [("one", 1.0, 1), ("one", 2.0, 1), ("f", None, 1), ("f", 2.0, None)]
    got = {}
    for r in features.roc_points(spark.createDataFrame(rows + odd, "feature string, value double, label int").repartition(4)).orderBy("place").collect():
        got.setdefault(r.feature, []).append((r.place, r.positives, r.negatives))
    want = {}
    for f in "fg":
        own = sorted((v, x) for g, v, x in rows if g == f)
        pos = sum(x for _, x in own)
        at, want[f] = (0, len(own) - pos), [(0, 0.0, 1.0)]
        for i, (_, x) in enumerate(own):
            at = (at[0] + x, at[1] - (1 - x))
            want[f].append((i + 1, at[0] / pos, at[1] / (len(own) - pos)))
    assert got.keys() == want.keys() and all(np.allclose(got[f], want[f]) for f in want)


def _t_p(t, df):
    """Two-sided p by Simpson's rule over the density of t."""
    c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    x = np.linspace(0, abs(t), 20001)
    y = c * (1 + x * x / df) ** (-(df + 1) / 2)
    return 1 - 2 * float((y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum()) * (x[1] - x[0]) / 3)


def test_p_values_of_cohort_tests(spark):
    rng = np.random.default_rng(3)
    data = {(f, c): rng.normal(c, 1 + c, 5 + 3 * c) for f in "fg" for c in (1, 2, 3)}
    df = spark.createDataFrame([(f, c, float(x)) for (f, c), v in data.items() for x in v] + [("f", 1, None), ("g", 2, float("nan"))], "feature string, cohort int, value double")
    for equal in (True, False):
        out = features.cohort_tests(df, equal).collect()
        assert len(out) == 6
        for r in out:
            a, b = data[r.feature, r.cohort_1], data[r.feature, r.cohort_2]
            va, vb = a.var(ddof=1) / len(a), b.var(ddof=1) / len(b)
            n = len(a) + len(b) - 2
            pooled = ((len(a) - 1) * a.var(ddof=1) + (len(b) - 1) * b.var(ddof=1)) / n * (1 / len(a) + 1 / len(b))
            t = (a.mean() - b.mean()) / math.sqrt(pooled if equal else va + vb)
            d = n if equal else (va + vb) ** 2 / (va**2 / (len(a) - 1) + vb**2 / (len(b) - 1))
            assert (r.t, r.df) == (pytest.approx(t), pytest.approx(d)) and r.p == pytest.approx(_t_p(t, d), abs=1e-8)


def test_p_values_of_enrichment_and_moran(spark):
    rng = np.random.default_rng(6)
    rows = [(s, s * 100 + i, int(rng.integers(0, 40)), int(rng.integers(0, 40)), int(rng.integers(0, 8)), int(rng.integers(0, 2))) for s in (1, 2) for i in range(30)]
    df = spark.createDataFrame(rows, "specimen long, structure long, x int, y int, mask long, label int")
    table = features.importance_enrichment(df, F.col("x") < 20, F.col("mask") >= 4).collect()
    region = spatial.region_enrichment_counts(df, F.col("x") < 20, (4, 0)).select("*", statistics.fisher("a", "b", "c", "d").alias("p")).collect()
    for r in [*table, *region]:
        n = [math.comb(r.a + r.b, k) * math.comb(r.c + r.d, r.a + r.c - k) for k in range(max(0, r.a - r.d), min(r.a + r.b, r.a + r.c) + 1)]
        own = math.comb(r.a + r.b, r.a) * math.comb(r.c + r.d, r.c)
        assert r.p == pytest.approx(sum(x for x in n if x <= own) / sum(n))
    edges = neighbors.stored(spatial.neighbour_edges(df, 4))
    found = {r.specimen: r for r in spatial.moran(df, edges).collect()}
    z = {r.specimen: r for r in spatial.enrichment(df, edges, (0, 1)).collect()}
    for s in (1, 2):
        ids = [r[1] for r in rows if r[0] == s]
        v = np.array([r[5] for r in rows if r[0] == s], float)
        w = np.zeros((30, 30))
        for e in edges.where(f"specimen = {s}").collect():
            w[ids.index(e.a), ids.index(e.b)] = 1 / 4
        d = v - v.mean()
        i = (w * np.outer(d, d)).sum() / w.sum() / (d * d).mean()
        s0, s1, s2 = w.sum(), ((w + w.T) ** 2).sum() / 2, ((w.sum(1) + w.sum(0)) ** 2).sum()
        variance = (900 * s1 - 30 * s2 + 3 * s0 * s0) / (899 * s0 * s0) - 1 / 29**2
        p = 0.5 * math.erfc(abs(i + 1 / 29) / math.sqrt(variance) / math.sqrt(2))
        assert found[s].moran == pytest.approx(i) and found[s].p == pytest.approx(p, abs=1e-9)
        assert z[s].enrichment == pytest.approx(0.5 * math.erfc(-z[s].z / math.sqrt(2)), abs=1e-12)


def test_stored_cells_are_read_by_folder(spark, tmp_path):
    from cytofabric.sources import tables

    rows = spark.range(100).select((F.col("id") % 5).alias("specimen"), F.col("id").alias("structure"))
    tables.store_cells(rows, str(tmp_path / "cells"))
    out = tables.read_cells(spark, str(tmp_path / "cells"), spark.createDataFrame([(2,), (3,), (2,), (77,)], "specimen long"))
    assert sorted(r.structure for r in out.collect()) == [i for i in range(100) if i % 5 in (2, 3)]
    plan = out._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan.lower() or "PartitionFilters" in plan


def test_a_range_of_structures_reads_little(spark, tmp_path):
    import pyarrow.parquet as pq

    from cytofabric.sources import tables

    path = tmp_path / "cells"
    rows = spark.range(200_000).select(F.when(F.col("id") % 10 < 7, 1).otherwise(2).alias("specimen"), F.xxhash64("id").alias("structure"), F.col("id").alias("mask"))
    tables.store_cells(rows.repartition(9), str(path), group_bytes=64 << 10)
    held = [pq.ParquetFile(f).metadata for f in sorted((path / "specimen=1").glob("*.parquet"))]
    spans = sorted((g.column(0).statistics.min, g.column(0).statistics.max) for m in held for g in (m.row_group(i) for i in range(m.num_row_groups)))
    assert len(held) > 1 and len(spans) > 4 and all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))  # a large specimen: several files, no overlap

    def read(*how, **more):
        out = tables.read_range(spark, str(path), *how, **more)
        got = sorted((r.structure, r.mask) for r in out.collect())
        leaf = out._jdf.queryExecution().executedPlan().collectLeaves().head()
        return got, leaf.metrics().apply("numOutputRows").value()

    want = sorted((r.structure, r.mask) for r in rows.where("specimen = 1").collect())
    got, scanned = read(1, want[5000][0], want[5999][0])
    assert got == want[5000:6000] and scanned < len(want) / 4
    assert read(1)[0] == want and read(3)[0] == [] and read(1, highest=want[9][0])[0] == want[:10] and read(1, want[-10][0])[0] == want[-10:]
    some = [want[i][0] for i in (3, 700, 701)]
    assert read(1, structures=[*some, 5])[0] == [want[i] for i in (3, 700, 701)]
    assert read(1, want[4][0], structures=some)[0] == [want[700], want[701]] and read(1, structures=[])[0] == []
    assert {(r.specimen, r.n) for r in tables.serial_ranges(rows).collect()} == {(1, 140_000), (2, 60_000)}


def test_cells_of_files_with_any_header(spark):
    from cytofabric.streaming import incremental

    files = {
        "a": "XMin,XMax,YMin,YMax,A_Positive,B Positive,B Intensity\n0,4,0,2,1,0,0.5\n0,4,0,2,1,0,0.5\n-2,2,6,8,0,1,1.5\n",
        "b": "B Positive,A Positive,YMin,YMax,XMin,XMax\r\n1,1,0,2,0,4\r\n", "c": "", "d": "XMin,XMax\n",
    }
    df = spark.createDataFrame([(k, v.encode()) for k, v in files.items()], "sha256 string, content binary")
    out = sorted((r.sha256, r.structure, r.x, r.y, r.mask, r.intensity) for r in incremental.cells_in(df, ["B", "A"]).collect())
    assert out == [("a", 0, 2.0, 1.0, 1, [None, 0.5]), ("a", 1, 0.0, 7.0, 2, [None, 1.5]), ("b", 0, 2.0, 1.0, 3, [None, None])]
    assert incremental.cells_in(df.where("sha256 > 'b'"), ["A"]).count() == 0


def test_counts_go_on_after_a_restart_and_late_events_are_left(spark, tmp_path):
    from datetime import datetime

    from cytofabric.streaming import incremental

    at = lambda h, m: datetime(2024, 1, 1, h, m)
    loads = [[(at(1, 5), 7, "a"), (at(1, 50), 7, "a")], [(at(1, 55), 7, "a"), (at(3, 0), 7, "a")], [(at(1, 10), 7, "a"), (at(2, 55), 8, "a")]]
    seen = []
    for i, load in enumerate(loads):
        spark.createDataFrame(load, "ts timestamp, user_id long, event_type string").coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
        counts = incremental.event_counts(spark.readStream.schema("ts timestamp, user_id long, event_type string").parquet(f"{tmp_path}/in/*"))
        incremental.keep_counts(counts, str(tmp_path / "store"), str(tmp_path / "checkpoint")).awaitTermination(120)
        seen.append(sorted((r.start.hour, r.user_id, r.n) for r in incremental.read_counts(spark, str(tmp_path / "store"), counts, ["start", "user_id", "event_type"]).collect()))
    # 1:55 joins a window left by the first run; 1:10 comes after the watermark of 2:50, 2:55 lies in a window still open
    assert seen == [[(1, 7, 2)], [(1, 7, 3), (3, 7, 1)], [(1, 7, 3), (2, 8, 1), (3, 7, 1)]]


def test_subsample_bytes_and_gates(spark):
    import json

    rng = np.random.default_rng(3)
    rows = []
    for s, n in (("x", 50), ("y", 30), ("z", 3)):
        for i, (v, w) in enumerate(rng.random((n, 2))):
            rows.append((s, len(rows), int(v > 0.3) + (2 if s == "y" else 0), float(v), None if s == "z" else float(w) * 1e-5))
    df = spark.createDataFrame(rows, "specimen string, structure long, mask long, a double, b double")
    names, where = {"A": (1, 0), "B": (2, 0)}, {"A": "a", "B": "b"}
    high = (1 + 31 / 32) * 2**7 - 1

    def code(v):
        m, e = math.frexp(1 + v * high)
        return min(255, 32 * (e - 1) + math.floor(32 * (2 * m - 1)))

    value = lambda b: ((1 + b % 32 / 32) * 2.0 ** (b // 32) - 1) / high
    found = {r.specimen: (r["count"], list(r.thresholds)) for r in gating.subsample_metadata(df, names, where, 40).collect()}
    assert {s: f[0] for s, f in found.items()} == {"x": 25, "y": 14, "z": 1}
    for s in "xyz":
        low, hit = ([value(code(r[3])) for r in rows if r[0] == s and r[2] % 2 == i] for i in (0, 1))
        want = (max(low) + min(hit)) / 2 if low and hit else max(low) if low else min(hit)
        assert found[s][1][0] == max(1, code(want))
    assert found["x"][1][1] == 1 and found["y"][1][1] == 1 and found["z"][1][1] is None  # byte 0 becomes 1; no value at all
    metadata, sample = api.whole_study_subsample(df, names, where, 40)
    read = json.loads(metadata.first().metadata)
    assert read["channel_order"] == ["A", "B"] and [c["specimen"] for c in read["subsample_counts"]] == ["x", "y", "z"]
    codes = {r.structure: bytes(r.codes) for r in sample.collect()}
    assert len(codes) == 40 and all(c == bytes((code(rows[i][3]), code(rows[i][4] or 0))) for i, c in codes.items())
