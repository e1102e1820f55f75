"""Results on tables that are larger, or of another kind, than those of test_core.py."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from cytofabric.operators import cohorts, spatial
from cytofabric.plans import registry

SF = "/root/testdata/sf0.1"


def test_labels_of_strata_keep_columns_that_do_not_differ(spark):
    """At sf0.1 the chosen strata share one position, which the SQL names all the same."""
    db = duckdb.connect()
    for t in ("supplier", "nation", "events"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = {(r.specimen, r.label) for r in registry.queries()["b18_labelled_strata"](spark, SF).collect()}
    assert got == set(db.execute(registry.oracle_sql()["b18_labelled_strata"]).fetchall())
    rows = spark.createDataFrame([(1, 1, "p", "c", ""), (2, 2, "p", "d", ""), (3, 3, "p", "e", "")], "specimen long, stratum int, position string, condition string, result string")
    label = lambda **how: sorted(r.label for r in cohorts.labelled_strata(rows, [1, 2], ["position", "condition", "result"], **how).collect())
    assert label() == ["(c)", "(d)"] and label(differing=False) == ["(p, c)", "(p, d)"]


def test_simulations_of_ripley_meet_a_part_of_the_pattern(spark, monkeypatch):
    """Pairs by distance as over the whole matrix, from fewer distances; and few bytes of long work are dealt to several tasks."""
    rng, met = np.random.default_rng(3), []
    plain = spatial._squares_between
    monkeypatch.setattr(spatial, "_squares_between", lambda a, b: met.append(len(a) * len(b)) or plain(a, b))
    for at in (rng.random((1000, 2)) * 1000, rng.integers(0, 40, (500, 2)).astype(float) * 25, np.zeros((70, 2))):
        met.clear()
        d2 = ((at[:, None] - at[None]) ** 2).sum(2)[np.triu_indices(len(at), 1)]
        want = np.bincount((np.sqrt(d2[d2 < 177.0**2]) * (99 / 177.0)).astype(int), minlength=99)
        assert (spatial._pairs_by_distance(at, 177.0, 99) == want).all()
        assert at.max() == 0 or sum(met) < 0.4 * len(at) ** 2
    keys = spark.range(64).withColumnsRenamed({"id": "specimen"})
    assert len(set(r[0] for r in spatial._spread(keys, 64, "specimen").select(F.spark_partition_id()).distinct().collect())) > 8


def test_nearest_of_many_leaves_meet_a_part_of_their_leaf(monkeypatch):
    """Neighbours within leaves, taken many at once, as by comparing all of a leaf with all; on spread positions from few distances."""
    rng, met, plain = np.random.default_rng(5), [], np.square
    leaf, x, y = np.repeat(np.arange(6), 500), rng.random(3000) * 1000, rng.random(3000) * 1000
    ids, thick = rng.permutation(3000) + (1 << 32), rng.random(3000) < 0.9
    monkeypatch.setattr(neighbors.np, "square", lambda v: met.append(len(v)) or plain(v))
    for k, at, to in ((6, x, y), (6, x // 50, y // 50), (3, x, 0 * y), (2, np.where(thick, x / 1e4, x), np.where(thick, y / 1e4, y)), (1, 0 * x, 0 * y - 3), (600, x, y)):
        met.clear()
        row, near, d2, rank, last = neighbors._k_nearest_each(leaf, ids, at, to, k)
        if at is x and k == 6:
            assert sum(met) / 2 < 0.2 * 6 * 500**2
        for own in (np.flatnonzero(leaf == i) for i in range(6)):
            q = (ids[own], at[own], to[own])
            r, n, d, place, most = neighbors._k_nearest(q, q, k)
            here = np.isin(row, own)
            assert sorted(zip(row[here], rank[here], near[here], d2[here])) == sorted(zip(own[r], place, own[n], d)) and (last[own] == most).all()


def test_folders_of_stored_cells_follow_cells_not_specimens(spark, tmp_path):
    from cytofabric.sources import tables

    path = str(tmp_path / "cells")
    rows = spark.range(20_000).select(F.when(F.col("id") < 19_000, F.col("id") % 1000).otherwise(None).alias("specimen"), F.col("id").alias("structure"), (F.col("id") * 3).alias("mask"))
    tables.store_cells(rows, path)
    assert len(list((tmp_path / "cells").rglob("*=*"))) <= tables.SHARED
    assert sorted(map(tuple, tables.read_cells(spark, path).collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    wanted = spark.createDataFrame([(7,), (999,), (5000,)], "specimen int")
    assert sorted(r.structure for r in tables.read_cells(spark, path, wanted).collect()) == [i for i in range(19_000) if i % 1000 in (7, 999)]
    assert sorted(r.mask for r in tables.read_range(spark, path, 7, 3000, 6000).collect()) == [3 * i for i in (3007, 4007, 5007)]


def test_files_that_arrive_grow_in_number(spark, monkeypatch, tmp_path):
    """Each file of cells is numbered in one task, so it is bounded; contents are not shuffled to find those that are known."""
    from cytofabric.plans import api

    seen, plain = [], api.ingest_cells
    monkeypatch.setattr(api, "_FILE_CELLS", 250)
    monkeypatch.setattr(api, "ingest_cells", lambda s, folder, *more: seen.append((len(list(__import__("pathlib").Path(folder[:-2].removeprefix("file://")).rglob("*.csv"))), more[-1])) or plain(s, folder, *more))
    small = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"create view lineitem as select * from '{small}/lineitem.parquet'")
    got = sorted(tuple(r) for r in registry.queries()["n01_cells_from_files"](spark, small).collect())
    assert got == sorted(db.execute(registry.oracle_sql()["n01_cells_from_files"]).fetchall())
    assert seen[0][0] > 3 and seen[1][0] == 3 * seen[0][0] and seen[0][1] > 2


def test_subsample_metadata_reads_cells_once(spark):
    from cytofabric.operators import gating

    rows = spark.range(2000).select((F.col("id") % 7).alias("specimen"), F.col("id").alias("structure"), (F.col("id") % 3).alias("mask"), ((F.col("id") * 37 % 1000) / 1000).alias("v"))
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            read.add(len(b))
            yield b

    names, where = {"A": (1, 0)}, {"A": "v"}
    got = {r.specimen: (r["count"], list(r.thresholds)) for r in gating.subsample_metadata(rows.mapInPandas(count, rows.schema), names, where, 70).collect()}
    gates = {r.specimen: [r.gate] for r in gating.gate_bytes(rows, names, where).collect()}
    assert read.value == 2000 and {s: t for s, (_, t) in got.items()} == gates and sum(n for n, _ in got.values()) == 70


def test_leading_bins_and_boxes_of_a_dense_specimen(spark):
    """Bins that lead within two around, as by looking at all; boxes as one by one, of specimens that are done early and of one that is not."""
    from cytofabric.operators import graphs

    rng = np.random.default_rng(11)
    bins = [(s, int(i), int(j), int(rng.integers(0, 4))) for s in (1, 2) for i, j in {(i, j) for i, j in rng.integers(-12, 12, (200, 2))}]
    best = spark.createDataFrame([(s, i, j, (-n, at, 0)) for at, (s, i, j, n) in enumerate(bins)], "specimen long, bx long, by long, b struct<m: long, a: long, x: int>")
    key = {(s, i, j): (-n, at) for at, (s, i, j, n) in enumerate(bins)}
    want = {k for k, v in key.items() if all(v <= key.get((k[0], k[1] + u, k[2] + w), v) for u in range(-2, 3) for w in range(-2, 3))}
    assert {(r.specimen, r.bx, r.by) for r in graphs._leading(best).collect()} == want
    at = [(s, 1000 * s + i, int(x), int(y), bool(t)) for s, wide in ((1, 1000), (2, 300)) for i, (x, y, t) in enumerate(zip(rng.integers(-50, wide, 400), rng.integers(0, wide, 400), rng.random(400) < 0.3, strict=True))]
    cells = spark.createDataFrame(at, "specimen long, structure long, x int, y int, hit boolean")
    got, half = {}, 60
    for r in graphs.place_rois(cells, F.col("hit"), 2 * half).collect():
        got.setdefault(r.specimen, {})[r.roi] = (r.x_min, r.y_min, r.targets)
    for s in (1, 2):
        left, found = {c[1]: c[2:4] for c in at if c[0] == s and c[4]}, []
        while left and len(found) < len(got[s]):
            near = {a: sum((x - u) ** 2 + (y - v) ** 2 <= half**2 for u, v in left.values()) for a, (x, y) in left.items()}
            x, y = left[min(left, key=lambda a: (-near[a], a))]
            inside = [a for a, (u, v) in left.items() if abs(u - x) <= half and abs(v - y) <= half]
            found.append((x - half, y - half, len(inside)))
            left = {a: p for a, p in left.items() if a not in inside}
        assert [got[s][i] for i in range(len(got[s]))] == found and len(found) > 1


def test_autocorrelation_is_read_off_one_graph(spark, monkeypatch):
    from cytofabric.plans import api

    rows = spark.range(120).select((F.col("id") % 3).alias("specimen"), F.col("id").alias("structure"), (F.col("id") * 7919 % 100 + 2).alias("x"), (F.col("id") * 104729 % 97 + 2).alias("y"), (F.col("id") * 31 % 5 % 2).alias("mask"))
    marked = rows.withColumn("label", F.col("mask"))
    want = {r.specimen: r.p for r in spatial.moran(marked, spatial.neighbour_edges(marked)).collect()}

    def absent(*_):
        raise AssertionError("joins of edges and cells")

    monkeypatch.setattr(spatial, "moran", absent)
    got = {r.specimen: r.value for r in api.spatial_metrics(rows, ["A"], [(["A"], [])], "autocorrelation").collect()}
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-9 for s in want)
