"""Spatial metrics of each specimen: proximity, neighbourhood enrichment, co-occurrence, autocorrelation, Ripley's F."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.statistics import norm_cdf
from .neighbors import nearest, radius_pairs, stored, unordered_pairs
from .populations import Signature, matches


#: Simulations taken at once, and cells of a specimen that meet its simulations in one group.
TURNS, SHARE = 50, 8192


def integer_positions(cells: DataFrame) -> DataFrame:
    """x, y shifted to begin at 1 where either begins at 1 or less, then cut to integers; extents are joined, not windowed."""
    low = cells.groupBy("specimen").agg(F.min("x").alias("mx"), F.min("y").alias("my"))
    both = cells.join(low, "specimen")
    shift = (F.col("mx") <= 1) | (F.col("my") <= 1)
    place = {c: F.when(shift, F.col(c) - F.col(f"m{c}") + 1).otherwise(F.col(c)).cast("int") for c in "xy"}
    return both.withColumns(place).drop("mx", "my")


def proximity(cells: DataFrame, requests: Mapping[str, tuple[Signature, Signature, float]]) -> DataFrame:
    """(specimen, <name>...): pairs (p in first, q in second) within the radius, without self-pairs, over the number of p.

    Null where a specimen has no p. All requests share one join at the largest radius, of cells that any request wants; pairs are summed
    where they arise, one row for each specimen and task.
    """
    m = F.col("mask")
    any_of = lambda i: F.greatest(*(matches(m, *r[i]).cast("int") for r in requests.values()), F.lit(0)) == 1
    radius = max(r[2] for r in requests.values())
    pairs = radius_pairs(cells.where(any_of(0)).withColumnRenamed("mask", "ma"), cells.where(any_of(1)).withColumnRenamed("mask", "mb"), radius, ("ma",), ("mb",))
    hits = [F.sum(F.when(matches(F.col("ma"), *p) & matches(F.col("mb"), *q) & (F.col("d2") <= r * r), 1).otherwise(0)).alias(f"hit_{n}") for n, (p, q, r) in requests.items()]
    found = pairs.where("a <> b").groupBy("specimen").agg(*hits)
    first = [F.sum(F.when(matches(m, *p), 1).otherwise(0)).alias(f"first_{n}") for n, (p, _, _) in requests.items()]
    sizes = cells.groupBy("specimen").agg(*first)
    both = sizes.join(found, "specimen", "left")
    return both.select("specimen", *(F.when(F.col(f"first_{n}") > 0, F.coalesce(f"hit_{n}", F.lit(0)) / F.col(f"first_{n}")).alias(n) for n in requests))


def labels(mask: Column, phenotypes: Sequence[Signature]) -> Column:
    """1 for the first phenotype, 2 for the second among the rest, and so on; 0 for cells of none."""
    out = F.lit(0)
    for i in range(len(phenotypes), 0, -1):
        out = F.when(matches(mask, *phenotypes[i - 1]), i).otherwise(out)
    return out


def neighbour_edges(cells: DataFrame, k: int = 6) -> DataFrame:
    """(specimen, a, b): each cell with its k nearest others, directed."""
    return nearest(cells, k).select("specimen", "a", "b")


class NeighbourGraph(NamedTuple):
    """Edges (specimen, a, b, rank, a_<kept>..., b_<kept>...) from each cell to its nearest others, stored, and what every statistic of a specimen's graph needs of
    it: moments (specimen, s0, rec, oo, ii, oi, degree), the numbers of edges and of those that go both ways, sums over cells of squared and mixed degrees, edges from a cell."""

    edges: DataFrame
    moments: DataFrame


def neighbour_graph(cells: DataFrame, k: int = 6, keep: tuple[str, ...] = ("mask",)) -> NeighbourGraph:
    """The graph of each specimen's k nearest neighbours with the columns `keep` of both ends, so that any number of labellings and channels
    is read off one stored table, without joins. Cells (specimen, structure, x, y, kept) have distinct ids; each has as many neighbours as any other of its specimen."""
    edges = nearest(cells, k, keep=keep)
    one_way = edges.groupBy("specimen", F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.count("*").alias("m"))
    mutual = one_way.groupBy("specimen").agg(F.sum(F.when(F.col("m") == 2, 2).otherwise(0)).cast("double").alias("rec"))
    inward = edges.groupBy("specimen", "b").agg(F.count("*").cast("double").alias("i")).groupBy("specimen").agg(F.sum(F.col("i") * F.col("i")).alias("ii"))
    own = edges.groupBy("specimen").agg(F.count("*").cast("double").alias("s0"), F.max("rank").cast("double").alias("degree"))
    all_ = own.join(mutual, "specimen").join(inward, "specimen")
    by_degree = (F.col("s0") * F.col("degree")).alias
    return NeighbourGraph(edges, stored(all_.select("specimen", "s0", "rec", by_degree("oo"), "ii", by_degree("oi"), "degree")))


def _long(wide: DataFrame, names: Sequence[str], fields: Mapping[str, Callable[[str], Column]], key: str) -> DataFrame:
    """(specimen, key, <field>...): one row for each specimen and name."""
    rows = F.array(*(F.struct(F.lit(n).alias(key), *(f(n).alias(c) for c, f in fields.items())) for n in names))
    return wide.select("specimen", F.explode(rows).alias("r")).select("specimen", "r.*")


def _two_labels(counts: Sequence[Column]) -> tuple[Column, Column]:
    """Of labels 0, 1, 2 with these counts the two smallest that occur; null where there are fewer."""
    have = F.filter(F.array(*(F.when(c > 0, i) for i, c in enumerate(counts))), lambda v: v.isNotNull())
    return F.get(have, F.lit(0)), F.get(have, F.lit(1))


def enrichment_batch(cells: DataFrame, graph: NeighbourGraph, requests: Mapping[str, tuple[Signature, Signature]]) -> DataFrame:
    """(specimen, request, n, observed, z, enrichment) for many pairs of phenotypes over one graph that kept `mask`.

    Cells of the first phenotype are labelled 1, those of the second among the rest 2, others 0; the two smallest labels that a specimen has are compared, as
    enrichment() does by default. All requests are sums in one pass over the edges and one over the cells.
    """
    duos = [(0, 1), (0, 2), (1, 2)]
    flag = lambda when: F.sum(F.when(when, 1).otherwise(0)).cast("double")
    label = {e: {n: labels(F.col(f"{e}mask"), pq) for n, pq in requests.items()} for e in ("", "a_", "b_")}
    sizes = cells.groupBy("specimen").agg(F.count("*").alias("n"), *(flag(label[""][n] == v).alias(f"c{v}_{n}") for n in requests for v in range(3)))
    seen = graph.edges.groupBy("specimen").agg(*(flag((label["a_"][n] == u) & (label["b_"][n] == v)).alias(f"e{u}{v}_{n}") for n in requests for u, v in duos))
    x = sizes.join(seen, "specimen", "left").join(graph.moments, "specimen", "left")
    two = {n: _two_labels([F.col(f"c{v}_{n}") for v in range(3)]) for n in requests}
    size = lambda n, end: F.get(F.array(*(F.col(f"c{v}_{n}") for v in range(3))), two[n][end])
    edges = lambda n: F.coalesce(*(F.when((two[n][0] == u) & (two[n][1] == v), F.col(f"e{u}{v}_{n}")) for u, v in duos))
    rows = _long(x.withColumn("graph", F.struct("n", *graph.moments.columns[1:])), list(requests), {"na": lambda n: size(n, 0), "nb": lambda n: size(n, 1), "observed": edges, "graph": lambda _: F.col("graph")}, "request")
    out = _enriched(rows.select("specimen", "request", "na", "nb", "observed", "graph.*"))
    return out.select("specimen", "request", "n", "observed", "z", norm_cdf("z").alias("enrichment"))


def moran_batch(cells: DataFrame, graph: NeighbourGraph, channels: Mapping[str, Sequence[Signature]], values: Sequence[str] = (), impute_zero: bool = False) -> DataFrame:
    """(specimen, channel, n, moran, p) for many channels over one graph that kept `mask` and the columns `values`.

    A channel's value is the label (see labels()) that its signatures give a cell, 1 or 0 for one signature; a column of `values` is its own. p as in moran(); impute_zero: 0 where it is null. Means and
    variances come from one pass over the cells, all sums of products of deviations from one over the edges.
    """
    of = {e: {n: labels(F.col(f"{e}mask"), s).cast("double") for n, s in channels.items()} | {v: F.col(f"{e}{v}").cast("double") for v in values} for e in ("", "a_", "b_")}
    names = list(of[""])
    stats = cells.groupBy("specimen").agg(F.count("*").cast("double").alias("n"), *(f(of[""][c]).alias(f"{k}_{c}") for c in names for k, f in (("m", F.avg), ("v", F.var_pop))))
    stats = stored(stats)  # one row for each specimen
    off = lambda e, c: of[e][c] - F.col(f"m_{c}")
    sums = graph.edges.join(stats, "specimen").groupBy("specimen").agg(*(F.sum(off("a_", c) * off("b_", c)).alias(f"zz_{c}") for c in names))
    x = stats.join(sums, "specimen", "left").join(graph.moments, "specimen", "left")
    d = F.col("degree")
    whole = {"n": F.col("n"), "s0": F.col("s0") / d, "s1": (F.col("s0") + F.col("rec")) / (d * d), "s2": (F.col("oo") + 2 * F.col("oi") + F.col("ii")) / (d * d)}
    fields = {k: (lambda _, v=v: v) for k, v in whole.items()} | {"wzz": lambda c: F.col(f"zz_{c}") / d, "var": lambda c: F.col(f"v_{c}")}
    out = _autocorrelated(_long(x, names, fields, "channel")).select("specimen", "channel", "n", "moran", "p")
    return out.fillna(0.0, ["p"]) if impute_zero else out


def _labelled_edges(cells: DataFrame, edges: DataFrame) -> DataFrame:
    own = cells.select("specimen", "structure", "label")
    a, b = (own.withColumnRenamed("structure", s).withColumnRenamed("label", f"l{s}") for s in "ab")
    return edges.join(a, ["specimen", "a"]).join(b, ["specimen", "b"])


def enrichment(cells: DataFrame, edges: DataFrame, pair: tuple[int, int] | None = None) -> DataFrame:
    """(specimen, n, observed, z, enrichment): edges from one label to another against a random dealing of labels.

    cells: (specimen, structure, label). pair: the two labels; None: the two smallest that the specimen has. z uses the exact
    moments of the count of edges under permutation; enrichment is its normal probability. Null for one label,
    for 3 cells or fewer, and without variance.
    """
    sizes = cells.groupBy("specimen", "label").agg(F.count("*").alias("c"))
    per = sizes.groupBy("specimen").agg(F.array_sort(F.collect_list(F.struct("label", "c"))).alias("l"), F.sum("c").alias("n"))
    if pair is None:
        per = per.withColumns({"one": F.get("l", F.lit(0)), "two": F.get("l", F.lit(1))})
    else:
        a, b = pair
        per = per.withColumns({"one": F.get(F.filter("l", lambda s: s.label == a), F.lit(0)), "two": F.get(F.filter("l", lambda s: s.label == b), F.lit(0))})
    per = stored(per.select("specimen", "n", F.col("one.label").alias("l1"), F.col("two.label").alias("l2"), F.col("one.c").cast("double").alias("na"), F.col("two.c").cast("double").alias("nb")))
    by_label = _labelled_edges(cells, edges).groupBy("specimen", "la", "lb").agg(F.count("*").alias("m"))
    seen = by_label.join(per.select("specimen", "l1", "l2"), "specimen")
    observed = seen.groupBy("specimen").agg(F.sum("m").cast("double").alias("s0"), F.sum(F.when((F.col("la") == F.col("l1")) & (F.col("lb") == F.col("l2")), F.col("m")).otherwise(0)).cast("double").alias("observed"))
    both_ways = edges.groupBy("specimen", F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.count("*").alias("m"))
    rec = both_ways.groupBy("specimen").agg(F.sum(F.when(F.col("m") == 2, 2).otherwise(0)).cast("double").alias("rec"))
    degrees = edges.select("specimen", F.col("a").alias("v"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("specimen", "b", F.lit(0), F.lit(1)))
    degrees = degrees.groupBy("specimen", "v").agg(F.sum("o").cast("double").alias("o"), F.sum("i").cast("double").alias("i"))
    sums = degrees.groupBy("specimen").agg(F.sum(F.col("o") * F.col("o")).alias("oo"), F.sum(F.col("i") * F.col("i")).alias("ii"), F.sum(F.col("o") * F.col("i")).alias("oi"))
    x = per.join(observed, "specimen", "left").join(rec, "specimen", "left").join(sums, "specimen", "left").fillna(0, ["rec", "observed"])
    return _enriched(x).select("specimen", "n", "observed", "z", norm_cdf("z").alias("enrichment"))


def _enriched(x: DataFrame) -> DataFrame:
    """x (n, na, nb, observed, s0, rec, oo, ii, oi, ...) with z: the exact mean and variance of the count of edges when labels are dealt anew."""
    n, a, b, s0, same = (F.col(c).cast("double") for c in ("n", "na", "nb", "s0", "s0"))
    out, inn, mixed = F.col("oo") - same, F.col("ii") - same, 2 * (F.col("oi") - F.col("rec"))
    rest = s0 * s0 - same - out - inn - mixed - F.col("rec")
    mean = s0 * a * b / (n * (n - 1))
    square = same * a * b / (n * (n - 1)) + out * a * b * (b - 1) / (n * (n - 1) * (n - 2)) + inn * a * (a - 1) * b / (n * (n - 1) * (n - 2)) + rest * a * (a - 1) * b * (b - 1) / (n * (n - 1) * (n - 2) * (n - 3))
    x = x.withColumns({"mean": F.when(n > 3, mean), "square": F.when(n > 3, square)})
    var = F.col("square") - F.col("mean") * F.col("mean")
    return x.withColumn("z", F.when(var > 1e-9, (F.col("observed") - F.col("mean")) / F.sqrt(var)))


def _pairs_of_labels(cells: DataFrame, radius: float, kept: Sequence[str]) -> DataFrame:
    """(specimen, a_<kept>..., b_<kept>..., n): ordered pairs of cells 0 < d <= radius, counted by what their ends carry. Each unordered pair is met once."""
    pairs = unordered_pairs(cells, radius, tuple(kept)).where("d2 > 0")
    n = stored(pairs.groupBy("specimen", *(f"{e}_{c}" for e in "ab" for c in kept)).agg(F.count("*").alias("n")))
    turned = n.select("specimen", *(F.col(f"{e}_{c}").alias(f"{o}_{c}") for e, o in ("ba", "ab") for c in kept), "n")
    return n.unionByName(turned)


def _ratio(both: Column, near: Column, second: Column, total: Column) -> Column:
    return F.when((near > 0) & (second > 0), (both / near) / (second / total))


def co_occurrence(cells: DataFrame, radius: float, pair: tuple[int, int] | None = None) -> DataFrame:
    """(specimen, ratio): share of the second label near the first one, over its share near any cell, pairs 0 < d <= radius.

    pair: the two labels; None: the two smallest that the specimen has.
    """
    if pair is None:
        have = cells.groupBy("specimen").agg(F.array_sort(F.collect_set("label")).alias("l")).select("specimen", F.get("l", F.lit(0)).alias("l1"), F.get("l", F.lit(1)).alias("l2"))
    else:
        have = cells.select("specimen").distinct().select("specimen", F.lit(pair[0]).alias("l1"), F.lit(pair[1]).alias("l2"))
    n = _pairs_of_labels(cells, radius, ("label",)).join(have, "specimen")
    one, two = F.col("a_label") == F.col("l1"), F.col("b_label") == F.col("l2")
    total = lambda when: F.sum(F.when(when, F.col("n")).otherwise(0))
    s = n.groupBy("specimen").agg(total(one & two).alias("both"), total(one).alias("near"), total(two).alias("second"), F.sum("n").alias("total"))
    return have.select("specimen").join(s, "specimen", "left").select("specimen", _ratio(*map(F.col, ("both", "near", "second", "total"))).alias("ratio"))


def co_occurrence_batch(cells: DataFrame, requests: Mapping[str, tuple[Signature, Signature]], radius: float) -> DataFrame:
    """(specimen, request, ratio) for many pairs of phenotypes, labelled as in enrichment_batch(), by one join of cells: pairs are counted by the labels that all requests give their ends."""
    rows = cells.select("specimen", "structure", "x", "y", *(labels(F.col("mask"), pq).alias(f"label_{n}") for n, pq in requests.items()))
    sizes = rows.groupBy("specimen").agg(*(F.sum((F.col(f"label_{n}") == v).cast("long")).alias(f"c{v}_{n}") for n in requests for v in range(3)))
    two = stored(sizes.select("specimen", *(c.alias(f"l{i}_{n}") for n in requests for i, c in enumerate(_two_labels([F.col(f"c{v}_{n}") for v in range(3)])))))
    pairs = _pairs_of_labels(rows, radius, [f"label_{n}" for n in requests]).join(two, "specimen")
    one, other = (lambda n: F.col(f"a_label_{n}") == F.col(f"l0_{n}")), (lambda n: F.col(f"b_label_{n}") == F.col(f"l1_{n}"))
    total = lambda when: F.sum(F.when(when, F.col("n")).otherwise(0))
    sums = pairs.groupBy("specimen").agg(F.sum("n").alias("total"), *(x for n in requests for x in (total(one(n) & other(n)).alias(f"both_{n}"), total(one(n)).alias(f"near_{n}"), total(other(n)).alias(f"second_{n}"))))
    wide = two.select("specimen").join(sums, "specimen", "left")
    return _long(wide, list(requests), {"ratio": lambda n: _ratio(F.col(f"both_{n}"), F.col(f"near_{n}"), F.col(f"second_{n}"), F.col("total"))}, "request")


def moran(cells: DataFrame, edges: DataFrame, value: str = "label") -> DataFrame:
    """(specimen, n, moran, p): Moran's I of a value over row-normalised neighbours; one-sided normal p, cut to ten decimals.

    p is null where it is not a number or 0, as for a constant value or fewer than 2 cells.
    """
    v = cells.select("specimen", "structure", F.col(value).cast("double").alias("v"))
    mean = stored(v.groupBy("specimen").agg(F.count("*").cast("double").alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("var")))
    z = v.join(mean, "specimen").select("specimen", "structure", (F.col("v") - F.col("m")).alias("z"))
    weight = edges.groupBy("specimen", "a").agg(F.count("*").alias("deg")).join(z.select("specimen", F.col("structure").alias("a"), F.col("z").alias("za")), ["specimen", "a"])
    w = edges.join(weight, ["specimen", "a"]).join(z.select("specimen", F.col("structure").alias("b"), F.col("z").alias("zb")), ["specimen", "b"])
    w = stored(w.select("specimen", "a", "b", (1 / F.col("deg")).alias("w"), (F.col("za") * F.col("zb") / F.col("deg")).alias("wzz")))
    inner = w.groupBy("specimen").agg(F.sum("wzz").alias("wzz"), F.sum("w").alias("s0"))
    both = w.select("specimen", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w").groupBy("specimen", "a", "b").agg(F.sum("w").alias("w"))
    s1 = both.groupBy("specimen").agg(F.sum(F.col("w") * F.col("w")).alias("s1"))  # (w_ij + w_ji)^2, each pair twice, over 2
    ends = w.select("specimen", F.col("a").alias("v"), "w").union(w.select("specimen", "b", "w")).groupBy("specimen", "v").agg(F.sum("w").alias("w"))
    s2 = ends.groupBy("specimen").agg(F.sum(F.col("w") * F.col("w")).alias("s2"))
    x = mean.join(inner, "specimen", "left").join(s1, "specimen", "left").join(s2, "specimen", "left")
    return _autocorrelated(x).select("specimen", F.col("n").cast("long").alias("n"), "moran", "p")


def _autocorrelated(x: DataFrame) -> DataFrame:
    """x (n, var, wzz, s0, s1, s2, ...) with Moran's I and its one-sided normal p under random values, cut to ten decimals; null where not a number or 0."""
    n, s0 = F.col("n"), F.col("s0")
    i = F.when((F.col("var") > 0) & (s0 > 0), F.col("wzz") / s0 / F.col("var"))
    expected = F.try_divide(F.lit(-1.0), n - 1)
    var = F.try_divide(n * n * F.col("s1") - n * F.col("s2") + 3 * s0 * s0, (n * n - 1) * s0 * s0) - expected * expected
    x = x.withColumn("moran", i).withColumn("z", F.when((n > 2) & (var > 0), (i - expected) / F.sqrt(var)))
    p = F.when(F.col("z") > 0, 1 - norm_cdf("z")).otherwise(norm_cdf("z"))
    cut = F.floor(p * 1e10) / 1e10
    return x.withColumns({"n": n.cast("long"), "p": F.when(cut > 0, cut)})


def _inside(p: np.ndarray) -> np.ndarray:
    """Whether each point lies well within the polygon of those that are farthest in sixteen directions, so that it is no corner of the hull."""
    turn = np.arange(16) * (math.pi / 8)
    far = (np.outer(np.cos(turn), p[:, 0]) + np.outer(np.sin(turn), p[:, 1])).argmax(1)
    a = p[far[far != np.roll(far, 1)]]
    if len(a) < 3:
        return np.zeros(len(p), bool)
    e = np.roll(a, -1, axis=0) - a
    left = e[:, :1] * (p[:, 1] - a[:, 1:]) - e[:, 1:] * (p[:, 0] - a[:, :1])
    return (left > 1e-9 * np.ptp(p, axis=0).max() ** 2).all(0)


def _hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, in order (monotone chain)."""
    p = np.unique(points, axis=0)
    if len(p) > 64:
        p = p[~_inside(p)]
    if len(p) < 3:
        return p

    def half(rows):
        out: list = []
        for q in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]))


def convex_hulls(cells: DataFrame) -> DataFrame:
    """(specimen, hull): a hull of each specimen's part in a partition, then the hull of those corners: few points travel."""
    schema = "specimen long, x double, y double"

    def partial(batches):
        for batch in batches:
            for s, g in batch.groupby("specimen"):
                h = _hull(g[["x", "y"]].to_numpy(float))
                yield pd.DataFrame({"specimen": s, "x": h[:, 0], "y": h[:, 1]})

    def whole(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        h = _hull(group[["x", "y"]].to_numpy(float))
        return pd.DataFrame({"specimen": [key[0]], "hull": [h.ravel().tolist()]})

    corners = cells.select("specimen", "x", "y").mapInPandas(partial, schema)
    return corners.groupBy("specimen").applyInPandas(whole, "specimen long, hull array<double>")


def ripley_f(cells: DataFrame, label: int | None = None, steps: int = 100, simulations: int = 100, points: int = 1000, seed: int = 0) -> DataFrame:
    """(specimen, radius, area): Ripley's F of a label's cells: how far random points of the hull are from them.

    F of a distance is the share of the distances from `points` random points to their two nearest cells that are no larger, among those up to a quarter of
    sqrt(area / 2). p of a distance is the share of patterns whose F is less than the observed, which counts as one of them; a simulated pattern is
    `points` uniform points of the hull, of which only the nearest to each of the same random points counts. The summary is
    sum(p * distance) / sum(p), to one decimal. label None: the smallest that the specimen has. Null without two cells of the label or an area.

    A specimen of SHARE cells at most is one group, which does all; the cells of larger ones meet the random points in grid bins, so a specimen of any size
    spreads, and TURNS simulations are a row, which holds two fixed numbers of points. Seeded by specimen and simulation.
    """
    cells, few, some = _by_size(cells)
    found = _ripley_few(few, some, "F", label, steps, simulations, points, seed).select("specimen", "area", "hit")
    found = found if cells is None else found.union(_f_of_many(cells, label, steps, simulations, points, seed))
    lower = found.select("specimen", "area", F.posexplode("hit").alias("at", "hits"))
    p, distance = (1 + F.col("hits")) / (simulations + 1), F.col("at") * F.sqrt(F.col("area") / 2) / 4 / (steps - 1)
    summary = lower.groupBy("specimen").agg(F.round(F.sum(p * distance) / F.sum(p), 1).alias("radius"))
    return found.select("specimen", "area").join(summary, "specimen", "left").select("specimen", "radius", "area")


def _by_size(cells: DataFrame) -> tuple[DataFrame | None, DataFrame, int]:
    """(cells of specimens of more than SHARE cells, or None; the other cells; the other specimens' number), of specimen, structure, x, y, label. Structures are numbered
    anew: what is asked of them is only that they differ."""
    cells = stored(cells.where("specimen is not null").select("specimen", F.monotonically_increasing_id().alias("structure"), "x", "y", "label"))
    sizes = stored(cells.groupBy("specimen").agg((F.count("*") > SHARE).alias("many")))
    some, many = sizes.where("not many").count(), sizes.where("many").select("specimen")
    if not many.limit(1).count():
        return None, cells, some
    return stored(cells.join(many, "specimen", "left_semi")), cells.join(many, "specimen", "left_anti"), some


def _ripley_few(cells: DataFrame, n: int, mode: str, label: int | None, steps: int, simulations: int, points: int, seed: int) -> DataFrame:
    """(specimen, area, observed, hit): of each of n specimens, a group each, the observed curve of Ripley's F, G or L and at each of its distances the number of simulated
    patterns with a lower one. Both are null without an area or enough cells."""

    def observed(at: np.ndarray, mine: np.ndarray, other: np.ndarray, asked: np.ndarray, area: float, edges: np.ndarray) -> np.ndarray:
        if mode == "F":
            return _f_curve(_to_nearest(asked, at[mine], 2 * math.sqrt(area / mine.sum()), 2), edges)
        bins, width = steps - 1, math.sqrt(area / 2) / 4 / (steps - 1)
        if mode == "G":
            d = _to_nearest(at[other], at[mine], 2 * math.sqrt(area / mine.sum()), 2) if other.any() else np.zeros((0, 2))
            bin_ = np.floor(d / width)
            bin_[(bin_ == bins) & (d <= width * bins)] = bins - 1  # the last bin is closed
            below = np.cumsum(np.bincount(bin_[bin_ < bins].astype(int), minlength=bins))
            return np.concatenate([[0], below]) / (below[-1] or math.nan)
        counts = np.zeros(bins, int)
        for d2 in _pairs_within(at[mine], width * bins):
            bin_ = np.floor(np.sqrt(d2) / width)
            counts += np.bincount(bin_[bin_ < bins].astype(int), minlength=bins)
        return _levels(np.concatenate([[0], np.cumsum(counts)]), len(at), area)

    def whole(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        at, labels = group[["x", "y"]].to_numpy(float), group["label"]
        hull = _hull(at)
        area, mine = _area(hull), (labels == (labels.min() if label is None else label)).to_numpy(bool)
        other, curve, hit = ~(mine | labels.isna().to_numpy()), None, None
        if area > 0 and mine.sum() > 1 and (mode != "G" or mine.sum() < len(at)):
            edges = np.linspace(0, math.sqrt(area / 2) / 4, steps)
            asked = {"F": lambda: _uniform(hull, points, [seed, int(key[0])]), "G": lambda: at, "L": lambda: at[:0]}[mode]()
            curve = observed(at, mine, other, asked, area, edges)
            hit = _lower(mode, int(key[0]), hull, area, asked, len(at), curve, range(simulations), points, seed).tolist()
            curve = [None if math.isnan(v) else v for v in curve.tolist()]
        return pd.DataFrame({"specimen": [key[0]], "area": [area], "observed": [curve], "hit": [hit]})

    rows = _spread(cells.select("specimen", "x", "y", "label"), n, "specimen")
    return stored(rows.groupBy("specimen").applyInPandas(whole, "specimen long, area double, observed array<double>, hit array<int>"))


def _lower(mode: str, specimen: int, hull: np.ndarray, area: float, at: np.ndarray, n: int, curve: np.ndarray, turns: range, points: int, seed: int) -> np.ndarray:
    """At each distance of a curve of Ripley's F, G or L the number of a specimen's simulated patterns, of these turns, with a lower one."""
    grid, reach, hits = _Grid.of(hull, area, points), math.sqrt(area / 2) / 4, np.zeros(len(curve), int)
    at_once = max(1, min(TURNS, (1 << 16) // max(points, len(at))))
    for first in range(turns.start, turns.stop, at_once):
        x, y = _uniform_each(hull, points, [[seed, specimen, t + 1] for t in range(first, min(first + at_once, turns.stop))])
        if mode == "L":
            hits += _lower_levels(x, y, grid, reach, len(curve) - 1, lambda pairs: _levels(pairs, n, area), curve)
        else:
            hits += _lower_shares(at, x, y, area, grid, np.linspace(0, reach, len(curve)), curve)
    return hits


def _levels(pairs: np.ndarray, n: int, area: float) -> np.ndarray:
    """Ripley's L of pairs by distance in a specimen of n cells."""
    return np.sqrt(2 * pairs / n / n * area / math.pi)


def _f_of_many(cells: DataFrame, label: int | None, steps: int, simulations: int, points: int, seed: int) -> DataFrame:
    """(specimen, area, hit) as _ripley_few() has it for F, of specimens of any size."""
    own = cells.where(F.col("label") == label) if label is not None else cells.join(cells.groupBy("specimen").agg(F.min("label").alias("least")), "specimen").where("label = least")
    own = stored(own.select("specimen", "structure", "x", "y"))

    @F.pandas_udf("double")
    def area(hull: pd.Series) -> pd.Series:
        return hull.map(lambda h: _area(np.reshape(h, (-1, 2)))).astype(float)

    @F.pandas_udf("array<array<double>>")
    def probes(specimen: pd.Series, hull: pd.Series) -> pd.Series:
        return pd.Series([_uniform(np.reshape(h, (-1, 2)), points, [seed, int(s)]).tolist() for s, h in zip(specimen, hull, strict=True)])

    hulls = stored(convex_hulls(cells).withColumn("area", area("hull")))
    used = hulls.where("area > 0").join(own.groupBy("specimen").count().where("count > 1"), "specimen", "left_semi")
    asked = used.select("specimen", F.posexplode(probes("specimen", "hull")).alias("at", "p")).select("specimen", (-1 - F.col("at")).cast("long").alias("structure"), F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))
    distances = nearest(own, 2, queries=asked).groupBy("specimen").agg(F.collect_list(F.sqrt("d2")).alias("d"))  # 2 * points of them

    @F.pandas_udf("array<double>")
    def curve(area: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([_f_curve(np.asarray(own), np.linspace(0, math.sqrt(a / 2) / 4, steps)).tolist() for a, own in zip(area, d, strict=True)])

    @F.pandas_udf("array<int>")
    def below(specimen: pd.Series, hull: pd.Series, area: pd.Series, observed: pd.Series, first: pd.Series) -> pd.Series:
        out = []
        for s, h, a, own, at in zip(specimen, hull, area, observed, first, strict=True):
            h = np.reshape(h, (-1, 2))
            out.append(_lower("F", int(s), h, a, _uniform(h, points, [seed, int(s)]), 0, own, range(int(at), min(int(at) + TURNS, simulations)), points, seed).tolist())
        return pd.Series(out)

    used = stored(used.join(distances, "specimen").select("specimen", "hull", "area", curve("area", "d").alias("observed")))
    rows = used.withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(simulations - 1), F.lit(TURNS))))
    rows = _spread(rows, used.count() * -(-simulations // TURNS), "specimen", "first")
    hits = rows.select("specimen", "area", below("specimen", "hull", "area", "observed", "first").alias("hit")).groupBy("specimen", "area").agg(_sums("hit", steps).alias("hit"))
    return stored(hulls.select("specimen", "area").join(hits.drop("area"), "specimen", "left"))


def pair_distance_counts(cells: DataFrame, width: float | str, bins: int) -> DataFrame:
    """(specimen, bin, pairs): unordered pairs of a specimen's cells whose distance lies in [bin, bin + 1) widths, for bins from 0.

    width: a number, or the name of a column with one for each specimen. Pairs are counted where the join makes them; none is kept. Their number is what grows with the
    square of the density: that is the statistic.
    """
    sized = cells.select("specimen", "structure", "x", "y", (F.col(width) if isinstance(width, str) else F.lit(float(width))).alias("width_")).withColumn("reach_", F.col("width_") * bins)
    pairs = unordered_pairs(sized, "reach_", ("width_",)).select("specimen", F.floor(F.sqrt("d2") / F.col("a_width_")).cast("int").alias("bin"))
    return pairs.where(F.col("bin") < bins).groupBy("specimen", "bin").agg(F.count("*").alias("pairs"))


def ripley_gl(cells: DataFrame, mode: str, label: int | None = None, steps: int = 100, simulations: int = 100, points: int = 1000, seed: int = 0) -> DataFrame:
    """(specimen, at, distance, observed, p): Ripley's G or L of a label's cells at `steps` distances up to a quarter of sqrt(area / 2), at from 0.

    G: the share, among the distances of all other cells to their two nearest cells of the label that lie in that range, of those below a distance. L: sqrt(K / pi),
    K = 2 * pairs of the label's cells nearer than the distance * area / n^2, n all cells of the specimen. A simulated pattern is `points` uniform points of the hull: for G the
    distances are those of all cells to its nearest point, for L those among its points. p: as in ripley_f(). label None: the smallest that the specimen has.
    Specimens without an area, two cells of the label or (G) another cell give no rows.

    A specimen of SHARE cells at most is one group, which does all. Of larger ones the observed distances come from the joins of the neighbour search and of pairs; only
    counts by distance travel. Their simulations are dealt to tasks by specimen and TURNS turns (L) or by SHARE cells at most (G), whose counts are added up; they meet
    the observed curve as arrays, one for each turn (G) or TURNS turns (L).
    """
    if mode not in ("G", "L"):
        raise ValueError(f"no mode {mode!r}")
    cells, few, some = _by_size(cells)
    found = _ripley_few(few, some, mode, label, steps, simulations, points, seed).select("specimen", "area", F.posexplode(F.arrays_zip("observed", "hit")).alias("at", "e"))
    width = F.sqrt(F.col("area") / 2) / 4 / (steps - 1)
    found = found.select("specimen", "at", (F.col("at") * width).alias("distance"), "e.observed", ((1 + F.col("e.hit")) / (simulations + 1)).alias("p"))
    return found if cells is None else found.union(_gl_of_many(cells, mode, label, steps, simulations, points, seed))


def _gl_of_many(cells: DataFrame, mode: str, label: int | None, steps: int, simulations: int, points: int, seed: int) -> DataFrame:
    """ripley_gl() of specimens of any size."""
    least = cells.groupBy("specimen").agg(F.min("label").alias("least"), F.count("*").alias("n"))
    marked = stored(cells.join(least, "specimen").select("specimen", "structure", "x", "y", (F.col("label") == (F.lit(label) if label is not None else F.col("least"))).alias("own"), "n"))

    @F.pandas_udf("double")
    def area(hull: pd.Series) -> pd.Series:
        return hull.map(lambda h: _area(np.reshape(h, (-1, 2)))).astype(float)

    some = marked.groupBy("specimen").agg(F.sum(F.col("own").cast("int")).alias("mine"), F.max("n").alias("n"))
    some = some.where("mine > 1 and mine < n" if mode == "G" else "mine > 1")
    frame = convex_hulls(cells).withColumn("area", area("hull")).where("area > 0").join(some.select("specimen", "n"), "specimen")
    frame = stored(frame.withColumn("width", F.sqrt(F.col("area") / 2) / 4 / (steps - 1)))
    bins = steps - 1
    own = marked.where("own").join(frame.select("specimen", "width"), "specimen")
    last = lambda b, d, w: F.when((b == bins) & (d <= w * bins), bins - 1).otherwise(b)  # noqa: E731  the last bin is closed
    if mode == "L":
        counts = pair_distance_counts(own, "width", bins).withColumnRenamed("pairs", "c")
    else:
        others = marked.where(~F.col("own")).join(frame.select("specimen"), "specimen", "left_semi")
        near = nearest(own, 2, queries=others).join(frame.select("specimen", "width"), "specimen")
        d = F.sqrt("d2")
        counts = near.select("specimen", last(F.floor(d / F.col("width")).cast("int"), d, F.col("width")).alias("bin")).where(F.col("bin") < bins).groupBy("specimen", "bin").agg(F.count("*").alias("c"))
    observed = frame.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(bins)))).join(counts.withColumnRenamed("bin", "at_"), "specimen", "left")
    below = F.sum(F.when(F.col("at_") < F.col("at"), F.col("c")).otherwise(0)).cast("double")
    observed = observed.groupBy("specimen", "at", "n", "area", "width").agg(below.alias("below"), F.coalesce(F.sum("c"), F.lit(0)).cast("double").alias("all"))
    value = F.sqrt(2 * F.col("below") / F.col("n") / F.col("n") * F.col("area") / math.pi) if mode == "L" else F.try_divide("below", "all")
    observed = stored(observed.select("specimen", "at", (F.col("at") * F.col("width")).alias("distance"), value.alias("observed")))

    curves = observed.groupBy("specimen").agg(F.array_sort(F.collect_list(F.struct("at", "observed"))).alias("l")).select("specimen", F.col("l.observed").alias("observed"))

    @F.pandas_udf("array<int>")
    def among(specimen: pd.Series, hull: pd.Series, n: pd.Series, area: pd.Series, observed: pd.Series, first: pd.Series) -> pd.Series:
        out = []
        for s, h, m, a, own, at in zip(specimen, hull, n, area, observed, first, strict=True):
            turns = range(int(at), min(int(at) + TURNS, simulations))
            out.append(_lower("L", int(s), np.reshape(h, (-1, 2)), a, np.zeros((0, 2)), int(m), own, turns, points, seed).tolist())
        return pd.Series(out)

    def around(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame(columns=["specimen", "turn", "c"])
        s, reach = right["specimen"].iloc[0], right["width"].iloc[0] * bins
        hull, edges, at = np.reshape(right["hull"].iloc[0], (-1, 2)), np.linspace(0, reach, steps), left[["x", "y"]].to_numpy(float)
        near = 1.5 * math.sqrt(right["area"].iloc[0] / points)
        counts = [np.histogram(_to_nearest(at, _uniform(hull, points, [seed, int(s), t + 1]), near), edges)[0] for t in range(simulations)]
        return pd.DataFrame({"specimen": s, "turn": range(simulations), "c": counts})

    @F.pandas_udf("array<int>")
    def grown(counts: pd.Series, observed: pd.Series) -> pd.Series:
        if not len(counts):
            return pd.Series([], dtype=object)
        below = np.cumsum(np.vstack(counts), axis=1)
        with np.errstate(invalid="ignore"):
            hits = np.pad(below, ((0, 0), (1, 0))) / below[:, -1:] < np.vstack(observed).astype(float)
        return pd.Series(list(hits.astype(np.int32)))

    if mode == "L":
        turns = frame.join(curves, "specimen").withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(simulations - 1), F.lit(TURNS))))
        turns = _spread(turns, frame.count() * -(-simulations // TURNS), "specimen", "first")
        hits = turns.select("specimen", among("specimen", "hull", "n", "area", "observed", "first").alias("hit"))
    else:
        shares = F.ceil(F.col("n") / SHARE).cast("int")
        spread = marked.select("specimen", "x", "y", F.pmod(F.xxhash64("structure"), shares).cast("int").alias("share"))
        frames = frame.withColumn("share", F.explode(F.sequence(F.lit(0), shares - 1))).select("specimen", "share", "hull", "area", "width")
        n = frames.count()
        spread, frames = (_spread(d, n, "specimen", "share") for d in (spread, frames))
        c = spread.groupBy("specimen", "share").cogroup(frames.groupBy("specimen", "share")).applyInPandas(around, "specimen long, turn int, c array<long>")
        c = c.groupBy("specimen", "turn").agg(_sums("c", bins).alias("c"))
        hits = c.join(curves, "specimen").select("specimen", grown("c", "observed").alias("hit"))
    hits = hits.groupBy("specimen").agg(_sums("hit", steps).alias("hit")).select("specimen", F.posexplode("hit").alias("at", "hits"))
    return observed.join(hits, ["specimen", "at"], "left").select("specimen", "at", "distance", "observed", ((1 + F.coalesce("hits", F.lit(0))) / (simulations + 1)).alias("p"))


def ripley_summary(curves: DataFrame) -> DataFrame:
    """(specimen, radius) of ripley_gl(): the distances' mean weighted by p, to one decimal."""
    return curves.groupBy("specimen").agg(F.round(F.sum(F.col("p") * F.col("distance")) / F.sum("p"), 1).alias("radius"))


def _spread(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """rows dealt by their keys, of which there are n: a key's work is long and its rows are few bytes, so the number of tasks follows the keys and the cores, not bytes."""
    return rows.repartition(max(1, min(-(-n // 4), 16 * rows.sparkSession.sparkContext.defaultParallelism)), *keys)


def _sums(column: str, n: int) -> Column:
    """The sums of each of the n elements of an array column."""
    return F.array(*(F.sum(F.get(column, F.lit(i))) for i in range(n)))


def _squares_between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d, dy = a[:, :1] - b[:, 0], a[:, 1:] - b[:, 1]
    d *= d
    dy *= dy
    d += dy
    return d


def _pairs_by_distance(pattern: np.ndarray, reach: float, bins: int, most: int | None = None) -> np.ndarray:
    """Pairs of points nearer than `reach`, counted in equal bins of distance (most: in the first ones only). Points that stand close in x meet those after them in x
    within reach."""
    total, most = np.zeros(bins, int), bins if most is None else most
    for d2 in _pairs_within(pattern, reach * most / bins):
        at = (np.sqrt(d2[d2 < reach * reach]) * (bins / reach)).astype(int)
        total += np.bincount(np.minimum(at, bins - 1), minlength=bins)
    return total[:most]


def _pairs_within(points: np.ndarray, reach: float) -> Iterator[np.ndarray]:
    """The squared distances of all pairs nearer than reach and of some no farther than a hair beyond it, each pair once, in parts."""
    points, reach = points[np.argsort(points[:, 0], kind="stable")], reach * (1 + 1e-9)
    for i in range(0, len(points), 64):
        block = points[i : i + 64]
        d2 = _squares_between(block, points[i : np.searchsorted(points[:, 0], block[-1, 0] + reach, side="right")])
        d2[:, : len(block)][np.tri(len(block), dtype=bool)] = np.inf  # each pair of the block once
        yield d2[d2 <= reach * reach]


def _to_nearest(at: np.ndarray, pattern: np.ndarray, reach: float, k: int = 1) -> np.ndarray:
    """The distance of each point to the nearest of the pattern (k > 1: to the k nearest, a column each, infinite where there are fewer). Points that stand close in x
    meet the part of the pattern within `reach` in x of them; those with fewer than k so near meet the whole."""
    order, pattern = np.argsort(at[:, 0], kind="stable"), pattern[np.argsort(pattern[:, 0], kind="stable")]
    out = np.full((len(at), k), np.inf)

    def least(part: np.ndarray, among: np.ndarray) -> np.ndarray:
        d2 = _squares_between(at[part], among)
        if k == 1:
            return d2.min(1, keepdims=True)
        n = min(k, len(among))
        return np.pad(np.partition(d2, n - 1, axis=1)[:, :n], ((0, 0), (0, k - n)), constant_values=np.inf)

    for part in np.array_split(order, max(1, len(at) // 64)):
        low, high = np.searchsorted(pattern[:, 0], [at[part[0], 0] - reach, at[part[-1], 0] + reach])
        if high > low:
            out[part] = least(part, pattern[low:high])
    far = np.flatnonzero(out.max(1) > reach * reach)
    for part in np.array_split(far, max(1, len(far) // 64)):
        if len(part):
            out[part] = least(part, pattern)
    return np.sqrt(out[:, 0] if k == 1 else out)


#: Squares of a grid in either direction at most, so that a byte numbers them all, and points that a square of the grid has on the mean.
ACROSS, WITHIN = 15, 9


class _Grid(NamedTuple):
    """Squares of a frame, of WITHIN of the frame's points each if these are spread over its area."""

    low: np.ndarray
    side: np.ndarray
    count: np.ndarray

    @classmethod
    def of(cls, hull: np.ndarray, area: float, points: int) -> _Grid:
        low, extent = hull.min(0), np.ptp(hull, axis=0)
        count = np.clip(extent / math.sqrt(area * WITHIN / points), 1, ACROSS).astype(int)
        return cls(low, extent / count, count)

    def square(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        i, j = (np.clip(((v - self.low[c]) / self.side[c]).astype(np.int16), 0, self.count[c] - 1) for c, v in enumerate((x, y)))
        return (i * np.int16(self.count[1]) + j).astype(np.uint8)  # sorted by counting


def _near_some(at: np.ndarray, x: np.ndarray, y: np.ndarray, grid: _Grid) -> np.ndarray:
    """For each pattern, a row of x and of y, the distance of each point to the nearest of the pattern's in its own square: no less than to the nearest of all. Infinite
    where there is none."""
    turns, (kinds, own) = len(x), np.unique(grid.square(at[:, 0], at[:, 1]), return_inverse=True)
    known = np.full(grid.count.prod(), len(kinds), np.uint8)  # squares without any of `at` come last
    known[kinds] = np.arange(len(kinds))
    square = known[grid.square(x, y)]
    first = np.arange(0, x.size, x.shape[1])[:, None]
    order = (np.argsort(square, axis=1, kind="stable") + first).ravel()
    square, turn = square.ravel()[order], np.repeat(np.arange(turns), x.shape[1])
    count = np.bincount(square + turn * (len(kinds) + 1), minlength=turns * (len(kinds) + 1)).reshape(turns, -1)
    depth = count.max(0)
    ends, base = np.cumsum(count, axis=1), np.cumsum(depth) - depth
    to = ((base - ends + count - first)[turn, square] + np.arange(x.size)) * turns + turn
    px, py = (np.full(int(depth.sum()) * turns, np.inf) for _ in "xy")
    px[to], py[to] = x.ravel()[order], y.ravel()[order]
    px, py = px.reshape(-1, 1, turns), py.reshape(-1, 1, turns)
    out = np.full((len(at), turns), np.inf)
    for b, n, mine in zip(base, depth, np.split(np.argsort(own, kind="stable"), np.cumsum(np.bincount(own))[:-1])):
        step = max(1, (1 << 16) // max(1, int(n) * turns))
        for part in (mine[i : i + step] for i in range(0, len(mine) if n else 0, step)):
            d, dy = px[b : b + n] - at[part, :1], py[b : b + n] - at[part, 1:]
            d *= d
            dy *= dy
            d += dy
            out[part] = d.min(0)
    return np.sqrt(out).T


def _bins(d: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The bin of each distance as np.histogram() has it, whose last is closed; the number of bins for those beyond. edges are equally wide, from 0."""
    n = len(edges) - 1
    at = np.minimum(d * (n / edges[-1]), n).astype(int)  # at most one off
    at -= d < edges[at]
    at += (at < n) & (d >= edges[np.minimum(at + 1, n)])
    return at - (d == edges[n])


def _lower_shares(at: np.ndarray, x: np.ndarray, y: np.ndarray, area: float, grid: _Grid, edges: np.ndarray, own: np.ndarray) -> np.ndarray:
    """At each edge the number of patterns (rows of x and y) for which _f_curve() of the distances from `at` to their nearest point is lower than `own`.

    Distances to the nearest point of the same square are upper bounds, which give least shares. Where such a share is not lower than own, the share is not
    either; from the first other edge on, the distances that are not surely below it are found as they are.
    """
    above, bins = _near_some(at, x, y, grid), len(edges) - 1
    bin_ = _bins(above, edges)
    rows = np.arange(len(x))[:, None] * len(edges)
    counts = np.bincount((bin_ + rows).ravel(), minlength=len(x) * len(edges)).reshape(len(x), -1)
    below = lambda c: np.pad(np.cumsum(c[:, :bins], axis=1), ((0, 0), (1, 0)))
    unsure = below(counts) / len(at) < own
    unsure[:, -1] = False  # all of the distances within the edges: 1
    some = np.flatnonzero(unsure.any(1))
    if not len(some):
        return np.zeros(len(edges), int)
    first, near = unsure[some].argmax(1), 1.5 * math.sqrt(area / x.shape[1])
    turn, point = np.nonzero(bin_[some] >= first[:, None])
    exact, few = np.empty(len(turn)), np.bincount(turn, minlength=len(some)) < 32
    for t in np.flatnonzero(~few):
        exact[turn == t] = _to_nearest(at[point[turn == t]], np.stack([x[some[t]], y[some[t]]], 1), near)
    for part in np.array_split(few_ := np.flatnonzero(few[turn]), len(few_) // 64 + 1):
        d, dy = x[some[turn[part]]] - at[point[part], :1], y[some[turn[part]]] - at[point[part], 1:]
        d *= d
        dy *= dy
        d += dy
        exact[part] = np.sqrt(d.min(1))
    c = counts[some]
    np.subtract.at(c, (turn, bin_[some[turn], point]), 1)
    np.add.at(c, (turn, _bins(exact, edges)), 1)
    c = below(c)
    with np.errstate(invalid="ignore"):
        lower = c / c[:, -1:] < own
    return (lower & (np.arange(len(edges)) >= first[:, None])).sum(0)


#: Points after each one, by squares, that meet it before all do.
AFTER = 3


def _lower_levels(x: np.ndarray, y: np.ndarray, grid: _Grid, reach: float, bins: int, level: Callable[[np.ndarray], np.ndarray], own: np.ndarray) -> np.ndarray:
    """At each edge the number of patterns (rows of x and y) whose level() of the pairs nearer than it is lower than `own`.

    level() does not fall with the pairs. So where some of the pairs, those of points that follow each other by squares, give no lower level than own, all do not; up to the
    last other edge all pairs are counted.
    """
    order = np.argsort(grid.square(x, y), axis=1, kind="stable") + np.arange(0, x.size, x.shape[1])[:, None]
    sx, sy = x.ravel()[order], y.ravel()[order]
    least, turn, hits = np.zeros(len(x) * bins, int), np.arange(len(x))[:, None] * bins, np.zeros(bins + 1, int)
    for after in range(1, min(AFTER, x.shape[1] - 1) + 1):
        d, dy = sx[:, after:] - sx[:, :-after], sy[:, after:] - sy[:, :-after]
        d *= d
        dy *= dy
        d += dy
        at = (np.sqrt(d) * (bins / reach * (1 + 1e-9))).astype(int)
        least += np.bincount((at + turn)[at < bins], minlength=len(least))
    unsure = level(np.pad(np.cumsum(least.reshape(-1, bins), axis=1), ((0, 0), (1, 0)))) < own
    for t in np.flatnonzero(unsure.any(1)):
        last = bins - int(unsure[t][::-1].argmax())
        pairs = _pairs_by_distance(np.stack([x[t], y[t]], 1), reach, bins, last)
        hits[: last + 1] += (level(np.concatenate([[0], np.cumsum(pairs)])) < own[: last + 1])
    return hits


def _area(h: np.ndarray) -> float:
    x, y = h[:, 0], h[:, 1]
    return abs(float(x @ np.roll(y, -1) - y @ np.roll(x, -1))) / 2 if len(h) > 2 else 0.0


def _uniform(h: np.ndarray, n: int, seed: list[int]) -> np.ndarray:
    """n uniform points of a convex polygon: of a triangle of its fan in proportion to area, then within it."""
    return np.stack([v[0] for v in _uniform_each(h, n, [seed])], 1)


def _uniform_each(h: np.ndarray, n: int, seeds: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """x and y of _uniform() for each seed, a row each."""
    one, two = h[1:-1] - h[0], h[2:] - h[0]
    size = np.abs(one[:, 0] * two[:, 1] - one[:, 1] * two[:, 0])
    upto = np.cumsum(size / size.sum())
    upto /= upto[-1]
    drawn = np.empty((len(seeds), 3 * n))
    for seed, row in zip(seeds, drawn, strict=True):
        np.random.default_rng([abs(v) for v in seed]).random(out=row)
    t = upto.searchsorted(drawn[:, :n], side="right")
    u, v = drawn[:, n::2].copy(), drawn[:, n + 1 :: 2].copy()
    turned = u + v > 1
    for w in (u, v):
        np.subtract(1, w, out=w, where=turned)
    out = []
    for at, a, b in zip(h[0], one.T, two.T, strict=True):
        to, add = a.take(t), b.take(t)
        to *= u
        to += at
        add *= v
        to += add
        out.append(to)
    return tuple(out)


def _f_curve(distances: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """At each bin's edge the share of the distances in the bins that lie below it; 0 at the first; NaN if none lies in them."""
    counts = np.histogram(distances, bins)[0]
    with np.errstate(invalid="ignore"):
        return np.concatenate([[0.0], np.cumsum(counts) / counts.sum()])


def region_enrichment_counts(cells: DataFrame, region: Column, phenotype: Signature) -> DataFrame:
    """(specimen, a, b, c, d): cells in and out of a region by cells of a phenotype or not, for Fisher's test."""
    hit = matches(F.col("mask"), *phenotype)
    count = lambda when: F.sum(F.when(when, 1).otherwise(0)).cast("long")
    return cells.groupBy("specimen").agg(count(region & hit).alias("a"), count(region & ~hit).alias("b"), count(~region & hit).alias("c"), count(~region & ~hit).alias("d"))
