"""Neighbours in the plane, per specimen, by joins on grid bins: within a radius, k nearest, one-to-one matches."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Cells in a leaf of the quadtree at most (where it can still be split), levels of the tree, and levels that one round of counting looks ahead.
LEAF_CELLS, DEPTH, AHEAD = 1024, 18, 3
#: Cells that one task compares with a leaf at a time in the second round.
QUERIES = 1 << 15
#: Cells whose leaves a task takes in at a time in the first round, and cells in a square of a leaf's grid, both about.
BUNDLE, FILL = 1 << 15, 4
#: Slack of borders, in sides of the root: what rounding may do to a position's bin.
SLACK = 1e-9
#: Session setting under which Spark deletes a query's shuffle files when the query ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def new_folder(spark: SparkSession) -> str:
    """The path of a new folder in the cluster's shared one, spark.checkpoint.dir. Where that is unset, a temporary folder serves if all
    tasks run in this process; elsewhere that is an error, as machines would not see each other's files."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{(folder or tempfile.gettempdir()).rstrip('/')}/cells-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df written to a new shared folder and read back, so that loops start from short plans and real sizes."""
    spark = df.sparkSession
    path, before = new_folder(spark), spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def squared_distance(xa: str, ya: str, xb: str, yb: str) -> Column:
    """In doubles: exact for whole positions that lie up to 2^26 apart, where 32-bit integers would overflow from 2^15 on."""
    dx, dy = (F.col(a).cast("double") - F.col(b).cast("double") for a, b in ((xa, xb), (ya, yb)))
    return dx * dx + dy * dy


def _around(points: DataFrame) -> DataFrame:
    """Each point once for each of the nine bins around its own."""
    step = F.array(*(F.lit(i) for i in (-1, 0, 1)))
    return points.withColumn("i_", F.explode(step)).withColumn("j_", F.explode(step)).withColumns({"bx": F.col("bx") + F.col("i_"), "by": F.col("by") + F.col("j_")}).drop("i_", "j_")


def radius_pairs(left: DataFrame, right: DataFrame, radius: float, keep_left: tuple = (), keep_right: tuple = ()) -> DataFrame:
    """(specimen, a, b, d2, kept columns): cells of left and right of one specimen at distance <= radius, a cell with itself too.

    Both sides: (specimen, structure, x, y, ...). Bins of side radius are the join key, so a large specimen spreads over many
    tasks; only the right side is repeated, nine times. Squared distances of integer positions are exact.
    """
    side = float(radius)

    def binned(d: DataFrame, name: str, keep: tuple) -> DataFrame:
        return d.select("specimen", F.col("structure").alias(name), F.col("x").alias(f"x{name}"), F.col("y").alias(f"y{name}"), *keep, F.floor(F.col("x") / side).alias("bx"), F.floor(F.col("y") / side).alias("by"))

    pairs = binned(left, "a", keep_left).join(_around(binned(right, "b", keep_right)), ["specimen", "bx", "by"])
    pairs = pairs.withColumn("d2", squared_distance("xa", "ya", "xb", "yb")).where(F.col("d2") <= radius * radius)
    return pairs.select("specimen", "a", "b", "d2", *keep_left, *keep_right)


def unordered_pairs(cells: DataFrame, radius: float | str, keep: tuple = ()) -> DataFrame:
    """(specimen, a, b, d2, a_<kept>..., b_<kept>...): each pair of different cells of a specimen at distance <= radius once, in either order.

    radius: a number, or the name of a column with one for each specimen. As radius_pairs(), but a cell is repeated five times only: for its own bin and for four
    of the eight around it.
    """
    rows = stored(cells.select("specimen", "structure", "x", "y", (F.col(radius) if isinstance(radius, str) else F.lit(float(radius))).alias("side_"), *keep))  # read twice
    side = F.col("side_")
    name = lambda e: rows.select("specimen", F.col("structure").alias(e), F.col("x").alias(f"x{e}"), F.col("y").alias(f"y{e}"), *(F.col(c).alias(f"{e}_{c}") for c in keep), F.floor(F.col("x") / side).alias("bx"), F.floor(F.col("y") / side).alias("by"), *(["side_"] if e == "a" else []))
    step = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 0), (1, 0), (-1, 1), (0, 1), (1, 1)))))
    right = name("b").withColumn("s_", step).withColumns({"bx": F.col("bx") + F.col("s_.i"), "by": F.col("by") + F.col("s_.j"), "own_": (F.col("s_.i") == 0) & (F.col("s_.j") == 0)}).drop("s_")
    pairs = name("a").join(right, ["specimen", "bx", "by"]).where(~F.col("own_") | (F.col("a") < F.col("b")))
    pairs = pairs.withColumn("d2", squared_distance("xa", "ya", "xb", "yb")).where(F.col("d2") <= side * side)
    return pairs.select("specimen", "a", "b", "d2", *(f"{e}_{c}" for e in "ab" for c in keep))


def _k_nearest(q: tuple[np.ndarray, ...], c: tuple[np.ndarray, ...], k: int) -> tuple[np.ndarray, ...]:
    """(row, at, d2, rank, last): for each query of q = (id, x, y) its k nearest of c = (id, x, y) with other ids, by (d2, id), as positions in both; rank from 0.
    last: for each query the k-th squared distance, infinite where there are fewer."""
    by_id = np.argsort(c[0], kind="stable")
    ids, x, y = (v[by_id] for v in c)
    found: list[tuple] = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0, int))]
    last, begin, kth = np.full(len(q[0]), np.inf), 0, min(k, len(ids)) - 1
    for part in np.array_split(np.arange(len(q[0])), max(1, len(q[0]) * len(ids) // 100_000)):  # so much as fits in a core's own memory
        d, dy = q[1][part][:, None] - x, q[2][part][:, None] - y
        d *= d
        dy *= dy
        d += dy
        d[q[0][part][:, None] == ids] = np.inf
        most = np.partition(d, kth, axis=1)[:, kth]
        if kth == k - 1:
            last[part] = most
        row, at = np.nonzero(d <= np.minimum(most, np.finfo(float).max)[:, None])  # by id within a row; equal distances may be more than k
        d2 = d[row, at]
        order = np.lexsort((d2, row))
        row, at, d2 = row[order], at[order], d2[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        own = rank < k
        found.append((row[own] + begin, by_id[at[own]], d2[own], rank[own]))
        begin += len(part)
    return (*map(np.concatenate, zip(*found, strict=True)), last)


def _squares(level: str, x: str = "x", y: str = "y") -> tuple[Column, Column]:
    """Column and row of a position's square on a level of its specimen's quadtree (ox, oy, span)."""
    scale = F.pow(F.lit(2.0), F.col(level))
    inside = lambda v: F.greatest(F.lit(0), F.least(F.floor(v * scale), (scale - 1).cast("long"))).cast("int")
    return inside((F.col(x) - F.col("ox")) / F.col("span")), inside((F.col(y) - F.col("oy")) / F.col("span"))


def _quadtree(cells: DataFrame, extents: DataFrame, most: int) -> tuple[DataFrame, DataFrame, bool]:
    """(cells with level, i, j of their leaf; nodes (specimen, level, i, j, n, leaf); whether any specimen was split).

    A square with more than `most` cells is split, so leaves follow the density from place to place: crowds get small ones, deserts large ones.
    A round counts the squares AHEAD levels below those that are still crowded and settles all levels between, for the cells of these only.
    """
    small = extents.where(F.col("n") <= most)
    place = lambda d: d.select(*cells.columns, "level", "i", "j")
    root = {"level": F.lit(0), "i": F.lit(0), "j": F.lit(0)}
    settled = [place(cells.join(small.select("specimen"), "specimen", "left_semi").withColumns(root))]
    nodes = [extents.withColumns(root).select("specimen", "level", "i", "j", F.col("n"), (F.col("n") <= most).alias("leaf"))]
    if not extents.where(F.col("n") > most).limit(1).count():
        return place(cells.withColumns(root)), nodes[0], False
    todo, level = cells.join(extents.where(F.col("n") > most).select("specimen", "ox", "oy", "span"), "specimen"), 0
    while level < DEPTH and todo.limit(1).count():
        deep = min(DEPTH, level + AHEAD)
        i, j = _squares("deep")
        todo = todo.withColumn("deep", F.lit(deep)).withColumns({"i": i, "j": j})
        counts = stored(todo.groupBy("specimen", "i", "j").agg(F.count("*").alias("n")))
        known = counts.select("specimen", F.col("i").alias("fi"), F.col("j").alias("fj"), F.lit(deep).alias("at"))
        for up in range(deep - 1, level, -1):  # the leaf is the shallowest square that is not crowded
            shift = deep - up
            square = [F.shiftright("i", shift).alias("i"), F.shiftright("j", shift).alias("j")]
            sums = counts.groupBy("specimen", *square).agg(F.sum("n").alias("n"))
            known = known.withColumns({"i": F.shiftright("fi", shift), "j": F.shiftright("fj", shift)}).join(sums, ["specimen", "i", "j"])
            known = known.withColumn("at", F.when(F.col("n") <= most, up).otherwise(F.col("at"))).drop("i", "j", "n")
        known = known.join(counts.select("specimen", F.col("i").alias("fi"), F.col("j").alias("fj"), "n"), ["specimen", "fi", "fj"])
        full = (F.col("at") == deep) & (F.col("n") > most) & F.lit(deep < DEPTH)
        known = stored(known.withColumn("full", full))
        for up in range(level + 1, deep + 1):
            # squares on this level that hold a leaf below them or are one; those inside a leaf are none
            here = known.where(F.col("at") >= up).groupBy("specimen", F.shiftright("fi", deep - up).alias("i"), F.shiftright("fj", deep - up).alias("j"))
            nodes.append(here.agg(F.sum("n").alias("n"), F.bool_and((F.col("at") == up) & ~F.col("full")).alias("leaf")).select("specimen", F.lit(up).alias("level"), "i", "j", "n", "leaf"))
        found = stored(todo.withColumnsRenamed({"i": "fi", "j": "fj"}).join(known.select("specimen", "fi", "fj", "at", "full"), ["specimen", "fi", "fj"]))
        down = {"level": F.col("at"), "i": F.expr(f"shiftright(fi, {deep} - at)"), "j": F.expr(f"shiftright(fj, {deep} - at)")}
        settled.append(place(found.where(~F.col("full")).withColumns(down)))
        todo, level = found.where("full").select(*cells.columns, "ox", "oy", "span"), deep
    return reduce(DataFrame.union, settled), stored(reduce(DataFrame.union, nodes)), True


def _reached(queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """queries (specimen, a, xa, ya, r2, ox, oy, span, ...) with level, i, j of each leaf that comes as near as r2.

    A query's circle lies in at most four squares of the level on which a side is as long as its diameter. Below such a square lie the leaves that have it as an
    ancestor; or it lies in one leaf, which is among its own ancestors. So both are equi-joins.
    """
    leaves = nodes.where("leaf").select("specimen", "level", "i", "j")
    above = leaves.withColumn("top", F.explode(F.sequence(F.lit(0), "level"))).withColumns({"ti": F.expr("shiftright(i, level - top)"), "tj": F.expr("shiftright(j, level - top)")})
    r = F.sqrt("r2") * (1 + SLACK) + F.col("span") * SLACK
    wide = F.greatest(F.lit(0), F.least(F.lit(DEPTH), F.floor(F.log2(F.col("span") / (2 * r))))).cast("int")
    q = queries.withColumn("r_", r).withColumn("top", F.when(F.col("r2") > 0, wide).otherwise(DEPTH))
    corners = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 1) for dy in (-1, 1)))
    q = q.withColumn("corner", F.explode(corners)).withColumns({"cx": F.col("xa") + F.col("corner.dx") * F.col("r_"), "cy": F.col("ya") + F.col("corner.dy") * F.col("r_")})
    ti, tj = _squares("top", "cx", "cy")
    q = q.withColumns({"ti": ti, "tj": tj}).drop("corner", "cx", "cy").dropDuplicates(["specimen", "a", "ti", "tj"])
    below = q.join(above, ["specimen", "top", "ti", "tj"])
    up = q.withColumn("level", F.explode(F.expr("filter(sequence(0, top), v -> v < top)"))).withColumns({"i": F.expr("shiftright(ti, top - level)"), "j": F.expr("shiftright(tj, top - level)")})
    both = below.select(*queries.columns, "r_", "level", "i", "j").union(up.join(leaves, ["specimen", "level", "i", "j"]).select(*queries.columns, "r_", "level", "i", "j"))
    side = F.col("span") / F.pow(F.lit(2.0), F.col("level"))
    gap = lambda p, o, s: F.greatest(F.lit(0.0), F.col(o) + F.col(s) * side - F.col(p), F.col(p) - F.col(o) - (F.col(s) + 1) * side)
    # a border square also holds what lies beyond it, as for queries' leaves
    near = F.pow(gap("xa", "ox", "i"), 2) + F.pow(gap("ya", "oy", "j"), 2) <= F.col("r_") * F.col("r_")
    return both.where(near).drop("r_").dropDuplicates(["specimen", "a", "level", "i", "j"])


def _bounded(queries: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """queries (specimen, a, xa, ya, ox, oy, span) with r2, within which k cells lie for sure (or all): the least distance to the farthest corner of a leaf with more
    than k cells, among those under the smallest square around the query with more than k; for a specimen with fewer cells the whole of it."""
    i, j = _squares("level", "xa", "ya")
    q = queries.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(DEPTH)))).withColumns({"i": i, "j": j})
    home = q.join(nodes.where(F.col("n") > k).select("specimen", "level", "i", "j"), ["specimen", "level", "i", "j"]).groupBy("specimen", "a").agg(F.max(F.struct("level", "i", "j")).alias("h")).select("specimen", "a", "h.*")
    rich = nodes.where(F.col("leaf") & (F.col("n") > k)).select("specimen", F.col("level").alias("own"), F.col("i").alias("li"), F.col("j").alias("lj"))
    under = rich.withColumn("level", F.explode(F.sequence(F.lit(0), "own"))).withColumns({"i": F.expr("shiftright(li, own - level)"), "j": F.expr("shiftright(lj, own - level)")})
    side = F.col("span") / F.pow(F.lit(2.0), F.col("own"))
    far = lambda p, o, s: F.greatest(F.abs(F.col(o) + F.col(s) * side - F.col(p)), F.abs(F.col(o) + (F.col(s) + 1) * side - F.col(p)))
    r2 = F.pow(far("xa", "ox", "li"), 2) + F.pow(far("ya", "oy", "lj"), 2)
    best = home.join(under, ["specimen", "level", "i", "j"]).join(queries, ["specimen", "a"]).groupBy("specimen", "a").agg(F.min(r2).alias("r2"))
    return queries.join(best, ["specimen", "a"], "left").withColumn("r2", F.coalesce("r2", 8 * F.col("span") * F.col("span")))


def _k_nearest_each(leaf: np.ndarray, ids: np.ndarray, x: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """As _k_nearest() of points among themselves, for many leaves at once: a point's neighbours are of its own leaf (numbers from 0, without gaps).

    A leaf has a grid with about FILL points in a square; a point meets the squares around its own, then wider blocks of them, until its k-th neighbour is nearer than the
    block's border or the block is the leaf. So work goes with the points, not with the square of a leaf's.
    """
    code = np.unique(ids, return_inverse=True)[1]
    n = np.bincount(leaf)
    bounds = [np.full(len(n), v) for v in (np.inf, -np.inf, np.inf, -np.inf)]
    for bound, least, v in zip(bounds, (True, False) * 2, (x, x, y, y), strict=True):
        (np.minimum if least else np.maximum).at(bound, leaf, v)
    lx, ly, w, h = bounds[0], bounds[2], bounds[1] - bounds[0], bounds[3] - bounds[2]
    side = np.maximum(np.sqrt(w * h * FILL / n), np.maximum(w, h) * FILL / n)
    side[side == 0] = 1.0
    mx, my = ((v / side).astype(int) + 1 for v in (w, h))
    base = np.concatenate([[0], np.cumsum(mx * my)])
    cx, cy = (np.minimum(((v - low[leaf]) / side[leaf]).astype(int), m[leaf] - 1) for v, low, m in ((x, lx, mx), (y, ly, my)))
    square = base[leaf] + cy * mx[leaf] + cx
    by_square = np.argsort(square, kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(square, minlength=base[-1]))])
    found: list[tuple] = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0, int))]
    last, todo, ring = np.full(len(x), np.inf), by_square, 1
    while len(todo):
        again = []
        most = np.minimum(2 * ring + 1, my[leaf[todo]]) * np.minimum(2 * ring + 1, mx[leaf[todo]])  # squares, for the size of parts only
        for p in np.array_split(todo, max(1, int(most.sum()) * FILL // 500_000)):
            s, m = leaf[p], mx[leaf[p]]
            rows = cy[p][:, None] + np.arange(-min(ring, int(my.max())), min(ring, int(my.max())) + 1)
            there = (rows >= 0) & (rows < my[s][:, None])
            row = base[s][:, None] + np.where(there, rows, 0) * m[:, None]
            first, stop = starts[row + np.maximum(cx[p] - ring, 0)[:, None]], starts[row + np.minimum(cx[p] + ring, m - 1)[:, None] + 1]
            size = np.where(there, stop - first, 0)
            each, ends = size.sum(1), np.cumsum(size)
            at = by_square[np.arange(ends[-1]) + np.repeat((first - (ends.reshape(size.shape) - size)).ravel(), size.ravel())]
            of = np.repeat(np.arange(len(p)), each)
            d2 = np.square(x[at] - x[p][of]) + np.square(y[at] - y[p][of])
            d2[code[at] == code[p][of]] = np.inf
            wide = np.full((len(p), max(k, int(each.max()))), np.inf)
            wide[of, np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each)] = d2
            kth = np.partition(wide, k - 1, axis=1)[:, k - 1]
            gap = np.full(len(p), np.inf)
            for v, low, c, count in ((x[p], lx[s], cx[p], m), (y[p], ly[s], cy[p], my[s])):
                gap = np.minimum(gap, np.where(c - ring > 0, v - (low + (c - ring) * side[s]), np.inf))
                gap = np.minimum(gap, np.where(c + ring < count - 1, low + (c + ring + 1) * side[s] - v, np.inf))
            gap = np.maximum(0, gap - np.maximum(w, h)[s] * SLACK)
            done = np.isinf(gap) | (kth < gap * gap)
            again.append(p[~done])
            last[p[done]] = kth[done]
            near = np.flatnonzero((d2 <= np.minimum(kth, np.finfo(float).max)[of]) & done[of])  # equal distances may be more than k
            of, at, d2 = of[near], at[near], d2[near]
            count = np.bincount(of, minlength=len(p))
            place = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
            d, c, i = np.full((len(p), max(1, int(count.max()))), np.inf), np.zeros((len(p), max(1, int(count.max()))), int), np.zeros((len(p), max(1, int(count.max()))), int)
            d[of, place], c[of, place], i[of, place] = d2, code[at], at
            order = np.lexsort((c, d), axis=-1)[:, :k]
            d, i = np.take_along_axis(d, order, 1), np.take_along_axis(i, order, 1)
            own, rank = np.nonzero(np.isfinite(d))
            found.append((p[own], i[own, rank], d[own, rank], rank))
        todo, ring = np.concatenate(again), 3 * ring
    return (*map(np.concatenate, zip(*found, strict=True)), last)


def _own_leaves(group: pd.DataFrame, k: int, keep: tuple) -> pd.DataFrame:
    """(specimen, a, b, d2, rank, kept columns of both) of the cells of some leaves whose neighbours all lie in their own one; for each other cell one row of rank 0 with
    its place (xa, ya) and d2 within which k cells lie (or nothing)."""
    leaf = group.groupby(["specimen", "level", "i", "j"], sort=False, dropna=False).ngroup().to_numpy()
    ids, x, y, level, i, j, ox, oy, span = (group[c].to_numpy() for c in ("structure", "x", "y", "level", "i", "j", "ox", "oy", "span"))
    side, end = span / 2.0**level, 2**level - 1
    gap = np.full(len(x), np.inf)
    for p, o, at in ((x, ox, i), (y, oy, j)):
        gap = np.minimum(gap, np.where(at == 0, np.inf, p - (o + at * side)))
        gap = np.minimum(gap, np.where(at == end, np.inf, o + (at + 1) * side - p))
    gap = np.maximum(0, gap - span * SLACK)
    row, near, d2, rank, last = _k_nearest_each(leaf, ids, x, y, k)
    done = (last < gap * gap) | (level == 0)
    own, rest = done[row], np.flatnonzero(~done)
    at, to = np.concatenate([row[own], rest]), np.concatenate([near[own], rest])
    bound = np.where(np.isfinite(last[rest]), last[rest], np.nan)
    place = lambda v: np.concatenate([np.full(own.sum(), np.nan), v[rest]])  # noqa: E731  those that are done need none
    out = {"specimen": group["specimen"].to_numpy()[at], "a": ids[at], "b": ids[to], "d2": np.concatenate([d2[own], bound]), "rank": np.concatenate([rank[own] + 1, np.zeros(len(rest), int)]), "xa": place(x), "ya": place(y)}
    return pd.DataFrame(out | {f"a_{c}": group[c].to_numpy()[at] for c in keep} | {f"b_{c}": group[c].to_numpy()[to] for c in keep})


def nearest(cells: DataFrame, k: int = 6, rank_ties: str = "structure", queries: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(specimen, a, b, d2, rank, a_<kept>..., b_<kept>...): the k nearest other cells of every cell, ties by the smaller id; all if there are fewer.

    queries: points (specimen, structure, x, y) to find the nearest cells of, instead of the cells themselves. keep: columns (numbers, null where
    there is none) of both ends that come along; of queries none. Cells without a position have no neighbours and are nobody's.

    Cells are grouped by the leaves of a quadtree of each specimen, at most LEAF_CELLS in each, so specimens of any size and density spread over tasks. A first
    round takes bundles of leaves, about BUNDLE cells in each, and finds the nearest within the own leaf; a cell whose k-th neighbour is nearer than the leaf's border is done. The others, which stand near
    borders or in leaves of k cells or fewer, know how far their neighbours can be at most; a second round asks the leaves that come so near. Two rounds do,
    whatever the density. Of cells at one and the same place in a leaf that cannot be split only the k + 1 with the smallest ids can be anyone's neighbours.
    """

    def place(d: DataFrame, kept: tuple = ()) -> DataFrame:
        x, y = F.col("x").cast("double"), F.col("y").cast("double")
        return d.where(x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y)).select("specimen", F.col(rank_ties).alias("structure"), x.alias("x"), y.alias("y"), *(F.col(c).alias(f"keep_{c}") for c in kept))

    c = stored(place(cells, keep))
    asked = c if queries is None else stored(place(queries))
    extent = F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.lit(1.0))
    points = c.select("specimen", "x", "y", F.lit(1).alias("n"))
    points = points if queries is None else points.union(asked.select("specimen", "x", "y", F.lit(0)))
    extents = stored(points.groupBy("specimen").agg(F.sum("n").alias("n"), F.min("x").alias("ox"), F.min("y").alias("oy"), extent.alias("span")).where("n > 0"))
    frame = extents.select("specimen", "ox", "oy", "span")
    most = max(LEAF_CELLS, 8 * (k + 1))
    leafed, nodes, split = _quadtree(c, extents, most)
    leaf, full = ["specimen", "level", "i", "j"], nodes.where(F.col("leaf") & (F.col("n") > most))
    kinds = {f.name: f.dataType.simpleString() for f in c.schema}
    kept = tuple(n for n in c.columns if n.startswith("keep_"))
    ends = kept if queries is None else ()
    pairs = f"specimen {kinds['specimen']}, a {kinds['structure']}, b {kinds['structure']}, d2 double"
    both = [f"a_{n} {kinds[n]}" for n in ends] + [f"b_{n} {kinds[n]}" for n in kept]
    out = ["specimen", "a", "b", "d2", "rank", *(F.col(f"a_{n}").alias(f"a_{n[5:]}") for n in ends), *(F.col(f"b_{n}").alias(f"b_{n[5:]}") for n in kept)]
    whole = lambda d: d.select("specimen", F.col("structure").alias("a"), F.col("x").alias("xa"), F.col("y").alias("ya"), F.lit(None).cast("double").alias("r2"), *(F.col(n).alias(f"a_{n}") for n in ends))
    done = []
    if queries is None:
        first = lambda group: _own_leaves(group, k, kept)
        some = (leafed.join(full.select(*leaf), leaf, "left_anti") if split else leafed).join(frame, "specimen")
        bundles = -(-(extents.agg(F.sum("n")).first()[0] or 1) // BUNDLE)
        some = some.withColumn("bundle", F.pmod(F.xxhash64(*leaf), F.lit(bundles)))
        own = stored(some.groupBy("bundle").applyInPandas(first, ", ".join([pairs, "rank int, xa double, ya double", *both])))
        done.append(own.where("rank > 0").select(*out))
        if not split:  # every specimen is one leaf
            return done[0]
        rest = own.where("rank = 0").select("specimen", "a", "xa", "ya", F.nanvl("d2", F.lit(None).cast("double")).alias("r2"), *(f"a_{n}" for n in ends))
        rest = rest.union(whole(leafed.join(full.select(*leaf), leaf, "left_semi")))
    else:
        rest = whole(asked)
    rest = stored(rest.join(frame, "specimen"))
    root = extents.where(F.col("n") <= most).select("specimen")  # specimens of one leaf, which all their queries reach
    reached = rest.join(root, "specimen", "left_semi").withColumns({"r2": 8 * F.col("span") * F.col("span"), "level": F.lit(0), "i": F.lit(0), "j": F.lit(0)})
    rest = rest.join(root, "specimen", "left_anti")
    bounded = rest.where("r2 is not null").unionByName(_bounded(rest.where("r2 is null").drop("r2"), nodes, k))
    hits = stored((_reached(bounded, nodes).unionByName(reached) if split else reached))
    parts = stored(hits.groupBy(*leaf).agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts")))
    at_place = Window.partitionBy("specimen", "x", "y").orderBy("structure")
    thinned = leafed.join(full.select(*leaf), leaf, "left_semi").withColumn("nth", F.row_number().over(at_place)).where(F.col("nth") <= k + 1).drop("nth")
    there = leafed.join(full.select(*leaf), leaf, "left_anti").unionByName(thinned).join(parts, leaf)
    there = there.withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).drop("parts")
    hits = hits.join(parts, leaf).withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int")).drop("parts")
    names = ["specimen", "a", "b", "d2", *(p.split()[0] for p in both)]

    def second(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame(columns=names)
        row, at, d2, _, _ = _k_nearest(tuple(left[v].to_numpy() for v in ("a", "xa", "ya")), tuple(right[v].to_numpy() for v in ("structure", "x", "y")), k)
        near = d2 <= left["r2"].to_numpy()[row] * (1 + SLACK)
        row, at, d2 = row[near], at[near], d2[near]
        found = {"specimen": key[0], "a": left["a"].to_numpy()[row], "b": right["structure"].to_numpy()[at], "d2": d2}
        return pd.DataFrame(found | {f"a_{n}": left[f"a_{n}"].to_numpy()[row] for n in ends} | {f"b_{n}": right[n].to_numpy()[at] for n in kept}, columns=names)

    found = hits.groupBy(*leaf, "part").cogroup(there.groupBy(*leaf, "part")).applyInPandas(second, ", ".join([pairs, *both]))
    lists = found.groupBy("specimen", "a").agg(F.slice(F.array_sort(F.collect_list(F.struct("d2", "b", *names[4:]))), 1, k).alias("l"))
    lists = lists.select("specimen", "a", F.posexplode("l").alias("at", "e")).select("specimen", "a", "e.*", (F.col("at") + 1).alias("rank"))
    done.append(stored(lists.select(*out)))
    return reduce(DataFrame.union, done)


def match_one_to_one(left: DataFrame, right: DataFrame, radius: float = 10.0) -> DataFrame:
    """(specimen, a, b, d2, problem): each left cell with its nearest right cell within radius, and what forbids the match.

    problem: null, 'unmatched' (nothing within radius) or 'duplicate' (another left cell has the same nearest one).
    """
    pairs = radius_pairs(left, right, radius)
    best = pairs.groupBy("specimen", "a").agg(F.min(F.struct("d2", "b")).alias("m")).select("specimen", "a", "m.b", "m.d2")
    twice = best.groupBy("specimen", "b").agg(F.count("*").alias("uses"))
    out = left.select("specimen", F.col("structure").alias("a")).join(best, ["specimen", "a"], "left").join(twice, ["specimen", "b"], "left")
    return out.select("specimen", "a", "b", "d2", F.when(F.col("b").isNull(), "unmatched").when(F.col("uses") > 1, "duplicate").alias("problem"))


def rank_within(cells: DataFrame, value: str, most: int, by: str = "specimen", tie: str = "structure") -> DataFrame:
    """cells with rank (from 1) by value descending within `by`, the first `most` only; ties by the smaller id."""
    w = Window.partitionBy(by).orderBy(F.desc(value), tie)
    return cells.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
