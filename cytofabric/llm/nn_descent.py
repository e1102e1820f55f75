"""Near-duplicate embeddings by NN-descent, with an exact way for dense groups."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, release, slices, table
from .components import connected_components

#: Vectors in a block of the first graph; random projections it is made from; first and last length of neighbour lists; rounds,
#: after which vectors are compared with all others if the audit is still not content.
BLOCK, PROJECTIONS, FIRST_K, LAST_K, MOST_ROUNDS = 256, 8, 12, 48, 24
#: Recall of links that the audit asks for; vectors that go to all tasks at once; true links that make a measurement; the least vectors and the
#: least share of all (one in so many) that are audited before fewer links make one.
WANTED_RECALL, AUDIT, ENOUGH_LINKS, AUDIT_LEAST, AUDIT_SHARE = 0.98, 4096, 200, 16384, 64
#: Slack of angles between pivots, in radians: near 0 the arc cosine of a rounded cosine is wrong by some 1e-8, and three of them are added up.
ANGLE_SLACK = 1e-6
#: Neighbours that meet in one local join; a longer list is dealt into several.
LOCAL = 96
_GRAPH = pa.schema([("id", pa.int64()), ("other", pa.int64()), ("sim", pa.float64())])


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _top(sims: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, other, sim) of the k best others of each row of a square block."""
    np.fill_diagonal(sims, -2)
    k = min(k, len(ids) - 1)
    best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    rows = np.repeat(np.arange(len(ids)), k)
    return ids[rows], ids[best.ravel()], sims[rows, best.ravel()]


def _batch(parts: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(zip(*parts, strict=True), _GRAPH, strict=True)], schema=_GRAPH)


def unit_vectors(column: pa.Array) -> pa.Array:
    """Each vector over its length, in doubles; null for null, empty and zero vectors and those with null, NaN or infinite components.

    Components are divided by the largest one first, so that no square overflows or vanishes.
    """
    column = column.cast(pa.list_(pa.float64()))
    n = pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)
    x = column.flatten().to_numpy(zero_copy_only=False).copy()
    good, at = n > 0, np.concatenate([[0], np.cumsum(n)])[:-1]
    if len(x):
        row = np.repeat(np.flatnonzero(good), n[good])
        largest, length = np.zeros(len(n)), np.zeros(len(n))
        x[~np.isfinite(x)] = np.inf
        largest[good] = np.maximum.reduceat(np.abs(x), at[good])
        good &= (largest > 0) & (largest < np.inf)
        x[~good[row]] = 0
        x /= np.where(good, largest, 1)[row]
        length[n > 0] = np.sqrt(np.add.reduceat(x * x, at[n > 0]))
        x /= np.where(good, length, 1)[row]
    return pa.ListArray.from_arrays(pa.array(np.append(at, len(x)), pa.int32()), pa.array(x), mask=pa.array(~good))


def classes_of(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """(members (id_, cls), one for each row of vectors; points (rep, first, copies, v)): equal unit vectors are one class, known by a number,
    cls or rep; first is its smallest id, null if it has none. cls is null for vectors without a direction."""

    @F.arrow_udf("array<double>")
    def unit(column: pa.Array) -> pa.Array:
        parts = [unit_vectors(part) for part in slices(column)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.float64()))

    rows = cut(vectors.select(F.col(id_col).cast("long").alias("id_"), unit(F.col(vector_col)).alias("v")))
    points = rows.where("v is not null").groupBy("v").agg(F.min("id_").alias("first"), F.count("*").alias("copies"))
    points = cut(points.withColumn("rep", F.monotonically_increasing_id()))
    members = cut(rows.join(points.select("v", F.col("rep").alias("cls")), "v", "left").select("id_", "cls"))
    release(rows)
    return members, points


def first_graph(points: DataFrame, k: int, seed: int) -> DataFrame:
    """(id, other, sim): the best k of each vector within blocks of neighbours along each of several random projections.

    A projection's order is a range partitioning, so blocks are made where the vectors lie, whatever there is of them. Signs along so
    many planes go before it that those with equal signs are about a block: else a near pair shares a block ever more rarely as the table grows.
    """
    width, n = points.select(F.size("v").alias("d")).agg(F.max("d"), F.count("*")).first()
    width = width or 1
    rng = np.random.default_rng(seed)
    bits = min(30, max(6, (n // BLOCK).bit_length()))
    planes = rng.normal(size=(PROJECTIONS, bits + 1, width))

    @F.arrow_udf("array<struct<turn:int,code:int,at:double>>")
    def project(column: pa.Array) -> pa.Array:
        x = _matrix(column)
        values = np.einsum("tbd,nd->ntb", planes, x) if len(x) else np.zeros((0, PROJECTIONS, bits + 1))
        codes = (values[:, :, :bits] > 0) @ (1 << np.arange(bits)[::-1])
        return pa.array([[{"turn": t, "code": int(c[t]), "at": float(a[t, bits])} for t in range(PROJECTIONS)] for c, a in zip(codes, values, strict=True)], pa.list_(pa.struct([("turn", pa.int32()), ("code", pa.int32()), ("at", pa.float64())])))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            rows = pa.Table.from_batches(held)
            turns = rows["turn"].to_numpy()
            ids, x = rows["rep"].to_numpy(), _matrix(rows["v"])
            edges = [0, *(np.flatnonzero(np.diff(turns)) + 1).tolist(), len(turns)]
            for a, b in zip(edges, edges[1:], strict=False):
                for at in range(a, b, BLOCK):
                    lo, hi = max(a, min(at, b - BLOCK)), min(at + BLOCK, b)
                    if hi - lo > 1:
                        yield _batch([_top(x[lo:hi] @ x[lo:hi].T, ids[lo:hi], k)])
            held = []

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= 64 * BLOCK:
                yield from flush(False)
        if held:
            yield from flush(True)

    spread = points.select("rep", "v", F.explode(project("v")).alias("p")).select("p.*", "rep", "v")
    ordered = spread.repartitionByRange("turn", "code", "at").sortWithinPartitions("turn", "code", "at").select("turn", "rep", "v")
    return ordered.mapInArrow(blocks, "id long, other long, sim double")


def _best(graph: DataFrame, lists: DataFrame | None, threshold: float) -> DataFrame:
    """The k best of each id (k from lists, else FIRST_K; twice as many, up to LAST_K, where all k are links): (id, other, sim, k)."""
    graph = graph.groupBy("id", "other").agg(F.max("sim").alias("sim"))
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("sim"), F.desc("other")))
    graph = graph.withColumn("place", place).where(F.col("place") <= LAST_K)  # kept short on both sides of the shuffle, also for a hub
    rows = graph.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("sim", "other")), asc=False).alias("l"))
    if lists is not None:
        rows = rows.join(lists, "id", "left")
    else:
        rows = rows.withColumn("k", F.lit(None).cast("int"))
    k = F.coalesce("k", F.lit(FIRST_K))
    rows = rows.withColumn("k", F.when((F.size("l") >= k) & (F.get("l", k - 1)["sim"] >= threshold), F.least(2 * k, F.lit(LAST_K))).otherwise(k))
    return rows.select("id", "k", F.explode(F.slice("l", 1, F.col("k"))).alias("e")).select("id", "e.other", "e.sim", "k")


def refine(graph: DataFrame, points: DataFrame, turn: int) -> DataFrame:
    """(id, other, sim) of better neighbours: those that meet in the list, or reverse list, of a common neighbour.

    Each vector goes to the lists that name it; there all are compared with each other, and what beats the worst that either has goes
    out. A list of more than LOCAL names (of a hub) is dealt by hash into several local joins, other ones each turn.
    """
    worst = graph.groupBy("id").agg(F.when(F.count("*") >= F.max("k"), F.min("sim")).otherwise(F.lit(-2.0)).alias("worst"))
    both = graph.select(F.col("id").alias("at"), F.col("other").alias("rep")).union(graph.select(F.col("other").alias("at"), F.col("id").alias("rep"))).distinct()
    sizes = cut(both.groupBy("at").count().where(F.col("count") > LOCAL).select("at", F.ceil(F.col("count") / LOCAL).alias("shares")))
    both = both.join(sizes, "at", "left").withColumn("share", F.pmod(F.xxhash64("rep", F.lit(turn)), F.coalesce("shares", F.lit(1))))
    sent = points.select("rep", "v").join(worst, points["rep"] == worst["id"], "left").select("rep", "v", F.coalesce("worst", F.lit(-2.0)).alias("worst"))
    sent = both.join(sent, "rep").select("at", "share", "rep", "worst", "v")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([held, rows]) if held is not None else rows
            at, share = rows["at"].to_numpy(), rows["share"].to_numpy()
            edges = np.concatenate([[0], np.flatnonzero((np.diff(at) != 0) | (np.diff(share) != 0)) + 1, [len(at)]])
            yield from joined(rows.slice(0, int(edges[-2])), edges[:-1])
            held = rows.slice(int(edges[-2])).combine_chunks()
        if held is not None:
            yield from joined(held, np.array([0, held.num_rows]))

    def joined(rows: pa.Table, edges: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(edges) < 2:
            return
        ids, low, x, out = rows["rep"].to_numpy(), rows["worst"].to_numpy(), _matrix(rows["v"]), []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            sims = np.triu(x[a:b] @ x[a:b].T, 1)
            i, j = np.nonzero((sims > np.minimum(low[a:b, None], low[None, a:b])) & (np.arange(b - a)[:, None] < np.arange(b - a)))
            s = sims[i, j]
            one, two = s > low[a:b][i], s > low[a:b][j]
            out.append((ids[a:b][i[one]], ids[a:b][j[one]], s[one]))
            out.append((ids[a:b][j[two]], ids[a:b][i[two]], s[two]))
        yield _batch(out)

    parts = sent.repartition("at", "share").sortWithinPartitions("at", "share")
    return parts.mapInArrow(meet, "id long, other long, sim double")


def _full(graph: DataFrame, threshold: float) -> DataFrame:
    """(rep) of the vectors whose list holds links only, as many as it may."""
    lists = graph.groupBy("id").agg(F.count("*").alias("n"), F.max("k").alias("k"), F.min("sim").alias("low"))
    return lists.where((F.col("low") >= threshold) & (F.col("n") >= F.col("k")) & (F.col("k") >= LAST_K)).select(F.col("id").alias("rep"))


def _growing(graph: DataFrame, threshold: float) -> DataFrame:
    """Lists of links only that may still get longer, or have not been filled since they may."""
    lists = graph.groupBy("id").agg(F.count("*").alias("n"), F.max("k").alias("k"), F.min("sim").alias("low"))
    return lists.where((F.col("low") >= threshold) & (F.col("k") < LAST_K) & (F.col("n") >= F.col("k")))


def _true_links(points: DataFrame, full: DataFrame, threshold: float, seed: int) -> Iterator[DataFrame]:
    """All links (id, other), but for those between two vectors of full lists: for id in one share of the vectors, then in the next one.

    A share, of about AUDIT vectors chosen by hash, goes to every task, which compares it with its own vectors; only hits are returned.
    """
    marked = cut(points.select("rep", "v").join(full.select("rep", F.lit(True).alias("full")), "rep", "left").select("rep", "v", F.coalesce("full", F.lit(False)).alias("full")))
    shares = max(1, -(-marked.count() // AUDIT))

    def share(at: int) -> DataFrame:
        chosen = marked.where(F.pmod(F.xxhash64("rep", F.lit(seed)), F.lit(shares)) == at).toArrow()
        ids, x, thick = chosen["rep"].to_numpy(), _matrix(chosen["v"]), chosen["full"].to_numpy()

        def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for a in range(0, whole.num_rows if len(ids) else 0, 1000):
                    batch = whole.slice(a, 1000)
                    other, thick_ = batch.column(0).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
                    i, j = np.nonzero((x @ _matrix(batch.column(1)).T >= threshold) & ~(thick[:, None] & thick_) & (ids[:, None] != other))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(other[j])], names=["id", "other"])

        return cut(marked.mapInArrow(hits, "id long, other long"))

    return map(share, range(shares))


def audit_recall(points: DataFrame, links: DataFrame, full: DataFrame, threshold: float, seed: int) -> float:
    """Share of the true links of vectors chosen by hash that links (id, other) has.

    Links between two vectors of full lists don't count: those are found exactly later on. More and more vectors are compared with
    all others, until ENOUGH_LINKS were seen, or a link and AUDIT_LEAST vectors and one in AUDIT_SHARE of all. So where links are rare the audit goes
    through all vectors, and what it returns is always measured; 1 if no vector has a link.
    """
    n, found, audited, total = 0, 0, 0, points.count()
    for true in _true_links(points, full, threshold, seed):
        more = true.join(links.select("id", "other", F.lit(1).alias("found")), ["id", "other"], "left").agg(F.count("*"), F.count("found")).first()
        release(true)
        n, found, audited = n + more[0], found + more[1], audited + AUDIT
        if n >= ENOUGH_LINKS or (n and audited >= max(AUDIT_LEAST, total // AUDIT_SHARE)):
            break
    return found / n if n else 1.0


def _between_dense(points: DataFrame, dense: DataFrame, threshold: float, per_block: int = 512) -> tuple[DataFrame, DataFrame]:
    """Exact links among vectors whose lists are full of links: (counts (rep, n), joins (id, other), enough for the components).

    They are dealt to pivots (a fixed share of them); a pivot's members lie within its radius. Two pivots meet only if their radii leave
    room for a link. Where blocks meet, each vector's number of linked copies is counted and one link for each row and
    column goes out, never all pairs.
    """
    own = cut(points.join(dense, "rep", "left_semi"))
    n = own.count()
    n_blocks = max(1, -(-n // per_block))
    pivots = own.orderBy(F.xxhash64("rep", F.lit(11))).limit(min(n, 4096, 4 * n_blocks)).select("v").toArrow()
    px = _matrix(pivots["v"])

    @F.arrow_udf("struct<pivot:int,angle:double>")
    def nearest(column: pa.Array) -> pa.Array:
        if not len(column):
            return pa.array([], pa.struct([("pivot", pa.int32()), ("angle", pa.float64())]))
        sims = _matrix(column) @ px.T
        best = sims.argmax(1)
        return pa.StructArray.from_arrays([pa.array(best, pa.int32()), pa.array(np.arccos(np.clip(sims[np.arange(len(best)), best], -1, 1)))], names=["pivot", "angle"])

    placed = own.withColumn("p", nearest("v")).select("rep", "copies", "v", "p.pivot", "p.angle")
    radii = placed.groupBy("pivot").agg(F.max("angle").alias("radius"), F.count("*").alias("size")).collect()  # at most 4096 rows
    parts = {r["pivot"]: -(-r["size"] // per_block) for r in radii}
    shares = own.sparkSession.createDataFrame([(p, c) for p, c in parts.items()], "pivot int, shares int")
    placed = placed.join(F.broadcast(shares), "pivot").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("shares")).cast("int"))
    placed = cut(placed.select("rep", "copies", "v", "pivot", "block"))
    reach = np.arccos(threshold) + ANGLE_SLACK
    order = np.array([r["pivot"] for r in radii], np.int64)
    radius = np.array([r["radius"] for r in radii])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in batch.column(0).to_pylist():
                b = np.arange(a, len(order))
                angle = np.arccos(np.clip(px[order[b]] @ px[order[a]], -1, 1))
                b = b[angle <= radius[a] + radius[b] + reach]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), order[a])), pa.array(order[b])], names=["p", "q"])

    spark = own.sparkSession
    plan = spark.range(len(order)).mapInArrow(near, "p long, q long").join(shares.select(F.col("pivot").alias("p"), F.col("shares").alias("n_p")), "p").join(shares.select(F.col("pivot").alias("q"), F.col("shares").alias("n_q")), "q")
    plan = plan.withColumn("s", F.explode(F.sequence(F.lit(0), F.col("n_p") - 1))).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("n_q") - 1)))
    plan = plan.where("p <> q or s <= t").select("p", "s", "q", "t")
    sides = plan.select("p", "s", "q", "t", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("p").alias("pivot"), F.col("s").alias("block")), F.struct(F.lit(1).alias("side"), F.col("q").alias("pivot"), F.col("t").alias("block")))).alias("x")).select("p", "s", "q", "t", "x.*")
    rows = placed.join(sides, ["pivot", "block"]).select("p", "s", "q", "t", "side", "rep", "copies", "v")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            now = pa.concat_tables([held, now]) if held is not None else now
            task = np.stack([now[c].to_numpy() for c in "psqt"])
            edges = np.concatenate([[0], np.flatnonzero((np.diff(task) != 0).any(0)) + 1, [now.num_rows]]).tolist()
            for a, b in zip(edges[:-2], edges[1:-1], strict=True):
                yield counted(now.slice(a, b - a))
            held = now.slice(edges[-2]).combine_chunks()
        if held is not None:
            yield counted(held)

    def counted(rows: pa.Table) -> pa.RecordBatch:
        side, ids, copies, x = rows["side"].to_numpy(), rows["rep"].to_numpy(), rows["copies"].to_numpy(), _matrix(rows["v"])
        one, two = side == 0, side == 1
        link = (x[one] @ x[two].T >= threshold) & (ids[one][:, None] != ids[two][None, :])
        a, b, w, u = ids[one], ids[two], link @ copies[two], copies[one] @ link
        if len(a) == len(b) and (np.sort(a) == np.sort(b)).all():
            u = np.zeros_like(u)  # a block with itself: rows count all
        ri, ci = np.flatnonzero(link.any(1)), np.flatnonzero(link.any(0))
        return _batch([(a, np.full(len(a), -1), w.astype(float)), (b, np.full(len(b), -1), u.astype(float)), (a[ri], b[link[ri].argmax(1)], np.full(len(ri), -1.0)), (b[ci], a[link[:, ci].argmax(0)], np.full(len(ci), -1.0))])

    out = cut(rows.repartition("p", "s", "q", "t").sortWithinPartitions("p", "s", "q", "t", "side").mapInArrow(compare, "id long, other long, sim double"))
    counts = out.where("sim >= 0").groupBy(F.col("id").alias("rep")).agg(F.sum("sim").cast("long").alias("n"))
    return counts, out.where("sim < 0").select("id", "other")


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 5) -> DataFrame:
    """One row per row of vectors: id_col, n_links (other vectors linked directly), component_id, kept, recall (the audit's).

    Vectors link at cosine >= threshold, in doubles. Equal directions are one class. NN-descent from blocks along random
    projections finds neighbour lists; those full of links grow to LAST_K, and beyond that their vectors
    are compared exactly with each other, in blocks, so that no list's length hides a link. Refinement goes on
    until a round adds no link. If the audit is not content with that, further projections are added. If it never is, all links are found by comparing every vector with all others. Null, zero and non-finite vectors link with nothing.
    Rows that repeat an id are vectors of their own. A row with a null id links as any other; its component's id is null if no row in it has one. Vectors of
    different widths don't link: each width is searched by itself, one after the other.
    """
    width = F.when(F.size(vector_col) > 0, F.size(vector_col))
    widths = [r[0] for r in vectors.select(width.alias("w")).distinct().where("w is not null").orderBy("w").collect()]
    if len(widths) < 2:
        return _of_one_width(vectors, threshold, id_col, vector_col, seed)
    width = F.coalesce(width, F.lit(widths[0]))  # those without components go with any others
    return reduce(DataFrame.union, [_of_one_width(vectors.where(width == w), threshold, id_col, vector_col, seed) for w in widths])


def _of_one_width(vectors: DataFrame, threshold: float, id_col: str, vector_col: str, seed: int) -> DataFrame:
    members, points = classes_of(vectors, id_col, vector_col)
    graph = cut(_best(first_graph(points, FIRST_K, seed), None, threshold))
    recall, fresh = 0.0, False
    for turn in range(MOST_ROUNDS):
        better = refine(graph, points, turn)
        better = better.union(first_graph(points, FIRST_K, seed + turn)) if fresh else better
        better = cut(_best(graph.select("id", "other", "sim").union(better), graph.groupBy("id").agg(F.max("k").alias("k")), threshold))
        added = _loose(better, threshold).join(_loose(graph, threshold), ["id", "other"], "left_anti").count()
        release(graph)
        graph, fresh = better, False
        if added or _growing(graph, threshold).limit(1).count():
            continue
        recall = audit_recall(points, _links(graph, threshold), _full(graph, threshold), threshold, seed + turn + 1)
        if recall >= WANTED_RECALL:
            break
        fresh = True
    else:
        recall = audit_recall(points, _links(graph, threshold), _full(graph, threshold), threshold, seed)
    dense = cut(_full(graph, threshold))
    loose, links = cut(_loose(graph, threshold)), cut(_links(graph, threshold))
    if recall < WANTED_RECALL:
        shares = []
        for true in _true_links(points, dense, threshold, seed):
            shares.append(true)
            if len(shares) == 32:
                shares = [cut(reduce(DataFrame.union, shares))]
        loose, recall = cut(reduce(DataFrame.union, shares).distinct()), 1.0
        links = cut(links.union(loose).distinct())
    counts, joins = _between_dense(points, dense, threshold)
    copies = points.select(F.col("rep").alias("other"), "copies")
    near = loose.join(copies, "other").groupBy(F.col("id").alias("rep")).agg(F.sum("copies").alias("n")).union(counts).groupBy("rep").agg(F.sum("n").alias("n"))
    labels = connected_components(links.union(joins), "id", "other")
    about = points.select("rep", "copies").join(near, "rep", "left").join(labels.select(F.col("id").alias("rep"), "component"), "rep", "left")
    about = cut(about.select("rep", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component")))
    least = about.join(points.select("rep", "first"), "rep").groupBy("component").agg(F.min("first").alias("component_id"))
    about = cut(about.join(least, "component").select(F.col("rep").alias("cls"), "n_links", "component_id"))
    out = members.join(about, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("id_")).otherwise(F.col("component_id"))
    return out.select(F.col("id_").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id_") == component, F.lit(False)).alias("kept"), F.lit(round(recall, 4)).cast("double").alias("recall"))


def _links(graph: DataFrame, threshold: float) -> DataFrame:
    """Both directions of the graph's links, once each."""
    found = graph.where(F.col("sim") >= threshold)
    return found.select("id", "other").union(found.select(F.col("other").alias("id"), F.col("id").alias("other"))).distinct()


def _loose(graph: DataFrame, threshold: float) -> DataFrame:
    """_links() without those between two vectors of full lists."""
    thick = _full(graph, threshold).select(F.col("rep").alias("id"), F.lit(True).alias("thick"))
    marked = _links(graph, threshold).join(thick, "id", "left").join(thick.select(F.col("id").alias("other"), F.col("thick").alias("thick_")), "other", "left")
    return marked.where("thick is null or thick_ is null").select("id", "other")


def op2_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
