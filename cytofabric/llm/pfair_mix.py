"""Mixing sources to target weights: Pfair windows for each source's blocks, earliest deadline first."""

from __future__ import annotations

import heapq
import json
import math
from bisect import bisect_right
from collections.abc import Iterator, Mapping
from fractions import Fraction
from functools import reduce
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

#: Slots that leave the driver at once.
BATCH = 1 << 18


def period_of(shares: Mapping[str, int]) -> dict[str, list[int]]:
    """source -> slots of its blocks in one period of sum(shares) slots.

    Block j (from 1) of a source with c of H slots may run from floor((j-1) H/c) and must end by ceil(j H/c). Of the blocks
    released, the one with the earliest deadline takes the slot. At full load every deadline is met, so at every
    slot each source is less than one block off its share.
    """
    h, out = sum(shares.values()), {s: [] for s in shares}
    coming = sorted((((j - 1) * h) // c, -((-j * h) // c), s) for s, c in shares.items() for j in range(1, c + 1))
    ready, at = [], 0
    for slot in range(h):
        while at < len(coming) and coming[at][0] <= slot:
            heapq.heappush(ready, coming[at][1:])
            at += 1
        _, s = heapq.heappop(ready)
        out[s].append(slot)
    return out


def windows(ends: list[tuple[Fraction, str]], left: list[int], gone: list[int], n: int, w: int) -> Iterator[tuple[int, int]]:
    """(release, deadline) of each of the n blocks of a source of weight w, exactly.

    In the ideal schedule all sources run at once, at rates in proportion to their weights, until they end; after V units of weight
    a source has had min(weight V, blocks) slots. ends: V at which each ends, in order; left and gone: weight
    that is left and blocks of ended sources, before the first and from each end on.
    """
    at, floor = 0, 0
    for j in range(1, n + 1):
        if at < len(ends) and ends[at][0] * w <= j:
            at = bisect_right(ends, Fraction(j, w), at, key=lambda e: e[0])
        work = j * left[at]
        yield floor, gone[at] - (-work // w)
        floor = gone[at] + work // w


def schedule(blocks: Mapping[str, int], weights: Mapping[str, float]) -> Iterator[tuple[str, int, int]]:
    """(source, block, slot) in the order of slots: earliest deadline first over the exact windows, so that at every slot of a schedule
    of any length each source is less than one block off the ideal schedule. Every slot is taken. Memory grows with the sources only."""
    exact = {s: Fraction(weights[s]) for s, n in blocks.items() if n > 0}
    scale = math.lcm(*(x.denominator for x in exact.values()))
    whole = {s: int(x * scale) for s, x in exact.items()}
    ends = sorted((Fraction(blocks[s], w), s) for s, w in whole.items())
    left, gone = [sum(whole.values())], [0]
    for _, s in ends:
        left.append(left[-1] - whole[s])
        gone.append(gone[-1] + blocks[s])
    coming, ready = [], []
    for s in whole:
        of = windows(ends, left, gone, blocks[s], whole[s])
        coming.append((*next(of), s, 0, of))
    heapq.heapify(coming)
    for slot in range(sum(blocks[s] for s in whole)):
        while coming and coming[0][0] <= slot:
            _, deadline, s, j, of = heapq.heappop(coming)
            heapq.heappush(ready, (deadline, s, j, of))
        _, s, j, of = heapq.heappop(ready)
        yield s, j, slot
        if (following := next(of, None)) is not None:
            heapq.heappush(coming, (*following, s, j + 1, of))


def pfair_mix(docs: DataFrame, weights: Mapping[str | None, float] | None = None, temperature: float = 0.5, block: int = 16, seed: int = 0, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """docs with all columns in row_, and source_ (JSON text), rank, block_, slot, offset: read by (slot, offset) the sources are mixed.

    weights: target weight for each source, sources not named get none and follow when all others have ended; None: rows ** temperature.
    Every row stays, once. Rows of a source stand by a seeded hash of their id (then id), so order in the input and
    partitions don't matter; repeated ids are neighbours. Null is a source of its own. An empty table gives no rows.

    Nothing of a source meets in one task: its n rows are numbered in sqrt(n) hash buckets of about sqrt(n) rows each,
    offset by the buckets' counts. The driver sees one count for each source and streams the schedule out in batches of BATCH
    slots, a step for each block; what it holds grows with the number of sources only.
    """
    spark = docs.sparkSession
    key = F.to_json(F.struct(F.col(source_col).cast("string").alias("s")))
    rows = docs.select(F.struct("*").alias("row_"), key.alias("source_"), F.xxhash64(F.lit(seed), F.col(id_col)).alias("hash_"), F.col(id_col).alias("id_"))
    n = {r[0]: r[1] for r in rows.groupBy("source_").count().collect()}
    blocks = {s: -(-n[s] // block) for s in sorted(n)}
    if weights is None:
        share = {s: float(n[s]) ** temperature for s in blocks}
    else:
        share = {s: float(w) for s in blocks if (w := weights.get(json.loads(s).get("s"), 0)) > 0}
    late = {s: 1.0 for s in blocks if s not in share}
    first, last = (schedule({s: blocks[s] for s in some}, some) for some in (share, late))
    end = sum(blocks[s] for s in share)
    slots, parts = chain(first, ((s, j, end + slot) for s, j, slot in last)), []
    while held := list(islice(slots, BATCH)):
        columns = zip(zip(*held, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)
        parts.append(cut(spark.createDataFrame(pa.table([pa.array(c, t) for c, t in columns], names=["source_", "block_", "slot"]))))
    taken = reduce(DataFrame.union, parts, spark.createDataFrame([], "source_ string, block_ long, slot long"))

    buckets = max(1, math.isqrt(max(n.values(), default=1)))
    rows = rows.withColumn("bucket", F.pmod(F.shiftright("hash_", 20), F.lit(buckets)))
    sizes = rows.groupBy("source_", "bucket").count()
    before = Window.partitionBy("source_").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut(sizes.select("source_", "bucket", "count", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start_")))
    # The slots of a bucket's blocks, about sqrt(n) / block of them, come with its start, so that rows move once.
    parts = starts.select("*", F.explode(F.sequence(F.floor(F.col("start_") / block), F.floor((F.col("start_") + F.col("count") - 1) / block))).alias("block_"))
    parts = parts.join(taken, ["source_", "block_"]).groupBy("source_", "bucket", "start_")
    starts = cut(parts.agg(F.array_sort(F.collect_list(F.struct("block_", "slot"))).alias("slots_")))
    within = F.row_number().over(Window.partitionBy("source_", "bucket").orderBy("hash_", "id_"))
    rows = rows.withColumn("within", within).join(starts, ["source_", "bucket"]).withColumn("rank", F.col("start_") + F.col("within") - 1)
    rows = rows.withColumn("block_", F.floor(F.col("rank") / block))
    slot = F.get("slots_", (F.col("block_") - F.col("slots_")[0]["block_"]).cast("int"))["slot"]
    return rows.select("row_", "source_", "rank", "block_", slot.alias("slot"), (F.col("rank") % block).alias("offset"))


def mixed(docs: DataFrame, position: str | None = None, block: int = 16, **how) -> DataFrame:
    """The rows of docs, with their own columns only, in mixed order; position: name of a further column that keeps this order."""
    out = pfair_mix(docs, block=block, **how).orderBy("slot", "offset")
    return out.select("row_.*", *([(F.col("slot") * block + F.col("offset")).alias(position)] if position else []))


def op7_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    out = pfair_mix(docs)
    return out.select("row_.doc_id", "row_.source", F.col("block_").alias("block"), "slot", "offset")
