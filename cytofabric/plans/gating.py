"""Queries on gates, samples, layouts and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gating as G
from ..operators import graphs as R
from ..operators import sampling as K
from ..operators.neighbors import rank_within
from ..operators.populations import matches
from ..sources.tables import CELLS, cells, table
from .populations import SIGNATURES
from .registry import query

_C = f"WITH cells AS MATERIALIZED ({CELLS})"


@query("d09_segment_means", "SELECT l_suppkey AS sample, l_partkey % 50 AS segment, round(avg(l_orderkey), 6) AS row, round(avg(l_linenumber), 6) AS col, round(coalesce(avg(CASE WHEN l_returnflag = 'R' THEN l_quantity END), 0), 6) AS q, round(coalesce(avg(l_tax), 0), 6) AS t FROM lineitem GROUP BY ALL")
def d09(spark, d):
    pixels = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("sample"), (F.col("l_partkey") % 50).alias("segment"), F.col("l_orderkey").alias("row"), F.col("l_linenumber").alias("col"), F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).alias("q"), F.col("l_tax").alias("t"))
    return G.segment_means(pixels, ["q", "t"]).select("sample", "segment", *(F.round(c, 6).alias(c) for c in ("row", "col", "q", "t")))


@query("d14_gates_from_calls", f"{_C} SELECT specimen, 'BULK' AS channel, round((max(l_quantity) FILTER ((mask & 4) = 0) + min(l_quantity) FILTER ((mask & 4) = 4)) / 2, 6) AS gate FROM cells GROUP BY 1 UNION ALL SELECT specimen, 'TAXED', round((max(l_tax) FILTER ((mask & 16) = 0) + min(l_tax) FILTER ((mask & 16) = 16)) / 2, 6) FROM cells GROUP BY 1")
def d14(spark, d):
    g = G.gates_from_calls(cells(spark, d), {"BULK": (4, 0), "TAXED": (16, 0)}, {"BULK": "l_quantity", "TAXED": "l_tax"})
    return g.withColumn("gate", F.round("gate", 6))


def _samples(spark, d):
    return cells(spark, d).select(F.col("specimen").alias("sample"), F.col("l_quantity").cast("double").alias("BULK"), F.col("l_tax").cast("double").alias("TAXED"), matches(F.col("mask"), 4, 0).cast("int").alias("is_bulk"), matches(F.col("mask"), 20, 0).cast("int").alias("is_both"))


_SIGS = {"is_bulk": (["BULK"], []), "is_both": (["BULK", "TAXED"], [])}


@query("d15_discordance", f"{_C}, g AS (SELECT * FROM (VALUES (0, 20, 0.02), (1, 25, 0.04), (2, 30, 0.06)) AS g(candidate, gb, gt)), s AS (SELECT specimen AS sample, candidate, (mask & 4) = 4 AS a, (mask & 20) = 20 AS b, l_quantity > gb AS x, l_quantity > gb AND l_tax > gt AS y FROM cells, g) SELECT sample, candidate, round(((1 - count(*) FILTER (a AND x) / count(*) FILTER (a OR x)) + (1 - count(*) FILTER (b AND y) / count(*) FILTER (b OR y))) / 2, 6) AS distance FROM s GROUP BY ALL")
def d15(spark, d):
    c = _samples(spark, d)
    gates = c.select("sample").distinct().crossJoin(F.broadcast(spark.createDataFrame([(0, 20.0, 0.02), (1, 25.0, 0.04), (2, 30.0, 0.06)], "candidate int, BULK double, TAXED double")))
    return G.discordance(c, {n: n for n in _SIGS}, _SIGS, gates).withColumn("distance", F.round("distance", 6))


def _gate_search_sql() -> str:
    """Two channels, 16 gates, two rounds, each turn spelled out over all cells."""
    distance = lambda n, made: f"CASE WHEN count(*) FILTER ({n} OR ({made})) > 0 THEN 1 - count(*) FILTER ({n} AND ({made})) / count(*) FILTER ({n} OR ({made})) ELSE 0 END"
    text = f"""{_C}, s AS MATERIALIZED (SELECT specimen AS sample, CAST(l_quantity AS DOUBLE) AS b, CAST(l_tax AS DOUBLE) AS t, (mask & 4) = 4 AS is_bulk, (mask & 20) = 20 AS is_both FROM cells),
m AS MATERIALIZED (SELECT sample, avg(b) AS mb, avg(t) AS mt FROM s GROUP BY 1),
first AS (SELECT sample, candidate, {distance("is_bulk", "b > mb * 2 * candidate / 15")} AS d FROM s JOIN m USING (sample), range(16) r(candidate) GROUP BY ALL),
g0 AS MATERIALIZED (SELECT sample, mb, mt, mb * 2 * candidate / 15 AS gb, mt AS gt, mb * 2 * candidate / 15 AS sb FROM first JOIN m USING (sample) QUALIFY row_number() OVER (PARTITION BY sample ORDER BY d, candidate) = 1)"""
    for turn, c in enumerate("btbt"):
        gate = f"CASE WHEN candidate < 0 THEN g{c} ELSE m{c} * 2 * candidate / 15 END"
        b, t = (f"b > {gate}", "t > gt") if c == "b" else ("b > gb", f"t > {gate}")
        text += f""",
t{turn} AS (SELECT sample, candidate, ({distance("is_bulk", b)} + {distance("is_both", f"{b} AND {t}")}) / 2 AS d FROM s JOIN g{turn} USING (sample), range(-1, 16) r(candidate) GROUP BY ALL),
g{turn + 1} AS MATERIALIZED (SELECT sample, mb, mt, sb, {gate if c == "b" else "gb"} AS gb, {gate if c == "t" else "gt"} AS gt FROM t{turn} JOIN g{turn} USING (sample) QUALIFY row_number() OVER (PARTITION BY sample ORDER BY d, candidate) = 1)"""
    return text + """
SELECT sample, 'BULK' AS channel, round(gb, 6) AS final, round(sb, 6) AS single, round(mb, 6) AS mean FROM g4 UNION ALL SELECT sample, 'TAXED', round(gt, 6), round(mt, 6), round(mt, 6) FROM g4"""


@query("i13_gate_search", _gate_search_sql())
def i13(spark, d):
    found = G.gate_search(_samples(spark, d), {n: n for n in _SIGS}, _SIGS, ["BULK", "TAXED"])
    return found.select("sample", "channel", *(F.round(c, 6).alias(c) for c in ("final", "single", "mean")))


@query("k06_gate_subsample", "SELECT l_suppkey AS sample, least(count(*), 40) AS n FROM lineitem GROUP BY 1")
def k06(spark, d):
    """How many cells of each sample the gate search would get, were 40 its limit (1000 by default)."""
    return G.gate_subsample(cells(spark, d).select(F.col("specimen").alias("sample"), "structure"), 40).groupBy("sample").agg(F.count("*").alias("n"))


def _standard(spark, d):
    c = cells(spark, d).select(F.col("specimen").alias("sample"), F.lit("price").alias("channel"), F.col("l_extendedprice").cast("double").alias("v"))
    m = c.groupBy("sample", "channel").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    return c.join(m, ["sample", "channel"]).select("sample", "channel", ((F.col("v") - F.col("m")) / F.col("s")).alias("v"))


@query("i10_two_gaussians")
def i10(spark, d):
    return G.bimodality(G.two_gaussians(_standard(spark, d), 20))


@query("i12_calls_from_gates", f"{_C} SELECT specimen AS sample, count(*) FILTER (v >= CASE WHEN specimen % 2 = 0 THEN 60000 ELSE m END) AS positive FROM (SELECT specimen, l_extendedprice AS v, avg(l_extendedprice) OVER (PARTITION BY specimen) AS m FROM cells) GROUP BY 1")
def i12(spark, d):
    v = cells(spark, d).select(F.col("specimen").alias("sample"), F.lit("price").alias("channel"), F.col("l_extendedprice").cast("double").alias("v"))
    gates = v.select("sample", "channel").distinct().select("sample", "channel", F.when(F.col("sample") % 2 == 0, 0.9).otherwise(0.1).alias("score"), F.lit(60000.0).alias("gate"))
    return G.calls_from_gates(v, gates).groupBy("sample").agg(F.sum("positive").cast("long").alias("positive"))


@query("e07_allocation", "WITH s AS (SELECT l_suppkey AS specimen, count(*) AS n FROM lineitem GROUP BY 1), t AS (SELECT *, sum(n) OVER () AS total, floor(n * 5000.0 / sum(n) OVER ()) AS f FROM s), u AS (SELECT *, 5000 - sum(f) OVER () AS spare, row_number() OVER (ORDER BY specimen) AS r FROM t) SELECT specimen, n, CAST(f + CASE WHEN r <= spare THEN 1 ELSE 0 END AS BIGINT) AS take FROM u")
def e07(spark, d):
    return K.allocation(table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("specimen")).agg(F.count("*").alias("n")), 5000)


@query("k02_representative")
def k02(spark, d):
    return K.representative(cells(spark, d), 5000).select("specimen", "structure", "mask")


@query("k01_random_draws")
def k01(spark, d):
    return K.draws_with_replacement(cells(spark, d), 10_000).select("specimen", "structure")


@query("k03_uniform_ranks")
def k03(spark, d):
    return K.uniform_ranks(cells(spark, d).select("structure", "l_quantity", "l_extendedprice"), ["l_quantity", "l_extendedprice"], 200)


@query("k04_layout")
def k04(spark, d):
    v = table(spark, d, "embeddings")
    width = v.agg(F.max(F.size("embedding"))).first()[0] or 0
    names = [f"e{i}" for i in range(width)]
    v = v.select("vec_id", *(F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)))
    return K.layout(v, names).select("vec_id", "x", "y")


@query("k05_virtual_sample", f"{_C} SELECT CAST(specimen AS BIGINT) AS specimen, structure, x, y, mask FROM cells UNION ALL SELECT -1, structure, CAST(l_quantity AS INT), CAST(l_quantity AS INT), mask FROM cells WHERE structure % 7 = 0")
def k05(spark, d):
    c = cells(spark, d)
    q = F.col("l_quantity").cast("int")
    return K.virtual_sample(c, c.where("structure % 7 = 0").withColumns({"x": q, "y": q}))



def _target():
    return matches(F.col("mask"), *SIGNATURES["bulk_taxed"])


@query("j09_place_rois")
def j09(spark, d):
    return R.place_rois(cells(spark, d), _target(), 200)


@query("j10_roi_graphs")
def j10(spark, d):
    c = cells(spark, d)
    return R.roi_graphs(c, R.place_rois(c, _target(), 200), 5, 100)[1]


@query("j11_split_datasets", """WITH s AS (SELECT s_suppkey AS specimen, CAST(s_nationkey % 5 AS VARCHAR) AS label, s_suppkey % 4 + 1 AS rois FROM supplier),
m AS (SELECT label, median(rois) AS med, sum(rois) AS everything, count(*) AS many FROM s GROUP BY 1),
o AS (SELECT s.*, everything, many, row_number() OVER (PARTITION BY label ORDER BY CASE WHEN rois >= 10 * med THEN 0 ELSE 1 END, md5(specimen || '/0'), specimen) AS place FROM s JOIN m USING (label)),
given AS (SELECT label, max(rois) FILTER (place = 1) AS to_train, max(rois) FILTER (place = 2) AS to_validation FROM o GROUP BY 1),
remainder AS (SELECT label, specimen, sum(rois) OVER (PARTITION BY label ORDER BY place) - rois AS used FROM o WHERE place > 3),
target AS (SELECT DISTINCT o.label, everything * CAST(0.7 AS DOUBLE) - to_train AS train, everything * CAST(0.15 AS DOUBLE) - to_validation AS validation FROM o JOIN given USING (label))
SELECT specimen, label, rois, CASE WHEN place = 1 THEN 'train' WHEN many = 2 THEN CASE WHEN left(md5(label || '/0'), 1) < '8' THEN 'validation' ELSE 'test' END WHEN place = 2 THEN 'validation' WHEN place = 3 THEN 'test'
  WHEN used < train THEN 'train' WHEN used < train + validation THEN 'validation' ELSE 'test' END AS part FROM o JOIN target USING (label) LEFT JOIN remainder USING (label, specimen)""")
def j11(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("specimen"), (F.col("s_nationkey") % 5).cast("string").alias("label"), (F.col("s_suppkey") % 4 + 1).alias("rois"))
    return R.split_datasets(s).withColumnRenamed("set", "part")


@query("b19_labelled_specimens", f"{_C} SELECT specimen, structure FROM cells JOIN supplier ON specimen = s_suppkey WHERE s_nationkey % 5 <> 0")
def b19(spark, d):
    labels = table(spark, d, "supplier").select(F.col("s_suppkey").alias("specimen"), F.when(F.col("s_nationkey") % 5 != 0, F.col("s_nationkey")).alias("label"))
    return R.labelled_specimens(cells(spark, d), labels).select("specimen", "structure")


@query("d21_stitched", "SELECT l_suppkey AS specimen, l_partkey AS structure, max(l_extendedprice) AS importance FROM lineitem GROUP BY ALL")
def d21(spark, d):
    return R.stitched(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("specimen"), F.col("l_partkey").alias("structure"), F.col("l_extendedprice").alias("importance")))


@query("d25_importance_composition", f"{_C}, r AS (SELECT *, row_number() OVER (PARTITION BY specimen ORDER BY round((l_extendedprice % 1000) / 1000, 5) DESC, structure) AS k FROM cells) SELECT specimen, count(*) AS n, round(avg(CASE WHEN (mask & 4) = 4 THEN 1.0 ELSE 0 END), 6) AS bulk FROM r WHERE k <= 50 GROUP BY 1")
def d25(spark, d):
    c = cells(spark, d).withColumn("importance", F.round(F.col("l_extendedprice") % 1000 / 1000, 5))
    out = R.importance_composition(rank_within(c, "importance", 100), c, {"bulk": matches(F.col("mask"), *SIGNATURES["bulk"])}, 50)
    return out.withColumn("bulk", F.round("bulk", 6))
