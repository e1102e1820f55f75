"""Queries on populations: predicates, counts, fractions, projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metadata as M
from ..operators import populations as P
from ..sources.tables import CELLS, CHANNELS, cells, table
from .registry import query

_C = f"WITH cells AS ({CELLS}) "
SIGNATURES = {
    "returned": P.signature(["RET"], ["OPEN"], CHANNELS), "bulk": P.signature(["BULK"], [], CHANNELS),
    "bulk_taxed": P.signature(["BULK", "TAXED"], ["RET"], CHANNELS), "everything": P.signature([], [], CHANNELS),
}
_WHEN = {"returned": "mask & 1 = 1 AND mask & 2 = 0", "bulk": "mask & 4 = 4", "bulk_taxed": "mask & 20 = 20 AND mask & 1 = 0", "everything": "TRUE"}
_WHEN = {k: v.replace("mask & 1 ", "(mask & 1) ").replace("mask & 2 ", "(mask & 2) ").replace("mask & 4 ", "(mask & 4) ").replace("mask & 20 ", "(mask & 20) ") for k, v in _WHEN.items()}


def _sums(names) -> str:
    return ", ".join(f"CAST(count(*) FILTER ({_WHEN[n]}) AS BIGINT) AS {n}" for n in names)


@query("b01_signature_cells", _C + f"SELECT specimen, structure FROM cells WHERE {_WHEN['bulk_taxed']}")
def b01(spark, d):
    return cells(spark, d).where(P.matches(F.col("mask"), *SIGNATURES["bulk_taxed"])).select("specimen", "structure")


@query("b02_boolean_columns", _C + f"SELECT specimen, count(*) AS n FROM cells WHERE {_WHEN['bulk_taxed']} GROUP BY specimen")
def b02(spark, d):
    wide = cells(spark, d).select("specimen", *(c.cast("boolean").alias(n) for c, n in zip(P.unpack(F.col("mask"), CHANNELS), CHANNELS, strict=True)))
    return wide.where(P.matches_columns([F.col("BULK"), F.col("TAXED")], [F.col("RET")])).groupBy("specimen").agg(F.count("*").alias("n"))


@query("b04_pack_masks", """
WITH calls AS (SELECT l_orderkey, l_linenumber, l_partkey, 'DISC' AS target, CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END AS positive FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'BULK', CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'TAXED', CASE WHEN l_tax > 0.04 THEN 1 ELSE 0 END FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CAST(bit_or(CAST(positive AS BIGINT) << (CASE target WHEN 'BULK' THEN 0 WHEN 'DISC' THEN 1 ELSE 2 END)) AS BIGINT) AS mask
FROM calls GROUP BY ALL""")
def b04(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_discount") > 0.05).cast("int").alias("DISC"), (F.col("l_quantity") > 25).cast("int").alias("BULK"), (F.col("l_tax") > 0.04).cast("int").alias("TAXED"))
    calls = rows.unpivot(["l_orderkey", "l_linenumber", "l_partkey"], ["DISC", "BULK", "TAXED"], "target", "positive")
    names = calls.sparkSession.createDataFrame([("DISC",), ("BULK",), ("TAXED",)], "target string")
    return P.pack(calls, P.channel_bits(names), ["l_orderkey", "l_linenumber", "l_partkey"])


@query("b05_unpack_masks", _C + "SELECT structure, " + ", ".join(f"CAST((mask >> {i}) & 1 AS INT) AS {c}" for i, c in enumerate(CHANNELS)) + " FROM cells")
def b05(spark, d):
    return cells(spark, d).select("structure", *P.unpack(F.col("mask"), CHANNELS))


_B07 = "SELECT * FROM (VALUES ('returned', 'RET', 'OPEN', TRUE), ('1', 'BULK', '', TRUE), ('TAXED', 'TAXED', '', TRUE), ('', '', '', TRUE), ('NONE', '', '', FALSE)) AS t(handle, positive, negative, known)"


@query("b07_phenotype_handles", f"WITH h AS ({_B07}), n AS (SELECT count(DISTINCT n_regionkey) AS regions FROM nation) SELECT h.*, regions FROM h, n")
def b07(spark, d):
    composites = spark.createDataFrame([(0, "returned", "RET", "positive"), (0, "returned", "OPEN", "negative"), (1, "bulk", "BULK", "positive")], "identifier int, name string, marker string, polarity string")
    channels = spark.createDataFrame([(c,) for c in CHANNELS], "target string")
    handles = spark.createDataFrame([("returned",), ("1",), ("TAXED",), ("",), ("NONE",)], "handle string")
    found = P.resolve_handles(handles, composites, channels)
    regions = table(spark, d, "nation").agg(F.count_distinct("n_regionkey").alias("regions"))
    return found.select("handle", F.array_join("positive", ";").alias("positive"), F.array_join("negative", ";").alias("negative"), "known").crossJoin(F.broadcast(regions))


@query("b10_restrict_to_cells", f"SELECT structure, mask FROM ({CELLS}) WHERE l_extendedprice > 50000")
def b10(spark, d):
    c = cells(spark, d)
    return P.restrict(c, c.where("l_extendedprice > 50000")).select("structure", "mask")


@query("b12_specimens", "SELECT DISTINCT l_suppkey AS specimen FROM lineitem")
def b12(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("specimen")).distinct().orderBy("specimen")


@query("b13_drop_discrete", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_tax FROM lineitem")
def b13(spark, d):
    columns = ["l_quantity", "l_tax", "l_linestatus"]
    return P.drop_discrete(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *columns), columns)


@query("b14_shifted_positions", _C + """, m AS (SELECT *, min(x) OVER w AS mx, min(y) OVER w AS my FROM cells WINDOW w AS (PARTITION BY specimen))
SELECT structure, CAST(trunc(CASE WHEN mx <= 1 OR my <= 1 THEN x - mx + 1 ELSE x END) AS INT) AS x, CAST(trunc(CASE WHEN mx <= 1 OR my <= 1 THEN y - my + 1 ELSE y END) AS INT) AS y FROM m""")
def b14(spark, d):
    from ..operators.spatial import integer_positions

    return integer_positions(cells(spark, d)).select("structure", "x", "y")


@query("b15_scaled_intensities", _C + "SELECT structure, round(l_quantity / 10, 6) AS q, round(l_extendedprice / 10, 6) AS p FROM cells")
def b15(spark, d):
    return cells(spark, d).select("structure", F.round(F.col("l_quantity") / 10, 6).alias("q"), F.round(F.col("l_extendedprice") / 10, 6).alias("p"))


@query("d01_counts", _C + f"SELECT specimen, {_sums(SIGNATURES)}, count(*) AS all_cells FROM cells GROUP BY specimen")
def d01(spark, d):
    return P.counts(cells(spark, d), SIGNATURES)


_PCT = "CASE WHEN all_cells IS NULL OR all_cells = 0 THEN NULL WHEN n = 0 THEN 0.0 ELSE 100 * round_even(CAST(n AS DOUBLE) / all_cells * 10000, 0) / 10000 END"


@query("d02_fractions", _C + f", c AS (SELECT specimen, count(*) FILTER ({_WHEN['bulk_taxed']}) AS n, count(*) AS all_cells FROM cells GROUP BY specimen) SELECT s_suppkey AS specimen, n, all_cells, round({_PCT}, 6) AS percentage FROM supplier LEFT JOIN c ON s_suppkey = specimen")
def d02(spark, d):
    who = table(spark, d, "supplier").select(F.col("s_suppkey").alias("specimen"))
    n = P.counts(cells(spark, d), {"n": SIGNATURES["bulk_taxed"]}, who)
    return n.withColumn("percentage", F.round(P.percentage(F.col("n"), F.col("all_cells")), 6))


def _many() -> list[tuple[str, int, int]]:
    return [(f"s{p}_{n}", p, n) for p in range(8) for n in range(0, 32, 4) if not p & n]


@query("d03_counts_batch", _C + ", s AS (SELECT 's' || p || '_' || n AS signature, p, n AS neg FROM range(8) a(p), range(0, 32, 4) b(n) WHERE (p & n) = 0) SELECT signature, specimen, count(*) FILTER ((mask & p) = p AND (mask & neg) = 0) AS n FROM cells, s GROUP BY signature, specimen")
def d03(spark, d):
    return P.counts_long(cells(spark, d), spark.createDataFrame(_many(), "signature string, positive long, negative long"))


@query("d04_overlap_grid", _C + " SELECT first, second, round(fraction, 9) AS fraction FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS first, '{b}' AS second, count(*) FILTER (({_WHEN[a]}) AND ({_WHEN[b]})) / count(*) AS fraction FROM cells"
    for i, a in enumerate(SIGNATURES) for b in list(SIGNATURES)[i:]) + ")")
def d04(spark, d):
    return P.overlap_grid(cells(spark, d), SIGNATURES).withColumn("fraction", F.round("fraction", 9))


@query("d05_study_summary", "SELECT count(DISTINCT l_suppkey) AS specimens, count(*) AS cells, CAST(5 AS BIGINT) AS channels, CAST(4 AS BIGINT) AS phenotypes FROM lineitem")
def d05(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("specimen"))
    return P.summary(rows, len(CHANNELS), len(SIGNATURES))


@query("d06_cells_by_specimen", "SELECT l_suppkey AS specimen, count(*) AS n FROM lineitem GROUP BY 1")
def d06(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("specimen")).agg(F.count("*").alias("n"))


@query("d10_extents", _C + "SELECT specimen, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max, count(*) AS n FROM cells GROUP BY specimen")
def d10(spark, d):
    return P.extents(cells(spark, d))


@query("d11_pivot_measures", "SELECT l_suppkey AS specimen, " + ", ".join(f"round(avg(l_quantity) FILTER (l_returnflag = '{f}'), 6) AS {f}_quantity, count(*) FILTER (l_returnflag = '{f}') AS {f}_n" for f in "ANR") + " FROM lineitem GROUP BY 1")
def d11(spark, d):
    wide = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("specimen")).pivot("l_returnflag", list("ANR")).agg(F.round(F.avg("l_quantity"), 6).alias("quantity"), F.count("l_suppkey").alias("n"))
    return wide.fillna(0, [f"{f}_n" for f in "ANR"])


@query("d12_same_channels", "SELECT l_returnflag AS channel, count(DISTINCT l_suppkey) AS structures, count(DISTINCT l_suppkey) = (SELECT count(DISTINCT l_suppkey) FROM lineitem) AS complete FROM lineitem GROUP BY 1")
def d12(spark, d):
    return P.channel_coverage(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("structure"), F.col("l_returnflag").alias("channel")))


@query("d13_feature_matrix", _C + 'SELECT specimen, structure, x, y, ' + ", ".join(f'CAST((mask >> {i}) & 1 AS INT) AS "C {c}"' for i, c in enumerate(CHANNELS)) + ", " + ", ".join(f'CAST({w} AS INT) AS "P {k}"' for k, w in _WHEN.items()) + ', l_tax AS "I l_tax" FROM cells')
def d13(spark, d):
    return P.feature_matrix(cells(spark, d), CHANNELS, SIGNATURES, ["l_tax"])


@query("d20_row_counts", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in ("lineitem", "orders", "events", "supplier")))
def d20(spark, d):
    from functools import reduce

    one = [table(spark, d, t).agg(F.lit(t).alias("table_name"), F.count("*").alias("n")) for t in ("lineitem", "orders", "events", "supplier")]
    return reduce(lambda a, b: a.union(b), one)


@query("d27_channel_presence", "SELECT l_shipdate_year AS symbol, " + ", ".join(f"CAST(max(CASE WHEN f = '{f}' THEN 1 ELSE 0 END) AS INT) AS {f}" for f in "ANR") + ", count(DISTINCT f) AS studies FROM (SELECT CAST(year(l_shipdate) AS VARCHAR) || ' ' || CAST(month(l_shipdate) AS VARCHAR) AS l_shipdate_year, l_returnflag AS f FROM lineitem) GROUP BY 1")
def d27(spark, d):
    rows = table(spark, d, "lineitem").select(F.concat_ws(" ", F.year("l_shipdate"), F.month("l_shipdate")).alias("symbol"), F.col("l_returnflag").alias("study"))
    return P.phenotype_presence(rows.distinct(), list("ANR"))


@query("c06_extract_mismatch", _C + "SELECT structure, 1 AS in_left, 0 AS in_right FROM cells WHERE NOT l_tax > 0.01")
def c06(spark, d):
    c = cells(spark, d)
    return P.mismatched(c, c.where("l_tax > 0.01"), ["structure"]).fillna(0)


@query("g02_channels_in_every_file", "WITH h AS (SELECT l_suppkey AS f, l_shipmonth || ' Positive' AS h FROM (SELECT *, 'M' || month(l_shipdate) AS l_shipmonth FROM lineitem)) SELECT 'Positive' AS kind, replace(h, ' Positive', '') AS channel FROM h GROUP BY h HAVING count(DISTINCT f) = (SELECT count(DISTINCT f) FROM h)")
def g02(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("file"), F.concat(F.lit("M"), F.month("l_shipdate"), F.lit(" Positive")).alias("header"))
    return P.in_every_file(rows.distinct())


@query("h16_display_names", "SELECT CASE WHEN l_quantity > 25 THEN 'BULK+' ELSE '' END || CASE WHEN l_quantity > 25 THEN ' ' ELSE '' END || 'RET-' AS name, count(*) AS n FROM lineitem GROUP BY 1")
def h16(spark, d):
    positive = F.when(F.col("l_quantity") > 25, F.array(F.lit("BULK"))).otherwise(F.array().cast("array<string>"))
    rows = table(spark, d, "lineitem").select(P.phenotype_of(P.phenotype_text(positive, F.array(F.lit("RET")))).alias("p"))
    return rows.groupBy(P.display_name(F.col("p.positive"), F.col("p.negative")).alias("name")).agg(F.count("*").alias("n"))


@query("d27_split_channels", "WITH c AS (SELECT l_returnflag AS study, l_shipmode AS symbol, l_linestatus AS mechanism FROM (SELECT l_returnflag, l_linestatus, 'm' || l_suppkey % 7 AS l_shipmode FROM lineitem)), s AS (SELECT study, unnest(CASE symbol WHEN 'm1' THEN ['m2', 'x'] WHEN 'm3' THEN ['y'] ELSE [symbol] END) AS symbol FROM c WHERE mechanism <> 'F') SELECT symbol, " + ", ".join(f"CAST(max(CASE WHEN study = '{f}' THEN 1 ELSE 0 END) AS INT) AS {f}" for f in "ANR") + ", count(DISTINCT study) AS studies FROM s GROUP BY 1 HAVING count(DISTINCT study) = 1")
def d27_split(spark, d):
    """The channels that only one study has, after merged names are split and computed ones dropped."""
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("study"), F.concat(F.lit("m"), F.col("l_suppkey") % 7).alias("symbol"), F.col("l_linestatus").alias("mechanism"))
    return P.in_one_study(P.phenotype_presence(P.study_channels(rows, {"m1": ("m2", "x"), "m3": ("y",)}, ["F"]), list("ANR")))


@query("d20_count_changes", "SELECT t AS table_name, b AS n_before, a AS n_after, a - b AS change FROM (SELECT 'orders' AS t, count(*) FILTER (o_orderstatus = 'F') AS b, count(*) AS a FROM orders UNION ALL SELECT 'events', count(*) FILTER (event_type = 'click'), count(*) FROM events) WHERE a <> b")
def d20_changes(spark, d):
    tables = {t: table(spark, d, t) for t in ("orders", "events", "nation")}
    before = M.row_counts({"orders": tables["orders"].where("o_orderstatus = 'F'"), "events": tables["events"].where("event_type = 'click'"), "nation": tables["nation"]})
    return M.count_changes(before, M.row_counts(tables))
