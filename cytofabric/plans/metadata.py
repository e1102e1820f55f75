"""Queries on metadata joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as FS
from ..operators import graphs, metadata as M
from ..sources.tables import CELLS, SAMPLES, cells, samples, table
from .features import _V, shares
from .registry import query


@query("c01_cell_chain", "SELECT o_orderkey AS structure, c_nationkey AS specimen FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def c01(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("structure"), F.col("o_custkey").alias("data_file"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("data_file"), F.col("c_nationkey").alias("process"))
    return M.cell_chain(o, c, table(spark, d, "nation").select(F.col("n_nationkey").alias("process"), F.col("n_nationkey").alias("specimen")))


@query("c02_relevant_specimens", "SELECT DISTINCT s_suppkey AS specimen FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = (SELECT n_regionkey FROM nation WHERE n_nationkey = 3)")
def c02(spark, d):
    n = table(spark, d, "nation").select(F.col("n_regionkey").alias("primary_study"), F.col("n_nationkey").cast("string").alias("component_study"))
    return M.relevant_specimens(n, "3", table(spark, d, "supplier").select(F.col("s_suppkey").alias("specimen"), F.col("s_nationkey").cast("string").alias("study")))


@query("c05_values_by_cohort", f"{_V} SELECT feature, cohort, count(*) AS n, round(avg(value), 9) AS mean FROM vals GROUP BY ALL")
def c05(spark, d):
    return shares(spark, d).groupBy("feature", "cohort").agg(F.count("*").alias("n"), F.round(F.avg("value"), 9).alias("mean"))


@query("c11_pixels_onto_segments", "SELECT a.l_suppkey AS sample, a.l_orderkey AS row, a.l_partkey AS col, a.l_linenumber AS segment, coalesce(b.l_tax, -1) AS tax FROM lineitem a LEFT JOIN (SELECT * FROM lineitem WHERE l_returnflag = 'R' QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_orderkey, l_partkey ORDER BY l_linenumber) = 1) b ON a.l_suppkey = b.l_suppkey AND a.l_orderkey = b.l_orderkey AND a.l_partkey = b.l_partkey")
def c11(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("sample"), F.col("l_orderkey").alias("row"), F.col("l_partkey").alias("col"), F.col("l_linenumber").alias("segment"), "l_tax", "l_returnflag")
    channel = rows.where("l_returnflag = 'R'").groupBy("sample", "row", "col").agg(F.min_by("l_tax", "segment").alias("value"))
    return M.onto_segments(rows.select("sample", "row", "col", "segment"), channel, "tax").fillna(-1, ["tax"])


@query("c13_grouped_channels", "SELECT n_regionkey AS \"group\", r_name AS color, n_name AS channel FROM nation JOIN region ON n_regionkey = r_regionkey")
def c13(spark, d):
    n = table(spark, d, "nation").select(F.col("n_regionkey").alias("group"), F.col("n_name").alias("channel"))
    return M.grouped_channels(n, table(spark, d, "region").select(F.col("r_regionkey").alias("group"), F.col("r_name").alias("color")))


@query("c14_supplemented_channels", "SELECT p_partkey, p_name, coalesce(s_name, '') AS s_name FROM part LEFT JOIN supplier ON p_partkey = s_suppkey")
def c14(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("p_partkey"), "s_name")
    return M.supplemented(table(spark, d, "part").select("p_partkey", "p_name"), s, "p_partkey").fillna("", ["s_name"])


@query("c15_importance_counts", f"WITH cells AS ({CELLS}), samples AS ({SAMPLES}) SELECT specimen, any_value(cohort) AS cohort, count(*) AS all_cells, count(*) FILTER ((mask & 20) = 20) AS both, count(*) FILTER ((mask & 4) = 4) AS one, count(*) FILTER ((mask & 16) = 16) AS two FROM cells JOIN samples USING (specimen) GROUP BY 1")
def c15(spark, d):
    return M.importance_counts(cells(spark, d), samples(spark, d).select("specimen", "cohort"), (4, 0), (16, 0))


@query("c16_important_cells", f"WITH cells AS ({CELLS}) SELECT specimen, count(*) AS n FROM cells WHERE l_extendedprice > 70000 GROUP BY 1")
def c16(spark, d):
    c = cells(spark, d)
    top = c.where("l_extendedprice > 70000").select("structure")
    return c.join(top, "structure", "left_semi").groupBy("specimen").agg(F.count("*").alias("n"))


@query("d23_roi_side", f"WITH cells AS ({CELLS}), b AS (SELECT count(*) AS n, (max(x) - min(x)) * (max(y) - min(y)) AS area FROM cells GROUP BY specimen) SELECT CAST(round_even(sqrt(50 / quantile_cont(n / area, 0.5)), 0) AS BIGINT) AS side, CAST((SELECT count(*) FROM nation) AS BIGINT) AS nations FROM b")
def d23(spark, d):
    side = graphs.roi_side(cells(spark, d), 50)
    return table(spark, d, "nation").agg(F.lit(side).cast("long").alias("side"), F.count("*").alias("nations"))


@query("d24_mean_intensities", "SELECT l_suppkey AS sample, round(avg(l_quantity), 6) AS l_quantity, round(avg(l_tax), 6) AS l_tax FROM lineitem GROUP BY 1")
def d24(spark, d):
    out = M.mean_intensities(table(spark, d, "lineitem").withColumnRenamed("l_suppkey", "sample"), ["l_quantity", "l_tax"])
    return out.select("sample", F.round("l_quantity", 6).alias("l_quantity"), F.round("l_tax", 6).alias("l_tax"))


@query("d26_baseline_means", f"{_V} SELECT feature, round(avg(value), 9) AS mean, CAST(count(*) FILTER (value > 0) AS BIGINT) AS present FROM vals GROUP BY 1")
def d26(spark, d):
    return M.baseline_means(shares(spark, d), {"bulk": "", "bulk_taxed": ""}).withColumn("mean", F.round("mean", 9))


@query("g04_samples_with_cohort", "SELECT s_suppkey AS specimen FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49) AND s_nationkey < 12")
def g04(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("specimen"), "s_nationkey")
    measured = table(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_suppkey").alias("specimen")).distinct()
    return M.with_cohort(s, measured, s.where("s_nationkey < 12")).select("specimen")


@query("g05_complete_samples", f"{_V} SELECT DISTINCT subject AS specimen FROM vals WHERE subject NOT IN (SELECT subject FROM vals WHERE value IS NULL)")
def g05(spark, d):
    return M.complete_samples(shares(spark, d).withColumnRenamed("subject", "specimen"))


@query("i03_tests_by_study", f"{_V}, v AS (SELECT CASE WHEN subject % 2 = 0 THEN 'fractions A' ELSE 'other' END AS study, * FROM vals), m AS (SELECT study, feature, cohort, CAST(count(value) AS DOUBLE) AS n, avg(value) AS m, var_samp(value) AS v FROM v WHERE value IS NOT NULL AND study LIKE '%fraction%' GROUP BY ALL HAVING count(value) >= 2) SELECT a.study, a.feature, a.cohort AS cohort_1, b.cohort AS cohort_2, round((a.m - b.m) / sqrt(((a.n-1)*a.v + (b.n-1)*b.v) / (a.n+b.n-2) * (1/a.n + 1/b.n)), 5) AS t FROM m a JOIN m b ON a.study = b.study AND a.feature = b.feature AND CAST(a.cohort AS VARCHAR) < CAST(b.cohort AS VARCHAR)")
def i03(spark, d):
    v = shares(spark, d).withColumn("study", F.when(F.col("subject") % 2 == 0, "fractions A").otherwise("other"))
    return M.tests_by_study(v).select("study", "feature", "cohort_1", "cohort_2", F.round("t", 5).alias("t"))


@query("l03_compute_if_missing", f"{_V} SELECT feature, subject, round(coalesce(value, -1), 9) AS value FROM vals UNION ALL SELECT 'bulk_taxed', specimen, 0.5 FROM samples WHERE specimen % 10 = 3")
def l03(spark, d):
    v = shares(spark, d).drop("cohort")
    expected = samples(spark, d).select(F.col("specimen").alias("subject")).crossJoin(F.broadcast(spark.createDataFrame([("bulk",), ("bulk_taxed",)], "feature string")))
    out = M.compute_if_missing(expected, v, lambda due: due.withColumn("value", F.lit(0.5)))
    return out.select("feature", "subject", F.round(F.coalesce("value", F.lit(-1.0)), 9).alias("value"))


@query("l03_pending", f"""{_V}, e AS (SELECT feature, count(*) AS expected FROM samples, (VALUES ('bulk'), ('bulk_taxed'), ('none')) AS f(feature) GROUP BY 1)
SELECT feature, expected, count(vals.subject) AS computed, count(vals.subject) <> expected AS pending FROM e LEFT JOIN vals USING (feature) GROUP BY feature, expected""")
def l03_pending(spark, d):
    wanted = spark.createDataFrame([("bulk",), ("bulk_taxed",), ("none",)], "feature string")
    expected = samples(spark, d).select(F.col("specimen").alias("subject")).crossJoin(F.broadcast(wanted))
    return FS.progress(expected, shares(spark, d))


@query("l06_available_plugins", "SELECT DISTINCT CASE o_orderpriority WHEN '1-URGENT' THEN 'cg-gnn' ELSE o_orderpriority END AS plugin FROM orders")
def l06(spark, d):
    o = table(spark, d, "orders").select(F.lit("gnn importance score").alias("method"), F.array(F.when(F.col("o_orderpriority") == "1-URGENT", "CGGNN").otherwise(F.col("o_orderpriority"))).alias("specifiers"))
    return M.available_plugins(o).select(M.canonical_plugin(F.col("plugin")).alias("plugin"))


@query("a12_replaced_artifacts", "SELECT o_orderstatus AS study, o_orderkey AS id, o_orderpriority AS text FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT 'F', l_orderkey * 8 + l_linenumber, l_linestatus FROM lineitem WHERE l_quantity > 49")
def a12(spark, d):
    """The artifacts of one study are synchronised with new ones."""
    o, new = table(spark, d, "orders"), table(spark, d, "lineitem").where("l_quantity > 49")
    old = o.select(F.col("o_orderstatus").alias("study"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("text"))
    return M.replaced(old, new.select(F.lit("F").alias("study"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.col("l_linestatus").alias("text")))
