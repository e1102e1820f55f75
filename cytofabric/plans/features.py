"""Queries on feature tables and cohort statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as L
from ..operators import populations as P
from ..sources.tables import CELLS, SAMPLES, cells, samples, table
from .populations import SIGNATURES
from .registry import query

#: Two features of each specimen: shares of two signatures.
_V = f"""WITH cells AS ({CELLS}), samples AS ({SAMPLES}),
shares AS (SELECT specimen, count(*) FILTER ((mask & 4) = 4) / count(*) AS bulk, count(*) FILTER ((mask & 20) = 20 AND (mask & 1) = 0) / count(*) AS bulk_taxed FROM cells GROUP BY 1),
vals AS (SELECT 'bulk' AS feature, specimen AS subject, bulk AS value, cohort FROM shares JOIN samples USING (specimen) UNION ALL SELECT 'bulk_taxed', specimen, CASE WHEN specimen % 7 = 0 THEN NULL ELSE bulk_taxed END, cohort FROM shares JOIN samples USING (specimen) WHERE specimen % 10 <> 3)"""


def shares(spark, d):
    n = P.counts(cells(spark, d), {k: SIGNATURES[k] for k in ("bulk", "bulk_taxed")})
    rows = n.select("specimen", (F.col("bulk") / F.col("all_cells")).alias("bulk"), (F.col("bulk_taxed") / F.col("all_cells")).alias("bulk_taxed")).unpivot(["specimen"], ["bulk", "bulk_taxed"], "feature", "value")
    rows = rows.where("feature = 'bulk' or specimen % 10 <> 3").withColumn("value", F.when((F.col("feature") == "bulk") | (F.col("specimen") % 7 != 0), F.col("value")))
    return rows.join(samples(spark, d), "specimen").select("feature", F.col("specimen").alias("subject"), "value", "cohort")


def _expected(spark, d):
    names = spark.createDataFrame([("bulk",), ("bulk_taxed",)], "feature string")
    return samples(spark, d).select(F.col("specimen").alias("subject")).crossJoin(F.broadcast(names))


@query("l04_feature_values", f"{_V} SELECT subject, round(value, 9) AS value FROM vals WHERE feature = 'bulk'")
def l04(spark, d):
    return L.values_of(shares(spark, d), "bulk").withColumn("value", F.round("value", 9))


@query("c10_missing_values", f"{_V} SELECT f AS feature, specimen AS subject FROM samples, (VALUES ('bulk'), ('bulk_taxed')) AS t(f) WHERE (f, specimen) NOT IN (SELECT (feature, subject) FROM vals)")
def c10(spark, d):
    return L.missing(_expected(spark, d), shares(spark, d)).select("feature", "subject")


@query("c12_zero_filled", f"{_V} SELECT f AS feature, specimen AS subject, coalesce(round(v.value, 9), CASE WHEN v.subject IS NULL THEN 0 END, -1) AS value FROM samples CROSS JOIN (VALUES ('bulk'), ('bulk_taxed')) AS t(f) LEFT JOIN vals v ON v.feature = f AND v.subject = specimen")
def c12(spark, d):
    v = shares(spark, d).drop("cohort")
    who = samples(spark, d).select(F.col("specimen").alias("subject"))
    return L.zero_filled(v, who).select("feature", "subject", F.coalesce(F.round("value", 9), F.lit(-1.0)).alias("value"))


@query("c04_matching_specifiers", "SELECT o_custkey AS request, o_custkey AS feature FROM orders GROUP BY o_custkey HAVING count(*) >= 3 ORDER BY 1")
def c04(spark, d):
    o = table(spark, d, "orders")
    w = F.array_sort(F.collect_list(F.struct("o_orderkey", F.col("o_orderkey").cast("string").alias("s"))))
    wanted = o.groupBy(F.col("o_custkey").alias("request")).agg(F.transform(w, lambda x: x.s).alias("specifiers")).where("size(specifiers) >= 3")
    rows = o.select(F.col("o_custkey").alias("feature"), F.col("o_orderkey").alias("ordinality"), F.col("o_orderkey").cast("string").alias("specifier"))
    return L.matching_features(rows, wanted)


@query("l01_specifications", "SELECT sha256('population fractions' || chr(31) || o_orderstatus || chr(30) || o_orderpriority || chr(31)) AS feature, o_orderstatus AS first, o_orderpriority AS second FROM orders GROUP BY ALL HAVING o_orderstatus <> 'F'")
def l01(spark, d):
    o = table(spark, d, "orders").select(F.lit("population fractions").alias("method"), F.array("o_orderstatus", "o_orderpriority").alias("specifiers"))
    new = L.new_specifications(o, L.specifications(o.where("specifiers[0] = 'F'")))
    return new.select("feature", F.col("specifiers")[0].alias("first"), F.col("specifiers")[1].alias("second"))


@query("l05_drop_features", f"{_V} SELECT feature, subject FROM vals WHERE feature <> 'bulk'")
def l05(spark, d):
    v = shares(spark, d)
    return L.without_features(v, spark.createDataFrame([("bulk",)], "feature string")).select("feature", "subject")


@query("l08_equal_cell_sets", "SELECT a.o_custkey AS set_a, b.o_orderpriority AS set_b FROM (SELECT o_custkey, list_sort(list(DISTINCT o_orderstatus)) AS l FROM orders GROUP BY 1) a JOIN (SELECT o_orderpriority, list_sort(list(DISTINCT o_orderstatus)) AS l FROM orders GROUP BY 1) b ON a.l = b.l")
def l08(spark, d):
    """Which customers' orders have just the statuses that a priority's orders have: every set of one kind against every one of the other, of which there are few."""
    o = table(spark, d, "orders")
    return L.equal_cell_sets(o.select(F.col("o_custkey").alias("set_a"), F.col("o_orderstatus").alias("structure")), o.select(F.col("o_orderpriority").alias("set_b"), F.col("o_orderstatus").alias("structure")))


@query("l08_cell_set_classes", "SELECT o_custkey AS set_id, min(o_custkey) OVER (PARTITION BY l) AS class_id, count(*) OVER (PARTITION BY l) AS class_size FROM (SELECT o_custkey, list_sort(list(DISTINCT o_orderstatus)) AS l FROM orders GROUP BY 1)")
def l08_classes(spark, d):
    return L.cell_set_classes(table(spark, d, "orders").select(F.col("o_custkey").alias("set_id"), F.col("o_orderstatus").alias("structure")))


@query("e06_latest_run", "SELECT event_type AS plugin, CAST(max(event_id) AS BIGINT) AS run FROM events WHERE event_type = 'click' GROUP BY 1")
def e06(spark, d):
    return L.latest_run(table(spark, d, "events").select(F.col("event_type").alias("plugin"), F.col("event_id").cast("long").alias("run")), "click")


@query("l11_outdated", "SELECT DISTINCT l_returnflag AS derivative, s_suppkey AS specimen FROM supplier, (SELECT DISTINCT l_returnflag FROM lineitem WHERE l_quantity > 49) f WHERE (l_returnflag, s_suppkey) NOT IN (SELECT (l_returnflag, l_suppkey) FROM lineitem WHERE l_quantity > 49)")
def l11(spark, d):
    made = table(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_returnflag").alias("derivative"), F.col("l_suppkey").alias("specimen")).distinct()
    return L.outdated(table(spark, d, "supplier").select(F.col("s_suppkey").alias("specimen")), made)


@query("d19_completeness", f"{_V}, s AS (SELECT feature, count(*) FILTER (value IS NULL) AS n_null, count(value) AS n_value, (SELECT count(*) FROM samples) AS expected FROM vals GROUP BY 1) SELECT *, n_null >= 5 OR n_null / (n_null + n_value) >= 0.2 OR (expected - n_null - n_value) / expected >= 0.1 AS suspicious FROM s")
def d19(spark, d):
    return L.completeness(shares(spark, d), _expected(spark, d))


_T = f"""{_V}, m AS (SELECT feature, cohort, CAST(count(value) AS DOUBLE) AS n, avg(value) AS m, var_samp(value) AS v FROM vals WHERE value IS NOT NULL GROUP BY ALL HAVING count(value) >= 2),
p AS (SELECT a.feature, a.cohort AS cohort_1, b.cohort AS cohort_2, a.n AS n1, b.n AS n2, a.m AS m1, b.m AS m2, a.v AS v1, b.v AS v2 FROM m a JOIN m b ON a.feature = b.feature AND CAST(a.cohort AS VARCHAR) < CAST(b.cohort AS VARCHAR))"""


@query("i01_t_tests", f"{_T} SELECT feature, cohort_1, cohort_2, round((m1 - m2) / sqrt(((n1-1)*v1 + (n2-1)*v2) / (n1+n2-2) * (1/n1 + 1/n2)), 6) AS t, n1 + n2 - 2 AS df FROM p")
def i01(spark, d):
    return L.cohort_tests(shares(spark, d)).select("feature", "cohort_1", "cohort_2", F.round("t", 6).alias("t"), "df")


@query("i04_welch_and_fold", f"{_T} SELECT feature, cohort_1, cohort_2, round((m1 - m2) / sqrt(v1/n1 + v2/n2), 6) AS t, round((v1/n1 + v2/n2) * (v1/n1 + v2/n2) / (v1*v1/n1/n1/(n1-1) + v2*v2/n2/n2/(n2-1)), 5) AS df, round(m2 / m1, 6) AS fold FROM p")
def i04(spark, d):
    v = shares(spark, d)
    t = L.cohort_tests(v, equal_variances=False).join(L.fold_change(v), ["feature", "cohort_1", "cohort_2"])
    return t.select("feature", "cohort_1", "cohort_2", F.round("t", 6).alias("t"), F.round("df", 5).alias("df"), F.round("fold", 6).alias("fold"))


@query("i02_untested", f"{_V} SELECT feature, count(*) AS n FROM vals WHERE feature = 'bulk' GROUP BY 1")
def i02(spark, d):
    v = shares(spark, d)
    return L.untested(v, v.where("feature = 'bulk_taxed'")).groupBy("feature").agg(F.count("*").alias("n"))


@query("i05_auc", f"{_V}, l AS (SELECT feature, value, CAST(cohort > 2 AS INT) AS label FROM vals WHERE value IS NOT NULL), r AS (SELECT p.feature, sum(CASE WHEN n.value <= p.value THEN 1.0 ELSE 0 END) / count(*) AS a FROM l p JOIN l n ON p.feature = n.feature AND p.label = 1 AND n.label = 0 GROUP BY 1) SELECT feature, round(greatest(a, 1 - a), 6) AS auc FROM r")
def i05(spark, d):
    v = shares(spark, d).where("value is not null").select("feature", "value", (F.col("cohort") > 2).cast("int").alias("label"))
    return L.auc(v).withColumn("auc", F.round("auc", 6))


@query("e09_roc_curve", f"""{_V}, l AS (SELECT feature, value, CAST(cohort > 2 AS INT) AS label FROM vals WHERE value IS NOT NULL),
n AS (SELECT feature, sum(label) AS pos, sum(1 - label) AS neg FROM l GROUP BY 1), r AS (SELECT feature, row_number() OVER w AS place, sum(label) OVER w AS ones FROM l WINDOW w AS (PARTITION BY feature ORDER BY value, label ROWS UNBOUNDED PRECEDING))
SELECT feature, place, round(ones / pos, 9) AS positives, round((neg - place + ones) / neg, 9) AS negatives FROM r JOIN n USING (feature) UNION ALL SELECT feature, 0, 0.0, 1.0 FROM n""")
def e09(spark, d):
    v = shares(spark, d).select("feature", "value", (F.col("cohort") > 2).cast("int").alias("label"))
    return L.roc_points(v).select("feature", "place", F.round("positives", 9).alias("positives"), F.round("negatives", 9).alias("negatives"))


@query("i06_fractions_by_cohort", f"{_V} SELECT feature, cohort, count(*) FILTER (value <> 0) AS n, round(avg(value) FILTER (value <> 0), 9) AS mean, count(*) FILTER (value = 0) AS omitted FROM vals WHERE value IS NOT NULL GROUP BY ALL")
def i06(spark, d):
    return L.fractions_by_cohort(shares(spark, d).where("value is not null"), True).withColumn("mean", F.round("mean", 9))


@query("i07_importance_enrichment", f"WITH cells AS ({CELLS}), f AS (SELECT *, l_extendedprice > 50000 AS i, (mask & 4) = 4 AS p FROM cells) SELECT specimen, count(*) FILTER (i AND p) AS a, count(*) FILTER (i AND NOT p) AS b, count(*) FILTER (NOT i AND p) AS c, count(*) FILTER (NOT i AND NOT p) AS d, round(count(*) FILTER (i AND p) / count(*) FILTER (i), 9) AS fraction FROM f GROUP BY 1")
def i07(spark, d):
    x = L.importance_enrichment(cells(spark, d), F.col("l_extendedprice") > 50000, P.matches(F.col("mask"), *SIGNATURES["bulk"]))
    return x.select("specimen", "a", "b", "c", "d", F.round("fraction", 9).alias("fraction"))


_RUNS = "SELECT event_type AS plugin, event_id AS run, CAST(user_id % 3 AS VARCHAR) AS version, CASE WHEN user_id % 2 = 0 THEN 'cohort' ELSE 'outcome' END AS stratifier FROM events"


@query("e06_latest_run_of", f"WITH r AS ({_RUNS}) SELECT plugin, CAST(max(run) AS BIGINT) AS run, '1' AS version, 'cohort' AS stratifier FROM r WHERE plugin = 'click' AND version = '1' AND stratifier = 'cohort' GROUP BY 1")
def e06_of(spark, d):
    runs = table(spark, d, "events").select(F.col("event_type").alias("plugin"), F.col("event_id").cast("long").alias("run"), (F.col("user_id") % 3).cast("string").alias("version"), F.when(F.col("user_id") % 2 == 0, "cohort").otherwise("outcome").alias("stratifier"))
    return L.latest_run(runs, "click", version="1", stratifier="cohort")


@query("l10_importance_features", f"""WITH cells AS ({CELLS}), s AS (SELECT CASE WHEN (mask & 1) = 1 THEN 'one' ELSE 'two' END AS plugin, CAST(structure % 2 AS VARCHAR) AS run, specimen, structure, l_extendedprice AS importance FROM cells),
f AS (SELECT sha256('gnn importance score' || chr(31) || plugin || chr(30) || run || chr(30) || '1.0' || chr(30) || 'cohort' || chr(31)) AS feature, * FROM s)
SELECT feature, structure AS subject, CAST(row_number() OVER (PARTITION BY feature, specimen ORDER BY importance DESC, structure) AS INT) AS value FROM f QUALIFY value <= 20""")
def l10(spark, d):
    c = cells(spark, d)
    scores = c.select(F.when(F.col("mask").bitwiseAND(1) == 1, "one").otherwise("two").alias("plugin"), (F.col("structure") % 2).cast("string").alias("run"), F.lit("1.0").alias("version"), F.lit("cohort").alias("stratifier"), "specimen", "structure", F.col("l_extendedprice").alias("importance"))
    return L.importance_features(scores, 20)[1]


@query("l02_staged_values", "SELECT o_orderstatus = 'F' AS accepted, count(*) AS n FROM orders GROUP BY 1")
def l02(spark, d):
    o = table(spark, d, "orders")
    specifiers = F.when(F.col("o_orderstatus") == "F", F.array("o_orderpriority", "o_orderstatus")).when(F.col("o_orderstatus") == "O", F.array("o_orderstatus")).otherwise(F.array(F.lit(None), "o_orderstatus"))
    good, bad = L.staged(o.select(specifiers.alias("specifiers"), F.col("o_orderkey").alias("subject"), F.lit(1.0).alias("value")), 2)
    return good.select(F.lit(True).alias("accepted")).union(bad.select(F.lit(False))).groupBy("accepted").agg(F.count("*").alias("n"))
