"""The public questions a user asks of a study, each one DataFrame; and the streaming ones as batch queries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import collection_tag, without_tag
from ..operators import gating as G
from ..operators import populations as P
from ..operators import sampling as K
from ..operators import spatial as S
from ..operators.features import importance_enrichment
from ..operators.neighbors import new_folder, stored
from ..sources.tables import CELLS, CHANNELS, cells, table
from ..streaming.incremental import event_counts, ingest_cells, ingest_once, keep_counts, keep_features_up_to_date, read_counts, signature_counts
from .populations import SIGNATURES
from .registry import query

Phenotype = tuple[Sequence[str], Sequence[str]]


def study_names(studies: DataFrame, public: DataFrame, tag: str | None = None) -> DataFrame:
    """(handle, display_name, tag) of public studies: untagged or whitelisted (public: tag); of one tag, if named."""
    x = studies.select(F.col("study").alias("handle"), without_tag(F.col("study")).alias("display_name"), collection_tag(F.col("study")).alias("tag"))
    if tag is not None:
        return x.where(F.col("tag") == tag).orderBy("handle")
    return x.where("tag = ''").union(x.join(public, "tag", "left_semi").select(*x.columns)).orderBy("handle")


def channels(table_of: DataFrame) -> DataFrame:
    return table_of.select("symbol").distinct().orderBy("symbol")


def phenotype_counts(cells_: DataFrame, names: Sequence[str], phenotype: Phenotype, specimens: DataFrame | None = None) -> DataFrame:
    """(specimen, n, all_cells, percentage), samples without a value last."""
    n = P.counts(cells_, {"n": P.signature(*phenotype, names)}, specimens)
    return n.withColumn("percentage", P.percentage(F.col("n"), F.col("all_cells"))).orderBy(F.col("n").isNull(), "specimen")


def batch_spatial_metrics(cells_: DataFrame, names: Sequence[str], requests: Mapping[str, tuple[Sequence[Phenotype], str, float]], impute_zero: bool = False) -> DataFrame:
    """(request, specimen, value) of many requests name -> (phenotypes, metric, radius), as spatial_metrics() gives one; impute_zero: 0 for no value.

    All proximities come from one join of cells, the co-occurrences of each radius from another; all enrichments and autocorrelations from one stored graph.
    """
    cells_ = stored(S.integer_positions(cells_).select("specimen", "structure", "x", "y", "mask"))
    asked = {n: ([P.signature(*p, names) for p in phenotypes], metric, radius) for n, (phenotypes, metric, radius) in requests.items()}
    of = lambda metric: {n: (s, r) for n, (s, m, r) in asked.items() if m == metric}
    unknown = {m for _, m, _ in asked.values()} - {"proximity", "co-occurrence", "enrichment", "autocorrelation"}
    if unknown:
        raise ValueError(f"no metrics {sorted(unknown)} in batches")
    parts = []
    if own := of("proximity"):
        wide = S.proximity(cells_, {f"v{i}": (*s[:2], r) for i, (s, r) in enumerate(own.values())})
        parts.append(wide.select("specimen", F.explode(F.array(*(F.struct(F.lit(n).alias("request"), F.col(f"v{i}").alias("value")) for i, n in enumerate(own)))).alias("r")).select("r.request", "specimen", "r.value"))
    own = of("co-occurrence")
    for radius in sorted({r for _, r in own.values()}):
        parts.append(S.co_occurrence_batch(cells_, {n: tuple(s[:2]) for n, (s, r) in own.items() if r == radius}, radius).select("request", "specimen", F.col("ratio").alias("value")))
    pairs, single = of("enrichment"), of("autocorrelation")
    if pairs or single:
        graph = S.neighbour_graph(cells_)
        if pairs:
            parts.append(S.enrichment_batch(cells_, graph, {n: tuple(s[:2]) for n, (s, _) in pairs.items()}).select("request", "specimen", F.col("enrichment").alias("value")))
        if single:
            parts.append(S.moran_batch(cells_, graph, {n: s for n, (s, _) in single.items()}).select(F.col("channel").alias("request"), "specimen", F.col("p").alias("value")))
    out = reduce(DataFrame.unionByName, parts)
    return out.fillna(0.0, ["value"]) if impute_zero else out


def spatial_metrics(cells_: DataFrame, names: Sequence[str], phenotypes: Sequence[Phenotype], metric: str, radius: float = 30.0) -> DataFrame:
    """(specimen, value) of proximity, enrichment, co-occurrence or autocorrelation for the phenotypes (two, but one for the last)."""
    signatures = [P.signature(*p, names) for p in phenotypes]
    cells_ = S.integer_positions(cells_)
    if metric == "proximity":
        return S.proximity(cells_, {"value": (signatures[0], signatures[1], radius)})
    marked = cells_.withColumn("label", S.labels(F.col("mask"), signatures)).select("specimen", "structure", "x", "y", "label")
    if metric == "co-occurrence":
        return S.co_occurrence(marked, radius).withColumnRenamed("ratio", "value")
    if metric == "ripley":
        return S.ripley_f(marked).select("specimen", F.col("radius").alias("value"))
    marked = stored(marked)
    if metric == "enrichment":
        return S.enrichment(marked, stored(S.neighbour_edges(marked))).select("specimen", F.col("enrichment").alias("value"))
    if metric == "autocorrelation":
        return S.moran_batch(marked, S.neighbour_graph(marked, keep=("label",)), {}, ["label"]).select("specimen", F.col("p").alias("value"))
    raise ValueError(f"no metric {metric!r}")


def importance_fraction_plot(cells_: DataFrame, important: Column, phenotypes: Mapping[str, Column]) -> DataFrame:
    """(phenotype, specimen, fraction, p) behind the plot, not the plot."""
    out = None
    for name, hit in phenotypes.items():
        one = importance_enrichment(cells_, important, hit).select(F.lit(name).alias("phenotype"), "specimen", "fraction", "p")
        out = one if out is None else out.union(one)
    return out


def create_finding(findings: DataFrame, row: DataFrame) -> DataFrame:
    """findings with a new one, pending review."""
    return findings.unionByName(row.withColumns({"status": F.lit("pending_review"), "published_at": F.lit(None).cast("timestamp")}))


def set_status(findings: DataFrame, finding: int, status: str) -> DataFrame:
    """A finding's status changed; the time of publication is set once."""
    own = F.col("id") == finding
    first = own & F.lit(status == "published") & F.col("published_at").isNull()
    return findings.withColumns({"status": F.when(own, status).otherwise(F.col("status")), "published_at": F.when(first, F.current_timestamp()).otherwise(F.col("published_at"))})


def review(findings: DataFrame, decisions: DataFrame, now: Column | None = None) -> DataFrame:
    """Findings with the status that decisions (id, status) give them, others as they are; the time of publication is set once. The last
    of several decisions on one finding in the order of text counts."""
    one = decisions.groupBy("id").agg(F.max("status").alias("decided_"))
    x = findings.join(one, "id", "left")
    first = (F.col("decided_") == "published") & F.col("published_at").isNull()
    when = F.current_timestamp() if now is None else now
    return x.withColumns({"status": F.coalesce("decided_", "status"), "published_at": F.when(first, when).otherwise(F.col("published_at"))}).drop("decided_").select(*findings.columns)


def published_findings(findings: DataFrame, study: str, most: int = 100) -> DataFrame:
    return findings.where((F.col("study") == study) & (F.col("status") == "published")).orderBy("id").limit(min(most, 100))


def channel_annotations(members: DataFrame) -> DataFrame:
    """(group, color, channels): sorted distinct channels of each group."""
    return members.groupBy("group", "color").agg(F.array_sort(F.collect_set("channel")).alias("channels"))


def study_summary(studies: DataFrame, publications: DataFrame, strata: DataFrame, cells_: DataFrame, channels_: int, phenotypes: int, findings: DataFrame) -> DataFrame:
    """One row for each study: study, institution, contact, assay, publications, specimens, cells, channels, phenotypes, cohorts, findings.

    studies: (study, institution, contact, assay); publications (study, title); strata (study, specimen, stratum); cells_ (specimen); findings (study, id, txt).
    publications and findings are sorted arrays, cohorts of structs (stratum, samples). Empty arrays and 0 where a study has none.
    """
    n = cells_.groupBy("specimen").agg(F.count("*").alias("n"))
    sizes = strata.select("study", "specimen").distinct().join(n, "specimen", "left").groupBy("study").agg(F.count("*").alias("specimens"), F.coalesce(F.sum("n"), F.lit(0)).alias("cells"))
    cohorts = strata.groupBy("study", "stratum").agg(F.count("*").alias("samples")).groupBy("study").agg(F.array_sort(F.collect_list(F.struct("stratum", "samples"))).alias("cohorts"))
    titles = publications.groupBy("study").agg(F.array_sort(F.collect_set("title")).alias("publications"))
    told = findings.groupBy("study").agg(F.array_sort(F.collect_list(F.struct("id", "txt"))).alias("told")).select("study", F.transform("told", lambda f: f.txt).alias("findings"))
    x = studies
    for part in (titles, sizes, cohorts, told):
        x = x.join(part, "study", "left")
    none = F.array().cast("array<string>")
    return x.select(
        "study", "institution", "contact", "assay", F.coalesce("publications", none).alias("publications"), F.coalesce("specimens", F.lit(0)).alias("specimens"), F.coalesce("cells", F.lit(0)).alias("cells"),
        F.lit(channels_).cast("long").alias("channels"), F.lit(phenotypes).cast("long").alias("phenotypes"), F.coalesce("cohorts", F.array().cast("array<struct<stratum:string,samples:bigint>>")).alias("cohorts"), F.coalesce("findings", none).alias("findings"),
    )


def phenotype_criteria(composites: DataFrame, channels_: DataFrame, handles: DataFrame) -> DataFrame:
    """(handle, positive_markers, negative_markers, known) of phenotype names, identifiers and channels: sorted arrays, empty for an unknown handle."""
    found = P.resolve_handles(handles, composites, channels_)
    return found.select("handle", F.array_sort("positive").alias("positive_markers"), F.array_sort("negative").alias("negative_markers"), "known")


@query("m_study_names", "SELECT c_mktsegment || CASE WHEN c_nationkey % 5 = 0 THEN '' ELSE ' collection: t' || c_nationkey % 5 END AS handle, c_mktsegment AS display_name, CASE WHEN c_nationkey % 5 = 0 THEN '' ELSE 't' || c_nationkey % 5 END AS tag FROM customer WHERE c_nationkey % 5 IN (0, 2) GROUP BY ALL")
def m_study_names(spark, d):
    suffix = F.when(F.col("c_nationkey") % 5 == 0, "").otherwise(F.concat(F.lit(" collection: t"), F.col("c_nationkey") % 5))
    studies = table(spark, d, "customer").select(F.concat("c_mktsegment", suffix).alias("study")).distinct()
    return study_names(studies, spark.createDataFrame([("t2",)], "tag string"))


@query("m_study_summary", """WITH n AS (SELECT l_suppkey AS specimen, count(*) AS n FROM lineitem GROUP BY 1),
strata AS (SELECT r_name AS study, s_suppkey AS specimen, n_name AS stratum FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
sizes AS (SELECT study, count(*) AS specimens, CAST(coalesce(sum(n), 0) AS BIGINT) AS cells FROM strata LEFT JOIN n USING (specimen) GROUP BY 1),
cohorts AS (SELECT study, string_agg(stratum || ':' || samples, ';' ORDER BY stratum) AS cohorts FROM (SELECT study, stratum, count(*) AS samples FROM strata GROUP BY ALL) GROUP BY 1),
told AS (SELECT r_name AS study, string_agg(DISTINCT c_mktsegment, ';' ORDER BY c_mktsegment) AS publications FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1),
findings AS (SELECT r_name AS study, string_agg(n_name, ';' ORDER BY n_nationkey) AS findings FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 2 = 0 GROUP BY 1)
SELECT r_name AS study, 'I' || r_regionkey AS institution, coalesce(publications, '') AS publications, coalesce(specimens, 0) AS specimens, coalesce(cells, 0) AS cells, CAST(5 AS BIGINT) AS channels, CAST(4 AS BIGINT) AS phenotypes, coalesce(cohorts, '') AS cohorts, coalesce(findings, '') AS findings
FROM region r LEFT JOIN sizes ON r_name = sizes.study LEFT JOIN cohorts ON r_name = cohorts.study LEFT JOIN told ON r_name = told.study LEFT JOIN findings ON r_name = findings.study""")
def m_study_summary(spark, d):
    region, nation = table(spark, d, "region"), table(spark, d, "nation")
    of = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).withColumn("study", F.col("r_name"))
    studies = region.select(F.col("r_name").alias("study"), F.concat(F.lit("I"), "r_regionkey").alias("institution"), F.lit("").alias("contact"), F.lit("").alias("assay"))
    publications = table(spark, d, "customer").join(of, F.col("c_nationkey") == F.col("n_nationkey")).select("study", F.col("c_mktsegment").alias("title"))
    strata = table(spark, d, "supplier").join(of, F.col("s_nationkey") == F.col("n_nationkey")).select("study", F.col("s_suppkey").alias("specimen"), F.col("n_name").alias("stratum"))
    findings = of.where("n_nationkey % 2 = 0").select("study", F.col("n_nationkey").alias("id"), F.col("n_name").alias("txt"))
    cells_ = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("specimen"))
    x = study_summary(studies, publications, strata, cells_, len(CHANNELS), len(SIGNATURES), findings)
    cohorts_ = F.array_join(F.transform("cohorts", lambda c: F.concat(c.stratum, F.lit(":"), c.samples)), ";")
    return x.select("study", "institution", F.array_join("publications", ";").alias("publications"), "specimens", "cells", "channels", "phenotypes", cohorts_.alias("cohorts"), F.array_join("findings", ";").alias("findings"))


@query("m_phenotype_criteria", """WITH p AS (SELECT p_brand AS name, min(p_type) AS low, max(p_type) AS high FROM part GROUP BY 1), t AS (SELECT DISTINCT p_type AS target FROM part), h AS (SELECT name AS handle FROM p UNION SELECT target FROM t UNION SELECT c_mktsegment FROM customer)
SELECT handle, CASE WHEN p.name IS NOT NULL THEN low WHEN target IS NOT NULL THEN target ELSE '' END AS positive_markers, CASE WHEN p.name IS NOT NULL AND high <> low THEN high ELSE '' END AS negative_markers, p.name IS NOT NULL OR target IS NOT NULL AS known FROM h LEFT JOIN p ON handle = name LEFT JOIN t ON handle = target""")
def m_phenotype_criteria(spark, d):
    part = table(spark, d, "part")
    p = part.groupBy(F.col("p_brand").alias("name")).agg(F.min("p_type").alias("low"), F.max("p_type").alias("high")).withColumn("identifier", F.hash("name"))
    composites = p.select("identifier", "name", F.col("low").alias("marker"), F.lit("positive").alias("polarity")).union(p.where("high <> low").select("identifier", "name", "high", F.lit("negative")))
    targets = part.select(F.col("p_type").alias("target")).distinct()
    handles = p.select(F.col("name").alias("handle")).union(targets).union(table(spark, d, "customer").select("c_mktsegment")).distinct()
    return phenotype_criteria(composites, targets, handles).select("handle", F.array_join("positive_markers", ";").alias("positive_markers"), F.array_join("negative_markers", ";").alias("negative_markers"), "known")


@query("m_channels", "SELECT DISTINCT p_brand AS symbol FROM part")
def m_channels(spark, d):
    return channels(table(spark, d, "part").select(F.col("p_brand").alias("symbol")))


@query("m_phenotype_counts", f"WITH cells AS ({CELLS}), c AS (SELECT specimen, count(*) FILTER ((mask & 4) = 4 AND (mask & 1) = 0) AS n, count(*) AS all_cells FROM cells GROUP BY 1) SELECT *, round(CASE WHEN n = 0 THEN 0.0 ELSE 100 * round_even(CAST(n AS DOUBLE) / all_cells * 10000, 0) / 10000 END, 6) AS percentage FROM c")
def m_phenotype_counts(spark, d):
    return phenotype_counts(cells(spark, d), CHANNELS, (["BULK", ""], ["RET"])).withColumn("percentage", F.round("percentage", 6))


@query("m_spatial_metrics")
def m_spatial_metrics(spark, d):
    return spatial_metrics(cells(spark, d), CHANNELS, [(["BULK"], ["RET"])], "autocorrelation")


@query("m_importance_fractions", f"WITH cells AS ({CELLS}), f AS (SELECT *, l_extendedprice > 60000 AS i FROM cells) SELECT 'bulk' AS phenotype, specimen, round(avg(CASE WHEN (mask & 4) = 4 THEN 1.0 ELSE 0 END) FILTER (i), 6) AS fraction FROM f GROUP BY 2 UNION ALL SELECT 'taxed', specimen, round(avg(CASE WHEN (mask & 16) = 16 THEN 1.0 ELSE 0 END) FILTER (i), 6) FROM f GROUP BY 2")
def m_importance_fractions(spark, d):
    hits = {"bulk": P.matches(F.col("mask"), 4, 0), "taxed": P.matches(F.col("mask"), 16, 0)}
    return importance_fraction_plot(cells(spark, d), F.col("l_extendedprice") > 60000, hits).select("phenotype", "specimen", F.round("fraction", 6).alias("fraction"))


@query("m_findings", "SELECT o_orderkey AS id, o_clerk AS background FROM (SELECT o_orderkey, o_orderpriority AS o_clerk, row_number() OVER (ORDER BY o_orderkey) AS r FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 2 = 0) WHERE r <= 100")
def m_findings(spark, d):
    o = table(spark, d, "orders")
    rows = o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("s"), F.col("o_custkey") % 2).alias("study"), F.col("o_orderpriority").alias("background"), F.when(F.col("o_orderstatus") == "F", "published").otherwise("pending_review").alias("status"))
    return published_findings(rows, "s0", 500).select("id", "background")


@query("b23_finding_life", """SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' OR (o_orderstatus = 'F' AND o_orderkey % 2 = 0) THEN 'pending_review' ELSE 'published' END AS status,
CASE o_orderstatus WHEN 'F' THEN '2024-01-01' WHEN 'O' THEN '2024-02-01' END AS published FROM orders""")
def b23(spark, d):
    """Findings are sent in, some published, half of these taken back, then others published with those that are out already."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("background"), "o_orderstatus")
    decided = lambda where, status: o.where(where).select("id", F.lit(status).alias("status"))
    day = lambda text: F.lit(text).cast("timestamp")
    none = spark.createDataFrame([], "id long, background string, status string, published_at timestamp")
    f = create_finding(none, o.select("id", "background"))
    f = review(f, decided("o_orderstatus = 'F'", "published"), day("2024-01-01"))
    f = review(f, decided("o_orderstatus = 'F' and id % 2 = 0", "pending_review"))
    f = review(f, decided("o_orderstatus = 'O' or (o_orderstatus = 'F' and id % 2 = 1)", "published"), day("2024-02-01"))
    return f.select("id", "status", F.date_format("published_at", "yyyy-MM-dd").alias("published"))


@query("m_channel_annotations", "SELECT p_type AS \"group\", 'c' || p_size % 2 AS color, array_to_string(list_sort(list(DISTINCT p_brand)), ',') AS channels FROM part GROUP BY ALL")
def m_channel_annotations(spark, d):
    p = table(spark, d, "part").select(F.col("p_type").alias("group"), F.concat(F.lit("c"), F.col("p_size") % 2).alias("color"), F.col("p_brand").alias("channel"))
    return channel_annotations(p).withColumn("channels", F.array_join("channels", ","))


def whole_study_subsample(cells_: DataFrame, names: Mapping[str, P.Signature], intensity: Mapping[str, str], most: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """(metadata, cells): the sample's description as whole_study_metadata() gives it, and its cells' bytes as subsample_bytes() does."""
    return whole_study_metadata(cells_, names, intensity, most), G.subsample_bytes(cells_, list(names), intensity, most)


def whole_study_metadata(cells_: DataFrame, names: Mapping[str, P.Signature], intensity: Mapping[str, str], most: int = 1_000_000) -> DataFrame:
    """One row (metadata): JSON of each specimen's count and thresholds, in the order of specimens, and of the order of channels."""
    rows = G.subsample_metadata(cells_, names, intensity, most)
    counts = F.array_sort(F.collect_list(F.struct("specimen", "count", "thresholds"))).alias("subsample_counts")  # a row for each specimen
    return rows.agg(counts).select(F.to_json(F.struct("subsample_counts", F.array(*map(F.lit, names)).alias("channel_order"))).alias("metadata"))


@query("m_whole_study_subsample")
def m_subsample(spark, d):
    return K.representative(cells(spark, d), 10_000).select("specimen", "structure", "mask", "l_quantity", "l_tax")


_GATED = {"BULK": (4, 0), "DISC": (8, 0), "TAXED": (16, 0)}
_LEVELS = {"BULK": "bulk", "DISC": "disc", "TAXED": "taxed"}
_MOST = 5000


def _levels(spark, d):
    """Cells with three intensities in 0..1."""
    c = cells(spark, d)
    return c.select("specimen", "structure", "mask", (F.col("l_quantity").cast("double") / 50).alias("bulk"), (F.col("l_discount").cast("double") * 10).alias("disc"), (F.col("l_tax").cast("double") * 10).alias("taxed"))


def _subsample_sql() -> str:
    """Counts by largest whole shares, the remainder one each in order; gates between decoded extremes of calls, coded by their power of two."""
    high = (1 + 31 / 32) * 2**7 - 1
    power = lambda v: "+".join(f"CAST({v} >= {2**i} AS INT)" for i in range(1, 8))
    coded = lambda v: f"least(255, 32 * ({power(v)}) + CAST(floor(32 * ({v} / pow(2.0, {power(v)}) - 1)) AS INT))"
    held = lambda b: f"((1 + {b} % 32 / 32.0::DOUBLE) * pow(2.0, {b} // 32) - 1) / {high}"
    values = {"BULK": "CAST(l_quantity AS DOUBLE) / 50", "DISC": "CAST(l_discount AS DOUBLE) * 10", "TAXED": "CAST(l_tax AS DOUBLE) * 10"}
    rows = " UNION ALL ".join(f"SELECT specimen, {i} AS i, (mask & {s[0]}) = {s[0]} AS hit, 1 + {values[c]} * {high} AS v FROM cells" for i, (c, s) in enumerate(_GATED.items()))
    return f"""WITH cells AS MATERIALIZED ({CELLS}), x AS MATERIALIZED (SELECT specimen, i, hit, {coded("v")} AS b FROM ({rows})),
e AS (SELECT specimen, i, max(b) FILTER (NOT hit) AS low, min(b) FILTER (hit) AS high FROM x GROUP BY ALL),
h AS (SELECT specimen, i, {held("low")} AS low, {held("high")} AS high FROM e),
g AS (SELECT specimen, i, 1 + coalesce((low + high) / 2, low, high) * {high} AS v FROM h),
t AS (SELECT specimen, array_to_string(list(greatest(1, {coded("v")}) ORDER BY i), ',') AS thresholds FROM g GROUP BY 1),
n AS (SELECT specimen, count(*) AS n FROM cells GROUP BY 1),
f AS (SELECT *, sum(n) OVER () AS total, CAST(floor(n * {_MOST}.0::DOUBLE / sum(n) OVER ()) AS BIGINT) AS share, row_number() OVER (ORDER BY specimen) AS turn FROM n)
SELECT specimen, CAST(CASE WHEN total <= {_MOST} THEN n ELSE share + CAST(turn <= {_MOST} - sum(share) OVER () AS INT) END AS BIGINT) AS "count", thresholds FROM f JOIN t USING (specimen)"""


@query("k02_subsample_metadata", _subsample_sql())
def k02_metadata(spark, d):
    return G.subsample_metadata(_levels(spark, d), _GATED, _LEVELS, _MOST).withColumn("thresholds", F.array_join(F.col("thresholds").cast("array<string>"), ","))


@query("m_whole_study_metadata", _subsample_sql())
def m_whole_study_metadata(spark, d):
    """The JSON that a user gets, read back."""
    rows = whole_study_metadata(_levels(spark, d), _GATED, _LEVELS, _MOST)
    read = F.from_json("metadata", "subsample_counts array<struct<specimen: long, count: long, thresholds: array<string>>>, channel_order array<string>")
    return rows.select(F.explode(read["subsample_counts"]).alias("r")).select("r.specimen", "r.count", F.array_join("r.thresholds", ",").alias("thresholds"))


@query("m_whole_study_bytes")
def m_whole_study_bytes(spark, d):
    return whole_study_subsample(_levels(spark, d), _GATED, _LEVELS, _MOST)[1].withColumn("codes", F.hex("codes"))


@query("n02_signature_counts", f"WITH cells AS ({CELLS}) SELECT specimen, count(*) FILTER ((mask & 1) = 1 AND (mask & 2) = 0) AS returned, count(*) FILTER ((mask & 4) = 4) AS bulk, count(*) AS all_cells FROM cells GROUP BY 1")
def n02(spark, d):
    return signature_counts(cells(spark, d), {k: SIGNATURES[k] for k in ("returned", "bulk")})


@query("n02_event_counts", "SELECT date_trunc('hour', ts) AS start, user_id, event_type, count(*) AS n FROM events GROUP BY ALL")
def n02_events(spark, d):
    return event_counts(table(spark, d, "events"))


def _arrivals(spark, d):
    """The events as files of one folder, as they would arrive."""
    folder = new_folder(spark)
    table(spark, d, "events").repartition(6, "user_id").write.parquet(f"{folder}/in")
    return folder


@query("n01_ingest_once", "SELECT user_id, count(*) AS n FROM events GROUP BY 1")
def n01(spark, d):
    """Files of events are ingested, then the same and more again: each content is stored once."""
    folder = _arrivals(spark, d)
    of = "path string, modificationTime timestamp, length long, content binary"
    load = lambda seen: seen.select("sha256", "path", "length")
    for turn in range(2):
        files = spark.readStream.format("binaryFile").schema(of).option("pathGlobFilter", "part-*").load(f"{folder}/in").select("path", "content", "length")
        ingest_once(files, f"{folder}/store", load, f"{folder}/checkpoint{turn}").awaitTermination()
    stored_files = spark.read.parquet(f"{folder}/store/rows").select(F.substring_index("path", "/", -1).alias("name"))
    rows = spark.read.parquet(f"{folder}/in").select("user_id", F.col("_metadata.file_name").alias("name"))
    return rows.join(stored_files, "name").groupBy("user_id").agg(F.count("*").alias("n"))


#: Cells of a file that arrives, on average at most.
_FILE_CELLS = 250_000


@query("n01_cells_from_files", """WITH f AS (SELECT DISTINCT l_partkey, l_suppkey, CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS b, CASE WHEN l_tax > 0.04 THEN 1 ELSE 0 END AS t, l_tax FROM lineitem)
SELECT CAST(b + 2 * t AS BIGINT) AS mask, count(*) AS cells, round(sum(l_partkey + 2.0), 6) AS xs, round(sum(l_suppkey + 1.0), 6) AS ys, round(sum(l_tax), 4) AS taxes FROM f GROUP BY 1""")
def n01_cells(spark, d):
    """Cell files arrive in two loads, the second with the first's contents under other names; each content becomes cells once.

    A load's files grow in number, not in size: three, or as many as hold _FILE_CELLS on average; a batch takes half a load's, from 2 to 64."""
    folder, rows = new_folder(spark), table(spark, d, "lineitem")
    files = max(3, -(-rows.count() // (2 * _FILE_CELLS)))
    most_files = max(2, min(64, files // 2))
    box = {"XMin": F.col("l_partkey"), "XMax": F.col("l_partkey") + 4, "YMin": F.col("l_suppkey"), "YMax": F.col("l_suppkey") + 2}
    calls = {"TAXED Positive": (F.col("l_tax") > 0.04).cast("int"), "BULK_Positive": (F.col("l_quantity") > 25).cast("int"), "TAXED Intensity": F.col("l_tax")}
    half = lambda i: rows.where(F.col("l_suppkey") % 2 == i).repartition(files, "l_suppkey")

    def arrive(load: str, i: int, columns: dict) -> None:
        load_rows = half(i).select(*(c.alias(n) for n, c in columns.items()))
        load_rows.sortWithinPartitions(*columns).write.csv(f"{folder}/in/{load}", header=True)

    arrive("a", 0, box | calls)
    ingest_cells(spark, f"{folder}/in/*", f"{folder}/store", ["TAXED", "BULK"], f"{folder}/checkpoint", most_files).awaitTermination()
    arrive("b", 0, box | calls)
    arrive("c", 1, calls | box)  # other order of columns
    ingest_cells(spark, f"{folder}/in/*", f"{folder}/store", ["TAXED", "BULK"], f"{folder}/checkpoint", most_files).awaitTermination()
    c = spark.read.parquet(f"{folder}/store/rows")
    return c.groupBy("mask").agg(F.count("*").alias("cells"), F.round(F.sum("x"), 6).alias("xs"), F.round(F.sum("y"), 6).alias("ys"), F.round(F.sum(F.col("intensity")[1]), 4).alias("taxes"))


@query("n02_signature_stream", f"WITH cells AS ({CELLS}) SELECT specimen, count(*) FILTER ((mask & 1) = 1 AND (mask & 2) = 0) AS returned, count(*) FILTER ((mask & 4) = 4) AS bulk, count(*) AS all_cells FROM cells GROUP BY 1")
def n02_signature_stream(spark, d):
    """Cells arrive in two loads; the stream ends after each and starts again from its checkpoint."""
    folder, rows = new_folder(spark), stored(cells(spark, d).select("specimen", "structure", "mask"))
    for i in range(2):
        rows.where(F.col("structure") % 2 == i).write.parquet(f"{folder}/in/{i}")
        counts = signature_counts(spark.readStream.schema(rows.schema).parquet(f"{folder}/in/*"), {k: SIGNATURES[k] for k in ("returned", "bulk")})
        keep_counts(counts, f"{folder}/counts", f"{folder}/checkpoint").awaitTermination()
    return read_counts(spark, f"{folder}/counts", counts, ["specimen"])


@query("n02_event_stream", "SELECT date_trunc('hour', ts) AS start, user_id, event_type, count(*) AS n FROM events GROUP BY ALL")
def n02_event_stream(spark, d):
    """Events arrive in order of time in three loads, the stream starting again from its checkpoint for each. The last load repeats the first, whose
    windows the watermark has closed: its events are too late and change nothing."""
    folder, rows = new_folder(spark), table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))  # streams need a time with a zone
    first, last = rows.agg(F.min("ts"), F.max("ts")).first()
    cut = first + (last - first) / 3 if first else None
    for i, load in enumerate((F.col("ts") < cut, F.col("ts") >= cut, F.col("ts") < cut)):
        rows.where(load).write.parquet(f"{folder}/in/{i}")
        counts = event_counts(spark.readStream.schema(rows.schema).parquet(f"{folder}/in/*"))
        keep_counts(counts, f"{folder}/counts", f"{folder}/checkpoint").awaitTermination()
    return read_counts(spark, f"{folder}/counts", counts, ["start", "user_id", "event_type"]).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("n03_features_up_to_date", "SELECT event_type AS feature, user_id AS subject, count(*) AS value FROM events GROUP BY ALL")
def n03(spark, d):
    """Features are asked for in two streams; what the first has computed the second does not compute again."""
    folder = _arrivals(spark, d)
    events = spark.read.parquet(f"{folder}/in")
    expected = events.select(F.col("event_type").alias("feature"), F.col("user_id").alias("subject")).distinct()
    spark.createDataFrame([], "feature string, subject long, value long").write.parquet(f"{folder}/values")
    compute = lambda due: due.join(events.groupBy(F.col("event_type").alias("feature"), F.col("user_id").alias("subject")).agg(F.count("*").alias("value")), ["feature", "subject"])
    for turn in range(2):
        requests = spark.readStream.schema(events.schema).parquet(f"{folder}/in").select(F.col("event_type").alias("feature"))
        requests = requests.where("feature < 'm'") if turn == 0 else requests
        append = lambda rows, number: rows.select("feature", F.col("subject").cast("long").alias("subject"), "value").write.mode("append").parquet(f"{folder}/values")
        keep_features_up_to_date(requests, expected, lambda s: s.read.parquet(f"{folder}/values"), compute, append, f"{folder}/checkpoint{turn}").awaitTermination()
    return spark.read.parquet(f"{folder}/values")
