"""Queries on sources and sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import ingest as A
from ..operators.neighbors import new_folder
from ..sources.tables import CELLS, DIAGNOSES, INTERVENTIONS, cells, diagnoses, interventions, read_cells, read_range, serial_ranges, store_cells, table
from .registry import query


@query("a01_file_ids", "SELECT CAST(c_nationkey AS VARCHAR) || '-' || c_mktsegment AS id, CASE WHEN count(*) = 1 THEN min(c_name) ELSE '' END AS name FROM customer GROUP BY 1")
def a01(spark, d):
    m = table(spark, d, "customer").select(F.concat_ws("-", "c_nationkey", "c_mktsegment").alias("File ID"), F.col("c_name").alias("File name"))
    return A.file_by_id(m).select(F.col("File ID").alias("id"), F.coalesce("File name", F.lit("")).alias("name"))


@query("a02_distinct_rows", "SELECT l_suppkey, count(*) AS n FROM (SELECT DISTINCT l_suppkey, l_partkey, l_returnflag FROM lineitem) GROUP BY 1")
def a02(spark, d):
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_returnflag").dropDuplicates()
    return rows.groupBy("l_suppkey").agg(F.count("*").alias("n"))


@query("a03_long_expression", "SELECT l_suppkey, 'DISC' AS target, round(sum(l_discount), 4) AS quantity, count(*) FILTER (l_discount > 0.05) AS positive FROM lineitem GROUP BY 1 UNION ALL SELECT l_suppkey, 'BULK', round(sum(l_quantity), 4), count(*) FILTER (l_quantity > 25) FROM lineitem GROUP BY 1")
def a03(spark, d):
    rows = table(spark, d, "lineitem").select("l_suppkey", (F.col("l_discount") > 0.05).cast("int").alias("DISC Positive"), F.col("l_discount").alias("DISC Intensity"), (F.col("l_quantity") > 25).cast("int").alias("BULK_Positive"), F.col("l_quantity").alias("BULK_Intensity"))
    return A.long_expression(rows, ["l_suppkey"], ["DISC", "BULK"]).groupBy("l_suppkey", "target").agg(F.round(F.sum("quantity"), 4).alias("quantity"), F.sum((F.col("coded") == "positive").cast("long")).alias("positive"))


@query("a06_ingest_plan", "SELECT sha256(CAST(s_suppkey AS VARCHAR)) AS sha256, n, CASE s_suppkey % 3 WHEN 0 THEN 0 WHEN 1 THEN n ELSE n + 1 END AS known_n, CASE s_suppkey % 3 WHEN 0 THEN 'load' WHEN 1 THEN 'skip' ELSE 'warn' END AS action FROM supplier JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) ON s_suppkey = l_suppkey")
def a06(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("path"), F.sha2(F.col("s_suppkey").cast("string").cast("binary"), 256).alias("sha256"), "s_suppkey")
    n = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("path")).agg(F.count("*").alias("n"))
    known = s.where("s_suppkey % 3 > 0").join(n, "path").select("sha256", F.when(F.col("s_suppkey") % 3 == 1, F.col("n")).otherwise(F.col("n") + 1).alias("n"))
    return A.ingest_plan(s.select("path", "sha256"), n, known).drop("path")


@query("a07_surrogate_keys", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_orderkey) + 1000 AS id FROM orders")
def a07(spark, d):
    return A.surrogate_keys(table(spark, d, "orders"), 1000, "o_orderpriority", ["o_orderkey"]).select("o_orderkey", "id")


@query("a08_insert_absent", "SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def a08(spark, d):
    have = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return A.insert_absent(table(spark, d, "orders").select("o_custkey"), have, ["o_custkey"])


@query("b24_nonblank_assessments", "SELECT c_custkey, c_mktsegment AS assay FROM customer WHERE c_nationkey <> 3 AND c_mktsegment <> 'BUILDING'")
def b24(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise(F.col("c_mktsegment")).alias("Assay"), F.when(F.col("c_nationkey") == 3, "").otherwise("x").alias("Assessment"))
    return A.assessed(c).select("c_custkey", F.col("Assay").alias("assay"))


@query("c18_unknown_markers", "SELECT p_partkey, marker FROM (SELECT p_partkey, unnest([p_type, p_brand]) AS marker FROM part) WHERE marker NOT IN (SELECT p_type FROM part WHERE p_type <> 'PROMO')")
def c18(spark, d):
    p = table(spark, d, "part")
    names = p.select(F.col("p_partkey").cast("string").alias("Name"), F.col("p_type").alias("Positive markers"), F.col("p_brand").alias("Negative markers"))
    return A.unknown_markers(names, p.where("p_type <> 'PROMO'").select(F.col("p_type").alias("Name")).distinct()).select(F.col("Name").cast("long").alias("p_partkey"), "marker")


@query("d07_polygons", "SELECT l_orderkey, l_linenumber, l_partkey, round((l_orderkey % 1000) + CAST(l_quantity AS DOUBLE) / 2, 6) AS x, round((l_partkey % 1000) + CAST(l_quantity AS DOUBLE) / 2, 6) AS y FROM lineitem")
def d07(spark, d):
    x, y, q = F.col("l_orderkey") % 1000, F.col("l_partkey") % 1000, F.col("l_quantity")
    c = A.centroid(A.box_corners(x, x + q, y, y + q))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(c["x"], 6).alias("x"), F.round(c["y"], 6).alias("y"))


@query("d16_common_mechanism", "SELECT o_orderpriority AS mechanism FROM orders WHERE o_orderpriority NOT LIKE '1%' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1")
def d16(spark, d):
    p = F.col("o_orderpriority")
    return A.common_mechanism(table(spark, d, "orders").select(F.when(p.startswith("1"), "Computational identification").otherwise(p).alias("mechanism")))


@query("d28_single_value", "SELECT min(c_mktsegment) AS value, count(DISTINCT c_mktsegment) > 1 AS several FROM customer WHERE c_mktsegment <> 'AUTOMOBILE'")
def d28(spark, d):
    return A.single_value(table(spark, d, "customer").select(F.when(F.col("c_mktsegment") == "AUTOMOBILE", "").otherwise(F.col("c_mktsegment")).alias("v")), "v")


@query("a05_bundle_to_cells", """WITH f AS (SELECT DISTINCT l_suppkey % 4 AS file, l_partkey, l_suppkey, CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS b, CASE WHEN l_tax > 0.04 THEN 1 ELSE 0 END AS t, l_tax FROM lineitem)
SELECT file, count(*) AS cells, CAST(sum(b + 2 * t) AS BIGINT) AS masks, round(sum(l_partkey + 2.0), 6) AS xs, round(sum(l_suppkey + 1.0), 6) AS ys, round(sum(l_tax), 4) AS taxes FROM f GROUP BY 1""")
def a05(spark, d):
    """Cell files are written as a bundle has them, read back, and become cells."""
    rows, folder = table(spark, d, "lineitem"), new_folder(spark)
    bundle = rows.select(
        (F.col("l_suppkey") % 4).alias("file"), F.col("l_partkey").alias("XMin"), (F.col("l_partkey") + 4).alias("XMax"), F.col("l_suppkey").alias("YMin"), (F.col("l_suppkey") + 2).alias("YMax"),
        (F.col("l_quantity") > 25).cast("int").alias("BULK_Positive"), (F.col("l_tax") > 0.04).cast("int").alias("TAXED Positive"), F.col("l_tax").alias("TAXED Intensity"),
    )
    bundle.write.partitionBy("file").csv(folder, header=True)
    read = A.cell_manifests(spark, folder).withColumn("source", F.col("file").cast("string")).dropDuplicates()  # a partitioned folder: its parts are one file
    c = A.cells_of(read, ["TAXED", "BULK"])
    return c.groupBy(F.col("source").cast("int").alias("file")).agg(F.count("*").alias("cells"), F.sum("mask").alias("masks"), F.round(F.sum("x"), 6).alias("xs"), F.round(F.sum("y"), 6).alias("ys"), F.round(F.sum(F.col("intensity")[1]), 4).alias("taxes"))


@query("c03_stored_cells", f"WITH cells AS ({CELLS}) SELECT specimen, structure, mask FROM cells WHERE specimen IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def c03(spark, d):
    """Cells are stored by specimen; those of some specimens are read, from their folders only."""
    folder = new_folder(spark)
    store_cells(cells(spark, d).select("specimen", "structure", "mask"), folder)
    return read_cells(spark, folder, table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("specimen"))).select(F.col("specimen").cast("long").alias("specimen"), "structure", "mask")


@query("c03_serial_range", f"""WITH cells AS MATERIALIZED ({CELLS}), r AS (SELECT specimen, min(structure) AS lowest, count(*) AS n FROM cells GROUP BY 1 ORDER BY n DESC, specimen LIMIT 3)
SELECT specimen, structure, mask FROM cells JOIN r USING (specimen) WHERE structure BETWEEN lowest + n // 4 AND lowest + n // 2""")
def c03_range(spark, d):
    """The second quarter of each of the three largest specimens, read from the stored cells by ranges of structures."""
    folder = new_folder(spark)
    store_cells(cells(spark, d).select("specimen", "structure", "mask"), folder)
    largest = serial_ranges(read_cells(spark, folder)).orderBy(F.desc("n"), "specimen").limit(3).collect()  # three rows
    parts = [read_range(spark, folder, r.specimen, r.lowest + r.n // 4, r.lowest + r.n // 2) for r in largest]
    rows = reduce(DataFrame.union, parts) if parts else read_cells(spark, folder)
    return rows.select(F.col("specimen").cast("long").alias("specimen"), "structure", "mask")


@query("a04_bundle_tables", f"""WITH d AS ({DIAGNOSES}), i AS ({INTERVENTIONS}),
s AS (SELECT s_nationkey AS subject, count(*) AS samples, count(*) FILTER (s_suppkey % 7 > 0 AND s_suppkey % 5 > 0) AS assessed FROM supplier GROUP BY 1),
x AS (SELECT subject, count(*) AS diagnoses, min(event_date) AS first_diagnosis FROM d GROUP BY 1), y AS (SELECT subject, count(*) AS interventions FROM i GROUP BY 1)
SELECT CAST(n_nationkey AS VARCHAR) AS subject, coalesce(samples, 0) AS samples, coalesce(assessed, 0) AS assessed, coalesce(diagnoses, 0) AS diagnoses, first_diagnosis, coalesce(interventions, 0) AS interventions
FROM nation LEFT JOIN s ON s.subject = n_nationkey LEFT JOIN x ON x.subject = n_nationkey LEFT JOIN y ON y.subject = n_nationkey""")
def a04(spark, d):
    """Subjects, samples, diagnoses and interventions are written as a bundle's TSV files, read back as text, and put together."""
    folder = new_folder(spark)
    given = {
        "subjects": (A.SUBJECTS, table(spark, d, "nation").select(F.col("n_nationkey").alias("Subject ID"))),
        "samples": (A.SAMPLES, table(spark, d, "supplier").select(F.col("s_suppkey").alias("Sample ID"), F.col("s_nationkey").alias("Source subject"), F.when(F.col("s_suppkey") % 7 > 0, "assay").alias("Assay"), F.when(F.col("s_suppkey") % 5 > 0, "assessed").otherwise("").alias("Assessment"))),
        "diagnoses": (A.DIAGNOSES, diagnoses(spark, d).select(F.col("subject").alias("Subject of diagnosis"), F.col("condition").alias("Diagnosed condition"), F.col("result").alias("Diagnosis"), F.col("event_date").alias("Date of diagnosis"))),
        "interventions": (A.INTERVENTIONS, interventions(spark, d).select(F.col("subject").alias("Subject of intervention"), F.lit("purchase").alias("Intervention"), F.col("event_date").alias("Date of intervention"))),
    }
    read = {}
    for name, (columns, rows) in given.items():
        rows.select(*((F.col(c) if c in rows.columns else F.lit("")).alias(c) for c in columns)).write.csv(f"{folder}/{name}", sep="\t", header=True)
        read[name] = A.text_table(spark, f"{folder}/{name}", columns)
    by = lambda rows, key, *sums: rows.groupBy(F.col(key).alias("subject")).agg(*sums)
    out = read["subjects"].select(F.col("Subject ID").alias("subject")).join(by(read["samples"], "Source subject", F.count("*").alias("samples")), "subject", "left")
    out = out.join(by(A.assessed(read["samples"]), "Source subject", F.count("*").alias("assessed")), "subject", "left")
    out = out.join(by(read["diagnoses"], "Subject of diagnosis", F.count("*").alias("diagnoses"), F.min("Date of diagnosis").alias("first_diagnosis")), "subject", "left")
    out = out.join(by(read["interventions"], "Subject of intervention", F.count("*").alias("interventions")), "subject", "left")
    return out.fillna(0).select("subject", "samples", "assessed", "diagnoses", "first_diagnosis", "interventions")


@query("a05_study_authors", """SELECT p_brand AS study, 'of ' || p_brand AS institution, p_type AS title, CAST(row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_size) - 1 AS INTEGER) AS ordinality, 'author ' || p_size AS author
FROM (SELECT DISTINCT p_brand, p_type, p_size FROM part)""")
def a05_authors(spark, d):
    """Studies with publications are written as JSON, read back, and their authors listed in order."""
    folder, part = new_folder(spark), table(spark, d, "part")
    papers = part.groupBy("p_brand", "p_type").agg(F.transform(F.array_sort(F.collect_set("p_size")), lambda n: F.concat(F.lit("author "), n)).alias("authors"))
    studies = papers.groupBy("p_brand").agg(F.collect_list(F.struct(F.col("p_type").alias("Title"), F.col("authors").alias("Authors"))).alias("Publications"))
    studies.select(
        F.col("p_brand").alias("Study name"), F.concat(F.lit("of "), "p_brand").alias("Institution"), F.struct(F.lit("someone").alias("Name")).alias("Study contact person"), "Publications"
    ).repartition("Study name").write.option("maxRecordsPerFile", 1).json(folder)
    found = A.study_tables(spark, folder)
    return found["study"].join(found["authors"], "study").select("study", F.col("Institution").alias("institution"), "title", "ordinality", "author")


@query("a10_export", """WITH t AS (SELECT 'sample' AS name, 0 AS kind, count(*) AS n, sum(s_suppkey) AS keys FROM supplier UNION ALL SELECT 'subject', 0, count(*), sum(n_nationkey) FROM nation
UNION ALL SELECT 'quantitative_feature_value', 1, count(*), sum(o_orderkey) FROM orders UNION ALL SELECT 'feature_specification', 2, count(*), sum(p_partkey) FROM part UNION ALL SELECT 'feature_specifier', 2, count(*), sum(p_size) FROM part)
SELECT v AS feature_values, s AS feature_specifications, name, n, CAST(keys AS BIGINT) AS keys FROM t, (VALUES (true), (false)) AS a(v), (VALUES (true), (false)) AS b(s) WHERE (v OR kind <> 1) AND (s OR kind <> 2)""")
def a10(spark, d):
    """A study's tables are exported with each choice of options; what was written is read back."""
    folder = new_folder(spark)
    keys = {"sample": ("supplier", "s_suppkey"), "subject": ("nation", "n_nationkey"), "quantitative_feature_value": ("orders", "o_orderkey"), "feature_specification": ("part", "p_partkey"), "feature_specifier": ("part", "p_size"), "expression_quantification": ("lineitem", "l_orderkey")}
    tables = {name: table(spark, d, source).select(F.col(key).cast("long").alias("key")) for name, (source, key) in keys.items()}
    parts = []
    for values in (True, False):
        for specifications in (True, False):
            path = f"{folder}/{values}-{specifications}"
            for name in A.export_tables(tables, path, values, specifications):
                read = spark.read.parquet(f"{path}/{name}").agg(F.count("*").alias("n"), F.sum("key").alias("keys"))
                parts.append(read.select(F.lit(values).alias("feature_values"), F.lit(specifications).alias("feature_specifications"), F.lit(name).alias("name"), "n", "keys"))
    return reduce(DataFrame.union, parts)
