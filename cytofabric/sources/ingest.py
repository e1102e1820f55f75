"""Reading study bundles (TSV, CSV, JSON) into tables, and writing tables out."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns of the bundle's tables; all are text.
FILE_MANIFEST = ("File ID", "Project ID", "File name", "Sample ID", "Data type")
CHANNELS = ("Name", "Column header fragment prefix", "Target structure class", "Antibody", "Marking mechanism", "Target full name")
PHENOTYPES = ("Name", "Positive markers", "Negative markers")
SUBJECTS = ("Subject ID", "Sex")
SAMPLES = ("Sample ID", "Source subject", "Source site", "Source subject age at specimen collection", "Extraction method", "Extraction date", "Preservation method", "Storage location", "Assay", "Assessment")
DIAGNOSES = ("Subject of diagnosis", "Diagnosed condition", "Diagnosis", "Date of diagnosis", "Last date of considered evidence")
INTERVENTIONS = ("Subject of intervention", "Intervention", "Date of intervention")
IMPORTANCES = "histological_structure BIGINT, importance DOUBLE"
CELL_MANIFEST_TYPE = "Tabular cell manifest"
#: Fixed names of a study's tables by size: those of cells, never exported; computed values; and what the values' features are.
BIG_TABLES = ("histological_structure", "shape_file", "histological_structure_identification", "expression_quantification")
VALUE_TABLES = ("quantitative_feature_value",)
SPECIFICATION_TABLES = ("feature_specification", "feature_specifier")


def text_table(spark: SparkSession, path: str, columns: Sequence[str], sep: str = "\t") -> DataFrame:
    """A file with a header, every column as text, blanks as ''."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.csv(path, sep=sep, header=True, schema=schema).na.fill("")


def importances(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(IMPORTANCES).csv(path, header=True)


def files_of_type(manifest: DataFrame, kind: str = CELL_MANIFEST_TYPE) -> DataFrame:
    return manifest.where(F.col("Data type") == kind).select("File name", "Sample ID")


def file_by_id(manifest: DataFrame) -> DataFrame:
    """(File ID, File name): null where an id is given more than once."""
    n = manifest.groupBy("File ID").agg(F.count("*").alias("n"), F.first("File name").alias("name"))
    return n.select("File ID", F.when(F.col("n") == 1, F.col("name")).alias("File name"))


def cell_columns(columns: Sequence[str], prefixes: Sequence[str]) -> dict[str, tuple[str, str | None]]:
    """prefix -> (positivity column, intensity column or None); the separator may be a space or an underscore. No positivity: ValueError."""
    out = {}
    for p in prefixes:
        find = lambda word, p=p: next((c for s in " _" if (c := f"{p}{s}{word}") in columns), None)
        positive = find("Positive")
        if positive is None:
            raise ValueError(f"no positivity column for {p}")
        out[p] = (positive, find("Intensity"))
    return out


def cell_manifests(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Cell files with their path as source, exact duplicate rows of a file dropped."""
    rows = spark.read.csv(paths if isinstance(paths, str) else list(paths), header=True, inferSchema=False)
    return rows.select("*", F.col("_metadata.file_path").alias("source")).dropDuplicates()


def box_corners(x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
    """The box as a closed polygon: its four corners and the first again."""
    at = [(x0, y0), (x0, y1), (x1, y1), (x1, y0), (x0, y0)]
    return F.array(*(F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in at))


def centroid(vertices: Column) -> Column:
    """Mean of a closed polygon's vertices without the repeated last one."""
    open_ = F.slice(vertices, 1, F.size(vertices) - 1)
    mean = lambda f: F.aggregate(F.transform(open_, f), F.lit(0.0), lambda a, v: a + v) / F.size(open_)
    return F.struct(mean(lambda p: p.x).alias("x"), mean(lambda p: p.y).alias("y"))


def cells_of(rows: DataFrame, prefixes: Sequence[str], key: str = "source") -> DataFrame:
    """(source, structure, x, y, mask, intensity): one row for each cell row; bits in the order of the prefixes as text.

    structure numbers a source's rows by their values, so it does not depend on partitions.
    """
    ordered = sorted(prefixes)
    where = cell_columns(rows.columns, ordered)
    mask = F.lit(0).cast("long")
    for i, p in enumerate(ordered):
        mask = mask.bitwiseOR(F.shiftleft(F.col(f"`{where[p][0]}`").cast("long"), i))
    values = [F.col(f"`{i}`").cast("double") if (i := where[p][1]) else F.lit(None).cast("double") for p in ordered]
    box = box_corners(*(F.col(c) for c in ("XMin", "XMax", "YMin", "YMax")))
    x = rows.select(F.col(key), centroid(box).alias("c"), mask.alias("mask"), F.array(*values).alias("intensity"), F.col("XMin").cast("int").alias("o1"), F.col("YMin").cast("int").alias("o2"))
    number = F.row_number().over(Window.partitionBy(key).orderBy("o2", "o1", "mask", "c")) - 1
    return x.select(key, number.cast("long").alias("structure"), F.col("c.x").alias("x"), F.col("c.y").alias("y"), "mask", "intensity")


def long_expression(rows: DataFrame, ids: Sequence[str], prefixes: Sequence[str]) -> DataFrame:
    """(ids..., target, quantity, coded): one row for each cell and channel; quantity is null without an intensity column."""
    where = cell_columns(rows.columns, prefixes)
    parts = [F.struct(F.lit(p).alias("target"), (F.col(f"`{q}`").cast("double") if q else F.lit(None).cast("double")).alias("quantity"), F.when(F.col(f"`{c}`").cast("int") == 1, "positive").otherwise("negative").alias("coded")) for p, (c, q) in where.items()]
    return rows.select(*ids, F.explode(F.array(*parts)).alias("e")).select(*ids, "e.*")


def study_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """study, people, publications and authors (with their place, from 0) of a study's JSON."""
    s = spark.read.json(path, multiLine=True)
    has = lambda c: c in s.columns
    name = F.col("`Study name`").alias("study")
    out = {"study": s.select(name, F.col("Institution"), F.col("`Study contact person`.Name").alias("contact"))}
    if has("Publications"):
        p = s.select(name, F.explode("Publications").alias("p"))
        out["publications"] = p.select("study", *(F.col(f"p.`{f.name}`") for f in p.schema["p"].dataType if f.name != "Authors"))
        out["authors"] = p.select("study", F.col("p.Title").alias("title"), F.posexplode("p.Authors").alias("ordinality", "author"))
    if has("People"):
        out["people"] = s.select(name, F.explode("People").alias("p")).select("study", "p.*")
    return out


def file_digests(spark: SparkSession, paths: str) -> DataFrame:
    """(path, sha256) of whole files."""
    return spark.read.format("binaryFile").load(paths).select("path", F.sha2("content", 256).alias("sha256"))


def ingest_plan(files: DataFrame, cells_in_file: DataFrame, known: DataFrame) -> DataFrame:
    """(sha256, n, known_n, action): load files with no known cells, skip those with as many, skip-and-warn where counts differ.

    files: (path, sha256); cells_in_file: (path, n); known: (sha256, n).
    """
    x = files.join(cells_in_file, "path").join(known.select("sha256", F.col("n").alias("known_n")), "sha256", "left")
    k = F.coalesce("known_n", F.lit(0))
    return x.select("sha256", "path", "n", k.alias("known_n"), F.when(k == 0, "load").when(k == F.col("n"), "skip").otherwise("warn").alias("action"))


def surrogate_keys(rows: DataFrame, existing_max: int, by: str, order: Sequence[str]) -> DataFrame:
    """rows with id: existing_max + 1 on, by file and place in it; ranks are within files, offset by the files' counts before."""
    sizes = rows.groupBy(by).agg(F.count("*").alias("n_"))
    before = F.coalesce(F.sum("n_").over(Window.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # files: metadata
    place = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    starts = sizes.withColumn("start_", before).drop("n_")
    return rows.withColumn("place_", place).join(starts, by).withColumn("id", F.col("start_") + F.col("place_") + existing_max).drop("place_", "start_")


def insert_absent(rows: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys the table does not have, each once: what an insert that ignores conflicts appends."""
    return rows.dropDuplicates(list(keys)).join(existing.select(*keys), list(keys), "left_anti")


def normalised_names(columns: Sequence[str]) -> dict[str, str]:
    return {c: re.sub("[ -]", "_", c).lower() for c in columns}


def single_value(rows: DataFrame, column: str) -> DataFrame:
    """(value, several): the smallest value that is not blank, and whether there are others; null if none."""
    v = F.when(F.col(column) != "", F.col(column))
    return rows.agg(F.min(v).alias("value"), (F.count_distinct(v) > 1).alias("several"))


def common_mechanism(channels: DataFrame) -> DataFrame:
    """(mechanism): the only one, else the most frequent that is not a computational identification; ties by name."""
    n = channels.groupBy("mechanism").agg(F.count("*").alias("n"))
    rank = F.struct(F.col("mechanism").rlike("[Cc]omputational [Ii]dentification"), -F.col("n"), "mechanism")
    return n.agg(F.min_by("mechanism", rank).alias("mechanism"))


def assessed(samples: DataFrame) -> DataFrame:
    """The samples with an assay and an assessment, both not blank."""
    return samples.where((F.col("Assay") != "") & (F.col("Assessment") != ""))


def unknown_markers(phenotypes: DataFrame, channels: DataFrame) -> DataFrame:
    """(Name, marker) of phenotypes' markers that are no channel."""
    parts = F.filter(F.transform(F.split(F.concat_ws(";", "Positive markers", "Negative markers"), ";"), lambda m: F.trim(m)), lambda m: m != "")
    return phenotypes.select("Name", F.explode(parts).alias("marker")).join(channels.select(F.col("Name").alias("marker")), "marker", "left_anti").select("Name", "marker")


def export_partitioned(rows: DataFrame, path: str, by: str = "specimen") -> None:
    rows.write.mode("overwrite").partitionBy(by).parquet(path)


def export_tables(tables: dict[str, DataFrame], path: str, feature_values: bool = True, feature_specifications: bool = True) -> list[str]:
    """Write a study's metadata tables, each a folder of path; the names of those written, in order.

    BIG_TABLES are always left out, VALUE_TABLES and SPECIFICATION_TABLES on request, each by itself.
    """
    out = {*BIG_TABLES, *(() if feature_values else VALUE_TABLES), *(() if feature_specifications else SPECIFICATION_TABLES)}
    names = sorted(n for n in tables if n not in out)
    for name in names:
        tables[name].write.mode("overwrite").parquet(f"{path}/{name}")
    return names
