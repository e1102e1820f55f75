"""The driver's tables, and the cells, specimens and clinical events that stand in them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..operators.neighbors import stored

#: Names of the mask's bits, lowest first, and the columns with their intensities (the first two share theirs with the next).
CHANNELS = ("RET", "OPEN", "BULK", "DISC", "TAXED")
INTENSITIES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")

#: Cells from which on a specimen is stored in a folder of its own, and folders that the smaller ones share.
OWN_FOLDER, SHARED = 1 << 16, 64

#: One cell for each line item; the same text runs in Spark and in the oracle.
CELLS = """
SELECT l_suppkey AS specimen,
       l_suppkey * 4294967296 + row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber,
           l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS structure,
       CAST((l_orderkey*7919 + l_linenumber*31) % 1000 AS INT) AS x,
       CAST((l_partkey*104729 + l_linenumber*17) % 1000 AS INT) AS y,
       CAST((CASE WHEN l_returnflag='R' THEN 1 ELSE 0 END) + (CASE WHEN l_linestatus='O' THEN 2 ELSE 0 END)
          + (CASE WHEN l_quantity>25 THEN 4 ELSE 0 END) + (CASE WHEN l_discount>0.05 THEN 8 ELSE 0 END)
          + (CASE WHEN l_tax>0.04 THEN 16 ELSE 0 END) AS BIGINT) AS mask,
       l_quantity, l_extendedprice, l_discount, l_tax
FROM lineitem
"""
#: One sample for each supplier; extraction dates in ten days of January.
SAMPLES = """
SELECT s_suppkey AS specimen, s_nationkey AS subject, n_regionkey AS cohort,
       '2024-01-' || CAST(10 + s_suppkey % 10 AS VARCHAR(2)) AS extraction
FROM supplier JOIN nation ON s_nationkey = n_nationkey
"""
INTERVENTIONS = """
SELECT user_id % 25 AS subject, substr(CAST(ts AS VARCHAR(40)), 1, 10) AS event_date
FROM events WHERE event_type = 'purchase' AND value > 100
"""
DIAGNOSES = """
SELECT user_id % 25 AS subject, event_type AS condition, CAST(CAST(floor(value / 50) AS INT) AS VARCHAR(12)) AS result,
       substr(CAST(ts AS VARCHAR(40)), 1, 10) AS event_date
FROM events WHERE event_type IN ('error', 'signup') AND value > 100
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql(spark: SparkSession, sf_dir: str, text: str, *names: str) -> DataFrame:
    """Run text over the named tables of sf_dir without leaving views behind."""
    frames = {n: table(spark, sf_dir, n) for n in names}
    for n in names:
        text = text.replace(f"FROM {n}", f"FROM {{{n}}} AS {n}").replace(f"JOIN {n}", f"JOIN {{{n}}} AS {n}")
    return spark.sql(text, **frames)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, CELLS, "lineitem")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, SAMPLES, "supplier", "nation")


def interventions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, INTERVENTIONS, "events")


def diagnoses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, DIAGNOSES, "events")


def _shared_folder(specimen: Column) -> Column:
    return F.pmod(F.xxhash64(specimen.cast("string")), F.lit(SHARED)).cast("int")


def store_cells(rows: DataFrame, path: str, group_bytes: int = 16 << 20) -> None:
    """Write cells in folders by specimen, and within these in files of disjoint ranges of structure, sorted by it.

    A specimen of OWN_FOLDER cells or more has a folder of its own, smaller ones share SHARED folders by hash, sorted by specimen, so folders and files follow the cells and
    not the specimens. A request for some specimens reads no other folder, one for a range of structures the row groups (of group_bytes at most) and pages that it
    meets. Tasks have ranges of (specimen, structure) over all rows: a large specimen spreads over several, and no folder gets a file of every task. Null structures come first.
    """
    rows = stored(rows)  # read for sizes, for the ranges' sample and for the files

    def write(part: DataFrame, to: str, *by: str, tasks: tuple = ()) -> None:
        ordered = part.repartitionByRange(*tasks, *by, "structure").sortWithinPartitions(*by, "structure")
        ordered.write.mode("overwrite").partitionBy(by[0]).option("parquet.block.size", group_bytes).parquet(to)

    large = stored(rows.groupBy("specimen").agg(F.count("*").alias("n")).where(F.col("n") >= OWN_FOLDER))
    cells_of_large = large.agg(F.sum("n")).first()[0] or 0
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, cells_of_large >> 20) if cells_of_large else 1
    write(rows.join(large, "specimen", "left_semi"), path, "specimen", tasks=(tasks,))
    write(rows.join(large, "specimen", "left_anti").withColumn("folder_", _shared_folder(F.col("specimen"))), f"{path}/_shared", "folder_", "specimen")
    rows.limit(0).write.parquet(f"{path}/_schema")


def _held(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """What store_cells() wrote of large specimens, and of the others with their folder_. Spark's listing of the former leaves out names that begin with _."""
    schema = spark.read.parquet(f"{path}/_schema").schema
    return spark.read.schema(schema).parquet(path).select(schema.names), spark.read.schema(StructType([*schema, StructField("folder_", IntegerType())])).parquet(f"{path}/_shared").select(*schema.names, "folder_")


def read_cells(spark: SparkSession, path: str, specimens: DataFrame | None = None) -> DataFrame:
    """Cells that store_cells() wrote; specimens: those of this table (specimen) only, whose folders alone are read."""
    own, shared = _held(spark, path)
    if specimens is not None:
        wanted = specimens.select(F.col("specimen").cast(own.schema["specimen"].dataType).alias("specimen")).distinct()
        own = own.join(wanted, "specimen", "left_semi")
        shared = shared.join(wanted.withColumn("folder_", _shared_folder(F.col("specimen"))), ["folder_", "specimen"], "left_semi").select(*own.columns, "folder_")
    return own.union(shared.drop("folder_"))


def serial_ranges(rows: DataFrame) -> DataFrame:
    """(specimen, lowest, highest, n): the range of structures of each specimen, and its cells."""
    return rows.groupBy("specimen").agg(F.min("structure").alias("lowest"), F.max("structure").alias("highest"), F.count("*").alias("n"))


def read_range(spark: SparkSession, path: str, specimen: object, lowest: int | None = None, highest: int | None = None, structures: Sequence[int] | None = None) -> DataFrame:
    """One specimen's cells with structures from lowest to highest (None: no bound), of these only those named, if any are.

    Bounds reach the scan, so a range costs what it meets of the specimen's files. Null structures are in no range with a bound. structures
    is a request's list, whose span is pushed down too; an empty one gives no cells.
    """
    own, shared = _held(spark, path)
    one = F.lit(specimen).cast(own.schema["specimen"].dataType)
    rows = own.where(F.col("specimen") == one).union(shared.where((F.col("folder_") == _shared_folder(one)) & (F.col("specimen") == one)).drop("folder_"))
    if structures is not None:
        lowest = max([min(structures, default=0), *([] if lowest is None else [lowest])])
        highest = min([max(structures, default=-1), *([] if highest is None else [highest])])
        rows = rows.where(F.col("structure").isin(list(structures)))
    rows = rows if lowest is None else rows.where(F.col("structure") >= lowest)
    return rows if highest is None else rows.where(F.col("structure") <= highest)
