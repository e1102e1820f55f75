"""Streams: cell files as they arrive, counts as they grow, requested features as they are asked for."""

from __future__ import annotations

import csv
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.features import missing
from ..operators.neighbors import stored
from ..operators.populations import Signature, matches
from ..sources.ingest import cells_of

#: What the binaryFile source says of a file.
FILES = "path string, modificationTime timestamp, length long, content binary"


def signature_counts(cells: DataFrame, signatures: Mapping[str, Signature]) -> DataFrame:
    """Running counts of each specimen and signature over a stream of cells; state: one row for each specimen."""
    sums = [F.sum(F.when(matches(F.col("mask"), *s), 1).otherwise(0)).cast("long").alias(n) for n, s in signatures.items()]
    return cells.groupBy("specimen").agg(*sums, F.count("*").alias("all_cells"))


def event_counts(events: DataFrame, delay: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts by user, type and window of event time; later than the delay is too late."""
    late = events.withWatermark("ts", delay)
    return late.groupBy(F.window("ts", width).alias("w"), "user_id", "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "user_id", "event_type", "n")


def keep_counts(counts: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Run a stream of running counts over what has arrived, and write what each batch changes to store, in a folder of its own.

    A run that is started anew with the same checkpoint goes on with the state and the watermark that the last one left; a batch that is
    run again after a failure writes to its folder again, so nothing counts twice. read_counts() gives the counts as they stand.
    """

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store}/batch={number}")

    return counts.writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_counts(spark: SparkSession, store: str, counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each key's last row among those keep_counts() wrote, with the columns of counts; the store must have a batch."""
    rows = spark.read.schema(StructType([*counts.schema.fields, StructField("batch", LongType())])).parquet(store)
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*(c for c in counts.columns if c not in keys)), "batch").alias("last_"))
    return last.select(*keys, "last_.*").select(*counts.columns)


def ingest_once(files: DataFrame, store: str, load: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Append load(rows) of each new content to store, exactly once for each hash.

    files: a stream (path, content) as from the binaryFile source. Each batch meets the hashes already stored, which lie by themselves in
    store/hashes, by an anti-join; a batch that is run again writes to its own folders again, so nothing is doubled. Rows are in store/rows.
    """
    known_of = "sha256 string, batch long"

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        seen = batch.select("path", F.sha2("content", 256).alias("sha256")).groupBy("sha256").agg(F.min("path").alias("path"))
        spark.createDataFrame([], known_of).write.mode("append").partitionBy("batch").parquet(f"{store}/hashes")  # makes the folder, no rows
        known = spark.read.schema(known_of).parquet(f"{store}/hashes").where(F.col("batch") != number)
        seen = stored(seen.join(known.select("sha256"), "sha256", "left_anti"))  # a row for each file; contents are read again where they lie, and never shuffled
        load(batch.join(F.broadcast(seen), "path")).write.mode("overwrite").parquet(f"{store}/rows/batch={number}")
        seen.select("sha256").write.mode("overwrite").parquet(f"{store}/hashes/batch={number}")

    return files.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def cells_in(files: DataFrame, prefixes: Sequence[str], key: str = "sha256") -> DataFrame:
    """(key, structure, x, y, mask, intensity): the cells of CSV files given as (key, content), exact duplicate rows of a file dropped.

    Files may have their columns in any order: those with one header are read together. Files without a row give no cells. A field holds
    no line break, as none of a cell file does. The driver sees the distinct headers.
    """
    lines = files.select(key, F.filter(F.split(F.decode("content", "UTF-8"), "\r?\n"), lambda x: x != "").alias("lines_")).where(F.size("lines_") > 1)
    parts = []
    for (header,) in lines.select(F.col("lines_")[0]).distinct().collect():
        schema = ", ".join(f"`{c}` string" for c in next(csv.reader([header])))
        body = F.explode(F.slice("lines_", 2, F.size("lines_") - 1))
        rows = lines.where(F.col("lines_")[0] == header).select(key, body.alias("line_")).distinct().select(key, F.from_csv("line_", schema).alias("r_"))
        parts.append(cells_of(rows.select(key, "r_.*"), prefixes, key))
    if not parts:
        return files.sparkSession.createDataFrame([], f"{key} string, structure long, x double, y double, mask long, intensity array<double>")
    return reduce(DataFrame.union, parts)


def ingest_cells(spark: SparkSession, folder: str, store: str, prefixes: Sequence[str], checkpoint: str, most_files: int = 64) -> StreamingQuery:
    """Cells of the CSV files that have come to folder, appended to store/rows with the sha256 of their file; each content once, whatever
    its name. most_files: files of one batch, which bounds what a batch holds; the stream goes on until none is left."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.csv").option("maxFilesPerTrigger", most_files).load(folder)
    return ingest_once(files.select("path", "content"), store, lambda seen: cells_in(seen, prefixes), checkpoint)


def keep_features_up_to_date(requests: DataFrame, expected: DataFrame, read_values: Callable[[SparkSession], DataFrame], compute: Callable[[DataFrame], DataFrame], append: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """For each batch of requests (feature): what is expected and has no value yet is computed and appended."""

    def step(batch: DataFrame, number: int) -> None:
        due = missing(expected.join(batch.select("feature").distinct(), "feature", "left_semi"), read_values(batch.sparkSession))
        append(compute(due), number)

    return requests.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
