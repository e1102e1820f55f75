"""Exact duplicates by a persistent digest index, bucketed and sorted by hash."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

#: A digest that holds at least this share of a batch's rows is "heavy": there can be at most HEAVY_PARTS of them.
HEAVY_PARTS = 4096


#: Recent batches are merged into the settled table once they hold more than one in so many of its rows.
MERGE_SHARE = 8
#: Session setting under which a scan of buckets of one sorted file each counts as sorted, so that a sort-merge join reads it as it lies.
_SORTED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


@contextmanager
def sorted_scans(spark: SparkSession) -> Iterator[None]:
    """Buckets are read in their order while this lasts."""
    before = spark.conf.get(_SORTED, None)
    spark.conf.set(_SORTED, "true")
    try:
        yield
    finally:
        spark.conf.unset(_SORTED) if before is None else spark.conf.set(_SORTED, before)


class DigestIndex:
    """Two tables (digest, keep_id, copies, batch), together one row for each text ever added.

    Both lie in the warehouse in buckets by digest. The settled one has one sorted file for each bucket, so that a batch meets it by a sort-merge
    join that neither moves nor sorts it. Batches are appended to the recent one, whose buckets have several files and are sorted by
    each join; settle() merges them when they hold more than one in MERGE_SHARE of the settled rows, so that a row is written anew a bounded number
    of times for each doubling. Under a lasting catalogue the name finds the index again in later sessions.

    One writer at a time: two batches that are added at once may both bring a text.
    """

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int | None = None):
        self.spark, self.name = spark, name or f"digest_index_{uuid.uuid4().hex}"
        self.recent, self.coming = f"{self.name}_recent", f"{self.name}_coming"
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self._recover()
        for table in (self.name, self.recent):
            self._create(table)

    def _create(self, table: str) -> None:
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {table} (digest BINARY, keep_id BIGINT, copies BIGINT, batch STRING) "
            f"USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS"
        )

    def _recover(self) -> None:
        """End a merge that broke off. Only a whole merged table bears the mark of one; the tables it was made of then go, if they are still there."""
        if self.spark.catalog.tableExists(self.coming):
            marked = self.spark.sql(f"SHOW TBLPROPERTIES {self.coming}").where("key = 'whole'").count()
            if marked:
                self._swap()
            else:
                self.spark.sql(f"DROP TABLE {self.coming}")

    def _swap(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.recent}")
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        self.spark.sql(f"ALTER TABLE {self.coming} RENAME TO {self.name}")
        self.spark.sql(f"ALTER TABLE {self.name} UNSET TBLPROPERTIES IF EXISTS ('whole')")

    def levels(self) -> list[DataFrame]:
        """The settled table and the recent one."""
        return [self.spark.table(self.name), self.spark.table(self.recent)]

    def read(self) -> DataFrame:
        settled, recent = self.levels()
        return settled.union(recent)

    def drop(self) -> None:
        for table in (self.name, self.recent):
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")

    def met(self, groups: DataFrame, how: str) -> list[DataFrame]:
        """groups joined on the digest with each level, always by sort-merge, under sorted_scans() without a sort of the settled one.

        left_anti: a list of one, what no level has; inner: one for each level.
        """
        if how != "left_anti":
            return [groups.join(level.hint("merge"), "digest", how) for level in self.levels()]
        for level in self.levels():
            groups = groups.join(level.select("digest").hint("merge"), "digest", how)
        return [groups]

    def add(self, groups: DataFrame, batch: str) -> None:
        """Append the groups (digest, largest, copies) whose digest the index has not seen. A batch added again, after a failure
        half-way too, appends only what is not there yet."""
        with sorted_scans(self.spark):
            fresh = self.met(groups, "left_anti")[0].select("digest", F.col("largest").alias("keep_id"), "copies", F.lit(batch).alias("batch"))
            fresh.repartition(self.buckets, "digest").write.insertInto(self.recent)

    def settle(self, always: bool = False) -> None:
        """Merge the recent table into the settled one, if it has grown enough or always."""
        settled, recent = (level.count() for level in self.levels())  # from the files' footers
        if recent and (always or recent * MERGE_SHARE > settled):
            self._create(self.coming)
            self.read().repartition(self.buckets, "digest").write.insertInto(self.coming)
            self.spark.sql(f"ALTER TABLE {self.coming} SET TBLPROPERTIES ('whole' = 'true')")
            self._swap()
            self._create(self.recent)


def digest_of(text: str):
    """SHA-256 of the text in UTF-8; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null equals empty. Of a batch's equal texts the largest id stays; a text that an
    earlier batch brought keeps its first id and none of the new rows stays. group_size counts the new rows and those
    with which the text entered the index. Rows that repeat id and text are all marked alike; null ids stay only
    where no copy has an id. An empty table gives no rows. Other columns are neither read nor returned.

    batch names the rows that come together. A job that failed after they entered the index is run again under the same name and
    gives the same result: texts that the batch itself brought are not taken for earlier ones. Without an index one is made and dropped.

    Counts are pre-aggregated before the shuffle. Rows of heavy digests, of which there are at most HEAVY_PARTS by
    definition, get their group from a broadcast of that bounded size; in the join their key is their own id, which
    spreads them. All others meet their group by a join on the digest, of which none holds many rows.
    """
    spark = docs.sparkSession
    given, batch = index, batch or uuid.uuid4().hex
    index = index or DigestIndex(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id_"), digest_of(text_col).alias("digest"))
    groups = cut(rows.groupBy("digest").agg(F.max("id_").alias("largest"), F.count("*").alias("copies")))
    total = groups.agg(F.sum("copies")).first()[0] or 0
    index.add(groups, batch)
    groups = groups.withColumnRenamed("copies", "new")
    known = reduce(DataFrame.union, index.met(groups, "inner")).withColumn("own", F.col("batch") == batch)
    found = known.select(
        "digest", F.col("new").alias("copies"), F.when(F.col("own"), F.col("largest")).otherwise(F.col("keep_id")).alias("keep_id"), "own",
        F.when(F.col("own"), F.col("new")).otherwise(F.col("new") + F.col("copies")).alias("group_size"),
    )
    with sorted_scans(spark):
        found = cut(found)
    index.drop() if given is None else index.settle()
    heavy = found.where(F.col("copies") >= max(2, total / HEAVY_PARTS)).select(
        F.col("digest").alias("heavy"), F.struct("keep_id", "group_size", "own").alias("h")
    )
    light = found.select(F.col("digest").alias("key"), F.struct("keep_id", "group_size", "own").alias("l"))
    rows = rows.join(F.broadcast(heavy), F.col("digest") == F.col("heavy"), "left")
    rows = rows.withColumn("key", F.when(F.col("h").isNull(), F.col("digest")).otherwise(F.coalesce(F.col("id_").cast("string"), F.concat(F.lit("null "), F.spark_partition_id())).cast("binary")))
    rows = rows.join(light, "key", "left").withColumn("g", F.coalesce("h", "l"))
    return rows.select(
        F.col("id_").alias(id_col), "g.keep_id", "g.group_size",
        (F.col("g.own") & F.col("id_").eqNullSafe(F.col("g.keep_id"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_first_copies(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_dedup() keeps, with all their columns, whatever their names. Of rows that repeat id and text one stays, any of them."""
    kept = exact_dedup(docs, index, batch, id_col, text_col).where("kept").select(F.col(id_col).alias("id_"), F.unhex("text_sha256").alias("digest_"))
    kept = cut(kept.groupBy("id_", "digest_").agg(F.count("*").alias("rows_")))
    marked = docs.select(F.struct("*").alias("row_"), F.col(id_col).cast("long").alias("key_id"), digest_of(text_col).alias("key_digest"))
    same = F.col("key_id").eqNullSafe(F.col("id_")) & (F.col("key_digest") == F.col("digest_"))
    once = marked.join(kept.where("rows_ = 1"), same, "left_semi")
    several = marked.join(cut(kept.where("rows_ > 1")), same, "left_semi").dropDuplicates(["key_id", "key_digest"])
    return once.union(several).select("row_.*")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY sha256(coalesce(text, '')))
"""
