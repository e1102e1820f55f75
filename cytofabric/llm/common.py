"""Helpers that several operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Session setting under which Spark deletes a query's shuffle files when the query ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A temporary one of this machine where that is unset and all
    tasks run in this process; an error on a cluster, whose machines would not see each other's files."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (folder or tempfile.gettempdir()).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back: ends the lineage, survives lost executors.

    Unlike a cached plan, the files' sizes are known to the optimizer, so that only what is really small is
    broadcast, and every join above starts from a fresh exchange, which adaptive execution can split. Shuffle files of the write
    go when it ends, as nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cytofabric-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Delete the files behind tables that cut() made and that nothing needs any more."""
    for table in tables:
        for folder in {name.rsplit("/", 1)[0] for name in table.inputFiles()}:
            if "/cytofabric-" in folder:
                path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from: crc32 of the id as text leaves 0 when divided by 5."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def slices(array: pa.Array, rows: int = 2000, most_bytes: int = 16 << 20) -> Iterator[pa.Array]:
    """array in pieces, so that what Python holds of it is bounded whatever Spark's batch size is."""
    step = max(1, min(rows, rows * most_bytes // max(1, array.nbytes)))
    for at in range(0, len(array), step):
        yield array.slice(at, step)


class Remembered(dict):
    """word -> make(word) of this Python worker, in two generations of at most `most` entries each; long words are made anew each time.

    So it is bounded in bytes too: a key has at most LONGEST of them (or characters), and what is made of it is in proportion.
    """

    LONGEST = 48
    all: list[Remembered] = []

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}
        Remembered.all.append(self)

    def __missing__(self, word):
        value = self.old.get(word)
        if value is None:
            value = self.make(word)
            if len(word) > self.LONGEST:
                return value
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[word] = value
        return value


def only(*wanted: Remembered) -> None:
    """Empty all others: a worker is used by one operator after another, and each would else leave what it remembers behind."""
    for held in Remembered.all:
        if (held or held.old) and not any(held is w for w in wanted):
            held.clear()
            held.old = {}


#: A-Z to a-z, everything but letters, digits and non-ASCII bytes to a space.
_ALNUM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def alnum_words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of letters, digits and non-ASCII characters, in UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_ALNUM).split()


def blank_words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of anything but space, tab, line feed, vertical tab, form feed, carriage return."""
    return lowered(text).split()


def lowered(text: str | None) -> bytes:
    """The text in UTF-8, A-Z lower-cased; null counts as empty."""
    return (text or "").encode("utf-8", "surrogatepass").lower()
