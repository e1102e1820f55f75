"""Packing token ids into rows of fixed length: best-fit-decreasing with a segment tree over capacities."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Ids of a row; ids that a task holds before it packs them (64 MB); id that fills a row up.
LENGTH, WINDOW_IDS, FILL = 2048, 16 << 20, 50256
SCHEMA = (
    "pack_id long, n_ids int, doc_ids array<long>, starts array<long>, cu_seqlens array<int>, input_ids binary, position_ids binary"
)
_ARROW = pa.schema([
    ("pack_id", pa.int64()), ("n_ids", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())),
    ("cu_seqlens", pa.list_(pa.int32())), ("input_ids", pa.binary()), ("position_ids", pa.binary()),
])


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@cache
def tokenizer(path: str) -> tiktoken.Encoding:
    """Byte-level BPE from a file of ranks, one for each Python worker; strings of special tokens are ordinary text."""
    import public_tokenizers

    with open(path, "rb") as file:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, file)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Capacities:
    """For each free capacity 0..length the open bins that have it; finds the smallest capacity that is large enough.

    A segment tree over capacities counts bins in each range; a search goes up from the leaf, then down, in log2(length) steps.
    """

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.count = [0] * (2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(length + 1)]

    def _change(self, free: int, by: int) -> None:
        i = free + self.size
        while i:
            self.count[i] += by
            i >>= 1

    def put(self, free: int, b: int) -> None:
        self.bins[free].append(b)
        self._change(free, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(bin, its free capacity) with the least capacity >= need, taken out; None if there is none."""
        i = need + self.size
        if not self.count[i]:
            while i & 1 or not self.count[i + 1]:
                i >>= 1
                if i <= 1:
                    return None
            i += 1
            while i < self.size:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        free = i - self.size
        self._change(free, -1)
        return self.bins[free].pop(), free


def best_fit_decreasing(sizes: np.ndarray, length: int) -> list[list[int]]:
    """Bins as lists of items: the longest items first (ties by position), each into the fullest bin that has room."""
    open_bins, bins = Capacities(length), []
    for i in np.argsort(-sizes, kind="stable").tolist():
        n = int(sizes[i])
        got = open_bins.take(n)
        if got is None:
            got = len(bins), length
            bins.append([])
        b, free = got
        bins[b].append(i)
        if free > n:
            open_bins.put(free - n, b)
    return bins


def pack_window(doc_ids: list, texts_ids: list[np.ndarray], length: int, fill: int, first: int) -> Iterator[tuple]:
    """Rows of a window of documents. Longer ones are cut into whole rows and a rest; no id is lost or repeated."""
    pieces = [(d, at, ids[at : at + length]) for d, ids in zip(doc_ids, texts_ids, strict=True) for at in range(0, len(ids), length)]
    sizes = np.array([len(p[2]) for p in pieces], np.int64)
    for k, items in enumerate(best_fit_decreasing(sizes, length)):
        n = sizes[items]
        ids, positions = np.full(length, fill, np.int32), np.zeros(length, np.int32)
        ids[: n.sum()] = np.concatenate([pieces[i][2] for i in items])
        positions[: n.sum()] = np.concatenate([np.arange(m) for m in n])
        yield first + k, int(n.sum()), [pieces[i][0] for i in items], [pieces[i][1] for i in items], np.concatenate([[0], np.cumsum(n)]), ids.tobytes(), positions.tobytes()


def pack_documents(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None, fill: int = FILL) -> DataFrame:
    """Rows of `length` ids each: pack_id, n_ids (used), doc_ids and starts (of each segment, in its document's ids),
    cu_seqlens (0, then the segments' ends), input_ids and position_ids (little-endian 32-bit; positions start anew with each segment).

    Each task packs its own partition of documents, in windows of at most about WINDOW_IDS ids: nothing is shuffled, memory is
    bounded, and a hot source weighs no more than its rows. Every id of every document stands in exactly one row. Empty and
    null texts have no ids, so no segment; null ids stay null in doc_ids; repeated rows are packed each. Pack ids are
    unique and ascend in a partition; which documents share a row depends on how the input is partitioned.
    """
    path = ranks or default_ranks()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, held, ids, size = tokenizer(path), [], [], 0
        next_id = TaskContext.get().partitionId() << 33

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, ids, size, next_id
            rows = []
            for row in pack_window(held, ids, length, fill, next_id):
                rows.append(row)
                next_id = row[0] + 1
                if len(rows) == 512:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)
            held, ids, size = [], [], 0

        for batch in batches:
            for i, text in enumerate(batch.column(1)):
                one = bpe.encode_to_numpy(text.as_py() or "", disallowed_special=()).astype(np.int32)
                held.append(batch.column(0)[i].as_py())
                ids.append(one)
                size += len(one)
                if size >= WINDOW_IDS:
                    yield from flush()
        yield from flush()

    return docs.select(F.col(id_col).cast("long").alias("id_"), F.col(text_col).alias("text_")).mapInArrow(pack, SCHEMA)


def op8_pack_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
