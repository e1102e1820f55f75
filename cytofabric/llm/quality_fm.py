"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Remembered, blank_words, held_out, only, slices, table

#: Word buckets; bins of a statistic; rank of the interactions; labelled rows learnt from, at most; passes; threshold.
WORD_BUCKETS, BINS, RANK, MOST_ROWS, PASSES, ACCEPT = 1 << 15, 12, 6, 6000, 6, 0.3
STATISTICS = (
    "chars", "words", "mean_word", "distinct_words", "top_word", "same_as_before", "distinct_pairs", "upper", "digits",
    "marks", "exclamations", "bars", "lines", "same_lines", "non_ascii", "top_line", "n_chars",
)
_KIND = np.zeros((256, 6), np.int64)  # upper, digits, marks, !, |, non-ASCII
for _b in range(256):
    _KIND[_b] = (65 <= _b <= 90, 48 <= _b <= 57, 33 <= _b < 127 and not chr(_b).isalnum(), _b == 33, _b == 124, _b >= 128)


def _bucket(word: bytes) -> int:
    return zlib.crc32(word) % WORD_BUCKETS


_buckets = Remembered(_bucket, 60_000)


def statistics(text: str, words: list[bytes], n_chars: float | None) -> np.ndarray:
    """Shares and counts of the whole text, each in 0 to 1."""
    raw = text.encode("utf-8", "surrogatepass")
    size, n = max(1, len(raw)), max(1, len(words))
    upper, digits, marks, exclaim, bars, beyond = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _KIND / size
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x]
    by_line = Counter(lines)
    pairs = set(zip(words, words[1:], strict=False))
    log = lambda x, most: min(1.0, np.log1p(x) / most)
    return np.array([
        log(len(text), 14), log(len(words), 12), min(1.0, len(raw) / n / 20), len(counts) / n, max(counts.values(), default=0) / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, len(pairs) / n, upper, digits, min(1.0, 4 * marks), min(1.0, 8 * exclaim),
        min(1.0, 8 * bars), min(1.0, 8 * len(lines) / n), 1 - len(by_line) / max(1, len(lines)), beyond,
        max(by_line.values(), default=0) / max(1, len(lines)), log(max(0.0, n_chars), 14) if n_chars is not None and np.isfinite(n_chars) else 0.0,
    ])


def features(texts: list, n_chars: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows (offsets, indices, values): log counts of words to unit length, then the bin of each statistic."""
    at, ids, values = [0], [], []
    bins = WORD_BUCKETS + BINS * np.arange(len(STATISTICS))
    for text, chars in zip(texts, n_chars, strict=True):
        text = text or ""
        words = blank_words(text)
        counts = Counter(map(_buckets.__getitem__, words))
        w = np.log1p(np.fromiter(counts.values(), np.float64, len(counts)))
        stats = statistics(text, words, chars)
        ids += [np.fromiter(counts, np.int64, len(counts)), bins + np.minimum(BINS - 1, (stats * BINS).astype(np.int64))]
        values += [w / (np.sqrt((w * w).sum()) or 1.0), np.ones(len(STATISTICS))]
        at.append(at[-1] + len(counts) + len(STATISTICS))
    if not ids:
        return np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.array(at), np.concatenate(ids), np.concatenate(values)


@dataclass
class FactorisationMachine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def margins(self, at: np.ndarray, ids: np.ndarray, values: np.ndarray) -> np.ndarray:
        """bias + sum w x + 1/2 sum_f ((sum v x)^2 - sum (v x)^2): linear in the number of features."""
        if len(at) < 2:
            return np.zeros(0)
        vx = self.factors[ids] * values[:, None]
        pairs = np.add.reduceat(vx, at[:-1]) ** 2 - np.add.reduceat(vx * vx, at[:-1])
        return self.bias + np.add.reduceat(self.linear[ids] * values, at[:-1]) + pairs.sum(1) / 2

    def scores(self, texts: list, n_chars: list) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(*features(texts, n_chars)), -30, 30)))


def fit(at: np.ndarray, ids: np.ndarray, values: np.ndarray, labels: np.ndarray, seed: int = 7, rate: float = 0.05) -> FactorisationMachine:
    """AdaGrad on the log loss over rows in seeded order. Without both labels the score is the constant that fits."""
    n = len(labels)
    prior = (labels.sum() + 1) / (n + 2)
    size = WORD_BUCKETS + BINS * len(STATISTICS)
    rng = np.random.default_rng(seed)
    fm = FactorisationMachine(float(np.log(prior / (1 - prior))), np.zeros(size), np.zeros((size, RANK)))
    if n == 0 or labels.min() == labels.max():
        return fm
    fm.factors = rng.normal(0, 0.02, (size, RANK))
    g_linear, g_factors, g_bias = np.full(size, 1e-2), np.full((size, RANK), 1e-2), 1e-2
    for _ in range(PASSES):
        for i in rng.permutation(n):
            j, x = ids[at[i] : at[i + 1]], values[at[i] : at[i + 1]]
            v = fm.factors[j]
            vx = v * x[:, None]
            total = vx.sum(0)
            margin = fm.bias + fm.linear[j] @ x + (total @ total - (vx * vx).sum()) / 2
            e = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[i]
            d_linear = e * x + 1e-5 * fm.linear[j]
            d_factors = e * x[:, None] * (total - vx) + 1e-4 * v
            g_linear[j] += d_linear**2
            g_factors[j] += d_factors**2
            g_bias += e * e
            fm.linear[j] -= rate * d_linear / np.sqrt(g_linear[j])
            fm.factors[j] -= rate / 2 * d_factors / np.sqrt(g_factors[j])
            fm.bias -= rate * e / np.sqrt(g_bias)
    return fm


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_rows: int = MOST_ROWS) -> FactorisationMachine:
    """Learn from at most most_rows labelled rows that are not held out: those with the smallest hash of their id.

    The bound keeps the sample, and so the driver's work, the same however large the corpus is; labels (id_col, quality)
    with null count as unlabelled; documents that repeat an id each count.
    """
    spark = docs.sparkSession
    chosen = labels.where("quality is not null").select(F.col(id_col).cast("long").alias("id_"), F.col("quality").cast("double").alias("y")).where(~held_out(F.col("id_")))
    chosen = chosen.orderBy(F.xxhash64("id_"), "id_", "y").limit(most_rows)
    chosen = spark.createDataFrame(chosen.collect(), chosen.schema)  # most_rows ids and labels
    rows = docs.select(F.col(id_col).cast("long").alias("id_"), F.col(text_col).alias("text_"), _metadata(docs).alias("chars_")).join(F.broadcast(chosen), "id_")

    @F.arrow_udf("struct<ids:array<int>,x:array<float>>")
    def sparse(texts: pa.Array, chars: pa.Array) -> pa.Array:
        only(_buckets)
        at, ids, x = features(texts.to_pylist(), chars.to_pylist())
        at = pa.array(at, pa.int32())
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(at, pa.array(ids, pa.int32())), pa.ListArray.from_arrays(at, pa.array(x, pa.float32()))], names=["ids", "x"])

    rows = rows.select("y", "id_", F.xxhash64("text_").alias("h"), sparse("text_", "chars_").alias("f"))
    found = rows.orderBy("id_", "h", "y").limit(2 * most_rows).toArrow()  # more than most_rows only where ids repeat
    found = found.take(pa.compute.sort_indices(found, [("id_", "ascending"), ("h", "ascending"), ("y", "ascending")])).combine_chunks() if found.num_rows else found
    if not found.num_rows:
        return fit(np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
    f = found["f"].combine_chunks()
    ids, x = f.field("ids"), f.field("x")
    at = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(ids).to_numpy(zero_copy_only=False))])
    return fit(at, ids.flatten().to_numpy(), x.flatten().to_numpy().astype(np.float64), found["y"].to_numpy())


def _metadata(docs: DataFrame) -> Column:
    return F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")


def score(docs: DataFrame, model: FactorisationMachine, text_col: str = "text") -> Column:
    """Probability of label 1 for each text; null counts as empty. Looks at the text and n_chars only.

    The model's size is fixed by WORD_BUCKETS and RANK (about 2 MB), whatever the data; it is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, model.linear, model.factors))

    @F.arrow_udf("double")
    def scores(texts: pa.Array, chars: pa.Array) -> pa.Array:
        only(_buckets)
        fm, out, at = FactorisationMachine(*shared.value), [], 0
        for part in slices(texts, 500):
            out.append(fm.scores(part.to_pylist(), chars.slice(at, len(part)).to_pylist()))
            at += len(part)
        return pa.array(np.concatenate(out) if out else [], pa.float64())

    return scores(F.col(text_col), _metadata(docs))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, held_out, score, predicted (score >= ACCEPT).

    Rows are scored one by one, so ties and repeated rows score alike; no labels at all give every row the score 0.5.
    """
    model = train(docs, labels, id_col, text_col)
    scored = docs.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), score(docs, model, text_col).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that the classifier accepts."""
    model = train(docs, labels, id_col, text_col)
    rows = docs.select(F.struct("*").alias("row_"), score(docs, model, text_col).alias("score_"))
    return rows.where(F.col("score_") >= ACCEPT).select("row_.*")


def op3_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
