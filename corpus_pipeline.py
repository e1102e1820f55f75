"""A corpus from raw documents to token ids: five stages, each over all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cytofabric.llm import exact_dedup, partenum, pfair_mix, piece_bpe, quality_fm
from cytofabric.llm.common import cut, table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality_fm.keep_good(docs, table(spark, sf_dir, "labels"))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the largest id stays."""
    return exact_dedup.keep_first_copies(docs)


def distinct_shingles(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that near copies (five words, 0.8 or more) link together the smallest id stays."""
    return partenum.keep_one_of_each(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, and the position of each in an order that interleaves the sources by their target weights."""
    return pfair_mix.mixed(docs, position="position")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each text's token ids, and of the text decoded from them, with the text's position in the mix."""
    return piece_bpe.digests(piece_bpe.encode_documents(docs, keep=("position",)), keep=("position",))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_fm", good_documents),
    ("exact_dedup", distinct_texts),
    ("partenum_join", distinct_shingles),
    ("pfair_mix", mixed_sources),
    ("piece_bpe", token_ids),
]

#: The classifier, the similarity join and the tokenizer have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
