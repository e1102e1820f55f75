"""Ranked lexical search by a dual tree: hierarchies over items and documents whose nodes hold coordinate maxima."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import alnum_words, cut, release, slices, table

#: Documents that each item gets.
BEST = 50
#: One pass over the documents serves items of at most so many, with so many distinct terms together (an item with more has a pass of its own).
MOST_ITEMS, MOST_TERMS = 4096, 1 << 18
#: Documents in a tree (a row of the stored hierarchy), in its inner nodes and in its leaves; items below an inner node of their tree.
TREE, NODE, LEAF, ITEM_FAN = 4096, 512, 64, 8
#: Heaviest terms of a document by which it is sorted, so that documents under one node are alike.
SORT_TERMS = 4


class Rows(NamedTuple):
    """Sparse rows: those of node i are (terms, values)[start[i]:start[i + 1]]."""

    start: np.ndarray
    terms: np.ndarray
    values: np.ndarray

    def sums(self, dense: np.ndarray, which: np.ndarray) -> np.ndarray:
        """For each node of `which`: the sum of its values times those of dense. Whole numbers of 64 bits throughout."""
        sizes = self.start[which + 1] - self.start[which]
        at = np.repeat(self.start[which] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        sums = np.concatenate([[0], np.cumsum(self.values[at] * dense[self.terms[at]])])
        ends = np.cumsum(sizes)
        return sums[ends] - sums[ends - sizes]

    def maxima(self, size: int) -> Rows:
        """The level above: each `size` nodes in turn as one, which holds every term of theirs with the largest value."""
        nodes = len(self.start) - 1
        node = np.repeat(np.arange(nodes) // size, np.diff(self.start))
        order = np.lexsort((self.values, self.terms, node))
        node, terms, values = node[order], self.terms[order], self.values[order]
        last = np.ones(len(order), bool)
        last[:-1] = (node[1:] != node[:-1]) | (terms[1:] != terms[:-1])
        above = -(-nodes // size)
        return Rows(np.concatenate([[0], np.cumsum(np.bincount(node[last], minlength=above))]).astype(np.int64), terms[last], values[last])


def _rows(lists: list[np.ndarray], values: list[np.ndarray]) -> Rows:
    start = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    return Rows(start, np.concatenate([*lists, np.zeros(0, np.int64)]).astype(np.int64), np.concatenate([*values, np.zeros(0, np.int64)]).astype(np.int64))


class Items(NamedTuple):
    """The hierarchy over one pass's items: level 0 is the items, each level above has a node for ITEM_FAN below, the last has one."""

    numbers: np.ndarray
    levels: list[Rows]
    terms: int


def item_tree(items: list[tuple[int, list[int]]], weights: np.ndarray) -> Items:
    """items: (number, terms). They stand by their heaviest terms, so that items under one node share some. A node's coordinate is a term's weight
    where any item below has the term: the largest."""
    kept = [(n, sorted((t for t in terms if weights[t] > 0), key=lambda t: (-weights[t], t))) for n, terms in items]
    kept = sorted((k for k in kept if k[1]), key=lambda k: k[1][:SORT_TERMS])
    terms = [np.array(t, np.int64) for _, t in kept]
    levels = [_rows(terms, [weights[t] for t in terms])]
    while len(levels[-1].start) > 2:
        levels.append(levels[-1].maxima(ITEM_FAN))
    return Items(np.array([n for n, _ in kept], np.int64), levels, len(weights))


class Best:
    """The best documents of each item that a task has seen, and the score below which none matters (the weakest kth).

    A document is its id (the largest number for null, so that it comes last among equal scores) and its mark: twice its row's number, and 1 for a null id.
    """

    def __init__(self, floors: np.ndarray, k: int):
        self.k, self.floors = k, floors.copy()
        self.held: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 3] * len(floors)

    def add(self, item: int, scores: np.ndarray, ids: np.ndarray, marks: np.ndarray) -> None:
        own = tuple(np.concatenate(x) for x in zip(self.held[item], (scores, ids, marks), strict=True))
        if len(own[0]) > self.k:
            order = np.lexsort((own[2], own[1], -own[0]))[: self.k]
            own = tuple(x[order] for x in own)
        if len(own[0]) == self.k:
            self.floors[item] = max(self.floors[item], own[0].min())
        self.held[item] = own


class Docs(NamedTuple):
    """A tree of documents, each with a term at least."""

    ids: np.ndarray
    marks: np.ndarray
    rows: Rows

    def score(self, leaf: int, item: int, items: Items, best: Best, dense: np.ndarray) -> None:
        """The exact scores of a leaf's documents for one item."""
        rows, own = self.rows, items.levels[0]
        first, last = leaf * LEAF, min((leaf + 1) * LEAF, len(self.ids))
        part, have = slice(rows.start[first], rows.start[last]), slice(own.start[item], own.start[item + 1])
        dense[own.terms[have]] = own.values[have]
        scores = np.add.reduceat(rows.values[part] * dense[rows.terms[part]], rows.start[first:last] - rows.start[first])
        dense[own.terms[have]] = 0
        good = np.flatnonzero(scores >= max(best.floors[item], 1))
        if len(good):
            best.add(item, scores[good], self.ids[first + good], self.marks[first + good])


def search(items: Items, docs: Docs, best: Best, dense: np.ndarray) -> None:
    """All documents of one tree against all items: both hierarchies descend together, and a pair of nodes is left where the sum of the products of their
    maxima, which no pair below can exceed, is under the weakest kth score of its items. A document with just that score may still win by its id."""
    leaves = docs.rows.maxima(LEAF)
    inner = leaves.maxima(NODE // LEAF)
    tree = [docs.rows, leaves, inner, inner.maxima(TREE // NODE)]
    fans = [1, LEAF, NODE // LEAF, TREE // NODE]

    def bounds(level: int, node: int, depth: int, which: np.ndarray) -> np.ndarray:
        rows = tree[level]
        part = slice(rows.start[node], rows.start[node + 1])
        dense[rows.terms[part]] = rows.values[part]
        out = items.levels[depth].sums(dense, which)
        dense[rows.terms[part]] = 0
        return out

    def weakest(depth: int, which: np.ndarray) -> np.ndarray:
        """The least floor of the items below each node."""
        width = ITEM_FAN**depth
        return np.array([best.floors[n * width : (n + 1) * width].min() for n in which], np.int64) if depth else best.floors[which]

    def descend(level: int, node: int, depth: int, which: np.ndarray) -> None:
        which = which[bounds(level, node, depth, which) >= np.maximum(weakest(depth, which), 1)]
        if not len(which):
            return
        if level == 1 and not depth:
            for item in which:
                docs.score(node, item, items, best, dense)
        elif depth and (depth >= level or level == 1):  # the taller hierarchy goes down first
            below = (which[:, None] * ITEM_FAN + np.arange(ITEM_FAN)).ravel()
            descend(level, node, depth - 1, below[below < len(items.levels[depth - 1].start) - 1])
        else:
            for child in range(node * fans[level], min((node + 1) * fans[level], len(tree[level - 1].start) - 1)):
                descend(level - 1, child, depth, which)

    descend(3, 0, len(items.levels) - 1, np.zeros(1, np.int64))


def seed(items: Items, docs: Docs, best: Best, dense: np.ndarray) -> None:
    """For each item the documents of the one leaf whose bound is largest: scores that documents really have, so a fair start for the weakest kth."""
    leaves, every = docs.rows.maxima(LEAF), np.arange(len(items.numbers))
    top, at = np.zeros(len(every), np.int64), np.full(len(every), -1)
    for leaf in range(len(leaves.start) - 1):
        part = slice(leaves.start[leaf], leaves.start[leaf + 1])
        dense[leaves.terms[part]] = leaves.values[part]
        bound = items.levels[0].sums(dense, every)
        dense[leaves.terms[part]] = 0
        at[bound > top] = leaf
        top = np.maximum(top, bound)
    for item in np.flatnonzero(at >= 0):
        docs.score(int(at[item]), int(item), items, best, dense)


def _best_of(found: DataFrame, k: int) -> DataFrame:
    """(item, doc, score, rank): the k best of each item; first of each of 64 parts of its candidates, as these may be many."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), "doc"]
    part = Window.partitionBy("item", F.pmod(F.xxhash64("doc"), F.lit(64))).orderBy(*order)
    some = found.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)


def _passes(items: DataFrame) -> Iterator[list[tuple[int, list[bytes]]]]:
    """The items (item, terms) a bounded number at a time, in order; they are read from the stored table as they are needed."""
    held: list[tuple[int, list[bytes]]] = []
    known: set[bytes] = set()
    for row in items.toLocalIterator():
        terms = [bytes(t) for t in row.terms]
        if held and (len(held) >= MOST_ITEMS or len(known) + sum(t not in known for t in terms) > MOST_TERMS):
            yield held
            held, known = [], set()
        held.append((row.item, terms))
        known.update(terms)
    if held:
        yield held


def _vectors(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, terms, counts): of each text its number of terms and how often it has those of the vocabulary. Rows with n null instead
    give in how many texts of a task each term stands, so that these counts are added up before they travel."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches):
        number, seen = known.value, Counter()
        for batch in batches:
            for part in slices(batch.to_struct_array()):
                out = []
                for row in part.to_pylist():
                    words = alnum_words(row["text"])
                    own = sorted((number[w], c) for w, c in Counter(words).items() if w in number)
                    seen.update(t for t, _ in own)
                    if words:
                        out.append((row["doc_id"], len(words), [t for t, _ in own], [c for _, c in own]))
                yield _vector_batch(out)
        yield _vector_batch([(None, None, list(seen), list(seen.values()))])

    # a task's counts come last: a task that runs again gives the same rows
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return cut(rows.mapInArrow(count, "doc_id long, n long, terms array<int>, counts array<long>").withColumn("doc", F.monotonically_increasing_id()))


def _vector_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
    types = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "n", "terms", "counts"])


def _hierarchy(vectors: DataFrame, weights: np.ndarray, texts: int, length: int) -> DataFrame:
    """Trees of TREE documents: (docs, ids, start, terms, values). value: (10^9 tf) div (1000 tf + 20 m), m = 50 + (50 n texts) div length.

    Documents stand by their heaviest terms, sorted in ranges; rows that agree in all of these by their number, so that no key is too large for a task.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(weights)

    def weigh(batches):
        weight = shared.value
        for batch in batches:
            for part in slices(batch.to_struct_array()):
                out = []
                for row in part.to_pylist():
                    terms, tf = np.array(row["terms"], np.int64), np.array(row["counts"], np.int64)
                    terms, tf = terms[weight[terms] > 0], tf[weight[terms] > 0]
                    if len(terms):
                        m = 50 + 50 * row["n"] * texts // length
                        order = np.lexsort((terms, -weight[terms]))[:SORT_TERMS]
                        out.append((terms[order].tolist(), row["doc"], row["doc_id"], terms.tolist(), ((1_000_000_000 * tf) // (1000 * tf + 20 * m)).tolist()))
                columns = list(zip(*out, strict=True)) or [()] * 5
                types = (pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["key", "doc", "doc_id", "terms", "values"])

    def plant(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            while batch.num_rows:
                take = min(batch.num_rows, TREE - sum(b.num_rows for b in held))
                held.append(batch.slice(0, take))
                batch = batch.slice(take)
                if sum(b.num_rows for b in held) == TREE:
                    yield tree(held)
                    held = []
        if held:
            yield tree(held)

    def tree(held):
        rows = pa.Table.from_batches(held).combine_chunks()
        doc, ids = rows["doc"].to_numpy(), rows["doc_id"].combine_chunks()
        missing = ids.is_null().to_numpy(zero_copy_only=False)
        start = np.concatenate([[0], np.cumsum(pc.list_value_length(rows["terms"]).to_numpy())])
        columns = [ids.fill_null(np.iinfo(np.int64).max).to_numpy(), 2 * doc + missing, start, pc.list_flatten(rows["terms"]).to_numpy(), pc.list_flatten(rows["values"]).to_numpy()]
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays([0, len(c)], pa.array(c, t)) for c, t in zip(columns, types, strict=True)], ["ids", "marks", "start", "terms", "values"])

    weighed = vectors.where("n is not null and size(terms) > 0").select("doc", "doc_id", "n", "terms", "counts")
    weighed = weighed.mapInArrow(weigh, "key array<int>, doc long, doc_id long, terms array<int>, values array<long>")
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # set, as the search costs more than the trees' bytes tell
    ordered = weighed.repartitionByRange(parts, "key", "doc").sortWithinPartitions("key", "doc").select("doc", "doc_id", "terms", "values")
    return cut(ordered.mapInArrow(plant, "ids array<long>, marks array<long>, start array<long>, terms array<int>, values array<long>"))


def _over_trees(trees: DataFrame, items: Items, floors: np.ndarray, k: int, step) -> DataFrame:
    """(item, doc, doc_id, score): what `step` finds for each item in a task's trees, at most k each. items and floors are one pass's, so bounded."""
    shared = trees.sparkSession.sparkContext.broadcast((items, floors))

    def run(batches):
        own, least = shared.value
        best, dense = Best(least, k), np.zeros(own.terms, np.int64)
        for batch in batches:
            for at in range(batch.num_rows):
                ids, marks, start, terms, values = (np.array(batch.column(c)[at].values, np.int64) for c in ("ids", "marks", "start", "terms", "values"))
                step(own, Docs(ids, marks, Rows(start, terms, values)), best, dense)
        for item, (scores, ids, marks) in enumerate(best.held):
            good = scores >= best.floors[item]
            if good.any():
                marks, named = marks[good], pa.array(ids[good], mask=marks[good] % 2 == 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(marks), own.numbers[item])), pa.array(marks // 2), named, pa.array(scores[good])], ["item", "doc", "doc_id", "score"])

    return trees.mapInArrow(run, "item long, doc long, doc_id long, score long")


def rank_documents(items: DataFrame, docs: DataFrame, k: int = BEST, item_col: str = "item_id", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(item_col, rank, doc_id, score): the k documents that score highest for each row of items, those above 0 only, equal scores by ascending id.

    Terms are runs of letters, digits and characters beyond ASCII, A-Z lower-cased; a null text has none. Scores are those of BM25 in whole numbers:
    with N documents that have a term and L terms in them, a document's score is the sum over the item's distinct terms of
    w * ((10^9 tf) div (1000 tf + 20 m)), w = floor(1000 ln((2N + 2) / (2df + 1))), m = 50 + (50 n N) div L. Rows are items and documents of their own even if they repeat;
    null ids come last among equal scores. Items or documents without terms, and empty tables, give no rows.

    Items are taken a bounded number at a time (MOST_ITEMS, MOST_TERMS), so what is broadcast is bounded however many there are; each pass reads the documents once,
    and keeps of them the terms its items have. The documents' hierarchy is stored; its trees are searched by separate tasks. A first round scores for each item the
    most promising leaf of each tree, which gives all tasks of the second a common kth score to prune by. A task sends no more than k documents for an item.
    """
    spark = items.sparkSession

    @F.pandas_udf("array<binary>")
    def distinct_terms(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sorted(set(alnum_words(t))))

    told = cut(items.select(F.col(item_col).alias("item_id"), distinct_terms(F.col(text_col)).alias("terms")).withColumn("item", F.monotonically_increasing_id()))
    out = spark.createDataFrame([], "item long, rank int, doc_id long, score long")
    for some in _passes(told.select("item", "terms")):
        vocabulary = {t: i for i, t in enumerate(sorted({t for _, terms in some for t in terms}))}
        vectors = _vectors(docs, vocabulary, id_col, text_col)
        texts, length = vectors.where("n is not null").agg(F.count("*"), F.sum("n")).first()
        if not texts or not vocabulary:
            release(vectors)
            continue
        weights = np.zeros(len(vocabulary), np.int64)
        seen = vectors.where("n is null").select(F.explode(F.arrays_zip("terms", "counts")).alias("e")).groupBy("e.terms").agg(F.sum("e.counts").alias("df"))
        for term, df in seen.collect():  # at most one row for each term of the pass
            weights[term] = math.floor(1000 * math.log((2 * texts + 2) / (2 * df + 1)))
        tree = item_tree([(n, [vocabulary[t] for t in terms]) for n, terms in some], weights)
        if not len(tree.numbers):
            release(vectors)
            continue
        trees = _hierarchy(vectors, weights, texts, length)
        release(vectors)
        floors = np.zeros(len(tree.numbers), np.int64)
        place = {int(n): i for i, n in enumerate(tree.numbers)}
        first = _best_of(_over_trees(trees, tree, floors, k, seed), k).where(F.col("rank") == k)
        for row in first.select("item", "score").collect():  # at most one row for each item of the pass
            floors[place[row.item]] = row.score
        found = cut(_best_of(_over_trees(trees, tree, floors, k, search), k).select("item", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
        release(trees)
        out = out.union(found)
    return out.join(told.select("item", "item_id"), "item").select(F.col("item_id").alias(item_col), "rank", "doc_id", "score")


def op12_dual_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH words AS MATERIALIZED (SELECT doc_id, unnest({_WORDS}) AS term FROM documents),
tf AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
len AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY 1),
total AS (SELECT count(*) AS texts, CAST(sum(n) AS BIGINT) AS length FROM len),
item AS (SELECT DISTINCT item_id, unnest({_WORDS}) AS term FROM benchmark),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(texts) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY 1),
scored AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * texts) // length)))) AS BIGINT) AS score
  FROM item JOIN w USING (term) JOIN tf USING (term) JOIN len USING (doc_id), total GROUP BY ALL),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {BEST}
"""
