import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytofabric.llm import dual_tree
from cytofabric.llm.common import alnum_words


def naive_ranks(items, docs, k=dual_tree.BEST):
    """items: (item_id, text), docs: (doc_id, text), in plain Python."""
    words = [(d, Counter(alnum_words(t))) for d, t in docs]
    words = [(d, c, sum(c.values())) for d, c in words if c]
    texts, length = len(words), sum(n for _, _, n in words)
    df = Counter(t for _, c, _ in words for t in c)
    out = []
    for item_id, text in items:
        scores = []
        for d, c, n in words:
            m = 100 - 50 + (50 * n * texts) // length
            s = sum(math.floor(1000 * math.log((2 * texts + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(alnum_words(text)) if c[t])
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item_id, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


def ranks(spark, items, docs, k=dual_tree.BEST):
    docs = docs if not isinstance(docs, list) else spark.createDataFrame(docs, "doc_id long, text string")
    items = items if not isinstance(items, list) else spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in dual_tree.rank_documents(items, docs, k).select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    docs = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randint(1, 80)))) for i in range(900)]
    docs += [(1000 + i, docs[5][1]) for i in range(120)]  # equal scores, more than any item may return
    items = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randint(1, 30)))) for i in range(70)]
    items += [(100, docs[5][1]), (101, docs[17][1]), (102, "nowhere else"), (103, "w0 w0 W0"), (104, None), (105, "")]
    return items, docs


@pytest.mark.parametrize(("tree", "node", "leaf"), [(4096, 512, 64), (128, 32, 8), (16, 8, 4)])
def test_ranks_are_those_of_brute_force(spark, corpus, monkeypatch, tree, node, leaf):
    """Also with hierarchies so small that every level has many nodes. Workers read the sizes from the module, so one process is used for that."""
    items, docs = corpus
    if tree == 4096:
        assert ranks(spark, items, docs) == naive_ranks(items, docs)
        return
    for name, value in (("TREE", tree), ("NODE", node), ("LEAF", leaf)):
        monkeypatch.setattr(dual_tree, name, value)
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, x in items for t in alnum_words(x)}))}
    words = [(d, Counter(alnum_words(t))) for d, t in docs]
    df = Counter(t for _, c in words for t in c)
    weights = np.zeros(len(vocabulary), np.int64)
    for t, i in vocabulary.items():
        if df[t]:
            weights[i] = math.floor(1000 * math.log((2 * len(words) + 2) / (2 * df[t] + 1)))
    texts, length = len(words), sum(sum(c.values()) for _, c in words)
    own = dual_tree.item_tree([(i, sorted({vocabulary[t] for t in alnum_words(x)})) for i, x in items], weights)
    best, dense, pruned = dual_tree.Best(np.zeros(len(own.numbers), np.int64), 50), np.zeros(len(vocabulary), np.int64), 0
    rows = [(d, sum(c.values()), sorted((vocabulary[t], tf) for t, tf in c.items() if t in vocabulary and weights[vocabulary[t]] > 0)) for d, c in words]
    rows = sorted((r for r in rows if r[2]), key=lambda r: sorted((-weights[t], t) for t, _ in r[2])[:4])
    scored, plain = [], dual_tree.Docs.score
    monkeypatch.setattr(dual_tree.Docs, "score", lambda self, *a: (scored.append(1), plain(self, *a)))
    for at in range(0, len(rows), tree):
        some = rows[at : at + tree]
        terms = [np.array([t for t, _ in r[2]]) for r in some]
        values = [np.array([1_000_000_000 * tf // (1000 * tf + 20 * (50 + 50 * r[1] * texts // length)) for _, tf in r[2]]) for r in some]
        ids = np.array([r[0] for r in some])
        dual_tree.search(own, dual_tree.Docs(ids, 2 * ids, dual_tree._rows(terms, values)), best, dense)
    pruned = 1 - len(scored) / (len(own.numbers) * -(-len(rows) // leaf))
    got = []
    for i, (scores, ids, _) in enumerate(best.held):
        order = np.lexsort((ids, -scores))
        got += [(int(own.numbers[i]), r + 1, int(ids[j]), int(scores[j])) for r, j in enumerate(order)]
    assert sorted(got, key=str) == naive_ranks(items, docs)
    assert pruned > 0  # some whole leaves that were never scored for an item
    assert not dense.any()


def test_bounds_are_never_exceeded():
    rng = np.random.default_rng(3)
    docs = dual_tree._rows([np.sort(rng.choice(50, rng.integers(1, 9), replace=False)) for _ in range(100)], [])
    docs = docs._replace(values=rng.integers(1, 1000, len(docs.terms)))
    weights = rng.integers(0, 100, 50)
    above, dense = docs.maxima(8), np.zeros(50, np.int64)
    for i in range(100):
        dense[docs.terms[docs.start[i] : docs.start[i + 1]]] = docs.values[docs.start[i] : docs.start[i + 1]]
        node = slice(above.start[i // 8], above.start[i // 8 + 1])
        most = np.zeros(50, np.int64)
        most[above.terms[node]] = above.values[node]
        assert (dense <= most).all() and (dense * weights).sum() <= (most * weights).sum()
        dense[:] = 0


def test_passes_are_bounded_and_change_nothing(spark, corpus, monkeypatch):
    items, docs = corpus
    monkeypatch.setattr(dual_tree, "MOST_ITEMS", 40)
    monkeypatch.setattr(dual_tree, "MOST_TERMS", 300)
    table = spark.createDataFrame([(i, [w for w in sorted(set(alnum_words(x)))]) for i, x in items], "item long, terms array<binary>")
    some = list(dual_tree._passes(table))
    assert sum(map(len, some)) == len(items) and all(len(s) <= 40 and (len(s) == 1 or len({t for _, ts in s for t in ts}) <= 300) for s in some) and len(some) > 1
    assert ranks(spark, items, docs, 7) == naive_ranks(items, docs, 7)


def test_ranks_of_odd_rows(spark, odd_documents, no_documents):
    items = [(1, "alpha BETA"), (2, None), (3, ""), (None, "mit license alpha"), (4, "ünï"), (4, "ünï"), (5, "beta\u0000alpha")]
    docs = [(r.doc_id, r.text) for r in odd_documents.collect()]
    frame = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(9)).withColumn("rank", F.lit("x"))
    got = sorted((tuple(r) for r in dual_tree.rank_documents(frame, odd_documents).select("item_id", "rank", "doc_id", "score").collect()), key=str)
    assert got == naive_ranks(items, docs)
    assert ranks(spark, frame, no_documents) == [] and ranks(spark, frame.limit(0), odd_documents) == []
    copies = [(None, "same words"), (7, "same words"), (3, "same words"), (3, "same words"), (2**63 - 1, "same words"), (9, "others altogether")]
    assert ranks(spark, [(1, "same")], copies, 4) == naive_ranks([(1, "same")], copies, 4)
