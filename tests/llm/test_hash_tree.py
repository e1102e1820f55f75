import hashlib
import math
import zlib

import pytest
from pyspark.sql import functions as F

from cytofabric.llm import hash_tree
from cytofabric.llm.hash_tree import Shard


def naive_shard(key, tree):
    """The descent in plain Python."""
    prefix, level = "", list(tree)
    for part in (lambda s: s.region, lambda s: f"{s.region}/{s.rack}", lambda s: f"{s.region}/{s.rack}/{s.shard}"):
        weights = {}
        for s in level:
            if s.weight:
                weights[part(s)] = weights.get(part(s), 0.0) + s.weight
        draws = {n: -math.log((int(hashlib.md5(f"{key}:{n}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52) / w for n, w in weights.items()}
        prefix = min(draws, key=draws.get)
        level = [s for s in level if part(s) == prefix]
    return int(prefix.rsplit("/", 1)[1])


UNEVEN = [Shard("a", "x", 0, 1.0), Shard("a", "x", 1, 3.0), Shard("a", "y", 2, 2.0), Shard("b", "x", 3, 0.0), Shard("b", "z", 4, 4.0), Shard("c", "z", 5, 0.5)]


@pytest.fixture(scope="module")
def keys(spark):
    return spark.range(4000).select(F.col("id").alias("doc_id"))


def where(keys, tree):
    return {r.doc_id: r.s for r in hash_tree.placed(keys, "doc_id", tree, "s").collect()}


@pytest.mark.parametrize("tree", [hash_tree.even_tree(), UNEVEN, [Shard("a", "x", 9, 2.0)]])
def test_descent_is_the_plain_one(keys, tree):
    assert where(keys.limit(300), tree) == {i: naive_shard(i, tree) for i in range(300)}


def test_shares_follow_the_weights(keys):
    got = where(keys, UNEVEN)
    total = sum(s.weight for s in UNEVEN)
    for s in UNEVEN:
        share, want = sum(v == s.shard for v in got.values()) / 4000, s.weight / total
        assert abs(share - want) < 4 * math.sqrt(want * (1 - want) / 4000) + 1e-9


def test_one_more_shard_takes_rows_only_into_itself(keys):
    tree = hash_tree.even_tree()
    for _ in range(3):
        then = hash_tree.grown(tree)
        new = then[-1].shard
        moved = hash_tree.moves(keys, tree, then).collect()
        assert {r.target for r in moved} == {new} and abs(len(moved) / 4000 - 1 / len(then)) < 0.015
        tree = then


def test_movement_stays_in_the_subtree_whose_weights_change(keys):
    before = hash_tree.even_tree(12, 3, 2)
    place = {s.shard: (s.region, s.rack) for s in before}
    heavier = [s._replace(weight=3.0) if s.shard == 5 else s for s in before]
    a, b = where(keys, before), where(keys, heavier)
    region, rack = place[5]
    for i in a:
        if a[i] != b[i]:  # comes into the region; within the region, into the rack; within the rack, into the shard
            assert place[b[i]][0] == region
            if place[a[i]][0] == region:
                assert place[b[i]] == (region, rack)
                if place[a[i]] == (region, rack):
                    assert b[i] == 5
    gone = [s._replace(weight=0.0) if s.shard == 5 else s for s in before]
    c = where(keys, gone)
    assert all(place[a[i]][0] == region for i in a if a[i] != c[i]) and 5 not in c.values()
    assert where(keys, list(reversed(before))) == a


def test_bad_trees():
    for tree in ([], [Shard("a", "x", 0, 0.0)], [Shard("a", "x", 0), Shard("b", "y", 0)], [Shard("a", "x", 0, -1.0), Shard("a", "x", 1)], [Shard("a", "x", 0, math.inf)]):
        with pytest.raises(ValueError):
            hash_tree._children(tree)


def test_sharding_of_odd_rows(odd_documents, no_documents):
    out = hash_tree.shard_documents(odd_documents).collect()
    text = {(r.doc_id, r.text) for r in odd_documents.collect()}
    assert len(out) == 12 and hash_tree.shard_documents(no_documents).count() == 0
    assert {(r.doc_id, r.size, r.text_crc32) for r in out} == {(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in text}
    tree = hash_tree.even_tree()
    for r in out:
        key = "" if r.doc_id is None else r.doc_id
        assert (r.shard, r.grown_shard) == (naive_shard(key, tree), naive_shard(key, hash_tree.grown(tree)))
    for s in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))


def test_slots_of_a_hot_id_are_gapless_over_many_ranges(spark):
    df = spark.range(6000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("same").alias("text"))
    out = hash_tree.shard_documents(df).select("shard", "slot", "doc_id").collect()
    assert len(out) == 6000
    for s in range(24):
        own = sorted((r.slot, r.doc_id) for r in out if r.shard == s)
        assert [a for a, _ in own] == list(range(len(own))) and [b for _, b in own] == sorted(b for _, b in own)


def test_shards_are_written_whole(odd_documents, tmp_path):
    df = odd_documents.withColumn("shard", F.lit("mine")).withColumn("key_", F.lit(1))
    name = hash_tree.write_shards(df, str(tmp_path / "s"))
    back = odd_documents.sparkSession.read.parquet(str(tmp_path / "s"))
    assert name == "shard_" and set(back.columns) == {*df.columns, name} and back.count() == 12
    assert all(r.shard_ == naive_shard("" if r.doc_id is None else r.doc_id, hash_tree.even_tree()) for r in back.collect())
