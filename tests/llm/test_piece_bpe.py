"""The encoder's shortcuts against the merges they stand for."""

import random

from cytofabric.llm import piece_bpe


def test_longest_piece_ahead_is_read_off_the_automaton():
    bpe = piece_bpe.load(piece_bpe.default_model())
    draw = random.Random(4)
    pieces = sorted(bpe.reached)
    for _ in range(5_000):
        text = (draw.choice(pieces) + draw.choice(pieces))[: bpe.span]
        longest = next(text[:k] for k in range(len(text), 0, -1) if text[:k] in bpe.reached)
        assert bpe.begun[text[: bpe.find.longest_prefix(text)]] == longest


def test_remembered_pairs_are_bounded():
    pairs = piece_bpe.Pairs(lambda last, piece: last < piece, 10)
    for i in range(100):
        assert pairs[str(i % 7)][str(i)] == (str(i % 7) < str(i))
        assert sum(1 + len(row) for row in pairs.values()) <= 10


def test_each_text_is_encoded_once(odd_documents):
    encoded = piece_bpe.encode_documents(odd_documents)
    for df in (encoded, piece_bpe.digests(encoded)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        called = plan.split("ArrowEvalPython [")[1].split("], [")[0]
        assert plan.count("ArrowEvalPython") == 1 and called.count("(text#") == 1


def test_round_trip_is_encode_and_decode(odd_documents):
    t = piece_bpe.F.col("text")
    rows = odd_documents.select("text", piece_bpe.encode(t).alias("ids"), piece_bpe.round_trip(t).alias("r")).withColumn("decoded", piece_bpe.decode(piece_bpe.F.col("ids"))).collect()
    assert rows and all((r.ids, r.decoded) == tuple(r.r) for r in rows)
