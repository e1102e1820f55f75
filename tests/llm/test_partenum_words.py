"""The similarity join's sets of shingles, hashed for many texts at once, against plain ones."""

import random
import sys

import numpy as np

from cytofabric.llm import partenum
from cytofabric.llm.common import blank_words


def plain(text: str | None, words_each: int) -> set:
    w = blank_words(text)
    return {tuple(w[i : i + words_each]) for i in range(max(1, len(w) - words_each + 1))} if w else set()


def test_sets_are_those_of_plain_shingles():
    draw = random.Random(5)
    sizes = [1, 2, 7, 8, 9, 15, 16, 17, 63, 64, 65, 72, 300]
    words = ["".join(draw.choice("ab\u0000é") for _ in range(draw.choice(sizes))) for _ in range(60)] + ["a", "a\u0000", "\u0000", "A", " ", "\u0085", "\ud800", "a" * 64, "a" * 65]
    texts = [None, "", " ", "\t\n", "one", "One  two", "a b c", "a\u000bb\u000cc\rd", "x " * 50, "  lead", "trail \n"]
    texts += ["".join(draw.choice(words) + draw.choice([" ", "\n", "  \t"]) for _ in range(draw.randrange(80))) for _ in range(150)]
    for words_each in (1, 4, 5):
        seen, found = {}, partenum.shingle_sets(texts, words_each)
        assert len(found) == len(texts) and partenum.shingle_sets([], words_each) == []
        for text, hashes in zip(texts, found, strict=True):
            want = plain(text, words_each)
            assert len(hashes) == len(want) and (np.diff(hashes.astype(object)) > 0).all()
            assert (partenum.shingle_set(text, words_each) == hashes).all()
            for shingle in want:
                assert seen.setdefault(shingle, h := int(partenum.shingle_set(" ".join(w.decode("utf-8", "surrogatepass") for w in shingle), words_each)[0])) == h and h in hashes
        assert len(set(seen.values())) == len(seen)


def test_words_are_hashed_without_a_call_for_each():
    text, calls = " ".join(f"word{i}" for i in range(20_000)), 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        found = partenum.shingle_set(text, 4)
    finally:
        sys.setprofile(None)
    assert len(found) == 19_997 and calls < 2_000
