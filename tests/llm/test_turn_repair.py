import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from cytofabric.llm import turn_repair
from cytofabric.llm.turn_repair import INITIALS, Repair, edits

GRAMMAR = re.compile(r"(s?(ua)+)?\Z")


def naive_repair(rows):
    """All lists of edits by increasing cost, in plain Python: rows of (role, text), in order. -> faults, illegal, (cost, audit, repaired)."""
    seen, faults = set(), []
    for role, text in rows:
        ended = text.rstrip(" \t\n\v\f\r")
        faults.append("blank" if not ended else "duplicate" if (role, text) in seen else "truncated" if ended[-1] not in ".!?" else "")
        seen.add((role, text))
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    # (cost, audit, repaired roles, repaired turns) after each row, the best for each state of the grammar
    ways = {"": (0, "", ())}
    follows = {"": ("s", "u"), "s": ("u",), "u": ("a",), "a": ("u",)}

    def insert(ways):
        """Any number of insertions, until nothing gets cheaper or lesser."""
        out, todo = dict(ways), list(ways)
        while todo:
            state = todo.pop()
            cost, audit, turns = out[state]
            for nxt, name in (("u", "user"), ("a", "assistant")):
                new = (cost + 2, audit + "I", (*turns, (name, "")))
                if nxt in follows[state] and (nxt not in out or new < out[nxt]):
                    out[nxt] = new
                    todo.append(nxt)
        return out

    for (role, text), fault in zip(rows, faults, strict=True):
        after = {}
        # before any row the ways are compared whole, so all those of least cost are kept: see test_brute_force for all lists
        for state, (cost, audit, turns) in _all_insertions(ways, follows):
            options = [(state, cost + 3, "D", turns)]
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if role[:1] in follows[state]:
                    options.append((role[:1], cost + more, "K", (*turns, (role, text))))
                for nxt, name in (("u", "user"), ("a", "assistant")):
                    if nxt in follows[state]:
                        options.append((nxt, cost + 2 + more, "R", (*turns, (name, text))))
            for nxt, price, letter, said in options:
                new = (price, audit + letter, said)
                if nxt not in after or new[:2] < after[nxt][:2]:
                    after[nxt] = new
        ways = after
    best = min(w for state, w in _all_insertions(ways, follows, whole=True) if state in ("", "a"))
    return faults, illegal, best


def _all_insertions(ways, follows, whole=False):
    for state, (cost, audit, turns) in ways.items():
        at, row = state, (cost, audit, turns)
        for _ in range(4):
            yield at, row
            nxt = "a" if at == "u" else "u"
            row = (row[0] + 2, row[1] + "I", (*row[2], ("assistant" if nxt == "a" else "user", "")))
            at = nxt


def every_list(codes):
    """(cost, audit) of the best of really all lists of edits: each row D, K or R (to each role), up to three insertions anywhere."""
    best = None

    def go(i, roles, cost, audit):
        nonlocal best
        if best and cost > best[0]:
            return
        for ins in range(4):
            for kinds in _product(ins):
                said = roles + kinds
                price, letters = cost + 2 * ins, audit + "I" * ins
                if i == len(codes):
                    if GRAMMAR.match(said) and (best is None or (price, letters) < best):
                        best = (price, letters)
                    continue
                initial, fault = divmod(ord(codes[i]) - 65, 4)
                go(i + 1, said, price + 3, letters + "D")
                if fault < 2:
                    if initial < 3:
                        go(i + 1, said + INITIALS[initial], price + fault, letters + "K")
                    for r in "ua":
                        go(i + 1, said + r, price + 2 + fault, letters + "R")

    def _product(n):
        return [""] if n == 0 else [k + r for k in _product(n - 1) for r in "ua"]

    go(0, "", 0, "")
    return best


def test_brute_force():
    rng = random.Random(1)
    for _ in range(25):
        codes = "".join(chr(65 + rng.randrange(16)) for _ in range(rng.randint(0, 3)))
        assert edits(codes)[::-1] == every_list(codes)


def test_edits_are_those_of_the_plain_search():
    rng = random.Random(2)
    for n in [*range(8)] * 12 + [40, 200, 1024]:
        codes = "".join(chr(65 + rng.choice((0, 4, 4, 4, 8, 8, 8, 12, 5, 9, 6, 11))) for _ in range(n))
        audit, cost = edits(codes)
        # rows that have these codes
        rows = []
        for i, c in enumerate(codes):
            initial, fault = divmod(ord(c) - 65, 4)
            role = ("system", "user", "assistant", "tool")[initial]
            rows.append((role, " " if fault == 2 else f"{i}" if fault == 1 else f"{i}."))
        if any((ord(c) - 65) % 4 == 3 for c in codes):
            continue
        assert (cost, audit) == naive_repair(rows)[2][:2]


def test_halves_meet_where_whole_blocks_do():
    rng = random.Random(3)
    for _ in range(60):
        elements = [turn_repair.ROWS[rng.randrange(16)] for _ in range(rng.randint(1, 60))]
        end = turn_repair.closing_state(elements)
        step = rng.randint(1, 9)
        parts = [elements[i : i + step] for i in range(0, len(elements), step)]
        sums = [turn_repair.summary(p) for p in parts]
        assert turn_repair.closing_state(sums) == end
        whole, above = turn_repair.crossings(elements, 0, end), turn_repair.crossings(sums, 0, end)
        assert above == [*whole[::step], *([end] if len(elements) % step else [])][: len(above)]


@pytest.fixture(scope="module")
def turns(spark):
    rng = random.Random(5)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "USER"]
    texts = ["Yes.", "No!", "and so", "", " \n\t", None, "Why?  \n", "x" * 40000 + ".", "ü.", "a "]
    rows = [(c, t if rng.random() > 0.05 else None, rng.choice(roles), rng.choice(texts)) for c in (1, 2, 3, None) for t in range(rng.randint(1, 12))]
    rows += [(9, t, rng.choice(roles[:5]), f"turn {t}" + rng.choice([".", "", "?"])) for t in range(150) for _ in range(rng.randint(1, 2))]
    rows += [(10, 4, "user", "Same."), (10, 4, "user", "Same."), (10, 4, "assistant", "Same."), (11, None, None, None), (12, 2**40, "assistant", "Last."), (12, -3, "system", "First.")]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("i", F.lit("x")).withColumn("at", F.lit(1)).withColumn("code", F.lit(2))


def expected(rows, original):
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t, " " if r is None else r, " " if x is None else x))
    out = {}
    for c in original:
        own = sorted(by.get(c, []), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        known = [t for t, _, _ in own if t is not None]
        faults, illegal, (cost, audit, repaired) = naive_repair([r[1:] for r in own])
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        sha = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in repaired).encode()).hexdigest()
        out[c] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha), repaired
    return out


@pytest.mark.parametrize("bits", [10, 3, 1])
def test_repairs_of_odd_conversations(turns, bits, monkeypatch):
    """Blocks of 1024, 8 and 2 rows: the same repairs, through none, two and three levels of sums."""
    monkeypatch.setattr(turn_repair, "BLOCK_BITS", bits)
    monkeypatch.setattr(turn_repair, "FAN", 4)
    want = expected([r[:4] for r in turns.collect()], {r.conv_id for r in turns.collect()})
    repair = Repair(turns)
    got = {r.conv_id: tuple(r)[1:] for r in repair.report().collect()}
    assert got == {c: w for c, (w, _) in want.items()}
    said = {}
    for r in repair.repaired().orderBy("conv_id", "place").collect():
        said.setdefault(r.conv_id, []).append((r.role, r.text))
    assert said == {c: [tuple(x) for x in repaired] for c, (_, repaired) in want.items() if repaired}
    assert all(GRAMMAR.match("".join(role[0] for role, _ in s)) for s in said.values())
    repair.release()


def test_damage_is_by_the_checksum(turns):
    want = []
    for c, t, role, text in [r[:4] for r in turns.collect()]:
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        row = (c, t, "user" if fate == 4 else role, "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text)
        want += [row] * (0 if fate == 0 else 2 if fate == 3 else 1)
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in turn_repair.damage(turns).collect())


def test_conversations_without_turns(spark, turns):
    none = turns.limit(0)
    assert Repair(none).report().count() == 0
    row = Repair(none).report(turns.where("conv_id = 10")).collect()
    assert [tuple(r) for r in row] == [(10, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
