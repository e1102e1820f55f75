"""Repair of a conversation's structure: Hirschberg's divide and conquer over costs of four states, in blocks that Spark spreads."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, release, slices, table

#: Costs of the edits; a truncated row that stays costs TRUNCATED more.
REROLE, INSERT, DELETE, TRUNCATED = 2, 2, 3, 1
#: Rows of a conversation that one task works through at a time, as a power of two, and blocks (of blocks) that meet in one step above them.
BLOCK_BITS, FAN = 10, 16
BLANKS = " \t\n\v\f\r"
#: States: nothing said yet, after system, after user, after assistant. A conversation may end in the first and the last.
STATES, CLOSING = 4, ("", "II", "I", "")
#: A row's code is one letter: which initial (s, u, a, other) and which fault (none, truncated, blank, duplicate).
INITIALS, SOUND, CUT_OFF, BLANK, DUPLICATE = "sua", 0, 1, 2, 3
NEVER = 1 << 40


def _inserted(state: int) -> Iterator[tuple[int, str]]:
    """(state, letters) reachable by insertions; a third one would only come back to where one was."""
    yield state, ""
    step = 3 if state == 2 else 2
    yield step, "I"
    if state < 2:
        yield 3, "II"


def _row(code: int) -> tuple[list[list[int]], list[list[int]], list[list[str]]]:
    """(cost, rank, letters) from state to state over one row: insertions, then Delete, Keep or Rerole. rank orders the letters from one state."""
    initial, fault = divmod(code, 4)
    cost, letters = [[NEVER] * STATES for _ in range(STATES)], [[""] * STATES for _ in range(STATES)]
    stays = TRUNCATED if fault == CUT_OFF else 0
    for start in range(STATES):
        for at, before in _inserted(start):
            turn = 3 if at == 2 else 2  # the state after the user or assistant turn that may come next
            moves = [("D", at, DELETE)]
            if fault < BLANK:
                moves.append(("R", turn, REROLE + stays))
                if initial == 0 and at == 0:
                    moves.append(("K", 1, stays))
                elif initial == turn - 1:
                    moves.append(("K", turn, stays))
            for letter, end, price in moves:
                new = (price + INSERT * len(before), before + letter)
                if new < (cost[start][end], letters[start][end]):
                    cost[start][end], letters[start][end] = new
    return cost, [_ranks(row) for row in letters], letters


def _ranks(keys: Sequence) -> list[int]:
    order = sorted(range(len(keys)), key=keys.__getitem__)
    out = [0] * len(keys)
    for rank, i in enumerate(order):
        out[i] = rank
    return out


ROWS = [_row(code) for code in range(16)]


def forward(elements: Sequence, start: int) -> tuple[list[int], list[int]]:
    """(cost, rank) of the cheapest way from start over elements to each state; rank orders the ASCII-least letters of these ways.

    Such letters end with an edit that uses up the last row, so none is a prefix of another's: who is least now stays so whatever follows. Four costs and
    four ranks are all that is kept.
    """
    cost, rank = [NEVER] * STATES, [0] * STATES
    cost[start] = 0
    for price, order, *_ in elements:
        best = [min((cost[s] + price[s][q], rank[s], order[s][q]) for s in range(STATES)) for q in range(STATES)]
        cost = [b[0] for b in best]
        rank = _ranks([b[1:] for b in best])
    return cost, rank


def backward(elements: Sequence, end: int) -> list[int]:
    """The cost of the cheapest way from each state over elements to end."""
    cost = [NEVER] * STATES
    cost[end] = 0
    for price, *_ in reversed(elements):
        cost = [min(price[s][q] + cost[q] for q in range(STATES)) for s in range(STATES)]
    return cost


def closing_state(elements: Sequence, start: int = 0) -> int:
    """The state after the last element on the cheapest way to the end, ASCII-least among those."""
    cost, rank = forward(elements, start)
    return min(range(STATES), key=lambda q: (cost[q] + INSERT * len(CLOSING[q]), rank[q]))


def crossings(elements: Sequence, start: int, end: int) -> list[int]:
    """The states before each element and after the last, on the cheapest and then ASCII-least way from start to end.

    Hirschberg: costs forward over the first half and backward over the second meet in the middle; of the optimal crossings that with the least
    letters so far is taken, and both halves go on alike.
    """
    if len(elements) <= 1:
        return [start, end][: len(elements) + 1]
    middle = len(elements) // 2
    there, rank = forward(elements[:middle], start)
    back = backward(elements[middle:], end)
    state = min(range(STATES), key=lambda s: (there[s] + back[s], rank[s]))
    return crossings(elements[:middle], start, state)[:-1] + crossings(elements[middle:], state, end)


def summary(elements: Sequence) -> tuple[list[list[int]], list[list[int]]]:
    """(cost, rank) from state to state over all elements: itself an element of the level above."""
    both = [forward(elements, s) for s in range(STATES)]
    return [c for c, _ in both], [r for _, r in both]


def edits(codes: str, start: int = 0, end: int | None = None) -> tuple[str, int]:
    """(letters, cost) of the rows of one block; end None: the block is a conversation's last, and closing insertions follow."""
    elements = [ROWS[ord(c) - 65] for c in codes]
    last = closing_state(elements, start) if end is None else end
    states = crossings(elements, start, last)
    pairs = list(zip(elements, states, states[1:], strict=False))
    tail = CLOSING[last] if end is None else ""
    return "".join(e[2][p][q] for e, p, q in pairs) + tail, sum(e[0][p][q] for e, p, q in pairs) + INSERT * len(tail)


def damage(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as a careless crawl leaves them, by crc32(conv_id:turn) % 20: 0 lost, 1 without text, 2 without its
    `.`, `!` and `?`, 3 twice, 4 said by the user. A null role or text becomes one space, as a null does in conv_id:turn; null ids and turns stay."""
    space = F.lit(" ")
    part = lambda c: F.coalesce(F.col(c).cast("string"), space)
    rows = turns.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), (F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20).alias("fate"))
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.where("fate <> 0").select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "fate")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("fate") == 3, 2).otherwise(1)))).drop("fate", "copy")


class Repair:
    """The cheapest repair of each conversation of turns (conv_id, turn, role, text).

    A conversation's rows stand by turn (null first), equal turns by role and text. All rows with a null conv_id are one conversation. A null role
    or text counts as one space. A row's first fault counts: blank (nothing but spaces and line ends), duplicate (role and text stood before),
    truncated (does not end in `.`, `!` or `?`). Blank and duplicate rows must go. Kept rows stay as they are, others are given the role user or
    assistant, empty turns of the two may be inserted, so that role initials read `(s?(ua)+)?`. Of equally cheap lists of edits that with the
    ASCII-least initials is taken (Delete, Insert, Keep, Rerole).

    Rows are sorted in ranges, so a conversation of any length spreads over tasks; they travel as one letter each in blocks of at most 2^BLOCK_BITS.
    Blocks of a conversation are summed up FAN by FAN, each as the costs and the order of its ways from state to state, until one sum is left; from
    there the crossings between blocks are settled downwards, then those within blocks. Two exchanges carry texts: the first sort, and the one that brings the
    rows of a conversation together in order, as a digest or a transcript wants them; they pass in a stream and are never gathered.

    release() deletes the tables behind it. An empty table has no repairs.
    """

    def __init__(self, turns: DataFrame):
        space = F.lit(" ")
        rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), space).alias("role"), F.coalesce(F.col("text"), space).alias("text"))
        order = ["conv_id", F.asc_nulls_first("turn"), "role", "text"]
        self.rows = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
        self.codes = cut(self._codes())
        self.blocks = cut(self._blocks())
        self.edits = cut(self._edits())

    def release(self) -> None:
        release(self.rows, self.codes, self.blocks, self.edits)

    def _codes(self) -> DataFrame:
        """(conv_id, turn, at, code): what a row is, without its text. The first of equal rows is found by a minimum, not by gathering them."""
        ended = F.rtrim(F.col("text"), F.lit(BLANKS))
        fault = F.when(ended == "", BLANK).when(F.substring(ended, -1, 1).isin(".", "!", "?"), SOUND).otherwise(CUT_OFF)
        known = self.rows.select("conv_id", "turn", "at", "role", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), fault.alias("fault"))
        firsts = known.groupBy("conv_id", "role", "digest").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
        initial = F.instr(F.lit(INITIALS), F.substring("role", 1, 1))
        initial = F.when((initial > 0) & (F.col("role") != ""), initial - 1).otherwise(len(INITIALS))
        all_faults = F.when((F.col("fault") != BLANK) & F.col("first").isNull(), DUPLICATE).otherwise(F.col("fault"))
        return known.join(firsts, "at", "left").select("conv_id", "turn", "at", F.char(65 + 4 * initial + all_faults).alias("code"))

    def _blocks(self) -> DataFrame:
        """(conv_id, i, first, n_blocks, codes): blocks of a conversation in order, i from 0; first: where its first row stands."""
        letters = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "code"))), lambda r: r.code), "")
        blocks = self.codes.groupBy("conv_id", F.shiftright("at", BLOCK_BITS).alias("block")).agg(F.min("at").alias("first"), letters.alias("codes"))
        # one small row for each block of up to 2^BLOCK_BITS rows
        own = Window.partitionBy("conv_id")
        return blocks.select("conv_id", (F.row_number().over(own.orderBy("block")) - 1).alias("i"), "first", F.count("*").over(own).alias("n_blocks"), "codes")

    def _edits(self) -> DataFrame:
        """(conv_id, i, audit, cost) of every block."""

        @F.pandas_udf("array<array<array<long>>>")
        def of_codes(codes: pd.Series) -> pd.Series:
            return codes.map(lambda c: [list(m) for m in summary([ROWS[ord(x) - 65] for x in c])])

        @F.pandas_udf("array<array<array<long>>>")
        def of_parts(parts: pd.Series) -> pd.Series:
            return parts.map(lambda p: [list(m) for m in summary(_nested(p))])

        @F.pandas_udf("array<int>")
        def between(parts: pd.Series, start: pd.Series, end: pd.Series) -> pd.Series:
            out = []
            for p, s, e in zip(map(_nested, parts), start, end, strict=True):
                out.append(crossings(p, int(s), closing_state(p, int(s)) if pd.isna(e) else int(e)))
            return pd.Series(out)

        @F.pandas_udf("audit string, cost long")
        def within(codes: pd.Series, start: pd.Series, end: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([edits(c, int(s), None if pd.isna(e) else int(e)) for c, s, e in zip(codes, start, end, strict=True)], columns=["audit", "cost"])

        none, spent = F.lit(None).cast("int"), []
        several = self.blocks.where("n_blocks > 1")
        levels = [cut(several.select("conv_id", "i", of_codes("codes").alias("sums")))]
        while levels[-1].where("i > 0").limit(1).count():
            parts = F.array_sort(F.collect_list(F.struct("i", "sums")))
            up = levels[-1].groupBy("conv_id", F.floor(F.col("i") / FAN).cast("int").alias("i")).agg(F.transform(parts, lambda r: r.sums).alias("parts"))
            levels.append(cut(up.withColumn("sums", of_parts("parts"))))
        # downwards: a sum's own start and end give those of its parts; the last part of the last one ends as is cheapest
        known = levels[-1].select("conv_id", "i", F.lit(0).alias("start"), none.alias("end"))
        for level in reversed(levels[1:]):
            same = level.select(F.col("conv_id").alias("c"), F.col("i").alias("j"), "parts")
            met = same.join(known, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("i") == F.col("j"))).withColumn("states", between("parts", "start", "end"))
            met = met.select("conv_id", F.col("i").alias("up"), "end", "states", F.posexplode("parts").alias("k", "part"))
            last = (F.col("k") == F.size("states") - 2) & F.col("end").isNull()
            known = cut(met.select("conv_id", (F.col("up") * FAN + F.col("k")).cast("int").alias("i"), F.get("states", F.col("k")).alias("start"), F.when(~last, F.get("states", F.col("k") + 1)).alias("end")))
            spent.append(known)
        known = known.select(F.col("conv_id").alias("c"), F.col("i").alias("j"), "start", "end")
        long = several.join(known, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("i") == F.col("j"))).select("conv_id", "i", "codes", "start", "end")
        every = self.blocks.where("n_blocks = 1").select("conv_id", "i", "codes", F.lit(0).alias("start"), none.alias("end")).union(long)
        out = cut(every.select("conv_id", "i", within("codes", "start", "end").alias("e")).select("conv_id", "i", "e.audit", "e.cost"))
        release(*levels, *spent)
        return out

    def _marked(self) -> DataFrame:
        """(conv_id, at, role, text, audit): the rows, and before those of each block its edits; a conversation's together and in order."""
        edits = self.edits.select(F.col("conv_id").alias("c"), F.col("i").alias("j"), "audit")
        blocks = self.blocks.select("conv_id", "i", "first").join(edits, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("i") == F.col("j")))
        none = F.lit(None).cast("string")
        blocks = blocks.select("conv_id", F.col("first").alias("at"), none.alias("role"), none.alias("text"), "audit")
        both = self.rows.select("conv_id", "at", "role", "text", none.alias("audit")).union(blocks)
        return both.repartition("conv_id").sortWithinPartitions("conv_id", "at", F.desc_nulls_last("audit"))

    def repaired(self) -> DataFrame:
        """(conv_id, place, role, text, edit): the turns of each repaired conversation, place from 0; edit: Keep, Rerole or Insert."""
        types = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])
        return self._marked().mapInArrow(lambda batches: _batched(_repaired(batches), types), "conv_id long, place long, role string, text string, edit string")

    def digests(self) -> DataFrame:
        """(conv_id, repaired_sha256): SHA-256 of the repaired turns, role:text, joined by line feeds."""

        def digest(batches):
            conv, sha = None, None
            for c, place, role, text, _ in _repaired(batches, empty=True):
                if place < 0:
                    if sha is not None:
                        yield conv, sha.hexdigest()
                    conv, sha = c, hashlib.sha256()
                else:
                    sha.update(("\n" * (place > 0) + f"{role}:{text}").encode("utf-8", "surrogatepass"))
            if sha is not None:
                yield conv, sha.hexdigest()

        types = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])
        return self._marked().mapInArrow(lambda batches: _batched(digest(batches), types), "conv_id long, repaired_sha256 string")

    def report(self, conversations: DataFrame | None = None) -> DataFrame:
        """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one row for each conversation.

        gaps: turns that are missing between the first and the last. illegal: neighbours whose role initials are not su, ua or au, before repair.
        conversations: (conv_id) that get a row even without turns: zeros, no audit, the empty text's digest.
        """
        fault = (F.ascii("code") - 65) % 4
        count = lambda f: F.sum(F.when(fault == f, 1).otherwise(0)).cast("long")
        turn = F.col("turn")
        counts = self.codes.groupBy("conv_id", "turn").agg(count(BLANK).alias("blank"), count(DUPLICATE).alias("duplicate"), count(CUT_OFF).alias("truncated"))
        counts = counts.groupBy("conv_id").agg(F.coalesce(F.max(turn) - F.min(turn) + 1 - F.count(turn), F.lit(0)).alias("gaps"), *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")))
        plain = F.translate("codes", "".join(map(chr, range(65, 81))), "ssssuuuuaaaaxxxx")
        joined = F.concat(F.coalesce(F.substring(F.lag(plain).over(Window.partitionBy("conv_id").orderBy("i")), -1, 1), F.lit("")), plain)
        bad = F.length(joined) - 1 - F.regexp_count(joined, F.lit("s(?=u)|u(?=a)|a(?=u)"))
        illegal = self.blocks.select("conv_id", bad.alias("illegal")).groupBy("conv_id").agg(F.sum("illegal").cast("long").alias("illegal"))
        letters = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "audit"))), lambda r: r.audit), "")
        audits = self.edits.groupBy("conv_id").agg(F.sum("cost").alias("cost"), letters.alias("audit"))
        parts = [counts, illegal, audits, self.digests()] + ([conversations.select("conv_id").distinct()] if conversations is not None else [])
        numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
        columns = {**dict.fromkeys(numbers, "long"), "audit": "string", "repaired_sha256": "string"}
        # every part has one row for a conversation, so the largest value is the only one; a null conv_id groups as any other
        padded = [p.select(F.col("conv_id").cast("long").alias("conv_id"), *((F.col(c) if c in p.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items())) for p in parts]
        together = padded[0]
        for p in padded[1:]:
            together = together.union(p)
        empty = {**dict.fromkeys(numbers, F.lit(0).cast("long")), "audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256(b"").hexdigest())}
        return together.groupBy("conv_id").agg(*(F.coalesce(F.max(c), empty[c]).alias(c) for c in columns))


def _nested(parts) -> list:
    """Sums as they come from Spark (arrays of arrays), as lists."""
    return [[[list(map(int, row)) for row in matrix] for matrix in part] for part in parts]


def _batched(rows: Iterator[tuple], types: pa.Schema, most: int = 500) -> Iterator[pa.RecordBatch]:
    while held := list(itertools.islice(rows, most)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types.types, strict=True)], schema=types)


def _repaired(batches, empty: bool = False) -> Iterator[tuple]:
    """(conv_id, place, role, text, edit) of each turn that a stream of _marked() rows leaves or gains.

    empty: a conversation also gives a first row with place -1, so that one without turns is seen.
    """
    conv, begun, audit, at, state, place = None, False, "", 0, 0, 0

    def insertions():
        nonlocal at, state, place
        while at < len(audit) and audit[at] == "I":
            role, state = ("assistant", 3) if state == 2 else ("user", 2)
            yield conv, place, role, "", "Insert"
            at, place = at + 1, place + 1

    for batch in batches:
        for part in slices(batch.to_struct_array()):
            for row in part.to_pylist():
                if row["audit"] is not None:
                    yield from insertions()
                    if not begun or row["conv_id"] != conv:
                        conv, begun, state, place = row["conv_id"], True, 0, 0
                        if empty:
                            yield conv, -1, None, None, None
                    audit, at = row["audit"], 0
                    continue
                yield from insertions()
                edit, at = audit[at], at + 1
                if edit == "D":
                    continue
                if edit == "R":
                    role, state = ("assistant", 3) if state == 2 else ("user", 2)
                else:
                    role = row["role"]
                    state = 1 + INITIALS.index(role[0])
                yield conv, place, role, row["text"], "Rerole" if edit == "R" else "Keep"
                place += 1
    yield from insertions()


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return Repair(damage(turns)).report(turns)


#: The same by a search from row to row that keeps, for each conversation and state, the cheapest and ASCII-least list of edits.
ORACLE = r"""
WITH RECURSIVE bits AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, i) AS v FROM range(256) r(i))),
c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
fated AS (SELECT *, xor(list_reduce(list_transform(regexp_extract_all(hex(key), '..'), lambda h: CAST('0x' || h AS BIGINT)), lambda a, b: xor(a // 256, t[1 + xor(a % 256, b)]), CAST(4294967295 AS BIGINT)), 4294967295) % 20 AS fate FROM c, bits),
damaged AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN fate = 3 THEN [1, 2] ELSE [1] END) AS copy FROM fated WHERE fate <> 0),
placed AS (SELECT *, row_number() OVER w AS i, lag(left(role, 1)) OVER w || left(role, 1) AS pair FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
told AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen FROM placed),
r AS MATERIALIZED (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM told),
ins(p, q, letters, price, said) AS (VALUES (0, 0, '', 0, ''), (1, 1, '', 0, ''), (2, 2, '', 0, ''), (3, 3, '', 0, ''), (0, 2, 'I', 2, chr(10) || 'user:'), (1, 2, 'I', 2, chr(10) || 'user:'), (3, 2, 'I', 2, chr(10) || 'user:'),
  (2, 3, 'I', 2, chr(10) || 'assistant:'), (0, 3, 'II', 4, chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 3, 'II', 4, chr(10) || 'user:' || chr(10) || 'assistant:')),
edit(letter, initial, q, s, price, said) AS (SELECT 'D', CAST(NULL AS VARCHAR), x, x, 3, CAST(NULL AS VARCHAR) FROM range(4) v(x) UNION ALL VALUES ('K', 's', 0, 1, 0, NULL), ('K', 'u', 0, 2, 0, NULL), ('K', 'u', 1, 2, 0, NULL), ('K', 'u', 3, 2, 0, NULL), ('K', 'a', 2, 3, 0, NULL),
  ('R', NULL, 0, 2, 2, 'user'), ('R', NULL, 1, 2, 2, 'user'), ('R', NULL, 3, 2, 2, 'user'), ('R', NULL, 2, 3, 2, 'assistant')),
dp AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS state, '' AS audit, CAST(0 AS BIGINT) AS cost, '' AS said FROM (SELECT DISTINCT conv_id FROM r)
  UNION ALL SELECT conv_id, i, state, min(audit) AS audit, any_value(cost) AS cost, arg_min(said, audit) AS said FROM (
    SELECT *, min(cost) OVER (PARTITION BY conv_id, state) AS least FROM (
    SELECT dp.conv_id, r.i, CAST(edit.s AS BIGINT) AS state, dp.audit || ins.letters || edit.letter AS audit, dp.cost + ins.price + edit.price + CASE WHEN r.fault = 'truncated' AND edit.letter <> 'D' THEN 1 ELSE 0 END AS cost,
      dp.said || ins.said || CASE WHEN edit.letter = 'D' THEN '' ELSE chr(10) || coalesce(edit.said, r.role) || ':' || r.text END AS said
    FROM dp JOIN r ON r.conv_id IS NOT DISTINCT FROM dp.conv_id AND r.i = dp.i + 1 JOIN ins ON ins.p = dp.state JOIN edit ON edit.q = ins.q AND (edit.initial IS NULL OR edit.initial = left(r.role, 1)) AND (edit.letter = 'D' OR r.fault NOT IN ('blank', 'duplicate'))))
  WHERE cost = least GROUP BY conv_id, i, state),
size AS (SELECT conv_id, max(i) AS n, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY 1),
ended AS (SELECT dp.conv_id, min(printf('%09d', cost + x.price) || audit || x.letters) AS best, arg_min(dp.said || x.said, printf('%09d', cost + x.price) || audit || x.letters) AS said
  FROM dp JOIN size ON dp.conv_id IS NOT DISTINCT FROM size.conv_id AND dp.i = size.n JOIN ins x ON x.p = dp.state AND x.q IN (0, 3) GROUP BY 1)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(CAST(left(best, 9) AS BIGINT), 0) AS cost, coalesce(substr(best, 10), '') AS audit, sha256(coalesce(substr(said, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN size s ON a.conv_id IS NOT DISTINCT FROM s.conv_id LEFT JOIN ended e ON a.conv_id IS NOT DISTINCT FROM e.conv_id
"""
