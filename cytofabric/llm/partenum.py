"""N-gram Jaccard join by PartEnum signatures, and the components of its links."""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache, lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, lowered, only, release, slices, table
from .components import connected_components

#: Rounds at least in which the members of a bucket are compared with one of them, before all that is left is; more follow while each settles
#: this share of the members that are left.
LEADER_ROUNDS, SETTLING = 2, 0.25
#: Sub-parts of a part, by the most differences k of two similar sets: more where k is small, as then a signature of few parts says little;
#: never fewer than three, so that a signature combines two or more.
SUB_PARTS = ((12, 4), (1 << 60, 3))
#: Parts beyond those needed, as a share of k: how many weak ones a set may leave out. Least and most bins of a sketch.
SLACK, LEAST_BINS, MOST_BINS = 0.15, 128, 1 << 16
#: Members, and shingles of members, that one side of a comparison of sets inside a task has; times as many where sketches are compared, of a byte or two for each shingle.
BLOCK, BLOCK_SHINGLES, OF_SKETCHES = 1024, 400_000, 6
#: Parts, by hash, in which described sets become classes, and signatures find those that share them: only one part at a time is in shuffle files.
CLASS_PARTS, SIGNATURE_PARTS = 4, 2
_MANY = 65535  # a full bin of a sketch
_C1, _C2, _P = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _C1
    x = (x ^ (x >> np.uint64(27))) * _C2
    return x ^ (x >> np.uint64(31))


#: Bytes that part words, masks of the lowest bytes of eight, and the bytes of the longest words that are hashed eight bytes at a time.
_BLANK = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
_LOWEST, LONG_WORD = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64), 64


def _word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where words start, and a 64-bit hash of each: its length and its bytes, eight by eight, so words of eight bytes or fewer and of one length never
    share one. Of longer words than LONG_WORD a digest. raw: lower-cased, with a blank before and eight after it."""
    blank = _BLANK[np.frombuffer(raw, np.uint8)]
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    eight = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))  # from each byte on
    hashes = _mix(_mix(sizes.astype(np.uint64) + _P) ^ (eight[starts] & _LOWEST[np.minimum(sizes, 8)]))
    done, more = 8, np.flatnonzero((sizes > 8) & (sizes <= LONG_WORD))
    while len(more):
        hashes[more] = _mix(hashes[more] ^ (eight[starts[more] + done] & _LOWEST[np.minimum(sizes[more] - done, 8)]))
        done += 8
        more = more[sizes[more] > done]
    for i in np.flatnonzero(sizes > LONG_WORD).tolist():
        hashes[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : starts[i] + sizes[i]], digest_size=8).digest(), "little")
    return starts, hashes


def shingle_sets(texts: list[str | None], words_each: int) -> list[np.ndarray]:
    """For each text, sorted distinct 64-bit hashes of the runs of words_each words; of fewer words, the whole as one; none if none."""
    raw = [lowered(t) for t in texts]
    starts, words = _word_hashes(b"".join([b" ", *(part for r in raw for part in (r, b" ")), bytes(b" " * 7)]))
    ends = np.searchsorted(starts, np.cumsum([len(r) + 1 for r in raw])).tolist()
    runs, out = _runs(words, words_each), []
    for a, b in zip([0, *ends], ends, strict=False):
        found = runs[a : b - words_each + 1] if b - a >= words_each else _runs(words[a:b], b - a) if b > a else words[:0]
        found = np.sort(found)
        out.append(found[np.concatenate([[True], found[1:] != found[:-1]])] if len(found) else found)
    return out


def _runs(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of each run of so many words."""
    out = np.full(max(0, len(words) - size + 1), size, np.uint64)
    for i in range(size if len(out) else 0):
        out = out * _P + words[i : len(words) - size + 1 + i]
    return _mix(out)


def shingle_set(text: str | None, words_each: int) -> np.ndarray:
    return shingle_sets([text], words_each)[0]


@cache
def band_starts(percent: int) -> list[int]:
    """Smallest sizes of the bands. The largest set of a band is so much larger than the smallest that similar sets are of one band or of adjacent ones."""
    starts = [1]
    while starts[-1] < 1 << 40:
        least = starts[-1] * 100 // percent + 1
        starts.append(least * 100 // percent + 1)
    return starts


@cache
def parts_of(k: int) -> tuple[int, int]:
    """(n1, n2): parts of the domain, and sub-parts of each, for sets that differ in k shingles at most."""
    return k // 2 + 2 + int(SLACK * k), next(n2 for most, n2 in SUB_PARTS if k <= most)


@lru_cache(64)
def _instance(i: int, k: int) -> tuple[int, int, np.uint64, np.ndarray]:
    """(n1, n2) of a band's instance, its salt, and a number for each of its sub-parts."""
    n1, n2 = parts_of(k)
    salt = _mix(np.array([i + 1], np.uint64))[0] | np.uint64(1)
    return n1, n2, salt, np.arange(n1 * n2, dtype=np.uint64).reshape(n1, n2) * _C1 + salt


def signatures(shingles: np.ndarray, percent: int) -> np.ndarray:
    """Signatures of which two different sets with 100 |A & B| >= percent |A | B| have one in common at least.

    A set takes part in the instance of its band, and in the one below if it may be the larger of two there. There two such sets
    differ in at most k shingles. The domain falls into n1 parts, each of n2 sub-parts. For each part all subsets of n2 - 1 sub-parts are
    enumerated: a signature hashes all shingles that the set has in such a subset. At most k // 2 parts hold two differences or more; each of
    the other g = n1 - k // 2 has a subset on which both sets agree. A set leaves out signatures of fewer than c shingles, for the largest c for which
    these lie in g - 1 parts at most. So of the two sets the one with the larger c keeps an agreeing signature, whose size is the same
    in the other, which keeps it too. Subsets of a shingle or two, which a common passage fills, rarely count then. With k = 0 only equal
    sets are similar; they need no signature.
    """
    n, out = len(shingles), []
    if not n:
        return np.zeros(0, np.uint64)
    starts = band_starts(percent)
    band = bisect_right(starts, n) - 1
    for i in (band, band - 1):
        k = (starts[i + 1] - 1) * (100 - percent) // percent if i >= 0 else 0
        if k == 0 or (i < band and n * percent > 100 * (starts[band] - 1)):
            continue
        n1, n2, salt, name = _instance(i, k)
        part = (((shingles * salt) >> np.uint64(33)) % np.uint64(n1 * n2)).astype(np.uint16 if n1 * n2 <= 1 << 16 else np.int64)  # short ones are sorted faster
        sizes, order = np.bincount(part, minlength=n1 * n2), np.argsort(part, kind="stable")
        ends, sums = np.cumsum(sizes), np.concatenate([[np.uint64(0)], np.cumsum(_mix(shingles[order] ^ salt))])
        hashed, sizes = (sums[ends] - sums[ends - sizes]).reshape(n1, n2), sizes.reshape(n1, n2)
        kept, weight = hashed.sum(1)[:, None] - hashed, sizes.sum(1)[:, None] - sizes  # of all sub-parts but one
        c = np.partition(weight.min(1), n1 - k // 2 - 1)[n1 - k // 2 - 1]
        out.append(_mix((kept * _P + name)[weight >= c]))
    return np.concatenate([*out, np.zeros(0, np.uint64)])


def sketch(shingles: np.ndarray) -> bytes:
    """How many shingles fall to each bin, at most _MANY: for most_common(). Bins are a power of two, about half as many as shingles, so that
    sketches of long texts say as much as those of short ones."""
    bins = min(MOST_BINS, max(LEAST_BINS, 1 << (len(shingles) // 2).bit_length() - 1)) if len(shingles) > 1 else LEAST_BINS
    return np.minimum(np.bincount((shingles >> np.uint64(7)).astype(np.int64) % bins, minlength=bins), _MANY).astype(np.uint16).tobytes()


def folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows, with the bins of the shortest of them: a longer one's bins are added up."""
    least = min(map(len, sketches)) // 2
    return np.stack([_fold(np.frombuffer(s, np.uint16), least) for s in sketches])


def _fold(counts: np.ndarray, bins: int) -> np.ndarray:
    return counts if len(counts) == bins else np.minimum(counts.reshape(-1, bins).sum(0, dtype=np.int64), _MANY).astype(np.uint16)


def most_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sum of the minima of two sketches, at least the size of the intersection; very large where a bin of both is full."""
    least = np.minimum(a, b)
    return np.where((least == _MANY).any(-1), 1 << 40, least.sum(-1, dtype=np.int64))


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    at = np.concatenate([[0], np.cumsum([len(a) for a in arrays])])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate([*arrays, np.zeros(0, np.uint64)]).view(np.int64)))


_DESCRIBED = pa.struct([("n", pa.int64()), ("set_key", pa.binary()), ("sigs", pa.list_(pa.int64())), ("sketch", pa.binary())])


def _described(text: Column, words_each: int, percent: int) -> Column:
    @F.arrow_udf("struct<n:bigint,set_key:binary,sigs:array<bigint>,sketch:binary>")
    def describe(texts: pa.Array) -> pa.Array:
        only()
        parts = []
        for part in slices(texts, 500, 4 << 20):
            sets = shingle_sets(part.to_pylist(), words_each)
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            columns = [pa.array(map(len, sets), pa.int64()), pa.array(keys, pa.binary()), _lists([signatures(s, percent) for s in sets]), pa.array(map(sketch, sets), pa.binary())]
            parts.append(pa.StructArray.from_arrays(columns, fields=list(_DESCRIBED)))
        return pa.concat_arrays(parts) if parts else pa.array([], _DESCRIBED)

    return describe(text)


def _sets(text: Column, words_each: int) -> Column:
    """struct(set_key, set): the key tells texts of repeated ids apart."""

    @F.arrow_udf("struct<set_key:binary,set:array<bigint>>")
    def sets(texts: pa.Array) -> pa.Array:
        only()
        parts = []
        for part in slices(texts, 500, 4 << 20):
            found = shingle_sets(part.to_pylist(), words_each)
            keys = pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in found], pa.binary())
            parts.append(pa.StructArray.from_arrays([keys, _lists(found)], names=["set_key", "set"]))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("set_key", pa.binary()), ("set", pa.list_(pa.int64()))]))

    return sets(text)


def jaccard_components(docs: DataFrame, words_each: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_shingles, component_id (smallest id reachable by links, itself included).

    Two documents link when 100 |A & B| >= percent |A | B| for their sets of words_each-word shingles. Texts without words, null
    ones too, have no shingles and no links. Rows with equal sets are one class, known by a number, so that copies are never
    paired and repeated ids with different texts stay apart. A row with a null id links as any other; it belongs to its component, whose id is null
    if no row in it has one.

    Members of a bucket of one signature are first compared with a leader of it, so a group of near copies costs rows in proportion to
    its size; another leader follows as long as that settles many. Buckets that still hold several components are then compared whole, inside
    tasks (_between_components).
    Each pair's similarity is counted from the whole sets; none is left out. Links stay in Spark throughout.
    """
    described = docs.select(F.col(id_col).cast("long").alias("id_"), _described(F.col(text_col), words_each, percent).alias("d"))
    described = cut(described.select("id_", "d.n", "d.set_key", "d.sigs", "d.sketch"))
    members = cut(described.select("id_", "n", "set_key"))
    classes = _classes(described)
    release(described)
    buckets = _buckets(classes)
    known = cut(classes.select("cls", "set_key", "rep", "n", "sketch").join(buckets.select("cls").distinct(), "cls", "left_semi"))
    names = cut(classes.select("cls", "set_key", "rep"))
    release(classes)
    texts = docs.select(F.col(id_col).cast("long").alias("id_"), F.col(text_col).alias("text_"))
    sets = _Sets(texts, known, words_each)

    links, turn, before = None, 0, None
    while True:
        found = _links(_with_leader(buckets, turn, percent), known, sets, percent)
        links = found if links is None else links.union(found)
        labels = connected_components(links, "a", "b")
        buckets = _unsettled(buckets.select("sig", "cls", "n"), labels)  # settled once, settled for good
        left, turn = buckets.select("cls").distinct().count(), turn + 1
        if not left:
            break
        if turn >= LEADER_ROUNDS and left > (1 - SETTLING) * before:
            labels = connected_components(links.union(_between_components(buckets, known, sets, percent)), "a", "b")
            break
        before = left
    placed = names.join(labels.select(F.col("id").alias("cls"), "component"), "cls", "left").select("set_key", "rep", F.coalesce("component", "cls").alias("component"))
    placed = cut(placed)
    least = placed.groupBy("component").agg(F.min("rep").alias("component_id"))
    placed = placed.join(least, "component").select("set_key", "component_id")
    return members.join(cut(placed), "set_key", "left").select(
        F.col("id_").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id_")).alias("component_id")
    )


def _classes(described: DataFrame) -> DataFrame:
    """(set_key, rep, n, sigs, sketch, cls): each distinct set that is not empty, with the smallest id that has it."""
    out = []
    for i in range(CLASS_PARTS):
        part = described.where((F.col("n") > 0) & (F.pmod(F.xxhash64("set_key"), F.lit(CLASS_PARTS)) == i))
        part = part.groupBy("set_key").agg(F.min("id_").alias("rep"), *(F.any_value(c).alias(c) for c in ("n", "sigs", "sketch")))
        out.append(cut(part.withColumn("cls", F.monotonically_increasing_id() * CLASS_PARTS + i)))
    return reduce(DataFrame.union, out)


def _buckets(classes: DataFrame) -> DataFrame:
    """(sig, cls, n): signatures that several classes have, with these. Counts are pre-aggregated, and a frequent signature's rows
    meet their count by a join, which adaptive execution can split."""
    out = []
    for i in range(SIGNATURE_PARTS):
        sigs = classes.select(F.explode("sigs").alias("sig"), "cls").where(F.pmod("sig", F.lit(SIGNATURE_PARTS)) == i)
        shared = sigs.groupBy("sig").agg(F.count("*").alias("size")).where("size > 1").select("sig")
        shared = cut(shared)
        out.append(cut(sigs.join(shared, "sig")))
        release(shared)
    rows = reduce(DataFrame.union, out)
    found = cut(rows.join(classes.select("cls", F.col("n").cast("int").alias("n")), "cls").select("sig", "cls", "n"))
    release(rows)
    return found


def _fit(a: str, b: str, percent: int) -> Column:
    """May sets of these sizes be similar?"""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _with_leader(buckets: DataFrame, turn: int, percent: int) -> DataFrame:
    """(a, b, n_a, n_b): each member with one of the leaders of its buckets, of another component: the one that most of them have.

    A bucket's leader is one of its members, another one each turn. Near copies share most buckets, so that one leader is
    as a rule their group's; pairs are never more than members.
    """
    rank = F.col("cls") if turn == 0 else F.xxhash64("cls", F.lit(turn))
    own = F.col("component") if turn else F.col("cls")
    leaders = buckets.groupBy("sig").agg(F.min(F.struct(rank.alias("k"), F.col("cls"), F.col("n"), own.alias("of"))).alias("l"))
    pairs = buckets.join(leaders, "sig").where(own != F.col("l.of"))
    pairs = pairs.select("cls", "n", F.col("l.cls").alias("leader"), F.col("l.n").alias("n_l")).where(_fit("n", "n_l", percent))
    shared = pairs.groupBy("cls", "n", "leader", "n_l").agg(F.count("*").alias("shared"))
    best = shared.groupBy("cls", "n").agg(F.max_by(F.struct("leader", "n_l"), F.struct("shared", -F.col("leader"))).alias("l"))
    return best.select(F.col("l.leader").alias("a"), F.col("cls").alias("b"), F.col("l.n_l").alias("n_a"), F.col("n").alias("n_b"))


def _unsettled(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (sig, cls, n, component) of buckets that hold more than one component."""
    rows = cut(buckets.join(labels.select(F.col("id").alias("cls"), "component"), "cls", "left").withColumn("component", F.coalesce("component", "cls")))
    mixed = rows.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("sig")
    return cut(rows.join(mixed, "sig").select("sig", "cls", "n", "component"))


class _Sets:
    """The sets of classes, made from the texts of those that need them, once."""

    def __init__(self, texts: DataFrame, known: DataFrame, words_each: int):
        self.texts, self.known, self.words_each, self.made = texts, known, words_each, None

    def of(self, wanted: DataFrame) -> DataFrame:
        """(cls, set) of the classes in wanted (cls), and of others wanted before."""
        wanted = wanted.distinct()
        wanted = wanted.join(self.made.select("cls"), "cls", "left_anti") if self.made else wanted
        wanted = cut(self.known.join(wanted, "cls", "left_semi").select("cls", "set_key", "rep"))
        rows = self.texts.join(wanted, F.col("id_").eqNullSafe(F.col("rep")), "left_semi")  # a class's rep is the id of one of its rows
        found = rows.select(_sets(F.col("text_"), self.words_each).alias("s")).select("s.*").dropDuplicates(["set_key"])
        # null-safe, as the optimizer would else ask for a key that is not null before the join above, and so make every text's set
        wanted = wanted.select("cls", F.col("set_key").alias("key_"))
        made = cut(found.join(wanted, F.col("set_key").eqNullSafe(F.col("key_"))).select("cls", "set"))
        self.made = self.made.union(made) if self.made else made
        return self.made


def _links(pairs: DataFrame, known: DataFrame, sets: _Sets, percent: int) -> DataFrame:
    """Those of the distinct pairs (a, b, n_a, n_b) that link. Pairs whose sketches leave no room for it go before any set moves."""
    pairs = pairs.join(known.select(F.col("cls").alias("a"), F.col("sketch").alias("x")), "a").join(known.select(F.col("cls").alias("b"), F.col("sketch").alias("y")), "b")
    pairs = pairs.withColumn("most", _most_common(F.col("x"), F.col("y")))
    pairs = cut(pairs.where(100 * F.col("most") >= percent * (F.col("n_a") + F.col("n_b") - F.col("most"))).select("a", "b"))
    made = sets.of(pairs.select(F.col("a").alias("cls")).union(pairs.select("b")))
    both = pairs.join(made.select(F.col("cls").alias("a"), F.col("set").alias("x")), "a").join(made.select(F.col("cls").alias("b"), F.col("set").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y")).cast("long")
    both = both.select("a", "b", common.alias("i"), (F.size("x") + F.size("y") - common).alias("u"))
    return cut(both.where(100 * F.col("i") >= percent * F.col("u")).select("a", "b"))


def _most_common(x: Column, y: Column) -> Column:
    @F.arrow_udf("bigint")
    def most(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([int(most_common(*folded([u, v]))) for u, v in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.int64())

    return most(x, y)


def _between_components(buckets: DataFrame, known: DataFrame, sets: _Sets, percent: int) -> DataFrame:
    """(a, b): links that join all components that any links in the buckets (sig, cls, n, component) join.

    Buckets of one smallest member become one group, as near copies meet in many buckets. In a group all members of different
    components are compared: by sketches first, of which only members that may have a link come back, then these by their whole
    sets, of which no more links come back than join the components. Blocks of a large group are spread over tasks; only those whose
    sizes leave room for a link meet. What comes back grows with the members; arithmetic, and rows that go out, with the square of the members
    of about one size in a group that does not settle.
    """
    leaders = buckets.groupBy("sig").agg(F.min("cls").alias("leader"))
    rows = cut(buckets.join(leaders, "sig").select("leader", "cls", "n", "component").distinct())
    may = _compared(rows.join(known.select("cls", F.col("sketch").alias("held")), "cls"), percent, False)
    rows = cut(rows.join(may.select(F.col("a").alias("leader"), F.col("b").alias("cls")).distinct(), ["leader", "cls"]))
    made = sets.of(rows.select("cls"))
    return cut(_compared(rows.join(made.select("cls", F.col("set").alias("held")), "cls"), percent, True).distinct())


def _compared(rows: DataFrame, percent: int, exact: bool) -> DataFrame:
    """rows: (leader, cls, n, component, held), held: the set if exact, else its sketch. Returns links (a, b) if exact, else (leader, cls) as (a, b).

    A group of more than BLOCK members or BLOCK_SHINGLES shingles (OF_SKETCHES times as many for sketches) falls into bins by size, as wide as two
    similar sets may differ, and each bin into blocks by hash. Each pair of blocks of one bin or of neighbours is compared by itself; a member goes to
    the pairs of its block, so few blocks mean few rows, and other sizes cost none.
    """
    rows = _dealt(rows, percent, 1 if exact else OF_SKETCHES)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            now = pa.concat_tables([held, now]).combine_chunks() if held is not None else now
            keys = [now[c].to_numpy() for c in ("leader", "lo", "hi")]
            edges = [0, *(np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1).tolist()]
            yield from found_in(now, edges)
            held = now.slice(edges[-1])
        if held is not None and held.num_rows:
            yield from found_in(held, [0, held.num_rows])

    def found_in(rows: pa.Table, edges: list[int]) -> Iterator[pa.RecordBatch]:
        columns, out = [rows[c].to_numpy() for c in ("leader", "lo", "hi", "own", "cls", "n", "component")], []
        payload = rows["held"].combine_chunks() if rows.num_rows else None
        for a, b in zip(edges, edges[1:], strict=False):
            leader, lo, hi, own, cls, n, component = (c[a:b] for c in columns)
            if b - a > 1 and (component != component[0]).any():
                pairs = _pairs_of(payload.slice(a, b - a), own if lo[0] != hi[0] else None, n, component.copy(), percent, exact)
                out += [(min(cls[i], cls[j]), max(cls[i], cls[j])) for i, j in pairs] if exact else [(leader[0], c) for c in {x for i, j in pairs for x in (cls[i], cls[j])}]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

    dealt = rows.repartition("leader", "lo", "hi").sortWithinPartitions("leader", "lo", "hi", "cls")
    return dealt.mapInArrow(compare, "a long, b long")


def _dealt(rows: DataFrame, percent: int, sides: int) -> DataFrame:
    """rows of _compared(), each once for each pair (lo, hi) of blocks that its own one takes part in. A block's name is its bin and its number there.

    A group's bins, of which there are few whatever the sizes, come as a map of blocks for each.
    """
    width = math.log(100 / percent) + 1e-9  # a little more, so that rounding never puts similar sizes two bins apart
    rows = rows.withColumn("bin", F.floor(F.log("n") / width))
    blocks = F.ceil(F.greatest(F.col("members") / (BLOCK * sides), F.col("shingles") / (BLOCK_SHINGLES * sides))).cast("long")
    binned = rows.groupBy("leader", "bin").agg(F.count("*").alias("members"), F.sum(F.col("n").cast("long")).alias("shingles"))
    groups = binned.withColumn("blocks", blocks).groupBy("leader").agg(
        F.sum("members").alias("members"), F.sum("shingles").alias("shingles"), F.map_from_entries(F.collect_list(F.struct("bin", "blocks"))).alias("bins")
    )
    groups = groups.select("leader", "bins", (blocks == 1).alias("whole"))
    rows = rows.join(groups, "leader").withColumn("block", F.when(F.col("whole"), F.lit(0)).otherwise(F.pmod(F.xxhash64("cls"), F.element_at("bins", F.col("bin")))))
    name = lambda bin_, block: bin_ * (1 << 24) + block
    met = F.flatten(F.transform(F.array(*(F.col("bin") + d for d in (-1, 0, 1))), lambda b: F.when(F.map_contains_key("bins", b), F.transform(F.sequence(F.lit(0).cast("long"), F.element_at("bins", b) - 1), lambda i: name(b, i))).otherwise(F.array().cast("array<bigint>"))))
    rows = rows.withColumn("own", F.when(F.col("whole"), F.lit(0)).otherwise(name(F.col("bin"), F.col("block"))).cast("long"))
    rows = rows.withColumn("other", F.explode(F.when(F.col("whole"), F.array(F.lit(0).cast("long"))).otherwise(met)))
    return rows.select("leader", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "cls", F.col("n").cast("long").alias("n"), "component", "held")


def _pairs_of(held: pa.Array, own: np.ndarray | None, n: np.ndarray, component: np.ndarray, percent: int, exact: bool) -> list[tuple[int, int]]:
    """Pairs (i, j) of a group's members of different components, and of different `own` if given, that link (exact) or may.

    Exact pairs join components as they are found, and later ones only count between what is still apart; of pairs that may link one is enough for each member.
    """
    out, m = [], len(n)
    if exact:
        starts = np.concatenate([[0], np.cumsum(n)])
        distinct, place = np.unique(held.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
        mark = np.zeros(len(distinct), np.int64)
    else:
        bins, seen = folded(held.to_pylist()), np.zeros(m, bool)
    for x in range(m - 1):
        may = (component[x + 1 :] != component[x]) & (100 * np.minimum(n[x + 1 :], n[x]) >= percent * np.maximum(n[x + 1 :], n[x]))
        if own is not None:
            may &= own[x + 1 :] != own[x]
        if not exact and seen[x]:
            may &= ~seen[x + 1 :]
        j = np.flatnonzero(may) + x + 1
        if not len(j):
            continue
        if exact:
            mark[place[starts[x] : starts[x + 1]]] = 1
            common = np.add.reduceat(mark[place[starts[x + 1] :]], starts[x + 1 : m] - starts[x + 1])[j - x - 1]
            mark[place[starts[x] : starts[x + 1]]] = 0
        else:
            common = most_common(bins[j], bins[x])
        j = j[100 * common >= percent * (n[x] + n[j] - common)]
        if exact:
            _, first = np.unique(component[j], return_index=True)
            out += [(x, int(j[i])) for i in first]
            component[np.isin(component, component[j])] = component[x]
        elif len(j):
            out += [(x, int(i)) for i in (j[~seen[j]] if (~seen[j]).any() else j[:1])]
            seen[j] = seen[x] = True
    return out


def keep_one_of_each(docs: DataFrame, words_each: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose id is their component's; those without words and without an id stay."""
    found = jaccard_components(docs, words_each, percent, id_col, text_col)
    kept = found.where(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("kept_")).distinct()
    rows = docs.select(F.struct("*").alias("row_"), F.col(id_col).cast("long").alias("key_"))
    return rows.join(kept, F.col("key_").eqNullSafe(F.col("kept_")), "left_semi").select("row_.*")


def op9_partenum_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), words_each=4, percent=85)
