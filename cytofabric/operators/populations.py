"""Cell populations by marker signatures on a bit mask: predicates, packing, counts, fractions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A mask is a signed 64-bit integer; bit 63 is its sign, and bitwise operations stay right.
MOST_CHANNELS = 64
Signature = tuple[int, int]


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def signature(positive: Iterable[str], negative: Iterable[str], channels: Sequence[str]) -> Signature:
    """Bits of the channels that must be set and must be clear; empty names are ignored, unknown ones raise KeyError."""
    if len(channels) > MOST_CHANNELS:
        raise ValueError(f"{len(channels)} channels; a mask has {MOST_CHANNELS} bits")
    bit = {name: 1 << i for i, name in enumerate(channels)}
    return tuple(_signed(reduce(lambda a, n: a | bit[n], filter(None, names), 0)) for names in (positive, negative))


def matches(mask: Column, positive: int | Column, negative: int | Column) -> Column:
    """All positive bits set and all negative ones clear; no bits at all match every cell."""
    p, n = (F.lit(v).cast("long") if isinstance(v, int) else v for v in (positive, negative))
    return (mask.bitwiseAND(p) == p) & (mask.bitwiseAND(n) == 0)


def matches_columns(positive: Sequence[Column], negative: Sequence[Column]) -> Column:
    """The same predicate over boolean columns."""
    return reduce(lambda a, b: a & b, [*positive, *(~c for c in negative)], F.lit(True))


def pack(calls: DataFrame, channels: DataFrame, by: Sequence[str] = ("structure",)) -> DataFrame:
    """Long rows (by..., target, positive 0/1) to one mask for each cell; channels: (target, bit), small."""
    joined = calls.join(channels, "target").withColumn("v", F.expr("shiftleft(bigint(positive), int(bit))"))
    return joined.groupBy(*by).agg(F.bit_or("v").alias("mask"))


def channel_bits(targets: DataFrame) -> DataFrame:
    """(target, bit): bits by the order of the targets as text, so "10" comes before "2"."""
    ordered = targets.select(F.col("target").cast("string").alias("target")).distinct().agg(F.array_sort(F.collect_set("target")).alias("t"))
    return ordered.select(F.posexplode("t").alias("bit", "target")).select("target", "bit")


def unpack(mask: Column, channels: Sequence[str], prefix: str = "") -> list[Column]:
    """One 0/1 column for each channel, lowest bit first."""
    return [F.shiftright(mask, i).bitwiseAND(F.lit(1).cast("long")).cast("int").alias(f"{prefix}{c}") for i, c in enumerate(channels)]


def conjunction(phenotypes: Iterable[tuple[Iterable[str], Iterable[str]]]) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Cells of all the phenotypes at once: sorted unions of their markers."""
    both = list(phenotypes)
    return tuple(tuple(sorted({m for p in both for m in p[side]})) for side in (0, 1))


def display_name(positive: Column, negative: Column) -> Column:
    """A+ B+ C- from two arrays of markers."""
    return F.array_join(F.concat(F.transform(positive, lambda m: F.concat(m, F.lit("+"))), F.transform(negative, lambda m: F.concat(m, F.lit("-")))), " ")


def phenotype_text(positive: Column, negative: Column) -> Column:
    """Canonical text of a phenotype, markers in the order given; read back by phenotype_of()."""
    return F.to_json(F.struct(positive.alias("positive"), negative.alias("negative")))


def phenotype_of(text: Column) -> Column:
    return F.from_json(text, "positive array<string>, negative array<string>")


def resolve_handles(handles: DataFrame, composites: DataFrame, channels: DataFrame) -> DataFrame:
    """(handle, positive, negative, known): a composite's name or number, else a single channel, '' for all cells.

    composites: (identifier, name, marker, polarity) long; channels: (target). Unknown handles have known = false.
    """
    sides = composites.groupBy("identifier", "name").agg(
        F.array_sort(F.collect_set(F.when(F.col("polarity") == "positive", F.col("marker")))).alias("positive"),
        F.array_sort(F.collect_set(F.when(F.col("polarity") == "negative", F.col("marker")))).alias("negative"),
    )
    named = sides.select(F.col("name").alias("handle"), "positive", "negative").union(sides.select(F.col("identifier").cast("string"), "positive", "negative"))
    single = channels.select(F.col("target").alias("handle"), F.array("target").alias("positive"), F.array().cast("array<string>").alias("negative")).join(named.select("handle"), "handle", "left_anti")
    known = named.unionByName(single).withColumn("known", F.lit(True))
    none = F.array().cast("array<string>")
    found = handles.join(known, "handle", "left")
    return found.select("handle", F.coalesce("positive", none).alias("positive"), F.coalesce("negative", none).alias("negative"), (F.coalesce("known", F.lit(False)) | (F.col("handle") == "")).alias("known"))


def unknown_channels(requested: Column, known: Column) -> Column:
    return F.array_except(F.array_remove(requested, ""), known)


def counts(cells: DataFrame, signatures: Mapping[str, Signature], specimens: DataFrame | None = None, by: str = "specimen") -> DataFrame:
    """(by, <name>..., all_cells): cells of each signature in one pass, zero counts kept.

    With specimens, those without any cell get null. Sums are partial before the shuffle, one row for each specimen and task.
    """
    sums = [F.sum(F.when(matches(F.col("mask"), *s), 1).otherwise(0)).cast("long").alias(name) for name, s in signatures.items()]
    out = cells.groupBy(by).agg(*sums, F.count("*").alias("all_cells"))
    return out if specimens is None else specimens.select(by).distinct().join(out, by, "left")


def counts_long(cells: DataFrame, signatures: DataFrame, by: str = "specimen") -> DataFrame:
    """(signature, by, n) for a table of signatures (signature, positive, negative); cells are first counted by mask.

    Only (specimen, mask) pairs meet the signatures, so the work after the scan does not grow with cells.
    """
    masks = cells.groupBy(by, "mask").agg(F.count("*").alias("n"))
    hit = matches(F.col("mask"), F.col("positive"), F.col("negative"))
    crossed = masks.crossJoin(F.broadcast(signatures))  # requested signatures: a request's size, not the data's
    return crossed.groupBy("signature", by).agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n"))


def percentage(part: Column, whole: Column) -> Column:
    """100 * ratio with four digits of the ratio, half to even; null if either is null or the whole is 0, 0 if the part is 0."""
    return F.when(part.isNull() | whole.isNull() | (whole == 0), F.lit(None).cast("double")).when(part == 0, F.lit(0.0)).otherwise(100 * F.bround(part / whole * 10000, 0) / 10000)


def overlap_grid(cells: DataFrame, signatures: Mapping[str, Signature]) -> DataFrame:
    """(first, second, fraction): share of all cells in both of each pair of phenotypes, and in each alone."""
    both = [(a, a, signatures[a]) for a in signatures]
    both += [(a, b, tuple(x | y for x, y in zip(signatures[a], signatures[b], strict=True))) for a, b in combinations(signatures, 2)]
    sums = [F.sum(F.when(matches(F.col("mask"), *s), 1).otherwise(0)).alias(f"s{i}") for i, (_, _, s) in enumerate(both)]
    one = cells.agg(F.count("*").alias("total"), *sums)
    rows = F.array(*(F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.try_divide(f"s{i}", "total").alias("fraction")) for i, (a, b, _) in enumerate(both)))
    return one.select(F.explode(rows).alias("r")).select("r.*")


def summary(cells: DataFrame, channels: int, phenotypes: int) -> DataFrame:
    return cells.agg(F.countDistinct("specimen").alias("specimens"), F.count("*").alias("cells"), F.lit(channels).cast("long").alias("channels"), F.lit(phenotypes).cast("long").alias("phenotypes"))


def extents(cells: DataFrame, by: str = "specimen") -> DataFrame:
    return cells.groupBy(by).agg(F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"), F.count("*").alias("n"))


def feature_matrix(cells: DataFrame, channels: Sequence[str], phenotypes: Mapping[str, Signature], intensities: Sequence[str] = ()) -> DataFrame:
    """specimen, structure, x, y, `C <channel>` and `P <phenotype>` as 0/1, and intensities: a projection, no shuffle."""
    return cells.select(
        "specimen", "structure", "x", "y", *unpack(F.col("mask"), channels, "C "),
        *(matches(F.col("mask"), *s).cast("int").alias(f"P {p}") for p, s in phenotypes.items()), *(F.col(i).alias(f"I {i}") for i in intensities),
    )


def restrict(cells: DataFrame, ids: DataFrame, key: str = "structure") -> DataFrame:
    """Cells whose id is asked for; unknown ids are ignored."""
    return cells.join(ids.select(key), key, "left_semi")


def mismatched(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that only one side has: the check that two extracts describe the same cells. Keys with a null match none.

    Both sides are grouped at once, so a task holds one table of keys, and no sorted sides of a join.
    """
    none = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys))
    sides = [d.select(*keys, F.when(none, s).alias("side_"), F.when(F.lit(s == 0), 1).alias("in_left"), F.when(F.lit(s == 1), 1).alias("in_right")) for s, d in enumerate((left, right))]
    dealt = sides[0].union(sides[1]).repartition(*keys)  # keys are all but distinct: grouping them before they move would hold them twice
    found = dealt.groupBy(*keys, "side_").agg(F.max("in_left").alias("in_left"), F.max("in_right").alias("in_right"))
    return found.where("in_left is null or in_right is null").drop("side_")


def drop_discrete(table: DataFrame, columns: Sequence[str], most: int = 2) -> DataFrame:
    """Without the columns that have at most `most` distinct values; one pass, one row to the driver."""
    n = table.agg(*(F.count_distinct(c).alias(c) for c in columns)).first()
    return table.drop(*(c for c in columns if n[c] <= most))


def phenotype_presence(calls: DataFrame, studies: Sequence[str]) -> DataFrame:
    """(symbol, one 0/1 column for each study, studies): channels by the number of studies that have them."""
    wide = calls.groupBy("symbol").pivot("study", list(studies)).agg(F.lit(1)).fillna(0)
    return wide.withColumn("studies", reduce(lambda a, b: a + b, (F.col(f"`{s}`") for s in studies)).cast("long"))


def study_channels(channels: DataFrame, merged: Mapping[str, Sequence[str]], computed: Sequence[str] = ()) -> DataFrame:
    """Distinct (study, symbol) of channels (study, symbol, mechanism): names in merged become the several they stand for, mechanisms in computed go."""
    kept = channels.where(~F.coalesce(F.col("mechanism").isin(*computed), F.lit(False))) if computed else channels
    parts = F.array(F.col("symbol"))
    for name, several in merged.items():
        parts = F.when(F.col("symbol") == name, F.array(*map(F.lit, several))).otherwise(parts)
    return kept.select("study", F.explode(parts).alias("symbol")).distinct()


def in_one_study(presence: DataFrame) -> DataFrame:
    """Channels of phenotype_presence() that a single study has."""
    return presence.where("studies = 1")


def in_every_file(headers: DataFrame) -> DataFrame:
    """(kind, channel) that all files have, from rows (file, header): X Positive, X Intensity, X Cell Intensity."""
    n = headers.agg(F.count_distinct("file").alias("files"))
    name = F.regexp_extract("header", r"^(.+?)[ _](?:Positive|(?:Cell[ _])?Intensity)$", 1)
    kind = F.when(F.col("header").rlike("Positive$"), "Positive").otherwise("Intensity")
    rows = headers.select("file", kind.alias("kind"), name.alias("channel")).where("channel <> ''").where(~F.col("channel").rlike("(Nucleus|Cytoplasm|Membrane)$"))
    return rows.groupBy("kind", "channel").agg(F.count_distinct("file").alias("files_with")).crossJoin(F.broadcast(n)).where("files_with = files").select("kind", "channel")


def channel_coverage(expression: DataFrame) -> DataFrame:
    """(channel, structures, complete): how many structures have each channel, and whether all structures do. expression: (structure, channel)."""
    each = expression.select("structure", "channel").distinct()
    everyone = each.agg(F.count_distinct("structure").alias("everyone_"))
    n = each.groupBy("channel").agg(F.count("structure").alias("structures"))
    return n.crossJoin(F.broadcast(everyone)).select("channel", "structures", (F.col("structures") == F.col("everyone_")).alias("complete"))  # one row
