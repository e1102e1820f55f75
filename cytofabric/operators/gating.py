"""From intensities to calls: mixtures and gates, gate search, segments to cells."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import dequantise, quantise
from .neighbors import stored
from .populations import Signature, matches
from .sampling import allocation, at_most, representative


def segment_means(pixels: DataFrame, channels: Sequence[str]) -> DataFrame:
    """(sample, segment, row, col, <channel>...): mean place of a segment's pixels, and mean value of each channel where it is present, else 0."""
    means = [F.coalesce(F.avg(F.when(~F.isnan(F.col(c).cast("double")), F.col(c))), F.lit(0.0)).alias(c) for c in channels]
    return pixels.groupBy("sample", "segment").agg(F.avg("row").alias("row"), F.avg("col").alias("col"), *means)


def gates_from_calls(cells: DataFrame, channels: Mapping[str, Signature], intensity: Mapping[str, str]) -> DataFrame:
    """(specimen, channel, gate): midway between the highest intensity of negative cells and the lowest of positive ones; one if the other is absent."""
    return _gates(cells.groupBy("specimen").agg(*_extremes(channels, {c: F.col(intensity[c]) for c in channels})), channels)


def _extremes(channels: Mapping[str, Signature], value: Mapping[str, Column]) -> list[Column]:
    """Aggregates low_<channel> and high_<channel>: the highest value of a channel's negative cells and the lowest of its positive ones."""
    both = []
    for c, s in channels.items():
        hit = matches(F.col("mask"), *s)
        both += [F.max(F.when(~hit, value[c])).alias(f"low_{c}"), F.min(F.when(hit, value[c])).alias(f"high_{c}")]
    return both


def _gates(wide: DataFrame, channels: Mapping[str, Signature]) -> DataFrame:
    gate = lambda c: F.coalesce((F.col(f"low_{c}") + F.col(f"high_{c}")) / 2, F.col(f"low_{c}"), F.col(f"high_{c}"))
    rows = F.array(*(F.struct(F.lit(c).alias("channel"), gate(c).cast("double").alias("gate")) for c in channels))
    return wide.select("specimen", F.explode(rows).alias("r")).select("specimen", "r.*")


def gate_bytes(cells: DataFrame, channels: Mapping[str, Signature], intensity: Mapping[str, str]) -> DataFrame:
    """(specimen, channel, gate): gates_from_calls() over intensities as their one-byte codes hold them, as a code itself; 0 becomes 1.

    intensity: channel -> a column of values in 0..1. Null where a specimen has no value of the channel.
    """
    return _bytes(cells.groupBy("specimen").agg(*_held_extremes(channels, intensity)), channels)


def _held_extremes(channels: Mapping[str, Signature], intensity: Mapping[str, str]) -> list[Column]:
    """_extremes() of codes; a value's code does not fall as the value grows, so each specimen's extremes are decoded by _bytes(), not each cell."""
    return _extremes(channels, {c: quantise(F.col(intensity[c]).cast("double")) for c in channels})


def _bytes(wide: DataFrame, channels: Mapping[str, Signature]) -> DataFrame:
    gates = _gates(wide.withColumns({f"{end}_{c}": dequantise(F.col(f"{end}_{c}")) for c in channels for end in ("low", "high")}), channels)
    byte = F.when(F.col("gate").isNotNull(), F.greatest(quantise(F.col("gate")), F.lit(1)))
    return gates.select("specimen", "channel", byte.cast("smallint").alias("gate"))


def subsample_metadata(cells: DataFrame, channels: Mapping[str, Signature], intensity: Mapping[str, str], most: int = 1_000_000) -> DataFrame:
    """(specimen, count, thresholds): the cells that representative() takes of each specimen, and its gate bytes in the order of channels.

    Gates are those of all of a specimen's cells, not of its sample. One row for each specimen; sums and extremes are pre-aggregated, in one pass over the cells.
    """
    wide = stored(cells.groupBy("specimen").agg(F.count("*").alias("n"), *_held_extremes(channels, intensity)))
    sizes = allocation(wide.select("specimen", "n"), most)
    gates = _bytes(wide, channels).groupBy("specimen").agg(F.map_from_entries(F.collect_list(F.struct("channel", "gate"))).alias("gates_"))
    of = F.array(*(F.element_at("gates_", F.lit(c)) for c in channels))
    return sizes.join(gates, "specimen").select("specimen", F.col("take").alias("count"), of.alias("thresholds"))


def subsample_bytes(cells: DataFrame, channels: Sequence[str], intensity: Mapping[str, str], most: int = 1_000_000, seed: int = 10001) -> DataFrame:
    """(specimen, structure, codes): representative() cells with one byte for each channel, in order; a missing value is byte 0."""
    codes = F.concat(*(F.unhex(F.lpad(F.hex(F.coalesce(quantise(F.col(intensity[c]).cast("double")), F.lit(0)).cast("long")), 2, "0")) for c in channels))
    return representative(cells, most, seed).select("specimen", "structure", codes.alias("codes"))


def discordance(cells: DataFrame, assigned: Mapping[str, str], signatures: Mapping[str, tuple[Sequence[str], Sequence[str]]], gates: DataFrame, by: str = "sample") -> DataFrame:
    """(by, candidate, distance): mean Jaccard distance between assigned calls and those that gates make, over signatures.

    assigned: signature -> 0/1 column; gates: (by, candidate, <channel>...) with a gate for each channel. Positive is value > gate.
    """
    g = gates.select(by, "candidate", *(F.col(c).alias(f"gate_{c}") for c in gates.columns if c not in (by, "candidate")))
    rows = cells.join(g, by)
    parts = []
    for name, (positive, negative) in signatures.items():
        made = F.lit(True)
        for c in positive:
            made = made & (F.col(c) > F.col(f"gate_{c}"))
        for c in negative:
            made = made & ~(F.col(c) > F.col(f"gate_{c}"))
        was = F.col(assigned[name]) == 1
        parts.append((F.sum((made & was).cast("long")).alias(f"i_{name}"), F.sum((made | was).cast("long")).alias(f"u_{name}")))
    sums = rows.groupBy(by, "candidate").agg(*(x for p in parts for x in p))
    distance = sum((F.when(F.col(f"u_{n}") > 0, 1 - F.col(f"i_{n}") / F.col(f"u_{n}")).otherwise(0.0) for n in signatures), F.lit(0.0)) / len(signatures)
    return sums.select(by, "candidate", distance.alias("distance"))


def gate_subsample(cells: DataFrame, most: int = 1000, by: str = "sample", key: str = "structure") -> DataFrame:
    """Of each sample's cells at most `most`, chosen by seeded hash of key: what gate_search() needs look at of large samples."""
    return at_most(cells, most, by=by, key=key)


def gate_cube(cells: DataFrame, assigned: Mapping[str, str], channels: Sequence[str], means: DataFrame, steps: int, by: str = "sample") -> DataFrame:
    """(by, n_<channel>, u_<channel>..., was_<signature>..., n): cells counted by how many of each channel's candidate gates their value exceeds, whether it exceeds the
    channel's mean, and their assigned calls.

    A channel's candidates are 2 * mean * i / (steps - 1), i from 0 to steps - 1; means: (by, m_<channel>...). They are in order, so how many a value exceeds tells which:
    the table holds all that any choice among them makes of the cells. A null value exceeds none.
    """
    rows = cells.join(means, by)
    level = lambda c: sum((F.when(F.col(c) > F.col(f"m_{c}") * 2 * i / (steps - 1), 1).otherwise(0) for i in range(steps)), F.lit(0))
    mean = lambda c: F.coalesce(F.col(c) > F.col(f"m_{c}"), F.lit(False))
    keys = [x for c in channels for x in (level(c).alias(f"n_{c}"), mean(c).alias(f"u_{c}"))]
    keys += [F.coalesce(F.col(a) == 1, F.lit(False)).alias(f"was_{n}") for n, a in assigned.items()]
    return rows.select(by, *keys).groupBy(by, *(f"{k}_{c}" for c in channels for k in "nu"), *(f"was_{n}" for n in assigned)).agg(F.count("*").alias("n"))


def gate_search(cells: DataFrame, assigned: Mapping[str, str], signatures: Mapping[str, tuple[Sequence[str], Sequence[str]]], channels: Sequence[str], steps: int = 16, rounds: int = 2, by: str = "sample") -> DataFrame:
    """(by, channel, final, single, mean): gates that agree best with assigned calls.

    Each channel's own signature first: the best of `steps` gates on [0, 2 mean]; the mean for channels without one. Then rounds of one channel at a time, others held, for
    the least mean distance over all signatures. Of equally good gates the first wins; one that is held is given up for a better one only.

    The cells are read once for means and once for a cube of counts (gate_cube()), whatever steps and rounds are. For a channel's turn the cube is added up over
    all but that channel's levels and what the others, held, make of each signature; every candidate then is a sum over those few rows.
    """
    means = stored(cells.groupBy(by).agg(*(F.avg(c).alias(f"m_{c}") for c in channels)))
    cube = stored(gate_cube(cells, assigned, channels, means, steps, by))

    def above(c: str, gate: Column) -> Column:
        """Whether a value exceeds the gate-th candidate; the mean for -1. Candidates of a negative mean run downwards."""
        over = F.when(F.col(f"m_{c}") < 0, gate >= steps - F.col(f"n_{c}")).otherwise(gate < F.col(f"n_{c}"))
        return F.when(gate < 0, F.col(f"u_{c}")).otherwise(over)

    def best(state: DataFrame, c: str, some: Mapping[str, tuple[Sequence[str], Sequence[str]]], first: int) -> DataFrame:
        """state with g_<c> changed to the best candidate from `first` on; candidate -1 is the gate held now."""
        held = lambda n: reduce(lambda a, b: a & b, [*(above(x, F.col(f"g_{x}")) for x in some[n][0] if x != c), *(~above(x, F.col(f"g_{x}")) for x in some[n][1] if x != c)], F.lit(True))
        rows = cube.join(state, by).select(by, f"n_{c}", f"u_{c}", f"m_{c}", f"g_{c}", *(held(n).alias(f"held_{n}") for n in some), *(f"was_{n}" for n in some), "n")
        rows = rows.groupBy(*(x for x in rows.columns if x != "n")).agg(F.sum("n").alias("n")).withColumn("candidate", F.explode(F.sequence(F.lit(first), F.lit(steps - 1))))
        own = above(c, F.when(F.col("candidate") < 0, F.col(f"g_{c}")).otherwise(F.col("candidate")))
        parts = []
        for n, (positive, negative) in some.items():
            made = F.col(f"held_{n}") & (own if c in positive else F.lit(True)) & (~own if c in negative else F.lit(True))
            parts += [F.sum(F.when(made & F.col(f"was_{n}"), F.col("n")).otherwise(0)).alias(f"i_{n}"), F.sum(F.when(made | F.col(f"was_{n}"), F.col("n")).otherwise(0)).alias(f"u_{n}")]
        sums = rows.groupBy(by, "candidate").agg(*parts)
        distance = sum((F.when(F.col(f"u_{n}") > 0, 1 - F.col(f"i_{n}") / F.col(f"u_{n}")).otherwise(0.0) for n in some), F.lit(0.0)) / len(some)
        chosen = sums.select(by, F.struct(distance.alias("distance"), "candidate").alias("b")).groupBy(by).agg(F.min("b").alias("b")).select(by, F.col("b.candidate").alias("candidate"))
        return stored(state.join(chosen, by).withColumn(f"g_{c}", F.when(F.col("candidate") >= 0, F.col("candidate")).otherwise(F.col(f"g_{c}"))).drop("candidate"))

    now = means.withColumns({f"g_{c}": F.lit(-1) for c in channels})
    for c in channels:
        if own := {n: s for n, s in signatures.items() if list(s[0]) == [c] and not s[1]}:
            now = best(now, c, own, 0)
    now = stored(now.withColumns({f"s_{c}": F.col(f"g_{c}") for c in channels}))
    for _ in range(rounds):
        for c in channels:
            now = best(now, c, signatures, -1)
    gate = lambda c, at: F.when(F.col(at) < 0, F.col(f"m_{c}")).otherwise(F.col(f"m_{c}") * 2 * F.col(at) / (steps - 1))
    rows = F.array(*(F.struct(F.lit(c).alias("channel"), gate(c, f"g_{c}").alias("final"), gate(c, f"s_{c}").alias("single"), F.col(f"m_{c}").alias("mean")) for c in channels))
    return now.select(by, F.explode(rows).alias("r")).select(by, "r.*")


def two_gaussians(values: DataFrame, iterations: int = 20) -> DataFrame:
    """(sample, channel, w0, m0, s0, w1, m1, s1): a mixture of two normals for each (sample, channel), from means -1 and 1 of the values given.

    values: (sample, channel, v), usually standardised. Each iteration is one aggregation of the weighted sums of all groups.
    """
    values = stored(values.select("sample", "channel", "v"))
    state = stored(values.groupBy("sample", "channel").agg(F.count("*").alias("n"), F.greatest(F.stddev_pop("v"), F.lit(1e-3)).alias("s0")).select("sample", "channel", F.lit(0.5).alias("w0"), F.lit(-1.0).alias("m0"), "s0", F.lit(0.5).alias("w1"), F.lit(1.0).alias("m1"), F.col("s0").alias("s1")))
    for _ in range(iterations):
        x = values.join(state, ["sample", "channel"])
        density = lambda i: F.log(F.greatest(F.col(f"w{i}"), F.lit(1e-300))) - F.log(F.col(f"s{i}")) - F.pow((F.col("v") - F.col(f"m{i}")) / F.col(f"s{i}"), 2) / 2  # noqa: B023, E731
        r = 1 / (1 + F.exp(F.least(F.lit(700.0), density(0) - density(1))))
        x = x.select("sample", "channel", "v", r.alias("r"))
        sums = x.groupBy("sample", "channel").agg(F.count("*").alias("n"), F.sum("r").alias("r1"), F.sum(F.col("r") * F.col("v")).alias("x1"), F.sum(F.col("r") * F.col("v") * F.col("v")).alias("q1"), F.sum("v").alias("x"), F.sum(F.col("v") * F.col("v")).alias("q"))
        r0 = F.greatest(F.col("n") - F.col("r1"), F.lit(1e-9))
        r1 = F.greatest("r1", F.lit(1e-9))
        m0, m1 = (F.col("x") - F.col("x1")) / r0, F.col("x1") / r1
        sd = lambda q, m: F.greatest(F.sqrt(F.greatest(q - m * m, F.lit(0.0))), F.lit(1e-3))
        state = stored(sums.select("sample", "channel", (r0 / F.col("n")).alias("w0"), m0.alias("m0"), sd((F.col("q") - F.col("q1")) / r0, m0).alias("s0"), (r1 / F.col("n")).alias("w1"), m1.alias("m1"), sd(F.col("q1") / r1, m1).alias("s1")))
    return state


def bimodality(mixtures: DataFrame) -> DataFrame:
    """mixtures with score (both weights times the mean gap in standard deviations) and gate (means weighted by inverse deviation)."""
    gap = F.abs(F.col("m1") - F.col("m0"))
    score = F.col("w0") * F.col("w1") * (gap / F.col("s0") + gap / F.col("s1")) / 2
    gate = (F.col("m0") / F.col("s0") + F.col("m1") / F.col("s1")) / (1 / F.col("s0") + 1 / F.col("s1"))
    return mixtures.withColumns({"score": score, "gate": gate})


def calls_from_gates(values: DataFrame, gates: DataFrame, least_score: float = 0.5) -> DataFrame:
    """values with positive 0/1: v >= gate where the mixture is bimodal enough, else v >= the mean; NaN and null are 0."""
    mean = values.groupBy("sample", "channel").agg(F.avg("v").alias("mean_"))
    x = values.join(gates.select("sample", "channel", "score", "gate"), ["sample", "channel"], "left").join(mean, ["sample", "channel"])
    at = F.when(F.col("score") >= least_score, F.col("gate")).otherwise(F.col("mean_"))
    hit = F.coalesce((F.col("v") >= at) & ~F.isnan(F.col("v").cast("double")), F.lit(False))
    return x.withColumn("positive", hit.cast("int")).drop("score", "gate", "mean_")


