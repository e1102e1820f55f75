"""Joins and lookups on study metadata: the cell-to-specimen chain, siblings, groups, artifacts, work to be done."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import code
from .features import cohort_tests, missing
from .populations import Signature, matches

#: The feature methods that a store may hold.
METHODS = (
    "population fractions", "proximity", "neighborhood enrichment", "co-occurrence", "spatial autocorrelation", "ripley", "gnn importance score",
)
#: Other names of graph plugins.
PLUGINS = {"cggnn": "cg-gnn", "cg_gnn": "cg-gnn", "graph-transformer": "graph-transformer", "gt": "graph-transformer"}


def cell_chain(structures: DataFrame, files: DataFrame, processes: DataFrame) -> DataFrame:
    """(structure, specimen): cell to data file to measurement process to specimen; written once as the cells' table."""
    return structures.join(files, "data_file").join(processes, "process").select("structure", "specimen")


def relevant_specimens(components: DataFrame, study: str, processes: DataFrame) -> DataFrame:
    """Distinct specimens measured in any study that shares a primary study with this one: components (primary_study, component_study)."""
    own = components.where(F.col("component_study") == study).select("primary_study")
    siblings = components.join(own, "primary_study", "left_semi").select(F.col("component_study").alias("study"))
    return processes.join(siblings, "study", "left_semi").select("specimen").distinct()


def onto_segments(segments: DataFrame, channel: DataFrame, name: str) -> DataFrame:
    """Pixels of the segment mask (sample, row, col, segment) with a channel's value where it has one."""
    return segments.join(channel.select("sample", "row", "col", F.col("value").alias(name)), ["sample", "row", "col"], "left")


def grouped_channels(members: DataFrame, groups: DataFrame) -> DataFrame:
    return members.join(groups, "group").select("group", "color", "channel")


def supplemented(channels: DataFrame, supplement: DataFrame, key: str) -> DataFrame:
    return channels.join(supplement, key, "left")


def importance_counts(cells: DataFrame, cohorts: DataFrame, first: Signature, second: Signature) -> DataFrame:
    """(specimen, cohort, all_cells, both, one, two): side by side in one pass over the cells, then the cohort."""
    m = F.col("mask")
    n = lambda when: F.sum(F.when(when, 1).otherwise(0)).cast("long")
    x = cells.groupBy("specimen").agg(F.count("*").alias("all_cells"), n(matches(m, *first) & matches(m, *second)).alias("both"), n(matches(m, *first)).alias("one"), n(matches(m, *second)).alias("two"))
    return x.join(cohorts, "specimen", "left")


def mean_intensities(cells: DataFrame, channels: Sequence[str], by: str = "sample") -> DataFrame:
    return cells.groupBy(by).agg(*(F.avg(c).alias(c) for c in channels))


def with_cohort(samples: DataFrame, measured: DataFrame, cohorts: DataFrame) -> DataFrame:
    """Samples that have a data file and a cohort."""
    return samples.join(measured.select("specimen"), "specimen", "left_semi").join(cohorts.select("specimen"), "specimen", "left_semi")


def complete_samples(values: DataFrame) -> DataFrame:
    """Samples none of whose values is null."""
    return values.select("specimen").distinct().join(values.where("value is null").select("specimen"), "specimen", "left_anti")


def json_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """(study, id, text): a JSON object {study: [text, ...]}, in order; replaces what a study had."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    each = rows.select(F.explode("m").alias("study", "texts"))
    return each.select("study", F.posexplode("texts").alias("id", "text")).orderBy("study", "id")


def json_annotations(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """groups (group, color, channel) and aliases (alias, channel) of {groups: {name: {channels, color}}, aliases: {name: channel}}."""
    schema = "groups map<string,struct<channels:array<string>,color:string>>, aliases map<string,string>"
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("j"))
    groups = rows.select(F.explode("j.groups").alias("group", "g")).select("group", "g.color", F.explode("g.channels").alias("channel"))
    return {"groups": groups, "aliases": rows.select(F.explode("j.aliases").alias("alias", "channel"))}


def replaced(artifacts: DataFrame, new: DataFrame) -> DataFrame:
    """artifacts with those of each study in new replaced by the new ones; other studies keep theirs. Both: (study, id, text)."""
    return artifacts.join(new.select("study").distinct(), "study", "left_anti").select("study", "id", "text").union(new.select("study", "id", "text"))


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, n)."""
    return reduce(DataFrame.union, [t.agg(F.lit(name).alias("table_name"), F.count("*").alias("n")) for name, t in tables.items()])


def count_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(table_name, n_before, n_after, change) of tables whose count an import has changed; a table that was not there had none."""
    both = after.select("table_name", F.col("n").alias("n_after")).join(before.select("table_name", F.col("n").alias("n_before")), "table_name", "full")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return both.select("table_name", zero("n_before").alias("n_before"), zero("n_after").alias("n_after"), (zero("n_after") - zero("n_before")).alias("change")).where("change <> 0")


def canonical_plugin(name: Column) -> Column:
    return F.coalesce(F.nullif(code(F.lower(name), PLUGINS), F.lit("")), name)


def method_catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(m,) for m in METHODS], "method string")


def available_plugins(features: DataFrame) -> DataFrame:
    """Plugins of importance features: the first specifier."""
    return features.where(F.col("method") == "gnn importance score").select(F.col("specifiers")[0].alias("plugin")).distinct()


def compute_if_missing(expected: DataFrame, values: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """values with what was expected and not there yet, computed for all due samples at once."""
    return values.unionByName(compute(missing(expected, values)).select(*values.columns))


def tests_by_study(values: DataFrame, pattern: str = "fraction") -> DataFrame:
    """Cohort tests within each study whose name matches: values (study, feature, cohort, value)."""
    rows = values.where(F.col("study").rlike(pattern)).withColumn("feature", F.struct("study", "feature"))
    return cohort_tests(rows).select("feature.study", F.col("feature.feature").alias("feature"), "cohort_1", "cohort_2", "t", "df", "p")


def baseline_means(values: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """(feature, mean, present): mean over samples, and how many have any."""
    rows = values.where(F.col("feature").isin(*names))
    return rows.groupBy("feature").agg(F.avg("value").alias("mean"), F.sum((F.col("value") > 0).cast("long")).alias("present"))
