"""URL filter: rules first, else an empirical-Bayes reputation of the host."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

#: (rule, verdict): host and path in one string, as the contract of the query names them.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: Public suffixes of two labels: a category under a country's code; others have one label. A pattern for the last two labels.
TWO_LABEL_SUFFIX = r"^(ac|co|com|edu|go|gob|gov|gouv|id|ltd|me|mil|ne|net|nhs|nom|or|org|plc|sch)\.[a-z]{2}$"
#: A page is blocked if the bad share of its host is above LIMIT even at the lower bound, Z standard deviations down.
LIMIT, Z = 0.5, 1.0


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and for urls without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(host, upper, upper.lower()), F.lit("")), F.coalesce(path, F.lit(""))


def listed(spark: SparkSession, rows: DataFrame | Sequence[Sequence[str]], columns: Sequence[str]) -> DataFrame:
    """A list of text rows as a table; a table as it is, its columns in this order."""
    if isinstance(rows, DataFrame):
        return rows.select(*columns)
    text = json.dumps([dict(zip(columns, row, strict=True)) for row in rows])
    kind = f"array<struct<{','.join(f'{c}:string' for c in columns)}>>"
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), kind)))


def _ends(host: Column, most: int | Column) -> Column:
    """The host's last label, last two, ... up to `most` labels, joined again."""
    parts = F.split(host, "[.]")
    n = F.size(parts)
    return F.transform(F.sequence(F.lit(1), F.least(n, F.greatest(F.lit(most), F.lit(1)))), lambda k: F.array_join(F.slice(parts, n - k + 1, k), "."))


def _most_labels(names: DataFrame, name: str) -> int:
    return names.agg(F.max(F.size(F.split(name, "[.]")))).first()[0] or 0


def rules_of(hosts: DataFrame, rules: DataFrame | Sequence[tuple[str, str]]) -> DataFrame:
    """(host, rules_) of those distinct hosts that a rule's host fits, itself or a parent: array of (length, rule, verdict, at), at the path's start.

    rules: (rule, verdict), as a list or a table, any number. Hosts meet them by equi-joins on their last labels, as many as the longest rule has; a rule
    without a slash or verdict is none. What is kept for a host is the rules that fit it.
    """
    table_of = listed(hosts.sparkSession, rules, ("rule", "verdict")).where("instr(rule, '/') > 0 and verdict is not null").dropDuplicates()
    names = cut(table_of.select(F.substring_index("rule", "/", 1).alias("end_"), F.struct(F.length("rule").alias("length"), "rule", "verdict", F.expr("substr(rule, instr(rule, '/'))").alias("at")).alias("r")))
    ends = hosts.select("host", F.explode(_ends(F.col("host"), _most_labels(names, "end_"))).alias("end_"))
    return ends.join(names, "end_").groupBy("host").agg(F.collect_list("r").alias("rules_"))


def longest_rule(path: Column, rules: Column) -> Column:
    """Of a host's rules the longest whose path the url's path starts with (of equal length the later text, then verdict), else null."""
    return F.array_max(F.filter(rules, lambda r: F.startswith(path, r["at"])))


def domain_and_suffix(host: Column, two_labels: str = TWO_LABEL_SUFFIX, listed_labels: Column | None = None) -> tuple[Column, Column]:
    """The registered domain and the public suffix of a host, without user and port; a host of one label or of numbers is both itself.

    listed_labels: labels of the suffix that a list gives the host (see suffix_labels()), which counts before the pattern; null: none.
    """
    host = bare(host)
    labels = F.when(F.substring_index(host, ".", -2).rlike(two_labels), 2).otherwise(1)
    labels = labels if listed_labels is None else F.coalesce(listed_labels, labels)
    parts = F.split(host, "[.]")
    last = lambda n: F.array_join(F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), n), ".")
    whole = host.rlike(r"^[0-9.]+$|^\[.*\]$") | (F.instr(host, ".") == 0)
    return F.when(whole, host).otherwise(last(labels + 1)), F.when(whole, host).otherwise(last(labels))


def bare(host: Column) -> Column:
    """A host without user and port."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")


def suffix_labels(hosts: DataFrame, suffixes: DataFrame | Sequence[str]) -> DataFrame:
    """(host, labels_): labels of the longest public suffix that each host ends in, for distinct hosts that end in one.

    suffixes: a list, or a table (suffix), any number of any number of labels, as a public suffix list has them.
    """
    rows = suffixes if isinstance(suffixes, DataFrame) else [(x,) for x in suffixes]
    names = cut(listed(hosts.sparkSession, rows, ("suffix",)).where("suffix is not null").select(F.col("suffix").alias("end_")).distinct())
    ends = hosts.select("host", F.explode(_ends(bare(F.col("host")), _most_labels(names, "end_"))).alias("end_"))
    return ends.join(names, "end_").groupBy("host").agg(F.max(F.size(F.split("end_", "[.]"))).alias("labels_"))


def _strength(rows: DataFrame, n: str, bad: str, mean: str) -> Column:
    """Pseudo-count of a beta prior by moments: how much groups scatter round their parents' mean beyond chance.

    One number for a level: sum((bad - n m)^2 - n m (1-m)) estimates sum(n (n-1) m (1-m)) / (strength + 1).
    """
    var = F.col(mean) * (1 - F.col(mean))
    over = F.sum(F.pow(F.col(bad) - F.col(n) * F.col(mean), 2) - F.col(n) * var)
    chance = F.sum(F.col(n) * (F.col(n) - 1) * var)
    ratio = F.when((over > 0) & (chance > 0), chance / over - 1).otherwise(F.lit(1000.0))
    return F.coalesce(F.greatest(F.lit(1.0), F.least(F.lit(1000.0), ratio)), F.lit(1000.0)).alias("strength")


def host_reputation(hosts: DataFrame, suffixes: DataFrame | Sequence[str] | None = None) -> DataFrame:
    """hosts: one row (host, n, bad) for each host, n labelled pages of which bad are bad; n may be 0. suffixes: public suffixes
    beyond the pattern for two labels, as suffix_labels() takes them.

    Returns (host, mean, sd) of the posterior beta distribution. The bad share of all pages is the prior mean of each
    suffix, a suffix's posterior mean that of its domains, a domain's that of its hosts; each level's weight is
    fitted by moments. Sums run over host rows, never pages, and are pre-aggregated; one row holds all weights.
    """
    if suffixes is not None:
        hosts = hosts.join(suffix_labels(hosts, suffixes), "host", "left")
    domain, suffix = domain_and_suffix(F.col("host"), listed_labels=None if suffixes is None else F.col("labels_"))
    hosts = hosts.withColumns({"domain": domain, "suffix": suffix})
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n_d"), F.sum("bad").alias("bad_d"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n_d").alias("n_s"), F.sum("bad_d").alias("bad_s"))
    overall = suffixes.agg(((F.sum("bad_s") + 0.5) / (F.sum("n_s") + 1.0)).alias("m_0"))

    def weigh(rows, n, bad, mean):
        one = rows.agg(_strength(rows, n, bad, mean))
        return rows.crossJoin(F.broadcast(one))  # one row

    level = cut(weigh(suffixes.crossJoin(F.broadcast(overall)), "n_s", "bad_s", "m_0").select("suffix", ((F.col("bad_s") + F.col("strength") * F.col("m_0")) / (F.col("n_s") + F.col("strength"))).alias("m_s")))
    level = cut(weigh(domains.join(level, "suffix"), "n_d", "bad_d", "m_s").select("domain", ((F.col("bad_d") + F.col("strength") * F.col("m_s")) / (F.col("n_d") + F.col("strength"))).alias("m_d")))
    both = weigh(cut(hosts.join(level, "domain").select("host", "n", "bad", "m_d")), "n", "bad", "m_d")
    a, b = F.col("bad") + F.col("strength") * F.col("m_d"), F.col("n") - F.col("bad") + F.col("strength") * (1 - F.col("m_d"))
    return both.select("host", (a / (a + b)).alias("mean"), F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))).alias("sd"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: DataFrame | Sequence[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", limit: float = LIMIT, z: float = Z, suffixes: DataFrame | Sequence[str] | None = None) -> DataFrame:
    """One row per row of pages: id_col, host, path, rule, verdict, bad_share (the host's posterior mean).

    outcomes: (host, bad), a row for each labelled page, bad 0 or 1. Null urls and urls without :// have empty host and
    path; the empty host has a reputation like any other. Repeated rows each count. Without labelled pages no host is blocked by its
    reputation. rules: (rule, verdict), a list or a table of any size. The verdict is the rule's, else block where mean - z sd > limit: the posterior's lower bound in normal approximation.
    """
    host, path = host_and_path(F.col(url_col))
    seen = pages.select(F.col(id_col).alias("id_"), host.alias("host"), path.alias("path"))
    labelled = outcomes.where("host is not null and bad is not null").groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("double")).alias("bad"))
    counts = seen.groupBy("host").agg(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("bad"))
    counts = cut(counts.union(labelled).groupBy("host").agg(F.sum("n").cast("double").alias("n"), F.sum("bad").alias("bad")))
    known = cut(host_reputation(counts, suffixes).join(rules_of(counts.select("host"), rules), "host", "left"))
    rule = longest_rule(F.col("path"), F.col("rules_"))
    verdict = F.when(F.col("mean") - z * F.col("sd") > limit, F.lit("block")).otherwise(F.lit("allow"))
    return seen.join(known, "host", "left").select(
        F.col("id_").alias(id_col), "host", "path", rule["rule"].alias("rule"), F.coalesce(rule["verdict"], verdict).alias("verdict"), F.round("mean", 6).alias("bad_share")
    )


def outcomes_of(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, bad): a page shows the document whose id is the number in its path; bad: that document's quality is 0."""
    host, path = host_and_path(F.col("url"))
    shown = pages.select(host.alias("host"), F.regexp_extract(path, r"/([0-9]{1,18})(?:[/.]|$)", 1).try_cast("long").alias("shown")).where("shown is not null")
    marks = labels.where("quality is not null").select(F.col("doc_id").alias("shown"), (F.col("quality") == 0).cast("int").alias("bad"))
    return shown.join(marks, "shown").select("host", "bad")


def op5_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, outcomes_of(pages, table(spark, sf_dir, "labels")))


def _level(name: str, rows: str, n: str, bad: str, mean: str, keys: str) -> str:
    """SQL: the strength of a level's prior, and its groups' posterior means under it."""
    var = f"{mean} * (1 - {mean})"
    return f"""
{name}_w AS (SELECT CASE WHEN over_ > 0 AND chance > 0 THEN greatest(1.0, least(1000.0, chance / over_ - 1)) ELSE 1000.0 END AS strength
  FROM (SELECT sum(pow({bad} - {n} * {mean}, 2) - {n} * {var}) AS over_, sum({n} * ({n} - 1) * {var}) AS chance FROM {rows})),
{name} AS (SELECT {keys}, ({bad} + strength * {mean}) / ({n} + strength) AS m_{name}, strength FROM {rows}, {name}_w)"""


_BARE = "regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '')"
_WHOLE = f"(regexp_matches({_BARE}, '^[0-9.]+$|^\\[.*\\]$') OR NOT contains({_BARE}, '.'))"
_TWO = f"array_to_string(split({_BARE}, '.')[-2:], '.')"
_LONG = f"regexp_matches({_TWO}, '{TWO_LABEL_SUFFIX}')"
_RULES = " ".join(
    f"WHEN (host = '{r.split('/')[0]}' OR host LIKE '%.{r.split('/')[0]}') AND starts_with(path, '/{r.split('/', 1)[1]}') THEN '{r}'" for r, _ in sorted(RULES, key=lambda x: -len(x[0]))
)
_BLOCKED = tuple(r for r, v in RULES if v == "block")
ORACLE = f"""
WITH rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path FROM rest),
outcomes AS (SELECT host, CAST(quality = 0 AS DOUBLE) AS bad FROM parts JOIN labels ON doc_id = try_cast(regexp_extract(path, '/([0-9]{{1,18}})(?:[/.]|$)', 1) AS BIGINT) WHERE quality IS NOT NULL),
hosts AS (SELECT host, CAST(coalesce(n, 0) AS DOUBLE) AS n, coalesce(bad, 0.0) AS bad, CASE WHEN {_WHOLE} THEN {_BARE} WHEN {_LONG} THEN array_to_string(split({_BARE}, '.')[-3:], '.') ELSE {_TWO} END AS domain,
  CASE WHEN {_WHOLE} THEN {_BARE} WHEN {_LONG} THEN {_TWO} ELSE split({_BARE}, '.')[-1] END AS suffix
  FROM (SELECT DISTINCT host FROM parts) LEFT JOIN (SELECT host, count(*) AS n, sum(bad) AS bad FROM outcomes GROUP BY host) USING (host)),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY ALL),
s0 AS (SELECT *, (sum(bad) OVER () + 0.5) / (sum(n) OVER () + 1.0) AS m FROM suffixes),
{_level("s", "s0", "n", "bad", "m", "suffix")},
d0 AS (SELECT domains.*, m_s AS m FROM domains JOIN s USING (suffix)),
{_level("d", "d0", "n", "bad", "m", "domain")},
h0 AS (SELECT host, n, bad, m_d AS m FROM hosts JOIN d USING (domain)),
{_level("h", "h0", "n", "bad", "m", "host, n, bad, m")},
ab AS (SELECT host, bad + strength * m AS a, n - bad + strength * (1 - m) AS b FROM h),
known AS (SELECT host, a / (a + b) AS mean, sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS sd FROM ab),
ruled AS (SELECT *, CASE {_RULES} END AS rule FROM parts JOIN known USING (host))
SELECT page_id, host, path, rule, CASE WHEN rule IN {_BLOCKED} THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN mean - {Z} * sd > {LIMIT} THEN 'block' ELSE 'allow' END AS verdict, round(mean, 6) AS bad_share FROM ruled
"""
