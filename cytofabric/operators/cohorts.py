"""Strata of samples: their place among interventions and diagnoses, cohort numbers, labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def date_keys(date: Column) -> Column:
    """struct(iso, number, timepoint): the date's key under each scheme, null where it does not fit.

    iso: two or more parts between hyphens, each a number but for leading zeros; number: any number; timepoint: the words
    'timepoint N' at the end, ordered as text.
    """
    parts = F.split(date, "-")
    bare = F.transform(parts, lambda p: F.regexp_replace(p, "^0+", ""))
    iso = F.when((F.size(parts) >= 2) & F.forall(bare, lambda p: p.rlike("^[0-9]{1,18}$")), F.transform(bare, lambda p: p.try_cast("long")))
    number = F.when(date.rlike(r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"), F.trim(date).try_cast("double"))
    point = F.regexp_extract(date, r"(timepoint [0-9]+)$", 1)
    return F.struct(iso.alias("iso"), number.alias("number"), F.when(point != "", point).alias("timepoint"))


def _scheme(keys: Column) -> Column:
    """The first scheme that all dates fit: 1, 2, 3, else 0."""
    every = lambda f: F.forall(keys, f)
    return F.when(every(lambda k: k.iso.isNotNull()), 1).when(every(lambda k: k.number.isNotNull()), 2).when(every(lambda k: k.timepoint.isNotNull()), 3).otherwise(0)


def _key(scheme: Column, k: Column) -> Column:
    """A comparable key: only the scheme's own part."""
    return F.struct(F.when(scheme == 1, k.iso).alias("iso"), F.when(scheme == 2, k.number).alias("number"), F.when(scheme == 3, k.timepoint).alias("timepoint"))


def clinical_position(samples: DataFrame, interventions: DataFrame, diagnoses: DataFrame) -> DataFrame:
    """(specimen, position, condition, result) of each sample (specimen, subject, extraction).

    position: Before intervention, Between interventions, After interventions; empty without interventions or a common date scheme.
    An intervention on the day of extraction counts as earlier. condition, result: of the first diagnosis at or after extraction, else
    empty; of equal dates the one that sorts first. interventions: (subject, event_date); diagnoses: (subject, condition, result, event_date).

    Events are reduced where they lie to one for each subject and date, so a subject's list is as long as its dates are many; samples meet their subject's list.
    """
    when = interventions.select("subject", "event_date").distinct().groupBy("subject").agg(F.collect_list(date_keys(F.col("event_date"))).alias("i"))
    told = diagnoses.groupBy("subject", "event_date").agg(F.min(F.struct("condition", "result")).alias("f"))
    told = told.groupBy("subject").agg(F.collect_list(F.struct("f.condition", "f.result", date_keys(F.col("event_date")).alias("k"))).alias("d"))
    x = samples.select("specimen", "subject", date_keys(F.col("extraction")).alias("own")).join(when, "subject", "left").join(told, "subject", "left")
    x = x.withColumns({"si": _scheme(F.concat(F.coalesce("i", F.array()), F.array("own"))), "sd": _scheme(F.concat(F.coalesce(F.transform("d", lambda d: d.k), F.array()), F.array("own")))})
    before = F.exists("i", lambda k: _key(F.col("si"), k) <= _key(F.col("si"), F.col("own")))
    after = F.exists("i", lambda k: _key(F.col("si"), k) > _key(F.col("si"), F.col("own")))
    position = F.when(F.col("i").isNull() | (F.col("si") == 0), "").when(before & after, "Between interventions").when(~before, "Before intervention").otherwise("After interventions")
    later = F.filter("d", lambda d: (F.col("sd") > 0) & (_key(F.col("sd"), d.k) >= _key(F.col("sd"), F.col("own"))))
    first = F.get(F.array_sort(F.transform(later, lambda d: F.struct(_key(F.col("sd"), d.k).alias("k"), d.condition.alias("condition"), d.result.alias("result")))), F.lit(0))
    return x.select("specimen", position.alias("position"), F.coalesce(first["condition"], F.lit("")).alias("condition"), F.coalesce(first["result"], F.lit("")).alias("result"))


def stratum_numbers(positions: DataFrame, start: int = 0) -> DataFrame:
    """positions with stratum: distinct (position, condition, result) numbered from start + 1 by the first specimen that has them, blank ones last.

    Few rows: one for each combination that occurs.
    """
    keys = ["position", "condition", "result"]
    seen = positions.groupBy(*keys).agg(F.min("specimen").alias("first_"))
    blank = (F.col("position") == "") & (F.col("condition") == "") & (F.col("result") == "")
    numbered = seen.withColumn("stratum", F.row_number().over(Window.orderBy(blank, "first_")) + start)
    return positions.join(numbered.drop("first_"), keys)


def rebased(cohorts: DataFrame, study: str = "study", cohort: str = "cohort") -> DataFrame:
    """Cohort numbers that begin at 1 in each study."""
    low = cohorts.groupBy(study).agg(F.min(cohort).alias("low_"))
    return cohorts.join(low, study).withColumn(cohort, (F.col(cohort) - F.col("low_") + 1).cast("long")).drop("low_")


def selection_criteria(strata: DataFrame, known: DataFrame) -> DataFrame:
    """(stratum, criterion) of distinct strata not yet known: condition_position."""
    one = strata.select("stratum", "condition", "position").dropDuplicates(["stratum"])
    return one.select("stratum", F.concat_ws("_", "condition", "position").alias("criterion")).join(known.select("stratum"), "stratum", "left_anti")


def labelled_strata(strata: DataFrame, chosen: Sequence[int], columns: Sequence[str], differing: bool = True) -> DataFrame:
    """(specimen, label): of the chosen strata (two or more), the values of the columns, as '(a, b)'; blank: null. differing: of the columns that differ among them only."""
    if len(set(chosen)) < 2:
        raise ValueError("at least two strata are compared")
    rows = strata.where(F.col("stratum").isin(*chosen))
    used = list(columns)
    if differing:
        n = rows.agg(*(F.count_distinct(c).alias(c) for c in columns)).first()
        used = [c for c in columns if n[c] > 1]
    text = F.concat_ws(", ", *(F.when(F.col(c) != "", F.col(c)) for c in used)) if used else F.lit("")
    return rows.select("specimen", F.when(text != "", F.concat(F.lit("("), text, F.lit(")"))).alias("label"))
