"""The feature store: specifications, values, what is missing, completeness; tests between cohorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import feature_hash, json_number
from ..functions.statistics import fisher, t_tail
from .neighbors import stored


def specifications(requests: DataFrame) -> DataFrame:
    """(feature, method, specifiers): requests (method, specifiers array) with their identity, each once."""
    return requests.select(feature_hash(F.col("method"), F.array_join("specifiers", "\u001e")).alias("feature"), "method", "specifiers").dropDuplicates(["feature"])


def new_specifications(requests: DataFrame, known: DataFrame) -> DataFrame:
    """Those that the store does not have: what is appended."""
    return specifications(requests).join(known.select("feature"), "feature", "left_anti")


def matching_features(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(request, feature) whose ordered specifiers agree in full: rows (feature, ordinality, specifier); wanted (request, specifiers)."""
    have = rows.groupBy("feature").agg(F.array_sort(F.collect_list(F.struct("ordinality", "specifier"))).alias("l"))
    have = have.select("feature", F.transform("l", lambda s: s.specifier).alias("specifiers"))
    return have.join(wanted, "specifiers").select("request", "feature")


def missing(expected: DataFrame, values: DataFrame) -> DataFrame:
    """(feature, subject) pairs expected of a feature that have no value yet."""
    return expected.join(values.select("feature", "subject"), ["feature", "subject"], "left_anti")


def progress(expected: DataFrame, values: DataFrame) -> DataFrame:
    """(feature, expected, computed, pending) of each feature that expected (feature, subject) names: pending until it has just as many values."""
    wanted = expected.groupBy("feature").agg(F.count("*").alias("expected"))
    there = values.groupBy("feature").agg(F.count("*").alias("computed"))
    n = wanted.join(there, "feature", "left").withColumn("computed", F.coalesce("computed", F.lit(0)))
    return n.withColumn("pending", F.col("computed") != F.col("expected"))


def zero_filled(values: DataFrame, subjects: DataFrame) -> DataFrame:
    """values (feature, subject, value) with 0 for each feature's missing subjects."""
    every = values.select("feature").distinct().crossJoin(subjects.select("subject").distinct())  # the result: a row for each feature and sample
    return values.unionByName(missing(every, values).withColumn("value", F.lit(0.0)))


def values_of(values: DataFrame, feature: str) -> DataFrame:
    return values.where(F.col("feature") == feature).select("subject", json_number(F.col("value")).alias("value")).orderBy("subject")


def staged(values: DataFrame, n_specifiers: int) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused) of values (specifiers, subject, value): accepted have n_specifiers specifiers, as their method says, none of them null."""
    good = F.coalesce((F.size("specifiers") == n_specifiers) & ~F.exists("specifiers", lambda s: s.isNull()), F.lit(False))
    return values.where(good), values.where(~good)


def without_features(values: DataFrame, features: DataFrame) -> DataFrame:
    return values.join(features.select("feature"), "feature", "left_anti")


def completeness(values: DataFrame, expected: DataFrame, nulls: int = 5, null_share: float = 0.2, missing_share: float = 0.1) -> DataFrame:
    """(feature, n_null, n_value, expected, suspicious): any of too many nulls, too large a share of nulls, or of missing values."""
    have = values.groupBy("feature").agg(F.sum(F.col("value").isNull().cast("long")).alias("n_null"), F.count("value").alias("n_value"))
    x = have.join(expected.groupBy("feature").agg(F.count("*").alias("expected")), "feature")
    both = F.col("n_null") + F.col("n_value")
    bad = (F.col("n_null") >= nulls) | (F.col("n_null") / both >= null_share) | ((F.col("expected") - both) / F.col("expected") >= missing_share)
    return x.withColumn("suspicious", bad)


def _set_digests(rows: DataFrame, name: str) -> DataFrame:
    """(name, size, total, mixed) of each set's distinct cells, summed where they arise: equal for equal sets, and by chance for others with a probability of about 2^-128."""
    a, b = F.xxhash64("structure"), F.xxhash64(F.lit(1), "structure")
    return rows.select(name, "structure").distinct().groupBy(name).agg(F.count("*").alias("size"), F.sum(a.cast("decimal(20,0)")).alias("total"), F.bit_xor(b).alias("mixed"))


def equal_cell_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """(set_a, set_b) that hold the same cells: a (set_a, structure), b (set_b, structure). Sets are compared by digests, never held whole."""
    return _set_digests(a, "set_a").join(_set_digests(b, "set_b"), ["size", "total", "mixed"]).select("set_a", "set_b")


def cell_set_classes(sets: DataFrame) -> DataFrame:
    """(set_id, class_id, class_size) of every set: class_id is the smallest set_id that holds the same cells. sets: (set_id, structure)."""
    held = _set_digests(sets, "set_id")
    classes = held.groupBy("size", "total", "mixed").agg(F.min("set_id").alias("class_id"), F.count("*").alias("class_size"))
    return held.join(classes, ["size", "total", "mixed"]).select("set_id", "class_id", "class_size")


def latest_run(features: DataFrame, method: str | None = None, **where: object) -> DataFrame:
    """The row of (plugin, run, ...) with the greatest run, of a plugin if named, and of those columns' values (version, stratifier) if given."""
    rows = features if method is None else features.where(F.col("plugin") == method)
    for column, value in where.items():
        rows = rows.where(F.col(column).eqNullSafe(F.lit(value)))
    return rows.orderBy(F.desc("run")).limit(1)


def importance_features(scores: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(specifications, values) of importance scores (plugin, run, version, stratifier, specimen, structure, importance).

    Each (plugin, run, version, stratifier) is a feature, with these four as its specifiers in order; its values are the ranks, from 1, of the `most`
    important cells of each specimen: (feature, subject, value). Ties go to the smaller id. Scores that a cell has from overlapping regions count once, the largest.
    Features get their long names when ranks are known, so rows that are grouped and sorted are short.
    """
    method = F.lit("gnn importance score")
    keys = ["plugin", "run", "version", "stratifier"]
    named = scores.withColumn("specifiers", F.array(*(F.col(c).cast("string") for c in keys)))
    known = specifications(named.select(method.alias("method"), "specifiers"))
    best = named.groupBy(F.array_join("specifiers", "\u001e").alias("joined"), "specimen", "structure").agg(F.max("importance").alias("importance"))
    w = Window.partitionBy("joined", "specimen").orderBy(F.desc("importance"), "structure")
    ranked = best.withColumn("value", F.row_number().over(w)).where(F.col("value") <= most)
    return known, ranked.select(feature_hash(method, F.col("joined")).alias("feature"), F.col("structure").alias("subject"), "value")


def outdated(measured: DataFrame, derived: DataFrame) -> DataFrame:
    """(derivative, specimen) measured but absent from a derivative: derived (derivative, specimen)."""
    every = derived.select("derivative").distinct().crossJoin(measured.select("specimen").distinct())
    return every.join(derived, ["derivative", "specimen"], "left_anti")


def _moments(values: DataFrame) -> DataFrame:
    return values.where("value is not null and not isnan(value)").groupBy("feature", "cohort").agg(F.count("*").cast("double").alias("n"), F.avg("value").alias("m"), F.var_samp("value").alias("v"))


def cohort_tests(values: DataFrame, equal_variances: bool = True) -> DataFrame:
    """(feature, cohort_1, cohort_2, t, df, p): t-test of every feature between every two cohorts, numbers ordered as text.

    values: (feature, cohort, value). Cohorts with fewer than two values, and undefined p, have no row. Moments are aggregated in
    one pass; p-values are computed from those few rows. equal_variances False: Welch's test.
    """
    m = _moments(values).where("n >= 2")
    one, two = (m.select("feature", *(F.col(c).alias(f"{c}_{i}") for c in ("cohort", "n", "m", "v"))) for i in (1, 2))
    pairs = one.join(two, "feature").where(F.col("cohort_1").cast("string") < F.col("cohort_2").cast("string"))
    n1, n2, v1, v2 = (F.col(c) for c in ("n_1", "n_2", "v_1", "v_2"))
    if equal_variances:
        df = n1 + n2 - 2
        error = F.sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / df * (1 / n1 + 1 / n2))
    else:
        a, b = v1 / n1, v2 / n2
        df = F.when(a + b > 0, (a + b) * (a + b) / (a * a / (n1 - 1) + b * b / (n2 - 1)))
        error = F.sqrt(a + b)
    pairs = pairs.withColumns({"df": df, "t": F.when(error > 0, (F.col("m_1") - F.col("m_2")) / error)})
    return pairs.select("feature", "cohort_1", "cohort_2", "t", "df", t_tail("t", "df").alias("p")).where("p is not null")


def fold_change(values: DataFrame) -> DataFrame:
    """(feature, cohort_1, cohort_2, fold, log_fold): ratio of means, and of mean logs of the positive values."""
    ok = values.where("value is not null and not isnan(value) and abs(value) < double('inf')")
    m = ok.groupBy("feature", "cohort").agg(F.avg("value").alias("m"), F.avg(F.when(F.col("value") > 0, F.log("value"))).alias("l"))
    one, two = (m.select("feature", *(F.col(c).alias(f"{c}_{i}") for c in ("cohort", "m", "l"))) for i in (1, 2))
    pairs = one.join(two, "feature").where(F.col("cohort_1").cast("string") < F.col("cohort_2").cast("string"))
    ratio = lambda a, b: F.when(F.col(b) != 0, F.col(a) / F.col(b))
    return pairs.select("feature", "cohort_1", "cohort_2", ratio("m_2", "m_1").alias("fold"), ratio("l_2", "l_1").alias("log_fold"))


def untested(values: DataFrame, tested: DataFrame) -> DataFrame:
    return values.join(tested.select("feature").distinct(), "feature", "left_anti")


def auc(values: DataFrame) -> DataFrame:
    """(feature, auc): area under the ROC curve of value for label 1 against 0, folded to 0.5 or more; ties by (value, label).

    Ranks are by feature, over aggregated feature values (one for each sample).
    """
    w = Window.partitionBy("feature").orderBy("value", "label").rowsBetween(Window.unboundedPreceding, 0)
    x = values.withColumn("negatives", F.sum(F.when(F.col("label") == 0, 1).otherwise(0)).over(w))
    s = x.groupBy("feature").agg(F.sum(F.when(F.col("label") == 1, F.col("negatives")).otherwise(0)).alias("wins"), F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
    area = F.col("wins") / (F.col("pos") * F.col("neg"))
    return s.where("pos > 0 and neg > 0").select("feature", F.greatest(area, 1 - area).alias("auc"))


def roc_points(values: DataFrame) -> DataFrame:
    """(feature, place, positives, negatives): the ROC curve of value for label 1 against 0, a point for each row in order of (value, label), place from 1, after (0, 1) at place 0.

    positives: the share of label 1 up to there; negatives: the share of label 0 after it. Features without both labels give no points; null values and labels are left out.

    Rows are sorted in ranges, so a feature of any size spreads over tasks: sums within a range follow its rows, and the sums of the ranges before, one small row
    for each feature and range, are added.
    """
    keys = ["feature", "value", "label"]
    rows = values.where("value is not null and label in (0, 1)").select("feature", "value", F.col("label").cast("long").alias("label"))
    rows = stored(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()))
    rows = rows.withColumn("range", F.shiftright("at", 33))
    inner = Window.partitionBy("feature", "range").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    parts = rows.groupBy("feature", "range").agg(F.count("*").alias("n"), F.sum("label").alias("ones"))
    before, whole = Window.partitionBy("feature").orderBy("range").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("feature")
    parts = parts.select("feature", "range", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("n", "ones")), F.sum("ones").over(whole).alias("pos"), (F.sum("n").over(whole) - F.sum("ones").over(whole)).alias("neg"))
    parts = stored(parts.where("pos > 0 and neg > 0"))
    sums = rows.select("feature", "range", F.row_number().over(Window.partitionBy("feature", "range").orderBy("at")).alias("n"), F.sum("label").over(inner).alias("ones"))
    x = sums.join(parts, ["feature", "range"]).withColumns({"place": F.col("n") + F.col("n_before"), "up": F.col("ones") + F.col("ones_before")})
    points = x.select("feature", "place", (F.col("up") / F.col("pos")).alias("positives"), ((F.col("neg") - F.col("place") + F.col("up")) / F.col("neg")).alias("negatives"))
    return points.union(parts.select("feature").distinct().select("feature", F.lit(0).cast("long"), F.lit(0.0), F.lit(1.0)))


def fractions_by_cohort(values: DataFrame, omit_zeros: bool = False) -> DataFrame:
    """(feature, cohort, n, mean, omitted)."""
    use = (F.col("value") != 0) if omit_zeros else F.lit(True)
    return values.groupBy("feature", "cohort").agg(F.sum(use.cast("long")).alias("n"), F.avg(F.when(use, F.col("value"))).alias("mean"), F.sum((~use).cast("long")).alias("omitted"))


def importance_enrichment(cells: DataFrame, important: Column, phenotype: Column) -> DataFrame:
    """(specimen, a, b, c, d, fraction, p): important cells by phenotype, the share of the important ones, Fisher's two-sided p."""
    n = lambda when: F.sum(F.when(when, 1).otherwise(0)).cast("long")
    x = cells.groupBy("specimen").agg(n(important & phenotype).alias("a"), n(important & ~phenotype).alias("b"), n(~important & phenotype).alias("c"), n(~important & ~phenotype).alias("d"))
    fraction = F.when(F.col("a") + F.col("b") > 0, F.col("a") / (F.col("a") + F.col("b")))
    return x.withColumns({"fraction": fraction, "p": fisher("a", "b", "c", "d")})
