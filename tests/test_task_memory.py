"""Queries whose tasks held more of a large table than they need."""

import duckdb
import pytest
from pyspark.sql import functions as F

from cytofabric.operators import populations
from cytofabric.plans import registry

SF = "/root/testdata/sf0.01"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["l10_importance_features", "c06_extract_mismatch"])
def test_results_are_those_of_sql(spark, name):
    db = duckdb.connect()
    db.execute(f"create view lineitem as select * from '{SF}/lineitem.parquet'")
    got = registry.queries()[name](spark, SF)
    assert sorted(map(tuple, got.collect())) == sorted(db.execute(registry.oracle_sql()[name]).fetchall())


def test_long_names_of_features_are_not_grouped_or_sorted(spark):
    rows = plan(registry.queries()["l10_importance_features"](spark, SF)).splitlines()
    assert [i for i, r in enumerate(rows) if "sha2(" in r][-1] < next(i for i, r in enumerate(rows) if "Window" in r)  # from the last step to the first


def test_mismatched_keys_are_grouped_once(spark):
    assert "Join" not in plan(registry.queries()["c06_extract_mismatch"](spark, SF))
    left, right = (spark.createDataFrame(rows, "a long, b string") for rows in ([(1, "x"), (1, "x"), (2, None), (3, "z")], [(1, "x"), (2, None), (4, "z")]))
    got = populations.mismatched(left, right, ["a", "b"]).orderBy("a", F.col("in_left").isNull())
    assert got.columns == ["a", "b", "in_left", "in_right"]
    assert list(map(tuple, got.collect())) == [(2, None, 1, None), (2, None, None, 1), (3, "z", 1, None), (4, "z", None, 1)]
