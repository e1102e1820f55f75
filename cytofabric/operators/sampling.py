"""Samples of cells that do not depend on row order, and a linear layout of them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draws_with_replacement(cells: DataFrame, draws: int, seed: int = 0, key: str = "structure") -> DataFrame:
    """The distinct cells among `draws` draws with replacement.

    A cell is drawn at least once with probability 1 - (1 - 1/n)^draws; its seeded hash decides, so no numbering is needed.
    """
    n = cells.count()
    if not n:
        return cells
    share = 1 - (1 - 1 / n) ** draws if n > 1 else 1.0
    return cells.where(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 32)) < int(share * (1 << 32)))


def allocation(sizes: DataFrame, most: int, by: str = "specimen") -> DataFrame:
    """(by, n, take): a sample of `most` cells in proportion to n, the remainder one each in the order of names, never above n."""
    total = sizes.agg(F.sum("n").alias("total_"))
    x = sizes.crossJoin(F.broadcast(total)).withColumn("floor_", F.floor(F.col("n") * F.lit(float(most)) / F.col("total_")))
    given = x.agg(F.sum("floor_").alias("given_"))
    x = x.withColumn("room_", (F.col("floor_") < F.col("n")).cast("long")).crossJoin(F.broadcast(given))
    turn = F.sum("room_").over(Window.orderBy(by))  # specimens: metadata
    extra = ((F.col("room_") == 1) & (turn <= most - F.col("given_"))).cast("long")
    return x.select(by, "n", F.when(F.col("total_") <= most, F.col("n")).otherwise(F.col("floor_") + extra).cast("long").alias("take"))


def representative(cells: DataFrame, most: int = 1_000_000, seed: int = 10001, by: str = "specimen", key: str = "structure") -> DataFrame:
    """A subsample of at most `most` cells, allotted to specimens in proportion, the same cells whatever the partitions.

    A threshold on the seeded hash keeps a little more than is due; only what it keeps is ranked.
    """
    return _taken(cells, allocation(cells.groupBy(by).agg(F.count("*").alias("n")), most, by), seed, by, key)


def at_most(cells: DataFrame, most: int, seed: int = 10001, by: str = "specimen", key: str = "structure") -> DataFrame:
    """Of each specimen's cells `most`, chosen by seeded hash; all if it has no more."""
    sizes = cells.groupBy(by).agg(F.count("*").alias("n"))
    return _taken(cells, sizes.withColumn("take", F.least("n", F.lit(most))), seed, by, key)


def _taken(cells: DataFrame, take: DataFrame, seed: int, by: str, key: str) -> DataFrame:
    """take: (by, n, take). Cells of a specimen that is taken whole are not ranked."""
    share = (F.col("take") + 6 * F.sqrt(F.col("take").cast("double")) + 12) / F.col("n")
    h = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 40))
    some = cells.join(take.where("take < n"), by).withColumn("h_", h).where(F.col("h_") <= F.least(share, F.lit(1.0)) * float(1 << 40))
    rank = F.row_number().over(Window.partitionBy(by).orderBy("h_", key))
    some = some.withColumn("rank_", rank).where(F.col("rank_") <= F.col("take")).select(*cells.columns)
    return some.union(cells.join(take.where("take >= n").select(by), by, "left_semi").select(*cells.columns))


def uniform_ranks(cells: DataFrame, columns: Sequence[str], landmarks: int = 1000) -> DataFrame:
    """Columns by their quantile in 0..1, from percentile landmarks of one pass, means for missing values."""
    filled = Imputer(inputCols=list(columns), outputCols=list(columns)).fit(cells.withColumns({c: F.col(c).cast("double") for c in columns}))
    x = filled.transform(cells.withColumns({c: F.col(c).cast("double") for c in columns}))
    points = F.array(*(F.lit(i / landmarks) for i in range(landmarks + 1)))
    marks = x.agg(*(F.percentile_approx(c, points, 10 * landmarks).alias(c) for c in columns)).first()  # one row of fixed size

    def rank(c: str) -> Column:
        at = np.array(marks[c] or [])

        @F.pandas_udf("double")
        def below(v: pd.Series) -> pd.Series:
            return pd.Series(np.searchsorted(at, v.to_numpy()) / (landmarks + 1.0))

        return below(F.col(c))

    return x.withColumns({c: rank(c) for c in columns})


def layout(cells: DataFrame, columns: Sequence[str], extent: float = 5000.0) -> DataFrame:
    """cells with x, y: the first two principal components, moved to begin at 0 and scaled to extent over the smaller maximum."""
    vectors = VectorAssembler(inputCols=list(columns), outputCol="v_", handleInvalid="skip").transform(cells)
    placed = PCA(k=2, inputCol="v_", outputCol="p_").fit(vectors).transform(vectors).withColumn("p_", vector_to_array("p_"))
    placed = placed.withColumns({"px": F.col("p_")[0], "py": F.col("p_")[1]})
    low = placed.agg(F.min("px").alias("ax"), F.min("py").alias("ay"), F.max("px").alias("bx"), F.max("py").alias("by_"))
    scale = extent / F.least(F.col("bx") - F.col("ax"), F.col("by_") - F.col("ay"))
    both = placed.crossJoin(F.broadcast(low))
    return both.withColumns({"x": (F.col("px") - F.col("ax")) * scale, "y": (F.col("py") - F.col("ay")) * scale}).select(*(c for c in cells.columns if c not in ("x", "y")), "x", "y")


def virtual_sample(cells: DataFrame, laid_out: DataFrame, name: int = -1) -> DataFrame:
    """cells with the layout as one more specimen."""
    extra = laid_out.select(F.lit(name).cast("long").alias("specimen"), "structure", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), "mask")
    return cells.select(F.col("specimen").cast("long").alias("specimen"), "structure", "x", "y", "mask").unionByName(extra)
