"""Regions of interest, neighbour graphs within them, and data sets of graphs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .neighbors import nearest, squared_distance, stored
from .sampling import at_most


def roi_side(cells: DataFrame, target: int) -> int:
    """Side of a square that holds `target` cells at the median density of the specimens' bounding boxes."""
    box = cells.groupBy("specimen").agg(F.count("*").alias("n"), ((F.max("x") - F.min("x")).cast("double") * (F.max("y") - F.min("y"))).alias("area"))
    median = box.where("area > 0").agg(F.percentile(F.col("n") / F.col("area"), F.lit(0.5))).first()[0]
    return int(round((target / median) ** 0.5)) if median else 0


def _spanned(c: str, reach: float, side: float) -> Column:
    """The places, on a grid of this side, that c - reach to c + reach meet."""
    return F.sequence(F.floor((F.col(c) - reach) / side), F.floor((F.col(c) + reach) / side))


def _leading(best: DataFrame) -> DataFrame:
    """Of best (specimen, bx, by, b) the rows whose b comes first by (m, a) within two bins around. Bins travel in tiles of 8 by 8 with what borders on them, and are compared there."""
    tiled = best.withColumn("tx", F.explode(_spanned("bx", 2, 8))).withColumn("ty", F.explode(_spanned("by", 2, 8))).repartition("specimen", "tx", "ty")
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-2, 3) for j in range(-2, 3)))
    met = tiled.withColumn("s_", F.explode(steps)).withColumns({"own_": F.when((F.col("s_.i") == 0) & (F.col("s_.j") == 0), F.col("b")), "bx": F.col("bx") + F.col("s_.i"), "by": F.col("by") + F.col("s_.j")})
    met = met.where((F.floor(F.col("bx") / 8) == F.col("tx")) & (F.floor(F.col("by") / 8) == F.col("ty")))
    first = met.groupBy("specimen", "tx", "ty", "bx", "by").agg(F.min(F.struct("b.m", "b.a")).alias("o"), F.min("own_").alias("b"))
    return first.where(F.struct("b.m", "b.a") == F.col("o")).select("specimen", "bx", "by", "b")


def place_rois(cells: DataFrame, target: Column, side: int, k: int = 5, most_targets: int | None = None) -> DataFrame:
    """(specimen, roi, x_min, x_max, y_min, y_max, targets): boxes round target cells, the one with most target cells within side // 2 first.

    The number of boxes of a specimen is its share of target cells times its bounding box's area over a box's, rounded; one if that is
    over a tenth of a box but rounds to none. After each box its target cells go; ties go to the smaller id. A box with k cells
    of any kind or fewer ends the specimen. targets: those left when the box was placed. most_targets: so many target cells of a specimen at most take part, chosen by hash.

    Boxes are placed in rounds, many at a time: a cell whose count leads all that are left within two halves of it (judged by the best cell of each grid bin) comes
    before whatever could take cells from it, so it gets its box with just this count. Counts only fall, so the order of the boxes is that of their counts. A round
    joins boxes with cells and what they took with their neighbours, by grid bins; a specimen of any size spreads over tasks. Over all rounds each pair of near cells is met once.
    A specimen leaves the rounds when the boxes that it can get are known.
    """
    half = side // 2
    box = cells.groupBy("specimen").agg(F.count("*").alias("n"), F.sum(target.cast("long")).alias("hits"), ((F.max("x") - F.min("x")).cast("double") * (F.max("y") - F.min("y"))).alias("area"))
    share = F.col("hits") / F.col("n") * F.col("area") / float(side * side)
    wanted = F.when((F.rint(share) == 0) & (share > 0.1), 1).otherwise(F.rint(share)).cast("int")
    box = stored(box.select("specimen", wanted.alias("wanted")).where("wanted > 0"))
    aims = cells.where(target).join(box.select("specimen"), "specimen", "left_semi").select("specimen", "structure", "x", "y")
    aims = stored(aims if most_targets is None else at_most(aims, most_targets))
    tile = float(3 * half)
    own_tile = lambda d: d.withColumns({"tx": F.floor(F.col("x") / tile), "ty": F.floor(F.col("y") / tile)})
    near_tiles = lambda d, x, y: d.withColumn("tx", F.explode(_spanned(x, half, tile))).withColumn("ty", F.explode(_spanned(y, half, tile)))
    in_box = (F.abs(F.col("x") - F.col("qx")) <= half) & (F.abs(F.col("y") - F.col("qy")) <= half)
    near = own_tile(aims).join(near_tiles(aims.select("specimen", F.col("x").alias("qx"), F.col("y").alias("qy")), "qx", "qy"), ["specimen", "tx", "ty"]).where(in_box)
    counts = near.groupBy("specimen", "tx", "ty", F.col("structure").alias("a"), "x", "y").agg(F.sum((squared_distance("x", "y", "qx", "qy") <= half * half).cast("long")).alias("near"), F.count("*").alias("boxed"))
    counts = stored(counts.drop("tx", "ty"))
    # a box with more than k target cells to begin with has as many cells; only the others, few, are repeated and counted
    thin = counts.where(F.col("boxed") <= k).select("specimen", "a", F.col("x").alias("qx"), F.col("y").alias("qy"))
    around = near_tiles(thin, "qx", "qy").join(own_tile(cells.select("specimen", "x", "y")), ["specimen", "tx", "ty"])
    around = around.where(in_box).groupBy("specimen", "a").agg(F.count("*").alias("all_"))
    left = counts.join(around, ["specimen", "a"], "left").select("specimen", "a", "x", "y", "near", (F.coalesce("all_", F.lit(k + 1)) > k).alias("enough"))

    bins = lambda d: d.withColumns({"bx": F.floor(F.col("x") / half), "by": F.floor(F.col("y") / half)})
    around_by = lambda d, far: d.withColumn("i_", F.explode(F.sequence(F.lit(-far), F.lit(far)))).withColumn("j_", F.explode(F.sequence(F.lit(-far), F.lit(far)))).withColumns({"bx": F.col("bx") + F.col("i_"), "by": F.col("by") + F.col("j_")}).drop("i_", "j_")
    square, placed = ["specimen", "bx", "by"], []
    left = stored(bins(left))
    while True:
        best = left.groupBy(*square).agg(F.min(F.struct((-F.col("near")).alias("m"), "a", "x", "y", "enough")).alias("b"))
        boxes = stored(_leading(best).select(*square, F.col("b.a").alias("centre"), F.col("b.x").alias("cx"), F.col("b.y").alias("cy"), (-F.col("b.m")).alias("near_"), F.col("b.enough").alias("enough_")))
        if not boxes.limit(1).count():
            break
        # boxes of one round stand more than two halves apart, so a cell is in one at most, and few are near a bin
        near_boxes = around_by(boxes, 1).groupBy(*square).agg(F.collect_list(F.struct("centre", "cx", "cy", "near_", "enough_")).alias("l_"))
        inside = F.filter("l_", lambda s: (F.abs(F.col("x") - s.cx) <= half) & (F.abs(F.col("y") - s.cy) <= half))
        marked = stored(left.join(near_boxes, square, "left").withColumn("box_", F.get(inside, F.lit(0))).drop("l_"))
        taken = marked.where("box_ is not null")
        placed.append(stored(taken.select("specimen", "box_.*").groupBy("specimen", "centre", "cx", "cy", "near_", "enough_").agg(F.count("*").alias("targets"))))
        gone = around_by(taken.select(*square, F.col("x").alias("qx"), F.col("y").alias("qy")), 1)
        lost = F.sum(F.when(squared_distance("x", "y", "qx", "qy") <= half * half, 1).otherwise(0))
        rest = marked.where("box_ is null").drop("box_").join(gone, square, "left").groupBy(*square, "a", "x", "y", "near", "enough").agg(lost.alias("lost"))
        left = stored(rest.select(*square, "a", "x", "y", (F.col("near") - F.col("lost")).alias("near"), "enough"))
        # later boxes count no more than the best cell left now: a specimen with as many before it as wanted is done
        most_left = left.groupBy("specimen").agg(F.max("near").alias("most_"))
        ahead = reduce(DataFrame.union, placed).join(most_left, "specimen").where(F.col("near_") > F.col("most_")).groupBy("specimen").agg(F.count("*").alias("ahead_"))
        left = left.join(stored(ahead.join(box, "specimen").where(F.col("ahead_") >= F.col("wanted")).select("specimen")), "specimen", "left_anti")
    if not placed:
        placed = [stored(left.limit(0).select("specimen", F.col("a").alias("centre"), F.col("x").alias("cx"), F.col("y").alias("cy"), F.col("near").alias("near_"), F.col("enough").alias("enough_"), F.lit(0).cast("long").alias("targets")))]
    order = Window.partitionBy("specimen").orderBy(F.desc("near_"), "centre")  # a specimen's boxes
    rows = reduce(DataFrame.union, placed).withColumns({"roi": F.row_number().over(order) - 1, "thin_": F.max((~F.col("enough_")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    rows = rows.join(box, "specimen").where((F.col("roi") < F.col("wanted")) & (F.col("thin_") == 0))
    edge = lambda c, d, name: (F.col(c) + d).cast("long").alias(name)
    return rows.select("specimen", F.col("roi").cast("int").alias("roi"), edge("cx", -half, "x_min"), edge("cx", half, "x_max"), edge("cy", -half, "y_min"), edge("cy", half, "y_max"), "targets")


def roi_cells(cells: DataFrame, rois: DataFrame) -> DataFrame:
    """cells of each box, specimen replaced by the graph's name `specimen_WxH_i`; the original stays as source."""
    name = F.format_string("%s_%dx%d_%d", F.col("specimen").cast("string"), F.col("x_max") - F.col("x_min"), F.col("y_max") - F.col("y_min"), F.col("roi"))
    inside = F.col("x").between(F.col("x_min"), F.col("x_max")) & F.col("y").between(F.col("y_min"), F.col("y_max"))
    both = cells.join(rois.drop("targets"), "specimen").where(inside)
    return both.withColumn("graph", name).withColumnRenamed("specimen", "source")


def roi_graphs(cells: DataFrame, rois: DataFrame, k: int = 5, longest: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of every box: k nearest cells within the box, no farther than longest."""
    nodes = roi_cells(cells, rois)
    edges = nearest(nodes.select(F.col("graph").alias("specimen"), "structure", "x", "y"), k)
    edges = edges if longest is None else edges.where(F.col("d2") <= longest * longest)
    return nodes, edges.select(F.col("specimen").alias("graph"), F.col("a").alias("src"), F.col("b").alias("dst"), F.sqrt("d2").alias("distance"))


def split_datasets(specimens: DataFrame, validation: float = 0.15, test: float = 0.15, seed: int = 0) -> DataFrame:
    """specimens (specimen, label, rois) with set: train, validation, test by label; null for a null label and for labels without boxes.

    In a label, specimens with ten times the median number of boxes or more come first, the others in seeded order. The first trains. Of two, the second goes
    to the one other set that is wanted, by seeded coin if both are, and trains if none is. Of more, the next one is for validation and the next for test, where
    wanted; the rest, in order, train until their boxes reach training's share of all boxes less what it has, then validate until they reach validation's added
    to that, and the others are tests. A specimen counts after it is placed. Rows are specimens, so windows by label are small.
    """
    train = 1 - validation - test
    sizes = specimens.where("label is not null").groupBy("label").agg(F.percentile("rois", F.lit(0.5)).alias("median_"), F.sum("rois").alias("all_"), F.count("*").alias("many_"))
    x = specimens.join(sizes, "label", "left")
    draw = lambda *of: F.md5(F.concat_ws("/", *of, F.lit(seed)).cast("binary"))
    order = Window.partitionBy("label").orderBy((F.col("rois") < 10 * F.col("median_")), draw("specimen"), "specimen")
    x = x.withColumn("at_", F.row_number().over(order))
    second, third = int(validation > 0), int(validation > 0) + int(test > 0)  # specimens placed beside the first
    placed = lambda n: F.coalesce(F.sum(F.when(F.col("at_") == n, F.col("rois"))).over(Window.partitionBy("label")), F.lit(0))
    x = x.withColumns({"train_": F.col("all_") * F.lit(train) - placed(1), "valid_": F.col("all_") * F.lit(validation) - (placed(2) if second else F.lit(0))})
    rest = Window.partitionBy("label").orderBy("at_").rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.when(F.col("at_") > 1 + third, F.col("rois"))).over(rest), F.lit(0))
    filled = F.when(used < F.col("train_"), "train").when(used < F.col("train_") + F.col("valid_"), "validation").otherwise("test")
    coin = F.when(F.substring(draw("label"), 1, 1) < "8", "validation").otherwise("test")
    other = coin if validation > 0 and test > 0 else F.lit("validation" if validation > 0 else "test" if test > 0 else "train")
    chosen = F.when(F.col("at_") == 1, "train").when(F.col("many_") == 2, other)
    chosen = chosen.when((F.col("at_") == 2) & F.lit(bool(second)), "validation").when((F.col("at_") == 1 + third) & F.lit(test > 0), "test").otherwise(filled)
    return x.select("specimen", "label", "rois", F.when(F.col("label").isNotNull() & (F.col("all_") > 0), chosen).alias("set"))


def labelled_specimens(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """cells of specimens that have a label, as graphs for training are made of no others. labels: (specimen, label)."""
    return cells.join(labels.where("label is not null").select("specimen"), "specimen", "left_semi")


def dataset_counts(graphs: DataFrame) -> DataFrame:
    return graphs.groupBy("set", "label").agg(F.count("*").alias("n"))


def stitched(importances: DataFrame) -> DataFrame:
    """One importance for each cell of overlapping boxes: the largest."""
    return importances.groupBy("specimen", "structure").agg(F.max("importance").alias("importance"))


def importance_composition(ranked: DataFrame, cells: DataFrame, hits: dict[str, Column], most: int = 100) -> DataFrame:
    """(specimen, n, <phenotype>...): of each specimen's `most` important cells, the share of each phenotype."""
    top = cells.join(ranked.where(F.col("rank") <= most).select("structure"), "structure", "left_semi")
    return top.groupBy("specimen").agg(F.count("*").alias("n"), *(F.avg(h.cast("double")).alias(p) for p, h in hits.items()))
