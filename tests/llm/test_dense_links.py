import numpy as np
from pyspark.sql import functions as F

from cytofabric.llm import nn_descent


def test_links_of_members_that_stand_beside_their_pivots(spark):
    """A member 1e-8 off its pivot has the pivot's cosine 1, so a radius of 0; it may link with a pivot that stands a little too far from its own."""
    n = 8
    order = [r.rep for r in spark.range(n).select(F.col("id").alias("rep")).orderBy(F.xxhash64("rep", F.lit(11))).collect()]
    at = lambda angle: np.array([np.cos(angle), np.sin(angle)])
    beyond = next(d for d in np.linspace(3e-9, 9e-9, 100) if at(np.arccos(0.9) + d) @ at(np.arccos(0.9) + d) >= 1)  # a radius of 0 too
    angles = [0.0, np.arccos(0.9) + beyond, 2.5, 4.0, 1e-8, 2.501, 4.001, 4.002]  # the first four are pivots
    v = {rep: at(a) for rep, a in zip(order, angles, strict=True)}
    points = spark.createDataFrame([(rep, 1, x.tolist()) for rep, x in v.items()], "rep long, copies long, v array<double>")
    counts, _ = nn_descent._between_dense(points, points.select("rep"), 0.9, per_block=n)
    got = {r.rep: r.n for r in counts.collect()}
    want = {a: sum(b != a and float(v[a] @ v[b]) >= 0.9 for b in v) for a in v}
    assert want[order[4]] == 2 and {a: got.get(a, 0) for a in v} == want
