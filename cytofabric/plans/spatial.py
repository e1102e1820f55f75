"""Queries on positions: neighbours and the metrics built on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.statistics import fisher
from ..operators import neighbors as N
from ..operators import populations as P
from ..operators import spatial as S
from ..sources.tables import CELLS, CHANNELS, INTENSITIES, cells
from .populations import SIGNATURES
from .registry import query

_C = f"WITH cells AS MATERIALIZED ({CELLS})"
_BULK, _RET = SIGNATURES["bulk_taxed"], SIGNATURES["returned"]
_W = {"bulk": "({0}.mask & 20) = 20 AND ({0}.mask & 1) = 0", "ret": "({0}.mask & 1) = 1 AND ({0}.mask & 2) = 0"}
_D2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)"
_NEAR = f"""{_C}, ranked AS (SELECT a.specimen, a.structure AS a, b.structure AS b, {_D2} AS d2,
  row_number() OVER (PARTITION BY a.structure ORDER BY {_D2}, b.structure) AS rank
  FROM cells a JOIN cells b ON a.specimen = b.specimen AND a.structure <> b.structure),
edges AS MATERIALIZED (SELECT * FROM ranked WHERE rank <= 6),
labelled AS MATERIALIZED (SELECT specimen, structure, CASE WHEN (mask & 20) = 20 AND (mask & 1) = 0 THEN 1 WHEN (mask & 1) = 1 AND (mask & 2) = 0 THEN 2 ELSE 0 END AS label FROM cells)"""


def labelled(spark, d):
    c = cells(spark, d)
    return c.select("specimen", "structure", "x", "y", "mask", S.labels(F.col("mask"), [_BULK, _RET]).alias("label"))


@query("c07_radius_pairs", f"""{_C}, l AS MATERIALIZED (SELECT specimen, structure, x, y, x // 30 AS i, y // 30 AS j FROM cells a WHERE {_W['ret'].format('a')}),
r AS MATERIALIZED (SELECT specimen, structure, x, y, x // 30 + u AS i, y // 30 + v AS j FROM cells b, (VALUES (-1), (0), (1)) AS s(u), (VALUES (-1), (0), (1)) AS t(v) WHERE {_W['bulk'].format('b')})
SELECT a.specimen, a.structure AS a, b.structure AS b, {_D2} AS d2 FROM l a JOIN r b ON a.specimen = b.specimen AND a.i = b.i AND a.j = b.j WHERE {_D2} <= 900""")
def c07(spark, d):
    c = cells(spark, d)
    return N.radius_pairs(c.where(S.matches(F.col("mask"), *_RET)), c.where(S.matches(F.col("mask"), *_BULK)), 30).withColumn("d2", F.col("d2").cast("int"))


@query("c08_nearest_six", f"{_NEAR} SELECT specimen, a, b, d2, rank FROM edges")
def c08(spark, d):
    return N.nearest(cells(spark, d), 6).withColumn("d2", F.col("d2").cast("int"))


@query("c09_one_to_one", f"""{_C}, l AS (SELECT * FROM cells WHERE {_W['ret'].format('cells')}), r AS (SELECT * FROM cells WHERE {_W['bulk'].format('cells')}),
p AS (SELECT a.specimen, a.structure AS a, b.structure AS b, {_D2} AS d2 FROM l a JOIN r b ON a.specimen = b.specimen WHERE {_D2} <= 100),
best AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY a ORDER BY d2, b) = 1)
SELECT l.specimen, l.structure AS a, coalesce(b, -1) AS b, coalesce(d2, -1) AS d2, CASE WHEN b IS NULL THEN 'unmatched' WHEN count(*) OVER (PARTITION BY b) > 1 THEN 'duplicate' ELSE '' END AS problem FROM l LEFT JOIN best ON l.structure = best.a""")
def c09(spark, d):
    c = cells(spark, d)
    return N.match_one_to_one(c.where(S.matches(F.col("mask"), *_RET)), c.where(S.matches(F.col("mask"), *_BULK)), 10).withColumn("d2", F.col("d2").cast("int")).fillna(-1, ["b", "d2"]).fillna("", ["problem"])


def _prox(name, a, b, r):
    return f"(SELECT s.specimen, CASE WHEN count(*) FILTER ({_W[a].format('s')}) > 0 THEN round(coalesce(any_value(h.n), 0) / count(*) FILTER ({_W[a].format('s')}), 6) END AS {name} FROM cells s LEFT JOIN (SELECT a.specimen, count(*) AS n FROM cells a JOIN cells b ON a.specimen = b.specimen AND a.structure <> b.structure AND {_W[a].format('a')} AND {_W[b].format('b')} WHERE {_D2} <= {r * r} GROUP BY 1) h ON h.specimen = s.specimen GROUP BY 1)"


_REQUESTS = {"bulk_ret_30": (_BULK, _RET, 30), "ret_bulk_60": (_RET, _BULK, 60), "bulk_bulk_45": (_BULK, _BULK, 45)}


@query("j01_proximity", f"{_C} SELECT * FROM {_prox('proximity', 'bulk', 'ret', 60)}")
def j01(spark, d):
    out = S.proximity(cells(spark, d), {"proximity": (_BULK, _RET, 60)})
    return out.withColumn("proximity", F.round("proximity", 6))


@query("j02_proximity_batch", f"{_C} SELECT * FROM {_prox('bulk_ret_30', 'bulk', 'ret', 30)} JOIN {_prox('ret_bulk_60', 'ret', 'bulk', 60)} USING (specimen) JOIN {_prox('bulk_bulk_45', 'bulk', 'bulk', 45)} USING (specimen)")
def j02(spark, d):
    out = S.proximity(cells(spark, d), _REQUESTS)
    return out.select("specimen", *(F.round(n, 6).alias(n) for n in _REQUESTS))


@query("j03_labels", f"{_NEAR} SELECT specimen, label, count(*) AS n FROM labelled GROUP BY ALL")
def j03(spark, d):
    return labelled(spark, d).groupBy("specimen", "label").agg(F.count("*").alias("n"))


@query("j05_enrichment", f"""{_NEAR}, e AS (SELECT e.specimen, e.a, e.b, x.label AS la, y.label AS lb FROM edges e JOIN labelled x ON e.a = x.structure JOIN labelled y ON e.b = y.structure),
n AS (SELECT specimen, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (label = 0) AS DOUBLE) AS a, CAST(count(*) FILTER (label = 1) AS DOUBLE) AS b FROM labelled GROUP BY 1),
o AS (SELECT specimen, CAST(count(*) AS DOUBLE) AS s0, CAST(count(*) FILTER (la = 0 AND lb = 1) AS DOUBLE) AS observed FROM e GROUP BY 1),
rec AS (SELECT x.specimen, CAST(count(*) AS DOUBLE) AS rec FROM edges x JOIN edges y ON x.a = y.b AND x.b = y.a GROUP BY 1),
deg AS (SELECT specimen, v, CAST(sum(o) AS DOUBLE) AS o, CAST(sum(i) AS DOUBLE) AS i FROM (SELECT specimen, a AS v, 1 AS o, 0 AS i FROM edges UNION ALL SELECT specimen, b, 0, 1 FROM edges) GROUP BY ALL),
s AS (SELECT specimen, sum(o*o) AS oo, sum(i*i) AS ii, sum(o*i) AS oi FROM deg GROUP BY 1),
m AS (SELECT specimen, n, observed, s0*a*b/(n*(n-1)) AS mean, s0*a*b/(n*(n-1)) + (oo-s0)*a*b*(b-1)/(n*(n-1)*(n-2)) + (ii-s0)*a*(a-1)*b/(n*(n-1)*(n-2))
  + (s0*s0 - s0 - (oo-s0) - (ii-s0) - 2*(oi-rec) - rec)*a*(a-1)*b*(b-1)/(n*(n-1)*(n-2)*(n-3)) AS square FROM n JOIN o USING (specimen) JOIN rec USING (specimen) JOIN s USING (specimen))
SELECT specimen, CAST(n AS BIGINT) AS n, observed, round((observed - mean) / sqrt(square - mean*mean), 6) AS z FROM m""")
def j05(spark, d):
    c = N.stored(cells(spark, d).select("specimen", "structure", "x", "y", "mask"))
    return S.enrichment_batch(c, S.neighbour_graph(c), {"": (_BULK, _RET)}).select("specimen", "n", "observed", F.round("z", 6).alias("z"))


@query("j06_co_occurrence", f"""{_NEAR}, p AS (SELECT a.specimen, x.label AS la, y.label AS lb, count(*) AS n FROM cells a JOIN cells b ON a.specimen = b.specimen AND a.structure <> b.structure JOIN labelled x ON x.structure = a.structure JOIN labelled y ON y.structure = b.structure
WHERE {_D2} <= 2500 AND {_D2} > 0 GROUP BY ALL)
SELECT specimen, round((sum(n) FILTER (la = 1 AND lb = 2) / sum(n) FILTER (la = 1)) / (sum(n) FILTER (lb = 2) / sum(n)), 6) AS ratio FROM p GROUP BY 1""")
def j06(spark, d):
    return S.co_occurrence(labelled(spark, d), 50, (1, 2)).select("specimen", F.round("ratio", 6).alias("ratio"))


@query("j07_moran", f"""{_NEAR}, m AS (SELECT specimen, avg(label) AS m, var_pop(label) AS v, count(*) AS n FROM labelled GROUP BY 1),
z AS (SELECT specimen, structure, label - m AS z FROM labelled JOIN m USING (specimen))
SELECT e.specimen, any_value(n) AS n, round(sum(x.z * y.z / 6.0) / any_value(n) / any_value(v), 6) AS moran FROM edges e JOIN z x ON e.a = x.structure JOIN z y ON e.b = y.structure JOIN m ON m.specimen = e.specimen GROUP BY 1""")
def j07(spark, d):
    c = N.stored(labelled(spark, d).drop("mask"))
    return S.moran_batch(c, S.neighbour_graph(c, keep=("label",)), {}, ["label"]).select("specimen", "n", F.round("moran", 6).alias("moran"))


_DISC = P.signature(["DISC"], ["OPEN"], CHANNELS)
_PAIRS = {"bulk_ret": (_BULK, _RET), "ret_bulk": (_RET, _BULK), "disc_bulk": (_DISC, _BULK)}
_TAKES = _W | {"disc": "({0}.mask & 8) = 8 AND ({0}.mask & 2) = 0"}
_NAMES = "[" + ", ".join(f"'{n}'" for n in _PAIRS) + "]"
_BATCH_LABELS = "[" + ", ".join(f"CASE WHEN {_TAKES[n.split('_')[0]].format('cells')} THEN 1 WHEN {_TAKES[n.split('_')[1]].format('cells')} THEN 2 ELSE 0 END" for n in _PAIRS) + "]"
#: Each cell's label under every request as a list, which is unnested only after cells have met.
_LONG = f"w AS MATERIALIZED (SELECT specimen, structure, x, y, {_BATCH_LABELS} AS ls FROM cells), l AS (SELECT unnest({_NAMES}) AS request, specimen, unnest(ls) AS label FROM w)"
_SIZES = """per AS (SELECT request, specimen, label, count(*) AS c FROM l GROUP BY ALL), c AS (SELECT *, row_number() OVER (PARTITION BY request, specimen ORDER BY label) AS nth FROM per),
two AS (SELECT request, specimen, CAST(sum(c) AS DOUBLE) AS n, max(label) FILTER (nth = 1) AS one, max(label) FILTER (nth = 2) AS two, CAST(max(c) FILTER (nth = 1) AS DOUBLE) AS a, CAST(max(c) FILTER (nth = 2) AS DOUBLE) AS b FROM c GROUP BY ALL)"""


@query("m_batch_enrichment", f"""{_NEAR}, {_LONG}, {_SIZES},
met AS MATERIALIZED (SELECT e.specimen, x.ls AS la, y.ls AS lb, count(*) AS m FROM edges e JOIN w x ON e.a = x.structure JOIN w y ON e.b = y.structure GROUP BY ALL),
by_request AS (SELECT specimen, unnest({_NAMES}) AS request, unnest(la) AS la, unnest(lb) AS lb, m FROM met),
o AS (SELECT request, specimen, CAST(sum(m) AS DOUBLE) AS s0, CAST(coalesce(sum(m) FILTER (la = one AND lb = two), 0) AS DOUBLE) AS observed FROM by_request JOIN two USING (request, specimen) GROUP BY ALL),
rec AS (SELECT x.specimen, CAST(count(*) AS DOUBLE) AS rec FROM edges x JOIN edges y ON x.a = y.b AND x.b = y.a GROUP BY 1),
deg AS (SELECT specimen, v, CAST(sum(o) AS DOUBLE) AS o, CAST(sum(i) AS DOUBLE) AS i FROM (SELECT specimen, a AS v, 1 AS o, 0 AS i FROM edges UNION ALL SELECT specimen, b, 0, 1 FROM edges) GROUP BY ALL),
s AS (SELECT specimen, sum(o*o) AS oo, sum(i*i) AS ii, sum(o*i) AS oi FROM deg GROUP BY 1),
m AS (SELECT request, specimen, n, observed, s0*a*b/(n*(n-1)) AS mean, s0*a*b/(n*(n-1)) + (oo-s0)*a*b*(b-1)/(n*(n-1)*(n-2)) + (ii-s0)*a*(a-1)*b/(n*(n-1)*(n-2))
  + (s0*s0 - s0 - (oo-s0) - (ii-s0) - 2*(oi-rec) - rec)*a*(a-1)*b*(b-1)/(n*(n-1)*(n-2)*(n-3)) AS square FROM two JOIN o USING (request, specimen) JOIN rec USING (specimen) JOIN s USING (specimen))
SELECT specimen, request, CAST(n AS BIGINT) AS n, observed, round((observed - mean) / sqrt(square - mean*mean), 6) AS z FROM m""")
def batch_enrichment(spark, d):
    """Three pairs of phenotypes over one stored graph."""
    c = N.stored(cells(spark, d).select("specimen", "structure", "x", "y", "mask"))
    return S.enrichment_batch(c, S.neighbour_graph(c), _PAIRS).select("specimen", "request", "n", "observed", F.round("z", 6).alias("z"))


@query("m_batch_co_occurrence", f"""{_C}, {_LONG}, {_SIZES},
met AS MATERIALIZED (SELECT a.specimen, a.ls AS la, b.ls AS lb, count(*) AS n FROM w a JOIN w b ON a.specimen = b.specimen AND a.structure <> b.structure WHERE {_D2} <= 2500 AND {_D2} > 0 GROUP BY ALL),
p AS (SELECT specimen, unnest({_NAMES}) AS request, unnest(la) AS la, unnest(lb) AS lb, n FROM met)
SELECT specimen, request, round((sum(p.n) FILTER (la = one AND lb = two) / sum(p.n) FILTER (la = one)) / (sum(p.n) FILTER (lb = two) / sum(p.n)), 6) AS ratio FROM p JOIN two USING (request, specimen) GROUP BY ALL""")
def batch_co_occurrence(spark, d):
    """Three pairs of phenotypes by one join of cells."""
    return S.co_occurrence_batch(cells(spark, d), _PAIRS, 50).select("specimen", "request", F.round("ratio", 6).alias("ratio"))


_ALL_CHANNELS = "[" + ", ".join(f"'{c}'" for c in (*CHANNELS, *INTENSITIES)) + "]"
_CHANNEL_VALUES = "[" + ", ".join([f"CAST((mask >> {i}) & 1 AS DOUBLE)" for i in range(len(CHANNELS))] + [f"CAST({v} AS DOUBLE)" for v in INTENSITIES]) + "]"


@query("m_batch_autocorrelation", f"""{_NEAR}, w AS MATERIALIZED (SELECT specimen, structure, {_CHANNEL_VALUES} AS vs FROM cells),
m AS (SELECT channel, specimen, avg(v) AS m, var_pop(v) AS var, count(*) AS n FROM (SELECT unnest({_ALL_CHANNELS}) AS channel, specimen, unnest(vs) AS v FROM w) GROUP BY ALL),
met AS (SELECT e.specimen, unnest({_ALL_CHANNELS}) AS channel, unnest(x.vs) AS va, unnest(y.vs) AS vb FROM edges e JOIN w x ON e.a = x.structure JOIN w y ON e.b = y.structure)
SELECT specimen, channel, any_value(n) AS n, round(sum((va - m) * (vb - m) / 6.0) / any_value(n) / any_value(var), 6) AS moran FROM met JOIN m USING (channel, specimen) GROUP BY ALL""")
def batch_autocorrelation(spark, d):
    """Moran's I of every channel's calls and of every intensity over one stored graph."""
    c = N.stored(cells(spark, d))
    channels = {n: [P.signature([n], [], CHANNELS)] for n in CHANNELS}
    return S.moran_batch(c, S.neighbour_graph(c, keep=("mask", *INTENSITIES)), channels, INTENSITIES).select("specimen", "channel", "n", F.round("moran", 6).alias("moran"))


@query("j08_ripley_f")
def j08(spark, d):
    return S.ripley_f(labelled(spark, d))


@query("j08_pair_counts", f"""{_C}, l AS (SELECT * FROM cells WHERE {_W['bulk'].format('cells')})
SELECT a.specimen, CAST(floor(sqrt({_D2}) / 7) AS INT) AS bin, count(*) AS pairs FROM l a JOIN l b ON a.specimen = b.specimen AND a.structure < b.structure WHERE sqrt({_D2}) < 140 GROUP BY ALL""")
def j08_pairs(spark, d):
    """What Ripley's L counts: pairs of one phenotype's cells by distance."""
    return S.pair_distance_counts(cells(spark, d).where(S.matches(F.col("mask"), *_BULK)), 7.0, 20)


@query("j08_ripley_l")
def j08_l(spark, d):
    return S.ripley_summary(S.ripley_gl(labelled(spark, d), "L", 1))


@query("j08_ripley_g")
def j08_g(spark, d):
    return S.ripley_summary(S.ripley_gl(labelled(spark, d), "G", 1))


@query("i08_region_enrichment", f"{_C} SELECT specimen, count(*) FILTER (x < 500 AND (mask & 20) = 20 AND (mask & 1) = 0) AS a, count(*) FILTER (x < 500 AND NOT ((mask & 20) = 20 AND (mask & 1) = 0)) AS b, count(*) FILTER (x >= 500 AND (mask & 20) = 20 AND (mask & 1) = 0) AS c, count(*) FILTER (x >= 500 AND NOT ((mask & 20) = 20 AND (mask & 1) = 0)) AS d, TRUE AS p_in_range FROM cells GROUP BY 1")
def i08(spark, d):
    n = S.region_enrichment_counts(cells(spark, d), F.col("x") < 500, _BULK)
    return n.select("*", fisher("a", "b", "c", "d").between(0, 1).alias("p_in_range"))
