"""Queries: pairs and sums over placed nodes, roots and curves, record labels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weft import views
from weft.functions import geometry, solve
from weft.operators import basic, spatial, traverse
from weft.plans.graph import _g4
from weft.plans.layouts import _BOX, _boxes
from weft.plans.sqlviews import DIST4, G4, G5
from weft.registry import query
from weft.sources import records


@query("overlap_pairs", f"WITH {_BOX} SELECT a.grp, a.name AS name_a, b.name AS name_b FROM box a JOIN box b ON a.grp = b.grp AND a.name < b.name WHERE abs(a.x - b.x) < (a.width + b.width) / 2 + 2 AND abs(a.y - b.y) < (a.height + b.height) / 2 + 2")
def overlap_pairs(spark, sf):
    return spatial.overlap_pairs(_boxes(spark, sf), ["grp"], 2.0)


@query("grid_neighbors", f"WITH {_BOX} SELECT a.grp, a.name AS name_a, b.name AS name_b, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS dist2 FROM box a JOIN box b ON a.grp = b.grp AND a.name < b.name WHERE abs(floor(a.x / 64) - floor(b.x / 64)) <= 1 AND abs(floor(a.y / 64) - floor(b.y / 64)) <= 1")
def grid_neighbors(spark, sf):
    p = spatial.near_pairs(_boxes(spark, sf).select("grp", "name", "x", "y"), ["grp"], 64.0)
    dx, dy = F.col("x_a") - F.col("x_b"), F.col("y_a") - F.col("y_b")
    return p.select("grp", "name_a", "name_b", (dx * dx + dy * dy).alias("dist2"))


@query("grid_repulsion", f"""WITH {_BOX}, p AS (SELECT a.grp, a.name, a.x - b.x AS dx, a.y - b.y AS dy FROM box a JOIN box b ON a.grp = b.grp AND a.name <> b.name
 WHERE abs(floor(a.x / 64) - floor(b.x / 64)) <= 1 AND abs(floor(a.y / 64) - floor(b.y / 64)) <= 1 AND (a.x <> b.x OR a.y <> b.y))
SELECT grp, name, CASE WHEN abs(sum(dx * 900 / (dx * dx + dy * dy))) < 1e-6 THEN 0 ELSE round(sum(dx * 900 / (dx * dx + dy * dy)), 6) END AS fx, CASE WHEN abs(sum(dy * 900 / (dx * dx + dy * dy))) < 1e-6 THEN 0 ELSE round(sum(dy * 900 / (dx * dx + dy * dy)), 6) END AS fy FROM p GROUP BY 1, 2""")
def grid_repulsion(spark, sf):
    f = spatial.repulsion(_boxes(spark, sf).select("grp", "name", "x", "y"), ["grp"], 64.0, 30.0)
    return f.select("grp", "name", _rounded(F.col("fx")).alias("fx"), _rounded(F.col("fy")).alias("fy"))


def _rounded(c):
    return F.when(F.abs(c) < 1e-6, F.lit(0.0)).otherwise(F.round(c, 6))


@query("stress", f"WITH RECURSIVE {DIST4}" + """, t AS (SELECT dist * 72.0::DOUBLE AS want, sqrt((src * 37 % 1009 - dst * 37 % 1009)::DOUBLE * (src * 37 % 1009 - dst * 37 % 1009) + (src * 53 % 997 - dst * 53 % 997)::DOUBLE * (src * 53 % 997 - dst * 53 % 997)) AS gap FROM p4)
SELECT count(*) AS pairs, round(sum((gap - want) * (gap - want) / (want * want)), 3) AS stress FROM t""")
def stress(spark, sf):
    nodes, edges = _g4(spark, sf)
    at = nodes.select("name", (F.col("name") * 37 % 1009).cast("double").alias("x"), (F.col("name") * 53 % 997).cast("double").alias("y"))
    t = spatial.stress_terms(traverse.distances(edges), at)
    return t.agg(F.count("*").alias("pairs"), F.round(F.sum("term"), 3).alias("stress"))


@query("compare_degree", f"WITH {G4}, d AS (SELECT name, count(*) AS degree FROM (SELECT tail AS name FROM g4 UNION ALL SELECT head FROM g4) GROUP BY 1) SELECT tail, head, sign(a.degree - b.degree)::INT AS compared FROM g4 JOIN d a ON tail = a.name JOIN d b ON head = b.name")
def compare_degree(spark, sf):
    nodes, edges = _g4(spark, sf)
    e = basic.endpoints_joined(edges, basic.degree(nodes, edges), ["degree"])
    return e.select("tail", "head", F.signum(F.col("tail_degree") - F.col("head_degree")).cast("int").alias("compared"))


@query("interval_overlap", f"WITH {_BOX} SELECT grp, name, greatest(0, least(x + width / 2, lead(x + width / 2) OVER w) - greatest(x - width / 2, lead(x - width / 2) OVER w))::DOUBLE AS shared FROM box WINDOW w AS (PARTITION BY grp ORDER BY name)")
def interval_overlap(spark, sf):
    """How much of its horizontal extent each box shares with the next of its group (the last: none)."""
    w = Window.partitionBy("grp").orderBy("name")
    lo, hi = F.col("x") - F.col("width") / 2, F.col("x") + F.col("width") / 2
    b = _boxes(spark, sf).select("grp", "name", lo.alias("lo"), hi.alias("hi"), F.lead(lo).over(w).alias("next_lo"), F.lead(hi).over(w).alias("next_hi"))
    return b.select("grp", "name", geometry.interval_overlap(F.col("lo"), F.col("hi"), F.col("next_lo"), F.col("next_hi")).cast("double").alias("shared"))


@query("cluster_areas", f"""WITH {G5}, n AS (SELECT sub_id, (16 + sqrt(sum((1 + substr(name, 2)::BIGINT % 5)::DOUBLE))) ** 2 AS area FROM members GROUP BY 1),
m AS (SELECT s.sub_id, s.parent_sub, coalesce(n.area, 256.0::DOUBLE) AS area FROM subs s LEFT JOIN n USING (sub_id) WHERE depth = 2)
SELECT sub_id, round(area, 6) AS area FROM m UNION ALL SELECT s.sub_id, round((16 + sqrt(coalesce(sum(m.area), 0))) ** 2, 6) FROM subs s LEFT JOIN m ON m.parent_sub = s.sub_id WHERE depth = 1 GROUP BY 1""")
def cluster_areas(spark, sf):
    subs, members = views.hierarchy(spark, sf)
    sizes = members.select("sub_id", (1 + F.substr("name", F.lit(2)).cast("long") % 5).cast("double").alias("area"))
    return spatial.cluster_areas(subs, sizes).withColumn("area", F.round("area", 6))


@query("polynomial_roots", """WITH k AS (SELECT p_partkey AS name, (p_size % 3)::DOUBLE AS a, (p_partkey % 7 - 3)::DOUBLE AS b, (p_partkey % 11 - 5)::DOUBLE AS c, (p_partkey % 13 - 6)::DOUBLE AS d FROM part),
s AS (SELECT *, b / (3 * a) AS h FROM k WHERE a <> 0),
t AS (SELECT *, c / a / 3 - h * h AS p, 2 * h * h * h - h * (c / a) + d / a AS q FROM s),
u AS (SELECT *, q * q + 4 * p * p * p AS disc FROM t),
v AS (SELECT *, atan2(sqrt(greatest(-disc, 0)), -q) AS turn, 2 * sqrt(greatest(-p, 0)) AS r, cbrt((sqrt(greatest(disc, 0)) - q) / 2) + cbrt(-(sqrt(greatest(disc, 0)) + q) / 2) AS lone FROM u),
w AS (SELECT name, CASE WHEN disc > 0 THEN 1 ELSE 3 END AS n, CASE WHEN disc < 0 THEN r * cos(turn / 3) - h ELSE lone - h END AS r0,
 CASE WHEN disc < 0 THEN r * cos((turn + 2 * pi()) / 3) - h WHEN disc = 0 THEN -lone / 2 - h END AS r1,
 CASE WHEN disc < 0 THEN r * cos((turn - 2 * pi()) / 3) - h WHEN disc = 0 THEN -lone / 2 - h END AS r2 FROM v
UNION ALL SELECT name, CASE WHEN e < 0 THEN 0 WHEN e > 0 THEN 2 ELSE 1 END, CASE WHEN e >= 0 THEN sqrt(greatest(e, 0)) - g END, CASE WHEN e > 0 THEN -g - sqrt(greatest(e, 0)) END, NULL
 FROM (SELECT name, c / (2 * b) AS g, c / (2 * b) * (c / (2 * b)) - d / b AS e FROM k WHERE a = 0 AND b <> 0)
UNION ALL SELECT name, CASE WHEN c <> 0 THEN 1 WHEN d = 0 THEN 4 ELSE 0 END, CASE WHEN c <> 0 THEN -d / c END, NULL, NULL FROM k WHERE a = 0 AND b = 0)
SELECT name, n, CASE WHEN abs(r0) < 1e-6 THEN 0 ELSE round(r0, 6) END AS r0, CASE WHEN abs(r1) < 1e-6 THEN 0 ELSE round(r1, 6) END AS r1, CASE WHEN abs(r2) < 1e-6 THEN 0 ELSE round(r2, 6) END AS r2 FROM w""")
def polynomial_roots(spark, sf):
    k = F.col("p_partkey")
    p = views.table(spark, sf, "part").select(k.alias("name"), *[c.cast("double").alias(f"c{i}") for i, c in enumerate((k % 13 - 6, k % 11 - 5, k % 7 - 3, F.col("p_size") % 3))])
    n, *roots = solve.cubic(*[F.col(f"c{i}") for i in range(4)])
    return p.select("name", n.alias("n"), *[_rounded(r).alias(f"r{i}") for i, r in enumerate(roots)])


@query("bezier_midpoints", f"""WITH {_BOX}, n AS (SELECT grp, name, x, y, lead(x) OVER w AS x3, lead(y) OVER w AS y3 FROM box WINDOW w AS (PARTITION BY grp ORDER BY name))
SELECT grp, name, 0.125::DOUBLE * x + 0.375::DOUBLE * x + 0.375::DOUBLE * x3 + 0.125::DOUBLE * x3 AS mx, 0.125::DOUBLE * y + 0.375::DOUBLE * (y + 36) + 0.375::DOUBLE * (y3 - 36) + 0.125::DOUBLE * y3 AS my FROM n WHERE x3 IS NOT NULL""")
def bezier_midpoints(spark, sf):
    """The middle of the curve from each box to the next of its group, leaving upward and arriving from below."""
    w = Window.partitionBy("grp").orderBy("name")
    n = _boxes(spark, sf).select("grp", "name", "x", "y", F.lead("x").over(w).alias("x3"), F.lead("y").over(w).alias("y3")).where("x3 IS NOT NULL")
    x, y, x3, y3 = map(F.col, ("x", "y", "x3", "y3"))
    return n.select("grp", "name", solve.bezier_point(x, x, x3, x3, 0.5).alias("mx"), solve.bezier_point(y, y + 36, y3 - 36, y3, 0.5).alias("my"))


@query("record_fields", """SELECT p_partkey AS name, unnest([{'path': '0', 'port': 'f0', 'text': p_brand}, {'path': '1.0', 'port': '', 'text': p_type}, {'path': '1.1', 'port': 's', 'text': p_size || '|{}'}], recursive := true) FROM part""")
def record_fields(spark, sf):
    """Leaf fields of record labels made from parts; separators inside a text are escaped."""
    label = F.concat(F.lit("<f0> "), "p_brand", F.lit(" | {"), "p_type", F.lit("|<s>"), "p_size", F.lit("\\|\\{\\}}"))
    fields = records.fields(views.table(spark, sf, "part").select(F.col("p_partkey").alias("name"), label.alias("label")), "name")
    return fields.where("leaf").select("name", "path", "port", "text")
