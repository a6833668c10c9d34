"""Queries: generators, per-component kernels, geometry joins, text functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from weft import views
from weft.functions import color, geometry, lexical
from weft.operators import generate, kernels, strips, traverse
from weft.plans.sqlviews import COMP4, G4
from weft.registry import query

_R = "SELECT 'n' || i AS tail, 'n' || {h} AS head FROM range({n}) t(i)"
_GEN = {
    "complete": "SELECT 'n' || a.i AS tail, 'n' || b.i AS head FROM range(5) a(i) JOIN range(5) b(i) ON a.i < b.i",
    "cycle": _R.format(h="((i + 1) % 8)", n=8),
    "path": _R.format(h="(i + 1)", n=5),
    "star": "SELECT 'center' AS tail, 'n' || i AS head FROM range(6) t(i)",
    "grid": "SELECT 'n' || r || '_' || c AS tail, 'n' || r2 || '_' || c2 AS head FROM (SELECT r.i AS r, c.i AS c FROM range(4) r(i), range(4) c(i)) JOIN (SELECT r.i AS r2, c.i AS c2 FROM range(4) r(i), range(4) c(i)) ON (r2 = r AND c2 = c + 1) OR (r2 = r + 1 AND c2 = c)",
    "tree": "SELECT 'n' || ((i - 1) // 2) AS tail, 'n' || i AS head FROM range(1, 15) t(i)",
    "petersen": "SELECT 'o' || i AS tail, 'o' || ((i + 1) % 5) AS head FROM range(5) t(i) UNION ALL SELECT 'i' || i, 'i' || ((i + 2) % 5) FROM range(5) t(i) UNION ALL SELECT 'o' || i, 'i' || i FROM range(5) t(i)",
}
for _name, _make in generate.GENERATORS.items():
    query(f"gen_{_name}", _GEN[_name])(lambda spark, sf, make=_make: make(spark))


def _g4(spark, sf):
    e = views.copurchase(spark, sf)
    return views.endpoints(e), e


@query("biconnected_blocks")
def biconnected_blocks(spark, sf):
    def run(names, pairs):
        return [{"component": names[0], "block": k, "name": n} for k, n in kernels.biconnected(names, pairs)]

    return kernels.per_component(*_g4(spark, sf), run, "component long, block long, name long")


@query("articulation_points", f"""WITH RECURSIVE {G4}, h AS (SELECT tail AS a, head AS b FROM g4 WHERE tail <> head UNION SELECT head, tail FROM g4 WHERE tail <> head),
 r(cut, src, dst) AS (SELECT c.name, x.a, x.b FROM v4 c JOIN h y ON y.a = c.name JOIN h x ON x.a = y.b AND x.b <> c.name UNION
  SELECT r.cut, r.src, h.b FROM r JOIN h ON h.a = r.dst WHERE h.b <> r.cut)
SELECT DISTINCT x.a AS name FROM h x JOIN h y ON x.a = y.a AND x.b < y.b WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.cut = x.a AND r.src = x.b AND r.dst = y.b)""")
def articulation_points(spark, sf):
    def run(names, pairs):
        return {"name": kernels.articulation(names, pairs)}

    return kernels.per_component(*_g4(spark, sf), run, "name long")


@query("acyclic_reversed")
def acyclic_reversed(spark, sf):
    def run(names, pairs):
        return pd.DataFrame(kernels.break_cycles(names, pairs), columns=["tail", "head", "reversed"]).astype({"reversed": bool})

    return kernels.per_component(*_g4(spark, sf), run, "tail long, head long, reversed boolean")


@query("tred_in_order")
def tred_in_order(spark, sf):
    def run(names, pairs):
        return pd.DataFrame(kernels.reduce_in_order(names, pairs), columns=["tail", "head"])

    return kernels.per_component(*_g4(spark, sf), run, "tail long, head long")


@query("scc_order")
def scc_order(spark, sf):
    def run(names, pairs):
        return [{"component": names[0], "scc": k, "name": n} for k, n in kernels.strong(names, pairs)]

    return kernels.per_component(*_g4(spark, sf), run, "component long, scc long, name long")


_BTW = f"""WITH RECURSIVE {G4}, w(src, dst, via, d) AS (SELECT tail, head, [tail, head], 1 FROM g4 WHERE tail <> head UNION ALL
 SELECT w.src, g4.head, list_append(w.via, g4.head), w.d + 1 FROM w JOIN g4 ON w.dst = g4.tail WHERE NOT list_contains(w.via, g4.head) AND w.d < 14),
 best AS (SELECT src, dst, min(d) AS d FROM w GROUP BY 1, 2), sp AS (SELECT w.* FROM w JOIN best USING (src, dst, d)),
 total AS (SELECT src, dst, count(*) AS n FROM sp GROUP BY 1, 2),
 inner_ AS (SELECT unnest(via[2:-2]) AS name, src, dst FROM sp), part AS (SELECT name, src, dst, count(*) AS k FROM inner_ GROUP BY 1, 2, 3)
SELECT v4.name, round(coalesce(sum(k::DOUBLE / n), 0.0) / (((SELECT count(*) FROM v4) - 1) * ((SELECT count(*) FROM v4) - 2)), 12) AS betweenness
FROM v4 LEFT JOIN part ON v4.name = part.name LEFT JOIN total ON part.src = total.src AND part.dst = total.dst GROUP BY 1"""


@query("betweenness", _BTW)
def betweenness(spark, sf):
    nodes, edges = _g4(spark, sf)
    n = nodes.count()

    def run(names, pairs):
        b = kernels.betweenness(names, pairs, n)
        return {"name": list(b), "betweenness": list(b.values())}

    return kernels.per_component(nodes, edges, run, "name long, betweenness double").withColumn("betweenness", F.round("betweenness", 12))


# synthetic positions: part keys on a 100-wide sheet
_POS = "pos AS (SELECT tail, head, (tail * 37 % 1009)::DOUBLE AS ax, (tail * 53 % 997)::DOUBLE AS ay, (head * 37 % 1009)::DOUBLE AS bx, (head * 53 % 997)::DOUBLE AS by_ FROM g4 WHERE tail <> head)"


def _segments(spark, sf):
    e = views.copurchase(spark, sf).where("tail <> head")
    at = lambda c: ((F.col(c) * 37 % 1009).cast("double"), (F.col(c) * 53 % 997).cast("double"))
    (ax, ay), (bx, by) = at("tail"), at("head")
    return e.select("tail", "head", ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by.alias("by"))


def crossing_pairs(segs):
    """Properly crossing pairs of segments."""
    return strips.pairs(segs, F.least("ax", "bx"), F.greatest("ax", "bx"), strips.crossing)


@query("edgepaint_crossings", f"""WITH {G4}, {_POS}, s AS (SELECT tail, head, ax, ay, bx, by_ AS by FROM pos),
c AS (SELECT a.tail AS tail1, a.head AS head1, b.tail AS tail2, b.head AS head2,
 ((b.ax - a.ax) * (a.by - a.ay) - (a.bx - a.ax) * (b.ay - a.ay)) AS s1, ((b.bx - a.ax) * (a.by - a.ay) - (a.bx - a.ax) * (b.by - a.ay)) AS s2,
 ((a.ax - b.ax) * (b.by - b.ay) - (b.bx - b.ax) * (a.ay - b.ay)) AS s3, ((a.bx - b.ax) * (b.by - b.ay) - (b.bx - b.ax) * (a.by - b.ay)) AS s4
 FROM s a JOIN s b ON (a.tail, a.head) < (b.tail, b.head))
SELECT tail1, head1, tail2, head2 FROM c WHERE s1 * s2 < 0 AND s3 * s4 < 0""")
def edgepaint_crossings(spark, sf):
    return crossing_pairs(_segments(spark, sf))


@query("edgepaint_colors")
def edgepaint_colors(spark, sf):
    """Greedy colouring of the crossing graph in edge order."""
    return edge_colors(_segments(spark, sf))


def edge_colors(segs):
    """The order is that of all edges, so one task colours them; it holds the edges and looks at each one's crossings in
    turn, which are never a table."""
    edge = F.concat_ws("-", *[F.lpad(F.col(c).cast("string"), 9, "0") for c in ("tail", "head")])

    def run(pdf):
        pdf = pdf.sort_values("edge")
        found = strips.greedy_colors(*[pdf[c].to_numpy() for c in ("ax", "ay", "bx", "by")]) % len(color.EDGE_PALETTE)
        return pd.DataFrame({"edge": pdf["edge"], "color": [color.EDGE_PALETTE[c] for c in found]})

    return segs.select(F.lit(0).alias("sheet"), edge.alias("edge"), "ax", "ay", "bx", "by").groupBy("sheet").applyInPandas(run, "edge string, color string")


def compatible_pairs(segs):
    """Pairs of segments with compatibility from 0.5 on. Angle and scale are at most 1 each, so the middles of such a pair
    are no further apart than their mean length: stretches of each one's length around its middle meet."""
    lengths = segs.withColumn("len", geometry.distance(*(F.col(x) for x in ("ax", "ay", "bx", "by")))).where("len > 0")
    mid, reach = (F.col("ax") + F.col("bx")) / 2, F.col("len") * (1.001 / 2)  # a little wide, as compatibilities are rounded
    out = strips.pairs(lengths, mid - reach, mid + reach, strips.compatible, "compat")
    return out.withColumn("compat", F.round("compat", 6)).where("compat >= 0.5")


@query("mingle_compat", f"""WITH {G4}, {_POS}, s AS (SELECT *, sqrt((ax - bx) * (ax - bx) + (ay - by_) * (ay - by_)) AS len FROM pos),
p AS (SELECT a.tail AS tail1, a.head AS head1, b.tail AS tail2, b.head AS head2, a.len AS la, b.len AS lb, (a.len + b.len) / 2 AS av,
 abs(((a.bx - a.ax) * (b.bx - b.ax) + (a.by_ - a.ay) * (b.by_ - b.ay)) / (a.len * b.len)) AS ang,
 sqrt(((a.ax + a.bx) / 2 - (b.ax + b.bx) / 2) * ((a.ax + a.bx) / 2 - (b.ax + b.bx) / 2) + ((a.ay + a.by_) / 2 - (b.ay + b.by_) / 2) * ((a.ay + a.by_) / 2 - (b.ay + b.by_) / 2)) AS away
 FROM s a JOIN s b ON (a.tail, a.head) < (b.tail, b.head) WHERE a.len > 0 AND b.len > 0),
q AS (SELECT *, 2 / (greatest(la, lb) / av + av / least(la, lb)) AS sc FROM p)
SELECT tail1, head1, tail2, head2, round(CASE WHEN ang < 0.1 OR sc < 0.1 THEN 0.0 ELSE ang * sc * av / (av + away) END, 6) AS compat FROM q WHERE compat >= 0.5""")
def mingle_compat(spark, sf):
    return compatible_pairs(_segments(spark, sf))


@query("dot_lines", """SELECT p_partkey, CASE WHEN regexp_matches(p_name, '^[A-Za-z_][A-Za-z_0-9]*$') THEN p_name ELSE '"' || replace(p_name, '"', '\\"') || '"' END
 || ' [type=' || CASE WHEN regexp_matches(p_type, '^[A-Za-z_][A-Za-z_0-9]*$') THEN p_type ELSE '"' || p_type || '"' END || '];' AS line FROM part""")
def dot_lines(spark, sf):
    p = views.table(spark, sf, "part")
    return p.select("p_partkey", F.concat(lexical.quote(F.col("p_name")), F.lit(" [type="), lexical.quote(F.col("p_type")), F.lit("];")).alias("line"))


@query("sanitize_dot", r"SELECT doc_id, md5(regexp_replace(text, '[^\t\n\r\x20-\x7E]', '_', 'g')) AS clean FROM documents")
def sanitize_dot(spark, sf):
    return views.table(spark, sf, "documents").select("doc_id", F.md5(lexical.sanitize(F.col("text"))).alias("clean"))


@query("parse_attrs", "SELECT event_id, CASE WHEN contains(s, '=') THEN split_part(s, '=', 1) ELSE s END AS key, CASE WHEN contains(s, '=') THEN substr(s, strpos(s, '=') + 1) ELSE 'true' END AS value FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type ELSE event_type || '=' || props END AS s FROM events)")
def parse_attrs(spark, sf):
    s = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.concat("event_type", F.lit("="), "props"))
    k, v = lexical.parse_attr(F.col("s"))
    return views.table(spark, sf, "events").select("event_id", s.alias("s")).select("event_id", k.alias("key"), v.alias("value"))


@query("node_sizes", """SELECT p_partkey, round(greatest(length(p_name) * 0.52::DOUBLE * 14.0::DOUBLE + 16, p_size * 0.05::DOUBLE * 72), 6) AS w, round(greatest(1.2::DOUBLE * 14.0::DOUBLE + 8, 36.0::DOUBLE), 6) AS h FROM part""")
def node_sizes(spark, sf):
    w, h = lexical.node_size(F.col("p_name"), F.lit(14.0), F.col("p_size") * 0.05, F.lit(None).cast("double"))
    return views.table(spark, sf, "part").select("p_partkey", F.round(w, 6).alias("w"), F.round(h, 6).alias("h"))


@query("color_resolve", """SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN '#a1b2c3' WHEN 1 THEN '#ffa500' WHEN 2 THEN '#' || CASE n_regionkey WHEN 0 THEN 'ff0000' WHEN 1 THEN 'cbff00' WHEN 2 THEN '00ff66' WHEN 3 THEN '0066ff' ELSE 'cc00ff' END ELSE 'nosuch' END AS hex FROM nation""")
def color_resolve(spark, sf):
    spec = F.element_at(F.array(F.lit("#a1b2c3"), F.lit("Orange"), F.concat((F.col("n_regionkey") / 5).cast("string"), F.lit(" 1 1")), F.lit("nosuch")), (F.col("n_nationkey") % 4 + 1).cast("int"))
    return views.table(spark, sf, "nation").select("n_nationkey", color.resolve(spec).alias("hex"))


@query("component_edges_split", f"WITH RECURSIVE {COMP4} SELECT component, tail, head FROM g4 JOIN c4 ON tail = name")
def component_edges_split(spark, sf):
    nodes, edges = _g4(spark, sf)
    comp = traverse.connected_components(nodes, edges).select(F.col("name").alias("tail"), "component")
    return edges.join(comp, "tail").select("component", "tail", "head")
