"""Queries: predicates, subgraph creation, undo stacks, cluster crossings, attributes through the formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft import views
from weft.operators import basic, mutate, spatial
from weft.plans.algorithms import _POS, _segments
from weft.plans.sqlviews import CS, G4, G5
from weft.registry import query
from weft.sources import dot, exchange


@query("object_kinds", f"WITH {G5} SELECT DISTINCT name, 'node' AS kind FROM members UNION ALL SELECT sub_id, 'subgraph' FROM subs UNION ALL SELECT 'x' || r_regionkey, NULL FROM region")
def object_kinds(spark, sf):
    subs, members = views.hierarchy(spark, sf)
    nodes = members.select("name").distinct()
    names = nodes.unionByName(subs.select(F.col("sub_id").alias("name"))).unionByName(views.table(spark, sf, "region").select(F.concat(F.lit("x"), "r_regionkey").alias("name")))
    return basic.object_kinds(names, nodes, subs)


@query("contains", f"WITH {G5}, p AS (SELECT 'cluster_r' || r_regionkey AS sub_id, 's' || s_suppkey AS name FROM region, supplier UNION ALL SELECT 'cluster_n' || s_nationkey, 's' || s_suppkey FROM supplier) SELECT p.sub_id, p.name, m.sub_id IS NOT NULL OR x.name IS NOT NULL AS held, m.sub_id IS NOT NULL AS direct FROM p LEFT JOIN members m ON m.sub_id = p.sub_id AND m.name = p.name LEFT JOIN (SELECT parent_sub, name FROM members JOIN subs USING (sub_id)) x ON x.parent_sub = p.sub_id AND x.name = p.name")
def contains(spark, sf):
    subs, members = views.hierarchy(spark, sf)
    s = views.table(spark, sf, "supplier")
    name = F.concat(F.lit("s"), "s_suppkey").alias("name")
    regions = F.explode(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.concat(F.lit("cluster_r"), k.cast("string"))))
    pairs = s.select(regions.alias("sub_id"), name).unionByName(s.select(F.concat(F.lit("cluster_n"), "s_nationkey").alias("sub_id"), name))
    return basic.contains(pairs, subs, members)


@query("subgraph_parents", f"WITH {G5} SELECT sub_id, coalesce(parent_sub, 'G') AS parent, 'G' AS root FROM subs")
def subgraph_parents(spark, sf):
    return basic.parents(views.hierarchy(spark, sf)[0], "G")


@query("node_before", f"WITH {G4} SELECT tail AS a, head AS b, p.p_size * 1000000 + tail < q.p_size * 1000000 + head AS before FROM g4 JOIN part p ON tail = p.p_partkey JOIN part q ON head = q.p_partkey")
def node_before(spark, sf):
    order = views.table(spark, sf, "part").select(F.col("p_partkey").alias("name"), (F.col("p_size") * 1000000 + F.col("p_partkey")).alias("seq"))
    return basic.before(views.copurchase(spark, sf).select(F.col("tail").alias("a"), F.col("head").alias("b")), order)


@query("one_home", f"WITH {G5} SELECT sub_id, name FROM members")
def one_home(spark, sf):
    """Every member is put into its region as well; only its deepest home stays."""
    subs, members = views.hierarchy(spark, sf)
    both = members.join(subs, "sub_id").select(F.explode("path").alias("sub_id"), "name")
    return basic.one_home(subs, both)


@query("add_subgraphs", f"WITH {G5} SELECT sub_id, parent_sub, depth FROM subs UNION ALL SELECT DISTINCT 'seg_' || c_nationkey || '_' || c_mktsegment, 'cluster_n' || c_nationkey, 3 FROM customer")
def add_subgraphs(spark, sf):
    subs, _ = views.hierarchy(spark, sf)
    new = views.table(spark, sf, "customer").select(F.concat_ws("_", F.lit("seg"), "c_nationkey", "c_mktsegment").alias("sub_id"), F.concat(F.lit("cluster_n"), "c_nationkey").alias("parent_sub"))
    again = subs.select("sub_id", F.lit(None).cast("string").alias("parent_sub"))
    return mutate.add_subgraphs(subs, new.unionByName(again)).select("sub_id", "parent_sub", "depth")


@query("add_members", f"WITH {G5} SELECT sub_id, name FROM members UNION SELECT 'cluster_r0', 'c' || c_custkey FROM customer WHERE c_acctbal < 0")
def add_members(spark, sf):
    _, members = views.hierarchy(spark, sf)
    new = views.table(spark, sf, "customer").where("c_acctbal < 0").select(F.lit("cluster_r0").alias("sub_id"), F.concat(F.lit("c"), "c_custkey").alias("name"))
    return mutate.add_members(members.select("name").distinct(), members, new)[1]


@query("collapse_subgraphs", f"WITH {G5} SELECT sub_id || '_cmp' AS compound, sub_id FROM subs")
def collapse_subgraphs(spark, sf):
    subs, members = views.hierarchy(spark, sf)
    none = subs.select(F.lit("").alias("compound"), "sub_id").limit(0)  # no compounds yet
    return mutate.collapse(members.select("name").distinct(), none, subs)[1]


@query("hide_stack", f"""WITH {G5}, {CS} SELECT x.sub_id AS tail, y.sub_id AS head, tail AS orig_tail, head AS orig_head, x.sub_id = y.sub_id AS hidden
 FROM cs JOIN members x ON tail = x.name JOIN members y ON head = y.name WHERE x.sub_id <> y.sub_id UNION ALL SELECT tail, head, tail, head, true
 FROM cs JOIN members x ON tail = x.name JOIN members y ON head = y.name WHERE x.sub_id = y.sub_id""")
def hide_stack(spark, sf):
    members = views.hierarchy(spark, sf)[1].select("name", F.col("sub_id").alias("compound"))
    e = mutate.hide_stacked(views.customer_supplier(spark, sf), members)
    return e.select("tail", "head", F.col("undo")[0]["tail"].alias("orig_tail"), F.col("undo")[0]["head"].alias("orig_head"), (F.col("hidden") > 0).alias("hidden"))


@query("expose_stack", f"""WITH {G5}, {CS} SELECT CASE WHEN x.sub_id <> y.sub_id THEN x.sub_id ELSE tail END AS tail, CASE WHEN x.sub_id <> y.sub_id THEN y.sub_id ELSE head END AS head, 1 AS depth
 FROM cs JOIN members x ON tail = x.name JOIN members y ON head = y.name""")
def expose_stack(spark, sf):
    """Nations are hidden, then regions, and the regions shown again."""
    subs, members = views.hierarchy(spark, sf)
    nations = mutate.hide_stacked(views.customer_supplier(spark, sf), members.select("name", F.col("sub_id").alias("compound")))
    regions = mutate.hide_stacked(nations, subs.where("depth = 2").select(F.col("sub_id").alias("name"), F.col("parent_sub").alias("compound")))
    return mutate.expose_stacked(regions).select("tail", "head", F.size("undo").alias("depth"))


@query("apply_images", f"WITH {G5}, i AS (SELECT name, sub_id, 2 AS depth FROM members UNION ALL SELECT name, parent_sub, 1 FROM members JOIN subs USING (sub_id)) SELECT name, sub_id, row_number() OVER (PARTITION BY name ORDER BY depth DESC, sub_id) AS step FROM i")
def apply_images(spark, sf):
    return mutate.apply_images(*views.hierarchy(spark, sf), before=False)


_CLUSTERS = "m AS (SELECT 'cluster_' || p_brand AS sub_id, p_partkey AS name, (p_partkey * 37 % 1009)::DOUBLE AS x, (p_partkey * 53 % 997)::DOUBLE AS y FROM part WHERE p_size <= 2), bx AS (SELECT sub_id, min(x) AS llx, min(y) AS lly, min(x) + 60 AS urx, min(y) + 40 AS ury FROM m GROUP BY 1)"


@query("edge_cluster_crossings", f"""WITH {G4}, {_POS}, {_CLUSTERS}, h AS (SELECT tail, head, sub_id, [((bx_ - ax) * (c.y - ay) - (by_ - ay) * (c.x - ax)) FOR c IN [{{'x': llx, 'y': lly}}, {{'x': llx, 'y': ury}}, {{'x': urx, 'y': lly}}, {{'x': urx, 'y': ury}}]] AS s
 FROM (SELECT tail, head, ax, ay, bx AS bx_, by_ FROM pos) JOIN bx ON greatest(ax, bx_) >= llx AND least(ax, bx_) <= urx AND greatest(ay, by_) >= lly AND least(ay, by_) <= ury)
SELECT tail, head, sub_id FROM h WHERE list_min(s) <= 0 AND list_max(s) >= 0 AND NOT EXISTS (SELECT 1 FROM m WHERE m.sub_id = h.sub_id AND m.name IN (tail, head))""")
def edge_cluster_crossings(spark, sf):
    k = F.col("p_partkey")
    m = views.table(spark, sf, "part").where("p_size <= 2").select(F.concat(F.lit("cluster_"), "p_brand").alias("sub_id"), k.alias("name"), (k * 37 % 1009).cast("double").alias("x"), (k * 53 % 997).cast("double").alias("y"))
    boxes = m.groupBy("sub_id").agg(F.min("x").alias("llx"), F.min("y").alias("lly"), (F.min("x") + 60).alias("urx"), (F.min("y") + 40).alias("ury"))
    return spatial.cluster_crossings(_segments(spark, sf), boxes, m.select("sub_id", "name"))


def _attributed(spark, sf):
    """Nations as nodes of their region's graph, with attributes; each leads to the next of its region."""
    n = views.table(spark, sf, "nation")
    nodes = n.select(F.col("n_regionkey").alias("g"), F.col("n_name").alias("name"), F.create_map(F.lit("key"), F.col("n_nationkey").cast("string"), F.lit("label"), F.concat(F.lit('the "'), "n_name", F.lit('" <&>')), F.lit("odd"), (F.col("n_nationkey") % 2 == 1).cast("string")).alias("attrs"))
    from pyspark.sql import Window

    w = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    edges = n.select(F.col("n_regionkey").alias("g"), F.col("n_name").alias("tail"), F.lead("n_name").over(w).alias("head"), F.create_map(F.lit("w"), (F.col("n_nationkey") / 4).cast("string")).alias("attrs")).where("head IS NOT NULL")
    return nodes, edges


_WANT = "SELECT n_regionkey AS g, n_name AS name, n_nationkey::VARCHAR AS key, 'the \"' || n_name || '\" <&>' AS label, CASE WHEN n_nationkey % 2 = 1 THEN 'true' ELSE 'false' END AS odd FROM nation"


@query("json_attributes", _WANT)
def json_attributes(spark, sf):
    nodes, edges = _attributed(spark, sf)
    n, _, _ = exchange.read_json_attrs(exchange.write_json(nodes, edges, "g"), "g", "json")
    return n.select("g", "name", F.col("attrs")["key"].alias("key"), F.col("attrs")["label"].alias("label"), F.col("attrs")["odd"].alias("odd"))


@query("json_edge_attributes", "SELECT g, tail, head, (k / 4)::VARCHAR AS w FROM (SELECT n_regionkey AS g, n_name AS tail, lead(n_name) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS head, n_nationkey AS k FROM nation) WHERE head IS NOT NULL")
def json_edge_attributes(spark, sf):
    nodes, edges = _attributed(spark, sf)
    _, e, _ = exchange.read_json_attrs(exchange.write_json(nodes, edges, "g"), "g", "json")
    return e.select("g", "tail", "head", F.col("attrs")["w"].alias("w"))


@query("json_objects", f"WITH {G5} SELECT 'G' AS g, sub_id AS sub, name FROM members WHERE name LIKE 's%'")
def json_objects(spark, sf):
    members = views.hierarchy(spark, sf)[1].where("name LIKE 's%'").select(F.lit("G").alias("g"), F.col("sub_id").alias("sub"), "name")
    nodes = members.select("g", "name").distinct()
    none = nodes.select("g", F.col("name").alias("tail"), F.col("name").alias("head")).limit(0)  # no edges
    return exchange.read_json_attrs(exchange.write_json(nodes, none, "g", members=members), "g", "json")[2].select("g", "sub", "name")


@query("gxl_attributes", _WANT)
def gxl_attributes(spark, sf):
    rows = exchange.gxl_rows(exchange.write_gxl(*_attributed(spark, sf), "g"), "g", "xml").where("kind = 'node'")
    return rows.select(F.col("file").cast("int").alias("g"), "name", F.col("attrs")["key"].alias("key"), F.col("attrs")["label"].alias("label"), F.col("attrs")["odd"].alias("odd"))


@query("dot_attributes", _WANT)
def dot_attributes(spark, sf):
    """Written, read, made canonical and read again."""
    text = dot.write(*_attributed(spark, sf), "g")
    rows = dot.parse_texts(dot.canonicalize(text, "g", "text"), "file", "text").where("kind = 'node'")
    return rows.select(F.col("file").cast("int").alias("g"), "name", F.col("attrs")["key"].alias("key"), F.col("attrs")["label"].alias("label"), F.col("attrs")["odd"].alias("odd"))


@query("dot_problems", "SELECT event_id::VARCHAR AS file, 'unmatched }' AS problem FROM events WHERE event_id % 5 = 0")
def dot_problems(spark, sf):
    """A graph text per event, every fifth with a brace too many."""
    e = views.table(spark, sf, "events")
    text = F.concat(F.lit("digraph { "), "event_type", F.lit(" -> user"), F.col("user_id").cast("string"), F.lit("; }"), F.when(F.col("event_id") % 5 == 0, "}").otherwise(""))
    return dot.validate(e.select("event_id", text.alias("text")), "event_id", "text")
