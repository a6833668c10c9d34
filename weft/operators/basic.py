"""Counts, degrees, lookups and joins over (name) nodes and (tail, head) edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def half_edges(edges: DataFrame) -> DataFrame:
    """(name, other, kind): every edge once from its tail ('out') and once from its head ('in')."""
    out = edges.select(F.col("tail").alias("name"), F.col("head").alias("other"), F.lit("out").alias("kind"))
    return out.unionByName(edges.select(F.col("head").alias("name"), F.col("tail").alias("other"), F.lit("in").alias("kind")))


def degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, in_degree, out_degree, degree); a self-loop counts on both sides, isolated nodes have 0."""
    counts = half_edges(edges).groupBy("name").agg(F.count_if(F.col("kind") == "in").alias("in_degree"), F.count_if(F.col("kind") == "out").alias("out_degree"))
    d = nodes.select("name").join(counts, "name", "left").fillna(0, ["in_degree", "out_degree"])
    return d.withColumn("degree", F.col("in_degree") + F.col("out_degree"))


def unique_degree(nodes: DataFrame, edges: DataFrame, edge_id: str) -> DataFrame:
    """Distinct incident edges; a self-loop counts once."""
    ends = edges.select(F.explode(F.array_distinct(F.array("tail", "head"))).alias("name"), F.col(edge_id).alias("e")).groupBy("name").agg(F.count_distinct("e").alias("n_edges"))
    return nodes.select("name").join(ends, "name", "left").fillna(0, ["n_edges"])


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(half_edges(edges).select("name").distinct(), "name", "left_anti")


def without_isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(half_edges(edges).select("name").distinct(), "name", "left_semi")


def strict(edges: DataFrame, seq: str) -> DataFrame:
    """Strict reading of a multigraph: no self-loops, the first edge of each (tail, head)."""
    return edges.where("tail <> head").groupBy("tail", "head").agg(F.min(seq).alias(seq))


def edge_keys(edges: DataFrame, seq: str) -> DataFrame:
    """Keys of parallel edges: none for the first of a (tail, head), then _e1, _e2, ... in order."""
    n = F.row_number().over(Window.partitionBy("tail", "head").orderBy(seq)) - 1
    return edges.withColumn("ekey", F.when(n > 0, F.concat(F.lit("_e"), n.cast("string"))))


def adjacent(edges: DataFrame, order: Column) -> DataFrame:
    """Out-edges with their neighbours in the walk: (tail, head, prev_head, next_head)."""
    w = Window.partitionBy("tail").orderBy(order)
    return edges.select("tail", "head", F.lag("head").over(w).alias("prev_head"), F.lead("head").over(w).alias("next_head"))


def endpoints_joined(edges: DataFrame, nodes: DataFrame, columns: list[str]) -> DataFrame:
    t = nodes.select(F.col("name").alias("tail"), *[F.col(c).alias(f"tail_{c}") for c in columns])
    h = nodes.select(F.col("name").alias("head"), *[F.col(c).alias(f"head_{c}") for c in columns])
    return edges.join(t, "tail").join(h, "head")


def induced(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges with both ends among members(name)."""
    m = members.select("name").distinct()
    return edges.join(m.withColumnRenamed("name", "tail"), "tail", "left_semi").join(m.withColumnRenamed("name", "head"), "head", "left_semi")


def lowest_common(pairs: DataFrame, subs: DataFrame, members: DataFrame) -> DataFrame:
    """For (tail, head): the deepest subgraph holding both (null: the root)."""
    home = members.join(subs.select("sub_id", "path"), "sub_id").select("name", "path")
    t, h = home.select(F.col("name").alias("tail"), F.col("path").alias("pt")), home.select(F.col("name").alias("head"), F.col("path").alias("ph"))
    both = F.array_intersect("pt", "ph")
    return pairs.join(t, "tail").join(h, "head").select("tail", "head", F.when(F.size(both) > 0, F.element_at(both, -1)).alias("owner_sub"))


def local_members(subs: DataFrame, members: DataFrame) -> DataFrame:
    """Members of a subgraph that no child subgraph holds: every (ancestor, name) less the child's."""
    up = members.join(subs.select("sub_id", "path"), "sub_id").select(F.explode("path").alias("sub_id"), "name").distinct()
    below = up.join(subs.select("sub_id", "parent_sub"), "sub_id").select(F.col("parent_sub").alias("sub_id"), "name").distinct()
    return up.join(below, ["sub_id", "name"], "left_anti")


def cluster_counts(subs: DataFrame) -> DataFrame:
    """Per subgraph: direct children and all clusters below it."""
    below = subs.select(F.explode("path").alias("top"), "sub_id", "is_cluster", "parent_sub").where("top <> sub_id")
    n = below.groupBy(F.col("top").alias("sub_id")).agg(F.count_if(F.col("parent_sub") == F.col("top")).alias("children"), F.count_if("is_cluster").alias("clusters"))
    return subs.select("sub_id").join(n, "sub_id", "left").fillna(0, ["children", "clusters"])


def resolve_attr(own: Column, *defaults: Column) -> Column:
    """Attribute lookup: own value, else the defaults in order."""
    return F.coalesce(own, *defaults)


def set_missing(attrs: Column, extra: dict[str, str]) -> Column:
    """Override that fills only missing keys of an attribute map."""
    given = F.create_map(*[F.lit(x) for kv in extra.items() for x in kv])
    return F.map_concat(F.map_filter(given, lambda k, _: ~F.map_contains_key(attrs, k)), attrs)


def shown(attrs: Column) -> Column:
    """Attributes a writer emits: not empty, not private (leading underscore)."""
    return F.map_filter(attrs, lambda k, v: (v != "") & ~k.startswith("_"))


#: Types of the attributes that nodes and edges are read by; all others are text.
ATTR_TYPES = {
    "width": "double", "height": "double", "fontsize": "double", "penwidth": "double", "minlen": "double", "arrowsize": "double", "len": "double",
    "weight": "int", "peripheries": "int", "sides": "int", "rank": "int",
    "fixedsize": "boolean", "pin": "boolean", "constraint": "boolean", "regular": "boolean",
}


def typed(attrs: Column, names: list[str], defaults: dict[str, str] | None = None) -> list[Column]:
    """One column per attribute, cast to its type; a missing one takes its default, text that does not fit is null."""
    out = []
    for name in names:
        value = attrs[name]
        if defaults and name in defaults:
            value = F.coalesce(value, F.lit(defaults[name]))
        out.append(value.try_cast(ATTR_TYPES[name]).alias(name) if name in ATTR_TYPES else value.alias(name))
    return out


def object_kinds(names: DataFrame, nodes: DataFrame, subs: DataFrame) -> DataFrame:
    """(name, kind): what names(name) stand for - node, subgraph or nothing (null)."""
    kinds = nodes.select("name", F.lit("node").alias("kind")).unionByName(subs.select(F.col("sub_id").alias("name"), F.lit("subgraph").alias("kind")))
    return names.select("name").join(kinds, "name", "left")


def contains(pairs: DataFrame, subs: DataFrame, members: DataFrame) -> DataFrame:
    """(sub_id, name, held, direct) of pairs(sub_id, name): whether the subgraph holds the node, itself or below it."""
    held = members.join(subs.select("sub_id", "path"), "sub_id").select(F.explode("path").alias("sub_id"), "name", F.element_at("path", -1).alias("home"))
    held = held.groupBy("sub_id", "name").agg(F.bool_or(F.col("sub_id") == F.col("home")).alias("direct"), F.lit(True).alias("held"))
    return pairs.join(held, ["sub_id", "name"], "left").select("sub_id", "name", F.coalesce("held", F.lit(False)).alias("held"), F.coalesce("direct", F.lit(False)).alias("direct"))


def parents(subs: DataFrame, root: str) -> DataFrame:
    """(sub_id, parent, root): the enclosing subgraph (the root's name where there is none) and the root."""
    return subs.select("sub_id", F.coalesce("parent_sub", F.lit(root)).alias("parent"), F.lit(root).alias("root"))


def before(pairs: DataFrame, order: DataFrame) -> DataFrame:
    """(a, b, before): whether node a was inserted before b, by order(name, seq)."""
    at = lambda c: order.select(F.col("name").alias(c), F.col("seq").alias(f"seq_{c}"))
    return pairs.join(at("a"), "a").join(at("b"), "b").select("a", "b", (F.col("seq_a") < F.col("seq_b")).alias("before"))


def one_home(subs: DataFrame, members: DataFrame) -> DataFrame:
    """Members with one subgraph a node: the deepest, then the first by name; the others are dropped."""
    w = Window.partitionBy("name").orderBy(F.desc("depth"), "sub_id")
    return members.join(subs.select("sub_id", "depth"), "sub_id").withColumn("k", F.row_number().over(w)).where("k = 1").select("sub_id", "name")
