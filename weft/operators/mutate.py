"""Graph mutation as rewrites of the node, edge and member tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def add_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """Find-or-insert by name."""
    return nodes.unionByName(new.join(nodes.select("name"), "name", "left_anti").select(*nodes.columns))


def add_edges(edges: DataFrame, new: DataFrame, strict: bool = False, no_loop: bool = False) -> DataFrame:
    """Insert edges; strict refuses loops and second edges of a pair, no_loop refuses loops."""
    if strict:
        new = new.where("tail <> head").dropDuplicates(["tail", "head"]).join(edges.select("tail", "head"), ["tail", "head"], "left_anti")
    elif no_loop:
        new = new.where("tail <> head")
    return edges.unionByName(new.select(*edges.columns))


def delete_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Delete nodes and every edge at them."""
    g = gone.select("name").distinct()
    left = edges.join(g.withColumnRenamed("name", "tail"), "tail", "left_anti").join(g.withColumnRenamed("name", "head"), "head", "left_anti")
    return nodes.join(g, "name", "left_anti"), left


def delete_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone.select("tail", "head"), ["tail", "head"], "left_anti")


def delete_subgraph(subs: DataFrame, members: DataFrame, sub_id: str) -> tuple[DataFrame, DataFrame]:
    """Delete a subgraph with all below it; nodes stay in the graph."""
    left = subs.where(~F.array_contains("path", sub_id))
    return left, members.join(left.select("sub_id"), "sub_id", "left_semi")


def relabel(nodes: DataFrame, edges: DataFrame, names: DataFrame, refuse: bool = True) -> tuple[DataFrame, DataFrame]:
    """Rename nodes by (name, new_name); a name already taken is refused (the old one stays), or, without ``refuse``,
    given all the same (both nodes then bear it)."""
    free = names.join(nodes.select(F.col("name").alias("new_name")), "new_name", "left_anti") if refuse else names
    to = lambda col: free.select(F.col("name").alias(col), F.col("new_name").alias(f"new_{col}"))
    n = nodes.join(free, "name", "left").withColumn("name", F.coalesce("new_name", "name")).drop("new_name")
    e = edges.join(to("tail"), "tail", "left").join(to("head"), "head", "left")
    e = e.withColumn("tail", F.coalesce("new_tail", "tail")).withColumn("head", F.coalesce("new_head", "head"))
    return n, e.select(*edges.columns)


def splice(edges: DataFrame, moves: DataFrame, end: str = "head") -> DataFrame:
    """Move the given end of the edges listed in moves(tail, head, to)."""
    moved = edges.join(moves, ["tail", "head"], "left")
    return moved.withColumn(end, F.coalesce("to", end)).select(*edges.columns)


def hide(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Collapse subgraphs into compound nodes: members(name, compound). Boundary edges go to the compound,
    inner edges vanish; (orig_tail, orig_head) undo it."""
    m = lambda col: members.select(F.col("name").alias(col), F.col("compound").alias(f"c_{col}"))
    e = edges.join(m("tail"), "tail", "left").join(m("head"), "head", "left")
    e = e.where("c_tail IS NULL OR c_head IS NULL OR c_tail <> c_head")
    return e.select(F.coalesce("c_tail", "tail").alias("tail"), F.coalesce("c_head", "head").alias("head"), F.col("tail").alias("orig_tail"), F.col("head").alias("orig_head"))


def expose(hidden: DataFrame, edges: DataFrame, members: DataFrame) -> DataFrame:
    """Undo ``hide``: boundary edges from their saved ends, inner edges from the original table."""
    back = hidden.select(F.col("orig_tail").alias("tail"), F.col("orig_head").alias("head"))
    m = lambda col: members.select(F.col("name").alias(col), F.col("compound").alias(f"c_{col}"))
    inner = edges.join(m("tail"), "tail").join(m("head"), "head").where("c_tail = c_head").select("tail", "head")
    return back.unionByName(inner)


def add_subgraphs(subs: DataFrame, new: DataFrame) -> DataFrame:
    """Find-or-create: subs (sub_id, parent_sub, depth, path), new (sub_id, parent_sub); a parent must exist, one that is
    null is the root."""
    fresh = new.join(subs.select("sub_id"), "sub_id", "left_anti").dropDuplicates(["sub_id"])
    up = subs.select(F.col("sub_id").alias("parent_sub"), F.col("depth").alias("d"), F.col("path").alias("p"))
    placed = fresh.join(up, "parent_sub", "left").where("parent_sub IS NULL OR p IS NOT NULL")
    path = F.concat(F.coalesce("p", F.array().cast("array<string>")), F.array("sub_id"))
    made = placed.withColumn("depth", F.coalesce("d", F.lit(0)) + 1).withColumn("path", path)
    return subs.unionByName(made.drop("d", "p"), allowMissingColumns=True)


def add_members(nodes: DataFrame, members: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Insert new (sub_id, name) as members; a node that is not there yet is created."""
    m = members.unionByName(new.select("sub_id", "name").distinct().join(members, ["sub_id", "name"], "left_anti"))
    return add_nodes(nodes, new.select("name").distinct()), m


def make_compound(nodes: DataFrame, members: DataFrame, subs: DataFrame, compounds: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tie nodes to subgraphs by new (compound, sub_id): (nodes, subgraphs, compounds). Nodes and subgraphs are created
    where missing; a node or subgraph that is tied already keeps its partner."""
    free = new.join(compounds.select("compound"), "compound", "left_anti").join(compounds.select("sub_id"), "sub_id", "left_anti")
    free = free.dropDuplicates(["compound"]).dropDuplicates(["sub_id"])
    grown = add_subgraphs(subs, free.select("sub_id", F.lit(None).cast("string").alias("parent_sub")))
    return add_nodes(nodes, free.select(F.col("compound").alias("name"))), grown, compounds.unionByName(free.select("compound", "sub_id"))


def collapse(nodes: DataFrame, compounds: DataFrame, subs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A compound node ``<subgraph>_cmp`` for every subgraph without one: (nodes, compounds). No edge moves."""
    new = subs.join(compounds.select("sub_id"), "sub_id", "left_anti").select(F.concat("sub_id", F.lit("_cmp")).alias("compound"), "sub_id")
    return add_nodes(nodes, new.select(F.col("compound").alias("name"))), compounds.unionByName(new)


def hide_stacked(edges: DataFrame, members: DataFrame) -> DataFrame:
    """``hide`` with an undo stack: edges (tail, head, ..., undo array<struct<tail, head>>); each call pushes the ends it
    moves, so nested subgraphs can be hidden from the inside out. Inner edges stay, marked by ``hidden`` = their level."""
    if "undo" not in edges.columns:
        ends = f"array<struct<tail:{edges.schema['tail'].dataType.simpleString()},head:{edges.schema['head'].dataType.simpleString()}>>"
        edges = edges.withColumn("undo", F.array().cast(ends)).withColumn("hidden", F.lit(0))
    m = lambda col: members.select(F.col("name").alias(col), F.col("compound").alias(f"c_{col}"))
    e = edges.join(m("tail"), "tail", "left").join(m("head"), "head", "left")
    shown = F.col("hidden") == 0
    e = e.withColumn("undo", F.concat("undo", F.array(F.struct("tail", "head"))))
    inner = shown & F.col("c_tail").isNotNull() & (F.col("c_tail") == F.col("c_head"))
    e = e.withColumn("hidden", F.when(inner, F.size("undo")).otherwise(F.col("hidden")))
    move = lambda col: F.when(shown & ~F.coalesce(inner, F.lit(False)), F.coalesce(f"c_{col}", col)).otherwise(F.col(col))
    return e.withColumn("tail", move("tail")).withColumn("head", move("head")).select(*edges.columns)


def expose_stacked(edges: DataFrame) -> DataFrame:
    """Undo the last ``hide_stacked``: every edge takes back the ends on top of its stack."""
    top = F.element_at("undo", -1)
    back = edges.withColumn("tail", F.when(F.size("undo") > 0, top["tail"]).otherwise(F.col("tail"))).withColumn("head", F.when(F.size("undo") > 0, top["head"]).otherwise(F.col("head")))
    back = back.withColumn("hidden", F.when(F.col("hidden") == F.size("undo"), 0).otherwise(F.col("hidden")))
    return back.withColumn("undo", F.when(F.size("undo") > 0, F.slice("undo", F.lit(1), F.size("undo") - 1)).otherwise(F.col("undo")))


def apply_images(subs: DataFrame, members: DataFrame, before: bool = True) -> DataFrame:
    """(name, sub_id, step): the images of a node in the order a callback sees them, outermost first (``before``) or
    innermost first."""
    from pyspark.sql import Window

    held = members.join(subs.select("sub_id", "path"), "sub_id").select("name", F.explode("path").alias("sub_id")).distinct().join(subs.select("sub_id", "depth"), "sub_id")
    order = F.col("depth") if before else F.desc("depth")
    return held.select("name", "sub_id", F.row_number().over(Window.partitionBy("name").orderBy(order, "sub_id")).cast("long").alias("step"))
