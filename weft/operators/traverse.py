"""Fixpoints: components, distances, reachability, strong components, levels, transitive reduction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.iterate import components, release, stage


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, component): the smallest name reachable ignoring direction; isolated nodes are their own."""
    found = components(edges.select(F.col("tail").alias("a"), F.col("head").alias("b"))).withColumnRenamed("id", "name")
    return nodes.select("name").join(found, "name", "left").select("name", F.coalesce("component", "name").alias("component"))


def distances(edges: DataFrame, weight: str | None = None) -> DataFrame:
    """All-pairs shortest distances (src, dst, dist), dist > 0 by at least one edge, by min-plus doubling:
    rounds are logarithmic in the longest shortest path."""
    w = F.col(weight) if weight else F.lit(1).cast("long")
    cur = stage(edges.where("tail <> head").groupBy(F.col("tail").alias("src"), F.col("head").alias("dst")).agg(F.min(w).alias("dist")), "dist")
    before = None
    while True:
        now = cur.agg(F.count("*"), F.sum("dist")).first()
        if now == before:
            return cur
        before = now
        on = cur.select(F.col("src").alias("dst"), F.col("dst").alias("far"), F.col("dist").alias("more"))
        longer = cur.join(on, "dst").where("src <> far").select("src", F.col("far").alias("dst"), (F.col("dist") + F.col("more")).alias("dist"))
        cur = stage(cur.unionByName(longer).groupBy("src", "dst").agg(F.min("dist").alias("dist")), "dist")


def bfs(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(name, dist): hops from the nearest of sources(name). One staged table of what is seen; a round joins only
    its outermost ring with the edges."""
    seen = stage(sources.select("name", F.lit(0).cast("long").alias("dist")).distinct(), "bfs")
    out = stage(edges.where("tail <> head").select(F.col("tail").alias("name"), "head").distinct(), "bfs-edges")
    hops = 0
    while True:
        ring = seen.where(F.col("dist") == hops).select("name")
        if ring.isEmpty():
            release(out)
            return seen
        step = ring.join(out, "name").select(F.col("head").alias("name"), F.lit(hops + 1).cast("long").alias("dist"))
        old, seen = seen, stage(seen.unionByName(step).groupBy("name").agg(F.min("dist").alias("dist")), "bfs")
        release(old)
        hops += 1


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, scc): the smallest name that reaches the node and is reached by it.

    Forward-backward colouring: every node takes the smallest name that reaches it (its colour); within a colour, the
    nodes that reach the colour's own node are one strong component and leave; edges between colours never lie
    inside a component and are dropped. Tables are linear in nodes and edges; no closure is built."""
    live = stage(edges.where("tail <> head").select("tail", "head").distinct(), "scc")
    done = None
    while True:
        # what has no edge in or no edge out is alone: only cores go on
        while True:
            core = live.join(live.select(F.col("head").alias("tail")).distinct(), "tail", "left_semi").join(live.select(F.col("tail").alias("head")).distinct(), "head", "left_semi")
            core = stage(core.select("tail", "head"), "scc")
            same = core.count() == live.count()
            release(live)
            live = core
            if same:
                break
        if live.isEmpty():
            break
        names = live.select(F.col("tail").alias("name")).distinct()
        colour = _spread(names.select("name", F.col("name").alias("c")), live.select("tail", "head"))
        at = lambda end, to: colour.select(F.col("name").alias(end), F.col("c").alias(to))
        inside = stage(live.join(at("tail", "c"), "tail").join(at("head", "ch"), "head").where("c = ch").select("tail", "head", "c"), "scc")
        # backwards from each colour's own node, inside the colour
        back = _reach(colour.where("name = c"), inside.select(F.col("head").alias("tail"), F.col("tail").alias("head")))
        found = stage(back.select("name", F.col("c").alias("scc")), "scc-done")
        release(back)
        rest = inside.join(found.select(F.col("name").alias("tail")), "tail", "left_anti").join(found.select(F.col("name").alias("head")), "head", "left_anti")
        old, live = live, stage(rest.select("tail", "head"), "scc")
        release(old, inside, colour)
        done = found if done is None else done.unionByName(found)
    if done is None:
        return nodes.select("name", F.col("name").alias("scc"))
    return nodes.select("name").join(done, "name", "left").select("name", F.coalesce("scc", "name").alias("scc"))


def _spread(start: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, c): the smallest c of start(name, c) that reaches the name; only labels just lowered travel."""
    cur = stage(start.withColumn("fresh", F.lit(True)), "spread")
    while True:
        heard = cur.where("fresh").join(edges, F.col("name") == F.col("tail")).groupBy(F.col("head").alias("name")).agg(F.min("c").alias("h"))
        nxt = cur.join(heard, "name", "left").select("name", F.least("c", F.coalesce("h", "c")).alias("c"), (F.coalesce("h", "c") < F.col("c")).alias("fresh"))
        old, cur = cur, stage(nxt, "spread")
        release(old)
        if cur.where("fresh").isEmpty():
            return cur


def _reach(start: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, c): every name that edges reach from start(name, c), by rounds over the newest names."""
    seen = stage(start.select("name", "c", F.lit(0).alias("k")), "reach")
    k = 0
    while True:
        step = seen.where(F.col("k") == k).join(edges, F.col("name") == F.col("tail")).select(F.col("head").alias("name"), "c", F.lit(k + 1).alias("k"))
        if step.isEmpty():
            return seen
        old, seen = seen, stage(seen.unionByName(step).groupBy("name", "c").agg(F.min("k").alias("k")), "reach")
        release(old)
        k += 1


def topo_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, level): longest path from a source of a DAG; one round per level."""
    cur = stage(nodes.select("name", F.lit(0).cast("long").alias("level")), "level")
    e = edges.select("tail", "head").distinct()
    while True:
        up = e.join(cur.select(F.col("name").alias("tail"), "level"), "tail").groupBy(F.col("head").alias("name")).agg((F.max("level") + 1).alias("l"))
        nxt = stage(cur.join(up, "name", "left").select("name", F.greatest("level", F.coalesce("l", "level")).alias("level"), (F.col("l") > F.col("level")).alias("moved")), "level")
        release(cur)
        cur = nxt
        if cur.where("moved").isEmpty():
            return cur.select("name", "level")


def transitive_reduction(edges: DataFrame) -> DataFrame:
    """Edges of a DAG that no longer path implies. An edge is under test while some path from its tail may still
    reach its head: paths advance one edge a round, carry their tail, and stop beyond the topological level of the
    furthest head under test, so what is held is the paths' (tail, end) pairs inside those levels, never the closure."""
    e = stage(edges.where("tail <> head").select("tail", "head").distinct(), "tred")
    names = e.select(F.col("tail").alias("name")).unionByName(e.select(F.col("head").alias("name"))).distinct()
    level = stage(topo_levels(names, e), "tred-levels")
    at = lambda end, to: level.select(F.col("name").alias(end), F.col("level").alias(to))
    e = stage(e.join(at("tail", "lt"), "tail").join(at("head", "lh"), "head"), "tred")
    # an edge to the next level has no way round; a tail with one out-edge has none, either
    wide = e.groupBy("tail").agg(F.max("lh").alias("far"), F.count("*").alias("outs")).where("outs > 1").select("tail", "far")
    open_ = e.join(wide, "tail").where("lh > lt + 1").groupBy("tail").agg(F.max("lh").alias("far"))
    front = stage(e.join(open_, "tail").where("lh < far").select("tail", "far", F.col("head").alias("end")), "tred-front")
    implied = None
    while not front.isEmpty():
        step = front.join(e.select(F.col("tail").alias("end"), F.col("head").alias("next"), "lh"), "end").where("lh <= far")
        nxt = stage(step.select("tail", "far", F.col("next").alias("end")).distinct(), "tred-front")
        hit = stage(nxt.select("tail", F.col("end").alias("head")).join(e.select("tail", "head"), ["tail", "head"], "left_semi"), "tred-hit")
        implied = hit if implied is None else implied.unionByName(hit)
        release(front)
        front = nxt
    kept = e.select("tail", "head")
    return kept if implied is None else kept.join(implied, ["tail", "head"], "left_anti")


def component_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(component, n_nodes, n_edges, isolated, members): members are the first ten in order."""
    comp = stage(connected_components(nodes, edges), "comp")
    n = comp.groupBy("component").agg(F.count("*").alias("n_nodes"))
    m = edges.join(comp.select(F.col("name").alias("tail"), "component"), "tail").groupBy("component").agg(F.count("*").alias("n_edges"))
    first = comp.withColumn("k", F.row_number().over(Window.partitionBy("component").orderBy("name"))).where("k <= 10")
    first = first.groupBy("component").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "name"))), lambda s: s["name"].cast("string")), ",").alias("members"))
    out = n.join(m, "component", "left").join(first, "component").fillna(0, ["n_edges"])
    return out.withColumn("isolated", F.col("n_nodes") == 1)


def degree_centrality(degrees: DataFrame, n: int) -> DataFrame:
    return degrees.select("name", "degree", F.when(F.lit(n) > 1, F.col("degree") / F.lit(max(n - 1, 1))).otherwise(0.0).alias("centrality"))


def closeness(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, closeness): (n - 1) / sum of directed distances to what is reached; 0 if nothing is."""
    n = nodes.count()
    s = distances(edges).groupBy(F.col("src").alias("name")).agg(F.sum("dist").alias("s"))
    return nodes.select("name").join(s, "name", "left").select("name", F.coalesce(F.lit(float(n - 1)) / F.col("s"), F.lit(0.0)).alias("closeness"))


def unflatten(edges: DataFrame, cap: int = 0, fans: bool = False) -> DataFrame:
    """(tail, head, minlen): out-edges of nodes with in-edges and more than one out-edge grow by one, capped."""
    outs = edges.groupBy(F.col("tail").alias("tail")).agg(F.count("*").alias("outs"))
    ins = edges.select(F.col("head").alias("tail")).distinct().withColumn("has_in", F.lit(True))
    e = edges.join(outs, "tail").join(ins, "tail", "left")
    grown = F.col("minlen") + 1
    grown = F.least(grown, F.lit(cap)) if cap > 0 else grown
    many = F.lit(True) if fans else F.col("outs") > 1
    return e.select("tail", "head", F.when(many & F.col("has_in"), grown).otherwise(F.col("minlen")).alias("minlen"))
