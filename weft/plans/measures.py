"""Queries: block-cut tree, resistance distances, pivots and cycles of the co-purchase graph's components."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weft.operators import kernels, measures
from weft.plans.graph import _g4
from weft.plans.sqlviews import G4
from weft.registry import query


@query("block_cut_tree")
def block_cut_tree(spark, sf):
    """(component, block, name): each cut node with every block that holds it."""

    def run(names, pairs):
        return [{"component": names[0], "block": k, "name": n} for k, n in kernels.biconnected(names, pairs)]

    blocks = kernels.per_component(*_g4(spark, sf), run, "component long, block long, name long")
    held = F.count("*").over(Window.partitionBy("name"))
    return blocks.withColumn("held", held).where("held > 1").drop("held")


@query("circuit_distances")
def circuit_distances(spark, sf):
    def run(names, pairs):
        return [{"a": a, "b": b, "dist": d} for a, b, d in measures.circuit_distances(names, pairs)]

    return kernels.per_component(*_g4(spark, sf), run, "a long, b long, dist double").withColumn("dist", F.round("dist", 6))


@query("pivots")
def pivots(spark, sf):
    """Up to five pivots per component."""

    def run(names, pairs):
        return [{"component": names[0], "k": k, "name": n} for k, n in measures.pivots(names, pairs, 5)]

    return kernels.per_component(*_g4(spark, sf), run, "component long, k long, name long")


@query("simple_cycles", f"""WITH RECURSIVE {G4}, w(start, via, last) AS (SELECT tail, [tail], tail FROM (SELECT DISTINCT tail FROM g4) UNION ALL
 SELECT w.start, list_append(w.via, g4.head), g4.head FROM w JOIN g4 ON w.last = g4.tail WHERE g4.head > w.start AND NOT list_contains(w.via, g4.head) AND len(w.via) < 6)
SELECT w.start, len(via)::BIGINT AS n_nodes, array_to_string(via, '>') AS cycle FROM w JOIN g4 ON g4.tail = w.last AND g4.head = w.start""")
def simple_cycles(spark, sf):
    """Directed cycles of up to six nodes."""

    def run(names, pairs):
        return [{"start": c[0], "n_nodes": len(c), "cycle": ">".join(map(str, c))} for c in measures.simple_cycles(names, pairs, 6)]

    return kernels.per_component(*_g4(spark, sf), run, "start long, n_nodes long, cycle string")
