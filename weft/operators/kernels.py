"""Order-dependent graph algorithms, one component (or one graph) per task.

Each kernel is a function of one group's pandas table; ``per_component`` runs it over components, which is
the unit of parallelism, so a component must fit a task.
"""

from __future__ import annotations

from itertools import groupby
from operator import itemgetter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from weft.operators.traverse import connected_components

BATCH = 10_000  # rows handed on at once


def per_component(nodes: DataFrame, edges: DataFrame, kernel, schema: str) -> DataFrame:
    """Run ``kernel(names, pairs)`` (sorted list of nodes; edges sorted by tail, head) per connected component.

    Components are dealt by number to a fixed count of tasks, which adaptive execution does not merge however small the
    table is, as the kernels' work has nothing to do with its bytes. A task reads its components one after the other
    from a sorted stream and hands their rows on in batches, so many small ones cost no group each."""
    comp = connected_components(nodes, edges)
    loops = comp.select("component", F.col("name").alias("tail"), F.lit(None).cast(comp.schema["name"].dataType).alias("head"))
    inside = edges.join(comp.select(F.col("name").alias("tail"), "component"), "tail").select("component", "tail", "head")
    spark = nodes.sparkSession
    tasks = max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    columns = T._parse_datatype_string(schema).names

    def run(batches):
        rows = ((c, t, h) for b in batches for c, t, h in zip(*(b.column(k).to_pylist() for k in range(3))))
        out: dict = {c: [] for c in columns}
        for _, group in groupby(rows, key=itemgetter(0)):
            names, pairs = [], []
            for _, t, h in group:  # nodes first
                names.append(t) if h is None else pairs.append((t, h))
            found = kernel(names, pairs)
            if isinstance(found, list):
                found = {c: [r[c] for r in found] for c in columns}
            for c in columns:
                out[c].extend(found[c])
            if len(out[columns[0]]) >= BATCH:
                yield pd.DataFrame(out)
                out = {c: [] for c in columns}
        if out[columns[0]]:
            yield pd.DataFrame(out)

    def frames(batches):
        for pdf in run(batches):
            yield pa.RecordBatch.from_pandas(pdf, schema=arrow, preserve_index=False)

    arrow = to_arrow_schema(T._parse_datatype_string(schema))
    dealt = inside.unionByName(loops).repartition(tasks, "component").sortWithinPartitions("component", F.col("head").isNotNull(), "tail", "head")
    return dealt.mapInArrow(frames, schema)


def neighbours(pairs, both: bool = True) -> dict:
    """Simple adjacency in first-seen order, loops left out."""
    near: dict = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, {})[b] = None
            if both:
                near.setdefault(b, {})[a] = None
    return {k: list(v) for k, v in near.items()}


def biconnected(names, pairs) -> list[tuple[int, object]]:
    """(block, node) rows: biconnected blocks by one depth-first pass with an edge stack; isolated nodes are blocks."""
    near, depth, low, blocks = neighbours(pairs), {}, {}, []
    for start in names:
        if start in depth:
            continue
        if start not in near:
            depth[start] = 0
            blocks.append({start})
            continue
        depth[start] = low[start] = 0
        walk, edges = [(start, None, iter(near[start]))], []
        while walk:
            v, parent, rest = walk[-1]
            for w in rest:
                if w == parent:
                    continue
                if w not in depth:
                    depth[w] = low[w] = depth[v] + 1
                    edges.append((v, w))
                    walk.append((w, v, iter(near[w])))
                    break
                if depth[w] < depth[v]:
                    edges.append((v, w))
                    low[v] = min(low[v], depth[w])
            else:
                walk.pop()
                if parent is not None:
                    low[parent] = min(low[parent], low[v])
                    if low[v] >= depth[parent]:
                        block = set()
                        while True:
                            e = edges.pop()
                            block.update(e)
                            if e == (parent, v):
                                break
                        blocks.append(block)
    return [(k, n) for k, b in enumerate(blocks) for n in sorted(b)]


def articulation(names, pairs) -> list:
    seen: dict = {}
    for _, n in biconnected(names, pairs):
        seen[n] = seen.get(n, 0) + 1
    return sorted(n for n, k in seen.items() if k > 1)


def break_cycles(names, pairs) -> list[tuple]:
    """(tail, head, reversed): depth-first in order; edges into a node still open (loops too) turn round."""
    out: dict = {}
    for a, b in pairs:
        out.setdefault(a, []).append(b)
    state, rows = {}, []
    for start in names:
        if start in state:
            continue
        state[start] = 1
        walk = [(start, iter(out.get(start, [])))]
        while walk:
            v, rest = walk[-1]
            for w in rest:
                back = state.get(w) == 1
                rows.append((w, v, True) if back else (v, w, False))
                if w not in state:
                    state[w] = 1
                    walk.append((w, iter(out.get(w, []))))
                    break
            else:
                state[v] = 2
                walk.pop()
    return rows


def reduce_in_order(names, pairs) -> list[tuple]:
    """Transitive reduction as an ordered pass: an edge goes as soon as another way to its head exists, the
    edge itself being barred on the first hop only (so cycles lose edges, too)."""
    out: dict = {}
    for k, (a, b) in enumerate(pairs):
        out.setdefault(a, {})[k] = b
    kept = dict(enumerate(pairs))
    for k, (a, b) in enumerate(pairs):
        seen, todo = set(), [x for j, x in out.get(a, {}).items() if j != k]
        while todo:
            v = todo.pop()
            if v not in seen:
                seen.add(v)
                todo += out.get(v, {}).values()
        if b in seen:
            del out[a][k], kept[k]
    return list(kept.values())


def strong(names, pairs) -> list[tuple]:
    """(scc, node): strong components, numbered in reverse topological order."""
    out, index, low, on, stack, found = {}, {}, {}, set(), [], []
    for a, b in pairs:
        out.setdefault(a, []).append(b)
    for start in names:
        if start in index:
            continue
        walk = [(start, iter(out.get(start, [])))]
        index[start] = low[start] = len(index)
        stack.append(start), on.add(start)
        while walk:
            v, rest = walk[-1]
            for w in rest:
                if w not in index:
                    index[w] = low[w] = len(index)
                    stack.append(w), on.add(w)
                    walk.append((w, iter(out.get(w, []))))
                    break
                if w in on:
                    low[v] = min(low[v], index[w])
            else:
                walk.pop()
                if walk:
                    low[walk[-1][0]] = min(low[walk[-1][0]], low[v])
                if low[v] == index[v]:
                    at = stack.index(v)
                    found.append(stack[at:])
                    on.difference_update(stack[at:])
                    del stack[at:]
    return [(k, n) for k, c in enumerate(found) for n in sorted(c)]


def betweenness(names, pairs, n_total: int | None = None) -> dict:
    """Shortest-path betweenness over ordered sources; parallel edges multiply paths; scaled by
    1 / ((n - 1)(n - 2)) for n > 2."""
    out: dict = {}
    for a, b in pairs:
        out.setdefault(a, []).append(b)
    score = dict.fromkeys(names, 0.0)
    for s in names:
        sigma, dist, before, order = {s: 1.0}, {s: 0}, {}, [s]
        for v in order:
            for w in out.get(v, []):
                if w not in dist:
                    dist[w] = dist[v] + 1
                    order.append(w)
                if dist[w] == dist[v] + 1:
                    sigma[w] = sigma.get(w, 0.0) + sigma[v]
                    before.setdefault(w, []).append(v)
        delta = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in before.get(w, []):
                delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            if w != s:
                score[w] += delta[w]
    n = n_total or len(names)
    scale = 1 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    return {k: v * scale for k, v in score.items()}


def greedy_colors(n: int, clashes: list[tuple[int, int]], palette: int) -> list[int]:
    """Each item takes the smallest colour no earlier clashing item has, modulo the palette."""
    near: dict = {}
    for a, b in clashes:
        near.setdefault(max(a, b), []).append(min(a, b))
    colors: list[int] = []
    for i in range(n):
        used = {colors[j] for j in near.get(i, [])}
        c = 0
        while c in used:
            c += 1
        colors.append(c)
    return [c % palette for c in colors]
