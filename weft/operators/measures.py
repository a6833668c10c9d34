"""Per-component measures on small dense matrices: resistance distances, spread-out pivots, simple cycles.

Like the kernels, each takes (sorted names, sorted pairs) of one component, which must fit a task; the matrices
here are quadratic in its nodes, so these are for components of up to some thousands.
"""

from __future__ import annotations

import math

import numpy as np

from weft.operators.kernels import neighbours


def circuit_distances(names, pairs, unit: float = 72.0) -> list[tuple]:
    """(a, b, distance) for a < b: ``unit`` times the root of the effective resistance, every edge of the simple
    undirected graph a resistor of one. Nodes that no path joins have no row."""
    at = {n: i for i, n in enumerate(names)}
    near = neighbours(pairs)
    lap = np.zeros((len(names), len(names)))
    for a, others in near.items():
        lap[at[a], at[a]] = len(others)
        for b in others:
            lap[at[a], at[b]] = -1.0
    inverse = np.linalg.pinv(lap, hermitian=True)
    side = np.diag(inverse)
    resistance = np.maximum(side[:, None] + side[None, :] - 2 * inverse, 0.0)
    group = _groups(names, near)
    return [(a, b, unit * math.sqrt(resistance[at[a], at[b]])) for i, a in enumerate(names) for b in names[i + 1 :] if group[a] == group[b]]


def _groups(names, near) -> dict:
    group: dict = {}
    for start in names:
        if start in group:
            continue
        todo, group[start] = [start], start
        while todo:
            for w in near.get(todo.pop(), ()):
                if w not in group:
                    group[w] = start
                    todo.append(w)
    return group


def pivots(names, pairs, count: int) -> list[tuple[int, object]]:
    """(k, name): starting with the first name, each next pivot is the node whose nearest pivot is furthest
    (ties: the first in order)."""
    near, chosen = neighbours(pairs), []
    gap = dict.fromkeys(names, math.inf)
    while len(chosen) < min(count, len(names)):
        left = [n for n in names if gap[n] > 0]
        if not left:
            break
        nxt = max(left, key=lambda n: gap[n]) if chosen else names[0]
        chosen.append(nxt)
        seen, ring = {nxt}, [nxt]
        gap[nxt] = 0
        step = 0
        while ring:
            step += 1
            ring = [w for v in ring for w in near.get(v, ()) if not (w in seen or seen.add(w))]
            for w in ring:
                gap[w] = min(gap[w], step)
    return list(enumerate(chosen))


def simple_cycles(names, pairs, longest: int | None = None) -> list[tuple]:
    """Directed simple cycles, each once as a tuple that starts at its least node; self-loops are cycles of one.
    ``longest`` bounds the number of nodes (the number of cycles can grow exponentially without)."""
    order = {n: i for i, n in enumerate(names)}
    out_of: dict = {}
    for a, b in dict.fromkeys(pairs):
        out_of.setdefault(a, []).append(b)
    found = []
    for start in names:
        path, turns = [start], [iter(out_of.get(start, ()))]
        held = {start}
        while turns:
            w = next(turns[-1], None)
            if w is None:
                turns.pop()
                held.discard(path.pop())
            elif w == start:
                found.append(tuple(path))
            elif w not in held and order[w] > order[start] and (longest is None or len(path) < longest):
                path.append(w)
                held.add(w)
                turns.append(iter(out_of.get(w, ())))
    return found


def shortest_cycle(cycles: list[tuple], tail, head, least: int = 3) -> tuple | None:
    """The shortest of the cycles of at least ``least`` nodes that runs along tail -> head."""
    good = [c for c in cycles if len(c) >= least and any(c[k - 1] == tail and c[k] == head for k in range(len(c)))]
    return min(good, key=len, default=None)
