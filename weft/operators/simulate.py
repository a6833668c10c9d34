"""Simulation: synchronous block diagrams and event queues as time series."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def schedule(blocks: dict, wires: list[tuple]) -> list[str]:
    """Topological order with delays as sources; an algebraic loop raises."""
    deps = {b: set() for b in blocks}
    for src, dst, _ in wires:
        if blocks[src][0] != "delay" and blocks[dst][0] != "delay":
            deps[dst].add(src)
    order = sorted(b for b in blocks if blocks[b][0] == "delay")
    todo = sorted(set(blocks) - set(order))
    while todo:
        ready = [b for b in todo if deps[b] <= set(order)]
        if not ready:
            raise ValueError("algebraic loop")
        order.append(ready[0])
        todo.remove(ready[0])
    return order


def run_blocks(blocks: dict[str, tuple[str, float]], wires: list[tuple[str, str, int]], steps: int) -> list[tuple[str, int, float]]:
    """Rows (block, step, value): constant, gain, negator, adder, product, delay (param: start value)."""
    order, state, rows = schedule(blocks, wires), {b: p for b, (k, p) in blocks.items() if k == "delay"}, []
    ins: dict = {}
    for src, dst, port in sorted(wires, key=lambda w: (w[1], w[2])):
        ins.setdefault(dst, []).append(src)
    for t in range(steps):
        out: dict = {}
        for b in order:
            kind, p = blocks[b]
            v = [out.get(s, 0.0) for s in ins.get(b, [])]
            if kind == "constant":
                out[b] = p
            elif kind == "delay":
                out[b] = state[b]
            elif kind == "gain":
                out[b] = p * v[0]
            elif kind == "negator":
                out[b] = -v[0]
            elif kind == "adder":
                out[b] = sum(v)
            else:
                prod = 1.0
                for x in v:
                    prod *= x
                out[b] = prod
        rows += [(b, t, out[b]) for b in order]
        state = {b: out[ins[b][0]] if ins.get(b) else state[b] for b in state}
    return rows


def block_traces(diagrams: DataFrame, steps: int) -> DataFrame:
    """diagrams (scenario, name, kind, param, inputs array) -> (scenario, block, step, value), a scenario per group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        blocks = {r.name_: (r.kind, r.param) for r in pdf.rename(columns={"name": "name_"}).itertuples()}
        wires = [(s, n, k) for n, i in zip(pdf["name"], pdf["inputs"]) for k, s in enumerate(i if i is not None else [])]
        rows = run_blocks(blocks, wires, steps)
        return pd.DataFrame([(pdf["scenario"].iloc[0], *r) for r in rows], columns=["scenario", "block", "step", "value"])

    return diagrams.groupBy("scenario").applyInPandas(run, "scenario long, block string, step long, value double")


class Environment:
    """An event queue ordered by (time, insertion); processes are generators that yield delays."""

    def __init__(self):
        self.now, self._queue, self._count, self.trace = 0.0, [], 0, []

    def _push(self, at: float, what) -> None:
        heapq.heappush(self._queue, (at, self._count, what))
        self._count += 1

    def timeout(self, delay: float, call) -> None:
        if delay < 0:
            raise ValueError("negative delay")
        self._push(self.now + delay, call)

    def process(self, steps) -> None:
        def go():
            try:
                delay = next(steps)
            except StopIteration:
                return
            self.timeout(delay, go)

        self._push(self.now, go)

    def step(self) -> bool:
        if not self._queue:
            return False
        self.now, _, call = heapq.heappop(self._queue)
        call()
        return True

    def run(self, until: float | None = None) -> None:
        while self._queue and (until is None or self.now < until):
            self.step()


def fire_order(timeouts: DataFrame, scenario: str) -> DataFrame:
    """(scenario, name, t, k): the order in which timeouts(scenario, name, delay, seq) fire; ties by insertion."""
    from pyspark.sql import Window

    w = Window.partitionBy(scenario).orderBy("delay", "seq")
    return timeouts.select(scenario, "name", F.col("delay").alias("t"), F.row_number().over(w).cast("long").alias("k"))
