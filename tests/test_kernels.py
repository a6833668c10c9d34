"""Kernels and parsers against brute force on small random inputs."""

import itertools
import math
import random

import pytest

from weft.operators import kernels, layout, simulate
from weft.sources.dot import Parser


def random_graph(seed):
    r = random.Random(seed)
    n = r.randint(1, 7)
    names = list(range(n))
    return names, [(r.choice(names), r.choice(names)) for _ in range(r.randint(0, 10))]


def reach(names, pairs, gone=()):
    near = {v: {b for a, b in pairs if a == v and b not in gone} | {a for a, b in pairs if b == v and a not in gone} for v in names if v not in gone}
    out = {}
    for s in near:
        seen, todo = {s}, [s]
        while todo:
            for w in near[todo.pop()] - seen:
                seen.add(w)
                todo.append(w)
        out[s] = frozenset(seen)
    return out


@pytest.mark.parametrize("seed", range(40))
def test_articulation_and_blocks(seed):
    names, pairs = random_graph(seed)
    want = sorted(v for v in names if len(set(reach(names, pairs, {v}).values())) > len(set(reach(names, pairs).values())) - (not any(v in p and p[0] != p[1] for p in pairs)))
    assert kernels.articulation(names, pairs) == want
    blocks = {}
    for k, v in kernels.biconnected(names, pairs):
        blocks.setdefault(k, set()).add(v)
    assert set().union(*blocks.values()) == set(names)
    for a, b in pairs:
        if a != b:
            assert sum({a, b} <= s for s in blocks.values()) == 1


@pytest.mark.parametrize("seed", range(40))
def test_cycles_strong_and_reduction(seed):
    names, pairs = random_graph(seed)
    turned = [(a, b) for a, b, _ in kernels.break_cycles(names, pairs) if a != b]
    order = {}
    left = set(names)
    while left:
        free = [v for v in left if not any(b == v and a in left for a, b in turned)]
        assert free, "a cycle is left"
        for v in free:
            order[v] = len(order)
        left -= set(free)
    out = {v: {v} for v in names}
    for _ in names:
        for a, b in pairs:
            out[a] |= out[b]
    comp = {}
    for k, v in kernels.strong(names, pairs):
        comp[v] = k
    assert all((comp[a] == comp[b]) == (b in out[a] and a in out[b]) for a, b in itertools.product(names, names))
    dag = sorted({(a, b) for a, b in pairs if a < b})
    kept = kernels.reduce_in_order(names, dag)
    after = {v: {v} for v in names}
    full = {v: {v} for v in names}
    for _ in names:
        for a, b in kept:
            after[a] |= after[b]
        for a, b in dag:
            full[a] |= full[b]
    assert after == full and all(any(not (c != a and (c, b) != (a, b) and c in full[a] and b in full[c] and c != b) for c in [a]) for a, b in kept)


@pytest.mark.parametrize("seed", range(20))
def test_betweenness(seed):
    names, pairs = random_graph(seed)
    pairs = sorted({p for p in pairs if p[0] != p[1]})
    score = dict.fromkeys(names, 0.0)
    for s, t in itertools.permutations(names, 2):
        for k in range(1, len(names)):
            walks = [w for w in itertools.permutations([v for v in names if v not in (s, t)], k - 1) if all(e in pairs for e in zip((s, *w), (*w, t)))]
            if walks:
                for v in names:
                    score[v] += sum(v in w for w in walks) / len(walks)
                break
    n = len(names)
    scale = 1 / ((n - 1) * (n - 2)) if n > 2 else 1
    got = kernels.betweenness(names, pairs)
    assert all(math.isclose(got[v], score[v] * scale, abs_tol=1e-12) for v in names)


def test_layouts_place_every_node_apart():
    names, pairs = list(range(8)), [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (3, 5), (5, 6), (6, 7)]
    for name, engine in layout.ENGINES.items():
        at = engine(names, pairs)
        assert at.shape == (8, 2) and len({tuple(p.round(3)) for p in at}) == 8, name
        assert engine([5], []).shape == (1, 2)


def test_treemap_fills_its_box():
    boxes = layout.treemap([6, 6, 4, 3, 2, 2, 1], 0, 0, 6, 4)
    assert math.isclose(sum(w * h for *_, w, h in boxes), 24)
    assert [round(w * h, 6) for *_, w, h in boxes] == [6, 6, 4, 3, 2, 2, 1]


def test_simulation():
    blocks = {"one": ("constant", 1.0), "delay": ("delay", 0.0), "add": ("adder", 0.0)}
    wires = [("one", "add", 0), ("delay", "add", 1), ("add", "delay", 0)]
    assert [v for b, _, v in simulate.run_blocks(blocks, wires, 5) if b == "add"] == [1, 2, 3, 4, 5]
    with pytest.raises(ValueError):
        simulate.schedule({"a": ("gain", 1.0), "b": ("gain", 1.0)}, [("a", "b", 0), ("b", "a", 0)])
    env, fired = simulate.Environment(), []
    for name, delay in (("A", 5), ("B", 2), ("C", 8)):
        env.timeout(delay, lambda name=name: fired.append((env.now, name)))
    env.run()
    assert fired == [(2, "B"), (5, "A"), (8, "C")]


def test_dot_parser():
    rows = Parser('strict digraph "G" { /* c */ node [shape=box]; a -> b -> c [label="x\\"y"]; subgraph cluster_0 { d; e:p:n -> d } a -> a; a -> b; rankdir=LR }').parse()
    edges = [(r[3], r[4]) for r in rows if r[1] == "edge"]
    assert edges == [("a", "b"), ("b", "c"), ("e", "d")]
    assert {r[2] for r in rows if r[1] == "node"} == {"a", "b", "c", "d", "e"}
    assert next(r[9] for r in rows if r[1] == "edge")["label"] == 'x"y'
    assert Parser("").parse() == [] and Parser("graph { a -- b").parse()


def test_record_labels():
    from weft.sources import records

    shape = lambda label: [(p, f.port, f.text, f.lr) for p, f in records.walk(records.parse(label)) if not f.kids]
    assert shape("a|<p>b|{c|d}") == [("0", "", "a", False), ("1", "p", "b", False), ("2.0", "", "c", True), ("2.1", "", "d", True)]
    assert shape("{a|b}") == [("0", "", "a", True), ("1", "", "b", True)] and not records.parse("{a|b}").lr
    assert shape("<p> x\\|y \\{z\\}") == [("", "p", "x|y {z}", True)] and shape("") == [("", "", "", True)]
    assert [f[:2] for f in shape("{{<a>}|b}")] == [("0.0", "a"), ("1", "")]
    for odd in ("{a", "a}", "{a}b", "x{a}", "{a|{b}"):
        assert shape(odd) == [("", "", odd, True)]
    root = records.parse("aa|<p>b|{c|d|eeee}")
    records.measure(root)
    a, b, c = root.kids
    assert root.width == pytest.approx(a.width + b.width + c.width) and a.height == b.height == c.height == root.height
    assert sum(k.height for k in c.kids) == pytest.approx(root.height) and {k.width for k in c.kids} == {c.width}
    assert b.x == a.width and c.kids[1].y == pytest.approx(c.kids[0].height)
    assert records.port_center(root, "p") == pytest.approx((a.width + b.width / 2, root.height / 2)) and records.port_center(root, "q") is None


def test_polynomial_roots(spark):
    from pyspark.sql import functions as F

    from weft.functions import solve

    r = random.Random(12)
    rows = [tuple(float(r.randint(-5, 5)) for _ in range(4)) for _ in range(200)] + [(0.0, 0.0, 0.0, 0.0), (1.0, 0.0, 0.0, 0.0), (-1.0, 3.0, -3.0, 1.0), (0.0, 0.0, 0.0, 2.0)]
    n, *roots = solve.cubic(*[F.col(c) for c in "abcd"])
    for x in spark.createDataFrame(rows, "a double, b double, c double, d double").select("*", n.alias("n"), *[k.alias(f"r{i}") for i, k in enumerate(roots)]).collect():
        found = [x[f"r{i}"] for i in range(3) if x[f"r{i}"] is not None]
        assert len(found) == (0 if x["n"] == solve.ALL else x["n"])
        assert all(abs(x["a"] + x["b"] * t + x["c"] * t**2 + x["d"] * t**3) < 1e-5 * (1 + abs(t)) ** 3 for t in found)


@pytest.mark.parametrize("seed", range(30))
def test_measures(seed):
    from weft.operators import measures

    names, pairs = random_graph(seed)
    want = set()
    edges = set(pairs)
    for k in range(1, len(names) + 1):
        for c in itertools.permutations(names, k):
            if c[0] == min(c) and all((c[i - 1], c[i]) in edges for i in range(k)):
                want.add(c)
    got = measures.simple_cycles(names, pairs)
    assert set(got) == want and len(got) == len(want)
    both = {v: s for v, s in reach(names, pairs).items()}
    dist = {(a, b): d for a, b, d in measures.circuit_distances(names, pairs)}
    assert set(dist) == {(a, b) for a in names for b in names if a < b and b in both[a]}
    chosen = [n for _, n in measures.pivots(names, pairs, 3)]
    assert chosen[0] == names[0] and len(set(chosen)) == min(3, len(names))


def test_circuit_distance_values():
    from weft.operators import measures

    triangle = {(a, b): d for a, b, d in measures.circuit_distances([0, 1, 2, 3], [(0, 1), (1, 2), (2, 0), (2, 3)])}
    assert triangle[0, 1] == pytest.approx(72 * math.sqrt(2 / 3)) and triangle[2, 3] == pytest.approx(72) and triangle[0, 3] == pytest.approx(72 * math.sqrt(5 / 3))
    assert measures.shortest_cycle([(0, 1), (0, 1, 2), (0, 3, 1, 2)], 1, 2) == (0, 1, 2)


def test_command_line(spark, tmp_path):
    from weft import cli

    (tmp_path / "a.gv").write_text("digraph { a -> b -> c; a -> c; d }")
    rows = lambda tool: [tuple(r) for r in cli.run(spark, tool, [str(tmp_path / "a.gv")]).collect()]
    assert [r[1:] for r in rows("gc")] == [(4, 3)] and sorted(r[1:] for r in rows("ccomps")) == [(1, 0), (3, 3)]
    assert len(rows("tred")) == 2 and len(rows("sccmap")) == 4
