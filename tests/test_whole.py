"""Queries over whole tables: no row of the input is left out."""

import math
import random

from pyspark.sql import functions as F
from tests.conftest import SF

from weft import views
from weft.functions import color
from weft.operators import kernels, layout, mutate, spatial
from weft.plans import algorithms
from weft.registry import QUERIES, SQL


def test_typed_accessors_keeps_every_row(spark):
    got = QUERIES["typed_accessors"](spark, SF).collect()
    assert len(got) == views.table(spark, SF, "lineitem").count()
    assert {r["l_orderkey"] % 50 for r in got} == set(range(50))


def test_edgepaint_colors_every_edge(spark):
    edges = {tuple(r) for r in views.copurchase(spark, SF).where("tail <> head").select("tail", "head").collect()}
    got = {tuple(map(int, r["edge"].split("-"))): r["color"] for r in QUERIES["edgepaint_colors"](spark, SF).collect()}
    assert set(got) == edges and any(t % 2 for t, _ in edges)
    order = sorted(edges)
    place = {e: k for k, e in enumerate(order)}
    clash = [(place[r["tail1"], r["head1"]], place[r["tail2"], r["head2"]]) for r in QUERIES["edgepaint_crossings"](spark, SF).collect()]
    colors = kernels.greedy_colors(len(order), sorted(clash), len(color.EDGE_PALETTE))
    assert got == {e: color.EDGE_PALETTE[c] for e, c in zip(order, colors)}


def compat(a, b):
    la, lb = (math.hypot(x[0] - x[2], x[1] - x[3]) for x in (a, b))
    if not la or not lb:
        return 0.0
    av = (la + lb) / 2
    angle = abs(((a[2] - a[0]) * (b[2] - b[0]) + (a[3] - a[1]) * (b[3] - b[1])) / (la * lb))
    scale = 2 / (max(la, lb) / av + av / min(la, lb))
    away = math.hypot((a[0] + a[2] - b[0] - b[2]) / 2, (a[1] + a[3] - b[1] - b[3]) / 2)
    return 0.0 if angle < 0.1 or scale < 0.1 else angle * scale * av / (av + away)


def test_compatible_pairs_equal_brute_force(spark):
    r = random.Random(3)
    segs = [[r.uniform(-90, 90) for _ in range(2)] for _ in range(160)]
    segs = [(x, y, x + d * math.cos(t), y + d * math.sin(t)) for (x, y), d, t in ((s, 2 ** r.uniform(0, 7), r.choice([0, 0.1, 1.5, r.random()])) for s in segs)]
    # the edges of the bounds: lengths by 1 + 2 * sqrt(2), midpoints as far as the length, equal and empty segments
    segs += [(0.0, 0.0, 64.0, 0.0), (64.0, 0.0, 128.0, 0.0), (32 - 8.36, 0.0, 32 + 8.36, 0.0), (0.0, 0.0, 64.0, 0.0), (5.0, 5.0, 5.0, 5.0), (0.0, 64.0, 64.0, 64.0)]
    df = spark.createDataFrame([(i % 7, i, *map(float, s)) for i, s in enumerate(segs)], "tail long, head long, ax double, ay double, bx double, by double")
    got = [tuple(x) for x in algorithms.compatible_pairs(df).collect()]
    keyed = sorted(((i % 7, i), s) for i, s in enumerate(segs))
    want = {(*p, *q): round(k, 5) for n, (p, a) in enumerate(keyed) for q, b in keyed[n + 1 :] if round(k := compat(a, b), 6) >= 0.5}
    assert len(got) == len(want) and {g[:4]: round(g[4], 5) for g in got}.keys() == want.keys()
    assert all(abs(g[4] - want[g[:4]]) < 1e-4 for g in got)


def test_overlap_pairs_of_boxes_of_any_size(spark):
    r = random.Random(5)
    boxes = [(i % 2, i, r.uniform(-400, 400), r.uniform(-400, 400), 2 ** r.uniform(-3, 10), 2 ** r.uniform(-3, 9)) for i in range(150)]
    boxes += [(0, 900, 0.0, 0.0, 600.0, 20.0), (0, 901, 250.0, 0.0, 20.0, 20.0), (1, 902, 0.0, 0.0, 0.0, 0.0), (1, 903, 0.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(boxes, "grp int, name int, x double, y double, width double, height double")
    touch = lambda a, b: abs(a[2] - b[2]) < (a[4] + b[4]) / 2 + 2 and abs(a[3] - b[3]) < (a[5] + b[5]) / 2 + 2
    want = {(a[0], a[1], b[1]) for a in boxes for b in boxes if a[0] == b[0] and a[1] < b[1] and touch(a, b)}
    got = [tuple(x) for x in spatial.overlap_pairs(df, ["grp"], 2.0).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    two = df.where("name IN (900, 901)")
    assert layout.scale_factor(two, 0.0).first()["factor"] == 310 / 250


def test_coarse_force_layout_keeps_springs_near_their_length():
    import numpy as np

    pairs = [(i, i + 1) for i in range(39)]
    at = layout.coarse_force_layout(list(range(40)), pairs)
    length = np.linalg.norm(at[1:] - at[:-1], axis=1)
    assert 15 < length.mean() < 45 and length.min() > 2
    assert layout.heaviest_matching([1, 2, 3, 4], {(1, 2): 1, (2, 3): 5, (3, 4): 1}) == {1: 1, 2: 3, 3: 2, 4: 4}


def test_treemap_of_areas_with_zeros():
    boxes = layout.treemap([4.0, 0.0, 0.0], 0, 0, 2, 2)
    assert boxes[0] == (0, 0, 2, 2) and boxes[1][2:] == (0.0, 0.0)
    assert layout.treemap([0.0, 0.0], 0, 0, 2, 2) == [(2, 2, 0.0, 0.0)] * 2


def test_relabel_nodes_gives_names_that_are_taken(spark, tmp_path):
    import duckdb

    rows = [(1, 1, 3, 1), (1, 2, 5, 1), (2, 1, 1000003, 1), (2, 2, 6, 1)]
    line = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").selectExpr("*", "50D AS l_quantity", "'R' AS l_returnflag")
    line.coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.sql(SQL["relabel_nodes"]).fetchall()
    got = [tuple(r) for r in QUERIES["relabel_nodes"](spark, str(tmp_path)).select("tail", "head").collect()]
    assert sorted(got) == sorted(want) == [(1000003, 5), (1000003, 1000006)]
    nodes, edges = spark.createDataFrame([(3,), (1000003,)], "name long"), spark.createDataFrame([(3, 1000003)], "tail long, head long")
    kept = mutate.relabel(nodes, edges, spark.createDataFrame([(3, 1000003)], "name long, new_name long"))
    assert kept[1].first()["tail"] == 3 and kept[0].count() == 2


def placed(spark, n: int, seed: int):
    r = random.Random(seed)
    rows = [(i % 2, i, float(r.randint(-200, 200)), float(r.randint(-200, 200))) for i in range(n)]
    return rows, spark.createDataFrame(rows, "grp int, name int, x double, y double")


def touching(a, b):
    return a[0] == b[0] and all(abs(math.floor(a[k] / 64) - math.floor(b[k] / 64)) <= 1 for k in (2, 3))


def test_repulsion_broadcasts_nothing_and_equals_brute_force(spark):
    rows, df = placed(spark, 120, 11)
    f = spatial.repulsion(df, ["grp"], 64.0, 30.0)
    assert "Broadcast" not in f._jdf.queryExecution().executedPlan().toString()
    want = {}
    for a in rows:
        for b in rows:
            d2 = (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2
            if a[1] != b[1] and touching(a, b) and d2:
                x, y = want.get(a[:2], (0.0, 0.0))
                want[a[:2]] = x + (a[2] - b[2]) * 900 / d2, y + (a[3] - b[3]) * 900 / d2
    got = {(r["grp"], r["name"]): (r["fx"], r["fy"]) for r in f.collect()}
    assert got.keys() == want.keys() and all(abs(p - q) < 1e-9 for k in got for p, q in zip(got[k], want[k]))


def test_near_pairs_broadcasts_nothing_and_equals_brute_force(spark):
    rows, df = placed(spark, 150, 12)
    p = spatial.near_pairs(df, ["grp"], 64.0)
    assert "Broadcast" not in p._jdf.queryExecution().executedPlan().toString()
    got = [tuple(r) for r in p.select("grp", "name_a", "x_a", "y_a", "name_b", "x_b", "y_b").collect()]
    want = {(*a, *b[1:]) for a in rows for b in rows if a[1] < b[1] and touching(a, b)}
    assert len(got) == len(set(got)) and set(got) == want


def test_close_pairs_of_flat_boxes_meet_in_flat_cells(spark):
    r = random.Random(13)
    rows = [(0, i, r.uniform(0, 1000), r.uniform(0, 1000), r.uniform(20, 70), r.uniform(10, 16)) for i in range(1500)]
    df = spark.createDataFrame(rows, "grp int, name int, x double, y double, width double, height double")
    p = spatial.close_pairs(df, ["grp"], 2.0)
    assert "SortMergeJoin" in p._jdf.queryExecution().executedPlan().toString()
    # cells of 128 x 128 would make about 80,000 of them; those that overlap are about 3,000
    assert p.count() < 6 * spatial.overlap_pairs(df, ["grp"], 2.0).count()


def test_scale_factor_counts_pairs_without_forming_them(spark):
    r = random.Random(14)
    rows = [(i, float(r.randint(0, 99)), r.randint(0, 800) / 4, float(r.randint(1, 30)), float(r.randint(1, 9))) for i in range(300)]
    rows += [(900, -500.0, 0.0, 600.0, 1.0), (901, 50.0, -40.0, 1.0, 300.0)]
    rows = [*{(b[1], b[2]): b for b in rows}.values()]  # no two at one place
    df = spark.createDataFrame(rows, "name int, x double, y double, width double, height double")
    part = lambda d, s: max(s / d, 1.0) if d else math.inf
    sides = [(abs(a[1] - b[1]), abs(a[2] - b[2]), (a[3] + b[3]) / 2 + 2, (a[4] + b[4]) / 2 + 2) for a in rows for b in rows if a[0] < b[0]]
    want = [min(part(dx, w), part(dy, h)) for dx, dy, w, h in sides if dx < w and dy < h]
    assert tuple(layout.scale_factor(df, 2.0).first()) == (max(want), len(want))
    count = layout._count_overlaps(df, len(rows), 2.0, share=40)
    assert "Join" not in count._jdf.queryExecution().executedPlan().toString() and count.first()[0] == len(want)
    twice = df.unionByName(df.where("name = 900").withColumn("name", F.lit(902)))
    assert layout.scale_factor(twice, 2.0).first()["factor"] == math.inf
    assert tuple(layout.scale_factor(df.limit(0), 2.0).first()) == (1.0, 0)


def test_rank_crossings_counts_pairs_without_forming_them(spark):
    r = random.Random(15)
    rows = [(r.randint(0, 2), r.randint(0, 40), r.randint(0, 40)) for _ in range(300)] + [(7, 1, 1), (7, 2, 2)]
    got = layout.rank_crossings(spark.createDataFrame(rows, "rank long, t long, h long"))
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    want = {k: sum(a[0] == b[0] == k and a[1] < b[1] and a[2] > b[2] for a in rows for b in rows) for k in range(3)}
    assert {x["rank"]: x["crossings"] for x in got.collect()} == want


def random_segments(spark, n: int):
    r = random.Random(16)
    segs = [(i % 7, i, *(float(r.randint(0, 60)) for _ in range(4))) for i in range(n)]
    return segs, spark.createDataFrame(segs, "tail long, head long, ax double, ay double, bx double, by double")


def cross(a, b):
    side = lambda s, x, y: (x - s[2]) * (s[5] - s[3]) - (s[4] - s[2]) * (y - s[3])
    return side(a, *b[2:4]) * side(a, *b[4:6]) < 0 and side(b, *a[2:4]) * side(b, *a[4:6]) < 0


def test_crossing_pairs_meet_in_strips_and_equal_brute_force(spark):
    segs, df = random_segments(spark, 250)
    p = algorithms.crossing_pairs(df)
    assert "Join" not in p._jdf.queryExecution().executedPlan().toString()
    got = [tuple(x) for x in p.collect()]
    assert len(got) == len(set(got)) and set(got) == {(*a[:2], *b[:2]) for a in segs for b in segs if a[:2] < b[:2] and cross(a, b)}


def test_edge_colors_form_no_table_of_crossings(spark):
    segs, df = random_segments(spark, 250)
    c = algorithms.edge_colors(df)
    assert "Join" not in c._jdf.queryExecution().executedPlan().toString()
    order = sorted(segs)
    clash = [(i, j) for i, a in enumerate(order) for j, b in enumerate(order) if i < j and cross(a, b)]
    want = kernels.greedy_colors(len(order), clash, len(color.EDGE_PALETTE))
    assert {r["edge"]: r["color"] for r in c.collect()} == {f"{s[0]:09d}-{s[1]:09d}": color.EDGE_PALETTE[k] for s, k in zip(order, want)}


def test_compatible_pairs_broadcast_nothing(spark):
    segs, df = random_segments(spark, 250)
    p = algorithms.compatible_pairs(df)
    assert "Broadcast" not in p._jdf.queryExecution().executedPlan().toString()
    want = {(*a[:2], *b[:2]) for a in segs for b in segs if a[:2] < b[:2] and round(compat(a[2:], b[2:]), 6) >= 0.5}
    assert {tuple(x)[:4] for x in p.collect()} == want


def test_small_components_are_dealt_to_many_tasks(spark):
    import numpy as np

    edges = spark.createDataFrame([(10 * i, 10 * i + 1) for i in range(60)] + [(601 + i, 602 + i) for i in range(40)], "tail long, head long")
    got = layout.lay_out(views.endpoints(edges), edges, "fdp")
    rows = got.withColumn("task", F.spark_partition_id()).collect()
    assert len(rows) == 161 and len({r["task"] for r in rows}) > 4
    for names, pairs in ([0, 1], [(0, 1)]), (list(range(601, 642)), [(601 + i, 602 + i) for i in range(40)]):
        want = layout.force_layout(names, pairs)
        assert np.array_equal(want, [(r["x"], r["y"]) for v in names for r in rows if r["name"] == v])


def test_shapes_are_drawn_as_their_components_are():
    import numpy as np

    names, pairs = [3, 5, 8, 13], [(3, 5), (5, 8), (8, 3), (8, 8), (13, 3)]
    for kernel in layout.ENGINES.values():
        assert np.array_equal(layout.draw(kernel, names, pairs), kernel(names, pairs))


def test_edge_colors_do_not_meet_all_pairs(monkeypatch):
    import numpy as np

    from weft.operators import strips

    r, met = random.Random(17), []
    segs = [tuple(float(r.randint(0, 500)) for _ in range(4)) for _ in range(900)]
    keep = strips._cross
    monkeypatch.setattr(strips, "_cross", lambda a, b: (met.append((x := keep(a, b)).size), x)[1])
    got = strips.greedy_colors(*np.array(segs).T, block=16, wide=8)
    assert sum(met) < 900 * 899 / 2 / 2
    clash = [(i, j) for j, b in enumerate(segs) for i, a in enumerate(segs[:j]) if cross((0, 0, *a), (0, 0, *b))]
    assert got.tolist() == kernels.greedy_colors(900, clash, 10**9)
    assert strips.greedy_colors(*np.empty((4, 0))).tolist() == []
    same = np.array([segs[0], segs[1], segs[0], segs[0][2:] + segs[0][:2]] * 3).T
    assert len(set(strips.greedy_colors(*same, block=5, wide=2))) <= 2


def test_overlapping_boxes_meet_in_arrays_not_in_a_join(spark, monkeypatch):
    from weft.operators import strips

    monkeypatch.setattr(strips, "CELLS", 50)
    r = random.Random(18)
    rows = [(i % 3, f"n{i}", float(r.randint(-60, 60)), r.randint(-90, 90) / 4, r.choice([1.0, 3.0, 9.0, 70.0]), r.choice([0.5, 2.0, 40.0])) for i in range(260)]
    rows += [(1, "same", 0.0, 0.0, 2.0, 2.0), (1, "same", 0.0, 0.0, 2.0, 2.0), (2, "none", None, 0.0, 2.0, 2.0)]
    df = spark.createDataFrame(rows, "grp int, name string, x double, y double, width double, height double")
    assert "SortMergeJoin" not in spatial.overlap_pairs(df, [], 2.0)._jdf.queryExecution().executedPlan().toString()
    over = lambda a, b: all(abs(a[k] - b[k]) < (a[k + 2] + b[k + 2]) / 2 + 2 for k in (2, 3))
    want = [(a[0], b[0], a[1], b[1]) for a in rows[:-1] for b in rows[:-1] if a[1] < b[1] and over(a, b)]
    got = lambda by: sorted(tuple(x) for x in spatial.overlap_pairs(df, by, 2.0).collect())
    assert got([]) == sorted(x[2:] for x in want) and got(["grp"]) == sorted(x[1:] for x in want if x[0] == x[1])
