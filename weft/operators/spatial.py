"""Joins and sums over placed nodes (by..., name, x, y, width, height)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.geometry import distance
from weft.operators import strips


def _around(cx, cy, steps: list[tuple[int, int]]):
    at = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps]))
    return lambda df: df.withColumn("at", at).withColumn("cx", cx + F.col("at.i")).withColumn("cy", cy + F.col("at.j")).drop("at")


NINE = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]


def near_pairs(points: DataFrame, by: list[str], cell: float) -> DataFrame:
    """Pairs ``name_a < name_b`` of the same ``by`` whose grid cells touch, every other column twice
    (``_a``, ``_b``). One side is dealt to its own cell and the other to that and the four cells after it, so the join is
    an equi-join and a pair meets once. The dealt side is a multiple of the table, which Spark's estimate does not see:
    both are sorted, neither is broadcast."""
    rest = [c for c in points.columns if c not in by]
    cx, cy = F.floor(F.col("x") / cell), F.floor(F.col("y") / cell)
    left = points.select(*by, cx.alias("cx"), cy.alias("cy"), F.struct(*rest).alias("p"))
    right = _around(cx, cy, [(0, 0), (0, 1), (1, -1), (1, 0), (1, 1)])(points.withColumn("own", cx).withColumn("own_y", cy))
    right = right.select(*by, "cx", "cy", ((F.col("own") == F.col("cx")) & (F.col("own_y") == F.col("cy"))).alias("same"), F.struct(*rest).alias("q"))
    met = left.hint("merge").join(right, [*by, "cx", "cy"]).where("p.name < q.name OR p.name > q.name AND NOT same")
    turn = F.col("p.name") > F.col("q.name")
    one, two = F.when(turn, F.col("q")).otherwise(F.col("p")), F.when(turn, F.col("p")).otherwise(F.col("q"))
    return met.select(*by, one.alias("p"), two.alias("q")).select(*by, *[F.col(f"p.{c}").alias(f"{c}_a") for c in rest], *[F.col(f"q.{c}").alias(f"{c}_b") for c in rest])


def _graded(boxes: DataFrame, by: list[str], sep: float) -> DataFrame:
    """Boxes with their size class (own) and all grids (level, w, h) of their ``by``."""
    level = F.ceil(F.log2(F.greatest(F.col("width"), F.col("height"), F.lit(1e-9)) + sep)).cast("int")
    sized = boxes.withColumn("own", level)
    sizes = sized.groupBy(*by, "own").agg(F.max("width").alias("w"), F.max("height").alias("h")).groupBy(*by).agg(F.collect_list(F.struct("own", "w", "h")).alias("sizes"))
    # as many entries as there are powers of two; a little wide, as quotients are rounded
    side = lambda g, c: F.greatest(F.array_max(F.transform(F.filter("sizes", lambda x: x.own <= g.own), lambda x: x[c])) + sep, F.lit(1e-9)) * (1 + 1e-9)
    grids = sizes.select(*by, F.transform("sizes", lambda g: F.struct(g.own.alias("level"), side(g, "w").alias("w"), side(g, "h").alias("h"))).alias("grids"))
    return sized.join(grids, by) if by else sized.crossJoin(F.broadcast(grids))  # one row


def close_pairs(boxes: DataFrame, by: list[str], sep: float) -> DataFrame:
    """Pairs ``name_a < name_b`` of boxes of the same ``by`` that may lie closer than ``sep``, every other column twice.

    A box's size class is the power of two of its larger side plus ``sep``. Each class has a grid whose cells are as wide
    and as high as the widest and the highest box of this and the smaller classes, plus ``sep``. In each pair the box
    of the larger class stands in the cell of its middle, the other one in the nine cells around its own of that class's
    grid, so no box is too large and cells stay as small as they can. Neither side of the join is broadcast."""
    rest = [c for c in boxes.columns if c not in by]
    sized = _graded(boxes, by, sep)
    dealt = lambda keep: sized.withColumn("g", F.explode(F.filter("grids", keep))).withColumn("level", F.col("g.level"))
    cx, cy = F.floor(F.col("x") / F.col("g.w")), F.floor(F.col("y") / F.col("g.h"))
    big = dealt(lambda g: g.level == F.col("own")).select(*by, "level", cx.alias("cx"), cy.alias("cy"), *[F.col(c).alias(f"{c}_a") for c in rest])
    small = _around(cx, cy, NINE)(dealt(lambda g: g.level >= F.col("own"))).select(*by, "level", "cx", "cy", "own", *[F.col(c).alias(f"{c}_b") for c in rest])
    met = big.hint("merge").join(small, [*by, "level", "cx", "cy"]).where("own < level OR name_a < name_b")
    turn = F.col("name_a") > F.col("name_b")
    return met.select(*by, *[x for c in rest for x in (F.when(turn, F.col(f"{c}_b")).otherwise(F.col(f"{c}_a")).alias(f"{c}_a"), F.when(turn, F.col(f"{c}_a")).otherwise(F.col(f"{c}_b")).alias(f"{c}_b"))])


def overlap_pairs(boxes: DataFrame, by: list[str], sep: float) -> DataFrame:
    """(by..., name_a, name_b) of boxes closer than ``sep`` on both axes, whatever their sizes.

    Size classes are those of ``close_pairs``. The cells of a class are as high as its highest box plus ``sep``, and eight
    times as wide as its widest; the larger box of a pair stands in the cell of its middle, the other one in all cells it
    may reach. A cell's boxes are in a task at once, sorted by x, and meet in arrays; no side is broadcast."""
    apart = [*by, "name", "x", "y", "width", "height"]
    sized = _graded(boxes.select(*apart).dropna(), by, sep)
    dealt = sized.withColumn("g", F.explode(F.filter("grids", lambda g: g.level >= F.col("own"))))
    wide, high = F.col("g.w") * 8, F.col("g.h")
    # a little wide, as quotients are rounded
    cells = lambda c, size, cell, most: F.explode(F.sequence(F.floor((F.col(c) - (F.col(size) + most + sep) / 2 * (1 + 1e-9)) / cell), F.floor((F.col(c) + (F.col(size) + most + sep) / 2 * (1 + 1e-9)) / cell)))
    dealt = dealt.withColumn("cx", cells("x", "width", wide, F.col("g.w"))).withColumn("cy", cells("y", "height", high, F.col("g.h")))
    same = F.col("own") == F.col("g.level")
    home = same & (F.col("cx") == F.floor(F.col("x") / wide)) & (F.col("cy") == F.floor(F.col("y") / high))
    cell = [*by, "level", "cx", "cy"]
    dealt = dealt.select(*apart, F.col("g.level").alias("level"), "cx", "cy", same.alias("same"), home.alias("home"))
    spark = boxes.sparkSession
    tasks = max(8 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    first = F.row_number().over(Window.partitionBy(*cell).orderBy("x")) == 1
    rows = dealt.repartition(tasks, *cell).withColumn("first", first).select(*apart, "same", "home", "first")
    kind = dict(boxes.dtypes)
    schema = ", ".join([*[f"`{c}` {kind[c]}" for c in by], f"name_a {kind['name']}", f"name_b {kind['name']}"])
    return rows.mapInArrow(strips.overlapping(by, sep), schema)


def repulsion(points: DataFrame, by: list[str], cell: float, k: float) -> DataFrame:
    """(by..., name, fx, fy): the push of nodes in touching cells, k^2 / distance^2 along the line between
    them; nodes at one place do not push."""
    cx, cy = F.floor(F.col("x") / cell), F.floor(F.col("y") / cell)
    left = points.select(*by, "name", F.col("x").alias("x_a"), F.col("y").alias("y_a"), cx.alias("cx"), cy.alias("cy"))
    right = _around(cx, cy, NINE)(points).select(*by, "cx", "cy", F.col("name").alias("name_b"), F.col("x").alias("x_b"), F.col("y").alias("y_b"))
    dx, dy = F.col("x_a") - F.col("x_b"), F.col("y_a") - F.col("y_b")
    d2 = dx * dx + dy * dy
    # the join hands over a node's pairs in a row, so they are summed before anything is shuffled
    near = left.hint("merge").join(right, [*by, "cx", "cy"]).where((F.col("name") != F.col("name_b")) & (d2 > 0))
    return near.groupBy(*by, "name").agg(F.sum(dx * (k * k) / d2).alias("fx"), F.sum(dy * (k * k) / d2).alias("fy"))


def stress_terms(dist: DataFrame, places: DataFrame, unit: float = 72.0) -> DataFrame:
    """(src, dst, term): the squared gap between wanted and drawn distance over the wanted distance squared."""
    a = places.select(F.col("name").alias("src"), F.col("x").alias("xa"), F.col("y").alias("ya"))
    b = places.select(F.col("name").alias("dst"), F.col("x").alias("xb"), F.col("y").alias("yb"))
    want = F.col("dist") * unit
    off = distance(F.col("xa"), F.col("ya"), F.col("xb"), F.col("yb")) - want
    return dist.join(a, "src").join(b, "dst").select("src", "dst", (off * off / (want * want)).alias("term"))


def cluster_areas(subs: DataFrame, sizes: DataFrame, margin: float = 8.0) -> DataFrame:
    """(sub_id, area) bottom-up: (2 margin + sqrt(members' and children's areas))^2. ``sizes``: (sub_id, area) of
    members. One join a level; the number of levels is the nesting depth."""
    own = sizes.groupBy("sub_id").agg(F.sum("area").alias("own"))
    tree = subs.select("sub_id", "parent_sub", "depth").join(own, "sub_id", "left").fillna(0.0, ["own"])
    depth = subs.agg(F.max("depth")).first()[0] or 0
    done = out = None
    for level in range(depth, 0, -1):
        here = tree.where(F.col("depth") == level)
        if done is not None:
            below = done.groupBy(F.col("parent_sub").alias("sub_id")).agg(F.sum("area").alias("below"))
            here = here.join(below, "sub_id", "left").fillna(0.0, ["below"]).withColumn("own", F.col("own") + F.col("below"))
        side = F.sqrt("own") + 2 * margin
        here = here.select("sub_id", "parent_sub", "depth", (side * side).alias("area"))
        # only the level just done has parents at the next one
        done, out = here, here if out is None else out.unionByName(here)
    return out.select("sub_id", "area") if depth else subs.select("sub_id", F.lit(0.0).alias("area"))


def cluster_crossings(segs: DataFrame, boxes: DataFrame, members: DataFrame, cell: float = 128.0) -> DataFrame:
    """(tail, head, sub_id): edges (tail, head, ax, ay, bx, by) whose segment meets the box (sub_id, llx, lly, urx, ury) of
    a cluster that holds neither end. Both are dealt to the grid cells of their extents and meet by equality of a cell."""
    span = lambda a, b: F.sequence(F.floor(F.least(a, b) / cell), F.floor(F.greatest(a, b) / cell))
    e = segs.withColumn("gx", F.explode(span(F.col("ax"), F.col("bx")))).withColumn("gy", F.explode(span(F.col("ay"), F.col("by"))))
    b = boxes.withColumn("gx", F.explode(span(F.col("llx"), F.col("urx")))).withColumn("gy", F.explode(span(F.col("lly"), F.col("ury"))))
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    side = lambda x, y: dx * (F.col(y) - F.col("ay")) - dy * (F.col(x) - F.col("ax"))
    corners = [side(x, y) for x in ("llx", "urx") for y in ("lly", "ury")]
    apart = (F.greatest("ax", "bx") < F.col("llx")) | (F.least("ax", "bx") > F.col("urx")) | (F.greatest("ay", "by") < F.col("lly")) | (F.least("ay", "by") > F.col("ury"))
    meets = ~apart & (F.least(*corners) <= 0) & (F.greatest(*corners) >= 0)
    hit = e.join(b, ["gx", "gy"]).where(meets).select("tail", "head", "sub_id").distinct()
    own = lambda c: members.select("sub_id", F.col("name").alias(c))
    return hit.join(own("tail"), ["sub_id", "tail"], "left_anti").join(own("head"), ["sub_id", "head"], "left_anti").select("tail", "head", "sub_id")
