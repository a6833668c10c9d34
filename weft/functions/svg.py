"""SVG fragments as string expressions, one per row, and their ordered union per drawing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.lexical import xml_escape

# Corner counts and first angle (degrees) of the regular shapes.
SHAPES = {"diamond": (4, 0), "triangle": (3, -90), "invtriangle": (3, 90), "pentagon": (5, -90), "hexagon": (6, 0), "septagon": (7, -90), "octagon": (8, 22.5)}


def _num(x: Column) -> Column:
    return F.format_string("%.2f", x)


def polygon(x, y, rx, ry, corners: int, start: float) -> Column:
    points = F.transform(F.sequence(F.lit(0), F.lit(corners - 1)), lambda k: F.concat(_num(x + rx * F.cos(F.lit(math.radians(start)) + k * (2 * math.pi / corners))), F.lit(","), _num(y + ry * F.sin(F.lit(math.radians(start)) + k * (2 * math.pi / corners)))))
    return F.concat(F.lit('<polygon points="'), F.array_join(points, " "), F.lit('"/>'))


def node(shape: Column, x: Column, y: Column, w: Column, h: Column, label: Column) -> Column:
    """A node's outline and label."""
    rx, ry = w / 2, h / 2
    box = F.concat(F.lit('<rect x="'), _num(x - rx), F.lit('" y="'), _num(y - ry), F.lit('" width="'), _num(w), F.lit('" height="'), _num(h), F.lit('"/>'))
    round_ = F.concat(F.lit('<ellipse cx="'), _num(x), F.lit('" cy="'), _num(y), F.lit('" rx="'), _num(rx), F.lit('" ry="'), _num(ry), F.lit('"/>'))
    out = F.when(shape.isin("box", "rect", "rectangle", "square", "record"), box).when(shape.isin("plaintext", "plain", "none"), F.lit(""))
    for name, (corners, start) in SHAPES.items():
        out = out.when(shape == name, polygon(x, y, rx, ry, corners, start))
    text = F.concat(F.lit('<text x="'), _num(x), F.lit('" y="'), _num(y), F.lit('">'), xml_escape(label), F.lit("</text>"))
    return F.concat(F.lit("<g>"), out.otherwise(round_), text, F.lit("</g>"))


def edge(x1, y1, x2, y2) -> Column:
    return F.concat(F.lit('<path d="M'), _num(x1), F.lit(","), _num(y1), F.lit(" L"), _num(x2), F.lit(","), _num(y2), F.lit('"/>'))


def drawing(parts: DataFrame, by: str) -> DataFrame:
    """parts (by, layer, seq, fragment) -> (by, svg)."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("layer", "seq", "fragment"))), lambda p: p["fragment"])
    return parts.groupBy(by).agg(F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg">'), F.array_join(ordered, ""), F.lit("</svg>")).alias("svg"))
