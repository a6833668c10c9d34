"""Colours: palettes, names, HSV triples, degree shades."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The component palette, the edge palette and the basic colour names.
COMPONENT_PALETTE = "red blue green orange purple brown cyan magenta olive teal navy maroon lime aqua fuchsia silver coral salmon".split()
EDGE_PALETTE = "#e41a1c #377eb8 #4daf4a #984ea3 #ff7f00 #a65628 #f781bf #999999 #66c2a5 #fc8d62 #8da0cb #e78ac3 #a6d854 #ffd92f #e5c494".split()
NAMES = {
    "black": "#000000", "white": "#ffffff", "red": "#ff0000", "green": "#008000", "blue": "#0000ff", "orange": "#ffa500", "purple": "#800080",
    "brown": "#a52a2a", "cyan": "#00ffff", "magenta": "#ff00ff", "olive": "#808000", "teal": "#008080", "navy": "#000080", "maroon": "#800000",
    "lime": "#00ff00", "aqua": "#00ffff", "fuchsia": "#ff00ff", "silver": "#c0c0c0", "gray": "#808080", "yellow": "#ffff00", "coral": "#ff7f50", "salmon": "#fa8072",
}


def palette_sql(palette: list[str]) -> str:
    return "[" + ", ".join(f"'{c}'" for c in palette) + "]"


def pick(palette: list[str], ordinal: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in palette]), (F.pmod(ordinal, F.lit(len(palette))) + 1).cast("int"))


def by_degree(degree: Column, top: Column) -> Column:
    v = F.floor(255 * (1 - degree / top)).cast("int")
    return F.format_string("#%02x%02xff", v, v)


def from_hsv(h: Column, s: Column, v: Column) -> Column:
    """#rrggbb of an HSV triple in [0, 1]."""
    i = F.floor(h * 6)
    f = h * 6 - i
    p, q, t = v * (1 - s), v * (1 - s * f), v * (1 - s * (1 - f))
    k = F.pmod(i, F.lit(6))
    choose = lambda *c: F.element_at(F.array(*c), (k + 1).cast("int"))
    part = lambda x: F.format_string("%02x", F.floor(x * 255).cast("int"))
    return F.concat(F.lit("#"), part(choose(v, q, p, p, t, v)), part(choose(t, v, v, q, p, p)), part(choose(p, p, t, v, v, q)))


def resolve(spec: Column) -> Column:
    """Hex passes, a known name gives its hex, three numbers are HSV, all else stays."""
    table = F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv])
    parts = F.split(F.trim(spec), r"[\s,]+")
    number = lambda i: F.when(F.size(parts) == 3, F.get(parts, F.lit(i)).try_cast("double"))
    h, sat, v = number(0), number(1), number(2)
    triple = F.when(h.isNotNull() & sat.isNotNull() & v.isNotNull(), from_hsv(h, sat, v))
    return F.when(spec.startswith("#"), spec).otherwise(F.coalesce(F.try_element_at(table, F.lower(spec)), triple, spec))
