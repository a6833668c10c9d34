"""Lexical helpers of the graph text format and of command-line attributes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The reserved words.
RESERVED = ("node", "edge", "graph", "digraph", "subgraph", "strict")


def needs_quotes(s: Column) -> Column:
    bare = s.rlike(r"^[A-Za-z_][A-Za-z_0-9]*$") & ~F.lower(s).isin(*RESERVED)
    return ~(bare | s.rlike(r"^-?(\.[0-9]+|[0-9]+(\.[0-9]*)?)$"))


def quote(s: Column) -> Column:
    escaped = F.replace(F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    return F.when(needs_quotes(s), F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(s)


def sanitize(s: Column) -> Column:
    """Everything but tab, line breaks and printable ASCII becomes an underscore."""
    return F.regexp_replace(s, r"[^\t\n\r\x20-\x7E]", "_")


def parse_attr(s: Column) -> tuple[Column, Column]:
    """``key=value`` -> (key, value); a bare key means true."""
    at = F.locate("=", s)
    return F.when(at > 0, F.substr(s, F.lit(1), at - 1)).otherwise(s), F.when(at > 0, F.substr(s, at + 1)).otherwise(F.lit("true"))


def xml_escape(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def node_size(label: Column, size: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """Width and height (points) of a node from its label, font size and inch attributes."""
    lines = F.split(label, "\n")
    longest = F.array_max(F.transform(lines, F.length))
    w = F.greatest(longest * 0.52 * size + 16, F.coalesce(width * 72, F.lit(54.0)))
    return w, F.greatest(F.size(lines) * 1.2 * size + 8, F.coalesce(height * 72, F.lit(36.0)))
