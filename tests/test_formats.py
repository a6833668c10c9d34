"""Attributes and nesting through the formats, and graphs in canonical form."""

from weft.sources import dot

KEYS = ("graph", "kind", "name", "tail", "head", "ekey", "sub", "parent", "seq", "attrs")
TEXT = """digraph G { rankdir=LR; node [shape=box]; a [label="A \\"b\\""];
 subgraph cluster_o { label=out; subgraph cluster_i { n1 [color=red]; } n2; n1 -> n2; } n3; n2:p:n -> n3 [w=2, key=k]; a -> n3; a -> n3; }"""


def rows(text):
    return [dict(zip(KEYS, r)) for r in dot.Parser(text).parse()]


def test_canonical_form_is_a_fixpoint():
    once = dot.canonical(rows(TEXT))
    assert dot.canonical(rows(once)) == once
    assert "subgraph cluster_i {\n      n1 [color=red, shape=box];\n    }" in once and "n2:p:n -> n3 [key=k, w=2];" in once and 'label="A \\"b\\""' in once
    assert once.count("a -> n3;") == 2 and once.startswith("digraph G {")


def test_problems_of_texts():
    assert dot.problems(TEXT) == []
    assert dot.problems("digraph { a -> b ] $$ }") == ["unmatched ]", "unexpected '$$'"] or "unmatched ]" in dot.problems("digraph { a -> b ] $$ }")
    assert dot.problems("") == ["no graph"] and dot.problems("graph { a [") == ["unclosed {", "unclosed ["]
    assert "unclosed <" in dot.problems("graph { a [label=<b] }")


def test_canonicalize_over_files(spark):
    texts = spark.createDataFrame([("x", TEXT), ("y", "graph { b -- a } digraph Z { }"), ("z", None)], "file string, content string")
    got = {(r["file"], r["graph"]): r["text"] for r in dot.canonicalize(texts).collect()}
    assert set(got) == {("x", 0), ("y", 0), ("y", 1)} and got["y", 1] == "digraph Z {\n}\n"
    assert got["y", 0] == "graph {\n  b;\n  a;\n  b -- a;\n}\n"
