"""JSON and GXL in and out, with attributes and subgraphs, and format detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.lexical import xml_escape
from weft.operators.basic import shown

_ITEMS = "array<map<string,string>>"
JSON_SCHEMA = f"name string, directed boolean, strict boolean, objects {_ITEMS}, nodes {_ITEMS}, edges {_ITEMS}"


def detect(name: Column, text: Column) -> Column:
    """Format by suffix, else by how the text starts."""
    t = F.ltrim(text)
    return (
        F.when(F.lower(name).endswith(".json"), "json").when(F.lower(name).rlike(r"\.(gxl|xml)$"), "gxl").when(F.lower(name).rlike(r"\.(dot|gv)$"), "dot")
        .when(t.startswith("{"), "json").when(t.startswith("<?xml") | t.startswith("<gxl"), "gxl").otherwise("dot")
    )


def _attrs(df: DataFrame) -> Column:
    """The attributes that a writer emits; a table without any has none."""
    return shown(F.col("attrs")) if "attrs" in df.columns else F.create_map().cast("map<string,string>")


def _listed(df: DataFrame, by: str, number: Column, texts: Column, name: str) -> DataFrame:
    """(by, name): the JSON objects of a group as one array text, by their number. ``number``: the text of the numeric
    members; ``texts``: a map of the others."""
    rows = df.select(by, F.col("_gvid"), number.alias("number"), texts.alias("texts"))
    line = F.concat(F.lit("{"), "number", F.when(F.size("texts") > 0, F.concat(F.lit(","), F.substr(F.to_json("texts"), F.lit(2)))).otherwise(F.lit("}")))
    each = rows.select(by, "_gvid", line.alias("line")).groupBy(by).agg(F.array_sort(F.collect_list(F.struct("_gvid", "line"))).alias("v"))
    return each.select(by, F.concat(F.lit("["), F.array_join(F.transform("v", lambda x: x["line"]), ","), F.lit("]")).alias(name))


def write_json(nodes: DataFrame, edges: DataFrame, by: str, directed: bool = True, members: DataFrame | None = None) -> DataFrame:
    """(by, json): nodes (by, name[, attrs]) numbered from 0 by name, edges (by, tail, head[, attrs]) by (tail, head)
    number; labels default to names. ``members`` (by, sub, name) become objects, numbered before the nodes."""
    subs = members.select(by, "sub").distinct().withColumn("_gvid", F.row_number().over(Window.partitionBy(by).orderBy("sub")) - 1) if members is not None else None
    ids = nodes.select(by, "name", _attrs(nodes).alias("attrs"), (F.row_number().over(Window.partitionBy(by).orderBy("name")) - 1).alias("_gvid"))
    if subs is not None:
        ids = ids.join(subs.groupBy(by).agg(F.count("*").alias("before")), by, "left").withColumn("_gvid", F.col("_gvid") + F.coalesce("before", F.lit(0))).drop("before")
    gvid = F.concat(F.lit('"_gvid":'), F.col("_gvid").cast("string"))
    fixed = lambda **kv: F.map_concat(F.map_filter(F.create_map(*[x for k, v in kv.items() for x in (F.lit(k), v)]), lambda k, _: ~F.map_contains_key(F.col("attrs"), k)), F.col("attrs"))
    n = _listed(ids, by, gvid, fixed(name=F.col("name"), label=F.col("name")), "nodes")
    t, h = ids.select(by, F.col("name").alias("tail"), F.col("_gvid").alias("t")), ids.select(by, F.col("name").alias("head"), F.col("_gvid").alias("h"))
    e = edges.select(by, "tail", "head", _attrs(edges).alias("attrs")).join(t, [by, "tail"]).join(h, [by, "head"])
    e = e.withColumn("_gvid", F.row_number().over(Window.partitionBy(by).orderBy("t", "h", F.to_json("attrs"))) - 1)
    ends = F.concat(gvid, F.lit(',"tail":'), F.col("t").cast("string"), F.lit(',"head":'), F.col("h").cast("string"))
    e = _listed(e, by, ends, F.col("attrs"), "edges")
    out = n.join(e, by, "left")
    objects = F.lit("[]")
    if subs is not None:
        inside = members.join(ids.select(by, "name", F.col("_gvid").alias("id")), [by, "name"]).groupBy(by, "sub").agg(F.array_join(F.transform(F.array_sort(F.collect_set("id")), lambda x: x.cast("string")), ",").alias("ids"))
        o = subs.join(inside, [by, "sub"], "left")
        held = F.concat(gvid, F.lit(',"nodes":['), F.coalesce("ids", F.lit("")), F.lit("]"))
        out = out.join(_listed(o, by, held, F.create_map(F.lit("name"), F.col("sub")), "objects"), by, "left")
        objects = F.coalesce("objects", F.lit("[]"))
    head = F.substr(F.to_json(F.struct(F.col(by).cast("string").alias("name"), F.lit(directed).alias("directed"))), F.lit(2))
    return out.select(by, F.concat(F.lit("{"), F.regexp_replace(head, "}$", ""), F.lit(',"objects":'), objects, F.lit(',"nodes":'), "nodes", F.lit(',"edges":'), F.coalesce("edges", F.lit("[]")), F.lit("}")).alias("json"))


def _rest(item: str, *own: str) -> Column:
    return F.map_filter(F.col(item), lambda k, _: ~k.isin(*own))


def read_json_attrs(texts: DataFrame, by: str, content: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes (by, name, attrs), edges (by, tail, head, attrs), members (by, sub, name)) of graph JSON texts; text that
    is no JSON gives no rows."""
    g = texts.select(by, F.from_json(content, JSON_SCHEMA).alias("_doc"))
    nodes = g.select(by, F.explode("_doc.nodes").alias("_n")).select(by, F.col("_n")["_gvid"].alias("id"), F.col("_n")["name"].alias("name"), _rest("_n", "_gvid", "name").alias("attrs"))
    edges = g.select(by, F.explode("_doc.edges").alias("_e")).select(by, F.col("_e")["tail"].alias("t"), F.col("_e")["head"].alias("h"), _rest("_e", "_gvid", "tail", "head").alias("attrs"))
    name = lambda k, to: nodes.select(by, F.col("id").alias(k), F.col("name").alias(to))
    edges = edges.join(name("t", "tail"), [by, "t"]).join(name("h", "head"), [by, "h"]).select(by, "tail", "head", "attrs")
    objects = g.select(by, F.explode("_doc.objects").alias("_o")).where("_o['nodes'] IS NOT NULL").select(by, F.col("_o")["name"].alias("sub"), F.explode(F.from_json(F.col("_o")["nodes"], "array<string>")).alias("id"))
    return nodes.select(by, "name", "attrs"), edges, objects.join(nodes, [by, "id"]).select(by, "sub", "name")


def read_json(texts: DataFrame, by: str, content: str) -> tuple[DataFrame, DataFrame]:
    """(nodes (by, name), edges (by, tail, head)) of graph JSON texts."""
    nodes, edges, _ = read_json_attrs(texts, by, content)
    return nodes.select(by, "name"), edges.select(by, "tail", "head")


def _gxl_attrs(df: DataFrame, close: str) -> Column:
    """The rest of a GXL element: typed attributes inside it, or nothing."""
    kind = lambda v: F.when(v.rlike(r"^-?\d{1,9}$"), "int").when(v.rlike(r"^-?\d+\.\d+$"), "float").when(v.isin("true", "false"), "bool").otherwise("string")
    one = lambda x: F.concat(F.lit('<attr name="'), xml_escape(x["key"]), F.lit('"><'), kind(x["value"]), F.lit(">"), xml_escape(x["value"]), F.lit("</"), kind(x["value"]), F.lit("></attr>"))
    attrs = _attrs(df)
    return F.when(F.size(attrs) > 0, F.concat(F.lit(">"), F.array_join(F.transform(F.array_sort(F.map_entries(attrs)), one), ""), F.lit(f"</{close}>"))).otherwise(F.lit("/>"))


def write_gxl(nodes: DataFrame, edges: DataFrame, by: str, directed: bool = True) -> DataFrame:
    """(by, xml): nodes (by, name[, attrs]), edges (by, tail, head[, attrs]); whole numbers, decimals and flags are typed."""
    n = nodes.select(by, F.lit(0).alias("part"), F.col("name").alias("a"), F.lit("").alias("b"), F.concat(F.lit('<node id="'), xml_escape(F.col("name")), F.lit('"'), _gxl_attrs(nodes, "node")).alias("line"))
    ends = F.concat(F.lit('<edge from="'), xml_escape(F.col("tail")), F.lit('" to="'), xml_escape(F.col("head")), F.lit('"'))
    e = edges.select(by, F.lit(1).alias("part"), F.col("tail").alias("a"), F.col("head").alias("b"), F.concat(ends, _gxl_attrs(edges, "edge")).alias("line"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "a", "b", "line"))), lambda x: x["line"]), "\n")
    head = F.concat(F.lit('<gxl><graph id="'), xml_escape(F.col(by).cast("string")), F.lit(f'" edgemode="{"directed" if directed else "undirected"}">\n'))
    return n.unionByName(e).groupBy(by).agg(lines.alias("body")).select(by, F.concat(head, "body", F.lit("\n</graph></gxl>")).alias("xml"))


def gxl_rows(texts: DataFrame, by: str, content: str) -> DataFrame:
    """Statement rows, as the DOT reader gives them (file = by), of GXL texts; a graph inside a node is a subgraph, its
    nodes its members. Text that is no XML gives no rows."""
    import pandas as pd

    from weft.sources.dot import SCHEMA

    def attrs(item) -> dict:
        return {a.get("name"): "".join("".join(v.itertext()) for v in a) for a in item.findall("attr")}

    def walk(graph, number: int, sub, rows: list) -> None:
        add = lambda kind, **kv: rows.append(dict(graph=number, kind=kind, name=None, tail=None, head=None, ekey=None, sub=sub, parent=None, seq=len(rows), attrs={}) | kv)
        for item in graph:
            inner = item.find("graph")
            if item.tag == "node" and inner is not None:
                name = inner.get("id") or item.get("id")
                add("subgraph", name=name, sub=name, parent=sub, attrs=attrs(item))
                walk(inner, number, name, rows)
            elif item.tag == "node":
                add("node", name=item.get("id"), attrs=attrs(item))
                if sub is not None:
                    add("member", name=item.get("id"))
            elif item.tag == "edge":
                add("edge", tail=item.get("from"), head=item.get("to"), ekey=item.get("id"), attrs=attrs(item))
        if found := attrs(graph):
            add("graph_attr", attrs=found)

    def run(frames):
        import xml.etree.ElementTree as ET

        for pdf in frames:
            for f, text in zip(pdf["file"], pdf["content"]):
                try:
                    top = ET.fromstring(text or "")
                except ET.ParseError:
                    continue
                rows: list = []
                for k, g in enumerate(top.findall("graph")):
                    rows.append(dict(graph=k, kind="graph", name=g.get("id"), tail=None, head=None, ekey=None, sub=None, parent=None, seq=len(rows), attrs={"directed": str(g.get("edgemode", "directed") == "directed").lower(), "strict": "false"}))
                    walk(g, k, None, rows)
                if rows:
                    out = pd.DataFrame(rows)
                    out.insert(0, "file", f)
                    yield out

    return texts.select(F.col(by).cast("string").alias("file"), F.col(content).alias("content")).mapInPandas(run, SCHEMA)


def read_gxl(texts: DataFrame, by: str, content: str) -> tuple[DataFrame, DataFrame]:
    x = lambda path: F.xpath(F.col(content), F.lit(path))
    nodes = texts.select(by, F.explode(x("//node/@id")).alias("name"))
    edges = texts.select(by, F.explode(F.arrays_zip(x("//edge/@from").alias("tail"), x("//edge/@to").alias("head"))).alias("e")).select(by, F.col("e.tail").alias("tail"), F.col("e.head").alias("head"))
    return nodes, edges
