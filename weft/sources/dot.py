"""DOT text in and out. One graph's text parses in one task; texts are parsed in parallel."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import lexical

_TOKEN = re.compile(r'//[^\n]*|/\*.*?\*/|(?<![^\n])#[^\n]*|"(?:\\.|[^"\\])*"|->|--|[{}\[\];,=:]|<|-?(?:\.\d+|\d+(?:\.\d*)?)|[A-Za-z_\x80-\uffff][\w\x80-\uffff]*', re.DOTALL)


def _tokens(text: str) -> list[str]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.search(text, at)
        if not m:
            break
        tok, at = m.group(), m.end()
        if tok == "<":  # HTML identifier: balanced angle brackets
            depth, end = 1, at
            while end < len(text) and depth:
                depth += {"<": 1, ">": -1}.get(text[end], 0)
                end += 1
            out.append(text[at - 1 : end])
            at = end
        elif not tok.startswith(("//", "/*", "#")):
            out.append(tok)
    return out


def _value(tok: str) -> str:
    if tok.startswith('"'):
        return re.sub(r'\\(["\\nl])', lambda m: {"n": "\n", "l": "\n"}.get(m.group(1), m.group(1)), tok[1:-1])
    return tok


class Parser:
    """Statements of one or more graphs as rows (graph, kind, name, tail, head, key, sub, parent, seq, attrs).

    ``compat`` keeps defaults set inside a subgraph in force after it; otherwise they are scoped."""

    def __init__(self, text: str, compat: bool = False):
        self.t, self.i, self.rows, self.compat = _tokens(text), 0, [], compat
        self.graph = -1

    def peek(self) -> str:
        return self.t[self.i] if self.i < len(self.t) else ""

    def take(self, want: str = "") -> str:
        tok = self.peek()
        if want and tok != want:
            return ""
        self.i += 1
        return tok

    def row(self, kind, name=None, tail=None, head=None, key=None, sub=None, parent=None, attrs=None):
        self.rows.append((self.graph, kind, name, tail, head, key, sub, parent, len(self.rows), dict(attrs or {})))

    def parse(self) -> list[tuple]:
        while self.i < len(self.t):
            strict = self.peek().lower() == "strict" and bool(self.take())
            kind = self.peek().lower()
            if kind not in ("graph", "digraph"):
                self.take()
                continue
            self.take()
            self.graph += 1
            self.subs, self.anon, self.nodes, self.members, self.edges = set(), 0, set(), {}, {}
            name = _value(self.take()) if self.peek() != "{" else ""
            self.row("graph", name, attrs={"directed": str(kind == "digraph").lower(), "strict": str(strict).lower()})
            self.strict = strict
            self.defaults = {"node": {}, "edge": {}, "graph": {}}
            if self.take("{"):
                self.block(None)
        return self.rows

    def block(self, sub) -> None:
        while self.peek() not in ("}", ""):
            self.statement(sub)
            self.take(";") or self.take(",")
        self.take("}")

    def attrs(self) -> dict:
        out: dict = {}
        while self.take("["):
            while self.peek() not in ("]", ""):
                k = _value(self.take())
                out[k] = _value(self.take()) if self.take("=") else "true"
                self.take(",") or self.take(";")
            self.take("]")
        return out

    def declare(self, name, sub, attrs=None, member=True) -> None:
        if name not in self.nodes:
            self.nodes.add(name)
            self.row("node", name, sub=sub if member else None, attrs=(self.defaults["node"] | (attrs or {})) if member else {})
        elif attrs:
            self.row("attr", name, attrs=attrs)
        if member and sub is not None and name not in self.members.setdefault(sub, []):
            self.members[sub].append(name)
            self.row("member", name, sub=sub)

    def endpoint(self, sub):
        """(names, port attrs, whether a subgraph)."""
        if self.peek().lower() == "subgraph" or self.peek() == "{":
            return self.subgraph(sub), "", True
        name, port = _value(self.take()), []
        while self.take(":"):
            port.append(_value(self.take()))
        return [name], ":".join(port), False

    def subgraph(self, parent) -> list[str]:
        name = None
        if self.peek().lower() == "subgraph":
            self.take()
            if self.peek() != "{":
                name = _value(self.take())
        if name is None:
            name = f"_anonymous_{self.anon}"
            self.anon += 1
        if name not in self.subs:
            self.subs.add(name)
            self.row("subgraph", name, sub=name, parent=parent)
        if self.take("{"):
            kept = {k: dict(v) for k, v in self.defaults.items()}
            self.block(name)
            if not self.compat:
                self.defaults = kept
        return list(self.members.get(name, []))

    def statement(self, sub) -> None:
        word = self.peek().lower()
        if word in ("node", "edge", "graph") and self.i + 1 < len(self.t) and self.t[self.i + 1] == "[":
            self.take()
            got = self.attrs()
            self.defaults[word] |= got
            if word == "graph":
                self.row("graph_attr", sub=sub, attrs=got)
            return
        if self.i + 1 < len(self.t) and self.t[self.i + 1] == "=":
            k = _value(self.take())
            self.take("=")
            self.row("graph_attr", sub=sub, attrs={k: _value(self.take())})
            return
        ends = [self.endpoint(sub)]
        while self.peek() in ("->", "--"):
            self.take()
            ends.append(self.endpoint(sub))
        got = self.attrs()
        if len(ends) == 1:
            if not ends[0][2]:
                self.declare(ends[0][0][0], sub, got)
            return
        for names, _, group in ends:
            if not group:
                self.declare(names[0], sub, member=not self.compat)
        for (left, lp, _), (right, rp, _) in zip(ends, ends[1:]):
            for a in left:
                for b in right:
                    self.edge(a, b, sub, self.defaults["edge"] | got | ({"tailport": lp} if lp else {}) | ({"headport": rp} if rp else {}))

    def edge(self, a, b, sub, attrs) -> None:
        if self.strict and (a == b or (a, b) in self.edges):
            return
        n = self.edges[a, b] = self.edges.get((a, b), 0) + 1
        self.row("edge", tail=a, head=b, key=attrs.pop("key", None) or (f"_e{n - 1}" if n > 1 else None), sub=sub, attrs=attrs)


SCHEMA = "file string, graph int, kind string, name string, tail string, head string, ekey string, sub string, parent string, seq long, attrs map<string,string>"


def parse_texts(texts: DataFrame, file: str = "file", content: str = "content", compat: bool = False) -> DataFrame:
    """(file, content) -> statement rows; text is reduced to printable ASCII first."""
    src = texts.select(F.col(file).cast("string").alias("file"), lexical.sanitize(F.col(content)).alias("content"))

    def run(frames):
        for pdf in frames:
            for f, text in zip(pdf["file"], pdf["content"]):
                rows = Parser(text or "", compat).parse()
                if rows:
                    out = pd.DataFrame(rows, columns=["graph", "kind", "name", "tail", "head", "ekey", "sub", "parent", "seq", "attrs"])
                    out.insert(0, "file", f)
                    yield out

    return src.mapInPandas(run, SCHEMA)


def read(spark: SparkSession, path: str, compat: bool = False) -> DataFrame:
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("content"))
    return parse_texts(text, compat=compat)


def write(nodes: DataFrame, edges: DataFrame, by: str, directed: bool = True) -> DataFrame:
    """(by, text): canonical DOT per graph; nodes (by, name, attrs), edges (by, tail, head, attrs)."""
    arrow = " -> " if directed else " -- "

    def listed(attrs):
        kv = F.transform(F.array_sort(F.map_entries(attrs)), lambda e: F.concat(e["key"], F.lit("="), lexical.quote(e["value"])))
        return F.when(F.coalesce(F.size(attrs), F.lit(0)) > 0, F.concat(F.lit(" ["), F.array_join(kv, ", "), F.lit("]"))).otherwise("")

    n = nodes.select(by, F.lit(0).alias("part"), F.col("name").alias("a"), F.lit("").alias("b"), F.concat(F.lit("  "), lexical.quote(F.col("name")), listed(F.col("attrs")), F.lit(";")).alias("line"))
    e = edges.select(by, F.lit(1).alias("part"), F.col("tail").alias("a"), F.col("head").alias("b"), F.concat(F.lit("  "), lexical.quote(F.col("tail")), F.lit(arrow), lexical.quote(F.col("head")), listed(F.col("attrs")), F.lit(";")).alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("part", "a", "b", "line"))), lambda x: x["line"])
    head = F.concat(F.lit("digraph " if directed else "graph "), lexical.quote(F.col(by).cast("string")), F.lit(" {\n"))
    return n.unionByName(e).groupBy(by).agg(lines.alias("lines")).select(by, F.concat(head, F.array_join("lines", "\n"), F.lit("\n}\n")).alias("text"))


_BARE = re.compile(r"[A-Za-z_\x80-\uffff][\w\x80-\uffff]*|-?(?:\.\d+|\d+(?:\.\d*)?)")
_KEYWORDS = {"graph", "digraph", "subgraph", "node", "edge", "strict"}


def _id(text: str) -> str:
    """A DOT identifier: bare, HTML, or quoted."""
    if _BARE.fullmatch(text) and text.lower() not in _KEYWORDS or text.startswith("<") and text.endswith(">"):
        return text
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'


def _bracket(attrs: dict) -> str:
    return " [" + ", ".join(f"{_id(k)}={_id(v)}" for k, v in sorted(attrs.items())) + "]" if attrs else ""


def canonical(rows: list[dict]) -> str:
    """The DOT text of one graph's statement rows: attributes sorted, nodes and edges inside their deepest subgraph, each
    once, in the order they came."""
    graph = next(r for r in rows if r["kind"] == "graph")
    arrow = " -> " if graph["attrs"].get("directed") == "true" else " -- "
    head = ("strict " if graph["attrs"].get("strict") == "true" else "") + ("digraph" if arrow == " -> " else "graph") + (f" {_id(graph['name'])}" if graph["name"] else "")
    nodes: dict = {}
    for r in rows:
        if r["kind"] in ("node", "attr"):
            nodes.setdefault(r["name"], {}).update(r["attrs"])
    subs = {r["name"]: r for r in rows if r["kind"] == "subgraph"}
    depth: dict = {None: 0}
    for name, r in subs.items():  # parents come first
        depth[name] = depth.get(r["parent"], 0) + 1
    home: dict = {}
    for r in rows:
        if r["kind"] == "member" and depth[r["sub"]] > depth[home.get(r["name"])]:
            home[r["name"]] = r["sub"]

    def block(sub, pad: str) -> list[str]:
        out = [f"{pad}{_id(k)}={_id(v)};" for r in rows if r["kind"] == "graph_attr" and r["sub"] == sub for k, v in sorted(r["attrs"].items())]
        for name, r in subs.items():
            if r["parent"] == sub:
                out += [f"{pad}subgraph {_id(name)} {{", *block(name, pad + "  "), pad + "}"]
        out += [f"{pad}{_id(n)}{_bracket(a)};" for n, a in nodes.items() if home.get(n) == sub]
        if sub is not None:  # members whose home is another subgraph
            out += [f"{pad}{_id(r['name'])};" for r in rows if r["kind"] == "member" and r["sub"] == sub and home[r["name"]] != sub]
        for r in rows:
            if r["kind"] == "edge" and r["sub"] == sub:
                ports = {k: v for k, v in r["attrs"].items() if k not in ("tailport", "headport")}
                end = lambda name, port: _id(name) + "".join(":" + _id(p) for p in r["attrs"].get(port, "").split(":") if p)
                key = {"key": r["ekey"]} if r["ekey"] and not re.fullmatch(r"_e\d+", r["ekey"]) else {}
                out.append(f"{pad}{end(r['tail'], 'tailport')}{arrow}{end(r['head'], 'headport')}{_bracket(ports | key)};")
        return out

    return "\n".join([head + " {", *block(None, "  "), "}", ""])


def problems(text: str) -> list[str]:
    """What keeps a text from being DOT: characters outside the grammar, and brackets that do not match."""
    out, at, open_ = [], 0, []
    pairs = {"}": "{", "]": "["}
    while at < len(text):
        m = _TOKEN.search(text, at)
        gap = text[at : m.start() if m else len(text)].strip()
        if gap:
            out.append(f"unexpected {gap[:20]!r}")
        if not m:
            break
        tok, at = m.group(), m.end()
        if tok == "<":
            depth = 1
            while at < len(text) and depth:
                depth += {"<": 1, ">": -1}.get(text[at], 0)
                at += 1
            if depth:
                out.append("unclosed <")
        elif tok in "{[":
            open_.append(tok)
        elif tok in pairs and (not open_ or open_.pop() != pairs[tok]):
            out.append(f"unmatched {tok}")
    out += [f"unclosed {c}" for c in open_]
    if not any(t.lower() in ("graph", "digraph") for t in _tokens(text)):
        out.append("no graph")
    return out


def write_rows(rows: DataFrame) -> DataFrame:
    """(file, graph, text): canonical DOT of statement rows with their subgraphs and attributes; a graph must fit a task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        table = pdf.sort_values("seq").astype(object).where(pdf.sort_values("seq").notna(), None).to_dict("records")
        for r in table:
            r["attrs"] = dict(r["attrs"] or {})
        return pd.DataFrame({"file": [pdf["file"].iloc[0]], "graph": [int(pdf["graph"].iloc[0])], "text": [canonical(table)]})

    return rows.groupBy("file", "graph").applyInPandas(run, "file string, graph int, text string")


def canonicalize(texts: DataFrame, file: str = "file", content: str = "content") -> DataFrame:
    """Read and write: (file, graph, text)."""
    return write_rows(parse_texts(texts, file, content))


def validate(texts: DataFrame, file: str = "file", content: str = "content") -> DataFrame:
    """(file, problem): one row for each fault of a text, none for good ones."""

    def run(frames):
        for pdf in frames:
            found = [(f, p) for f, t in zip(pdf["file"], pdf["content"]) for p in problems(t or "")]
            yield pd.DataFrame(found, columns=["file", "problem"])

    return texts.select(F.col(file).cast("string").alias("file"), F.col(content).alias("content")).mapInPandas(run, "file string, problem string")
