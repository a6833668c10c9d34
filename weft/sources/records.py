"""Record labels: ``a|<port>b|{c|d}`` as rows of fields with their places."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Padding of a field around its text (points), and its line height as a multiple of the font size.
PAD_X, PAD_Y, LINE = 16.0, 8.0, 1.2
GLYPH = 0.52  # mean width of a character as a multiple of the font size
FIELD = "struct<path:string,port:string,text:string,leaf:boolean,lr:boolean,x:double,y:double,width:double,height:double>"


class Field:
    """A field of the tree: a leaf with text, or a row (``lr``) or column of fields. x, y: the top left corner."""

    __slots__ = ("port", "text", "kids", "lr", "x", "y", "width", "height")

    def __init__(self, lr: bool):
        self.port, self.text, self.kids, self.lr = "", "", [], lr
        self.x = self.y = self.width = self.height = 0.0


def parse(label: str, lr: bool = True) -> Field:
    """The field tree; every level of braces turns the direction, and braces around the whole label turn the
    root's. A backslash keeps a separator in the text. Unbalanced labels are one field of plain text."""
    root = Field(lr)
    open_, cur, at = [root], Field(not lr), 0
    bare: list[str] = []
    while at < len(label):
        c = label[at]
        if c == "\\" and at + 1 < len(label):
            bare.append(label[at + 1] if label[at + 1] in "{}|<> " else label[at : at + 2])
            at += 2
            continue
        if c == "<" and ">" in label[at:]:
            end = label.index(">", at)
            cur.port = label[at + 1 : end].strip()
            at = end
        elif c in "|}":
            cur.text = "".join(bare).strip()
            open_[-1].kids.append(cur)
            bare = []
            if c == "|":
                cur = Field(not open_[-1].lr)
            elif len(open_) == 1:
                return _plain(label, lr)
            else:
                cur = open_.pop()
                at += 1
                while at < len(label) and label[at] == " ":
                    at += 1
                if at < len(label) and label[at] not in "|}":
                    return _plain(label, lr)
                continue
        elif c == "{":
            if "".join(bare).strip() or cur.kids:
                return _plain(label, lr)
            bare = []
            open_.append(cur)
            cur = Field(not open_[-1].lr)
        else:
            bare.append(c)
        at += 1
    if len(open_) > 1:
        return _plain(label, lr)
    cur.text = "".join(bare).strip()
    root.kids.append(cur)
    if len(root.kids) == 1:
        only = root.kids[0]
        if only.kids:
            return only
        root.kids, root.port, root.text = [], only.port, only.text
    return root


def _plain(label: str, lr: bool) -> Field:
    out = Field(lr)
    out.text = label
    return out


def walk(root: Field) -> list[tuple[str, Field]]:
    """(path, field) parents first; the root's path is empty."""
    out, todo = [], [("", root)]
    while todo:
        path, f = todo.pop()
        out.append((path, f))
        todo += [(f"{path}.{k}" if path else str(k), c) for k, c in reversed(list(enumerate(f.kids)))]
    return out


def measure(root: Field, size: float = 14.0) -> None:
    """Natural widths and heights from the leaves up, then corners from the root down; a field takes the full
    height of its row or width of its column."""
    order = [f for _, f in walk(root)]
    for f in reversed(order):
        if f.kids:
            along, across = [(c.width, c.height) for c in f.kids], [(c.height, c.width) for c in f.kids]
            long, wide = sum(a for a, _ in (along if f.lr else across)), max(b for _, b in (along if f.lr else across))
            f.width, f.height = (long, wide) if f.lr else (wide, long)
        else:
            f.width, f.height = max(1, len(f.text)) * GLYPH * size + PAD_X, LINE * size + PAD_Y
    for f in order:
        at = f.x if f.lr else f.y
        for c in f.kids:
            if f.lr:
                c.x, c.y, c.height = at, f.y, f.height
                at += c.width
            else:
                c.x, c.y, c.width = f.x, at, f.width
                at += c.height
            _stretch(c)


def _stretch(f: Field) -> None:
    """Shares what a field gained along its own direction among its children, by their natural sizes."""
    side = "width" if f.lr else "height"
    total = sum(getattr(c, side) for c in f.kids)
    for c in f.kids:
        setattr(c, side, getattr(c, side) / total * getattr(f, side))


def port_center(root: Field, port: str) -> tuple[float, float] | None:
    """The middle of the field with this port, from the record's top left corner."""
    return next(((f.x + f.width / 2, f.y + f.height / 2) for _, f in walk(root) if f.port == port), None)


def fields(labels: DataFrame, by: str, column: str = "label", size: float = 14.0, lr: bool = True) -> DataFrame:
    """(by, path, port, text, leaf, lr, x, y, width, height): one row per field of every label; a null label has no rows."""

    @pandas_udf(f"array<{FIELD}>")
    def parsed(col: pd.Series) -> pd.Series:
        def one(label):
            if label is None:
                return None
            root = parse(label, lr)
            measure(root, size)
            return [dict(path=p, port=f.port, text=f.text, leaf=not f.kids, lr=f.lr, x=f.x, y=f.y, width=f.width, height=f.height) for p, f in walk(root)]

        return col.map(one)

    return labels.select(by, F.explode(parsed(column)).alias("f")).select(by, "f.*")
