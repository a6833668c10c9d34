"""N-gram Jaccard self-join with signature trees.

A document's set holds its distinct 5-word shingles (64-bit hashes; texts with equal sets are one node).
Two sets link when |a & b| / |a | b| >= 0.8.

Sharding loses no link. Shingles stand in one order for the whole corpus; two sets that link share a shingle
among the first ``n - ceil(0.8 n) + 1`` of each (what is left of either set is too small to link them), so every
set goes to the shards of these shingles, its prefix, and linked sets meet in one at least. Shingles that many
documents share stand last in the order (a fixed-size table of levels says which; any table gives the same links),
so that sets meet over rare ones. Shards with the same members are one block.

Within a block a signature tree is joined with itself: leaves hold sets, nodes the OR of their members' token
bitmaps, the size range, the most tokens any member lost to shared bits, and the range of the components known so
far. The dual traversal opens a pair of nodes only if their sizes can link and the maximum possible overlap,
``min(popcount(A & B) + min(lost), sizes)``, reaches what 0.8 takes for their size ranges.

Two rounds keep groups of copies cheap, and neither emits pairs. Round 1 looks at the ``FIRST`` blocks that hold
most of a set's shards, round 2 at every block whose members still lie in different components, across components
only. Each ships bitmaps and keeps the members that may link; for these it makes the sets, ships them once a
block, and confirms pairs exactly, passing over those connected meanwhile: a group of m near copies costs about m
comparisons. Blocks of more than ``BLOCK`` members are dealt as pairs of pieces, each a task, so all their pairs are
still compared. Texts whose sets are wanted are sifted by a fixed-size bitmap of text keys and hashed anew; whole
texts are never shuffled.

Edge cases: null text or no words: the empty set, n_shingles 0, linked with nothing, its own component;
fewer than five words: the whole sequence is the one shingle; equal texts are one node; rows with one doc_id are
rows of their own, each with its text's set; a null doc_id takes part and comes out null, its component the smallest
id of those reached, itself not counted (null only if there is none); an empty table gives no rows; very long
texts are shingled whole; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from weft.llm.common import Forest, arrow_map, components, mix64, release, sifted, sliced, stage, table, text_key

WIDTH = 5
PERCENT = 80
FIRST = 2
BLOCK = 1024
LEAF = 4
SIG_BITS = 2  # a token, in the bitmaps that travel; trees over sets at hand use more
TREE_BITS = 8
LEVEL_BITS = 20  # the table of levels has 2^20 one-byte places
WINDOW = 1 << 21  # shingles that a task counts at a time for the levels
OFTEN = 2  # documents of a window that make a shingle count as shared

_POWERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    words = (text or "").encode().lower().split()  # bytes: lowers A-Z only, splits at ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    h = np.array([xxh3_64_intdigest(w) for w in words], np.uint64)
    if len(h) < width:
        return mix64((h * _POWERS[: len(h)]).sum(keepdims=True) + np.uint64(len(h)))
    n = len(h) - width + 1
    s = h[:n] * _POWERS[0]
    for k in range(1, width):
        s += h[k : n + k] * _POWERS[k]
    return np.unique(mix64(s))


def node_of(s: np.ndarray) -> int:
    """The set's identity: a hash of its sorted members."""
    v = xxh3_64_intdigest(s.tobytes())
    return v - (1 << 64) if v >> 63 else v


def prefix(s: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The shingles whose shards the set goes to: its first ``n - ceil(0.8 n) + 1`` by (level, hash)."""
    least = len(s) - -(-PERCENT * len(s) // 100) + 1
    of = levels[s & np.uint64(len(levels) - 1)]
    if not of.any():
        return s[:least]
    return s[np.argsort(of, kind="stable")[:least]]


def signature(s: np.ndarray, per_token: int = SIG_BITS) -> np.ndarray:
    """Token bitmap of 64 x 2^k bits, up to ``per_token`` bits a token."""
    bits = max(64, 1 << int(len(s) * per_token - 1).bit_length() - 1)
    out = np.zeros(bits, bool)
    out[s & np.uint64(bits - 1)] = True
    return np.packbits(out, bitorder="little").view(np.uint64)


def needed(a, b):
    """Least overlap that links sets of these sizes."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def fold(rows: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (rows x words') brought down to fewer words; low hash bits pick the place, so halves overlay."""
    return rows if rows.shape[1] == words else np.bitwise_or.reduce(rows.reshape(len(rows), -1, words), 1)


class Tree:
    """A signature tree: level 0 holds the sets as they stand, every node of a level covers LEAF of the one below."""

    def __init__(self, sizes: np.ndarray, maps: np.ndarray, groups: np.ndarray):
        lost = sizes - np.bitwise_count(maps).sum(1, dtype=np.int64)
        self.levels = [(maps, sizes, sizes, lost, groups, groups)]
        while len(self.levels[-1][1]) > LEAF:
            m, lo, hi, l, g0, g1 = self.levels[-1]
            cut = np.arange(0, len(lo), LEAF)
            self.levels.append(
                (np.bitwise_or.reduceat(m, cut, 0), np.minimum.reduceat(lo, cut), np.maximum.reduceat(hi, cut), np.maximum.reduceat(l, cut), np.minimum.reduceat(g0, cut), np.maximum.reduceat(g1, cut))
            )

    def folded(self, words: int) -> "Tree":
        m, sizes, _, _, groups, _ = self.levels[0]
        return self if m.shape[1] == words else Tree(sizes, fold(m, words), groups)


def _open(a, i: np.ndarray, b, j: np.ndarray) -> np.ndarray:
    """Which node pairs can hold a linked pair: across groups, by size ranges, then by maximum possible overlap."""
    ma, lo_a, hi_a, lost_a, ga0, ga1 = a
    mb, lo_b, hi_b, lost_b, gb0, gb1 = b
    one = (ga0[i] == ga1[i]) & (gb0[j] == gb1[j]) & (ga0[i] == gb0[j])
    fit = ~one & (lo_a[i] * PERCENT <= hi_b[j] * 100) & (lo_b[j] * PERCENT <= hi_a[i] * 100)
    at = np.flatnonzero(fit)
    for lo in range(0, len(at), 2048):
        part = at[lo : lo + 2048]
        p, q = i[part], j[part]
        most = np.bitwise_count(ma[p] & mb[q]).sum(1, dtype=np.int64) + np.minimum(lost_a[p], lost_b[q])
        most = np.minimum(most, np.minimum(hi_a[p], hi_b[q]))
        fit[part] = most >= needed(lo_a[p], lo_b[q])
    return fit


def dual(a: Tree, b: Tree, same: bool):
    """Dual traversal: batches of member index pairs that may link."""
    levels = max(len(a.levels), len(b.levels))
    la, lb = (lambda t, d: t.levels[min(d, len(t.levels) - 1)]), None
    top = levels - 1
    na, nb = len(la(a, top)[1]), len(la(b, top)[1])
    i, j = (x.ravel() for x in np.meshgrid(np.arange(na), np.arange(nb), indexing="ij"))
    if same:
        keep = i < j if top == 0 else i <= j
        i, j = i[keep], j[keep]
    todo = [(top, i, j)]
    while todo:
        d, i, j = todo.pop()
        fit = _open(la(a, d), i, la(b, d), j)
        i, j = i[fit], j[fit]
        if not len(i):
            continue
        if d == 0:
            yield i, j
            continue
        for lo in range(0, len(i), 256):
            x, y = _below(a, d, i[lo : lo + 256], j[lo : lo + 256], b)
            if same:
                keep = x < y if d == 1 else x <= y
                x, y = x[keep], y[keep]
            todo.append((d - 1, x, y))


def _below(a: Tree, d: int, i, j, b: Tree):
    """Children pairs of node pairs; a tree that is less deep stays where it is."""
    ka = LEAF if d < len(a.levels) else 1
    kb = LEAF if d < len(b.levels) else 1
    x = (i[:, None] * ka + np.arange(ka))[:, :, None]
    y = (j[:, None] * kb + np.arange(kb))[:, None, :]
    x, y = np.broadcast_arrays(x, y)
    x, y = x.ravel(), y.ravel()
    fit = (x < len(a.levels[min(d - 1, len(a.levels) - 1)][1])) & (y < len(b.levels[min(d - 1, len(b.levels) - 1)][1]))
    return x[fit], y[fit]


def candidates(sizes: np.ndarray, maps: list[np.ndarray], side: np.ndarray | None = None, groups: np.ndarray | None = None):
    """Pairs of members that may link (batches of index arrays). ``side``: 0/1 to look across only. ``groups``: to
    look across groups only; members of a group stand together in the tree."""
    words = np.array([len(m) for m in maps])
    apart = groups is None
    groups = np.arange(len(maps)) if apart else groups
    trees = {}
    for w in np.unique(words):
        for s in (0, 1) if side is not None else (0,):
            at = np.flatnonzero((words == w) & ((side == s) if side is not None else True))
            if len(at):
                at = at[np.lexsort((sizes[at],) if apart else (sizes[at], groups[at]))]
                trees[int(w), s] = (at, Tree(sizes[at], np.stack([maps[k] for k in at]), groups[at]))
    for (w, s), (at, tree) in trees.items():
        for v in (w, 2 * w) if side is None else (w // 2, w, 2 * w):
            if side is not None and s == 1:
                continue
            other = trees.get((v, 0 if side is None else 1))
            if other is None:
                continue
            least = min(w, v)
            same = side is None and v == w
            for i, j in dual(tree.folded(least), tree if same else other[1].folded(least), same):
                yield at[i], other[0][j]


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum())


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = overlap(a, b) if len(a) <= len(b) else overlap(b, a)
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _edges(rows, names=("a", "b")):
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], names=list(names))


def _grouped(batches, keys: list[str], columns: list[str]):
    """Rows of consecutive Arrow batches grouped by equal ``keys``: (keys, list of rows)."""
    now, held = None, []
    for b in sliced(batches):
        name = zip(*(b.column(c).to_pylist() for c in keys))
        for key, row in zip(name, zip(*(b.column(c).to_pylist() for c in columns))):
            if key != now:
                if held:
                    yield now, held
                now, held = key, []
            held.append(row)
    if held:
        yield now, held


def _stars(forest: Forest, ids: list[int]) -> list[tuple[int, int]]:
    """(id, smallest id of its group) of all ids but the smallest."""
    low: dict[int, int] = {}
    for k, node in enumerate(ids):
        top = forest.find(k)
        low[top] = min(node, low.get(top, node))
    return [(node, low[forest.find(k)]) for k, node in enumerate(ids) if node != low[forest.find(k)]]


KEY = ["block", "low", "high"]
LIVE = "block long, low int, high int, own int, node long, comp long"


def candidate_blocks(batches):
    """Blocks of bitmaps -> their members that may link with one of another component (and side, where pieces meet)."""
    for (block, low, high), rows in _grouped(batches, KEY, ["own", "node", "comp", "n", "sig"]):
        if len(rows) < 2:
            continue
        own, node, comp, n = (np.array([r[k] for r in rows], np.int64) for k in range(4))
        keep = np.zeros(len(rows), bool)
        for i, j in candidates(n, [np.frombuffer(r[4], np.uint64) for r in rows], None if low == high else (own == high).astype(int), comp):
            keep[i] = keep[j] = True
        at = np.flatnonzero(keep)
        if len(at):
            same = lambda v, kind: pa.array(np.full(len(at), v), kind)
            yield pa.RecordBatch.from_arrays(
                [same(block, pa.int64()), same(low, pa.int32()), same(high, pa.int32()), pa.array(own[at].astype(np.int32)), pa.array(node[at]), pa.array(comp[at])], names=["block", "low", "high", "own", "node", "comp"]
            )


def link_blocks(batches):
    """Blocks of whole sets -> stars (a, b): each member linked to the smallest of those it is now connected with."""
    out: list = []
    for (_, low, high), rows in _grouped(batches, KEY, ["own", "node", "comp", "members"]):
        sets, comp = [np.frombuffer(r[3], np.uint64) for r in rows], np.array([r[2] for r in rows], np.int64)
        forest, first = Forest(len(rows)), {}
        for k, c in enumerate(comp.tolist()):
            forest.join(first.setdefault(c, k), k)
        side = None if low == high else np.array([int(r[0] == high) for r in rows])
        for i, j in candidates(np.array([len(s) for s in sets], np.int64), [signature(s, TREE_BITS) for s in sets], side, comp):
            for x, y in zip(i.tolist(), j.tolist()):
                if forest.find(x) != forest.find(y) and linked(sets[x], sets[y]):
                    forest.join(x, y)
        out += _stars(forest, [r[1] for r in rows])
        if len(out) > 20_000:
            yield _edges(out)
            out = []
    if out:
        yield _edges(out)


def profiles(docs: DataFrame) -> DataFrame:
    """Rows of two kinds: one per document (doc_id, n, node, sig, tk; node and sig null for the empty set), and per
    shingle that ``OFTEN`` or more documents of a window share (node the shingle, n their number, tk null)."""
    names = ["doc_id", "n", "node", "sig", "tk"]

    def work(batches):
        held, size = [], 0

        def often():
            seen, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            keep = n >= OFTEN
            k = int(keep.sum())
            return pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.array(n[keep].astype(np.int64)), pa.array(seen[keep].view(np.int64)), pa.nulls(k, pa.binary()), pa.nulls(k, pa.int64())], names=names)

        for b in sliced(batches):
            sets = [shingles(t) for t in b.column("text").to_pylist()]
            full = [len(s) > 0 for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([node_of(s) if f else None for s, f in zip(sets, full)], pa.int64()),
                    pa.array([signature(s).tobytes() if f else None for s, f in zip(sets, full)], pa.binary()),
                    b.column("tk"),
                ],
                names=names,
            )
            held += [s for s, f in zip(sets, full) if f]
            size += sum(map(len, sets))
            if size > WINDOW:
                yield often()
                size = 0
        if held:
            yield often()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key(F.col("text")).alias("tk"))
    return rows.mapInArrow(work, "doc_id long, n long, node long, sig binary, tk long")


def shared_levels(often: DataFrame, bits: int = LEVEL_BITS) -> np.ndarray:
    """Per place (low bits of a shingle) the bit length of the largest number of documents seen to share one there."""
    place = F.col("node").bitwiseAND((1 << bits) - 1).cast("int")
    rows = often.groupBy("node").agg(F.sum("n").alias("n")).groupBy(place.alias("place")).agg(F.max("n").alias("n")).toArrow()  # at most 2^bits rows
    out = np.zeros(1 << bits, np.uint8)
    out[rows.column("place").to_numpy()] = np.frexp(rows.column("n").to_numpy().astype(float))[1]
    return out


def postings(docs: DataFrame, levels: np.ndarray) -> DataFrame:
    """(node, key): every set, once a task, with the shingles of its prefix."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def work(batches):
        seen: set[int] = set()
        for b in sliced(batches):
            nodes, keys = [], []
            for t in b.column("text").to_pylist():
                s = shingles(t)
                if len(s) and (node := node_of(s)) not in seen:
                    seen.add(node)
                    keys.append(prefix(s, shared.value))
                    nodes.append(np.full(len(keys[-1]), node))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes), pa.int64()), pa.array(np.concatenate(keys).view(np.int64))], names=["node", "key"])

    return docs.select("text").mapInArrow(work, "node long, key long")


def blocks(posted: DataFrame) -> DataFrame:
    """(block, node, shards): the shards of two sets or more, those with the same members once. A block's name is made
    of the smallest and largest members under two orders; should two shards share it, they are compared as one."""
    w = Window.partitionBy("key")
    other = F.xxhash64("node")
    ends = posted.select("node", F.min("node").over(w).alias("n0"), F.max("node").over(w).alias("n1"), F.min(other).over(w).alias("h0"), F.max(other).over(w).alias("h1"))
    return ends.where("n0 < n1").groupBy(F.xxhash64("n0", "n1", "h0", "h1").alias("block"), "node").agg(F.count("*").alias("shards"))


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, members) for wanted (node, tk): the sets, made again from texts that the keys let through."""

    def work(batches):
        seen: set[int] = set()
        for b in sliced(batches):
            out = {}
            for t in b.column("text").to_pylist():
                s = shingles(t)
                if len(s) and (node := node_of(s)) not in seen:
                    seen.add(node)
                    out[node] = s.tobytes()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array(list(out.values()), pa.binary())], names=["node", "members"])

    made = sifted(docs.select("text", text_key(F.col("text")).alias("tk")), wanted, "tk", work, "node long, members binary").join(wanted.select("node"), "node", "left_semi")
    return made.groupBy("node").agg(F.first("members").alias("members"))


def link_round(docs: DataFrame, known: DataFrame, rows: DataFrame) -> DataFrame:
    """Links within blocks, (a, b): rows (block, low, high, own, node, comp), known (node, n, sig, tk). Bitmaps first;
    sets are made and shipped, once a block, only for what bitmaps leave."""
    parts = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    deal = lambda df: df.repartition(parts, *KEY).sortWithinPartitions(*KEY, "comp", "n", "node")
    live = stage(deal(rows.join(known.select("node", "n", "sig"), "node")).mapInArrow(candidate_blocks, LIVE), "ngram-live")
    wanted = stage(live.select("node").distinct().join(known.select("node", "n", "tk"), "node"), "ngram-wanted")
    full = live.join(sets_of(docs, wanted), "node").withColumn("n", F.octet_length("members"))
    edges = stage(deal(full).mapInArrow(link_blocks, "a long, b long"), "ngram-edges")
    release(live, wanted)
    return edges


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(profiles, node components): components has (node, component) for nodes with a link, labelled by node."""
    prof = stage(profiles(docs), "ngram")
    levels = shared_levels(prof.where("tk IS NULL"))
    prof = prof.where("tk IS NOT NULL")
    known = stage(prof.where("node IS NOT NULL").groupBy("node").agg(F.min("n").alias("n"), F.min("tk").alias("tk"), F.first("sig").alias("sig")), "ngram-known")
    met = stage(blocks(postings(docs, levels)), "ngram-blocks")

    # round 1: every set in the blocks that hold most of its shards
    best = Window.partitionBy("node").orderBy(F.desc("shards"), "block")
    first = stage(met.withColumn("k", F.row_number().over(best)).where(F.col("k") <= FIRST).select("block", "node"), "ngram-first")
    size = first.groupBy("block").agg(F.count("*").alias("m")).where("m > 1")
    piece = F.xxhash64("block", F.pmod(F.xxhash64("node", "block"), F.ceil(F.col("m") / BLOCK)))
    zero = F.lit(0).cast("int")
    rows = first.join(size, "block").select(piece.alias("block"), zero.alias("low"), zero.alias("high"), zero.alias("own"), "node", F.col("node").alias("comp"))
    edges = link_round(docs, known, rows)
    comps = stage(components(edges).select(F.col("id").alias("node"), "component"), "ngram-comps")
    release(first, edges)

    # round 2: every block that still joins different components
    rows = stage(met.join(comps, "node", "left").select("block", "node", F.coalesce("component", "node").alias("comp")), "ngram-rows")
    split = rows.groupBy("block").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("m")).where("c0 < c1").select("block", F.ceil(F.col("m") / BLOCK).cast("int").alias("pieces"))
    own = F.pmod(F.xxhash64("node", "block"), F.col("pieces")).cast("int")
    met_again = rows.join(split, "block").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    met_again = met_again.select("block", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node", "comp")
    more = link_round(docs, known, met_again)
    stars = comps.select(F.col("node").alias("a"), F.col("component").alias("b"))
    found = stage(components(more.unionByName(stars)).select(F.col("id").alias("node"), "component"), "ngram-classes")
    release(met, known, rows, more, comps)
    return prof, found


def labelled(docs: DataFrame) -> DataFrame:
    """(doc_id, tk, n_shingles, comp) per row: its text's key and its component by node (null for the empty set)."""
    prof, comps = classes(docs)
    named = prof.select("doc_id", "tk", F.col("n").alias("n_shingles"), "node").join(comps, "node", "left")
    return stage(named.select("doc_id", "tk", "n_shingles", F.coalesce("component", "node").alias("comp")), "ngram-named")


def join(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) per document."""
    named = labelled(docs)
    least = named.where("comp IS NOT NULL").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    out = named.join(least, "comp", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows, whole, of one document per group: that of the smallest doc_id (none counts as largest), then of the
    smallest text key. Rows equal in both are one document; texts without words are groups of their own."""
    named = labelled(docs)
    row = [F.col("doc_id").isNull().alias("no_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.col("tk")]
    first = named.where("comp IS NOT NULL").groupBy("comp").agg(F.min(F.struct(*row)).alias("row")).select("row.*")
    kept = first.unionByName(named.where("comp IS NULL").select(*row).distinct())
    keyed = docs.withColumn("tk", text_key(F.col("text"))).select("*", *row[:2])
    return keyed.join(kept, ["no_id", "id", "tk"], "left_semi").dropDuplicates(["no_id", "id", "tk"]).select(*docs.columns)


def op4_signature_trees(spark, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


#: Shingle sets, all pairs that share a shingle, and what their links reach.
OP4_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT rid, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingle FROM d),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.rid AS a, b.rid AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.rid <> b.rid GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON a = x.rid JOIN n y ON b = y.rid WHERE 100 * common >= 80 * (x.n + y.n - common)),
r(rid, other) AS (SELECT rid, rid FROM d UNION SELECT r.rid, l.b FROM r JOIN l ON r.other = l.a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM d LEFT JOIN n USING (rid)
 JOIN (SELECT r.rid, min(o.doc_id) AS component_id FROM r JOIN d o ON r.other = o.rid GROUP BY 1) USING (rid)
"""
