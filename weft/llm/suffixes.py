"""Suffix-array dedup with a logarithmic index family.

Every byte covered by a ``LENGTH``-byte string that also starts anywhere else in the corpus is removed.

Sharding: a window of LENGTH bytes names its anchor, the smallest hash among its GRAM-byte grams. Equal
windows have equal anchors, so windows are sharded by anchor hash and never have to meet another shard.
Anchors are about 2% of the positions; only those found twice are live, and only the
stretches of text whose windows share a live anchor travel (as contexts of at most CUT windows, equal contexts once
with a count). An anchor found more than HOT times is sharded further, by where it stands in the window
(in steps of STEP) and by the hash of the bytes that all windows of that step share: equal windows agree in both.

Within a shard an index family grows: each batch of contexts gets a suffix array (places in the shard's bytes, sorted
by the LENGTH bytes from there), whose neighbours show repeats inside the batch; it is merge-scanned against every
level of the family for repeats of older text; its unmatched suffixes become a level, and levels of equal
size class are merged by one linear pass, so each suffix is merged O(log n) times. Windows are looked at CHUNK at a
time, byte by byte; what stays in memory is the shard's bytes and one number per place.

Texts with equal bytes are folded beforehand, and texts go by their SHA-256 throughout: any text of LENGTH bytes or
more with a copy goes entirely, and one of the copies stands for them in the index.

Edge cases: null counts as empty; texts shorter than LENGTH keep everything; overlapping repeats and
repeats within one text count; matches never cross documents; rows repeating a doc_id, and rows without one, are
documents of their own; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from weft.llm.common import arrow_map, mix64, release, sifted, sliced, stage, table, text_key

LENGTH = 200
GRAM = 100
CUT = 1 << 15
HOT = 1000
STEP = 32
CHUNK = 1 << 14
BATCH_BYTES = 200_000
SHARD_BYTES = 8 << 20  # from this size on a family ends with its shard
_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int):
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 14)
        for k, b in enumerate((_BASE, _INVERSE)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0][:n], _POWERS[1][:n]


def gram_hashes(data: np.ndarray, gram: int = GRAM, step: int = 1 << 17) -> np.ndarray:
    """A 64-bit hash of each gram-byte string of the bytes, ``step`` of them at a time."""
    out = np.empty(max(0, len(data) - gram + 1), np.uint64)
    for lo in range(0, len(out), step):
        part = data[lo : lo + step + gram - 1]
        n = len(part)
        up, down = _powers(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[part] * up, out=sums[1:])
        out[lo : lo + step] = mix64((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
    return out


def _sliding(v: np.ndarray, width: int, op) -> np.ndarray:
    """op over every run of ``width`` values, by doubling."""
    span = 1
    while span * 2 <= width:
        v = op(v[:-span], v[span:])
        span *= 2
    rest = width - span
    return op(v[: len(v) - rest], v[rest:]) if rest else v


def window_anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(gram hashes, per window start the smallest gram hash in it)."""
    h = gram_hashes(data, gram)
    return h, _sliding(h, length - gram + 1, np.minimum)


def anchor_values(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """The hashes at the positions that are some window's anchor, those of several positions twice."""
    h, m = window_anchors(data, length, gram)
    width = length - gram + 1
    padded = np.zeros(len(m) + 2 * (width - 1), np.uint64)
    padded[width - 1 : width - 1 + len(m)] = m
    values, n = np.unique(h[h == _sliding(padded, width, np.maximum)], return_counts=True)
    return np.concatenate((values, values[n > 1]))


def contexts(data: bytes, live: np.ndarray, hot: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(first window start, anchor, sub-shard, bytes) of the runs of windows with one live anchor; sub-shard 0 unless
    the anchor is hot."""
    h, m = window_anchors(np.frombuffer(data, np.uint8), length, gram)
    cut = np.concatenate(([0], np.flatnonzero(m[1:] != m[:-1]) + 1, [len(m)]))
    good = np.flatnonzero(np.isin(m[cut[:-1]], live))
    busy = set(hot.tolist())
    for lo, hi, a in zip(cut[good].tolist(), cut[good + 1].tolist(), m[cut[good]].tolist()):
        for at in range(lo, hi, CUT):
            end = min(at + CUT, hi)
            if a not in busy:
                yield at, a, 0, data[at : end + length - 1]
                continue
            start = np.arange(at, end)
            places = at + np.flatnonzero(h[at : end + length - gram] == np.uint64(a))
            k = np.searchsorted(places, start)
            place = places[k]  # the anchor's first place in each window
            many = np.searchsorted(places, start + length - gram, side="right") - k > 1  # windows with several stay one sub-shard
            step = np.where(many, -1, (place - start) // STEP)
            edges = [0, *(np.flatnonzero((step[1:] != step[:-1]) | (place[1:] != place[:-1]) & ~many[1:]) + 1).tolist(), end - at]
            for x, y in zip(edges, edges[1:]):
                sub = 0
                if not many[x]:
                    common = int(place[x]) - int(step[x]) * STEP  # the last start of the step
                    sub = xxh3_64_intdigest(data[common : common - STEP + 1 + length], seed=int(step[x]) + 1)
                yield at + x, a, sub, data[at + x : at + y + length - 1]


class Family:
    """The logarithmic family of suffix arrays over a shard's windows."""

    def __init__(self, length: int = LENGTH):
        self.length = length
        self.data = np.zeros(0, np.uint8)
        self.repeated = np.zeros(0, bool)  # by place
        self.size = 0
        self.levels: list[np.ndarray] = []  # places, sorted by their windows

    def _windows(self, places: np.ndarray) -> np.ndarray:
        view = np.lib.stride_tricks.sliding_window_view(self.data[: self.size], self.length)
        return np.ascontiguousarray(view[places]).view(f"S{self.length}").ravel()

    def add(self, texts: list[bytes], counts: list[int]) -> np.ndarray:
        """Index one batch, a text counted more than once repeating entirely; gives each text's first place."""
        length, new = self.length, np.frombuffer(b"".join(texts), np.uint8)
        base, self.size = self.size, self.size + len(new)
        if self.size > len(self.data):
            room = max(2 * len(self.data), self.size)
            self.data, self.repeated = (np.concatenate((v, np.zeros(room - len(v), v.dtype))) for v in (self.data, self.repeated))
        self.data[base : self.size] = new
        sizes = np.array([len(t) for t in texts], np.int64)
        firsts = base + np.cumsum(sizes) - sizes
        number = sizes - length + 1
        place = np.repeat(firsts - (np.cumsum(number) - number), number) + np.arange(int(number.sum()))
        self.repeated[place] = np.repeat(np.array(counts) > 1, number)
        keys = self._windows(place)
        order = np.argsort(keys, kind="stable")
        keys, place = keys[order], place[order]
        same = keys[1:] == keys[:-1]
        fresh = np.concatenate(([True], ~same))
        group = np.cumsum(fresh) - 1
        unique, known = keys[fresh], np.zeros(int(group[-1]) + 1, bool)
        for level in self.levels:
            self._scan(level, unique, known)
        self.repeated[place[(np.bincount(group) > 1)[group] | known[group]]] = True
        if not known.all():
            self.levels.append(place[fresh][~known])
        while len(self.levels) > 1 and len(self.levels[-2]) <= 2 * len(self.levels[-1]):
            self.levels[-2:] = [self._merge(*self.levels[-2:])]
        return firsts

    def _scan(self, level: np.ndarray, keys: np.ndarray, known: np.ndarray) -> None:
        """Mark what the sorted keys and a level have in common: ``known`` on their side, ``repeated`` on the level's."""
        for lo in range(0, len(level), CHUNK):
            part = level[lo : lo + CHUNK]
            old = self._windows(part)
            a, b = np.searchsorted(keys, old[0]), np.searchsorted(keys, old[-1], side="right")
            if a == b:
                continue
            at = np.searchsorted(old, keys[a:b])
            hit = old[at] == keys[a:b]
            known[a:b] |= hit
            self.repeated[part[at[hit]]] = True

    def _merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Two levels as one, by one pass over both; they have no window in common."""
        out, i, j = [], 0, 0
        while i < len(a) and j < len(b):
            ka, kb = self._windows(a[i : i + CHUNK]), self._windows(b[j : j + CHUNK])
            end = min(ka[-1], kb[-1])
            na, nb = np.searchsorted(ka, end, side="right"), np.searchsorted(kb, end, side="right")
            out.append(np.insert(a[i : i + na], np.searchsorted(ka[:na], kb[:nb]), b[j : j + nb]))
            i, j = i + na, j + nb
        return np.concatenate([*out, a[i:], b[j:]])


def runs(flags: np.ndarray) -> list[int]:
    """[start, end, start, end, ...] of the true stretches."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return edge.tolist()


SHARD = ["anchor", "sub"]


def scan_shard(batches):
    """Contexts of shards (anchor, sub, ck, ctx, copies), shard by shard -> (anchor, sub, ck, found): window runs that
    repeat. Small shards share a family; one that has grown ends with its shard."""
    family, names, now = Family(), [], None

    def rows():
        columns: list[list] = [[], [], [], []]
        for anchors, subs, cks, sizes, firsts in names:
            for anchor, sub, ck, size, first in zip(anchors, subs, cks, sizes, firsts.tolist()):
                if found := runs(family.repeated[first : first + size]):
                    for c, v in zip(columns, (anchor, sub, ck, found)):
                        c.append(v)
        names.clear()
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["anchor", "sub", "ck", "found"])

    for b in sliced(batches, 4096, BATCH_BYTES):
        anchors, subs, cks, texts, copies = (b.column(c).to_pylist() for c in ("anchor", "sub", "ck", "ctx", "copies"))
        ends = [k for k in range(1, len(texts)) if (anchors[k], subs[k]) != (anchors[k - 1], subs[k - 1])]
        cuts = [0, len(texts)]
        if family.size > SHARD_BYTES and (anchors[0], subs[0]) == now and ends:
            cuts = [0, ends[0], len(texts)]  # the rest of the grown shard stays with it
        for lo, hi in zip(cuts, cuts[1:]):
            if family.size > SHARD_BYTES and (anchors[lo], subs[lo]) != now:
                yield rows()
                family = Family()
            firsts = family.add(texts[lo:hi], copies[lo:hi])
            names.append((anchors[lo:hi], subs[lo:hi], cks[lo:hi], [len(t) - LENGTH + 1 for t in texts[lo:hi]], firsts))
        now = (anchors[-1], subs[-1])
    if names:
        yield rows()


def _signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def covered(starts: list[tuple[int, int]], length: int = LENGTH) -> list[tuple[int, int]]:
    """Byte spans covered by windows whose starts lie in the given runs (start, end exclusive), merged."""
    out: list[list[int]] = []
    for lo, hi in sorted(starts):
        hi += length - 1
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def _once(batches):
    """Slices with each text (by sha) once, as far as a task sees."""
    seen: set = set()
    for b in sliced(batches):
        keep = []
        for sha in b.column("sha").to_pylist():
            keep.append(sha not in seen)
            seen.add(sha)
        yield b.filter(pa.array(keep))


def long_texts(docs: DataFrame) -> DataFrame:
    return docs.where(F.octet_length("text") >= LENGTH).select("text", F.sha2(F.col("text").cast("binary"), 256).alias("sha"), text_key(F.col("text")).alias("tk"))


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(sha, tk, starts) of the long texts with repeated windows, starts being flat runs of their window starts."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def anchors(batches):
        for b in _once(batches):
            found = [anchor_values(np.frombuffer(t.encode(), np.uint8)).view(np.int64) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("sha"), b.column("tk"), pa.array(found, pa.list_(pa.int64()))], names=["sha", "tk", "anchors"])

    marked = stage(long_texts(docs).mapInArrow(anchors, "sha string, tk long, anchors array<long>").dropDuplicates(["sha"]), "suffix-anchors")
    rows = marked.select("sha", "tk", F.explode("anchors").alias("anchor"))
    live = stage(rows.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor", (F.col("n") > HOT).alias("hot")), "suffix-live")
    wanted = rows.join(live, "anchor").groupBy("sha", "tk").agg(F.collect_set("anchor").alias("live"), F.collect_set(F.when(F.col("hot"), F.col("anchor"))).alias("hot"))
    wanted = stage(wanted, "suffix-wanted")
    release(marked, live)

    def cut(batches):
        last = None
        for b in sliced(batches):
            columns: list[list] = [[], [], [], [], [], []]
            for sha, t, live, hot in zip(*(b.column(c).to_pylist() for c in ("sha", "text", "live", "hot"))):
                if sha == last:  # the join leaves copies of a text side by side
                    continue
                last = sha
                for start, a, sub, c in contexts(t.encode(), *(np.array(x, np.int64).view(np.uint64) for x in (live, hot))):
                    for col, v in zip(columns, (sha, _signed(a), _signed(sub), _signed(xxh3_64_intdigest(c)), start, c)):
                        col.append(v)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["sha", "anchor", "sub", "ck", "lo", "ctx"])

    few = sifted(long_texts(docs), wanted, "tk", _once).select("sha", "text")
    cuts = stage(few.join(wanted.select("sha", "live", "hot"), "sha").select("sha", "text", "live", "hot").mapInArrow(cut, "sha string, anchor long, sub long, ck long, lo long, ctx binary"), "suffix-contexts")
    unique = cuts.groupBy("anchor", "sub", "ck", "ctx").agg(F.count("*").alias("copies"))
    shards = unique.repartition(parts * 4, *SHARD).sortWithinPartitions(*SHARD).mapInArrow(scan_shard, "anchor long, sub long, ck long, found array<int>")
    shards = stage(shards, "suffix-found")
    hit = cuts.select("sha", "anchor", "sub", "ck", "lo").join(shards, [*SHARD, "ck"])
    starts = hit.groupBy("sha").agg(F.flatten(F.collect_list(F.transform("found", lambda x: x + F.col("lo")))).alias("starts"))
    out = stage(starts.join(wanted.select("sha", "tk"), "sha"), "suffix-starts")
    release(wanted, cuts, shards)
    return out


def dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) per document; kept is the remaining text as bytes
    (null where nothing or everything goes)."""
    text = F.coalesce("text", F.lit(""))
    prof = stage(docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("sha")), "suffix")
    copied = stage(prof.where(F.col("n_bytes") >= LENGTH).groupBy("sha").agg(F.count("*").alias("copies")).where("copies > 1").select("sha"), "suffix-copied")
    edits = stage(repeated_windows(docs).join(copied, "sha", "left_anti"), "suffix-edits")

    def cut(batch):
        out: dict[str, list] = {"n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
        for t, flat in zip(batch.column("text").to_pylist(), batch.column("starts").to_pylist()):
            data = t.encode()
            spans = covered(list(zip(flat[0::2], flat[1::2])))
            keep, at = [], 0
            for lo, hi in spans:
                keep.append(data[at:lo])
                at = hi
            kept = b"".join([*keep, data[at:]])
            for k, v in zip(out, (len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept)):
                out[k].append(v)
        return out | {"sha": batch.column("sha")}

    # a text under edits has no copy, so it comes once
    lone = sifted(long_texts(docs), edits, "tk").join(edits.select("sha", "starts"), "sha").select("sha", "text", "starts")
    done = arrow_map(lone, cut, "sha string, n_removed long, n_spans long, kept_sha256 string, kept binary")
    gone = copied.select("sha", F.lit(None).cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(hashlib.sha256(b"").hexdigest()).alias("kept_sha256"), F.lit(None).cast("binary").alias("kept"))
    # short texts keep everything and stay out of the join
    out = prof.where(F.col("n_bytes") >= LENGTH).join(done.unionByName(gone), "sha", "left")
    out = out.select(
        "doc_id",
        "n_bytes",
        F.when(F.col("n_spans").isNull(), F.lit(0)).otherwise(F.coalesce("n_removed", "n_bytes")).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"),
        "kept",
    )
    none = F.lit(0).cast("long")
    return out.unionByName(prof.where(F.col("n_bytes") < LENGTH).select("doc_id", "n_bytes", none.alias("n_removed"), none.alias("n_spans"), F.col("sha").alias("kept_sha256"), F.lit(None).cast("binary").alias("kept")))


def op9_suffix_family(spark, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept")


#: Every window of 200 bytes, in hex, cut from pieces of 1,000 starts; those that occur twice; runs of what they cover.
OP9_SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT rid, o, substr(h, 2 * o + 1, 2 * 1199) AS piece FROM (SELECT rid, h, unnest(range(0, length(h) // 2, 1000)) AS o FROM d)),
w AS MATERIALIZED (SELECT rid, o + i AS pos, md5(substr(piece, 2 * i + 1, 400)) AS key FROM (SELECT rid, o, piece, unnest(range(0, least(1000, length(piece) // 2 - 199))) AS i FROM p)),
g AS (SELECT rid, pos, lag(pos) OVER (PARTITION BY rid ORDER BY pos) AS before FROM w JOIN (SELECT key FROM w GROUP BY 1 HAVING count(*) > 1) USING (key)),
k AS (SELECT rid, pos, sum((before IS NULL OR pos - before > 200)::INT) OVER (PARTITION BY rid ORDER BY pos) AS run FROM g),
r AS (SELECT rid, run, min(pos) AS lo, max(pos) + 200 AS hi FROM k GROUP BY 1, 2),
b AS (SELECT r.*, coalesce(lag(hi) OVER (PARTITION BY rid ORDER BY lo), 0) AS was FROM r),
e AS (SELECT rid, sum(hi - lo)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * was + 1, 2 * (lo - was)), '' ORDER BY lo) AS kept, max(hi) AS last
 FROM b JOIN d USING (rid) GROUP BY 1)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
 sha256(unhex(CASE WHEN e.rid IS NULL THEN h ELSE kept || substr(h, 2 * last + 1) END)) AS kept_sha256 FROM d LEFT JOIN e USING (rid)
"""
