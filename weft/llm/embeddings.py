"""Embedding near-dedup with randomised-rotation binary codes.

Every vector is normalised, rotated by a seeded random orthogonal frame (``BITS`` directions) and kept as
its sign bits plus one correction factor, the inner product of the rotated vector with its own code. For a
query q the quotient <code, q> / <code, v> estimates <v, q> without bias, and its error stays within
``EPSILON * sqrt((1 - f^2) / f^2 / (BITS - 1))`` (f the factor) with high probability. A pair whose upper
bound misses the threshold is dropped; the others are recomputed exactly in double precision, and only an
exact cosine of at least the threshold makes a link.

Pairs to look at come from banded codes: ``bands`` groups of sign bits, a pair meeting wherever it agrees on
a whole band. Band width follows log2 of the number of vectors (so buckets keep their size as the data
grows); the number of bands follows from the recall wanted at the threshold, over the distribution of the bits in
which such a pair differs (all bands read the same bits, so their misses go together). A pair meeting in several
bands is handled in the first only.

Buckets get the 32-byte codes, not the vectors. Members that differ from another one in no more bits than a pair at
the threshold can (``SIGMAS`` standard deviations above the mean) are kept, and only these have their vectors
fetched, once a bucket, for the estimates and the exact products. Buckets of more than ``BLOCK`` vectors are cut into
salted blocks and every pair of blocks is a task of its own, so no bucket lands in one task and all of its pairs are
still looked at; pairs are counted where they are found, and only a spanning forest of each block is emitted as links.

Equal vectors are folded first (they are linked at cosine 1) and counted by multiplicity.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing
(their own component, n_links 0); vectors of different length never link; rows repeating a vec_id count as
separate vectors under one id; rows without a vec_id take part, name no component and are kept only if alone; an
empty table gives no rows; extra columns (label) are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.common import Forest, arrow_map, components, release, stage, table

THRESHOLD = 0.95
BITS = 256
EPSILON = 3.0
RECALL = 0.99
SEED = 11
SIGMAS = 5.0
BUCKET = 32  # vectors that a band's bucket is meant to hold
BLOCK = 512  # vectors of a bucket that one task holds from either side


def frame(dim: int, bits: int = BITS, seed: int = SEED) -> np.ndarray:
    """bits x dim: stacked random orthogonal matrices (the first ``dim`` columns of a rotation when bits > dim)."""
    rng = np.random.default_rng(seed)
    size = max(bits, dim)
    q, r = np.linalg.qr(rng.standard_normal((size, size)))
    return (q * np.sign(np.diag(r)))[:bits, :dim] * math.sqrt(size / max(dim, 1)) if size > dim else q[:bits, :dim]


@lru_cache
def plan(rows: int, threshold: float = THRESHOLD, recall: float = RECALL, bits: int = BITS) -> tuple[int, int]:
    """(bits a band, bands) for this many vectors."""
    width = max(6, math.ceil(math.log2(max(rows, 2) / BUCKET)))
    p = math.acos(threshold) / math.pi
    log = math.lgamma
    chance, agree = [], []  # by number of differing bits: how likely, and how likely a band has none of them
    for k in range(bits - width + 1):
        chance.append(math.exp(log(bits + 1) - log(k + 1) - log(bits - k + 1) + k * math.log(p) + (bits - k) * math.log(1 - p)))
        agree.append(math.exp(log(bits - width + 1) - log(bits - width - k + 1) - log(bits + 1) + log(bits - k + 1)))
    chance, agree = np.array(chance), np.array(agree)
    bands = 1
    while (chance * (1 - agree) ** bands).sum() > 1 - recall:
        bands += max(1, bands // 16)
    return width, bands


def most_differing(threshold: float = THRESHOLD, bits: int = BITS) -> int:
    """Bits in which the codes of a pair at the threshold may differ."""
    p = math.acos(threshold) / math.pi
    return math.ceil(bits * p + SIGMAS * math.sqrt(bits * p * (1 - p)))


def encode(vectors: np.ndarray, axes: np.ndarray):
    """Unit vectors, sign bits and correction factors of finite non-zero rows."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    turned = unit @ axes.T
    length = np.linalg.norm(turned, axis=1)
    length[length == 0] = 1.0
    signs = turned >= 0
    factor = np.abs(turned).sum(1) / (math.sqrt(turned.shape[1]) * length)
    return unit, signs, factor, turned / length[:, None]


def estimate(signs: np.ndarray, factor: np.ndarray, turned: np.ndarray, epsilon: float = EPSILON):
    """Estimated inner products of coded rows with rotated query rows, and the rows' error bounds."""
    bits = signs.shape[1]
    code = np.where(signs, 1.0, -1.0) / math.sqrt(bits)
    est = (code @ turned.T) / factor[:, None]
    return est, epsilon * np.sqrt(np.maximum(1 - factor**2, 0) / factor**2 / max(bits - 1, 1))


def band_keys(signs: np.ndarray, width: int, bands: int, seed: int = SEED) -> np.ndarray:
    """rows x bands keys: each band reads ``width`` of the bits, chosen by seed, without repeats while they last."""
    rng = np.random.default_rng(seed + 1)
    bits = signs.shape[1]
    order = np.concatenate([rng.permutation(bits) for _ in range(-(-width * bands // bits))])[: width * bands].reshape(bands, width)
    weights = np.int64(1) << np.arange(width, dtype=np.int64)
    return np.stack([signs[:, o] @ weights for o in order], 1)


def _links(left, right, same: bool, band: int, threshold: float):
    """Within or between blocks: index pairs of exact links whose first common band is this one."""
    unit_a, signs_a, factor_a, keys_a = left
    unit_b, _, _, keys_b, turned_b = right
    est, bound = estimate(signs_a, factor_a, turned_b)
    i, j = np.nonzero(est + bound[:, None] >= threshold)
    if same:
        keep = i < j
        i, j = i[keep], j[keep]
    if band:
        first = ~(keys_a[i, :band] == keys_b[j, :band]).any(1)
        i, j = i[first], j[first]
    exact = np.einsum("ij,ij->i", unit_a[i], unit_b[j])
    keep = exact >= threshold
    return i[keep], j[keep]


BLOCK_KEY = ["band", "key", "low", "high"]
BUCKETS = "band int, key long, low int, high int, own int, cls long"


def _groups(batches, columns: list[str]):
    """(band, key, low, high) and the arrays of ``columns`` of consecutive rows with equal keys."""
    held, now = [], None
    for b in batches:
        if not b.num_rows:
            continue
        marks = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in BLOCK_KEY], 1)
        cuts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1).tolist(), len(marks)]
        for lo, hi in zip(cuts, cuts[1:]):
            name = tuple(marks[lo].tolist())
            if name != now:
                if held:
                    yield now, held
                held, now = [], name
            held.append([b.column(c).slice(lo, hi - lo) for c in columns])
    if held:
        yield now, held


def _numbers(held, k: int) -> np.ndarray:
    return np.concatenate([h[k].to_numpy(zero_copy_only=False) for h in held])


def _sides(own: np.ndarray, low: int, high: int):
    return (np.arange(len(own)),) * 2 if low == high else (np.flatnonzero(own == low), np.flatnonzero(own == high))


def near_buckets(width: int, bands: int, most: int):
    """Buckets of codes -> members that differ from another in at most ``most`` bits, where this band is the first
    on which they agree."""

    def work(batches):
        for (band, key, low, high), held in _groups(batches, ["own", "cls", "code"]):
            own, cls = _numbers(held, 0), _numbers(held, 1)
            if len(cls) < 2:
                continue
            codes = np.frombuffer(b"".join(x for h in held for x in h[2].to_pylist()), np.uint8).reshape(len(cls), -1)
            a, b = _sides(own, low, high)
            words = codes.view(np.uint64)
            apart = np.bitwise_count(words[a][:, None, :] ^ words[b][None, :, :]).sum(2, dtype=np.int32)
            i, j = np.nonzero(apart <= most)
            if low == high:
                i, j = i[i < j], j[i < j]
            if band and len(i):
                keys = band_keys(np.unpackbits(codes, axis=1, bitorder="little").astype(bool), width, bands)[:, :band]
                first = ~(keys[a[i]] == keys[b[j]]).any(1)
                i, j = i[first], j[first]
            at = np.unique(np.concatenate((a[i], b[j])))
            if len(at):
                same = lambda v, kind: pa.array(np.full(len(at), v), kind)
                yield pa.RecordBatch.from_arrays(
                    [same(band, pa.int32()), same(key, pa.int64()), same(low, pa.int32()), same(high, pa.int32()), pa.array(own[at], pa.int32()), pa.array(cls[at], pa.int64())], names=[*BLOCK_KEY, "own", "cls"]
                )

    return work


def near_links(classes: DataFrame, rows: int, threshold: float = THRESHOLD):
    """classes (cls long, copies long, vector array<float>) -> (degrees(cls, more), edges(a, b))."""
    spark = classes.sparkSession
    width, bands = plan(rows, threshold)

    def keyed(batch):
        vectors = [np.array(v, np.float32) for v in batch.column("vector").to_pylist()]
        out: dict[str, list] = {"cls": [], "band": [], "key": [], "code": []}
        ids = batch.column("cls").to_numpy()
        for dim in sorted({len(v) for v in vectors}):
            at = [k for k, v in enumerate(vectors) if len(v) == dim]
            _, signs, _, _ = encode(np.stack([vectors[k] for k in at]).astype(np.float64), frame_of(dim))
            keys = band_keys(signs, width, bands) * 4099 + dim
            codes = [c.tobytes() for c in np.packbits(signs, axis=1, bitorder="little")]
            out["cls"].append(np.repeat(ids[at], bands))
            out["band"].append(np.tile(np.arange(bands, dtype=np.int32), len(at)))
            out["key"].append(keys.ravel())
            out["code"] += [c for c in codes for _ in range(bands)]
        return {k: v if k == "code" else np.concatenate(v) for k, v in out.items()}

    posted = arrow_map(classes.select("cls", "vector"), keyed, "cls long, band int, key long, code binary", 4096)
    counted = posted.withColumn("n", F.count("*").over(Window.partitionBy("band", "key"))).where("n > 1")
    look = near_buckets(width, bands, most_differing(threshold))
    zero = F.lit(0).cast("int")
    # a bucket of ordinary size is looked at where it was counted
    whole = counted.where(F.col("n") <= BLOCK).select("band", "key", zero.alias("low"), zero.alias("high"), zero.alias("own"), "cls", "code")
    near = whole.sortWithinPartitions("band", "key").mapInArrow(look, BUCKETS)
    # of larger ones, a block pair (low, high) gets every member of either block
    pieces = F.ceil(F.col("n") / BLOCK).cast("int")
    hot = counted.where(F.col("n") > BLOCK).withColumn("pieces", pieces).withColumn("own", F.pmod(F.xxhash64("cls", "key"), F.col("pieces")).cast("int"))
    hot = hot.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).select("band", "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "cls", "code")
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    near = near.unionByName(hot.repartition(parts, *BLOCK_KEY).sortWithinPartitions(*BLOCK_KEY).mapInArrow(look, BUCKETS))
    near = stage(near, "embed-near")
    dealt = near.join(classes, "cls").repartition(parts, *BLOCK_KEY).sortWithinPartitions(*BLOCK_KEY, "own", "cls")

    def work(batches):
        ids, more, ea, eb = [], [], [], []
        size = 0
        for (band, _, low, high), held in _groups(batches, ["own", "cls", "copies", "vector"]):
            own, cls, copies = (_numbers(held, k) for k in range(3))
            vec = np.concatenate([h[3].flatten().to_numpy(zero_copy_only=False) for h in held]).reshape(len(cls), -1).astype(np.float64)
            unit, signs, factor, turned = encode(vec, frame_of(vec.shape[1]))
            keys = band_keys(signs, width, bands)
            a, b = _sides(own, low, high)
            i, j = _links((unit[a], signs[a], factor[a], keys[a]), (unit[b], signs[b], factor[b], keys[b], turned[b]), low == high, int(band), threshold)
            if not len(i):
                continue
            i, j = a[i], b[j]
            degree = np.bincount(i, copies[j], len(cls)) + np.bincount(j, copies[i], len(cls))
            got = np.flatnonzero(degree)
            ids.append(cls[got]), more.append(degree[got].astype(np.int64))
            forest = Forest(len(cls))
            tree = [(x, y) for x, y in zip(i.tolist(), j.tolist()) if forest.join(x, y)]
            ea.append(cls[[t[0] for t in tree]]), eb.append(cls[[t[1] for t in tree]])
            size += len(got)
            if size > 20_000:
                yield batch(ids, more, ea, eb)
                ids, more, ea, eb, size = [], [], [], [], 0
        if ids:
            yield batch(ids, more, ea, eb)

    def batch(ids, more, ea, eb):
        ids, more, ea, eb = (np.concatenate(x) for x in (ids, more, ea, eb))
        pad = np.zeros(len(ea), np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate((ids, ea))), pa.array(np.concatenate((more, pad))), pa.array([None] * len(ids) + eb.tolist(), pa.int64())], names=["cls", "more", "to"]
        )

    found = stage(dealt.mapInArrow(work, "cls long, more long, to long"), "embed-links")
    release(near)
    degrees = found.where("to IS NULL").groupBy("cls").agg(F.sum("more").alias("more"))
    return degrees, found.where("to IS NOT NULL").select(F.col("cls").alias("a"), F.col("to").alias("b"))


_FRAMES: dict[int, np.ndarray] = {}


def frame_of(dim: int) -> np.ndarray:
    if dim not in _FRAMES:
        _FRAMES[dim] = frame(dim)
    return _FRAMES[dim]


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """rows (vec_id, embedding) -> (vec_id, n_links, component_id, kept)."""
    v = F.col("embedding").cast("array<float>")
    fine = (
        v.isNotNull()
        & (F.size(v) > 0)
        & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
        & F.exists(v, lambda x: x != 0)
    )
    base = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vector"), F.coalesce(fine, F.lit(False)).alias("fine"))
    # one class per distinct vector, named by a hash of it and told apart by another and its length
    sealed = base.withColumn("cls", F.when(F.col("fine"), F.xxhash64("vector"))).withColumn("h2", F.when(F.col("fine"), F.hash("vector"))).withColumn("dim", F.size("vector"))
    key = ["cls", "h2", "dim"]
    classes = stage(sealed.where("fine").groupBy(*key).agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("vector").alias("vector")), "embed")
    degrees, edges = near_links(classes.select("cls", "copies", "vector"), classes.count(), threshold)
    labels = components(edges).select(F.col("id").alias("cls"), "component")
    known = stage(classes.select(*key, "least", "copies").join(degrees, "cls", "left").join(labels, "cls", "left"), "embed-known")
    # a group's name is its smallest vec_id
    named = known.where("component IS NOT NULL").groupBy("component").agg(F.min("least").alias("name"))
    known = known.join(named, "component", "left").select(*key, "copies", "more", F.coalesce("name", "least").alias("name"))
    out = sealed.select("vec_id", "fine", *key).join(known, key, "left")
    links = F.when(F.col("fine"), F.col("copies") - 1 + F.coalesce("more", F.lit(0))).otherwise(F.lit(0)).cast("long")
    comp = F.when(F.col("fine"), F.col("name")).otherwise(F.col("vec_id"))
    return out.select("vec_id", links.alias("n_links"), comp.alias("component_id"), F.col("vec_id").eqNullSafe(comp).alias("kept"))


def op8_rotation_codes(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


#: Cosines of all pairs in double precision, and what their links reach.
OP8_SQL = """
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, vec_id, embedding::DOUBLE[] AS v FROM embeddings),
f AS (SELECT rid, v, len(v) AS n, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS size FROM d
 WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.rid AS a, b.rid AS b FROM f a JOIN f b ON a.n = b.n AND a.rid <> b.rid WHERE list_dot_product(a.v, b.v) / (a.size * b.size) >= 0.95),
r(rid, other) AS (SELECT rid, rid FROM d UNION SELECT r.rid, l.b FROM r JOIN l ON r.other = l.a),
c AS (SELECT r.rid, min(o.vec_id) AS component_id FROM r JOIN d o ON r.other = o.rid GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM d JOIN c USING (rid) LEFT JOIN (SELECT a AS rid, count(*) AS n_links FROM l GROUP BY 1) USING (rid)
"""
