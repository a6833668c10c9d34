"""Shared plumbing of the training-data operators.

* ``stage``, ``release`` and ``components`` come from ``weft.iterate``: tables in the folder that all executors
  share cut lineage, so a lost executor never forces an upstream recomputation.
* ``arrow_map`` cuts Arrow batches inside the worker, so a task holds the Python form of a slice at a time and no
  session setting changes while a plan is built.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.iterate import components, release, shared_root, stage

__all__ = ["components", "release", "shared_root", "stage"]

WORD_SPACE = r"[ \t\n\x0B\f\r]+"
SLICE_ROWS = 512
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sliced(batches, rows: int = SLICE_ROWS, size: int = SLICE_BYTES):
    """The batches in slices of at most ``rows`` rows and about ``size`` bytes (one row at least), without copying."""
    for b in batches:
        if not b.num_rows:
            continue
        step = max(1, min(rows, int(b.num_rows * size / max(b.nbytes, 1))))
        for lo in range(0, b.num_rows, step):
            yield b.slice(lo, step)


def arrow_map(df: DataFrame, fn, schema: str, rows: int = SLICE_ROWS) -> DataFrame:
    """``mapInArrow`` for a function of one slice of a RecordBatch returning a dict of columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for batch in sliced(batches, rows):
            out = fn(batch)
            if out is not None:
                yield pa.RecordBatch.from_arrays([to_array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def to_array(values, kind):
    if isinstance(values, (pa.Array, pa.ChunkedArray)):
        values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)


def texts(batch, column: str = "text") -> list[str]:
    """The batch's texts; null counts as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def text_key(text: Column) -> Column:
    """A 64-bit key of a text, null like empty. Two texts may share one, so it only sifts; what is found by it is
    told apart by more."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def fold(doc_id: Column, parts: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts))


FILTER_BITS = 1 << 24


def key_filter(keys: DataFrame, bits: int = FILTER_BITS):
    """A broadcast bitmap over hashed keys (one long column): a semi-join's first sieve, of fixed size (2 MB)
    whatever the input. It lets through every key of ``keys`` and, once very full, all others too; a join
    must follow. It keeps long texts that no join wants out of the shuffle."""

    def words(batches):
        for b in batches:
            h = mix64(b.column(0).drop_null().to_numpy(zero_copy_only=False).view(np.uint64)) & np.uint64(bits - 1)
            word, inverse = np.unique(h >> np.uint64(6), return_inverse=True)
            value = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(value, inverse, np.uint64(1) << (h & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(value.view(np.int64))], names=["word", "value"])

    spark = keys.sparkSession
    rows = keys.mapInArrow(words, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value")).toArrow()
    table_ = np.zeros(bits >> 6, np.int64)
    table_[rows.column("word").to_numpy()] = rows.column("value").to_numpy()
    return spark.sparkContext.broadcast(table_.view(np.uint64))


def sieve(shared, keys: np.ndarray) -> np.ndarray:
    """Which keys the filter lets through."""
    words = shared.value
    h = mix64(keys.view(np.uint64)) & np.uint64((len(words) << 6) - 1)
    return (words[h >> np.uint64(6)] >> (h & np.uint64(63)) & np.uint64(1)).astype(bool)


def sifted(df: DataFrame, keys: DataFrame, key: str, then=None, schema=None) -> DataFrame:
    """``df`` without rows that ``key_filter(keys)`` rules out (null keys go, too); ``then``, a function of batches, goes
    on in the same worker."""
    shared = key_filter(keys.select(key))

    def kept(batches):
        for b in batches:
            b = b.filter(b.column(key).is_valid())
            if b.num_rows:
                yield b.filter(pa.array(sieve(shared, b.column(key).to_numpy(zero_copy_only=False))))

    return df.mapInArrow(kept if then is None else lambda batches: then(kept(batches)), schema or df.schema)


class Forest:
    """Union-find on 0..n-1 whose roots are the smallest members."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        if i > j:
            i, j = j, i
        self.up[j] = i
        return True


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply), vectorised."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
