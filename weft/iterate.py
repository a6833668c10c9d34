"""Iterative plans: tables that cut lineage, and connected components over them.

``stage`` writes a table under the folder that all executors share and reads it back, so a lost executor never
forces the rounds before it to run again; ``release`` deletes one that nothing reads any more. What is left when
the session's Python ends is deleted then.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}  # application id -> a folder of our own
_LEFT: dict[str, SparkSession] = {}  # staged tables not yet released


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the context's checkpoint folder. A temporary folder of our own only where neither
    is set and the driver is the only machine; elsewhere executors could not see it, so that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    sc = spark.sparkContext
    if not re.match(r"local(\[|$)", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.applicationId not in _OWN:
        _OWN[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="weft-steps-")
    return _OWN[sc.applicationId]


def stage(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` and read it again."""
    spark = df.sparkSession
    path, schema = f"{shared_root(spark)}/weft-{name}-{uuid.uuid4().hex}", df.schema
    with _freeing_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    _LEFT[path] = spark
    out = spark.read.schema(schema).parquet(path)
    out.staged_at = path
    return out


@contextlib.contextmanager
def _freeing_shuffles(spark: SparkSession):
    """While it holds, Spark drops the shuffle files of an execution when that ends: the table written stands for them."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


def release(*tables: DataFrame) -> None:
    """Delete staged tables; nothing that is still to run may read them."""
    for df in tables:
        _delete(df.staged_at)


def _delete(path: str) -> None:
    spark = _LEFT.pop(path, None)
    if spark is not None:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _sweep() -> None:
    for path in list(_LEFT):
        with contextlib.suppress(Exception):  # the JVM may be gone by now
            _delete(path)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)``: one row ``(id, component)`` per endpoint, ``component`` the smallest
    id reachable. Loops and repeats are harmless; no edges, no rows.

    Rounds of large-star and small-star over edges ``a > b`` until all of them are spokes of stars: O(log n) rounds
    in practice. Large-star moves an edge whose lower end hangs on something lower still; edges at a root stay as
    they are. Minima are combined before the shuffle, and both joins stream the edges, so adaptive execution can
    split a hub's."""
    cur = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "cc")
    while True:
        roles = cur.select("a", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(cur.select(F.col("b").alias("a"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        # done when every id hangs on one id that itself hangs on none
        if roles.groupBy("a").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up > 0 AND down > 0").isEmpty():
            break
        lower = cur.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("m"))
        large = cur.join(lower, "b", "left").select("a", F.coalesce("m", "b").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        old, cur = cur, stage(small.where("a <> b").distinct(), "cc")
        release(old)
    return cur.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(cur.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
