"""Standard graphs as (tail, head) edges from ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _n(i, prefix="n"):
    return F.concat(F.lit(prefix), i.cast("string"))


def _edges(df: DataFrame, a, b, prefix="n") -> DataFrame:
    return df.select(_n(a, prefix).alias("tail"), _n(b, prefix).alias("head"))


def complete(spark: SparkSession, n: int = 5) -> DataFrame:
    i = F.col("id")
    return spark.range(n).withColumn("j", F.explode(F.when(i + 1 < n, F.sequence(i + 1, F.lit(n - 1).cast("long"))))).select(_n(i).alias("tail"), _n(F.col("j")).alias("head"))


def cycle(spark: SparkSession, n: int = 8) -> DataFrame:
    return _edges(spark.range(n), F.col("id"), (F.col("id") + 1) % n)


def path(spark: SparkSession, n: int = 6) -> DataFrame:
    return _edges(spark.range(max(n - 1, 0)), F.col("id"), F.col("id") + 1)


def star(spark: SparkSession, n: int = 6) -> DataFrame:
    return spark.range(n).select(F.lit("center").alias("tail"), _n(F.col("id")).alias("head"))


def grid(spark: SparkSession, rows: int = 4, cols: int = 4) -> DataFrame:
    cell = spark.range(rows * cols).select(F.floor(F.col("id") / cols).alias("r"), (F.col("id") % cols).alias("c"))
    name = lambda r, c: F.concat(F.lit("n"), r.cast("string"), F.lit("_"), c.cast("string"))
    to = F.explode(F.filter(F.array(F.struct(F.col("r").alias("r"), (F.col("c") + 1).alias("c")), F.struct((F.col("r") + 1).alias("r"), F.col("c").alias("c"))), lambda x: (x["r"] < rows) & (x["c"] < cols)))
    return cell.withColumn("to", to).select(name(F.col("r"), F.col("c")).alias("tail"), name(F.col("to.r"), F.col("to.c")).alias("head"))


def tree(spark: SparkSession, depth: int = 3) -> DataFrame:
    return _edges(spark.range(1, 2 ** (depth + 1) - 1), F.floor((F.col("id") - 1) / 2), F.col("id"))


def petersen(spark: SparkSession) -> DataFrame:
    i = spark.range(5)
    outer = _edges(i, F.col("id"), (F.col("id") + 1) % 5, "o")
    inner = _edges(i, F.col("id"), (F.col("id") + 2) % 5, "i")
    return outer.unionByName(inner).unionByName(i.select(_n(F.col("id"), "o").alias("tail"), _n(F.col("id"), "i").alias("head")))


GENERATORS = {"complete": complete, "cycle": cycle, "path": path, "star": star, "grid": grid, "tree": tree, "petersen": petersen}
