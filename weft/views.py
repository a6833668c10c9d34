"""Graph views over the star schema. Every view is (tail, head, ...) edges or (name, ...) nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trade(spark, sf_dir) -> DataFrame:
    """G1: supplier nation -> customer nation, one row per pair with its number of lines."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("tail"))
    cust = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("head"))
    joined = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(sup, F.col("l_suppkey") == F.col("s_suppkey")).join(cust, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("tail", "head").agg(F.count("*").alias("weight"))


def transitions(spark, sf_dir) -> DataFrame:
    """G2: consecutive event types of a user, as a multigraph with a sequence number."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.col("event_type").alias("tail"), F.lead("event_type").over(w).alias("head"))
    return e.where("head IS NOT NULL").select(F.col("event_id").alias("seq"), "user_id", "tail", "head")


def part_supplier(spark, sf_dir) -> DataFrame:
    """G3: distinct part - supplier pairs, names prefixed by kind."""
    line = table(spark, sf_dir, "lineitem")
    return line.select(F.concat(F.lit("p"), "l_partkey").alias("tail"), F.concat(F.lit("s"), "l_suppkey").alias("head")).distinct()


def copurchase(spark, sf_dir) -> DataFrame:
    """G4: consecutive large returned lines of an order, as distinct part -> part edges."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    line = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_quantity >= 40")
    pairs = line.select(F.col("l_partkey").alias("tail"), F.lead("l_partkey").over(w).alias("head"))
    return pairs.where("head IS NOT NULL").distinct()


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("tail").alias("name")).unionByName(edges.select(F.col("head").alias("name"))).distinct()


def hierarchy(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """G5: (subgraphs, members): region clusters hold nation clusters hold customers and suppliers."""
    r = table(spark, sf_dir, "region")
    n = table(spark, sf_dir, "nation").join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    regions = r.select(F.concat(F.lit("cluster_r"), "r_regionkey").alias("sub_id"), F.lit(None).cast("string").alias("parent_sub"), F.col("r_name").alias("label"))
    nations = n.select(F.concat(F.lit("cluster_n"), "n_nationkey").alias("sub_id"), F.concat(F.lit("cluster_r"), "n_regionkey").alias("parent_sub"), F.col("n_name").alias("label"))
    subs = regions.withColumn("depth", F.lit(1)).withColumn("path", F.array("sub_id")).unionByName(nations.withColumn("depth", F.lit(2)).withColumn("path", F.array("parent_sub", "sub_id")))
    cust = table(spark, sf_dir, "customer").select(F.concat(F.lit("cluster_n"), "c_nationkey").alias("sub_id"), F.concat(F.lit("c"), "c_custkey").alias("name"))
    supp = table(spark, sf_dir, "supplier").select(F.concat(F.lit("cluster_n"), "s_nationkey").alias("sub_id"), F.concat(F.lit("s"), "s_suppkey").alias("name"))
    return subs.withColumn("is_cluster", F.startswith("sub_id", F.lit("cluster"))), cust.unionByName(supp)


def customer_supplier(spark, sf_dir) -> DataFrame:
    """Edges of G5: customer -> supplier of each line of urgent orders, distinct."""
    o = table(spark, sf_dir, "orders").where("o_orderpriority LIKE '1-%'").select("o_orderkey", "o_custkey")
    line = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_suppkey")
    return line.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat(F.lit("c"), "o_custkey").alias("tail"), F.concat(F.lit("s"), "l_suppkey").alias("head")).distinct()
