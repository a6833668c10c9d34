"""Command line: ``python -m weft.cli TOOL FILE...`` runs a graph tool over DOT files.

Tools print one line per row, tab-separated, the file first. Files are read by Spark, so any path it reads will do.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators import basic, traverse
from weft.sources import dot


def _keyed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of all files, names prefixed by their file so that files stay apart."""
    name = lambda c: F.concat_ws("\t", "file", F.col(c))
    nodes = rows.where("kind = 'node'").select("file", name("name").alias("name"))
    edges = rows.where("kind = 'edge'").select("file", name("tail").alias("tail"), name("head").alias("head"))
    return nodes, edges


def _counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("file").agg(F.count_if(F.col("kind") == "node").alias("nodes"), F.count_if(F.col("kind") == "edge").alias("edges"))


def _components(rows: DataFrame) -> DataFrame:
    return traverse.component_stats(*_keyed(rows)).select("component", "n_nodes", "n_edges")


def _strong(rows: DataFrame) -> DataFrame:
    return traverse.strong_components(*_keyed(rows)).groupBy("scc").agg(F.count("*").alias("n_nodes"))


def _reduced(rows: DataFrame) -> DataFrame:
    return traverse.transitive_reduction(_keyed(rows)[1])


def _degrees(rows: DataFrame) -> DataFrame:
    return basic.degree(*_keyed(rows))


TOOLS = {"gc": _counts, "ccomps": _components, "sccmap": _strong, "tred": _reduced, "degree": _degrees}


def run(spark: SparkSession, tool: str, paths: list[str]) -> DataFrame:
    """The tool's rows over all files, in order."""
    rows = dot.read(spark, paths[0])
    for p in paths[1:]:
        rows = rows.unionByName(dot.read(spark, p))
    out = TOOLS[tool](rows)
    return out.orderBy(*out.columns)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="weft.cli")
    parser.add_argument("tool", choices=sorted(TOOLS))
    parser.add_argument("files", nargs="+")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    for row in run(spark, args.tool, args.files).toLocalIterator():
        print(*row, sep="\t")


if __name__ == "__main__":
    main()
