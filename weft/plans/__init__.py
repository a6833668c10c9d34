"""Registered queries; importing this package registers them."""

from weft.plans import algorithms, graph, layouts, measures, spatial, structure  # noqa: F401


def flagship(spark, sf_dir):
    """Component statistics of the co-purchase graph."""
    return graph.component_stats(spark, sf_dir)
