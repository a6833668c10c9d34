"""Registered queries against their SQL on the smallest tables."""

from collections import Counter

import pytest
from tests.conftest import SF

import weft.plans  # noqa: F401
from weft.registry import QUERIES, SQL

#: Iterative queries take seconds each; these stand for them here, the driver runs them all.
SLOW = {"component_edges_split", "gc_stats", "components_by_size", "scc_stats", "reachability", "all_distances", "color_by_component", "closeness", "rank_longest_path", "y_coords", "rank_crossings", "virtual_nodes", "betweenness", "bfs_distances", "connected_components"}


def plain(v):
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(set(SQL) - SLOW))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    rel = duck.sql(SQL[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert got == Counter(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
