"""The graph views as SQL common table expressions, for the checking statements."""

G1 = """g1 AS (SELECT s_nationkey AS tail, c_nationkey AS head, count(*) AS weight FROM lineitem
 JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""
G2 = """g2 AS (SELECT * FROM (SELECT event_id AS seq, user_id, event_type AS tail,
 lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS head FROM events) WHERE head IS NOT NULL)"""
G3 = """g3 AS (SELECT DISTINCT 'p' || l_partkey AS tail, 's' || l_suppkey AS head FROM lineitem)"""
G4 = """g4 AS (SELECT DISTINCT tail, head FROM (SELECT l_partkey AS tail, lead(l_partkey) OVER (PARTITION BY l_orderkey
 ORDER BY l_linenumber, l_partkey, l_suppkey) AS head FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 40) WHERE head IS NOT NULL),
 v4 AS (SELECT tail AS name FROM g4 UNION SELECT head FROM g4)"""
DAG4 = G4 + ",\n d4 AS (SELECT tail, head FROM g4 WHERE tail < head)"
G5 = """subs AS (SELECT 'cluster_r' || r_regionkey AS sub_id, CAST(NULL AS VARCHAR) AS parent_sub, r_name AS label, 1 AS depth,
 ['cluster_r' || r_regionkey] AS path FROM region UNION ALL SELECT 'cluster_n' || n_nationkey, 'cluster_r' || n_regionkey, n_name, 2,
 ['cluster_r' || n_regionkey, 'cluster_n' || n_nationkey] FROM nation),
 members AS (SELECT 'cluster_n' || c_nationkey AS sub_id, 'c' || c_custkey AS name FROM customer UNION ALL
 SELECT 'cluster_n' || s_nationkey, 's' || s_suppkey FROM supplier)"""
CS = """cs AS (SELECT DISTINCT 'c' || o_custkey AS tail, 's' || l_suppkey AS head FROM lineitem JOIN orders ON l_orderkey = o_orderkey
 WHERE o_orderpriority LIKE '1-%' AND l_returnflag = 'R')"""
REACH4 = G4 + """,
 r4(src, dst) AS (SELECT tail, head FROM g4 WHERE tail <> head UNION SELECT r4.src, g4.head FROM r4 JOIN g4 ON r4.dst = g4.tail WHERE g4.tail <> g4.head)"""
DIST4 = G4 + """,
 w4(src, dst, d) AS (SELECT tail, head, 1 FROM g4 WHERE tail <> head UNION SELECT w4.src, g4.head, w4.d + 1 FROM w4 JOIN g4 ON w4.dst = g4.tail WHERE g4.tail <> g4.head AND w4.d < 24),
 p4 AS (SELECT src, dst, min(d)::BIGINT AS dist FROM w4 WHERE src <> dst GROUP BY 1, 2)"""
COMP4 = G4 + """,
 u4(name, other) AS (SELECT name, name FROM v4 UNION SELECT u4.name, h.b FROM u4 JOIN
  (SELECT tail AS a, head AS b FROM g4 UNION SELECT head, tail FROM g4) h ON u4.other = h.a),
 c4 AS (SELECT name, min(other) AS component FROM u4 GROUP BY 1)"""
