"""Queries: layout, simulation, codecs, rendering, windows over events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weft import streaming, views
from weft.functions import svg
from weft.operators import basic, layout, simulate, traverse
from weft.plans.graph import _LEVELS, _dag, _g4
from weft.plans.sqlviews import G4
from weft.registry import query
from weft.sources import dot, exchange

_BOX = """box AS (SELECT p_brand AS grp, p_partkey AS name, (p_partkey * 37 % 1009)::DOUBLE AS x, (p_partkey * 53 % 997)::DOUBLE AS y, (20 + p_size)::DOUBLE AS width, (10 + p_size % 7)::DOUBLE AS height FROM part),
bb AS (SELECT grp, min(x - width / 2) AS llx, min(y - height / 2) AS lly, max(x + width / 2) AS urx, max(y + height / 2) AS ury FROM box GROUP BY 1)"""


def _boxes(spark, sf):
    k = F.col("p_partkey")
    return views.table(spark, sf, "part").select(
        F.col("p_brand").alias("grp"), k.alias("name"), (k * 37 % 1009).cast("double").alias("x"), (k * 53 % 997).cast("double").alias("y"),
        (F.col("p_size") + 20).cast("double").alias("width"), (F.col("p_size") % 7 + 10).cast("double").alias("height"),
    )


@query("bbox", f"WITH {_BOX} SELECT * FROM bb")
def bbox(spark, sf):
    return layout.bounding_box(_boxes(spark, sf), ["grp"])


@query("normalize", f"WITH {_BOX} SELECT grp, name, x - llx AS x, y - lly AS y, width, height FROM box JOIN bb USING (grp)")
def normalize(spark, sf):
    return layout.normalize(_boxes(spark, sf), ["grp"])


@query("center", f"WITH {_BOX} SELECT grp, name, x - (llx + urx) / 2 AS x, y - (lly + ury) / 2 AS y, width, height FROM box JOIN bb USING (grp)")
def center(spark, sf):
    return layout.center(_boxes(spark, sf), ["grp"])


@query("rotate", f"WITH {_BOX} SELECT grp, name, x * 0 - y AS x, x + y * 0 AS y, height AS width, width AS height FROM box")
def rotate(spark, sf):
    return layout.rotate(_boxes(spark, sf), 90)


@query("scale_invert", f"WITH {_BOX} SELECT grp, name, x * 2.0::DOUBLE AS x, y * -3.0::DOUBLE AS y, width, height FROM box")
def scale_invert(spark, sf):
    return layout.scale(_boxes(spark, sf), 2.0, 3.0, invert=True)


@query("pack_components", f"WITH {_BOX}, o AS (SELECT grp, coalesce(sum(urx - llx + 8.0::DOUBLE) OVER (ORDER BY grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) - llx AS dx FROM bb) SELECT grp, name, x + dx AS x, y, width, height FROM box JOIN o USING (grp)")
def pack_components(spark, sf):
    return layout.pack(_boxes(spark, sf), "grp", 8.0)


@query("osage_pack", f"""WITH {_BOX}, t AS (SELECT *, greatest(1, ceil(sqrt(count(*) OVER p * avg(width) OVER p / greatest(avg(height) OVER p, 1.0))))::BIGINT AS cols,
 row_number() OVER (PARTITION BY grp ORDER BY name) - 1 AS k FROM box WINDOW p AS (PARTITION BY grp)), u AS (SELECT *, k // cols AS r FROM t),
v AS (SELECT *, 8.0::DOUBLE + coalesce(sum(width + 8.0::DOUBLE) OVER (PARTITION BY grp, r ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS x0 FROM u),
h AS (SELECT grp, r, 8.0::DOUBLE + coalesce(sum(max(height) + 8.0::DOUBLE) OVER (PARTITION BY grp ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS y0 FROM u GROUP BY grp, r)
SELECT grp, name, x0 + width / 2 AS x, y0 + height / 2 AS y, width, height FROM v JOIN h USING (grp, r)""")
def osage_pack(spark, sf):
    return layout.array_rows(_boxes(spark, sf), "grp", 8.0)


@query("scale_overlap", f"""WITH {_BOX}, p AS (SELECT abs(a.x - b.x) AS dx, abs(a.y - b.y) AS dy, (a.width + b.width) / 2 + 2 AS w, (a.height + b.height) / 2 + 2 AS h FROM box a JOIN box b ON a.name < b.name)
SELECT coalesce(round(max(least(greatest(CASE WHEN dx = 0 THEN 'inf'::DOUBLE ELSE w / dx END, 1.0), greatest(CASE WHEN dy = 0 THEN 'inf'::DOUBLE ELSE h / dy END, 1.0))), 9), 1.0)::DOUBLE AS factor, count(*) AS overlaps FROM p WHERE dx < w AND dy < h""")
def scale_overlap(spark, sf):
    return layout.scale_factor(_boxes(spark, sf), 2.0).withColumn("factor", F.round("factor", 9))


@query("rank_longest_path", _LEVELS + " SELECT name, level AS rank FROM l")
def rank_longest_path(spark, sf):
    return traverse.topo_levels(*_dag(spark, sf)).withColumnRenamed("level", "rank")


def _ranked(spark, sf):
    nodes, edges = _dag(spark, sf)
    r = traverse.topo_levels(nodes, edges)
    e = edges.join(r.select(F.col("name").alias("tail"), F.col("level").alias("rank_t")), "tail").join(r.select(F.col("name").alias("head"), F.col("level").alias("rank_h")), "head")
    return r.withColumnRenamed("level", "rank"), e


@query("virtual_nodes", _LEVELS + ", e AS (SELECT tail, head, a.level AS t, b.level AS h FROM d4 JOIN l a ON tail = a.name JOIN l b ON head = b.name) SELECT tail, head, unnest(range(t + 1, h)) AS rank FROM e")
def virtual_nodes(spark, sf):
    return layout.virtual_nodes(_ranked(spark, sf)[1])


@query("y_coords", _LEVELS + """, q AS (SELECT level AS rank, max((10 + name % 7)::DOUBLE) / 2 AS half FROM l GROUP BY 1)
SELECT rank, sum(step) OVER (ORDER BY rank) AS y FROM (SELECT rank, CASE WHEN lag(half) OVER (ORDER BY rank) IS NULL THEN half ELSE half + lag(half) OVER (ORDER BY rank) + 36.0::DOUBLE END AS step FROM q)""")
def y_coords(spark, sf):
    nodes = traverse.topo_levels(*_dag(spark, sf)).select(F.col("level").alias("rank"), (F.col("name") % 7 + 10).cast("double").alias("height"))
    return layout.rank_rows(nodes, 36.0)


@query("rank_crossings", _LEVELS + """, e AS (SELECT a.level AS rank, tail AS t, head AS h FROM d4 JOIN l a ON tail = a.name JOIN l b ON head = b.name WHERE b.level = a.level + 1)
SELECT a.rank, count(*) AS crossings FROM e a JOIN e b ON a.rank = b.rank AND a.t < b.t AND a.h > b.h GROUP BY 1""")
def rank_crossings(spark, sf):
    e = _ranked(spark, sf)[1].where("rank_h = rank_t + 1").select(F.col("rank_t").alias("rank"), F.col("tail").alias("t"), F.col("head").alias("h"))
    return layout.rank_crossings(e)


@query("weighted_median", f"WITH {G4}, m AS (SELECT tail, unnest(range(0, 1 + head % 3)) AS k, (head % 50)::DOUBLE AS pos FROM g4) SELECT tail, median(pos) AS median FROM m GROUP BY 1")
def weighted_median(spark, sf):
    e = views.copurchase(spark, sf).select("tail", (F.col("head") % 50).cast("double").alias("pos"), (1 + F.col("head") % 3).alias("weight"))
    return layout.weighted_median(e, "tail")


for _engine in layout.ENGINES:
    query(f"layout_{_engine}")(lambda spark, sf, engine=_engine: layout.lay_out(*_g4(spark, sf), engine))


@query("patchwork")
def patchwork(spark, sf):
    """Treemap of customers' balances per nation: one box per market segment."""
    import pandas as pd

    c = views.table(spark, sf, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.sum(F.abs("c_acctbal")).alias("area"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("c_mktsegment")
        boxes = layout.treemap(pdf["area"].tolist(), 0.0, 0.0, 100.0, 100.0)
        return pd.DataFrame({"nation": pdf["c_nationkey"], "segment": pdf["c_mktsegment"], "x": [b[0] for b in boxes], "y": [b[1] for b in boxes], "width": [b[2] for b in boxes], "height": [b[3] for b in boxes]})

    return c.groupBy("c_nationkey").applyInPandas(run, "nation int, segment string, x double, y double, width double, height double")


@query("cbd_ramp", "SELECT s.i AS scenario, t.i AS step, ((t.i + 1) * (s.i + 1))::DOUBLE AS value FROM range(4) s(i), range(5) t(i)")
def cbd_ramp(spark, sf):
    """Constant + delayed own output, several slopes: the sum grows by the constant every step."""
    s = spark.range(4).withColumnRenamed("id", "scenario")
    none = F.array().cast("array<string>")
    b = F.explode(F.array(
        F.struct(F.lit("one").alias("name"), F.lit("constant").alias("kind"), (F.col("scenario") + 1).cast("double").alias("param"), none.alias("inputs")),
        F.struct(F.lit("delay").alias("name"), F.lit("delay").alias("kind"), F.lit(0.0).alias("param"), F.array(F.lit("add")).alias("inputs")),
        F.struct(F.lit("add").alias("name"), F.lit("adder").alias("kind"), F.lit(0.0).alias("param"), F.array(F.lit("one"), F.lit("delay")).alias("inputs")),
    ))
    t = simulate.block_traces(s.select("scenario", b.alias("b")).select("scenario", "b.*"), 5)
    return t.where("block = 'add'").select("scenario", "step", "value")


@query("cbd_feedforward_delay", "SELECT user_id, event_id, value, lag(value, 1, 0.0) OVER w AS delayed, 2 * value - lag(value, 1, 0.0) OVER w AS filtered FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def cbd_feedforward_delay(spark, sf):
    z = F.lag("value", 1, 0.0).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return views.table(spark, sf, "events").select("user_id", "event_id", "value", z.alias("delayed"), (2 * F.col("value") - z).alias("filtered"))


@query("cbd_feedback", "SELECT i AS n, 2 ** i - 1.0 AS value FROM range(1, 31) t(i)")
def cbd_feedback(spark, sf):
    """x <- 2 x + 1 from 0, as a fold."""
    x = F.aggregate(F.sequence(F.lit(1), F.col("n").cast("int")), F.lit(0.0), lambda acc, _: acc * 2 + 1)
    return spark.range(1, 31).withColumnRenamed("id", "n").select("n", x.alias("value"))


@query("event_order", "SELECT user_id, event_type AS name, value AS t, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS k FROM events")
def event_order(spark, sf):
    e = views.table(spark, sf, "events").select("user_id", F.col("event_type").alias("name"), F.col("value").alias("delay"), F.col("event_id").alias("seq"))
    return simulate.fire_order(e, "user_id")


@query("trace_series", "SELECT event_type AS series, count(*) AS points, min(value) AS lo, max(value) AS hi, arg_max(value, event_id) AS last_value FROM events GROUP BY 1")
def trace_series(spark, sf):
    e = views.table(spark, sf, "events")
    return e.groupBy(F.col("event_type").alias("series")).agg(F.count("*").alias("points"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.max_by("value", "event_id").alias("last_value"))


@query("tumbling_counts", "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_counts(spark, sf):
    return streaming.tumbling_counts(views.table(spark, sf, "events")).withColumn("total", F.round("total", 4))


@query("event_sessions", """SELECT user_id, min(ts) AS session_start, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM
(SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE > ts THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s""")
def event_sessions(spark, sf):
    return streaming.sessions(views.table(spark, sf, "events"))


def _chains(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = views.table(spark, sf, "conversations").select("conv_id", F.concat(F.lit("t"), "turn").alias("tail"), F.concat(F.lit("t"), F.lead("turn").over(w)).alias("head"))
    return c.select("conv_id", F.col("tail").alias("name")), c.where("head IS NOT NULL").select("conv_id", "tail", "head")


@query("dot_round_trip", "SELECT conv_id::VARCHAR AS file, count(*) AS n_nodes, count(*) - 1 AS n_edges FROM conversations GROUP BY 1")
def dot_round_trip(spark, sf):
    """Conversation chains written as DOT and parsed again."""
    nodes, edges = _chains(spark, sf)
    none = F.create_map().cast("map<string,string>")
    text = dot.write(nodes.withColumn("attrs", none), edges.withColumn("attrs", none), "conv_id")
    rows = dot.parse_texts(text, "conv_id", "text")
    return rows.groupBy("file").agg(F.count_if(F.col("kind") == "node").alias("n_nodes"), F.count_if(F.col("kind") == "edge").alias("n_edges"))


@query("json0_nodes", "SELECT conv_id, 't' || turn AS name FROM conversations")
def json0_nodes(spark, sf):
    nodes, edges = _chains(spark, sf)
    return exchange.read_json(exchange.write_json(nodes, edges, "conv_id"), "conv_id", "json")[0]


@query("json0_edges", "SELECT * FROM (SELECT conv_id, 't' || turn AS tail, 't' || lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS head FROM conversations) WHERE head IS NOT NULL")
def json0_edges(spark, sf):
    nodes, edges = _chains(spark, sf)
    return exchange.read_json(exchange.write_json(nodes, edges, "conv_id"), "conv_id", "json")[1]


@query("gxl_round_trip", "SELECT * FROM (SELECT conv_id, 't' || turn AS tail, 't' || lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS head FROM conversations) WHERE head IS NOT NULL")
def gxl_round_trip(spark, sf):
    nodes, edges = _chains(spark, sf)
    return exchange.read_gxl(exchange.write_gxl(nodes, edges, "conv_id"), "conv_id", "xml")[1]


@query("detect_format", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'json' WHEN page_id % 3 = 1 THEN 'gxl' ELSE 'dot' END AS format FROM pages")
def detect_format(spark, sf):
    k = F.col("page_id") % 3
    name = F.when(k == 0, "a.json").when(k == 1, "noname").otherwise("b.gv")
    text = F.when(k == 1, F.concat(F.lit("<?xml"), "html")).otherwise(F.col("html"))
    return views.table(spark, sf, "pages").select("page_id", exchange.detect(name, text).alias("format"))


@query("svg_shapes", "SELECT n_regionkey AS drawing, count(*) AS shapes FROM nation GROUP BY 1")
def svg_shapes(spark, sf):
    """Nations drawn per region; the drawing's shapes counted from its text."""
    n = views.table(spark, sf, "nation")
    shape = F.element_at(F.array(*[F.lit(s) for s in ("box", "ellipse", "diamond", "hexagon", "plaintext")]), (F.col("n_nationkey") % 5 + 1).cast("int"))
    part = svg.node(shape, F.col("n_nationkey") * 10.0, F.lit(0.0), F.lit(54.0), F.lit(36.0), F.col("n_name"))
    d = svg.drawing(n.select("n_regionkey", F.lit(1).alias("layer"), F.col("n_nationkey").alias("seq"), part.alias("fragment")), "n_regionkey")
    return d.select(F.col("n_regionkey").alias("drawing"), F.regexp_count("svg", F.lit("<text ")).cast("long").alias("shapes"))


@query("degree_distribution", f"WITH {G4}, d AS (SELECT name, count(*) AS degree FROM (SELECT tail AS name FROM g4 UNION ALL SELECT head FROM g4) GROUP BY 1) SELECT degree, count(*) AS n FROM d GROUP BY 1")
def degree_distribution(spark, sf):
    return basic.degree(*_g4(spark, sf)).groupBy("degree").agg(F.count("*").alias("n"))
