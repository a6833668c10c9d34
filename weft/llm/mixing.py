"""Mixing sources to target weights by systematic sampling (DataFrame functions only).

Targets: sources in code-point order (null last) take the weights ``weights`` in turn and share
``budget`` times the words of all sources by weight; no target exceeds ``cap`` times its source's
words, the excess being shared again by weight among the rest (a water level, solved in closed form
over the source table).

Copies: within a source every document expects ``target / source_size`` copies. Documents stand in
the order (size class, salt, size, doc_id); the expected copies are prefix-summed along it, one random
offset per source is added, and a document is emitted once for every integer boundary its stretch
crosses. As expected copies are equal within a source, the prefix sum is rate x rank: exact ranks,
no float accumulation, so reruns agree. Ordering by size makes the words taken follow the target.

Scale: the rank is two-level. Documents are ranked inside (source, size class, salt) with about
sqrt(rows) salts, so a source with a third of all rows spreads over all tasks; only the per-group
counts are prefix-summed per source. ``documents`` is scanned once; the rest runs on three narrow columns.

Edge cases: null or empty text has size 0 and takes 0 words (its copies follow the same sampling);
a null source is a source of its own; an empty table gives no rows; repeated doc_ids are separate
rows; a source of size 0 has target 0. Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.common import WORD_SPACE, stage, text_key

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
CAP = 2.0
SEED = "mix-1"


def word_count(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    parts = F.size(F.split(t, WORD_SPACE)).cast("long")
    edge = F.rlike(t, F.lit(rf"^{WORD_SPACE}")).cast("long") + F.rlike(t, F.lit(rf"{WORD_SPACE}\z")).cast("long")
    return F.when(~F.rlike(t, F.lit(r"[^ \t\n\x0B\f\r]")), F.lit(0).cast("long")).otherwise(parts - edge)


def _unit(text: Column) -> Column:
    """A uniform number in [0, 1) from a string: 13 hex digits of its md5."""
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def source_targets(sized: DataFrame, weights=WEIGHTS, budget=BUDGET, cap=CAP, seed=SEED) -> DataFrame:
    """One row per source: (no_source, src, source_size, target, rate, shift)."""
    by_name = Window.orderBy("no_source", "src")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sized.groupBy("no_source", "src").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    s = s.withColumn("weight", weight).withColumn("ceiling", F.col("source_size") * F.lit(cap))
    s = s.withColumn("level", F.col("ceiling") / F.col("weight"))
    filled = Window.orderBy("level", "no_source", "src").rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("rest", F.sum("source_size").over(everyone) * F.lit(budget) - F.coalesce(F.sum("ceiling").over(filled), F.lit(0.0)))
    s = s.withColumn("open_weight", F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(filled), F.lit(0.0)))
    s = s.withColumn("water", F.col("rest") / F.col("open_weight"))
    # capping in level order raises the water until it covers no further source; from there on it falls
    final = F.max(F.when(F.col("water") <= F.col("level"), F.col("water"))).over(everyone)
    s = s.withColumn("target", F.least(F.col("ceiling"), F.coalesce(final, F.lit(0.0)) * F.col("weight")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return s.select("no_source", "src", "source_size", "target", rate.alias("rate"), _unit(F.concat_ws("|", F.lit(seed), F.col("no_source").cast("string"), "src")).alias("shift"))


def mix(docs: DataFrame, weights=WEIGHTS, budget=BUDGET, cap=CAP, seed=SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, tk): the number of times each document is emitted; tk is its
    text's key."""
    src = F.col("source").cast("string")
    narrow = docs.select(
        "doc_id", text_key(F.col("text")).alias("tk"), src.isNull().cast("int").alias("no_source"), F.coalesce(src, F.lit("")).alias("src"), word_count(F.col("text")).alias("size")
    )
    sized = stage(narrow, "mix")
    rows = sized.count()
    salts = max(1, math.isqrt(rows) // 4)
    salt = F.pmod(F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long"), F.lit(salts))
    keyed = sized.withColumn("size_class", F.length(F.bin("size"))).withColumn("salt", salt)
    group = ["no_source", "src", "size_class", "salt"]
    ahead = Window.partitionBy("no_source", "src").orderBy("size_class", "salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = keyed.groupBy(*group).agg(F.count("*").alias("members"))
    groups = groups.withColumn("base", F.coalesce(F.sum("members").over(ahead), F.lit(0))).drop("members")
    groups = groups.join(source_targets(sized, weights, budget, cap, seed), ["no_source", "src"])
    ranked = keyed.withColumn("inner_rank", F.row_number().over(Window.partitionBy(*group).orderBy("size", "doc_id", "tk")))
    at = (F.col("base") + F.col("inner_rank")).cast("double")
    cross = lambda k: F.floor(k * F.col("rate") + F.col("shift"))
    return ranked.join(groups, group).select(
        "doc_id", F.when(F.col("no_source") == 0, F.col("src")).alias("source"), "size", "source_size", "target", (cross(at) - cross(at - 1)).cast("long").alias("copies"), "tk"
    )


def emitted(docs: DataFrame, **settings) -> DataFrame:
    """The rows, whole, each as often as the mix takes it. Rows equal in doc_id, source and text are one document,
    taken as often as all of them."""
    row = lambda *tk: [F.col("doc_id").isNull().alias("no_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.col("source").isNull().alias("no_source"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("src"), *tk]
    key = ["no_id", "id", "no_source", "src", "tk"]
    taken = mix(docs, **settings).where("copies > 0").groupBy(*row(F.col("tk"))).agg(F.sum("copies").alias("copies"))
    keyed = docs.select("*", *row(text_key(F.col("text")).alias("tk"))).dropDuplicates(key)
    return keyed.join(taken, key).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*docs.columns)


def op5_systematic_mix(spark, sf_dir: str) -> DataFrame:
    from weft.llm.common import table

    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


#: The same mix as one statement; salts and offsets come from md5, which both engines have.
OP5_SQL = r"""
WITH sized AS (
  SELECT doc_id, (source IS NULL)::INT AS no_source, coalesce(source, '') AS src,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents),
n AS (SELECT greatest(1, floor(sqrt(count(*)))::BIGINT // 4) AS salts FROM sized),
s0 AS (SELECT no_source, src, sum(size)::BIGINT AS source_size,
              [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY no_source, src) - 1) % 3 + 1)::INT]::DOUBLE AS weight
       FROM sized GROUP BY no_source, src),
s1 AS (SELECT *, source_size * 2.0::DOUBLE AS ceiling, source_size * 2.0::DOUBLE / weight AS level FROM s0),
s2 AS (SELECT *, (SELECT sum(source_size) FROM s1)::DOUBLE * 1.5::DOUBLE
               - coalesce(sum(ceiling) OVER before, 0.0)::DOUBLE AS rest,
              (SELECT sum(weight) FROM s1)::DOUBLE - coalesce(sum(weight) OVER before, 0.0)::DOUBLE AS open_weight
       FROM s1 WINDOW before AS (ORDER BY level, no_source, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, max(CASE WHEN rest / open_weight <= level THEN rest / open_weight END) OVER () AS water FROM s2),
s4 AS (SELECT no_source, src, source_size, least(ceiling, coalesce(water, 0.0) * weight) AS target,
              ('0x' || substr(md5('mix-1|' || no_source || '|' || src), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS shift
       FROM s3),
r AS (SELECT sized.*, row_number() OVER (PARTITION BY no_source, src ORDER BY length(bin(size)),
              ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % n.salts, size, doc_id) AS k
      FROM sized, n)
SELECT doc_id, size, source_size, target,
       size * (floor(k::DOUBLE * rate + shift) - floor((k - 1)::DOUBLE * rate + shift))::BIGINT AS taken
FROM (SELECT r.doc_id, r.size, r.k, s4.source_size, s4.target, s4.shift,
             CASE WHEN s4.source_size > 0 THEN s4.target / s4.source_size ELSE 0.0 END AS rate
      FROM r JOIN s4 ON r.no_source = s4.no_source AND r.src = s4.src)
"""
