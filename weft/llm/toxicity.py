"""Toxicity by maximum-scoring segments.

Model: for every word, and every word's leading ``PREFIX`` characters, the documents of either class
that hold it are counted over all labelled training rows; rates are shares of all such counts of a class,
so the classes may differ in length. With a Dirichlet prior (the features' overall
rate, ``PRIOR`` pseudo-documents) this gives log-odds and their standard error; a feature's score is the
bound of the log-odds nearer to zero (``Z`` standard errors), so rare features say nothing. A feature
counts only if its likelihood ratio (signed root) passes ``sqrt(2 ln V)``, the most that V features
reach by chance: the vocabulary grows with the corpus, and without this so does the number of features
that look toxic by luck.

Scan: a token scores the strongest of its features less ``DRIFT``, so leanings of common words make no
passage and the expected score is negative. The linear-time all-maximal-segments scan finds every maximal-scoring segment
of a text. Extreme-value calibration: among texts that are not toxic, a text of n tokens has about
``E = K n exp(-lambda S)`` segments as good as S. lambda and K are estimated from all segments of all clean training
rows: the scores' tail is exponential (its rate, lambda, by maximum likelihood) and K is the number of segments a token;
both start from one segment of score 1 in ``CHANCE`` tokens, so they exist without any segment. A segment is
significant (a toxic passage) if E < 1, and every one is reported with its E-value. A text's statistic is -log of the
chance ``1 - exp(-E)`` (the extreme-value distribution) that a clean text of its length holds a segment as good as its
best, and is mapped to a probability by a logistic curve.

The curve is fitted on at most ``CALIBRATION_ROWS`` labelled training rows (by hash order, documented
bound); all counts use all rows. The model holds every feature that passes the likelihood-ratio test. Up to
``VOCABULARY`` of them are broadcast; a larger model is joined with the texts' features instead, which gives the
same scores.

Edge cases: null and empty texts have no segments and get the curve's base rate; unlabelled rows are
scored; a label table with one class only, or empty, gives every document the smoothed base rate; several labels
of one doc_id count as toxic if any is; labels without a doc_id are left out; rows sharing an id share its label;
repeated rows score alike; very long texts are scanned whole; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import arrow_map, fold, release, sifted, sliced, stage, table

PREFIX = 5
PRIOR = 20.0
Z = 1.0
DRIFT = 0.5
CHANCE = 50.0
VOCABULARY = 100_000
CALIBRATION_ROWS = 50_000

_WORD = re.compile(r"[^\W\d_]+")


def tokens(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def count_features(labelled: DataFrame) -> DataFrame:
    """(feature, toxic documents, clean documents) over rows of (text, toxic)."""
    def count(batches):
        sums: dict[str, list[int]] = {}

        def flush():
            keys = list(sums)
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([sums[k][1] for k in keys], pa.int64()), pa.array([sums[k][0] for k in keys], pa.int64())], names=["feature", "bad", "good"])
            sums.clear()
            return out

        for b in sliced(batches):
            for t, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
                for w in features(t or ""):
                    c = sums.get(w)
                    if c is None:
                        c = sums[w] = [0, 0]
                    c[y] += 1
            if len(sums) > 300_000:  # bounded memory: partial sums go on, the aggregation completes them
                yield flush()
        yield flush()

    part = labelled.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(count, "feature string, bad long, good long")
    return part.groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))


def features(text: str) -> set[str]:
    """A text's words, and of longer ones their leading ``PREFIX`` characters, marked."""
    words = set(tokens(text))
    return words | {w[:PREFIX] + "*" for w in words if len(w) > PREFIX}


def train(labelled: DataFrame) -> DataFrame:
    """(feature, s): the scores of all significant features, from rows of (text, toxic 0/1)."""
    spark = labelled.sparkSession
    n = labelled.agg(F.sum("toxic"), F.count("*")).first()
    bad, good = int(n[0] or 0), int((n[1] or 0) - (n[0] or 0))
    counts = stage(count_features(labelled), "toxic-features") if bad and good else None
    size, in_bad, in_good = counts.agg(F.count("*"), F.sum("bad"), F.sum("good")).first() if bad and good else (0, 0, 0)
    if not in_bad or not in_good:
        return spark.createDataFrame([], "feature string, s double")
    chance, held, pairs = 2 * math.log(max(size, 2)), F.col("bad") + F.col("good"), float(in_bad + in_good)

    def term(seen, total, rate):
        return F.when(seen > 0, seen * F.log(seen / (F.lit(float(total)) * rate))).otherwise(F.lit(0.0))

    rate, rest = held / pairs, 1 - held / pairs
    ratio = term(F.col("bad"), in_bad, rate) + term(F.col("good"), in_good, rate) + term(in_bad - F.col("bad"), in_bad, rest) + term(in_good - F.col("good"), in_good, rest)
    prior = PRIOR * held / float(bad + good)
    share = lambda c, total: F.log((F.col(c) + prior) / F.lit(total + PRIOR * pairs / (bad + good)))
    delta = share("bad", in_bad) - share("good", in_good)
    err = F.sqrt(1 / (F.col("bad") + prior) + 1 / (F.col("good") + prior))
    s = F.when(delta > 0, F.greatest(F.lit(0.0), delta - Z * err)).otherwise(F.least(F.lit(0.0), delta + Z * err))
    out = stage(counts.where(2 * ratio > chance).select("feature", s.alias("s")).where("s <> 0"), "toxic-model")
    release(counts)
    return out


def token_scores(words: list[str], model: dict[str, float]) -> list[float]:
    get, out = model.get, []
    for w in words:
        s = get(w, 0.0)
        if len(w) > PREFIX:
            p = get(w[:PREFIX] + "*", 0.0)
            if abs(p) > abs(s):
                s = p
        out.append(s - DRIFT)
    return out


def segments(scores) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score) of a sequence, in linear time."""
    runs: list[list] = []  # start, end, score before start, score at end, nearest run to the left with a lower start
    total = 0.0
    for i, s in enumerate(scores):
        before = total
        total += s
        if s <= 0:
            continue
        cur = [i, i + 1, before, total]
        while True:
            j = len(runs) - 1
            while j >= 0 and runs[j][2] >= cur[2]:
                j = runs[j][4]
            if j < 0 or runs[j][3] >= cur[3]:
                runs.append([*cur, j])
                break
            cur = [runs[j][0], cur[1], runs[j][2], cur[3]]
            del runs[j:]
    return [(r[0], r[1], r[3] - r[2]) for r in runs]


def found_in(text: str, model: dict[str, float]):
    """(number of tokens, all maximal segments) of a text."""
    words = tokens(text)
    return len(words), segments(token_scores(words, model)) if words else []


SEGMENTS = "array<struct<lo:int,hi:int,s:double>>"


def scan(docs: DataFrame, model: DataFrame, limit: int = VOCABULARY) -> DataFrame:
    """(doc_id, n, found) of rows (doc_id, text): tokens and maximal segments."""

    def rows(batch, models):
        got = [found_in(t, m) if t else (0, []) for t, m in zip(batch.column("text").to_pylist(), models)]
        return {"doc_id": batch.column("doc_id"), "n": [g[0] for g in got], "found": [[{"lo": a, "hi": b, "s": s} for a, b, s in g[1]] for g in got]}

    schema = f"doc_id long, n long, found {SEGMENTS}"
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if model.count() <= limit:
        shared = docs.sparkSession.sparkContext.broadcast({r["feature"]: r["s"] for r in model.collect()})  # at most `limit` features
        return arrow_map(docs, lambda batch: rows(batch, [shared.value] * batch.num_rows), schema)

    # each text gets its own part of the model; equal texts share it
    keyed = docs.withColumn("sha", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))

    def split(batch):
        held = [(sha, f) for sha, t in zip(batch.column("sha").to_pylist(), batch.column("text").to_pylist()) for f in features(t or "")]
        return {"sha": [h[0] for h in held], "feature": [h[1] for h in held]}

    own = arrow_map(keyed, split, "sha string, feature string").distinct().join(model, "feature")
    own = own.groupBy("sha").agg(F.collect_list(F.struct("feature", "s")).alias("own"))  # no more than a text's features
    return arrow_map(keyed.join(own, "sha", "left").select("doc_id", "text", "own"), lambda batch: rows(batch, [{x["feature"]: x["s"] for x in o or ()} for o in batch.column("own").to_pylist()]), schema)


def extreme_values(clean: DataFrame) -> tuple[float, float]:
    """(lambda, K) from the rows (n, found) of clean training texts."""
    sums = F.aggregate("found", F.lit(0.0), lambda a, x: a + x["s"])
    n, many, total = clean.agg(F.sum("n"), F.sum(F.size("found")), F.sum(sums)).first()
    return ((many or 0) + 1.0) / ((total or 0.0) + 1.0), ((many or 0) + 1.0) / ((n or 0) + CHANCE)


def evidence(found: DataFrame, rate: float, k: float, *others: str) -> DataFrame:
    """(doc_id, x, n_passages, passages): passages are the found segments with E < 1, each with its E-value."""
    chance = lambda s: F.greatest(F.lit(k) * F.col("n") * F.exp(-F.lit(rate) * s), F.lit(1e-300))
    best = F.aggregate("found", F.lit(0.0), lambda a, x: F.greatest(a, x["s"]))
    shown = F.transform("real", lambda x: F.format_string("%d:%d:%.1e", x["lo"], x["hi"], chance(x["s"])))
    out = found.withColumn("real", F.filter("found", lambda x: chance(x["s"]) < 1))
    x = F.when(F.size("found") > 0, -F.log(-F.expm1(-chance(best)))).otherwise(F.lit(0.0))
    return out.select("doc_id", x.alias("x"), F.size("real").cast("long").alias("n_passages"), F.array_join(shown, ",").alias("passages"), *others)


def calibrate(x: np.ndarray, y: np.ndarray, steps: int = 50):
    """Logistic curve on log1p(x), by ridge-regularised Newton steps: (intercept, slope >= 0)."""
    f = np.log1p(np.maximum(x, 0.0))
    a = np.stack([np.ones_like(f), f], 1)
    w = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + 0.01 * w
        hess = (a * (p * (1 - p))[:, None]).T @ a + 0.01 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), max(0.0, float(w[1]))


def score(docs: DataFrame, labelled_ids: DataFrame) -> DataFrame:
    """docs (doc_id, text) scored by a model learned from ``labelled_ids`` (doc_id, toxic)."""
    flags = labelled_ids.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    # labels grow with the corpus: never broadcast; only texts that have a label are shuffled
    labelled = sifted(docs.select("doc_id", "text"), flags, "doc_id").join(flags.hint("shuffle_hash"), "doc_id")
    model = train(labelled)
    found = stage(scan(docs, model), "toxic")
    if hasattr(model, "staged_at"):
        release(model)
    known = found.join(flags, "doc_id")
    tail = extreme_values(known.where("toxic = 0"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id", "n").limit(CALIBRATION_ROWS)
    pairs = evidence(sample, *tail, "toxic").select("x", "toxic").toPandas()
    a, b = calibrate(pairs["x"].to_numpy(float), pairs["toxic"].to_numpy(float))
    p = 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.log1p(F.greatest("x", F.lit(0.0))))))
    return evidence(found, *tail).select("doc_id", p.alias("score"), "n_passages", "passages")


THRESHOLD = 0.3


def op7_max_segments(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = score(docs, labels.where(fold(F.col("doc_id"), 4) != 2).select("doc_id", "toxic"))
    return out.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        "n_passages",
        "passages",
    )
