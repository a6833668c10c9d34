"""The corpus pipeline: five stages, each one of the training-data operators.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept; all but the last
return the columns of ``documents``. ``run`` writes each stage as Parquet under spark.checkpoint.dir and
reads it again for the next, and deletes what it has read.

Rows go by their content, so rows that share a doc_id, or have none, are documents of their own in every stage. Null
or empty texts have no language and leave at the first stage; an empty table passes through empty; extra columns are
left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weft.llm import langid, mixing, ngramjoin, pieces, pii
from weft.llm.common import release, stage, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_SHARE = 0.35  # a document whose largest language holds less than this has no language to speak of


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those in which no language dominates. Without any labelled text there are no
    languages, and every document goes; equal texts stay or go together."""
    return langid.determined(docs.select(*COLUMNS), langid.train(docs), LEAST_SHARE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays (one without an id only if none has
    one; of several with it, that of the smallest text key). Rows equal in id and text are one; a text without words is
    a group of its own."""
    return ngramjoin.one_of_each(docs.select(*COLUMNS))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every personal-data span by its kind and brings n_chars up to date. Every row stays; a null text stays
    null."""
    return pii.redacted(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emits each document as often as the mix takes it (0, 1 or 2 times). A null source is a source; null and empty
    texts have size 0 and follow the same sampling."""
    return mixing.emitted(docs.select(*COLUMNS))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled pieces of every emitted document: (doc_id, ids, n_tokens, ids_sha256, lossless). A null text has null ids;
    copies of a document get the same pieces."""
    return pieces.encode(docs)


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("pii", redact_pii),
    ("mix_sources", mix_sources),
    ("sentencepiece", tokenize),
]

#: SQL expresses none of the learned, sampled or set-similarity stages; tests hold them to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, old = table(spark, sf_dir, "documents"), None
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
        if old is not None:
            release(old)
        old = docs
    return STAGES[-1][1](spark, docs, sf_dir)
