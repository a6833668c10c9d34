"""The pipeline's stages one by one, on rows with shared and missing ids, and the opN_ queries that SQL cannot check."""

import collections
import random
import zlib

import pytest
from tests.llm.test_ops import SCHEMA, words

import corpus_pipeline as p
from weft.llm import licenses, pieces, pii
from weft.llm.queries import QUERIES


def sentence(r, lang, n=40):
    return " ".join(r.choice({"xx": "aeb ced dae fod", "yy": "qur zoq ruz wix"}[lang].split()) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(21)
    out = [(i, sentence(r, "xy"[i % 2] * 2) + " a.b@cd.ef" * (i % 5 == 0), "xy"[i % 2] * 2, ["a", "b", None][i % 3]) for i in range(60)]
    long = words(r, 50) + " " + sentence(r, "xx", 60)
    return out + [(3, long, "xx", "a"), (70, long + " more", None, "a"), (None, long + " other", "xx", "b"), (None, "...", None, None), (71, None, "xx", "a"), (72, "", None, None), (None, None, None, None)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), 1, "x", "y", 2) for i, t, lang, s in rows], SCHEMA)


def ids(df):
    assert df.columns == p.COLUMNS
    return collections.Counter((x["doc_id"], x["text"]) for x in df.collect())


def test_stages(spark, rows):
    docs = frame(spark, rows)
    named = ids(p.identify_language(spark, docs, ""))
    assert named == collections.Counter((i, t) for i, t, *_ in rows if t and any(c.isalpha() for c in t))
    kept = ids(p.drop_near_duplicates(spark, frame(spark, [*rows, rows[0]]), ""))
    gone = [(70, rows[61][1]), (None, rows[62][1])]
    want = collections.Counter((i, t) for i, t, *_ in rows)
    assert kept == want - collections.Counter(gone) and kept[3, rows[60][1]] == 1
    clean = ids(p.redact_pii(spark, docs, ""))
    assert clean == collections.Counter((i, None if t is None else pii.redact(t)) for i, t, *_ in rows) and any("<email>" in (t or "") for _, t in clean)
    mixed = ids(p.mix_sources(spark, docs, ""))
    assert set(mixed) <= set(want) and max(mixed.values()) <= 2 and mixed == ids(p.mix_sources(spark, docs.repartition(3), ""))
    got = p.tokenize(spark, docs, "").collect()
    assert len(got) == len(rows) and all(x["lossless"] for x in got)
    for name, step in p.STAGES[:-1]:
        assert step(spark, docs.limit(0), "").count() == 0, name


def test_queries_through_tables(spark, rows, tmp_path):
    frame(spark, rows).select(*p.COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, i % 2, int(i % 2 == 0)) for i in range(60)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    crc = lambda i, n: None if i is None else zlib.crc32(str(i).encode()) % n
    lang = QUERIES["op3_mixture_langid"](spark, str(tmp_path)).collect()
    assert collections.Counter((x["doc_id"], x["held_out"]) for x in lang) == collections.Counter((i, crc(i, 3) == 1) for i, *_ in rows)
    truth = {i: name for i, _, name, _ in rows[:60] if i != 3}
    assert all(x["lang_pred"] == truth[x["doc_id"]] for x in lang if x["doc_id"] in truth and 0 <= x["score"] <= 1)
    assert collections.Counter(x["lang_pred"] for x in lang)["und"] == 4
    tox = QUERIES["op7_max_segments"](spark, str(tmp_path)).collect()
    assert collections.Counter((x["doc_id"], x["held_out"]) for x in tox) == collections.Counter((i, crc(i, 4) == 2) for i, *_ in rows)
    assert all(0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.3) for x in tox)
    lic = QUERIES["op1_license_patience"](spark, str(tmp_path)).collect()
    scan = licenses.Scanner().scan
    assert collections.Counter((x["doc_id"], x["n_licenses"]) for x in lic) == collections.Counter((i, len(scan(t or ""))) for i, t, *_ in rows)
    enc = QUERIES["op10_lattice_sampling"](spark, str(tmp_path)).collect()
    c = pieces.codec(pieces.load(), pieces.TEMPERATURE)
    assert collections.Counter((x["doc_id"], None if x["ids"] is None else c.decode(x["ids"])) for x in enc) == collections.Counter((i, t) for i, t, *_ in rows)
    out = p.run(spark, str(tmp_path)).collect()
    assert out and all(x["lossless"] for x in out) and {x["doc_id"] for x in out} <= {i for i, *_ in rows}
