"""Licenses, toxicity and languages at the edges of their bounds."""

import random

import numpy as np
import pytest

from weft.llm import langid, licenses, toxicity


def test_licenses_two_copies_at_every_offset():
    s, r = licenses.Scanner(), random.Random(4)
    for name in ("apache-2.0-header", "bsd-redistribution", "mit-full"):
        tw = licenses.words_of(licenses.TEMPLATES[name])[0]
        for offset in range(60):
            # each word of the template more than once, so no word is an anchor
            drop = set(r.sample(range(1, len(tw) - 1), len(tw) // 10)) if offset % 2 else ()
            copy = " ".join(w for i, w in enumerate(tw) if i not in drop)
            text = " ".join(["the"] + ["of", "any"] * (offset // 2) + ["the"] * (offset % 2)) + f" {copy} the of the {copy} the"
            got = [f for f in s.scan(text) if f[0] == name]
            assert len(got) == 2, (name, offset, got)
            assert all(f[3] > 0.9 - 0.04 * bool(drop) for f in got)


def test_licenses_long_insertion():
    s = licenses.Scanner()
    for name in ("apache-2.0-header", "bsd-redistribution", "isc", "mit-full"):
        tw = licenses.words_of(licenses.TEMPLATES[name])[0]
        half = len(tw) // 2
        for n in (0, 7, 8, 20, len(tw)):
            notice = " ".join(tw[:half] + ["zzz"] * n + tw[half:])
            for text in (notice, f"some words of the {notice} and the rest", f"{notice} {'qqq ' * 300} {notice}"):
                got = [f for f in s.scan(text) if f[0] == name]
                assert len(got) == text.count(notice), (name, n, got)
                assert all(f[3] >= 0.95 for f in got)
        assert name not in [f[0] for f in s.scan(" ".join(tw[:half] + ["zzz"] * (len(tw) + 9) + tw[half:]))]


def test_toxicity_scores_alike_by_broadcast_and_join(spark):
    r = random.Random(3)
    texts = [" ".join(r.choice("alpha bravo charlie delta nasty vilest echo".split()) for _ in range(30)) for _ in range(120)]
    rows = [(i, t if i % 3 else t.replace("nasty", "alpha").replace("vilest", "echo"), int(i % 3 > 0)) for i, t in enumerate(texts)] + [(500, None, 0), (501, "", 0), (502, texts[0], 0)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(labelled)
    assert model.count() > 1
    held = {x["feature"]: x["s"] for x in model.collect()}
    want = sorted((i, *map(str, toxicity.found_in(t or "", held))) for i, t, _ in rows)
    for limit in (10**6, 0):
        got = toxicity.scan(labelled, model, limit).collect()
        assert sorted((g["doc_id"], str(g["n"]), str([tuple(x) for x in g["found"]])) for g in got) == want


def test_extreme_values_follow_the_tail(spark):
    r = np.random.default_rng(4)
    rows = [(1000, [(0, 1, float(x)) for x in r.exponential(1 / 0.7, 12)]) for _ in range(400)]
    df = spark.createDataFrame(rows, f"n long, found {toxicity.SEGMENTS}")
    rate, k = toxicity.extreme_values(df)
    assert abs(rate - 0.7) < 0.03 and abs(k - 0.012) < 0.0003
    assert toxicity.extreme_values(df.limit(0)) == (1.0, 1 / toxicity.CHANCE)


def test_langid_keeps_a_small_share_of_a_long_document():
    theta = np.full((3, 30), 1e-4)
    for k in range(3):
        theta[k, 10 * k : 10 * k + 10] = 1.0
    theta /= theta.sum(1, keepdims=True)
    counts = np.r_[np.full(10, 20000.0), np.full(10, 60.0)]  # 0.3 % of the second language
    who, share = langid.infer((np.arange(20), counts), theta)
    assert who == [0, 1] and 0.002 < share[1] < 0.004
