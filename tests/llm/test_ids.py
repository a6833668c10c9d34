"""Documents that share an id, or have none, and texts made to be slow: no row, link or byte is lost."""

import collections
import hashlib
import random
import re
import time

import numpy as np
import pytest
from tests.llm.test_ops import SCHEMA, base_spans, words

from weft.llm import embeddings, licenses, merkle, ngramjoin, pii, suffixes


def rows_of(spark, rows):
    """rows: (doc_id or None, text)."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "x", "y", 2) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd():
    r = random.Random(12)
    a, b, c, passage = words(r, 60), words(r, 60), words(r, 60), words(r, 70)
    return [
        (1, a), (1, c), (2, a + " word"), (3, c + " word"), (None, b), (4, b + " word"), (None, "alone " + words(r, 40)), (5, None), (None, None), (6, ""),
        (7, words(r, 20) + " " + passage), (7, words(r, 20)), (None, words(r, 20) + " " + passage + " x"), (8, a), (8, a), (None, words(r, 30)), (None, words(r, 30)),
    ]


def test_ngram_join_by_text(spark, odd):
    sets = []
    for _, t in odd:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    comp = list(range(len(odd)))
    for i in range(len(odd)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                comp = [min(comp[i], comp[j]) if c in (comp[i], comp[j]) else c for c in comp]
    low = {c: min((d for (d, _), x in zip(odd, comp) if x == c and d is not None), default=None) for c in comp}
    want = collections.Counter((d, len(s), low[c]) for (d, _), s, c in zip(odd, sets, comp))
    got = collections.Counter(tuple(r) for r in ngramjoin.join(rows_of(spark, odd)).collect())
    assert got == want and (3, 57, 1) in got and (4, 57, 4) in got


def test_prefixes_of_linked_sets_meet():
    r = np.random.default_rng(6)
    levels = r.integers(0, 3, 1 << 10).astype(np.uint8)
    for _ in range(300):
        n = int(r.integers(1, 60))
        a = np.unique(r.integers(0, 1 << 62, n).astype(np.uint64))
        keep = a[r.random(len(a)) > r.random() * 0.25]
        b = np.unique(np.concatenate((keep, r.integers(0, 1 << 62, int(r.integers(0, 8))).astype(np.uint64))))
        if len(b) and ngramjoin.linked(a, b):
            for table in (levels, np.zeros(1 << 10, np.uint8)):
                assert set(ngramjoin.prefix(a, table).tolist()) & set(ngramjoin.prefix(b, table).tolist())


def test_suffix_family_by_text(spark, odd):
    count = collections.Counter()
    data = [(t or "").encode() for _, t in odd]
    for b in data:
        count.update(b[k : k + 200] for k in range(len(b) - 199))
    want = collections.Counter()
    for (d, _), b in zip(odd, data):
        gone = np.zeros(len(b) + 2, int)
        for k in range(len(b) - 199):
            if count[b[k : k + 200]] > 1:
                gone[k + 1 : k + 201] = 1
        kept = bytes(c for c, g in zip(b, gone[1:]) if not g)
        want[d, len(b), int(gone.sum()), int((np.diff(gone) == 1).sum()), hashlib.sha256(kept).hexdigest()] += 1
    got = collections.Counter(tuple(r) for r in suffixes.dedup(rows_of(spark, odd)).drop("kept").collect())
    assert got == want and sum(k[2] > 0 for k in got) >= 4


def test_hot_anchors_and_long_runs(spark, monkeypatch):
    r = random.Random(13)
    passage = "".join(r.choice("abcd") for _ in range(330))
    texts = ["".join(r.choice("abcd") for _ in range(r.randint(0, 90))) + passage[r.randint(0, 40) :] + "".join(r.choice("ab") for _ in range(r.randint(0, 90))) for _ in range(30)]
    texts += ["z" * 900, "y" + "z" * 500, "z" * 199, "xyz" * 150, "q" + "xyz" * 90, passage * 2]
    data = [t.encode() for t in texts]
    count = collections.Counter(b[k : k + 200] for b in data for k in range(len(b) - 199))
    for hot in (1, 5, 1000):  # contexts of equal windows land in one sub-shard however hot their anchors are
        shards = collections.defaultdict(set)
        for n, b in enumerate(data):
            if len(b) < 200:
                continue
            live = np.unique(suffixes.anchor_values(np.frombuffer(b, np.uint8)))
            seen = np.zeros(len(b) - 199, int)
            for lo, a, sub, c in suffixes.contexts(b, live, live if hot < 1000 else live[:0]):
                seen[lo : lo + len(c) - 199] += 1
                for k in range(len(c) - 199):
                    shards[c[k : k + 200]].add((a, sub))
            assert (seen == 1).all()
        assert all(len(s) == 1 for s in shards.values())
    monkeypatch.setattr(suffixes, "HOT", 3)
    got = {x["doc_id"]: x["n_removed"] for x in suffixes.dedup(rows_of(spark, list(enumerate(texts)))).collect()}
    for n, b in enumerate(data):
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 199):
            gone[k : k + 200] |= count[b[k : k + 200]] > 1
        assert got[n] == gone.sum()


def test_ten_megabytes_of_one_letter():
    import tracemalloc

    data = b"a" * 10_000_000
    live = np.unique(suffixes.anchor_values(np.frombuffer(data, np.uint8)))
    tracemalloc.start()
    family, sizes = suffixes.Family(), collections.Counter(c for *_, c in suffixes.contexts(data, live, live))
    for c, n in sizes.items():
        first = family.add([c], [n])
        assert family.repeated[first[0] : first[0] + len(c) - 199].all()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 500e6


def test_family_of_many_batches_is_exact():
    r = random.Random(14)
    texts = ["".join(r.choice("ab") for _ in range(r.randint(200, 420))).encode() for _ in range(60)]
    texts += [t[r.randint(0, 30) :] + b"b" * 40 for t in texts[:30] if len(t) > 240]
    texts = [t for t in texts if len(t) >= 200]
    old, suffixes.CHUNK = suffixes.CHUNK, 64
    try:
        family = suffixes.Family()
        firsts = [family.add([t], [1])[0] for t in texts]
    finally:
        suffixes.CHUNK = old
    count = collections.Counter(t[k : k + 200] for t in texts for k in range(len(t) - 199))
    for t, at in zip(texts, firsts):
        assert family.repeated[at : at + len(t) - 199].tolist() == [count[t[k : k + 200]] > 1 for k in range(len(t) - 199)]
    assert len(family.levels) <= 8


def test_fingerprints_keep_every_row(spark, odd):
    got = merkle.fingerprints(rows_of(spark, odd)).collect()
    assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(d for d, _ in odd)
    texts = collections.Counter((d, t or "") for d, t in odd)
    by_print = {merkle.fingerprint(t): t for _, t in texts}
    assert collections.Counter((r["doc_id"], by_print[r["fingerprint"]]) for r in got) == texts
    # every row's next is another row, and each row is next once: by the edited texts' endings
    nexts = collections.Counter()
    for r in got:
        t = by_print[r["fingerprint"]]
        cut = len(t) // 4
        fits = {u for _, u in texts if hashlib.sha256((t[: len(t) - cut] + u[:cut]).encode()).hexdigest() == r["edited_sha256"]}
        assert fits
        if cut >= 20 and len(fits) == 1:
            nexts[fits.pop()] += 1
    assert all(n <= sum(c for (_, u), c in texts.items() if u == t) for t, n in nexts.items())
    everywhere = merkle.fingerprints(rows_of(spark, [(None, "one"), (None, "two"), (None, "one")])).collect()
    assert len(everywhere) == 3


def test_likeness_by_descent_is_that_of_all_leaves():
    r = random.Random(15)
    lines = [words(r, r.randint(0, 30), 60) for _ in range(40)]
    leaves = lambda fp: collections.Counter(x for _, _, ps in merkle.parse(fp) for _, _, z in ps for x in merkle._leaves(z))
    for _ in range(60):
        a = "\n".join(r.choice(lines) for _ in range(r.randint(1, 25)))
        b = a if r.random() < 0.1 else "\n".join(x for x in a.split("\n") + r.sample(lines, 3) if r.random() > 0.3)
        x, y = merkle.Node(a), merkle.Node(b)
        assert x.sections == merkle.parse(x.text) and merkle.likeness(x, y) == merkle.similarity(x.text, y.text)
        la, lb = leaves(x.text), leaves(y.text)
        weigh = lambda c: sum(merkle._WEIGHT[k[6]] * n for k, n in c.items())
        assert abs(merkle.likeness(x, y) - weigh(la & lb) / max(weigh(la), weigh(lb))) < 1e-12
        assert merkle.Node(b, x).text == y.text
        assert bool(merkle.edits(x.text, y.text)) == bool(la - lb)


def test_embeddings_that_share_ids(spark):
    a, b = [1.0, 0.1, 0.0], [0.0, 1.0, 0.2]
    rows = [(1, a), (1, b), (2, [1.0, 0.11, 0.0]), (3, [0.0, 1.0, 0.21]), (None, a), (None, [5.0, 0.0, -9.0]), (4, None), (None, None)]
    got = collections.Counter(tuple(r) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())
    assert got == collections.Counter([(1, 2, 1, True), (1, 1, 1, True), (2, 2, 1, False), (3, 1, 1, False), (None, 2, 1, False), (None, 0, None, True), (4, 0, 4, True), (None, 0, None, True)])


def test_bands_reach_their_recall():
    r = np.random.default_rng(16)
    for rows in (5_000, 1_000_000):
        width, bands = embeddings.plan(rows)
        a = r.standard_normal((3000, 64))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        side = r.standard_normal((3000, 64))
        side -= (side * a).sum(1, keepdims=True) * a
        side /= np.linalg.norm(side, axis=1, keepdims=True)
        b = 0.95 * a + (1 - 0.95**2) ** 0.5 * side
        axes = embeddings.frame(64)
        sa, sb = embeddings.encode(a, axes)[1], embeddings.encode(b, axes)[1]
        met = (embeddings.band_keys(sa, width, bands) == embeddings.band_keys(sb, width, bands)).any(1)
        assert met.mean() > 0.985 and ((sa != sb).sum(1) <= embeddings.most_differing()).all()


def added_spans(t):
    out = [(m.start(), 4, m.end()) for m in re.finditer(pii.PATTERNS["url"], t)]
    for m in re.finditer(pii.PATTERNS["iban"], t):
        s = m.group()
        if re.fullmatch("[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", s) and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1:
            out.append((m.start(), 5, m.end()))
    return out + [(m.start(1), 6, m.end(1)) for m in re.finditer(pii.PATTERNS["secret"], t)]


def test_added_spans_match_patterns():
    r, n = random.Random(17), 0
    parts = ["1", ".", "@", "a.b", " ", "token", "=", ":", "://", "ab", "/", '"', "secret_key_0123456789", "GB82WEST12345698765432", "DE89370400440532013000", "é", "x@y.z", "API_KEY", "0123456789abcdef"]
    for _ in range(6000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        want = sorted(base_spans(t) + added_spans(t))
        n += any(k > 3 for _, k, _ in want)
        assert pii.spans(t) == want
    assert n > 500


@pytest.mark.parametrize("unit", ["token=", "://", "a://", "1.1.1.", "@", "a@", "+1 ", "x@y.", "0123456789 ", "GB82", "a://b@", "secret: "])
def test_pii_is_linear(unit):
    start = time.process_time()
    pii.spans(unit * (1_000_000 // len(unit)))
    assert time.process_time() - start < 5


def test_licenses_of_many_notices_are_linear():
    s = licenses.Scanner()
    took = []
    for n in (4000, 8000):
        start = time.process_time()
        assert len(s.scan("All rights reserved. " * n)) == n
        took.append(time.process_time() - start)
    assert took[1] < 3 * took[0] + 0.2 and took[1] < 4
