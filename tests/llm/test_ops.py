"""The training-data operators against brute force on small fixtures, with the edge cases of each."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest

from weft.llm import embeddings, langid, licenses, merkle, mixing, ngramjoin, pieces, pii, suffixes, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, key string, sha string, copies long"


def docs_of(spark, texts, lang=None, source=None):
    rows = [(i, t, lang[i] if lang else None, source[i] if source else None, len(t or ""), 1, "x", "y", 2) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def words(r, n, vocabulary=400):
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(5)
    base = [words(r, r.randint(3, 90)) for _ in range(25)]
    texts = [None, "", " \n\t", "one", "ONE", "two words", "a b c d e", "A b x c d e"] + base + base[:6]
    for b in base[:12]:
        w = b.split()
        for _ in range(2):
            w[r.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    texts.append(words(r, 6000))
    passage = words(r, 80)
    texts += [words(r, 30) + " " + passage + " " + words(r, 30) for _ in range(5)] + ["ab" * 300, "é" * 150]
    return texts


def jaccard_components(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    comp = list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = comp[i], comp[j]
                comp = [min(a, b) if c in (a, b) else c for c in comp]
    return [(i, len(sets[i]), comp[i]) for i in range(len(texts))]


def test_ngram_join(spark, corpus):
    got = sorted(tuple(r) for r in ngramjoin.join(docs_of(spark, corpus)).collect())
    assert got == jaccard_components(corpus)
    assert ngramjoin.join(docs_of(spark, [])).count() == 0


def test_signature_trees_lose_no_pair():
    r = np.random.default_rng(3)
    base = [np.unique(r.integers(0, 1 << 62, r.integers(1, 400)).astype(np.uint64)) for _ in range(20)]
    sets = []
    for b in base:
        for _ in range(8):
            keep = b[r.random(len(b)) > 0.08]
            sets.append(np.unique(np.concatenate((keep, r.integers(0, 1 << 62, max(1, len(b) // 20)).astype(np.uint64)))))
    sizes = np.array([len(s) for s in sets])
    found = {frozenset((int(x), int(y))) for i, j in ngramjoin.candidates(sizes, [ngramjoin.signature(s) for s in sets]) for x, y in zip(i, j)}
    want = {frozenset((i, j)) for i in range(len(sets)) for j in range(i) if ngramjoin.linked(sets[i], sets[j])}
    assert want and want <= found and len(found) < len(sets) * (len(sets) - 1) / 2
    side = np.arange(len(sets)) % 2
    cross = {frozenset((int(x), int(y))) for i, j in ngramjoin.candidates(sizes, [ngramjoin.signature(s) for s in sets], side) for x, y in zip(i, j)}
    assert {p for p in want if len({side[k] for k in p}) == 2} <= cross


def removed(texts):
    count = collections.Counter()
    data = [(t or "").encode() for t in texts]
    for b in data:
        count.update(b[k : k + 200] for k in range(len(b) - 199))
    out = []
    for i, b in enumerate(data):
        gone = np.zeros(len(b) + 2, int)
        for k in range(len(b) - 199):
            if count[b[k : k + 200]] > 1:
                gone[k + 1 : k + 201] = 1
        kept = bytes(c for c, g in zip(b, gone[1:]) if not g)
        out.append((i, len(b), int(gone.sum()), int((np.diff(gone) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_family(spark, corpus):
    got = sorted(tuple(r) for r in suffixes.dedup(docs_of(spark, corpus)).drop("kept").collect())
    assert got == removed(corpus)
    assert suffixes.dedup(docs_of(spark, [])).count() == 0


def test_family_merges_levels():
    r = random.Random(1)
    texts = ["".join(r.choice("ab") for _ in range(r.randint(200, 260))).encode() for _ in range(40)]
    texts += [texts[3][5:], texts[7] + b"x"]
    texts = [t for t in texts if len(t) >= 200]
    family = suffixes.Family()
    firsts = np.concatenate([family.add(texts[k : k + 3], [1] * len(texts[k : k + 3])) for k in range(0, len(texts), 3)])
    flags = [f for t, at in zip(texts, firsts.tolist()) for f in family.repeated[at : at + len(t) - 199].tolist()]
    count = collections.Counter(t[k : k + 200] for t in texts for k in range(len(t) - 199))
    want = [count[t[k : k + 200]] > 1 for t in texts for k in range(len(t) - 199)]
    assert flags == want and len(family.levels) <= 6


def base_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        if 12 <= len(d) <= 19 and pii.luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out)


def test_pii_matches_patterns(spark):
    r = random.Random(2)
    texts = ["".join(r.choice("0123456789.+@ -()aZ%é") for _ in range(r.randint(0, 70))) for _ in range(4000)]
    texts += ["".join(r.choice(["1", "25", "300", ".", "..", "+1", "@", "a.b", "4111 1111-1111 1111", " ", "-"]) for _ in range(r.randint(0, 20))) for _ in range(4000)]
    for t in texts:
        assert [s for s in pii.spans(t) if s[1] < 4] == base_spans(t)
    rows = pii.detect(docs_of(spark, [None, "", "é a.b@c.de x", "1.2.3.4 1.2.3.4"])).orderBy("doc_id").collect()
    assert [r["n_email"] for r in rows] == [0, 0, 1, 0] and [r["n_ip"] for r in rows] == [0, 0, 0, 2]
    assert rows[2]["spans"] == "email:2:10" and rows[2]["base_sha256"] == hashlib.sha256(b"email:2:10").hexdigest()
    clean = pii.redacted(docs_of(spark, [None, "mail a@b.cd now"])).orderBy("doc_id").collect()
    assert clean[0]["text"] is None and clean[1]["text"] == "mail <email> now" and clean[1]["n_chars"] == 16


def test_language_mixture(spark):
    r = random.Random(4)
    make = {"xx": "aeb ced dae", "yy": "qur zoq ruz"}
    sample = lambda lang, n: " ".join(r.choice(make[lang].split()) for _ in range(n))
    texts = [sample("xx" if i % 2 else "yy", 40) for i in range(40)]
    langs = ["xx" if i % 2 else "yy" for i in range(40)]
    model = langid.train(docs_of(spark, texts, langs))
    mixed = sample("xx", 70) + " " + sample("yy", 30)
    odd = [None, "", "123 !?", sample("xx", 30), sample("yy", 3000), mixed]
    got = langid.predict(docs_of(spark, odd), model).orderBy("doc_id").collect()
    assert [g["lang_pred"] for g in got] == ["und", "und", "und", "xx", "yy", "xx"]
    assert got[0]["score"] == 0 and abs(got[5]["score"] - 0.7) < 0.12 and "yy" in got[5]["mixture"] and "," not in got[3]["mixture"]
    none = langid.predict(docs_of(spark, ["abc"]), langid.train(docs_of(spark, [])))
    assert none.first()["lang_pred"] == "und" and langid.predict(docs_of(spark, []), model).count() == 0


def test_mix_follows_targets(spark):
    r = random.Random(6)
    source = [["a", "b", None, "c"][min(3, int(r.random() * 6))] for _ in range(900)]
    texts = [None if r.random() < 0.02 else words(r, r.randint(0, 60)) for _ in source]
    rows = mixing.mix(docs_of(spark, texts, source=source)).collect()
    sizes = collections.Counter()
    for t, s in zip(texts, source):
        sizes[s] += len((t or "").split())
    weight = dict(zip(["a", "b", "c", None], [5, 2, 1, 5]))
    target, free, rest = {}, dict(weight), 1.5 * sum(sizes.values())
    while free:
        level = rest / sum(free.values())
        over = [s for s in free if level * free[s] > 2 * sizes[s]]
        for s in over or list(free):
            target[s] = 2 * sizes[s] if over else level * free[s]
            rest -= target[s]
            del free[s]
    taken = collections.Counter()
    for x in rows:
        assert math.isclose(x["target"], target[x["source"]]) and x["source_size"] == sizes[x["source"]]
        assert x["size"] == len((texts[x["doc_id"]] or "").split()) and 0 <= x["copies"] <= 2
        taken[x["source"]] += x["copies"] * x["size"]
    assert len(rows) == 900 and all(abs(taken[s] - target[s]) <= max(0.03 * target[s], 61) for s in target)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(docs_of(spark, texts, source=source).repartition(7)).collect())) if None not in source else True
    assert mixing.mix(docs_of(spark, [])).count() == 0


def test_merkle(spark, corpus):
    got = {r["doc_id"]: r for r in merkle.fingerprints(docs_of(spark, corpus)).collect()}
    assert len(got) == len(corpus)
    texts = [t or "" for t in corpus]
    for i, t in enumerate(texts):
        nxt = texts[(i + 1) % len(texts)]
        cut = len(t) // 4
        e = t[: len(t) - cut] + nxt[:cut]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        assert got[i]["fingerprint"] == merkle.fingerprint(t) and got[i]["edited_fingerprint"] == merkle.fingerprint(e)
        assert math.isclose(got[i]["near_next"], merkle.similarity(merkle.fingerprint(t), merkle.fingerprint(nxt)))
    assert len({merkle.fingerprint(t) for t in texts}) == len(set(texts))
    a, b = "one two.\nthree four! five\n\nsix", "one two.\nthree four! changed\n\nsix"
    assert merkle.edits(merkle.fingerprint(a), merkle.fingerprint(b)) and not merkle.edits(merkle.fingerprint(a), merkle.fingerprint(a))
    assert merkle.fingerprints(docs_of(spark, [])).count() == 0
    assert merkle.fingerprints(docs_of(spark, ["abcd"])).first()["near_next"] == 1.0


def test_segments_are_maximal():
    r = random.Random(7)

    def brute(s):
        if not s:
            return []
        best = max(((sum(s[i:j]), -(j - i), i, j) for i in range(len(s)) for j in range(i + 1, len(s) + 1)))
        if best[0] <= 0:
            return []
        _, _, i, j = best
        return brute(s[:i]) + [(i, j)] + [(a + j, b + j) for a, b in brute(s[j:])]

    for _ in range(200):
        s = [r.choice([-3, -2, -1, 1, 2, 3.5]) + r.random() / 100 for _ in range(r.randint(0, 12))]
        assert [(a, b) for a, b, _ in toxicity.segments(s)] == brute(s)


def test_toxicity_learns(spark):
    r = random.Random(8)
    texts, rows = [], []
    for i in range(300):
        bad = i % 5 == 0
        t = words(r, 40)
        texts.append(t.replace(" ", " nasty ", 3) if bad else t)
        rows.append((i, int(bad)))
    texts += [None, "", "nasty nasty " + words(r, 10)]
    labels = spark.createDataFrame(rows, "doc_id long, toxic int")
    got = {x["doc_id"]: x["score"] for x in toxicity.score(docs_of(spark, texts), labels).collect()}
    assert min(got[i] for i, y in rows if y) > 0.5 > 0.3 > max(got[i] for i, y in rows if not y)
    assert got[302] > 0.5 and got[300] == got[301] < 0.3
    flat = toxicity.score(docs_of(spark, ["a", None]), spark.createDataFrame([], "doc_id long, toxic int"))
    assert len({x["score"] for x in flat.collect()}) == 1


def test_licenses(spark):
    s = licenses.Scanner()
    full = licenses.TEMPLATES["mit-full"]
    broken = full.replace("free of charge", "at no cost").replace("publish, ", "")
    names = lambda t: [x[0] for x in s.scan(t)]
    assert names("x " + full + " y") == ["mit-full"] and names(broken) == ["mit-full"]
    assert names("Released under the MIT License.\nfoo\nReleased under the MIT License.") == ["mit", "mit"]
    assert names("") == [] and names("the license of this software") == []
    assert names("foo\nAll rights reserved.\nLicensed under CC BY-NC 4.0.") == ["all-rights-reserved", "cc-by-nc-4.0"]
    got = licenses.scan(docs_of(spark, [None, "", "All rights reserved."])).orderBy("doc_id").collect()
    assert [g["n_licenses"] for g in got] == [0, 0, 1] and got[2]["spans"] == "all-rights-reserved:0:19"
    r = random.Random(9)
    for _ in range(100):
        a, b = [[r.choice("abcdef") for _ in range(r.randint(0, 12))] for _ in "ab"]
        m = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in m) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(m, m[1:]))


def test_embeddings(spark):
    r = np.random.default_rng(10)
    base = r.standard_normal((150, 24))
    vectors = [list(map(float, v)) for v in base] + [list(map(float, v + r.standard_normal(24) * 0.12)) for v in base for _ in range(3)]
    vectors += [vectors[0], vectors[0], None, [0.0] * 24, [float("nan")] + [1.0] * 23, [1.0, None], [1.0, 2.0], [2.0, 4.0], []]
    rows = [(i, v, 1) for i, v in enumerate(vectors)]
    got = {x["vec_id"]: x for x in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    good = [i for i, v in enumerate(vectors) if v and None not in v and all(map(math.isfinite, v)) and any(v)]
    near, comp = collections.Counter(), {i: i for i in range(len(vectors))}
    for i in good:
        for j in good:
            if i < j and len(vectors[i]) == len(vectors[j]):
                a, b = np.float32(vectors[i]).astype(float), np.float32(vectors[j]).astype(float)
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.95:
                    near[i] += 1
                    near[j] += 1
                    x, y = comp[i], comp[j]
                    comp = {k: min(x, y) if c in (x, y) else c for k, c in comp.items()}
    found, true = sum(x["n_links"] for x in got.values()), sum(near.values())
    assert all(got[i]["n_links"] <= near[i] for i in got) and found >= 0.98 * true > 100
    assert sum(got[i]["component_id"] == comp[i] for i in got) >= 0.98 * len(vectors)
    for i in set(got) - set(good):
        assert got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"]
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_estimates_are_unbiased_and_bounded():
    r = np.random.default_rng(11)
    axes = embeddings.frame(48)
    a = r.standard_normal((300, 48))
    unit, signs, factor, turned = embeddings.encode(a, axes)
    est, bound = embeddings.estimate(signs, factor, turned)
    gap = est - unit @ unit.T
    assert abs(gap.mean()) < 0.005 and (np.abs(gap) <= bound[:, None]).mean() > 0.99


def test_pieces_round_trip_and_sample(spark):
    c = pieces.codec(pieces.load(), 1.0)
    odd = ["", " ", "a▁b 漢\U0001d54f\x00", "\n\n  x", "▁", "  ", "x" * 500, "Hello world, again and again", "é́​"]
    for t in odd:
        counts, ids = c.encode([t], [7])
        assert c.decode(ids) == t and counts[0] == len(ids)
    docs = docs_of(spark, [None, *odd, "word " * 5000])
    rows = pieces.encode(docs).orderBy("doc_id").collect()
    assert all(r["lossless"] for r in rows) and rows[0]["ids"] is None and rows[1]["ids"] == []
    again = pieces.encode(docs.repartition(5)).orderBy("doc_id").collect()
    assert [r["ids_sha256"] for r in rows] == [r["ids_sha256"] for r in again]
    back = pieces.decode(pieces.encode(docs)).orderBy("doc_id").collect()
    assert [r["text"] for r in back] == [None, *odd, "word " * 5000]
    # draws follow the weights of the segmentations
    unit, n = "the", 40000
    counts, ids = c.encode([unit] * n, range(n))
    seen, at = collections.Counter(), 0
    for k in counts:
        seen[tuple(ids[at : at + k].tolist())] += 1
        at += k
    weights = {s: math.exp(sum(c.weight[i] if i not in set(c.byte_ids.tolist()) else c.floor for i in s)) for s in seen}
    total = sum(weights.values())
    for s, k in seen.items():
        assert abs(k / n - weights[s] / total) < 0.02
