"""Document fingerprints: a Merkle tree over sections, paragraphs and phrases.

A text splits into paragraphs (lines); a section ends at a blank line or at a paragraph whose hash
says so (content-defined, so an edit moves no later boundary); a paragraph splits into phrases of about
six words, again at content-defined places. A leaf is the 128-bit hash of a phrase's exact characters, so every
character is covered; paragraphs and sections hash their children's full digests (128 bits); the root is a SHA-256
over the sections' digests.

A fingerprint is ``root;sections``: sections joined by ``/``, each ``hash=paragraphs``; paragraphs joined by ``.``,
each ``hash:leaves``; inner hashes are shown by 12 characters (72 bits), leaves by 7 (36 bits of their hash, and their
weight). Two strings suffice to test equality (by roots, which come from full digests), and to descend: sections with
one hash are equal and need no look inside, then paragraphs of the others, then phrases. The descent locates edits
(``edits``) and measures likeness: the weight of what both hold over the larger total weight. A fingerprint holds
about 8 characters per six words and is never truncated.

Edge cases: null counts as the empty text, which has one empty leaf; equal texts have equal
fingerprints; a table of one document has itself as next; rows without a doc_id come before all others; rows sharing
a doc_id (or having none) follow one another in the order of a hash of their text; an empty table gives no rows;
very long texts are hashed whole; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from base64 import urlsafe_b64encode
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from weft.llm.common import sliced, table, text_key

ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz-_"

_PAIRS = [a + b for a in ALPHABET for b in ALPHABET]
_STOP = "tx.;:!?"
_PHRASE = re.compile(f"[^{_STOP}]*(?:[{_STOP}](?! )[^{_STOP}]*)*(?:[{_STOP}] )?")


def phrases(line: str) -> list[str]:
    """A phrase ends at a blank after one of a few characters (about every sixth word); longer stretches without one
    are cut every 256 characters. An empty line is one empty phrase."""
    out = []
    for p in _PHRASE.findall(line):
        if len(p) <= 256:
            if p:
                out.append(p)
        else:
            out += [p[i : i + 256] for i in range(0, len(p), 256)]
    return out or [""]


def _inner(children: bytes) -> bytes:
    return hashlib.blake2b(children, digest_size=16).digest()


def _shown(digest: bytes) -> str:
    return urlsafe_b64encode(digest[:9]).decode()


def paragraph(line: str) -> tuple[bytes, str, int, str]:
    """(digest, shown hash, weight, leaves) of a line."""
    codes, digests, weight = [], [], 0
    for p in phrases(line):
        d, n = xxh3_128_digest(p.encode()), len(p)
        h = int.from_bytes(d[:5])
        n = n if n < 63 else 63
        codes.append(_PAIRS[h & 4095] + _PAIRS[h >> 12 & 4095] + _PAIRS[h >> 24 & 4095] + ALPHABET[n])
        digests.append(d)
        weight += n or 1
    digest = _inner(b"".join(digests))
    return digest, _shown(digest), weight, "".join(codes)


class Node:
    """A text's tree. ``sections``: (shown hash, weight, paragraphs), paragraphs (shown hash, weight, leaves);
    ``lines``: the paragraphs by their text, so that a text sharing lines need not hash them again."""

    __slots__ = ("root", "sections", "weight", "text", "lines")

    def __init__(self, text: str, *known: "Node"):
        self.lines = {}
        top, lines = hashlib.sha256(), text.split("\n")
        self.sections, held = [], []

        def close():
            digest = _inner(b"".join(p[0] for p in held))
            top.update(digest)
            self.sections.append((_shown(digest), sum(p[2] for p in held), [p[1:] for p in held]))
            held.clear()

        last = len(lines) - 1
        for k, line in enumerate(lines):
            line = line if k == last else line + "\n"
            p = self.lines.get(line) or next((n.lines[line] for n in known if line in n.lines), None) or paragraph(line)
            self.lines[line] = p
            held.append(p)
            if k < last and (line.isspace() or p[0][-1] % 4 == 0):
                close()
        if held:
            close()
        self.sections = [(h, w, [(x, y, z) for x, y, z in ps]) for h, w, ps in self.sections]
        self.weight = sum(s[1] for s in self.sections)
        self.root = top.hexdigest()
        self.text = self.root + ";" + "/".join(f"{h}=" + ".".join(f"{x}:{z}" for x, _, z in ps) for h, _, ps in self.sections)


def fingerprint(text: str | None) -> str:
    return Node(text or "").text


_WEIGHT = {c: max(k, 1) for k, c in enumerate(ALPHABET)}


def _leaves(codes: str) -> list[str]:
    return [codes[i : i + 7] for i in range(0, len(codes), 7)]


def parse(fp: str) -> list[tuple[str, int, list[tuple[str, int, str]]]]:
    """The sections of a fingerprint, as a Node holds them."""
    out = []
    for section in fp.partition(";")[2].split("/"):
        name, _, rest = section.partition("=")
        ps = [(h, sum(_WEIGHT[x[6]] for x in _leaves(z)), z) for h, _, z in (p.partition(":") for p in rest.split("."))]
        out.append((name, sum(p[1] for p in ps), ps))
    return out


def _split(xs, ys):
    """Two lists of (hash, weight, ...): the weight that both hold, and what of either the other lacks."""
    have, used, shared, left = Counter(y[0] for y in ys), Counter(), 0, []
    for x in xs:
        if have[x[0]] > used[x[0]]:
            used[x[0]] += 1
            shared += x[1]
        else:
            left.append(x)
    right = []
    for y in ys:
        if used[y[0]] > 0:
            used[y[0]] -= 1
        else:
            right.append(y)
    return shared, left, right


def _likeness(a, b, weight: int) -> float:
    """By descent into what differs: sections, then paragraphs, then phrases."""
    both, a, b = _split(a, b)
    if a and b:
        more, a, b = _split([p for s in a for p in s[2]], [p for s in b for p in s[2]])
        both += more
        have = Counter(x for p in b for x in _leaves(p[2])) if a and b else {}
        if have:
            for x, n in Counter(x for p in a for x in _leaves(p[2])).items():
                if m := have.get(x):
                    both += _WEIGHT[x[6]] * min(n, m)
    return both / weight


def likeness(a: Node, b: Node) -> float:
    """1 for equal roots, else what both hold over the larger weight."""
    return 1.0 if a.root == b.root else _likeness(a.sections, b.sections, max(a.weight, b.weight))


def similarity(fp_a: str, fp_b: str) -> float:
    """``likeness`` from two fingerprints alone."""
    if fp_a[:64] == fp_b[:64]:
        return 1.0
    a, b = parse(fp_a), parse(fp_b)
    return _likeness(a, b, max(sum(s[1] for s in a), sum(s[1] for s in b)))


def edits(fp_a: str, fp_b: str) -> list[tuple[int, int, int]]:
    """Where a differs from b: (section, paragraph, phrase) of a's leaves without a counterpart in b,
    found by descending only into sections and paragraphs whose hashes b lacks."""
    if fp_a[:64] == fp_b[:64]:
        return []
    a = [(h, w, [(x, y, z, i, j) for j, (x, y, z) in enumerate(ps)]) for i, (h, w, ps) in enumerate(parse(fp_a))]
    _, a, b = _split(a, parse(fp_b))
    _, a, b = _split([p for s in a for p in s[2]], [p for s in b for p in s[2]])
    have, out = Counter(x for p in b for x in _leaves(p[2])), []
    for _, _, codes, i, j in a:
        for k, x in enumerate(_leaves(codes)):
            if have[x] > 0:
                have[x] -= 1
            else:
                out.append((i, j, k))
    return out


def edited(text: str, other: str) -> str:
    """The last floor(n/4) characters replaced by the first as many (or all) of ``other``."""
    cut = len(text) // 4
    return text[: len(text) - cut] + other[:cut]


def in_order(docs: DataFrame, work, schema: str) -> DataFrame:
    """Run ``work(iterator of (spare, doc_id, text) rows)`` over documents in order, range by range. Each range ends
    with a spare row, the first document of the next range (of the first one, after the last), so one shuffle of the
    texts suffices and a task sees its range alone.

    Ids are cut into ranges by approximate quantiles, as fine as there are ranges; range numbers are partition
    numbers. What reaches the driver is a cut and a first row (without text) per range."""
    spark = docs.sparkSession
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keyed = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tk", text_key(F.col("text"))).withColumn("named", F.col("doc_id").isNotNull())
    cuts = keyed.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], max(10000, 100 * parts))).first()[0] or []
    cuts = sorted(set(cuts))
    arr, n = F.array(*[F.lit(c) for c in cuts]), len(cuts)
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(max(1, n.bit_length())))])
    # cuts below the id, by binary search; rows without an id stand in the first range
    number = F.aggregate(steps, F.lit(0), lambda s, k: F.when(F.when(s + k <= n, F.try_element_at(arr, s + k)) < F.col("doc_id"), s + k).otherwise(s)) if cuts else F.lit(0)
    keyed = keyed.withColumn("part", number)
    order = ["named", "doc_id", "tk"]
    firsts = keyed.select("part", *order).groupBy("part").agg(F.min(F.struct(*order)).alias("first")).orderBy("part").collect()  # one row per range
    if not firsts:
        return spark.createDataFrame([], schema)
    heads = [(*firsts[(k + 1) % len(firsts)]["first"], r["part"]) for k, r in enumerate(firsts)]
    heads = spark.createDataFrame(heads, "h_named boolean, h_id long, h_tk long, to int")
    is_head = (F.col("named") == F.col("h_named")) & F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("tk") == F.col("h_tk"))
    stay = F.struct("part", F.lit(0).alias("spare"))
    to = F.when(F.col("to").isNull(), F.array(stay)).otherwise(F.array(stay, F.struct(F.col("to").alias("part"), F.lit(1).alias("spare"))))
    routed = keyed.join(F.broadcast(heads), is_head, "left").withColumn("at", F.explode(to)).select("at.part", "at.spare", *order, "text")  # heads: one row a range
    dealt = routed.repartitionById(len(cuts) + 1, F.col("part").cast("int")).sortWithinPartitions("spare", *order).select("spare", "doc_id", "text")

    def run(batches):
        import pyarrow as pa

        def rows():
            for b in sliced(batches):
                yield from zip(*(b.column(c).to_pylist() for c in ("spare", "doc_id", "text")))

        for chunk in work(rows()):
            yield pa.RecordBatch.from_pydict(chunk)

    return dealt.mapInArrow(run, schema)


FP_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: its fingerprint, its edited text's, and the likenesses."""

    names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")

    def work(rows):
        out: dict[str, list] = {k: [] for k in names}
        size, held, over = 0, None, False  # held: (doc_id, text, node) waiting for its successor
        for spare, doc_id, text in rows:
            if over:
                continue
            node = held[2] if held and text == held[1] else Node(text)
            if held:
                e = edited(held[1], text)
                other = held[2] if e == held[1] else Node(e, held[2], node)
                row = (held[0], len(held[1]), hashlib.sha256(e.encode()).hexdigest(), held[2].text, other.text, likeness(held[2], other), likeness(held[2], node))
                for k, v in zip(names, row):
                    out[k].append(v)
                size += len(row[3]) + len(row[4])
                if size > 1 << 22:
                    yield out
                    out, size = {k: [] for k in names}, 0
            # a spare ends the range; further ones are copies of it
            held, over = (None, True) if spare else ((doc_id, text, node), False)
        if out["doc_id"]:
            yield out

    return in_order(docs, work, FP_SCHEMA)


def op6_merkle(spark, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def merkle_edits(spark, sf_dir: str) -> DataFrame:
    """What of op6_merkle SQL can express: the lengths and the edited texts."""
    return op6_merkle(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


EDITS_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, coalesce(lead(coalesce(text, '')) OVER w, first_value(coalesce(text, '')) OVER w) AS other
 FROM documents WINDOW w AS (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT doc_id, n AS n_chars, sha256(substr(t, 1, n - n // 4) || substr(other, 1, n // 4)) AS edited_sha256 FROM d
"""
