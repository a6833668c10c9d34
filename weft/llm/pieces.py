"""SentencePiece encoding and decoding by lattice sampling.

The lattice over a text holds every vocabulary piece at every place (plus, per character, its UTF-8
byte pieces). Forward filtering sums path weights up to each position, backward sampling draws a
segmentation in proportion to its weight; the draws are seeded by the row key and the place in the text,
so every run gives the same pieces. Places that no
vocabulary piece can cross (no piece holds the two characters side by side) cut the lattice into
independent units; the forward pass runs once per distinct unit of a slice of texts, all units abreast,
and the backward pass over all units abreast.

A piece's log weight is ``-temperature * log(2 + merge rank)``; low temperatures sample more freely.
Byte pieces weigh the least. Decoding is lossless: a literal blank mark (U+2581) and anything outside the
vocabulary travel as bytes.

Edge cases: null text gives null ids (decoded null); empty text gives no ids; very long texts are encoded
whole; a null key seeds like 0; repeated rows with one key get the same pieces; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import arrow_map, mix64, table

BLANK = "\u2581"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
TEMPERATURE = 1.0
SEED = 20240607
SLICE_CHARS = 500_000  # characters whose lattice is in memory at a time (a longer text is one slice)
DENSE = 128
MODEL_BYTES = 16 << 20


def _order(values: np.ndarray) -> np.ndarray:
    """A stable argsort of small non-negative integers, as one sort of (value, place) packed in 64 bits."""
    packed = values.astype(np.int64)
    packed <<= 32
    packed |= np.arange(len(values))
    packed.sort()
    return packed.astype(np.uint32)


class Codec:
    """The vocabulary as a trie over character classes, and the two passes, vectorised over a slice."""

    def __init__(self, model: bytes, temperature: float = TEMPERATURE):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        forms: list[bytes] = [b""] * n
        self.byte_ids = np.zeros(256, np.int64)
        pieces: dict[str, int] = {}
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                forms[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                forms[i] = piece.replace(BLANK, " ").encode()
                pieces[piece] = i
        self.form_size = np.array([len(f) for f in forms], np.int64)
        self.form_start = np.cumsum(self.form_size) - self.form_size
        self.form_bytes = np.frombuffer(b"".join(forms), np.uint8)
        self.weight = np.concatenate((-temperature * np.log(2.0 + np.arange(n)), np.zeros(0x110001)))
        self.floor = -temperature * math.log(2 + n) - 5.0
        self.longest = max(map(len, pieces))
        # classes: 0 is any character in no piece; the blank mark's class stands for the space
        often: dict[str, int] = {}
        for piece in pieces:
            for c in piece:
                often[c] = often.get(c, 0) + 1
        ranked = sorted(often, key=lambda c: (-often[c], c))
        self.classes = len(ranked) + 1
        self.cls = np.zeros(0x110000, np.int32)
        for k, c in enumerate(ranked, 1):
            self.cls[ord(" " if c == BLANK else c)] = k
        kind = {c: k for k, c in enumerate(ranked, 1)}
        # trie: state 0 is the root; dense rows for the commonest classes, sorted keys for the rest
        step: dict[tuple[int, int], int] = {}
        ends, pairs = [-1], set()
        for piece, i in pieces.items():
            at = 0
            for k in (ks := [kind[c] for c in piece]):
                nxt = step.get((at, k))
                if nxt is None:
                    nxt = step[at, k] = len(ends)
                    ends.append(-1)
                at = nxt
            ends[at] = i
            pairs.update(zip(ks, ks[1:]))
        self.piece = np.array(ends, np.int32)
        self.dense = np.zeros((len(ends), DENSE), np.int32)
        rare = []
        for (at, k), nxt in step.items():
            if k < DENSE:
                self.dense[at, k] = nxt
            else:
                rare.append((at * self.classes + k, nxt))
        rare.sort()
        self.rare_keys = np.array([r[0] for r in rare] or [-1], np.int64)
        self.rare_next = np.array([r[1] for r in rare] or [0], np.int64)
        self.inside = np.zeros((DENSE, DENSE), bool)
        for a, b in pairs:
            if a < DENSE and b < DENSE:
                self.inside[a, b] = True
        self.rare_pairs = np.array(sorted(a * self.classes + b for a, b in pairs if a >= DENSE or b >= DENSE) or [-1], np.int64)

    @staticmethod
    def _member(keys: np.ndarray, x: np.ndarray):
        at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
        return keys[at] == x, at

    def _follow(self, state: np.ndarray, k: np.ndarray) -> np.ndarray:
        common = k < DENSE
        if common.all():
            return self.dense[state, k]
        out = self.dense[state, np.where(common, k, 0)]
        odd = np.flatnonzero(~common)
        hit, at = self._member(self.rare_keys, state[odd].astype(np.int64) * self.classes + k[odd])
        out[odd] = np.where(hit, self.rare_next[at], 0)
        return out

    def _units(self, cp: np.ndarray, k: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """Starts of the lattice's units: places that no piece can cross."""
        a, b = k[:-1], k[1:]
        common = (a < DENSE) & (b < DENSE)
        joined = self.inside[np.where(common, a, 0), np.where(common, b, 0)]
        if not common.all():
            odd = np.flatnonzero(~common)
            joined[odd] = self._member(self.rare_pairs, a[odd].astype(np.int64) * self.classes + b[odd])[0]
        first = np.ones(len(cp), bool)
        first[1:] = ~joined
        first[heads] = True
        return np.flatnonzero(first)

    def _lattice(self, k: np.ndarray, cp: np.ndarray, size: np.ndarray):
        """Forward filtering over units laid end to end, longest first. Returns per edge (in the order of
        the state it ends in) the cumulative share, the state it starts in and its token; per state its
        first edge; and per length the first state."""
        count, chars = len(size), len(k)
        unit = np.repeat(np.arange(count, dtype=np.int32), size)
        start = (np.cumsum(size) - size).astype(np.int32)
        rel = np.arange(chars, dtype=np.int32) - start[unit]
        left = size.astype(np.int32)[unit] - rel  # characters from here to the unit's end
        depth = int(size[0])
        alive = np.searchsorted(-size, -np.arange(depth + 1), side="right")  # units of at least each length
        level = np.concatenate(([0], np.cumsum(alive))).astype(np.int32)  # level[d] + unit: the state after d characters
        src, dst, tok = [], [], []
        state = np.zeros(chars, np.int32)
        at = np.arange(chars, dtype=np.int32)
        lone = np.ones(chars, bool)
        for n in range(1, self.longest + 1):
            state = self._follow(state, k[at + n - 1])
            keep = state > 0
            at, state = at[keep], state[keep]
            done = self.piece[state]
            hit = np.flatnonzero(done >= 0)
            if n == 1:
                lone[at[hit]] = False
            place = at[hit]
            src.append(level[rel[place]] + unit[place])
            dst.append(level[rel[place] + n] + unit[place])
            tok.append(done[hit])
            more = left[at] > n
            at, state = at[more], state[more]
            if not len(at):
                break
        place = np.flatnonzero(lone)
        src.append(level[rel[place]] + unit[place])
        dst.append(level[rel[place] + 1] + unit[place])
        tok.append(-1 - cp[place].astype(np.int32))
        src, dst, tok = np.concatenate(src), np.concatenate(dst), np.concatenate(tok)
        order = _order(dst)
        src, dst, tok = src[order], dst[order], tok[order]
        states = int(level[-1])
        first = np.concatenate(([0], np.cumsum(np.bincount(dst, minlength=states))))
        w = self.weight[tok]  # byte tokens are negative: they index the floor at the table's end
        w[tok < 0] = self.floor
        alpha = np.zeros(states)
        share = np.empty(len(dst))
        for d in range(1, depth + 1):
            lo, hi = level[d], level[d + 1]
            e0, e1 = first[lo], first[hi]
            cut = first[lo:hi] - e0
            v = alpha[src[e0:e1]] + w[e0:e1]
            top = np.maximum.reduceat(v, cut)
            who = dst[e0:e1] - lo
            v = np.exp(v - top[who])
            total = np.add.reduceat(v, cut)
            alpha[lo:hi] = top + np.log(total)
            share[e0:e1] = v / total[who]
        run = np.concatenate(([0.0], np.cumsum(share)))
        run[1:] -= run[first[dst]]
        return run[1:], src, tok, first, level, alpha

    def _slice(self, texts: list[str], keys: np.ndarray, seed: int):
        """(token counts per text, all tokens) of a slice of non-empty texts."""
        joined = "".join([" " + t for t in texts])
        cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        k = self.cls[cp]
        lens = np.array([len(t) + 1 for t in texts], np.int64)
        heads = np.cumsum(lens) - lens
        starts = self._units(cp, k, heads)
        sizes = np.diff(np.concatenate((starts, [len(cp)])))
        # units by content: a 64-bit hash over positions counted from the unit's start
        offset = (np.arange(len(cp), dtype=np.int32) - np.repeat(starts.astype(np.int32), sizes)).astype(np.uint64)
        offset += np.uint64(1)
        offset *= np.uint64(0xD1342543DE82EF95)
        offset += cp.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        codes = np.add.reduceat(mix64(offset), starts)
        grouped = np.argsort(codes)
        fresh = np.ones(len(codes), bool)
        fresh[1:] = codes[grouped[1:]] != codes[grouped[:-1]]
        sample = grouped[fresh]
        which = np.empty(len(codes), np.int64)
        which[grouped] = np.cumsum(fresh) - 1
        longest = np.argsort(-sizes[sample], kind="stable")
        rank = np.empty(len(longest), np.int64)
        rank[longest] = np.arange(len(longest))
        sample, which = sample[longest], rank[which]
        size = sizes[sample]
        spread = np.repeat(starts[sample] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        upper, back, token, first, level, _ = self._lattice(k[spread], cp[spread], size)
        doc = np.searchsorted(heads, starts, side="right") - 1
        place = starts - heads[doc]
        with np.errstate(over="ignore"):
            rng = mix64(mix64(keys[doc] + np.uint64(seed)) + place.astype(np.uint64))
        rng, live = rng[grouped], grouped  # neighbours share a lattice
        state = level[size[which[live]]] + which[live]
        who, what, step = [], [], 0
        while len(live):
            step += 1
            u = (mix64(rng + np.uint64(step * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(11)).astype(np.float64) / float(1 << 53)
            e, last = first[state], first[state + 1] - 1
            go = np.flatnonzero((e < last) & (u >= upper[e]))
            while len(go):
                e[go] += 1
                go = go[(e[go] < last[go]) & (u[go] >= upper[e[go]])]
            who.append(live)
            what.append(token[e])
            state = back[e]
            on = state >= level[1]
            live, rng, state = live[on], rng[on], state[on]
        # pieces came last to first; a stable sort of the reversed steps gives the reading order
        who, what = np.concatenate(who[::-1]), np.concatenate(what[::-1])
        order = _order(who)
        who, what = who[order], what[order]
        if (what < 0).any():
            who, what = self._as_bytes(who, what)
        return np.bincount(doc[who], minlength=len(texts)), what.astype(np.int32)

    def _as_bytes(self, who, what):
        odd = np.flatnonzero(what < 0)
        forms = [chr(-1 - c).encode("utf-8", "surrogatepass") for c in what[odd].tolist()]
        sizes = np.ones(len(what), np.int64)
        sizes[odd] = [len(f) for f in forms]
        out = np.repeat(what, sizes)
        out[out < 0] = self.byte_ids[np.frombuffer(b"".join(forms), np.uint8)]
        return np.repeat(who, sizes), out

    def encode(self, batch: list[str], keys, seed: int = SEED):
        """(token counts per text, all sampled tokens)."""
        counts = np.zeros(len(batch), np.int64)
        out, at = [], 0
        todo = [i for i, t in enumerate(batch) if t]
        keys = np.array([int(k) & 0xFFFFFFFFFFFFFFFF for k in keys], np.uint64)
        while at < len(todo):
            end, chars = at, 0
            while end < len(todo) and (end == at or chars + len(batch[todo[end]]) <= SLICE_CHARS):
                chars += len(batch[todo[end]])
                end += 1
            part = todo[at:end]
            counts[part], ids = self._slice([batch[i] for i in part], keys[part], seed)
            out.append(ids)
            at = end
        return counts, np.concatenate(out) if out else np.zeros(0, np.int32)

    def decode_all(self, counts: np.ndarray, ids: np.ndarray) -> list[bytes]:
        """UTF-8 of every text, without the leading blank."""
        size = self.form_size[ids]
        ends = np.cumsum(size)
        flat = self.form_bytes[np.repeat(self.form_start[ids] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)].tobytes()
        cut = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))].tolist()
        return [flat[a + 1 : b] for a, b in zip(cut, cut[1:])]

    def decode(self, ids) -> str:
        ids = np.asarray(ids, np.int64)
        return self.decode_all(np.array([len(ids)]), ids)[0].decode("utf-8", "surrogatepass")


def load(path: str = MODEL) -> bytes:
    """A vocabulary file, read by the driver; tasks get its bytes, so executors need no such file."""
    if os.path.getsize(path) > MODEL_BYTES:
        raise ValueError(f"{path} is larger than {MODEL_BYTES} bytes")
    with open(path, "rb") as f:
        return f.read()


_CODECS: dict[tuple, Codec] = {}


def codec(model: bytes, temperature: float) -> Codec:
    key = hashlib.sha256(model).digest(), temperature
    if key not in _CODECS:
        _CODECS[key] = Codec(model, temperature)
    return _CODECS[key]


def encode(docs: DataFrame, key: str = "doc_id", path: str = MODEL, temperature: float = TEMPERATURE, seed: int = SEED) -> DataFrame:
    """(key, text) -> (key, ids, n_tokens, ids_sha256, lossless): sampled pieces, and whether decoding
    gave the text back."""
    model = docs.sparkSession.sparkContext.broadcast(load(path))

    def work(batch):
        c = codec(model.value, temperature)
        raw = batch.column("text").to_pylist()
        counts, ids = c.encode([t or "" for t in raw], [k or 0 for k in batch.column(key).to_pylist()], seed)
        ends = np.cumsum(counts)
        cut = [0, *ends.tolist()]
        data = ids.astype("<i4").tobytes()
        back = c.decode_all(counts, ids)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(ids, pa.int32()), mask=pa.array([t is None for t in raw]))
        return {
            key: batch.column(key),
            "ids": lists,
            "n_tokens": counts,
            "ids_sha256": [hashlib.sha256(data[4 * a : 4 * b]).hexdigest() for a, b in zip(cut, cut[1:])],
            "lossless": [x == (t or "").encode() for x, t in zip(back, raw)],
        }

    return arrow_map(docs.select(F.col(key).cast("long").alias(key), "text"), work, f"{key} long, ids array<int>, n_tokens long, ids_sha256 string, lossless boolean")


def decode(encoded: DataFrame, key: str = "doc_id", path: str = MODEL) -> DataFrame:
    """(key, ids) -> (key, text)."""
    model = encoded.sparkSession.sparkContext.broadcast(load(path))

    def work(batch):
        c = codec(model.value, TEMPERATURE)
        return {key: batch.column(key), "text": [None if v is None else c.decode(v) for v in batch.column("ids").to_pylist()]}

    return arrow_map(encoded.select(key, "ids"), work, f"{key} long, text string")


def op10_lattice_sampling(spark, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
