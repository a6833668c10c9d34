"""PII by anchor expansion.

One Aho-Corasick pass per text finds the anchors: at-signs, plus-signs, digits, URL schemes and
identifier cues. At each anchor a deterministic local parser expands to the left and right, bounded by
the previous span of its kind, and validates what it found (octet range, Luhn, digit counts, IBAN
checksum). No backtracking search runs over the text, so cost is linear in its length.

All kinds are leftmost and non-overlapping per kind; a candidate that fails validation is dropped without retry.
Base kinds: email, ip, card, phone, by the patterns of ``PATTERNS``. Added kinds, never replacing base spans: ``url``
(a scheme whose authority carries a user part), ``iban`` (a run of letters and digits: country, check digits, account,
mod 97) and ``secret`` (16 or more key characters after an identifier cue and ``=`` or ``:``). No run of characters is
walked twice by a kind: where one ended is remembered, or the next anchor bounds it.

Spans are code-point offsets, end exclusive. Null and empty texts have no spans; very long texts are
scanned whole; ties (same start) sort by kind in the order listed. Rows are taken one by one, so repeated or null ids
make no difference; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import arrow_map, sliced, table, texts

BASE = ("email", "ip", "card", "phone")
KINDS = BASE + ("url", "iban", "secret")
# What each kind's candidates match (a secret's span is its group). Validation follows.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "url": r"""[A-Za-z0-9]+://[^\x09-\x0D\x20"'<>)@/]+@[^\x09-\x0D\x20"'<>)]+""",
    "iban": r"[A-Za-z0-9]+",
    "secret": r"""(?:{cues})[\x20\x09"']{{0,3}}[=:][\x20\x09"']{{0,7}}([A-Za-z0-9_+/=.-]{{16,}})""",
}
CUES = ("token", "secret", "password", "passwd", "api_key", "apikey", "api-key", "access_key", "iban")

_DIGITS = frozenset("0123456789")
_ALNUM = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
_LOCAL = _ALNUM | frozenset("._%+-")
_LABEL = _ALNUM | frozenset("-")
_PHONE = _DIGITS | frozenset(" ().-")
_KEY = _ALNUM | frozenset("_-+/=.")
_UPPER = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_QUOTE = frozenset(" \t\"'")
_STOP = frozenset("\t\n\v\f\r \"'<>)")
FORMS = sorted({form for cue in CUES for form in (cue, cue.upper(), cue.capitalize())})
PATTERNS["secret"] = PATTERNS["secret"].format(cues="|".join(FORMS))


def _automaton():
    a = ahocorasick.Automaton()
    for c in "0123456789":
        a.add_word(c, ("d", 1))
    a.add_word("@", ("@", 1))
    a.add_word("+", ("+", 1))
    a.add_word("://", ("s", 3))
    for form in FORMS:
        a.add_word(form, ("c", len(form)))
    a.make_automaton()
    return a


_AUTOMATON = _automaton()


def _run(t: str, i: int, allowed) -> int:
    n = len(t)
    while i < n and t[i] in allowed:
        i += 1
    return i


def _email(t: str, at: int, floor: int):
    lo = at
    while lo > floor and t[lo - 1] in _LOCAL:
        lo -= 1
    end = _run(t, at + 1, _LABEL)
    if lo == at or end == at + 1:
        return None
    last = end
    while last < len(t) and t[last] == "." and (more := _run(t, last + 1, _LABEL)) > last + 1:
        last = more
    return (lo, last) if last > end else None


def _dotted(t: str, i: int):
    """From the start of a digit run: the end after four dotted runs (0: none), their validity, and
    the end of the last run seen."""
    ends, ok = [], True
    start = i
    while True:
        end = _run(t, start, _DIGITS)
        part = t[start:end].lstrip("0")
        ok &= len(part) <= 3 and int(part or "0") <= 255
        ends.append(end)
        if len(ends) == 4:
            return end, ok, end
        if end + 1 < len(t) and t[end] == "." and t[end + 1] in _DIGITS:
            start = end + 1
        else:
            return 0, False, end


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k & 1:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _card(t: str, i: int):
    """From a digit: the end of the longest run of digits with single spaces or hyphens between, and the digits."""
    out, n, j = [t[i]], len(t), i + 1
    while j < n:
        if t[j] in _DIGITS:
            out.append(t[j])
            j += 1
        elif t[j] in " -" and j + 1 < n and t[j + 1] in _DIGITS:
            out.append(t[j + 1])
            j += 2
        else:
            break
    return j, "".join(out)


def _phone(t: str, i: int):
    if i + 1 >= len(t) or t[i + 1] not in _DIGITS:
        return None
    end = _run(t, i + 2, _PHONE)
    while end > i + 3 and t[end - 1] not in _DIGITS:
        end -= 1
    if end <= i + 3 or t[end - 1] not in _DIGITS:
        return None
    return i, end, 9 <= sum(c in _DIGITS for c in t[i:end]) <= 15


def _iban(t: str, i: int):
    """At two check digits: the country letters before and the account after; mod 97 must be 1."""
    if i < 2 or t[i - 1] not in _UPPER or t[i - 2] not in _UPPER or (i > 2 and t[i - 3] in _ALNUM):
        return None
    end, most = i, min(len(t), i + 33)  # 34 characters with the letters, and one to see that it ends
    while end < most and (t[end] in _UPPER or t[end] in _DIGITS):
        end += 1
    if not 15 <= end - i + 2 <= 34 or (end < len(t) and t[end] in _ALNUM) or t[i + 1] not in _DIGITS:
        return None
    s = t[i:end][2:] + t[i - 2 : i + 2]
    return (i - 2, end) if int("".join(str(int(c, 36)) for c in s)) % 97 == 1 else None


def _url(t: str, at: int, floor: int):
    """The user part ends before the next slash, so it never reaches beyond the next anchor."""
    lo = at
    while lo > floor and t[lo - 1] in _ALNUM:
        lo -= 1
    if lo == at:
        return None
    i, n = at + 3, len(t)
    while i < n and t[i] not in _STOP and t[i] not in "@/":
        i += 1
    if i == at + 3 or i == n or t[i] != "@":
        return None
    end = i + 1
    while end < n and t[end] not in _STOP:
        end += 1
    return (lo, end) if end > i + 1 else None


def _secret(t: str, end: int):
    i, n = end, len(t)
    while i < n and i < end + 3 and t[i] in _QUOTE:
        i += 1
    if i >= n or t[i] not in "=:":
        return None
    i = mark = i + 1
    while i < n and i < mark + 7 and t[i] in _QUOTE:
        i += 1
    stop = _run(t, i, _KEY)
    return (i, stop) if stop - i >= 16 else None


def spans(t: str) -> list[tuple[int, int, int]]:
    """All spans of a text as (start, kind index, end), sorted."""
    out = set()
    email_end = ip_next = card_next = phone_end = url_end = secret_end = 0
    for last, (what, length) in _AUTOMATON.iter(t):
        at = last - length + 1
        if what == "d":
            if at >= card_next:
                end, digits = _card(t, at)
                card_next = end
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.add((at, 2, end))
            if at >= ip_next and (at == 0 or t[at - 1] not in _DIGITS or at == ip_next):
                end, ok, seen = _dotted(t, at)
                ip_next = end or seen
                if end and ok:
                    out.add((at, 1, end))
                if (at >= 2 and t[at - 1] in _UPPER) and (found := _iban(t, at)):
                    out.add((found[0], 5, found[1]))
        elif what == "@":
            if found := _email(t, at, email_end):
                email_end = found[1]
                out.add((found[0], 0, found[1]))
        elif what == "+":
            if at >= phone_end and (found := _phone(t, at)):
                phone_end = found[1]
                if found[2]:
                    out.add((at, 3, found[1]))
        elif what == "s":
            if at >= url_end and (found := _url(t, at, url_end)):
                url_end = found[1]
                out.add((found[0], 4, found[1]))
        elif at >= secret_end and (found := _secret(t, last + 1)):
            secret_end = found[1]
            out.add((found[0], 6, found[1]))
    return sorted(out)


def redact(t: str, found=None) -> str:
    """The text with every span replaced by <kind>; overlapping spans merge under the first kind."""
    out, at = [], 0
    for lo, kind, hi in spans(t) if found is None else found:
        if lo >= at:
            out += (t[at:lo], f"<{KINDS[kind]}>")
        at = max(at, hi)
    return "".join(out) + t[at:]


def _join(found) -> str:
    return ",".join(f"{KINDS[k]}:{lo}:{hi}" for lo, k, hi in found)


def detect(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> counts per base kind, the digest of the base spans, and all spans."""

    def work(batch):
        found = [spans(t) for t in texts(batch)]
        base = [[s for s in f if s[1] < 4] for f in found]
        out = {"doc_id": batch.column("doc_id")}
        for k, kind in enumerate(BASE):
            out[f"n_{kind}"] = [sum(s[1] == k for s in b) for b in base]
        out["base_sha256"] = [hashlib.sha256(_join(b).encode()).hexdigest() for b in base]
        out["spans"] = [_join(f) for f in found]
        return out

    return arrow_map(docs.select("doc_id", "text"), work, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(docs: DataFrame) -> DataFrame:
    """The table with each text's spans replaced by <kind>; a null text stays null, other columns pass
    (n_chars, where there is one, is brought up to date)."""
    def work(batches):
        for b in sliced(batches):
            clean = pa.array([None if t is None else redact(t) for t in b.column("text").to_pylist()], pa.string())
            yield b.set_column(b.schema.get_field_index("text"), "text", clean)

    out = docs.mapInArrow(work, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def op2_anchor_pii(spark, sf_dir: str) -> DataFrame:
    return detect(table(spark, sf_dir, "documents"))


def _candidates(k: int, kind: str) -> str:
    """SQL: (rid, k, s, lo) of a kind's matches; a match starts after all gaps and matches before it."""
    pattern = PATTERNS[kind].replace("'", "''")
    return f"""SELECT rid, {k} AS k, s, sum(length(gap) + length(s)) OVER (PARTITION BY rid ORDER BY i) - length(s) AS lo FROM (
 SELECT rid, unnest(ms) AS s, unnest(gaps[1:len(ms)]) AS gap, unnest(range(1, len(ms) + 1)) AS i FROM (
  SELECT rid, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS gaps FROM d))"""


_SECRET = PATTERNS["secret"].replace("'", "''")

#: The patterns, validations and spans in SQL.
OP2_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
c AS ({" UNION ALL ".join(_candidates(k, kind) for k, kind in enumerate(KINDS))}),
g AS (SELECT *, regexp_replace(s, '[^0-9]', '', 'g') AS digits, string_split(s, '.') AS parts, substr(s, 5) || substr(s, 1, 4) AS turned FROM c),
v AS (SELECT rid, k, CASE WHEN k = 6 THEN lo + length(s) - length(regexp_extract(s, '{_SECRET}', 1)) ELSE lo END AS lo, lo + length(s) AS hi FROM g WHERE CASE k
 WHEN 1 THEN len(list_filter(parts, lambda x: length(ltrim(x, '0')) > 3 OR coalesce(try_cast(ltrim(x, '0') AS INT), 0) > 255)) = 0
 WHEN 2 THEN length(digits) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda j:
  CASE WHEN (length(digits) - j) % 2 = 0 THEN substr(digits, j, 1)::INT WHEN substr(digits, j, 1)::INT > 4 THEN 2 * substr(digits, j, 1)::INT - 9 ELSE 2 * substr(digits, j, 1)::INT END)) % 10 = 0
 WHEN 3 THEN length(digits) BETWEEN 9 AND 15
 WHEN 5 THEN CASE WHEN regexp_full_match(s, '[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}') THEN list_reduce(list_transform(string_split(turned, ''), lambda x: CASE WHEN x <= '9' THEN x::INT ELSE ascii(x) - 55 END),
  lambda a, x: (CASE WHEN x > 9 THEN a * 100 ELSE a * 10 END + x) % 97) = 1 ELSE false END
 ELSE true END),
r AS (SELECT rid, k, [{", ".join(f"'{kind}'" for kind in KINDS)}][k + 1] || ':' || lo || ':' || hi AS span, lo FROM v)
SELECT doc_id, count(*) FILTER (k = 0) AS n_email, count(*) FILTER (k = 1) AS n_ip, count(*) FILTER (k = 2) AS n_card, count(*) FILTER (k = 3) AS n_phone,
 sha256(coalesce(string_agg(span, ',' ORDER BY lo, k) FILTER (k < 4), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY lo, k), '') AS spans
FROM d LEFT JOIN r USING (rid) GROUP BY rid, doc_id
"""
