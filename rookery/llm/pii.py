"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits,
schemes and identifier cues. From each anchor a small deterministic parser
expands to both sides, validates what it found and reports a span. The four base
kinds are the leftmost non-overlapping matches of fixed patterns:

    email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+
    ip     [0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+), parts at most 255
    card   [0-9]([\\x20-]?[0-9])+, 14 to 19 digits that pass the Luhn test
    phone  \\+[0-9][\\x20().0-9-]+[0-9], 10 to 15 digits

A match that fails its test is dropped and still uses up its characters. Cues
add further kinds: ``url`` (scheme and host), ``iban`` (mod-97 test), ``account``
(an account, passport or social-security cue followed by a number) and
``secret`` (a quoted or assigned token, password or key).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "iban", "account", "secret")
ORDER = {k: i for i, k in enumerate(KINDS)}

Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_URL_REST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?::[0-9]{1,5})?(?:[/?#][^\s<>\"'`]*)?")
_IBAN = re.compile(r"[\s:#=]{0,3}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){10,30})")
_ACCOUNT = re.compile(r"(?:[\s_-]?(?i:number|no\.?|nr\.?|#))?[\"']?[\s:#=]{1,3}[\"']?([A-Z]{0,3}[0-9](?:[\x20-]?[0-9]){5,19})(?![0-9A-Za-z])")
_SECRET = re.compile(r"[\"']?\s?[=:]\s?(?:\"([^\"\s]{8,})\"|'([^'\s]{8,})'|([A-Za-z0-9_\-]{16,}))")

_ACCOUNT_CUES = ("account", "acct", "passport", "ssn", "social security")
_SECRET_CUES = ("token", "password", "passwd", "secret", "api_key", "api key", "api-key", "apikey")
#: upper-case ASCII letters to lower case: cues match without regard to case, offsets stay
_FOLD = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def anchors():
    """The automaton that finds where a span may be in a folded text: word -> kind of anchor."""
    import ahocorasick

    words = {"@": "at", "+": "plus", "://": "scheme"}
    words |= {str(d): "digit" for d in range(10)}
    for cue, kind in [("iban", "iban"), *((c, "account") for c in _ACCOUNT_CUES), *((c, "secret") for c in _SECRET_CUES)]:
        words[cue] = kind
    found = ahocorasick.Automaton()
    for word, kind in words.items():
        found.add_word(word, kind)
    found.make_automaton()
    return found


def _folded(text: str) -> str:
    """``text`` in lower case, at the same offsets; only ASCII letters where full lower case is longer."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(_FOLD)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _mod97(code: str) -> bool:
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _back(text: str, at: int, low: int, allowed: frozenset) -> int:
    while at > low and text[at - 1] in allowed:
        at -= 1
    return at


def find_spans(text: str | None, automaton) -> list[Span]:
    """All spans (kind, start, end) of a text in code points, sorted by start, then kind."""
    if not text:
        return []
    spans: list[Span] = []
    ends = dict.fromkeys(KINDS, 0)
    last_digit = -2
    for at, cue in automaton.iter(_folded(text)):
        if cue == "digit":
            run_start, last_digit = at != last_digit + 1, at
            # a part of a number in the middle of a run cannot start a match that its first digit could not
            if at >= ends["ip"] and (run_start or at == ends["ip"]):
                m = _IP.match(text, at)
                if m:
                    ends["ip"] = m.end()
                    parts = [p.lstrip("0") for p in m.group().split(".")]
                    if all(len(p) < 4 and int(p or 0) <= 255 for p in parts):
                        spans.append(("ip", at, m.end()))
            if at >= ends["card"]:
                m = _CARD.match(text, at)
                if m:
                    ends["card"] = m.end()
                    digits = _digits(m.group())
                    if 14 <= len(digits) <= 19 and luhn(digits):
                        spans.append(("card", at, m.end()))
        elif cue == "at":
            start = _back(text, at, ends["email"], _LOCAL)
            m = _DOMAIN.match(text, at + 1) if start < at else None
            if m:
                ends["email"] = m.end()
                spans.append(("email", start, m.end()))
        elif cue == "plus":
            m = _PHONE.match(text, at) if at >= ends["phone"] else None
            if m:
                ends["phone"] = m.end()
                if 10 <= len(_digits(m.group())) <= 15:
                    spans.append(("phone", at, m.end()))
        else:
            spans += _cued(text, at, cue, ends)
    spans.sort(key=lambda s: (s[1], ORDER[s[0]]))
    return spans


def _cued(text: str, at: int, cue: str, ends: dict[str, int]) -> Iterator[Span]:
    """Spans of the kinds that the method adds, behind the cue that ends at ``at``."""
    if cue == "scheme":
        start = _back(text, at - 2, ends["url"], _SCHEME)
        m = _URL_REST.match(text, at + 1)
        if m and start < at - 2 and text[start].isalpha():
            end = at + 1 + len(m.group().rstrip(".,;:!?)]}"))
            ends["url"] = end
            yield "url", start, end
        return
    pattern = {"iban": _IBAN, "account": _ACCOUNT, "secret": _SECRET}[cue]
    m = pattern.match(text, at + 1) if at >= ends[cue] else None
    if not m:
        return
    group = m.lastindex
    start, end = m.span(group)
    if cue == "iban":
        # national formats differ in length: the longest prefix that passes the test
        for stop in range(end, start + 14, -1):
            code = text[start:stop].replace(" ", "")
            if text[stop - 1] != " " and 15 <= len(code) <= 34 and _mod97(code):
                break
        else:
            return
        end = stop
    ends[cue] = end
    yield cue, start, end


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redact(text: str, spans: list[Span], kinds: frozenset[str]) -> str:
    """``text`` with each span of ``kinds`` replaced by its kind in brackets.

    Where spans overlap, the one that starts first (then the kind listed first)
    gives the name and the replaced range is their union.
    """
    out, at = [], 0
    merged: list[list] = []
    for kind, start, end in spans:
        if kind not in kinds:
            continue
        if merged and start < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], end)
        else:
            merged.append([kind, start, end])
    for kind, start, end in merged:
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


_SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def detect(docs: DataFrame) -> DataFrame:
    """Personal data of every document: doc_id and ``spans``, an array of (kind, start, end).

    A null or empty text has no spans. Every input row gives one row, repeated
    rows and null doc_ids included; an empty table gives an empty table. Only
    doc_id and text are read. Offsets are code points, ends exclusive.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = anchors()
        for batch in batches:
            rows = [[{"kind": k, "start": s, "end": e} for k, s, e in find_spans(t.as_py(), automaton)] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("spans", _SPAN)]))


def digests(found: DataFrame) -> DataFrame:
    """Counts and digests of ``detect``'s rows: one row per document."""
    def text_of(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(text_of(base), 256).alias("base_sha256"), text_of(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame, kinds: tuple[str, ...] = tuple(k for k in KINDS if k != "url"), length: str = "n_chars") -> DataFrame:
    """``docs`` with the spans of ``kinds`` replaced in ``text``; same columns.

    Texts without such spans come back unchanged, null stays null. ``length``,
    if there is such a column, is set to the new length of changed texts.
    """
    wanted = frozenset(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = anchors()
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = [None if (x := t.as_py()) is None else redact(x, find_spans(x, automaton), wanted) for t in batch.column(at)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    out = docs.mapInArrow(run, docs.schema)
    if length in docs.columns:
        out = out.withColumn(length, F.when(F.col("text").isNull(), F.col(length)).otherwise(F.length("text")).cast(docs.schema[length].dataType))
    return out.select(*docs.columns)
