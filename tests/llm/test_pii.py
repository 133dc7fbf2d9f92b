"""Personal data against the base patterns, and the kinds that cues add."""

import hashlib
import random
import re

import pytest
from rookery.llm import pii, queries

SF = "/root/testdata/sf0.001"
AUTO = pii.anchors()


def luhn(d):
    return sum((x - 9 if x > 9 else x) for x in (int(c) * (2 if i % 2 else 1) for i, c in enumerate(d[::-1]))) % 10 == 0


def brute(text):
    text, out = text or "", []
    out += [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 14 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], pii.BASE_KINDS.index(s[0])))


def base(text):
    return [s for s in pii.find_spans(text, AUTO) if s[0] in pii.BASE_KINDS]


def test_base_spans_of_random_texts():
    rng = random.Random(5)
    parts = ["a@b.co", "@", "x.y+z@", "mail.example.com", ".", "..", "1.2.3.4", "255.1.0.256", "999", "4111 1111 1111 1111", "4111111111111111", "-", " ", "+",
             "+1 (504) 555-2652", "+49.30.1234567", "(", ")", "12", "0", "é", "字", "token", "\n", "1.2.3.4.5.6.7.8", "a@b@c.de", "00000000000000"]
    for _ in range(20000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert base(text) == brute(text), text


@pytest.mark.parametrize("text", ["1" * 4999, "1." * 5000, "a@" * 3000 + "b.c", "+1" + " 2" * 4000, "x" * 20000 + "@a.b", "9." + "9" * 6000 + ".1.1"])
def test_long_texts(text):
    # parts of thousands of digits are no numbers to convert
    assert base(text) == brute(text)


def test_added_kinds():
    text = "see https://ex.org/a?b=1. IBAN: DE89 3704 0044 0532 0130 00, account no. 12345678; token = \"5d190bd7c06284de91015a36974748794293dd8a\" passport AB1234567"
    got = {k: text[s:e] for k, s, e in pii.find_spans(text, AUTO)}
    assert got["url"] == "https://ex.org/a?b=1"
    assert got["iban"] == "DE89 3704 0044 0532 0130 00"
    assert got["secret"] == "5d190bd7c06284de91015a36974748794293dd8a"
    assert [text[s:e] for k, s, e in pii.find_spans(text, AUTO) if k == "account"] == ["12345678", "AB1234567"]
    for clean in ("IBAN: DE00 3704 0044 0532 0130 00", "the account of a token gesture", "a://b", "an account 12", "https://nodots"):
        assert pii.find_spans(clean, AUTO) == []


@pytest.mark.parametrize("text,kind,found", [
    ("Account Number: 12345678", "account", "12345678"), ("ACCOUNT NUMBER 12345678", "account", "12345678"), ("Passport No. AB1234567", "account", "AB1234567"),
    ("Account No: 12345678", "account", "12345678"), ("aCcOuNt nO 12345678", "account", "12345678"), ("Social Security Number: 123-45-6789", "account", "123-45-6789"),
    ('"account_number": "12345678"', "account", "12345678"), ("É İ Account Nr. 12345678", "account", "12345678"),
    ('"password": "hunter2hunter2"', "secret", "hunter2hunter2"), ('{"api_key":"hunter2hunter2"}', "secret", "hunter2hunter2"), ("'Secret' = 'hunter2hunter2'", "secret", "hunter2hunter2"),
    ("API key: abcdefgh12345678", "secret", "abcdefgh12345678"), ("Api Key = abcdefgh12345678", "secret", "abcdefgh12345678"), ("API_Key=abcdefgh12345678", "secret", "abcdefgh12345678"),
    ("IBan DE89 3704 0044 0532 0130 00", "iban", "DE89 3704 0044 0532 0130 00"),
])
def test_spellings_of_cues(text, kind, found):
    assert [text[s:e] for k, s, e in pii.find_spans(text, AUTO) if k == kind] == [found]


def test_query_against_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op2_pii(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(pii.joined(want).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in want) for k in pii.BASE_KINDS)
        every = [tuple(s.split(":")) for s in r.spans.split(",") if s]
        assert [(k, int(s), int(e)) for k, s, e in every if k in pii.BASE_KINDS] == want


def test_nulls_repeats_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, None, 0, "s"), (None, "a@b.cd", 6, None), (2, "", 0, "s"), (2, "", 0, "s"), (3, "clean", None, "s")], "doc_id long, text string, n_chars long, spans string")
    got = sorted((str(r.doc_id), r.n_email, r.spans) for r in pii.digests(pii.detect(docs)).collect())
    assert got == [("1", 0, ""), ("2", 0, ""), ("2", 0, ""), ("3", 0, ""), ("None", 1, "email:0:6")]
    out = pii.redacted(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    assert sorted((str(r.doc_id), r.text, r.n_chars) for r in out.collect()) == [("1", None, 0), ("2", "", 0), ("2", "", 0), ("3", "clean", 5), ("None", "[EMAIL]", 7)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pii.digests(pii.detect(docs)).collect() == []
    assert pii.redacted(docs).collect() == []


def test_redaction_joins_overlaps():
    text = "+4111111111111111 x"
    spans = pii.find_spans(text, AUTO)
    assert {k for k, _, _ in spans} == {"card"} or len(spans) > 1
    assert pii.redact("abcdefgh", [("email", 1, 4), ("ip", 2, 6), ("url", 7, 8)], frozenset({"email", "ip"})) == "a[EMAIL]gh"
