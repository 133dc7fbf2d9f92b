"""Language identification: a plain version of the method, held-out accuracy, edge cases."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from rookery.llm import langid, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string"


def is_held_out(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 4 == 2


def plain(rows):
    """(doc_id, held_out, lang_pred, score) by dictionaries; the sample bounds are not reached."""
    seen = {(d, t, x) for d, t, x in rows if t is not None and x is not None and not is_held_out(d)}
    counts = defaultdict(Counter)   # (n, lang) -> item -> count
    for _, text, lang in seen:
        for word in re.findall(r"[^\W\d_]+", text.lower()):
            counts[0, lang][word] += 1
            for n in range(1, 6):
                padded = f" {word} " if n > 1 else word
                for i in range(len(padded) - n + 1):
                    counts[n, lang][padded[i:i + n]] += 1
    langs = sorted({lang for _, lang in counts})
    total = defaultdict(Counter)
    for (n, _), c in counts.items():
        total[n].update(c)
    known = {n: {w for w, c in total[n].items() if c >= 2} for n in range(6)}
    langs = [x for x in langs if any(w in known[n] for n in range(6) for w in counts[n, x])]

    def freq(n, item, lang):
        size = sum(c for w, c in counts[n, lang].items() if w in known[n])
        return math.log((counts[n, lang].get(item, 0) + 0.5) / (size + 0.5 * len(known[n])))

    def score(word, lang):
        if word in known[0]:
            return freq(0, word, lang)
        for n in range(5, 0, -1):
            padded = f" {word} " if n > 1 else word
            hits = [padded[i:i + n] for i in range(len(padded) - n + 1) if padded[i:i + n] in known[n]]
            if hits:
                return sum(freq(n, g, lang) for g in hits) / len(hits)
        return 0.0

    out = []
    for d, text, _ in rows:
        words = [w for w in re.findall(r"[^\W\d_]+", (text or "").lower()) if any(c.isalpha() for c in w)]
        if not words or not langs:
            out.append((d, is_held_out(d), "und", 0.0))
            continue
        sums = [sum(score(w, x) for w in words) for x in langs]
        best = max(range(len(langs)), key=lambda i: (round(sums[i], 9), -i))
        out.append((d, is_held_out(d), langs[best], 1 / sum(math.exp(s - sums[best]) for s in sums)))
    return out


def found(spark, rows, schema=SCHEMA):
    docs = spark.createDataFrame(rows, schema)
    df = langid.predictions(docs, langid.train(docs))
    assert df.columns == ["doc_id", "held_out", "lang_pred", "score"]
    return [tuple(r) for r in df.collect()]


def check(got, want):
    def order(r):
        return str(r[0]), r[2], round(r[3], 6)

    got, want = sorted(got, key=order), sorted(want, key=order)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in want], abs=1e-6)


TEXTS = [("The cat and the dog of the house", "en"), ("the house and a dog are in it", "en"), ("Der Hund und die Katze", "de"), ("die Häuser und der Hund", "de"),
         ("le chien et la maison", "fr"), ("La maison est à la mer", "fr")]


def test_against_plain_version(spark):
    rows = [(i, *TEXTS[i % len(TEXTS)]) for i in range(24)]
    rows += [(100, "houses", None), (101, "hundert Häusern", "en"), (102, "x²y ½ 3 chienne", None), (103, "1234 -- ½", "de"), (104, "", "fr"), (105, None, "fr"),
             (None, "ein Text ohne Nummer", "de"), (106, "中文", None), (107, "the" * 400, None), (108, "o", "en")]
    check(found(spark, rows), plain(rows))


def test_small_table_against_plain_version(spark):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()]
    rows = rows[:60] + [(None, "x", None)]
    check(found(spark, rows), plain(rows))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    df = queries.op13_langid(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id")
    rows = df.collect()
    assert len(rows) == docs.count()
    out = [r for r in rows if r.held_out]
    assert 150 < len(out) < 350
    assert sum(r.lang_pred == r.lang for r in out) / len(out) >= 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_nothing_is_learned_from_held_out_rows(spark):
    ids = [i for i in range(40) if is_held_out(i)][:4]
    rows = [(i, "nur ein Satz nur ein Satz", "de") for i in ids]
    assert {r[2:] for r in found(spark, rows)} == {("und", 0.0)}
    learned = next(i for i in range(40) if not is_held_out(i))
    assert {r[2] for r in found(spark, [*rows, (learned, "just a line just a line", "en")])} == {"en"}


def test_sample_is_bounded_and_whole(spark):
    learned = [i for i in range(400) if not is_held_out(i)]
    docs = spark.createDataFrame([(i, f"word{'x' * 50} " * 10, "en") for i in learned] + [(learned[0], "twice " * 9, "de")] * 50, SCHEMA)
    rows = langid.sample(docs, rows=30).collect()
    assert sum(r.lang == "en" for r in rows) == 30 and sum(r.lang == "de" for r in rows) == 1
    size = len(f"word{'x' * 50} " * 10)
    rows = langid.sample(docs, rows=30, chars=3 * size + 1).collect()
    assert sum(r.lang == "en" for r in rows) == 4 and {len(r.text) for r in rows if r.lang == "en"} == {size}


def test_long_text_ties_repeated_rows_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(langid, "STEP", 1000)
    base = [(i, *TEXTS[i % 2 * 2]) for i in range(12)]
    rows = [*base, (50, "katze " * 20_000, None), (50, "katze " * 20_000, None), (51, "zzz", "de"), (52, "", None)]
    want = plain(rows)
    check(found(spark, rows), want)
    wide = [(*r, 1, "s", 0.5, "h") for r in rows]
    check(found(spark, wide, SCHEMA + ", h int, held_out string, score double, lang_pred string"), want)


def test_empty_table(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, None, None)]) == [(1, is_held_out(1), "und", 0.0)]
