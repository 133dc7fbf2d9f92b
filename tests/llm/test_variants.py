"""Spelling variants against brute force, and their edge cases."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from rookery.llm import queries, variants

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_words(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{doc_id}:{run}".encode()) if doc_id is not None else 1
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def deletions(word):
    return {word[:i] + word[i + 1:] for i in range(len(word))}


def brute_near(words):
    """Near words by deleted and by masked letters."""
    near = {w: set() for w in words}
    masked = {}
    for w in words:
        for short in deletions(w):
            if short in near:
                near[w].add(short)
                near[short].add(w)
        for i in range(len(w)):
            masked.setdefault((w[:i], w[i + 1:]), set()).add(w)
    for group in masked.values():
        for w in group:
            near[w] |= group - {w}
    return near


def brute(rows):
    words = brute_words(rows)
    near = brute_near(words)
    form = {}
    for w, n in words.items():
        if near[w]:
            best = min(near[w], key=lambda x: (-words[x], x))
            form[w] = best if words[best] >= 10 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form.get(root):
            root = form[root]
        f = form.get(w)
        out.append((w, f, root, n, len(near[w]), words[f] if f else None))
    return sorted(out)


def found(spark, rows, **kw):
    df = variants.variants(spark.createDataFrame(rows, SCHEMA), **kw)
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(tuple(r) for r in df.collect())


def corpus(seed, letters="abcé", size=9, docs=60, words=60):
    rng = random.Random(seed)
    base = ["".join(rng.choice(letters) for _ in range(size)) for _ in range(words)]
    rows = []
    for i in range(docs):
        out = []
        for _ in range(rng.randint(0, 80)):
            w = base[int(rng.random() ** 3 * len(base))]
            if rng.random() < 0.3:
                at = rng.randrange(len(w))
                w = w[:at] + rng.choice(["", rng.choice(letters), w[at] + rng.choice(letters)]) + w[at + 1:]
            out.append(w.title() if rng.random() < 0.2 else w)
        rows.append((i, rng.choice([" ", ", ", "1"]).join(out)))
    return rows


@pytest.mark.parametrize("seed, kw, letters", [(1, {}, "abcé"), (2, {"cell_words": 8}, "abcdefg"), (3, {"cell_words": 3}, "ab"), (4, {"cell_words": 20}, "abcdÀÿ×")])
def test_against_brute_force(spark, seed, kw, letters):
    rows = corpus(seed, letters)
    want = brute(rows)
    assert any(w[4] for w in want) and found(spark, rows, **kw) == want


def test_cells_of_a_sample(spark, monkeypatch):
    """A tree fitted on a few of the words still loses no pair."""
    monkeypatch.setattr(variants, "SAMPLE_WORDS", 60)
    rows = corpus(5, "abcde", 8)
    assert found(spark, rows, cell_words=30) == brute(rows)


def test_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in queries.op12_variants(spark, SF).collect()) == brute(rows)


def test_forms_are_followed_to_the_last(spark):
    chain = ["aaaaaaaa", "aaaaaaab", "aaaaaabb", "aaaaabbb"]
    rows = [(None, (w + " ") * (2 * 10 ** i)) for i, w in enumerate(chain)]
    got = found(spark, rows)
    assert got == brute(rows) and {r[2] for r in got} == {chain[-1]}


def test_one_edit():
    def same(a, b):
        return bool(variants.one_replaced(np.array([list(a.encode())]), np.array([list(b.encode())]))[0])

    def more(a, b):
        return bool(variants.one_inserted(np.array([list(a.encode())]), np.array([list(b.encode())]))[0])

    assert same("abc", "abd") and not same("abc", "acb") and not same("abc", "abc")
    assert more("abc", "xabc") and more("abc", "abcx") and more("abc", "abbc") and not more("abc", "axcb") and not more("abc", "acbb")


def test_very_long_words_ties_and_repeated_rows(spark):
    long = "x" * 40_000
    rows = [(1, f"{long} {long}y {long}z"), (2, f"{long} {long}y {long}z"), (2, f"{long} {long}y {long}z"),
            (3, "bcdefgh " * 2 + "bcdefga " * 20 + "bcdefgi " * 20)]
    got = found(spark, rows)
    assert got == brute(rows)
    assert [r[1] for r in got if r[0] == "bcdefgh"] == ["bcdefga"]


def test_nulls_empty_and_clashing_columns(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, None), (2, ""), (None, "short words only 1234567"), (None, None)]) == []
    rows = [(None, "Colourful colourful colorful"), (7, "colorful COLORFUL Ābcdefgh")]
    df = spark.createDataFrame([(*r, "w", 1, "c") for r in rows], SCHEMA + ", word string, n int, cell string")
    assert sorted(tuple(r) for r in variants.variants(df).collect()) == brute(rows)
