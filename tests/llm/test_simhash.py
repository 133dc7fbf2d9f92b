"""SimHash near-dedup against brute force, and its edge cases."""

import random
import re

import numpy as np
import pytest
import xxhash
from rookery.llm import components, queries, simhash

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_fingerprint(text, k=3):
    words = [w.translate(LOWER) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i:i + k]).encode(), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def expected(rows):
    """(doc_id, fp, component) of (doc_id, text) rows with ids."""
    fps = [(d, brute_fingerprint(t)) for d, t in rows]
    distinct = sorted({f for _, f in fps})
    a = np.array(distinct, dtype=np.uint64)
    near = [(distinct[i], distinct[j]) for i in range(len(a)) for j in np.nonzero(np.bitwise_count(a[i] ^ a) <= 2)[0] if i < j]
    comp = brute_components(distinct, near)
    low = {}
    for d, f in fps:
        if d is not None:
            low[comp[f]] = min(low.get(comp[f], d), d)
    return sorted(((d, f, low.get(comp[f])) for d, f in fps), key=str)


@pytest.mark.parametrize("text", ["", None, " \t\n", "one", "one two", "One two THREE", "a b c d a b c d", "ÀÉ bé\u00a0x y\u2003z", "x" * 5000, "w " * 3000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_fingerprint_counts_long_texts_in_pieces(monkeypatch):
    text = " ".join(random.Random(1).choice("abcdefgh") for _ in range(5000))
    monkeypatch.setattr(simhash, "CELLS", 64 * 17)
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_query_on_the_test_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in queries.op1_simhash(spark, SF).collect()), key=str)
    assert got == expected(rows)


def test_nulls_repeats_clashing_columns_and_ties(spark):
    rows = [(5, None), (3, ""), (9, " \n"), (7, "a b c d"), (2, "A B C D"), (None, "a b c d"), (7, "a b c d"), (None, "alone here now"), (1, "q r s t u")]
    docs = spark.createDataFrame([(d, t, i, "x") for i, (d, t) in enumerate(rows)], "doc_id long, text string, fp long, component_id string")
    got = sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == expected(rows)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    # one row of each group, also of a group without an id
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == [(1, "q r s t u"), (2, "A B C D"), (3, ""), (None, "alone here now")]


def test_repeated_id_counts_once(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (2, "z y x w v")], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == [1, 2]


def test_copies_without_ids_go(spark):
    same, other = "a b c d e f", "t u v w x y z"
    rows = [(None, same, 3), (5, same, 1), (None, same, 2), (None, other, 9), (None, other, 4), (None, None, 7), (None, "", 6)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, n int"))
    assert sorted((tuple(r) for r in kept.collect()), key=str) == sorted([(5, same, 1), (None, other, 4), (None, None, 7)], key=str)


def test_an_id_that_stays_does_not_bring_its_copies_back(spark):
    # doc 5 is alone with one row, and a copy of doc 3 with another
    same, alone = "one two three four five", "quite another text with other words"
    rows = [(3, same, {"k": 1}), (5, same, {"k": 2}), (5, alone, {"k": 3}), (5, alone, {"k": 0})]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, `a.b` map<string,int>"))
    assert sorted((r[0], r[1], r[2]["k"]) for r in kept.collect()) == [(3, same, 1), (5, alone, 0)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).collect() == []
    assert simhash.keep_one(docs).collect() == []


@pytest.mark.parametrize("radius,tile", [(0, 8), (2, 3), (2, 4096), (3, 16)])
def test_tiles_find_every_link(spark, radius, tile):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    fps = set(base.tolist()) | {0, (1 << 64) - 1, 1, 3}
    for f in base[:40].tolist():
        for n in range(1, 5):
            g = f
            for b in rng.choice(64, n, replace=False):
                g ^= 1 << int(b)
            fps.add(g)
    signed = np.array(sorted(fps), dtype=np.uint64)
    df = spark.createDataFrame([(int(x),) for x in signed.view(np.int64)], "fp long")
    got = [(r.a, r.b) for r in simhash.fingerprint_links(df, radius, tile).collect()]
    nodes = signed.view(np.int64).tolist()
    near = [(nodes[i], nodes[j]) for i in range(len(nodes)) for j in np.nonzero(np.bitwise_count(signed[i] ^ signed) <= radius)[0] if i < j]
    assert set(map(frozenset, got)) <= set(map(frozenset, near))  # true links only
    assert brute_components(nodes, got) == brute_components(nodes, near)


def test_dense_group_gives_a_forest():
    a = np.arange(0, 4, dtype=np.int64)
    b = np.array([x for x in range(256) if bin(x).count("1") <= 1], dtype=np.int64)
    links = simhash.linked_in(a, b, 8)
    assert len(links) <= len(a) + len(b)
    nodes = set(a.tolist()) | set(b.tolist())
    assert len(set(brute_components(nodes, links).values())) == 1


@pytest.mark.parametrize("links", [[], [(1, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)], [(5, 3), (3, 5), (9, 8), (None, 4), (7, 9), (2, 3)]])
def test_components(spark, links):
    df = spark.createDataFrame(links, "a long, b long")
    real = [(a, b) for a, b in links if a is not None and b is not None and a != b]
    want = brute_components({x for ab in real for x in ab}, real)
    assert {r.node: r.component for r in components.connected_components(df).collect()} == want
