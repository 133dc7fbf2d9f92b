"""Packing against brute force, its constraints and its edge cases."""

import random

import pytest
from rookery.llm import packing, queries

SF = "/root/testdata/sf0.001"


def brute_best_fit(items, capacity):
    bins, out = [], []
    for length, source, cluster in items:
        fit = [(capacity - b["used"], k) for k, b in enumerate(bins) if capacity - b["used"] >= length
               and (source is None or source not in b["sources"]) and (cluster is None or cluster not in b["clusters"])]
        k = min(fit)[1] if fit else len(bins)
        if not fit:
            bins.append({"used": 0, "sources": set(), "clusters": set()})
        out.append((k, bins[k]["used"]))
        bins[k]["used"] += length
        bins[k]["sources"].add(source)
        bins[k]["clusters"].add(cluster)
    return out


@pytest.mark.parametrize("seed", range(8))
def test_best_fit(seed):
    rng = random.Random(seed)
    items = sorted(((rng.randint(0, 50), rng.choice([None, "a", "a", "b", "c", "d", "e"]), rng.choice([None, *range(12)])) for _ in range(250)), key=lambda x: -x[0])
    assert packing.best_fit(items, 50) == brute_best_fit(items, 50)


def check(rows, lengths, capacity):
    """Pieces cover their documents; bins keep capacity and conflicts."""
    bins, docs = {}, {}
    for r in rows:
        bins.setdefault(r.bin_id, []).append(r)
        docs.setdefault(r.doc_id, []).append(r)
    for held in bins.values():
        held.sort(key=lambda r: (r.bin_offset, r.piece_tokens))
        at = 0
        for r in held:
            assert r.bin_offset == at
            at += r.piece_tokens
        assert at <= capacity
        for values in ([r.source for r in held if r.source is not None], [r.cluster for r in held if r.cluster is not None]):
            assert len(values) == len(set(values))
    got = {d: sorted((r.piece, r.piece_start, r.piece_tokens) for r in rs) for d, rs in docs.items()}
    want = {}
    for d, n in lengths.items():
        full = [(i, i * capacity, capacity) for i in range(n // capacity)]
        want[d] = full + ([(len(full), len(full) * capacity, n % capacity)] if n % capacity or not n else [])
    assert got == want


def test_query_on_the_test_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lengths = {r.doc_id: r.n for r in docs.select("doc_id", packing.token_length(docs.text).alias("n")).collect()}
    check(queries.op7_packing(spark, SF).collect(), lengths, packing.CAPACITY)


def test_shards_pack_as_brute_force_does(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ITEMS", 100)
    rng = random.Random(3)
    rows = [(i, rng.choice([0, 1, 5, rng.randint(0, 40), 95]), rng.choice(["hot"] * 5 + ["a", "b", None]), rng.choice([None, *range(9)])) for i in range(700)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, n_tokens long, source string, cluster long"), 40).collect()
    check(out, {r[0]: r[1] for r in rows}, 40)
    assert len({r.bin_id // packing.SHARD_BINS for r in out}) > 3
    shards = {}
    for r in out:
        shards.setdefault(r.bin_id // packing.SHARD_BINS, []).append(r)
    for shard, held in shards.items():
        rest = sorted((r for r in held if r.piece_tokens < 40 or not r.piece_tokens), key=lambda r: (-r.piece_tokens, r.doc_id))
        want = brute_best_fit([(r.piece_tokens, r.source, r.cluster) for r in rest], 40)
        assert [(r.bin_id - shard * packing.SHARD_BINS, r.bin_offset) for r in rest] == want


def test_near_duplicates_are_kept_apart(spark):
    docs = spark.createDataFrame([(i, f"word{i % 7} a b", None) for i in range(60)] + [(1, "word1 a b", None), (None, "x", None)], "doc_id long, text string, source string")
    groups = spark.createDataFrame([(i, 0 if i < 20 else None) for i in range(60)] + [(1, 0), (None, None)], "doc_id long, component_id long")
    out = packing.pack_documents(docs, 30, groups).collect()
    assert len(out) == 62
    held = [r.bin_id for r in out if r.doc_id is not None and r.doc_id < 20]
    assert len(held) == len(set(held)) == 21


def test_nulls_repeats_and_empty_table(spark):
    kind = "doc_id long, n_tokens long, source string, cluster long, bin_id string"
    rows = [(1, None, None, None, "x"), (None, 3, "s", 1, "x"), (2, -5, "s", 1, "x"), (4, 9, "s", 2, "x"), (4, 9, "s", 2, "x")]
    out = packing.pack(spark.createDataFrame(rows, kind), 4).collect()
    assert sorted((str(r.doc_id), r.piece_tokens) for r in out) == [("1", 0), ("2", 0), ("4", 1), ("4", 1), ("4", 4), ("4", 4), ("4", 4), ("4", 4), ("None", 3)]
    assert packing.pack(spark.createDataFrame([], kind), 4).collect() == []
    docs = spark.createDataFrame([(1, None, "s"), (2, "", "s"), (3, "One  two", "t"), (4, "one two", "u")], "doc_id long, text string, source string")
    got = {r.doc_id: (r.piece_tokens, r.bin_id) for r in packing.pack_documents(docs).collect()}
    assert [got[i][0] for i in (1, 2, 3, 4)] == [0, 0, 2, 2]
    assert got[3][1] != got[4][1]  # the same text but for case and space


def test_numbers_stay_exact_beside_nulls(spark):
    """Ids and clusters above 2**53 in one shard with null ids, null texts and null clusters."""
    ids = [9007199254740993, 9007199254740995, -9223372036854775807, None, 7]
    clusters = [-2167479932694485896, 4812870629301592785, 9223372036854775807, None, None]
    items = spark.createDataFrame([(d, 3, None, c) for d, c in zip(ids, clusters)] + [(None, None, "s", 9007199254740993)],
                                  "doc_id long, n_tokens long, source string, cluster long")
    out = packing.pack(items, 10).collect()
    assert sorted(((r.doc_id, r.cluster) for r in out), key=str) == sorted([*zip(ids, clusters), (None, 9007199254740993)], key=str)
    docs = spark.createDataFrame([(ids[0], "a b", "s"), (ids[1], None, None), (None, "c d", None)], "doc_id long, text string, source string")
    rows = {r.doc_id: r.cluster for r in packing.pack_documents(docs).collect()}
    text = {r.doc_id: r.c for r in docs.select("doc_id", packing.text_cluster(docs.text).alias("c")).collect()}
    assert rows == {ids[0]: text[ids[0]], ids[1]: None, None: text[None]}
