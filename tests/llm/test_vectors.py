"""Embedding near-dedup and nearest neighbours against brute force."""

import math

import numpy as np
import pytest
from rookery.llm import ann_forest, embed_dedup, queries

SF = "/root/testdata/sf0.1"
KIND = "vec_id long, embedding array<float>, label int, n_links string"


def brute_links(rows, threshold=0.98):
    """vec_id -> (links, component) of (vec_id, vector, label) rows with distinct ids."""
    def usable(v):
        return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)

    links = {i: set() for i, _, _ in rows}
    for a, (i, v, p) in enumerate(rows):
        for j, w, q in rows[:a]:
            if p is None or p != q or not usable(v) or not usable(w) or len(v) != len(w):
                continue
            x, y = np.array(v, dtype=np.float64), np.array(w, dtype=np.float64)
            if x @ y / math.sqrt((x @ x) * (y @ y)) >= threshold:
                links[i].add(j)
                links[j].add(i)
    out = {}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[i] = (len(links[i]), min(seen))
    return out


def clustered(n=220, width=6, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((9, width))
    out = []
    for i in range(n):
        v = centres[rng.integers(9)] + rng.standard_normal(width) * rng.choice([0.02, 0.08, 0.3])
        out.append((i, np.float32(v * rng.uniform(0.1, 9)).tolist(), int(rng.integers(3))))
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_links_of_clusters(spark, monkeypatch, seed):
    monkeypatch.setattr(embed_dedup, "BLOCK_ROWS", 16)
    monkeypatch.setattr(embed_dedup, "LEAF_ROWS", 4)
    rows = clustered(seed=seed)
    df = spark.createDataFrame([(*r, "x") for r in rows], KIND)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.near_duplicates(df).collect()}
    want = brute_links(rows)
    assert got == want and max(n for n, _ in want.values()) > 3


def test_sequence_join_in_parts():
    rng = np.random.default_rng(4)
    u = embed_dedup.unit(rng.standard_normal((400, 3)))
    cells = np.floor(u / 0.2).astype(np.int32)
    order = np.lexsort(cells.T[::-1])
    u, cells = u[order], cells[order]
    i, j = embed_dedup.sequence_join(u, u, cells, cells, 0.98, True)
    a, b = np.nonzero(np.triu(u @ u.T >= 0.98, 1))
    assert sorted(zip(i.tolist(), j.tolist())) == sorted(zip(a.tolist(), b.tolist()))


def test_copies_nulls_and_odd_vectors(spark):
    v, w = [1.0, 2.0, 3.0], [3.0, -1.0, 0.5]
    rows = [(5, v, 1), (3, [2.0, 4.0, 6.0], 1), (9, v, 1), (9, v, 1), (4, v, 2), (6, v, None), (7, None, 1), (8, [0.0, 0.0, 0.0], 1), (10, [1.0, None, 3.0], 1),
            (11, [1.0, float("nan"), 3.0], 1), (12, [float("inf"), 2.0, 3.0], 1), (13, [], 1), (14, [1.0, 2.0], 1), (None, v, 1), (2, w, 1)]
    df = spark.createDataFrame([(*r, None) for r in rows], KIND)
    got = sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in embed_dedup.near_duplicates(df).collect())
    alone = [(i, 0, i, True) for i in (4, 6, 7, 8, 10, 11, 12, 13, 14, 2)]
    linked = [(5, 3, 3, False), (3, 3, 3, True), (9, 3, 3, False), (9, 3, 3, False)]
    assert got == sorted([(str(i), n, c, k) for i, n, c, k in alone + linked] + [("None", 0, None, True)])


def test_huge_components_do_not_overflow(spark):
    df = spark.createDataFrame([(1, [1e300, 1e300], 1), (2, [1e300, 1.0001e300], 1), (3, [1e-300, -1e-300], 1)], "vec_id long, embedding array<double>, label int")
    assert {r.vec_id: r.component_id for r in embed_dedup.near_duplicates(df).collect()} == {1: 1, 2: 1, 3: 3}


def test_dedup_query_on_the_test_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = {r.vec_id: (r.n_links, r.component_id) for r in queries.op4_embedding_dedup(spark, sf).collect()}
    assert got == brute_links(rows)


def test_sql_of_the_dedup_query():
    import duckdb
    rows = clustered(seed=2) + [(1000, None, 1), (1001, [0.0] * 6, 1), (1002, [float("nan")] * 6, 1), (1003, [1.0] * 6, None)]
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INTEGER)")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", rows)
    got = {i: (n, c) for i, n, c, _ in con.execute(queries.ORACLE["op4_embedding_dedup"]).fetchall()}
    assert got == brute_links(rows)


def brute_nearest(rows, query, k):
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], dtype=np.float64)
    q = x[np.flatnonzero(ids == query)[0]]
    d = np.sqrt(((x - q) ** 2).sum(axis=1))
    ok = ids != query
    order = np.lexsort((ids[ok], d[ok]))[:k]
    return list(zip(ids[ok][order].tolist(), d[ok][order].tolist()))


def test_recall_on_the_test_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = {}
    for r in queries.op9_ann(spark, SF).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    asked = [i for i, _ in rows if i % 100 == 0]
    assert sorted(got) == sorted(asked)
    hit = 0
    for q in asked:
        want = brute_nearest(rows, q, 10)
        assert [r for r, _, _ in got[q]] == list(range(1, 11))
        assert [(i, s) for _, i, s in got[q]] == sorted(((i, s) for _, i, s in got[q]), key=lambda x: (x[1], x[0]))
        hit += len({i for i, _ in want} & {i for _, i, _ in got[q]})
    assert hit / (10 * len(asked)) >= 0.9


def test_ascent_ends_with_enough():
    x = np.random.default_rng(0).standard_normal((500, 8))
    forest = ann_forest.Forest(x, trees=6, bits=12)
    for q, rows in zip(x[:20], forest.candidates(x[:20], 60)):
        assert len(rows) >= 60 and any((x[r] == q).all() for r in rows)
    assert all(len(rows) == 500 for rows in forest.candidates(x[:3], 10**9))


def test_shards_ties_and_copies(spark, monkeypatch):
    monkeypatch.setattr(ann_forest, "SHARD_ROWS", 40)  # every shard is searched whole below LEAST
    rng = np.random.default_rng(1)
    rows = [(i, np.float32(rng.standard_normal(4)).tolist()) for i in range(150)]
    rows += [(200 + i, rows[7][1]) for i in range(60)] + [(300 + i, [1.0, 1.0, 0.0, 0.0]) for i in range(3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in ann_forest.search(df, df.where("vec_id % 25 = 0 or vec_id = 7")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    for q, found in got.items():
        want = brute_nearest(rows, q, 10)
        assert [i for i, _ in found] == [i for i, _ in want]
        assert np.allclose([s for _, s in found], [s for _, s in want], rtol=1e-14, atol=0)
    assert [i for i, _ in got[7]] == list(range(200, 210))


def test_repeated_rows_of_the_query_hide_no_copies():
    same, far = [1.0, 0.0], [[0.0, float(i)] for i in range(1, 21)]
    ids = np.array([7] * 25 + list(range(200, 260)) + list(range(300, 320)))
    shard = ann_forest.Shard(ids, np.array([same] * 85 + far))
    assert shard.nearest(np.array([7]), np.array([same]), 10) == [(7, i, 0.0) for i in range(200, 210)]
    # the query's id with many vectors of its own
    own = [[1.0, i / 100] for i in range(30)]
    shard = ann_forest.Shard(np.array([7] * 30 + list(range(300, 320))), np.array(own + far))
    assert [i for _, i, _ in shard.nearest(np.array([7]), np.array([same]), 10)] == list(range(300, 310))


def test_few_candidates_nulls_and_empty(spark):
    kind = "vec_id long, embedding array<float>, score string"
    rows = [(0, [1.0, 0.0], "x"), (100, [0.0, 2.0], None), (3, [0.0, 0.0], "x"), (4, None, "x"), (5, [1.0, None], "x"), (6, [float("nan"), 1.0], "x"),
            (None, [1.0, 1.0], "x"), (7, [1.0, 2.0, 3.0], "x"), (8, [1.0, 1.0], "x"), (0, [1.0, 0.0], "x")]
    df = spark.createDataFrame(rows, kind)
    got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 12)) for r in ann_forest.search(df, df.where("vec_id % 100 = 0")).collect())
    far = round(math.sqrt(5), 12)
    assert got == [(0, 1, 8, 1.0), (0, 2, 100, far), (100, 1, 8, round(math.sqrt(2), 12)), (100, 2, 0, far), (100, 3, 0, far)]
    empty = spark.createDataFrame([], kind)
    assert ann_forest.search(empty, empty).collect() == []
    assert ann_forest.search(df, empty).collect() == []
    assert embed_dedup.near_duplicates(spark.createDataFrame([], KIND)).collect() == []
