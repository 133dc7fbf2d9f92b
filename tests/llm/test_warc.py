"""WARC files: bytes, rolling, revisits and the way back."""

import gzip
import hashlib
import os

import duckdb
import pytest
from rookery.llm import queries, warc
from rookery.session import fresh_path

SF = "/root/testdata/sf0.01"
KIND = "page_id long, url string, html string, digest string"
LONG = "<p>" + "long enough to be stored once " * 5


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], KIND)


def brute(rows):
    first = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 100 and i is not None:
            first[b] = min(first.get(b, i), i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        to = first.get(b)
        to = None if to == i else to
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


ROWS = [(1, "http://a/1", LONG), (2, "http://a/2", LONG), (3, None, None), (4, "http://a/4", ""), (5, "u\r\nX: y", "short"), (6, "u", "short"), (None, "n", LONG),
        (0, "http://é/字", "é字" * 60), (7, "v", "é字" * 60), (1, "http://a/1", LONG), (None, "n", "another page without an id " * 9), (8, "w", "x\r\n\r\ny" * 40)]


def test_round_trip_with_nulls_repeats_and_clashes(spark):
    got = warc.round_trip(pages(spark, ROWS))
    rows = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()), key=str)
    assert rows == brute(ROWS)
    payloads = {r.page_id: bytes(r.payload) for r in got.where("record_type = 'response' and page_id is not null").collect()}
    assert payloads[0] == ("é字" * 60).encode() and payloads[3] == b"" and payloads[8] == b"x\r\n\r\ny" * 40


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{SF}/pages.parquet')")
    want = con.execute(queries.ORACLE["op5_warc"]).fetchall()
    got = [tuple(r) for r in queries.op5_warc(spark, SF).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_files_roll_are_listed_and_the_same_every_time(spark):
    rows = [(i, f"http://h/{i}", f"page {i} " * 40 if i % 3 else LONG) for i in range(60)]
    seen = []
    for _ in range(2):
        folder = fresh_path(spark, "warc-test")
        manifest = warc.write(pages(spark, rows), folder, roll_bytes=4000).orderBy("name").collect()
        assert len(manifest) > 3 and sum(m.records for m in manifest) == 60
        assert sorted(os.listdir(f"{folder}/data")) == [m.name for m in manifest] and os.listdir(f"{folder}/temporary") == []
        for m in manifest:
            data = open(f"{folder}/data/{m.name}", "rb").read()
            assert (len(data), hashlib.sha256(data).hexdigest()) == (m.bytes, m.sha256)
            assert gzip.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
        assert all(a.last_page < b.first_page for a, b in zip(manifest, manifest[1:]))
        seen.append([(m.name, m.sha256) for m in manifest])
        # a file that no manifest lists is not read
        open(f"{folder}/data/part-999999-00000.warc.gz", "wb").write(b"left over")
        assert warc.read(spark, folder).count() == 60
    assert seen[0] == seen[1]


def test_shards_by_bytes(spark):
    """Ends of shards follow sizes; pages without an id and revisits fall into their places."""
    big = "<p>" + "x y z " * 4000
    rows = [(i, f"http://h/{i}", big + str(i) if i % 10 == 0 else LONG if i % 3 else f"p{i}" * 30) for i in range(120)] + [(None, f"n{i}", big + "n") for i in range(8)]
    folder = fresh_path(spark, "warc-test")
    manifest = warc.write(pages(spark, rows), folder, range_bytes=50_000).orderBy("name").collect()
    assert len({m.name[:11] for m in manifest}) > 4
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read(spark, folder).collect()), key=str)
    assert got == brute(rows)
    ends = [(m.first_page, m.last_page) for m in manifest if m.first_page is not None]
    assert all(a[1] < b[0] for a, b in zip(ends, ends[1:]))


def test_a_file_of_a_dead_attempt_is_replaced(spark):
    folder = fresh_path(spark, "warc-test")
    os.makedirs(f"{folder}/data")
    os.makedirs(f"{folder}/temporary")
    open(f"{folder}/data/part-000000-00000.warc.gz", "wb").write(b"half")
    open(f"{folder}/temporary/part-000000-00000.warc.gz.99", "wb").write(b"half")
    warc.write(pages(spark, ROWS), folder)
    assert warc.read(spark, folder).count() == len(ROWS) and os.listdir(f"{folder}/temporary") == []


def test_one_very_large_payload(spark):
    text = "".join(chr(97 + i % 26) for i in range(1 << 16)) * 512     # 32 MB
    rows = [(1, "u", text), (2, "v", text), (3, "w", "small")]
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages(spark, rows), payloads=False).collect()), key=str)
    assert got == brute(rows)


def test_damage_is_found(spark):
    folder = fresh_path(spark, "warc-test")
    name = warc.write(pages(spark, ROWS), folder).first().name
    data = gzip.decompress(open(f"{folder}/data/{name}", "rb").read())
    for damaged in (data.replace(b"stored once", b"stored ONCE", 1), data[:-30]):
        open(f"{folder}/data/{name}", "wb").write(gzip.compress(damaged))
        with pytest.raises(Exception, match="digest|cut off"):
            warc.read(spark, folder).collect()


def test_empty_table(spark):
    assert warc.round_trip(pages(spark, [])).collect() == []
