"""Phrase collocations against brute force and SQL, and their edge cases."""

import random
import re
from collections import Counter

import pytest
from rookery.llm import phrases, queries
from rookery.plans.verify import compare

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, lang string, text string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, support=100, longest=5, top=2000):
    f, n = Counter(), Counter()
    for _, lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i:i + k])] += 1
    cand = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= support}
    out = []
    for (lang, words), a in cand.items():
        k = len(words)
        if any(l2 == lang and len(w2) > k and b >= a and any(w2[i:i + k] == words for i in range(len(w2) - k + 1)) for (l2, w2), b in cand.items()):
            continue
        score, _, l, r = min((1000 * a * n[lang] // (f[lang, words[:c]] * f[lang, words[c:]]), c, f[lang, words[:c]], f[lang, words[c:]]) for c in range(1, k))
        out.append((lang, " ".join(words), a, l, r, n[lang], score))
    out.sort(key=lambda x: (x[0], -x[6], -x[2], x[1].encode()))
    ranks = Counter()
    res = []
    for x in out:
        ranks[x[0]] += 1
        if ranks[x[0]] <= top:
            res.append((x[0], ranks[x[0]], *x[1:]))
    return res


def found(spark, rows, **kw):
    df = phrases.collocations(spark.createDataFrame(rows, SCHEMA), **kw)
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def corpus(seed, docs=120):
    rng = random.Random(seed)
    words = ["a", "B", "c", "dé", "É", "x y", "-", "f"]
    return [(i, rng.choice(["en", "en", "de", None, "und"]),
             "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\r\n", "!?"]) for _ in range(rng.randint(0, 60))))
            for i in range(docs)]


@pytest.mark.parametrize("kw", [{"support": 5}, {"support": 12, "chunk_words": 50, "part_words": 100}, {"support": 3, "shards": 3, "chunk_words": 100, "longest": 4},
                                {"support": 7, "longest": 2}, {"support": 4, "top": 7}])
def test_against_brute_force(spark, kw):
    rows = corpus(1)
    want = brute(rows, kw["support"], kw.get("longest", 5), kw.get("top", 2000))
    assert want and found(spark, rows, **kw) == sorted(want)


def test_query_against_brute_force(spark):
    rows = [(r.doc_id, r.lang, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in queries.op11_phrases(spark, SF).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert got == sorted(brute(rows))


def test_query_against_sql(spark, duck):
    got = queries.op11_phrases(spark, "/root/testdata/sf0.01")
    assert [t for c, t in got.dtypes if c not in ("lang", "phrase")] == ["bigint"] * 6
    assert compare(got.toPandas(), duck.execute(queries.ORACLE["op11_phrases"]).df()) == []


def test_long_text_is_split_at_ends_of_pieces_only(monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK", 16)
    blocks = list(phrases.words_and_ends(b"one two three four five six seven. Eight nine! ten"))
    assert blocks == [[b"one", b"two", b"three", b"four", b"five", b"six", b"seven", b"."], [b"eight", b"nine", b".", b"ten"]]


def test_very_long_text_and_repeated_rows(spark):
    rows = [(1, "en", "red fox " * 50_000), (1, "en", "red fox " * 50_000), (2, "en", "red fox")]
    got = found(spark, rows, longest=3)
    assert got == sorted(brute(rows, longest=3)) and len(got) == 3


def test_exact_scores_beyond_64_bits(spark):
    found = spark.createDataFrame([("en", "a", 1, 3_000_000_007), ("en", "b", 1, 2_000_000_011), ("en", "a b", 2, 1_999_999_999)], "lang string, phrase string, k int, a long")
    sizes = spark.createDataFrame([("en", 9_000_000_000_000_001)], "lang string, n long")
    row = phrases.scored(found, sizes).first()
    assert row.score == 1000 * 1_999_999_999 * 9_000_000_000_000_001 // (3_000_000_007 * 2_000_000_011)


def test_empty_null_and_clashing_columns(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, "en", None), (2, None, ""), (None, "de", ". , !")]) == []
    rows = [(None, None, "to be " * 3), (3, "und", "to be")]
    df = spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], SCHEMA + ", chunk int, phrase string, n int, score int")
    got = sorted(tuple(r) for r in phrases.collocations(df, support=2, longest=2).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert got == sorted(brute(rows, 2, 2))


def test_chunks_are_not_moved(spark):
    """The joins that bring kept places back to the chunks leave these where they are."""
    docs = spark.createDataFrame(corpus(3), SCHEMA).repartition(5)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        chunks = phrases.bucketed(phrases.chunked(docs, 100), "chunk", 5, phrases.fresh_path(spark, "t-chunks"))
        rows = chunks.select("chunk", phrases.F.lit(0).alias("part"), phrases.F.lit(b"").alias("at"))
        joined = chunks.join(phrases._back(rows, "a", 5), "chunk").join(phrases._back(rows, "b", 5), "chunk")
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "codes" in plan and not [line for line in plan.splitlines() if "Exchange" in line and "codes" in line]
    assert plan.count("Bucketed: true") >= 1 and joined.count() == chunks.count()
    assert spark.sql("SHOW TABLES").count() == 0
