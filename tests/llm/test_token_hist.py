"""Token counts against brute force."""

import base64

import numpy as np
import public_tokenizers
import tiktoken
from rookery.llm import queries, token_hist

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def check(rows, lengths):
    n = np.array(lengths)
    assert sorted(r.n_tokens for r in rows) == sorted(set(lengths))
    for r in rows:
        x = r.n_tokens
        assert (r.docs, r.tokens) == ((n == x).sum(), x * (n == x).sum())
        assert (r.docs_from, r.tokens_from, r.docs_upto) == ((n >= x).sum(), n[n >= x].sum(), (n <= x).sum())
        assert r.truncated_tokens == np.minimum(n, x).sum()
        assert abs(r.quantile - (n <= x).mean()) < 1e-12


def test_query_on_the_test_table(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check(queries.op8_token_counts(spark, SF).collect(), [len(e.encode_ordinary(t)) for t in texts])


def test_sums_limits_and_quantiles(spark):
    lengths = [0, 0, 1, 5, 5, 5, 1023, 1024, 1025, 4096, 5000, 5000, 100_000]
    df = spark.createDataFrame([(x,) for x in lengths] + [(None,)], "n_tokens long")
    sums = token_hist.suffix_sums(token_hist.histogram(df)).cache()
    check(sums.collect(), lengths)
    limits = [0, 1, 4, 5, 6, 1024, 4999, 5000, 99_999, 100_000, 10**9]
    got = {r.context: (r.docs_over, r.tokens_over, r.truncated_tokens) for r in token_hist.at_limits(sums, limits).collect()}
    n = np.array(lengths)
    assert got == {x: ((n > x).sum(), n[n > x].sum(), np.minimum(n, x).sum()) for x in limits}
    shares = [0.0, 0.1, 0.5, 0.9, 1.0]
    got = {r.share: r.n_tokens for r in token_hist.quantiles(sums, shares).collect()}
    assert got == {s: min(x for x in lengths if (n <= x).mean() >= s) for s in shares}


def test_nulls_repeats_and_empty_table(spark):
    docs = spark.createDataFrame([(1, None, 0), (None, "", 0), (2, "Hello world", 0), (2, "Hello world", 0), (3, "<|endoftext|>", 0)], "doc_id long, text string, n_tokens int")
    rows = token_hist.token_counts(docs, RANKS, public_tokenizers.PATTERN).collect()
    assert [(r.n_tokens, r.docs) for r in sorted(rows, key=lambda r: r.n_tokens)][:2] == [(0, 2), (2, 2)]
    empty = spark.createDataFrame([], "doc_id long, text string")
    sums = token_hist.token_counts(empty, RANKS, public_tokenizers.PATTERN)
    assert sums.collect() == []
    assert [tuple(r) for r in token_hist.at_limits(sums, [8]).collect()] == [(8, 0, 0, 0)]
