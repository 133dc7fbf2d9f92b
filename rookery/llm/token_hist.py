"""Token counts for every context limit, from one exact histogram of lengths.

Documents are aggregated by encoded length. Suffix sums over the histogram give,
for any context limit, how many documents and tokens lie above it and how many
tokens remain when texts are cut there; prefix sums give quantiles. The texts
are read once; everything else works on the distinct lengths.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import written

#: Neighbouring lengths that are summed together first.
BLOCK = 128


def encoded_lengths(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens): the length of every whole text under a byte-level BPE.

    ``ranks_path`` is a file of base64 tokens and ranks, ``pattern`` its splitting
    pattern; special tokens are ordinary text. A null text counts as empty.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            n = [len(encoding.encode_ordinary(t.as_py() or "")) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("n_tokens", T.LongType())]))


def histogram(lengths: DataFrame, column: str = "n_tokens") -> DataFrame:
    """Distinct lengths and how many documents have them: n_tokens, docs. Null lengths are left out."""
    return (lengths.select(F.col(column).cast("long").alias("n_tokens")).where("n_tokens is not null")
            .groupBy("n_tokens").agg(F.count(F.lit(1)).alias("docs")))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """The histogram with running sums, one row per distinct length L.

    docs, tokens           documents of length L and their tokens
    docs_from, tokens_from documents of length L or more and their tokens
    docs_upto              documents of length L or less
    truncated_tokens       tokens that remain when every text is cut at L
    quantile               share of documents of length L or less

    Sums run within blocks of neighbouring lengths first; only the block totals,
    one row per ``BLOCK`` lengths, are summed in one place.
    """
    rows = hist.select("n_tokens", "docs", (F.col("n_tokens") * F.col("docs")).alias("tokens"),
                       F.floor(F.col("n_tokens") / BLOCK).alias("block"))
    blocks = rows.groupBy("block").agg(F.sum("docs").alias("block_docs"), F.sum("tokens").alias("block_tokens"))
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    everything = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select("block", F.coalesce(F.sum("block_docs").over(above), zero).alias("docs_above"),
                           F.coalesce(F.sum("block_tokens").over(above), zero).alias("tokens_above"),
                           F.sum("block_docs").over(everything).alias("n_all"), F.sum("block_tokens").over(everything).alias("t_all"))
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    sums = (rows.withColumn("docs_from", F.sum("docs").over(inside)).withColumn("tokens_from", F.sum("tokens").over(inside))
            .join(blocks, "block")
            .withColumn("docs_from", F.col("docs_from") + F.col("docs_above"))
            .withColumn("tokens_from", F.col("tokens_from") + F.col("tokens_above")))
    upto = F.col("n_all") - F.col("docs_from") + F.col("docs")
    return sums.select("n_tokens", "docs", "tokens", "docs_from", "tokens_from", upto.alias("docs_upto"),
                       (F.col("t_all") - F.col("tokens_from") + F.col("n_tokens") * F.col("docs_from")).alias("truncated_tokens"),
                       (upto / F.col("n_all")).alias("quantile"))


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """For each context limit: documents and tokens above it, and the tokens left when cut there.

    Any limit is answered from the next longer length in the histogram: texts
    longer than the limit L are those from there on, and cutting leaves
    ``tokens - tokens_from + L * docs_from``.
    """
    spark = sums.sparkSession
    asked = spark.createDataFrame([(int(x),) for x in limits], "context long")
    total = sums.agg(F.sum("tokens")).scalar()
    # the given limits are few; the histogram has one row per distinct length
    longer = (sums.join(F.broadcast(asked), F.col("n_tokens") > F.col("context"))
              .groupBy("context").agg(F.max("docs_from").alias("docs_over"), F.max("tokens_from").alias("tokens_over")))
    out = asked.join(longer, "context", "left")
    over, tokens = F.coalesce("docs_over", F.lit(0)), F.coalesce("tokens_over", F.lit(0))
    return out.select("context", over.alias("docs_over"), tokens.alias("tokens_over"),
                      (F.coalesce(total, F.lit(0)) - tokens + F.col("context") * over).alias("truncated_tokens"))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """For each share the smallest length that at least this share of the documents does not exceed."""
    spark = sums.sparkSession
    asked = spark.createDataFrame([(float(x),) for x in shares], "share double")
    return (sums.join(F.broadcast(asked), F.col("quantile") >= F.col("share"))
            .groupBy("share").agg(F.min("n_tokens").alias("n_tokens")))


def token_counts(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``suffix_sums`` of the encoded lengths of a document table.

    A null or empty text has length 0; repeated rows count each; null ids do not
    matter. An empty table gives an empty table.
    """
    return suffix_sums(written(histogram(encoded_lengths(docs, ranks_path, pattern)), "token-histogram"))
