"""Best-fit packing of documents into training windows under conflicts.

Every window (bin) holds at most ``capacity`` tokens, at most one document of a
source and at most one of a duplicate cluster. Items are dealt by hash to shards
of bounded size and packed there by best-fit decreasing: bins are kept in the
order of their residuals and carry a bitmap of the sources and one of the
clusters they hold; from the first bin that has room the successor search goes
on until a bin without conflict is found, which is the tightest compatible one.

Dealing by hash keeps the work even when one source or cluster holds a large
part of all rows: its documents spread over all shards.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import written

CAPACITY = 2048
#: A shard is dealt this many tokens and items on average, whichever is reached first.
SHARD_TOKENS, SHARD_ITEMS = 1 << 20, 2048
#: Bins of one shard are numbered below this.
SHARD_BINS = 1 << 32

Item = tuple[int, object, object]  # length, source, cluster


def best_fit(items: list[Item], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset in it) of each item; items come longest first and none exceeds ``capacity``.

    A null source or cluster conflicts with nothing.
    """
    source_bit: dict[object, int] = {}
    cluster_bit: dict[object, int] = {}
    order: list[tuple[int, int]] = []  # (residual, bin), ascending
    sources: list[int] = []
    clusters: list[int] = []
    out = []
    for length, source, cluster in items:
        s = 0 if source is None else 1 << source_bit.setdefault(source, len(source_bit))
        c = 0 if cluster is None else 1 << cluster_bit.setdefault(cluster, len(cluster_bit))
        at = bisect_left(order, (length, -1))
        while at < len(order) and (sources[order[at][1]] & s or clusters[order[at][1]] & c):
            at += 1
        if at < len(order):
            residual, k = order.pop(at)
        else:
            residual, k = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        out.append((k, capacity - residual))
        sources[k] |= s
        clusters[k] |= c
        insort(order, (residual - length, k))
    return out


def token_length(text):
    """Tokens of a text: words, and signs one by one; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"(?U)\w+|[^\w\s]")), F.lit(0))


def text_cluster(text):
    """A cluster number for texts that are equal but for case and white space."""
    return F.xxhash64(F.lower(F.trim(F.regexp_replace(text, r"\s+", " "))))


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pack ``items`` (doc_id, n_tokens, source, cluster) into bins.

    Returns doc_id, piece, piece_start, piece_tokens, source, cluster, bin_id and
    bin_offset. A document longer than ``capacity`` is cut: its full pieces have
    bins of their own, the rest is packed like a document. A document of 0
    tokens is packed as well, into one row of 0 tokens. Nothing is dropped: the
    pieces of a document cover it. Null or negative lengths count as 0. Null
    sources and clusters conflict with nothing. Repeated rows are packed as
    often as they come. An empty table gives an empty table.
    """
    items = items.select(F.col("doc_id").cast("long"), F.greatest(F.coalesce("n_tokens", F.lit(0)), F.lit(0)).cast("long").alias("n_tokens"),
                         F.col("source").cast("string"), F.col("cluster").cast("long"))
    n, tokens = items.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    shards = max(1, -(-tokens // SHARD_TOKENS), -(-n // SHARD_ITEMS))
    dealt = items.withColumn("shard", F.pmod(F.xxhash64("doc_id", "n_tokens", "cluster"), F.lit(shards)).cast("long"))

    def run(group: pa.Table) -> pa.Table:
        shard = group["shard"][0].as_py()
        columns = [group[c].to_pylist() for c in ("doc_id", "n_tokens", "source", "cluster")]  # nulls and 64-bit numbers as they are
        full, rest = [], []
        for doc, length, source, cluster in sorted(zip(*columns), key=lambda r: [(x is None, x) for x in r]):
            whole = length // capacity
            full += [(doc, p, p * capacity, capacity, source, cluster) for p in range(whole)]
            if length % capacity or not length:
                rest.append((doc, whole, whole * capacity, length % capacity, source, cluster))
        rest.sort(key=lambda r: -r[3])  # stable: ties stay in the order of the documents
        bins = best_fit([(r[3], r[4], r[5]) for r in rest], capacity)
        first = shard * SHARD_BINS
        free = first + 1 + max((k for k, _ in bins), default=-1)
        rows = [(*r, first + k, at) for r, (k, at) in zip(rest, bins)] + [(*r, free + i, 0) for i, r in enumerate(full)]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int64()), ("piece_start", pa.int64()), ("piece_tokens", pa.int64()),
                        ("source", pa.string()), ("cluster", pa.int64()), ("bin_id", pa.int64()), ("bin_offset", pa.int64())])
    kind = "doc_id long, piece long, piece_start long, piece_tokens long, source string, cluster long, bin_id long, bin_offset long"
    return dealt.groupBy("shard").applyInArrow(run, kind)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, groups: DataFrame | None = None) -> DataFrame:
    """Pack a document table: lengths and clusters are taken from ``text``.

    ``groups`` (doc_id, component_id) gives the clusters of near-duplicate
    documents; a document without a group has its text for a cluster. The
    lengths and clusters are written once, so that the texts are read once.
    """
    text = F.col("text")
    items = docs.select("doc_id", "source", token_length(text).alias("n_tokens"),
                        F.when(text.isNotNull(), text_cluster(text)).alias("cluster"))
    items = written(items, "packing-items")
    if groups is not None:
        near = groups.groupBy("doc_id").agg(F.min("component_id").alias("near"))
        items = items.join(near, "doc_id", "left").withColumn("cluster", F.coalesce("near", "cluster"))
        items = written(items, "packing-clusters")
    return pack(items, capacity)
