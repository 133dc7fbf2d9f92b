"""Approximate nearest neighbours by a hash-prefix forest.

Every vector gets a long string of hash bits per tree, the signs of its
projections on random directions. A tree is the sorted array of these strings.
A query descends each tree to the longest prefix it shares with an entry, then
ascends all trees together, one bit at a time, until the entries that share a
prefix of the current length are enough; their distances are computed exactly.

Rows are dealt by hash to shards of bounded size, each with a forest of its own,
and every query visits every shard: what a shard finds depends on its own rows
only, so that recall does not fall as the table grows, and a group of copies of
any size is spread over all shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .vectors import matrix, usable

TOP = 10
#: Rows of a shard on average; trees and bits of a forest; the share of a
#: shard's distinct vectors at which the ascent ends, and the least number.
SHARD_ROWS = 16_384
TREES, BITS = 48, 32
SHARE, LEAST = 0.5, 2_048
SEED = 7


class Forest:
    """Sorted hash strings of a set of distinct vectors, one array per tree."""

    def __init__(self, x: np.ndarray, trees: int = TREES, bits: int = BITS):
        self.x, self.trees, self.bits = x, trees, bits
        self.centre = x.mean(axis=0)
        self.directions = np.random.default_rng(SEED).standard_normal((x.shape[1], trees * bits))
        hashes = self.hashes(x)
        self.order = np.argsort(hashes, axis=0, kind="stable")
        self.sorted = np.ascontiguousarray(np.take_along_axis(hashes, self.order, axis=0).T)
        self.order = np.ascontiguousarray(self.order.T)

    def hashes(self, x: np.ndarray) -> np.ndarray:
        """One string of bits per row and tree, as an unsigned number."""
        out = np.empty((len(x), self.trees), dtype=np.uint64)
        weight = 1 << np.arange(self.bits - 1, -1, -1, dtype=np.uint64)
        for at in range(0, len(x), 2048):
            signs = (x[at:at + 2048] - self.centre) @ self.directions > 0
            out[at:at + 2048] = signs.reshape(-1, self.trees, self.bits).astype(np.uint64) @ weight
        return out

    def candidates(self, queries: np.ndarray, least: int) -> Iterator[np.ndarray]:
        """For each query the row numbers that the ascent ends with: ``least`` or more, if there are."""
        h = self.hashes(queries)
        low = np.zeros((self.bits + 1, self.trees, len(queries)), dtype=np.int32)
        high = np.zeros_like(low)
        for depth in range(self.bits + 1):
            rest = np.uint64((1 << (self.bits - depth)) - 1)
            for t in range(self.trees):
                low[depth, t] = np.searchsorted(self.sorted[t], h[:, t] & ~rest, "left")
                high[depth, t] = np.searchsorted(self.sorted[t], h[:, t] | rest, "right")
        total = (high - low).sum(axis=1)
        for q in range(len(queries)):
            # entries repeat over trees: no depth with fewer entries than ``least`` can do
            depth = int(np.flatnonzero(total[:, q] >= min(least, len(self.x)))[-1])
            seen = np.zeros(len(self.x), dtype=bool)
            while True:
                for t in range(self.trees):
                    seen[self.order[t, low[depth, t, q]:high[depth, t, q]]] = True
                if depth == 0 or np.count_nonzero(seen) >= least:
                    break
                depth -= 1
            yield np.flatnonzero(seen)


class Shard:
    """A forest over the distinct vectors of a shard, with the ids of their copies."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], np.ascontiguousarray(x[order] + 0.0)  # no -0.0
        raw = x.view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel()
        _, first, which = np.unique(raw, return_index=True, return_inverse=True)
        by_class = np.argsort(which, kind="stable")  # classes in turn, smaller ids first
        self.ids = ids[by_class]
        self.ends = np.cumsum(np.bincount(which, minlength=len(first)))
        self.forest = Forest(x[first])

    def nearest(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[int, int, float]]:
        """(query, row, distance) of the ``k`` nearest rows found for each query, nearest first."""
        x = self.forest.x
        least = max(LEAST, int(SHARE * len(x)))
        out = []
        for q, query, rows in zip(query_ids.tolist(), queries, self.forest.candidates(queries, least)):
            dist = np.sqrt(((x[rows] - query) ** 2).sum(axis=1))
            classes = k + 1
            while True:
                near = dist <= np.partition(dist, classes - 1)[classes - 1] if classes < len(rows) else np.ones(len(rows), dtype=bool)
                found = []
                for c, d in zip(rows[near].tolist(), dist[near].tolist()):
                    ids = self.ids[self.ends[c - 1] if c else 0:self.ends[c]]
                    own, after = np.searchsorted(ids, q, "left"), np.searchsorted(ids, q, "right")
                    first = ids[:min(own, k)].tolist()
                    found += [(d, i) for i in first + ids[after:after + k - len(first)].tolist()]
                # classes may hold no other rows than the query's own
                if len(found) >= k or classes >= len(rows):
                    break
                classes *= 2
            found.sort()
            out += [(q, i, d) for d, i in found[:k]]
        return out


def _search(k: int):
    def answered(batch_rows: list[tuple[int, int, float]]) -> pa.RecordBatch:
        q, i, d = zip(*batch_rows)
        return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(d, pa.float64())], names=["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come sorted by (shard, width, kind): a shard's entries, then the queries that visit it
        group, ids, held, shard = None, [], [], None
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(3)])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                key, kind, width = tuple(keys[:2, a]), keys[2, a], int(keys[1, a])
                if key != group:
                    group, ids, held, shard = key, [], [], None
                x = matrix(part.column(4), width)
                if kind == 0:
                    ids.append(part.column(3).to_numpy())
                    held.append(x)
                    continue
                if not held:
                    continue
                shard = shard or Shard(np.concatenate(ids), np.concatenate(held))
                query_ids = part.column(3).to_numpy()
                for at in range(0, len(x), 512):
                    rows = shard.nearest(query_ids[at:at + 512], x[at:at + 512], k)
                    if rows:
                        yield answered(rows)
    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """The ``k`` nearest rows found of ``vectors`` for every row of ``queries``.

    Both have vec_id and embedding. Returns query_id, rank (from 1), vec_id and
    score, the Euclidean distance in double precision; nearest first, ties to the
    smaller vec_id; rows with the query's own vec_id are not among them. A query
    that finds fewer rows than ``k`` returns those it finds.

    Vectors that are null, empty, zero or hold null or non-finite components, and
    rows without vec_id, take no part on either side; vectors of another length
    than the query's are not compared with it. Equal vectors are one entry of
    the forest, whose rows are all found. Repeated rows of ``vectors`` repeat in
    the result, repeated queries are asked once. Empty tables give an empty
    table. Other columns are not read.
    """
    valid = lambda df: (df.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
                        .where(usable("embedding") & F.col("vec_id").isNotNull()))
    entries = valid(vectors)
    shards = max(1, -(-entries.count() // SHARD_ROWS))
    dealt = entries.select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), F.size("embedding").alias("width"),
                           F.lit(0).alias("kind"), "vec_id", "embedding")
    asked = (valid(queries).dropDuplicates(["vec_id"])
             .select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.size("embedding").alias("width"),
                     F.lit(1).alias("kind"), "vec_id", "embedding"))
    visits = dealt.union(asked).repartition(4 * shards, "shard").sortWithinPartitions("shard", "width", "kind")
    found = visits.mapInArrow(_search(k), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
