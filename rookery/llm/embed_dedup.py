"""Embedding near-duplicates by an epsilon grid order join.

Two unit vectors with a cosine of at least t lie within eps = sqrt(2 - 2 t) of
each other, and no rotation or projection moves them further apart. Vectors are
rotated to their principal dimensions, laid on a grid of cells eps wide over the
leading ones and sorted by cell. Blocks are intervals of that sequence. Two
blocks are joined only if their cells lie within one of each other in every
grid dimension; inside a pair of blocks the intervals are halved recursively,
skipping halves that are provably distant, down to small matrix products. Blocks
that follow each other are compared in one place, a super-block: a block travels
once to each super-block that it has to meet, and not once for every pair.

The rotation is fitted on a bounded sample. It decides how much is skipped,
never what is found: any orthonormal rotation gives the same links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components, spanning_forest
from .tables import written
from .vectors import usable

THRESHOLD = 0.98
#: Leading principal dimensions on the grid; the first two also choose the blocks to join.
GRID_DIMS, KEY_DIMS = 8, 2
#: Rows of a block, and of an interval that is compared as a whole.
BLOCK_ROWS, LEAF_ROWS = 512, 128
#: A super-block has 2 to the power of this blocks.
SUPER_BITS = 4
#: Vectors from which rotations are fitted, and their components in all.
SAMPLE_ROWS, SAMPLE_VALUES = 4096, 1 << 20
#: Cosines this near the threshold are computed anew with exact sums.
CLOSE = 1e-12


def rotations(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Leading principal axes for each length of vectors, from a bounded sample."""
    widest = vectors.agg(F.max(F.size("embedding"))).first()[0] or 1
    rows = max(64, min(SAMPLE_ROWS, SAMPLE_VALUES // widest))
    sample = (vectors.select("embedding", F.size("embedding").alias("width"), F.xxhash64("embedding").alias("h"))
              .orderBy("h").limit(rows).collect())
    out: dict[int, np.ndarray] = {}
    for width in {r.width for r in sample}:
        u = unit(np.array([r.embedding for r in sample if r.width == width], dtype=np.float64))
        _, axes = np.linalg.eigh((u - u.mean(0)).T @ (u - u.mean(0)))
        out[width] = axes[:, ::-1][:, :GRID_DIMS]
    return out


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # else a square may overflow
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _exact_cosine(a: np.ndarray, b: np.ndarray) -> float:
    a, b = a / np.abs(a).max(), b / np.abs(b).max()
    dot = math.fsum((a * b).tolist())
    return dot / math.sqrt(math.fsum((a * a).tolist()) * math.fsum((b * b).tolist()))


def sequence_join(ua: np.ndarray, ub: np.ndarray, ca: np.ndarray, cb: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs (i, j) of two intervals in grid order whose cosine reaches the threshold.

    ``ca`` and ``cb`` are their cells. Both intervals are halved as long as they
    are large; a pair of halves is skipped when their cells are more than one
    apart in some dimension. ``same``: both are one interval; pairs i < j only.
    """
    left, right = [], []
    todo = [(0, len(ua), 0, len(ub))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if a0 >= a1 or b0 >= b1 or same and b1 <= a0:
            continue
        pa_, pb_ = ca[a0:a1], cb[b0:b1]
        if (pa_.min(0) - pb_.max(0) > 1).any() or (pb_.min(0) - pa_.max(0) > 1).any():
            continue
        if a1 - a0 <= LEAF_ROWS and b1 - b0 <= LEAF_ROWS:
            cos = ua[a0:a1] @ ub[b0:b1].T
            i, j = np.nonzero(cos >= threshold - CLOSE)
            for k in np.nonzero(cos[i, j] < threshold + CLOSE)[0]:
                if _exact_cosine(ua[a0 + i[k]], ub[b0 + j[k]]) < threshold:
                    i[k] = -1
            ok = i >= 0
            i, j = i[ok] + a0, j[ok] + b0
            if same:
                i, j = i[i < j], j[i < j]
            left.append(i)
            right.append(j)
            continue
        am, bm = (a0 + a1) // 2, (b0 + b1) // 2
        halves_a = [(a0, am), (am, a1)] if a1 - a0 > LEAF_ROWS else [(a0, a1)]
        halves_b = [(b0, bm), (bm, b1)] if b1 - b0 > LEAF_ROWS else [(b0, b1)]
        todo += [(*x, *y) for x in halves_a for y in halves_b]
    empty = np.zeros(0, dtype=np.int64)
    return (np.concatenate(left) if left else empty), (np.concatenate(right) if right else empty)


def _blocks():
    schema = pa.schema([("block", pa.int64()), ("label", pa.int64()), ("width", pa.int32()), ("key", pa.list_(pa.int32())),
                        ("low", pa.list_(pa.int32())), ("high", pa.list_(pa.int32())),
                        ("ids", pa.list_(pa.int64())), ("copies", pa.list_(pa.int64())), ("vectors", pa.binary()), ("cells", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        held: list[tuple] = []
        held_key = None

        def closed() -> pa.RecordBatch:
            nonlocal number
            label, width, key = held_key
            cells = np.array([h[2] for h in held], dtype=np.int32)
            batch = pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(
                (number, label, width, list(key), cells.min(0).tolist(), cells.max(0).tolist(), [h[0] for h in held], [h[1] for h in held],
                 np.array([h[3] for h in held]).tobytes(), cells.tobytes()), schema)], schema=schema)
            number += 1
            held.clear()
            return batch

        for batch in batches:
            ids, copies, labels, cells = (batch.column(i).to_pylist() for i in range(4))
            for k, vector in enumerate(batch.column(4)):
                v = np.asarray(vector.values, dtype=np.float64)
                key = (labels[k], len(v), tuple(cells[k][:KEY_DIMS]))
                if held and (key != held_key or len(held) >= BLOCK_ROWS):
                    yield closed()
                held_key = key
                held.append((ids[k], copies[k], cells[k], v))
        if held:
            yield closed()

    return run


def _cells(axes: dict[int, np.ndarray], eps: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = []
            for v in batch.column(batch.schema.get_field_index("embedding")):
                u = unit(np.asarray(v.values, dtype=np.float64)[None, :])[0]
                # a length that the sample missed: its own first dimensions
                own = axes.get(len(u))
                at = u @ own if own is not None else u[:GRID_DIMS]
                cells.append(np.pad(np.floor(at / eps), (0, GRID_DIMS - len(at))).astype(np.int32).tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.int32()))], names=[*batch.schema.names, "cells"])
    return run


class Block:
    """A block in its task: ids, copies, unit vectors and cells."""

    def __init__(self, ids: pa.Scalar, copies: pa.Scalar, vectors: pa.Scalar, cells: pa.Scalar):
        self.ids, self.copies = np.asarray(ids.values), np.asarray(copies.values)
        self.u = unit(np.frombuffer(vectors.as_buffer(), dtype=np.float64).reshape(len(self.ids), -1))
        self.cells = np.frombuffer(cells.as_buffer(), dtype=np.int32).reshape(len(self.ids), -1)


def _linked(a: Block, b: Block, threshold: float, same: bool) -> pa.RecordBatch | None:
    """Links of two blocks: how many each vector has, with the copies of the other one, and a forest of them."""
    i, j = sequence_join(a.u, b.u, a.cells, b.cells, threshold, same)
    if not len(i):
        return None
    one = np.concatenate([a.ids[i], b.ids[j]])
    other = np.concatenate([b.copies[j], a.copies[i]])
    nodes, at = np.unique(one, return_inverse=True)
    n = np.bincount(at, weights=other).astype(np.int64)
    pairs = spanning_forest(a.ids[i], b.ids[j])
    return pa.RecordBatch.from_arrays(
        [pa.array([*nodes.tolist(), *(p[0] for p in pairs)], pa.int64()), pa.array([*[None] * len(nodes), *(p[1] for p in pairs)], pa.int64()),
         pa.array([*n.tolist(), *[0] * len(pairs)], pa.int64())], names=["a", "b", "n"])


def _compare(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come sorted by (super, visit): a super-block's own blocks, then one after the other those that visit it
        held: dict[int, Block] = {}
        here = None
        for batch in batches:
            for k in range(batch.num_rows):
                at, visit, block, own = (batch.column(i)[k].as_py() for i in range(4))
                if at != here:
                    here, held = at, {}
                row = Block(*(batch.column(i)[k] for i in range(4, 8)))
                if not visit:
                    held[block] = row
                for other in own:
                    if (found := _linked(held[other], row, threshold, other == block)) is not None:
                        yield found
    return run


def _super(block: str) -> Column:
    """The super-block of a block: blocks that follow each other in the sequence."""
    return F.shiftright(F.col(block), SUPER_BITS)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Link vectors of equal label whose cosine is at least ``threshold``.

    ``vectors`` has vec_id, embedding and label. Returns one row per input row:
    vec_id, n_links (other rows linked directly), component_id (smallest vec_id
    that links reach, itself included) and kept (vec_id = component_id).

    Vectors that are null, empty, zero or hold null or non-finite components,
    rows without label or without vec_id, and vectors of different lengths link
    with nothing: n_links 0, a component of their own (null without vec_id).
    Equal vectors of a label are compared once and counted as often as they
    come, repeated rows as well. Rows that share a vec_id but differ otherwise
    are one node of the links. An empty table gives an empty table. Other
    columns are not read.
    """
    eps = math.sqrt(2 - 2 * threshold) + 1e-9
    rows = vectors.select(F.col("vec_id").cast("long"), "embedding", F.col("label").cast("long"))
    takes_part = usable("embedding") & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    # 128 bits of the printed components name a vector
    marked = rows.select("vec_id", "label", F.when(takes_part, F.md5(F.col("embedding").cast("string"))).alias("vector"), "embedding")
    classes = written(marked.where("vector is not null").groupBy("label", "vector").agg(
        F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.any_value("embedding").alias("embedding")), "embed-classes")
    axes = rotations(classes)

    fields = ["id", "copies", "label", "embedding"]
    placed = classes.select(*fields).mapInArrow(_cells(axes, eps), f"id long, copies long, label long, embedding {classes.schema['embedding'].dataType.simpleString()}, cells array<int>")
    order = ["label", F.size("embedding"), *[F.col("cells")[d] for d in range(GRID_DIMS)], "id"]
    n = max(1, int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sequence = placed.repartitionByRange(n, *order).sortWithinPartitions(*order).select("id", "copies", "label", "cells", "embedding")
    blocks = written(sequence.mapInArrow(_blocks(), "block long, label long, width int, key array<int>, low array<int>, high array<int>, "
                                         "ids array<long>, copies array<long>, vectors binary, cells binary"), "embed-blocks")

    head = blocks.select("block", "label", "width", "key", "low", "high")
    # neighbours in the key dimensions, one of each +/- pair
    steps = [(x, y) for x in (0, 1) for y in (-1, 0, 1) if (x, y) >= (0, 0)]
    steps = F.array(*[F.array(F.lit(x), F.lit(y)) for x, y in steps])
    near = (head.select(F.col("block").alias("a_block"), "label", "width", F.col("low").alias("a_low"), F.col("high").alias("a_high"),
                        F.explode(F.transform(steps, lambda s: F.array(F.col("key")[0] + s[0], F.col("key")[1] + s[1]))).alias("key"),
                        F.col("key").alias("a_key"))
            .join(head.withColumnsRenamed({"block": "b_block", "low": "b_low", "high": "b_high"}), ["label", "width", "key"]))
    apart = F.exists(F.arrays_zip("a_low", "a_high", "b_low", "b_high"),
                     lambda d: (d["a_low"] - d["b_high"] > 1) | (d["b_low"] - d["a_high"] > 1))
    pairs = near.where(~apart & ((F.col("a_key") != F.col("key")) | (F.col("a_block") <= F.col("b_block")))) \
        .select(F.least("a_block", "b_block").alias("a_block"), F.greatest("a_block", "b_block").alias("b_block"))
    # a block is sent once to each super-block that it has to meet: with the first of a pair at home there
    pairs = pairs.groupBy(_super("a_block").alias("super"), F.col("b_block").alias("block")).agg(F.collect_set("a_block").alias("own"))
    pairs = pairs.withColumn("own", F.sort_array("own"))
    load = ["ids", "copies", "vectors", "cells"]
    home = blocks.select(_super("block").alias("super"), F.lit(0).alias("visit"), "block", *load)
    inside = pairs.where(F.col("super") == _super("block")).select("block", "own")
    visits = pairs.where(F.col("super") != _super("block")).select("super", F.lit(1).alias("visit"), "block", "own")
    # blocks of one super-block come in order, so that both of a pair are there when its second one comes
    rows = (home.join(inside, "block", "left").withColumn("own", F.coalesce("own", F.array().cast("array<long>")))
            .unionByName(visits.join(blocks.select("block", *load), "block")).select("super", "visit", "block", "own", *load))
    rows = rows.repartition("super").sortWithinPartitions("super", "visit", "block")
    found = written(rows.mapInArrow(_compare(threshold), "a long, b long, n long"), "embed-links")

    links = found.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("others"))
    comp = connected_components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "id")
    known = (classes.select("label", "vector", "id", "copies").join(links, "id", "left").join(comp, "id", "left")
             .select("label", "vector", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id")))
    part = marked.where("vector is not null").select("vec_id", "label", "vector").join(known, ["label", "vector"])
    alone = marked.where("vector is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = part.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id").union(alone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
