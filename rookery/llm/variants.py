"""Spelling variants: words one edit apart, by k-d trees over letter counts.

One inserted, deleted or replaced letter changes the letter counts of a word by
one up, one down, or one of each: by at most two in sum. So the words near a word
of length L lie, in the space of letter counts, within that box distance among the
words of length L and L + 1 (and L - 1, found from there).

    words     counted over whole texts
    cells     a k-d tree for every length, fitted on a bounded sample of words,
              cuts the space into cells; it decides where words meet, never whether
    visits    a word goes to its own cell and to those that the tree's boxes leave
              within reach: cells of its length behind its own, and of length L + 1
    search    a cell's words form a k-d tree with tight boxes; residents and
              visitors descend it together, and what reaches a leaf is verified
              letter by letter

Each pair of near words is found once, in the cell of one of them. A cell whose
words the tree cannot part (equal letter counts) is cut into blocks by hash, so no
task holds more than the words of a cell.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import drop_written, written

LEAST_LETTERS = 7
LEAST_COUNT = 2
#: A word's form has so many times its own occurrences.
FORM_RATIO = 10

#: One occurrence in so many loses a letter.
DAMAGE = 31

#: Words that fit the trees of all lengths: the bound of what the driver holds.
SAMPLE_WORDS = 1 << 18

#: Words of a cell, and bytes where words are long.
CELL_WORDS = 1 << 15
CELL_BYTES = 1 << 24

#: Words of a leaf in a cell's tree.
LEAF_WORDS = 12

#: Distinct words a task counts before it hands them on.
HELD_WORDS = 1 << 18

#: Rows compared at a time.
ROWS = 1 << 17

# The letters: a-z and U+00C0-U+00FF; both fit one byte of Latin-1.
_RUN = re.compile(rf"[a-zÀ-ÿ]{{{LEAST_LETTERS},}}")
_LETTERS = [*range(97, 123), *range(0xC0, 0x100)]
_PLACE = np.full(256, -1, dtype=np.int64)
_PLACE[_LETTERS] = np.arange(len(_LETTERS))


def damaged(doc_id, run: str) -> str:
    """A run as it is counted: one in ``DAMAGE`` loses a letter, by a hash of document and run."""
    if doc_id is None:
        return run
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % DAMAGE:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def word_counts(docs: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words of 7 letters and more with ``least`` occurrences.

    Tasks count before the shuffle and hand on what they have after every
    ``HELD_WORDS`` distinct words. Runs shorter than that cannot become words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def held() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return batch

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for found, n in Counter(_RUN.findall((text.as_py() or b"").lower().decode())).items():
                    word = damaged(doc_id, found)
                    if len(word) >= LEAST_LETTERS:
                        counts[word] += n
                if len(counts) >= HELD_WORDS:
                    yield held()
        if counts:
            yield held()

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


# ---------------------------------------------------------------- trees

def letter_counts(words: list[bytes]) -> np.ndarray:
    """Counts of the letters of Latin-1 words, 255 at most (which lessens differences, so no pair is lost)."""
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    row = np.repeat(np.arange(len(words)), size)
    letter = _PLACE[np.frombuffer(b"".join(words), dtype=np.uint8)]
    counts = np.bincount(row * len(_LETTERS) + letter, minlength=len(words) * len(_LETTERS))
    return np.minimum(counts, 255).astype(np.int16).reshape(len(words), len(_LETTERS))


@dataclass
class Tree:
    """A k-d tree over letter counts; node 0 is the root.

    ``lo`` and ``hi`` are the nodes' boxes, ``left`` and ``right`` their children
    (-1 at a leaf), ``first`` and ``size`` a leaf's rows in ``order``. ``dim`` and
    ``cut`` say where a node is split."""

    lo: np.ndarray
    hi: np.ndarray
    left: np.ndarray
    right: np.ndarray
    dim: np.ndarray
    cut: np.ndarray
    first: np.ndarray
    size: np.ndarray
    order: np.ndarray


def build_tree(counts: np.ndarray, leaf: int, tight: bool) -> Tree:
    """Split at the most balanced cut of the letter that varies most, down to ``leaf`` rows.

    With ``tight`` a node's box holds its rows and no more; else it is the region
    that the cuts leave, in which any other word has its place as well."""
    width = counts.shape[1]
    nodes: list[list] = []   # lo, hi, left, right, dim, cut, first, size
    order = np.empty(len(counts), dtype=np.int64)
    placed = 0
    todo = [(np.arange(len(counts)), np.zeros(width, np.int16), np.full(width, 255, np.int16), -1, 0)]
    while todo:
        rows, lo, hi, parent, side = todo.pop()
        at = len(nodes)
        if parent >= 0:
            nodes[parent][2 + side] = at
        own = counts[rows]
        if tight:
            lo, hi = own.min(axis=0), own.max(axis=0)
        node = [lo, hi, -1, -1, -1, -1, placed, len(rows)]
        nodes.append(node)
        if len(rows) > leaf:
            dim = int(own.var(axis=0).argmax())
            up_to = np.cumsum(np.bincount(own[:, dim]))
            if up_to.searchsorted(1) < len(up_to) - 1:   # the letter varies
                low, high = int(own[:, dim].min()), int(own[:, dim].max())
                cut = low + int(np.abs(2 * up_to[low:high] - len(rows)).argmin())
                node[4], node[5] = dim, cut
                left_hi, right_lo = hi.copy(), lo.copy()
                left_hi[dim], right_lo[dim] = cut, cut + 1
                below = own[:, dim] <= cut
                todo.append((rows[~below], right_lo, hi, at, 1))
                todo.append((rows[below], lo, left_hi, at, 0))
                continue
        order[placed:placed + len(rows)] = rows
        placed += len(rows)
    columns = list(zip(*nodes))
    whole = [np.array(c, dtype=np.int64) for c in columns[2:]]
    return Tree(np.array(columns[0], np.int16), np.array(columns[1], np.int16), *whole, order)


def home(tree: Tree, counts: np.ndarray) -> np.ndarray:
    """The leaf in whose region each row lies."""
    node = np.zeros(len(counts), dtype=np.int64)
    inner = np.nonzero(tree.left[node] >= 0)[0]
    while len(inner):
        at = node[inner]
        node[inner] = np.where(counts[inner, tree.dim[at]] <= tree.cut[at], tree.left[at], tree.right[at])
        inner = inner[tree.left[node[inner]] >= 0]
    return node


def reach(tree: Tree, counts: np.ndarray, up: int, down: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of the leaves whose boxes lie within ``up`` more and ``down`` fewer letters of a row."""
    rows_out, leaves_out = [], []
    step = max(1, ROWS // 64)
    for start in range(0, len(counts), step):
        row = np.arange(start, min(start + step, len(counts)))
        node = np.zeros(len(row), dtype=np.int64)
        while len(row):
            own = counts[row]
            near = (np.maximum(tree.lo[node] - own, 0).sum(axis=1) <= up) & (np.maximum(own - tree.hi[node], 0).sum(axis=1) <= down)
            row, node = row[near], node[near]
            at_leaf = tree.left[node] < 0
            rows_out.append(row[at_leaf])
            leaves_out.append(node[at_leaf])
            row, node = row[~at_leaf], node[~at_leaf]
            row, node = np.concatenate([row, row]), np.concatenate([tree.left[node], tree.right[node]])
    none = np.empty(0, dtype=np.int64)
    return np.concatenate(rows_out or [none]), np.concatenate(leaves_out or [none])


# ---------------------------------------------------------------- one cell

def _letters(words: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(words), dtype=np.uint8).reshape(len(words), width)


def one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of letters of one length differ at exactly one place."""
    return (a != b).sum(axis=1) == 1


def one_inserted(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Whether a row of ``long`` is that of ``short`` with one letter more."""
    size = short.shape[1]

    def same(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        differ = a != b
        return np.where(differ.any(axis=1), differ.argmax(axis=1), size)

    return same(short, long[:, :-1]) + same(short[:, ::-1], long[:, :0:-1]) >= size


def near_in_cell(residents: list[bytes], same: list[bytes], shorter: list[bytes]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Near pairs of a cell as (whose, row, resident) arrays: of residents, of visitors of
    the same length, and of visitors one letter shorter. All residents are distinct and of one length."""
    if not residents:
        return
    width = len(residents[0])
    counts = letter_counts(residents)
    tree = build_tree(counts, LEAF_WORDS, tight=True)
    letters = _letters(residents, width)
    for whose, words, up, down in (("own", residents, 1, 1), ("same", same, 1, 1), ("shorter", shorter, 1, 0)):
        if not words:
            continue
        asked_counts = counts if whose == "own" else letter_counts(words)
        asked = letters if whose == "own" else _letters(words, len(words[0]))
        row, leaf = reach(tree, asked_counts, up, down)
        size = tree.size[leaf]
        ends = np.cumsum(size)
        step = max(1, ROWS // max(1, width // 32))
        at = 0
        while at < len(row):   # some (row, leaf) pairs at a time, spread over the leaves' words
            before = ends[at] - size[at]
            stop = max(at + 1, int(np.searchsorted(ends, before + step, "right")))
            some = size[at:stop]
            r = np.repeat(row[at:stop], some)
            w = tree.order[np.repeat(tree.first[leaf[at:stop]], some) + np.arange(some.sum()) - np.repeat(ends[at:stop] - some - before, some)]
            at = stop
            if whose == "own":
                r, w = r[r < w], w[r < w]
            change = counts[w] - asked_counts[r]
            near = (np.maximum(change, 0).sum(axis=1) <= up) & (np.maximum(-change, 0).sum(axis=1) <= down)
            r, w = r[near], w[near]
            good = one_inserted(asked[r], letters[w]) if whose == "shorter" else one_replaced(asked[r], letters[w])
            yield whose, r[good], w[good]


# ---------------------------------------------------------------- all cells

def fitted_trees(words: DataFrame, cell_words: int = CELL_WORDS) -> dict[int, tuple[Tree, np.ndarray, np.ndarray]]:
    """For every length of the words of a bounded sample its tree of regions, and the
    first cell and the number of cells (blocks) of each leaf. Cells of a length count from 0.

    The sample are the words with the smallest hashes, ``SAMPLE_WORDS`` about; a
    length without a word in it has one cell."""
    total = words.count()
    share = min(1.0, SAMPLE_WORDS / max(1, total))
    rows = words.where(F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < int(share * (1 << 20))).select("word").toArrow().column(0).to_pylist()
    by_length: dict[int, list[bytes]] = {}
    for word in rows:
        by_length.setdefault(len(word), []).append(word.encode("latin-1"))
    out = {}
    for length, sample in by_length.items():
        sample.sort()
        most = max(1, min(cell_words, CELL_BYTES // length))
        tree = build_tree(letter_counts(sample), max(16, int(most * share)) if share < 1 else most, tight=False)
        leaf = tree.left < 0
        blocks = np.where(leaf, np.maximum(1, -(-tree.size // max(1, int(most * share)))), 0)
        out[length] = (tree, np.cumsum(blocks) - blocks, blocks)
    return out


def routed(words: DataFrame, trees: dict[int, tuple[Tree, np.ndarray, np.ndarray]]) -> DataFrame:
    """(length, cell, whose, word, n): every word in its own cell and as a visitor of those within reach."""
    shared = words.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value

        def rows(length: int, cell: np.ndarray, whose: str, word: pa.Array, n: pa.Array, row: np.ndarray) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(row), ROWS):
                take = pa.array(row[at:at + ROWS])
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(length, pa.int32()), len(take)), pa.array(cell[at:at + ROWS]),
                                                  pa.repeat(pa.scalar(whose), len(take)), word.take(take), n.take(take)],
                                                 names=["length", "cell", "whose", "word", "n"])

        def all_cells(tree: tuple, row: np.ndarray, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            _, first, blocks = tree
            many = blocks[leaf]
            return np.repeat(row, many), np.repeat(first[leaf], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)

        for batch in batches:
            texts = [w.encode("latin-1") for w in batch.column(0).to_pylist()]
            lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
            for length in np.unique(lengths).tolist():
                where = np.nonzero(lengths == length)[0]
                own = [texts[i] for i in where]
                word, n = batch.column(0).take(pa.array(where)), batch.column(1).take(pa.array(where))
                counts = letter_counts(own)
                every = np.arange(len(own))
                if length in known:
                    tree, first, blocks = known[length]
                    leaf = home(tree, counts)
                    spread = np.fromiter(map(zlib.crc32, own), dtype=np.int64, count=len(own))
                    cell = first[leaf] + spread % blocks[leaf]
                    row, there = all_cells(known[length], *reach(tree, counts, 1, 1))
                    behind = there > cell[row]
                    yield from rows(length, there[behind], "same", word, n, row[behind])
                else:
                    cell = np.zeros(len(own), dtype=np.int64)
                yield from rows(length, cell, "own", word, n, every)
                if length + 1 in known:
                    row, there = all_cells(known[length + 1], *reach(known[length + 1][0], counts, 1, 0))
                else:
                    row, there = every, np.zeros(len(own), dtype=np.int64)
                yield from rows(length + 1, there, "shorter", word, n, row)

    return words.select("word", "n").mapInArrow(run, "length int, cell long, whose string, word string, n long")


def near_pairs(words: DataFrame, cell_words: int = CELL_WORDS) -> DataFrame:
    """(word, n, near, near_n): the pairs of distinct words one edit apart, each once."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64()), ("near", pa.string()), ("near_n", pa.int64())])

    def run(cell: pa.Table) -> pa.Table:
        parts = {}
        for whose in ("own", "same", "shorter"):
            rows = cell.filter(pc.equal(cell["whose"], whose))
            parts[whose] = (rows["word"].combine_chunks(), rows["n"].combine_chunks(), [w.encode("latin-1") for w in rows["word"].to_pylist()])
        out = []
        for whose, row, resident in near_in_cell(*[parts[k][2] for k in ("own", "same", "shorter")]):
            row, resident = pa.array(row), pa.array(resident)
            out.append(pa.Table.from_arrays([parts[whose][0].take(row), parts[whose][1].take(row),
                                             parts["own"][0].take(resident), parts["own"][1].take(resident)], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    rows = routed(words, fitted_trees(words, cell_words))
    return rows.groupBy("length", "cell").applyInArrow(run, "word string, n long, near string, near_n long")


# ---------------------------------------------------------------- forms

def roots(forms: DataFrame, most: int) -> DataFrame:
    """(word, root) of words with a form: the last word along the forms.

    Each step has ``FORM_RATIO`` times the occurrences, so a word with the most,
    ``most``, bounds the steps; every round doubles those taken."""
    steps, covered = forms.select("word", F.col("form").alias("root")), 1
    while FORM_RATIO ** covered <= most:
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        steps = written(steps.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "variant-roots")
        covered *= 2
    return steps


def variants(docs: DataFrame, cell_words: int = CELL_WORDS) -> DataFrame:
    """Words, their near words and forms: word, form, root, n, n_near, form_n.

    Only ``doc_id`` and ``text`` are read. A null text has no words; a null doc_id
    has no hash, so no run of its document loses a letter; repeated rows count
    each time. A word without a near word has n_near 0, form and form_n null, and
    is its own root. An empty table gives an empty table.
    """
    words = written(word_counts(docs), "variant-words")
    pairs = written(near_pairs(words, cell_words), "variant-pairs")
    both = pairs.union(pairs.select("near", "near_n", "word", "n"))
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    form_n = -F.col("best.less")
    known = written(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(form_n >= FORM_RATIO * F.col("n"), F.struct(F.col("best.near").alias("word"), form_n.alias("n"))).alias("form")), "variant-forms")
    drop_written(pairs)
    drop_written(words)
    ends = roots(known.where("form is not null").select("word", F.col("form.word").alias("form")), known.agg(F.max("n")).first()[0] or 0)
    return known.join(ends, "word", "left").select(
        "word", F.col("form.word").alias("form"), F.coalesce("root", "word").alias("root"), "n", "n_near", F.col("form.n").alias("form_n"))
