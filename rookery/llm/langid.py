"""Language identification, words first and character n-grams for unseen words.

Every word of a text has a log frequency in each language. A word that the model
knows is scored by its own; for any other the longest character n-grams (of the
word between two blanks) that the model knows stand in, by their mean: five
letters, then four, down to single letters. A word without a known letter says
nothing. A text goes to the language with the largest sum.

The model is fitted on a bounded sample of labelled rows: of each language the
``LANG_ROWS`` rows with the smallest hashes, whole texts, until they hold
``LANG_CHARS`` characters. Items with ``LEAST_COUNT`` occurrences in it are known.
What is broadcast is bounded by that, times the number of languages; all texts of
the table are scored, each in whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import drop_written, first_rows, written

LANG_ROWS = 2048
LANG_CHARS = 1 << 22
LEAST_COUNT = 2

#: Letters of the longest n-grams.
LONGEST = 5

#: What an item counts in a language in which the sample does not have it.
UNSEEN = 0.5

#: Numbers that a task keeps of words it has scored, and words of a text summed at a time.
KEPT_SCORES = 1 << 23
STEP = 1 << 16

UNKNOWN = "und"

_WORD = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from: crc32 of the id as text leaves 2 modulo 4 (or there is no id)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def words_of(text: str) -> list[str]:
    """Lower-case words: runs of letters (and of numerals that are no digits, see ``Scorer``)."""
    return _WORD.findall(text.lower())


def grams_of(word: str, n: int) -> list[str]:
    """Character n-grams of a word between blanks; single letters without the blanks."""
    if n > 1:
        word = f" {word} "
    return [word[i:i + n] for i in range(len(word) - n + 1)]


@dataclass
class Model:
    """Log frequencies: per item the languages that have it and how far they lie above ``base``.

    ``base[n]`` holds, by language, the log frequency of an item of length n that
    the language does not have; n = 0 are words."""

    langs: list[str]
    base: np.ndarray
    words: dict[str, int]
    grams: dict[str, int]
    starts: np.ndarray
    lang: np.ndarray
    above: np.ndarray


def sample(docs: DataFrame, rows: int = LANG_ROWS, chars: int = LANG_CHARS) -> DataFrame:
    """(lang, text): of each language the labelled rows with the smallest hashes.

    Which ones is found out on hashes and lengths alone, so texts are kept for the
    rows of the sample only. Rows that repeat id and text count once."""
    labelled = (docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
                .select("lang", "text", F.xxhash64("doc_id", "text").alias("h")))
    narrow = labelled.select("lang", "h", F.length("text").alias("size")).dropDuplicates(["lang", "h"])
    before = Window.partitionBy("lang").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    narrow = (first_rows(narrow, "lang", [F.col("h")], rows, F.col("h"), "place")
              .withColumn("before", F.sum("size").over(before)).where(F.coalesce("before", F.lit(0)) < chars))
    last = written(narrow.groupBy("lang").agg(F.max("h").alias("last")), "langid-sample")
    return labelled.join(last, "lang").where(F.col("h") <= F.col("last")).dropDuplicates(["lang", "h"]).select("lang", "text")


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, word, c) of (lang, text), counted in the tasks first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[tuple[str, str]] = Counter()
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for word, c in Counter(words_of(text.as_py())).items():
                    counts[lang, word] += c
        if counts:
            langs, words = zip(*counts)
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(list(counts.values()), pa.int64())],
                                             names=["lang", "word", "c"])

    return texts.mapInArrow(run, "lang string, word string, c long").groupBy("lang", "word").agg(F.sum("c").alias("c"))


def item_counts(words: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """(n, item, lang, c) of the words (n = 0) and n-grams with ``least`` occurrences in all."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter[tuple[int, str, str]] = Counter()
            for lang, word, c in zip(*(column.to_pylist() for column in batch.columns)):
                counts[0, word, lang] += c
                for n in range(1, LONGEST + 1):
                    for gram in grams_of(word, n):
                        counts[n, gram, lang] += c
            if counts:
                n, items, langs = zip(*counts)
                yield pa.RecordBatch.from_arrays([pa.array(n, pa.int32()), pa.array(items, pa.string()), pa.array(langs, pa.string()),
                                                  pa.array(list(counts.values()), pa.int64())], names=["n", "item", "lang", "c"])

    counts = words.mapInArrow(run, "n int, item string, lang string, c long").groupBy("n", "item", "lang").agg(F.sum("c").alias("c"))
    known = counts.groupBy("n", "item").agg(F.sum("c").alias("all")).where(F.col("all") >= least)
    return counts.join(known.select("n", "item"), ["n", "item"])


def train(docs: DataFrame) -> Model:
    """The model of the documents that are not held out; without one it knows no language."""
    words = written(word_counts(sample(docs)), "langid-words")
    items = written(item_counts(words), "langid-items")
    rows = items.orderBy("n", "item", "lang").toArrow()
    drop_written(words)
    drop_written(items)
    langs = sorted(set(rows["lang"].to_pylist()))
    number = {lang: i for i, lang in enumerate(langs)}
    n = rows["n"].to_numpy().astype(np.int64)
    names = rows["item"].to_pylist()
    lang = np.array([number[x] for x in rows["lang"].to_pylist()], dtype=np.int32)
    count = rows["c"].to_numpy().astype(np.float64)
    new = np.array([i for i in range(len(names)) if i == 0 or names[i] != names[i - 1] or n[i] != n[i - 1]], dtype=np.int64)
    base = np.zeros((LONGEST + 1, len(langs)))
    for k in range(LONGEST + 1):
        total = np.bincount(lang[n == k], weights=count[n == k], minlength=len(langs)) + UNSEEN * (n[new] == k).sum()
        base[k] = np.log(UNSEEN) - np.log(np.maximum(total, UNSEEN))
    words = {names[i]: at for at, i in enumerate(new.tolist()) if n[i] == 0}
    grams = {names[i]: at for at, i in enumerate(new.tolist()) if n[i] > 0}
    return Model(langs, base, words, grams, np.append(new, len(names)), lang, np.log((count + UNSEEN) / UNSEEN))


class Scorer(dict):
    """Word -> row of ``table``, the scores of the words met so far; row 0 is no word."""

    def __init__(self, model: Model):
        super().__init__()
        self.langs, self.words, self.grams = model.langs, model.words, model.grams
        # plain lists: an item has a few languages only, too few for arrays to pay
        self.base, self.starts, self.lang, self.above = (x.tolist() for x in (model.base, model.starts, model.lang, model.above))
        self.table = np.zeros((1024, len(model.langs)))
        self.rows = 1

    def scores(self, word: str) -> list[float]:
        """Log frequency of a word by language: its own, or the mean of its longest known n-grams."""
        n, items = 0, [self.words.get(word)]
        if items[0] is None:
            for n in range(LONGEST, 0, -1):
                items = [g for g in map(self.grams.get, grams_of(word, n)) if g is not None]
                if items:
                    break
            else:
                return [0.0] * len(self.langs)
        out = [0.0] * len(self.langs)
        for item in items:
            for k in range(self.starts[item], self.starts[item + 1]):
                out[self.lang[k]] += self.above[k]
        return [b + x / len(items) for b, x in zip(self.base[n], out)]

    def __missing__(self, word: str) -> int:
        if not word.isalpha() and not any(map(str.isalpha, word)):
            self[word] = 0
            return 0
        if self.rows == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[self.rows] = self.scores(word)
        self[word] = at = self.rows
        self.rows += 1
        return at

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and its share among all; ties go to the first by name."""
        langs = self.langs
        if len(self) * max(1, len(langs)) > KEPT_SCORES:
            self.clear()
            self.table, self.rows = np.zeros((1024, len(langs))), 1
        at = np.fromiter(map(self.__getitem__, words_of(text or "")), dtype=np.int64)
        if not langs or not at.any():
            return UNKNOWN, 0.0
        total = np.zeros(len(langs))
        for start in range(0, len(at), STEP):
            total += self.table[at[start:start + STEP]].sum(axis=0)
        best = int(total.argmax())
        return langs[best], float(1.0 / np.exp(total - total[best]).sum())


def predictions(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of ``docs``.

    Only ``doc_id`` and ``text`` are read. ``lang_pred`` is ``und``, with score 0,
    for a null text, a text without a letter, and if the model knows no language.
    Repeated rows give a row each; a text none of whose letters is known goes to
    the first language by name, with an equal share. An empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            out = [scorer.predict(text.as_py()) for text in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x[0] for x in out], pa.string()),
                                              pa.array([x[1] for x in out], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return (docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
            .mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double"))
