"""Toxicity scores of texts whose words may be disguised.

A disguised word is read as the output of a noisy channel: leetspeak replaces
letters, spacing pulls them apart, repetition stretches them. Every such token
becomes a lattice of the letters it may stand for; a Viterbi search under a
character trigram model of the corpus gives the likeliest plain word. A logistic
model over the restored words then gives the score.

    char_model   trigram counts over all texts (a table bounded by the alphabet)
    Decoder      lattice and Viterbi search
    train        word statistics over all labelled training rows, then a fit
    scores       one pass over all texts
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import written

#: The fit: labelled rows in its sample at most, smallest word evidence (G statistic)
#: and support, strength of the ridge penalty.
SAMPLE_ROWS = 32_768
LEAST_EVIDENCE = 20.0
LEAST_SUPPORT = 3
RIDGE = 0.05
#: A word also counts by its first letters, so that the forms of a stem meet.
STEMS = (3, 4, 5, 6)
#: Words and stems whose counts a task holds before it hands them on.
HELD_COUNTS = 500_000
#: Decoded tokens that a task remembers before it starts anew.
HELD_WORDS = 300_000

# The letters of the character model, what a sign may stand for,
# and the costs (natural logarithms) of the channel.
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœ"
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
        "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou"}
COST_LEET, COST_STAR, COST_REPEAT, COST_BREAK = 1.0, 3.0, 0.5, 2.0
#: that a token doubles letters at all, paid once for all of them
COST_STRETCH = 6.0
COST_DROP_INSIDE, COST_DROP_SIGN, COST_DROP_DIGIT = 14.0, 2.5, 8.0

_TRIM_LEFT = ".,;:?\"'()[]{}<>«»“”„…#%&*~^=_-/\\`"
_TRIM_RIGHT = _TRIM_LEFT + "!|+"
#: three or more of one sign around a word are ornament, not letters
_EDGE_RUN = re.compile(r"^([^\w\s])\1\1+|([^\w\s])\2\2+$")
_DOUBLE = re.compile(r"(.)\1")
_TRIPLE = re.compile(r"(.)\1\1")
_RUNS = re.compile(r"(.)\1+")
#: runs of a word of letters up to which its readings are tried one by one
MOST_RUNS = 4
_GAP = r"[\s.\-_]+"
#: single letters or signs pulled apart: i d i o t, i.d.i.o.t, 1-d-1-0-t
_SPACED = re.compile(rf"(?<!\S)[^\s.\-_](?:{_GAP}[^\s.\-_]){{2,}}(?![^\s.,;:?!\-_])")
_EDGE = "^"


_SYMBOLS = LETTERS + "?" + _EDGE
_OTHER, _STOP = len(LETTERS), len(LETTERS) + 1
#: characters of a text that are counted at a time
_PIECE = 1 << 20


def _letter_codes() -> np.ndarray:
    """The symbol of every character: its letter, "?" for other letters, the edge for the rest."""
    codes = np.array([_OTHER if chr(c).isalpha() else _STOP for c in range(0x10000)], dtype=np.int32)
    codes[[ord(c) for c in LETTERS]] = np.arange(len(LETTERS))
    return codes


def add_trigrams(total: np.ndarray, text: str, codes: np.ndarray) -> None:
    """Add the character trigrams of the words (runs of letters) of ``text``, edges included."""
    k = len(_SYMBOLS)
    text = f"\n\n{text.lower()}\n"
    for at in range(2, len(text), _PIECE):
        code = np.frombuffer(text[at - 2:at + _PIECE].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        code = codes[np.minimum(code, 0xFFFF)]
        b, c = code[1:-1], code[2:]
        a = np.where(b == _STOP, _STOP, code[:-2])
        gram = ((a * k + b) * k + c)[(b != _STOP) | (c != _STOP)]
        total += np.bincount(gram, minlength=k ** 3)


def named(total: np.ndarray) -> Counter:
    k = len(_SYMBOLS)
    return Counter({_SYMBOLS[g // k // k] + _SYMBOLS[g // k % k] + _SYMBOLS[g % k]: int(total[g]) for g in np.flatnonzero(total).tolist()})


def char_model(docs: DataFrame) -> dict[str, int]:
    """Character trigram counts over the words of all texts.

    Tasks send sums per trigram; the table has as many rows as there are
    trigrams of the fixed alphabet at most, whatever the corpus.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _letter_codes()
        total = np.zeros(len(_SYMBOLS) ** 3, dtype=np.int64)
        held: list[str] = []
        size = 0
        for batch in batches:
            for t in batch.column(0):
                held.append(t.as_py() or "")
                size += len(held[-1])
                if size >= _PIECE:
                    add_trigrams(total, "\n".join(held), codes)
                    held, size = [], 0
        add_trigrams(total, "\n".join(held), codes)
        grams = named(total)
        yield pa.RecordBatch.from_arrays([pa.array(list(grams), pa.string()), pa.array(list(grams.values()), pa.int64())], names=["gram", "n"])

    grams = docs.select("text").mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return {r.gram: r.n for r in grams.collect()}


def beginnings(word: str, size: int) -> set[str]:
    """The first ``size`` letters of all readings of a word of letters: of a run of one letter, one or two are read."""
    out, i = {""}, 0
    while i < len(word) and any(len(b) < size for b in out):
        j = i
        while j < len(word) and word[j] == word[i]:
            j += 1
        out = {b if len(b) >= size else (b + word[i] * n)[:size] for b in out for n in range(1, min(j - i, 2) + 1)}
        i = j
    return out


class Decoder:
    """Restores disguised words by a Viterbi search under a character model."""

    def __init__(self, grams: dict[str, int], only: set[str] | None = None):
        """``only``: the features that are asked for; words that cannot have one are dropped."""
        self.only = only
        self.roots = {f[:STEMS[0]] for f in only or ()}
        # what a word that is asked for can begin with: a stem, or the first letters of a whole word
        self.stems = {f.rstrip("*") for f in only or () if f.endswith("*")}
        self.heads = {f[:STEMS[-1] + 1] for f in only or () if not f.endswith("*")}
        pairs: Counter = Counter()
        singles: Counter = Counter()
        for g, n in grams.items():
            pairs[g[:2]] += n
            singles[g[2]] += n
        total = sum(singles.values()) + len(LETTERS) + 1
        self.single = {c: math.log((singles.get(c, 0) + 1) / total) for c in LETTERS + _EDGE + "?"}
        self.grams, self.pairs = grams, pairs
        self.seen: dict[str, float] = {}
        self.words: dict[str, tuple[str, ...]] = {}

    def log_p(self, a: str, b: str, c: str) -> float:
        """log P(c | a b): trigrams, backing off to single letters with weight 5."""
        key = a + b + c
        if (p := self.seen.get(key)) is None:
            low = math.exp(self.single.get(c, self.single["?"]))
            p = self.seen[key] = math.log((self.grams.get(key, 0) + 5 * low) / (self.pairs.get(a + b, 0) + 5))
        return p

    def lattice(self, token: str, stretched: bool = False) -> list[list[tuple[str, float]]]:
        """For each position the strings it may stand for, with their costs; " " is a word break.

        In a ``stretched`` token two of a letter may be one.
        """
        out, i = [], 0
        while i < len(token):
            c, j = token[i], i
            while j < len(token) and token[j] == c:
                j += 1
            run = j - i
            if c in " -._'’/":
                out.append([("", 0.0), (" ", COST_BREAK if c == " " else 1.0)])
            elif c in LEET:
                inside = 0 < i and j < len(token)
                drop = COST_DROP_INSIDE if inside else COST_DROP_DIGIT if c.isdigit() else COST_DROP_SIGN
                cost = COST_STAR if c == "*" else COST_LEET
                single = [(x, cost) for x in LEET[c]] + [("", drop)]
                # a run of one sign is one letter, two, or none
                out.append(single + ([(x * 2, cost + COST_REPEAT) for x in LEET[c]] if run > 1 else []))
            elif c.isalpha():
                if run >= 3 or stretched and run == 2:
                    out.append([(c, COST_REPEAT), (c * 2, COST_REPEAT)])
                else:
                    out += [[(c, 0.0)]] * run
            else:
                out.append([("", 0.0)])
            i = j
        return out

    def _cost(self, word: str) -> float:
        """The cost of a word of letters as it stands."""
        a, b, cost = _EDGE, _EDGE, 0.0
        for c in word:
            k = c if c in LETTERS else "?"
            cost -= self.log_p(a, b, k)
            a, b = b, k
        return cost - self.log_p(a, b, _EDGE)

    def decode(self, token: str) -> str:
        """The likeliest plain reading of a lower-case token."""
        if token.isalpha() and len(runs := [m.span() for m in _RUNS.finditer(token)]) <= MOST_RUNS:
            # the lattice of a word of letters has two ways at each run: all readings are few
            readings, at = [""], 0
            for start, end in runs:
                readings = [r + token[at:start] + token[start] * n for r in readings for n in (1, 2)]
                at = end
            less, other = min((self._cost(r + token[at:]), r + token[at:]) for r in readings)
            if any(end - start > 2 for start, end in runs) or less + COST_REPEAT * len(runs) + COST_STRETCH < self._cost(token):
                return other
            return token
        return self._decode(token)

    def _decode(self, token: str) -> str:
        if _TRIPLE.search(token):
            return self._search(self.lattice(token, True))[1]
        cost, out = self._search(self.lattice(token))
        if _DOUBLE.search(token):
            less, other = self._search(self.lattice(token, True))
            if less + COST_STRETCH < cost:
                return other
        return out

    def _search(self, lattice: list[list[tuple[str, float]]]) -> tuple[float, str]:
        """The likeliest way through a lattice: its cost and its letters."""
        best: dict[str, tuple[float, tuple]] = {_EDGE * 2: (0.0, ())}  # last two letters -> cost, path
        for options in lattice:
            step: dict[str, tuple[float, tuple]] = {}
            for state, (cost, path) in best.items():
                for s, extra in options:
                    at, total, way = state, cost + extra, path
                    for c in s:
                        if c == " ":
                            if at == _EDGE * 2:
                                break  # no empty words
                            total -= self.log_p(at[0], at[1], _EDGE)
                            at = _EDGE * 2
                        else:
                            k = c if c in LETTERS else "?"
                            total -= self.log_p(at[0], at[1], k)
                            at = at[1] + k
                    else:
                        if s:
                            way = (way, s)
                        if at not in step or total < step[at][0]:
                            step[at] = (total, way)
            best = step
        ends = [(cost - self.log_p(s[0], s[1], _EDGE), path) for s, (cost, path) in best.items()]
        least, path = min(ends, key=lambda e: e[0])
        out: list[str] = []
        while path:
            path, s = path
            out.append(s)
        return least, "".join(reversed(out))

    def restore(self, token: str) -> tuple[str, ...]:
        """The plain words of one lower-case token; none for numbers and mere signs."""
        if (known := self.words.get(token)) is None:
            known = self._restore(token)
            if self.only is not None:
                known = tuple(w for w in known if w[:STEMS[0]] in self.roots and self._asked_for(w))
            if len(self.words) > HELD_WORDS:
                self.words.clear()
            if len(token) <= 64:
                self.words[token] = known
        return known

    def _asked_for(self, w: str) -> bool:
        return w in self.only or any(w[:k] + mark in self.only for k in STEMS if len(w) > k for mark in ("*", "**"))

    def _restore(self, token: str) -> tuple[str, ...]:
        word = token.strip(".,;:?")
        if word.isalpha() and not _DOUBLE.search(word):
            return (word,)
        word = _EDGE_RUN.sub("", token).lstrip(_TRIM_LEFT).rstrip(_TRIM_RIGHT)
        if not any(c.isalpha() for c in word):
            return ()
        if word.isalpha():
            if not _DOUBLE.search(word):
                return (word,)
            if self.only is not None and not _DOUBLE.search(word[:STEMS[0] + 1]) and word[:STEMS[0]] not in self.roots:
                return ()  # its first letters are as they stand
            if self.only is not None and not any(b in self.heads or any(b[:k] in self.stems for k in STEMS) for b in beginnings(word, STEMS[-1] + 1)):
                return ()  # however its letters are doubled, it is no word that is asked for
        return tuple(self.decode(word).split())

    def text_words(self, text: str | None) -> set[str]:
        """The distinct restored words of a text."""
        text = (text or "").lower()
        out: set[str] = set()
        known = self.words.get
        tokens = set(text.split())
        for token in tokens:
            words = known(token)
            if words is None:
                words = self.restore(token)
            if words:
                out.update(words)
        # pulled apart over white space: the first letter stands alone or has a sign behind
        if not any(len(t) == 1 or not t[1].isalnum() for t in tokens):
            return out
        for m in _SPACED.finditer(text):
            out.update(self.restore(re.sub(_GAP, " ", m.group())))
        return out


def features(words: set[str]) -> set[str]:
    """What a text is scored by: its words, their stems (``stem*``) and stems of two of them or more (``stem**``)."""
    stems = Counter(w[:k] + "*" for w in words for k in STEMS if len(w) > k)
    return words | stems.keys() | {s + "*" for s, n in stems.items() if n > 1}


@dataclass
class Model:
    bias: float
    weights: dict[str, float] = field(default_factory=dict)
    grams: dict[str, int] = field(default_factory=dict)

    def score(self, words: set[str]) -> float:
        z = self.bias + sum(self.weights[f] for f in features(words) & self.weights.keys())
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def held_out(doc_id):
    """Rows that no label is learned from: crc32 of the id as text leaves 0 modulo 5 (or there is no id)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _fit(rows: list[tuple[tuple[int, ...], int, float]], width: int) -> tuple[float, np.ndarray]:
    """Ridge logistic regression on (word numbers, toxic, how often) by Newton steps.

    The matrix is kept as its ones, and a step is found by conjugate gradients, so
    that neither time nor memory grows with the square of the number of words."""
    at = np.repeat(np.arange(len(rows)), [len(r[0]) + 1 for r in rows])
    word = np.fromiter((w for r in rows for w in (*r[0], width)), dtype=np.int64, count=len(at))  # the last column is the bias
    y = np.array([r[1] for r in rows], dtype=float)
    n = np.array([r[2] for r in rows], dtype=float)
    ridge = np.full(width + 1, RIDGE)
    ridge[-1] = 1e-3

    def times(w: np.ndarray) -> np.ndarray:
        return np.bincount(at, weights=w[word], minlength=len(rows))

    def back(u: np.ndarray) -> np.ndarray:
        return np.bincount(word, weights=u[at], minlength=width + 1)

    w = np.zeros(width + 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(times(w), -30, 30)))
        gradient = back(n * (p - y)) + ridge * w
        curve = n * np.maximum(p * (1 - p), 1e-6)
        diagonal = back(curve) + ridge
        step, left = np.zeros(width + 1), gradient.copy()
        way = scaled = left / diagonal
        enough = max(1e-10, 1e-2 * float(np.abs(scaled).max()))  # a step need not be exact while steps are long
        for _ in range(10 * (width + 1)):
            if np.abs(scaled).max() < enough:
                break
            curved = back(curve * times(way)) + ridge * way
            much = (left @ scaled) / (way @ curved)
            step += much * way
            rest = left - much * curved
            new = rest / diagonal
            way = new + way * ((rest @ new) / (left @ scaled))
            left, scaled = rest, new
        size = float(np.abs(step).max())
        w -= step * min(1.0, 2.0 / max(size, 1e-12))
        if size < 1e-6:
            break
    return float(w[-1]), w[:-1]


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from labelled rows that are not held out.

    The character model covers all texts. The classifier is fitted on a sample:
    the ``SAMPLE_ROWS`` labelled ids that come first by their hash, all if there
    are no more. Its size is bounded, so it is broadcast to the texts and these
    stay where they are. All words and stems with enough evidence in the sample
    make up the model. A document with several labels
    counts as toxic if one of them says so; null labels and null ids are left
    out. Without toxic rows every score is about 0.
    """
    grams = char_model(docs)
    marks = (labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(grams)
        for batch in batches:
            words = [sorted(decoder.text_words(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.string())), batch.column(2)], names=["doc_id", "words", "toxic"])

    kind = T.StructType([docs.schema["doc_id"], T.StructField("words", T.ArrayType(T.StringType())), T.StructField("toxic", T.IntegerType())])
    rows = (docs.select("doc_id", "text").where("doc_id is not null").where(~held_out(F.col("doc_id")))
            .join(F.broadcast(marks), "doc_id").select("doc_id", "text", F.col("toxic").cast("int")))
    rows = written(rows.mapInArrow(run, kind), "toxicity-train")
    n, toxic = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    share = toxic / n if n else 0.0
    if not 0 < share < 1:
        return Model(-30.0 if share == 0 else 30.0, {}, grams)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[Counter, Counter] = (Counter(), Counter())

        def handed_on() -> pa.RecordBatch:
            names = sorted(held[0].keys() | held[1].keys())
            cols = [pa.array([c[w] for w in names], pa.int64()) for c in (held[1], held[0])]
            held[0].clear()
            held[1].clear()
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *cols], names=["word", "a", "b"])

        for batch in batches:
            for ws, y in zip(batch.column(0), batch.column(1)):
                held[1 if y.as_py() else 0].update(features(set(ws.as_py())))
                if len(held[0]) + len(held[1]) > HELD_COUNTS:
                    yield handed_on()
        yield handed_on()

    words = (rows.select("words", "toxic").mapInArrow(counts, "word string, a long, b long")
             .groupBy("word").agg(F.sum("a").alias("a"), F.sum("b").alias("b")))
    a, b = F.col("a"), F.col("b")
    part = lambda x, share: F.when(x > 0, x * F.log(x / ((a + b) * share))).otherwise(0.0)
    top = (words.where(a >= LEAST_SUPPORT).where(a * (n - toxic) > b * toxic)
           .withColumn("g", 2 * (part(a, share) + part(b, 1 - share))).where(F.col("g") >= LEAST_EVIDENCE)
           .orderBy(F.desc("g"), "word").select("word"))
    vocabulary = {r.word: i for i, r in enumerate(top.collect())}

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [",".join(str(i) for i in sorted(vocabulary[f] for f in features(set(ws.as_py())) if f in vocabulary)) for ws in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), batch.column(1)], names=["found", "toxic"])

    sample = (rows.select("words", "toxic")
              .mapInArrow(numbers, "found string, toxic int").groupBy("found", "toxic").count().collect())
    fit_rows = sorted((tuple(int(i) for i in r.found.split(",") if i), r.toxic, r["count"]) for r in sample)
    # a word that always comes with others would learn nothing: each counts by itself once more
    alone: Counter = Counter()
    whole = {i for w, i in vocabulary.items() if not w.endswith("*")}
    for found, y, n in fit_rows:
        for i in whole.intersection(found):
            alone[(i,), y] += n / len(found)
    fit_rows += [(found, y, n) for (found, y), n in sorted(alone.items())]
    bias, weights = _fit(fit_rows, len(vocabulary))
    return Model(bias, {w: float(weights[i]) for w, i in vocabulary.items()}, grams)


def scores(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``docs`` with the toxicity of each text in ``column`` (double, 0 to 1).

    A null, empty or wordless text gets the score of a text without any word of
    the model. Rows, repeats and other columns stay as they are; a column that
    has the new one's name already is replaced.
    """
    kept = docs.drop(column)
    bias, weights, grams = model.bias, model.weights, model.grams

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder, own = Decoder(grams, set(weights)), Model(bias, weights)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            values = [own.score(decoder.text_words(t.as_py())) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], names=[*batch.schema.names, column])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(column, T.DoubleType())]))


def without_toxic(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score ``least`` or more; columns unchanged."""
    model = train(docs, labels)
    mark = "_toxicity"
    while mark in docs.columns:
        mark += "_"
    return scores(docs, model, mark).where(F.col(mark) < least).drop(mark)
