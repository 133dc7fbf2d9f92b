"""Phrase collocations by SON partitioning.

    chunks    texts are split into words once; a chunk holds the distinct words of
              some pieces of one language and their numbers in order
    words     counted over all chunks: the parts of two-word cuts
    pairs     every shard is mined completely at a support lowered to its share of
              the language's words; the union of the locally frequent pairs are the
              candidates, and all of them are counted over all shards
    longer    the same once more for phrases of three words and more, built from
              pairs that came through

A phrase that is frequent overall is locally frequent in at least one shard, so the
union misses none; and a phrase is no more frequent than its parts, so building
longer phrases from frequent ones misses none either. Shards are numbers that
chunks carry: there are ``SHARDS`` of them whatever the corpus, each mined by as
many tasks as its chunks fill, so that the local support stays well above one when
the corpus grows and no task holds more than a chunk.

In each step a chunk counts its phrases and hands them on in parts, by a hash of the
phrase: packed lists of distinct phrases and counts instead of a row for each. Lists
of one part meet, and which of their phrases are frequent returns to the chunks as
places in those lists. The number of parts follows the words of the language, so
that what meets stays at some hundred thousand phrases, and no vocabulary is ever
broadcast. The chunks are a table bucketed by chunk: they are not moved by the joins.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bucketed, delete_paths, fresh_path
from .tables import first_rows, small_batches, splits_of, written

#: Words after which the open chunks of a task are closed.
CHUNK_WORDS = 1 << 22

#: Shards; with a support of 100 a shard of average size is mined at a support of 7.
SHARDS = 16

#: Words of a language to each part of its phrases.
PART_WORDS = 1 << 22

#: Bytes of a text that are split at a time, up to the next end of a piece.
BLOCK = 1 << 22

#: Bytes that a task is handed at a time.
BATCH_BYTES = 8 << 20

SUPPORT = 100
LONGEST = 5
TOP = 2000

# A-Z become a-z, ends of pieces a full stop, a tab a blank; all other bytes stay.
_ENDS = b".,;:!?\n\x0b\x0c\r"
_FOLD = bytes(46 if b in _ENDS else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


def words_and_ends(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in order, ``b"."`` for every end of a piece, block by block."""
    at = 0
    text = text.translate(_FOLD)
    while at < len(text):
        cut = text.find(b".", at + BLOCK)
        cut = len(text) if cut < 0 else cut + 1
        yield text[at:cut].replace(b".", b" . ").split()
        at = cut


class _Numbers(dict):
    """Word -> number in order of appearance; 0 stands for the end of a piece."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _packed(codes: np.ndarray) -> bytes:
    """Numbers below 2^32, compressed by their bytes: the low ones of all, then the next."""
    import zstandard

    return zstandard.compress(np.ascontiguousarray(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 3)


def _unpacked(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.decompress(data), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def _packed_texts(texts: list[bytes]) -> bytes:
    """Texts without line feeds, one to a line."""
    import zstandard

    return zstandard.compress(b"\n".join(texts), 6)


def _unpacked_texts(data: bytes) -> list[bytes]:
    import zstandard

    return zstandard.decompress(data).split(b"\n")


def _unpacked_phrases(data: bytes) -> list[bytes]:
    """Phrases in lines of those that are equal but for their last words: ``first words<tab>last words``."""
    out: list[bytes] = []
    for line in _unpacked_texts(data):
        first, _, last = line.partition(b"\t")
        out += [first + b" " + w for w in last.split(b" ")] if first else last.split(b" ")
    return out


def chunked(docs: DataFrame, chunk_words: int = CHUNK_WORDS, shards: int = SHARDS) -> DataFrame:
    """Chunks: chunk, shard, lang, n, words, codes.

    ``words`` are the distinct words, frequent ones first, ``codes`` their numbers,
    from 1, in order, with 0 for the end of a piece. Chunks are numbered by
    partition and order, so the table has to be stored before use.
    """
    schema = pa.schema([("chunk", pa.int64()), ("shard", pa.int32()), ("lang", pa.string()), ("n", pa.int64()), ("words", pa.binary()), ("codes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId() if TaskContext.get() else 0
        made = 0
        numbers: dict[str, _Numbers] = {}
        codes: dict[str, list[np.ndarray]] = {}
        held = 0

        def closed() -> Iterator[pa.RecordBatch]:
            nonlocal made, held
            for lang in list(codes):
                flat = np.concatenate(codes.pop(lang))
                names = list(numbers.pop(lang))[1:]
                counts = np.bincount(flat, minlength=len(names) + 1)[1:]
                order = np.argsort(-counts, kind="stable")
                if len(order):
                    rank = np.zeros(len(order) + 1, dtype=np.uint32)
                    rank[order + 1] = np.arange(1, len(order) + 1, dtype=np.uint32)
                    yield pa.RecordBatch.from_pylist([{
                        "chunk": (task << 32) + made, "shard": (task + made) % shards, "lang": lang, "n": int(counts.sum()),
                        "words": _packed_texts([names[i] for i in order.tolist()]), "codes": _packed(rank[flat])}], schema=schema)
                    made += 1
            held = 0

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for tokens in words_and_ends(text.as_py() or b""):
                    if lang not in numbers:
                        numbers[lang], codes[lang] = _Numbers({b".": 0}), []
                    codes[lang].append(np.array([*map(numbers[lang].__getitem__, tokens), 0], dtype=np.uint32))
                    held += len(tokens)
                    if held >= chunk_words:
                        yield from closed()
        yield from closed()

    return (docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
            .mapInArrow(run, "chunk long, shard int, lang string, n long, words binary, codes binary"))


class Chunk:
    """A chunk in its task: its words and their numbers, what of it was kept, and its lists of phrases."""

    def __init__(self, words: bytes, codes: bytes, parts: int):
        self.names = _unpacked_texts(words)
        self.codes = _unpacked(codes)
        self.parts = parts
        self.hashes = np.fromiter(map(zlib.crc32, self.names), dtype=np.uint64, count=len(self.names))
        self.alphabetical = np.empty(len(self.names), dtype=np.int64)
        self.alphabetical[np.array(sorted(range(len(self.names)), key=self.names.__getitem__), dtype=np.int64)] = np.arange(len(self.names))

    def dealt(self, places: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The order of the phrases whose j-th word is ``names[places[j]]``, by part and
        then alphabetically, which packs best, and where each part begins and ends in it."""
        h = np.zeros(len(places[0]), dtype=np.uint64)
        for p in places:
            h = (h ^ self.hashes[p]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        part = (h % np.uint64(self.parts)).astype(np.int64)
        bits = len(self.names).bit_length()
        if bits * len(places) + self.parts.bit_length() < 63:
            key = part
            for p in places:
                key = (key << bits) | self.alphabetical[p]
            order = np.argsort(key)
        else:
            order = np.lexsort((*[self.alphabetical[p] for p in reversed(places)], part))
        return order, np.searchsorted(part[order], np.arange(self.parts + 1))

    def kept(self, places: list[np.ndarray], back: list[dict]) -> np.ndarray:
        """Which phrases the places ``back`` in their lists name."""
        out = np.zeros(len(places[0]), dtype=bool)
        order, ends = self.dealt(places)
        for b in back:
            out[order[ends[b["part"]] + _unpacked(b["at"])]] = True
        return out

    def word_places(self) -> list[np.ndarray]:
        return [np.arange(len(self.names))]

    def keep_words(self, back: list[dict]) -> None:
        """All but the frequent words become ends."""
        frequent = np.append(False, self.kept(self.word_places(), back))
        self.codes = np.where(frequent[self.codes], self.codes, 0)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct pairs of the words that are left, as one number each, and their counts."""
        a, b = self.codes[:-1], self.codes[1:]
        return np.unique(((a << 32) | b)[(a > 0) & (b > 0)], return_counts=True)

    @staticmethod
    def pair_places(pairs: np.ndarray) -> list[np.ndarray]:
        return [(pairs >> 32) - 1, (pairs & 0xFFFFFFFF) - 1]

    def longer(self, pairs: np.ndarray, longest: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
        """The words of the distinct phrases of 3 to ``longest`` words all whose pairs are among ``pairs``, and their counts."""
        key = (self.codes[:-1] << 32) | self.codes[1:]
        number = np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)
        starts_pair = np.append(pairs[number] == key, False)  # no pair starts at the last word
        start = np.nonzero(starts_pair)[0]
        name = number[start]
        for k in range(3, longest + 1):
            more = starts_pair[start + k - 2]  # the last two words are a pair as well
            start, name = start[more], name[more]
            if not len(start):
                return
            _, first, name, counts = np.unique((name << 32) | self.codes[start + k - 1], return_index=True, return_inverse=True, return_counts=True)
            yield [self.codes[start[first] + j] - 1 for j in range(k)], counts

    def lists(self, places: list[np.ndarray], counts: np.ndarray) -> Iterator[dict]:
        """The phrases in their parts, each part packed."""
        order, ends = self.dealt(places)
        names, k = self.names, len(places)
        for i in range(self.parts):
            own = order[ends[i]:ends[i + 1]]
            if not len(own):
                continue
            last = [names[j] for j in places[-1][own].tolist()]
            first = [p[own] for p in places[:-1]]
            new = np.zeros(len(own), dtype=bool)
            new[0] = True
            for p in first:
                new[1:] |= p[1:] != p[:-1]
            at = np.flatnonzero(new)
            lines = [b" ".join(names[j] for j in words) for words in zip(*(p[at].tolist() for p in first))] if first else [b""]
            cuts = [*at.tolist(), len(own)]
            yield {"k": k, "part": i, "phrases": _packed_texts([line + b"\t" + b" ".join(last[a:b]) for line, a, b in zip(lines, cuts, cuts[1:])]),
                   "counts": _packed(counts[own])}


LIST_KIND = "chunk long, shard int, need long, lang string, k int, part int, phrases binary, counts binary"


def phrase_lists(chunks: DataFrame, step: str, longest: int = LONGEST) -> DataFrame:
    """Lists of the phrases of every chunk for one step: words, pairs (of the words
    kept in ``words_back``), or longer (of the pairs kept in ``pairs_back``)."""
    schema = pa.schema([("chunk", pa.int64()), ("shard", pa.int32()), ("need", pa.int64()), ("lang", pa.string()),
                        ("k", pa.int32()), ("part", pa.int32()), ("phrases", pa.binary()), ("counts", pa.binary())])

    def counted(row: dict) -> Iterator[tuple[Chunk, list[np.ndarray], np.ndarray]]:
        chunk = Chunk(row["words"], row["codes"], row["parts"])
        if step == "words":
            yield chunk, chunk.word_places(), np.bincount(chunk.codes, minlength=len(chunk.names) + 1)[1:]
            return
        chunk.keep_words(row["words_back"])
        pairs, counts = chunk.pairs()
        if step == "pairs":
            yield chunk, chunk.pair_places(pairs), counts
            return
        kept = pairs[chunk.kept(chunk.pair_places(pairs), row["pairs_back"])]
        for places, counts in chunk.longer(kept, longest):
            yield chunk, places, counts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                own = {c: row[c] for c in ("chunk", "shard", "need", "lang")}
                for chunk, places, counts in counted(row):
                    held, size = [], 0
                    for packed in chunk.lists(places, counts):
                        held.append(own | packed)
                        size += len(packed["phrases"])
                        if size > BLOCK:
                            yield pa.RecordBatch.from_pylist(held, schema=schema)
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)

    return chunks.mapInArrow(run, LIST_KIND)


def frequent(lists: DataFrame, support: int) -> DataFrame:
    """What is frequent in lists of phrases, as two kinds of rows: phrases (lang, k,
    phrase, a), and for every chunk the places of its frequent phrases in its list
    of a part (chunk, k, part, at).

    All lists of a part meet. A phrase is a candidate if one shard at least has as
    many as its lowered support ``need``; candidates are counted over all shards.
    """
    schema = pa.schema([("lang", pa.string()), ("k", pa.int32()), ("phrase", pa.string()), ("a", pa.int64()),
                        ("chunk", pa.int64()), ("part", pa.int32()), ("at", pa.binary())])

    def run(group: pa.Table) -> pa.Table:
        lang, k, part = (group[c][0].as_py() for c in ("lang", "k", "part"))
        texts = [pa.array(_unpacked_phrases(x.as_py()), pa.binary()) for x in group["phrases"]]
        counts = np.concatenate([_unpacked(x.as_py()) for x in group["counts"]])
        sizes = [len(x) for x in texts]
        coded = pa.concat_arrays(texts).dictionary_encode()
        del texts
        number, names = coded.indices.to_numpy(), coded.dictionary
        row = np.repeat(np.arange(len(sizes)), sizes)
        shard = group["shard"].to_numpy()[row]
        need = group["need"].to_numpy()[row]
        candidate = np.zeros(len(names), dtype=bool)
        for s in np.unique(shard):
            own = shard == s
            mined = np.bincount(number[own], weights=counts[own], minlength=len(names))
            candidate |= mined >= need[own][0]
        a = np.bincount(number, weights=counts, minlength=len(names)).astype(np.int64)
        good = candidate & (a >= support)
        found = np.nonzero(good)[0]
        phrases = names.take(pa.array(found)).cast(pa.string())
        out = [pa.Table.from_arrays([pa.repeat(pa.scalar(lang), len(found)), pa.repeat(pa.scalar(k, pa.int32()), len(found)), phrases, pa.array(a[found]),
                                     pa.nulls(len(found), pa.int64()), pa.nulls(len(found), pa.int32()), pa.nulls(len(found), pa.binary())], schema=schema)]
        back = []
        chunks = group["chunk"].to_pylist()
        for i, hits in enumerate(np.split(good[number], np.cumsum(sizes)[:-1])):
            at = np.nonzero(hits)[0]
            if len(at):
                back.append({"lang": lang, "k": k, "chunk": chunks[i], "part": part, "at": _packed(at)})
        return pa.concat_tables([*out, pa.Table.from_pylist(back, schema=schema)])

    return lists.groupBy("lang", "k", "part").applyInArrow(run, "lang string, k int, phrase string, a long, chunk long, part int, at binary")


def _back(rows: DataFrame, name: str, buckets: int) -> DataFrame:
    """(chunk, ``name``): the places of its frequent phrases in every chunk, dealt like the chunks."""
    lists = rows.where("chunk IS NOT NULL").groupBy("chunk").agg(F.collect_list(F.struct("part", "at")).alias(name))
    return lists.repartition(buckets, "chunk")


def frequent_phrases(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, shards: int = SHARDS,
                     chunk_words: int = CHUNK_WORDS, part_words: int = PART_WORDS) -> tuple[DataFrame, DataFrame]:
    """All words and phrases of up to ``longest`` words that occur ``support``
    times in a language, (lang, phrase, k, a), and (lang, n), all words of it."""
    spark = docs.sparkSession
    buckets, stored_chunks = splits_of(docs), fresh_path(spark, "phrase-chunks")
    chunks = bucketed(chunked(docs, chunk_words, shards), "chunk", buckets, stored_chunks)
    by_lang = chunks.groupBy("lang").agg(F.sum("n").alias("n"))
    shares = written(chunks.groupBy("lang", "shard").agg(F.sum("n").alias("own")).join(by_lang, "lang")
                     .withColumn("need", F.expr(f"({support} * own + n - 1) div n"))
                     .withColumn("parts", F.expr(f"cast((n + {part_words} - 1) div {part_words} as int)")), "phrase-shares")
    sizes = shares.select("lang", "n").distinct()
    chunks = chunks.drop("n").join(shares.select("lang", "shard", "need", "parts"), ["lang", "shard"])

    with small_batches(spark, BATCH_BYTES):
        words = written(frequent(phrase_lists(chunks, "words"), support), "phrase-words")
        chunks = chunks.join(_back(words, "words_back", buckets), "chunk")
        pairs = written(frequent(phrase_lists(chunks, "pairs"), support), "phrase-pairs")
        found = words.unionByName(pairs)
        if longest > 2:
            chunks = chunks.join(_back(pairs, "pairs_back", buckets), "chunk")
            found = found.unionByName(written(frequent(phrase_lists(chunks, "longer", longest), support), "phrase-longer"))
    delete_paths(spark, [stored_chunks])
    return found.where("phrase IS NOT NULL").select("lang", "phrase", "k", "a"), sizes


def scored(found: DataFrame, sizes: DataFrame, cover_pct: int = 100) -> DataFrame:
    """Score of every phrase (lang, phrase, k, a, l, r, n, score) that no longer one stands for.

    A phrase is cut after each of its words but the last; ``l`` and ``r`` are the
    counts of the parts of the cut with the lowest floor(1000 a n / (l r)), the
    first one of equals. A phrase goes if it lies within a longer one that has
    ``cover_pct`` percent of its occurrences. Arithmetic is in 38 decimal digits.
    """
    long = found.where("k > 1")
    words = F.split("phrase", " ")

    def part(start, size):
        return F.array_join(F.slice(words, start, size), " ")

    # every phrase of two words and more within a longer one
    inner = long.where("k > 2").select("lang", F.col("a").alias("cover"), "phrase", F.explode(F.expr(
        "flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), s -> struct(s, m))))")).alias("x"))
    covers = inner.select("lang", part(F.col("x.s"), F.col("x.m")).alias("phrase"), "cover").groupBy("lang", "phrase").agg(F.max("cover").alias("cover"))
    left = long.join(covers, ["lang", "phrase"], "left").where(F.col("cover").isNull() | (100 * F.col("cover") < cover_pct * F.col("a"))).drop("cover")

    cuts = left.select("lang", "phrase", "k", "a", F.explode(F.expr("sequence(1, k - 1)")).alias("cut"))
    cuts = cuts.withColumn("lp", part(F.lit(1), F.col("cut"))).withColumn("rp", part(F.col("cut") + 1, F.col("k") - F.col("cut")))
    parts = found.select("lang", "phrase", "a")
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("lp"), F.col("a").alias("l")), ["lang", "lp"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("rp"), F.col("a").alias("r")), ["lang", "rp"]).join(sizes, "lang")
    cuts = cuts.withColumn("score", F.expr("(cast(1000 as decimal(38,0)) * cast(a as decimal(19,0)) * cast(n as decimal(19,0))) "
                                           "div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"))
    low = cuts.groupBy("lang", "phrase", "k", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("low"))
    return low.select("lang", "phrase", "k", "a", F.col("low.l").alias("l"), F.col("low.r").alias("r"), "n", F.col("low.score").alias("score"))


def collocations(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, top: int = TOP, shards: int = SHARDS,
                 chunk_words: int = CHUNK_WORDS, part_words: int = PART_WORDS) -> DataFrame:
    """Each language's ``top`` phrases by score, count and phrase.

    Returns lang, rank (from 1), phrase, k, a, l, r, n, score. Only ``lang`` and
    ``text`` of ``docs`` are read. A null text is empty; a null language counts as
    ``und``; repeated rows count each time; a language without a frequent phrase,
    or an empty table, gives no rows.
    """
    found, sizes = frequent_phrases(docs, support, longest, shards, chunk_words, part_words)
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    return (first_rows(scored(found, sizes), "lang", order, top, F.xxhash64("phrase"), "rank")
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "k", "a", "l", "r", "n", "score"))
