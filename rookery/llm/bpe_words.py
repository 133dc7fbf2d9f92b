"""BPE encoding and decoding through a table of distinct words.

    chunks    texts are split into words in Spark; a chunk of documents keeps its
              distinct words once and, for each document, their numbers in order
    words     every chunk's words meet sorted by word; each distinct word is
              encoded once, and its ids go back to the places it came from
    texts     every chunk gets the ids of its own words by a join on the chunk,
              its documents read them off by position, and the ids are joined
              with the id-to-piece table

The chunks are a table bucketed by chunk, so that the last join moves the ids of
words but not the texts. The id-to-piece table is as large as the tokenizer's
vocabulary, whatever the corpus, and is joined in the task.

The words and ids are those of the tokenizer file: its normalizer and
pre-tokenizer define the words, its merges the ids, special tokens in a text are
words of their own. Texts whose characters all lie below U+0180 (without U+0130)
are split by an equal regular expression; any other text by the library itself.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import fresh_path

#: A chunk is closed when its texts reach this many characters.
CHUNK_CHARS = 1 << 25

# Fixed values of the tokenizer's pattern within the characters below U+0180.
_SPACE = r"\t\n\x0b\x0c\r \x85\xa0"
_LETTER = "a-zA-ZªµºÀ-ÖØ-öø-ſ"
_NUMBER = "0-9²³¹¼½¾"
_WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")
_PLAIN = re.compile(r"[\x00-įı-ſ]*")


def _byte_letters() -> str:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = (b for b in range(256) if b not in set(shown))
    table = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return "".join(table[b] for b in range(256))


class Splitter:
    """Splits texts into the words of a tokenizer, written in its byte letters."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            text = f.read()
        self.tokenizer = Tokenizer.from_str(text)
        self.special = [t["content"] for t in json.loads(text)["added_tokens"]]
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.letters = {i: c for i, c in enumerate(_byte_letters())}

    def mapped(self, word: str) -> str:
        return word.encode("utf-8").decode("latin-1").translate(self.letters)

    def words(self, text: str) -> tuple[list[str], bool]:
        """Words of a text in order; whether they are in byte letters yet."""
        if _PLAIN.fullmatch(text) and not self.at_special.search(text):
            return _WORD.findall(text.lower()), False
        out: list[str] = []
        for part in self.at_special.split(text):
            if part in self.special:
                out.append(part)
            elif part:
                plain = self.tokenizer.normalizer.normalize_str(part)
                out += [w for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(plain)]
        return out, True


def _packed(codes: np.ndarray) -> bytes:
    """Word numbers, compressed by their bytes: the low ones of all, then the next."""
    import zstandard

    return zstandard.compress(np.ascontiguousarray(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 6)


def _unpacked(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.decompress(data), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def chunked(docs: DataFrame, path: str, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Chunks of documents: chunk, doc_ids, sizes, words, codes.

    ``words`` are the chunk's distinct words, frequent ones first; ``codes`` the
    compressed numbers of the words of all its documents one after the other;
    ``sizes`` how many words each document has. A chunk holds ``chunk_chars``
    characters and one more document at most. Chunks are numbered by partition
    and order; the table has to be written before use.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        split = Splitter(path)
        first = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        n = 0
        doc_ids: list = []
        sizes: list[int] = []
        codes: list[np.ndarray] = []
        plain: dict[str, int] = {}
        number: dict[str, int] = {}
        chars = 0

        def closed() -> pa.RecordBatch:
            nonlocal n, chars
            flat = np.concatenate(codes)
            order = np.argsort(-np.bincount(flat, minlength=len(number)), kind="stable")
            rank = np.empty(len(order), dtype=np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            names = list(number)
            batch = pa.RecordBatch.from_arrays(
                [pa.array([first + n], pa.int64()), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int32())),
                 pa.array([[names[i] for i in order.tolist()]], pa.list_(pa.string())), pa.array([_packed(rank[flat])], pa.binary())], schema=schema)
            n, chars = n + 1, 0
            for held in (doc_ids, sizes, codes, plain, number):
                held.clear()
            return batch

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py() or ""
                words, mapped = split.words(text)
                if mapped:
                    row = [number.setdefault(w, len(number)) for w in words]
                else:
                    for w in set(words).difference(plain):  # a word as split has the number of its byte letters
                        plain[w] = number.setdefault(split.mapped(w), len(number))
                    row = list(map(plain.__getitem__, words))
                doc_ids.append(doc_id.as_py())
                sizes.append(len(row))
                codes.append(np.array(row, dtype=np.uint32))
                chars += len(text)
                if chars >= chunk_chars:
                    yield closed()
        if doc_ids:
            yield closed()

    schema = pa.schema([("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("words", pa.list_(pa.string())), ("codes", pa.binary())])
    return (docs.select(F.col("doc_id").cast("long"), "text")
            .mapInArrow(run, "chunk long, doc_ids array<long>, sizes array<int>, words array<string>, codes binary"))


def _bucketed(chunks: DataFrame) -> DataFrame:
    """The chunks as a table below the shared folder, bucketed by chunk; its entry in the catalog goes at once."""
    spark = chunks.sparkSession
    name = f"bpe_chunks_{uuid.uuid4().hex}"
    (chunks.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "chunk")
     .option("path", fresh_path(spark, "bpe-chunks")).option("compression", "zstd").saveAsTable(name))
    out = spark.table(name)
    out.schema  # resolved, with its files, before the entry goes
    spark.sql(f"DROP TABLE {name}")
    return out


def pieces(path: str) -> list[str]:
    """The tokenizer's pieces by id."""
    from tokenizers import Tokenizer

    vocabulary = Tokenizer.from_file(path).get_vocab(with_added_tokens=True)
    out = [""] * (max(vocabulary.values()) + 1)
    for piece, i in vocabulary.items():
        out[i] = piece
    return out


def word_ids(places: DataFrame, path: str) -> DataFrame:
    """(chunk, at, ids) of rows (chunk, at, word); ``ids`` are packed 32-bit numbers.

    Rows meet by word and come sorted, so each distinct word is encoded once. A
    word is there once for each chunk that holds it, however frequent it is.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Splitter(path)
        special = {s: split.tokenizer.token_to_id(s) for s in split.special}
        last, known = None, b""
        for batch in batches:
            out = []
            for w in batch.column(2).to_pylist():
                if w != last:
                    ids = [special[w]] if w in special else [t.id for t in split.tokenizer.model.tokenize(w)]
                    last, known = w, np.array(ids, dtype="<u4").tobytes()
                out.append(known)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["chunk", "at", "ids"])

    return (places.select("chunk", "at", "word").repartition("word").sortWithinPartitions("word")
            .mapInArrow(run, "chunk long, at int, ids binary"))


def encode_decode(docs: DataFrame, path: str, full: bool = True, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Encode every text and decode it again.

    Returns doc_id, n_tokens, ids_sha256 and decoded_sha256 (of the decimal ids
    and of the decoded text), and with ``full`` also ``ids`` (array<int>) and
    ``decoded``. A null text counts as empty and has no tokens. Every input row
    gives one row, repeated rows and null ids included; an empty table gives an
    empty table. Only doc_id and text are read.
    """
    chunks = _bucketed(chunked(docs, path, chunk_chars))
    places = chunks.select("chunk", F.posexplode("words").alias("at", "word"))
    own = word_ids(places, path).groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("at", "ids"))).alias("t"))
    own = own.select("chunk", F.col("t.ids").alias("ids"))
    table = docs.sparkSession.sparkContext.broadcast(pieces(path))

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                                          names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = table.value
        for batch in batches:
            for k in range(batch.num_rows):
                doc_ids, sizes, codes, ids = (batch.column(i)[k].as_py() for i in range(4))
                word_n, word_text, word_piece = [], [], []
                for packed in ids or []:
                    own_ids = np.frombuffer(packed, dtype="<u4").tolist()
                    word_n.append(len(own_ids))
                    word_text.append(" ".join(map(str, own_ids)))
                    word_piece.append(" ".join([piece[i] for i in own_ids]))
                n, codes = np.array(word_n, dtype=np.int64), _unpacked(codes)
                at, held, out = 0, 0, []
                for doc_id, size in zip(doc_ids, sizes):
                    code = codes[at:at + size]
                    at += size
                    order = code.tolist()
                    text_ids = " ".join(map(word_text.__getitem__, order))
                    decoded = " ".join(map(word_piece.__getitem__, order))
                    out.append((doc_id, int(n[code].sum()) if size else 0, hashlib.sha256(text_ids.encode()).hexdigest(),
                                hashlib.sha256(decoded.encode("utf-8")).hexdigest(), text_ids if full else None, decoded if full else None))
                    held += len(text_ids) + len(decoded) if full else 0
                    if held > (1 << 24):
                        yield batch_of(out)
                        out, held = [], 0
                if out:
                    yield batch_of(out)

    kind = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids string, decoded string"
    rows = (chunks.select("chunk", "doc_ids", "sizes", "codes").join(own, "chunk", "left")
            .select("doc_ids", "sizes", "codes", "ids").mapInArrow(run, kind))
    if not full:
        return rows.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    ids = F.when(F.col("ids") == "", F.array().cast("array<int>")).otherwise(F.split("ids", " ").cast("array<int>"))
    return rows.withColumn("ids", ids)
