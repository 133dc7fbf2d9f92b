"""BPE through the distinct-word table against the library."""

import hashlib
import random

import pytest
import public_tokenizers
from rookery.llm import bpe_words, queries
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
SPLIT = bpe_words.Splitter(PATH)


def encoded(text):
    words, mapped = SPLIT.words(text)
    out = []
    for w in words:
        if mapped and w in SPLIT.special:
            out.append(LIBRARY.token_to_id(w))
        else:
            out += [t.id for t in LIBRARY.model.tokenize(w if mapped else SPLIT.mapped(w))]
    return out


def test_words_of_random_texts():
    rng = random.Random(2)
    low = [chr(c) for c in range(0x180)]
    some = list("''''''sstrevmld  !<|>")
    other = ["<|endoftext|>", "<|startoftext|>", "Σ", "字", "İ", "́", "’", "\U0001d4b3", "힣", "​", " "]
    for k in range(20000):
        letters = [low + some, some + low[:128], low + some + other][k % 3]
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 24)))
        assert encoded(text) == LIBRARY.encode(text, add_special_tokens=False).ids, text


def want(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    return ids, LIBRARY.decode(ids, skip_special_tokens=False)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query_on_the_test_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op10_bpe(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids, decoded = want(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(decoded))


@pytest.mark.parametrize("chunk_chars", [1, 40, 1 << 23])
def test_edge_cases(spark, chunk_chars):
    texts = [None, "", "  \n", "Hello World's", "ÀÉ ½ don'T", "x" * 3000, "a<|endoftext|>b", "字 Σας", "same same same", "same same same", "\x00\x1c"]
    rows = [(i if i != 4 else None, t, "c", 1) for i, t in enumerate(texts)] + [(3, texts[3], "c", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, chunk int")
    got = bpe_words.encode_decode(docs, PATH, chunk_chars=chunk_chars).collect()
    assert sorted((str(r.doc_id), list(r.ids), r.decoded) for r in got) == sorted((str(d), *want(t)) for d, t, _, _ in rows)
    for r in got:
        assert r.n_tokens == len(r.ids) and r.ids_sha256 == sha(" ".join(map(str, r.ids))) and r.decoded_sha256 == sha(r.decoded)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe_words.encode_decode(docs, PATH).collect() == []
