"""Deobfuscation, held-out accuracy and edge cases of the toxicity operator."""

import itertools
import random
import zlib

import numpy as np
import pytest
from rookery.llm import queries, toxicity

SF = "/root/testdata/sf0.1"


def grams(words):
    total = np.zeros(len(toxicity._SYMBOLS) ** 3, dtype=np.int64)
    toxicity.add_trigrams(total, " ".join(words), toxicity._letter_codes())
    return toxicity.named(total)


@pytest.fixture(scope="module")
def decoder():
    words = "you are an idiot stupid moron trash scum the then with loser clown good morning people write plain words and worthless pathetic text".split()
    return toxicity.Decoder(grams(words * 50))


def test_trigrams_of_words():
    got = grams(["ab", "c1d"])
    assert got == {"^^a": 1, "^ab": 1, "ab^": 1, "^^c": 1, "^c^": 1, "^^d": 1, "^d^": 1}


def test_trigrams_in_pieces(monkeypatch):
    words = ["hello", "wörld", "x", "naïve"] * 30
    whole = grams(words)
    monkeypatch.setattr(toxicity, "_PIECE", 7)
    assert grams(words) == whole


@pytest.mark.parametrize("token,word", [("1d10t", "idiot"), ("$tupid", "stupid"), ("m0r0n!", "moron"), ("tr@sh", "trash"), ("stuuuupid", "stupid"), ("5cum", "scum"), ("l.o.s.e.r", "loser"),
                                        ("idiot###", "idiot"), ("(trash)", "trash"), ("id*ot", "idiot"), ("then", "then"), ("the...", "the")])
def test_tokens(decoder, token, word):
    assert decoder.restore(token) == (word,)


def test_texts(decoder):
    assert {"you", "idiot"} <= decoder.text_words("YOU are an I D I O T today")
    assert "stupid" in decoder.text_words("s-t-u-p-i-d!")
    assert decoder.text_words("1 2 3 4 5 225-1234 ### --") == set()
    assert decoder.text_words(None) == decoder.text_words("") == set()
    assert decoder.text_words("a" * 100_000) and decoder.text_words("1a" * 2000)


@pytest.mark.parametrize("token,words", [("id-iot", ("idiot",)), ("stu_pid", ("stupid",)), ("wor.thless", ("worthless",)), ("l'oser", ("loser",)), ("tra/sh", ("trash",)),
                                         ("iiddiioott", ("idiot",)), ("trraasshh", ("trash",)), ("stuupid", ("stupid",)), ("sstuuuupid", ("stupid",)), ("m00rroonn", ("moron",)),
                                         ("good-morning", ("good", "morning")), ("people/trash", ("people", "trash")), ("good", ("good",))])
def test_split_and_doubled_tokens(decoder, token, words):
    assert decoder.restore(token) == words


@pytest.mark.parametrize("text", ["s c u m", "you s\tc\tu\tm!", "s   c   u   m", "s\nc\nu\nm", "s - c - u - m", "s.c u.m"])
def test_words_pulled_apart(decoder, text):
    assert "scum" in decoder.text_words(text)


def test_short_and_repeating_words_pulled_apart():
    decoder = toxicity.Decoder(grams("plain words and poop by the sod with mud".split() * 50))
    assert "poop" in decoder.text_words("plain p o o p words")
    assert "sod" in decoder.text_words("plain s o d words")
    assert {"plain", "words"} == decoder.text_words("plain 1 2 3 words")


def test_held_out_accuracy(spark):
    rows = queries.op6_toxicity(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(rows) == docs.count()
    labels = {}
    for r in spark.read.parquet(f"{SF}/labels.parquet").collect():
        labels[r.doc_id] = max(labels.get(r.doc_id, 0), r.toxic)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    hit = sum(y and p for y, p in held)
    assert hit / sum(y for y, _ in held) >= 0.85  # a tenth of the labels are noise
    assert sum(p and not y for y, p in held) / sum(not y for y, _ in held) <= 0.01


def made(spark, n=60):
    rows, labels = [], []
    for i in range(n):
        toxic = i % 3 == 0
        rows.append((i, f"plain text number{i} with {'idiot' if toxic else 'people'} words", i))
        labels.append((i, int(toxic)))
    return rows, labels


def test_disguised_words_and_edge_cases(spark):
    rows, labels = made(spark)
    rows += [(1000, "plain 1d10t words", 0), (1001, None, 0), (1002, "", 0), (None, "an idiot here", 0), (1002, "", 0)]
    labels += [(None, 1), (2, None), (5, 0), (5, 0), (99999, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score long")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, marks)
    got = toxicity.scores(docs, model)
    assert got.columns == ["doc_id", "text", "score"] and got.count() == len(rows)
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, []).append(r.score)
    assert by[1000][0] >= 0.5 and by[None][0] >= 0.5
    assert by[1001][0] < 0.5 and by[1001] * 2 == by[1002]
    kept = toxicity.without_toxic(docs, marks)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    assert {r.doc_id for r in kept.collect()} == {i for i in range(60) if i % 3} | {1001, 1002}


def test_labels_of_held_out_rows_are_not_used(spark):
    rows, labels = made(spark)
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long")
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    one, two = (toxicity.train(docs, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, flipped))
    assert one == two


def test_without_labels_or_documents(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    docs = spark.createDataFrame([(1, "an idiot")], "doc_id long, text string")
    assert toxicity.scores(docs, toxicity.train(docs, none)).first().score < 0.5
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert toxicity.without_toxic(empty, none).collect() == []


def test_rare_toxic_word_enters_the_model(spark):
    rows, labels = [], []
    # six of the 322 toxic documents that are learned from have the rare insult, the others a common one
    rare = [i for i in range(0, 4000, 10) if zlib.crc32(str(i).encode()) % 5][:6]
    for i in range(4000):
        toxic = i % 10 == 0
        word = ("clodpole" if i in rare else "idiot") if toxic else "people"
        rows.append((i, f"plain text with {word} words"))
        labels.append((i, int(toxic)))
    rows += [(i, "plain text with clodpole words") for i in (9001, 9002)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert {"idiot", "clodpole"} <= model.weights.keys()
    assert all(r.score >= 0.5 for r in toxicity.scores(docs.where("doc_id > 9000"), model).collect())


def all_readings(decoder, lattice):
    """Every way through a lattice that leaves no empty word, with its cost, by the definition of the model."""
    for way in itertools.product(*lattice):
        text = "".join(x for x, _ in way)
        if " " in text and not all(text.split(" ")[:-1]):
            continue
        cost = sum(c for _, c in way)
        a = b = toxicity._EDGE
        for c in text + " ":
            k = toxicity._EDGE if c == " " else c if c in toxicity.LETTERS else "?"
            cost -= decoder.log_p(a, b, k)
            a, b = (toxicity._EDGE, toxicity._EDGE) if c == " " else (b, k)
        yield cost, text


@pytest.mark.parametrize("token", ["1d10t", "s t u", "id-iot", "aabbcc", "f**l", "w0rd!", "ttrraa", "x.y.z", "$$a1", "hello", "жx1", "l00ss", "5p4m", "a'b"])
@pytest.mark.parametrize("stretched", [False, True])
def test_search_against_all_readings(decoder, token, stretched):
    lattice = decoder.lattice(token, stretched)
    cost, text = decoder._search(lattice)
    readings = list(all_readings(decoder, lattice))
    assert cost == pytest.approx(min(c for c, _ in readings)) and text in {t for c, t in readings if c <= cost + 1e-9}


def test_words_of_letters_are_read_as_by_the_search(decoder):
    rng = random.Random(6)
    words = ["hello", "iiddiioott", "stuuupid", "aaa", "aa", "ttrraasshh", "bookkeeper", "ßß", "жжx"]
    words += ["".join(rng.choice("abdiostu") * rng.choice([1, 1, 1, 2, 3]) for _ in range(rng.randint(1, 8))) for _ in range(500)]
    for word in words:
        assert decoder.decode(word) == decoder._decode(word), word


def test_beginnings_hold_for_every_reading(decoder):
    rng = random.Random(4)
    for _ in range(200):
        word = "".join(rng.choice("abst") * rng.choice([1, 1, 2, 3]) for _ in range(rng.randint(1, 5)))
        for reading in (decoder.decode(word), decoder._search(decoder.lattice(word, True))[1]):
            assert reading[:3] in toxicity.beginnings(word, 3), word


def test_words_that_are_asked_for_are_found_as_without_asking(decoder):
    only = {"idi*", "stupid", "tra**", "as", "cat"}
    asked = toxicity.Decoder(decoder.grams, only)
    rng = random.Random(5)
    tokens = ["idiot", "iidiott", "stuupid", "ttraash", "aas", "cat", "caat", "id1ot", "s.t.u.p.i.d", "traashh", "assess", "hello", "bookkeeper"]
    tokens += ["".join(rng.choice("acdiopstru") * rng.choice([1, 1, 1, 2, 3]) for _ in range(rng.randint(2, 7))) for _ in range(300)]
    for token in tokens:
        want = tuple(w for w in decoder.restore(token) if w[:3] in asked.roots and asked._asked_for(w))
        assert asked.restore(token) == want, token


def test_fit_against_a_plain_solver():
    """The sparse fit finds the weights of Newton steps on the whole matrix."""
    rng = np.random.default_rng(2)
    width = 30
    rows = []
    for _ in range(400):
        words = tuple(sorted(rng.choice(width, rng.integers(0, 5), replace=False).tolist()))
        rows.append((words, int(rng.random() < (0.8 if set(words) & {1, 2, 3} else 0.1)), float(rng.integers(1, 4))))
    x = np.zeros((len(rows), width + 1))
    x[:, -1] = 1
    for i, (words, _, _) in enumerate(rows):
        x[i, list(words)] = 1
    y, n = np.array([r[1] for r in rows], float), np.array([r[2] for r in rows])
    ridge = np.array([toxicity.RIDGE] * width + [1e-3])
    w = np.zeros(width + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x.T * (n * p * (1 - p))) @ x + np.diag(ridge), x.T @ (n * (p - y)) + ridge * w)
        w -= step * min(1.0, 2.0 / max(float(np.abs(step).max()), 1e-12))
    bias, weights = toxicity._fit(rows, width)
    assert np.allclose(np.append(weights, bias), w, atol=1e-5)


def test_many_words_make_up_a_model():
    """More words than a dense matrix of the sample would hold."""
    rows = [((3 * i, 3 * i + 1, 3 * i + 2), i % 2, 1.0) for i in range(7000)]
    bias, weights = toxicity._fit(rows, 21_000)
    assert len(weights) == 21_000 and weights[3] > 0 > weights[0] and np.isfinite(weights).all()
