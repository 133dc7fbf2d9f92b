"""The pipeline's stages against brute-force versions, and its edge cases."""

import corpus_pipeline as pipeline
import pytest
from rookery.llm import packing, pii, toxicity
from test_packing import check
from test_simhash import expected

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs.cache())
    for _, stage in pipeline.STAGES:
        out.append(stage(spark, out[-1], SF).cache())
    return out


def test_stages_in_order():
    assert [name for name, _ in pipeline.STAGES] == ["toxicity", "simhash", "pii", "packing"]


def test_filters_keep_columns_and_rows(spark, stages):
    docs, clean, single, redacted, _ = stages
    for df in (clean, single, redacted):
        assert df.columns == COLUMNS and df.dtypes == docs.dtypes
    assert clean.exceptAll(docs).count() == 0 and single.exceptAll(clean).count() == 0
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    decoder = toxicity.Decoder(model.grams)
    want = {r.doc_id for r in docs.collect() if model.score(decoder.text_words(r.text)) < 0.5}
    assert {r.doc_id for r in clean.collect()} == want and len(want) > 0.8 * docs.count()


def test_one_document_of_each_group_stays(stages):
    rows = [(r.doc_id, r.text) for r in stages[1].collect()]
    want = sorted({c for _, _, c in expected(rows)})
    assert sorted(r.doc_id for r in stages[2].collect()) == want


def test_personal_data_is_gone(stages):
    before, auto = {r.doc_id: r for r in stages[2].collect()}, pii.anchors()
    kinds = frozenset(pii.KINDS) - {"url"}
    for r in stages[3].collect():
        old = before[r.doc_id]
        assert r.text == pii.redact(old.text, pii.find_spans(old.text, auto), kinds)
        assert r.n_chars == len(r.text) and (r.lang, r.source) == (old.lang, old.source)
        assert not [s for s in pii.find_spans(r.text, auto) if s[0] in pii.BASE_KINDS]


def test_every_document_is_packed(spark, stages):
    docs = stages[3]
    lengths = {r.doc_id: r.n for r in docs.select("doc_id", packing.token_length(docs.text).alias("n")).collect()}
    check(stages[4].collect(), lengths, packing.CAPACITY)


def test_run_gives_the_last_stage(spark, stages):
    got, want = pipeline.run(spark, SF), stages[4]
    key = lambda df: sorted(tuple(r) for r in df.select("doc_id", "piece", "piece_tokens", "bin_id", "bin_offset").collect())
    assert key(got) == key(want)


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)], [(1, None, None, None, None), (None, "a@b.cd x", "en", None, 8), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (3, "w " * 5000, "en", "s", 10000)]])
def test_nulls_repeats_and_empty_tables(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == COLUMNS
            docs = out
    assert out.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_near_copies_made_by_redaction_do_not_share_a_window(spark):
    text = "write to {}@mail.example.com about the offer of last week and the one before it "
    docs = spark.createDataFrame([(i, text.format(f"u{i}") * 3, "en", f"s{i}", 9) for i in range(6)], "doc_id long, text string, lang string, source string, n_chars long")
    redacted = pipeline.STAGES[2][1](spark, docs, SF)
    assert redacted.select("text").distinct().count() == 1
    out = pipeline.STAGES[3][1](spark, redacted, SF).collect()
    assert len({r.bin_id for r in out}) == 6


def test_large_ids_pass_all_stages(spark):
    ids = [9007199254740993, 9007199254740995]
    rows = [(ids[0], "first text with words", "en", "s", 21), (ids[1], "second one, quite different", "en", "s", 27), (ids[1] + 2, None, "en", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert sorted(r.doc_id for r in docs.collect()) == [ids[0], ids[1], ids[1] + 2]
