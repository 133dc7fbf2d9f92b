"""One registered query per operator, over its whole table.

Each query applies the operator with its production parameters and derives the
columns it returns from the operator's own output. ``ORACLE`` has the queries
that SQL can express; tests compare the others with brute-force versions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann_forest, bpe_words, embed_dedup, html_layout, langid, packing, phrases, pii, simhash, token_hist, toxicity, variants, warc
from .tables import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.detect(table(spark, sf_dir, "documents")))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_layout.extract(table(spark, sf_dir, "pages"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(table(spark, sf_dir, "pages"), payloads=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.scores(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, groups=simhash.near_duplicates(docs))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return token_hist.token_counts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann_forest.search(vectors, vectors.where("vec_id % 100 = 0"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe_words.encode_decode(table(spark, sf_dir, "documents"), path, full=False)


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents")).drop("k")


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(table(spark, sf_dir, "documents"))


def op13_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predictions(docs, langid.train(docs))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_pii": op2_pii,
    "op3_html_text": op3_html_text,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_warc": op5_warc,
    "op6_toxicity": op6_toxicity,
    "op7_packing": op7_packing,
    "op8_token_counts": op8_token_counts,
    "op9_ann": op9_ann,
    "op10_bpe": op10_bpe,
    "op11_phrases": op11_phrases,
    "op12_variants": op12_variants,
    "op13_langid": op13_langid,
}

ORACLE: dict[str, str] = {
    "op4_embedding_dedup": """
        WITH RECURSIVE v AS (
               SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
               WHERE label IS NOT NULL AND len(embedding) > 0
                 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
             u AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v),
             links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
                       WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
             reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
        SELECT m.vec_id, coalesce(n.n_links, 0) AS n_links, m.component_id, m.vec_id = m.component_id AS kept
        FROM (SELECT x AS vec_id, min(y) AS component_id FROM reach GROUP BY x) m
        LEFT JOIN (SELECT x, count(*) AS n_links FROM links GROUP BY x) n ON m.vec_id = n.x""",
    "op5_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
             d AS (SELECT page_id, octet_length(encode(html)) AS n, sha256(html) AS digest FROM p),
             f AS (SELECT digest, min(page_id) AS first_id FROM d WHERE n >= 100 GROUP BY digest)
        SELECT d.page_id, CAST(d.n AS BIGINT) AS payload_bytes, d.digest AS payload_digest,
               CASE WHEN f.first_id IS NULL OR f.first_id = d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN f.first_id <> d.page_id THEN f.first_id END AS refers_to
        FROM d LEFT JOIN f ON d.digest = f.digest AND d.n >= 100""",
    "op11_phrases": """
        WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
                   FROM documents),
             p AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM t),
             w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
             n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
             s AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT lang, w, unnest(range(1, 6)) AS k FROM w) x WHERE len(w) >= k),
             f AS (SELECT lang, phrase, k, count(*) AS a FROM (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM s) x
                   GROUP BY lang, phrase, k HAVING count(*) >= 100),
             c AS (SELECT lang, phrase, k, a, string_split(phrase, ' ') AS v FROM f WHERE k > 1),
             i AS (SELECT lang, v, a, k, m, unnest(range(1, k - m + 2)) AS i FROM (SELECT lang, v, a, k, unnest(range(2, k)) AS m FROM c) x),
             h AS (SELECT lang, array_to_string(v[i:i + m - 1], ' ') AS phrase, max(a) AS cover FROM i GROUP BY ALL),
             cuts AS (SELECT c.lang, c.phrase, c.a, x.a AS l, y.a AS r, n.n, j,
                             CAST(1000 AS HUGEINT) * c.a * n.n // (CAST(x.a AS HUGEINT) * y.a) AS score
                      FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c
                      JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.v[1:c.j], ' ')
                      JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.v[c.j + 1:c.k], ' ')
                      JOIN n ON n.lang = c.lang
                      LEFT JOIN h ON h.lang = c.lang AND h.phrase = c.phrase
                      WHERE h.cover IS NULL OR 100 * h.cover < 100 * c.a),
             low AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l,
               CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
        FROM low QUALIFY rank <= 2000""",
}
