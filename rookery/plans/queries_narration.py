"""Narration queries: prompts, reply checks, anchor timing, playback, JSON I/O."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import START_FEN
from ..operators import narration as nr
from ..session import fresh_path
from ..sources import narration_io
from ..sources import testdata as td
from .catalog import register
from .queries_evals import DIFF_CTE

FINAL = td.PARA_FINAL_INDEX
WORDS = r"len(list_filter(string_split_regex({x}, '\s+'), lambda w: w != ''))"
KEY = r"array_to_string(list_slice(string_split_regex(trim({x}), '\s+'), 1, 4), ' ')"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nr.documents_from_paragraphs(td.para(spark, sf_dir))


def _paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraph rows with resolved anchor indexes (the view carries them)."""
    return td.para(spark, sf_dir).select(
        "g", "p", "text", F.array(F.struct("fen", "trigger_word", "fen_idx")).alias("anchors"))


# ------------------------------------------------------------------ anchors
register("broken_anchors",
         lambda s, d: nr.broken_anchors(nr.anchor_rows(_docs(s, d))),
         """SELECT g, CAST(p AS INT) AS p, 0 AS a, trigger_word FROM para
            WHERE trigger_word != '' AND NOT contains(text, trigger_word)""", ("para",))

ANCHOR_CTE = f"""
, par AS (SELECT g, p, text, trigger_word, fen, fen_idx, {WORDS.format(x='text')} AS n_words FROM para)
, par2 AS (
  SELECT *, COALESCE(SUM(n_words) OVER (PARTITION BY g ORDER BY p
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS words_before,
         GREATEST(SUM(n_words) OVER (PARTITION BY g), 1) AS total_words
  FROM par)
, anc AS (
  SELECT g, p, fen_idx, total_words,
         COALESCE(trigger_word != '' AND fen != '' AND strpos(text, trigger_word) > 0 AND fen_idx >= 0, false)
           AS valid,
         CASE WHEN trigger_word != '' AND fen != '' AND strpos(text, trigger_word) > 0 AND fen_idx >= 0
              THEN words_before + {WORDS.format(x="substr(text, 1, strpos(text, trigger_word) - 1)")} END
           AS word_pos
  FROM par2)
, fr AS (SELECT *, CASE WHEN valid THEN ROUND_EVEN(word_pos / total_words, 6) END AS word_frac FROM anc)
, kp AS (
  SELECT *, valid AND fen_idx > COALESCE(MAX(CASE WHEN valid THEN fen_idx END) OVER (
              PARTITION BY g ORDER BY word_frac NULLS FIRST, p
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS kept
  FROM fr)
, lst AS (
  SELECT g, MAX(CASE WHEN kept THEN fen_idx END) AS last_idx,
         arg_max(word_frac, fen_idx) FILTER (WHERE kept) AS last_frac
  FROM kp GROUP BY g)
, ta AS (
  SELECT g, fen_idx, word_frac FROM kp WHERE kept
  UNION ALL
  SELECT g, {FINAL} AS fen_idx,
         ROUND_EVEN(COALESCE(last_frac, 0.0) + (1.0 - COALESCE(last_frac, 0.0)) * 0.65, 6) AS word_frac
  FROM lst WHERE {FINAL} > 0 AND (last_idx IS NULL OR last_idx < {FINAL}))
"""

register("anchor_word_pos", lambda s, d: nr.anchor_word_pos(_paragraphs(s, d)),
         ANCHOR_CTE + """SELECT g, p, 0 AS a, valid, fen_idx, CAST(word_pos AS BIGINT) AS word_pos,
                                CAST(total_words AS BIGINT) AS total_words
                         FROM anc""", ("para",))
register("timed_anchors", lambda s, d: nr.timed_anchors(_paragraphs(s, d), FINAL),
         ANCHOR_CTE + "SELECT * FROM ta", ("para",))

TICKS = 50


def _playback(spark: SparkSession, sf_dir: str) -> DataFrame:
    anchors = nr.timed_anchors(_paragraphs(spark, sf_dir), FINAL)
    totals = td.para(spark, sf_dir).select("g").distinct().withColumn("total", F.lit(FINAL + 1))
    return nr.playback_index(anchors, totals, TICKS)


register("playback_index", _playback, ANCHOR_CTE + f"""
, docs AS (SELECT DISTINCT g FROM para)
, tk AS (SELECT g, CAST(r.k AS INT) AS k,
                LEAST(GREATEST((CAST(r.k AS DOUBLE) + 0.5) / {float(TICKS)}, 0.0), 1.0) AS f
         FROM docs, range(0, {TICKS}) r(k))
, ends AS (SELECT g, MIN(word_frac) AS fw, MIN(fen_idx) AS fi, MAX(word_frac) AS lw, MAX(fen_idx) AS li
           FROM ta GROUP BY g)
, nb AS (
  SELECT tk.g, tk.k, tk.f, e.fw, e.fi, e.lw, e.li,
         (SELECT MAX(word_frac) FROM ta WHERE ta.g = tk.g AND ta.word_frac <= tk.f) AS pw,
         (SELECT MAX(fen_idx) FROM ta WHERE ta.g = tk.g AND ta.word_frac <= tk.f) AS pi,
         (SELECT MIN(word_frac) FROM ta WHERE ta.g = tk.g AND ta.word_frac > tk.f) AS nw,
         (SELECT MIN(fen_idx) FROM ta WHERE ta.g = tk.g AND ta.word_frac > tk.f) AS ni
  FROM tk LEFT JOIN ends e ON tk.g = e.g)
, raw AS (
  SELECT g, k, f, CAST(CASE
           WHEN fw IS NULL THEN LEAST(FLOOR(f * {FINAL + 1}), {FINAL})
           WHEN f <= fw THEN CASE WHEN fw > 0 THEN FLOOR(f / fw * fi + 0.5) ELSE 0 END
           WHEN f >= lw THEN LEAST(li + FLOOR(CASE WHEN 1.0 - lw > 0 THEN (f - lw) / (1.0 - lw) ELSE 1.0 END
                                             * ({FINAL} - li) + 0.5), {FINAL})
           ELSE FLOOR(pi + (f - pw) / (nw - pw) * (ni - pi) + 0.5) END AS INT) AS raw_idx
  FROM nb)
SELECT g, k, f, raw_idx,
       CAST(GREATEST(0, MAX(LEAST(raw_idx, {FINAL})) OVER (PARTITION BY g ORDER BY k
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS INT) AS fen_idx
FROM raw""", ("para",))

START_KEY = " ".join(START_FEN.split()[:4])

register("document_positions", lambda s, d: nr.document_positions(nr.anchor_rows(_docs(s, d))), f"""
, a AS (SELECT g, p, fen, {KEY.format(x='fen')} AS key FROM para WHERE fen != '')
, f AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY g, key ORDER BY p) AS r FROM a WHERE key != '{START_KEY}')
SELECT g, 0 AS idx, '{START_FEN}' AS fen FROM (SELECT DISTINCT g FROM para)
UNION ALL
SELECT g, CAST(ROW_NUMBER() OVER (PARTITION BY g ORDER BY p) AS INT) AS idx, fen FROM f WHERE r = 1""",
         ("para",))

register("last_anchor", lambda s, d: nr.last_anchor(_docs(s, d)),
         "SELECT g, arg_max(fen, p) FILTER (WHERE fen != '') AS fen FROM para GROUP BY g", ("para",))

register("narration_text", lambda s, d: nr.narration_text(_docs(s, d)),
         "SELECT g, string_agg(text, chr(10) || chr(10) ORDER BY p) AS text FROM para GROUP BY g", ("para",))


def _anchor_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ply's position looked up in its game's FEN list. The list is the
    document's: start position at index 0 and again as ``moves[0]`` (index 1),
    then ply k at index k + 2."""
    plies = td.plies(spark, sf_dir).select(F.col("game_id").alias("g"), "ply", "fen")
    # the two start entries come along with the first ply, in the same scan
    entry = lambda idx, fen: F.struct(idx.cast("int").alias("idx"), fen.alias("fen"))
    own, start = entry(F.col("ply") + 2, F.col("fen")), F.lit(START_FEN)
    entries = F.when(F.col("ply") == 0, F.array(entry(F.lit(0), start), entry(F.lit(1), start), own)).otherwise(F.array(own))
    positions = plies.select("g", F.explode(entries).alias("e")).select("g", "e.idx", "e.fen")
    return nr.anchor_positions(plies, positions).select("g", "ply", "fen_idx")


register("anchor_positions", _anchor_positions, f"""
, pos AS (SELECT game_id AS g, ply + 2 AS idx, fen FROM plies
          UNION ALL SELECT DISTINCT game_id, 0, '{START_FEN}' FROM plies
          UNION ALL SELECT DISTINCT game_id, 1, '{START_FEN}' FROM plies)
, lst AS (SELECT g, {KEY.format(x='fen')} AS key, CAST(MAX(idx) AS INT) AS fen_idx FROM pos GROUP BY 1, 2)
SELECT p.game_id AS g, p.ply, l.fen_idx
FROM plies p JOIN lst l ON p.game_id = l.g AND {KEY.format(x='p.fen')} = l.key""", ("plies",))

# ------------------------------------------------------------------ prompts
TP_CTE = """
, tpg AS (SELECT game_id, COUNT(*) AS n FROM dd GROUP BY game_id)
, tpt AS (SELECT game_id, ply FROM (
            SELECT *, ROW_NUMBER() OVER (PARTITION BY game_id ORDER BY ABS(diff) DESC, ply) AS rk
            FROM dd WHERE ply >= LEAST(5, n_plies)) WHERE rk = 1)
, tp AS (SELECT tpg.game_id, COALESCE(tpt.ply, tpg.n - 1) AS turning_ply
         FROM tpg LEFT JOIN tpt ON tpg.game_id = tpt.game_id)
, info AS (SELECT game_id, white, black, result, eco, opening, white_elo, black_elo FROM games)
, j AS (SELECT dd.*, COALESCE(i.white, 'White') AS white, COALESCE(i.black, 'Black') AS black,
               COALESCE(i.result, '*') AS result, tp.turning_ply
        FROM dd LEFT JOIN info i ON dd.game_id = i.game_id JOIN tp ON dd.game_id = tp.game_id)
, lines AS (
  SELECT game_id, ply,
    concat_ws('; ', 'ply=' || ply, 'move=' || move_number || CASE color WHEN 'white' THEN '.' ELSE '...' END || coalesce(san, ''),
      'score=' || coalesce('mate' || printf('%+d', mate), printf('%+d', cp), 'none'),
      'swing=' || nullif(abs(diff), 0), 'error_by=' || CASE blame WHEN 'white' THEN white WHEN 'black' THEN black END,
      'better=' || CASE WHEN blame IS NOT NULL THEN nullif(best_san, '') END,
      CASE WHEN ply = turning_ply THEN 'turning_point' END, 'phase=' || nullif(tag, ''), 'position=' || coalesce(fen, '')) AS line
  FROM j)
, wb AS (SELECT * FROM (
           SELECT *, ROW_NUMBER() OVER (PARTITION BY game_id ORDER BY ABS(diff) DESC, ply) AS rk
           FROM dd WHERE blame IS NOT NULL AND ply >= LEAST(5, n_plies)) WHERE rk = 1)
, facts AS (
  SELECT *, concat_ws(chr(10), concat_ws('; ', 'result=' || result, 'winner=' || winner), worst) AS facts FROM (
    SELECT g.game_id, g.n AS n_plies, coalesce(i.result, '*') AS result,
      CASE i.result WHEN '1-0' THEN i.white || ', white' WHEN '0-1' THEN i.black || ', black' ELSE 'none' END AS winner,
      CASE WHEN wb.blame IS NOT NULL THEN concat_ws('; ',
        'worst_move=' || wb.move_number || CASE wb.color WHEN 'white' THEN '.' ELSE '...' END || coalesce(wb.san, ''),
        'by=' || CASE wb.blame WHEN 'white' THEN coalesce(i.white, 'White') ELSE coalesce(i.black, 'Black') END,
        'side=' || wb.blame, 'swing=' || abs(wb.diff)) END AS worst
    FROM tpg g LEFT JOIN wb ON g.game_id = wb.game_id LEFT JOIN info i ON g.game_id = i.game_id))
"""


def _gp(fn):
    return lambda s, d: fn(td.games(s, d), td.plies(s, d))


register("narration_lines", _gp(nr.narration_lines), DIFF_CTE + TP_CTE + "SELECT * FROM lines",
         ("games", "plies"))
register("narration_facts", _gp(nr.narration_facts), DIFF_CTE + TP_CTE + "SELECT game_id, n_plies, winner, facts FROM facts",
         ("games", "plies"))
register("narration_prompts", _gp(nr.narration_prompts), DIFF_CTE + TP_CTE + """
, body AS (SELECT game_id, string_agg(line, chr(10) ORDER BY ply) AS moves_block, COUNT(*) AS n
           FROM lines GROUP BY game_id)
SELECT b.game_id, concat_ws(chr(10), '[game]',
    'white=' || coalesce(i.white, 'White') || '; rating=' || coalesce(CAST(i.white_elo AS VARCHAR), 'unknown'),
    'black=' || coalesce(i.black, 'Black') || '; rating=' || coalesce(CAST(i.black_elo AS VARCHAR), 'unknown'),
    'eco=' || coalesce(i.eco, 'unknown') || '; opening=' || coalesce(i.opening, ''),
    'plies=' || b.n || '; words=' || greatest(250, least(650, b.n * 12 + 50)),
    '[facts]', f.facts, '[record]', b.moves_block) AS prompt
FROM body b JOIN facts f ON b.game_id = f.game_id LEFT JOIN info i ON b.game_id = i.game_id""",
         ("games", "plies"))

# ------------------------------------------------------------------ replies
_INVALID = "g % 6 IN (2, 3)"


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nr.parse_replies(nr.replies_from_documents(_docs(spark, sf_dir)))


def _parse_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _parsed(spark, sf_dir)
    n_anchors = F.size(F.flatten(F.transform("doc.paragraphs", lambda x: x["anchors"])))
    return p.select("g", "valid",
                    F.when(F.col("valid"), F.size("doc.paragraphs")).alias("n_paragraphs"),
                    F.when(F.col("valid"), n_anchors).alias("n_anchors"))


register("parse_replies", _parse_replies, f"""
SELECT g, NOT ({_INVALID}) AS valid,
       CASE WHEN NOT ({_INVALID}) THEN CAST(COUNT(*) AS INT) END AS n_paragraphs,
       CASE WHEN NOT ({_INVALID}) THEN CAST(COUNT(*) AS INT) END AS n_anchors
FROM para GROUP BY g""", ("para",))

register("reply_status", lambda s, d: nr.reply_status(_parsed(s, d)), f"""
SELECT g, CASE WHEN {_INVALID} THEN 'invalid_json'
               WHEN SUM(CASE WHEN trigger_word != '' AND NOT contains(text, trigger_word) THEN 1 ELSE 0 END) > 0
               THEN 'broken_anchors' ELSE 'ok' END AS status,
       CASE WHEN {_INVALID} THEN 0
            ELSE SUM(CASE WHEN trigger_word != '' AND NOT contains(text, trigger_word) THEN 1 ELSE 0 END)
       END::BIGINT AS n_broken
FROM para GROUP BY g""", ("para",))


# ------------------------------------------------------------------ JSON round trip
def _narration_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "narrations")
    narration_io.write_narrations(_docs(spark, sf_dir), path)
    docs = narration_io.read_narrations(spark, path, multi_line=False)
    return nr.anchor_rows(docs)


register("narration_scan", _narration_scan, """
SELECT g, CAST(p AS INT) AS p, 0 AS a, text, fen, trigger_word FROM para""", ("para",))


def _text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "narration-text")
    nr.write_narration_text(_docs(spark, sf_dir), path, F.concat(F.lit("doc_"), F.col("g").cast("string")))
    return nr.read_narration_text(spark, path)


register("narration_text_files", _text_files, """
SELECT 'doc_' || g AS stem, string_agg(text, chr(10) || chr(10) ORDER BY p) AS text FROM para GROUP BY g""", ("para",))


def _with_unknown_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of JSON: documents with fields that no schema names, at the top and inside
    paragraphs; every eleventh is cut off, every thirteenth no object."""
    docs = _docs(spark, sf_dir)
    inner = F.transform("paragraphs", lambda p: p.withField("tone", F.length(p["text"]) % 5))
    more = F.struct("g", "white", "black", inner.alias("paragraphs"), F.struct((F.col("g") * 3).alias("takes"), F.lit("é").alias("voice")).alias("studio"))
    line = F.to_json(more)
    line = F.when(F.col("g") % 11 == 0, F.left(line, F.length(line) - 7)).when(F.col("g") % 13 == 0, F.to_json(F.array("white", "black"))).otherwise(line)
    return docs.select(line.alias("value"))


def _variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with unknown fields written, read as VARIANT, written and read again:
    of each its paragraphs by the known schema and two fields by their paths."""
    first, again = fresh_path(spark, "variant-in"), fresh_path(spark, "variant-out")
    _with_unknown_fields(spark, sf_dir).write.text(first)
    narration_io.write_variants(narration_io.read_variants(spark, first), again)
    read = narration_io.read_variants(spark, again)
    known = narration_io.known_fields(read)
    tones = F.try_variant_get("doc", "$.paragraphs", "array<struct<tone:int>>")
    rows = known.select("g", "white", F.size("paragraphs").alias("n_paragraphs"), F.aggregate(tones, F.lit(0), lambda a, t: a + t["tone"]).alias("tones"),
                        F.variant_get("doc", "$.studio.takes", "long").alias("takes"), F.variant_get("doc", "$.studio.voice", "string").alias("voice"),
                        F.lit(None).cast("string").alias("reject"))
    bad = read.where("doc IS NULL").select(
        F.regexp_extract("raw", r"White (\d+)", 1).cast("long").alias("g"), *[F.lit(None).cast(t).alias(c) for c, t in rows.dtypes[1:-1]],
        F.left("raw", F.lit(12)).alias("reject"))
    return rows.unionByName(bad)


register("narration_variant", _variants, """
, d AS (SELECT g, CAST(COUNT(*) AS INT) AS n, CAST(SUM(length(text) % 5) AS INT) AS tones, g % 11 = 0 AS cut, g % 11 <> 0 AND g % 13 = 0 AS other
        FROM para GROUP BY g)
SELECT g, CASE WHEN NOT cut AND NOT other THEN 'White ' || g END AS white, CASE WHEN NOT cut AND NOT other THEN n END AS n_paragraphs,
       CASE WHEN NOT cut AND NOT other THEN tones END AS tones, CASE WHEN NOT cut AND NOT other THEN g * 3 END AS takes,
       CASE WHEN NOT cut AND NOT other THEN 'é' END AS voice,
       CASE WHEN cut THEN left('{"g":' || g || ',"white":"White', 12) WHEN other THEN left('["White ' || g || '","Black', 12) END AS reject
FROM d""", ("para",))


# ------------------------------------------------------------------ documents end to end
def _documents_of_three_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON documents: a third without a ``moves`` field, a third with an empty list, a
    third with the start entry and a move for each anchored position; read back."""
    docs = _docs(spark, sf_dir)
    fens = F.transform(F.filter(F.flatten(F.transform("paragraphs", lambda p: p["anchors"])), lambda a: a["fen"] != ""), lambda a: a["fen"])
    entry = lambda fen: F.struct(F.lit(1).alias("move_number"), F.lit("white").alias("color"), F.lit("e4").alias("san"), fen.alias("fen"))
    moves = F.concat(F.array(entry(F.lit(START_FEN))), F.transform(fens, entry))
    path = fresh_path(spark, "documents")
    kind = F.col("g") % 3
    docs = docs.withColumn("moves", F.when(kind == 1, F.col("moves")).when(kind == 2, moves))
    docs.write.option("ignoreNullFields", "true").json(path)  # the first third has no such field
    return narration_io.read_narrations(spark, path, multi_line=False)


def _anchor_cte(table: str, final: str) -> str:
    return ANCHOR_CTE.replace("FROM para)", f"FROM {table})").replace(f"SELECT g, {FINAL} AS", f"SELECT g, {final} AS").replace(f"WHERE {FINAL} > 0", f"WHERE {final} > 0") \
        .replace(f"last_idx < {FINAL}", f"last_idx < {final}")


register("timed_anchors_documents", lambda s, d: nr.timed_anchors_for_documents(_documents_of_three_kinds(s, d)), f"""
, a AS (SELECT g, p, fen, {KEY.format(x='fen')} AS key FROM para WHERE fen != '')
, f AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY g, key ORDER BY p) AS r FROM a WHERE key != '{START_KEY}' AND g % 3 <> 2)
, boards AS (
  SELECT g, 0 AS idx, '{START_KEY}' AS key FROM (SELECT DISTINCT g FROM para)
  UNION ALL SELECT g, 1, '{START_KEY}' FROM (SELECT DISTINCT g FROM para WHERE g % 3 = 2)
  UNION ALL SELECT g, ROW_NUMBER() OVER (PARTITION BY g ORDER BY p) + 1, key FROM a WHERE g % 3 = 2
  UNION ALL SELECT g, ROW_NUMBER() OVER (PARTITION BY g ORDER BY p), key FROM f WHERE r = 1)
, last_board AS (SELECT g, key, CAST(MAX(idx) AS INT) AS fen_idx FROM boards GROUP BY g, key)
, ends AS (SELECT g, CAST(MAX(idx) AS INT) AS final_idx FROM boards GROUP BY g)
, para2 AS (SELECT p.g, p.p, p.text, p.trigger_word, p.fen, COALESCE(l.fen_idx, -1) AS fen_idx
            FROM para p LEFT JOIN last_board l ON p.g = l.g AND {KEY.format(x='p.fen')} = l.key)
""" + _anchor_cte("para2", "(SELECT final_idx FROM ends WHERE ends.g = lst.g)") + "SELECT * FROM ta", ("para",))
