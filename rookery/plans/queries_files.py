"""File-level queries: Parquet sink/compaction, folder conversion, freshness,
batch outcome, report JSON sink, listings, base64, random pick, output names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import convert_and_report
from ..operators import naming
from ..operators import narration as nr
from ..operators import report, report_parts
from ..operators.pgn_render import render_games
from ..operators.skew import rank_within
from ..session import fresh_path
from ..sources import corpus, files
from ..sources import testdata as td
from .catalog import register
from .report_sql import CELLS, REPORT_SQL, cells_sql

GAME_COLS = ", ".join(files.GAME_COLUMNS)


def _roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "games")
    files.write_games(td.games(spark, sf_dir), path)
    return spark.read.schema(files.GAMES_SCHEMA).parquet(path)


register("games_write_roundtrip", _roundtrip, f"SELECT {GAME_COLS} FROM games", ("games",))


def _compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = fresh_path(spark, "games-parts")
    # unordered parts, as a batch conversion leaves them
    files.write_games(td.games(spark, sf_dir).repartition("white"), parts)
    out = fresh_path(spark, "games-compact")
    files.compact_games(spark, parts, out, remove_parts=True)
    return spark.read.schema(files.GAMES_SCHEMA).parquet(out)


register("games_compact", _compact, f"SELECT {GAME_COLS} FROM games", ("games",))

SOURCE = r"regexp_replace(lower(event), '[^a-z0-9]+', '_', 'g')"


def _folder_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fresh_path(spark, "converted")
    files.convert_folder(spark, corpus.games_corpus(spark, sf_dir, packed=True), out, glob=None)
    return files.read_games(spark, out).groupBy("source").agg(
        F.count(F.lit(1)).alias("games"), F.min("game_id").alias("first_id"), F.max("game_id").alias("last_id"))


register("pgn_folder_scan", _folder_scan, f"""
SELECT {SOURCE} AS source, COUNT(*) AS games, 1 AS first_id, CAST(COUNT(*) AS INT) AS last_id
FROM games GROUP BY 1""", ("games",))


def _earlier_batch(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """A folder of sources, and a target that an earlier batch filled with two of them."""
    src = corpus.games_corpus(spark, sf_dir, packed=True)
    out = fresh_path(spark, "converted-part")
    files.convert_sources(spark, src, out, ["rated_game_0", "rated_game_1"], glob=None)
    return src, out


def _freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    src, out = _earlier_batch(spark, sf_dir)
    # the part-file count and the times depend on the writer, not on the data
    return files.files_to_process(spark, src, out, glob=None).select("source", "status")


def _outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    src, out = _earlier_batch(spark, sf_dir)
    return files.batch_status(files.convert_folder(spark, src, out, glob=None))


_FRESH_SQL = f"""
SELECT DISTINCT {SOURCE} AS source,
       CASE WHEN {SOURCE} IN ('rated_game_0', 'rated_game_1') THEN 'skip' ELSE 'convert' END AS status
FROM games"""
register("files_to_process", _freshness, _FRESH_SQL, ("games",))
register("batch_status", _outcome,
         f"""SELECT CASE status WHEN 'skip' THEN 'skipped' ELSE 'converted' END AS status, COUNT(*) AS count
             FROM ({_FRESH_SQL}) GROUP BY status""", ("games",))


_LONG_SQL = "(game_id % 997 = 5 OR event = 'Rated game 3' AND game_id % 499 = 0)"


def _with_long_games(spark: SparkSession, sf_dir: str) -> str:
    """The PGN corpus with games of 33,000 plies in it, more than the table's type holds."""
    games = td.games(spark, sf_dir).withColumn("source", corpus.source_name("event"))
    long = games.withColumn("moves_uci", F.when(F.expr(_LONG_SQL), F.rtrim(F.repeat(F.lit("a1a2 "), 33000))).otherwise(F.col("moves_uci")))
    path = fresh_path(spark, "pgn-long")
    corpus.write_pgn(render_games(corpus.in_file_order(long), keep=("source",)), path)
    return path


def _rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a conversion kept and what it rejected, game by game, after one job."""
    out = fresh_path(spark, "converted-rejects")
    files.convert_folder(spark, _with_long_games(spark, sf_dir), out, glob=None)
    bad = files.read_rejects(spark, out).select("source", F.col("number").cast("int").alias("game_id"), "reason",
                                                F.get_json_object("record", "$.src_game_id").cast("int").alias("src_game_id"))
    kept = files.read_games(spark, out).select("source", "game_id", F.lit(None).cast("string").alias("reason"), F.lit(None).cast("int").alias("src_game_id"))
    return kept.unionByName(bad)


register("pgn_rejects", _rejects, f"""
SELECT source, CAST(ROW_NUMBER() OVER (PARTITION BY source ORDER BY game_id) AS INT) AS game_id,
       CASE WHEN bad THEN 'num_moves does not fit smallint: 33000' END AS reason, CASE WHEN bad THEN game_id END AS src_game_id
FROM (SELECT *, {SOURCE} AS source, {_LONG_SQL} AS bad FROM games)""", ("games",))


def _stats_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each analysis written as its own JSON folder, read back number by number."""
    root = fresh_path(spark, "stats")
    report.write_report(report.report_input(td.games(spark, sf_dir)), root)
    lines = spark.read.text(f"{root}/*/*.json").select(
        F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/[^/]+$", 1).alias("analysis"),
        F.from_json("value", "map<string,string>").alias("m"))
    out = None
    for name, (texts, numbers) in CELLS.items():
        m = lambda c: F.col("m")[c]
        key = F.concat_ws("|", *[m(c) for c in texts]) if texts else m(numbers[0]).cast("double").cast("long").cast("string")
        cells = F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), m(c).cast("double").alias("value")) for c in numbers]))
        part = lines.where(F.col("analysis") == name).select("analysis", key.alias("key"), cells.alias("cell")) \
            .select("analysis", "key", "cell.*")
        out = part if out is None else out.unionByName(part)
    return out


def _convert_and_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An earlier batch of two sources, then the job twice: it converts the rest,
    finds nothing new, and reports from the parts that the sources have left."""
    src, out = _earlier_batch(spark, sf_dir)
    for _ in range(2):
        convert_and_report.run(spark, src, out, glob=None)
    return report.report_cells(None, sources=report_parts.merged(spark, f"{out}-parts"))


# games as the files hold them: numbered by source, and with the plies of their movetext
_OF_FILES = """
, of_files AS (SELECT * REPLACE (CAST(ROW_NUMBER() OVER (PARTITION BY event ORDER BY game_id) AS INT) AS game_id,
                                 CAST(CASE WHEN moves_uci = '' THEN 0 ELSE len(string_split(moves_uci, ' ')) END AS SMALLINT) AS num_moves) FROM games)
, top_of_files AS (SELECT * FROM of_files WHERE least(white_elo, black_elo) > 2000 AND moves_uci <> ''
                   QUALIFY row_number() OVER (ORDER BY white_elo + black_elo DESC, game_id) = 1)
"""
_CELLS_OF_FILES = f"""
SELECT * FROM ({cells_sql().replace("FROM games", "FROM of_files")}) WHERE analysis <> 'top_game'
UNION ALL
SELECT * FROM ({cells_sql().replace("FROM games", "FROM top_of_files")}) WHERE analysis = 'top_game'"""
register("convert_and_report", _convert_and_report, _OF_FILES + _CELLS_OF_FILES, ("games",))


def _incremental_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A games table that grows by a source, loses one to a new version, and the
    report of its parts: each time only the named sources are read."""
    table, parts = fresh_path(spark, "games-by-source"), fresh_path(spark, "report-parts")
    games = td.games(spark, sf_dir).withColumn("source", corpus.source_name("event"))
    early = games.where("event <> 'Rated game 3'").where("event <> 'Rated game 2' OR game_id % 2 = 0")
    files.write_games(early, table, ["source"])
    report_parts.update(files.read_games(spark, table), parts, ["rated_game_0", "rated_game_1", "rated_game_2"])
    late = games.where("event IN ('Rated game 2', 'Rated game 3')")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        files.write_games(late, table, ["source"])
    finally:
        spark.conf.unset("spark.sql.sources.partitionOverwriteMode")
    report_parts.update(files.read_games(spark, table), parts, ["rated_game_2", "rated_game_3"])
    return report.report_cells(None, sources=report_parts.merged(spark, parts))


register("report_incremental", _incremental_report, cells_sql(), ("games",))


def _games_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL over a view of a games table that was written by source."""
    path = fresh_path(spark, "games-by-source")
    files.write_games(td.games(spark, sf_dir).withColumn("source", corpus.source_name("event")), path, ["source"])
    files.read_games(spark, path, "games_table")
    return spark.sql("SELECT source, result, count(*) AS games, max(white_elo) AS top FROM games_table GROUP BY source, result")


register("games_view", _games_view, f"""
SELECT {SOURCE} AS source, result, COUNT(*) AS games, MAX(white_elo) AS top FROM games GROUP BY ALL""", ("games",))

register("stats_json", _stats_json, cells_sql(status=False), ("games",))


def _top_game_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top game as a JSON document, read back with its fixed schema."""
    path = fresh_path(spark, "top-game")
    top = report.top_game(td.games(spark, sf_dir))
    top.write.json(path)
    return spark.read.schema(top.schema).json(path)


register("top_game_json", _top_game_json, REPORT_SQL["top_game"], ("games",))


def _narrated(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """Documents and the sound of those whose reply passed the checks, each as an
    ordinary table with a stem column: a document is a row, not a folder."""
    docs = nr.documents_from_paragraphs(td.para(spark, sf_dir))
    docs = docs.withColumn("stem", F.concat(naming.stem_base("white", "black", F.lit("")), F.lit("_0001")))
    docs_dir, audio_dir = fresh_path(spark, "docs"), fresh_path(spark, "audio")
    made = F.timestamp_seconds(F.pmod(F.col("g") * 7919, F.lit(1000)) * 60)
    docs.select("g", "stem", made.alias("modified")).write.json(docs_dir)
    status = nr.reply_status(nr.parse_replies(nr.replies_from_documents(docs)))
    ok = status.where(F.col("status") == "ok").join(docs.select("g", "stem", "paragraphs"), "g")
    # some bytes that differ from document to document
    sound = F.encode(F.concat(F.lit("ID3"), F.col("paragraphs")[0]["text"]), "UTF-8")
    ok.select("stem", sound.alias("content")).write.parquet(audio_dir)
    return docs_dir, audio_dir


def _playable(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs_dir, audio_dir = _narrated(spark, sf_dir)
    docs = spark.read.schema("stem string, modified timestamp").json(docs_dir)
    return files.playable_games(docs, spark.read.parquet(audio_dir)) \
        .select("stem", F.unix_seconds("modified").alias("modified"), "display")


def _base64(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sound of the playable games as base64."""
    _, audio_dir = _narrated(spark, sf_dir)
    return spark.read.parquet(audio_dir).select("stem", F.length("content").cast("long").alias("length"), files.base64_text("content").alias("b64"))


_OK_STEMS = """
, ok AS (
  SELECT g, first(text ORDER BY p) AS text FROM para GROUP BY g
  HAVING NOT (g % 6 IN (2, 3))
     AND SUM(CASE WHEN trigger_word != '' AND NOT contains(text, trigger_word) THEN 1 ELSE 0 END) = 0)
, stems AS (SELECT g, 'White_' || CAST(g AS VARCHAR) || '_vs_Black_' || CAST(g AS VARCHAR) || '_XX_0001' AS stem,
                   encode('ID3' || text) AS content FROM ok)
"""
register("playable_games", _playable, _OK_STEMS + """
SELECT stem, CAST((g * 7919) % 1000 * 60 AS BIGINT) AS modified, stem AS display FROM stems""", ("para",))
register("file_base64", _base64, _OK_STEMS + """
SELECT stem, CAST(octet_length(content) AS BIGINT) AS length, base64(content) AS b64 FROM stems""", ("para",))

RANDOM_SEED = 42


def random_game(games: DataFrame, seed: int = RANDOM_SEED) -> DataFrame:
    """One game picked by a seeded hash (reproducible, no global shuffle:
    top-1 per task, then top-1 overall)."""
    key = F.md5(F.concat(F.col("game_id").cast("string"), F.lit(f"/{seed}")))
    return games.withColumn("_k", key).orderBy("_k").limit(1).drop("_k")


register("random_game", lambda s, d: random_game(td.games(s, d)).select("game_id", "white", "black", "result"),
         f"""SELECT game_id, white, black, result FROM games
             ORDER BY md5(CAST(game_id AS VARCHAR) || '/{RANDOM_SEED}') LIMIT 1""", ("games",))


def _stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = td.games(spark, sf_dir).select("game_id", "event", naming.stem_base().alias("base"))
    earlier = g.where(F.col("event") == "Rated game 0")
    # an earlier batch used every second serial of its base
    used = rank_within(earlier, ["base"], "game_id", out="r").select("base", (F.col("r") * 2).alias("serial"))
    return naming.allocate_stems(g.where(F.col("event") != "Rated game 0"), used)


_BASE_SQL = r"""regexp_replace(regexp_replace(regexp_replace(white, '[^\w]', '_', 'g'), '_+', '_', 'g'),
                  '^_+|_+$', '', 'g')"""

register("game_stems", _stems, rf"""
, b AS (SELECT game_id, event,
          COALESCE(NULLIF({_BASE_SQL}, ''), 'Unknown') || '_vs_'
          || COALESCE(NULLIF({_BASE_SQL.replace('white', 'black')}, ''), 'Unknown') || '_'
          || COALESCE(NULLIF(regexp_replace(eco, '[^\w]', '', 'g'), ''), 'XX') AS base
        FROM games)
, used AS (SELECT base, 2 * ROW_NUMBER() OVER (PARTITION BY base ORDER BY game_id) AS serial
           FROM b WHERE event = 'Rated game 0')
, ug AS (SELECT base, serial - ROW_NUMBER() OVER (PARTITION BY base ORDER BY serial) AS g FROM used)
, nw AS (SELECT game_id, base, ROW_NUMBER() OVER (PARTITION BY base ORDER BY game_id) AS k
         FROM b WHERE event != 'Rated game 0')
, s AS (SELECT nw.game_id, nw.base,
               nw.k + (SELECT COUNT(*) FROM ug WHERE ug.base = nw.base AND ug.g < nw.k) AS serial FROM nw)
SELECT game_id, base || '_' || CASE WHEN serial < 10000 THEN lpad(CAST(serial AS VARCHAR), 4, '0')
                                    ELSE CAST(serial AS VARCHAR) END AS stem
FROM s""", ("games",))
