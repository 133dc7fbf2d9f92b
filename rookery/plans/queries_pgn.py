"""PGN ingest queries: the test tables are rendered to PGN files by Spark, then
scanned and parsed back; the oracle is the table the text came from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.pgn_render import render_annotated, render_games
from ..session import fresh_path
from ..sources import corpus, files
from ..sources import pgn
from ..sources import testdata as td
from .catalog import register

SOURCE = r"regexp_replace(lower(event), '[^a-z0-9]+', '_', 'g')"
N_TOKENS = "CASE WHEN moves_uci = '' THEN 0 ELSE len(string_split(moves_uci, ' ')) END"
GAMES_LIMIT = 1000


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pgn.scan_pgn(spark, corpus.games_corpus(spark, sf_dir, packed=True), glob=None)


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed games, narrowed like the games table."""
    return files.conform(pgn.parse_games(_raw(spark, sf_dir)), ("source", "src_game_id")) \
        .withColumn("src_game_id", F.col("src_game_id").cast("int"))


register("pgn_scan", lambda s, d: _raw(s, d).groupBy("source").agg(F.count(F.lit(1)).alias("games")),
         f"SELECT {SOURCE} AS source, COUNT(*) AS games FROM games GROUP BY 1", ("games",))

register("pgn_game_ids", lambda s, d: _parsed(s, d).select("source", "game_id", "src_game_id"), f"""
SELECT source, CAST(ROW_NUMBER() OVER (PARTITION BY source ORDER BY game_id) AS INT) AS game_id,
       game_id AS src_game_id
FROM (SELECT *, {SOURCE} AS source FROM games)""", ("games",))

HEADER_COLS = ["event", "site", "date", "white", "black", "result", "white_elo", "black_elo", "white_rd",
               "black_rd", "eco", "opening", "time_control", "termination"]

register("pgn_headers", lambda s, d: _parsed(s, d).select("src_game_id", *HEADER_COLS),
         f"SELECT game_id AS src_game_id, {', '.join(HEADER_COLS)} FROM games", ("games",))

register("pgn_clocks", lambda s, d: _parsed(s, d).select("src_game_id", "clock_times"), f"""
SELECT game_id AS src_game_id,
       CASE WHEN clock_times = '' THEN ''
            ELSE array_to_string(list_slice(string_split(clock_times, ' '), 1, {N_TOKENS}), ' ') END
         AS clock_times
FROM games""", ("games",))

register("pgn_plies", lambda s, d: _parsed(s, d).select("src_game_id", "num_moves", "moves_uci"),
         f"""SELECT game_id AS src_game_id, CAST({N_TOKENS} AS SMALLINT) AS num_moves, moves_uci FROM games""",
         ("games",))


register("games_limit",
         lambda s, d: _parsed(s, d).where(F.col("game_id") <= GAMES_LIMIT).select("source", "game_id",
                                                                                 "src_game_id"), f"""
SELECT * FROM (
  SELECT source, CAST(ROW_NUMBER() OVER (PARTITION BY source ORDER BY game_id) AS INT) AS game_id,
         game_id AS src_game_id
  FROM (SELECT *, {SOURCE} AS source FROM games))
WHERE game_id <= {GAMES_LIMIT}""", ("games",))

register("pgn_single_defaults",
         lambda s, d: pgn.single_game_defaults(_raw(s, d)).withColumn("src_game_id",
                                                                       F.col("src_game_id").cast("int"))
         .drop("source"), """
SELECT game_id AS src_game_id, white, black,
       CASE WHEN white_elo > 0 THEN CAST(white_elo AS VARCHAR) ELSE '?' END AS white_elo,
       CASE WHEN black_elo > 0 THEN CAST(black_elo AS VARCHAR) ELSE '?' END AS black_elo,
       CASE WHEN eco = '' THEN '?' ELSE eco END AS eco, opening, result, moves_uci,
       CASE WHEN moves_uci != '' THEN 'ok' ELSE 'rejected: no moves' END AS status
FROM games""", ("games",))


def _evals(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = pgn.scan_pgn(spark, corpus.annotated_corpus(spark, sf_dir), glob=None)
    return pgn.ply_evals(raw).select(F.col("src_game_id").cast("int").alias("game_id"), "ply", "cp", "mate")


register("pgn_evals", _evals, """
SELECT game_id, ply, cp, mate FROM plies WHERE cp IS NOT NULL OR mate IS NOT NULL""", ("plies",))

_TAGS = [("Event", "event"), ("Site", "site"), ("Date", "date"), ("Round", "'?'"), ("White", "white"),
         ("Black", "black"), ("Result", "result")]


def _tag_sql(name: str, expr: str) -> str:
    return f"""'[{name} "' || replace(replace({expr}, '\\', '\\\\'), '"', '\\"') || '"]'"""


register("pgn_render", lambda s, d: render_annotated(td.games(s, d), td.plies(s, d)), f"""
, info AS (
  SELECT p.game_id, COALESCE(g.event, '?') AS event, COALESCE(g.site, '?') AS site,
         COALESCE(g.date, '????.??.??') AS date, COALESCE(g.white, '?') AS white, COALESCE(g.black, '?') AS black,
         COALESCE(g.result, '*') AS result, g.white_elo, g.black_elo, g.white_rd, g.black_rd, g.eco,
         COALESCE(g.opening, '') AS opening, g.time_control, g.termination
  FROM (SELECT DISTINCT game_id FROM plies) p LEFT JOIN games g ON p.game_id = g.game_id)
, cm AS (
  SELECT game_id, ply, uci,
         CASE WHEN mate IS NOT NULL THEN '[%eval #' || CAST(mate AS VARCHAR) || ']'
              WHEN cp IS NOT NULL THEN '[%eval ' || printf('%.2f', cp / 100.0) || ']' END AS c
  FROM plies)
, tok AS (
  SELECT game_id, ply,
         CASE WHEN ply % 2 = 0 THEN CAST(CAST(FLOOR(ply / 2) AS INT) + 1 AS VARCHAR) || '. '
              WHEN LAG(c) OVER (PARTITION BY game_id ORDER BY ply) IS NOT NULL
              THEN CAST(CAST(FLOOR(ply / 2) AS INT) + 1 AS VARCHAR) || '... ' ELSE '' END
         || uci || CASE WHEN c IS NOT NULL THEN ' {{ ' || c || ' }}' ELSE '' END AS t
  FROM cm)
, mt AS (SELECT game_id, string_agg(t, ' ' ORDER BY ply) AS body FROM tok GROUP BY game_id)
SELECT i.game_id,
  concat_ws(chr(10), {', '.join(_tag_sql(n, e) for n, e in _TAGS)},
    CASE WHEN white_elo > 0 THEN {_tag_sql('WhiteElo', 'CAST(white_elo AS VARCHAR)')} END,
    CASE WHEN black_elo > 0 THEN {_tag_sql('BlackElo', 'CAST(black_elo AS VARCHAR)')} END,
    CASE WHEN white_rd != 0 THEN {_tag_sql('WhiteRatingDiff', "printf('%+d', CAST(white_rd AS INT))")} END,
    CASE WHEN black_rd != 0 THEN {_tag_sql('BlackRatingDiff', "printf('%+d', CAST(black_rd AS INT))")} END,
    CASE WHEN eco != '' THEN {_tag_sql('ECO', 'eco')} END,
    {_tag_sql('Opening', 'opening')},
    CASE WHEN time_control != '' THEN {_tag_sql('TimeControl', 'time_control')} END,
    CASE WHEN termination != '' THEN {_tag_sql('Termination', 'termination')} END,
    {_tag_sql('ParquetGameId', 'CAST(i.game_id AS VARCHAR)')})
  || chr(10) || chr(10) || mt.body || ' ' || result || chr(10) AS pgn
FROM info i JOIN mt ON i.game_id = mt.game_id""".replace("{{", "{").replace("}}", "}"), ("games", "plies"))


def _append_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A19 guard: the games that a target does not hold yet."""
    target = corpus.games_corpus(spark, sf_dir, packed=True) + "/source=rated_game_0"
    existing = pgn.with_tags(pgn.scan_pgn(spark, target, glob=None)).select(
        pgn.tag(F.col("_keys"), F.col("_vals"), "ParquetGameId", "").cast("int").alias("game_id"))
    return td.games(spark, sf_dir).join(existing, "game_id", "left_anti").select("game_id")


register("pgn_append_new", _append_new,
         f"SELECT game_id FROM games WHERE {SOURCE} != 'rated_game_0'", ("games",))


def _append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append in two steps that overlap; every game is there once."""
    folder = fresh_path(spark, "appended")
    games = render_games(td.games(spark, sf_dir), keep=("event",))
    files.append_games(games.where("event <> 'Rated game 1'"), folder)
    files.append_games(games, folder)
    parsed = pgn.parse_games(pgn.scan_pgn(spark, folder, glob=None))
    return parsed.select(F.col("src_game_id").cast("int").alias("game_id"), "white", "moves_uci")


register("pgn_append", _append, "SELECT game_id, white, moves_uci FROM games", ("games",))
