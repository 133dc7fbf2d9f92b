"""Game-shaped views over the driver's test tables.

The test tables hold no chess data, so ``games``, ``plies`` and ``para`` are
defined as plain SQL projections of ``orders``, ``lineitem`` and
``conversations``. The same text runs on Spark (``spark.sql`` with DataFrame
arguments) and on DuckDB (as a CTE in front of each oracle query), so both sides
read identical inputs. Only ``{ws}`` (whitespace squeeze) differs by dialect.

Edge cases are deliberate: Elo 0, empty ECO, unknown dates, ``*`` results,
self-play, empty moves, empty and daily time controls, mate scores, missing
scores, repeated positions, broken anchors and empty anchor FENs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")

GAMES_SQL = """
SELECT CAST(o_orderkey + 1 AS INT) AS game_id,
  concat('Rated game ', CAST(o_orderkey % 4 AS STRING)) AS event,
  concat('https://example.org/', CAST(o_orderkey AS STRING)) AS site,
  CASE WHEN o_orderkey % 211 = 0 THEN '????.??.??'
       ELSE replace(substr(CAST(o_orderdate AS STRING), 1, 10), '-', '.') END AS date,
  concat('P', CAST(o_custkey % 300 AS STRING)) AS white,
  concat('P', CAST((o_custkey * 31 + o_orderkey) % 300 AS STRING)) AS black,
  CASE WHEN o_orderkey % 50 = 0 THEN '*' WHEN o_orderstatus = 'F' THEN '1-0'
       WHEN o_orderstatus = 'O' THEN '0-1' ELSE '1/2-1/2' END AS result,
  CAST(CASE WHEN o_orderkey % 41 = 0 THEN 0
       ELSE 600 + (o_orderkey * 37 + o_custkey) % 2300 END AS SMALLINT) AS white_elo,
  CAST(CASE WHEN o_orderkey % 43 = 0 THEN 0
       ELSE 300 + (o_orderkey * 37 + o_custkey) % 2300 + (o_orderkey * 13) % 601 END AS SMALLINT) AS black_elo,
  CAST(o_orderkey % 21 - 10 AS FLOAT) AS white_rd,
  CAST(10 - o_orderkey % 21 AS FLOAT) AS black_rd,
  CASE WHEN o_orderkey % 29 = 0 THEN ''
       ELSE concat(substr('ABCDE', CAST(1 + o_custkey % 5 AS INT), 1),
                   lpad(CAST(o_orderkey % 12 AS STRING), 2, '0')) END AS eco,
  concat('Line ', CAST(o_orderkey % 3 AS STRING)) AS opening,
  CASE o_orderpriority WHEN '1-URGENT' THEN '30+0' WHEN '2-HIGH' THEN '60+1' WHEN '3-MEDIUM' THEN '300+3'
       WHEN '4-NOT SPECIFIED' THEN '-'
       ELSE CASE o_orderkey % 4 WHEN 0 THEN '900+10' WHEN 1 THEN '1800+30' WHEN 2 THEN '1/86400' ELSE '' END
       END AS time_control,
  CASE o_orderstatus WHEN 'F' THEN 'Normal' WHEN 'O' THEN 'Time forfeit' ELSE '' END AS termination,
  CAST((o_orderkey * 17) % 320 AS SMALLINT) AS num_moves,
  CASE o_orderkey % 7 WHEN 0 THEN 'e2e4 e7e5 g1f3' WHEN 1 THEN 'd2d4 d7d5 c2c4' WHEN 2 THEN 'c2c4 e7e5'
       WHEN 3 THEN 'g1f3 d7d5' WHEN 4 THEN 'e2e4 c7c5' WHEN 5 THEN 'b2b3 e7e5' ELSE '' END AS moves_uci,
  CASE WHEN o_orderkey % 3 = 0 THEN '182 182 181' ELSE '' END AS clock_times
FROM {orders}
"""

# One row per ply. A mate score replaces the centipawn score (cp is NULL then);
# a few plies carry no score at all.
PLIES_SQL = """
SELECT game_id, ply,
  CASE WHEN (ok + ln) % 97 IN (0, 1, 2) THEN NULL
       ELSE CAST((ok * 7919 + sk * 104729 + ln * 31) % 1201 - 600 AS INT) END AS cp,
  CASE WHEN (ok + ln) % 97 = 0 THEN CAST(1 + ok % 3 AS INT)
       WHEN (ok + ln) % 97 = 1 THEN CAST(-1 - ok % 3 AS INT) ELSE NULL END AS mate,
  concat(substr('abcdefgh', CAST(1 + sk % 8 AS INT), 1), CAST(1 + ok % 8 AS STRING),
         substr('abcdefgh', CAST(1 + pk % 8 AS INT), 1), CAST(1 + ln % 8 AS STRING)) AS uci,
  CASE WHEN ln % 3 = 0
       THEN concat(substr('abcdefgh', CAST(1 + sk % 8 AS INT), 1), CAST(1 + ok % 8 AS STRING),
                   substr('abcdefgh', CAST(1 + pk % 8 AS INT), 1), CAST(1 + ln % 8 AS STRING))
       ELSE concat(substr('abcdefgh', CAST(1 + ok % 8 AS INT), 1), CAST(1 + sk % 8 AS STRING),
                   substr('abcdefgh', CAST(1 + ln % 8 AS INT), 1), CAST(1 + pk % 8 AS STRING)) END AS best_uci,
  concat(substr('NBRQK', CAST(1 + sk % 5 AS INT), 1), substr('abcdefgh', CAST(1 + pk % 8 AS INT), 1),
         CAST(1 + ln % 8 AS STRING)) AS san,
  CASE WHEN ln % 3 = 0
       THEN concat(substr('NBRQK', CAST(1 + sk % 5 AS INT), 1), substr('abcdefgh', CAST(1 + pk % 8 AS INT), 1),
                   CAST(1 + ln % 8 AS STRING))
       ELSE concat(substr('NBRQK', CAST(1 + ok % 5 AS INT), 1), substr('abcdefgh', CAST(1 + ln % 8 AS INT), 1),
                   CAST(1 + pk % 8 AS STRING)) END AS best_san,
  concat('rnbqkbnr/pppppppp/8/8/', CAST(1 + ok % 4 AS STRING), 'P', CAST(6 - ok % 4 AS STRING),
         '/8/PPPP1PPP/RNBQKBNR ', CASE WHEN ply % 2 = 0 THEN 'b' ELSE 'w' END, ' KQkq - 0 ',
         CAST(CAST(FLOOR(ply / 2) AS INT) + 1 AS STRING)) AS fen
FROM (
  SELECT CAST(l_partkey AS INT) AS game_id,
    CAST(ROW_NUMBER() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice,
         l_quantity, l_discount, l_tax, l_shipdate) - 1 AS INT) AS ply,
    l_orderkey AS ok, l_suppkey AS sk, l_linenumber AS ln, l_partkey AS pk
  FROM {lineitem}
) t
"""

# One narration paragraph per conversation turn, one anchor each. Some triggers
# are broken on purpose ('##'), some anchor FENs are empty; the final position
# index of every document is 40.
PARA_SQL = """
WITH n AS (SELECT conv_id AS g, turn AS p, trim({ws}) AS text FROM {conversations})
SELECT g, p, text,
  concat(trim(substr(text, CAST(1 + floor(length(text) * ((g * 7 + p * 3) % 9) / CAST(10 AS DOUBLE)) AS INT), 24)),
         CASE WHEN (g + p) % 17 = 0 THEN '##' ELSE '' END) AS trigger_word,
  CAST((g * 5 + p * 4 + (p * g) % 7) % 41 AS INT) AS fen_idx,
  CASE WHEN (g * 3 + p) % 31 = 0 THEN ''
       ELSE concat(substr('rnbqkbnr', CAST(1 + (g * 5 + p * 4 + (p * g) % 7) % 41 % 7 AS INT), 1),
                   '7/8/8/8/8/8/8/4K3 ',
                   CASE WHEN (g * 5 + p * 4 + (p * g) % 7) % 41 % 2 = 0 THEN 'w' ELSE 'b' END,
                   ' - - 0 ', CAST((g * 5 + p * 4 + (p * g) % 7) % 41 AS STRING)) END AS fen
FROM n
"""

PARA_FINAL_INDEX = 40

WS_SPARK = r"regexp_replace(text, '\\s+', ' ')"
WS_DUCKDB = r"regexp_replace(text, '\s+', ' ', 'g')"

VIEWS = {
    "games": (GAMES_SQL, "orders"),
    "plies": (PLIES_SQL, "lineitem"),
    "para": (PARA_SQL, "conversations"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text, base = VIEWS[name]
    text = text.replace("{ws}", WS_SPARK)
    return spark.sql(text, **{base: table(spark, sf_dir, base)})


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "games")


def plies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "plies")


def para(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "para")


def oracle_with(*names: str) -> str:
    """``WITH`` clause defining the named views for DuckDB."""
    parts = []
    for name in names:
        text, base = VIEWS[name]
        text = text.replace("{ws}", WS_DUCKDB).replace("{" + base + "}", base)
        parts.append(f"{name} AS ({text.strip()})")
    return "WITH " + ",\n".join(parts) + "\n"
