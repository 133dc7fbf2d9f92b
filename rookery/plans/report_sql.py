"""DuckDB SQL of the report, written from the definitions of the analyses.

Independent of the Spark side by its means: the two sides of a game are turned
into rows once, class bounds are a table that is joined by range, shares divide
by a total that is joined, and quantiles are read off cumulated frequencies.
"""

from __future__ import annotations

from ..functions.exprs import (TIME_CLASS_BOUNDS, TIME_CLASS_CORRESPONDENCE, TIME_CLASS_ELSE, TIME_CLASS_OTHER)

_SIDES = """SELECT g.game_id, s.side, s.player, s.elo, g.white_elo, g.black_elo
  FROM games g, LATERAL (VALUES ('white', g.white, g.white_elo), ('black', g.black, g.black_elo)) s(side, player, elo)"""


def _shares(key: str, rows: str) -> str:
    """Counts of a key and their share of all rows."""
    return f"""SELECT c.{key}, c.n AS count, round(CAST(100 AS DOUBLE) * c.n / t.n, 2) AS pct
      FROM (SELECT {key}, count(*) AS n FROM ({rows}) GROUP BY ALL) c, (SELECT count(*) AS n FROM ({rows})) t"""


def _outcomes() -> str:
    """Shares of the three outcomes within a group, by filtered counts."""
    return ", ".join(f"round(CAST(100 AS DOUBLE) * count(*) FILTER (result = '{r}') / count(*), 1) AS {name}"
                     for r, name in (("1-0", "white_win_pct"), ("0-1", "black_win_pct"), ("1/2-1/2", "draw_pct")))


def _quantile(freq: str, share: float) -> str:
    """Interpolated quantile of a frequency table (v, n): the values at the two
    places around share * (total - 1) are found by the cumulated counts."""
    return f"""(WITH f AS ({freq}), c AS (SELECT v, sum(n) OVER (ORDER BY v) AS upto FROM f),
      p AS (SELECT {share} * (sum(n) - 1) AS place FROM f),
      ends AS (SELECT place, (SELECT min(v) FROM c WHERE upto > floor(place)) AS low, (SELECT min(v) FROM c WHERE upto > ceil(place)) AS high FROM p)
      SELECT CAST(low + (high - low) * (place - floor(place)) AS DOUBLE) FROM ends)"""


def _classes() -> str:
    bounds = [(low, high, label) for (low, _), (high, label) in zip([(0, ""), *TIME_CLASS_BOUNDS], TIME_CLASS_BOUNDS)]
    bounds = [(-2**31, bounds[0][1], bounds[0][2]), *bounds[1:], (TIME_CLASS_BOUNDS[-1][0], 2**31, TIME_CLASS_ELSE)]
    table = ", ".join(f"({low}, {high}, '{label}')" for low, high, label in bounds)
    return f"""SELECT coalesce(b.label, CASE WHEN g.tc = '-' THEN '{TIME_CLASS_CORRESPONDENCE}' ELSE '{TIME_CLASS_OTHER}' END) AS time_class
      FROM (SELECT time_control AS tc, TRY_CAST(regexp_extract(time_control, '^([^+]*)[+]', 1) AS INTEGER) AS base
            FROM games WHERE length(time_control) > 0) g
      LEFT JOIN (VALUES {table}) b(low, high, label) ON g.base >= b.low AND g.base < b.high"""


_MOVES = "SELECT num_moves AS v, count(*) AS n FROM games WHERE num_moves > 0 GROUP BY ALL"


def _side_elo(side: str) -> str:
    return f"SELECT elo AS v, count(*) AS n FROM ({_SIDES}) WHERE side = '{side}' AND least(white_elo, black_elo) > 400 GROUP BY ALL"


def _mean(freq: str) -> str:
    return f"(SELECT CAST(sum(v * n) AS DOUBLE) / sum(n) FROM ({freq}))"


def _elo_buckets(*by: str) -> str:
    columns = "".join(f"{c}, " for c in by)
    return f"""SELECT {columns}CAST(elo - elo % 100 AS DOUBLE) AS elo_bucket, count(*) AS count
      FROM ({_SIDES}) WHERE elo BETWEEN 401 AND 3499 GROUP BY ALL"""


REPORT_SQL = {
    "total_games": "SELECT count(*) AS total_games FROM games",
    "results": _shares("result", "SELECT result FROM games WHERE result <> '*'"),
    "elo_histogram": _elo_buckets(),
    "elo_histogram_by_side": _elo_buckets("side"),
    "elo_stats": f"""SELECT {_mean(_side_elo('white'))} AS avg_white, {_mean(_side_elo('black'))} AS avg_black,
      {_quantile(_side_elo('white'), 0.5)} AS median_white, {_quantile(_side_elo('black'), 0.5)} AS median_black""",
    "top_openings": f"""SELECT eco, opening, count(*) AS count, {_outcomes()} FROM games WHERE length(eco) > 0
      GROUP BY eco, opening QUALIFY row_number() OVER (ORDER BY count(*) DESC, eco, opening) <= 30""",
    "time_controls": _shares("time_class", _classes()),
    "move_count_dist": f"SELECT v AS num_moves, n AS count FROM ({_MOVES}) WHERE v < 300",
    "move_stats": f"""SELECT {_mean(_MOVES)} AS avg_moves, {_quantile(_MOVES, 0.5)} AS median_moves,
      (SELECT min(v) FROM ({_MOVES})) AS min_moves, (SELECT max(v) FROM ({_MOVES})) AS max_moves,
      {_quantile(_MOVES, 0.25)} AS p25, {_quantile(_MOVES, 0.75)} AS p75""",
    "daily_activity": "SELECT date, count(*) AS count FROM games WHERE regexp_matches(date, '[0-9]') GROUP BY ALL",
    "terminations": f"""SELECT * FROM ({_shares('termination', "SELECT termination FROM games WHERE length(termination) > 0")})
      QUALIFY row_number() OVER (ORDER BY count DESC, termination) <= 15""",
    "top_players": f"""SELECT player, count(*) AS games, max(elo) AS peak_elo FROM ({_SIDES}) WHERE elo > 0
      GROUP BY player QUALIFY row_number() OVER (ORDER BY count(*) DESC, player) <= 20""",
    "eco_categories": _shares("eco_cat", "SELECT eco[1] AS eco_cat FROM games WHERE length(eco) > 0"),
    "rating_advantage": f"""SELECT CAST(50 * floor((white_elo - black_elo) / CAST(50 AS DOUBLE)) AS DOUBLE) AS elo_diff_bucket,
      count(*) AS count, {_outcomes()}
      FROM games WHERE least(white_elo, black_elo) > 400 AND white_elo - black_elo BETWEEN -500 AND 500 GROUP BY ALL""",
    "top_game": """SELECT game_id, white, black, white_elo, black_elo, white_elo + black_elo AS total_elo, result, moves_uci,
        eco, opening, date, time_control
      FROM games WHERE game_id = (
        SELECT arg_max(game_id, (white_elo + black_elo) * CAST(4294967296 AS BIGINT) - game_id)
        FROM games WHERE least(white_elo, black_elo) > 2000 AND length(moves_uci) > 0)""",
    "focus_player": f"""SELECT player, count(*) AS games FROM ({_SIDES}) GROUP BY player
      QUALIFY row_number() OVER (ORDER BY count(*) DESC, player) = 1""",
    "ply_distribution_player": f"""SELECT f.v AS num_moves, f.n AS count, {_quantile(_MOVES, 0.5)} AS median_moves, t.n AS total_games
      FROM ({_MOVES}) f, (SELECT CAST(sum(n) AS BIGINT) AS n FROM ({_MOVES})) t""",
    "collection_sizes": """SELECT count(*) FILTER (num_moves > 0) AS games_with_plies,
      count(*) FILTER (regexp_matches(moves_uci, '^[^ ]')) AS games_with_first_move FROM games""",
}

#: text and number columns of the analyses in the report
CELLS = {
    "total_games": ([], ["total_games"]), "results": (["result"], ["count", "pct"]), "elo_histogram": ([], ["elo_bucket", "count"]),
    "elo_stats": ([], ["avg_white", "avg_black", "median_white", "median_black"]),
    "top_openings": (["eco", "opening"], ["count", "white_win_pct", "black_win_pct", "draw_pct"]),
    "time_controls": (["time_class"], ["count", "pct"]), "move_count_dist": ([], ["num_moves", "count"]),
    "move_stats": ([], ["avg_moves", "median_moves", "min_moves", "max_moves", "p25", "p75"]), "daily_activity": (["date"], ["count"]),
    "terminations": (["termination"], ["count", "pct"]), "top_players": (["player"], ["games", "peak_elo"]),
    "eco_categories": (["eco_cat"], ["count", "pct"]),
    "rating_advantage": ([], ["elo_diff_bucket", "count", "white_win_pct", "black_win_pct", "draw_pct"]),
    "top_game": (["white", "black", "result", "moves_uci", "eco", "opening", "date", "time_control"], ["game_id", "white_elo", "black_elo", "total_elo"]),
}


def cells_sql(status: bool = True) -> str:
    """The whole report as one table: a row per number of every analysis."""
    parts = []
    for name, (texts, numbers) in CELLS.items():
        key = " || '|' || ".join(texts) if texts else f"CAST(CAST(trunc({numbers[0]}) AS BIGINT) AS VARCHAR)"
        values = ", ".join(f"('{c}', CAST({c} AS DOUBLE))" for c in numbers)
        parts.append(f"""SELECT '{name}' AS analysis, {"'ok' AS status, " if status else ""}{key} AS key, m.measure, m.value
          FROM ({REPORT_SQL[name]}) a, LATERAL (VALUES {values}) m(measure, value)""")
    return "\nUNION ALL\n".join(parts)
