"""Render games (and optionally per-ply scores) as PGN text.

One text per game, built with column expressions; higher-order array functions
number the moves and attach ``{ [%eval ..] [%clk ..] }`` comments. The text
ends with a newline so that a text sink writing one game per row leaves a blank
line between games, which is what the PGN scan splits on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tag order of the export; the seven-tag roster first.
TAG_ORDER = (("Event", "event"), ("Site", "site"), ("Date", "date"), ("Round", None), ("White", "white"),
             ("Black", "black"), ("Result", "result"), ("WhiteElo", "white_elo"), ("BlackElo", "black_elo"),
             ("WhiteRatingDiff", "white_rd"), ("BlackRatingDiff", "black_rd"), ("ECO", "eco"),
             ("Opening", "opening"), ("TimeControl", "time_control"), ("Termination", "termination"))
ALWAYS = {"Event", "Site", "Date", "Round", "White", "Black", "Result", "Opening"}


def _escape(v: Column) -> Column:
    """PGN string escapes (literal replaces, no regex)."""
    return F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def _signed(c: Column) -> Column:
    """Integer with an explicit sign ('+5', '-3', '+0')."""
    return F.concat(F.when(c >= 0, F.lit("+")).otherwise(F.lit("")), c.cast("string"))


def tag_line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f'[{name} "'), _escape(value), F.lit('"]'))


def _tag_value(name: str, col: str | None) -> Column | None:
    if col is None:
        return F.lit("?")
    c = F.col(col)
    if name in ("WhiteElo", "BlackElo"):
        return F.when(c > 0, c.cast("string"))
    if name in ("WhiteRatingDiff", "BlackRatingDiff"):
        return F.when(c != 0, _signed(c.cast("int")))
    if name in ALWAYS:
        return F.coalesce(c.cast("string"), F.lit(""))
    return F.when(F.coalesce(c, F.lit("")) != "", c)


def header_block(extra: list[tuple[str, Column]] | None = None) -> Column:
    lines = []
    for name, col in TAG_ORDER:
        v = _tag_value(name, col)
        lines.append(F.when(v.isNotNull(), tag_line(name, v)))
    for name, v in extra or []:
        lines.append(F.when(v.isNotNull(), tag_line(name, v)))
    return F.concat_ws("\n", *lines)


def clock_text(secs: Column) -> Column:
    """Seconds -> H:MM:SS."""
    s = secs.cast("int")
    return F.concat(F.floor(s / 3600).cast("string"), F.lit(":"),
                    F.lpad((F.floor(s / 60) % 60).cast("string"), 2, "0"), F.lit(":"),
                    F.lpad((s % 60).cast("string"), 2, "0"))


def eval_text(cp: Column, mate: Column) -> Column:
    """Mate first (``#n``), else pawns with two decimals, else NULL."""
    return F.when(mate.isNotNull(), F.concat(F.lit("#"), mate.cast("string"))) \
        .when(cp.isNotNull(), F.format_string("%.2f", cp / F.lit(100.0)))


def with_movetext(df: DataFrame, moves: Column, comments: Column, result: Column) -> DataFrame:
    """Adds ``_movetext``. ``moves`` / ``comments`` are aligned arrays (comment
    NULL = none). Both are materialised as columns first, so the per-move lambda
    reads array slots instead of re-evaluating the arrays for every element."""
    df = df.withColumn("_mv", moves).withColumn("_cm", comments)
    # previous ply's comment, shifted by one (NULL before the first move)
    df = df.withColumn("_prev", F.concat(F.array(F.lit(None).cast("string")),
                                         F.slice("_cm", 1, F.greatest(F.size("_cm") - 1, F.lit(0)))))
    parts = F.arrays_zip(F.col("_mv").alias("m"), F.col("_cm").alias("c"), F.col("_prev").alias("p"))

    def one(x: Column, i: Column) -> Column:
        num = (F.floor(i / 2) + 1).cast("string")
        prefix = F.when(i % 2 == 0, F.concat(num, F.lit(". "))) \
            .when(x["p"].isNotNull(), F.concat(num, F.lit("... "))).otherwise(F.lit(""))
        suffix = F.when(x["c"].isNotNull(), F.concat(F.lit(" { "), x["c"], F.lit(" }"))).otherwise(F.lit(""))
        return F.concat(prefix, x["m"], suffix)
    body = F.array_join(F.transform(parts, one), " ")
    text = F.when(F.size("_mv") > 0, F.concat(body, F.lit(" "), result)).otherwise(result)
    return df.withColumn("_movetext", text).drop("_mv", "_cm", "_prev")


def render_games(games: DataFrame, game_id_tag: bool = True, keep: tuple[str, ...] = (),
                 moves_col: str = "moves_uci") -> DataFrame:
    """``(game_id, *keep, pgn)`` from a games table: moves from ``moves_col``
    (space separated, UCI or SAN), clocks from ``clock_times`` attached to the
    first plies."""
    moves = F.filter(F.split(F.col(moves_col), " "), lambda x: x != "")
    clocks = F.filter(F.split(F.col("clock_times"), " "), lambda x: x != "")
    extra = [("ParquetGameId", F.col("game_id").cast("string"))] if game_id_tag else []
    df = games.withColumn("_clocks", F.coalesce(clocks, F.array().cast("array<string>"))).withColumn("_moves", moves)
    # only plies with a clock have a comment to build
    n = F.greatest(F.least(F.size("_clocks"), F.size("_moves")), F.lit(0))
    comments = F.concat(F.transform(F.slice("_clocks", 1, n), lambda c: F.concat(F.lit("[%clk "), clock_text(c), F.lit("]"))),
                        F.array_repeat(F.lit(None).cast("string"), F.size("_moves") - n))
    df = with_movetext(df, F.col("_moves"), comments, F.col("result"))
    text = F.concat(header_block(extra), F.lit("\n\n"), F.col("_movetext"), F.lit("\n"))
    return df.select("game_id", *keep, text.alias("pgn"))


def render_annotated(games: DataFrame, plies: DataFrame) -> DataFrame:
    """``(game_id, pgn)`` with one ``[%eval]`` comment per scored ply. Moves
    come from ``plies.uci`` in ply order; headers from ``games`` (defaults when a
    game has no row there)."""
    per_game = plies.groupBy("game_id").agg(
        F.array_sort(F.collect_list(F.struct("ply", "uci", "cp", "mate"))).alias("_p"))
    info = games.drop("moves_uci", "clock_times", "num_moves")
    j = per_game.join(info, "game_id", "left")
    j = (j.withColumn("event", F.coalesce("event", F.lit("?"))).withColumn("site", F.coalesce("site", F.lit("?")))
         .withColumn("date", F.coalesce("date", F.lit("????.??.??")))
         .withColumn("white", F.coalesce("white", F.lit("?"))).withColumn("black", F.coalesce("black", F.lit("?")))
         .withColumn("result", F.coalesce("result", F.lit("*"))))
    moves = F.transform("_p", lambda x: x["uci"])
    comments = F.transform("_p", lambda x: F.when(
        eval_text(x["cp"], x["mate"]).isNotNull(),
        F.concat(F.lit("[%eval "), eval_text(x["cp"], x["mate"]), F.lit("]"))))
    extra = [("ParquetGameId", F.col("game_id").cast("string"))]
    j = with_movetext(j, moves, comments, F.col("result"))
    text = F.concat(header_block(extra), F.lit("\n\n"), F.col("_movetext"), F.lit("\n"))
    return j.select("game_id", text.alias("pgn"))
