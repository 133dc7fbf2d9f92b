"""Per-ply evaluation features for all games at once.

Input is a ``plies`` table keyed by ``(game_id, ply)`` with engine scores already
in the data (``cp`` / ``mate`` from White's view, ``uci``, ``best_uci``, ``san``,
``best_san``, ``fen``). All window features share one partitioning by
``game_id`` ordered by ``ply``, so the whole feature set costs one exchange; the
per-game aggregates that follow reuse that partitioning.

Games are bounded in length (one row per half-move), so per-game windows and
per-game arrays stay small even when the table is huge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import (FINAL_PLIES, MATE_SCORE, OPENING_MOVES, START_FEN, blame,
                               effective_cp, move_number, move_quality, nonempty, ply_color,
                               position_key, win_probability)

TURNING_SKIP = 5          # first plies never count as turning point / worst error
TOP_MISTAKES = 5


def _by_game() -> Window:
    return Window.partitionBy("game_id").orderBy("ply")


def _whole_game() -> Window:
    return Window.partitionBy("game_id")


# Narrator features (diff to the previous ply)
def eval_diffs(plies: DataFrame) -> DataFrame:
    eff = effective_cp("cp", "mate")
    w = _by_game()
    df = plies.withColumn("eff_cp", eff)
    prev = F.lag("eff_cp").over(w)
    df = (df.withColumn("diff", F.col("eff_cp") - F.coalesce(prev, F.col("eff_cp")))
          .withColumn("n_plies", F.count(F.lit(1)).over(_whole_game()))
          .withColumn("color", ply_color("ply"))
          .withColumn("move_number", move_number("ply")))
    return (df.withColumn("blame", blame("color", "diff"))
            .withColumn("tag", phase_tag("move_number", "ply", "n_plies")))


def phase_tag(move_no: Column | str, ply: Column | str, n: Column | str) -> Column:
    """Opening for move numbers <= 8 (wins over) the last three plies."""
    m, p, n = (F.col(x) if isinstance(x, str) else x for x in (move_no, ply, n))
    return (F.when(m <= OPENING_MOVES, F.lit("opening"))
            .when(p >= n - FINAL_PLIES, F.lit("final"))
            .otherwise(F.lit("")))


# Bulk evaluation row per ply; all plies unless a bound is asked for
def ply_evaluations(plies: DataFrame, start_cp: int = 0, max_plies: int | None = None) -> DataFrame:
    w = _by_game()
    if max_plies is not None:
        plies = plies.where(F.col("ply") < max_plies)
    df = plies.withColumn("eval_after", effective_cp("cp", "mate"))
    df = df.withColumn("eval_before", F.coalesce(F.lag("eval_after").over(w), F.lit(start_cp)))
    signed = F.when(F.col("ply") % 2 == 0, F.col("eval_after") - F.col("eval_before")) \
        .otherwise(F.col("eval_before") - F.col("eval_after"))
    df = (df.withColumn("signed_change", signed)
          .withColumn("cp_loss", F.abs(F.col("signed_change")))
          .withColumn("win_prob_before", win_probability("eval_before"))
          .withColumn("win_prob_after", win_probability("eval_after"))
          .withColumn("is_best", F.coalesce(F.col("uci") == F.col("best_uci"), F.lit(False))))
    return df.withColumn("quality", move_quality("signed_change", "is_best"))


# Per game, arg-max |diff| over plies >= 5 (first on ties); last ply if n <= 5
def turning_points(plies: DataFrame) -> DataFrame:
    d = eval_diffs(plies)
    eligible = F.col("ply") >= F.least(F.lit(TURNING_SKIP), F.col("n_plies"))
    key = F.struct(F.abs("diff").alias("a"), (-F.col("ply")).alias("p"))
    agg = d.groupBy("game_id").agg(
        F.count(F.lit(1)).alias("n_plies"),
        F.max_by(F.when(eligible, F.col("ply")), F.when(eligible, key)).alias("_tp"),
        F.max_by(F.when(eligible, F.col("diff")), F.when(eligible, key)).alias("_td"),
        F.max_by("diff", "ply").alias("_last_diff"))
    return agg.select(
        "game_id", "n_plies",
        F.coalesce("_tp", F.col("n_plies") - 1).cast("int").alias("turning_ply"),
        F.coalesce("_td", "_last_diff").alias("turning_diff"))


# E5: five largest losses per game among inaccuracies, mistakes and blunders
def top_mistakes(plies: DataFrame, k: int = TOP_MISTAKES) -> DataFrame:
    ev = ply_evaluations(plies).where(F.col("quality").isin("inaccuracy", "mistake", "blunder"))
    w = Window.partitionBy("game_id").orderBy(F.desc("cp_loss"), "ply")
    return (ev.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("game_id", "rank", "ply", "uci", "best_uci", "cp_loss", "quality"))


# The worst blamed move from ply 5 on
def worst_blunder(plies: DataFrame) -> DataFrame:
    d = eval_diffs(plies).where(F.col("blame").isNotNull()
                                & (F.col("ply") >= F.least(F.lit(TURNING_SKIP), F.col("n_plies"))))
    key = F.struct(F.abs("diff").alias("a"), (-F.col("ply")).alias("p"))
    return d.groupBy("game_id").agg(F.max_by(F.struct("ply", "move_number", "color", "san", "diff", "blame"),
                                             key).alias("w")).select("game_id", "w.*")


# Per-game summary of the bulk evaluation
def eval_summary(plies: DataFrame) -> DataFrame:
    ev = ply_evaluations(plies)
    return ev.groupBy("game_id").agg(
        F.count(F.lit(1)).alias("total_moves_analyzed"),
        F.count_if(F.col("quality").isin("mistake", "blunder")).alias("mistakes"),
        F.count_if(F.col("quality") == "blunder").alias("blunders"),
        F.bround(F.avg("cp_loss"), 1).alias("avg_cp_loss"))


# H16
def narration_target(plies: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return plies.groupBy("game_id").agg(
        n.alias("n_plies"),
        F.greatest(F.lit(250), F.least(F.lit(650), n * 12 + 50)).cast("int").alias("target_words"))


# Scores reported for the side to move -> White's view
def score_white_view(plies: DataFrame, cp: str = "cp", mate: str = "mate") -> DataFrame:
    """After a white ply (even) Black is to move, so the sign flips. A mate of 0
    (mate delivered) credits the side that just moved."""
    flip = F.when(F.col("ply") % 2 == 0, F.lit(-1)).otherwise(F.lit(1))
    mw = F.col(mate) * flip
    mover_white = F.col("ply") % 2 == 0
    eff = F.coalesce(
        F.col(cp) * flip,
        F.when(mw > 0, F.lit(MATE_SCORE)).when(mw < 0, F.lit(-MATE_SCORE))
        .when(mw == 0, F.when(mover_white, F.lit(MATE_SCORE)).otherwise(F.lit(-MATE_SCORE))),
        F.lit(0))
    return plies.select("game_id", "ply", (F.col(cp) * flip).alias("cp_white"),
                        mw.alias("mate_white"), eff.cast("int").alias("eff_white"))


# H23
def position_keys(plies: DataFrame) -> DataFrame:
    return plies.select("game_id", "ply", position_key("fen").alias("position_key"))


# One nested document per game
def game_documents(games: DataFrame, plies: DataFrame) -> DataFrame:
    """(game_id, white, black, moves) with the start position as ``moves[0]``.
    Plies without a games row get White/Black defaults."""
    per_game = plies.groupBy("game_id").agg(
        F.array_sort(F.collect_list(F.struct(
            F.col("ply"), move_number("ply").alias("move_number"), ply_color("ply").alias("color"),
            F.col("san"), F.col("fen")))).alias("_m"))
    start = F.struct(F.lit(0).alias("move_number"), F.lit("start").alias("color"),
                     F.lit("").alias("san"), F.lit(START_FEN).alias("fen"))
    moves = F.concat(F.array(start), F.transform("_m", lambda m: F.struct(
        m["move_number"].alias("move_number"), m["color"].alias("color"),
        m["san"].alias("san"), m["fen"].alias("fen"))))
    names = games.select("game_id", "white", "black")
    return (per_game.join(names, "game_id", "left")
            .select("game_id", F.coalesce("white", F.lit("White")).alias("white"),
                    F.coalesce("black", F.lit("Black")).alias("black"), moves.alias("moves")))


def document_ply_count(docs: DataFrame) -> DataFrame:
    """The count the reference shows (start listed twice -> plies + 1) and
    the true number of plies."""
    return docs.select("game_id", F.size("moves").alias("shown_moves"),
                       (F.size("moves") - 1).alias("plies"))


def ply_counts(plies: DataFrame) -> DataFrame:
    """``document_ply_count`` of the games in ``plies``, without the documents."""
    n = F.count(F.lit(1))
    return plies.groupBy("game_id").agg((n + 1).cast("int").alias("shown_moves"), n.cast("int").alias("plies"))


def final_position(docs: DataFrame) -> DataFrame:
    """FEN of the last move, the start position for an empty document."""
    last = F.element_at("moves", -1)["fen"]
    return docs.select("game_id", F.coalesce(F.when(F.size("moves") > 0, last), F.lit(START_FEN))
                       .alias("final_fen"))


def final_positions(plies: DataFrame) -> DataFrame:
    """``final_position`` of the games in ``plies``, without the documents."""
    return plies.groupBy("game_id").agg(F.coalesce(F.max_by("fen", "ply"), F.lit(START_FEN)).alias("final_fen"))


# The evaluation of a game as one nested document
def evaluation_documents(games: DataFrame, plies: DataFrame, k: int = TOP_MISTAKES) -> DataFrame:
    """One document per game: every ply with its player, the positions around it
    and its evaluation; the best moves; the summary; the ``k`` worst errors.

    Plies behind the last one with a score were not evaluated: they have no
    quality and count nowhere but in ``plies``. All parts come from one
    partitioning by game. Plies without a games row get White/Black defaults."""
    w, whole = _by_game(), _whole_game()
    ev = ply_evaluations(plies).withColumn("fen_before", F.coalesce(F.lag("fen").over(w), F.lit(START_FEN)))
    scored = F.col("cp").isNotNull() | F.col("mate").isNotNull()
    ev = ev.withColumn("evaluated", F.col("ply") <= F.max(F.when(scored, F.col("ply"))).over(whole))
    ev = ev.withColumn("quality", F.when(F.col("evaluated"), F.col("quality")))
    row = F.struct("ply", move_number("ply").alias("move_number"), ply_color("ply").alias("color"), "uci", "san", "fen_before",
                   F.col("fen").alias("fen_after"), "eval_before", "eval_after", "cp_loss", "win_prob_before", "win_prob_after",
                   "is_best", "quality", "best_uci", "best_san")
    bad = F.col("quality").isin("inaccuracy", "mistake", "blunder")
    worst = F.when(bad, F.struct((-F.col("cp_loss")).alias("o"), "ply", "uci", "best_uci", "cp_loss", "quality"))
    per_game = ev.groupBy("game_id").agg(
        F.array_sort(F.collect_list(row)).alias("r"), F.count(F.lit(1)).alias("plies"),
        F.slice(F.array_sort(F.collect_list(worst)), 1, k).alias("worst"),
        F.count_if("evaluated").alias("total_moves_analyzed"),
        F.count_if(F.col("quality").isin("mistake", "blunder")).alias("mistakes"),
        F.count_if(F.col("quality") == "blunder").alias("blunders"),
        F.bround(F.avg(F.when(F.col("evaluated"), F.col("cp_loss"))), 1).alias("avg_cp_loss"))
    white, black = (F.coalesce(c, F.lit(c.capitalize())) for c in ("white", "black"))
    named = per_game.join(games.select("game_id", "white", "black"), "game_id", "left") \
        .withColumn("white", white).withColumn("black", black)

    def evaluation(x: Column) -> Column:
        player = F.when(x["color"] == "white", F.col("white")).otherwise(F.col("black"))
        return x.withField("player", player)
    best = F.transform(F.filter("r", lambda x: nonempty(x["best_uci"])), lambda x: F.struct(
        x["ply"].alias("ply"), x["best_uci"].alias("uci"), x["best_san"].alias("san")))
    return named.select(
        "game_id", "white", "black", "plies", F.transform("r", evaluation).alias("evaluations"), best.alias("best_moves"),
        F.struct("total_moves_analyzed", "mistakes", "blunders", "avg_cp_loss").alias("summary"),
        F.transform("worst", lambda x: x.dropFields("o")).alias("top_mistakes"))


# Games with no evaluation at all -> placeholder record
def games_without_evals(games: DataFrame, plies: DataFrame) -> DataFrame:
    missing = games.join(plies.select("game_id").distinct(), "game_id", "left_anti")
    return missing.select("game_id", "white", "black",
                          F.lit("evaluation unavailable").alias("error"))
