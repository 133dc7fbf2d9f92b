"""The statistics report over a ``games`` table (one DataFrame per analysis).

Every analysis is declared once, in ``REPORT``: where its rows come from and how
the result is made of them. Most count games by one key; the key and its filter
are declared as a ``Dimension``. Alone, such an analysis aggregates its own key;
in the whole report one pass over the games counts the keys of all of them, and
the same ``finish`` makes the result. If that pass fails, the analyses run alone,
so that one bad key costs one analysis.

Exact medians and percentiles are computed from a frequency table (value, count)
with the weighted ``percentile``: the partial aggregate shrinks the data before
the shuffle, and no task ever buffers one value per game.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import RESULTS_DECIDED, UNKNOWN_DATE, bucket, nonempty, pct, time_class
from ..session import stored


def _share(df: DataFrame, digits: int = 2) -> DataFrame:
    """Adds ``pct``, the share of the total; the total is a one-row subquery, so
    no task sees all keys."""
    return df.withColumn("pct", pct("count", df.agg(F.sum("count")).scalar(), digits))


def _sides(games: DataFrame, *fields: str) -> DataFrame:
    """One row per (game, side) in a single scan: ``side`` plus each field of that
    side (``white_elo`` -> ``elo``, ``white`` -> ``player``)."""
    def side(s: str) -> Column:
        cols = [F.lit(s).alias("side")]
        for f in fields:
            src = s if f == "player" else f"{s}_{f}"
            cols.append(F.col(src).alias(f))
        return F.struct(*cols)
    return games.select(F.inline(F.array(side("white"), side("black"))))


def _win_shares() -> list[Column]:
    """White wins, black wins and draws of a counted key, in percent of its games."""
    n = F.col("count")
    return [F.round(F.lit(100.0) * F.col(c) / n, 1).alias(a)
            for c, a in (("w", "white_win_pct"), ("b", "black_win_pct"), ("d", "draw_pct"))]


# ---------------------------------------------------------------- keys that games are counted by

@dataclass(frozen=True)
class Dimension:
    """A key of one or two columns, and the games that have it. Functions, as
    columns need a session."""
    key: Callable[[], dict[str, Column]]
    where: Callable[[], Column]


def _rated_close() -> Column:
    return (F.col("white_elo") > 400) & (F.col("black_elo") > 400) & (F.abs(_elo_diff()) <= 500)


def _elo_diff() -> Column:
    return F.col("white_elo") - F.col("black_elo")


DIMENSIONS: dict[str, Dimension] = {
    "result": Dimension(lambda: {"result": F.col("result")}, lambda: F.col("result").isin(*RESULTS_DECIDED)),
    "time_class": Dimension(lambda: {"time_class": time_class("time_control")}, lambda: nonempty("time_control")),
    "num_moves": Dimension(lambda: {"num_moves": F.col("num_moves")}, lambda: F.col("num_moves") > 0),
    "date": Dimension(lambda: {"date": F.col("date")}, lambda: nonempty("date") & (F.col("date") != UNKNOWN_DATE)),
    "termination": Dimension(lambda: {"termination": F.col("termination")}, lambda: nonempty("termination")),
    "eco_cat": Dimension(lambda: {"eco_cat": F.left(F.col("eco"), F.lit(1))}, lambda: nonempty("eco")),
    "elo_diff": Dimension(lambda: {"elo_diff_bucket": bucket(_elo_diff(), 50)}, _rated_close),
    "opening": Dimension(lambda: {"eco": F.col("eco"), "opening": F.col("opening")}, lambda: nonempty("eco")),
}


def _results_of_game() -> list[Column]:
    r = F.col("result")
    return [(r == v).cast("int").alias(c) for v, c in (("1-0", "w"), ("0-1", "b"), ("1/2-1/2", "d"))]


_COUNTS = ("count", "w", "b", "d")


def _counted(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("count"), *[F.sum(c).alias(c) for c in "wbd"])


def count_by(games: DataFrame, dimension: str) -> DataFrame:
    """Games, and wins and draws, by one key: the key's columns, count, w, b, d."""
    d = DIMENSIONS[dimension]
    key = d.key()
    return _counted(games.where(d.where()).select(*[c.alias(n) for n, c in key.items()], *_results_of_game()), *key)


def _slots(games: DataFrame, name: str) -> list[tuple[str, str, str]]:
    """(column, type, slot) of a dimension's key in the shared rows: text columns
    lie in s0 and s1, a number in n."""
    types = games.select(*[c.alias(n) for n, c in DIMENSIONS[name].key().items()]).dtypes
    texts = [n for n, t in types if t == "string"]
    return [(n, t, f"s{texts.index(n)}" if n in texts else "n") for n, t in types]


def key_struct(name: str, slots: dict[str, Column], peak: Column | None = None) -> Column:
    """A key of the shared rows; ``peak`` is a value of which they keep the largest."""
    kinds = (("s0", "string"), ("s1", "string"), ("n", "double"))
    return F.struct(F.lit(name).alias("dim"), *[slots.get(s, F.lit(None)).cast(t).alias(s) for s, t in kinds],
                    (F.lit(None) if peak is None else peak).cast("long").alias("peak"))


def dimension_keys(games: DataFrame, dimensions: list[str]) -> list[Column]:
    """Of every dimension the key of a game, NULL where it has none."""
    keys = []
    for name in dimensions:
        columns = DIMENSIONS[name].key()
        keys.append(F.when(DIMENSIONS[name].where(), key_struct(name, {slot: columns[n] for n, _, slot in _slots(games, name)})))
    return keys


def exploded_keys(games: DataFrame, keys: list[Column], *by: str) -> DataFrame:
    """A row per game and key (dim, s0, s1, n) with the game's result flags."""
    rows = games.select(*by, F.filter(F.array(*keys), lambda k: k.isNotNull()).alias("k"), *_results_of_game())
    # explode_outer: a plain explode would get an inferred size(k) > 0 filter
    # pushed below this projection, building the key array twice
    rows = rows.select(*by, F.explode_outer("k").alias("k"), "w", "b", "d").select(*by, "k.*", "w", "b", "d")
    return rows.where(F.col("dim").isNotNull())


def keyed_counts(games: DataFrame, shared: DataFrame, name: str) -> DataFrame:
    """The counts of one dimension, in its own columns and types, out of shared counts."""
    return shared.where(F.col("dim") == name).select(*[F.col(slot).cast(t).alias(n) for n, t, slot in _slots(games, name)], *_COUNTS)


def count_by_all(games: DataFrame, dimensions: list[str]) -> dict[str, DataFrame]:
    """``count_by`` for many keys in one pass over the games.

    Every game gives a narrow row (dimension, key) for each key that it has, as
    text or number; the partial aggregate folds them per task before the
    shuffle. The shared aggregate is cached; unpersist it when done."""
    shared = _counted(exploded_keys(games, dimension_keys(games, dimensions)), "dim", "s0", "s1", "n").cache()
    return {name: keyed_counts(games, shared, name) for name in dimensions} | {"": shared}


def elo_frequencies(games: DataFrame) -> DataFrame:
    """(side, elo, both_rated, count) for rated sides: one pass that serves the
    Elo histogram (per-side range filter) and the Elo stats (game filter)."""
    both = (F.col("white_elo") > 400) & (F.col("black_elo") > 400)
    pre = games.where((F.col("white_elo") > 0) | (F.col("black_elo") > 0)).withColumn("both_rated", both)
    rows = pre.select("both_rated", F.inline(F.array(
        F.struct(F.lit("white").alias("side"), F.col("white_elo").alias("elo")),
        F.struct(F.lit("black").alias("side"), F.col("black_elo").alias("elo")))))
    return rows.where(F.col("elo") > 0).groupBy("side", "elo", "both_rated").agg(F.count(F.lit(1)).alias("count"))


# ---------------------------------------------------------------- results

def _elo_in_range(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return (c > 400) & (c < 3500)


def _elo_histogram(freq: DataFrame, *by: str) -> DataFrame:
    return (freq.where(_elo_in_range("elo")).groupBy(*by, bucket("elo", 100).alias("elo_bucket"))
            .agg(F.sum("count").alias("count")).orderBy(*by, "elo_bucket"))


def _elo_stats(freq: DataFrame) -> DataFrame:
    v, c = F.col("elo"), F.col("count")
    per_side = (freq.where("both_rated").groupBy("side", "elo").agg(F.sum("count").alias("count")).groupBy("side")
                .agg((F.sum(v.cast("long") * c) / F.sum(c)).alias("avg"), F.percentile(v, F.lit(0.5), c).alias("median")))

    def pick(side: str, c: str) -> Column:
        return F.max(F.when(F.col("side") == side, F.col(c)))
    return per_side.agg(
        pick("white", "avg").alias("avg_white"), pick("black", "avg").alias("avg_black"),
        pick("white", "median").alias("median_white"), pick("black", "median").alias("median_black"))


def _move_stats(freq: DataFrame) -> DataFrame:
    q = F.percentile(F.col("num_moves"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("count"))
    return (freq.agg((F.sum(F.col("num_moves").cast("long") * F.col("count")) / F.sum("count")).alias("avg_moves"),
                     q.alias("q"), F.min("num_moves").alias("min_moves"), F.max("num_moves").alias("max_moves"))
            .select("avg_moves", F.col("q")[1].alias("median_moves"), "min_moves", "max_moves",
                    F.col("q")[0].alias("p25"), F.col("q")[2].alias("p75")))


def player_games(games: DataFrame) -> DataFrame:
    """(player, games, peak_elo) over both colours, sides with a rating."""
    pre = games.where((F.col("white_elo") > 0) | (F.col("black_elo") > 0))
    return (_sides(pre, "player", "elo").where(F.col("elo") > 0)
            .groupBy("player").agg(F.count(F.lit(1)).alias("games"), F.max("elo").alias("peak_elo")))


def _top_players(players: DataFrame, limit: int = 20) -> DataFrame:
    return players.orderBy(F.desc("games"), "player").limit(limit)


TOP_GAME_COLUMNS = ("game_id", "white", "black", "white_elo", "black_elo", "total_elo", "result",
                    "moves_uci", "eco", "opening", "date", "time_control")


def strong_games(games: DataFrame) -> DataFrame:
    """Games with moves and both sides above 2000, with the sum of both ratings."""
    return (games.where((F.col("white_elo") > 2000) & (F.col("black_elo") > 2000) & nonempty("moves_uci"))
            .withColumn("total_elo", F.col("white_elo") + F.col("black_elo")))


def _top_game(strong: DataFrame) -> DataFrame:
    return strong.orderBy(F.desc("total_elo"), "game_id").select(*TOP_GAME_COLUMNS).limit(1)


#: What analyses read that count by no dimension of games: of the games, or of merged parts.
FRAMES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "elo": elo_frequencies,
    "total": lambda games: games.agg(F.count(F.lit(1)).alias("count")),
    "player": player_games,
    "strong": strong_games,
}


@dataclass(frozen=True)
class Analysis:
    """``finish`` makes the result from the counts of ``dimension``, from the frame of
    that name or, without one, from the games."""
    finish: Callable[[DataFrame], DataFrame]
    dimension: str | None = None

    def alone(self, games: DataFrame) -> DataFrame:
        if self.dimension is None:
            return self.finish(games)
        return self.finish(count_by(games, self.dimension) if self.dimension in DIMENSIONS else FRAMES[self.dimension](games))


def _plain(*columns: str) -> Callable[[DataFrame], DataFrame]:
    return lambda c: c.select(*columns, "count").orderBy(*columns)


def _shares(column: str, *order: str) -> Callable[[DataFrame], DataFrame]:
    return lambda c: _share(c.select(column, "count")).orderBy(*(order or (F.desc("count"), column)))


# 2.J: the registry. An entry added here is part of the report.
REPORT: dict[str, Analysis] = {
    "total_games": Analysis(lambda t: t.select(F.col("count").alias("total_games")), "total"),  # D1
    "results": Analysis(_shares("result"), "result"),  # D2: '*' is no part of the total
    "elo_histogram": Analysis(_elo_histogram, "elo"),  # D3: both sides pooled, 100-point buckets
    "elo_stats": Analysis(_elo_stats, "elo"),  # D5: games with both sides above 400
    "top_openings": Analysis(lambda c: c.select("eco", "opening", "count", *_win_shares())
                             .orderBy(F.desc("count"), "eco", "opening").limit(30), "opening"),  # D6
    "time_controls": Analysis(_shares("time_class"), "time_class"),  # D7
    "move_count_dist": Analysis(lambda c: _plain("num_moves")(c.where("num_moves < 300")), "num_moves"),  # D8
    "move_stats": Analysis(_move_stats, "num_moves"),  # D9
    "daily_activity": Analysis(_plain("date"), "date"),  # D10
    "terminations": Analysis(lambda c: _shares("termination")(c).limit(15), "termination"),  # D11: share before the cut
    "top_players": Analysis(_top_players, "player"),  # D12: rated players over both colours
    "eco_categories": Analysis(_shares("eco_cat", "eco_cat"), "eco_cat"),  # D13
    "rating_advantage": Analysis(lambda c: c.select("elo_diff_bucket", "count", *_win_shares())
                                 .orderBy("elo_diff_bucket"), "elo_diff"),  # D14: floored toward minus infinity
    "top_game": Analysis(_top_game, "strong"),  # D15: both sides above 2000, ties to the lowest id
}


def analysis(name: str) -> Callable[[DataFrame], DataFrame]:
    """The named analysis by itself: ``games -> DataFrame``."""
    return lambda games: REPORT[name].alone(games)


total_games, results, elo_histogram, elo_stats, top_openings, time_controls = map(
    analysis, ("total_games", "results", "elo_histogram", "elo_stats", "top_openings", "time_controls"))
move_count_dist, move_stats, daily_activity, terminations = map(
    analysis, ("move_count_dist", "move_stats", "daily_activity", "terminations"))
top_players, eco_categories, rating_advantage, top_game = map(
    analysis, ("top_players", "eco_categories", "rating_advantage", "top_game"))


# The Elo histogram per side
def elo_histogram_by_side(games: DataFrame) -> DataFrame:
    return _elo_histogram(elo_frequencies(games), "side")


# The most frequent player name over both colours (no Elo filter)
def focus_player(games: DataFrame) -> DataFrame:
    return (_sides(games, "player").groupBy("player").agg(F.count(F.lit(1)).alias("games"))
            .orderBy(F.desc("games"), "player").limit(1))


# Plies per game of a collection, no upper bound, with its median
def ply_distribution_player(games: DataFrame) -> DataFrame:
    dist = count_by(games, "num_moves").select("num_moves", "count")
    whole = dist.agg(F.percentile("num_moves", F.lit(0.5), F.col("count")).alias("m"), F.sum("count").alias("t"))
    return (dist.withColumn("median_moves", whole.select("m").scalar()).withColumn("total_games", whole.select("t").scalar())
            .orderBy("num_moves"))


# Collection sizes shown in titles
def collection_sizes(games: DataFrame) -> DataFrame:
    return games.agg(
        F.count_if(F.col("num_moves") > 0).alias("games_with_plies"),
        F.count_if(F.split_part(F.col("moves_uci"), F.lit(" "), F.lit(1)) != "").alias("games_with_first_move"))


# ---------------------------------------------------------------- the whole report

REPORT_COLUMNS = ("game_id", "date", "white", "black", "result", "white_elo", "black_elo", "eco",
                  "opening", "time_control", "termination", "num_moves", "moves_uci")
_FAILURES = (PySparkException, Py4JError, ArithmeticError, ValueError, KeyError, TypeError)


def report_input(games: DataFrame) -> DataFrame:
    """The column-pruned games frame the report shares (no clock strings)."""
    return games.select(*REPORT_COLUMNS)


def _message(exc: Exception) -> str:
    return f"{type(exc).__name__}: {(str(exc).splitlines() or [''])[0][:300]}"


def _cached(name: str, df: DataFrame) -> DataFrame:
    df = df.cache()
    try:
        df.count()
    except BaseException:
        df.unpersist()
        raise
    return df


def run_report(games: DataFrame | None, names: list[str] | None = None, shared: bool = True, parallel: int = 4,
               sources: dict[str, DataFrame] | None = None,
               keep: Callable[[str, DataFrame], DataFrame | None] = _cached) -> tuple[dict[str, DataFrame | None], dict[str, str]]:
    """Run the registered analyses; a failing one is reported, not fatal.

    With ``shared`` one pass counts all keys and one the Elo frequencies; only
    these small aggregates are cached, and released in the end. Analyses whose
    shared pass fails run alone. Or ``sources`` holds what every analysis reads
    (``report_parts.merged``), and no games are needed. ``keep`` computes a result
    once, where it is to stay; by default it is cached, for the caller to release.
    Returns what it made by name, and the errors by name; every analysis asked for
    is in one of them."""
    todo = list(names or REPORT)
    passes: dict[str, DataFrame] = dict(sources or {})
    cached: list[DataFrame] = []
    if shared and sources is None:
        dimensions = list(dict.fromkeys(REPORT[n].dimension for n in todo if n in REPORT and REPORT[n].dimension in DIMENSIONS))
        try:
            counts = count_by_all(games, dimensions) if dimensions else {}
            if counts:
                cached.append(counts.pop(""))
                cached[-1].count()
                passes |= counts
        except _FAILURES:
            passes = {}
        if any(n in REPORT and REPORT[n].dimension == "elo" for n in todo):
            try:
                elo = elo_frequencies(games).cache()
                cached.append(elo)
                elo.count()
                passes["elo"] = elo
            except _FAILURES:
                pass

    def one(name: str) -> DataFrame | None:
        a = REPORT[name]
        return keep(name, a.finish(passes[a.dimension]) if a.dimension in passes else a.alone(games))

    out: dict[str, DataFrame | None] = {}
    errors: dict[str, str] = {}
    with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
        for name, future in {name: pool.submit(one, name) for name in todo}.items():
            try:
                out[name] = future.result()
            except _FAILURES as exc:
                errors[name] = _message(exc)
    for df in cached:
        df.unpersist()
    return out, errors


def report_cells(games: DataFrame | None, names: list[str] | None = None, shared: bool = True,
                 sources: dict[str, DataFrame] | None = None) -> DataFrame:
    """2.J: the whole report as one table ``(analysis, status, key, measure,
    value)``, a row per number of every analysis; ``key`` holds its text columns,
    or the first column if it has none. A failed analysis is one row. Arguments as
    in ``run_report``."""
    def cells(name: str, df: DataFrame) -> DataFrame:
        texts = [c for c, t in df.dtypes if t == "string"]
        numbers = [c for c, t in df.dtypes if t != "string"]
        key = F.concat_ws("|", *texts) if texts else F.col(numbers[0]).cast("double").cast("long").cast("string")
        cell = F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in numbers]))
        rows = df.select(F.lit(name).alias("analysis"), F.lit("ok").alias("status"), key.alias("key"), cell.alias("cell"))
        return stored(rows.select("analysis", "status", "key", "cell.measure", "cell.value"), "report-cells")

    done, errors = run_report(games, names, shared, sources=sources, keep=cells)
    bad = [(n, "error", "", e, None) for n, e in errors.items()]
    out = SparkSession.active().createDataFrame(bad, "analysis string, status string, key string, measure string, value double")
    for rows in done.values():
        out = out.unionByName(rows)
    return out


def write_report(games: DataFrame | None, folder: str, names: list[str] | None = None,
                 sources: dict[str, DataFrame] | None = None) -> dict[str, str]:
    """Every analysis as a JSON folder of its own below ``folder``; returns the errors."""
    def write(name: str, df: DataFrame) -> None:
        df.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{folder}/{name}")

    return run_report(games, names, sources=sources, keep=write)[1]
