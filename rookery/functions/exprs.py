"""Column expressions shared by the operators (all JVM-side built-ins)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's results.
RESULTS_DECIDED = ("1-0", "0-1", "1/2-1/2")        # a played-out result
UNKNOWN_DATE = "????.??.??"                          # date sentinel of the seven-tag roster
# Time classes by base seconds of a "base+increment" control: (upper bound, label)
TIME_CLASS_BOUNDS = ((60, "UltraBullet"), (180, "Bullet"), (600, "Blitz"), (1800, "Rapid"))
TIME_CLASS_ELSE = "Classical"
TIME_CLASS_CORRESPONDENCE = "Correspondence"       # time control '-'
TIME_CLASS_OTHER = "Other"                         # anything else, incl. bad numbers
MATE_SCORE = 10000                                 # flat score for a forced mate
WIN_PROB_SCALE = 400.0                             # logistic scale of the win probability
QUALITY_BOUNDS = ((-200, "blunder"), (-100, "mistake"), (-50, "inaccuracy"))
BLAME_THRESHOLD = 80                               # cp swing below this is noise
OPENING_MOVES = 8                                  # move numbers <= 8 are tagged opening
FINAL_PLIES = 3                                    # the last three plies are tagged final
START_FEN = "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1"


def let(value: Column, fn) -> Column:
    """Evaluate ``value`` once and hand it to ``fn`` (a one-element transform).

    Spark SQL has no local variables: an intermediate used several times, or a
    single-use one that the optimizer inlines into a lambda body, would be
    evaluated once per use or per array element."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nonempty(c) -> Column:
    """Non-null and not the empty string (missing values are '' in games)."""
    c = col(c)
    return c.isNotNull() & (c != F.lit(""))


def pct(num, den, digits: int) -> Column:
    """``ROUND(100 * num / den, digits)`` in DOUBLE arithmetic (SQL half-up)."""
    return F.round(F.lit(100.0) * col(num) / col(den), digits)


def bucket(c, width: float) -> Column:
    """``FLOOR(c / width) * width`` as DOUBLE; floors toward minus infinity."""
    return (F.floor(col(c) / F.lit(float(width))) * F.lit(int(width))).cast("double")


def time_class(tc) -> Column:
    """Class of a time-control tag. The increment is ignored; a base that is not a
    number falls into the 'other' class instead of failing the query."""
    tc = col(tc)
    base = F.split_part(tc, F.lit("+"), F.lit(1)).try_cast("int")
    inc_branch = None
    for bound, label in TIME_CLASS_BOUNDS:
        cond = base < F.lit(bound)
        inc_branch = F.when(cond, F.lit(label)) if inc_branch is None else inc_branch.when(cond, F.lit(label))
    inc_branch = inc_branch.when(base.isNotNull(), F.lit(TIME_CLASS_ELSE)).otherwise(F.lit(TIME_CLASS_OTHER))
    return (F.when(tc.contains("+"), inc_branch)
            .when(tc == F.lit("-"), F.lit(TIME_CLASS_CORRESPONDENCE))
            .otherwise(F.lit(TIME_CLASS_OTHER)))


def effective_cp(cp, mate) -> Column:
    """Centipawns from White's view; a mate counts as +/-10000, no score as 0."""
    cp, mate = col(cp), col(mate)
    return F.coalesce(
        cp,
        F.when(mate > 0, F.lit(MATE_SCORE)).when(mate.isNotNull(), F.lit(-MATE_SCORE)),
        F.lit(0),
    ).cast("int")


def win_probability(cp) -> Column:
    """``1 / (1 + exp(-cp/400))`` rounded half-even to 4 places; NULL -> 0.5."""
    cp = col(cp)
    return F.when(cp.isNull(), F.lit(0.5)).otherwise(
        F.bround(F.lit(1.0) / (F.lit(1.0) + F.exp(-cp / F.lit(WIN_PROB_SCALE))), 4))


def move_quality(signed_change, is_best) -> Column:
    """Quality by the mover's signed score change (strict bounds)."""
    d = col(signed_change)
    expr = None
    for bound, label in QUALITY_BOUNDS:
        expr = F.when(d < bound, F.lit(label)) if expr is None else expr.when(d < bound, F.lit(label))
    return expr.when(col(is_best), F.lit("good")).otherwise(F.lit("ok"))


def blame(color, diff) -> Column:
    """Side that erred: Black when the score rose > 80 after a black move,
    White when it fell < -80 after a white move; else NULL."""
    color, diff = col(color), col(diff)
    return (F.when((color == "black") & (diff > BLAME_THRESHOLD), F.lit("black"))
            .when((color == "white") & (diff < -BLAME_THRESHOLD), F.lit("white")))


def ply_color(ply) -> Column:
    return F.when(col(ply) % 2 == 0, F.lit("white")).otherwise(F.lit("black"))


def move_number(ply) -> Column:
    return (F.floor(col(ply) / F.lit(2)) + 1).cast("int")


def position_key(fen) -> Column:
    """First four FEN fields (placement, side, castling, en passant)."""
    return F.array_join(F.slice(F.split(F.trim(col(fen)), r"\s+"), 1, 4), " ")


def word_count(text) -> Column:
    """Number of whitespace-separated words (Python ``len(s.split())``)."""
    return F.size(F.filter(F.split(col(text), r"\s+"), lambda w: w != F.lit("")))


def js_round(x) -> Column:
    """JavaScript ``Math.round``: ``floor(x + 0.5)``."""
    return F.floor(col(x) + F.lit(0.5))


def unescaped(path) -> Column:
    """A path or name of ``_metadata``, which Spark writes as part of a URI, as it is."""
    return F.url_decode(F.regexp_replace(col(path), r"\+", "%2B"))


def file_stem(name="_metadata.file_name") -> Column:
    """The name of the file a row was read from, without its extension."""
    return F.regexp_extract(unescaped(name), r"^(.*?)(\.[^.]*)?$", 1)
