"""PGN text as a Spark source: scan, game numbering, tags, movetext, clocks, evals.

``scan_pgn`` reads one game per record with the text source, splitting where a
line starts with ``[Event `` (Hadoop's record reader keeps records whole across
split boundaries, so a huge file is parsed by many tasks). One separator serves
LF and CRLF files and files without blank lines between games. Everything after
the scan is built-in column expressions: no Python worker touches the text.

Game numbers follow file order within a source, and the text never moves for
them: a narrow pass counts the games of every split into a stored table, a running
sum over it gives each split's offset, and the pass that parses attaches the
offsets in its tasks. The running sum orders the splits of one source in one task:
100 TB in splits of 128 MB are about 800,000 rows of a few bytes.

Moves are the mainline tokens as they are written (SAN or UCI); whether they are
legal is not checked, which would take a chess engine's move generator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import file_stem, let
from ..session import stored

# Python-chess fills the seven-tag roster with these when a tag is
# missing; all other tags default to ''.
ROSTER_DEFAULTS = {"Event": "?", "Site": "?", "Date": "????.??.??", "Round": "?",
                   "White": "?", "Black": "?", "Result": "*"}
GAME_SEP = "\n[Event "
DEFAULT_GLOB = "*.[pP][gG][nN]"

_TAG_RE = r'(?m)^\[([A-Za-z0-9_]+)\s+"(.*)"\][ \t]*$'
_MOVE_AND_COMMENT = r"([^\s{}]+)(?:\s*\{([^}]*)\})?"


def scan_pgn(spark: SparkSession, path: str | list[str], glob: str | None = DEFAULT_GLOB,
             recursive: bool = False, base_path: str | None = None, missing_ok: bool = False) -> DataFrame:
    """Raw games: ``(source, file_path, block_start, _row, text)``.

    ``source`` is a ``source=`` partition folder when the layout has one, else
    the file name without extension. ``_row`` orders games within a split."""
    reader = spark.read.option("lineSep", GAME_SEP)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    if base_path:
        reader = reader.option("basePath", base_path)
    if missing_ok:
        reader = reader.option("ignoreMissingFiles", "true")
    raw = reader.text(path)
    source = F.col("source").cast("string") if "source" in raw.columns else file_stem()
    # what stands in front of the first game (a byte order mark, blank lines) is no game
    df = (raw.where(has_game("value"))
          .select(source.alias("source"), F.col("_metadata.file_path").alias("file_path"),
                  F.col("_metadata.file_block_start").alias("block_start"),
                  F.monotonically_increasing_id().alias("_row"), F.col("value").alias("text")))
    return restore_game_text(df)


def has_game(value: str) -> Column:
    """Whether a record of the scan holds more than a byte order mark and blanks."""
    return F.left(F.col(value), F.lit(4096)).rlike("[^\\x{FEFF}\\s]")


def restore_game_text(df: DataFrame, text: str = "text") -> DataFrame:
    """Undo the record split: invalid bytes replaced, LF line ends, no BOM or
    blank lines in front, and the ``[Event `` the separator consumed. One
    projection per stage, so the stages are not evaluated twice."""
    t = F.col(text)
    # literal replaces: "\r\n" first, then what is left of "\r"
    df = df.withColumn(text, F.replace(F.replace(F.make_valid_utf8(t), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")))
    df = df.withColumn(text, F.when(F.left(t, F.lit(1)).rlike("[\\x{FEFF}\\s]"), F.regexp_replace(t, "^[\\x{FEFF}\\s]+", "")).otherwise(t))
    return df.withColumn(text, F.when(t.startswith("[Event "), t).otherwise(F.concat(F.lit("[Event "), t)))


#: Splits whose offsets are sent to every task, some 40 bytes each; of more, the
#: planner chooses the join.
MAP_SIDE_SPLITS = 2_000_000

_SPLIT = ["source", "_f1", "_f2", "block_start"]


def _keyed(raw: DataFrame) -> DataFrame:
    # two independent hashes stand for the file path in the split table
    return raw.withColumn("_f1", F.xxhash64("file_path")).withColumn("_f2", F.hash("file_path"))


def split_table(raw: DataFrame) -> DataFrame:
    """The games of every file split, counted in a pass of its own and stored:
    one row per split with its number of games ``_n`` and first row ``_r0``."""
    spark = raw.sparkSession
    # how files are split must not change with the number of executors between the passes
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    return stored(_keyed(raw).groupBy(*_SPLIT, "file_path").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_r0")), "pgn-splits")


def _attached(raw: DataFrame, splits: DataFrame, offsets: DataFrame, number: Column) -> DataFrame:
    """``raw`` with ``game_id``: ``number`` over ``_place``, the 0-based position of a
    game in its split, and the columns of ``offsets``, joined where the rows are. A
    row that the count does not know, because files changed in between, is an error."""
    if splits.count() <= MAP_SIDE_SPLITS:
        offsets = F.broadcast(offsets)
    known = F.col("_place").between(0, F.col("_n") - 1)
    changed = F.raise_error(F.concat(F.lit("changed since its games were counted: "), F.col("file_path"))).cast("long")
    df = _keyed(raw).join(offsets, _SPLIT, "left").withColumn("_place", F.col("_row") - F.col("_r0"))
    return df.withColumn("game_id", F.when(known, number).otherwise(changed)).drop("_place", *[c for c in offsets.columns if c != "source" and c != "block_start"])


def number_games(raw: DataFrame, first: DataFrame | None = None, splits: DataFrame | None = None) -> DataFrame:
    """A5: 1-based game number (LONG) in file order within each source.

    Rows of one split are consecutive within one task, so the position inside
    the split is ``_row - min(_row)``. ``splits`` is the split table (counted here
    unless given). ``first`` ``(source, last_id)`` holds the numbers already given,
    which go on."""
    splits = split_table(raw) if splits is None else splits
    before = Window.partitionBy("source").orderBy("file_path", "block_start") \
        .rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select(*_SPLIT, "_n", "_r0", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    if first is not None:
        offsets = offsets.join(first, "source", "left").withColumn(
            "_offset", F.col("_offset") + F.coalesce("last_id", F.lit(0))).drop("last_id")
    return _attached(raw, splits, offsets, F.col("_offset") + F.col("_place") + 1)


def number_games_in_ranges(raw: DataFrame, splits: DataFrame, ranges: DataFrame) -> DataFrame:
    """Game numbers out of the ranges that each file has been given: ``ranges`` is
    ``(file_path, ranges array<struct<pos, first, n>>)``, and the game at position
    pos + i of its file (from 1) has the number first + i."""
    before = Window.partitionBy("file_path").orderBy("block_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (splits.select(*_SPLIT, "file_path", "_n", "_r0", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
               .join(ranges.select("file_path", F.col("ranges").alias("_ranges")), "file_path").drop("file_path"))
    position = F.col("_offset") + F.col("_place") + 1
    own = F.filter("_ranges", lambda r: (r["pos"] <= position) & (position < r["pos"] + r["n"]))[0]
    return _attached(raw, splits, offsets, own["first"] + position - own["pos"])


# ---------------------------------------------------------------- tags

def split_game(text: Column | str = "text") -> tuple[Column, Column]:
    """(tag section, movetext): the leading lines in brackets, and the rest.
    The blank line between them may be missing."""
    t = F.col(text) if isinstance(text, str) else text
    header = F.regexp_extract(t, r"^((?:\[[^\n]*+\n?\s*+)*+)", 1)
    return header, F.substring(t, F.length(header) + 1, F.length(t))


def tag_arrays(header: Column) -> tuple[Column, Column]:
    """Tag names, reversed so that the last occurrence of a name wins, and the
    values in the same order behind one NULL slot (position 0 = not found)."""
    keys = F.reverse(F.regexp_extract_all(header, F.lit(_TAG_RE), 1))
    vals = F.concat(F.array(F.lit(None).cast("string")),
                    F.reverse(F.regexp_extract_all(header, F.lit(_TAG_RE), 2)))
    return keys, vals


def tag(keys: Column, vals: Column, name: str, default: str | None = None) -> Column:
    """Value of tag ``name`` (PGN escapes undone), else the default. Kept to
    one lookup per tag: a game has many tags and the whole projection must stay
    small enough for compiled code."""
    v = F.element_at(vals, F.array_position(keys, F.lit(name)).cast("int") + 1)
    if default is None:
        default = ROSTER_DEFAULTS.get(name, "")
    return F.coalesce(F.regexp_replace(v, r'\\(["\\])', "$1"), F.lit(default))


def tag_values(keys: Column, vals: Column, names: list[str]) -> Column:
    """Values of many tags at once (NULL = missing), as one array. One small
    lambda instead of one expression per tag keeps the generated code of the
    projection under the size the JIT compiles."""
    wanted = F.array(*[F.lit(n) for n in names])
    # bind the arrays once: inlined into the lambda they would be rebuilt per name
    def unescape(v: Column) -> Column:
        return _if_contains(v, "\\", lambda e: F.regexp_replace(e, r'\\(["\\])', "$1"))
    return let(F.struct(keys.alias("k"), vals.alias("v")), lambda kv: F.transform(F.transform(
        wanted, lambda n: F.element_at(kv["v"], F.array_position(kv["k"], n).cast("int") + 1)), unescape))


def with_tags(df: DataFrame, text: str = "text") -> DataFrame:
    header, movetext = split_game(F.col(text))
    keys, vals = tag_arrays(header)
    return df.withColumn("_keys", keys).withColumn("_vals", vals).withColumn("movetext", movetext)


# ---------------------------------------------------------------- movetext

def _if_contains(c: Column, needle: str, fn) -> Column:
    """Apply a rewrite only to values that contain ``needle`` (skips a regex
    pass for most games)."""
    return F.when(c.contains(needle), fn(c)).otherwise(c)


def with_clean_movetext(df: DataFrame, movetext: str = "movetext", out: str = "_clean") -> DataFrame:
    """Mainline only: drop ';' comments, side lines of any depth, move numbers,
    NAGs, '!?' suffixes and the result; merge consecutive comments; drop a
    comment that precedes the first move. Comments after moves stay in place.

    Each stage is its own projection: a stage refers to its input twice (test
    and rewrite), and nesting them as one expression would copy the earlier
    stages."""
    def innermost(m: Column) -> Column:
        return F.regexp_replace(m, r"\((?:[^(){}]++|\{[^}]*+\})*+\)", " ")

    def var(m: Column) -> Column:
        # one pass per level, innermost side lines first; a game has no more
        # levels than opening brackets, and passes without any are skipped
        levels = F.sequence(F.lit(1), F.greatest(F.regexp_count(m, F.lit(r"\(")), F.lit(1)))
        return F.aggregate(levels, m, lambda text, _: F.when(text.contains("("), innermost(text)).otherwise(text))
    df = df.withColumn(out, _if_contains(F.col(movetext), ";", lambda m: F.regexp_replace(m, r";[^\n]*", " ")))
    df = df.withColumn(out, _if_contains(F.col(out), "(", var))
    df = df.withColumn(out, _if_contains(F.col(out), "$", lambda m: F.regexp_replace(m, r"\$\d+", " ")))
    # a move number starts a token and is not followed by a digit (keeps "0.36")
    m = F.regexp_replace(F.col(out), r"(?<![^\s])\d+\.(?:\.\.)?(?![0-9])", " ")
    df = df.withColumn(out, m)
    m = F.col(out)
    df = df.withColumn(out, F.when(m.contains("!") | m.contains("?"), F.regexp_replace(m, r"(?<=[^\s{}])[!?]+", "")).otherwise(m))
    df = df.withColumn(out, F.regexp_replace(m, r"(^|\s)(1-0|0-1|1/2-1/2|\*)(?=\s|$)", " "))
    return df.withColumn(out, _if_contains(F.col(out), "{", lambda c: F.regexp_replace(
        F.regexp_replace(c, r"\}\s*\{", " "), r"^\s*\{[^}]*\}", " ")))


def move_tokens(clean: Column) -> tuple[Column, Column]:
    """Aligned arrays: mainline move tokens and the comment after each ('' if none)."""
    return (F.regexp_extract_all(clean, F.lit(_MOVE_AND_COMMENT), 1),
            F.regexp_extract_all(clean, F.lit(_MOVE_AND_COMMENT), 2))


def clock_seconds(comment: Column) -> Column:
    """A3: the first ``%clk`` of a comment in whole seconds (H:MM:SS or M:SS,
    fractions truncated), NULL when absent or malformed."""
    after = F.regexp_extract(comment, r"(?s)%clk(.*)", 1)
    after = F.split_part(after, F.lit("%clk"), F.lit(1))
    after = F.regexp_replace(F.regexp_replace(after, r"^\s+", ""), r"^[\[ ]+", "")
    val = F.regexp_replace(F.split_part(after, F.lit("]"), F.lit(1)), r"^\s+|\s+$", "")

    def seconds(parts: Column) -> Column:
        n = F.size(parts)

        def num(i: int) -> Column:
            return F.trim(F.element_at(parts, i)).try_cast("int")

        def secs(i: int) -> Column:
            return F.trim(F.element_at(parts, i)).try_cast("double").try_cast("int")
        return F.when(n == 3, num(1) * 3600 + num(2) * 60 + secs(3)).when(n == 2, num(1) * 60 + secs(2))
    # the parts are read several times, and found once
    return F.when(comment.contains("%clk"), let(F.split(val, ":"), seconds))


def eval_score(comment: Column) -> tuple[Column, Column]:
    """``[%eval x.xx]`` -> centipawns, ``[%eval #n]`` -> mate in n."""
    raw = F.regexp_extract(comment, r"\[%eval\s+([^\]\s]+)", 1)
    mate = F.when(raw.startswith("#"), F.substring(raw, 2, 1 << 20).try_cast("int"))
    cp = F.when(~raw.startswith("#") & (raw != ""),
                F.round(raw.try_cast("double") * 100).try_cast("int"))
    return cp, mate


def parse_games(raw: DataFrame, numbered: bool = True, first: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Raw games -> the columns of the ``games`` table (A2-A5, H7) plus ``source``
    and ``src_game_id`` (ParquetGameId tag).

    ``game_id`` is LONG and ``num_moves`` INT here; ``files.conform`` narrows
    them to the fixed schema. A rating that is no SMALLINT is unknown (0), like
    one that is no number. ``first`` as in ``number_games``; games that are not to
    be ``numbered`` keep the ``game_id`` that they have. Columns of ``raw`` named in
    ``keep`` come last."""
    df = raw
    if numbered:
        df = number_games(raw, first)
    elif "game_id" not in raw.columns:
        df = raw.withColumn("game_id", F.lit(None).cast("long"))
    df = with_clean_movetext(with_tags(df))
    moves, comments = move_tokens(F.col("_clean"))
    names = ["Event", "Site", "UTCDate", "Date", "White", "Black", "Result", "WhiteElo", "BlackElo",
             "WhiteRatingDiff", "BlackRatingDiff", "ECO", "Opening", "TimeControl", "Termination",
             "ParquetGameId"]
    # the comments of a game without clocks are not looked at
    clk = F.when(F.col("_clean").contains("%clk"), F.transform(comments, clock_seconds)).otherwise(F.array().cast("array<int>"))
    df = (df.withColumn("_tokens", moves)
          .withColumn("_clk", clk)
          .withColumn("_t", tag_values(F.col("_keys"), F.col("_vals"), names)))

    def t(name: str, default: str | None = None) -> Column:
        if default is None:
            default = ROSTER_DEFAULTS.get(name, "")
        return F.coalesce(F.col("_t")[names.index(name)], F.lit(default))

    def elo(name: str) -> Column:
        return F.coalesce(t(name).try_cast("smallint"), F.lit(0).cast("smallint"))

    def rd(name: str) -> Column:
        return F.coalesce(t(name).try_cast("float"), F.lit(0.0).cast("float"))
    date = F.coalesce(F.col("_t")[names.index("UTCDate")], t("Date"))
    df = df.select(
        "source", "game_id",
        t("Event").alias("event"), t("Site").alias("site"), date.alias("date"),
        t("White").alias("white"), t("Black").alias("black"), t("Result").alias("result"),
        elo("WhiteElo").alias("white_elo"), elo("BlackElo").alias("black_elo"),
        rd("WhiteRatingDiff").alias("white_rd"), rd("BlackRatingDiff").alias("black_rd"),
        t("ECO").alias("eco"), t("Opening").alias("opening"),
        t("TimeControl").alias("time_control"), t("Termination").alias("termination"),
        t("ParquetGameId").alias("src_game_id"),
        "_tokens", "_clk", *keep,
    )
    clocks = F.filter("_clk", lambda x: x.isNotNull())
    return df.select("source", "game_id", "event", "site", "date", "white", "black", "result", "white_elo",
                     "black_elo", "white_rd", "black_rd", "eco", "opening", "time_control", "termination",
                     F.size("_tokens").alias("num_moves"), F.array_join("_tokens", " ").alias("moves_uci"),
                     F.array_join(F.transform(clocks, lambda x: x.cast("string")), " ").alias("clock_times"),
                     "src_game_id", *keep)


def ply_evals(raw: DataFrame) -> DataFrame:
    """One row per evaluated ply ``(source, src_game_id, ply, cp, mate)``."""
    df = with_clean_movetext(with_tags(raw))
    moves, comments = move_tokens(F.col("_clean"))
    df = df.select("source", tag(F.col("_keys"), F.col("_vals"), "ParquetGameId", "").alias("src_game_id"),
                   F.posexplode(comments).alias("ply", "comment"))
    cp, mate = eval_score(F.col("comment"))
    return (df.select("source", "src_game_id", "ply", cp.alias("cp"), mate.alias("mate"))
            .where(F.col("cp").isNotNull() | F.col("mate").isNotNull()))


def single_game_defaults(raw: DataFrame) -> DataFrame:
    """The single-game parse: Elo and ECO default to '?', Elo stays text,
    a game without moves is rejected."""
    df = with_clean_movetext(with_tags(raw))
    k, v = F.col("_keys"), F.col("_vals")
    moves, _ = move_tokens(F.col("_clean"))
    df = df.withColumn("_moves", moves)
    return df.select(
        "source", tag(k, v, "ParquetGameId", "").alias("src_game_id"),
        tag(k, v, "White").alias("white"), tag(k, v, "Black").alias("black"),
        tag(k, v, "WhiteElo", "?").alias("white_elo"), tag(k, v, "BlackElo", "?").alias("black_elo"),
        tag(k, v, "ECO", "?").alias("eco"), tag(k, v, "Opening", "").alias("opening"),
        tag(k, v, "Result").alias("result"), F.array_join("_moves", " ").alias("moves_uci"),
        F.when(F.size("_moves") > 0, F.lit("ok")).otherwise(F.lit("rejected: no moves")).alias("status"))
