"""Physical-plan checks: the shapes the scale design relies on."""

import re

from conftest import SF001
from pyspark.sql import functions as F

from rookery.operators import evals, narration, report, repertoire
from rookery.operators.skew import rank_within
from rookery.sources import testdata as td


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def read_schemas(p: str) -> list[str]:
    return re.findall(r"ReadSchema: struct<([^>]*)>", p)


def test_report_scans_are_column_pruned(spark):
    p = plan(report.elo_stats(td.games(spark, SF001)))
    schemas = read_schemas(p)
    assert schemas and all("o_totalprice" not in s and "o_orderpriority" not in s for s in schemas)


def test_top_k_without_global_sort(spark):
    for fn in (report.top_game, report.top_openings, report.top_players):
        p = plan(fn(td.games(spark, SF001)))
        assert "TakeOrderedAndProject" in p, fn.__name__


def test_medians_from_frequency_table(spark):
    # the percentile runs after a (value, count) aggregate, never on raw games
    p = plan(report.move_stats(td.games(spark, SF001)))
    assert p.count("HashAggregate") >= 2 and "percentile" in p


def test_repertoire_levels_in_one_expand(spark):
    p = plan(repertoire.repertoire_nodes(td.games(spark, SF001)))
    assert "Expand" in p


def test_prompt_features_share_one_partitioning(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan(narration.narration_prompts(td.games(spark, SF001), td.plies(spark, SF001)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    by_game = re.findall(r"Exchange hashpartitioning\(game_id", p)
    assert len(by_game) == 2, p          # plies once, games once; aggregate reuses it


def test_hot_key_rank_windows_are_bucketed(spark):
    df = spark.range(1000).select(F.lit("hot").alias("key"), F.col("id"))
    p = plan(rank_within(df, ["key"], "id", width=100))
    assert re.search(r"Window .*partitionBy|Window \[", p) and "_b" in p


def test_eval_windows_need_one_exchange_per_input(spark):
    p = plan(evals.eval_diffs(td.plies(spark, SF001)))
    assert len(re.findall(r"Exchange hashpartitioning\(game_id", p)) == 1


def test_anchor_timing_is_one_partitioning(spark):
    par = td.para(spark, SF001).select("g", "p", "text", F.array(F.struct("fen", "trigger_word", "fen_idx")).alias("anchors"))
    p = plan(narration.timed_anchors(par, 40))
    assert len(re.findall(r"Exchange hashpartitioning\(g", p)) == 1 and "Union" not in p and "Join" not in p


def test_game_numbers_do_not_move_the_text(spark):
    import os
    from rookery.sources import pgn
    raw = pgn.scan_pgn(spark, os.path.join(os.path.dirname(__file__), "fixtures", "games5.pgn"), glob=None)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1024")
    try:
        p = plan(pgn.parse_games(raw))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert p.count("FileScan text") == 1 and "BroadcastHashJoin" in p and "SortMergeJoin" not in p
    # what is exchanged hangs below the broadcast of the split table, which has no text
    stream, split_side = p.split("BroadcastExchange", 1)
    below = split_side if "FileScan text" not in split_side else split_side.split("FileScan text")[0]
    assert "Exchange hashpartitioning" not in p.replace(split_side, "") and "FileScan parquet" in p
    assert "text#" not in "".join(line for line in p.splitlines() if "Exchange" in line), below


def test_features_of_stored_plies_need_no_exchange(spark):
    from rookery.session import fresh_path
    from rookery.sources import plies
    games, stored = plies.store(td.games(spark, SF001), td.plies(spark, SF001), fresh_path(spark, "t-plies"), per_bucket=1500)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = {"move_quality": evals.ply_evaluations(stored), "eval_summary": evals.eval_summary(stored), "turning_points": evals.turning_points(stored),
                "top_mistakes": evals.top_mistakes(stored), "evaluation_document": evals.evaluation_documents(games, stored),
                "game_document": evals.game_documents(games, stored), "prompts": narration.annotated_plies(games, stored)}
        for name, df in made.items():
            assert "Exchange" not in plan(df), name
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    from rookery.plans.verify import compare
    assert compare(made["eval_summary"].toPandas(), evals.eval_summary(td.plies(spark, SF001)).toPandas()) == []
    assert stored.count() == td.plies(spark, SF001).count() and plies.buckets_for(stored, 1500) > 1


def scanned_rows(df) -> int:
    """Rows that the scans of an executed plan have read: those of the row groups that were not passed over."""
    df.collect()
    node = df._jdf.queryExecution().executedPlan()
    leaves = node.executedPlan().collectLeaves() if hasattr(node, "executedPlan") and "Adaptive" in node.nodeName() else node.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_one_player_opens_few_row_groups(spark):
    from rookery.operators import repertoire
    from rookery.session import fresh_path
    from rookery.sources import players
    games = td.games(spark, "/root/testdata/sf0.1")
    path = fresh_path(spark, "t-players")
    players.write_player_index(games, path, group_bytes=1 << 17)
    everything = spark.read.schema(players.SCHEMA).parquet(path)
    name = report.focus_player(games).first().player
    own = players.games_of_player(spark, path, name)
    assert "PushedFilters: [IsNotNull(player), EqualTo(player," in plan(own)
    wanted = games.where((F.col("white") == name) | (F.col("black") == name)).count()
    assert own.count() == wanted and everything.count() > 50 * wanted
    assert scanned_rows(own) < everything.count() / 10
    # a name that lies between others is passed over by the filters of the row groups
    assert scanned_rows(players.games_of_player(spark, path, name + "x")) == 0
    from rookery.plans.verify import compare
    nodes = repertoire.repertoire_nodes(games).where(F.col("player") == name)
    assert compare(repertoire.repertoire_one_player(own).toPandas(), nodes.toPandas()) == []


def test_append_does_not_scan_the_text(spark, monkeypatch):
    from rookery.session import fresh_path
    from rookery.sources import files
    folder = fresh_path(spark, "t-append")
    games = spark.range(1, 500).select(F.col("id").alias("game_id"), F.format_string('[Event "x"]\n[ParquetGameId "%d"]\n\n1. e4 *\n', "id").alias("pgn"))
    files.append_games(games.where("game_id < 400"), folder)
    scans = []
    real = files.pgn.scan_pgn
    monkeypatch.setattr(files.pgn, "scan_pgn", lambda *a, **kw: scans.append(a) or real(*a, **kw))
    assert files.append_games(games, folder).count() == 100 and scans == []
    assert "FileScan text" not in plan(files.held_ids(spark, folder))
    assert files.append_games(games, folder).count() == 0 and scans == []
    assert real(spark, folder, glob=None).count() == 499
