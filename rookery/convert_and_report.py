"""Convert what is new in a folder of PGN sources, then report on all games.

The report is merged from the parts that every source leaves when it is converted
(``operators.report_parts``), so a run reads the games of new sources only.

    python -m rookery.convert_and_report --source pgn/ --games games/ --report stats/ [--force]

The master, ``spark.checkpoint.dir`` and other settings come from spark-submit
or the environment.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from .operators import report, report_parts
from .session import build_session, path_exists
from .sources import files, pgn


def run(spark: SparkSession, source: str, games: str, out: str | None = None, force: bool = False,
        glob: str | None = pgn.DEFAULT_GLOB) -> tuple[DataFrame, dict[str, str]]:
    """Convert the sources of ``source`` that need it into the table ``games``, with
    their parts of the report beside it (``<games>-parts``); write every analysis
    below ``out``, if given. Returns the outcome of every source and the errors of
    the analyses."""
    outcome = files.convert_folder(spark, source, games, glob, force)
    parts = f"{games.rstrip('/')}-parts"
    # a source of the table without a part, after a run that died, is read again
    known = report_parts.known_sources(spark, parts)
    changed = [r.source for r in outcome.collect() if r.status != "skipped" or r.source not in known]
    if changed and path_exists(spark, games):
        report_parts.update(files.read_games(spark, games), parts, changed)
    errors = report.write_report(None, out, sources=report_parts.merged(spark, parts)) if out else {}
    return outcome, errors


def main(argv: list[str]) -> int:
    args = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    args.add_argument("--source", required=True)
    args.add_argument("--games", required=True)
    args.add_argument("--report")
    args.add_argument("--force", action="store_true")
    a = args.parse_args(argv)
    outcome, errors = run(build_session(), a.source, a.games, a.report, a.force)
    counts = {r.status: r["count"] for r in files.batch_status(outcome).collect()}
    print(", ".join(f"{n} {status}" for status, n in sorted(counts.items())) or "no sources")
    for r in outcome.where("status = 'failed'").collect():
        print(f"failed: {r.source}: {r.error}")
    for name, error in errors.items():
        print(f"analysis {name}: {error}")
    return int("failed" in counts or bool(errors))


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
