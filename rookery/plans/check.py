"""Run named queries against their DuckDB oracle: ``python -m rookery.plans.check [keys]``."""

from __future__ import annotations

import sys
import time

from ..session import build_session
from .catalog import catalog
from .verify import compare, duckdb_connection


def main(argv: list[str]) -> int:
    sf_dir = "/root/testdata/sf0.01"
    keys = [a for a in argv if not a.startswith("--")]
    for a in argv:
        if a.startswith("--sf="):
            sf_dir = a.split("=", 1)[1]
    spark = build_session("local[8]", shuffle_partitions=8)
    con = duckdb_connection(sf_dir)
    cat = catalog()
    failed = 0
    for key in keys or list(cat):
        q = cat[key]
        t0 = time.time()
        try:
            s = q.build(spark, sf_dir).toPandas()
        except Exception as exc:  # noqa: BLE001 - report and go on
            print(f"FAIL {key}: spark error {type(exc).__name__}: {str(exc)[:400]}")
            failed += 1
            continue
        dt = time.time() - t0
        text = q.oracle_text()
        if text is None:
            print(f"ROWS {key}: {len(s)} rows ({dt:.1f}s, no oracle)")
            continue
        try:
            o = con.execute(text).df()
        except Exception as exc:  # noqa: BLE001
            print(f"FAIL {key}: oracle error {str(exc)[:400]}")
            failed += 1
            continue
        probs = compare(s, o)
        print(("OK   " if not probs else "FAIL ") + f"{key}: {len(s)} rows ({dt:.1f}s) {probs}")
        failed += bool(probs)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
