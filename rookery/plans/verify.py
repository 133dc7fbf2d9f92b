"""Side-by-side check of a Spark result against a DuckDB query.

Used by the tests: the Spark query and the SQL text of ``oracle_sql`` run on the
same parquet files; rows are compared without regard to order, floats with a
relative tolerance.
"""

from __future__ import annotations

import math

import duckdb
import pandas as pd

from ..sources.testdata import TABLES


def duckdb_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        if v.is_integer() and abs(v) < 2**53:
            return int(v)
        return v
    if hasattr(v, "item") and not isinstance(v, (list, tuple, dict)):
        try:
            return _norm(v.item())
        except (ValueError, AttributeError):
            pass
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime().replace(tzinfo=None)
    return v


def _rows(pdf: pd.DataFrame) -> list[tuple]:
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        out.append(tuple(_norm(v) for v in rec))
    return out


def _key(row):
    return tuple((x is None, str(type(x).__name__) if x is not None else "", x if x is not None else 0)
                 if not isinstance(x, (tuple,)) else (False, "tuple", str(x)) for x in row)


def _close(a, b, rel=1e-9) -> bool:
    if a is None or b is None:
        return a is None and b is None
    if isinstance(a, bool) or isinstance(b, bool):
        return bool(a) == bool(b)
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        if isinstance(a, int) and isinstance(b, int):
            return a == b
        return math.isclose(float(a), float(b), rel_tol=rel, abs_tol=1e-9)
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(_close(x, y, rel) for x, y in zip(a, b))
    return a == b


def compare(spark_pdf: pd.DataFrame, oracle_pdf: pd.DataFrame) -> list[str]:
    """Differences between the two results; empty when they agree."""
    problems = []
    s_cols, o_cols = sorted(spark_pdf.columns), sorted(oracle_pdf.columns)
    if s_cols != o_cols:
        return [f"columns differ: spark={s_cols} oracle={o_cols}"]
    if len(spark_pdf) != len(oracle_pdf):
        problems.append(f"row count spark={len(spark_pdf)} oracle={len(oracle_pdf)}")
    s_rows = sorted(_rows(spark_pdf), key=lambda r: repr(r))
    o_rows = sorted(_rows(oracle_pdf), key=lambda r: repr(r))
    if len(s_rows) == len(o_rows):
        bad = [(a, b) for a, b in zip(s_rows, o_rows) if not _close(a, b)]
        if bad:
            # repr-ordering can misalign rows that differ only in float noise:
            # retry with a tolerant matching on sorted non-float keys.
            problems.append(f"{len(bad)} rows differ, first: spark={bad[0][0]} oracle={bad[0][1]}")
    return problems
