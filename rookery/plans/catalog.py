"""Registry of named queries: Spark builder + DuckDB oracle SQL.

Each entry takes ``(spark, sf_dir)``, reads the driver's test tables through the
game-shaped views of ``sources.testdata`` and returns a DataFrame. The oracle
text is the same query in DuckDB SQL, prefixed by the view definitions it needs.
Entries that read files Spark wrote (PGN, JSON, listings, streams) have no
oracle unless the expected content follows from the tables alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..sources import testdata as td


@dataclass(frozen=True)
class Query:
    build: Callable[[SparkSession, str], DataFrame]
    oracle: str | None = None
    views: tuple[str, ...] = ()

    def oracle_text(self) -> str | None:
        if self.oracle is None:
            return None
        prefix = td.oracle_with(*self.views) if self.views else ""
        return prefix + self.oracle.strip()


CATALOG: dict[str, Query] = {}


def register(key: str, build: Callable[[SparkSession, str], DataFrame],
             oracle: str | None = None, views: tuple[str, ...] = ()) -> None:
    if key in CATALOG:
        raise KeyError(f"duplicate query key {key}")
    CATALOG[key] = Query(build, oracle, views)


def _load_all() -> None:
    # Importing the modules registers their queries.
    from . import queries_report  # noqa: F401
    from . import queries_repertoire  # noqa: F401
    from . import queries_evals  # noqa: F401
    from . import queries_narration  # noqa: F401
    from . import queries_pgn  # noqa: F401
    from . import queries_files  # noqa: F401
    from . import queries_streaming  # noqa: F401
    from . import queries_sql  # noqa: F401


def catalog() -> dict[str, Query]:
    if not CATALOG:
        _load_all()
    return CATALOG
