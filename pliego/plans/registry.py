"""Registered queries: Spark DataFrame builder + equivalent DuckDB SQL.

Every query reads the given tables (or frames Spark derives from them) in
full. Doubles are rounded identically on both sides because sums of doubles
depend on the order of addition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    return df.select(*[F.round(F.col(c), digits[c]).alias(c) if c in digits else F.col(c)
                       for c in df.columns])


def load_all() -> None:
    """Import the modules that register queries."""
    from pliego.plans import queries_study  # noqa: F401
    from pliego.plans import queries_text  # noqa: F401
    from pliego.plans import queries_search  # noqa: F401
    from pliego.plans import queries_quality  # noqa: F401
    from pliego.plans import queries_incremental  # noqa: F401
    from pliego.plans import queries_html  # noqa: F401
    from pliego.plans import queries_report  # noqa: F401
    from pliego.plans import queries_jobs  # noqa: F401
    from pliego.plans import queries_sections  # noqa: F401
