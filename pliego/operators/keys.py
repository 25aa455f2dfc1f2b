"""Joins on grouping keys that keep the null group."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_groups(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, null being equal to null; the key columns come once, from the left."""
    other = {k: f"__right_{k}" for k in keys}
    renamed = right.select(*[F.col(c).alias(other.get(c, c)) for c in right.columns])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(o)) for k, o in other.items()])
    return left.join(renamed, same, how).drop(*other.values())
