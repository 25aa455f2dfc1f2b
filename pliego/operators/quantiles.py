"""Exact order statistics per group by refining histograms.

``percentile``/``mode`` aggregates keep a value->count map per group and merge it
in one task, so a group holding a third of the table would sit in a single
executor. Here the work is split instead:

1. rows are compressed to ``(group, value, copies)`` with map-side combine, and
   that *value table* is written once; no sort, no range partitioning;
2. every value falls into a histogram cell by a monotone function of its
   logarithm; the cells' copies, counts of values and bounds (a few thousand rows a
   group at most, whatever its size) give each cell its interval of ranks;
3. a wanted rank lies in one cell. Only the values of those cells are looked at
   again; a cell with more than ``FINE`` values is cut into ``SPLIT`` equal parts of
   its own range, counted, and so on, until the cells that hold the wanted ranks are
   small enough to be sorted.

A round shuffles counts of cells only. A quantile is the value at rank ``p * (n - 1)``
(linear interpolation between floor and ceil, the rule of pandas and DuckDB's
``quantile_cont``).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pliego.operators.keys import join_groups
from pliego.session import frozen

ALL_KEY = "_all"
#: Cells of a factor e in the first histogram, parts of a cell in later ones, values of a cell that is sorted.
CELLS = 64
SPLIT = 4096
FINE = 2048


def value_counts_by_group(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """(keys..., value, _c): distinct values per group with their multiplicity."""
    return (df.where(F.col(value).isNotNull())
            .groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c")))


@dataclass(frozen=True)
class ValueTable:
    """Written: ``values`` (keys..., _v, _c, _b) and ``cells`` (keys..., _b, _s, _c, _d, _lo, _hi), where ``_s`` is the rank
    of a cell's first value in its group and ``_d`` its number of values."""
    values: DataFrame
    cells: DataFrame
    keys: list[str]


def _cell(v: Column) -> Column:
    """Number of the value's cell in the first histogram; does not fall as the value grows."""
    size = F.floor(F.least(F.log1p(F.abs(v)), F.lit(1e6)) * CELLS)
    return F.when(v < 0, -size).otherwise(size).cast("string")


def _histogram(values: DataFrame, by: list[str]) -> DataFrame:
    return values.groupBy(*by).agg(F.sum("_c").alias("_c"), F.count(F.lit(1)).alias("_d"),
                                   F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))


def value_table(df: DataFrame, value: str, keys: Sequence[str] = (), counted: DataFrame | None = None) -> ValueTable:
    """The value table of ``df``, or of already counted (keys..., _v, _c) rows, and its first histogram.

    Null is a group like any other; null values take no part."""
    keys = list(keys)
    vc = counted if counted is not None else (
        value_counts_by_group(df.select(*keys, F.col(value).cast("double").alias("_v")), "_v", keys))
    values = frozen(vc.withColumn("_b", _cell(F.col("_v"))), "values")
    before = Window.partitionBy(*keys).orderBy("_lo").rowsBetween(Window.unboundedPreceding, -1)   # a group's cells
    cells = _histogram(values, [*keys, "_b"]).withColumn("_s", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    return ValueTable(values, frozen(cells, "cells"), keys)


def _hit(cells: DataFrame) -> DataFrame:
    """The cells that hold a wanted rank, with those ranks only."""
    inside = F.filter("_w", lambda w: (w["r"] >= F.col("_s")) & (w["r"] < F.col("_s") + F.col("_c")))
    return cells.withColumn("_w", inside).where(F.size("_w") > 0)


def values_at(table: ValueTable, groups: DataFrame, positions: dict[str, Column]) -> DataFrame:
    """One row per group of ``groups`` with the value at each (fractional) rank position.

    ``positions`` maps an output name to a Column over the columns of ``groups``; a
    null position, or one outside the group, gives null."""
    keys, names = table.keys, list(positions)
    asked = []
    for i, pos in enumerate(positions.values()):
        for side, rank in ((0, F.floor(pos)), (1, F.ceil(pos))):
            asked.append(F.struct(F.lit(i).alias("i"), F.lit(side).alias("side"), rank.cast("long").alias("r")))
    wanted = groups.select(*keys, *[pos.cast("double").alias(f"_p{i}") for i, pos in enumerate(positions.values())],
                           F.filter(F.array(*asked), lambda w: w["r"].isNotNull()).alias("_w"))
    hit = frozen(_hit(join_groups(table.cells, wanted.select(*keys, "_w"), keys)), "wanted")
    values, found = table.values, []
    while True:
        rows = join_groups(values, hit.drop("_c"), [*keys, "_b"])
        upto = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)  # at most FINE rows
        end = F.col("_s") + F.sum("_c").over(upto)
        small = rows.where(F.col("_d") <= FINE).withColumn("_e", end)
        at = F.filter("_w", lambda w: (w["r"] >= F.col("_e") - F.col("_c")) & (w["r"] < F.col("_e")))
        found.append(small.select(*keys, "_v", F.explode(at).alias("_w")))
        if hit.where(F.col("_d") > FINE).isEmpty():
            break
        part = F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * SPLIT), F.lit(SPLIT - 1))
        large = rows.where(F.col("_d") > FINE).withColumn("_of", F.col("_b")).withColumn("_b", F.concat_ws("/", "_b", part.cast("string")))
        values = frozen(large.select(*keys, "_v", "_c", "_b", "_of", "_s", "_w"), "values")
        before = Window.partitionBy(*keys, "_of").orderBy("_lo").rowsBetween(Window.unboundedPreceding, -1)  # at most SPLIT rows
        cells = values.groupBy(*keys, "_of", "_b").agg(
            F.sum("_c").alias("_c"), F.count(F.lit(1)).alias("_d"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"),
            F.first("_s").alias("_s"), F.first("_w").alias("_w"))
        cells = cells.withColumn("_s", F.col("_s") + F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_of")
        values, hit = values.drop("_of", "_s", "_w"), frozen(_hit(cells), "wanted")
    picks = reduce(DataFrame.unionByName, found).groupBy(*keys).agg(*[
        F.max(F.when((F.col("_w.i") == i) & (F.col("_w.side") == side), F.col("_v"))).alias(f"_{'lh'[side]}{i}")
        for i in range(len(names)) for side in (0, 1)])
    out = join_groups(wanted.drop("_w"), picks, keys, "left")
    between = lambda i: F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * (F.col(f"_p{i}") - F.floor(f"_p{i}"))
    return out.select(*keys, *[between(i).alias(name) for i, name in enumerate(names)])


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], keys: Sequence[str] = (),
                    names: Sequence[str] | None = None) -> DataFrame:
    """One row per group: ``keys..., _n, <name_i>`` with the exact quantiles."""
    base, by = with_all_key(df, keys)
    names = list(names or [f"q_{i}" for i in range(len(probs))])
    t = value_table(base, value, by)
    sizes = t.cells.groupBy(*by).agg(F.sum("_c").alias("_n"))
    q = values_at(t, sizes, {name: F.lit(float(p)) * (F.col("_n") - 1) for name, p in zip(names, probs)})
    return drop_all_key(join_groups(sizes, q, by).select(*by, "_n", *names))


def approx_quantiles(df: DataFrame, value: str, probs: Sequence[float], keys: Sequence[str] = (),
                     names: Sequence[str] | None = None, accuracy: int = 10000) -> DataFrame:
    """Opt-in approximate quantiles (Q7): one aggregate with a bounded sketch
    per group (``percentile_approx``); rank error at most ``n / accuracy``.
    Values are observed values, not interpolated."""
    names = list(names or [f"q_{i}" for i in range(len(probs))])
    q = F.percentile_approx(F.col(value), [float(p) for p in probs], accuracy)
    out = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(q.alias("_q"), F.count(F.lit(1)).alias("_n"))
    return out.select(*keys, "_n", *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])


def with_all_key(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Give an ungrouped computation a constant key so one code path serves both."""
    if keys:
        return df, list(keys)
    return df.withColumn(ALL_KEY, F.lit(0)), [ALL_KEY]


def drop_all_key(df: DataFrame) -> DataFrame:
    return df.drop(ALL_KEY) if ALL_KEY in df.columns else df
