"""Data-quality, drift and freshness checks."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pliego.functions.text import strip_ws

# ---- fixed values -------------------------------------------------------------
FRESHNESS_ALERT_DAYS = 30
BADGE_DAYS = (7, 30)
# -----------------------------------------------------------------------------


def _spark_type_name(dt: T.DataType) -> str:
    return dt.simpleString()


def _cell_text(f: T.StructField) -> Column:
    """A cell as text that is equal exactly where the cells are."""
    c = F.col(f"`{f.name}`")
    if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
        c = c + F.lit(0.0)                       # -0.0 equals 0.0
    elif isinstance(f.dataType, T.BinaryType):
        return F.hex(c)
    elif not isinstance(f.dataType, T.AtomicType):
        return F.to_json(F.struct(c.alias("v")))
    return c.cast("string")


def quality_report(df: DataFrame, approximate: bool = False) -> DataFrame:
    """One row per column: type, nulls, % nulls, distinct non-null values,
    blanks (text only).

    Every cell becomes a (column, value) pair and alike ones are merged in the task, so
    the shuffle carries a pair once a task and rows are not copied whole for every
    distinct count. ``approximate`` counts distinct values by HLL++ in one wide
    aggregate instead."""
    fields = df.schema.fields
    if approximate:
        aggs: list[Column] = []
        for i, f in enumerate(fields):
            c = F.col(f"`{f.name}`")
            blank = F.count_if(strip_ws(c) == "") if isinstance(f.dataType, T.StringType) else F.lit(0)
            aggs.append(F.struct(F.lit(i).alias("i"), F.count(F.lit(1)).alias("filas"), F.count_if(c.isNull()).alias("nulos"),
                                 F.approx_count_distinct(c).cast("long").alias("unicos"), blank.cast("long").alias("vacios")))
        long = df.agg(F.array(*aggs).alias("_a")).select(F.explode("_a").alias("_a")).select("_a.*")
    else:
        cells = F.array(*[F.struct(F.lit(i).alias("i"), _cell_text(f).alias("x")) for i, f in enumerate(fields)])
        pairs = df.select(F.explode(cells).alias("p")).groupBy("p.i", "p.x").agg(F.count(F.lit(1)).alias("n"))
        counted = pairs.groupBy("i").agg(
            F.sum("n").alias("filas"), F.sum(F.when(F.col("x").isNull(), F.col("n")).otherwise(0)).alias("nulos"),
            F.count("x").alias("unicos"), F.sum(F.when(strip_ws(F.col("x")) == "", F.col("n")).otherwise(0)).alias("vacios"))
        every = df.sparkSession.createDataFrame([(i,) for i in range(len(fields))], "i int")   # an empty table has no pairs
        long = every.join(counted, "i", "left").fillna(0)
    names_of = F.array(*[F.lit(f.name) for f in fields])
    types_of = F.array(*[F.lit(_spark_type_name(f.dataType)) for f in fields])
    text = F.array(*[F.lit(isinstance(f.dataType, T.StringType)) for f in fields])
    pct = F.when(F.col("filas") > 0, F.round(F.col("nulos") / F.col("filas") * 100.0, 2)).otherwise(F.lit(None))
    return long.select(F.get(names_of, F.col("i")).alias("columna"), F.get(types_of, F.col("i")).alias("dtype"),
                       F.col("nulos").cast("long").alias("nulos"), pct.cast("double").alias("pct_nulos"),
                       F.col("unicos").cast("long").alias("unicos"),
                       F.when(F.get(text, F.col("i")), F.col("vacios")).cast("long").alias("vacios"))


def completeness(df: DataFrame) -> DataFrame:
    """% non-null cells, 0 for an empty table (rounded to 2)."""
    n_cols = len(df.columns)
    nulls = sum((F.count_if(F.col(f"`{c}`").isNull()) for c in df.columns), F.lit(0))
    agg = df.agg(F.count(F.lit(1)).alias("_rows"), nulls.alias("_nulls"))
    cells = F.col("_rows") * n_cols
    return agg.select(
        F.col("_rows").cast("long").alias("total_filas"), F.lit(n_cols).cast("long").alias("total_columnas"),
        F.when(cells > 0, F.round((1 - F.col("_nulls") / cells) * 100.0, 2)).otherwise(F.lit(0.0))
        .alias("pct_completitud"))


def count_matching(df: DataFrame, predicate: Column | None) -> DataFrame:
    """Count under the filters without materialising rows."""
    d = df.where(predicate) if predicate is not None else df
    return d.agg(F.count(F.lit(1)).alias("total"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Distinct values with their counts."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def filter_options(df: DataFrame, columns: list[str]) -> DataFrame:
    """Sorted distinct non-null values per field (long form)."""
    pairs = F.array(*[F.struct(F.lit(c).alias("campo"), F.col(c).cast("string").alias("valor"))
                      for c in columns if c in df.columns])
    return (df.select(F.explode(pairs).alias("_p")).select("_p.campo", "_p.valor")
            .where(F.col("valor").isNotNull()).distinct().orderBy("campo", "valor"))


def count_by_source(df: DataFrame, column: str = "fuente") -> DataFrame:
    """A26."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def source_list(df: DataFrame, column: str = "fuente") -> DataFrame:
    """Sorted distinct sources as one array."""
    return df.agg(F.array_sort(F.collect_set(column)).alias("fuentes"))


def freshness_badge(df: DataFrame, column: str, as_of: _dt.date | _dt.datetime,
                    threshold_days: int = FRESHNESS_ALERT_DAYS) -> DataFrame:
    """Age in days of ``column`` at ``as_of``, ok/warn against the threshold and the 7/30-day badge, for every row."""
    as_of_ts = F.lit(_dt.datetime(as_of.year, as_of.month, as_of.day)).cast("timestamp_ntz")
    age = F.floor((F.unix_timestamp(as_of_ts.cast("timestamp")) -
                   F.unix_timestamp(F.col(column).cast("timestamp"))) / 86400).cast("long")
    return df.select(
        "*", age.alias("dias"),
        F.when(age > threshold_days, F.lit("aviso")).otherwise(F.lit("ok")).alias("estado"),
        F.when(age <= BADGE_DAYS[0], F.lit("reciente")).when(age <= BADGE_DAYS[1], F.lit("normal"))
        .otherwise(F.lit("antiguo")).alias("insignia"))


def freshness(df: DataFrame, column: str, as_of: _dt.date | _dt.datetime,
              threshold_days: int = FRESHNESS_ALERT_DAYS) -> DataFrame:
    """Newest date, age in days at ``as_of`` (injected, deterministic),
    ok/warn against the threshold and the 7/30-day badge."""
    return freshness_badge(df.agg(F.max(F.col(column)).alias("mas_reciente")), "mas_reciente", as_of, threshold_days)


def filter_applied_check(df: DataFrame, column: str, expected: list[str]) -> DataFrame:
    """The distinct values must be a subset of ``expected``."""
    return df.agg(F.count(F.lit(1)).alias("filas"),
                  F.count_if(F.col(column).isNotNull() & ~F.col(column).isin(expected)).alias("fuera"),
                  F.countDistinct(column).cast("long").alias("distintos")) \
        .withColumn("aplicado", F.col("fuera") == 0)


def required_columns_check(df: DataFrame, required: list[str]) -> list[str]:
    """Missing columns (a schema read, no job)."""
    return [c for c in required if c not in df.columns]


def count_monotonic_check(df: DataFrame, predicate: Column) -> DataFrame:
    """A filtered count must be smaller than the unfiltered one."""
    return df.agg(F.count(F.lit(1)).alias("sin_filtro"), F.count_if(predicate).alias("con_filtro")) \
        .withColumn("ok", F.col("con_filtro") < F.col("sin_filtro"))


def health_check(checks: list[DataFrame]) -> DataFrame:
    """Union of (comprobacion, nivel, mensaje) rows from individual checks."""
    from functools import reduce
    return reduce(lambda a, b: a.unionByName(b), checks)


def check_row(df: DataFrame, name: str, failed: Column, message: Column, level_on_fail: str = "fallo") -> DataFrame:
    """Turn a one-row check frame into a (comprobacion, nivel, mensaje) row."""
    return df.select(F.lit(name).alias("comprobacion"),
                     F.when(failed, F.lit(level_on_fail)).otherwise(F.lit("ok")).alias("nivel"),
                     message.cast("string").alias("mensaje"))


def standard_health_check(df: DataFrame, catalogs: dict, as_of: _dt.date, date_col: str,
                          alias: tuple[str, str] | None = None, required: list[str] = (),
                          applied: dict[str, list[str]] | None = None,
                          smaller: dict[str, list[str]] | None = None,
                          scripts: dict[str, tuple[DataFrame, str, dict[str, str]]] | None = None) -> DataFrame:
    """The source-health report as (comprobacion, nivel, mensaje) rows.

    * freshness of ``date_col`` at ``as_of`` (warning when old);
    * per catalog (column -> options): API values missing from the data
      (failure: filtering by them returns nothing) and data values the
      catalog lacks (warning);
    * regression: ``alias = (column, label)`` must still translate to a value
      that finds rows (failure otherwise);
    * ``required`` columns that are missing (A30, failure);
    * ``applied``: rows outside the values a filter was to leave (A29, failure);
    * ``smaller``: a filter by these values must leave out some row (A31, failure);
    * ``scripts``: codes in portal scripts that a code table lacks (J9, warning).

    The data is read once: every looked-at column is counted by value in one
    aggregate, and all checks are sums over that table joined to the catalogs'
    values. Only ``scripts`` are other tables."""
    from functools import reduce

    from pliego.operators.filters import resolve_option
    from pliego.operators.lookup import code_drift
    spark = df.sparkSession
    missing = required_columns_check(df, list(required))
    watched = [c for c in dict.fromkeys([*catalogs, *(applied or {}), *(smaller or {})]) if c in df.columns]
    pairs = F.array(F.struct(F.lit("").alias("columna"), F.lit("").alias("valor")),
                    *[F.struct(F.lit(c).alias("columna"), F.col(c).cast("string").alias("valor")) for c in watched])
    seen = (df.select(F.col(date_col).alias("_t"), F.explode(pairs).alias("_p")).groupBy("_p.columna", "_p.valor")
            .agg(F.count(F.lit(1)).alias("n"), F.max("_t").alias("_t")))
    listed = spark.createDataFrame(sorted({(c, v) for c, options in catalogs.items() for o in options for v in o.all_api_values}),
                                   "_c string, _v string")
    both = seen.join(listed, (F.col("columna") == F.col("_c")) & (F.col("valor") == F.col("_v")), "full")
    at = lambda c, cond: F.coalesce(F.sum(F.when((F.col("columna") == c) & cond, F.col("n"))), F.lit(0))
    as_of_ts = F.lit(_dt.datetime(as_of.year, as_of.month, as_of.day)).cast("timestamp_ntz")
    age = F.floor((F.unix_timestamp(as_of_ts.cast("timestamp"))
                   - F.unix_timestamp(F.max("_t").cast("timestamp"))) / 86400).cast("long")
    # name, figure, whether it fails, level
    checks: list[tuple[str, Column, object, str]] = [("frescura", age, lambda x: x > FRESHNESS_ALERT_DAYS, "aviso")]
    for column in catalogs:
        checks.append((f"catalogo_huerfanos:{column}", F.count_if((F.col("_c") == column) & F.col("columna").isNull()),
                       lambda x: x > 0, "fallo"))
        checks.append((f"catalogo_desconocidos:{column}",
                       F.count_if((F.col("columna") == column) & F.col("valor").isNotNull() & F.col("_c").isNull()),
                       lambda x: x > 0, "aviso"))
    if alias is not None:
        column, label = alias
        opt = resolve_option(catalogs[column], label)
        values = list(opt.all_api_values) if opt is not None else []
        checks.append((f"regresion:{label}", at(column, F.col("valor").isin(values) if values else F.lit(False)),
                       lambda x: x == 0, "fallo"))
    for column, values in (applied or {}).items():
        checks.append((f"filtro_aplicado:{column}", at(column, F.col("valor").isNotNull() & ~F.col("valor").isin(values)),
                       lambda x: x > 0, "fallo"))
    for column, values in (smaller or {}).items():
        left_out = at(column, F.col("valor").isNull() | ~F.col("valor").isin(values))
        checks.append((f"conteo_monotono:{column}", left_out, lambda x: x == 0, "fallo"))
    wide = both.agg(*[figure.cast("long").alias(f"f{i}") for i, (_, figure, _, _) in enumerate(checks)])
    rows = F.array(*[F.struct(F.lit(name).alias("comprobacion"),
                              F.when(fails(F.col(f"f{i}")), F.lit(level)).otherwise(F.lit("ok")).alias("nivel"),
                              F.col(f"f{i}").cast("string").alias("mensaje"))
                     for i, (name, _, fails, level) in enumerate(checks)])
    parts = [wide.select(F.explode(rows).alias("r")).select("r.*")]
    if required:
        parts.append(spark.createDataFrame([("columnas_requeridas", "fallo" if missing else "ok", ",".join(missing))],
                                           "comprobacion string, nivel string, mensaje string"))
    for name, (texts, column, table) in (scripts or {}).items():
        drift = code_drift(texts, column, table).agg(F.count(F.lit(1)).alias("n"))
        parts.append(check_row(drift, f"codigos:{name}", F.col("n") > 0, F.col("n"), "aviso"))
    return reduce(lambda a, b: a.unionByName(b), parts)
