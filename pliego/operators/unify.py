"""Schema unification and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pliego.functions.dates import parse_date
from pliego.functions.money import to_numeric
from pliego.operators.filters import search_column
from pliego.schemas import SEARCH_COLUMN, SOURCE1_TO_UNIFIED, SOURCE_COLUMN, UNIFIED_COLUMNS


def normalize_schema(df: DataFrame, source: str = "") -> DataFrame:
    """Rename source-1 names where the target is absent, add missing
    unified columns as null, tag the source.

    Q25 (deviation): when several source names map to one target, the first
    present in map order wins and the others are coalesced in after it."""
    targets: dict[str, list[str]] = {}
    for src, dst in SOURCE1_TO_UNIFIED.items():
        if src in df.columns and dst not in df.columns:
            targets.setdefault(dst, []).append(src)
    out = df
    for dst, srcs in targets.items():
        expr = F.coalesce(*[F.col(s) for s in srcs]) if len(srcs) > 1 else F.col(srcs[0])
        out = out.withColumn(dst, expr)
    out = out.drop(*[s for srcs in targets.values() for s in srcs])
    missing = {c: F.lit(None).cast("string") for c in UNIFIED_COLUMNS if c not in out.columns}
    if missing:
        out = out.withColumns(missing)
    if source:
        out = out.withColumn(SOURCE_COLUMN, F.lit(source))
    return out


def order_columns(df: DataFrame, known: list[str] = UNIFIED_COLUMNS) -> DataFrame:
    """Known columns first (in order), extras after."""
    first = [c for c in known if c in df.columns]
    return df.select(*first, *[c for c in df.columns if c not in first])


def project_existing(df: DataFrame, cols: list[str]) -> DataFrame:
    """Projection to the listed columns that exist."""
    return df.select(*[c for c in cols if c in df.columns])


def type_columns(df: DataFrame) -> DataFrame:
    """P5: value/paid -> double (bad and NaN -> null), typed start/end dates, search text."""
    out = {}
    for c in ("valor_del_contrato", "valor_pagado"):
        if c in df.columns:
            out[c] = to_numeric(c)
    if "fecha_de_inicio_del_contrato" in df.columns:
        out["fecha_inicio"] = parse_date("fecha_de_inicio_del_contrato")
    if "fecha_de_fin_del_contrato" in df.columns:
        out["fecha_fin"] = parse_date("fecha_de_fin_del_contrato")
    out[SEARCH_COLUMN] = search_column("objeto_del_contrato") if "objeto_del_contrato" in df.columns \
        else F.lit("")
    return df.withColumns(out)


def drop_helper_columns(df: DataFrame) -> DataFrame:
    """Remove the search helper before export."""
    return df.drop(SEARCH_COLUMN)


def union_sources(frames: list[DataFrame], known: list[str] = UNIFIED_COLUMNS) -> DataFrame:
    """Union aligned by name, known columns first."""
    frames = [f for f in frames if f is not None]
    if not frames:
        raise ValueError("no sources to union")
    u = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return order_columns(u, known)


def union_distinct(frames: list[DataFrame]) -> DataFrame:
    """Union of pages + full-row distinct."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames).dropDuplicates()


def union_with_batch(base: DataFrame, new: DataFrame, batch_col: str = "_lote") -> DataFrame:
    """Base + new, tagging each with an ordinal so 'last' is well defined."""
    b = base if batch_col in base.columns else base.withColumn(batch_col, F.lit(0).cast("long"))
    n = new if batch_col in new.columns else new.withColumn(batch_col, F.lit(1).cast("long"))
    return b.unionByName(n, allowMissingColumns=True)


def distinct_urls(df: DataFrame, column: str = "url_detalle") -> DataFrame:
    """U4: distinct non-null, non-blank URLs."""
    return df.select(column).where(F.col(column).isNotNull() & (F.trim(F.col(column)) != "")).distinct()


def set_difference(expected: DataFrame, actual: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(expected not in actual, actual not in expected), by value."""
    e = expected.select(F.col(column)).distinct()
    a = actual.select(F.col(column)).distinct()
    return e.join(a, column, "left_anti"), a.join(e, column, "left_anti")


def fallback(primary, secondary, errors: list[Exception] | None = None) -> DataFrame:
    """The second source's rows when the first failed or is empty.

    Both are factories (or None for a source not asked). A failure of the first
    is handed to the caller through ``errors``; without a second source it is
    raised. ``isEmpty`` only reads until the first row."""
    if primary is None and secondary is None:
        raise ValueError("no source to ask")
    rows = None
    if primary is not None:
        try:
            rows = primary()
            if secondary is None or not rows.isEmpty():
                return rows
        except Exception as exc:  # noqa: BLE001 - a source may fail in any way; it is reported
            if secondary is None:
                raise
            if errors is not None:
                errors.append(exc)
    return secondary()
