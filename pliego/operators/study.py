"""Sector study: demand, supply, descriptive statistics with IQR outliers.

A1-A18, A32, W1-W5, L1-L4. Every operator returns a DataFrame; rows never reach
the driver. Price statistics and the assembled study write tables of counts and sums
to the shared folder, and the choice of the date column reads one row of counts. Top-N cuts happen on aggregated rows (``limit`` or a
``row_number() <= N`` filter, which Spark turns into a partial per-partition
group limit before the shuffle), never on raw rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pliego.functions.dates import month_name, month_of, year_of
from pliego.functions.links import cv_percent, dispersion_reading as _reading
from pliego.functions.money import to_numeric
from pliego.operators.filters import known_supplier_predicate, positive_predicate
from pliego.operators.keys import join_groups
from pliego.operators.quantiles import ValueTable, drop_all_key, value_table, values_at, with_all_key
from pliego.session import frozen

# ---- fixed values -------------------------------------------------------------
VALUE = "valor_del_contrato"
NOT_INFORMED = "No informado"
DEMAND_DIMENSIONS = [            # (dimension column, top N)
    ("modalidad_de_contratacion", 10),
    ("tipo_de_contrato", 10),
    ("nombre_entidad", 15),
    ("ciudad", 10),
    ("estado_contrato", 10),
]
DATE_CANDIDATES = ["fecha_inicio", "fecha_de_inicio_del_contrato", "fecha_de_firma", "fecha_apertura"]
SUPPLIER = "proveedor_adjudicado"
SUPPLIER_TOP = 20
IQR_FACTOR = 1.5
STAT_PROBS = [0.10, 0.25, 0.50, 0.75, 0.90]
STAT_NAMES = ["p10", "q1", "q2", "q3", "p90"]
TOP_OUTLIERS = 5
# -----------------------------------------------------------------------------


def _category(col: str):
    return F.coalesce(F.col(col).cast("string"), F.lit(NOT_INFORMED))


def distribution(df: DataFrame, column: str, top: int = 10, value: str = VALUE) -> DataFrame:
    """A1 (+W3 share of total, L1 sort, L2 top-N head): per category (null ->
    'No informado'): contracts, value sum, share of the total over *all*
    categories; descending by sum, ties by name; top N.

    An all-null (or missing) column gives an empty result (Q2)."""
    if column not in df.columns:
        return df.sparkSession.createDataFrame(
            [], "categoria string, contratos bigint, valor_total double, pct_valor double")
    agg = (df.groupBy(_category(column).alias("categoria"))
           .agg(F.count(F.lit(1)).alias("contratos"),
                F.coalesce(F.sum(to_numeric(value)), F.lit(0.0)).alias("valor_total"),
                F.count(F.col(column)).alias("_present")))
    return (_top_with_totals(agg, [], F.lit(top), top)
            .select("categoria", "contratos", "valor_total", "pct_valor"))


def _top_with_totals(agg: DataFrame, part: list[str], limit: F.Column, most: int) -> DataFrame:
    """The top categories of every ``part`` with their share of its total.

    Each task keeps its own ``most`` best rows of a part and they are merged (a group
    limit before and after the shuffle); totals are one sum a task. Both read the same
    aggregate, whose exchange Spark reuses, so the facts are read once."""
    best = [F.desc("valor_total"), F.asc("categoria")]
    agg = agg.withColumn("_limite", limit)
    top = (agg.withColumn("posicion", F.row_number().over(Window.partitionBy(*part).orderBy(*best)))
           .where((F.col("posicion") <= most) & (F.col("posicion") <= F.col("_limite")))
           .withColumn("posicion", F.col("posicion").cast("long")))
    sums = agg.groupBy(*part).agg(F.sum("valor_total").alias("_tot"), F.sum("_present").alias("_pres"),
                                  F.sum("contratos").alias("_filas"), F.max("_limite").alias("_hasta"))
    whole = join_groups(top, sums, part) if part else top.crossJoin(F.broadcast(sums))      # one row without parts
    # a part is no larger than its whole: said here so that both readers need the same columns, hence the same exchange
    out = whole.where((F.col("_pres") > 0) & (F.col("_present") <= F.col("_pres")) & (F.col("contratos") <= F.col("_filas"))
                      & (F.col("posicion") <= F.col("_hasta")))
    return out.withColumn("pct_valor", F.when(F.col("_tot") != 0, F.col("valor_total") / F.col("_tot") * 100.0)
                          .otherwise(F.lit(0.0)))


def demand_distributions(df: DataFrame, dims: Sequence[tuple[str, int]] = DEMAND_DIMENSIONS,
                         value: str = VALUE, segment: Sequence[str] = ()) -> DataFrame:
    """A2 (+W5): every dimension's distribution in one scan.

    Rows are stacked as (dimension, category) pairs inside the scan stage and
    pre-aggregated map-side; top-N and totals per (segment, dimension) come from
    one reading of that aggregate. Null segments are segments."""
    seg = list(segment)
    dims = [(c, n) for c, n in dims if c in df.columns]
    pairs = F.array(*[F.struct(F.lit(c).alias("dimension"), _category(c).alias("categoria"),
                               F.col(c).isNotNull().cast("long").alias("present"),
                               F.lit(n).alias("top")) for c, n in dims])
    stacked = df.select(*seg, to_numeric(value).alias("_v"), F.explode(pairs).alias("_d"))
    agg = (stacked.groupBy(*seg, F.col("_d.dimension").alias("dimension"),
                           F.col("_d.categoria").alias("categoria"))
           .agg(F.count(F.lit(1)).alias("contratos"),
                F.coalesce(F.sum("_v"), F.lit(0.0)).alias("valor_total"),
                F.sum("_d.present").alias("_present"), F.max("_d.top").alias("_top")))
    return (_top_with_totals(agg, [*seg, "dimension"], F.col("_top"), max([n for _, n in dims] or [0]))
            .select(*seg, "dimension", "posicion", "categoria", "contratos", "valor_total", "pct_valor"))


def demand_totals(df: DataFrame, value: str = VALUE) -> DataFrame:
    """A3: row count and value sum (all rows, not only positive ones, Q8)."""
    return df.agg(F.count(F.lit(1)).alias("total_contratos"),
                  F.coalesce(F.sum(to_numeric(value)), F.lit(0.0)).alias("valor_total"))


def pick_date_column(df: DataFrame, candidates: Sequence[str] = DATE_CANDIDATES) -> str | None:
    """First candidate holding any value (one aggregate pass, Q32)."""
    present = [c for c in candidates if c in df.columns]
    if not present:
        return None
    row = df.agg(*[F.count(F.col(c)).alias(c) for c in present]).first()
    return next((c for c in present if row[c] > 0), None)


def by_year(df: DataFrame, date_col: str, value: str = VALUE) -> DataFrame:
    """A4 (+C24, F19): year -> contracts, value sum."""
    return (df.select(year_of(date_col).alias("anio"), to_numeric(value).alias("_v"))
            .where(F.col("anio").isNotNull())
            .groupBy("anio").agg(F.count(F.lit(1)).alias("contratos"),
                                 F.coalesce(F.sum("_v"), F.lit(0.0)).alias("valor_total")))


def by_month(df: DataFrame, date_col: str) -> DataFrame:
    """A5: calendar month over all years -> contracts; absent months absent."""
    return (df.select(month_of(date_col).alias("mes")).where(F.col("mes").isNotNull())
            .groupBy("mes").agg(F.count(F.lit(1)).alias("contratos")))


def peak_month(df: DataFrame, date_col: str) -> DataFrame:
    """A6 (+J10): month with most contracts, the earliest month on ties."""
    return (by_month(df, date_col).orderBy(F.desc("contratos"), F.asc("mes")).limit(1)
            .select("mes", month_name("mes").alias("nombre_mes"), "contratos"))


def period(df: DataFrame, date_col: str) -> DataFrame:
    """First and last date."""
    return df.agg(F.min(date_col).alias("fecha_min"), F.max(date_col).alias("fecha_max"))


def known_suppliers(df: DataFrame, column: str = SUPPLIER) -> DataFrame:
    """supplier not blank and not the text 'nan'."""
    return df.where(known_supplier_predicate(column))


def supplier_count(df: DataFrame, column: str = SUPPLIER, approximate: bool = False) -> DataFrame:
    """Distinct known suppliers (exact by default; HLL++ opt-in)."""
    k = known_suppliers(df, column)
    agg = F.approx_count_distinct(column) if approximate else F.countDistinct(column)
    return k.agg(agg.cast("long").alias("n_proveedores"))


def supplier_distribution(df: DataFrame, column: str = SUPPLIER, top: int = SUPPLIER_TOP,
                          value: str = VALUE) -> DataFrame:
    """A10: A1 over known suppliers."""
    return distribution(known_suppliers(df, column), column, top, value)


def concentration(df: DataFrame, column: str = SUPPLIER, value: str = VALUE) -> DataFrame:
    """A11 (+W4): leader, leader share and top-5 cumulative share."""
    ranked = supplier_distribution(df, column, SUPPLIER_TOP, value).withColumn(
        "posicion", F.row_number().over(Window.partitionBy().orderBy(F.desc("valor_total"), F.asc("categoria"))))
    return concentration_of(ranked, [])


def concentration_of(top: DataFrame, by: Sequence[str]) -> DataFrame:
    """A11 from a supplier distribution with ``posicion``, per segment."""
    return top.groupBy(*by).agg(
        F.max(F.when(F.col("posicion") == 1, F.col("categoria"))).alias("lider"),
        F.max(F.when(F.col("posicion") == 1, F.col("pct_valor"))).alias("cuota_lider"),
        F.sum(F.when(F.col("posicion") <= 5, F.col("pct_valor"))).alias("cuota_top5"),
    ).where(F.col("lider").isNotNull())


def _positive(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """numeric, non-null, > 0 (Q8)."""
    return df.where(positive_predicate(value)).select(*keys, to_numeric(value).alias("_v"))


def _moments(t: ValueTable) -> DataFrame:
    """n, sum, min, max and mode (ties: the smallest value) in one aggregate."""
    return t.values.groupBy(*t.keys).agg(
        F.sum("_c").cast("long").alias("n"), F.sum(F.col("_c") * F.col("_v")).alias("suma"),
        F.min("_v").alias("minimo"), F.max("_v").alias("maximo"),
        F.min_by(F.col("_v"), F.struct(-F.col("_c"), F.col("_v"))).alias("moda"))


def _first_pass(t: ValueTable) -> DataFrame:
    """Stage A: the moments and the quantiles."""
    a = _moments(t)
    q = values_at(t, a, {name: F.lit(p) * (F.col("n") - 1) for p, name in zip(STAT_PROBS, STAT_NAMES)})
    return join_groups(a.withColumn("media", F.col("suma") / F.col("n")), q, t.keys)


def _second_pass(t: ValueTable, first: DataFrame) -> DataFrame:
    """Stage B: exact two-pass variance, outlier counts and the moments of the
    kept values (shifted by the group mean) in one aggregate."""
    keys = t.keys
    ric = F.col("q3") - F.col("q1")
    fences = first.select(*keys, "media", (F.col("q1") - IQR_FACTOR * ric).alias("limite_inferior"),
                          (F.col("q3") + IQR_FACTOR * ric).alias("limite_superior"))
    j = join_groups(t.values, fences, keys)
    d = F.col("_v") - F.col("media")
    low = F.col("_v") < F.col("limite_inferior")
    high = F.col("_v") > F.col("limite_superior")
    kept = ~low & ~high
    kc = F.when(kept, F.col("_c")).otherwise(F.lit(0))
    return j.groupBy(*keys).agg(
        F.sum(F.col("_c") * d * d).alias("_ss"),
        F.sum(F.when(low, F.col("_c")).otherwise(0)).alias("_nlow"),
        F.sum(F.when(high, F.col("_c")).otherwise(0)).alias("_nhigh"),
        F.sum(kc).alias("_kn"), F.sum(kc * d).alias("_kd"), F.sum(kc * d * d).alias("_kdd"),
        F.sum(kc * F.col("_v")).alias("_ksum"),
        F.min(F.when(kept, F.col("_v"))).alias("minimo_ajustado"),
        F.max(F.when(kept, F.col("_v"))).alias("maximo_ajustado"))


def _stats_columns(keys: list[str]) -> list:
    ric = F.col("q3") - F.col("q1")
    var = F.when(F.col("n") > 1, F.col("_ss") / (F.col("n") - 1)).otherwise(F.lit(0.0))
    return [*keys, "n", "media", F.col("q2").alias("mediana"), "moda", "minimo", "maximo",
            (F.col("maximo") - F.col("minimo")).alias("rango"), "suma", var.alias("varianza"),
            F.sqrt(var).alias("desviacion"), cv_percent(F.sqrt(var), F.col("media")).alias("coef_variacion"),
            "q1", "q2", "q3", ric.alias("ric"), "p10", "p90",
            (F.col("q1") - IQR_FACTOR * ric).alias("limite_inferior"),
            (F.col("q3") + IQR_FACTOR * ric).alias("limite_superior")]


@dataclass(frozen=True)
class PriceTables:
    """What the price sections share: the value table and two written tables of one row per group."""
    table: ValueTable
    first: DataFrame
    second: DataFrame

    @property
    def keys(self) -> list[str]:
        return self.table.keys


def price_tables(df: DataFrame | None, value: str = VALUE, by: Sequence[str] = (), counted: DataFrame | None = None) -> PriceTables:
    """The tables of the positive values of ``df``, or of (keys..., _v, _c) rows already counted."""
    if counted is not None:
        rows, keys = with_all_key(counted, by)
        t = value_table(rows, "_v", keys, counted=rows.select(*keys, "_v", "_c"))
    else:
        rows, keys = with_all_key(df, by)
        t = value_table(_positive(rows, value, keys), "_v", keys)
    first = frozen(_first_pass(t), "price-first")
    return PriceTables(t, first, frozen(_second_pass(t, first), "price-second"))


def describe_values(df: DataFrame, value: str = VALUE, by: Sequence[str] = ()) -> DataFrame:
    """N, mean, median, mode, min, max, range, sum, var, std, CV%, quartiles,
    IQR, p10, p90 and fences, per group (or one row), over values > 0."""
    p = price_tables(df, value, by)
    return drop_all_key(join_groups(p.first, p.second.select(*p.keys, "_ss"), p.keys).select(*_stats_columns(p.keys)))


def _sizes(p: PriceTables) -> DataFrame:
    """Counts per group from which the ranks of the adjusted statistics follow."""
    return join_groups(p.first.select(*p.keys, F.col("n").alias("_n")), p.second.select(*p.keys, "_nlow", "_nhigh", "_kn"), p.keys)


def _adjusted_median(p: PriceTables) -> DataFrame:
    """The adjusted median has rank ``n_low + (n_kept - 1) / 2``: outliers hold the lowest and highest ranks."""
    rank = F.when(F.col("_kn") > 0, F.col("_nlow") + (F.col("_kn") - 1) * 0.5)
    return values_at(p.table, _sizes(p), {"mediana_ajustada": rank})


def _adjusted_columns() -> list:
    """A13 + A14 over the joined passes."""
    kn = F.col("_kn")
    var = F.when(kn > 1, (F.col("_kdd") - F.col("_kd") * F.col("_kd") / kn) / (kn - 1)).when(kn > 0, F.lit(0.0))
    std = F.sqrt(F.greatest(var, F.lit(0.0)))
    mean = F.when(kn > 0, F.col("_ksum") / kn)
    return [(F.col("_nlow") + F.col("_nhigh")).cast("long").alias("n_atipicos"),
            ((F.col("_nlow") + F.col("_nhigh")) / F.col("n") * 100.0).alias("pct_atipicos"),
            kn.cast("long").alias("n_ajustado"), mean.alias("media_ajustada"),
            F.when(kn > 0, F.col("mediana_ajustada")).alias("mediana_ajustada"),
            "minimo_ajustado", "maximo_ajustado", F.when(kn > 0, std).alias("desviacion_ajustada"),
            F.when(kn > 0, cv_percent(std, mean)).alias("coef_variacion_ajustado"),
            F.when(kn > 0, F.col("_ksum")).alias("total_ajustado")]


def _all_passes(p: PriceTables) -> DataFrame:
    return join_groups(join_groups(p.first, p.second, p.keys), _adjusted_median(p), p.keys, "left")


def outliers_and_adjusted(df: DataFrame, value: str = VALUE, by: Sequence[str] = ()) -> DataFrame:
    """A13 + A14: outlier count and % (strict fences, Q9) and n, mean, median,
    min, max, std, CV, total of the values that are not outliers."""
    p = price_tables(df, value, by)
    return drop_all_key(_all_passes(p).select(*p.keys, *_adjusted_columns()))


def outliers(df: DataFrame, value: str = VALUE, by: Sequence[str] = ()) -> DataFrame:
    """A13 (+F12): outlier count and percentage (strict fences, Q9)."""
    p = price_tables(df, value, by)
    out = join_groups(p.first.select(*p.keys, "n"), p.second, p.keys).select(
        *p.keys, (F.col("_nlow") + F.col("_nhigh")).cast("long").alias("n_atipicos"),
        ((F.col("_nlow") + F.col("_nhigh")) / F.col("n") * 100.0).alias("pct_atipicos"))
    return drop_all_key(out)


def top_outliers(df: DataFrame | None, value: str = VALUE, by: Sequence[str] = (), top: int = TOP_OUTLIERS,
                 tables: PriceTables | None = None) -> DataFrame:
    """The five largest outlier values (duplicates kept), ranked: rank ``n-1-j``
    while ``j < n_high``, then ``n_low-1-(j-n_high)``."""
    p = tables if tables is not None else price_tables(df, value, by)
    rank = lambda j: (F.when(F.lit(j) < F.col("_nhigh"), F.col("_n") - 1 - j)
                      .when(F.lit(j) < F.col("_nhigh") + F.col("_nlow"), F.col("_nlow") - 1 - (j - F.col("_nhigh"))))
    at = values_at(p.table, _sizes(p), {f"top{j}": rank(j) for j in range(top)})
    out = at.select(*p.keys, F.explode(F.array(*[
        F.struct(F.lit(j + 1).cast("long").alias("posicion"), F.col(f"top{j}").alias("valor")) for j in range(top)])).alias("_t"))
    return drop_all_key(out.where(F.col("_t.valor").isNotNull()).select(*p.keys, "_t.posicion", "_t.valor"))


def adjusted_stats(df: DataFrame, value: str = VALUE, by: Sequence[str] = ()) -> DataFrame:
    """N, mean, median, min, max, std, CV and total without the outliers
    (groups whose every value is an outlier are absent)."""
    oa = outliers_and_adjusted(df, value, by).where(F.col("n_ajustado") > 0)
    return oa.select(*by, "n_ajustado", "media_ajustada", "mediana_ajustada", "minimo_ajustado",
                     "maximo_ajustado", "desviacion_ajustada", "coef_variacion_ajustado", "total_ajustado")


def market_stats(df: DataFrame | None, value: str = VALUE, by: Sequence[str] = (),
                 tables: PriceTables | None = None) -> DataFrame:
    """A12 + A13 + A14 + A15 + A16 in one row per group (the study's price section)."""
    p = tables if tables is not None else price_tables(df, value, by)
    full = _all_passes(p).select(*_stats_columns(p.keys), *_adjusted_columns())
    ref = F.when(F.col("media_ajustada").isNull() | (F.col("media_ajustada") == 0),
                 F.col("media")).otherwise(F.col("media_ajustada"))
    full = full.withColumn("precio_referencia", ref) \
               .withColumn("interpretacion", _reading(F.col("coef_variacion")))
    return drop_all_key(full)


def reference_price(df: DataFrame, value: str = VALUE, by: Sequence[str] = ()) -> DataFrame:
    """Adjusted mean (else mean) and the q1-q3 price range."""
    m = market_stats(df, value, by)
    return m.select(*by, "precio_referencia", F.col("q1").alias("rango_desde"), F.col("q3").alias("rango_hasta"))


def dispersion(df: DataFrame, value: str = VALUE, by: Sequence[str] = ()) -> DataFrame:
    """CV and its reading."""
    d = describe_values(df, value, by)
    return d.select(*by, "coef_variacion", _reading(F.col("coef_variacion")).alias("interpretacion"))


def predominant_modality(df: DataFrame, column: str = "modalidad_de_contratacion",
                         value: str = VALUE) -> DataFrame:
    """Top category, its contract count and value share."""
    return distribution(df, column, 1, value)


def kpis(df: DataFrame, value: str = VALUE) -> DataFrame:
    """Rows, value sum, distinct entities / modalities / cities.

    One (column, value) pair a cell, alike ones merged in the task before the shuffle."""
    names = {c: n for c, n in (("nombre_entidad", "entidades"), ("modalidad_de_contratacion", "modalidades"), ("ciudad", "ciudades"))
             if c in df.columns}
    cells = [F.struct(F.lit("").alias("c"), F.lit(None).cast("string").alias("x"), to_numeric(value).alias("v"))]
    cells += [F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("x"), F.lit(None).cast("double").alias("v")) for c in names]
    pairs = df.select(F.explode(F.array(*cells)).alias("p")).groupBy("p.c", "p.x").agg(F.count(F.lit(1)).alias("n"), F.sum("p.v").alias("v"))
    of_table = F.col("c") == ""
    return pairs.agg(F.coalesce(F.sum(F.when(of_table, F.col("n"))), F.lit(0)).cast("long").alias("contratos"),
                     F.coalesce(F.sum(F.when(of_table, F.col("v"))), F.lit(0.0)).alias("valor_total"),
                     *[F.count_if((F.col("c") == c) & F.col("x").isNotNull()).cast("long").alias(n) for c, n in names.items()])


def study_per_segment(df: DataFrame, by: Sequence[str], value: str = VALUE) -> DataFrame:
    """A32, price section: every segment in one job, instead of a loop."""
    return market_stats(df, value, by)


# ---- the whole study from one table of partial sums -----------------------------

_TOTAL, _SUPPLIER, _PRICE = "total", "proveedor", "precio"


@dataclass(frozen=True)
class StudyPartials:
    """One written table of sums by (segment..., dimension, category, price): every section but the annex is cut from it."""
    sums: DataFrame
    by: list[str]
    dims: list[tuple[str, int]]
    date: str | None
    supplier: bool


def study_partials(df: DataFrame, value: str = VALUE, by: Sequence[str] = ()) -> StudyPartials:
    """The one reading of the facts: each row is stacked into its dimensions (totals, the five demand
    dimensions, known supplier, year and month of every date candidate, positive price), alike ones
    merged in the task before the shuffle. The table has a row a category and a distinct price."""
    by = list(by)
    dims = [(c, n) for c, n in DEMAND_DIMENSIONS if c in df.columns]
    dates = [c for c in DATE_CANDIDATES if c in df.columns]
    amount = to_numeric(value) if value in df.columns else F.lit(None).cast("double")
    none = F.lit(None).cast("double")

    def pair(name: str, category, present=F.lit(1), price=none):
        return F.struct(F.lit(name).alias("dimension"), category.cast("string").alias("categoria"),
                        price.alias("precio"), present.cast("long").alias("present"))

    pairs = [pair(_TOTAL, F.lit(None)), F.when(F.col("_m") > 0, pair(_PRICE, F.lit(None), price=F.col("_m")))]
    pairs += [pair(c, _category(c), F.col(c).isNotNull()) for c, _ in dims]
    if SUPPLIER in df.columns:
        pairs.append(F.when(known_supplier_predicate(SUPPLIER), pair(_SUPPLIER, F.col(SUPPLIER))))
    for c in dates:
        pairs += [F.when(part(c).isNotNull(), pair(f"{name}:{c}", part(c))) for name, part in (("anio", year_of), ("mes", month_of))]
    first, last = [F.when(F.col("_d.dimension") == _TOTAL, F.col(c)) for c in dates], [f"_{c}" for c in dates]
    stacked = df.withColumn("_m", amount).select(*by, "_m", *dates, F.explode(F.array(*pairs)).alias("_d")).where(F.col("_d").isNotNull())
    sums = stacked.groupBy(*by, "_d.dimension", "_d.categoria", "_d.precio").agg(
        F.count(F.lit(1)).alias("contratos"), F.coalesce(F.sum("_m"), F.lit(0.0)).alias("valor_total"),
        F.sum("_d.present").alias("_present"),
        *[f(x).alias(f"{name}{n}") for x, n in zip(first, last) for f, name in ((F.min, "min"), (F.max, "max"), (F.count, "n"))])
    sums = frozen(sums, "study")
    held = sums.where(F.col("dimension") == _TOTAL).agg(F.lit(0).alias("_"), *[F.sum(f"n{n}").alias(n) for n in last]).first()
    date = next((c for c, n in zip(dates, last) if (held[n] or 0) > 0), None)
    return StudyPartials(sums, by, dims, date, SUPPLIER in df.columns)


def study_sections(p: StudyPartials) -> dict[str, DataFrame]:
    """The sections of the study, with the segment's columns in front. Null segments are segments."""
    by, of = p.by, lambda name: p.sums.where(F.col("dimension") == name)
    counted = of(_PRICE).select(*by, F.col("precio").alias("_v"), F.col("contratos").alias("_c"))
    prices = price_tables(None, by=by, counted=counted)
    market = frozen(market_stats(None, by=by, tables=prices), "market")
    tops = [(F.col("dimension") == c, n) for c, n in p.dims]
    limit = reduce(lambda w, t: w.when(*t), tops[1:], F.when(*tops[0])) if tops else F.lit(0)
    demand = p.sums.where(F.col("dimension").isin([c for c, _ in p.dims])).drop("precio")
    total = of(_TOTAL).groupBy(*by).agg(F.coalesce(F.sum("contratos"), F.lit(0)).cast("long").alias("total_contratos"),
                                        F.coalesce(F.sum("valor_total"), F.lit(0.0)).alias("valor_total"))
    shown = [*by, "posicion", "categoria", "contratos", "valor_total", "pct_valor"]
    sections = {
        "demanda_totales": total,
        "demanda_distribuciones": _top_with_totals(demand, [*by, "dimension"], limit, max([n for _, n in p.dims] or [0]))
        .select(*by, "dimension", *shown[len(by):]),
        "mercado": market,
        "referencia": market.select(*by, "precio_referencia", F.col("q1").alias("rango_desde"), F.col("q3").alias("rango_hasta")),
        "atipicos_mayores": top_outliers(None, by=by, tables=prices),
    }
    if p.supplier:
        known = of(_SUPPLIER)
        sections["proveedores_n"] = known.groupBy(*by).agg(F.count(F.lit(1)).alias("n_proveedores"))
        sections["proveedores"] = frozen(_top_with_totals(known, by, F.lit(SUPPLIER_TOP), SUPPLIER_TOP).select(*shown), "suppliers")
        sections["concentracion"] = concentration_of(sections["proveedores"], by)
    if "modalidad_de_contratacion" in [c for c, _ in p.dims]:
        sections["modalidad_predominante"] = _top_with_totals(of("modalidad_de_contratacion"), by, F.lit(1), 1).select(*by, *shown[len(by) + 1:])
    if p.date:
        year, month = of(f"anio:{p.date}"), of(f"mes:{p.date}")
        sections["por_anio"] = year.select(*by, F.col("categoria").cast("long").alias("anio"), "contratos", "valor_total")
        months = month.select(*by, F.col("categoria").cast("long").alias("mes"), "contratos", "valor_total")
        sections["por_mes"] = months
        peak = months.groupBy(*by).agg(F.max_by(F.struct("mes", "contratos"), F.struct("contratos", -F.col("mes"))).alias("_p"))
        sections["mes_pico"] = peak.select(*by, "_p.mes", month_name("_p.mes").alias("nombre_mes"), "_p.contratos")
        sections["periodo"] = of(_TOTAL).select(*by, F.col(f"min_{p.date}").alias("fecha_min"), F.col(f"max_{p.date}").alias("fecha_max"))
    return sections


def full_study_per_segment(df: DataFrame, by: Sequence[str], value: str = VALUE) -> dict[str, DataFrame]:
    """Every section of the study with the segment as an extra grouping key, from one reading of the facts."""
    return study_sections(study_partials(df, value, by))
