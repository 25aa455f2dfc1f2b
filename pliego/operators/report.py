"""Study assembly, annex and conclusions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pliego.functions.dates import parse_date, term_text
from pliego.functions.links import entity_city, process_link, upper_or_nd
from pliego.functions.money import money_text, percent_text, to_numeric
from pliego.operators import study as S

# ---- fixed values -------------------------------------------------------------
ANNEX_TOP = 50
TO_BE_COMPLETED = "[Por completar por la Entidad Estatal]"
# -----------------------------------------------------------------------------


def _as_date(df: DataFrame, column: str):
    return parse_date(column) if df.schema[column].dataType.simpleString() == "string" else F.col(column).cast("timestamp_ntz")


def annex(df: DataFrame, top: int = ANNEX_TOP, value: str = S.VALUE) -> DataFrame:
    """M7 (L3, W1, C18-C23): the ``top`` largest contracts, numbered 1..n.

    The cut is a distributed top-k (``TakeOrderedAndProject``); numbering and
    formatting run on those ``top`` rows only. Ties are broken by the
    displayed columns so the numbering is deterministic."""
    # a typed date wins row by row; where it is null the raw date is read
    df = df.withColumns({out: F.coalesce(*[_as_date(df, c) for c in (typed, raw) if c in df.columns] or [F.lit(None).cast("timestamp_ntz")])
                         for out, typed, raw in (("_inicio", "fecha_inicio", "fecha_de_inicio_del_contrato"),
                                                 ("_fin", "fecha_fin", "fecha_de_fin_del_contrato"))})
    start, end = "_inicio", "_fin"
    raw = ["proceso_de_compra", "modalidad_de_contratacion", "proveedor_adjudicado", "nombre_entidad", "ciudad",
           "objeto_del_contrato", start, end, "urlproceso"]
    raw = [c for c in raw if c in df.columns]
    order = [F.desc_nulls_last("_v"), *[F.asc_nulls_first(c) for c in raw]]
    cut = df.select(to_numeric(value).alias("_v"), *raw).orderBy(*order).limit(top)
    w = Window.partitionBy().orderBy(*order)      # over <= top rows
    return cut.select(
        F.row_number().over(w).cast("long").alias("n"),
        F.coalesce(F.col("proceso_de_compra").cast("string"), F.lit("N/D")).alias("proceso"),
        upper_or_nd("modalidad_de_contratacion").alias("modalidad"),
        upper_or_nd("proveedor_adjudicado").alias("contratista"),
        entity_city("nombre_entidad", "ciudad").alias("contratante"),
        upper_or_nd("objeto_del_contrato").alias("objeto"),
        money_text("_v").alias("valor"), term_text(start, end).alias("plazo"),
        process_link("urlproceso").alias("enlace"))


def conclusions(df: DataFrame, value: str = S.VALUE) -> DataFrame:
    """M8: conclusion items a-e from the statistics; f-h are placeholders."""
    return conclusions_of(S.market_stats(df, value), S.supplier_count(df) if S.SUPPLIER in df.columns else None,
                          S.predominant_modality(df) if "modalidad_de_contratacion" in df.columns else None)


def conclusions_of(market: DataFrame, suppliers: DataFrame | None, modality: DataFrame | None) -> DataFrame:
    """M8 from sections already there."""
    spark = market.sparkSession
    m = market.withColumn("_k", F.lit(1))
    sup = (suppliers if suppliers is not None
           else spark.createDataFrame([(0,)], "n_proveedores bigint")).withColumn("_k", F.lit(1))
    mod = (modality if modality is not None
           else spark.createDataFrame([], "categoria string, contratos bigint, valor_total double, pct_valor double")
           ).withColumn("_k", F.lit(1))
    # without a positive value the price items say N/D, the others stand
    j = sup.join(m, "_k", "left").join(mod, "_k", "left")
    n_sup = F.translate(F.format_number(F.col("n_proveedores"), 0), ",", ".")
    return j.select(
        F.concat(F.lit("a) Promedio de los contratos analizados: "), money_text("media"),
                 F.lit("; sin atípicos, "), money_text("media_ajustada"),
                 F.lit("; mediana, "), money_text("mediana"), F.lit(".")).alias("a"),
        F.concat(F.lit("b) Valor de referencia: "), money_text("precio_referencia"), F.lit(".")).alias("b"),
        F.concat(F.lit("c) La mitad central de los valores va de "), money_text("q1"), F.lit(" a "),
                 money_text("q3"), F.lit(".")).alias("c"),
        F.concat(F.lit("d) Proveedores distintos: "), n_sup, F.lit(".")).alias("d"),
        F.when(F.col("categoria").isNotNull(),
               F.concat(F.lit("e) Modalidad de selección predominante: "), F.col("categoria"), F.lit(", empleada en "),
                        F.col("contratos").cast("string"), F.lit(" de los contratos analizados ("),
                        percent_text("pct_valor"), F.lit(" del valor)."))).alias("e"),
        F.lit("f) Definición del presupuesto oficial: " + TO_BE_COMPLETED).alias("f"),
        F.lit("g) Requisitos habilitantes y criterios diferenciales: " + TO_BE_COMPLETED).alias("g"),
        F.lit("h) Análisis de riesgos: " + TO_BE_COMPLETED).alias("h"))


def study(df: DataFrame, value: str = S.VALUE) -> dict[str, DataFrame]:
    """M6: every section of the sector study as its own DataFrame.

    One reading of the facts fills a table of partial sums, from which all sections are
    cut; nothing stays cached. The annex shows rows, so it reads the facts again, but only
    those that are worth as much as the last of the largest prices in that table."""
    partials = S.study_partials(df, value)
    sections = S.study_sections(partials)
    prices = partials.sums.where("dimension = 'precio'")
    upto = Window.partitionBy().orderBy(F.desc("precio")).rowsBetween(Window.unboundedPreceding, 0)   # over <= ANNEX_TOP rows
    least = (prices.orderBy(F.desc("precio")).limit(ANNEX_TOP).withColumn("_n", F.sum("contratos").over(upto))
             .where(F.col("_n") >= ANNEX_TOP).agg(F.max("precio")).first()[0])
    # with fewer positive values than rows in the annex, all rows are needed
    # the plain column reaches the scan; NaN, which counts as above, is put last by the annex
    worth = F.col(value) if df.schema[value].dataType.simpleString() in ("double", "float") else to_numeric(value)
    sections["anexo"] = annex(df if least is None else df.where(worth >= F.lit(least)), value=value)
    sections["conclusiones"] = conclusions_of(sections["mercado"], sections.get("proveedores_n"), sections.get("modalidad_predominante"))
    for name in ("referencia", "modalidad_predominante"):     # part of other sections
        sections.pop(name, None)
    return sections
