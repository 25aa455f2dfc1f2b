"""Study queries (A1-A18, A32, W1-W5, L1-L4) on the contract view and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from pliego.operators import study
from pliego.plans.contract_view import CONTRACT_VIEW_SQL, contract_view, table
from pliego.plans.registry import register, rounded

CV = f"WITH cv AS ({CONTRACT_VIEW_SQL})"
R2, R4 = 2, 4


def _dist_sql(column: str, top: int, where: str = "TRUE") -> str:
    return f"""{CV},
g AS (SELECT coalesce(CAST({column} AS VARCHAR), 'No informado') AS categoria, count(*) AS contratos,
             coalesce(sum(valor_del_contrato), 0.0) AS valor_total FROM cv WHERE {where} GROUP BY 1),
t AS (SELECT sum(valor_total) AS tot FROM g)
SELECT categoria, contratos, round(valor_total, 2) AS valor_total,
       round(CASE WHEN tot <> 0 THEN valor_total / tot * 100.0 ELSE 0.0 END, 4) AS pct_valor
FROM g, t ORDER BY g.valor_total DESC, categoria LIMIT {top}"""


@register("distribution_modality", _dist_sql("modalidad_de_contratacion", 10))
def q_distribution(spark, sf):
    d = study.distribution(contract_view(spark, sf), "modalidad_de_contratacion", 10)
    return rounded(d, {"valor_total": R2, "pct_valor": R4})


@register("distribution_entity_top15", _dist_sql("nombre_entidad", 15))
def q_distribution_entity(spark, sf):
    d = study.distribution(contract_view(spark, sf), "nombre_entidad", 15)
    return rounded(d, {"valor_total": R2, "pct_valor": R4})


def _demand_sql() -> str:
    parts = []
    for col, top in study.DEMAND_DIMENSIONS:
        parts.append(f"""SELECT '{col}' AS dimension, coalesce(CAST({col} AS VARCHAR), 'No informado') AS categoria,
  count(*) AS contratos, coalesce(sum(valor_del_contrato), 0.0) AS valor_total, {top} AS top FROM cv GROUP BY 1, 2""")
    union = "\nUNION ALL\n".join(parts)
    return f"""{CV}, g AS ({union}),
r AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY valor_total DESC, categoria) AS posicion,
             sum(valor_total) OVER (PARTITION BY dimension) AS tot FROM g)
SELECT dimension, CAST(posicion AS BIGINT) AS posicion, categoria, contratos, round(valor_total, 2) AS valor_total,
       round(CASE WHEN tot <> 0 THEN valor_total / tot * 100.0 ELSE 0.0 END, 4) AS pct_valor
FROM r WHERE posicion <= top"""


@register("demand_distributions", _demand_sql())
def q_demand(spark, sf):
    d = study.demand_distributions(contract_view(spark, sf))
    return rounded(d, {"valor_total": R2, "pct_valor": R4})


@register("demand_totals", f"""{CV}
SELECT count(*) AS total_contratos, round(coalesce(sum(valor_del_contrato), 0.0), 2) AS valor_total FROM cv""")
def q_demand_totals(spark, sf):
    return rounded(study.demand_totals(contract_view(spark, sf)), {"valor_total": R2})


@register("by_year", f"""{CV}
SELECT CAST(year(fecha_de_inicio_del_contrato) AS BIGINT) AS anio, count(*) AS contratos,
       round(coalesce(sum(valor_del_contrato), 0.0), 2) AS valor_total
FROM cv WHERE fecha_de_inicio_del_contrato IS NOT NULL GROUP BY 1""")
def q_by_year(spark, sf):
    return rounded(study.by_year(contract_view(spark, sf), "fecha_de_inicio_del_contrato"), {"valor_total": R2})


@register("by_month", f"""{CV}
SELECT CAST(month(fecha_de_inicio_del_contrato) AS BIGINT) AS mes, count(*) AS contratos
FROM cv WHERE fecha_de_inicio_del_contrato IS NOT NULL GROUP BY 1""")
def q_by_month(spark, sf):
    return study.by_month(contract_view(spark, sf), "fecha_de_inicio_del_contrato")


_MONTHS_SQL = "['Enero','Febrero','Marzo','Abril','Mayo','Junio','Julio','Agosto','Septiembre','Octubre','Noviembre','Diciembre']"


@register("peak_month", f"""{CV},
m AS (SELECT CAST(month(fecha_de_inicio_del_contrato) AS BIGINT) AS mes, count(*) AS contratos
      FROM cv WHERE fecha_de_inicio_del_contrato IS NOT NULL GROUP BY 1)
SELECT mes, {_MONTHS_SQL}[mes] AS nombre_mes, contratos FROM m ORDER BY contratos DESC, mes LIMIT 1""")
def q_peak_month(spark, sf):
    return study.peak_month(contract_view(spark, sf), "fecha_de_inicio_del_contrato")


@register("period", f"""{CV}
SELECT min(fecha_de_inicio_del_contrato) AS fecha_min, max(fecha_de_inicio_del_contrato) AS fecha_max FROM cv""")
def q_period(spark, sf):
    return study.period(contract_view(spark, sf), "fecha_de_inicio_del_contrato")


_KNOWN = "trim(coalesce(proveedor_adjudicado, '')) <> '' AND lower(coalesce(proveedor_adjudicado, '')) <> 'nan'"


@register("supplier_count", f"""{CV}
SELECT CAST(count(DISTINCT proveedor_adjudicado) AS BIGINT) AS n_proveedores FROM cv WHERE {_KNOWN}""")
def q_supplier_count(spark, sf):
    return study.supplier_count(contract_view(spark, sf))


@register("supplier_distribution", _dist_sql("proveedor_adjudicado", 20, _KNOWN))
def q_supplier_distribution(spark, sf):
    d = study.supplier_distribution(contract_view(spark, sf))
    return rounded(d, {"valor_total": R2, "pct_valor": R4})


@register("concentration", f"""{CV},
g AS (SELECT proveedor_adjudicado AS categoria, coalesce(sum(valor_del_contrato), 0.0) AS valor_total
      FROM cv WHERE {_KNOWN} GROUP BY 1),
t AS (SELECT sum(valor_total) AS tot FROM g),
r AS (SELECT categoria, CASE WHEN tot <> 0 THEN valor_total / tot * 100.0 ELSE 0.0 END AS pct_valor,
             row_number() OVER (ORDER BY valor_total DESC, categoria) AS rk FROM g, t)
SELECT max(CASE WHEN rk = 1 THEN categoria END) AS lider,
       round(max(CASE WHEN rk = 1 THEN pct_valor END), 4) AS cuota_lider,
       round(sum(CASE WHEN rk <= 5 THEN pct_valor END), 4) AS cuota_top5 FROM r""")
def q_concentration(spark, sf):
    return rounded(study.concentration(contract_view(spark, sf)), {"cuota_lider": R4, "cuota_top5": R4})


@register("predominant_modality", _dist_sql("modalidad_de_contratacion", 1))
def q_predominant(spark, sf):
    d = study.predominant_modality(contract_view(spark, sf))
    return rounded(d, {"valor_total": R2, "pct_valor": R4})


@register("kpis", f"""{CV}
SELECT count(*) AS contratos, round(coalesce(sum(valor_del_contrato), 0.0), 2) AS valor_total,
       CAST(count(DISTINCT nombre_entidad) AS BIGINT) AS entidades,
       CAST(count(DISTINCT modalidad_de_contratacion) AS BIGINT) AS modalidades,
       CAST(count(DISTINCT ciudad) AS BIGINT) AS ciudades FROM cv""")
def q_kpis(spark, sf):
    return rounded(study.kpis(contract_view(spark, sf)), {"valor_total": R2})


# ---- descriptive statistics --------------------------------------------------

_DESC_ROUND = {c: R4 for c in ["media", "mediana", "moda", "minimo", "maximo", "rango", "coef_variacion",
                                "q1", "q2", "q3", "ric", "p10", "p90", "limite_inferior", "limite_superior"]}
_DESC_ROUND.update({"suma": R2, "varianza": R2, "desviacion": R4})


def _desc_sql(source: str, keys: list[str]) -> str:
    """Descriptive statistics in SQL; ``source`` yields (keys..., v)."""
    k = ", ".join(keys)
    kc = (k + ", ") if k else ""
    grp = f"GROUP BY {k}" if k else ""
    part = f"PARTITION BY {k}" if k else ""
    on = " AND ".join(f"m.{x} = mo.{x}" for x in keys) or "TRUE"
    return f"""b AS (SELECT {kc}v FROM ({source}) WHERE v > 0),
m AS (SELECT {kc}count(*) AS n, avg(v) AS media, min(v) AS minimo, max(v) AS maximo, sum(v) AS suma,
        coalesce(var_samp(v), 0.0) AS varianza, coalesce(stddev_samp(v), 0.0) AS desviacion,
        quantile_cont(v, 0.10) AS p10, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS q2,
        quantile_cont(v, 0.75) AS q3, quantile_cont(v, 0.90) AS p90 FROM b {grp}),
mo AS (SELECT {kc}v AS moda FROM (SELECT {kc}v, row_number() OVER ({part} ORDER BY count(*) DESC, v) AS rn
        FROM b GROUP BY {kc}v) WHERE rn = 1),
st AS (SELECT m.*, mo.moda, q3 - q1 AS ric, q1 - 1.5 * (q3 - q1) AS limite_inferior,
        q3 + 1.5 * (q3 - q1) AS limite_superior,
        CASE WHEN media = 0 THEN 0.0 ELSE desviacion / media * 100.0 END AS coef_variacion
        FROM m JOIN mo ON {on})"""


def _desc_select(keys: list[str]) -> str:
    kc = "".join(f"{x}, " for x in keys)
    return f"""SELECT {kc}n, round(media, 4) AS media, round(q2, 4) AS mediana, round(moda, 4) AS moda,
  round(minimo, 4) AS minimo, round(maximo, 4) AS maximo, round(maximo - minimo, 4) AS rango,
  round(suma, 2) AS suma, round(varianza, 2) AS varianza, round(desviacion, 4) AS desviacion,
  round(coef_variacion, 4) AS coef_variacion, round(q1, 4) AS q1, round(q2, 4) AS q2, round(q3, 4) AS q3,
  round(ric, 4) AS ric, round(p10, 4) AS p10, round(p90, 4) AS p90,
  round(limite_inferior, 4) AS limite_inferior, round(limite_superior, 4) AS limite_superior FROM st"""


_EVENTS_SRC = "SELECT event_type, value AS v FROM events"


@register("describe_values_events", f"WITH {_desc_sql(_EVENTS_SRC, ['event_type'])}\n{_desc_select(['event_type'])}")
def q_describe_events(spark, sf):
    return rounded(study.describe_values(table(spark, sf, "events"), "value", ["event_type"]), _DESC_ROUND)


@register("describe_values_contracts", f"""{CV}, {_desc_sql("SELECT valor_del_contrato AS v FROM cv", [])}
{_desc_select([])}""")
def q_describe_contracts(spark, sf):
    return rounded(study.describe_values(contract_view(spark, sf)), _DESC_ROUND)


def _flag_sql(source: str, keys: list[str]) -> str:
    on = " AND ".join(f"b.{x} = st.{x}" for x in keys) or "TRUE"
    kb = "".join(f"b.{x}, " for x in keys)
    return f"""{_desc_sql(source, keys)},
f AS (SELECT {kb}b.v, (b.v < st.limite_inferior OR b.v > st.limite_superior) AS out FROM b JOIN st ON {on})"""


@register("outliers_events", f"""WITH {_flag_sql(_EVENTS_SRC, ['event_type'])}
SELECT event_type, CAST(count_if(out) AS BIGINT) AS n_atipicos, round(count_if(out) / count(*) * 100.0, 4) AS pct_atipicos
FROM f GROUP BY event_type""")
def q_outliers(spark, sf):
    return rounded(study.outliers(table(spark, sf, "events"), "value", ["event_type"]), {"pct_atipicos": R4})


@register("top_outliers_events", f"""WITH {_flag_sql(_EVENTS_SRC, ['event_type'])}
SELECT event_type, posicion, valor FROM (
  SELECT event_type, CAST(row_number() OVER (PARTITION BY event_type ORDER BY v DESC) AS BIGINT) AS posicion,
         v AS valor FROM f WHERE out) WHERE posicion <= 5""")
def q_top_outliers(spark, sf):
    return study.top_outliers(table(spark, sf, "events"), "value", ["event_type"])


_ADJ_ROUND = {"media_ajustada": R4, "mediana_ajustada": R4, "minimo_ajustado": R4, "maximo_ajustado": R4,
              "desviacion_ajustada": R4, "coef_variacion_ajustado": R4, "total_ajustado": R2}


def _adj_sql(keys: list[str]) -> str:
    kc = "".join(f"{x}, " for x in keys)
    grp = f"GROUP BY {', '.join(keys)}" if keys else ""
    return f"""a AS (SELECT {kc}count(*) AS n_ajustado, avg(v) AS media_ajustada, quantile_cont(v, 0.5) AS mediana_ajustada,
        min(v) AS minimo_ajustado, max(v) AS maximo_ajustado,
        coalesce(stddev_samp(v), 0.0) AS desviacion_ajustada, sum(v) AS total_ajustado
        FROM f WHERE NOT out {grp})"""


@register("adjusted_stats_events", f"""WITH {_flag_sql(_EVENTS_SRC, ['event_type'])}, {_adj_sql(['event_type'])}
SELECT event_type, n_ajustado, round(media_ajustada, 4) AS media_ajustada,
  round(mediana_ajustada, 4) AS mediana_ajustada, round(minimo_ajustado, 4) AS minimo_ajustado,
  round(maximo_ajustado, 4) AS maximo_ajustado, round(desviacion_ajustada, 4) AS desviacion_ajustada,
  round(CASE WHEN media_ajustada = 0 THEN 0.0 ELSE desviacion_ajustada / media_ajustada * 100.0 END, 4)
    AS coef_variacion_ajustado,
  round(total_ajustado, 2) AS total_ajustado FROM a""")
def q_adjusted(spark, sf):
    return rounded(study.adjusted_stats(table(spark, sf, "events"), "value", ["event_type"]), _ADJ_ROUND)


_READ_SQL = """CASE WHEN coef_variacion < 15 THEN 'baja dispersión: los precios del mercado son homogéneos y la media es un buen estimador del precio de referencia'
  WHEN coef_variacion < 40 THEN 'dispersión moderada: conviene contrastar la media con la mediana antes de fijar el precio de referencia'
  ELSE 'dispersión alta: los precios son heterogéneos, por lo que la mediana y las estadísticas ajustadas representan mejor al mercado que el promedio simple' END"""


@register("reference_price_events", f"""WITH {_flag_sql(_EVENTS_SRC, ['event_type'])}, {_adj_sql(['event_type'])}
SELECT st.event_type,
  round(CASE WHEN a.media_ajustada IS NULL OR a.media_ajustada = 0 THEN st.media ELSE a.media_ajustada END, 4)
    AS precio_referencia, round(st.q1, 4) AS rango_desde, round(st.q3, 4) AS rango_hasta
FROM st LEFT JOIN a ON st.event_type = a.event_type""")
def q_reference_price(spark, sf):
    d = study.reference_price(table(spark, sf, "events"), "value", ["event_type"])
    return rounded(d, {"precio_referencia": R4, "rango_desde": R4, "rango_hasta": R4})


@register("dispersion_events", f"""WITH {_desc_sql(_EVENTS_SRC, ['event_type'])}
SELECT event_type, round(coef_variacion, 4) AS coef_variacion, {_READ_SQL} AS interpretacion FROM st""")
def q_dispersion(spark, sf):
    return rounded(study.dispersion(table(spark, sf, "events"), "value", ["event_type"]), {"coef_variacion": R4})


@register("study_per_region", f"""{CV}, {_flag_sql("SELECT departamento, valor_del_contrato AS v FROM cv", ['departamento'])},
{_adj_sql(['departamento'])}, o AS (SELECT departamento, CAST(count_if(out) AS BIGINT) AS n_atipicos FROM f GROUP BY 1)
SELECT st.departamento, st.n, round(st.media, 4) AS media, round(st.q2, 4) AS mediana,
  round(st.desviacion, 4) AS desviacion, round(st.coef_variacion, 4) AS coef_variacion,
  round(st.q1, 4) AS q1, round(st.q3, 4) AS q3, o.n_atipicos, a.n_ajustado,
  round(a.media_ajustada, 4) AS media_ajustada, round(a.mediana_ajustada, 4) AS mediana_ajustada,
  round(CASE WHEN a.media_ajustada IS NULL OR a.media_ajustada = 0 THEN st.media ELSE a.media_ajustada END, 4)
    AS precio_referencia,
  {_READ_SQL.replace('coef_variacion', 'st.coef_variacion')} AS interpretacion
FROM st JOIN o ON st.departamento = o.departamento LEFT JOIN a ON st.departamento = a.departamento""")
def q_study_per_region(spark, sf):
    m = study.study_per_segment(contract_view(spark, sf), ["departamento"])
    m = m.select("departamento", "n", "media", "mediana", "desviacion", "coef_variacion", "q1", "q3",
                 "n_atipicos", "n_ajustado", "media_ajustada", "mediana_ajustada", "precio_referencia",
                 "interpretacion")
    return rounded(m, {c: R4 for c in ["media", "mediana", "desviacion", "coef_variacion", "q1", "q3",
                                       "media_ajustada", "mediana_ajustada", "precio_referencia"]})


# ---- null paths (nullif written the same way on both sides) -------------------

@register("distribution_null_category", f"""{CV},
n AS (SELECT nullif(modalidad_de_contratacion, '1-URGENT') AS m, valor_del_contrato FROM cv),
g AS (SELECT coalesce(m, 'No informado') AS categoria, count(*) AS contratos,
             coalesce(sum(valor_del_contrato), 0.0) AS valor_total FROM n GROUP BY 1),
t AS (SELECT sum(valor_total) AS tot FROM g)
SELECT categoria, contratos, round(valor_total, 2) AS valor_total,
       round(CASE WHEN tot <> 0 THEN valor_total / tot * 100.0 ELSE 0.0 END, 4) AS pct_valor
FROM g, t ORDER BY g.valor_total DESC, categoria LIMIT 10""")
def q_distribution_nulls(spark, sf):
    cv = contract_view(spark, sf).withColumn(
        "modalidad_de_contratacion", F.nullif(F.col("modalidad_de_contratacion"), F.lit("1-URGENT")))
    d = study.distribution(cv, "modalidad_de_contratacion", 10)
    return rounded(d, {"valor_total": R2, "pct_valor": R4})


_NULLED_EVENTS = """SELECT event_type, CASE WHEN user_id % 7 = 0 THEN NULL WHEN user_id % 11 = 0 THEN -value
  ELSE value END AS v FROM events"""


@register("describe_values_null_paths", f"WITH {_desc_sql(_NULLED_EVENTS, ['event_type'])}\n{_desc_select(['event_type'])}")
def q_describe_nulls(spark, sf):
    ev = table(spark, sf, "events")
    v = (F.when(F.col("user_id") % 7 == 0, F.lit(None).cast("double"))
         .when(F.col("user_id") % 11 == 0, -F.col("value")).otherwise(F.col("value")))
    d = study.describe_values(ev.select("event_type", v.alias("value")), "value", ["event_type"])
    return rounded(d, _DESC_ROUND)


@register("study_segment_suppliers", f"""{CV},
s AS (SELECT departamento, proveedor_adjudicado AS categoria, count(*) AS contratos, sum(valor_del_contrato) AS v
      FROM (SELECT CASE WHEN departamento = 'ASIA' THEN NULL ELSE departamento END AS departamento, proveedor_adjudicado,
              valor_del_contrato FROM cv) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY departamento ORDER BY v DESC, categoria) AS n,
             sum(v) OVER (PARTITION BY departamento) AS t FROM s)
SELECT departamento, n AS posicion, categoria, contratos, round(v, 2) AS valor_total, round(v / t * 100, 4) AS pct_valor
FROM r WHERE n <= 20""")
def q_segment_suppliers(spark, sf):
    """A32 with a null segment: the suppliers section per department."""
    cv = contract_view(spark, sf)
    cv = cv.withColumn("departamento", F.when(F.col("departamento") != "ASIA", F.col("departamento")))
    out = study.full_study_per_segment(cv, ["departamento"])["proveedores"]
    return rounded(out, {"valor_total": 2, "pct_valor": 4})


@register("study_segment_periods", f"""{CV}
SELECT departamento, CAST(year(fecha_de_inicio_del_contrato) AS BIGINT) AS anio, count(*) AS contratos,
  round(sum(valor_del_contrato), 2) AS valor_total FROM cv WHERE fecha_de_inicio_del_contrato IS NOT NULL GROUP BY 1, 2""")
def q_segment_periods(spark, sf):
    out = study.full_study_per_segment(contract_view(spark, sf), ["departamento"])["por_anio"]
    return rounded(out, {"valor_total": 2})


@register("describe_with_nan_and_null_segment", """
WITH b AS (SELECT CASE WHEN event_type = 'click' THEN NULL ELSE event_type END AS g,
             CASE WHEN event_id % 10 <> 0 THEN value END AS v FROM events)
SELECT g, count(*) AS n, round(avg(v), 6) AS media, round(quantile_cont(v, 0.5), 6) AS mediana FROM b WHERE v > 0 GROUP BY g""")
def q_describe_nan(spark, sf):
    ev = table(spark, sf, "events").select(
        F.when(F.col("event_type") != "click", F.col("event_type")).alias("g"),
        F.when(F.col("event_id") % 10 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("v"))
    out = study.describe_values(ev, "v", ["g"]).select("g", "n", "media", "mediana")
    return rounded(out, {"media": 6, "mediana": 6})
