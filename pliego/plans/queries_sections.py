"""The assembled study, section by section: written as report tables and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pliego.operators import study
from pliego.operators.report import study as whole_study
from pliego.plans import queries_report as R
from pliego.plans import queries_study as Q
from pliego.plans.contract_view import contract_view
from pliego.plans.registry import ORACLE, register, rounded
from pliego.session import scratch_path
from pliego.sources import files

CV = Q.CV
#: Section: key columns, number columns with their digits, text columns.
SECTIONS: dict[str, tuple[list[str], dict[str, int], list[str]]] = {
    "demanda_totales": ([], {"total_contratos": 0, "valor_total": 2}, []),
    "demanda_distribuciones": (["dimension", "posicion", "categoria"], {"contratos": 0, "valor_total": 2, "pct_valor": 4}, []),
    "proveedores_n": ([], {"n_proveedores": 0}, []),
    "proveedores": (["categoria"], {"contratos": 0, "valor_total": 2, "pct_valor": 4}, []),
    "concentracion": (["lider"], {"cuota_lider": 4, "cuota_top5": 4}, []),
    "mercado": ([], {"n": 0, "media": 4, "mediana": 4, "moda": 4, "minimo": 4, "maximo": 4, "desviacion": 4, "q1": 4, "q3": 4, "p10": 4,
                     "p90": 4, "n_atipicos": 0, "n_ajustado": 0, "media_ajustada": 4, "mediana_ajustada": 4, "precio_referencia": 4},
                ["interpretacion"]),
    "atipicos_mayores": (["posicion"], {"valor": 4}, []),
    "anexo": (["n"], {}, ["proceso", "modalidad", "contratista", "contratante", "objeto", "valor", "plazo", "enlace"]),
    "conclusiones": ([], {}, ["a", "b", "c", "d", "e", "f", "g", "h"]),
    "por_anio": (["anio"], {"contratos": 0, "valor_total": 2}, []),
    "por_mes": (["mes"], {"contratos": 0}, []),
    "mes_pico": (["mes"], {"contratos": 0}, ["nombre_mes"]),
    "periodo": ([], {}, ["fecha_min", "fecha_max"]),
}


def _long(df: DataFrame, name: str) -> DataFrame:
    """(seccion, clave, medida, valor, texto)."""
    keys, numbers, texts = SECTIONS[name]
    none = F.lit(None).cast("double"), F.lit(None).cast("string")
    cells = [F.struct(F.lit(c).alias("medida"), F.round(F.col(c).cast("double"), d).alias("valor"), none[1].alias("texto")) for c, d in numbers.items()]
    cells += [F.struct(F.lit(c).alias("medida"), none[0].alias("valor"), F.col(c).cast("string").alias("texto")) for c in texts]
    return df.select(F.lit(name).alias("seccion"), F.concat_ws("|", *[F.col(c).cast("string") for c in keys]).alias("clave"),
                     F.explode(F.array(*cells)).alias("_m")).select("seccion", "clave", "_m.medida", "_m.valor", "_m.texto")


def _long_sql(name: str, sql: str) -> str:
    keys, numbers, texts = SECTIONS[name]
    key = f"concat_ws('|', {', '.join(f'CAST({k} AS VARCHAR)' for k in keys)})" if keys else "''"
    cells = [f"{{'medida': '{c}', 'valor': round(CAST({c} AS DOUBLE), {d}), 'texto': CAST(NULL AS VARCHAR)}}" for c, d in numbers.items()]
    cells += [f"{{'medida': '{c}', 'valor': CAST(NULL AS DOUBLE), 'texto': CAST({c} AS VARCHAR)}}" for c in texts]
    return f"""SELECT '{name}' AS seccion, clave, m.medida AS medida, m.valor AS valor, m.texto AS texto
FROM (SELECT {key} AS clave, unnest([{', '.join(cells)}]) AS m FROM ({sql}))"""


_PRICES = Q._flag_sql("SELECT valor_del_contrato AS v FROM cv", [])
_MARKET = f"""{CV}, {_PRICES}, {Q._adj_sql([])}, o AS (SELECT CAST(count_if(out) AS BIGINT) AS n_atipicos FROM f)
SELECT st.*, q2 AS mediana, o.n_atipicos, a.*, {Q._READ_SQL} AS interpretacion,
  CASE WHEN media_ajustada IS NULL OR media_ajustada = 0 THEN media ELSE media_ajustada END AS precio_referencia FROM st, o, a"""
_OUTLIERS = f"""{CV}, {_PRICES}
SELECT posicion, valor FROM (SELECT row_number() OVER (ORDER BY v DESC) AS posicion, v AS valor FROM f WHERE out) WHERE posicion <= 5"""
_CONCLUSIONS = f"""SELECT 'a) Promedio de los contratos analizados: ' || {R._money_sql('media')} || '; sin atípicos, ' ||
  {R._money_sql('media_ajustada')} || '; mediana, ' || {R._money_sql('mediana')} || '.' AS a,
  'b) Valor de referencia: ' || {R._money_sql('precio_referencia')} || '.' AS b,
  'c) La mitad central de los valores va de ' || {R._money_sql('q1')} || ' a ' || {R._money_sql('q3')} || '.' AS c,
  'd) Proveedores distintos: ' || replace(format('{{:,.0f}}', CAST(n_proveedores AS DOUBLE)), ',', '.') || '.' AS d,
  'e) Modalidad de selección predominante: ' || categoria || ', empleada en ' || CAST(contratos AS VARCHAR) ||
    ' de los contratos analizados (' || replace(format('{{:.1f}}', pct_valor), '.', ',') || '% del valor).' AS e,
  'f) Definición del presupuesto oficial: [Por completar por la Entidad Estatal]' AS f,
  'g) Requisitos habilitantes y criterios diferenciales: [Por completar por la Entidad Estatal]' AS g,
  'h) Análisis de riesgos: [Por completar por la Entidad Estatal]' AS h
FROM ({_MARKET}), ({ORACLE['supplier_count']}), ({ORACLE['predominant_modality']})"""
_SQL = {
    "demanda_totales": ORACLE["demand_totals"], "demanda_distribuciones": ORACLE["demand_distributions"],
    "proveedores_n": ORACLE["supplier_count"], "proveedores": ORACLE["supplier_distribution"],
    "concentracion": ORACLE["concentration"], "mercado": _MARKET, "atipicos_mayores": _OUTLIERS,
    "anexo": ORACLE["annex_top50"], "conclusiones": _CONCLUSIONS, "por_anio": ORACLE["by_year"], "por_mes": ORACLE["by_month"],
    "mes_pico": ORACLE["peak_month"], "periodo": ORACLE["period"],
}


@register("study_all_sections", "\nUNION ALL\n".join(_long_sql(name, _SQL[name]) for name in SECTIONS))
def q_all_sections(spark, sf):
    """All thirteen sections, written as report tables and read back."""
    root = scratch_path(spark, f"report-{uuid.uuid4().hex}")
    sections = whole_study(contract_view(spark, sf))
    files.sink_report_tables(sections, root)
    parts = [_long(spark.read.schema(df.schema).parquet(f"{root}/{name}"), name) for name, df in sections.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("study_segment_peak_month", f"""{CV},
m AS (SELECT departamento, CAST(month(fecha_de_inicio_del_contrato) AS BIGINT) AS mes, count(*) AS contratos
      FROM cv WHERE fecha_de_inicio_del_contrato IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY departamento ORDER BY contratos DESC, mes) AS n FROM m)
SELECT departamento, mes, {Q._MONTHS_SQL}[mes] AS nombre_mes, contratos FROM r WHERE n = 1""")
def q_segment_peak(spark, sf):
    """The peak month of every segment, with its name and count."""
    return study.full_study_per_segment(contract_view(spark, sf), ["departamento"])["mes_pico"]


@register("study_segment_concentration", f"""{CV},
g AS (SELECT departamento, proveedor_adjudicado AS categoria, coalesce(sum(valor_del_contrato), 0.0) AS v FROM cv
      WHERE {Q._KNOWN} GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY departamento ORDER BY v DESC, categoria) AS n,
        sum(v) OVER (PARTITION BY departamento) AS t FROM g)
SELECT departamento, max(CASE WHEN n = 1 THEN categoria END) AS lider, round(max(CASE WHEN n = 1 THEN v / t * 100 END), 4) AS cuota_lider,
  round(sum(CASE WHEN n <= 5 THEN v / t * 100 END), 4) AS cuota_top5 FROM r GROUP BY departamento""")
def q_segment_concentration(spark, sf):
    """Supplier concentration of every segment."""
    out = study.full_study_per_segment(contract_view(spark, sf), ["departamento"])["concentracion"]
    return rounded(out, {"cuota_lider": 4, "cuota_top5": 4})
