"""Quality, drift and freshness queries."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import functions as F

from pliego.operators import quality
from pliego.plans.contract_view import CONTRACT_VIEW_SQL, contract_view, table
from pliego.plans.registry import register

CV = f"WITH cv AS ({CONTRACT_VIEW_SQL})"
AS_OF = _dt.date(2024, 2, 15)


@register("freshness_events", """
WITH m AS (SELECT max(ts) AS mas_reciente FROM events),
d AS (SELECT mas_reciente, CAST(floor((epoch(TIMESTAMP '2024-02-15') - epoch(mas_reciente)) / 86400) AS BIGINT) AS dias FROM m)
SELECT mas_reciente, dias, CASE WHEN dias > 30 THEN 'aviso' ELSE 'ok' END AS estado,
  CASE WHEN dias <= 7 THEN 'reciente' WHEN dias <= 30 THEN 'normal' ELSE 'antiguo' END AS insignia FROM d""")
def q_freshness(spark, sf):
    return quality.freshness(table(spark, sf, "events"), "ts", AS_OF)


@register("filter_applied_check", f"""{CV}
SELECT count(*) AS filas, CAST(count_if(modalidad_de_contratacion NOT IN ('1-URGENT', '2-HIGH')) AS BIGINT) AS fuera,
  CAST(count(DISTINCT modalidad_de_contratacion) AS BIGINT) AS distintos,
  count_if(modalidad_de_contratacion NOT IN ('1-URGENT', '2-HIGH')) = 0 AS aplicado
FROM cv WHERE modalidad_de_contratacion = '1-URGENT'""")
def q_filter_applied(spark, sf):
    d = contract_view(spark, sf).where(F.col("modalidad_de_contratacion") == "1-URGENT")
    return quality.filter_applied_check(d, "modalidad_de_contratacion", ["1-URGENT", "2-HIGH"])


@register("count_monotonic_check", f"""{CV}
SELECT count(*) AS sin_filtro, CAST(count_if(departamento = 'EUROPE') AS BIGINT) AS con_filtro,
  count_if(departamento = 'EUROPE') < count(*) AS ok FROM cv""")
def q_monotonic(spark, sf):
    return quality.count_monotonic_check(contract_view(spark, sf), F.col("departamento") == "EUROPE")


@register("health_check", f"""{CV},
f AS (SELECT CAST(floor((epoch(TIMESTAMP '2024-02-15') - epoch(max(ts))) / 86400) AS BIGINT) AS dias FROM events),
m AS (SELECT count(*) AS a, count_if(departamento = 'EUROPE') AS b FROM cv),
x AS (SELECT count_if(estado_contrato NOT IN ('F', 'O', 'P')) AS fuera FROM cv)
SELECT 'frescura' AS comprobacion, CASE WHEN dias > 30 THEN 'aviso' ELSE 'ok' END AS nivel,
  CAST(dias AS VARCHAR) AS mensaje FROM f
UNION ALL SELECT 'conteo_monotono', CASE WHEN NOT (b < a) THEN 'fallo' ELSE 'ok' END, CAST(b AS VARCHAR) FROM m
UNION ALL SELECT 'filtro_estado', CASE WHEN fuera > 0 THEN 'fallo' ELSE 'ok' END, CAST(fuera AS VARCHAR) FROM x""")
def q_health(spark, sf):
    cv = contract_view(spark, sf)
    fr = quality.freshness(table(spark, sf, "events"), "ts", AS_OF)
    mono = quality.count_monotonic_check(cv, F.col("departamento") == "EUROPE")
    app = quality.filter_applied_check(cv, "estado_contrato", ["F", "O", "P"])
    return quality.health_check([
        quality.check_row(fr, "frescura", F.col("dias") > 30, F.col("dias"), "aviso"),
        quality.check_row(mono, "conteo_monotono", ~F.col("ok"), F.col("con_filtro")),
        quality.check_row(app, "filtro_estado", ~F.col("aplicado"), F.col("fuera")),
    ])


def _health_sql() -> str:
    from pliego import catalogs as K
    from pliego.plans.queries_search import _values_sql
    cats = {"departamento": K.DEPARTMENTS, "modalidad_de_contratacion": K.MODALITIES,
            "tipo_de_contrato": K.CONTRACT_TYPES, "estado_contrato": K.STATES}
    parts = ["""SELECT 'frescura' AS comprobacion, CASE WHEN dias > 30 THEN 'aviso' ELSE 'ok' END AS nivel,
  CAST(dias AS VARCHAR) AS mensaje FROM (SELECT CAST(floor((epoch(TIMESTAMP '2024-02-15') -
  epoch(max(fecha_de_inicio_del_contrato))) / 86400) AS BIGINT) AS dias FROM cv)"""]
    for col, opts in cats.items():
        cat = f"(SELECT DISTINCT unnest(valores_api) AS valor FROM {_values_sql(opts)})"
        parts.append(f"""SELECT 'catalogo_huerfanos:{col}', CASE WHEN n > 0 THEN 'fallo' ELSE 'ok' END, CAST(n AS VARCHAR)
  FROM (SELECT count(*) AS n FROM {cat} c WHERE c.valor NOT IN (SELECT {col} FROM cv WHERE {col} IS NOT NULL))""")
        parts.append(f"""SELECT 'catalogo_desconocidos:{col}', CASE WHEN n > 0 THEN 'aviso' ELSE 'ok' END, CAST(n AS VARCHAR)
  FROM (SELECT count(DISTINCT {col}) AS n FROM cv WHERE {col} IS NOT NULL AND {col} NOT IN (SELECT valor FROM {cat}))""")
    parts.append("""SELECT 'regresion:Bogotá D.C.', CASE WHEN n = 0 THEN 'fallo' ELSE 'ok' END, CAST(n AS VARCHAR)
  FROM (SELECT count_if(departamento = 'Distrito Capital de Bogotá') AS n FROM cv)""")
    parts.append("""SELECT 'filtro_aplicado:estado_contrato', CASE WHEN n > 0 THEN 'fallo' ELSE 'ok' END, CAST(n AS VARCHAR)
  FROM (SELECT count_if(estado_contrato NOT IN ('F', 'O')) AS n FROM cv)""")
    parts.append("""SELECT 'conteo_monotono:departamento', CASE WHEN n = 0 THEN 'fallo' ELSE 'ok' END, CAST(n AS VARCHAR)
  FROM (SELECT count_if(departamento IS NULL OR departamento <> 'EUROPE') AS n FROM cv)""")
    parts.append("SELECT 'columnas_requeridas', 'fallo', 'cuantia'")
    return CV + "\n" + "\nUNION ALL\n".join(parts)


@register("health_check_catalogs", _health_sql())
def q_health_catalogs(spark, sf):
    from pliego import catalogs as K
    cats = {"departamento": K.DEPARTMENTS, "modalidad_de_contratacion": K.MODALITIES,
            "tipo_de_contrato": K.CONTRACT_TYPES, "estado_contrato": K.STATES}
    return quality.standard_health_check(contract_view(spark, sf), cats, AS_OF, "fecha_de_inicio_del_contrato",
                                         alias=("departamento", "Bogotá D.C."),
                                         required=["objeto_del_contrato", "cuantia"],
                                         applied={"estado_contrato": ["F", "O"]}, smaller={"departamento": ["EUROPE"]})
