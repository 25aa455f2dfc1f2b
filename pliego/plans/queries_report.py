"""Annex, conclusions and file round-trip queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pliego.operators.report import annex, conclusions
from pliego.plans.contract_view import CONTRACT_VIEW_SQL, contract_view, table
from pliego.plans.registry import register
from pliego.session import scratch_path
from pliego.sources import files

CV = f"WITH cv AS ({CONTRACT_VIEW_SQL})"


def _money_sql(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN 'N/D' ELSE '$' || replace(format('{{:,.0f}}', {x}), ',', '.') END"


_TERM = """CASE WHEN d IS NULL OR d < 0 THEN 'N/D'
  WHEN d >= 30 THEN CAST(CAST(round_even(d / 30.0, 0) AS BIGINT) AS VARCHAR) ||
    CASE WHEN CAST(round_even(d / 30.0, 0) AS BIGINT) = 1 THEN ' MES' ELSE ' MESES' END || ' (' || CAST(d AS VARCHAR) || ' días)'
  ELSE CAST(d AS VARCHAR) || ' DÍAS' END"""


@register("annex_top50", f"""{CV},
b AS (SELECT valor_del_contrato AS v, coalesce(proceso_de_compra, 'N/D') AS proceso,
  upper(coalesce(modalidad_de_contratacion, 'N/D')) AS modalidad, upper(coalesce(proveedor_adjudicado, 'N/D')) AS contratista,
  CASE WHEN upper(coalesce(ciudad, '')) <> '' THEN upper(coalesce(nombre_entidad, 'N/D')) || ', ' || upper(ciudad)
       ELSE upper(coalesce(nombre_entidad, 'N/D')) END AS contratante,
  upper(coalesce(objeto_del_contrato, 'N/D')) AS objeto,
  CAST(floor((epoch(fecha_de_fin_del_contrato) - epoch(fecha_de_inicio_del_contrato)) / 86400) AS BIGINT) AS d,
  urlproceso AS enlace, proceso_de_compra AS p0, modalidad_de_contratacion AS p1, proveedor_adjudicado AS p2,
  nombre_entidad AS p3, ciudad AS p4, objeto_del_contrato AS p5, fecha_de_inicio_del_contrato AS p6,
  fecha_de_fin_del_contrato AS p7, urlproceso AS p8 FROM cv),
t AS (SELECT *, {_TERM} AS plazo FROM b),
r AS (SELECT *, row_number() OVER (ORDER BY v DESC NULLS LAST, p0 NULLS FIRST, p1 NULLS FIRST, p2 NULLS FIRST,
  p3 NULLS FIRST, p4 NULLS FIRST, p5 NULLS FIRST, p6 NULLS FIRST, p7 NULLS FIRST, p8 NULLS FIRST) AS n FROM t)
SELECT CAST(n AS BIGINT) AS n, proceso, modalidad, contratista, contratante, objeto, {_money_sql('v')} AS valor, plazo, enlace
FROM r WHERE n <= 50""")
def q_annex(spark, sf):
    return annex(contract_view(spark, sf))


@register("conclusions_events", """
WITH b AS (SELECT value AS v FROM events WHERE value > 0),
s AS (SELECT avg(v) AS media, quantile_cont(v, 0.5) AS mediana, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM b),
f AS (SELECT b.v, b.v < s.q1 - 1.5 * (s.q3 - s.q1) OR b.v > s.q3 + 1.5 * (s.q3 - s.q1) AS out FROM b, s),
a AS (SELECT avg(v) AS media_ajustada FROM f WHERE NOT out)
SELECT 'a) Promedio de los contratos analizados: ' || """ + _money_sql("media") + """ ||
  '; sin atípicos, ' || """ + _money_sql("media_ajustada") + """ ||
  '; mediana, ' || """ + _money_sql("mediana") + """ || '.' AS a,
  'b) Valor de referencia: ' || """ + _money_sql(
    "CASE WHEN media_ajustada IS NULL OR media_ajustada = 0 THEN media ELSE media_ajustada END") + """ || '.' AS b,
  'c) La mitad central de los valores va de ' || """ + _money_sql("q1") + """ || ' a ' || """ + _money_sql("q3") + """ || '.' AS c,
  'd) Proveedores distintos: 0.' AS d, CAST(NULL AS VARCHAR) AS e,
  'f) Definición del presupuesto oficial: [Por completar por la Entidad Estatal]' AS f,
  'g) Requisitos habilitantes y criterios diferenciales: [Por completar por la Entidad Estatal]' AS g,
  'h) Análisis de riesgos: [Por completar por la Entidad Estatal]' AS h
FROM s, a""")
def q_conclusions(spark, sf):
    ev = table(spark, sf, "events").select(F.col("value").alias("valor_del_contrato"))
    return conclusions(ev)


@register("csv_roundtrip_customer", """
SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey,
  c_mktsegment FROM customer""")
def q_csv_roundtrip(spark, sf):
    path = scratch_path(spark, f"csv-{uuid.uuid4().hex}")
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    files.sink_csv(c, path)
    return files.scan_csv_text(spark, path)


@register("api_dump_roundtrip", f"""{CV}
SELECT nombre_entidad, departamento, ciudad, modalidad_de_contratacion, estado_contrato, objeto_del_contrato,
  proveedor_adjudicado, proceso_de_compra, CAST(NULL AS VARCHAR) AS nit_entidad, count(*) AS n
FROM cv WHERE fuente = 'A' GROUP BY ALL""")
def q_api_dump(spark, sf):
    path = scratch_path(spark, f"api-{uuid.uuid4().hex}")
    cv = contract_view(spark, sf).where(F.col("fuente") == "A")
    cv.select("nombre_entidad", "departamento", "ciudad", "modalidad_de_contratacion", "estado_contrato",
              "objeto_del_contrato", "proveedor_adjudicado", "proceso_de_compra").write.json(path)
    d = files.scan_api_dump(spark, path)
    return d.groupBy("nombre_entidad", "departamento", "ciudad", "modalidad_de_contratacion", "estado_contrato",
                     "objeto_del_contrato", "proveedor_adjudicado", "proceso_de_compra", "nit_entidad") \
        .agg(F.count(F.lit(1)).alias("n"))


@register("base_versions_events", """
SELECT event_id, CASE WHEN event_type = 'purchase' THEN value + 1 ELSE value END AS value FROM events""")
def q_base_versions(spark, sf):
    from pliego.streaming.incremental import upsert_base
    path = scratch_path(spark, f"base-{uuid.uuid4().hex}")
    ev = table(spark, sf, "events").select("event_id", "event_type", "value")
    upsert_base(spark, ev, path, ["event_id"], ["value"])
    upd = ev.where(F.col("event_type") == "purchase").withColumn("value", F.col("value") + 1)
    out = upsert_base(spark, upd, path, ["event_id"], ["value"])
    return out.select("event_id", "value")


@register("query_combined_sources", f"""{CV},
s2 AS (SELECT count(*) AS n FROM cv WHERE fuente = 'A' AND departamento = 'ASIA' AND contains(upper(objeto_del_contrato), 'RED')),
s1 AS (SELECT count(*) AS n FROM (SELECT DISTINCT proceso_de_compra, _linea, modalidad_de_contratacion,
         estado_contrato, nombre_entidad, objeto_del_contrato, departamento, ciudad, round(valor_del_contrato, 2),
         fecha_de_inicio_del_contrato FROM cv
         WHERE CAST(proceso_de_compra AS BIGINT) % 50 <> 0 AND departamento = 'ASIA' AND contains(lower(objeto_del_contrato), 'red')))
SELECT 'SECOP II' AS fuente, n AS filas, n AS coincidencias, FALSE AS truncado FROM s2
UNION ALL SELECT 'SECOP I', n, CAST(NULL AS BIGINT), CAST(NULL AS BOOLEAN) FROM s1""")
def q_query_combined(spark, sf):
    from pliego.plans.fixtures import result_pages
    from pliego.plans.jobs import ContractQuery, query_combined, query_source1, query_source2
    from pliego.sources.html import extract_result_rows, landed_rows
    path = scratch_path(spark, f"api-{uuid.uuid4().hex}")
    cv = contract_view(spark, sf).where(F.col("fuente") == "A").drop("fuente")
    cv.select(*[F.col(c).cast("string") for c in cv.columns]).write.json(path, compression="lz4")
    q = ContractQuery(keyword="red", department="ASIA")
    s2, rep = query_source2(files.scan_api_dump(spark, path), q)
    pages = result_pages(spark, sf)
    s1 = query_source1(extract_result_rows(pages, landed_rows(pages)), q)
    _, counts = query_combined({"SECOP II": s2, "SECOP I": s1}, [rep])
    return counts.select("fuente", "filas", "coincidencias", "truncado")


@register("query_combined_report", f"""{CV},
s2 AS (SELECT count(*) AS n FROM cv WHERE fuente = 'A')
SELECT 'SECOP I' AS fuente, CAST(0 AS BIGINT) AS filas, CAST(NULL AS BIGINT) AS coincidencias, CAST(NULL AS BOOLEAN) AS truncado,
  CAST(NULL AS VARCHAR) AS error, 'tipo de contrato: sin ese dato en la fuente, no se filtra' AS aviso
UNION ALL SELECT 'SECOP II', least(n, 100), n, n > 100, NULL,
  CASE WHEN n > 100 THEN '100 de ' || n || ' coincidencias, por orden de proceso_de_compra,objeto_del_contrato' END FROM s2
UNION ALL SELECT 'otra', 0, NULL, NULL, 'sin respuesta', NULL""")
def q_combined_report(spark, sf):
    """M4: a capped source, a source without matches (unknown state) and a failed one, each with its row."""
    from pliego.plans.fixtures import result_pages
    from pliego.plans.jobs import ContractQuery, query_combined, query_source1, query_source2
    from pliego.sources.html import extract_result_rows, landed_rows
    path = scratch_path(spark, f"api-{uuid.uuid4().hex}")
    cv = contract_view(spark, sf).where(F.col("fuente") == "A").drop("fuente")
    cv.select(*[F.col(c).cast("string") for c in cv.columns]).write.json(path, compression="lz4")
    s2, rep = query_source2(files.scan_api_dump(spark, path), ContractQuery(), 100, ["proceso_de_compra", "objeto_del_contrato"])
    pages = result_pages(spark, sf)
    s1 = query_source1(extract_result_rows(pages, landed_rows(pages)), ContractQuery(state="NoExiste"))
    _, report = query_combined({"SECOP II": s2, "SECOP I": s1, "otra": RuntimeError("sin respuesta")}, [rep],
                               ContractQuery(contract_type="Obra"))
    return report.select("fuente", "filas", "coincidencias", "truncado", "error", F.get("avisos", F.lit(0)).alias("aviso"))
