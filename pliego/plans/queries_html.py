"""HTML extraction queries on pages Spark renders from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pliego.plans.contract_view import CONTRACT_VIEW_SQL, table
from pliego.plans.fixtures import detail_pages, generic_pages, result_pages
from pliego.plans.registry import register
from pliego.sources import html as H

CV = f"WITH cv AS ({CONTRACT_VIEW_SQL})"
_DETAIL = "https://www.contratos.gov.co/consultas/detalleProceso.do"
_MONEY = "'$' || translate(format('{:,.2f}', valor_del_contrato), ',.', '.,')"


@register("extract_result_rows", f"""{CV}
SELECT DISTINCT 'P-' || proceso_de_compra || '-' || CAST(_linea AS VARCHAR) AS numero_proceso,
  proceso_de_compra || '-' || CAST(_linea AS VARCHAR) AS id_proceso, nombre_entidad AS entidad,
  objeto_del_contrato AS objeto_contrato, modalidad_de_contratacion AS modalidad, estado_contrato AS estado,
  departamento, ciudad AS municipio, {_MONEY} AS cuantia, strftime(fecha_de_inicio_del_contrato, '%d-%m-%Y') AS fecha_apertura,
  'Fecha de Celebración del Primer Contrato' AS fecha_etiqueta,
  '{_DETAIL}?numConstancia=' || proceso_de_compra || '-' || CAST(_linea AS VARCHAR) AS url_detalle
FROM cv WHERE CAST(proceso_de_compra AS BIGINT) % 50 <> 0""")
def q_extract_rows(spark, sf):
    return H.combine_pages(result_pages(spark, sf)).drop("extra")


@register("result_totals", """
SELECT l_orderkey AS page_id, count(*) AS total_resultados FROM lineitem GROUP BY 1""")
def q_result_totals(spark, sf):
    return H.result_totals(result_pages(spark, sf))


@register("page_errors", """
SELECT 'no table' AS error, count(DISTINCT l_orderkey) AS paginas FROM lineitem WHERE l_orderkey % 50 = 0""")
def q_page_errors(spark, sf):
    return H.page_errors(H.table_rows(result_pages(spark, sf), with_text=False))


@register("extract_generic_rows", """
SELECT CAST(c_nationkey AS BIGINT) * 1000000 + CAST(floor(c_custkey / 50) AS BIGINT) AS page_id, c_name AS nombre_cliente,
  c_mktsegment AS segmento, format('{:.2f}', c_acctbal) AS saldo FROM customer""")
def q_generic_rows(spark, sf):
    g = H.extract_generic_rows(generic_pages(spark, sf))
    return g.select("page_id", F.col("fila")["nombre_cliente"].alias("nombre_cliente"),
                    F.col("fila")["segmento"].alias("segmento"), F.col("fila")["saldo"].alias("saldo"))


@register("extract_detail_records", f"""
SELECT o_orderkey AS page_id, 'SAMC ' || CAST(o_orderkey AS VARCHAR) AS numero_proceso,
  '26-' || CAST(o_orderkey AS VARCHAR) AS id_proceso, c_name AS entidad,
  'Suministro ' || CAST(o_orderkey AS VARCHAR) AS objeto_contrato, o_orderpriority AS modalidad,
  o_orderstatus AS estado, strftime(o_orderdate, '%d-%m-%Y') AS fecha_apertura, '' AS fecha_cierre,
  '' AS fecha_adjudicacion, '$' || translate(format('{{:,.2f}}', o_totalprice), ',.', '.,') AS valor_estimado,
  '' AS valor_adjudicado, '' AS valor_contrato, '' AS numero_contrato, '' AS tipo_contrato, '' AS estado_contrato,
  c_name AS proveedor, '' AS nit_proveedor, n_name AS departamento, 'Centro' AS municipio,
  '{_DETAIL}?numConstancia=26-' || CAST(o_orderkey AS VARCHAR) AS url_detalle
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey""")
def q_detail(spark, sf):
    return H.extract_detail_records(detail_pages(spark, sf))


@register("result_totals_landed_pages", """
SELECT page_id, CAST(NULL AS BIGINT) AS total_resultados FROM pages""")
def q_totals_landed(spark, sf):
    return H.result_totals(table(spark, sf, "pages"))


@register("page_errors_landed_pages", """
SELECT 'no table' AS error, count(*) AS paginas FROM pages WHERE NOT regexp_matches(html, '(?i)<table\\b')""")
def q_page_errors_landed(spark, sf):
    return H.page_errors(H.table_rows(table(spark, sf, "pages"), with_text=False))


@register("html_odd_tables", """
SELECT c_custkey AS page_id, 'Cliente' AS columna, c_name AS valor FROM customer
UNION ALL SELECT c_custkey, 'Cliente', c_mktsegment || ' ' || CAST(c_custkey AS VARCHAR) FROM customer
UNION ALL SELECT c_custkey, 'Cliente', 'fin' FROM customer""")
def q_html_odd(spark, sf):
    """S6 on tables with equal headers, row headers and a table inside a cell."""
    c = table(spark, sf, "customer")
    html = F.concat(
        F.lit("<table><thead><tr><th>Cliente</th><th>Cliente</th><th>Cliente</th></tr></thead><tbody><tr><th>fila</th><td>"),
        F.col("c_name"), F.lit("</td><td>"), F.col("c_mktsegment"), F.lit("<table><tr><td>"), F.col("c_custkey").cast("string"),
        F.lit("</td></tr></table></td><td>fin</td></tr></tbody></table>"))
    pages = c.select(F.col("c_custkey").alias("page_id"), F.lit("u").alias("url"), html.alias("html"))
    rows = H.extract_generic_rows(pages)
    return rows.select("page_id", F.explode("fila").alias("k", "valor")).select(
        "page_id", F.regexp_replace(F.initcap(F.regexp_replace("k", "#.*", "")), "_", " ").alias("columna"), "valor")
