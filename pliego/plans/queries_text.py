"""Cleaning and scalar-function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pliego.functions import dates as D
from pliego.functions import links as L
from pliego.functions import money as M
from pliego.functions import text as T
from pliego.operators import cleaning, quality
from pliego.plans.contract_view import CONTRACT_VIEW_SQL, contract_view, table
from pliego.plans.fixtures import RAW_RESULTS_SQL, raw_results
from pliego.plans.registry import register, rounded

# DuckDB (RE2) twins of the Java patterns: RE2 accepts the same \x{..} escapes.
WS = T.WS


def _sq(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _chars(s: str) -> str:
    return " || ".join(f"chr({ord(ch)})" for ch in s)


def _strip_sql(x: str) -> str:
    return f"regexp_replace({x}, {_sq('^' + WS + '+|' + WS + '+$')}, '', 'g')"


def _collapse_sql(x: str) -> str:
    return _strip_sql(f"regexp_replace({x}, {_sq(WS + '+')}, ' ', 'g')")


def _normalize_sql(x: str) -> str:
    s = f"translate(coalesce(CAST({x} AS VARCHAR), ''), {_chars(T.CP1252_FROM)}, {_chars(T.CP1252_TO)})"
    s = f"replace({s}, chr(133), '...')"
    s = f"regexp_replace({s}, {_sq(T.CONTROL_CHARS)}, '', 'g')"
    s = f"regexp_replace({s}, '[\\n\\r\\t]+', ' ', 'g')"
    s = f"regexp_replace({s}, {_sq(WS + '{2,}')}, ' ', 'g')"
    return _strip_sql(s)


def _fold_sql(x: str) -> str:
    return f"lower(translate({x}, '{T.ACCENTED}', '{T.UNACCENTED}'))"


@register("normalize_string_documents", f"""
SELECT doc_id, md5({_normalize_sql('text')}) AS texto_md5, length({_normalize_sql('text')}) AS longitud
FROM documents""")
def q_normalize_documents(spark, sf):
    d = cleaning.normalize_strings(table(spark, sf, "documents").select("doc_id", "text"))
    return d.select("doc_id", F.md5("text").alias("texto_md5"), F.length("text").cast("long").alias("longitud"))


@register("fold_documents", f"""
SELECT doc_id, md5({_fold_sql('text')}) AS plegado_md5, md5({_collapse_sql(_fold_sql('text'))}) AS plegado_compacto_md5,
  md5({_collapse_sql("regexp_replace(" + _strip_sql(_fold_sql('text')) + ", " + _sq('[^a-z0-9' + WS[1:-1] + ']') + ", ' ', 'g')")})
    AS etiqueta_md5
FROM documents""")
def q_fold_documents(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.md5(T.fold("text")).alias("plegado_md5"),
                    F.md5(T.fold_collapse("text")).alias("plegado_compacto_md5"),
                    F.md5(T.normalize_label("text")).alias("etiqueta_md5"))


@register("normalize_header_pages", f"""
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(lower({_strip_sql('url')}),
   '[^a-záéíóúñü0-9]+', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g') AS encabezado FROM pages""")
def q_normalize_header(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.normalize_header("url").alias("encabezado"))


_KEYWORDS = "é le"


@register("keyword_filter_documents", f"""
SELECT doc_id FROM documents WHERE {' AND '.join(f"contains({_fold_sql('coalesce(text, %s)' % _sq(''))}, {_sq(w)})"
                                                for w in _KEYWORDS.replace('é', 'e').split())}""")
def q_keyword_filter(spark, sf):
    from pliego.operators.filters import filter_keywords
    return filter_keywords(table(spark, sf, "documents"), _KEYWORDS, "text").select("doc_id")


@register("keyword_filter_api_documents", """
SELECT doc_id FROM documents WHERE contains(upper(text), upper('the')) AND contains(upper(text), upper('and'))""")
def q_keyword_filter_api(spark, sf):
    from pliego.operators.filters import api_keyword_predicate
    return table(spark, sf, "documents").where(api_keyword_predicate("the and", "text")).select("doc_id")


@register("keyword_filter_dashboard_contracts", f"""WITH cv AS ({CONTRACT_VIEW_SQL})
SELECT count(*) AS n FROM cv WHERE contains(lower(coalesce(objeto_del_contrato, '')), 'red')
  AND contains(lower(coalesce(objeto_del_contrato, '')), 'bolt')""")
def q_keyword_dashboard(spark, sf):
    from pliego.operators.filters import dashboard_keyword_predicate
    from pliego.operators.unify import type_columns
    t = type_columns(contract_view(spark, sf))
    return t.where(dashboard_keyword_predicate("Red BOLT")).agg(F.count(F.lit(1)).alias("n"))


# ---- cleaning round trip on rendered tables ---------------------------------

@register("clean_results", f"""WITH r AS ({RAW_RESULTS_SQL})
SELECT numero_proceso, CAST(k AS VARCHAR) AS id_proceso,
  c_name || ' - ' || o_orderstatus AS entidad,
  CASE WHEN k % 4 = 3 THEN NULL ELSE round(v, 2) END AS cuantia,
  CASE WHEN k % 3 = 0 THEN date_trunc('day', d) ELSE d END AS fecha_apertura,
  CASE WHEN k % 5 = 0 THEN NULL ELSE date_trunc('day', ship) END AS fecha_cierre
FROM r""")
def q_clean_results(spark, sf):
    c = cleaning.clean(raw_results(spark, sf))
    return rounded(c, {"cuantia": 2})


@register("conversion_failures", f"""WITH r AS ({RAW_RESULTS_SQL})
SELECT 'cuantia' AS columna, CAST(count_if(k % 4 = 3) AS BIGINT) AS fallidos FROM r
UNION ALL SELECT 'fecha_apertura', CAST(0 AS BIGINT) FROM r LIMIT 2""")
def q_conversion_failures(spark, sf):
    raw = cleaning.normalize_strings(raw_results(spark, sf))
    return cleaning.conversion_failures(raw).where(F.col("columna").isin("cuantia", "fecha_apertura"))


@register("parse_money_lineitem", """
SELECT l_orderkey, l_linenumber, round(l_extendedprice, 2) AS colombiano, round(l_extendedprice, 2) AS anglo,
       round(-l_extendedprice, 2) AS negativo FROM lineitem""")
def q_parse_money(spark, sf):
    from pliego.plans.fixtures import anglo_money, colombian_money
    li = table(spark, sf, "lineitem")
    v = F.col("l_extendedprice")
    return rounded(li.select("l_orderkey", "l_linenumber",
                             M.parse_money(colombian_money(v)).alias("colombiano"),
                             M.parse_money(anglo_money(v)).alias("anglo"),
                             M.parse_money(F.concat(F.lit("Valor: -"), F.format_number(v, 2))).alias("negativo")),
                   {"colombiano": 2, "anglo": 2, "negativo": 2})


@register("parse_date_orders", """
SELECT o_orderkey, o_orderdate AS dia_primero, o_orderdate AS iso, o_orderdate AS iso_t,
       CAST(NULL AS TIMESTAMP) AS invalida FROM orders""")
def q_parse_date(spark, sf):
    o = table(spark, sf, "orders")
    d = F.col("o_orderdate")
    return o.select("o_orderkey",
                    D.parse_date(F.date_format(d, "d/M/yyyy")).alias("dia_primero"),
                    D.parse_date(F.date_format(d, "yyyy-MM-dd")).alias("iso"),
                    D.parse_date(F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss.SSS")).alias("iso_t"),
                    D.parse_date(F.concat(F.lit("31/02/"), F.year(d).cast("string"))).alias("invalida"))


@register("split_location_customers", f"""
SELECT c_custkey,
  CASE WHEN c_custkey % 7 = 0 THEN n.n_name ELSE n.n_name END AS departamento,
  CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_name END AS municipio
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey""")
def q_split_location(spark, sf):
    c = table(spark, sf, "customer")
    n = F.broadcast(table(spark, sf, "nation"))
    j = c.join(n, c.c_nationkey == n.n_nationkey)
    txt = F.when(F.col("c_custkey") % 7 == 0, F.concat(F.lit(" "), F.col("n_name"), F.lit(" "))) \
        .otherwise(F.concat(F.col("n_name"), F.lit(" : "), F.col("c_name")))
    dept, town = T.split_location(txt)
    return j.select("c_custkey", dept.alias("departamento"), town.alias("municipio"))


@register("split_dated_label_orders", """
SELECT o_orderkey, 'Fecha de Celebración del Primer Contrato' AS etiqueta, strftime(o_orderdate, '%d-%m-%Y') AS fecha,
       strftime(o_orderdate, '%d-%m-%Y') AS solo_fecha FROM orders""")
def q_split_dated_label(spark, sf):
    o = table(spark, sf, "orders")
    d = F.date_format("o_orderdate", "dd-MM-yyyy")
    label, date = T.split_dated_label(F.concat(F.lit("Fecha de Celebración del Primer Contrato "), d))
    only = T.only_date(F.concat(d, F.lit(" 11:30 a.m.")))
    return o.select("o_orderkey", label.alias("etiqueta"), date.alias("fecha"), only.alias("solo_fecha"))


@register("process_links_orders", f"""
SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) || '-' || o_orderpriority AS id_proceso,
  '{T.DETAIL_URL_BASE}?numConstancia=' || CAST(o_orderkey AS VARCHAR) || '-' || o_orderpriority AS url_detalle,
  CAST(o_orderkey AS VARCHAR) || '-' || o_orderpriority AS id_desde_url
FROM orders""")
def q_process_links(spark, sf):
    o = table(spark, sf, "orders")
    pid = T.process_id(F.concat(F.lit("javascript: consultaProceso('"), F.col("o_orderkey").cast("string"),
                                F.lit("-"), F.col("o_orderpriority"), F.lit("')")))
    url = T.detail_url(pid)
    return o.select("o_orderkey", pid.alias("id_proceso"), url.alias("url_detalle"),
                    T.id_from_url(F.replace(url, F.lit(" "), F.lit("%20"))).alias("_raw")) \
        .withColumn("id_desde_url", F.replace(F.col("_raw"), F.lit("%20"), F.lit(" "))).drop("_raw")


@register("header_number_entity", """
SELECT o_orderkey, 'SAMC ' || CAST(o_orderkey AS VARCHAR) AS numero_proceso, c_name AS entidad
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey""")
def q_header(spark, sf):
    o = table(spark, sf, "orders")
    c = table(spark, sf, "customer")
    j = o.join(c, o.o_custkey == c.c_custkey)
    page = F.concat(F.lit("Portal\n\nDetalle del Proceso Número: SAMC "), F.col("o_orderkey").cast("string"),
                    F.lit("\n\n  "), F.col("c_name"), F.lit("\nInformación general"))
    return j.select("o_orderkey", T.header_number(page).alias("numero_proceso"),
                    T.header_entity(page).alias("entidad"))


@register("term_text_contracts", f"""WITH cv AS ({CONTRACT_VIEW_SQL}),
t AS (SELECT proceso_de_compra, _linea,
        CAST(floor((epoch(fecha_de_fin_del_contrato) - epoch(fecha_de_inicio_del_contrato)) / 86400) AS BIGINT) AS d
      FROM cv)
SELECT proceso_de_compra, _linea AS linea,
  CASE WHEN d IS NULL OR d < 0 THEN 'N/D'
       WHEN d >= 30 THEN CAST(CAST(round_even(d / 30.0, 0) AS BIGINT) AS VARCHAR) ||
            CASE WHEN CAST(round_even(d / 30.0, 0) AS BIGINT) = 1 THEN ' MES' ELSE ' MESES' END ||
            ' (' || CAST(d AS VARCHAR) || ' días)'
       ELSE CAST(d AS VARCHAR) || ' DÍAS' END AS plazo
FROM t""")
def q_term_text(spark, sf):
    cv = contract_view(spark, sf, with_line_keys=True)
    return cv.select("proceso_de_compra", F.col("_linea").alias("linea"),
                     D.term_text("fecha_de_inicio_del_contrato", "fecha_de_fin_del_contrato").alias("plazo"))


@register("money_percent_text", """
SELECT l_orderkey, l_linenumber, '$' || replace(format('{:,.0f}', l_extendedprice), ',', '.') AS valor_texto,
  replace(replace(replace(format('{:,.1f}', l_discount * 100.0), ',', '#'), '.', ','), '#', '.') || '%' AS descuento_texto
FROM lineitem""")
def q_money_text(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", M.money_text("l_extendedprice").alias("valor_texto"),
                     M.percent_text(F.col("l_discount") * 100.0).alias("descuento_texto"))


@register("process_link_contracts", f"""WITH cv AS ({CONTRACT_VIEW_SQL})
SELECT proceso_de_compra, _linea AS linea,
  CASE WHEN CAST(proceso_de_compra AS BIGINT) % 3 = 2 THEN 'N/D' ELSE urlproceso END AS enlace
FROM cv""")
def q_process_link(spark, sf):
    cv = contract_view(spark, sf, with_line_keys=True)
    k = F.col("proceso_de_compra").cast("long") % 3
    raw = (F.when(k == 0, F.concat(F.lit("{'url': '"), F.col("urlproceso"), F.lit("'}")))
           .when(k == 1, F.concat(F.lit(" "), F.col("urlproceso")))
           .otherwise(F.lit("nan")))
    return cv.select("proceso_de_compra", F.col("_linea").alias("linea"), L.process_link(raw).alias("enlace"))


@register("display_columns_contracts", f"""WITH cv AS ({CONTRACT_VIEW_SQL})
SELECT proceso_de_compra, _linea AS linea, upper(coalesce(proveedor_adjudicado, 'N/D')) AS contratista,
  CASE WHEN upper(coalesce(ciudad, '')) <> '' THEN upper(coalesce(nombre_entidad, 'N/D')) || ', ' || upper(ciudad)
       ELSE upper(coalesce(nombre_entidad, 'N/D')) END AS contratante
FROM cv""")
def q_display(spark, sf):
    cv = contract_view(spark, sf, with_line_keys=True)
    return cv.select("proceso_de_compra", F.col("_linea").alias("linea"),
                     L.upper_or_nd("proveedor_adjudicado").alias("contratista"),
                     L.entity_city("nombre_entidad", "ciudad").alias("contratante"))


def _quality_sql(tbl: str, cols: list[tuple[str, str, bool]]) -> str:
    parts = []
    for name, dtype, is_text in cols:
        blanks = f"CAST(count_if(trim({name}) = '') AS BIGINT)" if is_text else "CAST(NULL AS BIGINT)"
        parts.append(f"""SELECT '{name}' AS columna, '{dtype}' AS dtype, CAST(count_if({name} IS NULL) AS BIGINT) AS nulos,
  round(count_if({name} IS NULL) * 100.0 / count(*), 2)::DOUBLE AS pct_nulos,
  CAST(count(DISTINCT {name}) AS BIGINT) AS unicos, {blanks} AS vacios FROM {tbl}""")
    return "\nUNION ALL\n".join(parts)


@register("quality_report_customer", _quality_sql("customer", [
    ("c_custkey", "bigint", False), ("c_name", "string", True), ("c_nationkey", "int", False),
    ("c_acctbal", "double", False), ("c_mktsegment", "string", True)]))
def q_quality(spark, sf):
    return quality.quality_report(table(spark, sf, "customer"))


@register("completeness_events", """
SELECT count(*) AS total_filas, CAST(6 AS BIGINT) AS total_columnas,
  round((1 - (count_if(event_id IS NULL) + count_if(ts IS NULL) + count_if(user_id IS NULL) + count_if(event_type IS NULL)
   + count_if(value IS NULL) + count_if(props IS NULL)) / (count(*) * 6.0)) * 100.0, 2)::DOUBLE AS pct_completitud
FROM events""")
def q_completeness(spark, sf):
    return quality.completeness(table(spark, sf, "events"))
