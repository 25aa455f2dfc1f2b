"""Search, lookup and unification queries (F*, J*, P*, U*, L5-L6, A22-A27, M2-M5)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import functions as F

from pliego import catalogs as K
from pliego.operators import filters as FL
from pliego.operators import lookup, paging, quality, unify
from pliego.operators.cleaning import clean, drop_empty_rows, rename_columns
from pliego.plans.contract_view import CONTRACT_VIEW_SQL, contract_view, table
from pliego.plans.fixtures import raw_results
from pliego.plans.queries_text import _collapse_sql, _fold_sql, _sq, _strip_sql
from pliego.plans.registry import register, rounded

CV = f"WITH cv AS ({CONTRACT_VIEW_SQL})"

# ---- filters -------------------------------------------------------------------


@register("filter_equals_department", f"""{CV}
SELECT departamento, count(*) AS n FROM cv WHERE departamento IN ('AMERICA', 'ASIA') GROUP BY 1""")
def q_filter_equals(spark, sf):
    p = FL.equals_predicate("departamento", ["AMERICA", " ASIA ", K.ALL_LABEL], K.DEPARTMENTS)
    return contract_view(spark, sf).where(p).groupBy("departamento").agg(F.count(F.lit(1)).alias("n"))


_STATE_MAP = {"F": "terminado", "O": "En ejecución", "P": "Suspendido"}
_STATE_SQL = "CASE o_orderstatus " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _STATE_MAP.items()) + " END"


def _orders_with_state(spark, sf):
    o = table(spark, sf, "orders")
    m = F.create_map(*[F.lit(x) for kv in _STATE_MAP.items() for x in kv])
    return o.withColumn("estado_contrato", m[F.col("o_orderstatus")])


@register("filter_state_group", f"""
SELECT estado_contrato, count(*) AS n FROM (SELECT {_STATE_SQL} AS estado_contrato FROM orders)
WHERE estado_contrato IN ('Cerrado', 'terminado', 'En ejecución', 'Modificado', 'Prorrogado', 'cedido')
GROUP BY 1""")
def q_filter_state(spark, sf):
    o = _orders_with_state(spark, sf)
    return o.where(FL.state_predicate("estado_contrato", "Celebrado")) \
        .groupBy("estado_contrato").agg(F.count(F.lit(1)).alias("n"))


@register("filter_date_range", f"""{CV}
SELECT CAST(year(fecha_de_inicio_del_contrato) AS BIGINT) AS anio, count(*) AS n FROM cv
WHERE fecha_de_inicio_del_contrato >= TIMESTAMP '1998-01-01 00:00:00'
  AND fecha_de_inicio_del_contrato <= TIMESTAMP '1998-12-31 23:59:59' GROUP BY 1""")
def q_filter_date_range(spark, sf):
    p = FL.date_range_predicate("fecha_de_inicio_del_contrato", "01/01/1998", "31-12-1998")
    return contract_view(spark, sf).where(p).groupBy(F.year("fecha_de_inicio_del_contrato").cast("long").alias("anio")) \
        .agg(F.count(F.lit(1)).alias("n"))


@register("filter_in_sets", f"""{CV}
SELECT count(*) AS n, round(sum(valor_del_contrato), 2) AS valor_total FROM cv
WHERE modalidad_de_contratacion IN ('1-URGENT', '2-HIGH') AND departamento IN ('EUROPE', 'ASIA')
  AND estado_contrato IN ('F', 'O')""")
def q_filter_in_sets(spark, sf):
    p = FL.in_sets_predicate({"modalidad_de_contratacion": ["1-URGENT", "2-HIGH"], "ciudad": [],
                              "departamento": ["EUROPE", "ASIA"], "estado_contrato": ["F", "O"],
                              "tipo_de_contrato": []})
    d = contract_view(spark, sf).where(p)
    return rounded(d.agg(F.count(F.lit(1)).alias("n"), F.sum("valor_del_contrato").alias("valor_total")),
                   {"valor_total": 2})


@register("filter_value_range", f"""{CV}
SELECT count(*) AS n FROM (SELECT CASE WHEN _linea = 1 THEN NULL ELSE valor_del_contrato * 1000 END AS v FROM cv)
WHERE v >= 10000000 AND v <= 50000000""")
def q_filter_value_range(spark, sf):
    d = contract_view(spark, sf, with_line_keys=True).select(
        F.when(F.col("_linea") == 1, F.lit(None)).otherwise(F.col("valor_del_contrato") * 1000).alias("v"))
    return d.where(FL.value_range_predicate("v", 10, 50)).agg(F.count(F.lit(1)).alias("n"))


@register("filter_period_null_tolerant", f"""{CV},
d AS (SELECT CASE WHEN _linea = 2 THEN NULL ELSE fecha_de_inicio_del_contrato END AS fi,
             CASE WHEN _linea = 3 THEN NULL ELSE fecha_de_fin_del_contrato END AS ff FROM cv)
SELECT count(*) AS n FROM d WHERE (fi IS NULL OR fi >= TIMESTAMP '1997-01-01')
  AND (ff IS NULL OR ff <= TIMESTAMP '1999-06-30')""")
def q_filter_period(spark, sf):
    cv = contract_view(spark, sf, with_line_keys=True)
    d = cv.select(F.when(F.col("_linea") == 2, F.lit(None)).otherwise(F.col("fecha_de_inicio_del_contrato")).alias("fi"),
                  F.when(F.col("_linea") == 3, F.lit(None)).otherwise(F.col("fecha_de_fin_del_contrato")).alias("ff"))
    p = FL.period_predicate("fi", "ff", _dt.date(1997, 1, 1), _dt.date(1999, 6, 30))
    return d.where(p).agg(F.count(F.lit(1)).alias("n"))


@register("filter_positive_customers", """
SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY 1""")
def q_filter_positive(spark, sf):
    return table(spark, sf, "customer").where(FL.positive_predicate("c_acctbal")) \
        .groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


def _blank_docs(spark, sf):
    d = table(spark, sf, "documents")
    blank = F.col("doc_id") % 10 == 0
    return d.select(F.when(blank, F.lit(None)).otherwise(F.col("doc_id")).alias("doc_id"),
                    F.when(blank, F.lit("  ")).otherwise(F.col("lang")).alias("lang"),
                    F.when(blank, F.lit("")).otherwise(F.col("source")).alias("source"),
                    F.when(F.col("doc_id") % 20 == 0, F.lit(None)).otherwise(F.col("n_chars")).alias("n_chars"))


@register("drop_empty_rows_documents", """
SELECT doc_id, n_chars FROM documents WHERE doc_id % 10 <> 0""")
def q_drop_empty(spark, sf):
    return drop_empty_rows(_blank_docs(spark, sf)).select("doc_id", "n_chars")


@register("has_content_documents", """
SELECT CAST(count_if(doc_id % 10 <> 0) AS BIGINT) AS con_contenido, CAST(count_if(doc_id % 10 = 0) AS BIGINT) AS sin_contenido FROM documents""")
def q_has_content(spark, sf):
    d = _blank_docs(spark, sf)
    return d.agg(F.count_if(FL.content_predicate("lang")).alias("con_contenido"),
                 F.count_if(~FL.content_predicate("lang")).alias("sin_contenido"))


def _band_sql() -> str:
    cases = " ".join(
        f"WHEN v >= {lo} AND v <= {hi} THEN '{code}'" if hi is not None else f"WHEN v >= {lo} THEN '{code}'"
        for code, (lo, hi) in K.VALUE_BANDS.items())
    return f"""{CV}
SELECT banda, count(*) AS n FROM (SELECT CASE {cases} END AS banda FROM (SELECT valor_del_contrato * 10000 AS v FROM cv))
WHERE banda IS NOT NULL GROUP BY 1"""


@register("filter_value_band", _band_sql())
def q_value_band(spark, sf):
    d = contract_view(spark, sf).select((F.col("valor_del_contrato") * 10000).alias("v"))
    band = F.lit(None).cast("string")
    for code in reversed(list(K.VALUE_BANDS)):
        band = F.when(FL.value_band_predicate("v", code), F.lit(code)).otherwise(band)
    return d.select(band.alias("banda")).where(F.col("banda").isNotNull()).groupBy("banda") \
        .agg(F.count(F.lit(1)).alias("n"))


@register("filter_search_spec", f"""{CV}
SELECT count(*) AS n, round(sum(valor_del_contrato), 2) AS valor_total FROM cv
WHERE contains({_fold_sql("objeto_del_contrato")}, 'red')
  AND contains({_fold_sql("nombre_entidad")}, 'customer#00000')
  AND fecha_de_inicio_del_contrato >= TIMESTAMP '1997-01-01' AND fecha_de_inicio_del_contrato <= TIMESTAMP '2000-12-31 23:59:59'
  AND valor_del_contrato * 1000 <= 100000000""")
def q_search_spec(spark, sf):
    cv = contract_view(spark, sf)
    framed = cv.select(F.col("proceso_de_compra").alias("numero_proceso"), F.col("nombre_entidad").alias("entidad"),
                       F.col("objeto_del_contrato").alias("objeto_contrato"),
                       F.col("fecha_de_inicio_del_contrato").alias("fecha_apertura"),
                       (F.col("valor_del_contrato") * 1000).alias("cuantia"), "valor_del_contrato")
    spec = FL.SearchSpec(keyword="Red", entity="CUSTOMER#00000", date_from="01/01/1997", date_to="31/12/2000",
                         municipality="0", value_band="$0 - $100.000.000")
    d = framed.where(FL.spec_predicate(framed, spec))
    return rounded(d.agg(F.count(F.lit(1)).alias("n"), F.sum("valor_del_contrato").alias("valor_total")),
                   {"valor_total": 2})


@register("filter_strict_date_text", f"""
SELECT count(*) AS n FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey WHERE l.l_linenumber % 3 = 0""")
def q_strict_date(spark, sf):
    r = raw_results(spark, sf)
    return r.where(FL.strict_date_text_predicate("fecha_apertura")).agg(F.count(F.lit(1)).alias("n"))


# ---- catalog lookups ---------------------------------------------------------------

def _dept_spellings(spark, sf):
    """Every customer gets a department written one of five ways."""
    opts = K.DEPARTMENTS
    n = len(opts)
    codes = F.array(*[F.lit(o.code) for o in opts])
    api = F.array(*[F.lit(o.api_value or o.label) for o in opts])
    labels = F.array(*[F.lit(o.label) for o in opts])
    c = table(spark, sf, "customer").select("c_custkey")
    i = (F.col("c_custkey") % n + 1).cast("int")
    variant = (F.floor(F.col("c_custkey") / n) % 5).cast("int")
    folded4 = F.substring(F.lower(F.translate(F.element_at(labels, i), "áéíóúüñÁÉÍÓÚÜÑ", "aeiouunAEIOUUN")), 1, 4)
    value = (F.when(variant == 0, F.element_at(codes, i))
             .when(variant == 1, F.element_at(api, i))
             .when(variant == 2, F.concat(F.lit("  "), F.upper(F.element_at(labels, i)), F.lit(" ")))
             .when(variant == 3, folded4)
             .otherwise(F.lit("Desconocido")))
    return c.select("c_custkey", value.alias("valor"))


def _values_sql(opts: list[K.Option]) -> str:
    def q(v):
        return "NULL" if v is None else _sq(v)
    rows = ", ".join(f"({i}, {q(o.label)}, {q(o.code)}, {q(o.api_value)}, "
                     f"[{', '.join(_sq(v) for v in o.all_api_values)}]::VARCHAR[])" for i, o in enumerate(opts))
    return f"(VALUES {rows}) AS t(pos, etiqueta, codigo, valor_api, valores_api)"


def _dept_spellings_sql() -> str:
    opts = K.DEPARTMENTS
    n = len(opts)
    codes = "[" + ", ".join("NULL" if o.code is None else _sq(o.code) for o in opts) + "]"
    api = "[" + ", ".join(_sq(o.api_value or o.label) for o in opts) + "]"
    labels = "[" + ", ".join(_sq(o.label) for o in opts) + "]"
    i = f"(c_custkey % {n} + 1)"
    variant = f"(CAST(floor(c_custkey / {n}) AS BIGINT) % 5)"
    return f"""SELECT c_custkey, CASE WHEN {variant} = 0 THEN {codes}[{i}]
  WHEN {variant} = 1 THEN {api}[{i}]
  WHEN {variant} = 2 THEN '  ' || upper({labels}[{i}]) || ' '
  WHEN {variant} = 3 THEN substr({_fold_sql(labels + '[' + i + ']')}, 1, 4)
  ELSE 'Desconocido' END AS valor FROM customer"""


def _resolve_sql(src: str, opts: list[K.Option]) -> str:
    cat = _values_sql(opts)
    fc = _collapse_sql
    return f"""cat AS (SELECT * FROM {cat}),
keys AS (
  SELECT pos, 1 AS tier, codigo AS key FROM cat UNION ALL
  SELECT pos, 2, valor_api FROM cat UNION ALL
  SELECT pos, 3, {fc(_fold_sql('etiqueta'))} FROM cat UNION ALL
  SELECT pos, 3, {fc(_fold_sql('valor_api'))} FROM cat UNION ALL
  SELECT pos, 3, {fc(_fold_sql('codigo'))} FROM cat UNION ALL
  SELECT pos, 4, {fc(_fold_sql('m'))} FROM (SELECT pos, unnest(valores_api) AS m FROM cat) UNION ALL
  SELECT pos, 5, {fc(_fold_sql('etiqueta'))} FROM cat),
src AS ({src}),
v AS (SELECT DISTINCT valor, {_strip_sql('valor')} AS texto, {fc(_fold_sql(_strip_sql('valor')))} AS goal
      FROM src WHERE valor IS NOT NULL),
hits AS (SELECT v.valor, min(k.tier * 1000 + k.pos) AS best FROM v JOIN keys k ON k.key IS NOT NULL AND (
    (k.tier <= 2 AND k.key = v.texto) OR (k.tier IN (3, 4) AND k.key = v.goal)
    OR (k.tier = 5 AND v.goal <> '' AND contains(k.key, v.goal)))
  WHERE v.texto <> '' GROUP BY v.valor),
res AS (SELECT h.valor, c.etiqueta, c.codigo, c.valores_api, CAST(h.best // 1000 AS INTEGER) AS nivel
        FROM hits h JOIN cat c ON c.pos = h.best % 1000)"""


@register("resolve_catalog_departments", f"""WITH {_resolve_sql(_dept_spellings_sql(), K.DEPARTMENTS)}
SELECT s.c_custkey, r.etiqueta, r.nivel FROM src s LEFT JOIN res r ON s.valor = r.valor""")
def q_resolve_catalog(spark, sf):
    d = lookup.resolve_catalog(_dept_spellings(spark, sf), "valor", K.DEPARTMENTS)
    return d.select("c_custkey", F.col("valor_etiqueta").alias("etiqueta"), F.col("valor_nivel").alias("nivel"))


@register("translate_departments", f"""WITH {_resolve_sql(_dept_spellings_sql(), K.DEPARTMENTS)}
SELECT r.etiqueta, r.codigo AS en_secop1, len(r.valores_api) > 0 AS existe_en_api,
  r.codigo IS NULL AND len(r.valores_api) > 0 AS solo_api, count(*) AS n
FROM src s JOIN res r ON s.valor = r.valor GROUP BY ALL""")
def q_translate(spark, sf):
    d = lookup.resolve_catalog(_dept_spellings(spark, sf), "valor", K.DEPARTMENTS, prefix="d")
    t = lookup.translate_across_sources(d.where(F.col("d_etiqueta").isNotNull()), "d", "secop1")
    return t.groupBy(F.col("d_etiqueta").alias("etiqueta"), F.col("d_en_secop1").alias("en_secop1"),
                     F.col("d_existe_en_api").alias("existe_en_api"), F.col("d_solo_api").alias("solo_api")) \
        .agg(F.count(F.lit(1)).alias("n"))


def _state_spellings_sql() -> str:
    return f"SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'Celebrado' WHEN 1 THEN 'Terminado' ELSE 'terminado' END AS valor FROM orders"


@register("expand_state_option", f"""WITH {_resolve_sql(_state_spellings_sql(), K.STATES)}
SELECT m AS valor_api, count(*) AS n FROM (SELECT unnest(r.valores_api) AS m FROM src s JOIN res r ON s.valor = r.valor)
GROUP BY 1""")
def q_expand(spark, sf):
    o = table(spark, sf, "orders")
    v = F.when(F.col("o_orderkey") % 3 == 0, F.lit("Celebrado")).when(F.col("o_orderkey") % 3 == 1, F.lit("Terminado")) \
        .otherwise(F.lit("terminado"))
    d = lookup.resolve_catalog(o.select("o_orderkey", v.alias("valor")), "valor", K.STATES, prefix="e")
    e = lookup.expand_option(d, "e")
    return e.groupBy(F.col("e_valor").alias("valor_api")).agg(F.count(F.lit(1)).alias("n"))


def _modality_names(spark, sf):
    names = list(K.MODALITY_CODES.items())
    o = table(spark, sf, "orders").select("o_orderkey")
    i = (F.col("o_orderkey") % len(names) + 1).cast("int")
    variant = (F.floor(F.col("o_orderkey") / len(names)) % 4).cast("int")
    codes = F.array(*[F.lit(k) for k, _ in names])
    full = F.array(*[F.lit(v) for _, v in names])
    v = (F.when(variant == 0, F.element_at(codes, i))
         .when(variant == 1, F.upper(F.element_at(full, i)))
         .when(variant == 2, F.substring(F.lower(F.element_at(full, i)), 1, 12))
         .otherwise(F.lit("Modalidad inventada")))
    return o.select("o_orderkey", v.alias("modalidad"))


def _modality_names_sql() -> str:
    names = list(K.MODALITY_CODES.items())
    n = len(names)
    codes = "[" + ", ".join(_sq(k) for k, _ in names) + "]"
    full = "[" + ", ".join(_sq(v) for _, v in names) + "]"
    i = f"(o_orderkey % {n} + 1)"
    variant = f"(CAST(floor(o_orderkey / {n}) AS BIGINT) % 4)"
    return f"""SELECT o_orderkey, CASE WHEN {variant} = 0 THEN {codes}[{i}] WHEN {variant} = 1 THEN upper({full}[{i}])
  WHEN {variant} = 2 THEN substr(lower({full}[{i}]), 1, 12) ELSE 'Modalidad inventada' END AS modalidad FROM orders"""


def _code_table_sql() -> str:
    rows = ", ".join(f"({i}, {_sq(k)}, {_sq(v)})" for i, (k, v) in enumerate(K.MODALITY_CODES.items()))
    return f"(VALUES {rows}) AS t(pos, codigo, nombre)"


@register("resolve_code_modalities", f"""WITH src AS ({_modality_names_sql()}),
ct AS (SELECT * FROM {_code_table_sql()}),
keys AS (SELECT pos, codigo, 1 AS tier, codigo AS key FROM ct UNION ALL
         SELECT pos, codigo, 2, {_collapse_sql(_fold_sql('nombre'))} FROM ct UNION ALL
         SELECT pos, codigo, 3, {_collapse_sql(_fold_sql('nombre'))} FROM ct),
v AS (SELECT DISTINCT modalidad, {_strip_sql('modalidad')} AS texto,
        {_collapse_sql(_fold_sql(_strip_sql('modalidad')))} AS goal FROM src),
best AS (SELECT v.modalidad, arg_min(k.codigo, k.tier * 1000 + k.pos) AS codigo FROM v JOIN keys k ON
   (k.tier = 1 AND k.key = v.texto) OR (k.tier = 2 AND k.key = v.goal) OR (k.tier = 3 AND contains(k.key, v.goal))
   GROUP BY v.modalidad)
SELECT s.o_orderkey, coalesce(b.codigo, {_strip_sql('s.modalidad')}) AS modalidad_codigo
FROM src s LEFT JOIN best b ON s.modalidad = b.modalidad""")
def q_resolve_code(spark, sf):
    d = lookup.resolve_code(_modality_names(spark, sf), "modalidad", K.MODALITY_CODES)
    return d.select("o_orderkey", "modalidad_codigo")


@register("catalog_orphans_states", f"""
WITH cat AS (SELECT DISTINCT unnest(valores_api) AS valor FROM {_values_sql(K.STATES)}),
data AS (SELECT DISTINCT {_STATE_SQL} AS valor FROM orders)
SELECT valor FROM cat WHERE valor NOT IN (SELECT valor FROM data WHERE valor IS NOT NULL)""")
def q_orphans(spark, sf):
    return lookup.catalog_orphans(_orders_with_state(spark, sf), "estado_contrato", K.STATES)


@register("catalog_unknowns_types", f"""{CV},
cat AS (SELECT DISTINCT unnest(valores_api) AS valor FROM {_values_sql(K.CONTRACT_TYPES)})
SELECT DISTINCT tipo_de_contrato AS valor FROM cv WHERE tipo_de_contrato IS NOT NULL
  AND tipo_de_contrato NOT IN (SELECT valor FROM cat)""")
def q_unknowns(spark, sf):
    return lookup.catalog_unknowns(contract_view(spark, sf), "tipo_de_contrato", K.CONTRACT_TYPES)


@register("code_drift_departments", f"""
WITH js AS (SELECT 'deptos[' || n_nationkey || '] = "' || CAST(n_nationkey * 1000 AS VARCHAR) || '";' AS t FROM nation),
found AS (SELECT DISTINCT CAST(n_nationkey * 1000 AS VARCHAR) AS codigo FROM nation)
SELECT codigo FROM found WHERE codigo NOT IN ({', '.join(_sq(k) for k in K.DEPARTMENT_CODES)})""")
def q_code_drift(spark, sf):
    n = table(spark, sf, "nation")
    js = n.select(F.concat(F.lit("deptos["), F.col("n_nationkey").cast("string"), F.lit('] = "'),
                           (F.col("n_nationkey") * 1000).cast("string"), F.lit('";')).alias("js"))
    return lookup.code_drift(js, "js", K.DEPARTMENT_CODES)


# ---- unification, sets, paging ----------------------------------------------------

def _unified_sources(spark, sf):
    cv = contract_view(spark, sf)
    api = cv.where(F.col("fuente") == "A").drop("fuente")
    s1 = clean(raw_results(spark, sf)).drop("id_proceso", "fecha_cierre")
    return unify.union_sources([unify.normalize_schema(api, "SECOP II"), unify.normalize_schema(s1, "SECOP I")])


@register("union_sources_by_source", f"""{CV},
r AS (SELECT l.l_extendedprice AS v, l.l_linenumber AS k FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
      JOIN customer c ON o.o_custkey = c.c_custkey)
SELECT 'SECOP II' AS fuente, count(*) AS n, round(sum(valor_del_contrato), 2) AS valor_total FROM cv WHERE fuente = 'A'
UNION ALL
SELECT 'SECOP I', count(*), round(sum(CASE WHEN k % 4 = 3 THEN NULL ELSE round(v, 2) END), 2) FROM r""")
def q_union_sources(spark, sf):
    u = _unified_sources(spark, sf)
    return rounded(u.groupBy("fuente").agg(F.count(F.lit(1)).alias("n"),
                                           F.sum("valor_del_contrato").alias("valor_total")), {"valor_total": 2})


@register("unified_schema_columns", f"""
SELECT {', '.join(_sq(c) + ' AS c' + str(i) for i, c in enumerate(
    ['nombre_entidad', 'objeto_del_contrato', 'valor_del_contrato', 'valor_pagado', 'modalidad_de_contratacion',
     'ciudad', 'departamento', 'estado_contrato', 'tipo_de_contrato', 'proveedor_adjudicado', 'proceso_de_compra',
     'urlproceso', 'fecha_de_inicio_del_contrato', 'fecha_de_fin_del_contrato']))}, count(*) AS n
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey""")
def q_unified_columns(spark, sf):
    s1 = unify.order_columns(unify.normalize_schema(
        clean(raw_results(spark, sf)).drop("id_proceso", "fecha_cierre"), "SECOP I"))
    cols = s1.columns[:14]
    return s1.groupBy(*[F.lit(c).alias(f"c{i}") for i, c in enumerate(cols)]).agg(F.count(F.lit(1)).alias("n"))


@register("positional_rename", """
SELECT doc_id AS numero_proceso, lang AS id_proceso, source AS entidad FROM documents""")
def q_positional_rename(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("col_0"), F.col("lang").alias("col_1"),
                                              F.col("source").alias("col_2"))
    return rename_columns(d)


@register("type_and_project", f"""{CV}
SELECT count(*) AS n, count(*) FILTER (WHERE contains(lower(objeto_del_contrato), 'gear')) AS con_gear,
  min(fecha_de_inicio_del_contrato) AS primera FROM cv""")
def q_type_project(spark, sf):
    cv = contract_view(spark, sf).withColumn("fecha_de_inicio_del_contrato",
                                             F.date_format("fecha_de_inicio_del_contrato", "dd/MM/yyyy"))
    t = unify.type_columns(cv)
    p = unify.project_existing(t, ["fecha_inicio", "_busqueda", "no_existe"])
    return p.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_busqueda").contains("gear")).alias("con_gear"),
                 F.min("fecha_inicio").alias("primera"))


@register("union_distinct_documents", """
SELECT count(*) AS n FROM (SELECT DISTINCT text, lang FROM (
  SELECT text, lang FROM documents UNION ALL SELECT text, lang FROM documents WHERE lang = 'en'))""")
def q_union_distinct(spark, sf):
    d = table(spark, sf, "documents").select("text", "lang")
    return unify.union_distinct([d, d.where(F.col("lang") == "en")]).agg(F.count(F.lit(1)).alias("n"))


@register("distinct_urls_pages", """
SELECT count(DISTINCT url) AS n FROM pages WHERE url IS NOT NULL AND trim(url) <> ''""")
def q_distinct_urls(spark, sf):
    return unify.distinct_urls(table(spark, sf, "pages"), "url").agg(F.count(F.lit(1)).alias("n"))


@register("set_difference_nations", f"""{CV},
e AS (SELECT DISTINCT n_name AS ciudad FROM nation), a AS (SELECT DISTINCT ciudad FROM cv WHERE departamento <> 'ASIA')
SELECT 'faltan' AS lado, ciudad FROM e WHERE ciudad NOT IN (SELECT ciudad FROM a)
UNION ALL SELECT 'sobran', ciudad FROM a WHERE ciudad NOT IN (SELECT ciudad FROM e)""")
def q_set_difference(spark, sf):
    e = table(spark, sf, "nation").select(F.col("n_name").alias("ciudad"))
    a = contract_view(spark, sf).where(F.col("departamento") != "ASIA")
    missing, extra = unify.set_difference(e, a, "ciudad")
    return missing.select(F.lit("faltan").alias("lado"), "ciudad").unionByName(
        extra.select(F.lit("sobran").alias("lado"), "ciudad"))


@register("capped_rows_events", """
SELECT event_id, value FROM events WHERE event_type = 'click' ORDER BY event_id LIMIT 100""")
def q_capped_rows(spark, sf):
    rows, _ = paging.capped(table(spark, sf, "events").where(F.col("event_type") == "click"), 100, ["event_id"])
    return rows.select("event_id", "value")


@register("capped_report_events", """
SELECT count(*) AS coincidencias, least(count(*), 100) AS devueltos, count(*) > 100 AS truncado, 'event_id' AS orden
FROM events WHERE event_type = 'click'""")
def q_capped_report(spark, sf):
    _, rep = paging.capped(table(spark, sf, "events").where(F.col("event_type") == "click"), 100, ["event_id"])
    return rep


@register("page_events", """
SELECT event_id, user_id FROM events ORDER BY event_id LIMIT 50 OFFSET 200""")
def q_page(spark, sf):
    return paging.page(table(spark, sf, "events"), "event_id", 50, 200).select("event_id", "user_id")


@register("page_after_events", """
SELECT event_id, user_id FROM events WHERE event_id > 5000 ORDER BY event_id LIMIT 50""")
def q_page_after(spark, sf):
    return paging.page_after(table(spark, sf, "events"), "event_id", 50, 5000).select("event_id", "user_id")


# ---- counts and options ----------------------------------------------------------------

@register("count_matching_contracts", f"""{CV}
SELECT count(*) AS total FROM cv WHERE modalidad_de_contratacion = '1-URGENT' AND contains({_fold_sql('objeto_del_contrato')}, 'widget')""")
def q_count_matching(spark, sf):
    cv = contract_view(spark, sf)
    p = FL.equals_predicate("modalidad_de_contratacion", "1-URGENT") & FL.keyword_predicate(cv, "WIDGET")
    return quality.count_matching(cv, p)


@register("value_counts_state", f"""{CV}
SELECT estado_contrato, count(*) AS n FROM cv GROUP BY 1""")
def q_value_counts(spark, sf):
    return quality.value_counts(contract_view(spark, sf), "estado_contrato")


@register("filter_options_contracts", f"""{CV}
SELECT DISTINCT campo, valor FROM (
  SELECT 'modalidad_de_contratacion' AS campo, modalidad_de_contratacion AS valor FROM cv UNION ALL
  SELECT 'ciudad', ciudad FROM cv UNION ALL SELECT 'tipo_de_contrato', tipo_de_contrato FROM cv UNION ALL
  SELECT 'estado_contrato', estado_contrato FROM cv) WHERE valor IS NOT NULL""")
def q_filter_options(spark, sf):
    return quality.filter_options(contract_view(spark, sf),
                                  ["modalidad_de_contratacion", "ciudad", "tipo_de_contrato", "estado_contrato"])


@register("count_by_source", f"""{CV}
SELECT fuente, count(*) AS n FROM cv GROUP BY 1""")
def q_count_by_source(spark, sf):
    return quality.count_by_source(contract_view(spark, sf))


@register("source_list", f"""{CV}
SELECT array_to_string(list_sort(list(DISTINCT fuente)), ',') AS fuentes FROM cv""")
def q_source_list(spark, sf):
    return quality.source_list(contract_view(spark, sf)).select(F.array_join("fuentes", ",").alias("fuentes"))


@register("refine_dashboard", f"""{CV},
t AS (SELECT *, lower(coalesce(objeto_del_contrato, '')) AS b FROM cv)
SELECT count(*) AS n, round(sum(valor_del_contrato), 2) AS valor_total FROM t
WHERE contains(b, 'small') AND modalidad_de_contratacion IN ('3-MEDIUM', '5-LOW') AND tipo_de_contrato IN ('SMALL', 'ECONOMY')
  AND valor_del_contrato >= 0.02 * 1000000 AND valor_del_contrato <= 0.08 * 1000000
  AND (fecha_de_inicio_del_contrato IS NULL OR fecha_de_inicio_del_contrato >= TIMESTAMP '1996-01-01')
  AND (fecha_de_fin_del_contrato IS NULL OR fecha_de_fin_del_contrato <= TIMESTAMP '2001-12-31')""")
def q_refine(spark, sf):
    from pliego.plans.jobs import refine
    t = unify.type_columns(contract_view(spark, sf).withColumn(
        "fecha_de_inicio_del_contrato", F.date_format("fecha_de_inicio_del_contrato", "yyyy-MM-dd")).withColumn(
        "fecha_de_fin_del_contrato", F.date_format("fecha_de_fin_del_contrato", "yyyy-MM-dd")))
    r = refine(t, "Small", {"modalidad_de_contratacion": ["3-MEDIUM", "5-LOW"], "tipo_de_contrato": ["SMALL", "ECONOMY"]},
               (0.02, 0.08), _dt.date(1996, 1, 1), _dt.date(2001, 12, 31))
    return rounded(r.agg(F.count(F.lit(1)).alias("n"), F.sum("valor_del_contrato").alias("valor_total")),
                   {"valor_total": 2})
