"""Raw-text frames that Spark derives from the test tables.

The tables hold clean, typed values; the cleaning operators need messy text.
These frames render every row of the source tables into the portal's text
conventions (Colombian and Anglo money, day-first and ISO dates, stray
whitespace and mis-decoded punctuation) so that parsing them back can be
checked against the original typed values. Row counts grow with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pliego.plans.contract_view import table


def colombian_money(v) -> F.Column:
    """$1.234,56"""
    return F.concat(F.lit("$"), F.translate(F.format_number(v, 2), ",.", ".,"))


def anglo_money(v) -> F.Column:
    """$1,234.56 COP"""
    return F.concat(F.lit("$"), F.format_number(v, 2), F.lit(" COP"))


def raw_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source-1 style all-text result rows, one per lineitem."""
    # landed text files arrive in many splits: deal the narrow scan out before rendering
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", "l_suppkey", "l_shipdate"
    ).repartition(spark.sparkContext.defaultParallelism)
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == c.c_custkey)
    k = F.col("l_linenumber")
    v = F.col("l_extendedprice")
    money = (F.when(k % 4 == 0, colombian_money(v))
             .when(k % 4 == 1, anglo_money(v))
             .when(k % 4 == 2, F.concat(F.lit(" "), F.format_string("%.2f", v), F.lit("\n")))
             .otherwise(F.lit("sin valor")))
    d = F.col("o_orderdate")
    date = (F.when(k % 3 == 0, F.date_format(d, "dd-MM-yyyy"))
            .when(k % 3 == 1, F.date_format(d, "dd/MM/yyyy HH:mm"))
            .otherwise(F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss.SSS")))
    return j.select(
        F.col("l_orderkey").cast("string").alias("numero_proceso"),
        F.col("l_linenumber").cast("string").alias("id_proceso"),
        F.concat(F.lit("  "), F.col("c_name"), F.lit("\t\x96 "), F.col("o_orderstatus"), F.lit("\xa0")).alias("entidad"),
        money.alias("cuantia"),
        date.alias("fecha_apertura"),
        F.when(k % 5 == 0, F.lit(" ")).otherwise(F.date_format(F.col("l_shipdate"), "d/M/yyyy")).alias("fecha_cierre"),
    )


RAW_RESULTS_SQL = """
SELECT CAST(l.l_orderkey AS VARCHAR) AS numero_proceso, l.l_linenumber AS k, l.l_extendedprice AS v,
       o.o_orderdate AS d, l.l_shipdate AS ship, c.c_name, o.o_orderstatus
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
"""


# ---- landed HTML pages rendered from the tables ------------------------------

DETAIL_BASE = "https://www.contratos.gov.co/consultas/detalleProceso.do"


def _splits(spark: SparkSession) -> int:
    """Splits of landed pages: two a task slot at least, and no fewer than the session deals a large shuffle out to."""
    return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), 1)


def _as_landed(df: DataFrame) -> DataFrame:
    """Rendered pages stand in for landed files, which a scan reads in many
    splits; a fixed-count repartition keeps AQE from folding the small
    rendering shuffle into one task before the Python parse."""
    return df.repartition(_splits(df.sparkSession), "page_id")


def _esc(c):
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
                     F.lit(">"), F.lit("&gt;"))


def result_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One results page per order (its lines are the page's rows, <= 7), with
    the hidden total; every 50th order's page lost its table (a parse error)."""
    from pliego.plans.contract_view import contract_view
    # lines are dealt out by page as in _as_landed, and pages rendered where their lines are
    cv = contract_view(spark, sf_dir, with_line_keys=True, orders_last=True).withColumn(
        "page_id", F.col("proceso_de_compra").cast("long"))
    cv = cv.repartition(_splits(spark), "page_id").withColumn("proceso_de_compra", F.col("page_id").cast("string"))
    row = F.concat(
        F.lit("<tr><td>"), F.col("_linea").cast("string"), F.lit("</td><td><a href=\"javascript: consultaProceso('"),
        F.col("proceso_de_compra"), F.lit("-"), F.col("_linea").cast("string"), F.lit("')\">P-"),
        F.col("proceso_de_compra"), F.lit("-"), F.col("_linea").cast("string"), F.lit("</a></td><td>"),
        _esc(F.col("modalidad_de_contratacion")), F.lit("</td><td>"), F.col("estado_contrato"), F.lit("</td><td>"),
        _esc(F.col("nombre_entidad")), F.lit("</td><td>"), _esc(F.col("objeto_del_contrato")), F.lit("</td><td>"),
        F.col("departamento"), F.lit(" : "), F.col("ciudad"), F.lit("</td><td>"),
        colombian_money(F.col("valor_del_contrato")), F.lit("</td><td>Fecha de Celebración del Primer Contrato "),
        F.date_format("fecha_de_inicio_del_contrato", "dd-MM-yyyy"), F.lit("</td></tr>"))
    pages = cv.groupBy("page_id").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct(F.col("_linea"), row.alias("r")))).getField("r"), "")
        .alias("body"), F.count(F.lit(1)).alias("n"))
    header = ("<tr><th>&nabla;</th><th>Número de Proceso</th><th>Tipo de Proceso</th><th>Estado</th>"
              "<th>Entidad</th><th>Objeto</th><th>Departamento y Municipio de Ejecución</th><th>Cuantía</th>"
              "<th>Fecha(dd-mm-aaaa)</th></tr>")
    table = F.concat(F.lit("<table class=\"resultados\"><thead>" + header + "</thead><tbody>"), F.col("body"),
                     F.lit("<tr><td colspan=\"9\">Página 1</td></tr></tbody></table>"))
    html = F.concat(
        F.lit("<html><head><script>var x = '<td>';</script></head><body><form>"
              "<input type=\"hidden\" name=\"totalResultados\" value=\""), F.col("n").cast("string"),
        F.lit("\"/></form>"),
        F.when(F.col("page_id") % 50 == 0, F.lit("<p>Sin resultados</p>"))
        .otherwise(F.concat(F.lit("<table><tr><td>menú</td></tr></table>"), table)),
        F.lit("<p>"), F.col("n").cast("string"), F.lit(" registros encontrados</p></body></html>"))
    return pages.select("page_id", F.concat(F.lit("https://www.contratos.gov.co/consultas/resultados?page="),
                                            F.col("page_id").cast("string")).alias("url"), html.alias("html"))


def detail_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One detail page per order, label/value rows with varied spelling."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer")
    n = F.broadcast(table(spark, sf_dir, "nation"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == F.col("n_nationkey"))

    def tr(label, value):
        return F.concat(F.lit("<tr><td>" + label + "</td><td>"), value, F.lit("</td></tr>"))
    d = F.date_format("o_orderdate", "dd-MM-yyyy")
    rows = F.concat(
        tr("Tipo de Proceso:", F.col("o_orderpriority")),
        tr("Estado del Proceso", F.col("o_orderstatus")),
        tr("Objeto a Contratar:", F.concat(F.lit("Suministro "), F.col("o_orderkey").cast("string"))),
        tr("Cuantía a Contratar", colombian_money(F.col("o_totalprice"))),
        tr("Fecha y Hora de Apertura del Proceso", F.concat(d, F.lit(" 11:30 a.m."))),
        tr("Fecha de Apertura del Proceso", F.lit("01-01-1990")),
        tr("Nombre o Razón Social del Contratista", F.col("c_name")),
        tr("Departamento y Municipio de Ejecución", F.concat(F.col("n_name"), F.lit(" : Centro"))),
        tr("Etiqueta desconocida", F.lit("x")),
        tr("Valor Total del Contrato", F.lit("")))
    html = F.concat(F.lit("<html><body><h1>Detalle del Proceso Número: SAMC "), F.col("o_orderkey").cast("string"),
                    F.lit("</h1><div>"), F.col("c_name"), F.lit("</div><table>"), rows, F.lit("</table></body></html>"))
    url = F.concat(F.lit(DETAIL_BASE + "?numConstancia=26-"), F.col("o_orderkey").cast("string"))
    return _as_landed(j.select(F.col("o_orderkey").alias("page_id"), url.alias("url"), html.alias("html")))


def generic_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of unknown layout: customers of one nation, at most 50 per page."""
    c = table(spark, sf_dir, "customer")
    page = (F.col("c_nationkey").cast("long") * 1_000_000 + F.floor(F.col("c_custkey") / 50)).alias("page_id")
    row = F.concat(F.lit("<tr><td>"), F.col("c_name"), F.lit("</td><td>"), F.col("c_mktsegment"),
                   F.lit("</td><td>"), F.format_string("%.2f", F.col("c_acctbal")), F.lit("</td></tr>"))
    pages = c.groupBy(page).agg(F.array_join(F.array_sort(F.collect_list(F.struct("c_custkey", row.alias("r"))))
                                             .getField("r"), "").alias("body"))
    html = F.concat(F.lit("<html><body><table><tr><th>Nombre Cliente</th><th>Segmento</th><th>Saldo ($)</th></tr>"),
                    F.col("body"), F.lit("<tr><td> </td><td></td><td></td></tr></table></body></html>"))
    return _as_landed(pages.select("page_id", F.lit("https://example.org/clientes").alias("url"), html.alias("html")))
