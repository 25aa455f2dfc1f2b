"""Sources, sinks, small helpers and whole jobs, each run on the tables
(S2, S3, S12, S14, P7, A8, A30, U6, T3, M6, M10, M11)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pliego.operators import quality, report, study, unify
from pliego.plans import registry
from pliego.plans.contract_view import CONTRACT_VIEW_SQL, contract_view, table
from pliego.plans.fixtures import detail_pages, raw_results, result_pages
from pliego.plans.registry import register, rounded
from pliego.session import scratch_path
from pliego.sources import files

CV = f"WITH cv AS ({CONTRACT_VIEW_SQL})"


def _folder(spark, name: str) -> str:
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


@register("latest_snapshot_customer", "SELECT c_custkey, c_name FROM customer")
def q_latest_snapshot(spark, sf):
    """Two snapshots in one folder, each a folder of many files; the newer one holds the whole table."""
    path, c = _folder(spark, "snapshots"), table(spark, sf, "customer").select("c_custkey", "c_name")
    c.where("c_custkey % 2 = 0").write.parquet(f"{path}/first")
    c.write.parquet(f"{path}/second")
    return files.latest_snapshot(spark, path, "parquet")


@register("base_roundtrip_customer", """
SELECT 'csv' AS formato, CAST(c_custkey AS VARCHAR) AS c_custkey, c_name FROM customer
UNION ALL SELECT 'parquet', CAST(c_custkey AS VARCHAR), c_name FROM customer""")
def q_base_roundtrip(spark, sf):
    """Both formats, and a base that does not exist yet."""
    root, c = _folder(spark, "bases"), table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("c_custkey"), "c_name")
    files.sink_base(c, f"{root}/base.csv")
    files.sink_base(c, f"{root}/base")
    none = files.scan_base(spark, f"{root}/none", c.schema)
    return (files.scan_base(spark, f"{root}/base.csv").withColumn("formato", F.lit("csv"))
            .unionByName(files.scan_base(spark, f"{root}/base").unionByName(none).withColumn("formato", F.lit("parquet"))))


@register("report_tables_totals", registry.ORACLE["demand_totals"])
def q_report_tables(spark, sf):
    """A section written with the study's tables and read back."""
    root = _folder(spark, "report")
    files.sink_report_tables({"demanda_totales": study.demand_totals(contract_view(spark, sf))}, root)
    return rounded(spark.read.parquet(f"{root}/demanda_totales"), {"valor_total": 2})


@register("drop_helper_columns", f"{CV} SELECT proceso_de_compra, objeto_del_contrato FROM cv")
def q_drop_helper(spark, sf):
    """P7 after P5."""
    typed = unify.type_columns(contract_view(spark, sf).select("proceso_de_compra", "objeto_del_contrato"))
    return unify.drop_helper_columns(typed).select("proceso_de_compra", "objeto_del_contrato")


@register("pick_date_column", f"""{CV}
SELECT 'fecha_de_inicio_del_contrato' AS columna, count(*) AS contratos FROM cv""")
def q_pick_date(spark, sf):
    """The first candidate is there but holds nothing."""
    cv = contract_view(spark, sf).withColumn("fecha_inicio", F.lit(None).cast("timestamp_ntz"))
    return cv.groupBy(F.lit(study.pick_date_column(cv)).alias("columna")).agg(F.count(F.lit(1)).alias("contratos"))


@register("required_columns", f"{CV} SELECT 'cuantia' AS falta, count(*) AS filas FROM cv")
def q_required(spark, sf):
    """A30."""
    cv = contract_view(spark, sf)
    missing = quality.required_columns_check(cv, ["ciudad", "cuantia"])
    return cv.groupBy(F.lit(",".join(missing)).alias("falta")).agg(F.count(F.lit(1)).alias("filas"))


@register("fallback_source", f"""{CV}
SELECT 'fallida' AS primera, 'A' AS fuente, count(*) AS n FROM cv WHERE fuente = 'A'
UNION ALL SELECT 'vacia', 'A', count(*) FROM cv WHERE fuente = 'A'
UNION ALL SELECT 'con filas', 'B', count(*) FROM cv WHERE fuente = 'B'""")
def q_fallback(spark, sf):
    """The first source fails, is empty, or answers."""
    cv = contract_view(spark, sf)
    second = lambda: cv.where("fuente = 'A'")

    def failing():
        raise RuntimeError("no answer")

    firsts = {"fallida": failing, "vacia": lambda: cv.where("fuente = 'none'"), "con filas": lambda: cv.where("fuente = 'B'")}
    parts = [unify.fallback(f, second, []).groupBy("fuente").agg(F.count(F.lit(1)).alias("n")).withColumn("primera", F.lit(name))
             for name, f in firsts.items()]
    return unify.union_sources(parts, ["primera", "fuente", "n"])


@register("clean_stream_results", registry.ORACLE["clean_results"])
def q_clean_stream(spark, sf):
    """Landed rows cleaned by a file-source stream."""
    from pliego.streaming.incremental import clean_stream
    root, raw = _folder(spark, "clean"), raw_results(spark, sf)
    raw.write.parquet(f"{root}/landing")
    stream = clean_stream(spark.readStream.schema(raw.schema).parquet(f"{root}/landing"))
    q = (stream.writeStream.format("parquet").option("checkpointLocation", f"{root}/checkpoint")
         .trigger(availableNow=True).start(f"{root}/out"))
    q.awaitTermination()
    return rounded(spark.read.parquet(f"{root}/out"), {"cuantia": 2})


@register("study_sections_by_year", registry.ORACLE["by_year"])
def q_study(spark, sf):
    """M6: one section of the assembled study."""
    return rounded(report.study(contract_view(spark, sf))["por_anio"], {"valor_total": 2})


@register("search_job_base", f"""{CV}
SELECT 'SECOP I' AS fuente, count(*) AS filas, count(DISTINCT (proceso_de_compra, _linea)) AS en_base FROM (
  SELECT DISTINCT proceso_de_compra, _linea, modalidad_de_contratacion, estado_contrato, nombre_entidad,
    objeto_del_contrato, departamento, ciudad, round(valor_del_contrato, 2), fecha_de_inicio_del_contrato FROM cv
  WHERE CAST(proceso_de_compra AS BIGINT) % 50 <> 0 AND departamento = 'ASIA' AND contains(lower(objeto_del_contrato), 'red'))""")
def q_search_job(spark, sf):
    """Landed pages, the query's filters, the keyed base and the report."""
    from pliego.plans.jobs import ContractQuery, search_job
    path = _folder(spark, "search")
    _, rep = search_job(result_pages(spark, sf), None, ContractQuery(keyword="red", department="ASIA"),
                        base_path=path, key=("urlproceso",))
    base = files.scan_base(spark, path)
    return rep.select("fuente", "filas").join(base.groupBy("fuente").agg(F.count(F.lit(1)).alias("en_base")), "fuente")


@register("detail_job_records", """
SELECT 'SAMC ' || CAST(o_orderkey AS VARCHAR) AS numero_proceso, round(o_totalprice, 2) AS valor_estimado
FROM orders""")
def q_detail_job(spark, sf):
    """The detail pages of a listing, cleaned and merged into a keyed base; every page is also there
    under a URL that the listing does not have."""
    from pliego.plans.jobs import detail_job
    pages, path = detail_pages(spark, sf), _folder(spark, "details")
    listing = pages.select(F.col("url").alias("url_detalle"))
    landed = pages.unionByName(pages.withColumn("url", F.concat("url", F.lit("&copia=1"))))
    detail_job(listing, landed, base_path=path)
    return rounded(files.scan_base(spark, path).select("numero_proceso", "valor_estimado"), {"valor_estimado": 2})


@register("search_job_rows", f"""{CV}
SELECT 'primera' AS consulta, count(*) AS filas FROM (
  SELECT DISTINCT proceso_de_compra, _linea, modalidad_de_contratacion, estado_contrato, nombre_entidad,
    objeto_del_contrato, departamento, ciudad, round(valor_del_contrato, 2), fecha_de_inicio_del_contrato FROM cv
  WHERE CAST(proceso_de_compra AS BIGINT) % 50 <> 0 AND departamento = 'ASIA' AND contains(lower(objeto_del_contrato), 'red'))
UNION ALL SELECT 'segunda', count(*) FROM (
  SELECT DISTINCT proceso_de_compra, _linea, modalidad_de_contratacion, estado_contrato, nombre_entidad,
    objeto_del_contrato, departamento, ciudad, round(valor_del_contrato, 2), fecha_de_inicio_del_contrato FROM cv
  WHERE CAST(proceso_de_compra AS BIGINT) % 50 <> 0 AND departamento = 'EUROPE' AND contains(lower(objeto_del_contrato), 'red'))
UNION ALL SELECT 'base', count(DISTINCT (proceso_de_compra, _linea)) FROM cv
  WHERE CAST(proceso_de_compra AS BIGINT) % 50 <> 0 AND departamento IN ('ASIA', 'EUROPE') AND contains(lower(objeto_del_contrato), 'red')""")
def q_search_rows(spark, sf):
    """Two searches into one base; each returns its own rows, the base holds both."""
    from pliego.plans.jobs import ContractQuery, search_job
    from pliego.sources.html import landed_rows
    path, pages = _folder(spark, "search"), result_pages(spark, sf)
    rows = landed_rows(pages)
    runs = [search_job(pages, None, ContractQuery(keyword="red", department=d), base_path=path, key=("urlproceso",), rows=rows)[0]
            for d in ("ASIA", "EUROPE")]
    named = {"primera": runs[0], "segunda": runs[1], "base": files.scan_base(spark, path)}
    parts = [df.agg(F.count(F.lit(1)).alias("filas")).select(F.lit(name).alias("consulta"), "filas") for name, df in named.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("base_read_modify_write", """
SELECT c_custkey, round(c_acctbal * 2, 2) AS c_acctbal FROM customer WHERE c_acctbal > 0
UNION ALL SELECT s_suppkey, round(s_acctbal, 2) FROM supplier""")
def q_base_rewrite(spark, sf):
    """A base is read, filtered, changed, joined by new rows and written to the path it came from."""
    path = _folder(spark, "base")
    files.sink_base(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), path)
    kept = files.scan_base(spark, path).where("c_acctbal > 0").withColumn("c_acctbal", F.col("c_acctbal") * 2)
    files.sink_base(kept.unionByName(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("c_custkey"),
                                                                         F.col("s_acctbal").alias("c_acctbal"))), path)
    return rounded(files.scan_base(spark, path), {"c_acctbal": 2})
