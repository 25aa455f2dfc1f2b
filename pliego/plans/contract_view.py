"""The unified contract view on the TPC-H-shaped test tables.

lineitem x orders x customer x nation x region, plus supplier and part,
projected to the 14 unified contract columns + ``fuente``.

Join plan at scale: lineitem-orders is a large-large equi-join on the order
key (sort-merge, or co-located when both are bucketed by it); customer, part
and supplier joins are left to the planner, which broadcasts them only when
their measured size is under ``spark.sql.autoBroadcastJoinThreshold`` (AQE
re-checks at runtime); nation (25 rows) and region (5 rows) are fixed-size
TPC-H dimensions and are broadcast explicitly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pliego.functions.text import DETAIL_URL_BASE

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def contract_view(spark: SparkSession, sf_dir: str, with_line_keys: bool = False,
                  spread_scan: bool = False, orders_last: bool = False) -> DataFrame:
    """``orders_last`` joins the orders, with their customers, after the parts: lines are shuffled while they are
    narrow and come out order by order, so a shuffle after it finds an order's texts side by side.

    ``spread_scan`` deals the narrow fact scan out over the task slots, for
    tables of a single row group; a cluster reading many files leaves it off."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_discount",
        "l_returnflag", "l_shipdate")
    if spread_scan:
        li = li.repartition(spark.sparkContext.defaultParallelism)
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    geo = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
    if orders_last:
        placed = o.join(c, F.col("o_custkey") == c.c_custkey).join(F.broadcast(geo), F.col("c_nationkey") == F.col("n_nationkey"))
        j = (li.join(p, li.l_partkey == p.p_partkey).join(s, li.l_suppkey == s.s_suppkey)
             .join(placed, li.l_orderkey == F.col("o_orderkey")))
    else:
        j = (li.join(o, li.l_orderkey == o.o_orderkey)
             .join(c, F.col("o_custkey") == c.c_custkey)
             .join(F.broadcast(geo), F.col("c_nationkey") == F.col("n_nationkey"))
             .join(s, li.l_suppkey == s.s_suppkey)
             .join(p, li.l_partkey == p.p_partkey))
    cols = [
        F.col("c_name").alias("nombre_entidad"),
        F.col("p_name").alias("objeto_del_contrato"),
        F.col("l_extendedprice").alias("valor_del_contrato"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("valor_pagado"),
        F.col("o_orderpriority").alias("modalidad_de_contratacion"),
        F.col("n_name").alias("ciudad"),
        F.col("r_name").alias("departamento"),
        F.col("o_orderstatus").alias("estado_contrato"),
        F.col("p_type").alias("tipo_de_contrato"),
        F.col("s_name").alias("proveedor_adjudicado"),
        F.col("l_orderkey").cast("string").alias("proceso_de_compra"),
        F.concat(F.lit(DETAIL_URL_BASE + "?numConstancia="), F.col("l_orderkey").cast("string")).alias("urlproceso"),
        F.col("o_orderdate").alias("fecha_de_inicio_del_contrato"),
        F.col("l_shipdate").alias("fecha_de_fin_del_contrato"),
        F.when(F.col("l_returnflag") == "A", F.lit("A")).otherwise(F.lit("B")).alias("fuente"),
    ]
    if with_line_keys:
        cols += [F.col("l_linenumber").alias("_linea")]
    return j.select(*cols)


CONTRACT_VIEW_SQL = f"""
SELECT c.c_name AS nombre_entidad, p.p_name AS objeto_del_contrato,
       l.l_extendedprice AS valor_del_contrato,
       l.l_extendedprice * (1 - l.l_discount) AS valor_pagado,
       o.o_orderpriority AS modalidad_de_contratacion, n.n_name AS ciudad, r.r_name AS departamento,
       o.o_orderstatus AS estado_contrato, p.p_type AS tipo_de_contrato, s.s_name AS proveedor_adjudicado,
       CAST(l.l_orderkey AS VARCHAR) AS proceso_de_compra,
       '{DETAIL_URL_BASE}?numConstancia=' || CAST(l.l_orderkey AS VARCHAR) AS urlproceso,
       o.o_orderdate AS fecha_de_inicio_del_contrato, l.l_shipdate AS fecha_de_fin_del_contrato,
       CASE WHEN l.l_returnflag = 'A' THEN 'A' ELSE 'B' END AS fuente,
       l.l_linenumber AS _linea
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
JOIN supplier s ON l.l_suppkey = s.s_suppkey
JOIN part p ON l.l_partkey = p.p_partkey
"""
