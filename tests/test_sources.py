"""Sources, sinks and driver-side helpers (rows-only items of the survey)."""

import os
import time

from pyspark.sql import functions as F

from pliego.operators import quality, study, unify
from pliego.operators.report import study as full_study
from pliego.plans.contract_view import contract_view
from pliego.sources import files
from pliego.streaming.incremental import latest_version, read_base, upsert_base

from conftest import SF_SMALL


def test_csv_scan_nulls_tokens_and_multiline(spark, scratch):
    path = os.path.join(scratch, "in.csv")
    with open(path, "w", encoding="utf-8-sig") as fh:
        fh.write('a,b,c\n1,"x\ny",NA\n2,N/A,\n')
    df = files.scan_csv_text(spark, path)
    rows = sorted(df.collect(), key=lambda r: r.a)
    assert df.schema.simpleString() == "struct<a:string,b:string,c:string>"
    assert rows[0].b == "x\ny" and rows[0].c is None and rows[1].b is None


def test_latest_snapshot(spark, scratch):
    folder = os.path.join(scratch, "snaps")
    os.makedirs(folder)
    for i, name in enumerate(["old.csv", "new.csv"]):
        with open(os.path.join(folder, name), "w") as fh:
            fh.write(f"k\n{name}\n")
        os.utime(os.path.join(folder, name), (time.time() - 100 + i * 50,) * 2)
    assert [r.k for r in files.latest_snapshot(spark, folder).collect()] == ["new.csv"]


def test_latest_snapshot_of_many_files(spark, scratch):
    """The newest finished folder is read whole; unfinished folders and older files are not."""
    folder = os.path.join(scratch, "snapshot-folders")
    df = spark.range(100).repartition(4)
    df.where("id < 10").write.parquet(f"{folder}/z-old")
    df.write.parquet(f"{folder}/a-new")
    df.where("id < 20").write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{folder}/unfinished")
    got = files.latest_snapshot(spark, folder, "parquet")
    assert sorted(r.id for r in got.collect()) == list(range(100)) and len(got.inputFiles()) == 4
    df.where("id = 7").coalesce(1).write.mode("append").parquet(folder)
    assert [r.id for r in files.latest_snapshot(spark, folder, "parquet").collect()] == [7]



def test_scan_base_missing_is_empty(spark, scratch):
    from pliego.schemas import DETAIL_SCHEMA
    df = files.scan_base(spark, os.path.join(scratch, "nope"), DETAIL_SCHEMA)
    assert df.count() == 0 and df.columns[0] == "numero_proceso"


def test_base_is_rewritten_from_itself(spark, scratch):
    """A failed write loses nothing, a read-modify-write works, and a plain folder becomes a base."""
    for base in (os.path.join(scratch, "base"), os.path.join(scratch, "base.csv")):
        rows = spark.range(10).selectExpr("CAST(id AS STRING) AS id")
        files.sink_base(rows, base)
        try:
            files.sink_base(files.scan_base(spark, base).selectExpr("raise_error('no') AS id"), base)
        except Exception:
            pass
        assert files.scan_base(spark, base).count() == 10
        for _ in range(3):
            files.sink_base(files.scan_base(spark, base).where("CAST(id AS INT) % 2 = 0").unionByName(rows.limit(1)), base)
        assert files.scan_base(spark, base).count() == 8
        assert len([x for x in os.listdir(base) if not x.startswith(".")]) == files.KEEP_VERSIONS
    plain = os.path.join(scratch, "plain")
    spark.range(3).write.parquet(plain)
    files.sink_base(files.scan_base(spark, plain).unionByName(spark.range(1)), plain)
    assert files.scan_base(spark, plain).count() == 4


def test_nan_is_null_everywhere(spark):
    from pliego.operators import filters
    df = spark.createDataFrame([(float("nan"), "nan"), (1.0, "1"), (-1.0, "x"), (2e9, "NaN")], "v double, t string")
    assert [r.v for r in df.where(filters.positive_predicate("v")).collect()] == [1.0, 2e9]
    assert [r.t for r in df.where(filters.positive_predicate("t")).collect()] == ["1"]
    top = max(filters.VALUE_BANDS)
    assert [r.v for r in df.where(filters.value_band_predicate("v", top)).collect()] == [2e9]
    typed = unify.type_columns(df.selectExpr("t AS valor_del_contrato"))
    assert [r.valor_del_contrato for r in typed.collect()] == [None, 1.0, None, None]


def test_versioned_base(spark, scratch):
    base = os.path.join(scratch, "base")
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet").select("event_id", "value")
    upsert_base(spark, ev, base, ["event_id"], ["value"])
    upsert_base(spark, ev.limit(3).withColumn("value", F.lit(-1.0)), base, ["event_id"], ["value"])
    assert latest_version(spark, base) == 2
    cur = read_base(spark, base)
    assert cur.count() == ev.count() and cur.where("value = -1.0").count() == 3


def test_study_sections_and_sink(spark, scratch):
    secs = full_study(contract_view(spark, SF_SMALL))
    assert {"mercado", "anexo", "conclusiones", "por_anio", "demanda_distribuciones"} <= set(secs)
    written = files.sink_report_tables({k: secs[k] for k in ("mercado", "anexo")}, os.path.join(scratch, "rep"))
    assert all(spark.read.parquet(p).count() > 0 for p in written)
    assert secs["anexo"].count() == 50


def test_pick_date_and_required_columns(spark):
    df = spark.createDataFrame([(None, "2024-01-01")], "fecha_inicio string, fecha_de_firma string")
    assert study.pick_date_column(df) == "fecha_de_firma"
    assert quality.required_columns_check(df, ["fecha_inicio", "cuantia"]) == ["cuantia"]


def test_fallback_and_helpers(spark):
    empty = spark.createDataFrame([], "a int")
    other = spark.createDataFrame([(1,)], "a int")
    assert unify.fallback(empty, lambda: other).count() == 1
    assert unify.fallback(None, lambda: other).count() == 1
    t = unify.type_columns(spark.createDataFrame([("Obra Civil", "12,5")],
                                                 "objeto_del_contrato string, valor_del_contrato string"))
    assert t.first()["_busqueda"] == "obra civil"
    assert "_busqueda" not in unify.drop_helper_columns(t).columns
