"""Property checks: round trips, idempotence, shares."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pliego.operators import study as S
from pliego.operators.cleaning import clean, normalize_strings
from pliego.plans.contract_view import contract_view
from pliego.plans.fixtures import anglo_money, colombian_money
from pliego.streaming.incremental import upsert

from conftest import SF_SMALL


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(min_value=-10**11, max_value=10**11), min_size=1, max_size=20))
def test_money_render_parse_round_trip(spark, cents):
    from pliego.functions.money import parse_money
    df = spark.createDataFrame([(c / 100.0,) for c in cents], "v double")
    out = df.select("v", parse_money(colombian_money(F.col("v"))).alias("a"),
                    parse_money(anglo_money(F.col("v"))).alias("b")).collect()
    for r in out:
        assert r.a == round(r.v, 2) and r.b == round(r.v, 2)


def test_clean_is_idempotent_on_text(spark):
    d = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text", "lang")
    once = normalize_strings(d)
    twice = normalize_strings(once)
    assert once.exceptAll(twice).count() == 0


def test_upsert_is_idempotent(spark):
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet").select("event_id", "user_id", "ts", "value")
    first = upsert(None, ev, ["user_id"], ["ts", "event_id"]).drop("_lote")
    again = upsert(first.withColumn("_lote", F.lit(0).cast("long")), ev, ["user_id"], ["ts", "event_id"]).drop("_lote")
    assert first.exceptAll(again).count() == 0 and again.exceptAll(first).count() == 0


def test_shares_over_all_categories_sum_to_100(spark):
    cv = contract_view(spark, SF_SMALL)
    d = S.distribution(cv, "modalidad_de_contratacion", top=100)
    assert abs(sum(r.pct_valor for r in d.collect()) - 100.0) < 1e-9


def test_all_null_column_gives_empty_distribution(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0)], "c string, valor_del_contrato double")
    assert S.distribution(df, "c").count() == 0


def test_null_category_is_not_informed(spark):
    df = spark.createDataFrame([(None, 1.0), ("", 2.0), ("x", 3.0)], "c string, valor_del_contrato double")
    cats = {r.categoria for r in S.distribution(df, "c").collect()}
    assert cats == {"No informado", "", "x"}


def test_clean_pipeline_types(spark):
    raw = spark.createDataFrame([
        (" SAMC 1 ", "$255.000.000,00", "31-03-2026"), ("", "", ""), ("x", "sin valor", "2026-03-10")],
        "numero_proceso string, cuantia string, fecha_apertura string")
    rows = clean(raw).orderBy("numero_proceso").collect()
    assert len(rows) == 2
    assert rows[0].cuantia == 255000000.0 and rows[0].fecha_apertura.month == 3
    assert rows[1].cuantia is None and rows[1].fecha_apertura.day == 10


def test_blank_test_on_raw_equals_normalized(spark):
    from pliego.functions.text import normalize_string, normalizes_to_blank
    samples = ["", " ", "\xa0", "\x85", "\x82", "\x01\x02", "\t\n", "　", "a", " \x96 ", None, "\x7f", "\x99"]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    for r in df.select((normalize_string("s") == "").alias("a"), normalizes_to_blank("s").alias("b")).collect():
        assert r.a == r.b
