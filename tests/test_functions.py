"""Golden cases for the scalar functions (worked values of the reference)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pliego.functions import dates as D
from pliego.functions import links as L
from pliego.functions import money as M
from pliego.functions import text as T


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


@pytest.mark.parametrize("text,expected", [
    ("$255.000.000,00", 255000000.0),
    ("$9,062,000.00 Peso Colombiano", 9062000.0),
    ("1.234", 1234.0), ("1,5", 1.5), ("1.234.567", 1234567.0), ("123456.789", 123456789.0),
    ("sin valor", None), ("", None), (None, None), ("-12,50", -12.5), ("Lote-12", -12.0),
])
def test_parse_money(spark, text, expected):
    assert one(spark, M.parse_money(F.lit(text).cast("string"))) == expected


@pytest.mark.parametrize("text,expected", [
    ("31/01/2025", dt.datetime(2025, 1, 31)), ("31-01-2025", dt.datetime(2025, 1, 31)),
    ("2025-01-31", dt.datetime(2025, 1, 31)), ("31/01/2025 14:30", dt.datetime(2025, 1, 31, 14, 30)),
    ("2026-03-10", dt.datetime(2026, 3, 10)), ("2025-01-31T00:00:00.000", dt.datetime(2025, 1, 31)),
    ("2025-1-5", dt.datetime(2025, 1, 5)), ("31/02/2025", None), ("  ", None),
])
def test_parse_date(spark, text, expected):
    assert one(spark, D.parse_date(F.lit(text))) == expected


def test_location_and_labels(spark):
    d, m = T.split_location(F.lit("Santander : San José de Miranda"))
    assert (one(spark, d), one(spark, m)) == ("Santander", "San José de Miranda")
    d, m = T.split_location(F.lit("Santander"))
    assert (one(spark, d), one(spark, m)) == ("Santander", "")
    label, date = T.split_dated_label(F.lit("Fecha de Celebración del Primer Contrato 31-03-2026"))
    assert (one(spark, label), one(spark, date)) == ("Fecha de Celebración del Primer Contrato", "31-03-2026")
    assert one(spark, T.only_date(F.lit("24-03-2026 11:30 a.m."))) == "24-03-2026"
    assert one(spark, T.process_id(F.lit("javascript: consultaProceso('26-11-14696064')"))) == "26-11-14696064"
    assert one(spark, T.id_from_url(F.lit("https://x/a.do?numConstancia=26-1-2"))) == "26-1-2"


def test_normalize_string_unicode(spark):
    s = "  a\x85b\x93c\x94\xa0\xa0d e\n\tf\x01g  　"
    assert one(spark, T.normalize_string(F.lit(s))) == 'a...b"c" d e fg'
    assert one(spark, T.normalize_string(F.lit(None).cast("string"))) == ""


def test_folding(spark):
    assert one(spark, T.fold_collapse(F.lit(" Bogotá   D.C. "))) == "bogota d.c."
    assert one(spark, T.normalize_label(F.lit("Cuantía a Contratar:"))) == "cuantia a contratar"
    assert one(spark, T.normalize_header(F.lit(" Número de Proceso "))) == "número_de_proceso"


@pytest.mark.parametrize("days,expected", [
    (29, "29 DÍAS"), (30, "1 MES (30 días)"), (45, "2 MESES (45 días)"), (75, "2 MESES (75 días)"), (-1, "N/D")])
def test_term_text(spark, days, expected):
    start = F.lit(dt.datetime(2024, 1, 1))
    end = F.lit(dt.datetime(2024, 1, 1) + dt.timedelta(days=days))
    assert one(spark, D.term_text(start, end)) == expected


def test_term_floor_not_calendar(spark):
    start = F.lit(dt.datetime(2024, 1, 1, 12, 0))
    end = F.lit(dt.datetime(2024, 1, 2, 11, 30))
    assert one(spark, D.term_text(start, end)) == "0 DÍAS"


def test_money_and_percent_text(spark):
    assert one(spark, M.money_text(F.lit(1092848668.0))) == "$1.092.848.668"
    assert one(spark, M.money_text(F.lit(None).cast("double"))) == "N/D"
    assert one(spark, M.percent_text(F.lit(1234.56))) == "1.234,6%"


@pytest.mark.parametrize("cv,word", [(14.9, "baja"), (15.0, "moderada"), (39.9, "moderada"), (40.0, "alta")])
def test_dispersion(spark, cv, word):
    assert word in one(spark, L.dispersion_reading(F.lit(cv)))


def test_process_link(spark):
    assert one(spark, L.process_link(F.lit("{'url': 'https://a/b'}"))) == "https://a/b"
    assert one(spark, L.process_link(F.lit("nan"))) == "N/D"
    assert one(spark, L.process_link(F.lit("https://c"))) == "https://c"


def test_dates_of_last_resort(spark):
    """Golden cases: what the eight layouts leave to inference."""
    import datetime as dt

    from pliego.functions.dates import parse_date
    d = lambda *x: dt.datetime(*x)
    want = {
        "31/01/25": d(2025, 1, 31), "01/31/25": d(2025, 1, 31), "3/4/25": d(2025, 4, 3), "31-Jan-25": d(2025, 1, 31),
        "31 Jan 2025": d(2025, 1, 31), "Jan 31, 2025": d(2025, 1, 31), "January 31 2025": d(2025, 1, 31), "31.01.2025": d(2025, 1, 31),
        "20250131": d(2025, 1, 31), "2025-01-31 14:30": d(2025, 1, 31, 14, 30), "2025/10/03": d(2025, 3, 10),
        "2025/10/03 14:30": d(2025, 3, 10, 14, 30), "01/2025": d(2025, 1, 1), "2025-01": d(2025, 1, 1), "2025": d(2025, 1, 1),
        "Jan 2025": d(2025, 1, 1), "31/01/2025 02:30 PM": d(2025, 1, 31, 14, 30), "01/31/2025": d(2025, 1, 31), "01-31-2025": d(2025, 1, 31),
        "01/31/2025 14:30": d(2025, 1, 31, 14, 30), "13/13/2025": None, "2025-13-01": None, "2025-31-01": None, "Sept 5, 2024": d(2024, 9, 5),
        "5-sep-24": d(2024, 9, 5), "March 5th, 2024": d(2024, 3, 5), "Friday, January 31, 2025": d(2025, 1, 31), "2025-1-5 3:04": d(2025, 1, 5, 3, 4),
        "3/4/2025 3:04:05 pm": d(2025, 4, 3, 15, 4, 5), "12 Dec 1999 23:59:59": d(1999, 12, 12, 23, 59, 59), "2025-Jan-31": d(2025, 1, 31),
        "Jan-31-2025": d(2025, 1, 31), "1 May 2024 12 AM": d(2024, 5, 1), "texto": None, "N/A": None, "0": None, "31": None, "31/01": None,
        "2024-02-30": None, "30/02/2024": None, "30/02/24": None, "1/2/3": d(2003, 2, 1), "99/01/02": d(1999, 2, 1), "2025 01 31": d(2025, 1, 31),
        "310125": d(2025, 1, 31), "25-01-31": d(2031, 1, 25), "14/7/2025 9:5": d(2025, 7, 14, 9, 5), "2025-07-14 9:05 PM": d(2025, 7, 14, 21, 5),
        # Spanish names
        "31 de enero de 2025": d(2025, 1, 31), "5 agosto 2024": d(2024, 8, 5), "Mayo 5 2024": d(2024, 5, 5), "enero 2025": d(2025, 1, 1),
        "viernes, 31 de ene de 2025": d(2025, 1, 31), "31/12/2024 11:05 p. m.": d(2024, 12, 31, 23, 5),
        # no dates
        "": None, "hoy": None, "12:30": None, "2025-01-31T10:00:00Z": None, "lote 5 2024": None, "5 enero 2024 x": None,
    }
    rows = spark.createDataFrame([(k,) for k in want], "s string").repartition(2)
    got = {r.s: r.d for r in rows.select("s", parse_date("s").alias("d")).collect()}
    assert {k: v for k, v in got.items() if v != want[k]} == {}


def test_fold_and_label_equal_the_letter_table(spark):
    from pliego.functions import text as T

    odd = ["ÁÉÍÓÚÜÑ áéíóúüñ", " İΣ ς ß\x85_9\x1f", "  a\t-\xa0b ", "", None, "plain TEXT", "😀ñ\x00x"]
    df = spark.createDataFrame([(t,) for t in odd], "t string")
    table = F.lower(F.translate("t", T.ACCENTED, T.UNACCENTED))
    kept = F.regexp_replace(T.strip_ws(table), "[^a-z0-9" + T.WS[1:], " ")
    got = df.select(table.alias("a"), T.fold("t").alias("b"), T.collapse_ws(kept).alias("c"), T.normalize_label("t").alias("d"))
    assert all(r.a == r.b and r.c == r.d for r in got.collect())
    plan = df.select(T.normalize_label("t").alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert "translate(" not in plan and plan.count("regexp_replace(") == 1


def test_the_last_resort_is_for_text_with_a_digit(spark):
    from pliego.functions.dates import parse_date

    df = spark.createDataFrame([("",), ("sin fecha",), ("3 de mayo de 2025",)], "t string").select(parse_date("t").alias("d"))
    assert [r.d is not None for r in df.collect()] == [False, False, True]
    assert ", [0-9])" in df._jdf.queryExecution().analyzed().toString()
