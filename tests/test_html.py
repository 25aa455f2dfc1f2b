"""HTML extraction on a small results page and a detail page."""

from pliego.sources import html as H

ROWS = [
    ("1", "26-11-14696064", "SAMC 004 DE 2026", "Selección Abreviada", "Celebrado", "ALCALDÍA A", "OBJETO A",
     "Santander : San José de Miranda", "$255.000.000,00", "Fecha de Celebración del Primer Contrato 31-03-2026"),
    ("2", "26-13-14690001", "MC-001-2026", "Mínima Cuantía", "Celebrado", "ALCALDÍA B", "OBJETO B",
     "Santander : Girón", "$94.758.732,00", "Fecha de Celebración del Primer Contrato 12-02-2026"),
    ("3", "26-1-14688888", "LP-002-2026", "Licitación Pública", "Convocado", "GOBERNACIÓN", "OBRAS",
     "Santander : Bucaramanga", "$5.890.000.000,00", "Fecha de Apertura 05-01-2026"),
    ("4", "26-4-14687777", "RE-010-2026", "Régimen Especial", "Liquidado", "UNIVERSIDAD", "EQUIPOS",
     "Santander : Bucaramanga", "$780.250.000,00", "Fecha de Liquidación 20-01-2026"),
    ("5", "26-13-14686666", "MC-045-2026", "Mínima Cuantía", "Celebrado", "ALCALDÍA C", "VIGILANCIA",
     "Santander", "$120.500.000,00", "Fecha de Celebración del Primer Contrato 28-01-2026"),
]


def results_page():
    head = "".join(f"<td>{h}</td>" for h in ["&#8711;", "Número de Proceso", "Tipo", "Estado", "Entidad", "Objeto",
                                              "Ubicación", "Cuantía", "Fecha"])
    body = ""
    for r in ROWS:
        cells = [r[0], f"<a href=\"javascript: consultaProceso('{r[1]}')\">{r[2]}</a>", *r[3:]]
        body += "<tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr>"
    return (f"<html><body><input type=\"hidden\" name=\"totalResultados\" value='5' />"
            f"<table><tr>{head}</tr>{body}<tr><td>pie</td></tr></table></body></html>")


def test_results_page(spark):
    pages = spark.createDataFrame([(1, "u", results_page()), (2, "v", "<html><p>nada</p></html>")],
                                  "page_id long, url string, html string")
    rows = H.extract_result_rows(pages).orderBy("numero_proceso").collect()
    assert len(rows) == 5 and len(rows[0]) == 13
    from pliego.functions.money import parse_money
    from pyspark.sql import functions as F
    vals = sorted(r.v for r in H.extract_result_rows(pages).select(parse_money("cuantia").alias("v")).collect())
    assert vals == sorted([255000000.0, 94758732.0, 5890000000.0, 780250000.0, 120500000.0])
    first = [r for r in rows if r.numero_proceso == "SAMC 004 DE 2026"][0]
    assert first.id_proceso == "26-11-14696064" and first.municipio == "San José de Miranda"
    assert first.fecha_apertura == "31-03-2026" and first.url_detalle.endswith("numConstancia=26-11-14696064")
    last = [r for r in rows if r.numero_proceso == "MC-045-2026"][0]
    assert (last.departamento, last.municipio) == ("Santander", "")
    totals = {r.page_id: r.total_resultados for r in H.result_totals(pages).collect()}
    assert totals == {1: 5, 2: None}
    errors = {r.error: r.paginas for r in H.page_errors(H.table_rows(pages)).collect()}
    assert errors == {"no table": 1}
    assert F is not None


def test_detail_page(spark):
    html = ("<html><body><h2>Detalle del Proceso Número: SAMC 004</h2><p>ALCALDÍA X</p><table>"
            "<tr><td>Objeto a Contratar:</td><td>OBRA</td></tr>"
            "<tr><td>Detalle y Cantidad del Objeto a Contratar</td><td>OTRA</td></tr>"
            "<tr><td>Fecha y Hora de Apertura del Proceso</td><td>24-03-2026 11:30 a.m.</td></tr>"
            "<tr><td>Departamento y Municipio de Ejecución</td><td>Santander : Albania</td></tr>"
            "<tr><td>Cuantía a Contratar</td><td>$1.000,00</td></tr></table></body></html>")
    pages = spark.createDataFrame([(7, "https://x/detalleProceso.do?numConstancia=26-1-9", html)],
                                  "page_id long, url string, html string")
    r = H.extract_detail_records(pages).first()
    assert r.numero_proceso == "SAMC 004" and r.entidad == "ALCALDÍA X"
    assert r.objeto_contrato == "OBRA" and r.fecha_apertura == "24-03-2026"
    assert (r.departamento, r.municipio) == ("Santander", "Albania") and r.id_proceso == "26-1-9"
    assert r.valor_estimado == "$1.000,00" and r.proveedor == ""


def test_generic_table(spark):
    html = ("<table><tr><th>Nombre Cliente</th><th>Saldo ($)</th></tr><tr><td>A</td><td>1</td></tr>"
            "<tr><td> </td><td></td></tr><tr><td>B</td></tr></table>")
    pages = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    rows = sorted(H.extract_generic_rows(pages).collect(), key=lambda r: r.r_idx)
    assert [dict(r.fila) for r in rows] == [{"nombre_cliente": "A", "saldo": "1"}, {"nombre_cliente": "B", "saldo": ""}]


def pages_of(spark, *htmls):
    return spark.createDataFrame([(i, "u", h) for i, h in enumerate(htmls)], "page_id long, url string, html string")


def test_odd_pages(spark):
    empty = "<table><tr><th>Número de Proceso</th></tr></table>"
    odd = ("<table><thead><tr><th>A</th><th>A</th><th>Numero Contrato</th></tr></thead>"
           "<tbody><tr><th>1</th><td>x</td><td>y<table><tr><td>in</td></tr></table></td><td>z</td></tr></tbody></table>")
    pages = pages_of(spark, results_page(), empty, odd, "<p>no</p>")
    assert {r.error: r.paginas for r in H.page_errors(H.table_rows(pages)).collect()} == {"no rows": 1, "no table": 1}
    out = H.combine_pages(pages).collect()
    assert len(out) == 6
    extra = next(r for r in out if r.extra)
    assert {(e.columna, e.valor) for e in extra.extra} >= {("a", "x"), ("a#2", "y in")}


def test_all_pages_failing_is_an_error(spark):
    import pytest

    with pytest.raises(Exception, match="no page has data rows"):
        H.combine_pages(pages_of(spark, "<p>a</p>", "<p>b</p>")).collect()
    assert H.combine_pages(pages_of(spark, "x").limit(0)).collect() == []


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pages_are_parsed_once_per_query(spark):
    pages = pages_of(spark, results_page(), "<p>no</p>")
    assert plan_of(H.page_errors(H.table_rows(pages))).count("MapInPandas") == 1
    assert plan_of(H.extract_result_rows(pages)).count("MapInPandas") == 1


def test_blocks_of_rows_are_bounded():
    import pandas as pd

    html = results_page() + "x" * H._BLOCK_CHARS
    batch = pd.DataFrame({"page_id": [1, 2, 3], "url": "u", "html": html})
    blocks = list(H._parse_pages(iter([batch]), False))
    assert [set(b["page_id"]) for b in blocks] == [{1}, {2}, {3}]
    assert all(t is None for b in blocks for t in b["page_text"])


def test_fast_cells_equal_the_event_parser():
    odd = ("<table class='a b'><thead><tr><th> A &amp; B </th><th>C<br>d</th></tr></thead><tbody><tr><td>x</TD> \n<td>"
           "<a href='u' onclick=\"f('1')\">y</a> z</td><th>r</th></tr><TR><td></td><td>&nbsp;</td></tr></tbody></table>")
    assert H._fast_tables(odd, False) == H._read_tables(odd, False)


def test_equal_page_ids_share_one_choice(spark):
    generic = "<table><tr><td>a</td><td>b</td></tr><tr><td>c</td><td>d</td></tr></table>"
    pages = spark.createDataFrame([(1, "u", results_page()), (1, "v", generic), (None, "w", generic), (None, "x", "<p>no</p>")],
                                  "page_id long, url string, html string")
    rows = H.table_rows(pages)
    assert sorted((r.page_id or 0, r.filas, r.error or "") for r in H.page_results(rows).collect()) == [
        (0, 2, ""), (0, 2, "no table"), (1, 5, ""), (1, 5, "")]
    assert H.extract_result_rows(pages).count() == 5


def test_plain_and_linked_cells_skip_the_slow_path(monkeypatch):
    slow, plain = [], H._fast_cell
    monkeypatch.setattr(H, "_fast_cell", lambda fragment: slow.append(fragment) or plain(fragment))
    page = ("<table><tr><th>A</th><td> b &amp; c </td></tr><tr><td>1</TD><td><a href=\"f('1')&amp;\">P&nbsp;</a></td>"
            "<td><A HREF=\"\">q</A></td><td><a href=\"u\">r</a> s</td></tr></table>")
    (_, rows), = H._fast_tables(page, False)[0]
    assert rows == [("", ["A", "b & c"], ["", ""], [0]), ("", ["1", "P", "q", "r s"], ["", "f('1')&", "", "u"], [])]
    assert slow == ["1</TD>", '<a href="u">r</a> s</td>']
    assert H._fast_tables(page, False) == H._read_tables(page, False)


def test_best_table_is_chosen_where_a_page_is_parsed(spark):
    """Rows of ``landed_rows`` bring their page id's best table, also for ids that come twice; no shuffle chooses it again."""
    head = "<tr><th>x</th><th>Número de Proceso</th></tr>"
    row = "<tr>" + "".join(f"<td>{v}</td>" for v in ("1", "P-1", "t", "e", "ent", "obj", "ASIA : X", "$1", "Fecha 01-02-2003")) + "</tr>"
    table = lambda body, klass="": f"<table class='{klass}'>{body}</table>"
    few, many = table("<tr><td>a</td></tr>"), table("<tr><td>a</td></tr><tr><td>b</td></tr>")
    known, classed = table(head + row), table("<tr><td>c</td></tr>", "x tbl_resulados")
    htmls = [(1, few + many + known), (2, few + many), (3, few), (4, many + classed), (5, "<p>none</p>"), (6, "<table></table>" + few),
             (7, None), (8, many), (8, few + known), (8, "<p>none</p>"), (None, known), (None, many), (9, table("") + table(row))]
    pages = spark.createDataFrame([(i, "u", h) for i, h in htmls], "page_id long, url string, html string").repartition(3)
    rows, plain = H.landed_rows(pages), H.table_rows(pages, with_text=False)
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert same(H.extract_result_rows(pages, rows), H.extract_result_rows(pages, plain))
    assert same(H.extract_generic_rows(pages, rows), H.extract_generic_rows(pages, plain))
    assert same(H.page_results(rows), H.page_results(plain))
    assert H.extract_result_rows(pages, rows).count() == 3
    once = H.landed_rows(pages.where("page_id < 8"))
    plan = H.extract_result_rows(pages, once)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_two_searches_parse_the_pages_once(spark, monkeypatch):
    from pliego.plans import registry

    registry.load_all()
    parsed, plain = [], H._parsed
    monkeypatch.setattr(H, "_parsed", lambda *a, **k: parsed.append(1) or plain(*a, **k))
    assert registry.QUERIES["search_job_rows"](spark, "/root/testdata/sf0.001").count() == 3 and parsed == [1]
