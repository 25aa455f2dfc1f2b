"""HTML extraction of landed portal pages.

Parsing HTML is the one step Spark has no built-in for: a small stdlib
``html.parser`` helper runs inside ``mapInPandas`` and emits one row per
table row (cell texts and link attributes). Everything after that — table
choice, header/row filters, positional mapping, derived fields, label->field
mapping, first-value-wins and pivot — is DataFrame work.
"""

from __future__ import annotations

import re
import sys
import uuid
from collections.abc import Iterator
from functools import reduce
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pliego.session import bounded_batches, frozen, scratch_path, written_to

from pliego.functions.text import (detail_url, header_entity, header_number, id_from_url, normalize_header,
                                   normalize_label, only_date, process_id, split_dated_label, split_location,
                                   strip_ws)
from pliego.operators.filters import result_row_predicate
from pliego.schemas import DETAIL_COLUMNS, RESULT_COLUMNS, RESULT_TABLE_POSITIONS

# ---- fixed values (must equal the reference's) -------------------------------
RESULT_HEADER_KEYS = ("número de proceso", "numero de proceso")
RESULT_TABLE_CLASS = "tbl_resulados"
TOTAL_INPUT = r"(?i)name=['\"]totalResultados['\"]\s+value=['\"](\d+)['\"]"
TOTAL_TEXT = r"(?i)([\d.,]+)\s*registros\s+encontrados"
# Detail page labels (already normalized) -> record field.
DETAIL_LABELS = {
    "tipo de proceso": "modalidad",
    "modalidad de contratacion": "modalidad",
    "estado del proceso": "estado",
    "detalle y cantidad del objeto a contratar": "objeto_contrato",
    "objeto a contratar": "objeto_contrato",
    "cuantia a contratar": "valor_estimado",
    "presupuesto oficial": "valor_estimado",
    "fecha y hora de apertura del proceso": "fecha_apertura",
    "fecha de apertura del proceso": "fecha_apertura",
    "fecha y hora de cierre del proceso": "fecha_cierre",
    "fecha de cierre del proceso": "fecha_cierre",
    "numero del contrato": "numero_contrato",
    "objeto del contrato": "objeto_contrato",
    "estado del contrato": "estado_contrato",
    "tipo de contrato": "tipo_contrato",
    "cuantia definitiva del contrato": "valor_contrato",
    "valor total del contrato": "valor_contrato",
    "fecha de firma del contrato": "fecha_adjudicacion",
    "fecha de adjudicacion": "fecha_adjudicacion",
    "valor adjudicado": "valor_adjudicado",
    "nombre o razon social del contratista": "proveedor",
    "nombre del contratista": "proveedor",
    "identificacion del contratista": "nit_proveedor",
    "departamento y municipio de ejecucion": "_ubicacion",
}
DATE_FIELDS = ("fecha_apertura", "fecha_cierre", "fecha_adjudicacion")
# -----------------------------------------------------------------------------

# The parser below runs in Python workers. Pickling this module by value ships
# its code with each task, so executors need nothing but pandas installed.
try:
    from pyspark import cloudpickle as _cloudpickle
    _cloudpickle.register_pickle_by_value(sys.modules[__name__])
except Exception:  # noqa: BLE001 - older cloudpickle: the package must be importable on workers
    pass

ROWS_SCHEMA = ("page_id long, url string, t_idx int, t_class string, t_rows int, t_first string, "
               "r_idx int, has_th boolean, cells array<string>, links array<string>, tds array<string>, "
               "heads array<string>, in_body boolean, page_text string, error string, b_idx int, b_head boolean")


class _TableReader(HTMLParser):
    """Collects tables -> rows -> cells (text as ``get_text(' ', strip=True)``)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables: list[dict] = []
        self.stack: list[dict] = []
        self.outer: list[tuple] = []    # row, cell and part of the tables around this one
        self.row = None
        self.cell = None
        self.part = ""
        self.text: list[str] = []
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in ("script", "style"):
            self.skip += 1
        elif tag == "table":
            t = {"class": a.get("class") or "", "rows": []}
            self.tables.append(t)
            self.stack.append(t)
            self.outer.append((self.row, self.cell, self.part))
            self.row, self.cell, self.part = None, None, ""
        elif tag in ("thead", "tbody", "tfoot") and self.stack:
            self.part = tag
        elif tag == "tr" and self.stack:
            self.row = {"cells": [], "links": [], "th": False, "part": self.part}
            self.stack[-1]["rows"].append(self.row)
        elif tag in ("td", "th") and self.row is not None:
            self.row["th"] = self.row["th"] or tag == "th"
            self.cell = {"text": [], "links": [], "th": tag == "th"}
            self.row["cells"].append(self.cell)
        elif tag == "a" and self.cell is not None:
            link = " ".join(v for v in (a.get("href"), a.get("onclick")) if v)
            for cell in self._open_cells():
                cell["links"].append(link)
        elif tag == "br":
            self.text.append("\n")

    def _open_cells(self):
        """The innermost cell and the cells of outer tables that hold it."""
        if self.cell is not None:
            yield self.cell
        for _, cell, _ in self.outer:
            if cell is not None:
                yield cell

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag == "table" and self.stack:
            self.stack.pop()
            self.row, self.cell, self.part = self.outer.pop()
        elif tag in ("thead", "tbody", "tfoot"):
            self.part = ""
        elif tag in ("td", "th"):
            self.cell = None
        elif tag == "tr":
            self.row = None
        elif tag in ("p", "div", "h1", "h2", "h3", "li", "tr", "td", "th", "title"):
            self.text.append("\n")

    def handle_data(self, data):
        if self.skip:
            return
        for cell in self._open_cells():
            cell["text"].append(data)
        self.text.append(data)
        self.text.append("\n")


def _cell_text(parts: list[str]) -> str:
    return " ".join(p.strip() for p in parts if p.strip())


# Regex tokenizer for flat (non-nested) tables: the common case, several times
# faster than the event parser. Pages with nested tables use ``_TableReader``.
_DROP = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->", re.S | re.I)
# Up to a closing or opening tag: runs without "<" and other tags, never given back.
_TABLE = re.compile(r"<table\b([^>]*)>([^<]*+(?:<(?!/table\s*>)[^<]*+)*+)</table\s*>", re.I)
_PART = re.compile(r"<(thead|tbody|tfoot)\b[^>]*>", re.I)
_TR = re.compile(r"<tr\b[^>]*>([^<]*+(?:<(?!tr\b|/tbody|/thead|/tfoot)[^<]*+)*+)", re.I)
_CELL = re.compile(r"<(td|th)\b[^>]*>([^<]*+(?:<(?!td\b|th\b|/tr)[^<]*+)*+)", re.I)
_NESTED = re.compile(r"<table\b", re.I)
_TAG = re.compile(r"<[^>]*>")
_A = re.compile(r"<a\b([^>]*)>", re.I)
_ATTR = re.compile(r"""(href|onclick)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_CLASS = re.compile(r"""class\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)


def _nodes(fragment: str) -> list[str]:
    return [unescape(t) for t in _TAG.sub("\x00", fragment).split("\x00")]


def _links(fragment: str) -> str:
    out = []
    for a in _A.finditer(fragment):
        attrs = {m.group(1).lower(): next(g for g in m.groups()[1:] if g is not None) for m in _ATTR.finditer(a.group(1))}
        out.append(" ".join(unescape(v) for v in (attrs.get("href"), attrs.get("onclick")) if v))
    return " ".join(out)


#: What follows the text of a plain cell, and a cell that holds one link and nothing else.
_CLOSED = frozenset(("</td>", "</th>"))
_ONE_LINK = re.compile(r'<a\s+href="([^"<>]*+)"\s*+>([^<]*+)</a></td>', re.I)


def _fast_cell(fragment: str) -> tuple[str, str]:
    """(text, links) of a cell; most hold plain text up to their closing tag."""
    at = fragment.find("<")
    if "\x00" not in fragment and (at < 0 or fragment[at:].rstrip().lower() in ("</td>", "</th>")):
        return unescape(fragment[:at] if at >= 0 else fragment).strip(), ""
    return _cell_text(_nodes(fragment)), _links(fragment)


def _fast_tables(html: str, with_text: bool):
    """(tables, page_text) or None when the page has nested tables; a row is (part, its cells' texts, their links, which are th)."""
    body = _DROP.sub("", html)
    tables, plain = [], "\x00" not in body
    for m in _TABLE.finditer(body):
        inner = m.group(2)
        if _NESTED.search(inner):
            return None
        cm = _CLASS.search(m.group(1))
        klass = unescape(next((g for g in cm.groups() if g is not None), "")) if cm else ""
        rows, parts, part = [], [(p.start(), p.group(1).lower()) for p in _PART.finditer(inner)], 0
        for tr in _TR.finditer(inner):
            while part < len(parts) and parts[part][0] < tr.start():
                part += 1
            texts, links, ths = [], [], []
            for tag, fragment in _CELL.findall(tr.group(1)):
                at = fragment.find("<")
                if plain and (at < 0 or fragment[at:] in _CLOSED):
                    text, link = unescape(fragment[:at] if at >= 0 else fragment).strip(), ""
                elif plain and (one := _ONE_LINK.fullmatch(fragment)):
                    link, text = unescape(one[1]), unescape(one[2]).strip()
                else:
                    text, link = _fast_cell(fragment)
                if tag[1] in "hH":
                    ths.append(len(texts))
                texts.append(text)
                links.append(link)
            rows.append((parts[part - 1][1] if part else "", texts, links, ths))
        tables.append((klass, rows))
    return tables, "\n".join(t.strip() for t in _nodes(body) if t.strip()) if with_text else None


def _read_tables(html: str, with_text: bool):
    """The same from the event parser."""
    reader = _TableReader()
    reader.feed(html)
    reader.close()
    tables = [(t["class"], [(r["part"], [_cell_text(c["text"]) for c in r["cells"]], [" ".join(c["links"]) for c in r["cells"]],
                             [i for i, c in enumerate(r["cells"]) if c["th"]]) for r in t["rows"]]) for t in reader.tables]
    return tables, "\n".join(ln.strip() for ln in "".join(reader.text).split("\n") if ln.strip()) if with_text else None


#: Characters of pages whose rows go out together: a task holds one such block, whatever the pages' size.
_BLOCK_CHARS = 1 << 20
_NO_TABLE = (None,) * 10


def _page_rows(page_id, url, html: str, with_text: bool) -> Iterator[tuple]:
    try:
        tables, page_text = _fast_tables(html, with_text) or _read_tables(html, with_text)
    except Exception as exc:  # noqa: BLE001 - a bad page is reported, not fatal
        yield page_id, url, -1, *_NO_TABLE, None, str(exc), _NO_BEST, False
        return
    firsts = [" ".join(rows[0][1]).lower() if rows else "" for _, rows in tables]
    best, in_header = _page_best(tables, firsts)
    yield page_id, url, -1, *_NO_TABLE, page_text, None if tables else "no table", best, in_header
    for ti, (klass, rows) in enumerate(tables):
        parts = {part for part, _, _, _ in rows}
        # header cells: those of the head if there is one, else all; data rows: those of the body if there is one
        head, body, n = "thead" in parts, "tbody" in parts, len(rows)
        heads = [texts[i] for part, texts, _, ths in rows if part == "thead" or not head for i in ths]
        for ri, (part, texts, links, ths) in enumerate(rows):
            yield (page_id, url, ti, klass, n, firsts[ti], ri, bool(ths), texts, links, _without(texts, ths) if ths else None,
                   heads if ri == 0 else None, part == "tbody" or not body, None, None, best, in_header)


#: ``b_idx`` of a page without a row in a table.
_NO_BEST = -2


def _page_best(tables: list[tuple], firsts: list[str]) -> tuple[int, bool]:
    """``_best_table`` within one page: (its index, whether it has the header)."""
    ranks = []
    for i, ((klass, rows), first) in enumerate(zip(tables, firsts)):
        n = len(rows)
        if n:
            p = (1 if any(k in first for k in RESULT_HEADER_KEYS) else 2 if RESULT_TABLE_CLASS in klass.split(" ")
                 else 3 if n > 1 else 4)
            ranks.append((p, -n if p == 3 else 0, i))
    if not ranks:
        return _NO_BEST, False
    p, _, i = min(ranks)
    return i, p == 1


def _without(texts: list[str], places: list[int]) -> list[str]:
    left = set(places)
    return [text for i, text in enumerate(texts) if i not in left]


def _parse_pages(batches: Iterator[pd.DataFrame], with_text: bool) -> Iterator[pd.DataFrame]:
    names = [f.split(" ")[0] for f in ROWS_SCHEMA.split(", ")]
    for pdf in batches:
        rows, size = [], 0
        for page_id, url, html in zip(pdf["page_id"], pdf["url"], pdf["html"]):
            rows.extend(_page_rows(page_id, url, html or "", with_text))
            size += len(html or "")
            if size >= _BLOCK_CHARS:
                yield pd.DataFrame(rows, columns=names)
                rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=names)


def _parsed(pages: DataFrame, with_text: bool) -> DataFrame:
    p = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    bounded_batches(p.sparkSession)
    return p.mapInPandas(lambda batches: _parse_pages(batches, with_text), ROWS_SCHEMA)


def _with_tds(rows: DataFrame) -> DataFrame:
    return rows.withColumn("tds", F.coalesce("tds", "cells"))   # rows without row headers come without a second copy


def table_rows(pages: DataFrame, with_text: bool = True) -> DataFrame:
    """One row per HTML table row (plus one row per page, with its text if asked, and the error of a page without tables)."""
    return _with_tds(_parsed(pages, with_text))


def landed_rows(pages: DataFrame) -> DataFrame:
    """The rows of ``table_rows``, without the pages' texts, written once, with the best table of their page id.

    The parser has chosen the best table of its page; only the rows of ids that come more than once meet to
    choose among all tables of the id. So readers of these rows need no shuffle to choose a table."""
    rows = _with_tds(frozen(_parsed(pages, False).drop("url", "page_text"), "table-rows"))
    once = rows.withColumnsRenamed({"b_idx": "page_best", "b_head": "page_head"})
    ids = rows.where("t_idx = -1").groupBy(F.col("page_id").alias("_id")).agg(F.count(F.lit(1)).alias("_n"))
    twice = written_to(ids.where("_n > 1").select("_id"), scratch_path(rows.sparkSession, f"ids-{uuid.uuid4().hex}"))
    if twice.isEmpty():
        return once
    same = F.col("page_id").eqNullSafe(F.col("_id"))
    best = F.min(_best_table()).over(Window.partitionBy("page_id"))
    again = rows.join(twice, same, "left_semi").withColumn("_best", best).select(
        *rows.drop("b_idx", "b_head").columns, F.coalesce("_best.i", F.lit(_NO_BEST)).alias("page_best"),
        F.coalesce("_best.h", F.lit(False)).alias("page_head"))
    return once.join(twice, same, "left_anti").unionByName(again)


def _in_header():
    return reduce(lambda a, b: a | b, [F.col("t_first").contains(k) for k in RESULT_HEADER_KEYS])


def _best_table():
    """Per page: the table with header 'Número de Proceso', else with the known CSS class, else the
    largest with more than one row, else the first. Over columns of one row: t_idx, t_rows, header, t_class."""
    klass = F.array_contains(F.split(F.coalesce("t_class", F.lit("")), " "), RESULT_TABLE_CLASS)
    prio = (F.when(_in_header(), F.lit(1)).when(klass, F.lit(2)).when(F.col("t_rows") > 1, F.lit(3)).otherwise(F.lit(4)))
    tie = F.when(prio == 3, -F.col("t_rows")).otherwise(F.lit(0))
    return F.when(F.col("t_idx") >= 0, F.struct(prio.alias("p"), tie.alias("r"), F.col("t_idx").alias("i"), _in_header().alias("h")))


def _result_data():
    """F17 on a row of a result table."""
    return ~F.col("has_th") & result_row_predicate("cells")


def _generic_data():
    """A data row of a table of unknown layout."""
    return F.col("in_body") & (F.size("tds") > 0) & F.exists("tds", lambda x: x != "")


def _table_choice(rows: DataFrame, *columns: str) -> DataFrame:
    """The rows of every page's best table with ``columns`` and ``is_result_table``. A window over one page's
    rows (bounded by the page size), so the parsed rows are read once; the table's own texts stay out of it. The
    rows of ``landed_rows`` know their best table and are not shuffled."""
    if "page_best" in rows.columns:
        return rows.where((F.col("t_idx") >= 0) & (F.col("t_idx") == F.col("page_best"))).select(
            "page_id", "t_idx", *columns, F.col("page_head").alias("is_result_table"))
    t = rows.where(F.col("t_idx") >= 0).select("page_id", "t_idx", *columns, _best_table().alias("_best"))
    t = t.withColumn("_best", F.min("_best").over(Window.partitionBy("page_id")))
    return t.where(F.col("t_idx") == F.col("_best.i")).select("page_id", "t_idx", *columns, F.col("_best.h").alias("is_result_table"))


def extract_result_rows(pages: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """S5 (+F17, C11-C15): result-table rows -> the 12 result columns (+page_id).

    A table with the header is better than any without, so the window over a page needs the data rows
    and the first row of each such table."""
    rows = rows if rows is not None else table_rows(pages, with_text=False)
    r = rows.withColumn("_data", F.coalesce(_result_data(), F.lit(False))).where(F.col("_data") | (_in_header() & (F.col("r_idx") == 0)))
    r = _table_choice(r, "_data", "cells", "links").where("is_result_table AND _data")
    cell = {name: strip_ws(F.get(F.col("cells"), i)) for i, name in RESULT_TABLE_POSITIONS.items()}
    dept, town = split_location(cell["ubicacion_ejecucion"])
    label, date = split_dated_label(cell["fecha_texto"])
    pid = process_id(F.get(F.col("links"), 1))
    out = r.select(
        "page_id",
        cell["numero_proceso"].alias("numero_proceso"), pid.alias("id_proceso"), cell["entidad"].alias("entidad"),
        cell["objeto_contrato"].alias("objeto_contrato"), cell["modalidad"].alias("modalidad"),
        cell["estado"].alias("estado"), dept.alias("departamento"), town.alias("municipio"),
        cell["cuantia"].alias("cuantia"), date.alias("fecha_apertura"), label.alias("fecha_etiqueta"),
        detail_url(pid).alias("url_detalle"))
    return out.select("page_id", *RESULT_COLUMNS)


def extract_generic_rows(pages: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Fallback for a chosen table of unknown layout -> map(column -> value).

    Headers come from the table head's ``th`` cells (normalized; a name that
    comes again gets ``#2``, ``#3``, ...), else ``col_i``; values are the rows'
    ``td`` cells, so row headers are left out and their rows kept; rows are
    padded/truncated to the first data row's width; blank rows dropped.
    Windows run over one page's rows."""
    rows = rows if rows is not None else table_rows(pages, with_text=False)
    # of a result table the first row says that the page has one
    rows = rows.where(~F.coalesce(_in_header(), F.lit(False)) | (F.col("r_idx") == 0))
    r = _table_choice(rows, "r_idx", "tds", "heads", "in_body").where(~F.col("is_result_table"))
    page, data_row = Window.partitionBy("page_id"), _generic_data()
    first_data = F.min(F.when(data_row, F.struct("r_idx", F.size("tds").alias("w")))).over(page)
    d = (r.withColumn("_h", F.max("heads").over(page)).withColumn("_f", first_data).where(data_row)
         .withColumn("_n", F.transform(F.coalesce("_h", F.array().cast("array<string>")), lambda x: normalize_header(x)))
         .withColumn("_width", F.col("_f.w")))
    before = lambda x, i: F.size(F.filter(F.slice(F.col("_n"), F.lit(1), i), lambda y: y == x))
    unique = F.transform(F.col("_n"), lambda x, i: F.when(before(x, i) == 0, x).otherwise(
        F.concat(x, F.lit("#"), (before(x, i) + 1).cast("string"))))
    names = F.when(F.size("_n") == F.col("_width"), unique).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("_width") - 1), lambda i: F.concat(F.lit("col_"), i.cast("string"))))
    padded = F.transform(F.sequence(F.lit(0), F.col("_width") - 1),
                         lambda i: F.coalesce(F.get(F.col("tds"), i), F.lit("")))
    return d.select("page_id", "r_idx", F.map_from_arrays(names, padded).alias("fila"))


def result_totals(pages: DataFrame) -> DataFrame:
    """Declared total of matches (hidden input, else 'N registros encontrados')."""
    h = F.coalesce(F.col("html"), F.lit(""))
    hidden = F.regexp_extract(h, TOTAL_INPUT, 1)
    text = F.regexp_replace(F.regexp_extract(h, TOTAL_TEXT, 1), "[.,]", "")
    total = F.when(hidden != "", hidden.try_cast("long")).otherwise(
        F.when(text.rlike(r"^\d+$"), text.try_cast("long")))
    return pages.select("page_id", total.alias("total_resultados"))


def page_results(rows: DataFrame) -> DataFrame:
    """One row per page: its data rows and, if it has none, why (``no table``, ``no rows`` or the parser's error).

    A row needs only its table's rank and whether it holds data, so that is what the tasks pass on."""
    page = Window.partitionBy("page_id")
    flag = lambda c: F.coalesce(c, F.lit(False))
    if "page_best" in rows.columns:
        data = F.when(F.col("page_head"), flag(_result_data())).otherwise(flag(_generic_data()))
        marks = rows.select("page_id", "t_idx", "error", ((F.col("t_idx") == F.col("page_best")) & data).alias("_data"))
        counted = marks.where((F.col("t_idx") == -1) | F.col("_data")).withColumn("filas", F.count_if("_data").over(page))
        return _pages_with_error(counted)
    marks = rows.select("page_id", "t_idx", "error", _best_table().alias("_best"), flag(_result_data()).alias("_known"),
                        flag(_generic_data()).alias("_other"))
    data = F.when(F.col("_best.h"), F.col("_known")).otherwise(F.col("_other"))
    counted = marks.withColumn("_best", F.min("_best").over(page)).withColumn(
        "filas", F.count_if(data & (F.col("t_idx") == F.col("_best.i"))).over(page))
    return _pages_with_error(counted)


def _pages_with_error(counted: DataFrame) -> DataFrame:
    return counted.where(F.col("t_idx") == -1).select(
        "page_id", "filas", F.coalesce("error", F.when(F.col("filas") == 0, F.lit("no rows"))).alias("error"))


def page_errors(rows: DataFrame) -> DataFrame:
    """Pages without data per kind of error (pages are skipped, not fatal)."""
    return page_results(rows).where(F.col("error").isNotNull()).groupBy("error").agg(F.count(F.lit(1)).alias("paginas"))


EXTRA = "array<struct<columna:string,valor:string>>"


def combine_pages(pages: DataFrame) -> DataFrame:
    """S10 + U2: the data rows of all pages that have any, exact duplicates removed.

    Rows of pages of unknown layout stay: fields with a result column's name go
    there, all others to ``extra`` (sorted by name; empty for result pages).
    If there are pages and none has a data row, reading the result fails.

    Parsing is the costly part, so the parsed rows are written once and read by
    the three readers."""
    rows = landed_rows(pages)
    known = extract_result_rows(pages, rows).drop("page_id").withColumn("extra", F.array().cast(EXTRA))
    field = F.col("fila")
    other = F.array_sort(F.map_entries(F.map_filter(field, lambda k, v: ~k.isin(*RESULT_COLUMNS))))
    generic = extract_generic_rows(pages, rows).select(
        *[F.element_at(field, c).alias(c) for c in RESULT_COLUMNS], other.cast(EXTRA).alias("extra"))
    usable = page_results(rows).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("filas") > 0).alias("ok"))
    failed = F.when((F.col("n") > 0) & (F.col("ok") == 0),
                    F.raise_error(F.concat(F.lit("no page has data rows, of "), F.col("n").cast("string"))).cast("string"))
    check = usable.select(failed.alias("_e")).where(F.col("_e").isNotNull()).select(
        *[F.lit(None).cast("string").alias(c) for c in RESULT_COLUMNS], F.array().cast(EXTRA).alias("extra"))
    # dealt out before they are compared: few rows are equal, so comparing them in the scan would fill its memory for nothing
    found = known.unionByName(generic)
    return found.repartition(*found.columns).dropDuplicates().unionByName(check)


def extract_detail_records(pages: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """S7 (+J6, W6, S8): detail pages -> one 20-field record per page.

    Label/value rows are mapped through the broadcast label table; one
    aggregate per page keeps the first occurrence of every field (``min_by``
    over the row position) and the header text, so the parsed rows are read
    once. Dates keep only the date part."""
    spark = pages.sparkSession
    rows = rows if rows is not None else table_rows(pages)
    labels = F.broadcast(spark.createDataFrame(list(DETAIL_LABELS.items()), "etiqueta string, campo string"))
    pair = (F.col("t_idx") >= 0) & (F.size("cells") >= 2)
    r = rows.select("page_id", "url", "t_idx", "r_idx",
                    F.when(F.col("t_idx") == -1, header_number("page_text")).alias("_number"),
                    F.when(F.col("t_idx") == -1, header_entity("page_text")).alias("_entity"),
                    F.when(pair, normalize_label(F.get(F.col("cells"), 0))).alias("etiqueta"),
                    F.when(pair, strip_ws(F.get(F.col("cells"), 1))).alias("valor"))
    r = r.join(labels, "etiqueta", "left")
    r = r.withColumn("valor", F.when(F.col("campo").isin(*DATE_FIELDS), only_date("valor")).otherwise(F.col("valor")))
    usable = F.col("campo").isNotNull() & (F.col("etiqueta") != "") & F.coalesce(F.col("valor") != "", F.lit(False))
    pos = F.struct("t_idx", "r_idx")
    fields = sorted({v for v in DETAIL_LABELS.values()})
    # the header is read in the scan: page text takes no part in the join and the aggregate
    aggs = [F.max("_number").alias("_number"), F.max("_entity").alias("_entity"), F.max("url").alias("url")]
    for f in fields:
        hit = usable & (F.col("campo") == f)
        aggs.append(F.min_by(F.when(hit, F.col("valor")), F.when(hit, pos)).alias(f"_f_{f}"))
    per_page = r.groupBy("page_id").agg(*aggs)
    dept, town = split_location(F.col("_f__ubicacion"))
    cols = {c: F.coalesce(F.col(f"_f_{c}"), F.lit("")) for c in fields if c != "_ubicacion"}
    rec = per_page.withColumns(cols).withColumns({
        "departamento": F.coalesce(F.when(F.col("_f__ubicacion").isNotNull(), dept), F.lit("")),
        "municipio": F.coalesce(F.when(F.col("_f__ubicacion").isNotNull(), town), F.lit("")),
        "numero_proceso": F.coalesce("_number", F.lit("")), "entidad": F.coalesce("_entity", F.lit("")),
        "id_proceso": id_from_url("url"), "url_detalle": F.col("url")})
    for c in DETAIL_COLUMNS:
        if c not in rec.columns:
            rec = rec.withColumn(c, F.lit(""))
    # Keep records that have a process number or an object.
    rec = rec.where((F.col("numero_proceso") != "") | (F.col("objeto_contrato") != ""))
    return rec.select("page_id", *DETAIL_COLUMNS)
