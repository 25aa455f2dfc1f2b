"""Date parsing, calendar parts, contract term text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pliego.functions.text import strip_ws

__all__ = ["DATE_PATTERNS", "MONTH_NAMES", "parse_date", "parse_stripped_date", "infer_date", "with_date", "elapsed_days", "term_text",
           "month_name", "year_of", "month_of", "parse_filter_date"]

# ---- fixed values -------------------------------------------------------------
# The eight accepted layouts, tried in this order (day-first before ISO).
# Single-letter fields accept one or two digits, as strptime's %d/%m/%H do.
DATE_PATTERNS = [
    "d/M/yyyy",
    "d-M-yyyy",
    "yyyy-M-d",
    "d/M/yyyy H:m",
    "d/M/yyyy H:m:s",
    "yyyy-M-d'T'H:m:s.SSSSSS",
    "yyyy-M-d'T'H:m:s.SSS",
    "yyyy-M-d'T'H:m:s",
    "yyyy-M-d H:m:s",
]
MONTH_NAMES = ["Enero", "Febrero", "Marzo", "Abril", "Mayo", "Junio", "Julio",
               "Agosto", "Septiembre", "Octubre", "Noviembre", "Diciembre"]
SECONDS_PER_DAY = 86400
# Month names of the last resort: Spanish and English, whole or cut to three letters (and "sept").
ENGLISH_MONTHS = ["January", "February", "March", "April", "May", "June", "July",
                  "August", "September", "October", "November", "December"]
# Words that say nothing about the date: weekdays, ordinal endings and "of".
DATE_FILLERS = ("lunes martes miércoles miercoles jueves viernes sábado sabado domingo "
                "monday tuesday wednesday thursday friday saturday sunday mon tue tues wed thu thur thurs fri sat sun "
                "de del of the st nd rd th").split()
# -----------------------------------------------------------------------------


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def parse_date(col) -> Column:
    """First layout that parses the stripped text -> timestamp_ntz, else the
    last resort (``infer_date``), else null.

    Timestamps and dates pass through. Cells that stay null are counted by
    ``conversion_failures``.
    """
    return parse_stripped_date(strip_ws(_c(col).cast("string")))


# Each layout only applies to text of its shape, so shapes pick the layout and
# a value is handed to at most two parsers (a failed parse is costly).
_SHAPES = [
    (r"^\d{1,2}/\d{1,2}/\d{4}$", ["d/M/yyyy"]),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", ["d-M-yyyy"]),
    (r"^\d{4}-\d{1,2}-\d{1,2}$", ["yyyy-M-d"]),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}$", ["d/M/yyyy H:m"]),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}:\d{1,2}$", ["d/M/yyyy H:m:s"]),
    (r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}\.\d+$", ["yyyy-M-d'T'H:m:s.SSSSSS", "yyyy-M-d'T'H:m:s.SSS"]),
    (r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}$", ["yyyy-M-d'T'H:m:s"]),
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$", ["yyyy-M-d H:m:s"]),
    # timestamps written out by Spark: any number of fractional digits
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}\.\d{1,9}$", ["yyyy-M-d H:m:s.SSSSSSSSS"]),
    (r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}$", ["yyyy-M-d'T'H:m"]),
]


def parse_stripped_date(s) -> Column:
    """C5 on text already stripped (used by the staged ``with_date``)."""
    s = _c(s)
    out = F.lit(None).cast("timestamp")
    for shape, patterns in reversed(_SHAPES):
        out = F.when(s.rlike(shape), F.coalesce(*[F.try_to_timestamp(s, F.lit(p)) for p in patterns])).otherwise(out)
    return F.coalesce(out.cast("timestamp_ntz"), F.when(s.rlike("[0-9]"), infer_date(s)))   # no date without a digit


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _months() -> Column:
    names: dict[str, int] = {"sept": 9}
    for months in (ENGLISH_MONTHS, MONTH_NAMES):
        for i, name in enumerate(months, 1):
            names[name.lower()] = names[name.lower()[:3]] = i
    return F.create_map(*[F.lit(x) for pair in sorted(names.items()) for x in pair])


_CLOCK = r"(?:(?<=\d)t| +)(\d{1,2}):(\d{1,2})(?::(\d{1,2})(?:\.\d+)?)?\s*(?:([ap])\.?\s?m\.?)?$"
_HOUR = r" +(\d{1,2})\s*([ap])\.?\s?m\.?$"


def infer_date(s) -> Column:
    """The last resort for free text: the classes of its tokens say which is the year,
    the month and the day.

    Numbers are day first, month first only where day first is no date
    (``01/31/25``); a year of four digits may stand first, and after a dash it is ISO
    (``2025-10-3`` is in October, ``2025/10/03`` is day first: in March). Month names
    may be Spanish or English. Two-digit years are within fifty years of the current
    one. A missing day is the first, a missing month January. Words without a meaning
    for the date, time zones, and times without a date give null."""
    return _let(F.lower(_c(s)), _inferred)


def _inferred(n: Column) -> Column:
    clock = lambda i: F.regexp_extract(n, _CLOCK, i)
    noon = F.when(clock(1) != "", clock(4)).otherwise(F.regexp_extract(n, _HOUR, 2))
    hour = F.when(clock(1) != "", clock(1)).otherwise(F.regexp_extract(n, _HOUR, 1)).try_cast("int")
    hour = (F.when((noon != "") & (hour > 12), F.lit(99)).when((noon == "p") & (hour < 12), hour + 12)
            .when((noon == "a") & (hour == 12), F.lit(0)).otherwise(F.coalesce(hour, F.lit(0))))
    minute, second = F.coalesce(clock(2).try_cast("int"), F.lit(0)), F.coalesce(clock(3).try_cast("int"), F.lit(0))
    day = F.regexp_replace(F.regexp_replace(n, _CLOCK, ""), _HOUR, "")
    words = F.filter(F.regexp_extract_all(day, F.lit(r"(\p{L}+|\d+)"), 1), lambda w: ~w.isin(DATE_FILLERS))
    pairs = lambda w: F.array(*[F.substring(F.get(w, F.lit(0)), i, 2) for i in (1, 3, 5)])
    alone = (F.size(words) == 1) & F.get(words, F.lit(0)).rlike(r"^\d{6}$")
    whole = F.array(F.substring(day, 1, 4), F.substring(day, 5, 2), F.substring(day, 7, 2))
    tokens = F.when(day.rlike(r"^\d{8}$"), whole).when(alone, pairs(words)).otherwise(words)
    dashed = day.rlike(r"^\d{4}-") | day.rlike(r"^\d{8}$")
    parts = _let(F.struct(tokens.alias("t"), dashed.alias("iso")), lambda x: _year_month_day(x["t"], x["iso"]))
    known = n.rlike(r"^[\p{L}0-9:.,/\- ]+$")
    return F.when(known, _let(parts, lambda p: F.try_make_timestamp_ntz(
        p["y"], p["m"], p["d"], hour, minute, second.cast("decimal(16,6)"))))


def _year_month_day(t: Column, iso: Column) -> Column:
    """(y, m, d) of one to three tokens."""
    months = _months()
    text = lambda i: F.get(t, F.lit(i))
    number = lambda i: text(i).try_cast("int")
    name = lambda i: F.try_element_at(months, text(i))
    four = lambda i: text(i).rlike(r"^\d{4}$")
    year = lambda i: F.when(text(i).rlike(r"^(\d{4}|\d{1,2})$"), F.when(
        F.length(text(i)) == 4, number(i)).otherwise(_near_year(number(i))))
    ymd = lambda y, m, d: F.struct(y.cast("int").alias("y"), m.cast("int").alias("m"), d.cast("int").alias("d"))
    one = F.lit(1)
    three = (F.when(name(0).isNotNull(), ymd(year(2), name(0), number(1)))
             .when(name(1).isNotNull(), F.when(four(0), ymd(year(0), name(1), number(2))).otherwise(ymd(year(2), name(1), number(0))))
             .when(iso, ymd(year(0), number(1), number(2)))
             .when((four(0) | (number(0) > 31)) & (number(2) <= 12), ymd(year(0), number(2), number(1)))
             .when(four(0) | (number(0) > 31), ymd(year(0), number(1), number(2)))
             .when((number(0) > 12) | (number(1) <= 12), ymd(year(2), number(1), number(0)))
             .otherwise(ymd(year(2), number(0), number(1))))
    two = (F.when(four(1), ymd(number(1), F.coalesce(name(0), number(0)), one))
           .when(four(0), ymd(number(0), F.coalesce(name(1), number(1)), one)))
    return (F.when(F.size(t) == 3, three).when(F.size(t) == 2, two)
            .when((F.size(t) == 1) & four(0), ymd(number(0), one, one)))


def _near_year(y: Column) -> Column:
    """Two digits as the year within fifty years of the current one."""
    now = F.year(F.current_date())
    full = F.floor(now / 100) * 100 + y
    return F.when(full >= now + 50, full - 100).when(full < now - 50, full + 100).otherwise(full)


def with_date(df, column: str, out: str | None = None):
    """C5 as a two-step projection: strip once, then try the layouts."""
    out = out or column
    tmp = f"__str_{column}"
    return df.withColumn(tmp, strip_ws(F.col(column).cast("string"))) \
        .withColumn(out, parse_stripped_date(tmp)).drop(tmp)


def elapsed_days(start, end) -> Column:
    """Whole days elapsed (floor of the exact difference, Q17)."""
    secs = F.unix_timestamp(_c(end).cast("timestamp")) - F.unix_timestamp(_c(start).cast("timestamp"))
    return F.floor(secs / F.lit(SECONDS_PER_DAY)).cast("long")


def term_text(start, end) -> Column:
    """C18: 'N MES(ES) (d días)' from 30 days, 'd DÍAS' below, 'N/D' when a
    date is missing or the end precedes the start. Months are half-even."""
    d = elapsed_days(start, end)
    months = F.bround(d / F.lit(30.0), 0).cast("long")
    unit = F.when(months == 1, F.lit("MES")).otherwise(F.lit("MESES"))
    long_txt = F.format_string("%d %s (%d días)", months, unit, d)
    short_txt = F.format_string("%d DÍAS", d)
    return (F.when(d.isNull() | (d < 0), F.lit("N/D"))
            .when(d >= 30, long_txt).otherwise(short_txt))


def month_name(col) -> Column:
    """Month number (1..12) -> Spanish name, else null."""
    m = _c(col).cast("int")
    names = F.array(*[F.lit(n) for n in MONTH_NAMES])
    return F.when(m.between(1, 12), F.element_at(names, m))


def year_of(col) -> Column:
    return F.year(_c(col)).cast("long")


def month_of(col) -> Column:
    return F.month(_c(col)).cast("long")


def parse_filter_date(text: str, end_of_day: bool = False):
    """Q35: filter bounds are 'dd/MM/yyyy' or 'dd-MM-yyyy' (driver-side)."""
    import datetime as _dt
    for fmt in ("%d/%m/%Y", "%d-%m-%Y"):
        try:
            d = _dt.datetime.strptime(text.strip(), fmt)
            if end_of_day:
                d = d.replace(hour=23, minute=59, second=59)
            return d
        except ValueError:
            continue
    raise ValueError(f"bad filter date {text!r}: expected dd/MM/yyyy or dd-MM-yyyy")
