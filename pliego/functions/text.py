"""Text cleaning and extraction expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "WS", "ACCENTED", "UNACCENTED", "normalize_string", "fold", "fold_collapse",
    "normalize_label", "normalize_header", "split_location", "split_dated_label",
    "only_date", "process_id", "detail_url", "id_from_url", "header_number",
    "header_entity", "has_content", "strip_ws", "collapse_ws", "normalizes_to_blank",
]

# ---- fixed values (must equal the reference's) -------------------------------
# Unicode whitespace as Python's str.isspace() sees it, written as an explicit
# class: Java's \s and RE2's \s are ASCII-only.
WS = (r"[\t\n\x{0B}\x{0C}\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
      r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
# Accent folding table (14 characters, not NFD).
ACCENTED = "áéíóúüñÁÉÍÓÚÜÑ"
UNACCENTED = "aeiouunAEIOUUN"
# Mis-decoded Windows-1252 punctuation -> Unicode; \x85 becomes "...".
CP1252_FROM = "\x82\x84\x91\x92\x93\x94\x95\x96\x97\x99\xa0"
CP1252_TO = ",\"''\"\"---™ "
CP1252_ELLIPSIS = "\x85"
CONTROL_CHARS = r"[\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}\x{7F}-\x{9F}]"
DATE_IN_TEXT = r"(\d{1,2}[-/]\d{1,2}[-/]\d{4})"
PROCESS_ID_CALL = r"consultaProceso\(\s*['\"]([^'\"]+)['\"]\s*\)"
DETAIL_URL_BASE = "https://www.contratos.gov.co/consultas/detalleProceso.do"
HEADER_NUMBER = r"(?i)Detalle\s+del\s+Proceso\s+N[úu]mero:\s*([^\n]+)"
# -----------------------------------------------------------------------------

# The same sets as plain character strings, for translate/btrim (no regex).
WS_CHARS = ("\t\n\x0b\x0c\r" + "".join(chr(c) for c in range(0x1C, 0x20)) + " \x85\xa0\u1680"
            + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000")
CONTROL_STRING = "".join(chr(c) for c in [*range(0x00, 0x09), 0x0B, 0x0C, *range(0x0E, 0x20), *range(0x7F, 0xA0)])
# -----------------------------------------------------------------------------


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip_ws(col) -> Column:
    """Unicode-aware strip (Python ``str.strip()``), a character-set trim."""
    return F.btrim(_c(col), F.lit(WS_CHARS))


def collapse_ws(col) -> Column:
    """Python ``" ".join(s.split())``: collapse every whitespace run, strip."""
    return strip_ws(F.regexp_replace(_c(col), f"{WS}+", " "))


def normalize_string(col) -> Column:
    """Null -> ""; cp1252 controls -> Unicode; other controls dropped;
    newline/tab runs -> space; runs of 2+ whitespace -> one space; strip."""
    s = F.coalesce(_c(col).cast("string"), F.lit(""))
    s = F.translate(s, CP1252_FROM, CP1252_TO)
    s = F.replace(s, F.lit(CP1252_ELLIPSIS), F.lit("..."))
    s = F.translate(s, CONTROL_STRING, "")
    # "[\n\r\t]+ -> ' '" followed by "\s{2,} -> ' '" equals one pass that
    # turns every whitespace run of length >= 2, and every single newline or
    # tab, into one space.
    # Only text holding a double space or any other whitespace character can
    # change; the check is two cheap scans, the regex runs only when needed.
    needs = s.contains("  ") | (F.length(F.translate(s, _WS_NOT_SPACE, "")) != F.length(s))
    s = F.when(needs, F.regexp_replace(s, f"{WS}{{2,}}|[\n\r\t]", " ")).otherwise(s)
    return strip_ws(s)


# Characters normalize_string removes entirely: whitespace and control
# characters, except the mis-decoded punctuation that becomes visible text.
_VANISHING = "".join(sorted((set(WS_CHARS) | set(CONTROL_STRING))
                            - (set(CP1252_FROM) - {"\xa0"}) - {CP1252_ELLIPSIS}))


def normalizes_to_blank(col) -> Column:
    """True when ``normalize_string(col)`` would be '' — decided on the raw
    text with one ``translate`` (no regex), so a filter on it can run before
    the normalization without repeating it."""
    c = _c(col).cast("string")
    return c.isNull() | (F.length(F.translate(c, _VANISHING, "")) == 0)


_WS_NOT_SPACE = WS_CHARS.replace(" ", "")


def fold(col) -> Column:
    """Lower case, then the fixed accent table, whose letters no other letter lowers to.

    One search a letter, in text that has other letters than ASCII at all."""
    low = F.lower(_c(col))
    plain = reduce(lambda s, pair: F.replace(s, F.lit(pair[0]), F.lit(pair[1])), _PLAIN.items(), low)
    return F.when(F.octet_length(low) == F.char_length(low), low).otherwise(plain)


#: Lower-case accented letters and their plain ones.
_PLAIN = {letter: plain for letter, plain in zip(ACCENTED, UNACCENTED) if letter.islower()}


def plain_lower(text: str) -> str:
    """C7 for one argument on the driver."""
    return "".join(_PLAIN.get(letter, letter) for letter in text.lower())


def fold_collapse(col) -> Column:
    """Fold + collapse whitespace + strip."""
    return collapse_ws(fold(col))


def normalize_label(col) -> Column:
    """Fold, strip, non-[a-z0-9 whitespace] -> space, collapse."""
    # whitespace and all else that is replaced become one space a run
    return F.btrim(F.regexp_replace(fold(col), "[^a-z0-9]+", " "))


def normalize_header(col) -> Column:
    """Strip, lower, runs of other characters -> '_', '_' runs -> one, trim '_'."""
    s = F.lower(strip_ws(_c(col)))
    s = F.regexp_replace(s, "[^a-záéíóúñü0-9]+", "_")
    s = F.regexp_replace(s, "_+", "_")
    return F.regexp_replace(s, "^_+|_+$", "")


def split_location(col) -> tuple[Column, Column]:
    """C11: 'dept : town' -> (dept, town); without ':' all text is the dept."""
    s = F.coalesce(_c(col), F.lit(""))
    has = F.instr(s, ":") > 0
    dept = F.when(has, strip_ws(F.substring_index(s, ":", 1))).otherwise(strip_ws(s))
    town = F.when(has, strip_ws(F.regexp_extract(s, r"(?s)^[^:]*:(.*)$", 1))).otherwise(F.lit(""))
    return dept, town


def _strip_chars(col: Column, chars: str) -> Column:
    cls = "".join("\\" + ch for ch in chars)
    return F.regexp_replace(col, f"^[{cls}]+|[{cls}]+$", "")


def split_dated_label(col) -> tuple[Column, Column]:
    """C12: 'label dd-mm-yyyy' -> (label, date). Every occurrence of the
    date text is removed from the label, which is then stripped of ' .-:'."""
    s = F.coalesce(_c(col), F.lit(""))
    date = F.regexp_extract(s, DATE_IN_TEXT, 1)
    label = F.when(date == "", strip_ws(s)).otherwise(
        _strip_chars(F.replace(s, date, F.lit("")), " .-:"))
    return label, date


def only_date(col) -> Column:
    """First d[-/]m[-/]yyyy in the text, else ''."""
    return F.regexp_extract(F.coalesce(_c(col), F.lit("")), DATE_IN_TEXT, 1)


def process_id(col) -> Column:
    """C14: id inside ``consultaProceso('...')``; null when absent."""
    v = strip_ws(F.regexp_extract(F.coalesce(_c(col), F.lit("")), PROCESS_ID_CALL, 1))
    return F.when(v != "", v)


def detail_url(col) -> Column:
    """Id -> detail URL; null/empty -> null."""
    c = _c(col)
    return F.when(c.isNotNull() & (c != ""),
                  F.concat(F.lit(DETAIL_URL_BASE + "?numConstancia="), c))


def id_from_url(col) -> Column:
    """``numConstancia`` query parameter, else ''."""
    return F.coalesce(F.try_parse_url(_c(col), F.lit("QUERY"), F.lit("numConstancia")),
                      F.lit(""))


def header_number(col) -> Column:
    """C32 (1/2): process number after 'Detalle del Proceso Número:'."""
    return strip_ws(F.regexp_extract(F.coalesce(_c(col), F.lit("")), HEADER_NUMBER, 1))


def header_entity(col) -> Column:
    """C32 (2/2): the first non-blank line after the header line."""
    lines = F.transform(F.split(F.coalesce(_c(col), F.lit("")), "\n"), lambda x: strip_ws(x))
    idx = F.array_position(F.transform(lines, lambda x: x.rlike(HEADER_NUMBER)), F.lit(True))
    after = F.filter(F.slice(lines, F.greatest(idx + 1, F.lit(1)), F.size(lines)),
                     lambda x: x != "")
    return F.when(idx > 0, F.coalesce(F.get(after, 0), F.lit(""))).otherwise(F.lit(""))


def has_content(col) -> Column:
    """non-null and not blank."""
    c = _c(col)
    return c.isNotNull() & (strip_ws(c.cast("string")) != "")
