"""Money parsing and rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["parse_money", "money_token", "money_from_token", "with_money", "money_text", "percent_text", "to_numeric"]

# ---- fixed values -------------------------------------------------------------
MONEY_NUMBER = r"-?\d[\d.,]*"
NOT_AVAILABLE = "N/D"
# -----------------------------------------------------------------------------


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def money_token(col) -> Column:
    """The number part of a money text: first ``-?digit[digits.,]*`` with
    trailing separators dropped ('' when there is none)."""
    raw = F.regexp_extract(F.coalesce(_c(col).cast("string"), F.lit("")), MONEY_NUMBER, 0)
    return F.regexp_replace(raw, "[.,]+$", "")


def money_from_token(tok) -> Column:
    """Token -> double. Decimal separator rules (Q12): with both separators the
    rightmost is decimal; a single kind repeated is thousands; a single one
    with exactly three digits after it is thousands, any other count decimal."""
    t = _c(tok)
    both = t.rlike(r"\..*,|,.*\.")
    single = t.rlike(r"^[^.,]*[.,][^.,]*$")
    three_after = t.rlike(r"[.,]\d{3}$")
    decimal = both | (single & ~three_after)
    as_decimal = F.translate(F.regexp_replace(t, r"[.,](?=.*[.,])", ""), ",", ".")
    as_integer = F.regexp_replace(t, "[.,]", "")
    return F.when(decimal, as_decimal).otherwise(as_integer).try_cast("double")


def parse_money(col) -> Column:
    """Colombian or Anglo money text -> double (null when no number).

    A '-' right before the first digit makes the number negative (Q14).
    Inside DataFrame operators prefer ``with_money`` which computes the token
    once in its own projection."""
    return money_from_token(money_token(col))


def with_money(df, column: str, out: str | None = None, only_content: bool = True):
    """C3 as a two-step projection: token first, then the value from it."""
    from pliego.functions.text import has_content
    out = out or column
    tmp = f"__tok_{column}"
    staged = df.withColumn(tmp, F.when(has_content(column), money_token(column)) if only_content
                           else money_token(column))
    return staged.withColumn(out, money_from_token(tmp)).drop(tmp)


def to_numeric(col) -> Column:
    """Coerce to double; unparseable and NaN -> null (``try_cast``)."""
    return F.nullif(_c(col).try_cast("double"), F.lit(float("nan")))   # NaN equals NaN in Spark


def money_text(col) -> Column:
    """``$1.234.567`` (no decimals, half-even), null -> 'N/D'."""
    v = _c(col).cast("double")
    txt = F.concat(F.lit("$"), F.translate(F.format_number(v, 0), ",", "."))
    return F.when(v.isNull() | F.isnan(v), F.lit(NOT_AVAILABLE)).otherwise(txt)


def percent_text(col) -> Column:
    """C20: one decimal and '%', Colombian separators (``1.234,5%``).

    Deviation from the reference (Q30), which printed ``1.234.5%``."""
    v = _c(col).cast("double")
    s = F.format_number(v, 1)
    s = F.translate(s, ",.", ".,")
    return F.concat(s, F.lit("%"))
