"""Display helpers for the annex."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pliego.functions.text import strip_ws

__all__ = ["process_link", "upper_or_nd", "entity_city", "cv_percent", "dispersion_reading"]

# ---- fixed values -------------------------------------------------------------
DISPERSION_LOW = ("baja dispersión: los precios del mercado son homogéneos y la "
                  "media es un buen estimador del precio de referencia")
DISPERSION_MODERATE = ("dispersión moderada: conviene contrastar la media con la "
                       "mediana antes de fijar el precio de referencia")
DISPERSION_HIGH = ("dispersión alta: los precios son heterogéneos, por lo que la "
                   "mediana y las estadísticas ajustadas representan mejor al mercado "
                   "que el promedio simple")
CV_LOW, CV_HIGH = 15.0, 40.0
# -----------------------------------------------------------------------------


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def process_link(col) -> Column:
    """blank/'nan' -> 'N/D'; serialized ``{'url': ...}`` -> the url; else as is."""
    t = strip_ws(F.coalesce(_c(col).cast("string"), F.lit("")))
    parsed = F.from_json(t, "url string", {"allowSingleQuotes": "true", "mode": "PERMISSIVE"})
    is_dict = t.startswith("{") & t.contains("url")
    return (F.when((t == "") | (F.lower(t) == "nan"), F.lit("N/D"))
            .when(is_dict, F.coalesce(parsed.getField("url"), t))
            .otherwise(t))


def upper_or_nd(col) -> Column:
    """Upper-cased display value, null -> 'N/D'."""
    return F.upper(F.coalesce(_c(col).cast("string"), F.lit("N/D")))


def entity_city(entity, city) -> Column:
    """C23: 'ENTITY, CITY', or just the entity when the city is blank."""
    e = upper_or_nd(entity)
    c = F.upper(F.coalesce(_c(city).cast("string"), F.lit("")))
    return F.when(c != "", F.concat_ws(", ", e, c)).otherwise(e)


def cv_percent(std, mean) -> Column:
    """Coefficient of variation in percent, 0 when the mean is 0 (Q10)."""
    m = _c(mean)
    return F.when(m.isNull() | (m == 0), F.lit(0.0)).otherwise(_c(std) / m * 100.0)


def dispersion_reading(cv) -> Column:
    """CV < 15 low, < 40 moderate, else high."""
    c = _c(cv)
    return (F.when(c < CV_LOW, F.lit(DISPERSION_LOW))
            .when(c < CV_HIGH, F.lit(DISPERSION_MODERATE))
            .otherwise(F.lit(DISPERSION_HIGH)))
