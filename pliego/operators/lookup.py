"""Catalog lookups and set differences against dimension data.

Resolution runs on the *distinct* values of the column (map-side
deduplicated), against a broadcast catalog of fixed size; the small
resolution table is then joined back to the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pliego.catalogs import ALL_LABEL, NATIONAL_LABEL, Option, catalog_frame, code_table_frame
from pliego.functions.text import fold_collapse, plain_lower, strip_ws

# ---- fixed values -------------------------------------------------------------
# Tier order (Q24, our deviation: an option's own label/value/code ranks above
# membership in a group option).
TIER_CODE, TIER_API, TIER_OWN, TIER_MEMBER, TIER_PARTIAL = 1, 2, 3, 4, 5
# -----------------------------------------------------------------------------


class KeyIndex:
    """What a catalog entry can be called: exact keys by tier, and folded names for the partial tier.

    One table serves both sides: Spark joins it to a column's values, the driver
    looks single filter arguments up in it."""

    def __init__(self, entries: list[tuple[int, str | None, int]], names: list[tuple[str, int]]):
        self.entries = sorted({(t, k, p) for t, k, p in entries if k})
        self.names = names
        self._first: dict[tuple[int, str], int] = {}
        for tier, key, pos in self.entries:
            self._first.setdefault((tier, key), pos)

    def position(self, value: str) -> int | None:
        """Place of the entry that a text stands for, by the lowest tier, then the first place."""
        text = str(value).strip()
        goal = catalog_key(text)
        exact = [(tier, self._first[tier, key]) for tier, key in self.asked(text, goal) if (tier, key) in self._first]
        partial = [(TIER_PARTIAL, pos) for name, pos in self.names if goal and goal in name]
        return min(exact or partial, default=(None, None))[1]

    @staticmethod
    def asked(text, goal) -> list[tuple[int, object]]:
        return [(TIER_CODE, text), (TIER_API, text), (TIER_OWN, goal), (TIER_MEMBER, goal)]

    def frames(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        return (spark.createDataFrame(self.entries, "tier int, key string, pos int"),
                spark.createDataFrame(self.names, "name string, pos int"))


def catalog_key(text: str) -> str:
    """What ``fold_collapse`` makes of a catalog entry or a filter argument: its words in plain lower case, one space between."""
    return " ".join(plain_lower(word) for word in text.split())


def option_index(options: list[Option]) -> KeyIndex:
    entries: list[tuple[int, str | None, int]] = []
    for pos, o in enumerate(options):
        entries += [(TIER_CODE, o.code, pos), (TIER_API, o.api_value, pos)]
        entries += [(TIER_OWN, catalog_key(k), pos) for k in (o.label, o.api_value, o.code) if k]
        entries += [(TIER_MEMBER, catalog_key(k), pos) for k in o.all_api_values]
    return KeyIndex(entries, [(catalog_key(o.label), pos) for pos, o in enumerate(options)])


def code_index(table: dict[str, str]) -> KeyIndex:
    named = [(catalog_key(name), pos) for pos, name in enumerate(table.values())]
    return KeyIndex([(TIER_CODE, code, pos) for pos, code in enumerate(table)]
                    + [(TIER_OWN, name, pos) for name, pos in named], named)


def _resolve(values: DataFrame, column: str, index: KeyIndex, ignored: tuple[str, ...] = ()) -> DataFrame:
    """(_value, _pos, _tier) of a frame of distinct values: equi-joins for the exact tiers;
    only values without an exact match meet the folded names in a loop."""
    exact, names = (F.broadcast(f) for f in index.frames(values.sparkSession))   # fixed catalogs
    text = strip_ws(F.col(column).cast("string"))
    v = (values.select(F.col(column).alias("_value"), text.alias("_text"), fold_collapse(text).alias("_goal"))
         .where((F.col("_text") != "") & ~F.col("_text").isin(*ignored, "")))
    asks = F.array(*[F.struct(F.lit(t).alias("tier"), k.alias("key"))
                     for t, k in KeyIndex.asked(F.col("_text"), F.col("_goal"))])
    tried = (v.select("_value", "_goal", F.explode(asks).alias("_a")).select("_value", "_goal", "_a.*")
             .join(exact, ["tier", "key"], "left").groupBy("_value", "_goal")
             .agg(F.min(F.when(F.col("pos").isNotNull(), F.struct("tier", "pos"))).alias("_m")))
    found = tried.where(F.col("_m").isNotNull()).select("_value", "_m")
    loop = (tried.where(F.col("_m").isNull()).drop("_m")
            .join(names, (F.col("_goal") != "") & F.col("name").contains(F.col("_goal")))
            .groupBy("_value").agg(F.min(F.struct(F.lit(TIER_PARTIAL).alias("tier"), "pos")).alias("_m")))
    return found.unionByName(loop).select("_value", F.col("_m.pos").alias("_pos"), F.col("_m.tier").alias("_tier"))


def resolve_values(values: DataFrame, column: str, options: list[Option]) -> DataFrame:
    """J1 on a frame of distinct values: value -> (pos, tier) of the chosen option."""
    return _resolve(values, column, option_index(options), (ALL_LABEL, NATIONAL_LABEL))


def resolve_catalog(df: DataFrame, column: str, options: list[Option], prefix: str | None = None) -> DataFrame:
    """Add the resolved option (label, source-1 code, API value(s), tier)."""
    spark = df.sparkSession
    prefix = prefix or column
    distinct = df.select(column).where(F.col(column).isNotNull()).distinct()
    res = resolve_values(distinct, column, options)
    cat = F.broadcast(catalog_frame(spark, options))
    res = res.join(cat, res._pos == cat.pos).select(
        F.col("_value"), F.col("etiqueta").alias(f"{prefix}_etiqueta"),
        F.col("codigo_secop1").alias(f"{prefix}_codigo"), F.col("valor_api").alias(f"{prefix}_valor_api"),
        F.col("valores_api").alias(f"{prefix}_valores_api"), F.col("_tier").alias(f"{prefix}_nivel"))
    return df.join(res, df[column] == res["_value"], "left").drop("_value")


def resolve_code(df: DataFrame, column: str, table: dict[str, str], out: str | None = None) -> DataFrame:
    """Value -> source-1 code: a known code passes, then exact folded name,
    then partial name (first in table order); unknown values pass unchanged."""
    spark = df.sparkSession
    out = out or f"{column}_codigo"
    codes = F.broadcast(code_table_frame(spark, table))
    distinct = df.select(column).where(F.col(column).isNotNull()).distinct()
    res = _resolve(distinct, column, code_index(table))
    res = res.join(codes, F.col("_pos") == F.col("pos")).select("_value", F.col("codigo").alias("_code"))
    joined = df.join(res, df[column] == res["_value"], "left")
    blank = F.col(column).isNull() | (strip_ws(F.col(column).cast("string")) == "")
    return joined.withColumn(out, F.when(blank, F.lit(None).cast("string"))
                             .otherwise(F.coalesce("_code", strip_ws(F.col(column).cast("string"))))) \
        .drop("_value", "_code")


def expand_option(resolved: DataFrame, prefix: str) -> DataFrame:
    """One row per API value the resolved option stands for."""
    return resolved.withColumn(f"{prefix}_valor", F.explode_outer(F.col(f"{prefix}_valores_api")))


def translate_across_sources(resolved: DataFrame, prefix: str, target: str) -> DataFrame:
    """The resolved option's value in the other source (null = absent there)
    and availability flags."""
    vals = F.col(f"{prefix}_valores_api")
    code = F.col(f"{prefix}_codigo")
    exists_api = F.coalesce(F.size(vals) > 0, F.lit(False))
    value = code if target == "secop1" else F.when(exists_api, vals)
    return resolved.select(
        "*", value.alias(f"{prefix}_en_{target}"),
        exists_api.alias(f"{prefix}_existe_en_api"),
        (code.isNotNull() & ~exists_api).alias(f"{prefix}_solo_secop1"),
        (exists_api & code.isNull()).alias(f"{prefix}_solo_api"))


def catalog_orphans(data: DataFrame, column: str, options: list[Option]) -> DataFrame:
    """Catalog API values that no longer occur in the data."""
    spark = data.sparkSession
    vals = spark.createDataFrame(sorted({(v,) for o in options for v in o.all_api_values}), "valor string")
    present = data.select(F.col(column).cast("string").alias("valor")).distinct()
    return vals.join(present, "valor", "left_anti")


def catalog_unknowns(data: DataFrame, column: str, options: list[Option]) -> DataFrame:
    """Data values absent from the catalog (null excluded)."""
    spark = data.sparkSession
    vals = F.broadcast(spark.createDataFrame(sorted({(v,) for o in options for v in o.all_api_values}),
                                             "valor string"))
    present = data.select(F.col(column).cast("string").alias("valor")).where(F.col("valor").isNotNull()).distinct()
    return present.join(vals, "valor", "left_anti")


CODE_IN_JS = r'\[\d+\]\s*=\s*"([^"]+)"'


def code_drift(texts: DataFrame, column: str, table: dict[str, str]) -> DataFrame:
    """Numeric codes listed in portal scripts that the code table lacks."""
    spark = texts.sparkSession
    known = F.broadcast(spark.createDataFrame([(k,) for k in table], "codigo string"))
    found = (texts.select(F.explode(F.regexp_extract_all(F.col(column), F.lit(CODE_IN_JS), 1)).alias("codigo"))
             .where(F.col("codigo").rlike(r"^\d+$")).distinct())
    return found.join(known, "codigo", "left_anti")
