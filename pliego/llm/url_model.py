"""URL filter: host/path rules, then a character language-model ratio, in DataFrame operations.

Rules decide what they fit. The URLs they decide are also the labelled URLs of
two smoothed variable-order Markov models over the characters of host and path:
one of accepted and one of rejected URLs, orders 0 to ``ORDER``, Witten-Bell
interpolation. A context or character run enters the models only if it makes up
at least 1 / ``GRAMS`` of all labelled characters; so longer contexts exist only
where the data support them, and each order holds at most ``GRAMS`` rows however
large the input is. That bound is what allows the model table to be broadcast.

Every URL without a rule gets the sum over its characters of
log p(accepted) - log p(rejected), divided by its length. The threshold is the
one with the best balanced accuracy on the labelled URLs of fold 0 of
``FOLDS`` (by crc32 of the scored text), which the models do not see.

Distinct texts are scored once, so a URL that fills a third of the table costs
one scoring. Sums are exact (fixed point), so results do not depend on order.

Defined results: a null URL or one without ``://`` has empty host and path and
no score; without a score, or with only one labelled class, the method allows.
Repeated rows get one row each; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pliego.llm.common import ascii_lower

#: (host, path, verdict) of the registered query.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"),
         ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
ORDER = 3
GRAMS = 20_000
FOLDS = 5
#: Size of the uniform distribution below order 0.
ALPHABET = 256
_FIX = 1_000_000_000


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def apply_rules(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest fitting rule, else null."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _positions(texts: DataFrame) -> DataFrame:
    """One row per character: its run of 1 .. ORDER + 1 characters, null where the text is too short."""
    at = texts.withColumn("p", F.explode(F.sequence(F.lit(1), F.char_length("t"))))
    return at.select(*texts.columns, *[
        F.when(F.col("p") >= k, F.substr("t", F.col("p") - (k - 1), F.lit(k))).alias(f"g{k}")
        for k in range(1, ORDER + 2)])


def train(labelled: DataFrame) -> DataFrame:
    """Model rows (gram, d, w) from (t, label, n): texts, accepted or not, and their number.

    ``d``: log ratio of the last character after the others; ``w``: log ratio of
    the weights with which ``gram`` as a context falls back to a shorter one.
    """
    runs = _positions(labelled.filter(F.char_length("t") > 0))
    grams = runs.select("label", "n", F.explode(F.array(*[f"g{k}" for k in range(1, ORDER + 2)])).alias("gram"))
    counts = (grams.filter("gram IS NOT NULL").groupBy("gram")
              .agg(F.sum(F.when(F.col("label"), F.col("n")).otherwise(0)).alias("a"),
                   F.sum(F.when(F.col("label"), 0).otherwise(F.col("n"))).alias("r"))
              .withColumn("k", F.char_length("gram")))
    chars = labelled.agg(*[F.coalesce(F.sum(F.when(F.col("label") == c, F.col("n") * F.char_length("t"))), F.lit(0))
                           .alias(x) for c, x in ((True, "na"), (False, "nr"))]).first()
    least = (chars["na"] + chars["nr"]) / GRAMS
    kept = counts.filter(F.col("a") + F.col("r") >= F.lit(least)).checkpoint()
    ctx = (kept.filter("k > 1").groupBy(F.expr("substring(gram, 1, k - 1)").alias("c"))
           .agg(*[F.sum(x).alias(f"c{x}") for x in "ar"],
                *[F.sum((F.col(x) > 0).cast("long")).alias(f"t{x}") for x in "ar"]))
    model = (kept.filter("k = 1").select("gram", *[
        ((F.col(x) + 1.0) / F.lit(float(chars["n" + x] + ALPHABET))).alias("p" + x) for x in "ar"]))
    parts = [model]
    for k in range(2, ORDER + 2):
        low = model.select(F.col("gram").alias("low"), F.col("pa").alias("la"), F.col("pr").alias("lr"))
        model = (kept.filter(F.col("k") == k)
                 .join(ctx, F.expr("substring(gram, 1, k - 1)") == F.col("c"))
                 .join(low, F.expr("substring(gram, 2, k - 1)") == F.col("low"))
                 .select("gram", *[F.when(F.col(f"c{x}") > 0, (F.col(x) + F.col(f"t{x}") * F.col(f"l{x}"))
                                          / (F.col(f"c{x}") + F.col(f"t{x}"))).otherwise(F.col(f"l{x}")).alias("p" + x)
                                   for x in "ar"]))
        parts.append(model)
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    back = [F.when(F.col(f"c{x}") > 0, F.col(f"t{x}") / (F.col(f"c{x}") + F.col(f"t{x}"))).otherwise(1.0) for x in "ar"]
    return (rows.join(ctx, F.col("gram") == F.col("c"), "left")
            .select("gram", F.log(F.col("pa") / F.col("pr")).alias("d"),
                    F.coalesce(F.log(back[0] / back[1]), F.lit(0.0)).alias("w"))).checkpoint()


def score(texts: DataFrame, model: DataFrame) -> DataFrame:
    """(t, score): length-normalised log ratio of each distinct text."""
    unseen = 0.0  # a character in neither model
    rows = _positions(texts.select("t").filter(F.char_length("t") > 0))
    small = F.broadcast(model)
    for k in range(1, ORDER + 2):
        m = small.select(F.col("gram").alias(f"m{k}"), F.col("d").alias(f"d{k}"), F.col("w").alias(f"x{k}"))
        rows = rows.join(m, F.col(f"g{k}") == F.col(f"m{k}"), "left")
    for k in range(2, ORDER + 2):  # weight of the context of order k - 1
        m = small.select(F.col("gram").alias(f"m{k}"), F.col("d").alias("_"), F.col("w").alias(f"w{k}"))
        rows = rows.drop(f"m{k}").join(m, F.substring(f"g{k}", 1, k - 1) == F.col(f"m{k}"), "left").drop("_")
    value = F.coalesce("d1", F.lit(unseen))
    for k in range(2, ORDER + 2):
        value = F.coalesce(F.col(f"d{k}"), F.coalesce(F.col(f"w{k}"), F.lit(0.0)) + value)
    return (rows.select("t", F.round(value * _FIX).cast("long").alias("v")).groupBy("t")
            .agg((F.sum("v") / F.lit(float(_FIX)) / F.count("*")).alias("score")))


def calibrate(scored: DataFrame) -> float:
    """Threshold with the best balanced accuracy over (label, n, score), on a grid of 0.01 from -10 to 10."""
    cell = F.greatest(F.lit(-1000), F.least(F.lit(1000), F.floor(F.col("score") * 100))).cast("int")
    bins = {r["b"]: (r["a"], r["r"]) for r in scored.groupBy(cell.alias("b")).agg(
        F.sum(F.when(F.col("label"), F.col("n")).otherwise(0)).alias("a"),
        F.sum(F.when(F.col("label"), 0).otherwise(F.col("n"))).alias("r")).collect()}
    na, nr = sum(a for a, _ in bins.values()), sum(r for _, r in bins.values())
    if not na or not nr:
        return 0.0
    best, below_a, below_r = (0.5, 0, 0), 0, 0
    for b in range(-1000, 1001):
        # allow at or above b: accepted ones from here on, rejected ones below
        value = (1 - below_a / na + below_r / nr) / 2
        best = max(best, (value, -abs(b), b))
        a, r = bins.get(b, (0, 0))
        below_a, below_r = below_a + a, below_r + r
    return best[2] / 100


def filter_urls(pages: DataFrame, key: str = "page_id", url: str = "url",
                rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """Every row judged: key, host, path, rule, verdict, score (null where a rule decides)."""
    from pliego.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(pages.sparkSession)
    host, path = host_path(F.col(url))
    parsed = pages.select(F.col(key).alias("k"), host.alias("host"), path.alias("path"))
    rule, verdict = apply_rules(F.col("host"), F.col("path"), rules)
    judged = parsed.select("k", "host", "path", rule.alias("rule"), verdict.alias("by_rule"),
                           F.concat("host", "path").alias("t"))
    distinct = judged.groupBy("t", "by_rule").agg(F.count("*").alias("n")).checkpoint()
    labelled = distinct.filter("by_rule IS NOT NULL").select("t", (F.col("by_rule") == "allow").alias("label"), "n")
    held = F.crc32(F.col("t").cast("binary")) % FOLDS == 0
    seen = {r["label"] for r in labelled.filter(~held).select("label").distinct().collect()}
    if len(seen) < 2:
        scored, threshold = distinct.select(F.col("t").alias("s"), F.lit(None).cast("double").alias("score")).limit(0), 0.0
    else:
        model = train(labelled.filter(~held))
        # labelled texts of fold 0 calibrate; the rest needs a score only without a rule
        marks = score(distinct.filter(F.col("by_rule").isNull() | held).select("t").distinct(), model).checkpoint()
        threshold = calibrate(labelled.filter(held).join(marks, "t"))
        scored = marks.withColumnRenamed("t", "s")
    out = judged.join(scored, (F.col("t") == F.col("s")) & F.col("by_rule").isNull(), "left")
    method = F.when(F.col("score") < threshold, "block").otherwise("allow")
    return out.select(F.col("k").alias(key), "host", "path", "rule",
                      F.coalesce("by_rule", method).alias("verdict"), "score")
