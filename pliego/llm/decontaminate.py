"""Benchmark decontamination with a broadcast set of test n-grams, in DataFrame operations.

Words are runs of ASCII letters and digits and of all characters above ASCII,
after lower-casing A-Z. A test item gives every run of ``n`` consecutive words;
an item of fewer words (but not none) is one run. Every start of a training
token window looks up the hash of its first three words in the broadcast set;
hits are verified word by word, so hash collisions change nothing. A document
word inside any occurrence is hit.

One scan of the documents and one narrow shuffle: a marker row per document and
a row per verified occurrence. Copies of a row are counted before the shuffle
and given back at the end.

The set is broadcast only while it holds at most ``BROADCAST_WINDOWS`` windows
(measured first); a larger one is joined by a shuffle on the same key.

Defined results: null or empty text has no words and no hits; repeated
documents each get their own row; repeated items count once per item_id; an
empty benchmark hits nothing; an empty documents table gives no rows. Null
doc_ids are kept. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pliego.llm.common import ascii_lower

N_WORDS = 10
KEY_WORDS = 3
BROADCAST_WINDOWS = 200_000
#: What separates words: every ASCII character that is not a letter or digit.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), SEPARATORS), ""), F.array().cast("array<string>"))


def benchmark_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text",
                      n: int = N_WORDS) -> DataFrame:
    """(win, len, items): each distinct window with the items it comes from."""
    w = (benchmark.select(F.col(item).cast("string").alias("i"), words(F.col(text)).alias("w"))
         .filter(F.size("w") > 0)
         .withColumn("len", F.least(F.size("w"), F.lit(n)))
         .withColumn("s", F.explode(F.expr("sequence(1, size(w) - len + 1)")))
         .withColumn("win", F.expr("slice(w, s, len)")))
    return w.groupBy("win", "len").agg(F.collect_set("i").alias("items"))


def _key(arr: str, pos: str, k: int) -> Column:
    return F.xxhash64(*[F.expr(f"get({arr}, {pos} + {j})") for j in range(k)])


def find_hits(docs: DataFrame, windows: DataFrame, doc: str = "doc_id", text: str = "text",
              n: int = N_WORDS) -> DataFrame:
    """Markers (pos = 0, len null) of all documents, and verified occurrences (pos from 1)."""
    stats = windows.groupBy(F.least("len", F.lit(KEY_WORDS)).alias("k")).count().collect()
    small = sum(r["count"] for r in stats) <= BROADCAST_WINDOWS
    base = docs.select(F.col(doc).alias("d"), F.xxhash64(text).alias("h"), words(F.col(text)).alias("w"))
    # element 0 is the document's marker: it joins nothing and comes out once
    base = base.select("d", "h", F.size("w").alias("n"), F.concat(F.array(F.lit("")), "w").alias("w"))
    starts = base.select("d", "h", "n", "w", F.posexplode("w").alias("pos", "__w"))
    out = None
    for k in sorted((r["k"] for r in stats), reverse=True) or [KEY_WORDS]:
        keyed = (starts.withColumn("key", F.when(F.col("pos") > 0, _key("w", "pos", k)))
                 .withColumn("ahead", F.expr(f"slice(w, pos + 1, {n})")).drop("__w", "w"))
        wins = (windows.filter(F.least("len", F.lit(KEY_WORDS)) == k)
                .select(_key("win", "0", k).alias("wkey"), "win", "len", "items"))
        hit = keyed.join(F.broadcast(wins) if small else wins,
                         (F.col("key") == F.col("wkey")) & (F.expr("slice(ahead, 1, len)") == F.col("win")),
                         "left" if out is None else "inner")
        part = hit.filter("pos = 0 OR len IS NOT NULL").select("d", "h", "n", "pos", "len", "items")
        out = part if out is None else out.unionByName(part)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", text: str = "text",
                  item: str = "item_id", item_text: str = "text", n: int = N_WORDS) -> DataFrame:
    """Per document: (d, h, n_words, n_hit, items, copies); h is the text's hash."""
    hits = find_hits(docs, benchmark_windows(benchmark, item, item_text, n), doc, text, n)
    starts = hits.groupBy("d", "h", "n", "pos").agg(
        F.max("len").alias("len"), F.flatten(F.collect_set("items")).alias("items"), F.count("*").alias("c"))
    before = Window.partitionBy("d", "h").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("pos") + F.col("len")
    return (starts.withColumn("prev", F.max(end).over(before))
            .withColumn("new", end - F.greatest(F.col("pos"), F.coalesce("prev", F.col("pos"))))
            .groupBy("d", "h")
            .agg(F.max("n").alias("n_words"),
                 F.coalesce(F.sum(F.greatest(F.col("new"), F.lit(0))), F.lit(0)).alias("n_hit"),
                 F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
                 F.max(F.when(F.col("pos") == 0, F.col("c"))).alias("copies")))


def decontamination_report(docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", text: str = "text",
                           n: int = N_WORDS) -> DataFrame:
    """One row per document with its hit words and the items found in it."""
    found = contamination(docs, benchmark, doc, text, n=n)
    return (found.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
            .select(F.col("d").alias(doc), F.col("n_words").cast("long").alias("n_words"),
                    F.col("n_hit").cast("long").alias("n_hit"),
                    F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
                    (F.col("n_hit") > 0).alias("contaminated")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", text: str = "text",
                      n: int = N_WORDS) -> DataFrame:
    """The documents without any benchmark window, all columns kept."""
    bad = contamination(docs, benchmark, doc, text, n=n).filter("n_hit > 0").select(
        F.col("d").alias("__d"), F.col("h").alias("__h"))
    return docs.join(bad, F.col("__d").eqNullSafe(docs[doc]) & (F.col("__h") == F.xxhash64(docs[text])), "left_anti")


SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
         [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS w
  FROM documents),
i AS (
  SELECT item_id::VARCHAR AS item,
         [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS w
  FROM benchmark),
g AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM i WHERE len(w) > 0)),
p AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS s FROM d),
h AS (
  SELECT p.r, p.s, g.n, g.item
  FROM p JOIN (SELECT DISTINCT n AS k FROM g) ON p.s + k - 1 <= len(p.w)
  JOIN g ON g.n = k AND g.win = array_to_string(p.w[p.s:p.s + k - 1], ' ')),
c AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS x FROM h) GROUP BY r),
q AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit,
       coalesce(q.n_items, 0)::BIGINT AS n_items, sha256(coalesce(q.items, '')) AS items_sha256,
       coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN q USING (r)
"""
