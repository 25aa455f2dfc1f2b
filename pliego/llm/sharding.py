"""Sharding by extendible hashing, in DataFrame operations.

A row's key is hashed to 60 bits, and its text to 60 more. A shard is a prefix of
those bits. Starting from the empty prefix, only shards over the byte limit are
split, each on its next bit, until every shard fits: a key that many rows have is
split by their texts. Copies of one key and text have the same bits; if they are
too many for a shard they are numbered, and the last bits of the number split them
(written after a colon). Only a single row over the limit does not fit. The
directory lists the shards by prefix; a row belongs to the one shard whose prefix
its hash starts with.

Splitting is monotone (a longer prefix never holds more bytes), so it needs no
row movement: rows are summed once into cells of ``STEP`` bits, the tree above
the cells is decided on those sums, and only cells that are still too large are
summed again with ``STEP`` more bits. What is joined to the rows is the
directory, whose size follows total bytes / limit, not the number of rows. Copies
are numbered within their input partitions, after the counts of the partitions
before, so no task holds them all.

Defined results: a null key and a null text hash as the empty text; a null text
has 0 bytes; ``fits`` is false for single rows over the limit only; an empty table
gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pliego.llm.common import written

KEY_BITS = 60
HASH_BITS = 2 * KEY_BITS
STEP = 12
#: Default production limit of a shard.
SHARD_BYTES = 16 << 20


def _sixty(value: Column) -> Column:
    hexed = F.substring(F.md5(F.coalesce(value.cast("string"), F.lit("")).cast("binary")), 1, KEY_BITS // 4)
    return F.lpad(F.bin(F.conv(hexed, 16, 10).cast("long")), KEY_BITS, "0")


def hash_bits(key: Column, text: Column) -> Column:
    """First 60 bits of the key's md5 and of the text's, as a string of 0 and 1."""
    return F.concat(_sixty(key), _sixty(text))


def directory(rows: DataFrame, limit: int) -> DataFrame:
    """(shard, depth, shard_bytes, shard_rows, more) of the rows ``(bits, size)``: ``more`` is how many bits of
    the copies' numbers split the shard on."""
    # a lone hash never splits, however many copies it has
    hashes = rows.groupBy("bits").agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    open_, done, depth = None, [], 0
    while True:
        reach = min(depth + STEP, HASH_BITS)
        src = hashes if open_ is None else hashes.join(
            open_, F.substring("bits", 1, depth) == F.col("shard"), "left_semi")
        cells = src.groupBy(F.substring("bits", 1, reach).alias("cell")).agg(
            F.sum("b").alias("b"), F.sum("n").alias("n"), F.count("*").alias("h"))
        # every prefix of a cell, from the depth reached before
        first = depth if open_ is None else depth + 1
        tree = (cells.withColumn("depth", F.explode(F.sequence(F.lit(first), F.lit(reach))))
                .groupBy("depth", F.expr("substring(cell, 1, depth)").alias("shard"))
                .agg(F.sum("b").alias("b"), F.sum("n").alias("n"), F.sum("h").alias("h"))
                .withColumn("over", (F.col("b") > limit) & (F.col("h") > 1)))
        # a shard exists if its parent was split and it is not split itself
        parent = (tree.filter("over").select(
            (F.col("depth") + 1).alias("pd"), F.col("shard").alias("ps")))
        born = tree.join(parent, (F.col("depth") == F.col("pd"))
                         & (F.expr("substring(shard, 1, depth - 1)") == F.col("ps")), "left_semi")
        if open_ is None:
            born = born.unionByName(tree.filter(F.col("depth") == 0))
        else:
            born = born.unionByName(tree.filter(F.col("depth") == first))
        born = born.checkpoint()
        done.append(born.filter(~F.col("over")))
        open_ = born.filter(F.col("over") & (F.col("depth") == reach)).select("shard")
        depth = reach
        if depth == HASH_BITS or open_.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    # copies of one row, of equal size: as many in a shard as the limit allows, one at least
    held = F.greatest(F.floor(F.lit(limit) * F.col("n") / F.greatest(F.col("b"), F.lit(1))), F.lit(1))
    parts = F.ceil(F.col("n") / held).cast("long")
    more = F.when((F.col("b") > limit) & (F.col("n") > 1), F.length(F.bin(parts - 1))).otherwise(F.lit(0))
    return out.select("shard", F.col("depth").cast("int").alias("depth"), F.col("b").alias("shard_bytes"),
                      F.col("n").alias("shard_rows"), more.cast("int").alias("more"))


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``i``, the number of each row in its shard, from 0."""
    rows = written(rows.withColumn("id", F.monotonically_increasing_id()), "copies").withColumn("part", F.shiftright("id", 33))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)   # a row a partition
    first = rows.groupBy("shard", "part").agg(F.count("*").alias("n")).select(
        F.col("shard").alias("s"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    local = F.row_number().over(Window.partitionBy("shard", "part").orderBy("id"))                    # rows of one input partition
    return (rows.withColumn("i", local - 1).join(first, (F.col("shard") == F.col("s")) & (F.col("part") == F.col("p")))
            .withColumn("i", F.col("i") + F.col("first")).drop("id", "part", "s", "p", "first"))


def _split_copies(placed: DataFrame, limit: int) -> DataFrame:
    """Rows with their shard's figures; those of shards with ``more`` go to the shard of their number's last bits."""
    some = placed.filter("more > 0")
    done = placed.filter("more = 0").withColumn("fits", F.col("shard_bytes") <= limit).drop("more")
    if some.isEmpty():
        return done
    ways = F.expr("shiftleft(1L, more)")
    share = F.floor(F.col("shard_rows") / ways) + (F.col("i") % ways < F.col("shard_rows") % ways).cast("long")
    split = (_numbered(some).withColumn("rows_", share.cast("long"))
             .withColumn("shard", F.concat("shard", F.lit(":"), F.lpad(F.bin(F.col("i") % ways), F.col("more"), F.lit("0"))))
             .withColumn("depth", F.col("depth") + F.col("more"))
             .withColumn("shard_bytes", (F.col("shard_bytes") / F.col("shard_rows") * F.col("rows_")).cast("long"))
             .withColumn("shard_rows", F.col("rows_")).withColumn("fits", F.col("shard_bytes") <= limit))
    return done.unionByName(split.select(*done.columns))


def assign_shards(docs: DataFrame, key: str = "doc_id", text: str = "text",
                  limit: int = SHARD_BYTES) -> DataFrame:
    """One row per document: key, its bytes, its shard and the shard's figures."""
    from pliego.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(docs.sparkSession)
    rows = docs.select(F.col(key).alias("k"), hash_bits(F.col(key), F.col(text)).alias("bits"),
                       F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("size"))
    shards = written(directory(rows.select("bits", "size"), limit), "directory")
    # At most HASH_BITS + 1 depths: a row looks up its prefix of each depth in use.
    depths = sorted(r.depth for r in shards.select("depth").distinct().collect())
    probe = rows.withColumn("p", F.explode(F.array(*[F.substring("bits", 1, d) for d in depths] or [F.lit(None).cast("string")])))
    placed = probe.join(shards, F.col("p") == F.col("shard")).drop("p", "bits")
    return _split_copies(placed, limit).select(F.col("k").alias(key), F.col("size").alias("n_bytes"), "shard", "depth",
                                               "shard_bytes", "shard_rows", "fits")


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text",
                 limit: int = SHARD_BYTES) -> DataFrame:
    """Write one folder per shard (``__shard=b<bits>``) and return the directory (shard, its rows and bytes)."""
    from pliego.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(docs.sparkSession)
    rows = docs.select(F.struct("*").alias("__row"), hash_bits(F.col(key), F.col(text)).alias("bits"),
                       F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("size"))
    shards = written(directory(rows.select("bits", "size"), limit), "directory")
    placed = None
    for d in sorted(r[0] for r in shards.select("depth").distinct().collect()):
        part = rows.withColumn("p", F.substring("bits", 1, d)).join(shards.filter(F.col("depth") == d), F.col("p") == F.col("shard"))
        placed = part if placed is None else placed.unionByName(part)
    if placed is None:
        docs.withColumn("__shard", F.lit("b")).write.partitionBy("__shard").parquet(path)
        return shards.select(F.lit("b").alias("shard"), "shard_rows", "shard_bytes").limit(0)
    out = _split_copies(placed.drop("p", "bits", "size"), limit)
    name = F.concat(F.lit("b"), F.replace("shard", F.lit(":"), F.lit("_")))
    out = out.withColumn("__shard", name)
    out.select("__row.*", "__shard").repartition("__shard").write.partitionBy("__shard").parquet(path)
    return out.groupBy(F.col("__shard").alias("shard")).agg(F.max("shard_rows").alias("shard_rows"), F.max("shard_bytes").alias("shard_bytes"))


def _sql_bits(value: str) -> str:
    return f"lpad(to_binary(('0x' || substr(md5(coalesce({value}, '')), 1, {KEY_BITS // 4}))::BIGINT), {KEY_BITS}, '0')"


SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
         {_sql_bits('doc_id::VARCHAR')} || {_sql_bits('text')} AS bits,
         row_number() OVER (PARTITION BY doc_id, text) - 1 AS i
  FROM documents),
t AS (
  SELECT depth, substr(bits, 1, depth) AS shard, sum(n_bytes)::BIGINT AS b, count(*)::BIGINT AS n, count(DISTINCT bits) AS h
  FROM d, (SELECT unnest(range(0, {HASH_BITS} + 1)) AS depth)
  GROUP BY 1, 2),
m AS (
  SELECT d.doc_id, d.n_bytes, d.bits, d.i, min(t.depth) AS depth
  FROM d JOIN t ON t.shard = substr(d.bits, 1, t.depth)
  WHERE t.b <= {SHARD_BYTES} OR t.h = 1
  GROUP BY ALL),
x AS (
  SELECT m.*, t.shard, t.b, t.n,
         CASE WHEN t.b > {SHARD_BYTES} AND t.n > 1
              THEN len(to_binary(ceil(t.n / greatest(floor({SHARD_BYTES} * t.n / t.b), 1))::BIGINT - 1)) ELSE 0 END AS more
  FROM m JOIN t ON t.depth = m.depth AND t.shard = substr(m.bits, 1, m.depth)),
y AS (
  SELECT *, CASE WHEN more = 0 THEN n ELSE n // (1::BIGINT << more) + (i % (1::BIGINT << more) < n % (1::BIGINT << more))::BIGINT END AS r FROM x)
SELECT doc_id, n_bytes, CASE WHEN more = 0 THEN shard ELSE shard || ':' || lpad(to_binary(i % (1::BIGINT << more)), more::INTEGER, '0') END AS shard,
       (depth + more)::INTEGER AS depth, (b // n * r + CASE WHEN more = 0 THEN b - b // n * n ELSE 0 END)::BIGINT AS shard_bytes,
       r AS shard_rows, (b // n * r + CASE WHEN more = 0 THEN b - b // n * n ELSE 0 END) <= {SHARD_BYTES} AS fits
FROM y
"""
