"""Exact removal of repeated byte strings by merged Burrows-Wheeler transforms.

Every byte covered by a string of ``LENGTH`` bytes that also starts anywhere
else (same document included) is removed.

The suffixes that start such windows are dealt to buckets so that equal windows
meet: a window belongs to its anchor, the block of ``WIDTH`` bytes in it with the
smallest hash (the leftmost of equals). Consecutive windows with one anchor form
a context: one byte string of LENGTH + (windows - 1) bytes.

1. Scan: anchors that occur once in the corpus are dropped, all their windows
   are unique.
2. Equal contexts are counted into one weighted context, with map-side
   combining, so copies of a passage cost one context however many there are. A
   weighted context that is its anchor's only one needs no comparison.
3. The other contexts are dealt to buckets by anchor. In a bucket, shards sort
   their suffixes once, their transforms are merged by interleave refinement
   (``bwt``), and intervals of suffixes with LENGTH equal bytes and a weight of
   two or more are the repeated windows.
   An anchor with more than ``BUCKET_BYTES`` of different contexts would make
   one task grow with the corpus: its windows are grouped one by one instead, by
   a 128-bit hash of their bytes, which is exact and splits as far as needed.
4. Repeated windows go back to all members of their contexts, are united per
   document, and the rest of the bytes is kept.

Defined results: null and empty texts have 0 bytes and nothing removed; repeated
rows are copies of each other, so their windows are repeated; null doc_ids are
kept; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pliego.llm import bwt
from pliego.llm.common import bounded_batches, ship, text_blocks, written

LENGTH = 200
WIDTH = 40
BUCKET_BYTES = 2 << 20
SHARD_BYTES = 128 << 10
_PIECE = 256 << 10
_POS_BITS = 21


def _pieces(texts: list[str | None], length: int):
    """Blocks of (text number, offset, bytes): long texts are cut so that no window is lost."""
    block, size = [], 0
    for i, t in enumerate(texts):
        data = (t or "").encode()
        for a in range(0, max(len(data) - length + 1, 0), _PIECE):
            piece = data[a:a + _PIECE + length - 1]
            block.append((i, a, piece))
            size += len(piece)
            if size >= _PIECE:
                yield block
                block, size = [], 0
    if block:
        yield block


def find_anchors(block, length: int, width: int):
    """(text number, first window start, number of windows, anchor hash, context hash) of the block's contexts."""
    sizes = np.array([len(p) for _, _, p in block], np.int64)
    offs = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    buf = np.frombuffer(b"".join(p for _, _, p in block), np.uint8)
    with np.errstate(over="ignore"):
        h = bwt.block_hash(bwt.lanes(buf), width)
    mask = np.uint64((1 << _POS_BITS) - 1)
    key = (h & ~mask) | np.arange(len(h), dtype=np.uint64)
    span = length - width + 1
    # sliding minimum over span positions: of the rest of one row and the start of the next
    rows = -(-len(key) // span) + 1
    full = np.full(rows * span, np.iinfo(np.uint64).max, np.uint64)
    full[:len(key)] = key
    grid = full.reshape(rows, span)
    fore = np.minimum.accumulate(grid, axis=1).reshape(-1)
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    n = len(buf) - length + 1
    at = (np.minimum(back[:n], fore[span - 1:span - 1 + n]) & mask).astype(np.int64)
    valid = np.zeros(n + 1, np.int8)
    np.add.at(valid, offs, 1)
    np.add.at(valid, np.minimum(offs + sizes - length + 1, n), -1)
    valid = np.cumsum(valid[:n]) > 0
    fresh = np.empty(n, bool)
    fresh[0] = True
    fresh[1:] = (at[1:] != at[:-1]) | (valid[1:] != valid[:-1])
    first = np.flatnonzero(fresh)
    count = np.diff(np.append(first, n))
    keep = valid[first]
    first, count = first[keep], count[keep]
    anchor = h[at[first]]
    end = first + count + length - 1
    with np.errstate(over="ignore"):
        x = count.astype(np.uint64)
        for j in range(0, length, width):  # blocks from both ends cover the whole context
            x = (x ^ h[first + j]) * np.uint64(0xD6E8FEB86659FD93)
            x ^= x >> np.uint64(31)
            x = (x ^ h[end - width - j]) * np.uint64(0xA0761D6478BD642F)
            x ^= x >> np.uint64(30)
    owner = np.searchsorted(offs, first, side="right") - 1
    number = np.array([i for i, _, _ in block], np.int64)[owner]
    start = first - offs[owner] + np.array([a for _, a, _ in block], np.int64)[owner]
    return number, start, count, anchor.view(np.int64), x.view(np.int64)


def _anchor_rows(src: DataFrame, length: int, width: int) -> DataFrame:
    """(d, h, s, e, k, x) of every context; src has (d, h, text)."""
    import pyarrow as pa

    def run(batches):
        for (ids, hashes), texts in text_blocks(batches, 2):
            ids, hashes = pa.array(ids, key_type), pa.array(hashes, pa.int64())
            for block in _pieces(texts, length):
                number, s, e, k, x = find_anchors(block, length, width)
                at = pa.array(number)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(at), hashes.take(at), pa.array(s), pa.array(e.astype(np.int32)), pa.array(k), pa.array(x)],
                    ["d", "h", "s", "e", "k", "x"])

    from pyspark.sql.pandas.types import to_arrow_type

    kind = src.schema["d"].dataType
    key_type = to_arrow_type(kind)
    return src.mapInArrow(run, f"d {kind.simpleString()}, h long, s long, e int, k long, x long")


def _context_bytes(src: DataFrame, reps: DataFrame, length: int) -> DataFrame:
    """(k, x, c, bytes) of the representatives (d, h, s, e, k, x, c)."""
    import pyarrow as pa

    per_doc = reps.groupBy(F.col("d").alias("rd"), F.col("h").alias("rh")).agg(
        F.collect_list(F.struct("k", "x", "c", "s", "e")).alias("r"))
    both = src.join(per_doc, F.col("h").eqNullSafe(F.col("rh")) & F.col("d").eqNullSafe(F.col("rd"))).select("r", "text")

    def run(batches):
        for (wants,), texts in text_blocks(batches, 1):
            k, x, c, data = [], [], [], []
            for want, t in zip(wants, texts):
                raw = t.encode()
                for r in want:
                    k.append(r["k"]), x.append(r["x"]), c.append(r["c"])
                    data.append(raw[r["s"]:r["s"] + r["e"] + length - 1])
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(x, pa.int64()), pa.array(c, pa.int64()),
                                              pa.array(data, pa.binary())], ["k", "x", "c", "data"])

    return both.mapInArrow(run, "k long, x long, c long, data binary").dropDuplicates(["k", "x"])


def _runs(starts: np.ndarray) -> list[dict]:
    """Consecutive starts as ranges."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1)
    return [{"lo": int(a), "hi": int(b)} for a, b in
            zip(starts[np.concatenate([[0], cut + 1])], starts[np.concatenate([cut, [len(starts) - 1]])])]


_RANGES = "k long, x long, r array<struct<lo:int,hi:int>>"


def _merge_buckets(contexts: DataFrame, buckets: int, length: int, width: int) -> DataFrame:
    """Repeated ranges of window starts of each context, by merging transforms in each bucket."""
    import pandas as pd

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["k", "x"]).reset_index(drop=True)
        found = bwt.repeated_starts([bytes(b) for b in pdf["data"]], pdf["c"].to_numpy(np.float64), length, width, SHARD_BYTES)
        return pd.DataFrame({"k": pdf["k"], "x": pdf["x"], "r": [_runs(f) for f in found]})

    return contexts.withColumn("bucket", F.pmod(F.xxhash64("k"), F.lit(buckets))).groupBy("bucket").applyInPandas(
        lambda pdf: solve(pdf), _RANGES)


def _group_windows(contexts: DataFrame, length: int) -> DataFrame:
    """The same for anchors with too many contexts for one task: every window is grouped by its own hash."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for k, x, c, data in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                n = len(data) - length + 1
                w = [hashlib.blake2b(data[i:i + length], digest_size=16).digest() for i in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k] * n, pa.int64()), pa.array([x] * n, pa.int64()), pa.array([c] * n, pa.int64()),
                     pa.array(range(n), pa.int32()), pa.array(w, pa.binary())], ["k", "x", "c", "o", "w"])

    rows = contexts.select("k", "x", "c", "data").mapInArrow(run, "k long, x long, c long, o int, w binary")
    twice = rows.groupBy("w").agg(F.sum("c").alias("n")).filter("n > 1").select("w")
    return (rows.join(twice, "w", "left_semi").groupBy("k", "x")
            .agg(F.transform(F.collect_set("o"), lambda o: F.struct(o.alias("lo"), o.alias("hi"))).alias("r")))


def repeated_spans(docs: DataFrame, doc: str = "doc_id", text: str = "text", length: int = LENGTH,
                   width: int = WIDTH) -> DataFrame:
    """(d, h, spans): of each document with repeated strings, the byte ranges [s, e) they cover, not united."""
    if length % width or width % 8 or length < 2 * width:
        raise ValueError("length must be a multiple, at least twofold, of width, and width a multiple of 8")
    bounded_batches(docs.sparkSession)
    ship(bwt.__name__)
    ship(__name__)
    src = docs.select(F.col(doc).alias("d"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    anchors = _anchor_rows(src, length, width)
    # written first: a join of two plain shuffles is one that Spark can split at a hot anchor
    again = written(anchors.groupBy("k").agg(F.count("*").alias("m")).filter("m > 1").select("k"), "anchors")
    members = written(anchors.join(again, "k", "left_semi"), "contexts")
    classes = members.groupBy("k", "x").agg(F.count("*").alias("c"), F.min(F.struct("s", "e", "h", "d")).alias("r"))
    classes = written(classes.select("k", "x", "c", "r.*"), "classes")
    per = classes.groupBy("k").agg(F.count("*").alias("nx"), F.sum(F.col("e") + length - 1).alias("size"))
    alone = classes.join(per.filter("nx = 1").select("k"), "k", "left_semi").select(
        "k", "x", F.array(F.struct(F.lit(0).alias("lo"), (F.col("e") - 1).alias("hi"))).alias("r"))
    many = classes.join(per.filter("nx > 1"), "k").select("k", "x", "c", "d", "h", "s", "e", "size")
    total = per.filter(f"nx > 1 AND size <= {BUCKET_BYTES}").agg(F.sum("size")).first()[0] or 0
    bytes_of = written(_context_bytes(src, many, length), "bytes")
    large = per.filter(f"nx > 1 AND size > {BUCKET_BYTES}").select("k").checkpoint()
    ranges = alone.unionByName(_merge_buckets(
        bytes_of.join(large, "k", "left_anti"), int(8 * total // BUCKET_BYTES) + 1, length, width))
    if not large.isEmpty():
        ranges = ranges.unionByName(_group_windows(bytes_of.join(large, "k", "left_semi"), length))
    found = ranges.filter(F.size("r") > 0)
    spans = members.join(found, ["k", "x"]).select("d", "h", "s", F.explode("r").alias("g")).select(
        "d", "h", (F.col("s") + F.col("g.lo")).alias("a"), (F.col("s") + F.col("g.hi") + length).alias("b"))
    return spans.groupBy("d", "h").agg(F.collect_set(F.struct("a", "b")).alias("spans"))


def cut(data: bytes, spans) -> tuple[bytes, int, int]:
    """(bytes left, bytes removed, maximal removed runs)."""
    left, at, runs, gone = [], 0, 0, 0
    end = -1
    for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
        if a > end:
            runs += 1
            left.append(data[at:a])
            gone += b - a
            end = at = b
        elif b > end:
            gone += b - end
            end = at = b
    left.append(data[at:])
    return b"".join(left), gone, runs


def _with_spans(docs: DataFrame, doc: str, text: str, length: int) -> DataFrame:
    from pliego.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(docs.sparkSession)
    spans = written(repeated_spans(docs, doc, text, length), "spans")
    spans = spans.select(F.col("d").alias("__d"), F.col("h").alias("__h"), "spans").withColumnRenamed("spans", "__spans")
    return docs.join(spans, F.col("__d").eqNullSafe(docs[doc]) & (F.col("__h") == F.xxhash64(docs[text])), "left")


def dedup_report(docs: DataFrame, doc: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """Per row: doc, n_bytes, n_removed, n_spans, kept_sha256."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[doc].dataType
    key_type = to_arrow_type(kind)
    both = _with_spans(docs.select(doc, text), doc, text, length).select(doc, "__spans", text)

    def run(batches):
        for (ids, spans), texts in text_blocks(batches, 2):
            n, gone, runs, sha = [], [], [], []
            for s, t in zip(spans, texts):
                data = (t or "").encode()
                kept, g, r = cut(data, s)
                n.append(len(data)), gone.append(g), runs.append(r), sha.append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, key_type), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()),
                 pa.array(sha, pa.string())], [doc, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return both.mapInArrow(run, f"`{doc}` {kind.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, doc: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """The documents with their repeated strings cut out, all columns kept.

    Bytes of a character that was cut in two are left out. A document of which
    nothing but white space is left goes; one that was empty before stays.
    """
    import pyarrow as pa

    both = _with_spans(docs, doc, text, length)
    rest = [c for c in docs.columns if c != text]
    from pyspark.sql.types import StructType

    schema = StructType([docs.schema[c] for c in [*rest, text]])

    def run(batches):
        for batch in batches:
            keep, texts = [], []
            for i, (s, t) in enumerate(zip(batch.column(len(rest)).to_pylist(), batch.column(len(rest) + 1).to_pylist())):
                if s:
                    t = cut(t.encode(), s)[0].decode(errors="ignore")
                    if not t.strip():
                        continue
                keep.append(i)
                texts.append(t)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(i).take(at) for i in range(len(rest))],
                                              pa.array(texts, pa.string())], schema.names)

    return both.select(*rest, "__spans", text).mapInArrow(run, schema).select(*docs.columns)
