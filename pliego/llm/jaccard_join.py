"""N-gram Jaccard self-join by vertical partitioning, and the groups its links form.

A document is the set of its distinct word n-grams. All n-grams have one global
order, rare ones first: by the power of two of their document frequency (from a
count sketch of fixed size, summed over all documents) and then by hash. The
order only steers the work: any order gives the same links.

1. Equal sets become one class, counted with map-side combining. Copies are
   never paired with each other.
2. Prefix: two sets with Jaccard similarity of at least t share an n-gram among
   the first ``n - ceil(t n) + 1`` of each, and their sizes lie in one of the
   bands of ratio 1 / t or in two that follow each other. N-grams that no other
   prefix of such a size has are dropped; how many a class loses that way bounds
   its overlap with any class whose prefix reaches at least as far.
3. Classes that share a prefix n-gram and a band are candidates: each class is
   at home in the group of its own band and a guest in the next one's, and a
   pair has one at home. Groups of up to ``SMALL``
   give all their pairs. A larger group gives each class paired with the hub
   (the class with most copies) and with its run of about ``SMALL`` classes:
   linear in the group.
4. Vertical partitioning: the global order is cut into ``FRAGMENTS`` ranges of
   equal weight; every candidate pair's overlap is counted in each fragment
   separately and summed per pair.
5. Links connect classes. Large groups whose classes are not all connected yet
   give the pairs between different components, except those that the size
   bound rules out or that were counted before; steps 4 and 5 repeat with the
   groups that are still apart until none is left. So no link between different texts is lost, and pairs inside
   one connected group need not be made.

``n`` words and the threshold in percent are parameters (3 and 90 in the
registered query; near-duplicate stages use 5 and 80).

Defined results: null text, or text without words, has the empty set and links
with nothing; a text of fewer than n words is one n-gram; repeated rows are one
class and get a row each; a null doc_id is never a component's id unless all
ids of the component are null. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pliego.llm import shingles
from pliego.llm.common import bounded_batches, discard, ship, text_blocks, written
from pliego.llm.components import connected_components
from pliego.session import ensure_checkpoint_dir

WORDS, PERCENT = 3, 90
#: A group of candidates: an n-gram, and the sizes that can be linked.
GROUP = ["k", "band"]
SMALL = 8
FRAGMENTS = 4
#: Counters of the frequency sketch (4 MB), whatever the corpus.
SKETCH_BITS = 20
#: Class keys that may be broadcast to select the texts of candidates; more are joined by a shuffle.
BROADCAST_KEYS = 500_000
_BLOCK = 256 << 10
_CHUNK_BITS = 14


def _sets(batches, n: int, keys: int):
    """(keys, set) of every row, in small blocks that stay in the processor's cache."""
    for cols, texts in text_blocks(batches, keys):
        first = size = 0
        for i, t in enumerate(texts):
            size += len(t) if t else 0
            if size >= _BLOCK or i == len(texts) - 1:
                block = shingles.Words(texts[first:i + 1])
                yield [c[first:i + 1] for c in cols], block.sets(n)
                first, size = i + 1, 0


def frequency_levels(docs: DataFrame, text: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(level of each sketch slot, weight of each level): bit length of the slot's document frequency."""
    import pandas as pd
    import pyarrow as pa

    slots, chunk = 1 << SKETCH_BITS, 1 << _CHUNK_BITS

    def count(batches):
        from pyspark import TaskContext

        total = np.zeros(slots, np.int64)
        for _, sets in _sets(batches, n, 0):
            total += np.bincount(np.concatenate([*sets, np.empty(0, np.uint64)]) >> np.uint64(64 - SKETCH_BITS),
                                 minlength=slots)
        salt = TaskContext.get().partitionId() % 64
        parts = [total[i:i + chunk].astype("<i8") for i in range(0, slots, chunk)]
        if total.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(parts)), pa.int32()), pa.array(np.full(len(parts), salt), pa.int32()),
                 pa.array([p.tobytes() for p in parts], pa.binary())], ["chunk", "salt", "data"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(d, "<i8") for d in pdf["data"]], axis=0)
        return pd.DataFrame({"chunk": pdf["chunk"][:1], "salt": pdf["salt"][:1], "data": [total.tobytes()]})

    schema = "chunk int, salt int, data binary"
    parts = docs.select(text).mapInArrow(count, schema)
    parts = parts.groupBy("chunk", "salt").applyInPandas(add, schema)
    parts = parts.groupBy("chunk").applyInPandas(add, schema).collect()  # 64 chunks, 8 MB
    total = np.zeros(slots, np.int64)
    for r in parts:
        total[r["chunk"] * chunk:(r["chunk"] + 1) * chunk] = np.frombuffer(r["data"], "<i8")
    level = np.ceil(np.log2(total + 1)).astype(np.uint8)
    return level, np.bincount(level, weights=total, minlength=65)


def order_keys(grams: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The n-grams in global order, as non-negative 64-bit keys."""
    lv = level[(grams >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64)
    # the sketch used the top bits: mix before cutting seven of them off
    return np.sort((lv << np.uint64(57)) | (shingles.mix(grams) >> np.uint64(7))).astype(np.int64)


def fragment_limits(weight: np.ndarray, fragments: int = FRAGMENTS) -> np.ndarray:
    """Keys that cut the order into ranges of about equal weight."""
    total = weight.cumsum()
    if not total[-1]:
        return np.zeros(0, np.int64)
    cuts = []
    for i in range(1, fragments):
        goal = total[-1] * i / fragments
        lv = int(np.searchsorted(total, goal))
        part = (goal - (total[lv - 1] if lv else 0)) / max(weight[lv], 1)
        cuts.append((lv << 57) + int(part * (1 << 57)))
    return np.array(cuts, np.int64)


def class_of(grams: np.ndarray) -> int:
    """64-bit key of a set."""
    return int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=8).digest(), "little", signed=True)


def _describe(docs: DataFrame, doc: str, text: str, n: int, percent: int, level) -> DataFrame:
    """Per row: doc, hash of the text, class, size of the set, prefix keys."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    key_type = to_arrow_type(docs.schema[doc].dataType)

    def run(batches):
        for (ids, hashes), sets in _sets(batches, n, 2):
            cls, size, prefix = [], [], []
            for s in sets:
                m = len(s)
                size.append(m)
                cls.append(class_of(s) if m else None)
                prefix.append(order_keys(s, level.value)[:m - (percent * m + 99) // 100 + 1] if m else None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, key_type), pa.array(hashes, pa.int64()), pa.array(cls, pa.int64()),
                 pa.array(size, pa.int64()), pa.array(prefix, pa.list_(pa.int64()))], ["d", "h", "c", "n", "prefix"])

    src = docs.select(F.col(doc), F.xxhash64(text).alias("__h"), F.col(text))
    return src.mapInArrow(run, f"d {docs.schema[doc].dataType.simpleString()}, h long, c long, n long, prefix array<long>")


def _segments(docs: DataFrame, doc: str, text: str, n: int, nodes: DataFrame, level, cuts: np.ndarray) -> DataFrame:
    """(c, f, seg): the classes of ``nodes``, their keys cut into fragments."""
    import pyarrow as pa

    few = nodes.count() <= BROADCAST_KEYS
    nodes = nodes.select(F.col("c").alias("__c"), F.col("d").alias("__d"), F.col("h").alias("__hh"))
    src = docs.select(F.col(doc).alias("__id"), F.xxhash64(text).alias("__h"), F.col(text))
    src = src.join(F.broadcast(nodes) if few else nodes,
                   (F.col("__h") == F.col("__hh")) & F.col("__id").eqNullSafe(F.col("__d"))).select("__c", text)

    def run(batches):
        for (want,), sets in _sets(batches, n, 1):
            c, f, seg = [], [], []
            for w, s in zip(want, sets):
                if not len(s) or class_of(s) != w:
                    continue
                keys = order_keys(s, level.value)
                at = [0, *np.searchsorted(keys, cuts).tolist(), len(keys)]
                for i, (a, b) in enumerate(zip(at, at[1:])):
                    if b > a:
                        c.append(w)
                        f.append(i)
                        seg.append(keys[a:b])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(f, pa.int32()),
                                              pa.array(seg, pa.list_(pa.int64()))], ["c", "f", "seg"])

    # rows with the same id and text give the same segments
    return src.mapInArrow(run, "c long, f int, seg array<long>").groupBy("c", "f").agg(F.first("seg").alias("seg"))


def _links(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, na, nb) whose overlaps, summed over the fragments, reach the threshold."""
    left = segments.select(F.col("c").alias("a"), "f", F.col("seg").alias("sa"))
    right = segments.select(F.col("c").alias("b"), "f", F.col("seg").alias("sb"))
    part = pairs.join(left, "a").join(right, ["b", "f"]).select(
        "a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).cast("long").alias("o"))
    return (part.groupBy("a", "b", "na", "nb").agg(F.sum("o").alias("o"))
            .filter((100 + percent) * F.col("o") >= percent * (F.col("na") + F.col("nb"))).select("a", "b"))


def _whole(percent: int) -> str:
    """Whether the set whose prefix ends first can have the overlap that classes a and b need.

    Only its own prefix n-grams are sure to be in the other's prefix if they are in
    the other set: those of the longer-reaching prefix may lie beyond the shorter one.
    """
    return f"{100 + percent} * CASE WHEN a.last < b.last THEN a.e ELSE b.e END >= {percent} * (a.n + b.n)"


def _possible(percent: int):
    """Whether the classes of rows a and b, which share an n-gram, can be linked by what the row of each says.

    The size of the set whose prefix ends first, without n-grams that no other prefix
    has; the n-gram's place in the short prefix of the smaller set; and the most that
    can lie before and after it.
    """
    return F.expr(f"{_whole(percent)} "
                  "AND CASE WHEN a.n < b.n OR (a.n = b.n AND a.c < b.c) THEN a.q ELSE b.q END "
                  f"AND {100 + percent} * (least(a.r, b.r) + least(a.n - a.i, b.n - b.i)) >= {percent} * (a.n + b.n)")


def size_band(percent: int):
    """Band of the size n: the sizes of two sets that can be linked lie in one band or in two that follow each other."""
    # a little wider than the largest ratio of linked sizes, so that rounding cannot put a band between them
    return F.floor(F.ln("n") / (math.log(100 / min(percent, 99)) * (1 + 1e-9))).cast("int")


def comparable(tokens: DataFrame) -> DataFrame:
    """The rows (c, band, i, k) whose n-gram another class of the same or a neighbouring band may have; written.

    An n-gram keeps the set of its bands as 64 bits, which meet again after 64 bands, and its number
    of classes: if that is larger than the number of bits, two of them may be in one band.
    """
    bit = lambda shift: F.expr(f"shiftleft(1L, (band + {shift}) % 64)")
    seen = tokens.groupBy("k").agg(F.count("*").alias("m"), F.bit_or(bit(0)).alias("bands")).filter("m > 1")
    seen = written(seen, "seen")  # the shuffle that counts is off the disks before the tokens are shuffled for the join
    near = F.col("bands").bitwiseAND(bit(1).bitwiseOR(bit(63))) != 0
    out = tokens.join(seen, "k").filter(near | (F.col("m") > F.bit_count("bands"))).select("c", "band", "i", "k")
    out = written(out, "shared")
    discard(seen)
    return out


def jaccard_groups(docs: DataFrame, doc: str = "doc_id", text: str = "text", n: int = WORDS,
                   percent: int = PERCENT) -> DataFrame:
    """Per row: d, h (hash of the text), n (size of the set), root (its group), component (smallest doc of it)."""
    spark: SparkSession = docs.sparkSession
    ensure_checkpoint_dir(spark)
    bounded_batches(spark)
    ship(shingles.__name__)
    ship(__name__)
    slots, weight = frequency_levels(docs, text, n)
    level, cuts = spark.sparkContext.broadcast(slots), fragment_limits(weight)
    sets = written(_describe(docs, doc, text, n, percent, level), "sets")

    # prefixes, nearly all of these tables, stay on the disks as one copy and only until they are tokens
    prefixes = written(sets.filter("c IS NOT NULL").groupBy("c").agg(
        F.min(F.struct(F.col("d").isNull().alias("z"), "d", "h")).alias("rep"), F.min("n").alias("n"),
        F.count("*").alias("copies"), F.first("prefix").alias("prefix")), "prefixes")
    rows = written(sets.select("d", "h", "c", "n"), "rows")
    discard(sets)
    classes = written(prefixes.select("c", "rep", "n", "copies", F.size("prefix").alias("p"),
                                      F.element_at("prefix", -1).alias("last")), "classes")
    facts = classes.select("c", "n", "copies", "p", "last")
    tokens = shared_tokens = comparable(prefixes.select(
        "c", size_band(percent).alias("band"), F.posexplode("prefix").alias("i", "k")))
    discard(prefixes)
    # a class is at home in its own band's group and a guest in the next one's
    tokens = tokens.withColumn("home", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn(
        "band", F.expr("IF(home, band, band + 1)"))
    groups = tokens.groupBy("k", "band").agg(F.count("*").alias("m"), F.max("home").alias("any")).filter("m > 1 AND any").drop("any")
    tokens = grouped = written(tokens.join(groups, GROUP), "grouped")
    discard(shared_tokens)
    in_order, whole = Window.partitionBy("c").orderBy("i"), Window.partitionBy("c")  # within one prefix
    tokens = tokens.withColumn("r", F.dense_rank().over(in_order) - 1).select(
        "*", (F.max("r").over(whole) + 1).alias("in_common"),
        F.size(F.collect_set(F.expr(f"CASE WHEN m > {SMALL} THEN i END")).over(whole)).alias("wide"))
    # n-grams of its prefix that no other prefix of a like size has cannot be in an overlap with a set whose prefix reaches as far
    tokens = tokens.join(facts, "c").select(
        "c", "n", "p", (F.col("n") - F.col("p") + F.col("in_common")).alias("e"), "i", "r", "last", "copies", "wide", *GROUP,
        "home", "m",
        F.expr(f"i <= n - ({2 * percent} * n + {99 + percent}) div {100 + percent}").alias("q"),
        F.expr(f"CASE WHEN m > {SMALL} THEN c & (shiftleft(1L, CAST(ceil(log2(m / {SMALL}D)) AS int)) - 1) ELSE 0 END").alias("run"))
    tokens = written(tokens, "tokens")
    discard(grouped)

    # shared n-grams of large groups, of which not every pair is made, and the rest of
    # the set whose prefix ends first: what a pair's overlap may have besides its small groups
    rest = F.expr("least(a.wide, b.wide) + CASE WHEN a.last < b.last THEN a.n - a.p ELSE b.n - b.p END").alias("rest")
    same = "a.k = b.k AND a.band = b.band AND (a.home OR b.home)"
    a, b = tokens.alias("a"), tokens.alias("b")
    near = a.join(b, F.expr(f"{same} AND a.run = b.run AND a.c < b.c AND {_whole(percent)}")).select(
        F.col("a.c").alias("a"), F.col("b.c").alias("b"), F.col("a.n").alias("na"), F.col("b.n").alias("nb"), rest,
        F.expr(f"CAST(a.m <= {SMALL} AS int)").alias("one"), _possible(percent).alias("ok"))
    hubs = (tokens.filter(f"m > {SMALL} AND home").groupBy(*GROUP)
            .agg(F.min(F.struct((-F.col("copies")).alias("x"), "c", "n", "p", "e", "i", "r", "q", "last", "wide", "home")).alias("hub"))
            .select(*GROUP, "hub.*"))
    a, b = tokens.filter(f"m > {SMALL}").alias("a"), hubs.alias("b")
    star = a.join(b, F.expr(f"{same} AND a.c <> b.c") & _possible(percent)).select(
        F.least("a.c", "b.c").alias("a"), F.greatest("a.c", "b.c").alias("b"),
        F.expr("CASE WHEN a.c < b.c THEN a.n ELSE b.n END").alias("na"),
        F.expr("CASE WHEN a.c < b.c THEN b.n ELSE a.n END").alias("nb"), rest, F.lit(0).alias("one"), F.lit(True).alias("ok"))
    pairs = near.unionByName(star).groupBy("a", "b").agg(
        F.max("na").alias("na"), F.max("nb").alias("nb"), F.max("ok").alias("ok"),
        (F.sum("one") + F.max("rest")).alias("most")).filter("ok")
    pairs = pairs.filter((100 + percent) * F.col("most") >= percent * (F.col("na") + F.col("nb")))
    pairs = written(pairs.select("a", "b", "na", "nb"), "pairs")

    reps = classes.select("c", F.col("rep.d").alias("d"), F.col("rep.h").alias("h"))
    # the large groups that can still give pairs: one of the pair has the n-gram in its short prefix
    place = [*GROUP, "home", "c", "n", "e", "i", "r", "q", "last"]
    large = tokens.filter(f"m > {SMALL}").select(*place)
    large = large.join(large.filter("q").select(*GROUP).distinct(), GROUP, "left_semi")
    tested, links, comps, apart = None, None, None, None
    while True:
        nodes = pairs.select(F.col("a").alias("c")).union(pairs.select("b")).distinct()
        segments = written(_segments(docs, doc, text, n, reps.join(nodes, "c"), level, cuts), "segments")
        found = written(_links(pairs, segments, percent), "links")
        discard(segments)
        tested = pairs if tested is None else tested.unionByName(pairs)
        links = found if links is None else links.unionByName(found)
        comps = connected_components(links).checkpoint()
        # large groups with classes of different components; one that has become one component stays so
        wide = large.join(comps, F.col("c") == F.col("node"), "left").select(*place, F.coalesce("root", "c").alias("g"))
        sizes = wide.groupBy(*GROUP, "g").agg(F.count("*").alias("s"))
        main = sizes.groupBy(*GROUP).agg(F.max(F.struct("s", "g")).alias("x"), F.count("*").alias("gs")).filter("gs > 1")
        wide = written(wide.join(main.select(*GROUP, F.col("x.g").alias("main")), GROUP), "apart")
        if apart is not None:
            discard(apart)
        apart, large = wide, wide.select(*place)
        a, b = wide.filter("g <> main").alias("a"), wide.alias("b")
        more = (a.join(b, F.expr(f"{same} AND a.g <> b.g AND (b.g = b.main OR a.c < b.c)") & _possible(percent))
                .select(F.least("a.c", "b.c").alias("a"), F.greatest("a.c", "b.c").alias("b"),
                        F.expr("CASE WHEN a.c < b.c THEN a.n ELSE b.n END").alias("na"),
                        F.expr("CASE WHEN a.c < b.c THEN b.n ELSE a.n END").alias("nb")).distinct()
                .join(tested.select("a", "b"), ["a", "b"], "left_anti"))
        pairs = written(more, "pairs")
        if pairs.isEmpty():
            break

    # classes that are alone keep their own smallest document
    docs_of = classes.filter("copies > 1").select("c", F.col("rep.d").alias("low")).unionByName(
        classes.filter("copies = 1").join(comps, F.col("c") == F.col("node"), "left_semi").select("c", F.col("rep.d").alias("low")))
    placed = docs_of.join(comps, F.col("c") == F.col("node"), "left").select(
        "c", F.coalesce("root", "c").alias("root"), "low")
    lows = placed.groupBy("root").agg(F.min("low").alias("component"))
    placed = placed.join(lows, "root").select(F.col("c").alias("__c"), "root", "component", F.lit(True).alias("__in"))
    out = rows.select("d", "h", "c", "n").join(placed, F.col("c") == F.col("__c"), "left")
    return out.select("d", "h", "n", F.coalesce("root", "c").alias("root"),
                      F.when(F.col("__in"), F.col("component")).otherwise(F.col("d")).alias("component"))


def near_duplicates(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The registered query: doc_id, n_shingles, component_id."""
    return jaccard_groups(docs, n=n, percent=percent).select(
        F.col("d").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def keep_one_of_each(docs: DataFrame, doc: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group (its smallest id), all columns kept; documents without words all stay."""
    groups = jaccard_groups(docs, doc, text, n, percent)
    keep = (groups.filter("n > 0").groupBy("root")
            .agg(F.min(F.struct(F.col("d").isNull().alias("z"), "d", "h")).alias("r"))
            .select(F.col("r.d").alias("__d"), F.col("r.h").alias("__h"), F.lit(True).alias("__z")))
    keep = keep.unionByName(groups.filter("n = 0").select(
        F.col("d").alias("__d"), F.col("h").alias("__h"), F.lit(False).alias("__z")).distinct())
    out = docs.join(keep, F.col(doc).eqNullSafe(F.col("__d")) & F.xxhash64(text).eqNullSafe(F.col("__h")))
    # rows with equal id and text are one document
    twice = (groups.filter("n > 0").groupBy("d", "h").agg(F.count("*").alias("m")).filter("m > 1")
             .select(F.col("d").alias("__d2"), F.col("h").alias("__h2")).checkpoint())
    if twice.isEmpty():
        return out.select(*docs.columns)
    both = out.join(twice, F.col("__d").eqNullSafe(F.col("__d2")) & (F.col("__h") == F.col("__h2")) & F.col("__z"), "left")
    rest = both.filter("__h2 IS NULL").select(*docs.columns)
    return rest.unionByName(both.filter("__h2 IS NOT NULL").dropDuplicates(["__d", "__h"]).select(*docs.columns))
