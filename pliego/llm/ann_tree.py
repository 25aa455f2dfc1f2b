"""Approximate nearest neighbours: hierarchical k-means tree with best-bin-first search.

The tree is fitted on a bounded hash sample (``SAMPLE_FLOATS`` numbers at most)
and is therefore small enough to broadcast whatever the table; every row is
assigned to a leaf. Leaves hold ``LEAF_ROWS`` rows or, where that would make more
than ``MAX_LEAVES`` of them, correspondingly more. A query walks the tree through a
priority queue of nodes, nearest centroid first, and visits leaves in that order.
Each query stops by its own margin: when the nearest node left is farther than its
first leaf by more than a calibrated difference. For up to ``PROBES`` rows the exact
neighbours are found by brute force over the whole table, in blocks, and the
difference is widened until they are found with recall ``RECALL``. A query goes on
until its leaves hold k + 1 rows.

Neighbouring leaves are packed into groups of up to ``GROUP_ROWS`` rows. A query
goes to the groups of its leaves and brings back k rows from each, however many of
the group's leaves it visits; it leaves out a leaf whose ball cannot hold anything
better than what it has. Leaves with more rows than a group are dealt into blocks,
and so are the queries of a group, so no task holds an unbounded group; a vector
that fills a third of the table is spread over many blocks. Inside a group a matrix
product preselects, and the returned score is computed again pair by pair in double
precision, so equal vectors score exactly alike.

Defined results: vectors that are null, empty, zero, or hold a null, NaN or
infinite component take no part, neither do null ids, nor vectors of another
dimension than most. Rows with the query's id are its own; other repeated rows
are candidates each. With fewer than k candidates all are returned, without any
none; ties go to the smaller id.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pliego.llm.common import ship, written

SAMPLE_FLOATS = 2_000_000
BRANCH = 8
LEAF_ROWS = 400
MAX_LEAVES = 4096
PROBES = 200
RECALL = 0.97
GROUPS = 16              # groups at least, so that small tables are searched in parallel too
GROUP_ROWS = 65_536
BLOCK_ROWS = 8192        # rows of one matrix product
BLOCK_QUERIES = 8192


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, assignment); fewer centroids if there are fewer different points."""
    k = min(k, len(x))
    cent = x[rng.choice(len(x), k, replace=False)]
    part = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        part = (x @ cent.T - 0.5 * (cent * cent).sum(1)).argmax(1)
        used, part = np.unique(part, return_inverse=True)
        cent = np.stack([x[part == i].mean(0) for i in range(len(used))])
    part = (x @ cent.T - 0.5 * (cent * cent).sum(1)).argmax(1)
    return cent, part


class Tree:
    """Nodes by number: centroid, children (empty for a leaf), leaf number (-1 inside)."""

    def __init__(self, x: np.ndarray, rows: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.cent, self.kids, self.leaf = [x.mean(0)], [[]], [-1]
        self.leaves = 0
        share = max(rows, 1) / len(x)  # table rows per sample row
        size = max(LEAF_ROWS, rows / MAX_LEAVES)
        todo = [(0, x)]
        while todo:
            node, part = todo.pop()
            if len(part) * share <= size or len(part) < 2 * BRANCH:
                self._close(node)
                continue
            cent, of = kmeans(part, BRANCH, rng)
            groups = [i for i in range(len(cent)) if (of == i).any()]
            if len(groups) < 2:
                self._close(node)
                continue
            for i in groups:
                self.kids[node].append(len(self.cent))
                todo.append((len(self.cent), part[of == i]))
                self.cent.append(cent[i]), self.kids.append([]), self.leaf.append(-1)
        self.cent = np.array(self.cent)
        self.half = 0.5 * (self.cent * self.cent).sum(1)

    def _close(self, node: int) -> None:
        self.leaf[node] = self.leaves
        self.leaves += 1

    def assign(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, at = todo.pop()
            kids = self.kids[node]
            if not kids:
                out[at] = self.leaf[node]
                continue
            best = (x[at] @ self.cent[kids].T - self.half[kids]).argmax(1)
            todo += [(kid, at[best == i]) for i, kid in enumerate(kids) if (best == i).any()]
        return out

    def path(self, q: np.ndarray, sizes: np.ndarray):
        """(leaf, level) in best-bin-first order; the level says how much farther than the first leaf the walk had to go."""
        near = self.half - self.cent @ q  # order of distances
        heap, first, level = [(0.0, 0)], None, 0.0
        while heap:
            at, node = heapq.heappop(heap)
            if first is not None:
                level = max(level, at - first)
            if self.leaf[node] >= 0 and sizes[self.leaf[node]]:
                first = at if first is None else first
                yield self.leaf[node], level
            for kid in self.kids[node]:
                heapq.heappush(heap, (near[kid], kid))

    def visits(self, q: np.ndarray, sizes: np.ndarray, margin: float, rows: int) -> list[int]:
        """Leaves within the margin, or until they hold ``rows`` rows."""
        out, held = [], 0
        for leaf, level in self.path(q, sizes):
            if level > margin and held >= rows:
                break
            out.append(leaf)
            held += sizes[leaf]
        return out


def pack_leaves(sizes: np.ndarray) -> tuple[list[list[int]], int]:
    """(groups of each leaf, number of groups): neighbours share a group, a leaf larger than one is spread over several."""
    rows = int(sizes.sum())
    limit = max(1, min(GROUP_ROWS, -(-rows // GROUPS)))
    groups, held, n = [], 0, 0
    for size in sizes.tolist():
        if held and held + size > limit:
            held, n = 0, n + 1
        if size > limit:
            parts = -(-size // limit)
            groups.append(list(range(n, n + parts)))
            held, n = 0, n + parts
        else:
            groups.append([n])
            held += size
    return groups, n + 1


def matrix(column, dim: int) -> np.ndarray:
    """An Arrow list column as (rows, dim) doubles."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def best_of(q: np.ndarray, qid: np.ndarray, x: np.ndarray, xid: np.ndarray, k: int):
    """(query index, row index, score) of each query's k best rows other than its own."""
    near = unit(q) @ unit(x).T
    near[qid[:, None] == xid[None, :]] = -np.inf
    qs, xs = [], []
    for i in range(len(q)):
        row = near[i]
        at = np.flatnonzero(row > -np.inf)
        if len(at) > k:
            least = np.partition(row[at], len(at) - k)[len(at) - k]
            at = at[row[at] >= least - 1e-9]
        qs.append(np.full(len(at), i))
        xs.append(at)
    qs, xs = np.concatenate(qs), np.concatenate(xs)
    score = np.empty(len(qs))
    for a in range(0, len(qs), 4096):
        u, v = q[qs[a:a + 4096]], x[xs[a:a + 4096]]
        score[a:a + 4096] = (u * v).sum(1) / (np.sqrt((u * u).sum(1)) * np.sqrt((v * v).sum(1)))
    order = np.lexsort([xid[xs], -score, qs])
    qs, xs, score = qs[order], xs[order], score[order]
    rank = np.arange(len(qs)) - np.searchsorted(qs, qs)
    keep = rank < k
    return qs[keep], xs[keep], score[keep]


def usable(vectors: DataFrame, key: str, vec: str) -> tuple[DataFrame, int, int]:
    """(rows (id, v) that take part, their dimension, their number)."""
    v = F.col("v")
    ok = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & v.isNotNull() & ok)
    dims = rows.groupBy(F.size("v").alias("m")).count().orderBy(F.desc("count"), "m").first()
    if dims is None:
        return rows, 0, 0
    return rows.filter(F.size("v") == dims["m"]), dims["m"], dims["count"]


def nearest(vectors: DataFrame, is_query: Column, key: str = "vec_id", vec: str = "embedding", k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows for which ``is_query`` (over ``id``) holds."""
    import pyarrow as pa

    from pliego.session import ensure_checkpoint_dir

    spark = vectors.sparkSession
    ensure_checkpoint_dir(spark)
    ship(__name__)
    rows, dim, n = usable(vectors, key, vec)
    shape = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], shape)
    draw = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30))
    bound = max(SAMPLE_FLOATS // dim, 2)
    fit = rows.filter(draw < int(min(1.0, 0.9 * bound / n) * (1 << 30))).limit(bound).toArrow()
    if not fit.num_rows:
        fit = rows.limit(bound).toArrow()
    order = np.argsort(fit["id"].to_numpy(), kind="stable")
    sample, ids = matrix(fit["v"], dim)[order], fit["id"].to_numpy()[order]
    tree = spark.sparkContext.broadcast(Tree(unit(sample), n))

    def place(batches):
        for b in batches:
            if b.num_rows:
                leaf = tree.value.assign(unit(matrix(b.column(1), dim)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(leaf)], ["id", "v", "leaf"])

    placed = written(rows.mapInArrow(place, "id long, v array<double>, leaf int"), "leaves")
    sizes = np.zeros(tree.value.leaves, np.int64)
    for r in placed.groupBy("leaf").count().collect():  # at most one row per leaf
        sizes[r["leaf"]] = r["count"]

    # calibration: exact neighbours of some rows, over the whole table, in blocks
    rng = np.random.default_rng(11)
    pick = np.sort(rng.choice(len(ids), min(PROBES, len(ids)), replace=False))
    probe = spark.sparkContext.broadcast((sample[pick], ids[pick]))

    def exact(batches):
        q, qid = probe.value
        for b in batches:
            x, xid = matrix(b.column(1), dim), b.column(0).to_numpy()
            leaf = b.column(2).to_numpy()
            for a in range(0, len(x), BLOCK_ROWS):
                qs, xs, s = best_of(q, qid, x[a:a + BLOCK_ROWS], xid[a:a + BLOCK_ROWS], k)
                yield pa.RecordBatch.from_arrays([pa.array(qs), pa.array(xid[a + xs]), pa.array(leaf[a + xs]), pa.array(s)],
                                                 ["q", "id", "leaf", "s"])

    ranked = Window.partitionBy("q").orderBy(F.desc("s"), "id")
    truth = (placed.mapInArrow(exact, "q long, id long, leaf int, s double")
             .withColumn("r", F.row_number().over(ranked)).filter(F.col("r") <= k).collect())
    levels = [dict(tree.value.path(q, sizes)) for q in unit(sample[pick])]
    needed = sorted(levels[r["q"]][r["leaf"]] for r in truth)
    margin = needed[min(len(needed) - 1, int(np.ceil(RECALL * len(needed))) - 1)] if needed else 0.0
    groups, n_groups = pack_leaves(sizes)
    # how far a leaf's rows lie from its centroid at most, as an angle
    node = np.empty(len(sizes), np.int64)
    node[[leaf for leaf in tree.value.leaf if leaf >= 0]] = [i for i, leaf in enumerate(tree.value.leaf) if leaf >= 0]
    centre = tree.value.cent[node]
    middle = spark.sparkContext.broadcast(centre / np.maximum(np.sqrt((centre * centre).sum(1)), 1e-30)[:, None])

    def spread(batches):
        widest = np.full(len(sizes), -1.0)
        for b in batches:
            if b.num_rows:
                leaf = b.column(1).to_numpy()
                angle = np.arccos(np.clip((unit(matrix(b.column(0), dim)) * middle.value[leaf]).sum(1), -1, 1))
                np.maximum.at(widest, leaf, angle)
        at = np.flatnonzero(widest >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(widest[at])], ["leaf", "angle"])

    radius = np.zeros(len(sizes))
    for r in placed.select("v", "leaf").mapInArrow(spread, "leaf int, angle double").groupBy("leaf").agg(F.max("angle").alias("a")).collect():
        radius[r["leaf"]] = r["a"]                                 # at most one row per leaf

    # queries to the groups of their leaves
    def walk(batches):
        for b in batches:
            q = unit(matrix(b.column(1), dim)) if b.num_rows else []
            at, group, leaves = [], [], []
            for i, v in enumerate(q):
                mine: dict[int, list[int]] = {}
                for leaf in tree.value.visits(v, sizes, margin, k + 1):
                    for g in groups[leaf]:
                        mine.setdefault(g, []).append(leaf)
                at += [i] * len(mine)
                group += mine.keys()
                leaves += mine.values()
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(group, pa.int32()),
                                              pa.array(leaves, pa.list_(pa.int32()))], ["id", "v", "g", "leaves"])

    asked = placed.filter(is_query).select("id", "v").dropDuplicates(["id"])
    asked = written(asked.mapInArrow(walk, "id long, v array<double>, g int, leaves array<int>"), "visits")
    wants = F.broadcast(asked.groupBy("g").agg(F.ceil(F.count("*") / BLOCK_QUERIES).alias("qb")))   # at most one row per group
    place_of = F.broadcast(spark.createDataFrame([(i, g) for i, g in enumerate(groups)], "leaf int, gs array<int>"))
    dealt = F.get("gs", F.pmod(F.xxhash64("id", F.lit("group")), F.size("gs")).cast("int"))
    left = (placed.join(place_of, "leaf").withColumn("g", dealt).join(wants, "g")
            .withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("qb") - 1))).select("g", "b", "id", "v", "leaf"))
    right = asked.join(wants, "g").withColumn("b", F.pmod(F.xxhash64("id"), F.col("qb"))).select("g", "b", "id", "v", "leaves")

    def match(rows_, queries_):
        if not rows_.num_rows or not queries_.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        leaf = rows_["leaf"].to_numpy()
        order = np.argsort(leaf, kind="stable")
        x, xid, leaf = matrix(rows_["v"], dim)[order], rows_["id"].to_numpy()[order], leaf[order]
        q, qid = matrix(queries_["v"], dim), queries_["id"].to_numpy()
        lists = queries_["leaves"].combine_chunks()
        owner = np.repeat(np.arange(len(q)), np.diff(lists.offsets.to_numpy()))
        wanted = lists.flatten().to_numpy(zero_copy_only=False)
        uq = unit(q)
        # the best of each query so far, found leaf by leaf
        score, best = np.full((len(q), k), -np.inf), np.full((len(q), k), -1)
        names, start = np.unique(leaf, return_index=True)
        for name, a, b in zip(names.tolist(), start.tolist(), [*start[1:].tolist(), len(leaf)]):
            ask = owner[wanted == name]
            angle = np.arccos(np.clip(uq[ask] @ middle.value[name], -1, 1))
            ask = ask[np.cos(np.maximum(angle - radius[name] - 1e-9, 0)) >= score[ask, -1]]
            for c in range(a, b, BLOCK_ROWS):
                for i in range(0, len(ask), 256):
                    at = ask[i:i + 256]
                    qs, xs, s = best_of(q[at], qid[at], x[c:min(c + BLOCK_ROWS, b)], xid[c:min(c + BLOCK_ROWS, b)], k)
                    found = np.full((len(at), k), -np.inf), np.full((len(at), k), -1)
                    rank = np.arange(len(qs)) - np.searchsorted(qs, qs)
                    found[0][qs, rank], found[1][qs, rank] = s, c + xs
                    both, ids_ = np.hstack([score[at], found[0]]), np.hstack([best[at], found[1]])
                    keep = np.lexsort([np.where(ids_ >= 0, xid[ids_], np.iinfo(np.int64).max), -both], axis=1)[:, :k]
                    score[at], best[at] = np.take_along_axis(both, keep, 1), np.take_along_axis(ids_, keep, 1)
        qs, rank = np.nonzero(best >= 0)
        return pa.table({"query_id": qid[qs], "vec_id": xid[best[qs, rank]], "score": score[qs, rank]})

    keys = ["g", "b"]
    pairs = (left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(match, "query_id long, vec_id long, score double"))
    top = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (pairs.withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def search_embeddings(vectors: DataFrame) -> DataFrame:
    """The registered query: the five nearest of every row whose vec_id is divisible by 50."""
    return nearest(vectors, F.col("id") % 50 == 0)
