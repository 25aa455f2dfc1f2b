"""Quality by Bradley-Terry ranking.

A document's score is linear in features of its whole text. The weights come
from preference pairs (a document marked good, one marked bad): logistic loss on
the difference of their features, solved by Newton steps with a small ridge.
The threshold is the quantile of the training scores at the share of bad
documents; ``score`` is the logistic function of the distance to it, so a score
of 0.5 is the threshold.

Every labelled document is learned from, and every pair of a good and a bad one
counts once, though no pair is made: what a document's pairs add depends on its
score and the scores of the other class. Each step sums the documents' features
by class and score (cells of ``CELL``, a document dealt to the two nearest
points), which says what all pairs add to the gradient and to the mixed terms of
the Hessian; a second pass adds the documents' own terms. Tasks sum, Spark adds
the sums up, and the driver holds the cells only: their number follows the range
of the scores, not the corpus.

The features of all texts are computed once and written; training and scoring
read them from there.

Defined results: null and empty texts get the features of the empty text; with
one class of labels or none every score is 0.5; repeated rows get a row each;
null doc_ids are kept; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pliego.llm.common import bounded_batches, crc_mod, ship, text_blocks, written
from pliego.operators.quantiles import exact_quantiles

RIDGE = 1e-3
#: Distance of the points to which scores are dealt; a pair's probability changes little over it.
CELL = 1 / 16

# byte classes: 0 other ASCII, 1 lower, 2 upper, 3 digit, 4 space, 5 newline, 6 sentence mark, 7 comma, 8 symbol, 9 above ASCII
_CLASS = np.zeros(256, np.uint8)
_CLASS[ord("a"):ord("z") + 1] = 1
_CLASS[ord("A"):ord("Z") + 1] = 2
_CLASS[ord("0"):ord("9") + 1] = 3
_CLASS[[9, 32]] = 4
_CLASS[[10, 13]] = 5
_CLASS[[ord(c) for c in ".!?"]] = 6
_CLASS[[ord(c) for c in ",;:'\"-()"]] = 7
_CLASS[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = 8
_CLASS[128:] = 9
_ENDS = re.compile(r"[.!?]\s")

FEATURES = 26


def features(text: str | None) -> np.ndarray:
    """Length, shares of byte classes, and shape of words, lines and repetition of the whole text."""
    f = np.zeros(FEATURES)
    if not text:
        return f
    data = text.encode()
    f[:10] = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=10) / len(data)
    f[10] = np.log1p(len(data))
    f[11] = len(zlib.compress(data, 1)) / (len(data) + 20)
    words = text.split()
    n = len(words)
    if not n:
        return f
    sizes = np.fromiter(map(len, words), np.float64, n)
    seen = Counter(words)
    f[12:14] = sizes.mean(), sizes.std()
    f[14] = sizes.max() / n
    f[15] = len(seen) / n
    f[16] = np.log(len(seen)) / np.log(n + 1)
    f[17] = max(seen.values()) / n
    f[18] = np.mean([w.isupper() for w in words])
    f[19] = np.mean([w.isalpha() for w in words])
    f[20] = np.mean([w.istitle() for w in words])
    f[21] = np.mean(sizes == 1)
    lines = text.split("\n")
    f[22] = len(set(lines)) / len(lines)
    f[23] = np.log1p(len(data) / len(lines))
    f[24] = np.mean([x.rstrip()[-1:] in (".", "!", "?") for x in lines])
    f[25] = np.log1p(n / (1 + len(_ENDS.findall(text))))
    return f


class Ranker:
    """Bradley-Terry weights on standardised features and their squares, and the score threshold."""

    def __init__(self, mean: np.ndarray, std: np.ndarray):
        self.mean, self.std = mean, std + 1e-6
        self.w, self.threshold = np.zeros(2 * len(mean)), 0.0

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.std, -6, 6)
        return np.concatenate([z, z * z], axis=1)

    def raw(self, z: np.ndarray) -> np.ndarray:
        return (z * self.w).sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        s = self.raw(self.expand(x)) - self.threshold
        return 1 / (1 + np.exp(-np.clip(s, -30, 30)))


def describe(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc and f, the features of the whole text; written."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    bounded_batches(docs.sparkSession)
    ship(__name__)
    key_type = to_arrow_type(docs.schema[doc].dataType)

    def run(batches):
        for (keys,), texts in text_blocks(batches, 1):
            x = [features(t) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(keys, key_type), pa.array(x, pa.list_(pa.float64()))], [doc, "f"])

    kind = docs.schema[doc].dataType.simpleString()
    return written(docs.select(doc, text).mapInArrow(run, f"`{doc}` {kind}, f array<double>"), "features")


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), FEATURES)


def _sums(rows: DataFrame, part, width: int) -> dict[int, np.ndarray]:
    """Sums by key of the (keys, vectors) that ``part`` makes of the marks and features of a block of rows (y, f)."""
    import pyarrow as pa

    names = [f"s{i}" for i in range(width)]

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, values = part(batch.column(0).to_numpy(), _matrix(batch.column(1)))
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            for k, v in zip(keys[first].tolist(), np.add.reduceat(values[order], first, axis=0)):
                total[k] = total[k] + v if k in total else v
        if total:
            data = np.array(list(total.values()))
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), *(pa.array(c) for c in data.T)], ["key", *names])

    parts = rows.mapInArrow(run, ", ".join(["key long", *(f"{n} double" for n in names)]))
    return {r[0]: np.array(r[1:]) for r in parts.groupBy("key").agg(*(F.sum(n).alias(n) for n in names)).collect()}


def _points(ranker: Ranker, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the point below each score, share of the document that goes to the one above)."""
    at = ranker.raw(z) / CELL
    low = np.floor(at)
    return low.astype(np.int64), at - low


def _step(rows: DataFrame, ranker: Ranker) -> np.ndarray:
    """A Newton step of the mean loss over all pairs of a good and a bad document."""
    size = len(ranker.w)

    def by_score(y, x):
        z = ranker.expand(x)
        low, up = _points(ranker, z)
        values = np.concatenate([np.ones((len(z), 1)), z], axis=1)
        return np.concatenate([2 * low + y, 2 * low + 2 + y]), np.concatenate([values * (1 - up)[:, None], values * up[:, None]])

    cells = _sums(rows, by_score, 1 + size)

    def of(y):
        keys = np.array(sorted(k for k in cells if k % 2 == y))
        data = np.array([cells[k] for k in keys])
        return keys // 2, data[:, 0], data[:, 1:]

    (kg, ng, zg), (kb, nb, zb) = of(1), of(0)
    pairs = ng.sum() * nb.sum()
    grad, mixed = np.zeros(size), np.zeros((size, size))
    own_g, own_b, wrong_b = np.zeros(len(kg)), np.zeros(len(kb)), np.zeros(len(kb))
    for i in range(0, len(kg), 1000):  # of the table of all pairs of points, 1,000 rows at a time
        part = slice(i, i + 1000)
        p = 1 / (1 + np.exp(np.clip((kg[part, None] - kb[None, :]) * CELL, -30, 30)))  # probability of the wrong order
        q = p * (1 - p)
        grad += (p @ nb) @ zg[part]
        wrong_b += ng[part] @ p
        own_g[part] = q @ nb
        own_b += ng[part] @ q
        mixed += zg[part].T @ (q @ zb)
    grad = (grad - wrong_b @ zb) / pairs - RIDGE * ranker.w

    def own_terms(y, x):
        z = ranker.expand(x)
        at = ranker.raw(z) / CELL
        weight = np.where(y == 1, np.interp(at, kg, own_g), np.interp(at, kb, own_b))
        return np.arange(size), (z * weight[:, None]).T @ z

    own = _sums(rows, own_terms, size)
    hess = (np.array([own[i] for i in range(size)]) - mixed - mixed.T) / pairs + RIDGE * np.eye(size)
    return np.linalg.solve(hess, grad)


def train(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text",
          label: str = "quality", described: DataFrame | None = None) -> Ranker | None:
    """Fit on all labelled documents and all their pairs; None without both classes.

    ``described``: the features of ``docs``, if they are there already."""
    import pyarrow as pa

    bounded_batches(docs.sparkSession)
    ship(__name__)
    described = described if described is not None else describe(docs, doc, text)
    marks = labels.filter(F.col(label).isin(0, 1) & F.col(doc).isNotNull()).select(
        F.col(doc).alias("__d"), F.col(label).cast("int").alias("y"))
    rows = written(described.join(marks, F.col(doc) == F.col("__d")).select("y", "f"), "labelled")
    found = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(found) < 2:
        return None
    n = sum(found.values())
    zeros = lambda y: np.zeros(len(y), np.int64)
    mean = _sums(rows, lambda y, x: (zeros(y), x), FEATURES)[0] / n
    ranker = Ranker(mean, np.sqrt(_sums(rows, lambda y, x: (zeros(y), (x - mean) ** 2), FEATURES)[0] / n))
    for _ in range(30):
        move = _step(rows, ranker)
        ranker.w = ranker.w + move
        if np.abs(move).max() < 1e-6:
            break

    def scores(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(ranker.raw(ranker.expand(_matrix(batch.column(0)))))], ["s"])

    raw = rows.select("f").mapInArrow(scores, "s double")
    ranker.threshold = exact_quantiles(raw, "s", [found[0] / n]).first()["q_0"]
    return ranker


def score_documents(docs: DataFrame, ranker: Ranker | None, doc: str = "doc_id", text: str = "text",
                    described: DataFrame | None = None) -> DataFrame:
    """Per row: doc and score. ``described``: the features of ``docs``, if they are there already."""
    import pyarrow as pa

    described = described if described is not None else describe(docs, doc, text)

    def run(batches):
        for batch in batches:
            s = np.full(batch.num_rows, 0.5)
            if ranker is not None and batch.num_rows:
                s = ranker.score(_matrix(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], [doc, "score"])

    return described.select(doc, "f").mapInArrow(run, f"`{doc}` {docs.schema[doc].dataType.simpleString()}, score double")


def rank_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The registered query: learn from labels with crc32(doc_id) mod 3 other than 1, score every document."""
    described = describe(docs)
    ranker = train(docs, labels.filter(crc_mod(F.col("doc_id"), 3) != 1), described=described)
    return score_documents(docs, ranker, described=described).select(
        "doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))
