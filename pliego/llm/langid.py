"""Language identification by a small convolutional network over bytes.

Bytes are embedded, filters of widths 2, 3 and 4 run over a window of
``WINDOW`` bytes, each filter's largest response is kept (max pooling), and a
softmax gives the languages. It is trained in numpy on the driver from a
bounded sample: at most ``SAMPLE_PER_LANG`` labelled documents a language,
chosen by hash over the whole table, one passage each.

A text is cut into consecutive windows, the last one padded with zero bytes;
the document's probabilities are the windows' mean, weighted by their bytes.
Every byte of every text is read; nothing is shuffled.

Defined results: a null text, or one without any letter, is ``und`` with score
0; so is every text if there is no labelled row to learn from. Repeated rows
get a row each; null doc_ids are kept; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pliego.llm.common import bounded_batches, crc_mod, ship, text_blocks

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 12
DIM = 8
SAMPLE_PER_LANG = 1200
UNDETERMINED = "und"
_LETTER = re.compile(r"[^\W\d_]")      # letters, and numerals such as ½, which are none
_BLOCK = 512  # windows in one matrix product


def has_letter(text: str) -> bool:
    """A character of Unicode's letter categories, as the training rows' ``\\p{L}``."""
    return any(unicodedata.category(m.group())[0] == "L" for m in _LETTER.finditer(text))


class ByteCNN:
    """Parameters: embedding (256, DIM), filters (4 * DIM, 3 * FILTERS), bias, output weights and bias."""

    def __init__(self, langs: list[str], seed: int = 1):
        rng = np.random.default_rng(seed)
        self.langs, span, nf = langs, max(WIDTHS), FILTERS * len(WIDTHS)
        self.emb = rng.normal(0, 0.5, (256, DIM)).astype(np.float32)
        self.emb[0] = 0
        self.mask = np.zeros((span * DIM, nf), np.float32)  # a filter of width w sees its first w bytes
        for i, w in enumerate(WIDTHS):
            self.mask[:w * DIM, i * FILTERS:(i + 1) * FILTERS] = 1
        self.filt = (rng.normal(0, 0.3, self.mask.shape).astype(np.float32)) * self.mask
        self.bias = np.zeros(nf, np.float32)
        self.out = rng.normal(0, 0.2, (nf, len(langs))).astype(np.float32)
        self.obias = np.zeros(len(langs), np.float32)

    def _columns(self, x: np.ndarray) -> np.ndarray:
        """(n, WINDOW) bytes -> (n, positions, 4 * DIM) embedded runs."""
        span = max(WIDTHS)
        e = self.emb[x]
        m = x.shape[1] - span + 1
        return np.concatenate([e[:, j:j + m] for j in range(span)], axis=2)

    def features(self, x: np.ndarray):
        cols = self._columns(x)
        act = cols.reshape(-1, cols.shape[2]) @ self.filt
        return cols, act.reshape(len(x), -1, act.shape[1])

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        res = np.empty((len(x), len(self.langs)), np.float32)
        for i in range(0, len(x), _BLOCK):
            _, act = self.features(x[i:i + _BLOCK])
            z = np.maximum(act.max(axis=1) + self.bias, 0) @ self.out + self.obias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            res[i:i + _BLOCK] = z / z.sum(axis=1, keepdims=True)
        return res

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 4, batch: int = 64, rate: float = 0.01, seed: int = 2):
        rng = np.random.default_rng(seed)
        names = ("emb", "filt", "bias", "out", "obias")
        mom = {k: [np.zeros_like(getattr(self, k)), np.zeros_like(getattr(self, k))] for k in names}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                pick = order[i:i + batch]
                xb, yb, n = x[pick], y[pick], len(pick)
                cols, act = self.features(xb)
                best = act.argmax(axis=1)                                   # (n, filters)
                top = np.take_along_axis(act, best[:, None], axis=1)[:, 0] + self.bias
                h = np.maximum(top, 0)
                z = h @ self.out + self.obias
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(n), yb] -= 1
                dz = p / n
                dtop = (dz @ self.out.T) * (top > 0)
                grad = {"out": h.T @ dz, "obias": dz.sum(0), "bias": dtop.sum(0)}
                # only the pooled positions get a gradient
                run = np.take_along_axis(cols, best[:, :, None], axis=1)    # (n, filters, 4 * DIM)
                grad["filt"] = np.einsum("nfk,nf->kf", run, dtop) * self.mask
                back = dtop[:, :, None] * self.filt.T[None]                 # (n, filters, 4 * DIM)
                at = xb[np.arange(n)[:, None, None], best[:, :, None] + np.arange(max(WIDTHS))]
                demb = np.zeros_like(self.emb)
                np.add.at(demb, at.reshape(-1), back.reshape(-1, DIM))
                demb[0] = 0
                grad["emb"] = demb
                step += 1
                for k in names:
                    m, v = mom[k]
                    m += 0.1 * (grad[k] - m)
                    v += 0.001 * (grad[k] ** 2 - v)
                    getattr(self, k)[...] -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        return self


def windows(data: bytes) -> np.ndarray:
    """Consecutive windows of all bytes, the last one padded with zeros."""
    n = -(-len(data) // WINDOW)
    return np.frombuffer(data.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> ByteCNN | None:
    """Fit on a bounded hash sample of the rows; None if there is no row."""
    rows = labelled.filter(F.col(text).isNotNull() & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    sizes = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}
    if not sizes:
        return None
    draw = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("draw")), F.lit(1_000_000))
    share = F.lit(0)
    for name, n in sizes.items():
        share = F.when(F.col(lang) == name, int(min(1.0, SAMPLE_PER_LANG / n) * 1_000_000)).otherwise(share)
    # one passage of each drawn document, at a place chosen by hash
    at = 1 + F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("place")),
                    F.greatest(F.char_length(text) - WINDOW, F.lit(1)))
    drawn = (rows.filter(draw < share)
             .select(F.col(lang).alias("l"), F.substr(F.col(text), at.cast("int"), F.lit(WINDOW)).alias("t"))
             .limit(2 * SAMPLE_PER_LANG * len(sizes)).collect())
    langs = sorted(sizes)
    got = sorted((r["l"], r["t"]) for r in drawn if r["t"])
    if not got:
        return None
    x = np.stack([windows(t.encode()[:WINDOW])[0] for _, t in got])
    short = np.stack([windows(t.encode()[:40])[0] for _, t in got])  # short texts are padded: learn those too
    y = np.array([langs.index(l) for l, _ in got])
    return ByteCNN(langs).fit(np.concatenate([x, short]), np.concatenate([y, y]))


def classify(model: ByteCNN | None, texts: list[str | None]) -> list[tuple[str, float]]:
    """(language, probability) of each text."""
    res: list[tuple[str, float]] = [(UNDETERMINED, 0.0)] * len(texts)
    if model is None:
        return res
    held, parts = [], []
    for i, t in enumerate(texts):
        if t and has_letter(t):
            data = t.encode()
            held.append((i, len(data)))
            parts.append(windows(data))
    if not held:
        return res
    p = model.probabilities(np.concatenate(parts))
    first = 0
    for (i, size), w in zip(held, parts):
        weight = np.full(len(w), WINDOW, np.float64)
        weight[-1] = size - (len(w) - 1) * WINDOW
        mean = weight @ p[first:first + len(w)] / weight.sum()
        first += len(w)
        best = int(mean.argmax())
        res[i] = (model.langs[best], float(min(1.0, mean[best])))
    return res


def identify(docs: DataFrame, model: ByteCNN | None, doc: str = "doc_id", text: str = "text",
             keep: bool = False) -> DataFrame:
    """Per row: doc, lang_pred, score; with ``keep`` all columns of the row and ``__lang``, ``__score``."""
    import pyarrow as pa

    spark = docs.sparkSession
    bounded_batches(spark)
    ship(__name__)
    shared = spark.sparkContext.broadcast(model)

    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    rest = [c for c in docs.columns if c != text] if keep else [doc]
    names = ("__lang", "__score") if keep else ("lang_pred", "score")
    src = docs.select(*rest, text)
    schema = StructType([docs.schema[c] for c in rest] + ([docs.schema[text]] if keep else [])
                        + [StructField(names[0], StringType()), StructField(names[1], DoubleType())])

    def run(batches):
        for batch in batches:
            pairs = []
            for _, texts in text_blocks([batch.select([len(rest)])], 0):
                pairs += classify(shared.value, texts)
            cols = [batch.column(i) for i in range(len(rest) + keep)]
            cols += [pa.array([a for a, _ in pairs], pa.string()), pa.array([b for _, b in pairs], pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, schema.names)

    return src.mapInArrow(run, schema)


def predict_languages(docs: DataFrame) -> DataFrame:
    """The registered query: learn from documents with crc32(doc_id) mod 5 other than 0, predict all."""
    model = train(docs.filter(crc_mod(F.col("doc_id"), 5) != 0))
    out = identify(docs, model)
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents whose language is determined with at least ``least`` probability, all columns kept."""
    model = train(docs.filter(crc_mod(F.col("doc_id"), 5) != 0))
    marked = identify(docs, model, keep=True)
    return marked.filter((F.col("__lang") != UNDETERMINED) & (F.col("__score") >= least)).select(*docs.columns)
