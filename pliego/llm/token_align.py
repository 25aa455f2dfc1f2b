"""Alignment of two tokenizers over the same bytes, with corpus-wide link counts.

A is a byte-level BPE, B a SentencePiece model with byte fallback; both cut
space + text into tokens. Offsets where tokens of both end cut them into groups;
an A and a B token are linked where their bytes overlap.

Identity map: ``same[a]`` is the B id with the bytes of A's id a. A group of one A
and one B token that are each other's identity is counted in a vector of A's
vocabulary length; only the links of other groups are counted as pairs and enter
the shuffle that adds up the corpus.

Neither tokenizer has a token across a change from a non-space to a space, so a
text falls into chunks there. A task encodes and aligns each chunk it has not met
yet, all new chunks of a block at once, and puts texts together by position; its
chunk table is emptied at ``TABLE_CHUNKS``, which changes no result. Texts are
tokenised once: the first pass writes each document's distinct links, and the
second reads those back against the counts. Identity counts, the best count of
each B id and the pairs with at least 1/``FREQUENT`` of all links are broadcast
(bounded by the vocabularies and ``FREQUENT``); other links meet their counts by a
shuffle join, in which no pair can have many rows.

Defined results: null and empty texts, and texts whose tokens' bytes differ from
space + text under A or B, have no tokens: zeros and an empty ``groups_sha256``.
Repeated rows get a row each and count again; null doc_ids are kept; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pliego.llm.common import bounded_batches, ship, text_blocks, written
from pliego.llm.pieces import MARK, check_model

TABLE_CHUNKS = 300_000
FREQUENT = 1 << 18
_SPACES = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S)(?= )")


def byte_letters() -> dict[str, int]:
    """Letters that byte-level vocabularies write for bytes: printable ones stand for themselves, others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def check_byte_level(definition: str) -> None:
    """Chunks are exact only if A splits by its byte-level pattern and changes no text."""
    d = json.loads(definition)
    pre = d.get("pre_tokenizer") or {}
    if d.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        raise ValueError("tokenizer A is not plain byte-level BPE; the chunk table cannot be used")


class Vocabularies:
    """Both tokenizers, the bytes of their ids and the identity map."""

    def __init__(self, a_definition: str, b_model: bytes):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_definition)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        letters, vocab = byte_letters(), self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for entry, i in vocab.items():
            self.a_bytes[i] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()
        n = self.b.get_piece_size()
        self.b_bytes = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i)
                        else self.b.id_to_piece(i).replace(MARK, " ").encode() for i in range(n)]
        first: dict[bytes, int] = {}
        for i in sorted(range(n), key=lambda i: (self.b.is_byte(i), i)):
            if not (self.b.is_control(i) or self.b.is_unknown(i)):
                first.setdefault(self.b_bytes[i], i)
        self.same = np.array([first.get(x, -1) for x in self.a_bytes], np.int64)
        self.a_size = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)
        self.lone = [self.b.piece_to_id(MARK)]

    def encode(self, chunks: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of strings that begin with a space; B puts that space itself."""
        a = [e.ids for e in self.a.encode_batch_fast(chunks, add_special_tokens=False)]
        b = self.b.encode([c[1:] for c in chunks], num_threads=1)
        return a, [self.lone if c == " " else x for c, x in zip(chunks, b)]

    def covers(self, chunk: str, a: list[int], b: list[int]) -> bool:
        data = chunk.encode()
        return b"".join(map(self.a_bytes.__getitem__, a)) == data == b"".join(map(self.b_bytes.__getitem__, b))


class Alignment:
    """Groups and links of strings that both tokenizers cover, one after the other.

    ``link`` holds a * (B's vocabulary length) + b for each link, ``plain`` whether its group is an
    exact one-to-one group of the identity map; string i's are from start[i] to start[i + 1].
    """

    def __init__(self, v: Vocabularies, a: list[list[int]], b: list[list[int]]):
        flat_a = np.array([i for x in a for i in x], np.int64)
        flat_b = np.array([i for x in b for i in x], np.int64)
        self.n_a = np.fromiter(map(len, a), np.int64, len(a))
        self.n_b = np.fromiter(map(len, b), np.int64, len(b))
        end_a, end_b = np.cumsum(v.a_size[flat_a]), np.cumsum(v.b_size[flat_b])
        both = np.intersect1d(end_a, end_b, assume_unique=True)
        cut = np.union1d(end_a, end_b)                    # every overlap ends at one of these
        at_a, at_b = np.searchsorted(end_a, cut), np.searchsorted(end_b, cut)
        group = np.searchsorted(both, cut)
        one = np.bincount(group, minlength=len(both))[group] == 1
        self.link = flat_a[at_a] * len(v.b_size) + flat_b[at_b]
        self.plain = one & (v.same[flat_a[at_a]] == flat_b[at_b])
        ends = np.concatenate([[0], end_a])[np.cumsum(self.n_a)] if len(a) else np.empty(0, np.int64)
        self.start = np.concatenate([[0], np.searchsorted(cut, ends, "right")])
        group_start = np.concatenate([[0], np.searchsorted(both, ends, "right")])
        self.n_groups = np.diff(group_start)
        # text of the groups
        to_a, to_b = np.searchsorted(end_a, both, "right").tolist(), np.searchsorted(end_b, both, "right").tolist()
        word_a, word_b = list(map(str, flat_a.tolist())), list(map(str, flat_b.tolist()))
        texts, p, q = [], 0, 0
        for x, y in zip(to_a, to_b):
            texts.append((word_a[p] if x == p + 1 else ",".join(word_a[p:x])) + "|" + (word_b[q] if y == q + 1 else ",".join(word_b[q:y])))
            p, q = x, y
        edges = group_start.tolist()
        self.text = [texts[x] if y == x + 1 else ";".join(texts[x:y]) for x, y in zip(edges, edges[1:])]


def chunks_of(s: str) -> list[str]:
    """Space + text, cut before each space that follows a non-space."""
    if _SPACES.search(s) or "\0" in s:
        return _CUT.split(s)
    return s.replace(" ", "\0 ").split("\0")[1:]


class _Codes(dict):
    """Numbers of chunks; new ones are noted."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        n = self[chunk] = len(self)
        self.new.append(chunk)
        return n


class ChunkAligner:
    """A task's table of aligned chunks, its identity vector and the counts of its other links."""

    def __init__(self, v: Vocabularies):
        self.v = v
        self.identity = np.zeros(len(v.a_size), np.int64)
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []
        self.clear()

    def clear(self) -> None:
        self.code = _Codes()
        self.n_a, self.n_b, self.n_groups, self.seen = (np.empty(0, np.int64) for _ in range(4))
        self.fits = np.empty(0, bool)
        self.link, self.plain, self.start = np.empty(0, np.int64), np.empty(0, bool), np.zeros(1, np.int64)
        self.text: list[str] = []

    def _learn(self) -> None:
        chunks, self.code.new = self.code.new, []
        a, b = self.v.encode(chunks)
        fits = [self.v.covers(*x) for x in zip(chunks, a, b)]
        if not all(fits):
            a, b = [x if f else [] for x, f in zip(a, fits)], [x if f else [] for x, f in zip(b, fits)]
        new = Alignment(self.v, a, b)
        for name in ("n_a", "n_b", "n_groups", "link", "plain"):
            setattr(self, name, np.concatenate([getattr(self, name), getattr(new, name)]))
        self.fits = np.concatenate([self.fits, np.array(fits, bool)])
        self.start = np.concatenate([self.start, self.start[-1] + new.start[1:]])
        self.seen = np.concatenate([self.seen, np.zeros(len(chunks), np.int64)])
        self.text += new.text

    def count(self) -> None:
        """Add the links of all chunks met, as often as they were met, to the task's counts."""
        times = np.repeat(self.seen, np.diff(self.start))
        a = self.link[self.plain] // len(self.v.b_size)
        self.identity += np.bincount(a, times[self.plain], minlength=len(self.identity)).astype(np.int64)
        link, of = np.unique(self.link[~self.plain], return_inverse=True)
        n = np.bincount(of, times[~self.plain], minlength=len(link)).astype(np.int64)
        self.pairs.append((link[n > 0], n[n > 0]))
        self.clear()

    def totals(self):
        """(links, counts) of the task so far, a part at a time."""
        at = np.flatnonzero(self.identity)
        self.pairs.append((at * len(self.v.b_size) + self.v.same[at], self.identity[at]))
        self.identity[:] = 0
        out, self.pairs = self.pairs, []
        return out

    def align(self, texts: list[str | None]):
        """Of each text: (n_a, n_b, n_groups, groups as text, distinct links, their occurrences)."""
        if len(self.code) > TABLE_CHUNKS:
            self.count()
        number = self.code.__getitem__
        coded = [list(map(number, chunks_of(" " + t))) if t and MARK not in t else [] for t in texts]
        if self.code.new:
            self._learn()
        for t, codes in zip(texts, coded):
            c = np.array(codes, np.int64)
            if not len(c):
                yield 0, 0, 0, "", (), ()
            elif self.fits[c].all():
                np.add.at(self.seen, c, 1)
                sizes = self.start[c + 1] - self.start[c]
                ends = np.cumsum(sizes)
                links = self.link[np.arange(ends[-1]) + np.repeat(self.start[c] - (ends - sizes), sizes)]
                yield (int(self.n_a[c].sum()), int(self.n_b[c].sum()), int(self.n_groups[c].sum()),
                       ";".join(map(self.text.__getitem__, codes)), *np.unique(links, return_counts=True))
            else:
                yield self._whole(t)

    def _whole(self, text: str):
        """A text with a chunk that a tokenizer does not cover: judged as a whole."""
        a, b = self.v.encode([" " + text])
        if not self.v.covers(" " + text, a[0], b[0]):
            return 0, 0, 0, "", (), ()
        one = Alignment(self.v, a, b)
        np.add.at(self.identity, one.link[one.plain] // len(self.v.b_size), 1)
        self.pairs.append(np.unique(one.link[~one.plain], return_counts=True))
        return (len(a[0]), len(b[0]), int(one.n_groups[0]), one.text[0], *np.unique(one.link, return_counts=True))


def _aligned(docs: DataFrame, vocabularies, doc: str, text: str, with_groups: bool) -> DataFrame:
    """The first pass, written: rows of documents (row not null) and rows of a task's link counts (link, n)."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    key_type = to_arrow_type(docs.schema[doc].dataType)
    names = ["row", doc, "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links", "times", "groups", "link", "n"]
    types = [pa.int64(), key_type, *[pa.int64()] * 4, pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string(),
             pa.list_(pa.int64()), pa.list_(pa.int64())]

    def batch(columns: dict, rows: int):
        return pa.RecordBatch.from_arrays([pa.array(columns.get(i, [None] * rows), t) for i, t in enumerate(types)], names)

    def run(batches):
        from pyspark import TaskContext

        aligner, row = ChunkAligner(Vocabularies(*vocabularies.value)), TaskContext.get().partitionId() << 33

        def counts():
            for link, n in aligner.totals():
                for i in range(0, len(link), 20_000):
                    yield batch({10: [link[i:i + 20_000]], 11: [n[i:i + 20_000]]}, 1)

        for (keys,), texts in text_blocks(batches, 1):
            got = list(zip(*aligner.align(texts)))
            n_a, n_b, n_groups, groups, links, times = got
            sha = [hashlib.sha256(g.encode()).hexdigest() if n else "" for g, n in zip(groups, n_a)]
            cols = {0: range(row, row + len(texts)), 1: keys, 2: n_a, 3: n_b, 4: n_groups,
                    5: [int(np.sum(x)) for x in times], 6: sha, 7: links, 8: times}
            if with_groups:
                cols[9] = groups
            row += len(texts)
            yield batch(cols, len(texts))
            if sum(len(x) for x, _ in aligner.pairs) > 1_000_000:
                yield from counts()
        aligner.count()
        yield from counts()

    shape = (f"row long, `{doc}` {docs.schema[doc].dataType.simpleString()}, n_a long, n_b long, n_groups long, n_links long, "
             "groups_sha256 string, links array<long>, times array<long>, groups string, link array<long>, n array<long>")
    return written(docs.select(F.col(doc), F.col(text)).mapInArrow(run, shape), "aligned")


def _link_counts(aligned: DataFrame) -> DataFrame:
    parts = aligned.filter("link IS NOT NULL").select(F.explode(F.arrays_zip("link", "n")).alias("x")).select("x.*")
    return written(parts.groupBy("link").agg(F.sum("n").alias("n")), "link-counts")


def _opened(spark, a_file: str, b_file: str):
    """The broadcast tokenizer files (2 MB) and the vocabularies on the driver."""
    import sentencepiece

    with open(a_file) as f:
        definition = f.read()
    with open(b_file, "rb") as f:
        model = f.read()
    check_byte_level(definition)
    check_model(sentencepiece.SentencePieceProcessor(model_proto=model))
    return spark.sparkContext.broadcast((definition, model)), Vocabularies(definition, model)


def link_counts(docs: DataFrame, a_file: str, b_file: str, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(a_id, b_id, n): the links of the corpus."""
    bounded_batches(docs.sparkSession)
    ship(__name__)
    files, v = _opened(docs.sparkSession, a_file, b_file)
    size = len(v.b_size)
    return _link_counts(_aligned(docs, files, doc, text, False)).select(
        F.floor(F.col("link") / size).cast("long").alias("a_id"), (F.col("link") % size).alias("b_id"), "n")


def align_documents(docs: DataFrame, a_file: str, b_file: str, doc: str = "doc_id", text: str = "text",
                    with_groups: bool = False) -> DataFrame:
    """Per document: n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; with_groups adds the groups' text."""
    import pyarrow as pa

    spark = docs.sparkSession
    bounded_batches(spark)
    ship(__name__)
    files, v = _opened(spark, a_file, b_file)
    size = len(v.b_size)
    aligned = _aligned(docs, files, doc, text, with_groups)
    counts = _link_counts(aligned)

    # bounded by the vocabularies and FREQUENT, whatever the corpus
    at = np.flatnonzero(v.same >= 0)
    own = spark.createDataFrame([(int(x),) for x in at * size + v.same[at]], "link long")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = counts.filter(F.col("n") * FREQUENT >= total).unionByName(counts.join(F.broadcast(own), "link", "left_semi")).distinct().toArrow()
    best = counts.groupBy((F.col("link") % size).alias("b")).agg(F.max("n").alias("n")).toArrow()
    link, n = often["link"].to_numpy(), often["n"].to_numpy()
    order = np.argsort(link)
    most = np.zeros(size, np.int64)
    most[best["b"].to_numpy()] = best["n"].to_numpy()
    plain = np.zeros(len(v.a_size), np.int64)
    mine = v.same[link // size] == link % size
    plain[link[mine] // size] = n[mine]
    known = spark.sparkContext.broadcast((link[order], n[order], most, plain, v.same))

    def look_up(batches):
        links_, counts_, most_, plain_, same_ = known.value
        for b in batches:
            got = b.column(b.schema.names.index("links")), b.column(b.schema.names.index("times"))
            flat, times = (x.flatten().to_numpy(zero_copy_only=False) for x in got)
            edges = got[0].offsets.to_numpy() - got[0].offsets.to_numpy()[0]
            owner = np.repeat(np.arange(b.num_rows), np.diff(edges))
            a, to = flat // size, flat % size
            place = np.minimum(np.searchsorted(links_, flat), max(len(links_) - 1, 0))
            if len(links_):
                n_ = np.where(same_[a] == to, plain_[a], np.where(links_[place] == flat, counts_[place], 0))
            else:
                n_ = np.zeros(len(flat), np.int64)
            sums, tops = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            np.add.at(sums, owner, n_ * times)
            np.add.at(tops, owner, times * (n_ == most_[to]))
            rest = n_ == 0
            offsets = np.concatenate([[0], np.cumsum(np.bincount(owner[rest], minlength=b.num_rows))]).astype(np.int32)
            rare = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x[rest], pa.int64())) for x in (flat, times)]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(kept))] + [pa.array(tops), pa.array(sums), *rare],
                                             [*kept, "n_best", "count_sum", "rare", "rare_times"])

    kept = ["row", doc, "n_a", "n_b", "n_groups", "n_links", "groups_sha256", *(["groups"] if with_groups else [])]
    rows = aligned.filter("row IS NOT NULL").select(*kept, "links", "times")
    shape = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    done = written(rows.mapInArrow(look_up, shape + ", n_best long, count_sum long, rare array<long>, rare_times array<long>"), "aligned-known")

    # links below 1/FREQUENT of all
    spread = (done.filter(F.size("rare") > 0).select("row", F.explode(F.arrays_zip("rare", "rare_times")).alias("x"))
              .select("row", F.col("x.rare").alias("link"), F.col("x.rare_times").alias("times")))
    bests = F.broadcast(spark.createDataFrame([(int(b), int(x)) for b, x in enumerate(most) if x], "b long, best long"))  # B's vocabulary
    rare = counts.filter(F.col("n") * FREQUENT < total).join(bests, F.col("link") % size == F.col("b")).select("link", "n", "best")
    more = (spread.join(rare, "link").groupBy("row")
            .agg(F.sum(F.col("times") * F.col("n")).alias("more_sum"),
                 F.sum(F.when(F.col("n") == F.col("best"), F.col("times")).otherwise(0)).alias("more_best")))
    out = done.select(*kept, "n_best", "count_sum").join(more, "row", "left")
    return out.select(doc, "n_a", "n_b", "n_groups", "n_links",
                      (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
                      (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"),
                      "groups_sha256", *(["groups"] if with_groups else []))
