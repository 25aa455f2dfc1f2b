"""SentencePiece encoding and decoding through a table of distinct chunks.

A chunk is a run of white-space markers and what follows up to the next marker.
If no piece has a marker after another character (checked on the model), no
merge can cross the start of a chunk, so a text's pieces are those of its
chunks one after the other. Each task keeps a table of the distinct chunks it
has met, lets the library segment and decode only new ones, and joins the ids
back by position. The table is emptied when it holds ``TABLE_CHUNKS`` chunks,
which bounds memory and changes no result.

Documents are never shuffled: the scan is the only stage.

Defined results: null text counts as empty (begin and end ids only, decoded to
the empty text); every row gets one row, in an empty table none; null doc_ids
are kept; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pliego.llm.common import bounded_batches, ship, text_blocks

MARK = "▁"
TABLE_CHUNKS = 200_000
_CHUNK = re.compile(" +[^ ]*")


def check_model(processor) -> None:
    """The chunk table is exact only if no piece has a marker after another character."""
    for i in range(processor.get_piece_size()):
        if MARK in processor.id_to_piece(i).lstrip(MARK):
            raise ValueError(f"piece {i} crosses a white-space marker; the chunk table cannot be used")
    if processor.encode(" a") == processor.encode("a") or processor.encode(MARK) != processor.encode(" "):
        raise ValueError("the model's normalisation changes white space; the chunk table cannot be used")


class _Codes(dict):
    """Numbers of chunks; a chunk not met before gets the next one and is noted in ``new``."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        n = self[chunk] = len(self)
        self.new.append(chunk)
        return n


class ChunkTable:
    """Ids and decoded bytes of distinct chunks."""

    def __init__(self, processor, decode: bool = True):
        self.sp, self.decode = processor, decode
        self.begin, self.end = processor.bos_id(), processor.eos_id()
        self.lone = [processor.piece_to_id(MARK)]
        self.clear()

    def clear(self) -> None:
        self.code = _Codes()
        self.decoded: list[bytes] = []
        self.flat = np.empty(0, np.uint32)
        self.start = np.zeros(1, np.int64)

    def _segment(self) -> None:
        """Ids of the chunks noted as new."""
        chunks, self.code.new = self.code.new, []
        # the library puts a marker of its own before every text: leave out the chunk's first
        ids = self.sp.encode([c[1:] for c in chunks], num_threads=1)
        ids = [self.lone if c == " " else x for c, x in zip(chunks, ids)]
        if self.decode:
            self.decoded += [b" " + d.encode() for d in self.sp.decode(ids)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(sizes)])
        self.flat = np.concatenate([self.flat, np.array([i for x in ids for i in x], np.uint32)])

    @staticmethod
    def chunks(text: str) -> list[str]:
        """A text's chunks, each with the markers before it."""
        text = text.replace(MARK, " ")
        if "  " in text or text[:1] == " " or text[-1:] == " ":
            return _CHUNK.findall(" " + text)
        return (" " + text.replace(" ", "\x00 ")).split("\x00") if "\x00" not in text else _CHUNK.findall(" " + text)

    def encode(self, texts: list[str]):
        """(ids, decoded bytes) of each text; no bytes if the table was made without decoding."""
        if len(self.code) > TABLE_CHUNKS:
            self.clear()
        split = [self.chunks(t) if t else [] for t in texts]
        number, dec = self.code.__getitem__, self.decoded.__getitem__
        coded = [list(map(number, chunks)) for chunks in split]
        if self.code.new:
            self._segment()
        for codes in coded:
            c = np.array(codes, np.int64)
            sizes = self.start[c + 1] - self.start[c]
            ends = np.cumsum(sizes)
            total = int(ends[-1]) if len(ends) else 0
            ids = np.empty(total + 2, "<u4")
            ids[0], ids[-1] = self.begin, self.end
            if total:
                ids[1:-1] = self.flat[np.arange(total) + np.repeat(self.start[c] - (ends - sizes), sizes)]
            yield ids, b"".join(map(dec, codes))[1:] if self.decode else b""


def encode_documents(docs: DataFrame, model_file: str, doc: str = "doc_id", text: str = "text",
                     with_ids: bool = False) -> DataFrame:
    """Per document: n_tokens, ids_sha256, decoded_sha256; with_ids adds the ids and the decoded text."""
    import pyarrow as pa
    import sentencepiece

    spark = docs.sparkSession
    bounded_batches(spark)
    ship(__name__)
    check_model(sentencepiece.SentencePieceProcessor(model_file=model_file))
    with open(model_file, "rb") as f:  # about 0.5 MB, sent with the task: executors need no file
        model = spark.sparkContext.broadcast(f.read())

    def run(batches):
        import sentencepiece as lib

        table = ChunkTable(lib.SentencePieceProcessor(model_proto=model.value))
        for (keys,), texts in text_blocks(batches, 1):
            n, a, b, c, d = [], [], [], [], []
            for ids, decoded in table.encode(texts):
                n.append(len(ids))
                a.append(hashlib.sha256(ids.tobytes()).hexdigest())
                b.append(hashlib.sha256(decoded).hexdigest())
                if with_ids:
                    c.append(ids.astype(np.int32))
                    d.append(decoded.decode())
            cols = [pa.array(keys, key_type), pa.array(n, pa.int64()), pa.array(a), pa.array(b)]
            names = [doc, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols += [pa.array(c, pa.list_(pa.int32())), pa.array(d, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names)

    from pyspark.sql.pandas.types import to_arrow_type

    key_type = to_arrow_type(docs.schema[doc].dataType)
    schema = f"`{doc}` {docs.schema[doc].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>, decoded string" if with_ids else ""
    return docs.select(F.col(doc), F.col(text)).mapInArrow(run, schema)
