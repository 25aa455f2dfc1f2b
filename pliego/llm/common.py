"""Shared helpers of the corpus operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pliego.session import bounded_batches, scratch_path, written_to  # noqa: F401 - the operators take it from here

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. All-ASCII text takes the fast built-in."""
    return (F.when(F.octet_length(text) == F.char_length(text), F.lower(text))
            .otherwise(F.translate(text, UPPER, LOWER)))


def crc_mod(key: Column, modulus: int) -> Column:
    """crc32 of the key's text, modulo ``modulus`` (null keys count as the empty text)."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to a new folder below ``spark.checkpoint.dir`` and read it back.

    The folder is shared by all executors, so a lost executor loses nothing.
    """
    return written_to(df, scratch_path(df.sparkSession, f"llm/{name}-{uuid.uuid4().hex}"))


def discard(df: DataFrame) -> None:
    """Remove a table that ``written`` made, once what was made from it is written."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of text that a Python task handles at once.
BLOCK_BYTES = 4 << 20


def text_blocks(batches, keys: int):
    """From Arrow batches whose last column is text: (key columns, texts) in blocks of about BLOCK_BYTES."""
    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in range(keys)]
        texts = batch.column(keys).to_pylist()
        first, size = 0, 0
        for i, t in enumerate(texts):
            size += len(t) if t else 0
            if size >= BLOCK_BYTES or i == len(texts) - 1:
                yield [c[first:i + 1] for c in cols], texts[first:i + 1]
                first, size = i + 1, 0


def ship(module_name: str) -> None:
    """Send the module's functions to Python workers by value: workers need no installed package."""
    import sys

    from pyspark import cloudpickle

    for name in (module_name, __name__):
        cloudpickle.register_pickle_by_value(sys.modules[name])


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file on the driver."""
    import public_tokenizers

    return public_tokenizers.path(name)
