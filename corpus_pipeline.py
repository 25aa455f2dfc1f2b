"""The corpus pipeline: five stages over ``documents``, each calling one operator.

1. language ID: documents without a letter, or whose language stays uncertain, go;
2. n-gram Jaccard join: of each group of near duplicates (five-word shingles,
   similarity 0.8 or more) the document with the smallest id stays;
3. suffix dedup: strings of 200 bytes that occur again anywhere are cut out;
4. benchmark decontamination: documents that hold a benchmark window go;
5. SentencePiece: the documents' token counts and the digests of ids and decoded text.

Every stage works on all rows its predecessor kept and passes them on with the
columns of ``documents``; the last returns its figures. Between stages the rows
are written to the shared folder, so a lost executor repeats one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pliego.llm import decontaminate, jaccard_join, langid, pieces, suffix_dedup
from pliego.llm.common import table, tokenizer_path, written

#: Least probability of the predicted language.
LEAST_LANGUAGE = 0.35


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs, LEAST_LANGUAGE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one_of_each(docs, n=5, percent=80)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(docs)
    if "n_chars" in out.columns:  # follows the text
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.coalesce(F.char_length("text").cast(kind), F.col("n_chars")))
    return out


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", near_duplicates),
    ("suffix_dedup", repeated_strings),
    ("benchmark_decontamination", benchmark_leaks),
    ("sentencepiece", encode),
]

#: SQL cannot express a trained network or the SentencePiece library.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
