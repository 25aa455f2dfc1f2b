"""Registered queries of the corpus operators, with SQL where SQL can express them.

Each applies its operator, with its production parameters, to the whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pliego.llm import ann_tree, decontaminate, jaccard_join, langid, lm_score, pieces, quality_rank, sharding, spelling, suffix_dedup, token_align, toxicity, url_model
from pliego.llm.common import table, tokenizer_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _add(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


@_add("op1_url_filter")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_model.filter_urls(table(spark, sf_dir, "pages"))


@_add("op3_decontamination", decontaminate.SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_add("op10_sharding", sharding.SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


@_add("op5_quality_ranking")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rank.rank_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_add("op7_sentencepiece")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


@_add("op9_language_id")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_languages(table(spark, sf_dir, "documents"))


@_add("op8_ngram_jaccard_join")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


@_add("op2_suffix_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_report(table(spark, sf_dir, "documents"))


@_add("op4_nearest_neighbours")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_tree.search_embeddings(table(spark, sf_dir, "embeddings"))


@_add("op6_lm_score")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_held_out(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


@_add("op11_token_alignment")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.align_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"),
                                       tokenizer_path("piece_bpe_32k.model"))


@_add("op12_spelling_variants")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


@_add("op13_toxicity")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
