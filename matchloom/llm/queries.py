"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from matchloom.llm.common import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from matchloom.llm.quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from matchloom.llm.fingerprint import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from matchloom.llm.jaccard_join import join

    return join(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from matchloom.llm.line_dedup import digests

    return digests(table(spark, sf_dir, "documents"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from matchloom.llm.html_extract import extract_pages

    return extract_pages(table(spark, sf_dir, "pages"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from matchloom.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from matchloom.llm.token_files import token_index

    return token_index(table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from matchloom.llm.bpe import digests

    return digests(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from matchloom.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "first_slot", "last_slot")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from matchloom.llm.topk import top_k

    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows, rows.filter(F.col("vec_id") % 50 == 0))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_fingerprints, op3_jaccard_join, op4_line_dedup, op5_html, op6_toxicity, op7_token_files, op8_bpe, op9_mixing, op10_topk)}


def oracle_sql() -> dict[str, str]:
    from matchloom.llm import line_dedup, mixing, topk

    return {"op4_line_dedup": line_dedup.ORACLE, "op9_mixing": mixing.ORACLE, "op10_topk": topk.ORACLE}
