"""A corpus pipeline over ``documents``: toxic texts go, repeated lines go, one of each group of near copies stays,
sources are mixed to their target weights, and the mix is encoded.

Every stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; all but the last return its columns.
SQL cannot express the first stage (a model is fitted), so there is no SQL for the whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from matchloom.llm.bpe import encoded
from matchloom.llm.common import materialise, scratch_dir, table
from matchloom.llm.jaccard_join import without_near_copies
from matchloom.llm.line_dedup import without_repeated_lines
from matchloom.llm.mixing import mixed
from matchloom.llm.toxicity import without_toxic

ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5; the model learns from ``labels`` as in op6."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that a document with a smaller id holds; n_chars follows the text."""
    return without_repeated_lines(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies."""
    return without_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each pass over a document, whole or cut to the words taken; n_chars follows the text."""
    return mixed(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256) of each row of the mix."""
    return encoded(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("jaccard_join", jaccard_join), ("mixing", mixing), ("bpe", bpe)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what one returns is written and read again for the next."""
    docs, path = table(spark, sf_dir, "documents"), scratch_dir(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"{path}/{k}-{name}")
    return docs
