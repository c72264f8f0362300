"""What a candidate looks like among its rivals: windows over the anchor, NULL meaning unknown.

Every window is partitioned by ``anchor`` alone or with one sort key, so all columns of a function share one
shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def _anchor():
    return Window.partitionBy("anchor")


def gap(column: str) -> Column:
    """Best of the anchor minus own; unknown counts as 0."""
    v = F.coalesce(F.col(column), F.lit(0.0))
    return F.max(v).over(_anchor()) - v


def lead(column: str) -> Column:
    """Own minus the best rival; a lone candidate leads by its own value, tied best ones by 0."""
    v = F.coalesce(F.col(column), F.lit(0.0))
    ordered = Window.partitionBy("anchor").orderBy(v.desc())
    best = F.max(v).over(_anchor())
    second = F.nth_value(v, 2).over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return v - F.when(v == best, F.coalesce(second, F.lit(0.0))).otherwise(best)


def rank_known(column: str, by: str = "anchor") -> Column:
    """Rank from 0 among known values, ties sharing the best rank; unknown stays unknown."""
    v = F.col(column)
    order = Window.partitionBy(by, v.isNull()).orderBy(F.desc(column))
    return F.when(v.isNotNull(), F.rank().over(order) - 1)


def best_known(column: str) -> Column:
    return F.max(column).over(_anchor())


def available(name: str = "name_tset", addr: str = "addr_tset") -> Column:
    """Mean of the known ones of two similarities."""
    a, b = F.col(name), F.col(addr)
    return F.coalesce((a + b) / 2, a, b)


def rival_context(pairs: DataFrame) -> DataFrame:
    """Adds the twelve context columns from score (as ret_score), name_tset, addr_tset and ret_rank."""
    combo = F.coalesce("name_tset", F.lit(0.0)) + F.coalesce("addr_tset", F.lit(0.0))
    order = Window.partitionBy("anchor").orderBy(F.desc("__combo"), "source", F.desc("ret_score"), "code")
    strong = (F.coalesce("avail_mean", F.lit(0.0)) >= 0.9).cast("int")
    return (
        pairs.withColumn("__combo", combo)
        .withColumn("avail_mean", available())
        .withColumn("n_cands", F.count("*").over(_anchor()))
        .withColumn("ret_score_gap", gap("ret_score"))
        .withColumn("name_tset_gap", gap("name_tset"))
        .withColumn("addr_tset_gap", gap("addr_tset"))
        .withColumn("name_tset_lead", lead("name_tset"))
        .withColumn("addr_tset_lead", lead("addr_tset"))
        .withColumn("combo_rank", F.row_number().over(order) - 1)
        .withColumn("avail_rank", rank_known("avail_mean"))
        .withColumn("avail_gap", best_known("avail_mean") - F.col("avail_mean"))
        .withColumn("name_rank_avail", rank_known("name_tset"))
        .withColumn("addr_rank_avail", rank_known("addr_tset"))
        .withColumn("n_strong_rivals", F.log1p(F.sum(strong).over(_anchor()) - strong))
        .drop("__combo")
    )


def tie_context(pairs: DataFrame) -> DataFrame:
    """Adds dense and shared ranks, ties and simple combinations of the two similarities (unknown is 0)."""
    n, a = F.coalesce("name_tset", F.lit(0.0)), F.coalesce("addr_tset", F.lit(0.0))
    dense = lambda v: F.dense_rank().over(Window.partitionBy("anchor").orderBy(F.desc(v))) - 1
    return (
        pairs.withColumn("__n", n)
        .withColumn("__a", a)
        .withColumn("__c", n + a)
        .withColumn("combo_dense_rank", dense("__c"))
        .withColumn("combo_competition_rank", F.rank().over(Window.partitionBy("anchor").orderBy(F.desc("__c"))) - 1)
        .withColumn("combo_ties", F.count("*").over(Window.partitionBy("anchor", "__c")))
        .withColumn("combo_gap", F.max("__c").over(_anchor()) - F.col("__c"))
        .withColumn("name_dense_rank", dense("__n"))
        .withColumn("addr_dense_rank", dense("__a"))
        .withColumn("joint_min", F.least("__n", "__a"))
        .withColumn("joint_product", F.col("__n") * F.col("__a"))
        .withColumn("joint_max", F.greatest("__n", "__a"))
        .withColumn("name_addr_disagreement", F.abs(F.col("__n") - F.col("__a")))
        .withColumn("addr_supported_name", F.coalesce("name_ratio", F.lit(0.0)) * F.col("__a"))
        .withColumn("number_supported_name", F.col("__n") * F.coalesce("num_jacc", F.lit(0.0)))
        .drop("__n", "__a", "__c")
    )


def refresh(pairs: DataFrame) -> DataFrame:
    """The same context worked out on the rows that are left after a selection."""
    return rival_context(pairs)
