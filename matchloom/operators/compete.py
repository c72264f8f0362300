"""Competing claims: how a pair stands among its anchor's candidates and among all claims on its target."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ANCHOR_SIDE = ("a_pmax", "a_gap", "a_rank", "a_n50", "a_n90", "a_psum")
TARGET_SIDE = ("t_nclaims", "t_rank", "t_best_other", "t_margin", "t_n50_other")


def competition(pairs: DataFrame) -> DataFrame:
    """Adds eleven columns from (anchor, target, p), over all rows; filter afterwards, never before.

    Two shuffles, one by anchor and one by target.  Ranks start at 0; ties go by the other side's id.
    """
    a, t = Window.partitionBy("anchor"), Window.partitionBy("target")
    over = lambda x, w: F.sum((F.col("p") > x).cast("int")).over(w)
    by_anchor = (
        pairs.withColumn("a_pmax", F.max("p").over(a))
        .withColumn("a_gap", F.col("a_pmax") - F.col("p"))
        .withColumn("a_rank", F.row_number().over(a.orderBy(F.desc("p"), "target")) - 1)
        .withColumn("a_n50", over(0.5, a))
        .withColumn("a_n90", over(0.9, a))
        .withColumn("a_psum", F.sum("p").over(a))
    )
    order = t.orderBy(F.desc("p"), "anchor")
    second = F.nth_value("p", 2).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return (
        by_anchor.withColumn("t_nclaims", F.count("*").over(t))
        .withColumn("t_rank", F.row_number().over(order) - 1)
        .withColumn("t_best_other", F.when(F.col("t_rank") == 0, F.coalesce(second, F.lit(0.0))).otherwise(F.max("p").over(t)))
        .withColumn("t_margin", F.col("p") - F.col("t_best_other"))
        .withColumn("t_n50_other", over(0.5, t) - (F.col("p") > 0.5).cast("int"))
    )
