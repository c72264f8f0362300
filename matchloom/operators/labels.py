"""Truth against records and candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def label(pairs: DataFrame, truth: DataFrame, on: list[str]) -> DataFrame:
    """Adds ``label``: 1 for pairs of the truth.  Anchors and targets keep their global ids throughout."""
    edges = truth.select(*on).distinct().withColumn("__true", F.lit(1))
    return pairs.join(edges, on, "left").withColumn("label", F.coalesce("__true", F.lit(0)).cast("tinyint")).drop("__true")


def missing_positives(truth: DataFrame, pairs: DataFrame, on: list[str]) -> DataFrame:
    """True pairs that no candidate covers; for training only."""
    return truth.join(pairs.select(*on).distinct(), on, "left_anti")


def truth_edges(truth: DataFrame) -> DataFrame:
    """(source1_entity_id, target_entity_id, position): one row a listed id; blanks inside a list are dropped."""
    parts = F.filter(F.transform(F.split(F.coalesce("matched_entity_ids", F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return truth.select("source1_entity_id", F.posexplode(parts).alias("position", "target_entity_id"))


def truth_audit(anchors: DataFrame, targets: DataFrame, truth: DataFrame) -> DataFrame:
    """(problem, n): inconsistencies between truth and records; reports, never raises."""
    edges = truth_edges(truth)
    ids = anchors.select(F.col("entity_id").alias("source1_entity_id"))
    known = targets.select(F.col("entity_id").alias("target_entity_id"))
    count = lambda frame, name: frame.agg(F.count("*").alias("n")).select(F.lit(name).alias("problem"), "n")
    repeated = edges.groupBy("source1_entity_id", "target_entity_id").agg(F.count("*").alias("c")).filter("c > 1")
    claimed = edges.select("source1_entity_id", "target_entity_id").distinct().groupBy("target_entity_id").agg(F.count("*").alias("c")).filter("c > 1")
    parts = [
        count(truth.join(ids, "source1_entity_id", "left_anti"), "truth_without_record"),
        count(ids.join(truth, "source1_entity_id", "left_anti"), "record_without_truth"),
        count(edges.join(known, "target_entity_id", "left_anti"), "unknown_target"),
        count(repeated, "repeated_in_list"),
        count(claimed, "claimed_twice"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def exclusive(truth: DataFrame) -> DataFrame:
    """Targets claimed by two anchors; must be empty."""
    return truth.groupBy("code").agg(F.countDistinct("anchor").alias("anchors")).filter("anchors > 1")


def require_empty(frame: DataFrame, what: str) -> None:
    found = frame.take(3)
    if found:
        raise ValueError(f"{what}: {found}")


def require_unique(frame: DataFrame, key: list[str], what: str) -> None:
    require_empty(frame.groupBy(*key).count().filter("count > 1"), what)
