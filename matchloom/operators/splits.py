"""Leak-free folds, samples and their checks.  Shuffles are hashes of ids, so they repeat at any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEED = 20260925


def match_bucket(n: Column) -> Column:
    return F.when(n <= 1, n).when(n <= 3, 2).when(n <= 5, 4).otherwise(6).cast("int")


def deal(rows: DataFrame, strata: list[str], key: str, folds: int, seed: int) -> DataFrame:
    """Adds ``fold``: members of each stratum in hash order, dealt in turn.

    Ranks are those of a stratum's earlier hash buckets and of the own bucket, so no task orders a whole stratum.
    """
    h = F.xxhash64(F.col(key), F.lit(seed))
    placed = rows.withColumns({"__h": h, "__bucket": F.shiftright(h, 52), "__stratum": F.to_json(F.struct(*strata))})
    counts = placed.groupBy("__stratum", "__bucket").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("__stratum").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("__stratum", "__bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("__base"))
    inside = F.row_number().over(Window.partitionBy("__stratum", "__bucket").orderBy("__h", key)) - 1
    ranked = placed.withColumn("__inside", inside).join(base, ["__stratum", "__bucket"])
    return ranked.withColumn("fold", ((F.col("__base") + F.col("__inside")) % folds).cast("tinyint")).select(*rows.columns, "fold")


def check_truth(anchors: DataFrame, targets: DataFrame, truth: DataFrame) -> None:
    """Raises if a true pair names an unknown anchor or target, or if two anchors share a target."""
    unknown = truth.join(anchors, "anchor", "left_anti").select(F.lit("anchor").alias("what"), F.col("anchor").alias("id"))
    missing = truth.join(targets, "code", "left_anti").select(F.lit("target").alias("what"), F.col("code").alias("id"))
    shared = truth.distinct().groupBy("code").count().filter("count > 1").select(F.lit("shared target").alias("what"), F.col("code").alias("id"))
    found = unknown.unionByName(missing).unionByName(shared).limit(5).collect()
    if found:
        raise ValueError("truth does not fit the records: " + ", ".join(f"{r['what']} {r['id']}" for r in found))


def make_split(anchors: DataFrame, targets: DataFrame, truth: DataFrame, folds: int = 5, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Folds of anchors (anchor, country) and targets (code, source, country); truth is (anchor, code).

    Anchors are dealt within (country, match count bucket); a matched target follows its owner; the others are
    dealt within (country, source).  Truth that names unknown ids or shares a target is refused.
    """
    check_truth(anchors, targets, truth)
    counts = truth.groupBy("anchor").agg(F.count("*").alias("n_true"))
    a = anchors.join(counts, "anchor", "left").fillna(0, ["n_true"]).withColumn("bucket", match_bucket(F.col("n_true")))
    a = deal(a, ["country", "bucket"], "anchor", folds, seed)
    owned = truth.join(a.select("anchor", "fold"), "anchor").select("code", F.col("fold").alias("owner_fold"))
    t = targets.join(owned, "code", "left")
    free = deal(t.filter("owner_fold is null").drop("owner_fold"), ["country", "source"], "code", folds, seed + 1)
    taken = t.filter("owner_fold is not null").withColumn("fold", F.col("owner_fold").cast("tinyint")).drop("owner_fold")
    return a, taken.unionByName(free)


def leaks(anchor_folds: DataFrame, target_folds: DataFrame, truth: DataFrame) -> DataFrame:
    """True pairs whose two sides lie in different folds; must be empty."""
    joined = truth.join(anchor_folds.select("anchor", F.col("fold").alias("a_fold")), "anchor").join(target_folds.select("code", F.col("fold").alias("t_fold")), "code")
    return joined.filter("a_fold <> t_fold")


def fold_summary(anchor_folds: DataFrame, target_folds: DataFrame) -> DataFrame:
    a = anchor_folds.groupBy("fold").agg(F.count("*").alias("anchors"))
    t = target_folds.groupBy("fold").agg(F.count("*").alias("targets"))
    return a.join(t, "fold", "full").withColumn("ratio", F.col("targets") / F.col("anchors"))


def outside(folds: DataFrame, fold: int = 0) -> DataFrame:
    return folds.filter(F.col("fold") != fold)


def sample(rows: DataFrame, key: str, n: int, seed: int = SEED) -> DataFrame:
    """A fixed sample without replacement of n rows, in hash order."""
    return rows.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def learning_subset(pairs: DataFrame, n: int, seed: int = 3) -> DataFrame:
    """All pairs of a fixed random n of the anchors that have pairs (all, if fewer), for a learning curve.

    Subsets of growing n contain each other.
    """
    return pairs.join(sample(pairs.select("anchor").distinct(), "anchor", n, seed), "anchor", "left_semi")


def is_dev(anchor: Column, share: float = 0.1, seed: int = 7) -> Column:
    """Whether an anchor, with all its pairs, belongs to the development part."""
    return F.pmod(F.xxhash64(anchor, F.lit(seed)), F.lit(10_000)) < int(10_000 * share)


def half(anchor: Column, seed: int = 3) -> Column:
    return F.pmod(F.xxhash64(anchor, F.lit(seed)), F.lit(2)).cast("int")


def thin_negatives(pairs: DataFrame, rate: float, key: Column, seed: int = 5) -> DataFrame:
    """Keeps all positives and hard negatives, and a share of easy ones with the inverse weight.

    Only after the context columns, which need all candidates.
    """
    hard = (F.col("combo_rank") < 5) | (F.col("ret_rank") < 3) | (F.coalesce("name_tset", F.lit(0.0)) >= 0.8) | (F.coalesce("addr_tset", F.lit(0.0)) >= 0.8)
    easy = (F.col("label") == 0) & ~hard
    drawn = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 20)) < int((1 << 20) * rate)
    return pairs.filter(~easy | drawn).withColumn("weight", F.when(easy, F.lit(1 / rate)).otherwise(1.0).cast("float"))
