"""Two-phase selection: a wide list by key rarity, re-ranked by a formula on the texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions.similarity import similarity
from matchloom.operators import search
from matchloom.operators.blocking import KEY, candidates, weighed
from matchloom.schema import EXTRA_CHANNELS


def formula(name_sim: Column, addr_sim: Column, ret_score: Column) -> Column:
    """Mean of the known similarities, 0 if both are unknown, and a trace of the blocking score for ties."""
    return F.coalesce((name_sim + addr_sim) / 2, name_sim, addr_sim, F.lit(0.0)) + 1e-6 * ret_score.cast("double")


def reselect(wide: DataFrame, k_keep: int = 25, k_formula: int = 10) -> DataFrame:
    """From (anchor, code, source, score, ret_rank, formula): blocking's best and the formula's best."""
    order = Window.partitionBy("anchor", "source").orderBy(F.desc("formula"), "code")
    ranked = wide.withColumn("frank", F.row_number().over(order) - 1)
    return ranked.filter((F.col("ret_rank") < k_keep) | (F.col("frank") < k_formula)).drop("frank")


def with_formula(wide: DataFrame, anchors: DataFrame, targets: DataFrame) -> DataFrame:
    """Adds ``formula`` by token-set similarity; only names and addresses of the records are joined."""
    a = anchors.select("anchor", F.col("name").alias("__na"), F.col("addr").alias("__aa"))
    t = targets.select("code", F.col("name").alias("__nt"), F.col("addr").alias("__at"))
    tset = similarity("tset")
    out = wide.join(a, "anchor").join(t, "code").withColumn("name_tset", tset("__na", "__nt")).withColumn("addr_tset", tset("__aa", "__at"))
    return out.withColumn("formula", formula(F.col("name_tset"), F.col("addr_tset"), F.col("score"))).drop("__na", "__aa", "__nt", "__at")


def jaccard(a: Column, t: Column) -> Column:
    """Of two arrays of distinct tokens; NULL if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(t) > 0), F.size(F.array_intersect(a, t)) / F.size(F.array_union(a, t)))


def select_by_tokens(anchors: DataFrame, targets: DataFrame, anchor_keys: DataFrame, target_keys: DataFrame, cap: int = 3000, k_keep: int = 25, k_wide: int = 150, k_formula: int = 10) -> DataFrame:
    """(anchor, code, source, score, channels, ret_rank): the wide list re-ranked by the Jaccard likeness of ``ntok``.

    anchors: (anchor, country, ntok), targets: (code, country, ntok), both held.  The search compares the tokens where
    it ranks, so the wide list is not shuffled; where an id comes in several rows, each of them counts, by joins.
    """
    a, t = anchors.select("anchor", "country", F.col("ntok").alias("tokens")), targets.select("code", "country", F.col("ntok").alias("tokens"))
    if all(x.groupBy(c).count().filter("count > 1").isEmpty() for x, c in ((a, "anchor"), (t, "code"))):
        found = search.best(anchor_keys, target_keys, KEY, cap, k_wide, weighed, 4, single=True, bits=True, tokens=(a, t), keep=(k_keep, k_formula))
        return found.select("anchor", "code", "source", "score", "channels", F.col("rank").alias("ret_rank"))
    wide = candidates(anchor_keys, target_keys, cap, k_wide).join(a.select("anchor", F.col("tokens").alias("na")), "anchor").join(t.select("code", F.col("tokens").alias("nt")), "code")
    wide = wide.withColumn("formula", F.round(formula(jaccard(F.col("na"), F.col("nt")), F.lit(None).cast("double"), F.col("score")), 9))
    return reselect(wide, k_keep, k_formula).select("anchor", "code", "source", "score", "channels", "ret_rank")


def add_quota(selected: DataFrame, extra: DataFrame, k_wide: int) -> DataFrame:
    """Adds one extra channel's own best; a pair that is there gets the channel's bit, a new one its own score."""
    base = selected.select("anchor", "code", "source", "score", "channels", "ret_rank", F.lit(1).alias("own"))
    more = extra.select("anchor", "code", "source", "score", "channels", F.lit(k_wide).alias("ret_rank"), F.lit(0).alias("own"))
    first = F.max_by(F.struct("score", "ret_rank"), "own")
    out = base.unionByName(more).groupBy("anchor", "code", "source").agg(first.alias("f"), F.bit_or("channels").alias("channels"))
    return out.select("anchor", "code", "source", F.col("f.score").alias("score"), "channels", F.col("f.ret_rank").alias("ret_rank"))


def rank_distinct(found: DataFrame) -> DataFrame:
    """Each (anchor, code) once, with its best score, and ``rank`` from 0 within anchor and source; ties go to the
    smaller code."""
    best = found.groupBy("anchor", "source", "code").agg(F.max_by("shared", F.struct("score", "shared")).alias("shared"), F.max("score").alias("score"))
    order = Window.partitionBy("anchor", "source").orderBy(F.desc("score"), "code")
    return best.withColumn("rank", F.row_number().over(order) - 1)


def select(anchors: DataFrame, targets: DataFrame, anchor_keys: DataFrame, target_keys: DataFrame, cap: int = 3000, k_keep: int = 25, k_wide: int = 150, k_formula: int = 10, extra_k: int = 0) -> DataFrame:
    """(anchor, code, source, score, channels, ret_rank) of the selected candidates.

    Extra channels take no part in the wide list; each then adds its own best.  Without a wider list or a formula
    quota this is plain blocking.
    """
    plain_a, plain_t = (x.filter(~F.col("channel").isin(*EXTRA_CHANNELS)) for x in (anchor_keys, target_keys))
    if not (k_wide > k_keep and k_formula > 0):
        return candidates(plain_a, plain_t, cap, k_keep)
    out = reselect(with_formula(candidates(plain_a, plain_t, cap, k_wide), anchors, targets), k_keep, k_formula)
    out = out.select("anchor", "code", "source", "score", "channels", "ret_rank")
    for channel in EXTRA_CHANNELS if extra_k else ():
        out = add_quota(out, candidates(anchor_keys, target_keys, cap, extra_k, (channel,)), k_wide)
    return out
