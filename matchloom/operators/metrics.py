"""Match quality per anchor and per run, blocking ceilings, and reports.

Scores start from the table of all anchors, so anchors without candidates count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.operators.labels import require_empty, require_unique

BUCKETS = (0.0, 0.1, 0.3, 0.5, 0.7, 0.9, 0.97, 1.01)


def f05(tp: Column, fp: Column, n_true: Column) -> Column:
    """F0.5 of an anchor; one without true matches scores 1 if nothing was predicted, else 0."""
    found = 1.25 * tp / (1.25 * tp + fp + 0.25 * (n_true - tp))
    wrong = F.raise_error(F.lit("more true positives than true matches")).cast("double")
    return F.when(tp > n_true, wrong).when(n_true == 0, F.when(tp + fp == 0, 1.0).otherwise(0.0)).otherwise(F.when(tp == 0, 0.0).otherwise(found))


def anchor_scores(kept: DataFrame, anchors: DataFrame) -> DataFrame:
    """anchors (anchor, n_true, ...) with tp, fp, fn and f05, from kept pairs (anchor, label)."""
    counts = kept.groupBy("anchor").agg(F.sum(F.col("label").cast("long")).alias("tp"), F.sum((1 - F.col("label")).cast("long")).alias("fp"))
    out = anchors.join(counts, "anchor", "left").fillna(0, ["tp", "fp"])
    return out.withColumn("fn", F.col("n_true") - F.col("tp")).withColumn("f05", f05(F.col("tp"), F.col("fp"), F.col("n_true")))


def macro(scores: DataFrame) -> DataFrame:
    single = F.col("n_true") == 0
    return scores.agg(
        F.avg("f05").alias("macro_f05"),
        F.avg(F.when(~single, F.col("f05"))).alias("non_singleton"),
        F.avg(F.when(single, F.col("f05"))).alias("singleton"),
        (F.sum(F.col("tp") + F.col("fp")) / F.count("*")).alias("pred_per_s1"),
    )


def check_coverage(answers: DataFrame, anchors: DataFrame) -> DataFrame:
    """The answers (one row an anchor), if they cover every anchor once and no other; else an error."""
    require_unique(answers, ["anchor"], "anchors answered twice")
    require_empty(anchors.join(answers, "anchor", "left_anti").select("anchor"), "anchors without an answer")
    require_empty(answers.join(anchors, "anchor", "left_anti").select("anchor"), "answers of unknown anchors")
    return answers


def report(scores: DataFrame) -> DataFrame:
    """One row: the score, its halves, the score of an empty answer, and pooled counts."""
    single = F.col("n_true") == 0
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    return scores.agg(
        F.avg("f05").alias("macro_f05"),
        F.count("*").alias("n_entities"),
        F.sum(single.cast("long")).alias("n_singletons"),
        F.sum((~single).cast("long")).alias("n_non_singletons"),
        F.avg(single.cast("double")).alias("singleton_rate"),
        F.avg(single.cast("double")).alias("empty_baseline"),
        F.avg(F.when(single, F.col("f05"))).alias("singleton_score"),
        F.avg(F.when(~single, F.col("f05"))).alias("non_singleton_score"),
        tp.alias("pair_tp"),
        fp.alias("pair_fp"),
        fn.alias("pair_fn"),
        F.try_divide(tp, tp + fp).alias("pair_precision"),
        F.try_divide(tp, tp + fn).alias("pair_recall"),
    )


def lower_percentile(counts: DataFrame, column: str, shares: dict[str, float]) -> DataFrame:
    """One row of exact percentiles without interpolation: the value at position floor(share * (n - 1)).

    Values are counted first, so the ordered window has one row for each distinct value.
    """
    groups = counts.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("c"))
    upto = groups.withColumn("last", F.sum("c").over(Window.orderBy("v")) - 1).withColumn("n", F.sum("c").over(Window.partitionBy()))
    return upto.agg(*(F.min(F.when(F.col("last") >= F.floor(p * (F.col("n") - 1)), F.col("v"))).cast("double").alias(name) for name, p in shares.items()))


def blocking(truth: DataFrame, pairs: DataFrame, anchors: DataFrame, total_pairs: int | None = None) -> DataFrame:
    """One row on candidates before any model: recall, ceiling, volume.

    truth: (anchor, code); pairs: candidates (anchor, code); anchors: (anchor, n_true).
    """
    unique = pairs.select("anchor", "code").distinct()
    found = unique.join(truth.select("anchor", "code").distinct(), ["anchor", "code"], "left_semi").groupBy("anchor").agg(F.count("*").alias("hit"))
    volume = unique.groupBy("anchor").agg(F.count("*").alias("cands"))
    per = anchors.join(found, "anchor", "left").join(volume, "anchor", "left").fillna(0, ["hit", "cands"])
    many = F.col("n_true") > 0
    out = per.agg(
        F.try_divide(F.sum("hit"), F.sum("n_true")).alias("pair_blocking_recall"),
        F.avg(F.when(many, F.col("hit") / F.col("n_true"))).alias("mean_per_entity_recall"),
        F.avg(F.when(many, (F.col("hit") == F.col("n_true")).cast("double"))).alias("full_coverage_rate"),
        F.avg(f05(F.col("hit"), F.lit(0), F.col("n_true"))).alias("oracle_macro_f05"),
        F.sum("cands").alias("candidates_total"),
        F.avg("cands").alias("candidates_mean"),
        F.max("cands").alias("candidates_max"),
        F.sum(F.col("n_true") - F.col("hit")).alias("missed_positives"),
    )
    if total_pairs:
        out = out.withColumn("reduction_ratio", 1 - F.col("candidates_total") / F.lit(total_pairs))
    return out.withColumn("__one", F.lit(1)).join(lower_percentile(per, "cands", {"candidates_median": 0.5, "candidates_p95": 0.95}).withColumn("__one", F.lit(1)), "__one").drop("__one")


def build_report(pairs: DataFrame, kept: DataFrame, anchors: DataFrame) -> DataFrame:
    """One row on built pair tables: (train_all, train_kept, train_pos, val, val_pos, val_blocking_recall).

    pairs: (role, label) with role train or val; kept: the training pairs left after thinning; anchors: (role,
    n_true).  A recall without true pairs is 0.
    """
    of = lambda role, x: F.sum(F.when(F.col("role") == role, x).otherwise(0))
    label = F.col("label").cast("long")
    totals = pairs.agg(F.coalesce(of("train", F.lit(1)), F.lit(0)).alias("train_all"), F.coalesce(of("train", label), F.lit(0)).alias("train_pos"), F.coalesce(of("val", F.lit(1)), F.lit(0)).alias("val"), F.coalesce(of("val", label), F.lit(0)).alias("val_pos"))
    left = kept.agg(F.count("*").alias("train_kept"))
    truth = anchors.agg(F.coalesce(of("val", F.col("n_true")), F.lit(0)).alias("n_true"))
    one = lambda frame: frame.withColumn("__one", F.lit(1))
    out = one(totals).join(one(left), "__one").join(one(truth), "__one")
    recall = F.col("val_pos") / F.greatest("n_true", F.lit(1))
    return out.select("train_all", "train_kept", "train_pos", "val", "val_pos", recall.alias("val_blocking_recall"))


def budget_ceilings(scored: DataFrame, anchors: DataFrame, budgets: tuple[int, ...] = (25, 50, 75)) -> DataFrame:
    """(budget, kept, ceiling): candidates re-ranked by ``p`` within anchor and source, the pairs within each budget,
    and the score of a perfect decision among them.

    scored: (anchor, code, source, p, label); ties go to the smaller code.  Pairs are ranked and counted once for all
    budgets.
    """
    order = Window.partitionBy("anchor", "source").orderBy(F.desc("p"), "code")
    ranked = scored.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= max(budgets))
    inside = [(b, F.col("rn") <= b) for b in budgets]
    counts = ranked.groupBy("anchor").agg(*(F.sum(F.when(x, F.col("label").cast("long")).otherwise(0)).alias(f"hit{b}") for b, x in inside), *(F.count(F.when(x, 1)).alias(f"kept{b}") for b, x in inside))
    per = anchors.join(counts, "anchor", "left").fillna(0, [c for c in counts.columns if c != "anchor"])
    row = per.agg(*(F.avg(f05(F.col(f"hit{b}"), F.lit(0), F.col("n_true"))).alias(f"c{b}") for b in budgets), *(F.sum(f"kept{b}").alias(f"k{b}") for b in budgets))
    return row.select(F.inline(F.array(*(F.struct(F.lit(b).alias("budget"), F.col(f"k{b}").alias("kept"), F.col(f"c{b}").alias("ceiling")) for b in budgets))))


def by_country(scores: DataFrame) -> DataFrame:
    """Scores of each country and of all (country NULL)."""
    return scores.rollup("country").agg(F.count("*").alias("n"), F.avg("f05").alias("macro_f05"))


def sweep(pairs: DataFrame, anchors: DataFrame, grid: list[float]) -> DataFrame:
    """(t, macro_f05) for each threshold after one-owner; the pairs are read once for the whole grid.

    Each pair is repeated for the thresholds that it reaches, so the grid is no join.
    """
    steps = F.filter(F.array(*map(F.lit, grid)), lambda t: t <= F.col("p"))
    reached = pairs.withColumn("t", F.explode(steps))
    order = Window.partitionBy("t", "target").orderBy(F.desc("p"), "anchor")
    kept = reached.withColumn("rn", F.row_number().over(order)).filter("rn = 1")
    counts = kept.groupBy("t", "anchor").agg(F.sum(F.col("label").cast("long")).alias("tp"), F.sum((1 - F.col("label")).cast("long")).alias("fp"))
    every = anchors.withColumn("t", F.explode(F.array(*map(F.lit, grid))))
    scored = every.join(counts, ["t", "anchor"], "left").fillna(0, ["tp", "fp"])
    return scored.groupBy("t").agg(F.avg(f05(F.col("tp"), F.col("fp"), F.col("n_true"))).alias("macro_f05"))


def best_threshold(swept: DataFrame) -> DataFrame:
    """The first threshold with the best score."""
    return swept.orderBy(F.desc(F.round("macro_f05", 12)), "t").limit(1)


def calibration(pairs: DataFrame) -> DataFrame:
    """(bucket, n, mean_p, mean_label) over fixed probability buckets."""
    bucket = F.lit(None).cast("double")
    for low in BUCKETS[:-1]:
        bucket = F.when(F.col("p") >= low, F.lit(low)).otherwise(bucket)
    return pairs.withColumn("bucket", bucket).filter(F.col("p") < BUCKETS[-1]).groupBy("bucket").agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg("label").alias("mean_label"))


def channel_shares(found: DataFrame, bits: dict[str, int]) -> DataFrame:
    """Share of found true pairs that carry each channel's bit."""
    one = found.agg(*(F.avg(((F.col("channels").bitwiseAND(F.lit(b))) != 0).cast("double")).alias(c) for c, b in bits.items()))
    return one.unpivot([], list(bits), "channel", "share")


def rank_depth(truth: DataFrame, ranked: DataFrame, bands: tuple[int, ...] = (25, 50, 150)) -> DataFrame:
    """How deep true pairs lie: by band of their blocking rank, deeper, or never found."""
    band = F.lit(f"over {bands[-1]}")
    for b in reversed(bands):
        band = F.when(F.col("ret_rank") < b, F.lit(f"below {b}")).otherwise(band)
    joined = truth.select("anchor", "code").join(ranked.select("anchor", "code", "ret_rank"), ["anchor", "code"], "left")
    return joined.groupBy(F.when(F.col("ret_rank").isNull(), F.lit("never found")).otherwise(band).alias("band")).agg(F.count("*").alias("n"))


def run_summary(pairs: DataFrame, anchors: DataFrame) -> DataFrame:
    """Per country: anchors, candidate pairs, kept pairs, anchors with a match and their share."""
    per = pairs.groupBy("anchor").agg(F.count("*").alias("pairs"), F.sum(F.col("keep").cast("long")).alias("kept"))
    rows = anchors.join(per, "anchor", "left").fillna(0, ["pairs", "kept"])
    matched = (F.col("kept") > 0).cast("long")
    return rows.groupBy("country").agg(
        F.count("*").alias("anchors"),
        F.sum("pairs").alias("pairs"),
        F.sum("kept").alias("kept"),
        F.sum(matched).alias("with_match"),
        F.avg(matched).alias("share"),
        (F.sum("kept") / F.count("*")).alias("kept_per_anchor"),
    )


def error_reasons(truth: DataFrame, scored: DataFrame, t: float) -> DataFrame:
    """(anchor, target, reason) of every missed true pair and every wrong kept one.

    scored: (anchor, target, p, label, keep) after one-owner.
    """
    missed = truth.select("anchor", "target").join(scored.select("anchor", "target", "p", "keep"), ["anchor", "target"], "left").filter(~F.coalesce("keep", F.lit(False)))
    reason = F.when(F.col("p").isNull(), "not_retrieved").when(F.col("p") < t, "below_threshold").otherwise("lost_ownership")
    wrong = scored.filter(F.col("keep") & (F.col("label") == 0)).select("anchor", "target", F.lit("false_positive").alias("reason"))
    return missed.select("anchor", "target", reason.alias("reason")).unionByName(wrong)


def loss_by_reason(reasons: DataFrame, scores: DataFrame) -> DataFrame:
    """Score lost by anchors, shared evenly over each anchor's errors."""
    n = reasons.groupBy("anchor").agg(F.count("*").alias("errors"))
    joined = reasons.join(n, "anchor").join(scores.select("anchor", "f05"), "anchor")
    return joined.groupBy("reason").agg(F.count("*").alias("n"), F.sum((1 - F.col("f05")) / F.col("errors")).alias("loss"))


def bootstrap(deltas: DataFrame, draws: int = 1000, seed: int = 7) -> DataFrame:
    """(mean, low, high) of paired per-anchor deltas: Poisson(1) weights from hashes, one pass over the anchors.

    Each anchor gives its weight in every draw from a hash, so nothing is shuffled but one sum a draw and task.
    """
    steps = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.999916758850712]
    u = lambda i: (F.pmod(F.xxhash64("anchor", i, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30))
    weight = lambda i: sum((u(i) >= s).cast("int") for s in steps)
    rows = deltas.select("anchor", "delta", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw")).withColumn("w", weight(F.col("draw")))
    means = rows.groupBy("draw").agg(F.try_divide(F.sum(F.col("w") * F.col("delta")), F.sum("w")).alias("m"))
    return means.agg(F.avg("m").alias("mean"), F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))
