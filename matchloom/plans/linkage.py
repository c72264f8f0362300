"""End-to-end plans: records to candidates, candidates to a trained matcher, records to matches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.operators import blocking, features, keys, labels, metrics, records, select, splits, stats
from matchloom.plans import learning
from matchloom.schema import CHANNELS, EXTRA_CHANNELS
from matchloom.scratch import held


def prepare(table: DataFrame, freq: DataFrame | None = None) -> DataFrame:
    """Records (entity_id, business_name, business_address, country) with codes, views and ordered tokens."""
    out = held(records.prepared(records.with_codes(table)))  # keys, statistics and features all start here
    return held(stats.in_rarity_order(out, freq)) if freq is not None else out


def candidates(anchors: DataFrame, targets: DataFrame, cap: int = 3000, k: int = 25, k_wide: int = 150, k_formula: int = 10, extra_k: int = 0) -> DataFrame:
    """Selected candidates with pool counts, from prepared anchors and targets."""
    channels = CHANNELS + EXTRA_CHANNELS if extra_k else CHANNELS
    a = anchors.withColumn("anchor", F.col("id"))
    ak, tk = keys.keys(a, channels, ("anchor",)), keys.keys(targets, channels, ("code",))
    found = select.select(a, targets, ak, tk, cap, k, k_wide, k_formula, extra_k)
    return blocking.pool_counts(found, ak, tk)


def featured(pairs: DataFrame, anchors: DataFrame, targets: DataFrame, freq: DataFrame) -> DataFrame:
    """The 70 columns; only targets that occur in pairs are prepared for pairing."""
    return features.features(pairs, anchors.withColumn("anchor", F.col("id")), blocking.needed_records(targets, pairs), freq)


def training_table(anchors: DataFrame, targets: DataFrame, truth: DataFrame, folds: int = 5, rate: float = 0.25, **k) -> tuple[DataFrame, DataFrame]:
    """(train, validation) pair tables with label and weight.

    Frequencies are counted outside fold 0; training anchors search targets outside fold 0, validation anchors
    (fold 0) search all.  A pair that crosses is an error.
    """
    a_fold, t_fold = splits.make_split(anchors.select(F.col("id").alias("anchor"), "country"), targets.select("code", "source", "country"), truth, folds)
    a_fold, t_fold = held(a_fold), held(t_fold)
    a = held(anchors.join(a_fold.select(F.col("anchor").alias("id"), "fold"), "id"))
    t = held(targets.join(t_fold.select("code", "fold"), "code"))
    labels.require_empty(splits.leaks(a_fold, t_fold, truth), "true pairs across folds")
    freq = held(stats.token_freq(t.filter("fold <> 0").drop("fold").unionByName(a.filter("fold <> 0").drop("fold"), allowMissingColumns=True)))
    train_a, train_t = a.filter("fold <> 0"), t.filter("fold <> 0")
    out = []
    for left, right in ((train_a, train_t), (a.filter("fold = 0"), t)):
        left, right = held(stats.in_rarity_order(left, freq)), held(stats.in_rarity_order(right, freq))
        pairs = held(featured(held(candidates(left, right, **k)), left, right, freq))
        out.append(labels.label(pairs, truth, ["anchor", "code"]))
    train = splits.thin_negatives(out[0], rate, F.concat_ws("-", "anchor", "code"))
    return train, out[1].withColumn("weight", F.lit(1.0).cast("float"))


def train_and_report(train: DataFrame, validation: DataFrame, anchors: DataFrame, t: float = 0.8, rounds: int = 40) -> tuple[learning.Matcher, DataFrame]:
    """The matcher and one row of validation scores; anchors: (anchor, n_true) of the validation part."""
    matcher = learning.fit(train, features.FEATURES, rounds=rounds, weight="weight")
    kept = learning.decide(matcher.predict(validation).withColumnRenamed("code", "target"), t).filter("keep")
    return matcher, metrics.report(metrics.anchor_scores(kept, anchors))


def predict(matcher: learning.Matcher, anchors: DataFrame, targets: DataFrame, freq: DataFrame, t: float = 0.8, stage2: learning.Matcher | None = None, **k) -> DataFrame:
    """(anchor, target, p, keep) of all candidates."""
    pairs = held(candidates(anchors, targets, **k))
    scored = held(matcher.predict(held(featured(pairs, anchors, targets, freq)))).withColumnRenamed("code", "target")
    if stage2 is not None:
        scored = learning.rejudge(stage2, scored)
    return learning.decide(scored, t).select("anchor", "target", "source", "p", "keep")
