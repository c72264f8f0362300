"""The pair matcher: gradient-boosted trees on the feature columns, and a second stage on competing claims.

The trees are MLlib's.  They take no missing values, so a missing one becomes -1 with an indicator column of its own
(no feature that can be missing is negative).  Scores differ from other tree libraries'; the contract is the
column order, the split by anchor, weights, and reproducible training.
"""

from __future__ import annotations

import json

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.operators.compete import ANCHOR_SIDE, TARGET_SIDE, competition
from matchloom.operators.decide import one_owner, threshold
from matchloom.operators.metrics import best_threshold, sweep
from matchloom.operators.splits import half, is_dev
from matchloom.scratch import held

# Fixed columns of the second stage and its gate.
CARRIED = (
    "ret_score", "ret_rank", "avail_mean", "avail_rank", "name_tset", "addr_tset", "combo_rank", "n_strong_rivals", "t_addr_cnt", "a_addr_cnt",
    "t_name_cnt", "a_name_cnt", "numj_first_equal", "num_first_equal", "addr_empty_t", "n_channels", "is_s3",
)
CLAIMS = ("a_pmax", "a_gap", "a_rank", "a_n50", "a_n90", "a_psum", "t_nclaims", "t_rank", "t_best_other", "t_margin", "t_n50_other")
STAGE2 = ("p", *CARRIED, *CLAIMS)
P_MIN = 0.005
GRID = [round(0.3 + 0.05 * i, 2) for i in range(14)]


def _encoded(pairs: DataFrame, features: tuple[str, ...]) -> DataFrame:
    new = {}
    for f in features:
        new[f"x_{f}"] = F.coalesce(F.col(f).cast("double"), F.lit(-1.0))
        new[f"m_{f}"] = F.col(f).isNull().cast("double")
    return pairs.withColumns(new)


class Matcher:
    """A fitted model with the names and order of its features; it refuses other columns."""

    def __init__(self, model: PipelineModel, features: tuple[str, ...], meta: dict | None = None):
        self.model, self.features, self.meta = model, tuple(features), meta or {}

    def predict(self, pairs: DataFrame, features: tuple[str, ...] | None = None, out: str = "p") -> DataFrame:
        if features is not None and tuple(features) != self.features:
            raise ValueError("features differ from those of the model, or their order does")
        missing = [f for f in self.features if f not in pairs.columns]
        if missing:
            raise ValueError(f"missing features {missing}")
        kept = pairs.columns
        scored = self.model.transform(_encoded(pairs, self.features))
        return scored.withColumn(out, vector_to_array("probability")[1]).select(*[c for c in kept if c != out], out)

    def importance(self) -> list[tuple[str, float]]:
        """Features by their share of the total gain, an indicator counting for its feature."""
        raw = self.model.stages[-1].featureImportances
        gain = {f: float(raw[2 * i] + raw[2 * i + 1]) for i, f in enumerate(self.features)}
        return sorted(gain.items(), key=lambda x: (-x[1], x[0]))

    def save(self, spark, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        spark.createDataFrame([(json.dumps({"features": self.features, "meta": self.meta}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @classmethod
    def load(cls, spark, path: str) -> "Matcher":
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        return cls(PipelineModel.load(f"{path}/model"), tuple(meta["features"]), meta["meta"])


def fit(pairs: DataFrame, features: tuple[str, ...], rounds: int = 40, depth: int = 5, weight: str | None = None, seed: int = 7) -> Matcher:
    """Trains on (features, label, anchor[, weight]) with a development part split by anchor, never by pair."""
    data = held(pairs.select(*features, "label", "anchor", *([weight] if weight else [])))  # read once a round otherwise
    data = _encoded(data, features).withColumn("dev", is_dev(F.col("anchor"))).withColumn("label", F.col("label").cast("double"))
    inputs = [x for f in features for x in (f"x_{f}", f"m_{f}")]
    trees = GBTClassifier(labelCol="label", featuresCol="features", maxIter=rounds, maxDepth=depth, stepSize=0.1, subsamplingRate=0.8, featureSubsetStrategy="0.8", maxBins=64, seed=seed, validationIndicatorCol="dev")
    if weight:
        trees = trees.setWeightCol(weight)
    return Matcher(Pipeline(stages=[VectorAssembler(inputCols=inputs, outputCol="features"), trees]).fit(data), features, {"rounds": rounds, "depth": depth, "seed": seed})


def stage2_table(scored: DataFrame) -> DataFrame:
    """Claims over all pairs, then the columns of the second stage for the pairs that it judges again."""
    claimed = competition(scored.withColumnRenamed("code", "target") if "target" not in scored.columns else scored)
    keys = [c for c in ("anchor", "target", "label") if c in claimed.columns]
    return claimed.filter(F.col("p") >= P_MIN).select(*keys, *(F.col(c).cast("float").alias(c) for c in STAGE2))


def fit_stage2(scored: DataFrame, anchors: DataFrame, rounds: int = 20, depth: int = 4, grid: list[float] = GRID) -> tuple[Matcher, dict]:
    """Second stage with an honest report: each half is judged by the other's model and threshold."""
    table = held(stage2_table(scored).withColumn("half", half(F.col("anchor"))))
    models = {h: fit(table.filter(F.col("half") != h), STAGE2, rounds, depth) for h in (0, 1)}
    parts = [models[h].predict(table.filter(F.col("half") == h)).select("anchor", "target", "label", "p", "half") for h in (0, 1)]
    oof = held(parts[0].unionByName(parts[1]))
    side = anchors.withColumn("half", half(F.col("anchor")))
    report = {"thresholds": {}, "scores": {}}
    for h in (0, 1):
        chosen = best_threshold(sweep(oof.filter(F.col("half") != h), side.filter(F.col("half") != h), grid)).first()
        report["thresholds"][h] = chosen["t"]
        report["scores"][h] = sweep(oof.filter(F.col("half") == h), side.filter(F.col("half") == h), [chosen["t"]]).first()["macro_f05"]
    final = fit(table, STAGE2, rounds, depth)
    return final, report


def rejudge(stage2: Matcher, scored: DataFrame) -> DataFrame:
    """Pairs with the second stage's probability where it judges, the first stage's elsewhere."""
    table = stage2.predict(stage2_table(scored)).select("anchor", "target", F.col("p").alias("p2"))
    base = scored.withColumnRenamed("code", "target") if "target" not in scored.columns else scored
    return base.join(table, ["anchor", "target"], "left").withColumn("p", F.coalesce("p2", "p")).drop("p2")


def decide(scored: DataFrame, t: float = 0.8) -> DataFrame:
    return one_owner(threshold(scored, t))


assert CLAIMS == (*ANCHOR_SIDE, *TARGET_SIDE)
