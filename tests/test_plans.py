import random

import pytest
from pyspark.sql import functions as F

from matchloom.operators import stats
from matchloom.plans import learning, linkage
from matchloom.scratch import held
from matchloom.streaming.incremental import match_stream


def world(spark, n=70):
    rng = random.Random(4)
    words = "amber birch cedar delta ember frost grove haven iris jade kite lark maple north ocean pearl quartz river".split()
    rows, truth = [], []
    for i in range(1, n + 1):
        name, road = f"{rng.choice(words)} {rng.choice(words)} {words[i % 18]}{i}", f"{i} {rng.choice(words)} road {10000 + i}"
        rows.append((f"S1-{i}", name, road, "US"))
        if i % 10:
            rows.append((f"S2-{i}", name.upper() + " LLC", road.replace("road", "rd"), "US"))
            truth.append((i, 4_000_000_000 + i))
        rows.append((f"S3-{i}", f"{rng.choice(words)} {rng.choice(words)}", f"{i + 3} {rng.choice(words)} lane", "US"))
    table = linkage.prepare(spark.createDataFrame(rows, "entity_id string, business_name string, business_address string, country string"))
    return table.filter("source = 1"), table.filter("source <> 1"), spark.createDataFrame(truth, "anchor bigint, code bigint")


def test_training_and_prediction(spark):
    a, t, truth = world(spark)
    train, val = (held(x) for x in linkage.training_table(a, t, truth, rate=0.5, k=5, k_wide=8, k_formula=3))
    assert train.filter("label = 1").count() > 20 and {r["weight"] for r in train.select("weight").distinct().collect()} <= {1.0, 2.0}
    n_true = truth.groupBy("anchor").agg(F.count("*").alias("n_true"))
    valid = val.select("anchor").distinct().join(n_true, "anchor", "left").fillna(0)
    matcher, report = linkage.train_and_report(train, val, valid, t=0.5, rounds=8)
    assert report.first()["macro_f05"] > 0.8
    with pytest.raises(ValueError):
        matcher.predict(val, tuple(reversed(matcher.features)))
    assert abs(sum(g for _, g in matcher.importance()) - 1) < 1e-6
    out = linkage.predict(matcher, a, t, stats.token_freq(a.unionByName(t)), 0.5, k=5, k_wide=8, k_formula=3)
    kept = out.filter("keep")
    assert kept.count() == kept.select("target").distinct().count()


def test_second_stage(spark):
    rng = random.Random(1)
    rows = [(i, j, 1 if i == j else 0, 0.9 if i == j and rng.random() < 0.8 else rng.random() * 0.7) for i in range(60) for j in range(i, i + 3)]
    scored = spark.createDataFrame(rows, "anchor int, target int, label int, p double").withColumns({c: F.lit(0.0) for c in learning.CARRIED})
    anchors = spark.createDataFrame([(i, 1) for i in range(60)], "anchor int, n_true int")
    model, report = learning.fit_stage2(scored, anchors, rounds=3, depth=2)
    assert set(report["scores"]) == {0, 1} and learning.rejudge(model, scored).count() == len(rows)


def test_stream_equals_batch(spark, tmp_path):
    from matchloom.operators.blocking import candidates
    from matchloom.operators.keys import keys

    a, t, _ = world(spark, 20)
    raw = a.select("entity_id", "business_name", "business_address", "country")
    raw.repartition(3).write.parquet(str(tmp_path / "in"))
    tk = keys(t, carry=("code",))
    q = match_stream(spark.readStream.schema(raw.schema).parquet(str(tmp_path / "in")), tk, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    want = candidates(keys(a.withColumn("anchor", F.col("id")), carry=("anchor",)), tk)
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    assert sorted(map(str, got.select(sorted(got.columns)).collect())) == sorted(map(str, want.select(sorted(want.columns)).collect()))
