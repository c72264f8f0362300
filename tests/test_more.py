"""Operators for reports, stored postings, seeds and strict outputs."""

import pytest
from pyspark.sql import functions as F

from matchloom.operators import blocking, chargram, keys, metrics, select, splits
from matchloom.schema import CHANNELS, SOURCE_BASE
from matchloom.sources import tsv
from tests.test_linkage import POOL, recs, sides


def rows(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_stored_postings_find_the_same(spark):
    a, t = sides(recs(spark, POOL))
    ak, tk = keys.keys(a, CHANNELS, ("anchor",)), keys.keys(t, CHANNELS, ("code",))
    spark.sql("DROP TABLE IF EXISTS postings_test")
    stored = blocking.store_postings(tk, "postings_test", 4)
    got = blocking.candidates(ak, stored)
    assert rows(got.select("anchor", "code", "score", "ret_rank")) == rows(blocking.candidates(ak, tk).select("anchor", "code", "score", "ret_rank"))
    sizes = blocking.block_sizes(stored)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in sizes  # the buckets serve the aggregation
    with pytest.raises(Exception):
        blocking.store_postings(tk, "postings_test", 4)
    spark.sql("DROP TABLE postings_test")


def test_block_profile_p99(spark):
    keyed = spark.createDataFrame([("US", "c", f"k{i}", j) for i in range(100) for j in range(1 + (i == 0) * 9)], "country string, channel string, key string, code int")
    r = blocking.block_profile(keyed).first()
    assert (r["keys"], r["max_size"], round(r["mean_size"], 6)) == (100, 10, 1.09) and abs(r["p99_size"] - 1.09) < 1e-9


def test_missing_records_are_refused(spark):
    records = spark.createDataFrame([(1,), (2,)], "code int")
    pairs = spark.createDataFrame([(9, 1), (9, 3)], "anchor int, code int")
    assert blocking.needed_records(records, pairs).count() == 1
    with pytest.raises(ValueError):
        blocking.needed_records(records, pairs, check=True)


def test_seeds_reach_what_the_anchor_does_not(spark):
    p = recs(spark, [("S1-1", "alphabetical", "", "US"), ("S2-2", "alphabetically zyxwvutsrq", "", "US"), ("S3-3", "zyxwvutsrq", "", "US"), ("S3-4", "unrelatedword", "", "US")])
    a, t = sides(p)
    plain = chargram.gram_candidates(chargram.gram_rows(a, "anchor"), chargram.gram_rows(t, "code"), t)
    seed, far = 2 * SOURCE_BASE + 2, 3 * SOURCE_BASE + 3
    assert {r["code"] for r in plain.collect()} == {seed}
    match = lambda p, keep=True: spark.createDataFrame([(1, seed, p, keep)], "anchor bigint, code bigint, p double, keep boolean")
    got = {r["code"]: r for r in chargram.seeded_candidates(a, t, match(0.99)).collect()}
    assert set(got) == {seed, far} and got[seed]["rank"] == got[far]["rank"] == 0
    own = {r["code"]: r["score"] for r in plain.collect()}
    assert got[seed]["score"] > own[seed]  # the seed finds itself with all its grams
    for weak in (match(0.5), match(0.99, False)):
        assert {r["code"] for r in chargram.seeded_candidates(a, t, weak).collect()} == {seed}


def test_rank_distinct(spark):
    found = spark.createDataFrame([(1, 2, 7, 1.0, 3), (1, 2, 7, 4.0, 2), (1, 2, 6, 4.0, 9), (1, 3, 8, 0.5, 1)], "anchor int, source int, code int, score double, shared int")
    assert rows(select.rank_distinct(found).select("source", "code", "score", "shared", "rank")) == [(2, 6, 4.0, 9, 0), (2, 7, 4.0, 2, 1), (3, 8, 0.5, 1, 0)]


def test_learning_subsets_nest(spark):
    pairs = spark.range(500).select((F.col("id") % 50).alias("anchor"), F.col("id").alias("code"))
    few, more = splits.learning_subset(pairs, 10), splits.learning_subset(pairs, 30)
    ids = lambda x: {r[0] for r in x.select("anchor").distinct().collect()}
    assert few.count() == 100 and more.count() == 300 and ids(few) < ids(more)
    assert splits.learning_subset(pairs, 99).count() == 500


def test_reports(spark):
    anchors = spark.createDataFrame([(1, 2, "val"), (2, 0, "val"), (3, 1, "train")], "anchor int, n_true int, role string")
    pairs = spark.createDataFrame([(1, 10, 2, 0.9, 0, "val"), (1, 11, 2, 0.8, 1, "val"), (1, 12, 3, 0.1, 1, "val"), (3, 13, 2, 0.7, 1, "train"), (3, 14, 2, 0.2, 0, "train")], "anchor int, code int, source int, p double, label int, role string")
    assert tuple(metrics.build_report(pairs, pairs.filter("role = 'train' and label = 1"), anchors).first()) == (2, 1, 1, 3, 2, 1.0)
    assert tuple(metrics.build_report(pairs.limit(0), pairs.limit(0), anchors.limit(0)).first()) == (0, 0, 0, 0, 0, 0.0)
    got = {r["budget"]: (r["kept"], round(r["ceiling"], 6)) for r in metrics.budget_ceilings(pairs, anchors, (1, 2)).collect()}
    assert got == {1: (3, round((1.25 / 1.5 + 1 + 1) / 3, 6)), 2: (5, 1.0)}


def test_coverage_is_refused(spark):
    anchors = spark.createDataFrame([(1,), (2,)], "anchor int")
    answers = lambda *ids: spark.createDataFrame([(i,) for i in ids], "anchor int")
    assert metrics.check_coverage(answers(2, 1), anchors).count() == 2
    for bad in ((1,), (1, 2, 2), (1, 2, 3)):
        with pytest.raises(ValueError):
            metrics.check_coverage(answers(*bad), anchors)


def test_grouped_lists(spark, tmp_path):
    order = tsv.with_order(spark.createDataFrame([("S1-2",), ("S1-1",)], "source1_entity_id string").coalesce(1))
    pairs = lambda *x: spark.createDataFrame(list(x), "source1_entity_id string, target_entity_id string, group string")
    good = pairs(("S1-1", "S2-9", "US"), ("S1-1", "S2-10", "US"), ("S1-2", "S3-1", "IN"))
    tsv.write_id_lists_by_group(order, good, "matched_entity_ids", str(tmp_path / "a"))
    tsv.write_id_lists(order, good, "matched_entity_ids", str(tmp_path / "b"))
    text = lambda p: "".join(x.read_text() for x in sorted((tmp_path / p).glob("part-*")))
    assert text("a") == text("b") == "source1_entity_id\tmatched_entity_ids\nS1-2\tS3-1\nS1-1\tS2-10,S2-9\n"
    for bad in (pairs(("S1-1", "S2-9", "US"), ("S1-1", "S2-10", "IN")), pairs(("S1-1", "S2-9", "US"), ("S1-1", "S2-9", "US")), pairs(("S1-1", "S2-9", None))):
        with pytest.raises(ValueError):
            tsv.write_id_lists_by_group(order, bad, "x", str(tmp_path / "c"))
    with pytest.raises(ValueError):
        tsv.read_id_lists(spark, str(tmp_path / "a"), "candidate_entity_ids")


def test_pair_files_agree_on_weights(spark, tmp_path):
    path = str(tmp_path / "pairs")
    one = spark.createDataFrame([(1, 2, "train", "US", 1.0)], "anchor int, code int, role string, country string, weight double")
    tsv.write_pairs(one, path)
    assert tsv.read_pairs(spark, path, sort=True).count() == 1
    one.drop("weight").write.mode("append").partitionBy("role", "country").parquet(path)
    with pytest.raises(ValueError):
        tsv.read_pairs(spark, path)
