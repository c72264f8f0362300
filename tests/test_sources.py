import pytest
from pyspark.sql import functions as F

from matchloom.plans.cli import parser
from matchloom.plans.manifest import Stages
from matchloom.sources import tsv


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


HEAD = "entity_id\tbusiness_name\tbusiness_address\tcountry\n"


def test_read(spark, tmp_path):
    p = put(tmp_path / "a.tsv", "﻿" + HEAD + 'S2-1 \t NA \t"quoted" \\x #1\tUS\nS2-2\tnull\t\t\n')
    rows = [tuple(r) for r in tsv.read_source(spark, p, "S2-").orderBy("entity_id").collect()]
    assert rows == [("S2-1", " NA ", '"quoted" \\x #1', "US"), ("S2-2", "null", "", "")]
    with pytest.raises(ValueError):
        tsv.read_source(spark, p, "S3-")
    with pytest.raises(ValueError):
        tsv.read_tsv(spark, put(tmp_path / "b.tsv", "entity_id\tcountry\nS2-1\tUS\n"), tsv.RECORDS)
    with pytest.raises(Exception):
        tsv.read_tsv(spark, put(tmp_path / "c.tsv", HEAD + "S2-1\tx\n"), tsv.RECORDS).collect()
    with pytest.raises(ValueError):
        tsv.read_source(spark, put(tmp_path / "d.tsv", HEAD + "S2-1\ta\tb\tc\nS2-1\ta\tb\tc\n"), "S2-")


def test_id_lists_round_trip(spark, tmp_path):
    order = tsv.with_order(spark.createDataFrame([(f"S1-{i}",) for i in (5, 1, 3)], "source1_entity_id string").coalesce(1))
    pairs = spark.createDataFrame([("S1-3", "S2-9"), ("S1-3", "S2-10"), ("S1-3", "S2-9"), ("S1-5", "S3-1")], "source1_entity_id string, target_entity_id string")
    tsv.write_id_lists(order, pairs, "matched_entity_ids", str(tmp_path / "out"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text == "source1_entity_id\tmatched_entity_ids\nS1-5\tS3-1\nS1-1\t\nS1-3\tS2-10,S2-9\n"
    back = tsv.read_id_lists(spark, str(tmp_path / "out"), "matched_entity_ids")
    assert sorted(map(tuple, back.collect())) == [("S1-1", ""), ("S1-3", "S2-10,S2-9"), ("S1-5", "S3-1")]
    assert len(tsv.checksum(spark, str(tmp_path / "out"))) == 64
    targets = spark.createDataFrame([("S2-9",), ("S2-10",)], "entity_id string")
    report = {r["problem"]: r["n"] for r in tsv.check_submission(order, back, back.withColumnRenamed("matched_entity_ids", "candidate_entity_ids"), targets).collect()}
    assert report == {"anchor_without_line": 0, "line_without_anchor": 0, "unknown_target": 1, "match_outside_candidates": 0, "repeated_in_list": 0}
    with pytest.raises(ValueError):
        tsv.id_lists(order, pairs.withColumn("target_entity_id", F.lit("S1-1")), "x")


def test_stages(spark, tmp_path):
    made = []
    folder = str(tmp_path / "run")
    make = lambda: made.append(1) or spark.range(3)
    for _ in range(2):
        assert Stages(spark, folder, {"cap": 3}).table("t", make).count() == 3
    assert made == [1]
    with pytest.raises(ValueError):
        Stages(spark, folder, {"cap": 4})
    (tmp_path / "other").mkdir()
    with pytest.raises(ValueError):
        Stages(spark, str(tmp_path / "other"), {})


def test_command_line():
    assert parser().parse_args(["split", "--data", "d", "--out", "o"]).command == "split"
    with pytest.raises(SystemExit):
        parser().parse_args(["nothing"])
