"""Command line: split, token-freq, train, predict, check."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from matchloom.operators import records, splits, stats
from matchloom.plans import learning, linkage
from matchloom.schema import entity_id
from matchloom.sources import tsv


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="matchloom", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    for name, extra in {"split": (), "token-freq": (), "train": ("--rounds",), "predict": ("--model", "--freq", "--threshold"), "check": ("--matches", "--candidates")}.items():
        p = sub.add_parser(name)
        p.add_argument("--data", required=True, help="folder of the tab-separated files")
        p.add_argument("--split", default="train")
        p.add_argument("--out", required=name != "check")
        for e in extra:
            p.add_argument(e)
    return top


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    data = tsv.read_split(spark, args.data, args.split, with_truth=args.command in ("split", "train"))
    targets = data["source2"].unionByName(data["source3"])
    if args.command == "check":
        ids = data["source1"].select(F.col("entity_id").alias("source1_entity_id"))
        m, c = tsv.read_id_lists(spark, args.matches, "matched_entity_ids"), tsv.read_id_lists(spark, args.candidates, "candidate_entity_ids")
        tsv.check_submission(ids, m, c, targets).show(truncate=False)
        return
    a, t = linkage.prepare(data["source1"]), linkage.prepare(targets)
    if args.command == "token-freq":
        stats.token_freq(a.unionByName(t)).write.parquet(args.out)
        return
    if args.command == "predict":
        freq = spark.read.parquet(args.freq)
        a, t = stats.in_rarity_order(a, freq), stats.in_rarity_order(t, freq)
        pairs = linkage.predict(learning.Matcher.load(spark, args.model), a, t, freq, float(args.threshold or 0.8))
        order = tsv.with_order(data["source1"].select(F.col("entity_id").alias("source1_entity_id")))
        named = pairs.select(entity_id(F.lit(1), F.col("anchor")).alias("source1_entity_id"), entity_id(F.col("source"), F.pmod("target", F.lit(2_000_000_000))).alias("target_entity_id"), "keep")
        tsv.write_id_lists(order, named.filter("keep"), "matched_entity_ids", f"{args.out}/matches")
        tsv.write_id_lists(order, named, "candidate_entity_ids", f"{args.out}/candidates")
        return
    code = records.with_codes(tsv.edges(data["truth"]).withColumnRenamed("target_entity_id", "entity_id")).select(F.substring("source1_entity_id", 4, 10).cast("bigint").alias("anchor"), "code")
    if args.command == "split":
        af, tf = splits.make_split(a.select(F.col("id").alias("anchor"), "country"), t.select("code", "source", "country"), code)
        af.write.parquet(f"{args.out}/anchors")
        tf.write.parquet(f"{args.out}/targets")
        return
    train, _ = linkage.training_table(a, t, code)
    learning.fit(train, linkage.features.FEATURES, rounds=int(args.rounds or 40), weight="weight").save(spark, args.out)


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    run(SparkSession.builder.appName("matchloom").getOrCreate(), args)


if __name__ == "__main__":
    main()
