"""Strict tab-separated files: record sources, truth lists, and id-list outputs."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom.operators.labels import require_empty, require_unique, truth_edges
from matchloom.schema import RECORDS, TRUTH


def read_tsv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All cells as text: no quoting, no inference, no NA words, empty cells as "".  Short or long rows and missing
    columns are errors; a byte order mark in the header is not."""
    header = spark.read.text(path).limit(1).collect()
    names = header[0][0].lstrip("﻿").rstrip("\r").split("\t") if header else []
    missing = [f.name for f in schema if f.name not in names]
    if missing:
        raise ValueError(f"{path}: missing columns {missing}")
    whole = T.StructType([T.StructField(n, T.StringType()) for n in names])
    rows = spark.read.schema(whole).options(sep="\t", header=True, quote="", escape="", mode="FAILFAST", enforceSchema=True).csv(path)
    return rows.select(*(F.coalesce(F.col(f.name), F.lit("")).alias(f.name) for f in schema))


def read_source(spark: SparkSession, path: str, prefix: str, columns: list[str] | None = None, check: bool = True) -> DataFrame:
    """One record source.  Only the id is trimmed; repeated ids and foreign prefixes are errors."""
    rows = read_tsv(spark, path, RECORDS).withColumn("entity_id", F.trim("entity_id"))
    if check:
        require_empty(rows.filter(~F.startswith("entity_id", F.lit(prefix))).select("entity_id"), f"{path}: ids without prefix {prefix}")
        require_unique(rows, ["entity_id"], f"{path}: repeated ids")
    return rows.select(columns) if columns else rows


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """The truth table; anchors with an empty list stay."""
    rows = read_tsv(spark, path, TRUTH).withColumn("source1_entity_id", F.trim("source1_entity_id"))
    require_unique(rows, ["source1_entity_id"], f"{path}: repeated anchors")
    return rows


def read_split(spark: SparkSession, folder: str, split: str, with_truth: bool = True) -> dict[str, DataFrame]:
    """The sources <split>_source1..3.tsv and, if wanted, <split>_ground_truth.tsv."""
    out = {f"source{i}": read_source(spark, f"{folder}/{split}_source{i}.tsv", f"S{i}-") for i in (1, 2, 3)}
    if with_truth:
        out["truth"] = read_truth(spark, f"{folder}/{split}_ground_truth.tsv")
    return out


def total_pairs(split: dict[str, DataFrame]) -> int:
    return split["source1"].count() * (split["source2"].count() + split["source3"].count())


def edges(truth: DataFrame) -> DataFrame:
    return truth_edges(truth).select("source1_entity_id", "target_entity_id").distinct()


def id_lists(anchors: DataFrame, pairs: DataFrame, name: str, repeated: str = "merge") -> DataFrame:
    """(source1_entity_id, <name>): distinct ids as sorted text, joined by commas; empty for anchors without any.

    Only ids of sources 2 and 3 without delimiters may occur, and no anchor may be unknown.  A repeated pair counts
    once, or is an error with ``repeated="refuse"``.
    """
    if repeated == "refuse":
        require_unique(pairs, ["source1_entity_id", "target_entity_id"], "repeated pairs")
    bad = pairs.filter(~F.col("target_entity_id").rlike(r"^S[23]-[0-9]+$")).select("target_entity_id")
    require_empty(bad, "ids that cannot be written")
    require_empty(pairs.join(anchors, "source1_entity_id", "left_anti"), "pairs of unknown anchors")
    lists = pairs.groupBy("source1_entity_id").agg(F.array_join(F.array_sort(F.collect_set("target_entity_id")), ",").alias(name))
    return anchors.join(lists, "source1_entity_id", "left").withColumn(name, F.coalesce(F.col(name), F.lit("")))


def write_id_lists(anchors: DataFrame, pairs: DataFrame, name: str, path: str, repeated: str = "merge") -> None:
    """One line for each anchor in input order (``row_ord``), a trailing tab for an empty list, under a header.

    Lines go to one sorted range of rows a file, so no task holds the whole output; file names keep the order.
    """
    rows = id_lists(anchors, pairs, name, repeated)
    lines = rows.select("row_ord", F.concat_ws("\t", "source1_entity_id", name).alias("value"))
    head = rows.sparkSession.createDataFrame([(-1, f"source1_entity_id\t{name}")], "row_ord bigint, value string")
    lines.unionByName(head).orderBy("row_ord").select("value").write.mode("errorifexists").text(path)


def write_id_lists_by_group(anchors: DataFrame, pairs: DataFrame, name: str, path: str) -> None:
    """As ``write_id_lists``, from pairs with a ``group`` (such as a country).  Repeated pairs are errors, and so is an
    anchor in two groups, whose list no group would hold whole."""
    spread = pairs.groupBy("source1_entity_id").agg(F.min("group").alias("first"), F.max("group").alias("last"), F.count("group").alias("n"), F.count("*").alias("all"))
    require_empty(spread.filter("first <> last or n < all"), "anchors in two groups or in none")
    write_id_lists(anchors, pairs, name, path, "refuse")


def read_id_lists(spark: SparkSession, path: str, name: str) -> DataFrame:
    """What ``write_id_lists`` wrote: exactly two fields a line, each anchor once."""
    rows = spark.read.text(path).select(F.split("value", "\t", -1).alias("f"))
    require_empty(rows.filter(F.size("f") != 2), f"{path}: lines without two fields")
    heads = [r[0] for r in rows.filter(F.col("f")[0] == "source1_entity_id").select(F.col("f")[1]).limit(3).collect()]
    if heads != [name]:
        raise ValueError(f"{path}: headers {heads}, not one of {name}")
    out = rows.select(F.col("f")[0].alias("source1_entity_id"), F.col("f")[1].alias(name)).filter(F.col("source1_entity_id") != "source1_entity_id")
    require_unique(out, ["source1_entity_id"], f"{path}: repeated anchors")
    return out


def with_order(rows: DataFrame) -> DataFrame:
    """Adds ``row_ord``, the order of lines in a file read from the front (partitions follow the file)."""
    return rows.withColumn("row_ord", F.monotonically_increasing_id())


def check_submission(anchors: DataFrame, matches: DataFrame, candidates: DataFrame, targets: DataFrame) -> DataFrame:
    """(problem, n) for a pair of id-list tables: coverage, existence, matches outside candidates."""
    ids = anchors.select("source1_entity_id")
    m = matches.select("source1_entity_id", F.explode(F.filter(F.split("matched_entity_ids", ","), lambda x: x != "")).alias("target"))
    c = candidates.select("source1_entity_id", F.explode(F.filter(F.split("candidate_entity_ids", ","), lambda x: x != "")).alias("target"))
    known = targets.select(F.col("entity_id").alias("target"))
    count = lambda frame, name: frame.agg(F.count("*").alias("n")).select(F.lit(name).alias("problem"), "n")
    parts = [
        count(ids.join(matches, "source1_entity_id", "left_anti"), "anchor_without_line"),
        count(matches.join(ids, "source1_entity_id", "left_anti"), "line_without_anchor"),
        count(m.join(known, "target", "left_anti"), "unknown_target"),
        count(m.join(c, ["source1_entity_id", "target"], "left_anti"), "match_outside_candidates"),
        count(m.groupBy("source1_entity_id", "target").count().filter("count > 1"), "repeated_in_list"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def checksum(spark: SparkSession, path: str) -> str:
    """SHA-256 of files in name order; each file is digested where it is read."""
    rows = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha"))
    return hashlib.sha256("".join(r["sha"] for r in rows.orderBy("path").collect()).encode()).hexdigest()


def write_pairs(pairs: DataFrame, path: str) -> None:
    """The pair table, partitioned for pruning by role and country; an existing table is an error."""
    pairs.write.mode("errorifexists").partitionBy("role", "country").parquet(path)


def read_pairs(spark: SparkSession, path: str, sort: bool = False) -> DataFrame:
    """The pair table, whose files must agree on having weights."""
    rows = spark.read.option("mergeSchema", True).parquet(path)
    if "weight" in rows.columns:
        require_empty(rows.filter("weight is null").select("anchor"), f"{path}: files without weights beside others")
    return rows.sortWithinPartitions("anchor") if sort else rows


def ordered_ids(pairs: DataFrame, rank: str = "ret_rank") -> DataFrame:
    """(anchor, ids): each anchor's ids in candidate order."""
    lists = F.array_sort(F.collect_list(F.struct("source", rank, "target_entity_id")))
    return pairs.groupBy("anchor").agg(F.transform(lists, lambda x: x["target_entity_id"]).alias("ids"))


