"""Blocking join: candidates share keys whose block is not too large, and score by how rare those keys are.

Block sizes come from one aggregation of the target keys, and oversized blocks go before any pair is made.  Pairs are
summed and ranked in cells (``search``), so only ids and keys are shuffled, no hits; texts join later.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.operators import search
from matchloom.operators.keys import channel_bit
from matchloom.operators.labels import require_empty
from matchloom.schema import IDF_REF

KEY = ["country", "channel", "key"]


def block_sizes(target_keys: DataFrame) -> DataFrame:
    return target_keys.groupBy(*KEY).agg(F.count("*").alias("size"))


def block_profile(target_keys: DataFrame) -> DataFrame:
    """(channel, keys, mean_size, p99_size, max_size) over the blocks of each channel; sizes are counted before the
    percentile, whose state is the number of distinct sizes."""
    spread = block_sizes(target_keys).groupBy("channel", "size").agg(F.count("*").alias("n"))
    mean = F.sum(F.col("size") * F.col("n")) / F.sum("n")
    return spread.groupBy("channel").agg(F.sum("n").alias("keys"), mean.alias("mean_size"), F.percentile("size", 0.99, F.col("n")).alias("p99_size"), F.max("size").alias("max_size"))


def store_postings(target_keys: DataFrame, name: str, buckets: int) -> DataFrame:
    """The posting table ``name``, written once in buckets of the join key and read back.

    Block sizes and searches against it shuffle only the anchors' keys.  One bucket should fit a task: take about a
    bucket for each 200 MB of postings.  An existing table is an error.
    """
    target_keys.select(*KEY, "code").write.bucketBy(buckets, *KEY).sortBy(*KEY).saveAsTable(name)
    return target_keys.sparkSession.table(name)


def weighed(blocks: DataFrame) -> DataFrame:
    """Blocks with the weight of their key, a float in a double, and the bit of their channel."""
    w = (F.log(F.lit(IDF_REF)) - F.log(F.col("size"))).cast("float").cast("double")
    return blocks.withColumn("w", w).withColumn("bit", channel_bit(F.col("channel")))


def candidates(anchor_keys: DataFrame, target_keys: DataFrame, cap: int = 3000, k: int = 25, channels: tuple[str, ...] | None = None, home: bool = False) -> DataFrame:
    """(anchor, code, source, score, channels, ret_rank[, home]) from (anchor | code, country, channel, key) rows.

    Weights are summed in double, keys with multiplicity, rounded to four places and to float once; the k best of each
    anchor and source have ``ret_rank`` from 0, and ties go to the smaller code.  ``home`` tells where the search found it.
    """
    if channels is not None:
        anchor_keys, target_keys = (x.filter(F.col("channel").isin(*channels)) for x in (anchor_keys, target_keys))
    found = search.best(anchor_keys, target_keys, KEY, cap, k, weighed, 4, single=True, bits=True)
    return found.select("anchor", "code", "source", "score", "channels", F.col("rank").alias("ret_rank"), *["home"] * home)


def pool_counts(pairs: DataFrame, anchor_keys: DataFrame, target_keys: DataFrame) -> DataFrame:
    """Adds t_name_cnt, t_addr_cnt, a_name_cnt, a_addr_cnt: target records that share the exact name or address of
    the candidate or of the anchor; 0 without such a key, never capped.

    The counts of both fields are put together a record, so pairs are joined twice.
    """
    out = pairs
    for rows, key, side in ((target_keys, "code", "t"), (anchor_keys, "anchor", "a")):
        out = counted(out, rows, target_keys, key, side)
    return out


EXACT = {"name": "name_exact", "addr": "addr_exact"}


def counted(frame: DataFrame, keys: DataFrame, target_keys: DataFrame, key: str, side: str) -> DataFrame:
    """Adds the two counts of ``pool_counts`` of one side to records (or pairs) with ``key``."""
    rows, own = (x.filter(F.col("channel").isin(*EXACT.values())) for x in (keys, target_keys))
    names = {f"{side}_{name}_cnt": channel for name, channel in EXACT.items()}
    counts = rows.join(block_sizes(own), KEY).groupBy(key).agg(*(F.max(F.when(F.col("channel") == c, F.col("size"))).alias(n) for n, c in names.items()))
    return frame.join(counts, key, "left").fillna(0, list(names))


def needed_records(records: DataFrame, pairs: DataFrame, check: bool = False) -> DataFrame:
    """The target records that occur in pairs, before any of their text is prepared; with ``check``, a pair whose
    target has no record is an error."""
    if check:
        require_empty(pairs.select("code").distinct().join(records, "code", "left_anti"), "pairs of unknown targets")
    return records.join(pairs.select("code").distinct(), "code", "left_semi")
