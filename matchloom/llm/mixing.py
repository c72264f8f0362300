"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks; DataFrame functions only.

Sources take the weights 5, 2, 1, 5, 2, 1, ... in code point order, NULL last, and share ``share`` times the words
of the table; a source's target stops at ``most`` times its own words and the excess is shared anew by weight
(water filling in closed form).  Slot ``i`` of the schedule is the golden-ratio point ``frac(i * phi)`` in 32-bit
integers, mapped through the cumulative targets to a source; slots are ranked per source.  Each source's documents
are shuffled by a digest of their id and laid end to end, again for a second pass; the stretch of that stream that
the target asks for is cut into as many equal blocks as the source has slots, and the r-th slot takes the r-th
block.  So the sources' blocks have nearly one length, every front of the schedule holds the sources near their
shares, and what is taken of a source is its target rounded down.  A source too small to be hit by a point gets one
slot of its own, at the place of its share.

There is a slot for every ``BLOCK`` words of the mix (``SLOTS`` at most), so the schedule grows with the table.
Ranks and positions come from counts per bucket and running sums inside a bucket, so no source, however large, is
ordered in one task.

Defined results: NULL, empty and blank texts have size 0 and take nothing; a source without words has target 0;
an empty table gives an empty result; rows of one doc_id keep one row each and are mixed by themselves, ordered
by a digest of their text (identical rows in any order); other columns of the input may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.llm.common import materialise, scratch_dir

#: SHARE is in halves: 3 is 150 %.  A broadcast holds one row a source, BROADCAST_SOURCES at most.  BLOCK: words of
#: a slot; beyond SLOTS of them (some 60 TB of text) blocks grow.
WEIGHTS, SHARE, MOST, BLOCK, SLOTS, SEED, BROADCAST_SOURCES = (5, 2, 1), 3, 2, 4096, 1 << 31, "mix-1", 100_000
GOLDEN, RANGE, CELLS, BUCKET = 2654435769, 1 << 32, 1 << 12, 4096  # 2^32 divided by the golden ratio, odd


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """Never NULL; its order is the code point order of the sources, NULL last."""
    return F.when(source.isNull(), F.lit("b")).otherwise(F.concat(F.lit("a"), source))


def _before(*by: str):
    return Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)


def _sum_before(column: str, *by: str) -> Column:
    return F.coalesce(F.sum(column).over(_before(*by)), F.lit(0))


def targets(sizes: DataFrame, block: int = BLOCK) -> DataFrame:
    """(key, source_size, weight, target, words, ahead, total, slots) of each source, from (key, size) rows.

    ``words`` is the target rounded down, ``ahead`` the words of the sources before, ``total`` of all, and ``slots``
    the points of the schedule.
    """
    order, whole = Window.orderBy("key"), Window.partitionBy()
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int")).cast("long")
    # One row a source from here on.  Sources reach their limit in the order of size / weight.
    per = sizes.groupBy("key").agg(F.sum("size").alias("source_size")).withColumn("weight", weight).withColumn("ratio", F.col("source_size") / F.col("weight"))
    full = Window.orderBy("ratio", "key")
    limit = F.col("source_size") * MOST
    return (
        per.withColumn("left2", SHARE * F.sum("source_size").over(whole) - 2 * MOST * F.coalesce(F.sum("source_size").over(full.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("level", F.col("left2") / (2 * F.sum("weight").over(full.rowsBetween(0, Window.unboundedFollowing))))
        # The level of the first source that stays below its limit holds for it and all that follow.
        .withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= limit, F.struct("ratio", "key", "level"))).over(whole)["level"])
        .withColumn("target", F.least(limit.cast("double"), F.coalesce(F.col("level") * F.col("weight"), limit.cast("double"))))
        .withColumn("words", F.floor("target").cast("long"))
        .withColumn("ahead", F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))
        .withColumn("total", F.sum("words").over(whole))
        .withColumn("slots", F.least(F.lit(SLOTS), F.ceil(F.col("total") / block)).cast("long"))
        .select("key", "source_size", "weight", "target", "words", "ahead", "total", "slots")
    )


def schedule(target: DataFrame) -> DataFrame:
    """(slot, key, rank, begin, end): each slot takes the words [begin, end) of its source's repeated stream."""
    spark = target.sparkSession
    bound = lambda cum: F.floor(cum.cast("decimal(20,0)") * F.lit(RANGE).cast("decimal(11,0)") / F.col("total").cast("decimal(20,0)")).cast("long")
    share = target.filter("words > 0").select("key", "words", "slots", bound(F.col("ahead")).alias("lo"), bound(F.col("ahead") + F.col("words")).alias("hi"))
    # Points meet the source whose share [lo, hi) holds them by an equi-join on cells: one row a cell and a source more.
    cell_of = lambda x: F.floor(x / (RANGE // CELLS)).cast("long")
    cells = share.filter("hi > lo").withColumn("cell", F.explode(F.sequence(cell_of(F.col("lo")), cell_of(F.col("hi") - 1)))).select("key", "lo", "hi", "cell")
    n = (target.agg(F.max("slots").alias("n")).first() or [0])[0] or 0
    points = spark.range(n).select(F.col("id").alias("slot"), F.pmod(F.col("id") * GOLDEN, F.lit(RANGE)).alias("point"))
    hits = points.withColumn("cell", cell_of(F.col("point"))).join(cells, "cell").filter("point >= lo and point < hi").select("slot", "key")
    hits = hits.withColumn("bucket", F.floor(F.col("slot") / BUCKET).cast("long"))
    # Rank of a slot among its source's: slots of earlier buckets, then those of its own bucket.
    counts = hits.groupBy("key", "bucket").agg(F.count("*").alias("n"))
    base = counts.select("key", "bucket", _sum_before("n", "key", "bucket").alias("base"))
    ranked = (
        hits.withColumn("inside", F.row_number().over(Window.partitionBy("key", "bucket").orderBy("slot")) - 1)
        .join(base, ["key", "bucket"])
        .select("key", "slot", (F.col("base") + F.col("inside")).cast("long").alias("rank"))
    )
    got = share.join(counts.groupBy("key").agg(F.sum("n").alias("got")), "key", "left")
    own = got.filter("got is null").select("key", F.floor(F.col("lo") * F.col("slots") / RANGE).cast("long").alias("slot"), F.lit(0).cast("long").alias("rank"))
    # Equal blocks: the r-th of n ends at floor(words * (r + 1) / n).
    edge = lambda r: F.floor(F.col("words").cast("decimal(20,0)") * r.cast("decimal(11,0)") / F.col("got").cast("decimal(11,0)")).cast("long")
    return (
        ranked.unionByName(own)
        .join(got.select("key", "words", F.coalesce("got", F.lit(1)).cast("long").alias("got")), "key")
        .select("slot", "key", "rank", edge(F.col("rank")).alias("begin"), edge(F.col("rank") + 1).alias("end"))
        .filter("end > begin")
    )


def streams(sizes: DataFrame) -> DataFrame:
    """Adds ``start``: the words of the source's stream before each row, in shuffled order.

    The stream is ordered by a digest of the id, whose first hex digits are the bucket; sums over buckets are
    made in two steps, so no task orders a whole source.
    """
    placed = sizes.withColumn("order", F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(SEED)).cast("binary"))).withColumn("bucket", F.substring("order", 1, 3))
    sums = placed.groupBy("key", "bucket").agg(F.sum("size").alias("n")).withColumn("group", F.substring("bucket", 1, 1))
    first = sums.groupBy("key", "group").agg(F.sum("n").alias("n")).select("key", "group", _sum_before("n", "key", "group").alias("ahead"))
    base = sums.withColumn("near", _sum_before("n", "key", "group", "bucket")).join(first, ["key", "group"]).select("key", "bucket", (F.col("ahead") + F.col("near")).alias("base"))
    own = Window.partitionBy("key", "bucket").orderBy("order", "doc_id", "size", "digest", "row").rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.withColumn("inside", F.coalesce(F.sum("size").over(own), F.lit(0)))
        .join(base, ["key", "bucket"])
        .withColumn("start", (F.col("base") + F.col("inside")).cast("long"))
        .drop("order", "bucket", "inside", "base")
    )


def text_digest(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _mix(docs: DataFrame, block: int) -> DataFrame:
    """``mix`` with the key of the source and the digest of the text."""
    path = scratch_dir(docs.sparkSession)
    # The texts are read once; what follows works on ids and sizes.
    sizes = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", source_key(F.col("source")).alias("key"), n_words(F.col("text")).alias("size"), text_digest(F.col("text")).alias("digest"))
    sizes = materialise(sizes, f"{path}/sizes")
    target = materialise(targets(sizes, block), f"{path}/targets")
    small = F.broadcast if target.count() <= BROADCAST_SOURCES else lambda x: x
    placed = materialise(streams(sizes), f"{path}/placed")
    plan = materialise(schedule(target), f"{path}/schedule")
    placed = placed.join(small(target.select("key", "source_size", "target")), "key")
    # Rows and slots meet in stretches of BLOCK words of the repeated stream: an equi-join.  A stretch holds few slots.
    stretch = lambda x: F.floor(x / block).cast("long")
    passes = placed.filter("size > 0").withColumn("epoch", F.explode(F.array(*map(F.lit, range(MOST)))))
    passes = passes.withColumn("first", F.col("start") + F.col("epoch") * F.col("source_size")).filter("first < target").select("key", "row", "size", "epoch", "first")
    spread = passes.withColumn("stretch", F.explode(F.sequence(stretch(F.col("first")), stretch(F.col("first") + F.col("size") - 1))))
    cut = plan.select("key", "slot", "begin", "end", F.explode(F.sequence(stretch(F.col("begin")), stretch(F.col("end") - 1))).alias("stretch"))
    low = F.greatest(F.col("first"), F.col("begin"), F.col("stretch") * block)
    high = F.least(F.col("first") + F.col("size"), F.col("end"), (F.col("stretch") + 1) * block)
    taken = (
        spread.join(cut, ["key", "stretch"])
        .withColumn("words", high - low)
        .filter("words > 0")
        .groupBy("row")
        .agg(
            F.sum("words").cast("long").alias("taken"),
            F.min("slot").alias("first_slot"),
            F.max("slot").alias("last_slot"),
            *(F.sum(F.when(F.col("epoch") == e, F.col("words"))).cast("long").alias(f"words{e}") for e in range(MOST)),
            *(F.min(F.when(F.col("epoch") == e, F.col("slot"))).alias(f"slot{e}") for e in range(MOST)),
        )
    )
    return (
        placed.join(taken, "row", "left")
        .withColumn("taken", F.coalesce(F.col("taken"), F.lit(0)).cast("long"))
        .withColumn("passes", F.filter(F.array(*(F.struct(F.col(f"slot{e}").alias("slot"), F.col(f"words{e}").alias("words")) for e in range(MOST))), lambda x: x["slot"].isNotNull()))
        .select("key", "digest", "doc_id", "source", "size", "source_size", "target", "taken", "first_slot", "last_slot", "start", "passes")
    )


def mix(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, first_slot, last_slot, start, passes): one row for each document.

    ``passes`` holds, for each pass that takes words of the document, the first slot that does and the words.
    """
    return _mix(docs, block).drop("key", "digest")


def mixed(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mix itself, with the columns of ``docs``, its rows in the order of their slots over partitions.

    A document is a row for each pass over it, at the first slot that takes words of it, whole or cut to the words
    taken (their white space becomes single spaces); one document a source is cut at most.
    """
    name = lambda x: F.coalesce(F.concat(F.lit("i"), x.cast("string")), F.lit("n"))
    found = _mix(docs, block).filter("taken > 0").groupBy(name(F.col("doc_id")).alias("id"), "key", "digest")
    found = found.agg(F.array_sort(F.collect_list(F.struct("start", "size", "passes"))).alias("same"))  # identical rows
    rows = docs.select(F.struct("*").alias("doc"), name(F.col("doc_id")).alias("id"), source_key(F.col("source")).alias("key"), text_digest(F.col("text")).alias("digest"))
    # One shuffle of the texts serves the join and the numbering of identical rows, which take turns.
    rows = rows.join(found, ["id", "key", "digest"]).withColumn("nth", F.row_number().over(Window.partitionBy("id", "key", "digest").orderBy("digest")))
    rows = rows.filter(F.col("nth") <= F.size("same")).withColumn("own", F.element_at("same", F.col("nth")))
    rows = rows.select("doc", F.col("own.size").alias("size"), F.col("own.start").alias("start"), F.explode("own.passes").alias("pass"))
    words = F.regexp_extract_all(F.col("doc.text"), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    text = F.when(F.col("pass.words") == F.col("size"), F.col("doc.text")).otherwise(F.array_join(F.slice(words, F.lit(1), F.col("pass.words").cast("int")), " "))
    placed = rows.select("doc", text.alias("cut"), F.col("pass.slot").alias("slot"), "start")
    placed = placed.repartitionByRange("slot").sortWithinPartitions("slot", "start")
    new = {"text": F.col("cut"), "n_chars": F.length("cut").cast("bigint")}
    return placed.select(*(new.get(f.name, F.col("doc").getField(f.name)).cast(f.dataType).alias(f.name) for f in docs.schema))


ORACLE = """
WITH sizes AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || 'mix-1') AS ord
  FROM documents),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS BIGINT) AS weight
  FROM sizes GROUP BY source),
levels AS (
  SELECT *, CAST(3 * sum(source_size) OVER () - 4 * coalesce(sum(source_size) OVER (
              ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
            / CAST(2 * sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST
              ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM per),
chosen AS (SELECT arg_min(level, source_size / weight) AS level FROM levels WHERE level * weight <= 2 * source_size),
target AS (
  SELECT source, source_size, least(CAST(2 * source_size AS DOUBLE), coalesce(chosen.level * weight, CAST(2 * source_size AS DOUBLE))) AS target
  FROM levels, chosen),
shares AS (
  SELECT source, source_size, target, CAST(floor(target) AS HUGEINT) AS words,
         CAST(coalesce(sum(CAST(floor(target) AS HUGEINT)) OVER (ORDER BY source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS HUGEINT) AS ahead,
         CAST(sum(CAST(floor(target) AS HUGEINT)) OVER () AS HUGEINT) AS total
  FROM target),
points AS (SELECT i AS slot, CAST(i AS HUGEINT) * 2654435769 % 4294967296 AS point
  FROM range((SELECT CAST(coalesce(max((total + 4095) // 4096), 0) AS BIGINT) FROM shares)) r(i)),
bounds AS (SELECT *, ahead * 4294967296 // total AS lo, (ahead + words) * 4294967296 // total AS hi FROM shares WHERE words > 0),
hits AS (
  SELECT b.source, p.slot, row_number() OVER (PARTITION BY b.source ORDER BY p.slot) - 1 AS rank, count(*) OVER (PARTITION BY b.source) AS n
  FROM bounds b JOIN points p ON p.point >= b.lo AND p.point < b.hi),
slots AS (
  SELECT source, slot, rank, n FROM hits
  UNION ALL
  SELECT source, CAST(lo * ((total + 4095) // 4096) // 4294967296 AS BIGINT), 0, 1 FROM bounds b
  WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.source IS NOT DISTINCT FROM b.source)),
blocks AS (
  SELECT s.source, s.slot, CAST(b.words * s.rank // s.n AS BIGINT) AS lo, CAST(b.words * (s.rank + 1) // s.n AS BIGINT) AS hi
  FROM slots s JOIN bounds b ON s.source IS NOT DISTINCT FROM b.source),
placed AS (
  SELECT s.doc_id, s.size, s.source, t.source_size, t.target,
         CAST(coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.ord, s.doc_id, s.size
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM sizes s JOIN target t ON s.source IS NOT DISTINCT FROM t.source),
passes AS (SELECT *, start + e * source_size AS first FROM placed, range(2) r(e) WHERE size > 0),
taken AS (
  SELECT p.doc_id, sum(least(p.first + p.size, b.hi) - greatest(p.first, b.lo)) AS taken, min(b.slot) AS first_slot, max(b.slot) AS last_slot
  FROM passes p JOIN blocks b ON p.source IS NOT DISTINCT FROM b.source AND b.lo < p.first + p.size AND p.first < b.hi
  GROUP BY p.doc_id)
SELECT p.doc_id, p.size, p.source_size, p.target, CAST(coalesce(t.taken, 0) AS BIGINT) AS taken, t.first_slot, t.last_slot
FROM placed p LEFT JOIN taken t ON p.doc_id = t.doc_id
"""
