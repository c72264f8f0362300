"""Candidates by shared character grams, for names and addresses that share no whole word.

Grams are whole numbers from the moment they are cut: texts are read in Arrow batches, and a record's grams are one
sorted array.  Targets are counted first, task by task; what is too common is then never made a row of any record.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions.text import ADDRESS_WORDS, COUNTRY_WORDS
from matchloom.operators import search
from matchloom.operators.select import rank_distinct
from matchloom.schema import code_source
from matchloom.scratch import give_back, held

NAME, ADDRESS = 4, 5
#: Bits of a character in a gram, and the marks of names and of grams with a character beyond those bits.
BITS, OF_NAME, WIDE = 12, 1 << 60, 1 << 62
#: Common grams that go to every task, at most; grams counted before they are added up, and sums held by a task.  They
#: choose the way, not the result.
COMMON, COUNTED, SUMS = 1 << 20, 1 << 22, 1 << 20
#: As HITS of ``search``.
HITS = 1 << 26
TARGET, ANCHOR, NONE = 0, 1, -(1 << 63)


def grams(text: str, n: int, mark: int = 0) -> np.ndarray:
    """Distinct character runs of length n as sorted numbers; none for shorter texts.

    Characters below 4096 are packed as they are; a run with another one is a digest of 62 bits.
    """
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    m = len(c) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    g = c[:m].astype(np.int64)
    for j in range(1, n):
        g <<= BITS
        g |= c[j : m + j] & ((1 << BITS) - 1)
    g |= mark
    if c.max() >> BITS:
        beyond = np.concatenate([[0], np.cumsum(c >> BITS > 0)])
        wide = np.flatnonzero(beyond[n:] > beyond[:m])
        h = np.full(len(wide), mark + n, np.uint64)
        for j in range(n):
            h ^= c[wide + j]
            for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
            h ^= h >> np.uint64(31)
        g[wide] = (h >> np.uint64(2)).astype(np.int64) | WIDE
    g.sort()
    return g[np.concatenate([[True], g[1:] != g[:-1]])]


def gram_rows(records: DataFrame, key: str, fields: tuple[str, ...] = ("name", "address"), carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, carried columns, country, n, a) of prepared records: the name and the address that grams are cut from,
    the address still in words.  Records without a country are left out; they match nothing."""
    parts = {"name": F.when(F.col("glued") != "", F.col("glued")).otherwise(F.replace(F.col("nf"), F.lit(" "), F.lit(""))), "address": F.col("af")}
    n, a = (F.coalesce(parts[f], F.lit("")) if f in fields else F.lit("") for f in ("name", "address"))
    return records.filter("country is not null").select(key, *carry, "country", n.alias("n"), a.alias("a"))


def _cut(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
    """(country, distinct grams) of each record."""
    words: dict[str, Callable] = {}
    for country, name, address in zip(*(batch[c] for c in ("country", "n", "a")), strict=True):
        country = country.as_py()
        if country not in words:
            words[country] = (ADDRESS_WORDS | COUNTRY_WORDS.get(country, {})).get
        whole, short = words[country], address.as_py().split(" ")
        yield country, np.concatenate([grams("".join(map(whole, short, short)), ADDRESS), grams(name.as_py(), NAME, OF_NAME)])


def _summed(values: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    value, count = np.concatenate(values), np.concatenate(counts)
    order = np.argsort(value, kind="stable")
    value = value[order]
    first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
    return value[first], np.add.reduceat(count[order], first)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(country, gram, size), summed within the task as far as memory goes."""
    new: dict[str, list[np.ndarray]] = {}
    sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    n = 0

    def add() -> None:
        for country, found in new.items():
            value, count = np.unique(np.concatenate(found), return_counts=True)
            old = sums.get(country)
            sums[country] = _summed([old[0], value], [old[1], count]) if old else (value, count)
        new.clear()

    def out() -> Iterator[pa.RecordBatch]:
        for country, (value, count) in sums.items():
            if len(value):
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(country, pa.string()), len(value)), pa.array(value), pa.array(count.astype(np.int64))], ["country", "gram", "size"])
        sums.clear()

    for batch in batches:
        for country, found in _cut(batch):
            new.setdefault(country, []).append(found)
            n += len(found)
            if n >= COUNTED:
                add()
                n = 0
                if sum(len(v) for v, _ in sums.values()) > SUMS:
                    yield from out()
    add()
    yield from out()
    give_back()


def _rare(common: dict[str, np.ndarray], buckets: int) -> Callable:
    """(country, bucket, side, grams, ids, seeds): a row for many records, their grams without the common ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], list] = {}
        n = 0

        def out() -> Iterator[pa.RecordBatch]:
            for (country, side), rows in found.items():
                sizes = [len(x[0]) for x in rows]
                g = np.concatenate([x[0] for x in rows])
                columns = [g, *(np.repeat(np.array([x[c] for x in rows], np.int64), sizes) for c in (1, 2))]
                bucket = ((g.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(buckets)
                order = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
                full = np.flatnonzero(np.diff(cuts))
                packed = [[x[order[cuts[b] : cuts[b + 1]]].tobytes() for b in full] for x in columns]
                yield pa.RecordBatch.from_arrays([pa.array([country] * len(full), pa.string()), pa.array(full, pa.int32()), pa.array([side] * len(full), pa.int32()), *(pa.array(x, pa.binary()) for x in packed)], ["country", "bucket", "side", "grams", "ids", "seeds"])
            found.clear()

        for batch in batches:
            sides, ids, seeds = batch["side"].to_pylist(), batch["id"].to_pylist(), batch["seed"].fill_null(NONE).to_pylist()
            for r, (country, g) in enumerate(_cut(batch)):
                known = common.get(country)
                if known is not None and len(g):
                    g = g[known[np.minimum(np.searchsorted(known, g), len(known) - 1)] != g]
                if len(g):
                    found.setdefault((country, sides[r]), []).append((g, ids[r], seeds[r]))
                    n += len(g)
                if n >= COUNTED:
                    yield from out()
                    n = 0
        yield from out()
        found = {}
        give_back()

    return run


BLOCKS = "country string, sizes binary, counts binary, codes binary, anchors binary, seeds binary, hits bigint, postings bigint"


def _blocked(cap: int) -> Callable:
    """A row for each country and bucket: targets and anchors of the grams in at most ``cap`` targets, gram by gram."""

    def blocks(given: dict[int, list]) -> list[np.ndarray] | None:
        if len(given) < 2:
            return None
        (tg, codes, _), (ag, anchors, seeds) = ([np.concatenate(c) for c in zip(*given[side], strict=True)] for side in (TARGET, ANCHOR))
        order = np.argsort(tg, kind="stable")
        tg, codes = tg[order], codes[order]
        starts = np.flatnonzero(np.concatenate([[True], tg[1:] != tg[:-1]]))
        values, sizes = tg[starts], np.diff([*starts, len(tg)])
        at = np.minimum(np.searchsorted(values, ag), len(values) - 1)
        good = np.flatnonzero((values[at] == ag) & (sizes[at] <= cap))
        good = good[np.argsort(at[good], kind="stable")]
        counts = np.bincount(at[good], minlength=len(values))
        codes = codes[np.repeat(counts > 0, sizes)]
        sizes, counts = sizes[counts > 0], counts[counts > 0]
        return [sizes, counts, codes, anchors[good], seeds[good]] if len(sizes) else None

    def out(country: str, given: dict[int, list]) -> Iterator[pa.RecordBatch]:
        if found := blocks(given):
            names = [x.split()[0] for x in BLOCKS.split(", ")]
            sums = [pa.array([int(x.sum())], pa.int64()) for x in (found[0] * found[1], found[0])]
            yield pa.RecordBatch.from_arrays([pa.array([country], pa.string()), *(pa.array([x.tobytes()], pa.binary()) for x in found), *sums], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, given = None, {}
        for batch in batches:
            for row in batch.to_pylist():
                if (row["country"], row["bucket"]) != now:
                    if now:
                        yield from out(now[0], given)
                    now, given = (row["country"], row["bucket"]), {}
                given.setdefault(row["side"], []).append([np.frombuffer(row[c], np.int64) for c in ("grams", "ids", "seeds")])
        if now:
            yield from out(now[0], given)
        given = {}
        give_back()

    return run


CELLS = "cell int, tag int, row bigint, blocks binary, w binary, items binary, seeds binary"


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The targets of each part of the targets, to all parts of the anchors, and the other way round."""
    part = lambda x, n: ((x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(n)
    kinds = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 4]
    names = [x.split()[0] for x in CELLS.split(", ")]
    for batch in batches:
        for row in batch.to_pylist():
            sizes, counts, codes, anchors, seeds = (np.frombuffer(row[c], np.int64) for c in ("sizes", "counts", "codes", "anchors", "seeds"))
            w = np.log1p(row["n_country"] / sizes)
            ap, tp = row["ap"], row["tp"]
            for tag, ids, runs, parts in ((TARGET, codes, sizes, tp), (ANCHOR, anchors, counts, ap)):
                block, of = np.repeat(np.arange(len(runs)), runs), part(ids, parts)
                for p in range(parts):
                    mine = np.flatnonzero(of == p)
                    if tag == TARGET:
                        blocks, held_by = np.unique(block[mine], return_counts=True)
                        data = (np.stack([blocks, held_by]).tobytes(), w[blocks].tobytes(), ids[mine].tobytes(), b"")
                        to = [row["first"] + a * tp + p for a in range(ap)]
                    else:
                        data = (block[mine].tobytes(), b"", ids[mine].tobytes(), seeds[mine].tobytes())
                        to = [row["first"] + p * tp + t for t in range(tp)]
                    if len(mine):
                        for cell in to:  # a batch a copy: batches stay small
                            yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip((cell, tag, row["row"], *data), kinds, strict=True)], names)
    give_back()


def _found(how: dict) -> Callable:
    """The search of each cell; anchors come after the targets."""

    def answers(cell: search.Cell, asked: list) -> Iterator[pa.RecordBatch]:
        if not (cell.given and asked):
            return
        cell.index()
        ids, seeds, blocks = (np.concatenate(x) for x in zip(*asked, strict=True))
        asked.clear()
        order = np.lexsort((blocks, seeds, ids))
        ids, seeds, blocks = ids[order], seeds[order], blocks[order]
        cuts = [0, *(np.flatnonzero((np.diff(ids) != 0) | (np.diff(seeds) != 0)) + 1), len(ids)]
        out, whose, n = [], [], 0
        for s, e in zip(cuts, cuts[1:], strict=False):
            places, *rest = cell.search(blocks[s:e])
            if len(places):
                out.append((cell.codes[places], *rest, np.zeros(len(places))))
                whose.append((int(ids[s]), int(seeds[s]) if seeds[s] != NONE else None, 0))
                n += len(places)
            if n >= search.ROWS:
                yield search.batch(out, whose)
                out, whose, n = [], [], 0
        if out:
            yield search.batch(out, whose)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, cell, asked, numbers = None, None, [], {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["cell"] != at:
                    if cell:
                        yield from answers(cell, asked)
                    at, cell, asked, numbers = row["cell"], search.Cell(how), [], {}
                blocks, items = np.frombuffer(row["blocks"], np.int64), np.frombuffer(row["items"], np.int64)
                base = numbers.setdefault(row["row"], len(numbers)) << 32
                if row["tag"] == TARGET:
                    blocks, sizes = blocks.reshape(2, -1)
                    cell.given.append((base + blocks, np.frombuffer(row["w"]), np.zeros(len(blocks), np.int32), items, np.concatenate([[0], np.cumsum(sizes)])))
                else:
                    asked.append((items, np.frombuffer(row["seeds"], np.int64), base + blocks))
        if cell:
            yield from answers(cell, asked)
        cell = asked = None
        give_back()

    return run


def common_grams(target_grams: DataFrame, cap: int) -> dict[str, np.ndarray]:
    """Grams in more than ``cap`` targets by country, sorted; if they are more than COMMON, the most common ones."""
    sizes = target_grams.select("country", "n", "a").mapInArrow(_counted, "country string, gram bigint, size bigint")
    sizes = held(sizes.groupBy("country", "gram").agg(F.sum("size").alias("size")).filter(F.col("size") > cap))
    step = F.floor(F.log2("size") * 16)
    most, n = None, 0
    for row in sorted(sizes.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect(), reverse=True):
        n += row["n"]
        if n > COMMON:
            break
        most = row["step"]
    if most is None:
        return {}
    found = sizes.filter(step >= most).select("country", "gram").toArrow()
    country, gram = found["country"].combine_chunks().dictionary_encode(), found["gram"].to_numpy()
    which = country.indices.to_numpy()
    return {c: np.sort(gram[which == i]) for i, c in enumerate(country.dictionary.to_pylist())}


def gram_candidates(anchor_grams: DataFrame, target_grams: DataFrame, targets: DataFrame, cap: int = 256, k: int = 30, min_shared: int = 2) -> DataFrame:
    """(anchor, code, source, score, shared, rank): grams in more than ``cap`` targets are left out whole.

    A gram weighs ln(1 + targets of the country / targets with the gram).  Common grams are left out while texts are
    cut, as far as COMMON goes, the rest of them by their sizes in buckets of grams.  Pairs are summed and ranked in
    cells (``search``).  What is shuffled are packed rows of many grams, never a row a gram or hit.  Anchors with a
    column ``seed`` are searched by (anchor, seed).
    """
    spark = anchor_grams.sparkSession
    seeded = "seed" in anchor_grams.columns
    seed = (F.col("seed") if seeded else F.lit(None)).cast("bigint").alias("seed")
    asked = anchor_grams.select(F.lit(ANCHOR).alias("side"), F.col("anchor").cast("bigint").alias("id"), seed, "country", "n", "a")
    given = target_grams.select(F.lit(TARGET).alias("side"), F.col("code").cast("bigint").alias("id"), F.lit(None).cast("bigint").alias("seed"), "country", "n", "a")
    rows = given.unionByName(asked).mapInArrow(_rare(common_grams(target_grams, cap), max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))), "country string, bucket int, side int, grams binary, ids binary, seeds binary")
    blocks = rows.repartition("country", "bucket").sortWithinPartitions("country", "bucket", "side").mapInArrow(_blocked(cap), BLOCKS)
    blocks = held(blocks.withColumn("row", F.monotonically_increasing_id()))
    # A record has one country; ids that come with several are summed over them, all countries then being one scope.
    one = asked.groupBy("id", "seed").agg((F.min("country") < F.max("country")).alias("several")).filter("several").isEmpty()
    scope = (F.col("country") if one else F.lit("")).alias("scope")
    hits, postings = F.sum("hits"), F.sum("postings")
    parts = blocks.groupBy(scope).agg(F.least(F.ceil(hits / HITS), F.greatest(F.lit(search.PARTS), F.ceil(hits / search.MOST_HITS))).cast("int").alias("ap"), F.ceil(postings / search.POSTINGS).cast("int").alias("tp"))
    parts = held(parts.withColumn("first", F.sum(F.col("ap") * F.col("tp")).over(Window.orderBy("scope")) - F.col("ap") * F.col("tp")))
    cells, most = parts.agg(F.max(F.col("first") + F.col("ap") * F.col("tp")), F.max("tp")).first()
    total = targets.groupBy("country").agg(F.count("*").alias("n_country"))
    dealt = blocks.withColumn("scope", scope).join(F.broadcast(total), "country").join(F.broadcast(parts), "scope").mapInArrow(_dealt, CELLS)
    how = {"k": k, "digits": 6, "single": False, "bits": False, "counts": True, "min_shared": min_shared}
    found = dealt.repartitionById(int(cells or 1), F.col("cell")).sortWithinPartitions("cell", "tag", "row").mapInArrow(_found(how), search.OUT)
    found = found.withColumn("source", code_source(F.col("code")))
    if (most or 1) > 1:  # the best of the parts of the targets
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy("anchor", "seed", "source").orderBy(F.desc("score"), "code")) - 1).filter(F.col("rank") < k)
    anchor, code = (F.col(c).cast(x.schema[c].dataType).alias(c) for c, x in (("anchor", anchor_grams), ("code", target_grams)))
    return found.select(anchor, *["seed"] * seeded, code, "source", "score", "shared", F.col("rank").cast("int").alias("rank"))


def seed_views(anchors: DataFrame, targets: DataFrame, matches: DataFrame, threshold: float) -> DataFrame:
    """The prepared anchors, and for each kept match (anchor, code, p, keep) of at least ``threshold`` its target's
    record as one more view of the anchor, marked by ``seed``, which is NULL for the own record."""
    fields = ["country", "glued", "nf", "af"]
    sure = matches.filter(F.col("keep") & (F.col("p") >= threshold)).select("anchor", "code").distinct()
    sure = sure.join(anchors.select("anchor"), "anchor", "left_semi")
    more = sure.join(targets.select("code", *fields), "code").select("anchor", F.col("code").alias("seed"), *fields)
    own = anchors.select("anchor", F.lit(None).cast("bigint").alias("seed"), *fields)
    return own.unionByName(more)


def seeded_candidates(anchors: DataFrame, targets: DataFrame, matches: DataFrame, threshold: float = 0.95, cap: int = 256, k: int = 30) -> DataFrame:
    """(anchor, code, source, score, shared, rank) of the character-gram search with confident matches as further
    views: each view finds its own k best, and a pair found by several keeps its best score.

    matches must not have been decided with the labels under test.
    """
    views = seed_views(anchors, targets, matches, threshold)
    found = gram_candidates(gram_rows(views, "anchor", carry=("seed",)), gram_rows(targets, "code"), targets, cap, k)
    return rank_distinct(found)
