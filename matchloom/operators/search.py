"""The best targets of each anchor by weighted shared keys, without a row for each hit.

Targets become posting lists of their keys, anchors lists of those blocks.  Both go to cells (country, part of the
anchors, part of the targets); a cell sums the weights of a pair over all its keys, since both records are whole in
it, and passes on the k best of each anchor and source.  What is shuffled are keys, posting lists (one copy for each
part of the anchors) and results, never the hits.

Keys are compared as they are; ids and codes are whole numbers.  Equal posting lists of a cell are read once an
anchor, and neighbouring anchors with equal blocks share their result.  A NULL country or key matches nothing.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.schema import SOURCE_BASE, code_source
from matchloom.scratch import give_back, held

#: A country's anchors are cut into a part for each HITS hits, up to PARTS parts, and beyond that for each MOST_HITS;
#: its targets into a part for each POSTINGS postings.  They choose the way, not the result.
HITS, PARTS, MOST_HITS, POSTINGS = 1 << 24, 8, 1 << 27, 1 << 22
#: Result rows of a batch.
ROWS = 1 << 16

POSTING, TOKENS, ANCHOR = 0, 1, 2
OUT = "anchor bigint, seed bigint, home int, code bigint, score double, channels int, shared bigint, rank int, formula double"


def half_up(x: np.ndarray, digits: int) -> np.ndarray:
    return np.floor(x * 10.0**digits + 0.5) / 10.0**digits


def _list(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column without NULLs."""
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)])


def _gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all items of some runs, one after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


class Cell:
    """Postings and targets of one cell, and the search of its anchors."""

    def __init__(self, how: dict):
        self.how, self.given, self.tokens = how, [], []
        self.last, self.found = None, None

    def index(self) -> None:
        given, self.given = self.given, []
        blocks = np.concatenate([x[0] for x in given])
        self.w, self.bit = (np.concatenate([x[n] for x in given]) for n in (1, 2))
        sizes = np.concatenate([np.diff(x[4]) for x in given])
        self.codes, self.at = np.unique(np.concatenate([x[3] for x in given]), return_inverse=True)
        self.at = self.at.astype(np.int32)
        ends = np.cumsum(sizes)
        starts, classes, known = ends - sizes, np.empty(len(sizes), np.int64), {}
        raw, of = self.at.tobytes(), known.setdefault
        for r, (s, e) in enumerate(zip((4 * starts).tolist(), (4 * ends).tolist(), strict=True)):
            classes[r] = of(raw[s:e], r)  # the first row with this list
        self.starts, self.sizes, self.classes = starts, sizes, classes
        self.order = np.argsort(blocks)
        self.blocks = blocks[self.order]
        self.signed = not len(self.w) or self.w.min() <= 0
        self.ends = np.flatnonzero(np.diff(self.codes // SOURCE_BASE)) + 1  # where the next source begins
        if self.tokens:
            ids = np.concatenate([x[0] for x in self.tokens])
            values, sizes = np.concatenate([x[1] for x in self.tokens]), np.concatenate([np.diff(x[2]) for x in self.tokens])
            starts = np.cumsum(sizes) - sizes
            order = np.argsort(ids)
            where = order[np.searchsorted(ids[order], self.codes)]  # every posted target has its row
            self.words, self.word_at = np.unique(values, return_inverse=True)
            self.word_at, self.marked = self.word_at.astype(np.int32), np.zeros(len(self.words), bool)
            self.t_starts, self.t_sizes, self.tokens = starts[where], sizes[where], []

    def search(self, blocks: np.ndarray) -> tuple[np.ndarray, ...]:
        """(places of targets, score, channels, shared, rank) of the k best of each source."""
        how = self.how
        found = np.searchsorted(self.blocks, blocks)
        found[found == len(self.blocks)] = 0
        rows = self.order[found[self.blocks[found] == blocks]] if len(self.blocks) else found[:0]
        if not len(rows):
            return (np.zeros(0, np.int64),) * 5
        lists, which = np.unique(self.classes[rows], return_inverse=True)
        w, n = np.bincount(which, self.w[rows]), np.bincount(which)
        sizes = self.sizes[lists]
        hits = self.at[_gather(self.starts[lists], sizes)]
        ws, counted = np.repeat(w, sizes), self.signed or how["min_shared"] > 1
        ns = np.repeat(n, sizes) if counted and len(lists) < len(rows) else None  # none if each list counts once
        if 8 * len(hits) > len(self.codes):
            score = np.bincount(hits, ws, len(self.codes))
            sums = np.bincount(hits, ns, len(self.codes)) if counted else None
            at = np.flatnonzero(sums >= how["min_shared"] if counted else score)
            score, sums = score[at], sums[at] if counted else None
        else:
            at, which = np.unique(hits, return_inverse=True)
            score = np.bincount(which, ws)
            sums = None
            if counted:
                sums = np.bincount(which, ns)
                enough = sums >= how["min_shared"]
                at, score, sums = at[enough], score[enough], sums[enough]
        score = half_up(score, how["digits"])
        if how["single"]:
            score = score.astype(np.float32)
        picked, ranks = [], []
        for s, e in zip(cuts := [0, *np.searchsorted(at, self.ends), len(at)], cuts[1:], strict=False):
            if s < e:
                v = score[s:e]
                if e - s > how["k"]:
                    best = np.flatnonzero(v >= np.partition(v, e - s - how["k"])[e - s - how["k"]])
                else:
                    best = np.arange(e - s)
                best = best[np.argsort(-v[best], kind="stable")][: how["k"]]  # places follow codes: ties go to the smaller
                picked.append(best + s)
                ranks.append(np.arange(len(best)))
        if not picked:
            return (np.zeros(0, np.int64),) * 5
        picked = np.concatenate(picked)
        at, score = at[picked], score[picked].astype(np.float64)
        channels, shared = np.zeros(len(at), np.int32), np.zeros(len(at), np.int64)
        if how["counts"] and counted and not how["bits"]:
            shared = sums[picked].astype(np.int64)
        elif how["bits"] or how["counts"]:
            bits = np.zeros(len(lists), np.int64)
            np.bitwise_or.at(bits, np.searchsorted(lists, self.classes[rows]), self.bit[rows])
            slot = np.argsort(at)
            place = np.searchsorted(at, hits, sorter=slot)
            place[place == len(at)] = 0
            place = slot[place]
            mine = np.flatnonzero(at[place] == hits)
            place = place[mine]
            of = np.repeat(np.arange(len(lists)), sizes)[mine]
            np.bitwise_or.at(channels, place, bits[of].astype(np.int32))
            np.add.at(shared, place, n[of])
        return at, score, channels, shared, np.concatenate(ranks)

    def formula(self, at: np.ndarray, score: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Jaccard of the distinct tokens, 0 without any, and a trace of the score."""
        sizes = self.t_sizes[at]
        place = np.searchsorted(self.words, own)
        known = place < len(self.words)
        place = place[known][self.words[place[known]] == own[known]]
        self.marked[place] = True
        sums = np.concatenate([[0], np.cumsum(self.marked[self.word_at[_gather(self.t_starts[at], sizes)]])])
        self.marked[place] = False
        both = sums[np.cumsum(sizes)] - sums[np.cumsum(sizes) - sizes]
        union = len(own) + sizes - both
        return half_up(np.where((len(own) > 0) & (sizes > 0), both / np.maximum(union, 1), 0.0) + 1e-6 * score, 9)

    def selected(self, found: tuple[np.ndarray, ...], own: np.ndarray) -> tuple[np.ndarray, ...]:
        """With the formula; what neither the score nor the formula ranks high goes, if the whole list is here."""
        at, score, _, _, rank = found
        value, keep = self.formula(at, score, own), self.how["keep"]
        if keep and len(at):
            source = np.searchsorted(self.ends, at, side="right")
            order = np.lexsort((at, -value, source))
            new = np.flatnonzero(np.concatenate([[True], np.diff(source[order]) != 0]))
            place = np.empty(len(at), np.int64)
            place[order] = np.arange(len(at)) - np.repeat(new, np.diff([*new, len(at)]))
            good = (rank < keep[0]) | (place < keep[1])
            return (*(x[good] for x in found), value[good])
        return (*found, value)

    def answers(self, part: pa.RecordBatch):
        """The results of each anchor of a run."""
        if self.given:
            self.index()
        values, offsets = _list(part["items"])
        words, cuts = _list(part["more"])
        for r, (s, e) in enumerate(zip(offsets.tolist(), offsets[1:].tolist(), strict=False)):
            asked = values[s:e]
            if (raw := asked.tobytes()) != self.last:
                self.last, self.found = raw, self.search(asked)
            found = self.found
            yield r, self.selected(found, words[cuts[r] : cuts[r + 1]]) if self.how["tokens"] else (*found, np.zeros(len(found[0])))


def batch(out: list, ids: list) -> pa.RecordBatch:
    """Results of anchors (anchor, seed, home) as rows."""
    n = [len(x[0]) for x in out]
    columns = [pa.array(np.repeat(np.array([i[0] for i in ids], np.int64), n)), *(pa.array([i[c] for i in ids], kind).take(pa.array(np.repeat(np.arange(len(ids)), n))) for c, kind in ((1, pa.int64()), (2, pa.int32())))]
    columns += [pa.array(np.concatenate([x[c] for x in out]), kind) for c, kind in enumerate((pa.int64(), pa.float64(), pa.int32(), pa.int64(), pa.int32(), pa.float64()))]
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in OUT.split(", ")])


def _searched(how: dict):
    def run(batches):
        cell, at, out, ids, n = None, None, [], [], 0
        for given in batches:
            if not given.num_rows:
                continue
            cells, tags = given["cell"].to_numpy(), given["tag"].to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(cells) != 0) | (np.diff(tags) != 0)) + 1), len(cells)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                part, tag = given.slice(s, e - s), tags[s]
                if cells[s] != at:
                    cell, at = Cell(how), cells[s]
                if tag == POSTING:
                    cell.given.append((part["id"].to_numpy(), part["w"].to_numpy(), part["bit"].to_numpy(), *_list(part["items"])))
                elif tag == TOKENS:
                    cell.tokens.append((part["id"].to_numpy(), *_list(part["more"])))
                elif cell.given or hasattr(cell, "blocks"):
                    own, seeds, homes = part["id"].to_pylist(), part["seed"].to_pylist(), part["home"].to_pylist()
                    for r, (places, *rest) in cell.answers(part):
                        if len(places):
                            out.append((cell.codes[places], *rest))
                            ids.append((own[r], seeds[r], homes[r]))
                            n += len(places)
                        if n >= ROWS:
                            yield batch(out, ids)
                            out, ids, n = [], [], 0
        if out:
            yield batch(out, ids)
        cell = out = given = part = None
        give_back()

    return run


def best(anchor_keys: DataFrame, target_keys: DataFrame, key: list[str], cap: int, k: int, weigh: Callable[[DataFrame], DataFrame], digits: int, single: bool = False, bits: bool = False, counts: bool = False, min_shared: int = 1, tokens: tuple[DataFrame, DataFrame] | None = None, keep: tuple[int, int] | None = None) -> DataFrame:
    """(anchor, [seed,] code, source, score, channels, shared, rank, home[, formula]) of the k best of each anchor and source.

    A key in more than ``cap`` targets counts for nothing.  ``weigh`` adds w (double), and bit if ``bits``, to blocks
    (*key, size).  Sums are rounded to ``digits`` places, as a float if ``single``; ties go to the smaller code.  Anchors
    with a column ``seed`` are searched by (anchor, seed).  With ``tokens``, (anchor, country, tokens) and (code, country,
    tokens) with distinct tokens and one row an id, the formula of ``select.formula`` on their Jaccard likeness is added;
    with ``keep`` too, only rows that are among the first keep[0] by rank or keep[1] by formula return.  ``home`` is the
    same for all rows of an anchor and seed, and for anchors that were searched together.
    """
    seeded = "seed" in anchor_keys.columns
    seed = F.col("seed") if seeded else F.lit(None).cast("bigint")
    a = anchor_keys.select(F.col("anchor").cast("bigint").alias("anchor"), seed.cast("bigint").alias("seed"), *key)
    t = target_keys.select(F.col("code").cast("bigint").alias("code"), *key)
    sizes = t.groupBy(*key).agg(F.count("*").alias("size")).filter(F.col("size") <= cap)
    blocks = weigh(sizes.join(a.groupBy(*key).agg(F.count("*").alias("n")), key))
    if not bits:
        blocks = blocks.withColumn("bit", F.lit(0))
    blocks = held(blocks.select(*key, "size", "n", F.col("w").cast("double").alias("w"), F.col("bit").cast("int").alias("bit"), F.monotonically_increasing_id().alias("block")))
    # A record has one country; ids that come with several are summed over them, all countries then being one scope.
    one = a.filter("country is not null").groupBy("anchor", "seed").agg((F.min("country") < F.max("country")).alias("several")).filter("several").isEmpty()
    scope = (F.col("country") if one else F.lit("")).alias("scope")
    hits, postings = F.sum(F.col("size") * F.col("n")), F.sum("size")
    parts = blocks.groupBy(scope).agg(F.least(F.ceil(hits / HITS), F.greatest(F.lit(PARTS), F.ceil(hits / MOST_HITS))).cast("int").alias("ap"), F.ceil(postings / POSTINGS).cast("int").alias("tp"))
    parts = held(parts.withColumn("first", F.sum(F.col("ap") * F.col("tp")).over(Window.orderBy("scope")) - F.col("ap") * F.col("tp")))
    cells, most = parts.agg(F.max(F.col("first") + F.col("ap") * F.col("tp")), F.max("tp")).first()
    cells, whole = int(cells or 1), (most or 1) == 1
    parts = F.broadcast(parts)
    nothing = F.array().cast("array<bigint>")
    t_part, a_part = F.pmod(F.xxhash64("code"), F.col("tp")), F.pmod(F.xxhash64("items"), F.col("ap"))
    to = lambda own, n, at: F.explode(F.transform(F.sequence(F.lit(0), F.col(n) - 1), at)).alias("cell")
    by_a, by_t = (lambda x: (F.col("first") + x * F.col("tp") + F.col("part")).cast("int")), (lambda x: (F.col("first") + F.col("part") * F.col("tp") + x).cast("int"))

    def rows(frame: DataFrame, tag: int, cell, **columns) -> DataFrame:
        default = {"h": F.lit(0).cast("bigint"), "seed": F.lit(None).cast("bigint"), "w": F.lit(0.0), "bit": F.lit(0), "home": F.lit(0), "items": nothing, "more": nothing}
        return frame.select(cell, F.lit(tag).alias("tag"), *(v.alias(n) for n, v in (default | columns).items()))

    lists = t.join(blocks.select(*key, "block", "w", "bit"), key).withColumn("scope", scope).join(parts, "scope").withColumn("part", t_part)
    lists = lists.groupBy(*key, "block", "w", "bit", "first", "ap", "tp", "part").agg(F.sort_array(F.collect_list("code")).alias("items"))
    asked = a.join(blocks.select(*key, "block"), key).groupBy("anchor", "seed", scope).agg(F.sort_array(F.collect_list("block")).alias("items"))
    if tokens:
        own, theirs = (x.withColumn("more", F.transform("tokens", lambda w: F.xxhash64(w))) for x in tokens)
        asked = asked.join(own.select(F.col("anchor").cast("bigint").alias("anchor"), "more"), "anchor")
        theirs = theirs.withColumn("scope", scope).join(parts, "scope").withColumn("part", t_part)
    asked = asked.join(parts, "scope").withColumn("part", a_part)
    every = rows(lists, POSTING, to(lists, "ap", by_a), id=F.col("block"), w=F.col("w"), bit=F.col("bit"), items=F.col("items"))
    if tokens:
        every = every.unionByName(rows(theirs, TOKENS, to(theirs, "ap", by_a), id=F.col("code").cast("bigint"), more=F.col("more")))
    every = every.unionByName(rows(asked, ANCHOR, to(asked, "tp", by_t), h=F.xxhash64("items"), id=F.col("anchor"), seed=F.col("seed"), home=(F.col("first") + F.col("part") * F.col("tp")).cast("int"), items=F.col("items"), **({"more": F.col("more")} if tokens else {})))
    how = {"k": k, "digits": digits, "single": single, "bits": bits, "counts": counts, "min_shared": min_shared, "tokens": tokens is not None, "keep": keep if whole else None}
    found = every.repartitionById(cells, F.col("cell")).sortWithinPartitions("cell", "tag", "h").mapInArrow(_searched(how), OUT)
    found = found.withColumn("source", code_source(F.col("code")))
    if not whole:  # the best of the parts of the targets
        order = Window.partitionBy("anchor", "seed", "source").orderBy(F.desc("score"), "code")
        found = found.withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < k)
        if keep:
            place = F.row_number().over(Window.partitionBy("anchor", "seed", "source").orderBy(F.desc("formula"), "code")) - 1
            found = found.withColumn("place", place).filter((F.col("rank") < keep[0]) | (F.col("place") < keep[1]))
    score = F.col("score").cast("float") if single else F.col("score")
    anchor, code = (F.col(c).cast(x.schema[c].dataType).alias(c) for c, x in (("anchor", anchor_keys), ("code", target_keys)))
    return found.select(anchor, *["seed"] * seeded, code, "source", score.alias("score"), "channels", "shared", F.col("rank").cast("int").alias("rank"), "home", *["formula"] * (tokens is not None))
