"""Columns of pairs worked out in cells, so that no text is shuffled with a pair.

A cell holds some anchors, all their pairs and the targets of these, each record once.  What is shuffled are pairs as
numbers and records once a cell that needs them; with ``home``, which tells where the search found a pair, anchors that
share targets meet.  Texts, words and numbers of a cell are numbered, pairs are compared as arrays, equal pairs of texts
once, and what depends on an anchor's other pairs is worked out in the same place.

A pair without one of its records goes; records that repeat an id give a pair each.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions.similarity import KERNELS
from matchloom.operators.search import _gather as gather
from matchloom.schema import BASE_MASK, BITS, CHANNELS, IDF_REF
from matchloom.scratch import give_back, held

#: Pairs of a cell, pairs and list items worked on at a time.  They choose the way, not the result.
PAIRS, ROWS, ITEMS = 200_000, 1 << 15, 1 << 21
TARGET, ANCHOR, PAIR = 0, 1, 2
COUNTS = ("t_name_cnt", "t_addr_cnt", "a_name_cnt", "a_addr_cnt")
Columns = dict[str, np.ndarray]


class Lists:
    """The numbered items of each record in order, each once, with weights if given; ``front`` has the first four."""

    def __init__(self, codes: np.ndarray, sizes: np.ndarray, w: np.ndarray | None = None):
        starts, rows = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
        self.front = np.full((len(sizes), 4), -1, np.int64)
        for k in range(4):
            self.front[sizes > k, k] = codes[starts[sizes > k] + k]
        order = np.lexsort((codes, rows))
        codes, rows = codes[order], rows[order]
        once = np.concatenate([[True], (np.diff(codes) != 0) | (np.diff(rows) != 0)])[: len(codes)]
        self.codes, self.sizes = codes[once].astype(np.int64), np.bincount(rows[once], minlength=len(sizes))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.w = None if w is None else w[order][once]


def _fields(column: pa.ChunkedArray) -> dict[str, pa.Array]:
    """The fields of a column of structs."""
    rows = column.combine_chunks()
    rows = rows.combine_chunks() if isinstance(rows, pa.ChunkedArray) else rows
    return dict(zip([f.name for f in rows.type], rows.flatten(), strict=True))


def _numbered(a: pa.Array, t: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Texts of both sides as numbers, and the text of each number."""
    found = pa.concat_arrays([a.fill_null(""), t.fill_null("")]).dictionary_encode()
    codes = found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return codes[: len(a)], codes[len(a) :], found.dictionary.to_pylist()


def _lists(a: pa.Array, t: pa.Array) -> tuple[Lists, Lists, list[str]]:
    """Arrays of texts, or of structs (token, w), of both sides as lists of numbers."""
    sizes = [pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (a, t)]
    items, w = [x.flatten() for x in (a, t)], (None, None)
    if pa.types.is_struct(items[0].type):
        w = [x.field("w").to_numpy(zero_copy_only=False) for x in items]
        items = [x.field("token") for x in items]
    left, right, words = _numbered(*items)
    return Lists(left, sizes[0], w[0]), Lists(right, sizes[1], w[1]), words


def _runs(weights: np.ndarray, most: int) -> Iterator[slice]:
    """Runs of rows of some ``most`` in all, of one row at least."""
    sums, s = np.cumsum(weights), 0
    while s < len(weights):
        e = max(s + 1, int(np.searchsorted(sums, (sums[s - 1] if s else 0) + most, side="right")))
        yield slice(s, e)
        s = e


def shared(a: Lists, t: Lists, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many items the records of each pair share."""
    return overlap(a, t, i, j, False)["both"]


def overlap(a: Lists, t: Lists, i: np.ndarray, j: np.ndarray, weighted: bool = True) -> Columns:
    """Shared items of each pair, and for weights the sums of shared ones (the larger weight), of those of one side
    alone, and the largest shared weight."""
    out = {c: np.zeros(len(i)) for c in ("both", *(("shared", "top", "only_a", "only_t", "all_a", "all_t") if weighted else ()))}
    base = int(max(a.codes.max(initial=0), t.codes.max(initial=0))) + 1
    for at in _runs(a.sizes[i] + t.sizes[j] + 1, ITEMS):
        n, na, nt = len(i[at]), a.sizes[i[at]], t.sizes[j[at]]
        ga, gt = gather(a.starts[i[at]], na), gather(t.starts[j[at]], nt)
        pa_, pt = np.repeat(np.arange(n), na), np.repeat(np.arange(n), nt)
        ka, kt = pa_ * base + a.codes[ga], pt * base + t.codes[gt]  # both ascend
        place = np.searchsorted(kt, ka)
        place[place == len(kt)] = 0
        hit = kt[place] == ka if len(kt) else np.zeros(len(ka), bool)
        out["both"][at] = np.bincount(pa_[hit], minlength=n)
        if not weighted:
            continue
        wa, wt, alone = a.w[ga], t.w[gt], np.ones(len(kt), bool)
        alone[place[hit]] = False
        w = np.maximum(wa[hit], wt[place[hit]])
        top = np.full(n, -np.inf)
        np.maximum.at(top, pa_[hit], w)
        sums = {"shared": (pa_[hit], w), "only_a": (pa_[~hit], wa[~hit]), "only_t": (pt[alone], wt[alone]), "all_a": (pa_, wa), "all_t": (pt, wt)}
        for c, (rows, values) in sums.items():
            out[c][at] = np.bincount(rows, values, n)
        out["top"][at] = np.where(np.isinf(top), 0.0, top)
    return out


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.where(whole > 0, part / np.where(whole > 0, whole, 1.0), 0.0)


def _known(mask: np.ndarray, value) -> np.ndarray:
    return np.where(mask, value, np.nan)


class Groups:
    """Windows over runs of rows."""

    def __init__(self, keys: np.ndarray):
        self.starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        self.sizes = np.diff([*self.starts, len(keys)])
        self.rows = np.repeat(np.arange(len(self.starts)), self.sizes)
        self.first = self.starts[self.rows]

    def spread(self, x: np.ndarray) -> np.ndarray:
        return x[self.rows]

    def max(self, v: np.ndarray) -> np.ndarray:
        return self.spread(np.maximum.reduceat(v, self.starts))

    def sum(self, v: np.ndarray) -> np.ndarray:
        return self.spread(np.add.reduceat(v, self.starts))

    def gap(self, v: np.ndarray) -> np.ndarray:
        return self.max(v) - v

    def lead(self, v: np.ndarray) -> np.ndarray:
        """Own minus the best rival; a lone one leads by its own value."""
        best, ordered = self.max(v), v[np.lexsort((-v, self.rows))]
        second = self.spread(np.where(self.sizes > 1, ordered[np.minimum(self.starts + 1, len(v) - 1)], 0.0))
        return v - np.where(v == best, second, best)

    def place(self, *keys: np.ndarray) -> np.ndarray:
        """Row numbers from 0 by keys, the last of which counts most."""
        out = np.empty(len(self.rows), np.int64)
        out[np.lexsort((*keys, self.rows))] = np.arange(len(out))
        return out - self.first

    def rank_known(self, v: np.ndarray) -> np.ndarray:
        """Ranks from 0 of known values, ties sharing the best; unknown stays unknown."""
        x = np.where(np.isnan(v), -np.inf, v)
        order = np.lexsort((-x, self.rows))
        new = np.concatenate([[True], (np.diff(self.rows[order]) != 0) | (x[order][1:] != x[order][:-1])])
        out = np.empty(len(v), np.int64)
        out[order] = np.maximum.accumulate(np.where(new, np.arange(len(v)), 0))
        return _known(~np.isnan(v), out - self.first)


def context(p: Columns, f: Columns, g: Groups) -> Columns:
    """What ``context.rival_context`` adds, from runs of an anchor's pairs."""
    name, addr, score = (np.nan_to_num(x) for x in (f["name_tset"], f["addr_tset"], p["score"].astype(np.float64)))
    known_n, known_a = ~np.isnan(f["name_tset"]), ~np.isnan(f["addr_tset"])
    mean = _known(known_n | known_a, (name + addr) / np.maximum(known_n.astype(int) + known_a, 1))
    strong = (np.nan_to_num(mean) >= 0.9).astype(np.float64)
    best = g.max(np.where(np.isnan(mean), -np.inf, mean))
    return {
        "n_cands": g.spread(g.sizes),
        "ret_score_gap": g.gap(score),
        "name_tset_gap": g.gap(name),
        "addr_tset_gap": g.gap(addr),
        "name_tset_lead": g.lead(name),
        "addr_tset_lead": g.lead(addr),
        "combo_rank": g.place(p["code"], -score, p["source"], -(name + addr)),
        "avail_mean": mean,
        "avail_rank": g.rank_known(mean),
        "avail_gap": best - mean,
        "name_rank_avail": g.rank_known(f["name_tset"]),
        "addr_rank_avail": g.rank_known(f["addr_tset"]),
        "n_strong_rivals": np.log1p(g.sum(strong) - strong),
    }


def rivals(f: Columns, g: Groups) -> Columns:
    """Best ones and gaps of a first ranking."""
    name, addr = (np.nan_to_num(f[c]) for c in ("name_tset", "addr_tset"))
    return {"c_name_best": g.max(name), "c_addr_best": g.max(addr), "c_name_gap": g.gap(name), "c_addr_gap": g.gap(addr), "c_combo_gap": g.gap(name + addr)}


class Cell:
    def __init__(self, full: bool):
        self.full, self.given = full, ([], [], [])

    def add(self, tag: int, part: pa.RecordBatch) -> None:
        self.given[tag].append(part)

    def index(self) -> None:
        """Numbers of both sides' texts, words and numbers."""
        tables = {side: pa.Table.from_batches(self.given[tag]).combine_chunks() for side, tag in (("a", ANCHOR), ("t", TARGET))}
        self.ids = {s: x["id"].to_numpy() for s, x in tables.items()}
        recs = {s: _fields(x["rec"]) for s, x in tables.items()}
        both = lambda c: [recs[s][c] for s in "at"]
        names = [pa.concat_arrays([recs[s]["name"], recs[s]["name_ns"]]) for s in "at"]  # one numbering for both
        a, t, self.names = _numbered(*names)
        half = [len(self.ids[s]) for s in "at"]
        self.name, self.ns = (a[: half[0]], t[: half[1]]), (a[half[0] :], t[half[1] :])
        *self.glued, self.glues = _numbered(*both("glued"))
        *self.addr, self.addrs = _numbered(*both("addr"))
        self.counts = [[recs[s][c].cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("name_cnt", "addr_cnt")] for s in "ta"]
        if self.full:
            self.nw, self.aw, self.nums, self.nums_j, self.postal = (_lists(*both(c)) for c in ("nw", "aw", "nums", "nums_j", "postal"))
            words = self.nums[2]
            at = {w: n for n, w in enumerate(words)}
            self.cut = np.array([at.get(w[:-1], -2) if len(w) > 2 else -2 for w in words] + [-3], np.int64)  # without the last digit
            self.value = np.array([float(w) for w in words] + [math.nan])
            self.indic = [x.cast(pa.int8()).to_numpy(zero_copy_only=False).astype(np.float64) for x in both("indic")]

    def texts(self, codes: tuple[np.ndarray, np.ndarray], words: list[str], i: np.ndarray, j: np.ndarray) -> tuple[list[tuple[str, str]], np.ndarray]:
        """The different pairs of texts, and which of them a pair has; -1 where one is empty."""
        left, right = codes[0][i], codes[1][j]
        empty = words.index("") if "" in words else -1
        keys, which = np.unique(left * len(words) + right, return_inverse=True)
        x, y = np.divmod(keys, max(1, len(words)))
        good = (x != empty) & (y != empty)
        slots = np.where(good, np.cumsum(good) - 1, -1)
        return [(words[m], words[n]) for m, n in zip(x[good].tolist(), y[good].tolist(), strict=True)], slots[which]

    def similarities(self, i: np.ndarray, j: np.ndarray) -> Columns:
        out, twice = {}, len(i)
        sides = tuple(np.concatenate([x, y]) for x, y in zip(self.name, self.ns, strict=True))
        n = [len(self.name[0]), len(self.name[1])]
        pairs, at = self.texts(sides, self.names, np.concatenate([i, i + n[0]]), np.concatenate([j, j + n[1]]))
        score = lambda kind, pairs: np.append(KERNELS[kind](pairs) if pairs else np.zeros(0), np.nan)
        for kind in ("ratio", "tset"):
            found = score(kind, pairs)[at]
            out[f"name_{kind}"], out[f"ns_{kind}"] = found[:twice], found[twice:]
        pairs, at = self.texts(self.name, self.names, i, j)
        for kind in ("jw", "tsort") if self.full else ("jw",):
            out[f"name_{kind}"] = score(kind, pairs)[at]
        pairs, at = self.texts(self.addr, self.addrs, i, j)
        for kind in ("ratio", "tsort", "tset") if self.full else ("ratio", "tset"):
            out[f"addr_{kind}"] = score(kind, pairs)[at]
        return out

    def equal(self, codes, words: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
        left, right = codes[0][i], codes[1][j]
        empty = words.index("") if "" in words else -1
        return _known((left != empty) & (right != empty), left == right)

    def numbers(self, i: np.ndarray, j: np.ndarray) -> Columns:
        """As ``features.number_evidence`` and ``features.joined_numbers``."""
        out = {}
        a, t, _ = self.nums
        na, nt, n = a.sizes[i], t.sizes[j], shared(a, t, i, j)
        both = (na > 0) & (nt > 0)
        x, y = a.front[i][:, :, None], t.front[j][:, None, :]
        cut = ((self.cut[x] == y) | (self.cut[y] == x)).any(axis=(1, 2))
        p, q = self.value[x], self.value[y]
        most = np.maximum(p, q)
        gap = np.fmin.reduce(np.where(most == 0, 0.0, np.abs(p - q) / most).reshape(len(i), 16), axis=1) if len(i) else np.zeros(0)
        out |= {"num_n_a": na, "num_n_t": nt, "num_shared": _known(both, n), "num_jacc": _known(both, n / np.maximum(na + nt - n, 1))}
        out |= {"num_first_equal": _known(both, x[:, 0, 0] == y[:, 0, 0]), "num_conflict": _known(both, n == 0), "num_min_reldiff": _known(both, np.fmin(1.0, gap)), "num_prefix": _known(both, cut)}
        a, t, _ = self.postal
        codes, meet = (a.sizes[i] > 0) & (t.sizes[j] > 0), shared(a, t, i, j) > 0
        out |= {"postal_equal": _known(codes, meet), "postal_conflict": _known(codes, ~meet)}
        a, t, _ = self.nums_j
        na, nt, n = a.sizes[i], t.sizes[j], shared(a, t, i, j)
        both = (na > 0) & (nt > 0)
        return out | {"numj_jacc": _known(both, n / np.maximum(na + nt - n, 1)), "numj_first_equal": _known(both, a.front[i, 0] == t.front[j, 0])}

    def words(self, lists: tuple[Lists, Lists, list[str]], field: str, i: np.ndarray, j: np.ndarray) -> Columns:
        """As ``features.token_overlap``."""
        a, t, _ = lists
        o, na, nt = overlap(a, t, i, j), a.sizes[i], t.sizes[j]
        both = (na > 0) & (nt > 0)
        found = {
            "jacc": o["both"] / np.maximum(na + nt - o["both"], 1),
            "wov": _share(o["shared"], o["shared"] + o["only_a"] + o["only_t"]),
            "wshared_max": o["top"] / math.log(IDF_REF),
            "wmiss_a": _share(o["only_a"], o["all_a"]),
            "wmiss_t": _share(o["only_t"], o["all_t"]),
        }
        return {f"{field}_{k}": _known(both, v) for k, v in found.items()}

    def columns(self, p: Columns, i: np.ndarray, j: np.ndarray) -> Columns:
        """All columns of whole anchors' pairs: of records i and j each."""
        f, g = self.similarities(i, j), Groups(p["anchor"])
        bits = p["channels"].astype(np.int64)
        f |= {"ret_score": p["score"], "ret_rank": p["rank"], "is_s3": p["source"] == 3, "n_channels": np.bitwise_count(bits & BASE_MASK), **{f"ch_{c}": (bits & BITS[c]) != 0 for c in CHANNELS}}
        own = [x[r] for x, r in zip((*self.counts[0], *self.counts[1]), (j, j, i, i), strict=True)]
        f |= {c: np.log1p(p[c] if c in p else n) for c, n in zip(COUNTS, own, strict=True)}
        glued = self.equal(self.glued, self.glues, i, j)
        if not self.full:
            return f | {f"c_{k}": f[k] for k in ("name_ratio", "name_jw", "name_tset", "ns_tset", "addr_ratio", "addr_tset")} | {"c_glued_eq": glued} | rivals(f, g)
        size = lambda words: np.fromiter(map(len, words), np.float64, len(words))
        n, d = size(self.names), size(self.addrs)
        la, lt, aa, at = n[self.name[0][i]], n[self.name[1][j]], d[self.addr[0][i]], d[self.addr[1][j]]
        f |= {"name_equal": self.equal(self.name, self.names, i, j), "glued_equal": glued, "name_len_a": la, "name_len_t": lt}
        f |= {"name_len_ratio": _known(np.maximum(la, lt) > 0, np.minimum(la, lt) / np.maximum(np.maximum(la, lt), 1)), "addr_empty_a": aa == 0, "addr_empty_t": at == 0}
        f |= {"addr_len_ratio": _known(np.minimum(aa, at) > 0, np.minimum(aa, at) / np.maximum(np.maximum(aa, at), 1)), "indic_a": self.indic[0][i], "indic_t": self.indic[1][j]}
        f |= self.words(self.nw, "name", i, j) | self.words(self.aw, "addr", i, j) | self.numbers(i, j)
        return f | context(p, f, g)

    def results(self, names: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
        if not all(self.given):
            return
        self.index()
        table = pa.Table.from_batches(self.given[PAIR]).combine_chunks()
        p = {"anchor": table["id"].to_numpy()} | {c: table[c].to_numpy() for c in ("code", "source", "score", "channels", "rank")}
        if not table["n"].null_count:
            p |= {c: x.to_numpy(zero_copy_only=False).astype(np.float64) for c, x in _fields(table["n"]).items()}
        self.given = ([], [], [])
        s, e = (np.searchsorted(self.ids["a"], p["anchor"], side=h) for h in ("left", "right"))
        u, v = (np.searchsorted(self.ids["t"], p["code"], side=h) for h in ("left", "right"))
        left, right = e - s, v - u  # rows of a pair's records, 1 each unless an id is repeated or missing
        times = left * right
        rows = np.repeat(np.arange(len(times)), times)
        nth = gather(np.zeros(len(times), np.int64), times)
        i, j = s[rows] + nth // right[rows], u[rows] + nth % right[rows]
        if not len(rows):
            return
        p = {c: x[rows] for c, x in p.items()}
        g = Groups(p["anchor"])
        for at in _runs(g.sizes, ROWS):
            run = slice(int(g.starts[at][0]), int(g.starts[at][-1] + g.sizes[at][-1]))
            own = {c: x[run] for c, x in p.items()}
            with np.errstate(invalid="ignore", divide="ignore"):
                f = self.columns(own, i[run], j[run])
            ids = [pa.array(own["anchor"], pa.int64()), pa.array(own["code"], pa.int64()), pa.array(own["source"], pa.int32())]
            yield pa.RecordBatch.from_arrays(ids + [pa.array(np.asarray(f[c], np.float32), pa.float32(), from_pandas=True) for c in names], ["anchor", "code", "source", *names])


def _worked_out(full: bool, names: tuple[str, ...]) -> Callable:
    def run(batches):
        cell, at = None, None
        for given in batches:
            if not given.num_rows:
                continue
            cells, tags = given["cell"].to_numpy(), given["tag"].to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(cells) != 0) | (np.diff(tags) != 0)) + 1).tolist(), len(cells)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                if cells[s] != at:
                    if cell:
                        yield from cell.results(names)
                    cell, at = Cell(full), cells[s]
                cell.add(tags[s], given.slice(s, e - s))
        if cell:
            yield from cell.results(names)
        cell = given = None
        give_back()

    return run


def worked_out(pairs: DataFrame, anchors: DataFrame, targets: DataFrame, columns: tuple[str, ...], names: tuple[str, ...], full: bool) -> DataFrame:
    """(anchor, code, source, *names) of pairs (anchor, code, source, score, channels, ret_rank[, counts][, home]).

    pairs is read several times and should be held.  Counts (``COUNTS``) come from the pairs, or else from the records,
    where a missing one is 0.  ``columns`` are those of the records that the names need.
    """
    if "home" not in pairs.columns:
        pairs = pairs.join(anchors.select("anchor", F.xxhash64("country").alias("home")).groupBy("anchor").agg(F.min("home").alias("home")), "anchor")
    sizes = pairs.groupBy("home").agg(F.count("*").alias("size")).withColumn("sub", F.ceil(F.col("size") / PAIRS).cast("int"))
    sizes = held(sizes.withColumn("first", F.sum("sub").over(Window.orderBy("home")) - F.col("sub")))
    cells = int(sizes.agg(F.sum("sub")).first()[0] or 1)
    counted = set(COUNTS) <= set(pairs.columns)
    cell = (F.col("first") + F.pmod(F.xxhash64("anchor"), F.col("sub"))).cast("int").alias("cell")
    numbers = F.struct(*(F.col(c).cast("int").alias(c) for c in COUNTS)) if counted else F.lit(None).cast("struct<x:int>")
    rows = pairs.join(F.broadcast(sizes.select("home", "first", "sub")), "home").select(
        cell, F.lit(PAIR).alias("tag"), F.col("anchor").cast("bigint").alias("id"), F.col("code").cast("bigint").alias("code"), F.col("source").cast("int").alias("source"),
        F.col("score").alias("score"), F.col("channels").cast("int").alias("channels"), F.col("ret_rank").cast("int").alias("rank"), numbers.alias("n"),
    )

    def records(tag: int, frame: DataFrame, key: str, column: str, side: str) -> DataFrame:
        count = lambda c: F.coalesce(F.col(c) if c in frame.columns else F.lit(0), F.lit(0)).cast("int")
        rec = F.struct(*columns, *(count(f"{side}_{c}").alias(c) for c in ("name_cnt", "addr_cnt"))).alias("rec")
        needed = rows.select("cell", F.col(column).alias("id")).distinct()
        return needed.join(frame.select(F.col(key).cast("bigint").alias("id"), rec), "id").select("cell", F.lit(tag).alias("tag"), "id", "rec")

    every = records(TARGET, targets, "code", "code", "t").unionByName(records(ANCHOR, anchors, "anchor", "id", "a"))
    every = every.unionByName(rows, allowMissingColumns=True)
    n = min(cells, max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-cells // 4)))
    out = "anchor bigint, code bigint, source int, " + ", ".join(f"{c} float" for c in names)
    found = every.repartitionById(n, (F.col("cell") % n).cast("int")).sortWithinPartitions("cell", "tag", "id").mapInArrow(_worked_out(full, names), out)
    return found.select(*(F.col(c).cast(pairs.schema[c].dataType).alias(c) for c in ("anchor", "code", "source")), *names)
