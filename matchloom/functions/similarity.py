"""String similarities of pairs, from 0 to 1, NULL where either side is empty.

``ratio`` is 2 LCS / (length sum), by a bit-parallel longest common subsequence; the others are the usual
Jaro-Winkler and the sorted and set forms of ``ratio`` on words.

Whole batches run as NumPy lanes, a 64-bit word of state a pair and a step a character, while the shorter text has at
most ``WORD`` characters and the longer at most ``REACH``; longer texts run one by one on Python's big integers, with
the same results.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD, REACH, LANES = 64, 256, 4096
Pairs = list[tuple[str, str]]


def lcs_length(a: str, b: str) -> int:
    if len(a) < len(b):
        a, b = b, a
    where: dict[str, int] = {}
    for i, c in enumerate(b):
        where[c] = where.get(c, 0) | 1 << i
    state = mask = (1 << len(b)) - 1
    for c in a:
        hit = state & where.get(c, 0)
        if hit:
            state = (state + hit | state - hit) & mask
    return len(b) - state.bit_count()


def ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 1.0 if not total or a == b else 2.0 * lcs_length(a, b) / total


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken = [False] * len(b)
    mine: list[str] = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                mine.append(c)
                break
    m = len(mine)
    if not m:
        return 0.0
    theirs = [c for c, t in zip(b, taken) if t]
    swaps = sum(x != y for x, y in zip(mine, theirs)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    if jaro <= 0.7:
        return jaro
    front = 0
    while front < min(4, len(a), len(b)) and a[front] == b[front]:
        front += 1
    return jaro + 0.1 * front * (1 - jaro)


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_x, only_y = sorted(x & y), sorted(x - y), sorted(y - x)
    if both and (not only_x or not only_y):
        return 1.0
    shared, left, right = " ".join(both), " ".join(both + only_x), " ".join(both + only_y)
    best = ratio(left, right)
    if both:
        best = max(best, ratio(shared, left), ratio(shared, right))
    return best


def _lanes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters as numbers from 1 in rows padded by 0, and the lengths."""
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    width = max(1, int(n.max()))
    codes = np.array(texts, dtype=f"U{width}").view(np.uint32).reshape(len(texts), width).astype(np.int32) + 1
    codes[np.arange(width) >= n[:, None]] = 0
    return codes, n


def _positions(patterns: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row, a word with the positions of each character of its pattern, and the texts as columns of that
    table; column 0 (padding and characters of no pattern) is empty."""
    column = np.zeros(int(max(patterns.max(), texts.max())) + 1, np.int32)
    column[patterns.ravel()] = 1
    column[0] = 0
    column = np.cumsum(column, dtype=np.int32) * column
    table = np.zeros((len(patterns), int(column.max()) + 1), np.uint64)
    rows, at = np.arange(len(patterns)), column[patterns]
    for i in range(patterns.shape[1]):
        table[rows, at[:, i]] |= np.uint64(1 << i)
    table[:, 0] = 0
    return table, column[texts]


def _lcs_lanes(short: list[str], long: list[str]) -> np.ndarray:
    patterns, n = _lanes(short)
    table, steps = _positions(patterns, _lanes(long)[0])
    rows = np.arange(len(short))
    mask = np.uint64(2**64 - 1) >> (WORD - n).astype(np.uint64)
    state = mask.copy()
    for j in range(steps.shape[1]):
        hit = state & table[rows, steps[:, j]]
        state = (state + hit) | (state - hit)
    return n - np.bitwise_count(state & mask)


def _jaro_lanes(left: list[str], right: list[str]) -> np.ndarray:
    (a, na), (b, nb) = _lanes(left), _lanes(right)
    table, steps = _positions(b, a)
    rows, one = np.arange(len(left)), np.uint64(1)
    reach = np.maximum(np.maximum(na, nb) // 2 - 1, 0)
    full = np.uint64(2**64 - 1)
    free, mine = np.full(len(left), full), np.zeros(a.shape, bool)
    for i in range(a.shape[1]):
        low, high = np.minimum(np.maximum(i - reach, 0), WORD - 1).astype(np.uint64), np.minimum(i + reach, WORD - 1)
        near = (full << low) & (full >> (WORD - 1 - high).astype(np.uint64))
        hits = table[rows, steps[:, i]] & near & free
        first = hits & (~hits + one)
        free ^= first
        mine[:, i] = first != 0
    theirs = (free[:, None] >> np.arange(b.shape[1], dtype=np.uint64) & one) == 0
    m = mine.sum(axis=1)
    # Both selections hold m characters a row, in order of rows and positions.
    swaps = np.bincount(np.repeat(rows, m), weights=a[mine] != b[theirs], minlength=len(left)).astype(np.int64) // 2
    known = np.maximum(m, 1)
    jaro = np.where(m > 0, (m / na + m / nb + (m - swaps) / known) / 3, 0.0)
    width = min(4, a.shape[1], b.shape[1])
    front = np.cumprod((a[:, :width] == b[:, :width]) & (a[:, :width] > 0), axis=1).sum(axis=1)
    return np.where(jaro > 0.7, jaro + 0.1 * front * (1 - jaro), jaro)


def _batched(pairs: Pairs, reach: int, lanes: Callable, single: Callable, dtype) -> np.ndarray:
    """``lanes`` on rows of similar length, ``single`` on texts too long for a word."""
    out = np.zeros(len(pairs), dtype)
    size = np.array([(min(len(a), len(b)), max(len(a), len(b))) for a, b in pairs], np.int64).reshape(-1, 2)
    fits = (size[:, 0] > 0) & (size[:, 0] <= WORD) & (size[:, 1] <= reach)
    order = np.flatnonzero(fits)[np.argsort(size[fits, 1], kind="stable")]
    for k in range(0, len(order), LANES):
        at = order[k : k + LANES]
        out[at] = lanes([pairs[i][0] for i in at], [pairs[i][1] for i in at])
    for i in np.flatnonzero(~fits & (size[:, 0] > 0)):
        out[i] = single(*pairs[i])
    return out


def lcs_lengths(pairs: Pairs) -> np.ndarray:
    ordered = [(a, b) if len(a) <= len(b) else (b, a) for a, b in pairs]
    return _batched(ordered, REACH, _lcs_lanes, lcs_length, np.int64)


def ratios(pairs: Pairs) -> np.ndarray:
    total = np.array([len(a) + len(b) for a, b in pairs], np.int64)
    return np.where(total > 0, 2.0 * lcs_lengths(pairs) / np.maximum(total, 1), 1.0)


def jaro_winklers(pairs: Pairs) -> np.ndarray:
    out = _batched(pairs, WORD, _jaro_lanes, jaro_winkler, np.float64)
    out[[i for i, (a, b) in enumerate(pairs) if a == b]] = 1.0
    return out


def token_sort_ratios(pairs: Pairs) -> np.ndarray:
    known = {x: " ".join(sorted(x.split())) for x in {x for p in pairs for x in p}}
    return ratios([(known[a], known[b]) for a, b in pairs])


def token_set_ratios(pairs: Pairs) -> np.ndarray:
    """Common words come first on both sides, so only the words of one side need a subsequence, and the common words
    alone are one of the whole."""
    words = {x: frozenset(x.split()) for x in {x for p in pairs for x in p}}
    out, open_, rests, fronts = np.zeros(len(pairs)), [], [], []
    for i, (a, b) in enumerate(pairs):
        x, y = words[a], words[b]
        if x and y:
            both = x & y
            if both and (both == x or both == y):
                out[i] = 1.0
            else:
                open_.append(i)
                rests.append((" ".join(sorted(x - both)), " ".join(sorted(y - both))))
                fronts.append(sum(map(len, both)) + len(both))  # with a blank behind each word
    if open_:
        front = np.array(fronts, np.int64)
        left, right = (np.array([len(r[s]) for r in rests], np.int64) + front for s in (0, 1))
        best = 2.0 * (front + lcs_lengths(rests)) / (left + right)
        shared = np.maximum(front - 1, 0)
        for side in (left, right):
            best = np.maximum(best, np.where(shared > 0, 2.0 * shared / (shared + side), 0.0))
        out[open_] = best
    return out


KERNELS = {"ratio": ratios, "jw": jaro_winklers, "tsort": token_sort_ratios, "tset": token_set_ratios}


def _compared(left: pd.Series, right: pd.Series, kinds: tuple[str, ...]) -> dict[str, np.ndarray]:
    """Each kind for all rows; repeated pairs of texts of a batch are compared once."""
    place: dict[tuple[str, str], int] = {}
    at = np.fromiter((place.setdefault((a, b), len(place)) if a and b else -1 for a, b in zip(left, right)), np.int64, len(left))
    pairs, out = list(place), {}
    for kind in kinds:
        values = np.append(KERNELS[kind](pairs) if pairs else np.zeros(0), np.nan)  # -1 is the last
        out[kind] = values[at]
    return out


def similarity(kind: str):
    """An Arrow UDF of one kernel over two text columns."""

    @F.pandas_udf(T.DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        found = _compared(a, b, (kind,))[kind]
        return pd.Series(found).astype("Float64")

    return run


PAIR = T.StructType([T.StructField(n, T.DoubleType()) for n in ("name_ratio", "name_jw", "name_tsort", "name_tset", "ns_ratio", "ns_tset", "addr_ratio", "addr_tsort", "addr_tset")])


@F.pandas_udf(PAIR)
def pair_similarities(name_a: pd.Series, name_t: pd.Series, ns_a: pd.Series, ns_t: pd.Series, addr_a: pd.Series, addr_t: pd.Series) -> pd.DataFrame:
    """All string similarities of a pair in one transfer."""
    plan = [("name", name_a, name_t, ("ratio", "jw", "tsort", "tset")), ("ns", ns_a, ns_t, ("ratio", "tset")), ("addr", addr_a, addr_t, ("ratio", "tsort", "tset"))]
    out = {}
    for field, left, right, kinds in plan:
        for kind, values in _compared(left, right, kinds).items():
            out[f"{field}_{kind}"] = pd.Series(values).astype("Float64")
    return pd.DataFrame(out)


def token_set_similarity(a: Column, b: Column) -> Column:
    return similarity("tset")(a, b)


def register(spark) -> None:
    """The kernels as SQL functions sim_ratio, sim_jw, sim_tsort and sim_tset."""
    for kind in KERNELS:
        spark.udf.register(f"sim_{kind}", similarity(kind))
