"""Toxicity by maximum-scoring segment search over token log-odds.

Tokens are lower-case runs of letters.  A token and its first four and five letters are nodes of a small tree;
the log-odds of a node come from the toxic and the clean training documents that hold it, with a Dirichlet prior
that hands each node its parent's rate (the root's is the share of all counts), so an unseen ending of a known
stem keeps the stem's odds.  Only nodes that differ from the root beyond ``Z`` standard errors, and nodes below
such a node, are kept; all other tokens score ``-DRIFT``.

A linear-time scan finds all maximal scoring segments of a text.  Segments are calibrated as extreme values: with
the positive root of ``E[exp(lambda * s)] = 1`` over clean tokens and a rate K from the clean segments, a segment
of score S is expected ``K * n * exp(-lambda * S)`` times by chance in n tokens.  A document sums the surprise
(-ln of that) of its significant segments; a logistic curve, fitted on training documents that did not count for
the log-odds, turns the sum into a score.

The fit uses a bounded sample of ``sample`` labelled documents, of which near copies count once; at most ``NODES``
nodes are kept.  All texts are scored whole.

Defined results: texts that are NULL, empty or without letters have no segment and the score of the curve at 0;
documents with a NULL label teach nothing; without labels, or with one class only, every score is 0.0; an empty
table gives an empty result; rows with a NULL or repeated id are scored like others.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import WordHashes, as_bytes, crc32_mod, mix64, shingle_hashes, tidy
from matchloom.llm.quality import labelled_sample, sigmoid

SAMPLE, NODES, PRIOR, Z, DRIFT, LEAST = 24_576, 50_000, 10.0, 2.5, 0.2, 3
WORD = re.compile(r"[^\W\d_]+")
BANDS = np.arange(1, 9, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def tokens(text: bytes) -> list[str]:
    return WORD.findall(text.decode("utf-8", "replace").lower())


def nodes(word: str) -> list[str]:
    """From the stem to the word itself; ``~`` marks stems (it is in no token)."""
    return [word[:n] + "~" for n in (4, 5) if len(word) > n] + [word]


class Scores(dict):
    """Token -> score: that of its most specific node that was kept, else the drift."""

    def __init__(self, odds: dict[str, float], most: int = 200_000):
        super().__init__()
        self.odds, self.most = odds, most

    def __missing__(self, word: str) -> float:
        if len(self) > self.most:
            self.clear()
        for node in reversed(nodes(word)):
            if node in self.odds:
                break
        else:
            self[word] = -DRIFT
            return -DRIFT
        self[word] = s = self.odds[node] - DRIFT
        return s


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (begin, end, score) in order, in time linear in the scores.

    The list holds disjoint candidates with the totals before and after each; a new positive run joins the
    candidates back to the last one that starts lower, as long as its own end is higher.  Non-positive scores
    only move the running total, so the scan visits positive positions alone.
    """
    total = np.concatenate([[0.0], np.cumsum(scores)])
    held: list[tuple[int, int, float, float]] = []
    lower: list[int] = []  # for each candidate, the nearest earlier one whose left total is lower
    for i in np.flatnonzero(scores > 0):
        begin, end, left, right = int(i), int(i) + 1, total[i], total[i + 1]
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= left:
                j = lower[j]
            if j < 0 or held[j][3] >= right:
                held.append((begin, end, left, right))
                lower.append(j)
                break
            begin, left = held[j][0], held[j][2]
            del held[j:], lower[j:]
    return [(a, b, float(r - l)) for a, b, l, r in held]


class Model:
    """Node log-odds, extreme-value parameters and the final curve; plain numbers, bounded by NODES."""

    def __init__(self, odds: dict[str, float], rate: float = 1.0, k: float = 0.1, slope: float = 1.0, shift: float = -3.0):
        self.odds, self.rate, self.k, self.slope, self.shift = odds, rate, k, slope, shift

    def significant(self, found: list[tuple[int, int, float]], n: int) -> list[tuple[int, int, float]]:
        """(begin, end, surprise) of the segments expected less than once by chance in a text of n tokens."""
        out = [(a, b, self.rate * s - float(np.log(self.k * max(n, 1)))) for a, b, s in found]
        return [x for x in out if x[2] > 0]

    def score(self, surprise: float) -> float:
        return float(sigmoid(self.slope * np.log1p(surprise) + self.shift))


def _copies(words: WordHashes, text: bytes) -> list[int]:
    """Four keys of two minima each of the shingles: near copies share one almost surely."""
    h = shingle_hashes(words.of(text.lower().split()))
    if not len(h):
        return [0]
    low = np.array([mix64(h ^ b).min() for b in BANDS])
    return mix64(low[::2] ^ mix64(low[1::2])).astype(np.int64).tolist()


def _one_of_each(sample: DataFrame) -> list[int]:
    """Ids of the sample without those that are near copies of a smaller id (the sample is bounded)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for b in batches:
            words.trim()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([_copies(words, t) for t in as_bytes(b.column("text"))], pa.list_(pa.int64()))], ["doc_id", "keys"])

    rows = sorted((r["doc_id"], r["keys"]) for r in sample.select("doc_id", "text").mapInArrow(tidy(run), "doc_id bigint, keys array<bigint>").collect())
    seen: set[tuple[int, int]] = set()
    out = []
    for doc_id, keys in rows:
        keys = set(enumerate(keys))
        if not keys & seen:
            out.append(doc_id)
        seen |= keys
    return out


def fit(sample: DataFrame) -> Model | None:
    spark = sample.sparkSession
    chosen = sorted(set(_one_of_each(sample)))
    if not chosen:
        return None
    # Bounded like the sample: one number a document.
    ids = spark.createDataFrame(pd.DataFrame({"__one": np.array(chosen, np.int64)}))
    sample = sample.join(F.broadcast(ids), F.col("doc_id") == F.col("__one")).dropDuplicates(["doc_id"]).select("text", "label", (F.pmod("key", F.lit(4)) == 0).alias("later"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()

        def out():
            names = list({*toxic, *clean})
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([toxic[x] for x in names], pa.int64()), pa.array([clean[x] for x in names], pa.int64())], ["node", "t", "c"])
            toxic.clear()
            clean.clear()

        for b in batches:
            for text, label, later in zip(as_bytes(b.column("text")), b.column("label").to_pylist(), b.column("later").to_pylist()):
                if not later:
                    (toxic if label else clean).update({x for w in set(tokens(text)) for x in nodes(w)})
            if len(toxic) + len(clean) > 1_000_000:
                yield from out()
        yield from out()

    counts = sample.mapInArrow(tidy(count), "node string, t bigint, c bigint").groupBy("node").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    counts = counts.persist()
    try:
        total = counts.agg(F.sum("t").alias("t"), F.sum("c").alias("c")).first()
        if not total["t"] or not total["c"]:
            return None
        base = total["t"] / (total["t"] + total["c"])
        rise = F.ln((F.col("t") + PRIOR * base) / (F.col("c") + PRIOR * (1 - base))) - float(np.log(base / (1 - base)))
        strong = counts.filter(F.col("t") + F.col("c") >= LEAST).withColumn("z", rise / F.sqrt(1 / (F.col("t") + PRIOR * base) + 1 / (F.col("c") + PRIOR * (1 - base))))
        strong = strong.filter(F.col("z") >= Z).orderBy(F.desc("z"), "node").limit(NODES).select("node", "t", "c").toPandas()
        stems = spark.createDataFrame(pd.DataFrame({"stem": [x for x in strong["node"] if x.endswith("~")] or ["~"]}))
        below = counts.filter(F.col("t") + F.col("c") >= LEAST).filter(F.length("node") > 4).withColumn("stem", F.concat(F.substring("node", 1, 4), F.lit("~"))).filter("node <> stem")
        below = below.join(F.broadcast(stems), "stem", "left_semi").select("node", "t", "c").orderBy(F.desc(F.col("t") + F.col("c")), "node").limit(NODES).toPandas()
    finally:
        counts.unpersist()
    seen = {r.node: (r.t, r.c) for r in pd.concat([strong, below]).itertuples()}
    odds: dict[str, float] = {}

    def share(path: list[str]) -> float:
        p = base
        for x in path:
            if x in seen:
                t, c = seen[x]
                p = (t + PRIOR * p) / (t + c + PRIOR)
        return p

    for x in seen:
        word = x.rstrip("~")
        path = [word[:n] + "~" for n in (4, 5) if len(word) > n] + [x]
        p = share(list(dict.fromkeys(path)))
        odds[x] = float(np.log(p / (1 - p)) - np.log(base / (1 - base)))

    model = Model(odds)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scores(odds)
        for b in batches:
            rows = []
            for text, label, later in zip(as_bytes(b.column("text")), b.column("label").to_pylist(), b.column("later").to_pylist()):
                s = np.array([score[w] for w in tokens(text)])
                found = segments(s) if len(s) else []
                rows.append((int(label), bool(later), len(s), [x[2] for x in found], s[s > 0].tolist()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.bool_(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())))], ["label", "later", "n", "found", "above"])

    # Bounded by the sample: a few numbers a document.
    seen_docs = sample.mapInArrow(tidy(measure), "label int, later boolean, n bigint, found array<double>, above array<double>").collect()
    later = [r for r in seen_docs if r["later"]] or seen_docs
    clean = [r for r in later if not r["label"]]
    n_clean = sum(r["n"] for r in clean) or 1
    above = np.array([x for r in clean for x in r["above"]])
    model.rate = _root(above, n_clean)
    found = np.array([x for r in clean for x in r["found"]])
    least = float(np.median(found)) if len(found) else 1.0
    model.k = max(float((found >= least).sum()) if len(found) else 0.0, 0.5) * float(np.exp(model.rate * least)) / n_clean
    x = np.array([np.log1p(sum(s for *_, s in model.significant([(0, 0, v) for v in r["found"]], r["n"]))) for r in later])
    model.slope, model.shift = _curve(x, np.array([r["label"] for r in later], float))
    return model


def _root(above: np.ndarray, n: int) -> float:
    """The positive root of E[exp(rate * s)] = 1 over the tokens of clean texts, 1 at most (true log-odds have 1)."""
    excess = lambda r: (np.exp(r * above).sum() + (n - len(above)) * np.exp(-r * DRIFT)) / n - 1
    if excess(1.0) <= 0:
        return 1.0
    low, high = 1e-3, 1.0
    if excess(low) > 0:
        return low
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return low


def _curve(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 1e-2) -> tuple[float, float]:
    """Logistic curve by Newton steps; the ridge keeps it finite where the classes separate."""
    a = np.stack([x, np.ones_like(x)], axis=1)
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + ridge * w
        h = (a * (p * (1 - p))[:, None]).T @ a + np.eye(2) * ridge
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score, passages): passages are the significant segments (first token, token behind it, surprise)."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    kind = "array<struct<begin:bigint,end:bigint,surprise:double>>"
    if model is None:
        return rows.select("doc_id", F.lit(0.0).alias("score"), F.array().cast(kind).alias("passages"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Scores(model.odds)
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                b, out, passages = whole.slice(k, 1000), [], []
                for text in as_bytes(b.column("text")):
                    words = tokens(text)
                    s = np.fromiter(map(known.__getitem__, words), np.float64, len(words))
                    found = model.significant(segments(s), len(s))
                    out.append(model.score(sum(x[2] for x in found)))
                    passages.append([{"begin": x, "end": y, "surprise": z} for x, y, z in found])
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.float64()), pa.array(passages, PASSAGES)], ["doc_id", "score", "passages"])

    return rows.mapInArrow(tidy(run), f"doc_id bigint, score double, passages {kind}")


PASSAGES = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("surprise", pa.float64())]))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    return fit(labelled_sample(docs, labels, "toxic", sample, crc32_mod("doc_id", 5) != 0))


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted, passages); the held-out fifth of the documents teaches nothing."""
    return score(docs, train(docs, labels, sample)).select(
        "doc_id", (crc32_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "passages"
    )


def without_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is below the threshold, with the same columns."""
    model = train(docs, labels, sample)
    if model is None:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Scores(model.odds)
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                b, kept = whole.slice(k, 1000), []
                for text in as_bytes(b.column("text")):
                    words = tokens(text)
                    s = np.fromiter(map(known.__getitem__, words), np.float64, len(words))
                    kept.append(model.score(sum(x[2] for x in model.significant(segments(s), len(s)))) < threshold)
                yield b.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
