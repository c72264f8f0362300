"""Quality classifier: hashed word n-gram logistic regression, trained with follow-the-regularised-leader updates.

A text is split at ASCII white space.  Its features are hashed one- and two-word sequences, of the words
themselves and of their shapes (runs of capitals, small letters and digits become one mark, other characters
stay; a word equal to the one before it is marked).  A feature's value is the square root of its share of the
sequences of its kind, so texts of any length have the same norm.  Scoring is a sparse dot product and a sigmoid.

The model is fitted on a bounded sample: ``sample`` labelled documents at most (in expectation), chosen by a hash
of their id, streamed through one task in hash order.  Weights are ``2**BITS`` floats, whatever the input.

Defined results: NULL, empty and blank texts have the score of the intercept; documents whose label is NULL teach
nothing; several labels of a document count as their maximum; without any labels all scores are 0.5; an empty
table gives an empty result.  Rows with a NULL or repeated id are scored like others.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import GOLD, as_bytes, crc32_mod, mix64

BITS, SAMPLE, EPOCHS, SEED = 18, 8192, 3, 11
ALPHA, BETA, L1, L2 = 0.6, 1.0, 0.02, 0.02
REPEATED = np.uint64(0x5851F42D4C957F2D)


def shape(word: bytes) -> bytes:
    text = word.decode("utf-8", "replace")
    marks = re.sub(r"(.)\1+", r"\1", "".join("A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c for c in text))
    return marks.encode("utf-8", "replace")


class Words(dict):
    """Interns words with the hashes of their lower-case form and of their shape; bounded by ``trim``."""

    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most = most
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.n, self.hashes = 0, np.zeros((1 << 12, 2), np.uint64)

    def __missing__(self, word: bytes) -> int:
        if self.n == len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
        self.hashes[self.n] = xxhash.xxh64_intdigest(word.lower()), xxhash.xxh64_intdigest(shape(word), 1)
        self[word] = self.n
        self.n += 1
        return self.n - 1

    def features(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Distinct feature numbers and their values."""
        words = text.split()
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.float32)
        rows = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.n > self.most:
            found = self.hashes[rows]
            self.clear()
        else:
            found = self.hashes[rows]
        word, form = found[:, 0], found[:, 1].copy()
        form[1:][rows[1:] == rows[:-1]] ^= REPEATED
        kinds = [mix64(word), mix64(form + GOLD)]
        if len(words) > 1:
            kinds += [mix64(mix64(word[:-1] + GOLD) ^ word[1:]), mix64(mix64(form[:-1]) ^ (form[1:] + GOLD))]
        at = np.concatenate(kinds) >> np.uint64(64 - BITS)
        share = np.concatenate([np.full(len(k), 1.0 / len(k)) for k in kinds])
        distinct, inverse = np.unique(at, return_inverse=True)
        return distinct.astype(np.int32), np.sqrt(np.bincount(inverse, share)).astype(np.float32)


class Ftrl:
    """Logistic regression by FTRL-proximal updates, one example at a time."""

    def __init__(self, size: int = 1 << BITS):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)  # the last weight is the intercept

    def weights(self, at) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        at = np.append(at, len(self.z) - 1)
        x = np.append(x, 1.0).astype(np.float64)
        w = self.weights(at)
        gradient = (sigmoid(float(w @ x)) - label) * x
        step = (np.sqrt(self.n[at] + gradient**2) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += gradient - step * w
        self.n[at] += gradient**2


def sigmoid(x: float) -> float:
    return 1.0 / (1.0 + np.exp(-min(max(x, -35.0), 35.0)))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, keep) -> DataFrame:
    """(doc_id, text, label, key): documents with a label, about ``most`` of them at any size of the tables."""
    found = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & keep).groupBy(F.col("doc_id").alias("__id")).agg(F.max(label).cast("int").alias("label"))
    n = found.count()
    if n > most:
        found = found.filter(F.pmod(F.xxhash64("__id", F.lit(SEED)), F.lit(1 << 20)) < int((1 << 20) * most / n))
    # The sample is bounded by ``most`` rows of two numbers.
    return docs.select("doc_id", "text").join(F.broadcast(found), F.col("doc_id") == F.col("__id")).select("doc_id", "text", "label", F.xxhash64("doc_id", F.lit(SEED)).alias("key"))


def fit(sample: DataFrame, epochs: int = EPOCHS) -> np.ndarray:
    """Weights of the 2**BITS features and the intercept, learnt in one task over the bounded sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, model, seen = Words(), Ftrl(), []
        for b in batches:
            for text, label in zip(as_bytes(b.column("text")), b.column("label").to_pylist()):
                seen.append((*words.features(text), label))
        for _ in range(epochs):
            for example in seen:
                model.learn(*example)
        w = model.weights(slice(None)).astype("<f4")
        at = np.flatnonzero(w).astype("<i4")
        yield pa.RecordBatch.from_arrays([pa.array([at.tobytes()], pa.binary()), pa.array([w[at].tobytes()], pa.binary())], ["at", "w"])

    weights = np.zeros((1 << BITS) + 1, np.float32)
    rows = sample.select("text", "label", "key").repartition(1).sortWithinPartitions("key", "text").mapInArrow(run, "at binary, w binary").collect()
    for r in rows:
        weights[np.frombuffer(r["at"], "<i4")] = np.frombuffer(r["w"], "<f4")
    return weights


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, score) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in batches:
            out = []
            for text in as_bytes(b.column("text")):
                at, x = words.features(text)
                out.append(sigmoid(float(weights[at] @ x) + float(weights[-1])))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, score double")


def quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted); documents whose id falls in the held-out quarter teach nothing."""
    weights = fit(labelled_sample(docs, labels, "quality", sample, crc32_mod("doc_id", 4) != 2))
    return score(docs, weights).select("doc_id", (crc32_mod("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
