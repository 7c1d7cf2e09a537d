"""Toxicity scores by FTRL-proximal logistic regression over hashed words, word pairs and skip-pairs.

A feature is present in a text or not: its words, its adjacent pairs, and its pairs with one or two words between. Each
coordinate has its own learning rate, and L1 keeps most weights at exactly zero, so a model is its few non-zero
weights. Null and empty texts have no feature; their score is that of the intercept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tidemark.llm.text_arrays import bounded_sample, joined, mapped, plain, with_computed, word_hashes

BITS = 20
#: Largest number of labelled rows a model is fitted on: the first ones in the order of a hash of their id.
SAMPLE = 20_000
#: Largest number of distinct features that a text of the sample has in the fit. Beyond it, those with the smallest hash are
#: learnt from, the same ones in every text; scores use all features of a text.
PER_TEXT = 1 << 14


@dataclass(frozen=True)
class Weights:
    """Non-zero weights by feature index, and the intercept."""
    index: np.ndarray
    value: np.ndarray
    bias: float
    bits: int = BITS

    def dense(self) -> np.ndarray:
        full = np.zeros(1 << self.bits, np.float32)
        full[self.index] = self.value
        return full


def features(texts: list[bytes], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature index) of every occurrence; a text's pairs never reach into the next one."""
    h, bounds = word_hashes(texts, alnum_only=True)
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
    shift = np.uint64(64 - bits)
    docs, index = [owner], [(h >> shift).astype(np.int64)]
    for gap in (1, 2, 3):
        same = owner[:-gap] == owner[gap:] if len(h) > gap else np.empty(0, bool)
        pair = joined(h[:-gap], h[gap:], gap)[same] if len(h) > gap else np.empty(0, np.uint64)
        docs.append(owner[:-gap][same] if len(h) > gap else np.empty(0, np.int64))
        index.append((pair >> shift).astype(np.int64))
    return np.concatenate(docs), np.concatenate(index)


def bounded_features(key: np.ndarray, bits: int, most: int = PER_TEXT) -> np.ndarray:
    """``key`` (text number and feature in one number, ascending) with at most ``most`` features a text."""
    text, start, count = np.unique(key >> bits, return_index=True, return_counts=True)
    if not len(text) or count.max() <= most:
        return key
    order = (key & ((1 << bits) - 1)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    keep = np.ones(len(key), bool)
    for s, c in zip(start[count > most], count[count > most]):
        keep[s + np.argsort(order[s:s + c], kind="stable")[most:]] = False
    return key[keep]


def fit(rows: list[tuple[np.ndarray, int]], bits: int = BITS, alpha: float = 2.0, beta: float = 1.0, l1: float = 6.0,
        l2: float = 0.1, epochs: int = 6) -> Weights:
    """FTRL-proximal over (distinct feature indices, label) pairs in the given order."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    bias_z = bias_n = 0.0

    def weight(z, n):
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(epochs):
        for index, label in rows:
            w = weight(z[index], n[index])
            bias = -bias_z / ((beta + bias_n ** 0.5) / alpha)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - label
            rate = (np.sqrt(n[index] + g * g) - np.sqrt(n[index])) / alpha
            z[index] += g - rate * w
            n[index] += g * g
            bias_z += g - ((bias_n + g * g) ** 0.5 - bias_n ** 0.5) / alpha * bias
            bias_n += g * g
    used = np.flatnonzero(np.abs(z) > l1)
    return Weights(used, weight(z[used], n[used]).astype(np.float32), float(-bias_z / ((beta + bias_n ** 0.5) / alpha)), bits)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          sample: int = SAMPLE, bits: int = BITS) -> Weights:
    """A model of the documents that ``labels`` marks 0 or 1; at most ``sample`` labels are used, chosen by a hash.

    Texts become feature indices where they lie; only those of the sample reach the one task that fits, at most ``PER_TEXT`` of
    a text. A pair of id and label counts once however often it occurs: of several documents with one id, one with the
    smallest hash of its features is learnt from. No usable row gives a model that scores 0.5 everywhere.
    """
    def hashed(batch: pa.RecordBatch) -> pa.RecordBatch:
        docs, index = features(plain(batch, "t"), bits)
        key = bounded_features(np.unique(docs << bits | index), bits)
        cut = np.searchsorted(key >> bits, np.arange(batch.num_rows + 1))
        lists = pa.ListArray.from_arrays(cut.astype(np.int32), pa.array((key & ((1 << bits) - 1)).astype(np.int32)))
        return pa.RecordBatch.from_arrays([batch.column("o"), batch.column("y"), lists], ["o", "y", "x"])

    def solve(batches):
        rows = []
        for batch in batches:
            lists = batch.column("x")
            rows += [(lists[i].values.to_numpy(), y) for i, y in enumerate(batch.column("y").to_pylist())]
        model = fit(rows, bits)
        yield pa.RecordBatch.from_arrays([pa.array([model.index.tolist()], pa.list_(pa.int64())),
                                          pa.array([model.value.tolist()], pa.list_(pa.float32())), pa.array([model.bias])], ["i", "v", "b"])

    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    chosen = F.broadcast(bounded_sample(marked.distinct(), ["id", "y"], sample))  # bounded by ``sample``
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).join(chosen, "id")
    vectors = rows.select(F.xxhash64(F.col("id").cast("string")).alias("o"), "y", "t").mapInArrow(mapped(hashed), "o long, y int, x array<int>")
    once = vectors.groupBy("o", "y").agg(F.min_by("x", F.xxhash64("x")).alias("x"))
    found = once.repartition(1).sortWithinPartitions("o", "y", "x").mapInArrow(solve, "i array<long>, v array<float>, b double").first()
    if found is None:
        return Weights(np.empty(0, np.int64), np.empty(0, np.float32), 0.0, bits)
    return Weights(np.array(found.i, np.int64), np.array(found.v, np.float32), found.b, bits)


def score(docs: DataFrame, model: Weights, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """``docs`` with the score of the whole text, 0 to 1, in ``out``."""
    dense, used = model.dense(), np.zeros(1 << model.bits, bool)
    used[model.index] = True
    bias, bits = model.bias, model.bits

    def step(texts: list[bytes]) -> pa.Array:
        docs, index = features(texts, bits)
        hit = used[index]
        key = np.unique(docs[hit] << bits | index[hit])
        total = np.bincount(key >> bits, dense[key & ((1 << bits) - 1)], len(texts)) + bias
        return pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))

    return with_computed(docs, text_col, out, T.DoubleType(), step)
