"""Language identification with error-correcting output codes over byte n-grams.

Each language has a codeword. One binary classifier per bit is learnt over the frequencies of hashed 2- and 3-grams of
the lower-cased letters; a text gets the language whose codeword costs least, each bit's logistic loss weighted by how
often its classifier was right. Texts without any letter, empty or null, are ``und`` with score 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tidemark.llm.text_arrays import bounded_sample, mapped, plain, with_computed

BITS = 14
UNKNOWN = "und"
#: Largest number of labelled rows the classifiers are fitted on: those with the smallest hash of their id.
SAMPLE = 8_000
#: Largest number of distinct n-grams, the most frequent ones, that a text of the sample has in the fit; predictions use all.
PER_TEXT = 1 << 12
#: Numbers held at once while codewords are compared.
CELLS = 1 << 23
LETTERS_ONLY = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


@dataclass(frozen=True)
class Codes:
    """Languages, their codewords of +1 and -1, a weight per n-gram and bit, intercepts, and the bits' weights."""
    langs: tuple[str, ...]
    words: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray


def codewords(k: int) -> np.ndarray:
    """k codewords: all distinct two-way splits up to 6 languages, else random ones of 15 bits per doubling."""
    if k < 2:
        return np.zeros((k, 0))
    if k <= 6:
        bits = [[1 if c == 0 else (1 if (s >> (c - 1)) & 1 else -1) for c in range(k)] for s in range((1 << (k - 1)) - 1)]
        return np.array(bits, np.float64).T
    n = 15 * int(np.ceil(np.log2(k)))
    return np.where(np.random.default_rng(k).random((k, n)) < 0.5, -1.0, 1.0)


def grams(texts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Hashed 2-grams and 3-grams by the byte they begin at, and the first and end place of each text."""
    parts = [b" " + b" ".join(t.decode("utf-8", "replace").lower().encode().translate(LETTERS_ONLY).split()) + b"  " for t in texts]
    buf = np.frombuffer(b"".join(parts) + b"  ", np.uint8).astype(np.uint32)
    ends = np.cumsum([len(p) for p in parts])
    starts = ends - [len(p) for p in parts]
    two = buf[:-1] | buf[1:] << np.uint32(8)
    three = two[:-1] | buf[2:] << np.uint32(16)
    shift = np.uint32(32 - BITS)
    return [(g * np.uint32(0x9E3779B1) + np.uint32(salt)) * np.uint32(0x85EBCA6B) >> shift
            for salt, g in ((1, two[:-1]), (2, three))], starts, ends - 2


def means(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mean of each run of values; runs do not touch and none is empty."""
    return np.add.reduceat(values, np.stack([starts, ends], 1).ravel())[::2] / (ends - starts)


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], langs: list[str], epochs: int = 4, rate: float = 0.5) -> Codes:
    """AdaGrad on the logistic loss of every bit, over (gram, frequency, language number) rows."""
    words = codewords(len(langs))
    n = words.shape[1]
    w, seen = np.zeros((1 << BITS, n)), np.full((1 << BITS, n), 1e-8)
    bias, bias_seen = np.zeros(n), np.full(n, 1e-8)
    right, total = np.ones(n), 2.0
    for epoch in range(epochs):
        for index, freq, lang in rows:
            want = words[lang]
            margin = freq @ w[index] + bias
            pull = want / (1 + np.exp(np.clip(want * margin, -35, 35)))
            g = freq[:, None] * pull
            seen[index] += g * g
            w[index] += rate * g / np.sqrt(seen[index])
            bias_seen += pull * pull
            bias += 0.1 * rate * pull / np.sqrt(bias_seen)
            if epoch == epochs - 1:
                right, total = right + (want * margin > 0), total + 1
    return Codes(tuple(langs), words, w.astype(np.float32), bias, np.clip(2 * right / total - 1, 0.01, 1))


def train(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Codes:
    """Codes of the languages of rows whose language is not null; at most ``sample`` pairs of id and language are used, chosen by a hash.

    A pair counts once: of several documents with one id and language, one with the smallest hash of its grams is learnt from, and
    of a text at most ``PER_TEXT`` distinct grams. Languages are those of the sample, so a column of stray values names no more than it holds.
    """
    named = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang")).where("lang is not null and id is not null").distinct()
    drawn = bounded_sample(named, ["id", "lang"], sample).toPandas()  # bounded by ``sample``
    langs = sorted(drawn["lang"].unique().tolist())
    chosen = F.broadcast(docs.sparkSession.createDataFrame(drawn, named.schema))

    def counted(batch: pa.RecordBatch) -> pa.RecordBatch:
        (two, three), starts, ends = grams(plain(batch, "t"))
        index, freq = [], []
        for s, e in zip(starts, ends):
            key, n = np.unique(np.concatenate([two[s:e], three[s:e]]), return_counts=True)
            if len(key) > PER_TEXT:
                often = np.sort(np.argsort(-n, kind="stable")[:PER_TEXT])
                key, n = key[often], n[often]
            index.append(key.astype(np.int32))
            freq.append((n / max(e - s, 1)).astype(np.float32))
        return pa.RecordBatch.from_arrays([batch.column("o"), batch.column("lang"), pa.array(index, pa.list_(pa.int32())),
                                           pa.array(freq, pa.list_(pa.float32()))], ["o", "lang", "i", "f"])

    def solve(batches):
        rows = []
        for b in batches:
            i, f = b.column("i"), b.column("f")
            rows += [(i[r].values.to_numpy(), f[r].values.to_numpy(), langs.index(lang)) for r, lang in enumerate(b.column("lang").to_pylist())]
        m = fit(rows, langs)
        yield pa.RecordBatch.from_arrays([pa.array([m.weights.tobytes()]), pa.array([m.bias.tobytes()]), pa.array([m.trust.tobytes()])], ["w", "b", "t"])

    rows = (docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("t")).join(chosen, ["id", "lang"])
            .select(F.xxhash64(F.col("id").cast("string"), "lang").alias("o"), "lang", "t"))
    vectors = rows.mapInArrow(mapped(counted), "o long, lang string, i array<int>, f array<float>")
    once = vectors.groupBy("o", "lang").agg(F.min_by(F.struct("i", "f"), F.xxhash64("i", "f")).alias("x")).select("o", "lang", "x.i", "x.f")
    found = once.repartition(1).sortWithinPartitions("o", "lang").mapInArrow(solve, "w binary, b binary, t binary").first()
    words = codewords(len(langs))
    if found is None:
        return Codes(tuple(langs), words, np.zeros((1 << BITS, words.shape[1]), np.float32), np.zeros(words.shape[1]), np.ones(words.shape[1]))
    return Codes(tuple(langs), words, np.frombuffer(found.w, np.float32).reshape(1 << BITS, words.shape[1]), np.frombuffer(found.b), np.frombuffer(found.t))


def decoded(codes: Codes, texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and whether it is ambiguous, for each text."""
    n = len(texts)
    lettered = np.array([any(map(str.isalpha, t.decode("utf-8", "replace"))) for t in texts], bool)
    if not n or not codes.langs:
        return [UNKNOWN] * n, np.zeros(n), np.zeros(n, bool)
    both, starts, ends = grams(texts)
    columns = np.ascontiguousarray(codes.weights.T)
    margin = np.zeros((n, len(columns)))
    for b, column in enumerate(columns):
        margin[:, b] = sum(means(column[g], starts, ends) for g in both) + codes.bias[b]
    step = max(1, CELLS // max(1, codes.words.size))  # texts at once, so that many languages need no more memory
    loss = np.concatenate([np.einsum("nkb,b->nk", np.logaddexp(0, -margin[i:i + step, None, :] * codes.words[None]), codes.trust)
                           for i in range(0, n, step)])
    odds = np.exp(loss.min(axis=1, keepdims=True) - loss)
    share = odds / odds.sum(axis=1, keepdims=True)
    best = loss.argmin(axis=1)
    score = np.where(lettered, share[np.arange(n), best], 0.0)
    langs = [codes.langs[b] if ok else UNKNOWN for b, ok in zip(best, lettered)]
    return langs, score, lettered & (score < 0.5)


def identify(docs: DataFrame, codes: Codes, text_col: str = "text", out: str = "language") -> DataFrame:
    """``docs`` with a struct of ``lang``, ``score`` (0 to 1) and ``ambiguous``: no language has half of the odds."""
    def step(texts: list[bytes]) -> pa.Array:
        langs, score, unsure = decoded(codes, texts)
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())],
                                          ["lang", "score", "ambiguous"])

    kind = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])
    return with_computed(docs, text_col, out, kind, step)
