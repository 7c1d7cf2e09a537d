"""Masked pseudo-likelihood: a bidirectional window network predicts every word from the words on both its sides.

The hidden layer adds one learnt row per neighbour and its place; the output is a softmax over word classes, then over the words of
the class. A document's score is the sum of the log-probabilities of its words. The vocabulary is the most frequent words of all
documents; other words share hashed buckets, and ``spelled`` multiplies a bucket's probability by that of the word in it, from a table
of the counts of all words that is joined and never gathered. Training starts from a bounded sample of documents, then every task goes over all its
documents from that model, and the tasks' weights are averaged by words seen: what is gathered grows with the corpus.

Words are runs of anything but blanks, ASCII letters lower-cased. Null and empty texts have no word: score 0, no mean.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tidemark.llm.text_arrays import bounded_sample, plain, sliced, summed_blocks, with_computed, word_hashes
from tidemark.session import stored

CLASSES, PER_CLASS, BUCKETS = 32, 32, 64
WORDS = CLASSES * PER_CLASS
#: Places of the neighbours that predict a word.
PLACES = (-2, -1, 1, 2)
HIDDEN = 24
BATCH = 8192
#: Documents of the first model, chosen by a hash, and passes over them.
SEED_DOCS, SEED_PASSES = 256, 3
RATE = 0.1
BLOCK = 1 << 14


@dataclass
class Network:
    """``near`` holds a row per place and word (the last word is "no neighbour"), the rest are the two softmax layers."""
    near: np.ndarray
    to_class: np.ndarray
    to_word: np.ndarray

    @staticmethod
    def fresh() -> Network:
        rng = np.random.default_rng(5)
        return Network(rng.normal(0, 0.1, (len(PLACES), WORDS + 1, HIDDEN)).astype(np.float32),
                       np.zeros((HIDDEN + 1, CLASSES), np.float32), np.zeros((CLASSES, HIDDEN + 1, PER_CLASS), np.float32))

    def flat(self) -> np.ndarray:
        return np.concatenate([self.near.ravel(), self.to_class.ravel(), self.to_word.ravel()])

    @staticmethod
    def of(flat: np.ndarray) -> Network:
        new, at, out = Network.fresh(), 0, []
        for part in (new.near, new.to_class, new.to_word):
            out.append(flat[at:at + part.size].reshape(part.shape).astype(np.float32))
            at += part.size
        return Network(*out)


def contexts(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The neighbours of every word, by place; beyond a text's ends they are the word ``WORDS``."""
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at = np.arange(len(words))
    out = np.full((len(PLACES), len(words)), WORDS)
    for k, place in enumerate(PLACES):
        other = at + place
        inside = (other >= bounds[text]) & (other < bounds[text + 1])
        out[k, inside] = words[other[inside]]
    return out


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def hidden(net: Network, near: np.ndarray) -> np.ndarray:
    """Hidden layer with a constant last unit."""
    h = np.ones((near.shape[1], HIDDEN + 1), np.float32)
    total = net.near[0][near[0]]
    for k in range(1, len(PLACES)):
        total += net.near[k][near[k]]
    np.tanh(total, out=h[:, :-1])
    return h


def log_probs(net: Network, words: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Log-probability of every word given its neighbours."""
    out = np.empty(len(words))
    for lo in range(0, len(words), BATCH):
        some = words[lo:lo + BATCH]
        h = hidden(net, near[:, lo:lo + BATCH])
        kind, inner = some // PER_CLASS, some % PER_CLASS
        value = _log_softmax(h @ net.to_class)[np.arange(len(some)), kind]
        order = np.argsort(kind, kind="stable")
        cut = np.searchsorted(kind[order], np.arange(CLASSES + 1))
        for c in range(CLASSES):
            rows = order[cut[c]:cut[c + 1]]
            if len(rows):
                value[rows] += _log_softmax(h[rows] @ net.to_word[c])[np.arange(len(rows)), inner[rows]]
        out[lo:lo + BATCH] = value
    return out


class Trainer:
    """AdaGrad on the negative log-probabilities, in batches of words."""

    def __init__(self, net: Network):
        self.net = Network(net.near.copy(), net.to_class.copy(), net.to_word.copy())
        self.seen = [np.full_like(p, 1e-6) for p in (net.near, net.to_class, net.to_word)]

    def _move(self, value: np.ndarray, seen: np.ndarray, grad: np.ndarray) -> None:
        seen += grad * grad
        value -= RATE * grad / np.sqrt(seen)

    def learn(self, words: np.ndarray, near: np.ndarray) -> None:
        net = self.net
        for lo in range(0, len(words), BATCH):
            some, ctx = words[lo:lo + BATCH], near[:, lo:lo + BATCH]
            n = len(some)
            h = hidden(net, ctx)
            kind, inner = some // PER_CLASS, some % PER_CLASS
            p = np.exp(_log_softmax(h @ net.to_class))
            p[np.arange(n), kind] -= 1
            back = p @ net.to_class.T
            order = np.argsort(kind, kind="stable")
            cut = np.searchsorted(kind[order], np.arange(CLASSES + 1))
            grad_word = np.zeros_like(net.to_word)
            for c in range(CLASSES):
                rows = order[cut[c]:cut[c + 1]]
                if len(rows):
                    q = np.exp(_log_softmax(h[rows] @ net.to_word[c]))
                    q[np.arange(len(rows)), inner[rows]] -= 1
                    grad_word[c] = h[rows].T @ q
                    back[rows] += q @ net.to_word[c].T
            inward = (back * (1 - h * h))[:, :-1] / n
            self._move(net.to_class, self.seen[1], h.T @ p / n)
            self._move(net.to_word, self.seen[2], grad_word / n)
            for k in range(len(PLACES)):
                sort = np.argsort(ctx[k].astype(np.uint16), kind="stable")
                of = ctx[k][sort]
                heads = np.flatnonzero(np.diff(of, prepend=-1))
                used = of[heads]
                grad = np.add.reduceat(inward[sort], heads, axis=0)
                self.seen[0][k, used] += grad * grad
                net.near[k, used] -= RATE * grad / np.sqrt(self.seen[0][k, used])


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n): the hash and count of every word of all documents."""
    def count(batches):
        keys, counts, held = [], [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            key, at = np.unique(np.concatenate(keys), return_inverse=True)
            return key, np.bincount(at, np.concatenate(counts), len(key)).astype(np.int64)

        def rows() -> pa.RecordBatch:
            key, n = merged()
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["word", "n"])

        for batch in sliced(batches):
            key, n = np.unique(word_hashes(plain(batch, "t"))[0], return_counts=True)
            keys.append(key)
            counts.append(n)
            held += len(key)
            if held > 1 << 20:
                yield rows()
                keys, counts, held = [], [], 0
        if held:
            yield rows()

    return docs.select(F.col(text_col).alias("t")).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame, text_col: str = "text", size: int = WORDS - BUCKETS, counts: DataFrame | None = None) -> np.ndarray:
    """Hashes of the most frequent words of all documents, most frequent first; equal counts by hash."""
    top = (word_counts(docs, text_col) if counts is None else counts).orderBy(F.desc("n"), "word").limit(size).collect()
    return np.array([r.word for r in top], np.int64).view(np.uint64)


def word_numbers(hashes: np.ndarray, vocab: np.ndarray) -> np.ndarray:
    """Number of every word: its place in the vocabulary, or a bucket at the end of the last classes."""
    other = WORDS - BUCKETS + (hashes >> np.uint64(57)).astype(np.int64) % BUCKETS
    if not len(vocab):
        return other
    order = np.argsort(vocab)
    at = np.minimum(np.searchsorted(vocab[order], hashes), len(vocab) - 1)
    return np.where(vocab[order][at] == hashes, order[at], other)


def read(texts: list[bytes], vocab: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, their neighbours, and where each text begins."""
    h, bounds = word_hashes(texts)
    words = word_numbers(h, vocab)
    return words, contexts(words, bounds), bounds


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: DataFrame | None = None) -> tuple[np.ndarray, Network]:
    """Vocabulary and network of ``docs``, whose ``word_counts`` may be given."""
    vocab = vocabulary(docs, text_col, counts=counts)
    chosen = F.broadcast(bounded_sample(docs.select(F.col(id_col).alias("id")).where("id is not null"), ["id"], SEED_DOCS).distinct())
    seed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).join(chosen, "id").select(
        F.xxhash64(F.col("id").cast("string")).alias("o"), "t")

    def first(batches):
        trainer, parts = Trainer(Network.fresh()), []
        for batch in sliced(batches):
            parts.append(read(plain(batch, "t"), vocab)[:2])
        for _ in range(SEED_PASSES):
            for words, near in parts:
                trainer.learn(words, near)
        yield pa.RecordBatch.from_arrays([pa.array([trainer.net.flat().tobytes()])], ["net"])

    row = seed.repartition(1).sortWithinPartitions("o", "t").mapInArrow(first, "net binary").first()
    start = Network.of(np.frombuffer(row.net, np.float32)) if row is not None else Network.fresh()

    def local(batches):
        trainer, n = Trainer(start), 0
        for batch in sliced(batches):
            words, near, _ = read(plain(batch, "t"), vocab)
            trainer.learn(words, near)
            n += len(words)
        if n:
            data = trainer.net.flat().astype(np.float64) * n
            parts = [np.array([n], np.float64).tobytes(), *(data[at:at + BLOCK].tobytes() for at in range(0, len(data), BLOCK))]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([n % 8] * len(parts), pa.int32()),
                                              pa.array(parts, pa.binary())], ["block", "part", "data"])

    sums = {b: np.frombuffer(d, np.float64) for b, d in
            summed_blocks(docs.select(F.col(text_col).alias("t")).mapInArrow(local, "block int, part int, data binary"))}
    if not sums:
        return vocab, start
    n = sums.pop(0)[0]
    return vocab, Network.of(np.concatenate([sums[b] for b in sorted(sums)]) / n)


def score(docs: DataFrame, vocab: np.ndarray, net: Network, text_col: str = "text", out: str = "pll") -> DataFrame:
    """``docs`` with a struct: ``words``, ``log_prob`` (the sum over all words) and ``mean`` (null without words)."""
    def step(texts: list[bytes]) -> pa.Array:
        words, near, bounds = read(texts, vocab)
        value = np.concatenate(([0.0], np.cumsum(log_probs(net, words, near))))
        n = np.diff(bounds)
        total = value[bounds[1:]] - value[bounds[:-1]]
        mean = pa.array(total / np.maximum(n, 1), mask=n == 0)
        return pa.StructArray.from_arrays([pa.array(n), pa.array(total), mean], ["words", "log_prob", "mean"])

    kind = T.StructType([T.StructField("words", T.LongType()), T.StructField("log_prob", T.DoubleType()), T.StructField("mean", T.DoubleType())])
    return with_computed(docs, text_col, out, kind, step)


def spelled(scored: DataFrame, docs: DataFrame, vocab: np.ndarray, text_col: str = "text", out: str = "pll",
            counts: DataFrame | None = None) -> DataFrame:
    """``scored`` with the scores of words in place of those of their buckets, by the word counts of ``docs``, which may be given.

    A word seen n times has n / (N + 1) of its bucket of N words, all unseen words of a bucket together the rest. Only the
    words of each text go through the join, the sums per text come back; the 64 bucket totals are all that the driver sees.
    """
    known = np.sort(vocab)

    def rare(hashes: np.ndarray) -> np.ndarray:
        if not len(known):
            return np.ones(len(hashes), bool)
        return known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] != hashes

    def listed(batches):
        for batch in sliced(batches):
            hashes, bounds = word_hashes(plain(batch, "t"))
            text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            keep = rare(hashes)
            hashes, text = hashes[keep], text[keep]
            order = np.lexsort((hashes, text))
            hashes, text = hashes[order], text[order]
            heads = np.flatnonzero((np.diff(hashes, prepend=np.uint64(0)) != 0) | (np.diff(text, prepend=-1) != 0))
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(text[heads])), pa.array(hashes[heads].view(np.int64)),
                                              pa.array(np.diff(heads, append=len(hashes)))], ["key", "word", "times"])

    bucket = F.shiftrightunsigned("word", 57) % BUCKETS
    counts = stored((word_counts(docs, text_col) if counts is None else counts).join(F.broadcast(  # the vocabulary: at most WORDS rows
        docs.sparkSession.createDataFrame([(int(w),) for w in vocab.view(np.int64)], "word long")), "word", "left_anti"))
    totals = [0] * BUCKETS
    for row in counts.groupBy(bucket.alias("b")).agg(F.sum("n").alias("n")).collect():
        totals[row.b] = row.n
    total = F.element_at(F.array(*[F.lit(float(np.log(n + 1))) for n in totals]), (bucket + 1).cast("int"))
    keyed = scored.withColumn("__key", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    uses = keyed.select(F.col("__key").alias("key"), F.col(text_col).alias("t")).mapInArrow(listed, "key long, word long, times long")
    sums = uses.join(counts, "word", "left").groupBy("key").agg(
        F.sum(F.col("times") * (F.log(F.coalesce("n", F.lit(1)).cast("double")) - total)).alias("more"))
    copies = keyed.groupBy("__key").agg(F.count(F.lit(1)).alias("__copies"))
    more = sums.join(copies, F.col("key") == F.col("__key")).select("__key", (F.col("more") / F.col("__copies")).alias("__more"))
    words, value = F.col(f"{out}.words"), F.col(f"{out}.log_prob") + F.coalesce("__more", F.lit(0.0))
    new = F.struct(words.alias("words"), value.alias("log_prob"), F.when(words > 0, value / words).alias("mean"))
    return keyed.join(more, "__key", "left").withColumn(out, new).select(*scored.columns)
