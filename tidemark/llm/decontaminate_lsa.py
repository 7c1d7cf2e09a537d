"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of hashed terms are counted over all passages of all documents.
2. A randomised SVD of the passages' TF-IDF matrix A runs over all passages: each task projects its rows on a random
   matrix (Y = A G) and adds up Y'Y and Y'A, which are as large as the term space, not as the corpus. From their sums
   the driver takes Q'A = R^-T Y'A with R'R = Y'Y, and its right singular vectors.
3. Passages and benchmark windows are compared by cosine in that space, scaled by the singular values.
4. A candidate is read word by word: shared words first, then the longest common subsequence (LCS) of the benchmark
   item with the words around the passage. An item counts as found if the LCS covers ``exact`` of its words, or
   ``close`` of them and its answer, the end of the item, stands there too: a paraphrase.

Passages are 24 words that begin every 8 words, so 17 successive words always lie within one. Words are ASCII letters,
digits and longer characters, lower-cased. Null and empty texts hold nothing; items of fewer than ``least`` words are
compared whole, an item without words is never found.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tidemark.llm.text_arrays import RUN as PART, add_by_term, part_sums, plain, sliced, summed_blocks, word_hashes

TERM_BITS = 14
TERMS = 1 << TERM_BITS
#: A passage is ``SPAN`` successive parts of ``PART`` words and one begins with every part.
SPAN = 3
#: Words of a window of a benchmark item; so many successive words, and one more, always lie within a passage.
WINDOW = 16
#: Power of the inverse document frequency; frequent words say little about a passage.
SHARPNESS = 4
RANK = 40
OVERSAMPLE = 8
#: Cosine from which a passage is a candidate; the second one for items of one or two windows, which have fewer chances.
COSINE, COSINE_SHORT = 0.65, 0.4
#: Shares of an item's words: found outright, or found if the answer stands there too.
EXACT, CLOSE = 0.8, 0.6
#: Share of a window's words that its passage must hold before the two are read in order.
SHARED = 0.5
#: Words at the end of an item that serve as its answer.
ANSWER = 5
#: Benchmark windows compared at a time.
WINDOWS = 2048
BLOCK_TERMS = 256


@dataclass(frozen=True)
class Space:
    """Per term its place in the latent space: idf times the right singular vectors over the singular values."""
    terms: np.ndarray


def terms_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, their terms, and where each text begins among them."""
    h, bounds = word_hashes(texts, alnum_only=True)
    return h, (h >> np.uint64(64 - TERM_BITS)).astype(np.int64), bounds


def parts_of(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and end word of each part, and its text. A text's last part may be short."""
    n = -(-np.diff(bounds) // PART)
    text = np.repeat(np.arange(len(n)), n)
    first = np.cumsum(n) - n
    start = bounds[text] + PART * (np.arange(int(n.sum())) - first[text])
    return start, np.minimum(start + PART, bounds[text + 1]), text


def spans(rows: np.ndarray, text: np.ndarray, back: bool = False) -> np.ndarray:
    """Sum of each part's row and those of the parts behind it in its passage; ``back``: of all passages a part is in."""
    out = rows.copy()
    for k in range(1, min(SPAN, len(rows))):
        same = np.flatnonzero(text[k:] == text[:-k])
        if back:
            out[same + k] += rows[same]
        else:
            out[same] += rows[same + k]
    return out


def passage_counts(term: np.ndarray, start: np.ndarray, end: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Number of passages that hold each term. An occurrence adds the passages of its part that no earlier one has reached."""
    part = np.repeat(np.arange(len(start)), end - start)
    order = np.argsort(term.astype(np.uint16), kind="stable")
    term, part = term[order], part[order]
    heads = np.flatnonzero(np.diff(text, prepend=-1))
    own = text[part]
    new = np.minimum(part - heads[np.cumsum(np.diff(text, prepend=-1) != 0) - 1][part] + 1, SPAN)
    same = np.flatnonzero((term[1:] == term[:-1]) & (own[1:] == own[:-1])) + 1
    new[same] = np.minimum(new[same], part[same] - part[same - 1])
    return np.bincount(term, new, TERMS).astype(np.int64)


def idf_of(docs: DataFrame, text_col: str) -> np.ndarray:
    """Weight of every term by its inverse document frequency, a passage counting as a document; bounded by the term space."""
    def count(batches):
        df, n = np.zeros(TERMS, np.int64), 0
        for batch in sliced(batches):
            _, term, bounds = terms_of(plain(batch, "t"))
            start, end, text = parts_of(bounds)
            if not len(start):
                continue
            df += passage_counts(term, start, end, text)
            n += len(start)
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, TERMS)), pa.array(np.append(df[used], n))], ["term", "n"])

    rows = docs.select(F.col(text_col).alias("t")).mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    df, total = np.zeros(TERMS), 0
    for term, n in rows:
        if term == TERMS:
            total = n
        else:
            df[term] = n
    return (np.log((1 + total) / (1 + df)) ** SHARPNESS).astype(np.float32)


def latent_space(docs: DataFrame, text_col: str = "text", rank: int = RANK, oversample: int = OVERSAMPLE) -> Space:
    """The latent space of all passages of ``docs``. What reaches the driver is as large as the term space."""
    idf = idf_of(docs, text_col)
    width = rank + oversample
    random = np.random.default_rng(11).standard_normal((TERMS, width)).astype(np.float32) * idf[:, None]

    def project(batches):
        gram, back, task = np.zeros((width, width)), np.zeros((TERMS, width)), 0
        for batch in sliced(batches):
            _, term, bounds = terms_of(plain(batch, "t"))
            start, end, text = parts_of(bounds)
            if not len(start):
                continue
            y = spans(part_sums(random, term, start, end), text)
            gram += y.T.astype(np.float64) @ y
            add_by_term(back, term, spans(y, text, back=True), np.repeat(np.arange(len(start)), end - start))
            task = (task * 31 + int(bounds[-1])) % 8
        back *= idf[:, None]
        parts = [gram.tobytes(), *(back[at:at + BLOCK_TERMS].tobytes() for at in range(0, TERMS, BLOCK_TERMS))]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([task] * len(parts), pa.int32()),
                                          pa.array(parts, pa.binary())], ["block", "part", "data"])

    found = {b: np.frombuffer(d, np.float64) for b, d in
             summed_blocks(docs.select(F.col(text_col).alias("t")).mapInArrow(project, "block int, part int, data binary"))}
    if not found:
        return Space(np.zeros((TERMS, rank), np.float32))
    gram = found[0].reshape(width, width)
    back = np.concatenate([found[b].reshape(-1, width) for b in range(1, TERMS // BLOCK_TERMS + 1)])
    value, vector = np.linalg.eigh(gram)
    keep = value > max(value.max(), 0.0) * 1e-10
    half_inverse = vector[:, keep] / np.sqrt(value[keep])
    inner = back @ half_inverse  # A'Q
    u, s, _ = np.linalg.svd(inner, full_matrices=False)
    u, s = u[:, :rank], s[:rank]
    good = s > 0
    out = np.zeros((TERMS, rank), np.float32)
    out[:, :int(good.sum())] = idf[:, None] * u[:, good] / s[good]
    return Space(out)


def unit_rows(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return (rows / np.where(norm > 0, norm, 1)).astype(np.float32)


@dataclass(frozen=True)
class Query:
    """A block of benchmark items: their words, and latent windows with the item and first word of each."""
    ids: list
    words: list[np.ndarray]
    latent: np.ndarray
    item: np.ndarray
    first: np.ndarray


def query_of(ids: list, texts: list[bytes], space: Space) -> Query:
    """Windows of ``WINDOW`` successive words of each item, the last one at the item's end."""
    h, term, bounds = terms_of(texts)
    words = [h[a:b] for a, b in zip(bounds, bounds[1:])]
    rows, item, first = [], [], []
    for i, (a, b) in enumerate(zip(bounds.tolist(), bounds[1:].tolist())):
        if a == b:
            continue
        last = max(a, b - WINDOW)
        for at in sorted({*range(a, last + 1, WINDOW), last}):
            rows.append(space.terms[term[at:min(at + WINDOW, b)]].sum(axis=0))
            item.append(i)
            first.append(at - a)
    latent = unit_rows(np.array(rows)) if rows else np.zeros((0, space.terms.shape[1]), np.float32)
    return Query(ids, words, latent, np.array(item, np.int64), np.array(first, np.int64))


def lcs(item: list[int], text: list[int]) -> int:
    """Length of the longest common subsequence, with one bit per word of the item."""
    places: dict[int, int] = {}
    for k, w in enumerate(item):
        places[w] = places.get(w, 0) | 1 << k
    full = (1 << len(item)) - 1
    row = full
    for w in text:
        hit = row & places.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(item) - row.bit_count()


def _verified(h, bounds, start, end, text, passage, window, query: Query, exact: float, close: float, answer: int) -> list[tuple]:
    """(text, item, LCS share, answer found) of the candidates that pass, the best one for each text and item."""
    grid = np.arange(SPAN * PART)
    at = np.minimum(start[passage][:, None] + grid, len(h) - 1)
    inside = start[passage][:, None] + grid < bounds[text[passage] + 1][:, None]
    first = query.first[window]
    size = np.fromiter(map(len, query.words), np.int64, len(query.words))[query.item[window]]
    flat = np.concatenate(query.words)
    base = np.cumsum([0, *map(len, query.words)])[query.item[window]]
    mine = flat[np.minimum((base + first)[:, None] + np.arange(WINDOW), len(flat) - 1)]
    real = first[:, None] + np.arange(WINDOW) < size[:, None]
    shared = np.zeros(len(passage), np.int64)
    for k in range(WINDOW):
        shared += real[:, k] & ((h[at] == mine[:, k:k + 1]) & inside).any(axis=1)
    good = np.flatnonzero(shared >= np.maximum(1, np.ceil(SHARED * real.sum(axis=1))))
    best: dict[tuple[int, int], tuple[float, bool]] = {}
    for c in good.tolist():
        t, i, n = int(text[passage[c]]), int(query.item[window[c]]), int(size[c])
        if best.get((t, i), (0.0, True))[0] == 1.0:
            continue
        lo = max(int(bounds[t]), int(start[passage[c]]) - n)
        hi = min(int(bounds[t + 1]), int(start[passage[c]]) + SPAN * PART + n)
        words, around = query.words[i].tolist(), h[lo:hi].tolist()
        share = max(lcs(words, around[s:s + n + max(4, n // 4)]) for s in range(0, max(1, len(around) - n + 1), max(1, n // 4))) / n
        tail = words[-answer:]
        known = any(around[s:s + len(tail)] == tail for s in range(len(around) - len(tail) + 1))
        if share >= exact or (share >= close and known):
            best[t, i] = max(best.get((t, i), (0.0, False)), (share, known))
    return [(t, i, share, known) for (t, i), (share, known) in best.items()]


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
         item_text: str = "text", rank: int = RANK, cosine: float = COSINE, cosine_short: float = COSINE_SHORT, exact: float = EXACT, close: float = CLOSE,
         answer: int = ANSWER) -> DataFrame:
    """(id, item, overlap, answer_found) for each document that holds an item.

    The benchmark is the query set: its items go to the tasks in blocks of bounded size, every block against all passages.
    """
    space = latent_space(docs, text_col, rank)
    item_kind, id_kind = benchmark.schema[item_col].dataType, docs.schema[id_col].dataType
    items = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(item_text).cast("binary").alias("t")).where("t is not null")
    blocks = max(1, math.ceil(items.count() / (WINDOWS // 8)))
    kind = T.StructType([T.StructField(id_col, id_kind), T.StructField(item_col, T.StringType()), T.StructField("overlap", T.DoubleType()), T.StructField("answer_found", T.BooleanType())])
    out = None
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).orderBy("i", "t").collect()  # a block of the benchmark
        query = query_of([r.i for r in rows], [bytes(r.t) for r in rows], space)

        few = np.bincount(query.item, minlength=len(rows))[query.item] <= 2
        least = np.where(few, cosine_short, cosine).astype(np.float32)

        def search(batches, query=query, least=least):
            for batch in sliced(batches):
                h, term, bounds = terms_of(plain(batch, "t"))
                start, end, text = parts_of(bounds)
                pairs: list[tuple] = []
                if len(start) and len(query.item):
                    latent = unit_rows(spans(part_sums(space.terms, term, start, end), text))
                    for at in range(0, len(latent), 2048):
                        p, w = np.nonzero(latent[at:at + 2048] @ query.latent.T >= least)
                        for cut in range(0, len(p), 65536):
                            pairs += _verified(h, bounds, start, end, text, p[cut:cut + 65536] + at, w[cut:cut + 65536], query, exact, close, answer)
                best: dict[tuple, tuple] = {}
                for t, i, share, known in pairs:
                    best[t, i] = max(best.get((t, i), (0.0, False)), (share, known))
                where = pa.array([t for t, _ in best], pa.int64())
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").take(where), pa.array([query.ids[i] for _, i in best], pa.string()),
                    pa.array([s for s, _ in best.values()], pa.float64()), pa.array([k for _, k in best.values()], pa.bool_())],
                    [id_col, item_col, "overlap", "answer_found"])

        narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
        part = narrow.mapInArrow(search, kind)
        out = part if out is None else out.union(part)
    return out.withColumn(item_col, F.col(item_col).cast(item_kind))


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents that hold no benchmark item.

    Documents are told apart by the digest of their text, so one without an id goes like any other, and a clean one stays even
    if it shares its id with one that goes. A null text stays.
    """
    key = next(n for n in ("_digest", *(f"_digest{i}" for i in range(len(docs.columns) + 1))) if n not in docs.columns)
    marked = docs.withColumn(key, F.md5(F.col(text_col).cast("binary")))
    held = find(marked, benchmark, key, text_col, **options).select(key).distinct()
    return marked.join(held, key, "left_anti").select(*docs.columns)
