"""Words and n-grams of many texts as NumPy arrays of hashes, for use inside Arrow tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

PIECE = 1 << 16
ROWS = 256
SLICE = 1 << 20
SPACE = frozenset(b" \t\n\x0b\x0c\r")


def fold_of(id_col: str, folds: int) -> Column:
    """The fold of a row: crc32 of its id written as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def bounded_sample(rows: DataFrame, key: list[str], size: int) -> DataFrame:
    """``size`` rows at most, those with the smallest hash of ``key``; all of them, if there are no more.

    A first cut by the hash, at a share computed from the row count, leaves little more than ``size`` rows to order.
    """
    n = rows.count()
    picked = rows.withColumn("__o", F.xxhash64(*[F.col(k).cast("string") for k in key]))
    if n > size:
        share = min(1.0, (size + 6 * size ** 0.5 + 36) / n)
        picked = picked.where(F.pmod("__o", F.lit(1 << 40)) < int(share * (1 << 40)))
    return picked.orderBy(F.pmod("__o", F.lit(1 << 40)), "__o", *key).limit(size).drop("__o")


def byte_mask(alnum_only: bool) -> np.ndarray:
    """Which bytes belong to words: all but ASCII blanks, or only ASCII letters, digits and bytes of longer characters."""
    keep = np.array([b not in SPACE for b in range(256)])
    if alnum_only:
        keep &= np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
    return keep


def _random_table(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, n, dtype=np.uint64) | np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def joined(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    """Hash of ordered pairs of hashes."""
    return mixed(a * np.uint64(0x9E3779B97F4A7C15) + b + np.uint64(salt))


BASE = 0xD6E8FEB86659FD93


def _powers(base: int, n: int) -> np.ndarray:
    factors = np.full(n, base, np.uint64)
    factors[0] = 1
    return np.cumprod(factors)


def _hash_bytes(buf: np.ndarray, table: np.ndarray, powers: np.ndarray, undo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word of a buffer that ends in a blank: sums of byte values times powers of the place.

    Blanks have the value 0, so a word's sum may run to the next word; the inverse power of its first place takes
    its position out again.
    """
    value = table[buf]
    inside = value != 0
    starts = np.flatnonzero(inside[1:] > inside[:-1]) + 1
    if inside[0]:
        starts = np.concatenate(([0], starts))
    if not len(starts):
        return np.empty(0, np.uint64), starts
    value *= powers[:len(buf)]
    return mixed(np.add.reduceat(value, starts) * undo[starts]), starts


def word_hashes(texts: list[bytes], alnum_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of ASCII-lower-cased texts, and where each text begins in them (one more entry at the end).

    The hash of a word depends on its bytes only. Texts are joined into small pieces; a longer
    one is cut at blanks, so memory stays with the longest word and the number of words.
    """
    table = np.where(byte_mask(alnum_only), _random_table(7, 256), np.uint64(0))
    powers, undo = _powers(BASE, 2 * PIECE), _powers(pow(BASE, -1, 1 << 64), 2 * PIECE)
    out: list[np.ndarray] = []
    counts = np.zeros(len(texts), np.int64)
    todo: list[tuple[int, bytes]] = []
    size = 0

    def flush() -> None:
        if not todo:
            return
        nonlocal powers, undo
        buf = np.frombuffer(b" ".join([t for _, t in todo]).lower() + b" ", np.uint8)
        if len(buf) > len(powers):
            powers, undo = _powers(BASE, len(buf)), _powers(pow(BASE, -1, 1 << 64), len(buf))
        h, starts = _hash_bytes(buf, table, powers, undo)
        bounds = np.cumsum([0, *(len(t) + 1 for _, t in todo)])
        per = np.diff(np.searchsorted(starts, bounds))
        np.add.at(counts, [i for i, _ in todo], per)
        out.append(h)
        todo.clear()

    for i, text in enumerate(texts):
        at = 0
        while len(text) - at > PIECE:
            cut = max(text.rfind(b, at + 1, at + PIECE) for b in (b" ", b"\n", b"\t"))
            cut = cut if cut > at else next((j for j in range(at + PIECE, len(text)) if text[j] in SPACE), len(text))
            todo.append((i, text[at:cut]))
            flush()
            size, at = 0, cut
        todo.append((i, text[at:]))
        size += len(text) - at + 1
        if size > PIECE:
            flush()
            size = 0
    flush()
    return (np.concatenate(out) if out else np.empty(0, np.uint64)), np.concatenate(([0], np.cumsum(counts)))


def plain(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The texts of a column as UTF-8; null counts as the empty text."""
    return [b"" if v is None else v for v in batch.column(column).cast(pa.binary()).to_pylist()]


def cuts(values: pa.Array, rows: int = ROWS, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """(first, number) of runs of at most ``rows`` texts and about ``size`` bytes; a longer text is a run of its own."""
    lens = np.nan_to_num(pc.binary_length(values).to_numpy(zero_copy_only=False).astype(np.float64))
    total = np.concatenate(([0], np.cumsum(lens)))
    at = 0
    while at < len(lens):
        stop = min(at + rows, max(at + 1, int(np.searchsorted(total, total[at] + size, "right")) - 1))
        yield at, stop - at
        at = stop


def sliced(batches: Iterator[pa.RecordBatch], column: str = "t", rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that the texts of each part, and the arrays made of them, stay small."""
    for batch in batches:
        for at, n in cuts(batch.column(column), rows):
            yield batch.slice(at, n)


def mapped(step: Callable[[pa.RecordBatch], pa.RecordBatch], column: str = "t"):
    """A function for ``mapInArrow`` that applies ``step`` to small slices, cut by the texts in ``column``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, column):
            yield step(part)
    return run


def with_computed(docs: DataFrame, text_col: str, out: str, kind: T.DataType, step: Callable, per_task: bool = False) -> DataFrame:
    """``docs`` plus a column computed from whole texts, a few rows at a time; an old column ``out`` is replaced.

    ``step`` turns a list of UTF-8 texts into an Arrow array; with ``per_task`` it is called once per task and returns such a function.
    """
    @F.arrow_udf(returnType=kind)
    def compute(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        run = step() if per_task else step
        for texts in batches:
            values = texts.cast(pa.binary())
            parts = [run([b"" if v is None else v for v in values.slice(at, n).to_pylist()]) for at, n in cuts(values)]
            yield pa.concat_arrays(parts) if parts else run([])

    return docs.withColumn(out, compute(F.col(text_col)))


def summed_blocks(blocks: DataFrame) -> list:
    """(block, data) with the sum of the float64 arrays of each block; added up by part first, so no task reads those of all tasks."""
    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for raw in batch.column("data").to_pylist():
                part = np.frombuffer(raw, np.float64)
                total = part.copy() if total is None else total + part
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([0], pa.int32()), pa.array([total.tobytes()])],
                                         ["block", "part", "data"])

    kind = "block int, part int, data binary"
    return blocks.groupBy("block", "part").applyInArrow(add, kind).groupBy("block").applyInArrow(add, kind).select("block", "data").collect()


#: Rows that are added up one after the other, for all sums at once.
RUN = 8


def part_sums(table: np.ndarray, term: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Per part the sum of its words' rows of ``table``: word by word of all parts, some thousand parts at a time."""
    out = np.zeros((len(start), table.shape[1]), table.dtype)
    for at in range(0, len(start), 1024):
        first, stop, some = start[at:at + 1024], end[at:at + 1024], out[at:at + 1024]
        full = bool((stop - first == RUN).all())
        for k in range(RUN):
            if full:
                some += table[term[first + k]]
            else:
                real = np.flatnonzero(first + k < stop)
                some[real] += table[term[first[real] + k]]
    return out


def add_by_term(out: np.ndarray, term: np.ndarray, rows: np.ndarray, row: np.ndarray) -> None:
    """Add rows[row[k]] to out[term[k]] for every word k: in runs of up to ``RUN`` words of one term, then run by run."""
    for lo in range(0, len(term), 1 << 16):
        order = np.argsort(term[lo:lo + (1 << 16)].astype(np.uint16), kind="stable") + lo
        of, at = term[order], row[order]
        heads = np.flatnonzero(np.diff(of, prepend=-1))
        size = np.diff(np.append(heads, len(of)))
        n = -(-size // RUN)
        first = np.repeat(heads, n) + RUN * (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))
        stop = np.minimum(first + RUN, np.repeat(heads + size, n))
        sums = part_sums(rows, at, first, stop)
        out[of[heads]] += np.add.reduceat(sums, np.cumsum(n) - n, axis=0)
