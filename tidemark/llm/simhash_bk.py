"""Near-duplicates by SimHash: fingerprints, links within a Hamming radius found by BK-trees, components.

Texts: ASCII letters lower-cased, words are runs of anything but blanks, shingles are joined by one blank. A text
with fewer words than a shingle is one shingle; without words, or null, its fingerprint is zero. Ids that are null,
repeated rows and extra columns are kept out of the search: the search works on distinct fingerprints only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.llm.components import components
from tidemark.llm.text_arrays import mapped, plain
from tidemark.session import stored

BITS = 64
SEED = 42
#: Largest number of fingerprints in one tree; a larger shard is searched in pairs of chunks of half that size.
TREE = 2048


def fingerprint(text: bytes, width: int = 3) -> int:
    """SimHash of one text: a bit is set if it is set in more than half of the shingles' XXH64."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    line = b" ".join(words)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    starts = (ends - lens)[:len(words) - width + 1].tolist()
    digest = xxhash.xxh64_digest
    set_bits, n = np.zeros(BITS, np.int64), len(starts)
    stops = ends[width - 1:].tolist()
    for at in range(0, n, 1 << 14):
        raw = b"".join([digest(line[s:e], SEED) for s, e in zip(starts[at:at + (1 << 14)], stops[at:at + (1 << 14)])])
        set_bits += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp) per row, ``fp`` as a signed long."""
    kind = docs.schema[id_col].dataType

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t, width) for t in plain(batch, "t")], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fps.view(np.int64))], ["id", "fp"])

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return narrow.mapInArrow(mapped(step), T.StructType([
        T.StructField("id", kind), T.StructField("fp", T.LongType())])).withColumnRenamed("id", id_col)


class BKForest:
    """Many BK-trees as arrays. The children of a node are keyed by their Hamming distance to it."""

    def __init__(self, values: np.ndarray, tree: np.ndarray):
        """``values`` are unsigned 64-bit, distinct within a tree; ``tree`` numbers their trees from 0, ascending."""
        n = len(values)
        self.values = values
        first = np.flatnonzero(np.diff(tree, prepend=-1))
        self.roots = first
        child_parent, child_key, child_node = [], [], []
        rest = np.setdiff1d(np.arange(n), first, assume_unique=True)
        at = first[tree[rest]]
        while len(rest):
            key = np.bitwise_count(values[rest] ^ values[at]).astype(np.int64)
            order = np.lexsort((rest, key, at))
            rest, at, key = rest[order], at[order], key[order]
            slot = at * (BITS + 1) + key
            head = np.diff(slot, prepend=-1) != 0
            node = rest[head]
            child_parent.append(at[head])
            child_key.append(key[head])
            child_node.append(node)
            into = node[np.cumsum(head) - 1]
            rest, at = rest[~head], into[~head]
        empty = np.empty(0, np.int64)
        parent, key, node = (np.concatenate([empty, *x]) for x in (child_parent, child_key, child_node))
        slot = parent * (BITS + 1) + key
        order = np.argsort(slot, kind="stable")
        self.slots, self.nodes = slot[order], node[order]

    def within(self, queries: np.ndarray, tree: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, node) at ``radius`` or less, following only children whose key lies within it of the parent's distance."""
        q, node = np.arange(len(queries)), self.roots[tree]
        found_q, found_n = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        while len(q):
            d = np.bitwise_count(queries[q] ^ self.values[node]).astype(np.int64)
            near = d <= radius
            found_q.append(q[near])
            found_n.append(node[near])
            low = np.searchsorted(self.slots, node * (BITS + 1) + np.maximum(d - radius, 0))
            high = np.searchsorted(self.slots, node * (BITS + 1) + np.minimum(d + radius, BITS), "right")
            n = high - low
            first = np.concatenate(([0], np.cumsum(n)[:-1])) if len(n) else n
            q = np.repeat(q, n)
            node = self.nodes[np.repeat(low - first, n) + np.arange(int(n.sum()))]
        return np.concatenate(found_q), np.concatenate(found_n)


def _least_linked(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1, the smallest node reachable over the pairs."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        new = new[new]
        if np.array_equal(new, low):
            return low
        low = new


def _spanning(batches, radius: int):
    """Of each row's fingerprints, links that join what the radius joins: one per fingerprint at most."""
    for batch in batches:
        lists = batch.column("fps")
        sizes = np.diff(lists.offsets.to_numpy())
        flat = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.int64)
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        row = 0
        while row < len(sizes):  # rows are taken together up to a bounded number of fingerprints
            stop = max(row + 1, int(np.searchsorted(bounds, bounds[row] + 8 * TREE, "right")) - 1)
            values = flat[bounds[row]:bounds[stop]].view(np.uint64)
            tree = np.repeat(np.arange(stop - row), sizes[row:stop])
            q, node = BKForest(values, tree).within(values, tree, radius)
            root = _least_linked(len(values), q, node)
            moved = np.flatnonzero(root != np.arange(len(values)))
            signed = values.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(signed[moved]), pa.array(signed[root[moved]])], ["a", "b"])
            row = stop


def _bands(low: int, high: int, n: int) -> list[tuple[int, int]]:
    """Bits low..high-1 in n runs of nearly one width, as (first bit, width)."""
    cuts = [low + (high - low) * i // n for i in range(n + 1)]
    return [(x, y - x) for x, y in zip(cuts, cuts[1:])]


def _bits(fp: Column, first: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, first).bitwiseAND((1 << width) - 1)


def near_links(fps: DataFrame, radius: int = 2, tree: int = TREE) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that join exactly those within ``radius``, directly or over others.

    Fingerprints within the radius agree on one of radius + 1 bands of bits, so a shard holds those that share one
    band. A shard beyond ``tree`` is split again by bands of its other bits, and what is still too large is searched
    in pairs of chunks, so no task holds more than ``tree`` fingerprints of a shard. Trees are not broadcast, as
    together they hold all fingerprints: a shard's tree is built in the task that searches it.
    """
    half = tree // 2
    n_bands = radius + 1
    first = _bands(0, BITS, n_bands)
    keyed = fps.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("band"), _bits(F.col("fp"), *b).alias("part")) for i, b in enumerate(first)])).alias("k"))
    keyed = keyed.select("fp", F.col("k.band").alias("k1"), F.col("k.part").alias("p1"))
    sizes = keyed.groupBy("k1", "p1").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    keyed = keyed.join(sizes, ["k1", "p1"])

    small = keyed.where(F.col("n") <= tree).select("fp", "k1", "p1", F.lit(-1).alias("k2"), F.lit(0).cast("long").alias("p2"))

    def other_bits(i: int) -> Column:
        at, width = first[i]
        fp = F.col("fp")
        low = fp.bitwiseAND((1 << at) - 1) if at else F.lit(0).cast("long")
        return low.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, at + width), at)) if at + width < BITS else low

    def second(i: int) -> Column:
        left = BITS - first[i][1]
        return F.array(*[F.struct(F.lit(j).alias("band"), _bits(other_bits(i), *b).alias("part"))
                         for j, b in enumerate(_bands(0, left, n_bands))])

    pick = second(n_bands - 1)
    for i in range(n_bands - 1):
        pick = F.when(F.col("k1") == i, second(i)).otherwise(pick)
    large = (keyed.where(F.col("n") > tree).select("fp", "k1", "p1", F.explode(pick).alias("k"))
             .select("fp", "k1", "p1", F.col("k.band").alias("k2"), F.col("k.part").alias("p2")))
    keys = ["k1", "p1", "k2", "p2"]
    counts = large.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    large = large.join(counts, keys).withColumn(
        "c", F.when(F.col("n") <= tree, 1).otherwise(F.ceil(F.col("n") / half)).cast("int"))
    mine = F.pmod(F.xxhash64("fp"), F.col("c")).cast("int")
    paired = large.withColumn("mine", mine).select("fp", *keys, "mine", F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("o"))
    paired = paired.select("fp", *keys, F.least("mine", "o").alias("x"), F.greatest("mine", "o").alias("y"))
    shards = small.withColumns({"x": F.lit(0), "y": F.lit(0)}).unionByName(paired)
    lists = shards.groupBy(*keys, "x", "y").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    return lists.select("fps").mapInArrow(lambda it: _spanning(it, radius), "a long, b long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """Per row its id, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest id its links reach."""
    marked = stored(fingerprints(docs, id_col, text_col, width))
    distinct = stored(marked.groupBy("fp").agg(F.min(id_col).alias("least_id")))
    comps = components(near_links(distinct.select("fp"), radius))
    joined = distinct.join(comps.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = joined.groupBy("root").agg(F.min("least_id").alias("component_id"))
    by_fp = joined.join(least, "root").select("fp", "component_id")
    return marked.join(by_fp, "fp").select(
        id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _row_key(id_col: str, text_col: str) -> list[Column]:
    """What tells rows of different ids or texts apart, in three numbers."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [F.xxhash64(text).alias("__t1"), F.xxhash64(F.lit(1), text).alias("__t2"), F.xxhash64(id_col).alias("__rid")]


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """One row of each group of near-duplicates: that of the smallest id, of rows that share it one.

    Rows are told apart by id and text, so a repeated id loses no group; a row without an id stays only where no other of its group has one.
    """
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), *_row_key(id_col, text_col))
    keyed = docs.select(key.alias("__key"), F.col(text_col).alias("__text"))
    distinct = stored(fingerprints(keyed, "__key", "__text", width).groupBy("fp").agg(F.min("__key").alias("least")))
    comps = components(near_links(distinct.select("fp"), radius))
    joined = distinct.join(comps.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    best = joined.groupBy("root").agg(F.min("least").alias("b")).select("b.__t1", "b.__t2", "b.__rid")
    names = ["__t1", "__t2", "__rid"]
    chosen = docs.select("*", *_row_key(id_col, text_col)).join(best, names, "left_semi")
    rows = F.struct(*docs.columns)
    return chosen.groupBy(*names).agg(F.min_by(rows, F.xxhash64(*docs.columns)).alias("__row")).select("__row.*")
