"""Near-duplicates by MinHash with fast similarity sketches: banding, links confirmed on whole shingle sets, components.

Texts: ASCII letters lower-cased, words are runs of anything but blanks. A text's set holds its distinct shingles of
``width`` words; a text with fewer words is one shingle; without words, or null, its set is empty and it is linked with nothing.

A sketch has as many coordinates as bins. In round after round every shingle is thrown into a random bin with a random
value; a bin keeps the least (round, value). After as many rounds as bins, round i throws everything into bin i, so every
bin fills however small the set is, and large sets are done after few rounds. Two sets agree on a coordinate with the
probability of their Jaccard similarity, and the share that agrees is concentrated at least as well as with one hash function a coordinate.

Repeated rows and ids, null ids and extra columns do no harm: the search works on distinct sets. A row without an id has
the component of its set, and is never the one that is kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tidemark.llm.components import components
from tidemark.llm.text_arrays import mapped, mixed, plain
from tidemark.session import stored

SEED = 42
#: Bands of a sketch and coordinates of a band. Sets of similarity 0.85 agree on no band once in four million pairs.
BANDS, ROWS = 48, 8
#: Pairs with one centre that are compared in one task.
CHUNK = 256
_VALUE_BITS = 40
_LOW = np.uint64((1 << _VALUE_BITS) - 1)
_EMPTY = np.uint64(2**64 - 1)


def shingle_set(text: bytes, width: int = 5) -> np.ndarray:
    """Distinct XXH64 of a text's shingles, ascending; empty without words."""
    words = text.lower().split()
    grams = (b" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))) if words else ()
    return np.unique(np.frombuffer(b"".join(xxhash.xxh64_digest(g, SEED) for g in grams), ">u8").astype(np.uint64))


class Sketcher:
    """Sketches of ``bins`` coordinates; all sets must be sketched by one seed."""

    def __init__(self, bins: int = BANDS * ROWS, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.bins = bins
        self.flip, self.odd = rng.integers(1, 2**63, (2, 2 * bins, 1), dtype=np.uint64) | np.uint64(1)

    def sketch(self, items: np.ndarray) -> np.ndarray:
        """Per bin the least (round, value) of a set of 64-bit hashes; a set without elements has no sketch."""
        if not len(items):
            raise ValueError("an empty set has no sketch")
        bins, out, at = self.bins, np.full(self.bins, _EMPTY), 0
        while at < 2 * bins and (out == _EMPTY).any():  # rounds go together while sets are small
            until = min(bins if at < bins else 2 * bins, at + max(1, 4 * bins // len(items)))
            h = mixed((items[None, :] ^ self.flip[at:until]) * self.odd[at:until])
            rounds = np.arange(at, until, dtype=np.uint64)[:, None]
            value = (rounds << np.uint64(_VALUE_BITS)) | (h & _LOW)
            if at < bins:
                where = ((h >> np.uint64(_VALUE_BITS)) * np.uint64(bins)) >> np.uint64(64 - _VALUE_BITS)
                np.minimum.at(out, where.ravel().astype(np.int64), value.ravel())
            else:
                fixed = out[at - bins:until - bins]
                np.minimum(fixed, value.min(axis=1), out=fixed)
            at = until
        return out


def band_keys(sketch: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key per band of the sketch, different for equal coordinates in different bands."""
    return np.array([xxhash.xxh64_intdigest(part.tobytes(), band) for band, part in enumerate(sketch.reshape(bands, -1))],
                    np.uint64).view(np.int64)


def _text_key(text_col: str) -> list[Column]:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


def sketched(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, t1, t2, n, d1, d2, keys) per row: two hashes of the text, the size of its set, a 128-bit digest of it, band keys."""
    kind = docs.schema[id_col].dataType

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        sketcher = Sketcher()
        sets = [shingle_set(t, width) for t in plain(batch, "t")]
        digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
        keys = [band_keys(sketcher.sketch(s)) if len(s) else np.empty(0, np.int64) for s in sets]
        return pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("t1"), batch.column("t2"), pa.array([len(s) for s in sets], pa.int64()),
             pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array(keys, pa.list_(pa.int64()))],
            ["id", "t1", "t2", "n", "d1", "d2", "keys"])

    narrow = docs.select(F.col(id_col).alias("id"), *_text_key(text_col), F.col(text_col).alias("t"))
    longs = [T.StructField(c, T.LongType()) for c in ("t1", "t2", "n", "d1", "d2")]
    return narrow.mapInArrow(mapped(step), T.StructType([
        T.StructField("id", kind), *longs, T.StructField("keys", T.ArrayType(T.LongType()))]))


def _comparable(a: Column, b: Column, over: int, under: int) -> Column:
    """Whether sets of these sizes can be as similar as over / under."""
    return F.least(a, b) * under >= F.greatest(a, b) * over


class _Sets:
    """Whole shingle sets by node, and the check of pairs on them."""

    def __init__(self, sets: DataFrame, over: int, under: int):
        self.sets, self.over, self.under = sets, over, under

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """Of (a, b), the pairs whose sets are as similar as over / under. A set ``a`` of many pairs is sent once per chunk of them."""
        pairs = stored(pairs.distinct())
        chunks = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("c"))
        salted = pairs.join(chunks, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("c")).cast("int").alias("salt"))
        left = salted.join(self.sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
        right = self.sets.join(chunks, F.col("node") == F.col("a")).select(
            "a", F.col("s").alias("sa"), F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("salt"))
        both = left.join(right, ["a", "salt"])
        same, total = F.size(F.array_intersect("sa", "sb")), F.size("sa") + F.size("sb")
        return stored(both.where(same * (self.over + self.under) >= total * self.over).select("a", "b"))

    def unique_counts(self, nodes: DataFrame) -> DataFrame:
        """(node, u): how many elements of a node's set no other of these nodes has; nodes without such are left out."""
        items = self.sets.join(nodes, "node", "left_semi").select("node", F.explode("s").alias("s"))
        alone = items.groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node")).where("n = 1")
        return alone.groupBy("node").agg(F.count(F.lit(1)).alias("u"))


def shared_keys(nodes: DataFrame) -> DataFrame:
    """(k, node, n, size) of the band keys that several of ``nodes`` (node, n, keys) have. Keys move once, to be counted where they lie."""
    keyed = nodes.select(F.explode("keys").alias("k"), "node", "n")
    return keyed.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("k"))).where("size > 1")


def set_links(nodes: DataFrame, sets: DataFrame, over: int = 85, under: int = 100, met: DataFrame | None = None) -> DataFrame:
    """Links (a, b) that join exactly those nodes whose sets are as similar as over / under, directly or over others.

    ``nodes`` has (node, n, keys), ``sets`` has (node, s) for every node that shares a band key, ``met`` may give their ``shared_keys``. Members of a key are first
    compared with its centre, the one that shares most keys with others; so a large group of near copies makes about a pair per
    member. What a key holds of more than one component afterwards is compared in pairs, but for those pairs that cannot be
    similar enough: an element that no other member has is in no intersection, which bounds the similarity from above. That
    comparison leaves out nothing; for a group of texts that are alike but below the threshold it stays quadratic in the group.
    """
    check = _Sets(sets, over, under)
    met = stored(shared_keys(nodes)) if met is None else met
    met = met.join(met.groupBy("node").agg(F.sum("size").alias("met")), "node")
    centres = met.groupBy("k").agg(F.max(F.struct("met", (-F.col("node")).alias("less"), "n")).alias("c"))
    met = stored(met.join(centres, "k").select("k", "node", "n", (-F.col("c.less")).alias("centre"), F.col("c.n").alias("cn")))
    star = check.confirmed(met.where((F.col("node") != F.col("centre")) & _comparable(F.col("n"), F.col("cn"), over, under))
                           .select(F.col("centre").alias("a"), F.col("node").alias("b")))
    rooted = stored(met.join(components(star), "node", "left").select(
        "k", "node", "n", "centre", F.coalesce("root", "node").alias("r")))
    mixed_keys = rooted.groupBy("k").agg(F.min("r").alias("r1"), F.max("r").alias("r2")).where("r1 != r2").select("k")
    rest = stored(rooted.join(mixed_keys, "k").where("node != centre").drop("centre"))
    for _ in range(2):  # an element may be alone only after others are known to be linked with nothing
        alone = check.unique_counts(rest.select("node").distinct())
        rest = rest.drop("common").join(alone, "node", "left").withColumn("common", F.col("n") - F.coalesce("u", F.lit(0))).drop("u")
        rest = stored(rest.where(F.col("common") * under >= F.col("n") * over))
    rest = rest.join(nodes.select("node", "keys"), "node")
    a = rest.select("k", *[F.col(c).alias(f"a_{c}") for c in ("node", "n", "r", "common", "keys")])
    b = rest.select("k", *[F.col(c).alias(f"b_{c}") for c in ("node", "n", "r", "common", "keys")])
    possible = F.least("a_common", "b_common") * (over + under) >= (F.col("a_n") + F.col("b_n")) * over
    first = F.element_at(F.array_intersect("a_keys", "b_keys"), 1) == F.col("k")  # a pair is named by the first key it shares
    late = a.join(b, "k").where((F.col("a_node") < F.col("b_node")) & (F.col("a_r") != F.col("b_r"))).where(possible).where(first)
    return star.union(check.confirmed(late.select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, over: int = 85,
                    under: int = 100) -> DataFrame:
    """Per row its id, ``n_shingles``, ``component_id`` (the smallest id its links reach, itself included) and ``kept``.

    Rows of one set are linked whatever their texts. Without words the component is the row's own id and the row is kept.
    Where ids repeat, rows are told apart by their sets; every row of the component's id is kept.
    """
    marked = stored(sketched(docs, id_col, text_col, width))
    key = F.struct("id", "t1", "t2")
    one = marked.where("n > 0").groupBy("d1", "d2").agg(
        F.min("id").alias("least_id"), F.min(key).alias("row"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    one = stored(one.withColumn("node", F.monotonically_increasing_id()))  # stored, so every later step sees one numbering
    met = stored(shared_keys(one))
    wanted = one.join(met.select("node").distinct(), "node", "left_semi").select("node", "row.t1", "row.t2", F.xxhash64("row.id").alias("rid"))
    texts = docs.select(*_text_key(text_col), F.xxhash64(id_col).alias("rid"), F.col(text_col).alias("t"))

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingle_set(t, width).view(np.int64) for t in plain(batch, "t")]
        return pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.list_(pa.int64()))], ["node", "s"])

    whole = texts.join(wanted, ["t1", "t2", "rid"]).select("node", "t").dropDuplicates(["node"])
    whole = stored(whole.mapInArrow(mapped(sets), "node long, s array<long>"))
    roots = components(set_links(one.select("node", "n", "keys"), whole, over, under, met))
    joined = one.select("node", "d1", "d2", "least_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = joined.groupBy("root").agg(F.min("least_id").alias("component"))
    by_set = joined.join(least, "root").select("d1", "d2", "component")
    found = marked.select("id", "n", "d1", "d2").join(by_set, ["d1", "d2"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
                        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
