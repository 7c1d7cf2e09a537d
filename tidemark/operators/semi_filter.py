"""Semi-joins against long lists: a Bloom filter of the list thins the rows before they are shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits of the filter per listed key, and bits that a key sets in its word of 64.
BITS_PER_KEY, HASHES = 16, 4
#: Largest number of words (some 32 bytes each in a task's table) that is sent to the tasks.
WORDS = 1 << 21


def _marks(keys: list[str], kinds: list, words: int) -> tuple[Column, Column]:
    """The word a key belongs to, and its bits in there."""
    same = []
    for key, kind in zip(keys, kinds):
        value = F.col(key).cast(kind)
        if isinstance(kind, (T.FloatType, T.DoubleType)):  # as joins see them: one NaN, and -0.0 is 0.0
            value = F.when(F.isnan(value), F.lit(float("nan")).cast(kind)).otherwise(value + F.lit(0.0).cast(kind))
        same.append(value)
    bits = F.xxhash64(F.lit(1), *same)
    mask = F.lit(0).cast("long")
    for i in range(HASHES):
        place = F.shiftrightunsigned(bits, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place))
    return F.pmod(F.xxhash64(F.lit(2), *same), F.lit(words)), mask


def _all_known(keys: list[str]) -> Column:
    """No key is null; NaN is a value."""
    known = F.lit(True)
    for key in keys:
        known = known & F.col(key).isNotNull()
    return known


def bloom_candidates(df: DataFrame, listed: DataFrame, keys: list[str], words: int = WORDS) -> DataFrame | None:
    """Rows of ``df`` whose keys may be in ``listed``: all that are, and about one in a hundred of the others.

    The filter is a table of words of 64 bits, made by one aggregate over the list. A key sets four bits of one word, so a row
    is tested by one lookup, and rows whose word is empty go at once. The keys are counted first; a filter of more than ``words``
    words is not made, and the result is None.
    """
    found = listed.select(*keys).where(_all_known(keys))
    size = max(1, -(-found.count() * BITS_PER_KEY // 64))
    if size > words:
        return None
    # the type each key has in both frames, so that equal keys have equal hashes
    kinds = [f.dataType for f in df.select(*keys).limit(0).union(listed.select(*keys).limit(0)).schema]
    place, mask = _marks(keys, kinds, size)
    bits = found.select(place.alias("_word"), mask.alias("_mask")).groupBy("_word").agg(F.bit_or("_mask").alias("_bits"))
    held = F.col("_found._bits").bitwiseAND(F.col("_row._mask"))
    named = df.select(F.struct(*df.columns).alias("_kept"), place.alias("_word"), mask.alias("_mask")).alias("_row")
    passed = named.join(F.broadcast(bits).alias("_found"), F.col("_row._word") == F.col("_found._word"))  # bounded by ``words``
    return passed.where(held == F.col("_row._mask")).select("_kept.*")


def bloom_semi_join(df: DataFrame, listed: DataFrame, keys: list[str], words: int = WORDS) -> DataFrame:
    """Rows of ``df`` whose keys are in ``listed``, each once; null keys match nothing.

    For lists too long to broadcast: the rows that a filter of the list rules out are never shuffled, the others are joined
    exactly. Beyond ``words`` words of filter the join runs without it. The list may repeat keys.
    """
    thinned = bloom_candidates(df, listed, keys, words)
    return (df if thinned is None else thinned).join(listed.select(*keys), keys, "left_semi").select(*df.columns)
