"""Running sums over ordered rows that do not depend on how large one key is.

Sums hardly depend on the plan: floating-point values are added up as decimals of 12 places, and what a decimal does
not hold (further places, values beyond 16 digits before the point, infinities, NaN) in a second, floating-point sum that is
added at the end. So for values of up to 12 places neither the size of a key nor the cut into blocks changes a digit.

A window over a key sends all its rows to one task. That is the cheapest plan as long as
the largest key fits, so its size is counted first. Without keys that holds for small frames only. Beyond the limit the rows are cut into
contiguous blocks by a range partitioning on (key, order): running sums are taken inside a
block and completed with the totals of the key's earlier blocks. A block that continues
a key is the only one to need such a total, so the totals number at most one per block
and can be broadcast.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import stored

MAX_GROUP_ROWS = 5_000_000
#: Rows of a whole frame that one task may order.
MAX_FRAME_ROWS = 10_000
#: Rows of a block, about, and the fewest blocks that are made.
BLOCK_ROWS, MIN_BLOCKS = 500_000, 4
BLOCK = "_block"
EXACT, TOTAL = "decimal(28,12)", "decimal(37,12)"  # of values, and of totals that are added to others


def as_columns(order: list[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def largest_group(df: DataFrame, keys: list[str]) -> int:
    """Rows of the largest key; reads the key columns only."""
    if not keys:
        return df.count()
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.max("n")).first()[0] or 0


def fits_window(df: DataFrame, keys: list[str], max_group_rows: int | None = None) -> bool:
    """Whether every key is small enough for one task."""
    limit = MAX_GROUP_ROWS if max_group_rows is None else max_group_rows
    return largest_group(df, keys) <= (limit if keys else min(limit, MAX_FRAME_ROWS))


def exact(df: DataFrame, value: Column) -> tuple[Column, Column | None]:
    """``value`` in a form whose sums are exact, and for floating-point values what that form leaves out, as a double."""
    kind = df.select(value.alias("_v")).schema["_v"].dataType
    if not isinstance(kind, (T.DoubleType, T.FloatType)):
        return value, None
    whole = value.try_cast(EXACT)
    return F.when(value.isNotNull(), F.coalesce(whole, F.lit(0).cast(EXACT))), F.when(whole.isNull(), value).otherwise(value - whole.cast("double")).cast("double")


def ordered_blocks(
    df: DataFrame, keys: list[str], order: list[str | Column], partitions: int | None = None
) -> DataFrame:
    """``df`` with a block number; blocks follow (keys, order) and none spans two partitions.

    Range bounds come from a sample, so the result is stored: every later branch,
    and every retry, sees the same blocks. Rows that tie on keys and order share a block.
    """
    columns = [*[F.col(k) for k in keys], *as_columns(order)]
    if partitions is None:
        partitions = max(MIN_BLOCKS, -(-df.count() // BLOCK_ROWS))
    ranged = df.repartitionByRange(partitions, *columns)  # a number that is asked for is not coalesced
    return stored(ranged.withColumn(BLOCK, F.spark_partition_id()))


def same_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Join condition on keys that also matches null to null."""
    return reduce(and_, [left[k].eqNullSafe(right[k]) for k in keys])


def running_sums(
    df: DataFrame,
    keys: list[str],
    order: list[str | Column],
    sums: dict[str, Column],
    windowed: bool,
    partitions: int | None = None,
) -> DataFrame:
    """Add running sums of the given expressions, the current row included.

    ``windowed`` takes one window per key, otherwise ``df`` is cut into blocks (or comes
    from ``ordered_blocks`` already).
    """
    running = (Window.unboundedPreceding, Window.currentRow)
    parted = {name: exact(df, value) for name, value in sums.items()}
    rests = {name: f"_rest_{name}" for name, (_, rest) in parted.items() if rest is not None}
    sums = {name: value for name, (value, _) in parted.items()} | {rests[name]: parted[name][1] for name in rests}

    def finished(df: DataFrame) -> DataFrame:
        """The two sums of floating-point values as one."""
        return df.withColumns({name: F.col(name).cast("double") + F.col(rest) for name, rest in rests.items()}).drop(*rests.values())

    if windowed:
        whole = Window.partitionBy(*keys).orderBy(*as_columns(order)).rowsBetween(*running)
        return finished(df.withColumns({name: F.sum(value).over(whole) for name, value in sums.items()}))

    parts = df if BLOCK in df.columns else ordered_blocks(df, keys, order, partitions)
    by_block = [*keys, BLOCK]
    inside = Window.partitionBy(*by_block).orderBy(*as_columns(order)).rowsBetween(*running)
    local = parts.withColumns({name: F.sum(value).over(inside) for name, value in sums.items()})

    totals = parts.groupBy(*by_block).agg(*[F.sum(v).alias(f"_t_{n}") for n, v in sums.items()])
    blocks = Window.partitionBy(*keys).orderBy(BLOCK)
    earlier = blocks.rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.withColumns({
        **{f"_c_{n}": F.sum(f"_t_{n}").over(earlier) for n in sums}, "_nth": F.row_number().over(blocks),
    }).filter("_nth > 1")
    right = carried.select(*[F.col(c).alias(f"_k_{c}") for c in by_block], *[f"_c_{n}" for n in sums])
    match = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by_block])
    joined = local.join(F.broadcast(right), match, "left")
    def added(name: str) -> Column:
        before, here = F.col(f"_c_{name}"), F.col(name)
        return before.cast(TOTAL) + here.cast(TOTAL) if isinstance(local.schema[name].dataType, T.DecimalType) else before + here

    full = {
        n: F.when(F.col(f"_c_{n}").isNull(), F.col(n)).when(F.col(n).isNull(), F.col(f"_c_{n}"))
        .otherwise(added(n)) for n in sums
    }
    return finished(joined.withColumns(full).drop(*[f"_k_{c}" for c in by_block], *[f"_c_{n}" for n in sums]))
