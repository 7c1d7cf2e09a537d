"""Set operations, history and comparison of frames."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_by_name(*frames: DataFrame) -> DataFrame:
    """All rows by column name; a column a frame lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def append_history(old: DataFrame | None, new: DataFrame, dedup_old: bool = True) -> DataFrame:
    """The history with duplicates removed, followed by the new batch as it is."""
    if old is None:
        return new
    kept = old.dropDuplicates() if dedup_old else old
    return kept.unionByName(new, allowMissingColumns=True)


def common_values(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Distinct values of a column that occur in both frames."""
    return a.select(column).intersect(b.select(column))


def keyed_zip(a: DataFrame, b: DataFrame, key: str | list[str]) -> DataFrame:
    """Columns of two frames side by side, matched by key and never by position."""
    return a.join(b, key, "inner")


def frames_equal(a: DataFrame, b: DataFrame) -> bool:
    """Same column names and types, and same rows with their counts; row order does not matter.

    Counts of one frame are set against the other in a single grouped pass.
    """
    if [(f.name, f.dataType) for f in a.schema] != [(f.name, f.dataType) for f in b.schema]:
        return False
    signed = a.withColumn("_sign", F.lit(1)).unionByName(b.withColumn("_sign", F.lit(-1)))
    return signed.groupBy(*a.columns).agg(F.sum("_sign").alias("_net")).filter("_net <> 0").isEmpty()


def frame_diffs(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Cells that differ as (keys, column, left, right), both as strings.

    A row only one frame has yields its cells against null and one line for the column
    '(row)' that says which side has it.
    """
    values = [c for c in a.columns if c in b.columns and c not in keys]
    left = a.select(*keys, *[F.col(c).alias(f"l_{c}") for c in values], F.lit("present").alias("l_(row)"))
    right = b.select(
        *[F.col(k).alias(f"k_{k}") for k in keys],
        *[F.col(c).alias(f"r_{c}") for c in values], F.lit("present").alias("r_(row)"),
    )
    match = reduce(and_, [F.col(k).eqNullSafe(F.col(f"k_{k}")) for k in keys])
    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"`l_{c}`").cast("string").alias("left"),
                 F.col(f"`r_{c}`").cast("string").alias("right"))
        for c in [*values, "(row)"]
    ])
    different = F.filter(cells, lambda c: ~c["left"].eqNullSafe(c["right"]))
    return (
        left.join(right, match, "full_outer")
        .select(*[F.when(F.col("`l_(row)`").isNotNull(), F.col(k)).otherwise(F.col(f"k_{k}")).alias(k) for k in keys],
                F.explode(different).alias("_d"))
        .select(*keys, "_d.column", "_d.left", "_d.right")
    )
