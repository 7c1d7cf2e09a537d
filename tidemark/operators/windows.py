"""Running totals, early stop, last rows and previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.ordered import BLOCK, fits_window, ordered_blocks, running_sums


def running_total(
    df: DataFrame, keys: list[str], order: list[str | Column], value: str | Column,
    name: str = "running", max_group_rows: int | None = None,
) -> DataFrame:
    """Running sum per key in the given order, which should have no ties."""
    value = F.col(value) if isinstance(value, str) else value
    windowed = fits_window(df, keys, max_group_rows)
    return running_sums(df, keys, order, {name: value}, windowed).drop(BLOCK)


def numbered(
    df: DataFrame, keys: list[str], order: list[str | Column], name: str = "n", max_group_rows: int | None = None
) -> DataFrame:
    """Row numbers from 1 per key."""
    return running_total(df, keys, order, F.lit(1).cast("bigint"), name, max_group_rows)


def early_stop(
    df: DataFrame, exam: str, order: list[str | Column], correct: str | Column,
    min_n: int = 6, max_fail: float = 0.40, max_group_rows: int | None = None,
) -> DataFrame:
    """Answers up to the first one, from the ``min_n``-th on, at which the share of wrong answers
    is above ``max_fail``; that answer is kept and later ones go. Adds answered and incorrect."""
    right = (F.col(correct) if isinstance(correct, str) else correct).cast("boolean")
    wrong = F.when(F.coalesce(right, F.lit(False)), 0).otherwise(1).cast("bigint")
    sums = {"answered": F.lit(1).cast("bigint"), "incorrect": wrong}
    windowed = fits_window(df, [exam], max_group_rows)
    parts = df if windowed else ordered_blocks(df, [exam], order)
    counted = running_sums(parts, [exam], order, sums, windowed)
    over = (F.col("answered") >= min_n) & (F.col("incorrect") / F.col("answered") > max_fail)
    stop = F.min(F.when(over, F.col("answered")))
    if windowed:
        staged = counted.withColumn("_stop", stop.over(Window.partitionBy(exam)))
    else:
        stops = counted.groupBy(F.col(exam).alias("_exam")).agg(stop.alias("_stop")).filter("_stop IS NOT NULL")
        staged = counted.join(stops, F.col(exam).eqNullSafe(F.col("_exam")), "left").drop("_exam")
    return staged.filter(F.col("_stop").isNull() | (F.col("answered") <= F.col("_stop"))).drop("_stop", BLOCK)


def last_of(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The named columns of each key's last row; an aggregate, so large keys combine early."""
    last = F.max_by(F.struct(*columns), F.struct(*order))
    return df.groupBy(*keys).agg(last.alias("_last")).select(*keys, *[F.col(f"_last.{c}").alias(c) for c in columns])


def head_tail(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """First and last ``n`` rows, each once, marked 'head' or 'tail' with their distance from that end.

    Two bounded top-n selections; the frame is never sorted as a whole. Rows that tie follow their other columns,
    so both ends agree on one order, and a row count keeps the tail clear of the head.
    """
    total = df.count()
    order = [*order, *[f.name for f in df.schema if f.name not in order and not isinstance(f.dataType, (T.MapType, T.VariantType))]]
    up, down = [F.col(c).asc() for c in order], [F.col(c).desc() for c in order]
    first = df.orderBy(*up).limit(n).withColumn("part", F.lit("head")).withColumn(
        "position", F.row_number().over(Window.orderBy(*up)).cast("bigint"))
    last = df.orderBy(*down).limit(max(0, min(n, total - n))).withColumn("part", F.lit("tail")).withColumn(
        "position", F.row_number().over(Window.orderBy(*down)).cast("bigint"))
    return first.unionByName(last)
