"""Aggregates, profiles and top rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.ordered import running_sums
from tidemark.session import stored


def shape(df: DataFrame) -> tuple[int, int]:
    """(rows, columns)."""
    return df.count(), len(df.columns)


def profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """count, mean, stddev, min and max per numeric column as rows, from one pass."""
    names = columns or [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    stats = df.agg(*[
        F.struct(
            F.lit(c).alias("column"), F.count(c).alias("count"), F.avg(c).alias("mean"),
            F.stddev_samp(c).alias("stddev"), F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"),
        ).alias(f"_{i}") for i, c in enumerate(names)
    ])
    rows = F.array(*[F.col(f"_{i}") for i in range(len(names))])
    return stats.select(F.inline(rows))


def quartiles(df: DataFrame, columns: list[str], accuracy: int = 10_000) -> DataFrame:
    """25, 50 and 75 % points per numeric column as rows, approximate."""
    marks = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    stats = df.agg(*[F.percentile_approx(F.col(c).cast("double"), marks, accuracy).alias(c) for c in columns])
    rows = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c)[0].alias("q25"), F.col(c)[1].alias("q50"), F.col(c)[2].alias("q75"))
        for c in columns
    ])
    return stats.select(F.inline(rows))


def exact_quartiles(df: DataFrame, columns: list[str]) -> DataFrame:
    """25, 50 and 75 % points per numeric column as rows: the values of rank ceil(n / 4), ceil(n / 2) and ceil(3n / 4), nulls left out.

    Equal values are counted before anything is ordered; the counts are added up in range-cut blocks, so no task orders a whole column.
    """
    cells = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns
    ]))).filter("value IS NOT NULL")
    counts = stored(cells.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))
    totals = counts.groupBy("column").agg(F.sum("n").alias("total"))
    summed = running_sums(counts, ["column"], ["value"], {"upto": F.col("n")}, windowed=False)

    def mark(share: float, name: str) -> Column:
        rank = F.ceil(F.col("total") * share)
        return F.max(F.when((F.col("upto") >= rank) & (F.col("upto") - F.col("n") < rank), F.col("value"))).alias(name)

    found = summed.join(F.broadcast(totals), "column").groupBy("column").agg(  # a line per column
        mark(0.25, "q25"), mark(0.5, "q50"), mark(0.75, "q75"))
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column STRING")
    return names.join(found, "column", "left")


def time_stats(df: DataFrame, column: str) -> DataFrame:
    """min, max, mean and sum of a timestamp; mean and sum in epoch seconds."""
    kind = df.schema[column].dataType
    epoch = F.lit("1970-01-01 00:00:00" + ("" if isinstance(kind, T.TimestampNTZType) else "+00:00")).cast(kind)
    seconds = F.timestamp_diff("MICROSECOND", epoch, F.col(column)) / 1_000_000
    return df.agg(
        F.min(column).alias("mn"), F.max(column).alias("mx"), F.avg(seconds).alias("ag"), F.sum(seconds).alias("sm")
    )


def distinct_count(df: DataFrame, column: str, approximate: bool = False) -> DataFrame:
    """Number of distinct values, exact or within a few percent by a sketch that needs no shuffle of values."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(count(column).alias("n"))


def distinct_per_group(df: DataFrame, key: str, column: str, name: str = "n") -> DataFrame:
    """Distinct values per group, largest first.

    Spark dedups (group, value) on the map side and shuffles by both, so a large group
    is spread before it is counted.
    """
    return df.groupBy(key).agg(F.count_distinct(column).alias(name)).orderBy(F.desc(name), F.col(key))


def group_stats(df: DataFrame, keys: list[str], **aggregates: Column) -> DataFrame:
    """Named aggregates per group."""
    return df.groupBy(*keys).agg(*[a.alias(n) for n, a in aggregates.items()])


def group_means(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Mean of each column per group."""
    return df.groupBy(key).agg(*[F.avg(c).alias(c) for c in columns])


def margins(df: DataFrame, row: str, col: str, value: str | Column) -> DataFrame:
    """Sums by row, by column and in total as (row, col, total), null meaning all.

    Cells are added up first, so the grouping sets expand the cells and not the input.
    """
    value = F.col(value) if isinstance(value, str) else value
    cells = df.groupBy(F.col(row).alias("row"), F.col(col).alias("col")).agg(F.sum(value).alias("total"))
    return cells.groupingSets([["row"], ["col"], []], "row", "col").agg(
        F.sum("total").alias("total"), F.grouping_id().cast("bigint").alias("level")
    )


def concat_distinct(df: DataFrame, keys: list[str], columns: list[str], sep: str = "/") -> DataFrame:
    """Per group and column the sorted distinct values joined by ``sep``.

    Values are deduplicated by (group, column, value) before they meet, so repeats in a large
    group never reach one task.
    """
    long = df.select(
        *keys,
        F.explode(F.array(*[
            F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns
        ])).alias("_cell"),
    ).select(*keys, "_cell.name", "_cell.value").distinct()
    return long.groupBy(*keys).agg(*[
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("name") == c, F.col("value")))), sep).alias(c)
        for c in columns
    ])


def corr_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every pair as (a, b, corr), from one pass over the rows."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    stats = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    cells = [F.struct(F.lit(c).alias("a"), F.lit(c).alias("b"), F.lit(1.0).alias("corr")) for c in columns]
    for i, (a, b) in enumerate(pairs):
        for x, y in ((a, b), (b, a)):
            cells.append(F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(f"c{i}").alias("corr")))
    return stats.select(F.inline(F.array(*cells)))


def top_rows(df: DataFrame, by: str, n: int, tie: str) -> DataFrame:
    """First ``n`` rows by ``by`` descending, ties by ``tie``."""
    return df.orderBy(F.desc(by), F.col(tie)).limit(n)


def scoreboard(df: DataFrame, exam: str, correct: str | Column) -> DataFrame:
    """answered, correct, incorrect and percent per exam; percent once anything is answered."""
    right = (F.col(correct) if isinstance(correct, str) else correct).cast("bigint")
    return df.groupBy(exam).agg(
        F.count(F.lit(1)).alias("answered"),
        F.coalesce(F.sum(right), F.lit(0)).alias("correct"),
    ).withColumns({
        "incorrect": F.col("answered") - F.col("correct"),
        "percent": F.when(F.col("answered") > 0, F.col("correct") / F.col("answered") * 100),
    })
