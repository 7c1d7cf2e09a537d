"""One row per month, step or list element."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.calendar import month_starts, stepped


def year_months(df: DataFrame, start: str, end: str) -> DataFrame:
    """One row per month touched by [start, end), as year and month; a frame that has such columns already is an error."""
    others = df.columns
    if {"year", "month"} & {c.lower() for c in others}:
        raise ValueError("the frame already has a column year or month")
    return (
        df.select(*others, F.explode(month_starts(F.col(start), F.col(end))).alias("_month"))
        .select(*others, F.year("_month").alias("year"), F.month("_month").alias("month"))
    )


def explode_range(df: DataFrame, start: str, end: str, step: str = "30 minutes", name: str = "ts") -> DataFrame:
    """One row per step from start to end, both included; no rows when inverted."""
    return df.select("*", F.explode(stepped(F.col(start), F.col(end), step)).alias(name))


def explode_list(df: DataFrame, column: str, keep_empty: bool = False, name: str | None = None) -> DataFrame:
    """One row per element, the exploded column last; ``keep_empty`` keeps rows without elements."""
    spread = F.explode_outer if keep_empty else F.explode
    others = [c for c in df.columns if c != column]
    return df.select(*others, spread(F.col(column)).alias(name or column))


def page_url_plan(counts: DataFrame, count: str, base: Column, per_page: int = 25) -> DataFrame:
    """One row per page that a count of results needs: the page number and its URL."""
    pages = F.ceil(F.col(count) / F.lit(per_page)).cast("int")
    numbers = F.when(pages >= 1, F.sequence(F.lit(1), pages)).otherwise(F.array().cast("array<int>"))
    return counts.select("*", F.explode(numbers).alias("page")).withColumn(
        "url", F.concat(base, F.col("page").cast("string"))
    )


def offset_plan(counts: DataFrame, count: str, base: Column, per_page: int = 25) -> DataFrame:
    """Pages by offset: the first URL is bare, later ones carry '&offset=n'."""
    planned = page_url_plan(counts, count, F.lit(""), per_page).drop("url")
    offset = (F.col("page") - 1) * per_page
    return planned.withColumn("url", F.when(offset == 0, base).otherwise(
        F.concat(base, F.lit("&offset="), offset.cast("string"))))
