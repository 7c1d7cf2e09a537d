"""Delimited text, Parquet, SQL over views, and file inventories."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from tidemark.functions.calendar import parse_time
from tidemark.session import bounded_tasks


def scan_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | str | None = None,
    *,
    header: bool = True,
    escape: str = '"',
    infer: bool = False,
    sample: float | None = None,
    date_cols: list[str] | None = None,
    fmt: str | list[str] | None = None,
    tolerant: bool = True,
    multi_line: bool = False,
) -> DataFrame:
    """Delimited text as a DataFrame.

    Without a schema every column is a string; ``infer`` types them from the data
    (``sample`` is the share of rows looked at). A schema saves that extra pass.
    ``date_cols`` are read as strings and parsed by ``fmt``, a pattern or a list of
    patterns tried in turn. ``tolerant`` turns bad cells into nulls and drops
    surplus fields; otherwise such a row fails the job. ``multi_line`` allows line breaks in
    quoted fields, at the price of one task per file. An empty field is null, quoted or not.
    """
    reader = spark.read.option("header", header).option("escape", escape).option("multiLine", multi_line)
    reader = reader.option("mode", "PERMISSIVE" if tolerant else "FAILFAST")
    dates = list(date_cols or [])
    patterns = [fmt] if isinstance(fmt, str) else list(fmt or ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd"])
    if schema is not None:
        wanted = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        fields = [T.StructField(f.name, T.StringType() if f.name in dates else f.dataType) for f in wanted]
        reader = reader.schema(T.StructType(fields))
    elif infer:
        reader = reader.option("inferSchema", True).option("preferDate", False)
        if sample is not None:
            reader = reader.option("samplingRatio", sample)
    frame = reader.csv(path)
    return frame.withColumns({c: parse_time(F.col(c).cast("string"), *patterns) for c in dates}) if dates else frame


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Text lines as (file, split, seq, line_no, text), numbered from 1 in every file.

    A large file is read as many splits. ``split`` is the byte offset a split starts at and
    ``seq`` rises inside it, so a line's number is its rank in the split plus the lines of
    earlier splits of the file; no file has to pass through one task. The lines are dealt by split to tasks of about 8 MB of
    text: shuffled lines are so small by their repeated paths that tasks joined up by shuffled bytes would hold far more.
    """
    text = spark.read.text(path)
    raw = text.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("seq"),
        F.col("value").alias("text"),
    )
    inside = Window.partitionBy("file", "split").orderBy("seq")
    ranked = raw.repartition(bounded_tasks(text), "file", "split").withColumn("_rank", F.row_number().over(inside).cast("bigint"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        raw.groupBy("file", "split").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .drop("_n")
    )
    # a left join: Spark drops it where no line number is asked for
    return ranked.join(offsets, ["file", "split"], "left").select(
        "file", "split", "seq", (F.col("_rank") + F.col("_before")).alias("line_no"), "text"
    )


def scan_csv_range(
    spark: SparkSession, path: str | list[str], *, skip: int, n: int | None, columns: dict[int, str]
) -> DataFrame:
    """Rows of a rectangle in each file: drop ``skip`` lines and the header that follows,
    keep ``n`` rows (all when None) and the 0-based fields named in ``columns``."""
    lines = read_lines(spark, path)
    first = skip + 2
    rows = lines.filter(F.col("line_no") >= first)
    if n is not None:
        rows = rows.filter(F.col("line_no") < first + n)
    width = max(columns) + 1
    shape = ", ".join(f"f{i} STRING" for i in range(width))
    cells = F.from_csv("text", F.lit(shape), {"mode": "PERMISSIVE", "escape": '"'})
    return rows.withColumn("_row", cells).select(
        "file", "line_no", *[F.col("_row")[f"f{i}"].alias(name) for i, name in columns.items()]
    )


def scan_parquet(spark: SparkSession, path: str | list[str], where: Column | str | None = None) -> DataFrame:
    """Parquet, with key=value folders as columns; ``where`` prunes folders and row groups."""
    paths = [path] if isinstance(path, str) else path
    frame = spark.read.parquet(*paths)
    return frame if where is None else frame.filter(where)


def sql_over(spark: SparkSession, sql: str, **views: DataFrame) -> DataFrame:
    """SQL whose ``{name}`` placeholders are the given DataFrames."""
    return spark.sql(sql, **views)


def frame_from_rows(spark: SparkSession, rows: list[tuple], schema: T.StructType | str | list[str]) -> DataFrame:
    """A small DataFrame from tuples; an empty one needs a typed schema."""
    if not rows and isinstance(schema, list):
        raise ValueError("an empty frame needs a schema with types")
    return spark.createDataFrame(rows, schema)


def dated_path(base: str, day: datetime.date) -> str:
    """``base`` for the snapshot of one day, a folder that partition discovery reads as ``date``."""
    return f"{base.rstrip('/')}/date={day.isoformat()}"


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Header line, UTF-8, quotes doubled, blanks kept; one file per partition."""
    options = {"header": True, "escape": '"', "encoding": "UTF-8",
               "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode(mode).options(**options).csv(path)


def write_parquet(
    df: DataFrame, path: str, compression: str = "zstd", by: list[str] | None = None, mode: str = "errorifexists"
) -> None:
    """Parquet, optionally in key=value folders."""
    writer = df.write.mode(mode).option("compression", compression)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Files directly below a folder as (name, path, length, modified); contents are not read."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", False)
        .load(path)
        .select(
            F.regexp_extract("path", r"[^/]+$", 0).alias("name"),
            "path", "length", F.col("modificationTime").alias("modified"),
        )
    )


def size_mb(inventory: DataFrame) -> DataFrame:
    """Total size of an inventory in MiB."""
    return inventory.agg((F.coalesce(F.sum("length"), F.lit(0)) / F.lit(1024.0 * 1024.0)).alias("size_mb"))
