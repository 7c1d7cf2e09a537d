"""Files that hold several tables: C (comment), I (header) and D (data) lines."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from tidemark.operators.clean import conditions_column

BLOCK_LINES = 200_000
LINES_PER_BATCH = 20_000
METADATA_FIELDS = 4


def tag_sections(lines: DataFrame) -> DataFrame:
    """Add kind, section_id, table and header to lines(file, line_no, text).

    A section starts at a line beginning 'I,' and runs to the next one; the last
    section of a file also ends before a following line that begins 'C,'. Lines
    outside sections get section_id null.

    The running counts are taken inside blocks of a file (the ``split`` column of
    ``read_lines`` when present, else ranges of line numbers) and completed with the
    sums of the earlier blocks, so one large file spreads over many tasks.
    """
    split = {"split", "seq"} <= set(lines.columns)
    block = F.col("split") if split else F.floor(F.col("line_no") / BLOCK_LINES)
    # the order read_lines leaves behind, so that its sort serves again
    place = "seq" if split else "line_no"
    kind = F.when(F.col("text").startswith("I,"), "I").when(F.col("text").startswith("C,"), "C").otherwise(
        F.substring("text", 1, 1))
    is_head, is_note = F.col("_header").isNotNull(), F.col("kind") == "C"
    inside = Window.partitionBy("file", "_block").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    counted = (
        lines.withColumn("_block", block).withColumn("kind", kind)
        # header text apart, so that the branch of the block sums does not shuffle whole lines
        .withColumn("_header", F.when(F.col("kind") == "I", F.col("text")))
        .withColumns({"_i": F.sum(is_head.cast("bigint")).over(inside),
                      "_c": F.sum(is_note.cast("bigint")).over(inside)})
        .withColumn("_head", F.last(
            F.when(is_head, F.struct(F.col("_header").alias("header"), F.col("_c").alias("c"))), ignorenulls=True
        ).over(inside))
    )

    per_block = counted.groupBy("file", "_block").agg(
        F.sum(is_head.cast("bigint")).alias("_ni"),
        F.sum(is_note.cast("bigint")).alias("_nc"),
        F.max_by(F.when(is_head, F.col("_head")), F.when(is_head, F.col(place))).alias("_last"),
    )
    order = Window.partitionBy("file").orderBy("_block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        per_block
        .withColumns({
            "_i0": F.coalesce(F.sum("_ni").over(before), F.lit(0)),
            "_c0": F.coalesce(F.sum("_nc").over(before), F.lit(0)),
            "_all": F.sum("_ni").over(Window.partitionBy("file")),
        })
        .withColumn("_mine", F.when(F.col("_last").isNotNull(), F.struct(
            F.col("_last.header").alias("header"), (F.col("_last.c") + F.col("_c0")).alias("c"))))
        .withColumn("_head0", F.last("_mine", ignorenulls=True).over(before))
        .select("file", "_block", "_i0", "_c0", "_all", "_head0")
    )

    joined = counted.join(carry, ["file", "_block"])
    own = F.struct(F.col("_head.header").alias("header"), (F.col("_head.c") + F.col("_c0")).alias("c"))
    head = F.when(F.col("_head").isNotNull(), own).otherwise(F.col("_head0"))
    section = F.col("_i") + F.col("_i0")
    open_ = (section > 0) & ~((section == F.col("_all")) & (F.col("_c") + F.col("_c0") > F.col("_now.c")))
    header = F.col("_now.header")
    return (
        joined.withColumn("_now", head)
        .withColumn("_open", open_)
        .select(
            *lines.columns, "kind",
            F.when(F.col("_open"), section).alias("section_id"),
            F.when(F.col("_open"), F.split_part(header, F.lit(","), F.lit(3))).alias("table"),
            F.when(F.col("_open"), header).alias("header"),
        )
    )


def section_ranges(tagged: DataFrame) -> DataFrame:
    """Byte range [start, end) of every section, from tagged lines ending in one '\\n' each."""
    sizes = (
        tagged.withColumn("_group", F.coalesce("section_id", F.lit(0)))
        .groupBy("file", "_group")
        .agg(F.sum(F.octet_length("text") + 1).alias("size"), F.max("table").alias("table"),
             F.min("line_no").alias("first_line"))
    )
    # section 0 is the preamble when it holds line 1; a trailer alone adds nothing in front
    lead = (
        tagged.filter(F.col("section_id").isNotNull()).groupBy("file").agg(F.min("line_no").alias("_first"))
        .join(tagged.filter(F.col("section_id").isNull()).select("file", "line_no", "text"), "file")
        .filter(F.col("line_no") < F.col("_first"))
        .groupBy("file").agg(F.sum(F.octet_length("text") + 1).alias("_lead"))
    )
    before = Window.partitionBy("file").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    return (
        sizes.filter("_group > 0").join(lead, "file", "left")
        .withColumn("start", F.coalesce("_lead", F.lit(0)) + F.coalesce(F.sum("size").over(before), F.lit(0)))
        .select("file", F.col("_group").alias("section_id"), "table", "start", (F.col("start") + F.col("size")).alias("end"))
    )


def _typed(frame: DataFrame, schema: dict[str, str] | None) -> DataFrame:
    if not schema:
        return frame
    return frame.withColumns({c: F.col(c).try_cast(t) for c, t in schema.items() if c in frame.columns})


def _layouts(lines: DataFrame, tables: list[str] | None = None) -> dict[str, list[str]]:
    """Header lines by table name: as many as there are layouts, not files."""
    found = lines.filter(F.col("text").startswith("I,")).select("text").distinct().orderBy("text")
    layouts: dict[str, list[str]] = {}
    for row in found.toLocalIterator():
        name = [*row["text"].split(",", 3), "", ""][2]
        if tables is None or name in tables:
            layouts.setdefault(name, []).append(row["text"])
    return layouts


def read_sections(
    lines: DataFrame,
    tables: list[str] | None = None,
    columns: dict[str, list[str]] | None = None,
    schemas: dict[str, dict[str, str]] | None = None,
    conditions: dict[str, Column | list[tuple]] | None = None,
    lower: bool = True,
    headers: dict[str, list[str]] | None = None,
    drop_metadata: bool | int = False,
    layouts: dict[str, list[str]] | None = None,
) -> dict[str, DataFrame]:
    """One DataFrame per table over all files, from plain or tagged lines.

    ``tables``, ``columns`` and ``schemas`` go by the name in the file, ``conditions`` by
    the lower-cased name when ``lower`` is on. Sections of one name are read together; where
    their headers differ, a column a section lacks is null. Unlisted types stay strings; a cell
    that does not fit its type becomes null; surplus fields are dropped. ``drop_metadata`` leaves
    out the leading fields of a line: kind, id, table and version, or as many as it says.
    ``headers`` names the fields of a table, ``layouts`` its header lines; either saves the pass
    that looks them up.
    """
    tagged = lines if "section_id" in lines.columns else tag_sections(lines)
    body = tagged.filter(F.col("section_id").isNotNull())
    if tables is not None:
        body = body.filter(F.col("table").isin(tables))
    if headers is not None:
        layouts = {name: [",".join(fields)] for name, fields in headers.items()}
    elif layouts is None:
        layouts = _layouts(lines, tables)

    result: dict[str, DataFrame] = {}
    for name, variants in layouts.items():
        parts = None
        rows = body.filter((F.col("table") == name) & (F.col("kind") != "I"))
        for header in variants:
            fields = next(iter(pd.read_csv(io.StringIO(header), header=None, dtype=str, keep_default_na=False).values))
            names = [f.lower() if lower else f for f in fields]
            unique = [n if names.index(n) == i else f"{n}_{i}" for i, n in enumerate(names)]
            shape = ", ".join(f"f{i} STRING" for i in range(len(unique)))
            mine = rows if headers is not None else rows.filter(F.col("header") == header)
            cells = F.from_csv("text", F.lit(shape), {"mode": "PERMISSIVE", "escape": '"'})
            keep = range(METADATA_FIELDS if drop_metadata is True else int(drop_metadata), len(unique))
            wanted = columns.get(name) if columns else None
            if wanted is not None:
                low = {w.lower() if lower else w for w in wanted}
                keep = [i for i in keep if unique[i] in low]
            part = mine.select(cells.alias("_r")).select(*[F.col("_r")[f"f{i}"].alias(unique[i]) for i in keep])
            parts = part if parts is None else parts.unionByName(part, allowMissingColumns=True)
        types = schemas.get(name) if schemas else None
        if types and lower:
            types = {k.lower(): v for k, v in types.items()}
        frame = _typed(parts, types)
        key = name.lower() if lower else name
        wanted = conditions.get(key) if conditions else None
        if wanted is not None:
            frame = frame.filter(wanted if isinstance(wanted, Column) else conditions_column(wanted))
        result[key] = frame
    return result


ZIP_LINES = T.StructType([
    T.StructField("archive", T.StringType()), T.StructField("member", T.StringType()),
    T.StructField("line_no", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("kind", T.StringType()), T.StructField("section_id", T.LongType()),
    T.StructField("table", T.StringType()), T.StructField("header", T.StringType()),
])


def member_lines(archive: zipfile.ZipFile, member: str, tables: frozenset[str] | None, heads_only: bool):
    """(line_no, text, kind, section_id, table, header) of a member's lines.

    A member is read in order anyway, so its sections are told apart on the way: once for the
    place of its last header, which decides where a 'C,' line ends a section, and once for the lines.
    """
    def opened():
        return io.TextIOWrapper(archive.open(member), encoding="utf-8", newline="\n")

    with opened() as text:
        last = sum(line.startswith("I,") for line in text)
    section, header, name, ended = 0, None, None, False
    with opened() as text:
        for number, line in enumerate(text, 1):
            line = line.rstrip("\r\n")
            head = line.startswith("I,")
            note = line.startswith("C,")
            if head:
                section, header = section + 1, line
                name = [*line.split(",", 3), "", ""][2]
            elif note and section == last:
                ended = True
            inside = section > 0 and not ended
            if (head or not heads_only) and (tables is None or (inside and name in tables)):
                yield (number, line, "I" if head else "C" if note else line[:1],
                       *((section, name, header) if inside else (None, None, None)))


def _unzip(tables: frozenset[str] | None, heads_only: bool):
    """Mapper from archives to tagged lines, in bounded pieces."""
    def run(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for member in archive.namelist():
                        if not member.lower().endswith(".csv"):
                            continue
                        found = []
                        for row in member_lines(archive, member, tables, heads_only):
                            found.append((path, member, *row))
                            if len(found) == LINES_PER_BATCH:
                                yield pd.DataFrame(found, columns=ZIP_LINES.names)
                                found = []
                        if found:
                            yield pd.DataFrame(found, columns=ZIP_LINES.names)

    return run


def unzip_lines(archives: DataFrame, tables: list[str] | None = None, heads_only: bool = False) -> DataFrame:
    """Lines of every CSV member of archives(path, content), tagged as by ``tag_sections``.

    A zip cannot be split, so each is opened in one task; its lines leave in small batches and,
    with ``tables``, only those of the named sections. Nothing is shuffled.
    """
    wanted = None if tables is None else frozenset(tables)
    lines = archives.select("path", "content").mapInPandas(_unzip(wanted, heads_only), ZIP_LINES)
    typed = lines.withColumn("section_id", F.col("section_id").cast("bigint"))
    return typed.select(F.concat_ws("!", "archive", "member").alias("file"), "*")


def read_zip_lines(spark: SparkSession, path: str | list[str], **options) -> DataFrame:
    """The lines of zip archives in a folder or by path; see ``unzip_lines``."""
    return unzip_lines(spark.read.format("binaryFile").load(path), **options)


def read_zip_tables(
    source: DataFrame | str | list[str], spark: SparkSession | None = None, drop_metadata: bool | int = True,
    tables: list[str] | None = None, headers: dict[str, list[str]] | None = None, **options,
) -> dict[str, DataFrame]:
    """The tables of all archives, given as paths or as archives(path, content).

    The options are those of ``read_sections``; the tables are chosen while unzipping.
    """
    archives = source if isinstance(source, DataFrame) else spark.read.format("binaryFile").load(source)
    layouts = None if headers is not None else _layouts(unzip_lines(archives, tables, heads_only=True))
    lines = unzip_lines(archives, tables)
    return read_sections(
        lines, tables=tables, headers=headers, layouts=layouts, drop_metadata=drop_metadata, **options)
