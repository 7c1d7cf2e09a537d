"""Zip archives of sectioned files as a Spark data source: one task per member, members and tables chosen before they are read.

    register_archives(spark)
    spark.read.format("zip_sections").load(folder).where("member = 'report3.csv' AND table = 'ORDERS'")

Partitions are planned from each archive's central directory, so an archive of many members is read by as many tasks and
only the bytes of wanted members are fetched. Equalities and lists on ``archive``, ``member`` and ``table`` are pushed into the reader
where ``spark.sql.python.filterPushdown.enabled`` is on (``register_archives`` turns it on). Paths are those that pyarrow opens:
local and mounted folders, hdfs, s3 and gs addresses; folders are listed one level deep. For other stores use
``read_zip_tables``, which reads whole archives through Spark.
"""

from __future__ import annotations

import posixpath
import zipfile
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from tidemark.sources.sections import LINES_PER_BATCH, ZIP_LINES, _layouts, member_lines, read_sections

FORMAT = "zip_sections"
LISTERS = 32
_ARROW = pa.schema([(f.name, pa.int64() if f.dataType.typeName() == "long" else pa.string()) for f in ZIP_LINES])


def _filesystem(path: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(path)


def _zips(path: str) -> list[str]:
    """The archives at a path: itself, or the zip files in a folder."""
    from pyarrow import fs
    files, inside = _filesystem(path)
    if files.get_file_info(inside).type != fs.FileType.Directory:
        return [path]
    found = files.get_file_info(fs.FileSelector(inside))
    return sorted(posixpath.join(path, f.base_name) for f in found if f.is_file and f.base_name.lower().endswith(".zip"))


def _opened(path: str):
    files, inside = _filesystem(path)
    return zipfile.ZipFile(files.open_input_file(inside))


@dataclass
class Member(InputPartition):
    """One CSV member of one archive."""

    archive: str
    member: str


class MemberReader(DataSourceReader):
    """Reads the tagged lines of members; ``tables`` and ``heads_only`` as in ``unzip_lines``."""

    def __init__(self, path: str, tables: Iterable[str] | None, heads_only: bool):
        self.path, self.heads_only = path, heads_only
        self.wanted: dict[str, frozenset | None] = {"archive": None, "member": None, "table": frozenset(tables) if tables is not None else None}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes over tests of archive, member and table; rows outside sections have no table and fail such a test anyway."""
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            values = frozenset([f.value] if isinstance(f, EqualTo) else f.value) if name in self.wanted else frozenset()
            if name not in self.wanted or None in values:
                yield f
                continue
            before = self.wanted[name]
            self.wanted[name] = values if before is None else before & values

    def _takes(self, column: str, value: str) -> bool:
        return self.wanted[column] is None or value in self.wanted[column]

    def partitions(self) -> list[Member]:
        def members(archive: str) -> list[Member]:
            with _opened(archive) as opened:
                return [Member(archive, m) for m in opened.namelist() if m.lower().endswith(".csv") and self._takes("member", m)]

        archives = [a for a in _zips(self.path) if self._takes("archive", a)]
        with ThreadPoolExecutor(LISTERS) as pool:
            found = [m for some in pool.map(members, archives) for m in some]
        return found or [Member("", "")]  # Spark asks for one partition at least

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        if not partition.member:
            return
        with _opened(partition.archive) as archive:
            held: list[dict] = []
            for row in member_lines(archive, partition.member, self.wanted["table"], self.heads_only):
                held.append(dict(zip(ZIP_LINES.names, (partition.archive, partition.member, *row))))
                if len(held) == LINES_PER_BATCH:
                    yield pa.RecordBatch.from_pylist(held, schema=_ARROW)
                    held = []
            if held:
                yield pa.RecordBatch.from_pylist(held, schema=_ARROW)


class ZipSections(DataSource):
    """The data source; options: path, tables (comma-separated), heads_only."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self):
        return ZIP_LINES

    def reader(self, schema) -> MemberReader:
        tables = self.options.get("tables")
        return MemberReader(self.options["path"], tables.split(",") if tables else None, self.options.get("heads_only", "false").lower() == "true")


def register_archives(spark: SparkSession) -> None:
    """Make the format known to a session and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ZipSections)


def scan_archives(spark: SparkSession, path: str, tables: list[str] | None = None, heads_only: bool = False) -> DataFrame:
    """Tagged lines of all members of the archives at ``path``, with ``file`` as in ``unzip_lines``."""
    register_archives(spark)
    reader = spark.read.format(FORMAT).option("heads_only", str(heads_only).lower())
    if tables is not None:
        reader = reader.option("tables", ",".join(tables))
    return reader.load(path).selectExpr("concat_ws('!', archive, member) AS file", "*")


def read_archive_tables(
    spark: SparkSession, path: str, tables: list[str] | None = None, drop_metadata: bool | int = True,
    headers: dict[str, list[str]] | None = None, **options,
) -> dict[str, DataFrame]:
    """The tables of all archives at ``path``, read member by member; options as in ``read_sections``."""
    layouts = None if headers is not None else _layouts(scan_archives(spark, path, tables, heads_only=True))
    return read_sections(scan_archives(spark, path, tables), tables=tables, headers=headers, layouts=layouts,
                         drop_metadata=drop_metadata, **options)
