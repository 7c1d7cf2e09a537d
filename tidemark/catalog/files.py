"""Files written from the driver tables to the shared folder and read back."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from tidemark.catalog import query, table
from tidemark.operators import windows
from tidemark.session import scratch_path, stored
from tidemark.sources import archives, files, sections, synth
from tidemark.streaming.history import read_distinct_history, read_history, stream_distinct_history, stream_history

CUSTOMER_SQL = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"
CUSTOMER = "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING"


def _customer_csv(spark, sf):
    path = scratch_path(spark, "customer-csv")
    files.write_csv(table(spark, sf, "customer"), path)
    return path


@query("""
SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, c_acctbal, c_mktsegment FROM customer
""")
def csv_strings(spark, sf):
    """All columns as text; the balance is read as a number afterwards, as engines write one number in different ways."""
    return files.scan_csv(spark, _customer_csv(spark, sf)).withColumn("c_acctbal", F.col("c_acctbal").try_cast("double"))


@query(CUSTOMER_SQL)
def csv_typed(spark, sf):
    return files.scan_csv(spark, _customer_csv(spark, sf), CUSTOMER)


@query("SELECT CAST(c_custkey AS INTEGER) AS c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_inferred(spark, sf):
    return files.scan_csv(spark, _customer_csv(spark, sf), infer=True)


@query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def csv_whole_texts(spark, sf):
    """Texts with commas, quotes and line breaks, in as many files as there are tasks."""
    path = scratch_path(spark, "documents-csv")
    documents = table(spark, sf, "documents")
    files.write_csv(documents, path)
    return files.scan_csv(spark, path, documents.schema, multi_line=True)


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderdate IS NULL AS bad FROM orders")
def csv_dates(spark, sf):
    path = scratch_path(spark, "orders-csv")
    shown = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "d/M/yyyy H:mm")).otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd"))
    files.write_csv(table(spark, sf, "orders").select("o_orderkey", shown.alias("o_orderdate")), path)
    read = files.scan_csv(spark, path, "o_orderkey BIGINT, o_orderdate TIMESTAMP", date_cols=["o_orderdate"],
                          fmt=["d/M/yyyy H:mm", "yyyy-MM-dd"])
    return read.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"),
                       F.col("o_orderdate").isNull().alias("bad"))


@query("""
SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_nationkey END AS s_nationkey FROM supplier
""")
def csv_tolerant(spark, sf):
    """Bad cells become null and surplus fields are dropped."""
    path = scratch_path(spark, "supplier-lines")
    cell = F.when(F.col("s_suppkey") % 3 == 0, F.lit("n/a")).otherwise(F.col("s_nationkey").cast("string"))
    line = F.concat_ws(",", "s_suppkey", cell, F.when(F.col("s_suppkey") % 2 == 0, F.lit("surplus")))
    table(spark, sf, "supplier").select(line.alias("value")).write.text(path)
    return files.scan_csv(spark, path, "s_suppkey BIGINT, s_nationkey INT", header=False)


LINES_PER_FILE = 5_000


def _order_sections(spark, sf):
    """Lines of files with an orders and a customers part each, as (chunk, place, seq, text).

    A file holds the orders of a range of keys, so its length is bounded.
    """
    orders = table(spark, sf, "orders").select(
        F.floor(F.col("o_orderkey") / LINES_PER_FILE).alias("chunk"), F.lit(2).alias("place"),
        F.col("o_orderkey").alias("seq"),
        F.concat_ws(",", F.lit("D"), F.lit("SALES"), F.lit("ORDERS"), F.lit("1"), "o_orderkey", "o_custkey",
                    F.format_string("%.2f", F.col("o_totalprice")), "o_orderpriority").alias("text"))
    stats = orders.select("chunk").distinct()
    frame = [
        (0, "C,HEADER,REPORT"), (1, "I,SALES,ORDERS,1,ORDERKEY,CUSTKEY,TOTAL,PRIORITY"),
        (3, "I,SALES,STATUS,1,KEY,STATE"), (5, "C,END OF REPORT"),
    ]
    fixed = stats.select("chunk", F.inline(F.array(*[
        F.struct(F.lit(p).alias("place"), F.lit(0).cast("bigint").alias("seq"), F.lit(t).alias("text")) for p, t in frame
    ])))
    states = table(spark, sf, "orders").select(
        F.floor(F.col("o_orderkey") / LINES_PER_FILE).alias("chunk"), F.lit(4).alias("place"),
        F.col("o_orderkey").alias("seq"),
        F.concat_ws(",", F.lit("D"), F.lit("SALES"), F.lit("STATUS"), F.lit("1"), "o_orderkey", "o_orderstatus").alias("text"))
    return orders.unionByName(fixed).unionByName(states)


def _section_files(spark, sf):
    path = scratch_path(spark, "sections")
    (_order_sections(spark, sf).repartition("chunk").sortWithinPartitions("chunk", "place", "seq")
     .select("chunk", "text").write.partitionBy("chunk").text(path))
    return path


SALES_SQL = """
SELECT o_orderkey AS orderkey, o_custkey AS custkey, o_totalprice AS total, o_orderpriority AS priority FROM orders
"""
SALES_TYPES = {"ORDERS": {"ORDERKEY": "bigint", "CUSTKEY": "bigint", "TOTAL": "double"},
               "STATUS": {"KEY": "bigint"}}


@query(SALES_SQL + "WHERE o_custkey > 100")
def sections_read(spark, sf):
    lines = files.read_lines(spark, f"{_section_files(spark, sf)}/*")
    found = sections.read_sections(lines, tables=["ORDERS"], schemas=SALES_TYPES, drop_metadata=True,
                                   conditions={"orders": [("custkey", ">", 100)]})
    return found["orders"]


@query("SELECT o_orderkey AS key, o_orderstatus AS state FROM orders")
def sections_columns(spark, sf):
    lines = files.read_lines(spark, f"{_section_files(spark, sf)}/*")
    return sections.read_sections(lines, columns={"STATUS": ["KEY", "STATE"]}, schemas=SALES_TYPES)["status"]


@query("""
SELECT CAST(count(*) AS BIGINT) AS lines, CAST(sum(len) AS BIGINT) AS bytes FROM (
  SELECT length(concat_ws(',', 'D', 'SALES', 'STATUS', '1', o_orderkey, o_orderstatus)) + 1 AS len FROM orders)
""")
def sections_ranges(spark, sf):
    """Lines and bytes of the data of all sections named STATUS, by their byte ranges."""
    tagged = sections.tag_sections(files.read_lines(spark, f"{_section_files(spark, sf)}/*"))
    ranges = sections.section_ranges(tagged).filter(F.col("table") == "STATUS")
    heading = len("I,SALES,STATUS,1,KEY,STATE\n")
    lines = tagged.filter((F.col("table") == "STATUS") & (F.col("kind") == "D")).agg(F.count(F.lit(1)).alias("lines"))
    size = ranges.agg(F.sum(F.col("end") - F.col("start") - heading).alias("bytes"))
    return lines.join(size, F.lit(True))


def _archives(spark, sf):
    """One zip archive of a sectioned file per range of order keys, as (path, content)."""
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["place", "seq"])
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
            archive.writestr("report.csv", "\n".join(pdf["text"]) + "\n")
        return pd.DataFrame({"path": [f"report{pdf['chunk'].iloc[0]}.zip"], "content": [buffer.getvalue()]})

    packed = _order_sections(spark, sf).groupBy("chunk").applyInPandas(pack, "path STRING, content BINARY")
    path = scratch_path(spark, "archives")
    files.write_parquet(packed, path)
    return files.scan_parquet(spark, path)


@query(SALES_SQL)
def zip_tables(spark, sf):
    found = sections.read_zip_tables(_archives(spark, sf), tables=["ORDERS"], schemas=SALES_TYPES)
    return found["orders"]


@query(SALES_SQL)
def zip_members(spark, sf):
    """Archives of several members each, written to the shared folder and read by one task a member."""
    folder = scratch_path(spark, "zips")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs
        store, inside = fs.FileSystem.from_uri(folder)
        store.create_dir(inside)
        name = f"reports{pdf['chunk'].iloc[0] // 4}.zip"
        with store.open_output_stream(f"{inside}/{name}") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            for chunk, part in pdf.groupby("chunk"):
                archive.writestr(f"report{chunk}.csv", "\n".join(part.sort_values(["place", "seq"])["text"]) + "\n")
        return pd.DataFrame({"name": [name]})

    stored(_order_sections(spark, sf).groupBy(F.floor(F.col("chunk") / 4)).applyInPandas(pack, "name STRING"))
    return archives.read_archive_tables(spark, folder, tables=["ORDERS"], schemas=SALES_TYPES)["orders"]


@query("""
SELECT s.* FROM (SELECT CAST(o_orderkey AS VARCHAR) AS okey, CAST(o_custkey AS VARCHAR) AS ckey,
  row_number() OVER (PARTITION BY o_orderkey // 5000 ORDER BY o_orderkey) AS nth FROM orders) s WHERE nth <= 3
""")
def csv_range(spark, sf):
    """Two columns and three rows below the second line of each file: a rectangle of a sheet."""
    found = files.scan_csv_range(spark, f"{_section_files(spark, sf)}/*", skip=1, n=3, columns={4: "okey", 5: "ckey"})
    return found.select("okey", "ckey", (F.col("line_no") - 2).alias("nth"))


@query("""
SELECT o_orderkey, o_custkey, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month
FROM orders WHERE year(o_orderdate) = 1997 AND month(o_orderdate) >= 6
""")
def parquet_partitions(spark, sf):
    """Parquet in year=/month= folders; the filter reads the folders it names only."""
    path = scratch_path(spark, "orders-hive")
    dated = table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"))
    files.write_parquet(dated.repartition("year", "month"), path, by=["year", "month"])
    return files.scan_parquet(spark, path, (F.col("year") == 1997) & (F.col("month") >= 6))


@query("""
SELECT vec_id, label, CAST(len(embedding) AS INTEGER) AS dims,
       CAST(list_sum(list_transform(embedding, lambda e, i: i * CAST(floor(CAST(e AS DOUBLE) * 1048576) AS BIGINT))) AS BIGINT) AS checksum
FROM embeddings
""")
def parquet_zstd(spark, sf):
    path = scratch_path(spark, "embeddings")
    files.write_parquet(table(spark, sf, "embeddings"), path, "zstd")
    weighed = F.transform("embedding", lambda e, i: (i + 1) * F.floor(e.cast("double") * 1048576))
    checksum = F.aggregate(weighed, F.lit(0).cast("bigint"), lambda total, e: total + e)
    return files.scan_parquet(spark, path).select("vec_id", "label", F.size("embedding").alias("dims"), checksum.alias("checksum"))


@query("""
SELECT n_regionkey AS region, count(DISTINCT 1) AS files, CAST(sum(length(n_name) + 1) AS BIGINT) AS length FROM nation GROUP BY n_regionkey
""")
def file_inventory(spark, sf):
    """Files and bytes of a text table with a folder and a file per region."""
    path = scratch_path(spark, "names")
    table(spark, sf, "nation").repartition("n_regionkey").select("n_regionkey", "n_name").write.partitionBy("n_regionkey").text(path)
    found = files.file_inventory(spark, f"{path}/n_regionkey=*")
    region = F.regexp_extract("path", "n_regionkey=(\\d+)", 1).cast("int")
    return found.groupBy(region.alias("region")).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("length"))


def _label_batches(spark, sf):
    labels = table(spark, sf, "labels")
    return (labels.filter("doc_id % 2 = 0").unionByName(labels.filter("doc_id % 4 = 0")),
            labels.filter("doc_id % 2 = 1").unionByName(labels.filter("doc_id % 9 = 0")))


@query("""
SELECT doc_id, quality, toxic FROM labels WHERE doc_id % 2 = 0
UNION ALL SELECT doc_id, quality, toxic FROM labels WHERE doc_id % 2 = 1
UNION ALL SELECT doc_id, quality, toxic FROM labels WHERE doc_id % 9 = 0
""")
def stream_history_batches(spark, sf):
    """Two deliveries read by a file stream into one history."""
    source, history, state = (scratch_path(spark, n) for n in ("deliveries", "history", "stream-state"))
    schema = table(spark, sf, "labels").schema
    for delivery in _label_batches(spark, sf):
        delivery.write.mode("append").parquet(source)
        stream_history(spark, source, history, schema, checkpoint=state).awaitTermination()
    return read_history(spark, history)


@query("""
WITH d AS (SELECT 0 AS part, * FROM labels WHERE doc_id % 2 = 0 UNION ALL SELECT 0, * FROM labels WHERE doc_id % 4 = 0
  UNION ALL SELECT 1, * FROM labels WHERE doc_id % 2 = 1 UNION ALL SELECT 1, * FROM labels WHERE doc_id % 9 = 0
  UNION ALL SELECT 2, * FROM labels WHERE doc_id % 3 = 0 UNION ALL SELECT 2, * FROM labels WHERE doc_id % 6 = 0)
SELECT DISTINCT doc_id, quality, toxic FROM d WHERE part < 2 UNION ALL SELECT doc_id, quality, toxic FROM d WHERE part = 2
""")
def stream_history_stateful(spark, sf):
    """Three deliveries, the query started anew for each: its state knows which rows are old."""
    source, history, state = (scratch_path(spark, n) for n in ("deliveries", "history", "stream-state"))
    labels = table(spark, sf, "labels")
    for delivery in (*_label_batches(spark, sf), labels.filter("doc_id % 3 = 0").unionByName(labels.filter("doc_id % 6 = 0"))):
        delivery.write.mode("append").parquet(source)
        stream_distinct_history(spark, source, history, labels.schema, checkpoint=state).awaitTermination()
    return read_distinct_history(spark, history)


@query("""
SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS bad_ints, CAST(0 AS BIGINT) AS bad_floats, CAST(0 AS BIGINT) AS bad_times,
       CAST(30 AS BIGINT) AS categories, true AS some_missing, CAST(0 AS BIGINT) AS changed FROM orders
""")
def random_columns(spark, sf):
    """Synthetic columns for every order; the line says how far they keep to their ranges."""
    spec = dict(
        str_cols={"count": 1, "name": ["category"], "str_len": [(5, 20)], "str_count": [30]},
        ts_cols={"count": 1, "name": ["start_date"], "start_date": "2020-01-01", "end_date": "2023-01-01", "freq": "MS"},
        int_cols={"count": 1, "low": 5, "high": 8}, float_cols={"count": 1, "low": 0.0, "high": 100.0, "missing_pct": 0.1})
    keys = table(spark, sf, "orders").select("o_orderkey")
    drawn = synth.random_columns(keys, "o_orderkey", **spec)
    again = synth.random_columns(keys.repartition(3), "o_orderkey", **spec)
    changed = drawn.unionByName(again).distinct().groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    count_if = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    stats = drawn.agg(
        F.count(F.lit(1)).alias("n_rows"), count_if(~F.col("i1").between(5, 7)).alias("bad_ints"),
        count_if((F.col("f1") < 0) | (F.col("f1") >= 100)).alias("bad_floats"),
        count_if((F.dayofmonth("start_date") != 1) | ~F.year("start_date").between(2020, 2022)).alias("bad_times"),
        F.count_distinct("category").alias("categories"),
        (F.count("f1") < F.count(F.lit(1))).alias("some_missing"))
    return stats.join(changed.agg(F.count(F.lit(1)).alias("changed")), F.lit(True))


@query("""
SELECT n.o_orderkey, strftime(TIMESTAMP '2020-01-01' + to_minutes(30 * n.i), '%Y-%m-%d %H:%M:%S') AS at, true AS in_range
FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) n
""")
def random_table(spark, sf):
    """A synthetic table with a row for every order, in key order; its times run by the half hour, its numbers keep to their range."""
    keys = stored(windows.numbered(table(spark, sf, "orders").select("o_orderkey"), [], ["o_orderkey"], "i"))
    drawn = synth.random_table(
        spark, keys.count(), str_cols={"count": 1, "name": ["kind"], "col_strs": [["a", "b"]]},
        ts_cols={"count": 1, "name": ["at"], "start_date": "2020-01-01", "end_date": "9000-01-01", "freq": "30min"},
        int_cols={"count": 1, "low": -3, "high": 4}, float_cols={"count": 1, "low": 1.0, "high": 2.0})
    kept = F.col("kind").isin("a", "b") & F.col("i1").between(-3, 3) & (F.col("f1") >= 1) & (F.col("f1") < 2)
    step = (F.unix_timestamp("at") - F.unix_timestamp(F.lit("2020-01-01").cast("timestamp"))) / 1800 + 1
    return drawn.withColumn("i", step.cast("long")).join(keys.withColumn("i", F.col("i").cast("long")), "i").select(
        "o_orderkey", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"), kept.alias("in_range"))
