"""Filters, joins, aggregates, windows, sets and facets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import query, table
from tidemark.operators import (
    aggregate, clean, compare, expand, facet_index, facets, hashed_diff, semi_filter, user_aggregate, windows,
)
from tidemark.plans import rfm as segments
from tidemark.sources.files import frame_from_rows, scan_parquet, sql_over

RFM_START = "1995-01-01 00:00:00"


def purchases(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", F.col("l_quantity").cast("decimal(12,2)").alias("qty"),
        F.col("l_extendedprice").cast("decimal(14,2)").alias("price"))
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))


PURCHASES_SQL = """
WITH d AS (
  SELECT o_custkey AS customer, date_diff('second', TIMESTAMP '1995-01-01 00:00:00', o_orderdate) AS recency,
         o_orderdate, CAST(l_quantity AS DECIMAL(12,2)) * CAST(l_extendedprice AS DECIMAL(14,2)) AS amount
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
m AS (SELECT customer, max(recency) AS recency FROM d GROUP BY customer),
"""
RFM_SQL = PURCHASES_SQL + """
k AS (SELECT * FROM d WHERE {keep}),
t AS (SELECT customer, count(o_orderdate) AS frequency, CAST(sum(amount) AS DOUBLE) AS monetary_value
      FROM k GROUP BY customer),
r AS (SELECT DISTINCT k.customer, k.recency, t.frequency, t.monetary_value FROM k JOIN t ON k.customer = t.customer)
"""
AS_WRITTEN = RFM_SQL.format(keep="recency IN (SELECT recency FROM m)")
PER_CUSTOMER = RFM_SQL.format(keep="(customer, recency) IN (SELECT customer, recency FROM m)")


def _rfm(spark, sf, per_customer):
    found = segments.rfm(purchases(spark, sf), "o_custkey", "o_orderdate", "qty", "price", RFM_START, per_customer)
    return found.withColumn("monetary_value", F.col("monetary_value").cast("double"))


@query(AS_WRITTEN + "SELECT customer, recency, frequency, monetary_value FROM r")
def rfm_as_written(spark, sf):
    return _rfm(spark, sf, False).select("customer", "recency", "frequency", "monetary_value")


@query(PER_CUSTOMER + "SELECT customer, recency, frequency, monetary_value FROM r")
def rfm_per_customer(spark, sf):
    return _rfm(spark, sf, True).select("customer", "recency", "frequency", "monetary_value")


@query("""
SELECT n_name, count(DISTINCT o_custkey) AS buyers
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
GROUP BY n_name ORDER BY buyers DESC, n_name
""")
def buyers_per_nation(spark, sf):
    # each buyer once: large buyers shrink on the map side, and the join sees no repeats
    buyers = table(spark, sf, "orders").select("o_custkey").distinct()
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, sf, "nation").select("n_nationkey", "n_name")
    joined = buyers.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(
        nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return aggregate.distinct_per_group(joined, "n_name", "o_custkey", "buyers")


@query("""
SELECT 'o_custkey' AS "column", count(o_custkey) AS "count", round(avg(o_custkey), 4) AS mean,
       round(stddev_samp(o_custkey), 4) AS stddev, CAST(min(o_custkey) AS DOUBLE) AS "min", CAST(max(o_custkey) AS DOUBLE) AS "max"
FROM orders
UNION ALL
SELECT 'o_totalprice', count(o_totalprice), round(avg(o_totalprice), 4), round(stddev_samp(o_totalprice), 4),
       min(o_totalprice), max(o_totalprice) FROM orders
""")
def orders_profile(spark, sf):
    found = aggregate.profile(table(spark, sf, "orders"), ["o_custkey", "o_totalprice"])
    return found.withColumns({"mean": F.round("mean", 4), "stddev": F.round("stddev", 4)})


@query(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", " + ", ".join(f"CAST(quantile_disc({c}, {q / 100}) AS DOUBLE) AS q{q}" for q in (25, 50, 75)) + " FROM orders"
    for c in ("o_custkey", "o_totalprice")))
def orders_summary(spark, sf):
    return aggregate.exact_quartiles(table(spark, sf, "orders"), ["o_custkey", "o_totalprice"])


@query(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", " + ", ".join(
        f"(SELECT count(*) FROM orders WHERE {c} <= (SELECT quantile_disc({c}, {q / 100}) FROM orders)) AS q{q}_upto" for q in (25, 50, 75))
    for c in ("o_custkey", "o_totalprice")))
def orders_summary_ranks(spark, sf):
    """How many rows each quartile cuts off."""
    orders = table(spark, sf, "orders")
    names = ["o_custkey", "o_totalprice"]
    marks = {r["column"]: r for r in aggregate.exact_quartiles(orders, names).collect()}
    upto = lambda n, q: F.count(F.when(F.col(n) <= F.lit(marks[n][q]), 1)).alias(f"{q}_upto")
    lines = [F.struct(F.lit(n).alias("column"), *[upto(n, q) for q in ("q25", "q50", "q75")]).alias(n) for n in names]
    return orders.agg(*lines).select(F.inline(F.array(*names)))


@query("""
SELECT strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S') AS mn, strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') AS mx,
       round(avg(epoch(o_orderdate)), 4) AS ag, sum(epoch(o_orderdate)) AS sm FROM orders
""")
def orders_time_stats(spark, sf):
    shown = {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("mn", "mx")}
    return aggregate.time_stats(table(spark, sf, "orders"), "o_orderdate").withColumns(
        {**shown, "ag": F.round("ag", 4)})


@query("""
SELECT 'orders' AS name, (SELECT count(*) FROM orders) AS n_rows, CAST(6 AS BIGINT) AS n_columns
UNION ALL SELECT 'lineitem', (SELECT count(*) FROM lineitem), 11
""")
def table_shapes(spark, sf):
    lines = [(n, *aggregate.shape(table(spark, sf, n))) for n in ("orders", "lineitem")]
    return frame_from_rows(spark, lines, "name STRING, n_rows BIGINT, n_columns BIGINT")


@query("SELECT count(DISTINCT o_custkey) AS n, true AS close FROM orders")
def distinct_count(spark, sf):
    """The exact count, and whether the sketch comes within a tenth of it."""
    orders = table(spark, sf, "orders")
    exact = aggregate.distinct_count(orders, "o_custkey")
    sketch = aggregate.distinct_count(orders, "o_custkey", approximate=True).withColumnRenamed("n", "about")
    return exact.join(sketch, F.lit(True)).select("n", (F.abs(F.col("about") - F.col("n")) <= F.col("n") / 10).alias("close"))


@query("""
SELECT l_returnflag, count(DISTINCT l_orderkey) AS orders, count(*) AS lines, max(l_quantity) AS most,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(14,2))) AS DOUBLE) AS total
FROM lineitem GROUP BY l_returnflag
""")
def grouped_stats(spark, sf):
    price = F.col("l_extendedprice").cast("decimal(14,2)")
    return aggregate.group_stats(
        table(spark, sf, "lineitem"), ["l_returnflag"], orders=F.count_distinct("l_orderkey"),
        lines=F.count(F.lit(1)), most=F.max("l_quantity"), total=F.sum(price).cast("double"))


@query("""
SELECT l_linestatus, round(avg(l_quantity), 4) AS l_quantity, round(avg(l_discount), 4) AS l_discount,
       round(avg(l_tax), 4) AS l_tax FROM lineitem GROUP BY l_linestatus
""")
def grouped_means(spark, sf):
    columns = ["l_quantity", "l_discount", "l_tax"]
    means = aggregate.group_means(table(spark, sf, "lineitem"), "l_linestatus", columns)
    return means.withColumns({c: F.round(c, 4) for c in columns})


@query("""
SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, TRY_CAST(event_type AS DOUBLE) AS word,
       strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS stamp, CAST(NULL AS VARCHAR) AS bad
FROM events
""")
def cast_tolerant(spark, sf):
    raw = table(spark, sf, "events").select(
        "event_id", F.get_json_object("props", "$.k").alias("k"), F.col("event_type").alias("word"),
        F.date_format("ts", "d/M/yyyy H:mm").alias("stamp"), F.date_format("ts", "yyyy").alias("bad"))
    typed = clean.cast_columns(raw, {
        "k": "int", "word": "double", "stamp": ("timestamp", "d/M/yyyy H:mm"), "bad": ("timestamp", "d/M/yyyy H:mm")})
    return typed.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("stamp", "bad")})


@query("""
SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_orderstatus ELSE o_orderpriority END AS cd
FROM orders
""")
def case_when_isin(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    tagged = clean.case_when(orders, "cd", "o_orderpriority", ["1-URGENT", "2-HIGH"],
                             F.col("o_orderstatus"), F.col("o_orderpriority"))
    return tagged.select("o_orderkey", "cd")


@query("SELECT s_name AS supplier_name, s_suppkey FROM supplier")
def project_renamed(spark, sf):
    picked = clean.pick(table(spark, sf, "supplier"), ["s_name", "s_suppkey", "s_acctbal"])
    upper = picked.toDF("SUPPLIER_NAME", "S_Suppkey", "S_ACCTBAL")
    return clean.drop_columns(clean.lower_names(upper), ["s_acctbal"])


@query("""
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
WHERE l_quantity >= 10 AND l_quantity < 20 AND l_discount <= 0.02
""")
def where_ranges(spark, sf):
    kept = scan_parquet(spark, f"{sf}/lineitem.parquet",
                        "l_quantity >= 10 AND l_quantity < 20 AND l_discount <= 0.02")
    return kept.select("l_orderkey", "l_linenumber", "l_quantity")


@query("""
SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem
WHERE l_returnflag IN ('A', 'R') AND l_tax = 0.0 AND l_quantity BETWEEN 5 AND 9 AND l_shipdate IS NOT NULL
""")
def where_conditions(spark, sf):
    kept = clean.where_conditions(table(spark, sf, "lineitem"), [
        ("l_returnflag", "in", ["A", "R"]), ("l_tax", "==", 0.0), ("l_quantity", "between", (5, 9)),
        ("l_shipdate", "not null")])
    return kept.select("l_orderkey", "l_linenumber", "l_returnflag")


@query("SELECT * EXCLUDE (o_orderdate) FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '5-LOW'")
def facet_filter(spark, sf):
    chosen = {"o_orderstatus": "F", "o_orderpriority": "5-LOW", "o_custkey": None}
    return facets.facet_filter(table(spark, sf, "orders"), chosen).drop("o_orderdate")


@query("""
SELECT DISTINCT 'o_orderstatus' AS facet, o_orderstatus AS value FROM orders
UNION ALL SELECT DISTINCT 'o_orderpriority', o_orderpriority FROM orders
""")
def facet_options(spark, sf):
    return facets.facet_options(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("""
SELECT n_name AS option, n_name IN ('NATION_2', 'NATION_7', 'NATION_9') AS selected
FROM (SELECT DISTINCT n_name FROM nation JOIN region ON n_regionkey = r_regionkey
      JOIN customer ON c_nationkey = n_nationkey WHERE r_name = 'ASIA')
ORDER BY option
""")
def cascade_options(spark, sf):
    nations = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    held = table(spark, sf, "customer").select("c_nationkey").join(
        nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return facets.cascade_options(held, "r_name", "ASIA", "n_name", ["NATION_2", "NATION_7", "NATION_9"])


@query("""
SELECT d.doc_id, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
WHERE quality IS NOT NULL AND toxic IS NOT NULL
""")
def nulls_dropped(spark, sf):
    joined = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    return clean.drop_missing(joined, ["quality", "toxic"])


@query("""
SELECT d.doc_id, coalesce(quality, 0) AS quality, coalesce(toxic, 0) AS toxic,
       coalesce(CASE WHEN quality = 1 THEN source END, '0') AS good_source
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
""")
def nulls_filled(spark, sf):
    joined = table(spark, sf, "documents").select("doc_id", "source").join(
        table(spark, sf, "labels"), "doc_id", "left")
    tagged = joined.withColumn("good_source", F.when(F.col("quality") == 1, F.col("source"))).drop("source")
    return clean.fill_missing(tagged, 0, "0")


@query("""
SELECT doc_id, CASE lang WHEN 'en' THEN 'english' WHEN 'fr' THEN 'french' ELSE lang END AS lang FROM documents
""")
def map_values(spark, sf):
    return clean.map_values(table(spark, sf, "documents").select("doc_id", "lang"),
                            {"lang": {"en": "english", "fr": "french"}})


@query("SELECT s_suppkey, '2022-06-23' AS snapshot FROM supplier")
def with_constant(spark, sf):
    return clean.with_constant(table(spark, sf, "supplier").select("s_suppkey"), "snapshot", "2022-06-23")


@query("""
WITH c AS (
  SELECT p_partkey, 2005 + p_size % 20 AS year, CASE WHEN contains(lower(p_name), 'ring') THEN 3
         WHEN contains(lower(p_name), 'bolt') OR contains(lower(p_name), 'gear') THEN 2 ELSE 1 END AS grade,
         p_type, p_retailprice FROM part)
SELECT p_partkey, CAST(grade AS INTEGER) AS grade, CAST(year - 2026 AS INTEGER) AS age,
       round(CAST(year + (grade - 2) * 0.3 + CASE WHEN p_type = 'ECONOMY' THEN 0 ELSE 0.12 END AS DOUBLE), 4) AS year,
       round(p_retailprice * 0.0001, 6) AS p_retailprice FROM c
""")
def derive_adjusted(spark, sf):
    parts = table(spark, sf, "part").withColumn("year", F.lit(2005) + F.col("p_size") % 20)
    graded = clean.keyword_grade(parts, "grade", "p_name", [("ring", 3), (["bolt", "gear"], 2)], 1)
    bonus = F.when(F.col("p_type") == "ECONOMY", 0.0).otherwise(0.12)
    return clean.derive(
        graded, age=F.col("year") - 2026, year=F.round(F.col("year") + (F.col("grade") - 2) * 0.3 + bonus, 4),
        p_retailprice=F.round(F.col("p_retailprice") * 0.0001, 6),
    ).select("p_partkey", "grade", "age", "year", "p_retailprice")


@query("""
SELECT l_orderkey, l_linenumber, round(l_quantity * l_extendedprice, 2) AS amount FROM lineitem
""")
def derive_amount(spark, sf):
    return clean.derive(table(spark, sf, "lineitem"), amount=F.round(F.col("l_quantity") * F.col("l_extendedprice"), 2)
                        ).select("l_orderkey", "l_linenumber", "amount")


@query("""
SELECT p_partkey, CASE WHEN contains(lower(p_name), 'red') THEN 'warm' WHEN contains(lower(p_name), 'blue')
       OR contains(lower(p_name), 'cold') THEN 'cool' ELSE 'plain' END AS tone,
       CASE WHEN contains(lower(p_type), 'eco') THEN 3 WHEN contains(lower(p_type), 'small') THEN 2 ELSE 1 END AS grade
FROM part
""")
def keyword_grade(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", "p_name", "p_type")
    toned = clean.keyword_grade(parts, "tone", "p_name", [("red", "warm"), (["blue", "cold"], "cool")], "plain")
    return clean.keyword_grade(toned, "grade", "p_type", [("eco", 3), ("small", 2)], 1).drop("p_name", "p_type")


@query("""
SELECT o_orderkey, CASE WHEN o_totalprice < 0 THEN NULL WHEN o_totalprice <= 50000 THEN '050k'
  WHEN o_totalprice <= 75000 THEN '075k' WHEN o_totalprice <= 100000 THEN '100k'
  WHEN o_totalprice <= 125000 THEN '125k' WHEN o_totalprice <= 150000 THEN '150k' ELSE 'maxk' END AS lvl
FROM orders
""")
def bin_values(spark, sf):
    return clean.bin_values(
        table(spark, sf, "orders"), "lvl", "o_totalprice",
        [0, 50_000, 75_000, 100_000, 125_000, 150_000, float("inf")],
        ["050k", "075k", "100k", "125k", "150k", "maxk"],
    ).select("o_orderkey", "lvl")


@query("SELECT l_linenumber, l_quantity FROM lineitem")
def drop_low_variance(spark, sf):
    numbers = table(spark, sf, "lineitem").select("l_linenumber", "l_quantity", "l_discount", "l_tax")
    return clean.drop_low_variance(numbers, 1.0)


@query("SELECT s_suppkey, s_acctbal FROM supplier")
def drop_constant(spark, sf):
    suppliers = table(spark, sf, "supplier").select("s_suppkey", "s_acctbal")
    return clean.drop_constant(suppliers.withColumns({"same": F.lit(7), "none": F.lit(None).cast("string")}))


@query("""
SELECT round(var_pop(l_quantity), 6) AS l_quantity, round(var_pop(l_discount), 6) AS l_discount,
       round(var_pop(l_tax), 6) AS l_tax, round(var_pop(l_linenumber), 6) AS l_linenumber FROM lineitem
""")
def variance_profile(spark, sf):
    columns = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
    found = clean.variances(table(spark, sf, "lineitem"), columns, sample=False)
    return found.select(*[F.round(c, 6).alias(c) for c in columns])


@query("""
SELECT o_orderkey, o_custkey FROM orders
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)
""")
def semi_membership(spark, sf):
    rich = table(spark, sf, "customer").filter("c_acctbal > 9000").select("c_custkey")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return orders.join(rich, F.col("o_custkey") == F.col("c_custkey"), "left_semi")


@query("""
SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem
WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 300000)
""")
def bloom_semi_join(spark, sf):
    """Lines of dear orders; the orders' filter thins the lines before the join."""
    dear = table(spark, sf, "orders").filter("o_totalprice > 300000").select(F.col("o_orderkey").alias("l_orderkey"))
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return semi_filter.bloom_semi_join(lines, dear, ["l_orderkey"])


@query("""
SELECT c_custkey, c_name, n_orders, spent FROM customer JOIN (
  SELECT o_custkey, count(*) AS n_orders, CAST(sum(CAST(o_totalprice AS DECIMAL(14,2))) AS DOUBLE) AS spent
  FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey
""")
def keyed_zip(spark, sf):
    spent = F.sum(F.col("o_totalprice").cast("decimal(14,2)")).cast("double")
    totals = aggregate.group_stats(
        table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"],
        n_orders=F.count(F.lit(1)), spent=spent)
    return compare.keyed_zip(table(spark, sf, "customer").select("c_custkey", "c_name"), totals, "c_custkey")


@query("""
SELECT c_nationkey, string_agg(DISTINCT c_mktsegment, '/' ORDER BY c_mktsegment) AS c_mktsegment,
       string_agg(DISTINCT substr(c_name, 18, 1), '/' ORDER BY substr(c_name, 18, 1)) AS last_digit
FROM customer GROUP BY c_nationkey
""")
def concat_distinct(spark, sf):
    customers = table(spark, sf, "customer").withColumn("last_digit", F.substring("c_name", 18, 1))
    return aggregate.concat_distinct(customers, ["c_nationkey"], ["c_mktsegment", "last_digit"])


@query("""
SELECT l_returnflag, l_linestatus, string_agg(DISTINCT CAST(l_linenumber AS VARCHAR), '/' ORDER BY CAST(l_linenumber AS VARCHAR)) AS numbers,
       round(avg(power(l_extendedprice - m, 3)) / power(avg(power(l_extendedprice - m, 2)), 1.5), 6) AS skew
FROM (SELECT *, avg(l_extendedprice) OVER (PARTITION BY l_returnflag, l_linestatus) AS m FROM lineitem) GROUP BY l_returnflag, l_linestatus
""")
def user_aggregates(spark, sf):
    """Two aggregates written in Python, with partial states."""
    found = user_aggregate.aggregate_by(
        table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"],
        numbers=user_aggregate.distinct_texts("l_linenumber"), skew=user_aggregate.skewness("l_extendedprice"))
    return found.withColumn("skew", F.round("skew", 6))


CORR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM lineitem" for a in CORR for b in CORR))
def corr_matrix(spark, sf):
    return aggregate.corr_matrix(table(spark, sf, "lineitem"), CORR).withColumn("corr", F.round("corr", 6))


@query("""
SELECT l_returnflag AS "row", l_linestatus AS col, CAST(sum(CAST(l_extendedprice AS DECIMAL(14,2))) AS DOUBLE) AS total,
       grouping(l_returnflag, l_linestatus) AS level
FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())
""")
def margins(spark, sf):
    price = F.col("l_extendedprice").cast("decimal(14,2)")
    found = aggregate.margins(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", price)
    return found.withColumn("total", F.col("total").cast("double"))


@query("""
SELECT user_id, count(*) AS answered, count(*) FILTER (event_type <> 'error') AS correct,
       count(*) FILTER (event_type = 'error') AS incorrect,
       round(count(*) FILTER (event_type <> 'error') / count(*) * 100, 4) AS percent
FROM events GROUP BY user_id
""")
def scoreboard(spark, sf):
    found = aggregate.scoreboard(table(spark, sf, "events"), "user_id", F.col("event_type") != "error")
    return found.withColumn("percent", F.round("percent", 4))


EARLY_STOP_SQL = """
WITH r AS (
  SELECT user_id, event_id, row_number() OVER w AS answered,
         CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS incorrect
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
s AS (SELECT user_id, min(answered) AS stop FROM r WHERE answered >= 6 AND incorrect / answered > 0.40 GROUP BY user_id)
SELECT r.user_id, event_id, answered, incorrect FROM r LEFT JOIN s ON r.user_id = s.user_id
WHERE stop IS NULL OR answered <= stop
"""


def _early_stop(spark, sf, limit):
    answers = table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type")
    found = windows.early_stop(answers, "user_id", ["ts", "event_id"], F.col("event_type") != "error",
                               max_group_rows=limit)
    return found.select("user_id", "event_id", "answered", "incorrect")


@query(EARLY_STOP_SQL)
def early_stop(spark, sf):
    return _early_stop(spark, sf, None)


@query(EARLY_STOP_SQL)
def early_stop_blocks(spark, sf):
    """The same by blocks, the plan for a user too large for one task."""
    return _early_stop(spark, sf, 0)


RUNNING_SQL = """
SELECT event_id, user_id, CAST(sum(CAST(value AS DECIMAL(12,2))) OVER (
  PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS running FROM events
"""


def _running(spark, sf, limit):
    events = table(spark, sf, "events").select("event_id", "user_id", "ts", F.col("value").cast("decimal(12,2)"))
    found = windows.running_total(events, ["user_id"], ["ts", "event_id"], "value", max_group_rows=limit)
    return found.select("event_id", "user_id", F.col("running").cast("double"))


@query(RUNNING_SQL)
def running_totals(spark, sf):
    return _running(spark, sf, None)


@query(RUNNING_SQL)
def running_totals_blocks(spark, sf):
    """The same by blocks, the plan for a user too large for one task."""
    return _running(spark, sf, 0)


@query("""
SELECT event_id, row_number() OVER (ORDER BY value DESC, event_id) AS n FROM events
""")
def row_numbers(spark, sf):
    events = table(spark, sf, "events").select("event_id", "value")
    return windows.numbered(events, [], [F.desc("value"), "event_id"], max_group_rows=0).select("event_id", "n")


@query("""
WITH r AS (SELECT event_id, user_id, row_number() OVER (ORDER BY ts, event_id) AS up,
                  row_number() OVER (ORDER BY ts DESC, event_id DESC) AS down FROM events)
SELECT event_id, user_id, CASE WHEN up <= 7 THEN 'head' ELSE 'tail' END AS part,
       CASE WHEN up <= 7 THEN up ELSE down END AS position FROM r WHERE up <= 7 OR down <= 7
""")
def head_tail(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "ts")
    return windows.head_tail(events, ["ts", "event_id"], 7).drop("ts")


@query("""
SELECT user_id, event_type, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1
""")
def last_event(spark, sf):
    return windows.last_of(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], ["event_type", "value"])


@query("SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20")
def top_customers(spark, sf):
    customers = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    return aggregate.top_rows(customers, "c_acctbal", 20, "c_custkey")


@query("""
SELECT c_name AS name, c_acctbal AS acctbal, c_mktsegment AS segment, CAST(NULL AS BIGINT) AS suppkey FROM customer
UNION ALL SELECT s_name, s_acctbal, NULL, s_suppkey FROM supplier
""")
def union_by_name(spark, sf):
    customers = table(spark, sf, "customer").select(
        F.col("c_name").alias("name"), F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("segment"))
    suppliers = table(spark, sf, "supplier").select(
        F.col("s_acctbal").alias("acctbal"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("suppkey"))
    return compare.union_by_name(customers, suppliers)


@query("SELECT DISTINCT l_returnflag, l_linestatus, l_discount FROM lineitem")
def distinct_rows(spark, sf):
    return table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_discount").distinct()


@query("SELECT c_nationkey AS nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier ORDER BY 1")
def sorted_intersection(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_nationkey").alias("nationkey"))
    b = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nationkey"))
    return compare.common_values(a, b, "nationkey").orderBy("nationkey")


def _altered(labels):
    """Labels with some values changed, some rows gone and some added."""
    changed = labels.withColumn("quality", F.when(F.col("doc_id") % 7 == 0, 1 - F.col("quality"))
                                .otherwise(F.col("quality"))).filter("doc_id % 11 <> 0")
    extra = labels.filter("doc_id % 13 = 0").withColumn("doc_id", -F.col("doc_id") - 1)
    return changed.unionByName(extra)


@query("""
WITH b AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 1 - quality ELSE quality END AS quality, toxic
           FROM labels WHERE doc_id % 11 <> 0
           UNION ALL SELECT -doc_id - 1, quality, toxic FROM labels WHERE doc_id % 13 = 0),
j AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.doc_id AS ka, b.doc_id AS kb, a.quality AS qa, b.quality AS qb,
             a.toxic AS ta, b.toxic AS tb FROM labels a FULL JOIN b ON a.doc_id = b.doc_id)
SELECT doc_id, 'quality' AS "column", CAST(qa AS VARCHAR) AS "left", CAST(qb AS VARCHAR) AS "right"
FROM j WHERE qa IS DISTINCT FROM qb
UNION ALL SELECT doc_id, 'toxic', CAST(ta AS VARCHAR), CAST(tb AS VARCHAR) FROM j WHERE ta IS DISTINCT FROM tb
UNION ALL SELECT doc_id, '(row)', CASE WHEN ka IS NOT NULL THEN 'present' END, CASE WHEN kb IS NOT NULL THEN 'present' END
FROM j WHERE (ka IS NULL) <> (kb IS NULL)
""")
def frame_diffs(spark, sf):
    labels = table(spark, sf, "labels")
    return compare.frame_diffs(labels, _altered(labels), ["doc_id"])


_FACETS = {"status": ["F", "O"], "priority": "5-LOW"}


def _facet_count_sql(facet, others):
    kept = " AND ".join({"status": "status IN ('F', 'O')", "priority": "priority = '5-LOW'"}[o] for o in others)
    return f"SELECT '{facet}' AS facet, {facet} AS value, count(*) FILTER ({kept}) AS rows FROM o GROUP BY {facet}"


@query("WITH o AS (SELECT o_orderstatus AS status, o_orderpriority AS priority, strftime(o_orderdate, '%Y') AS year FROM orders) " + " UNION ALL ".join([
    _facet_count_sql("status", ["priority"]), _facet_count_sql("priority", ["status"]), _facet_count_sql("year", ["status", "priority"])]))
def facet_counts(spark, sf):
    """How many orders each value of three facets leaves under choices in two of them, from bitmaps."""
    orders = table(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.date_format("o_orderdate", "yyyy").alias("year"))
    columns = ["status", "priority", "year"]
    return facet_index.facet_counts(facet_index.facet_index(orders, columns), columns, _FACETS)


@query("""
WITH b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 500 = 7 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_custkey
           FROM orders WHERE o_orderkey % 997 <> 3),
j AS (SELECT a.o_orderkey, b.o_orderkey AS other, a.o_orderstatus AS qa, b.o_orderstatus AS qb, a.o_custkey AS ca
      FROM orders a LEFT JOIN b ON a.o_orderkey = b.o_orderkey)
SELECT o_orderkey, 'o_orderstatus' AS "column", qa AS "left", qb AS "right" FROM j WHERE qa IS DISTINCT FROM qb
UNION ALL SELECT o_orderkey, 'o_custkey', CAST(ca AS VARCHAR), NULL FROM j WHERE other IS NULL
UNION ALL SELECT o_orderkey, '(row)', 'present', NULL FROM j WHERE other IS NULL
""")
def frame_diffs_hashed(spark, sf):
    """Changed cells of two frames that differ in few rows."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    status = F.when(F.col("o_orderkey") % 500 == 7, "X").otherwise(F.col("o_orderstatus"))
    other = orders.withColumn("o_orderstatus", status).where("o_orderkey % 997 <> 3")
    return hashed_diff.frame_diffs_hashed(orders, other, ["o_orderkey"])


@query("""
WITH b AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 1 - quality ELSE quality END AS quality, toxic
           FROM labels WHERE doc_id % 11 <> 0
           UNION ALL SELECT -doc_id - 1, quality, toxic FROM labels WHERE doc_id % 13 = 0),
c AS (SELECT * FROM labels ORDER BY doc_id DESC),
n AS (SELECT (SELECT count(*) FROM (FROM labels EXCEPT ALL FROM c)) + (SELECT count(*) FROM (FROM c EXCEPT ALL FROM labels)) AS shuffled,
             (SELECT count(*) FROM (FROM labels EXCEPT ALL FROM b)) + (SELECT count(*) FROM (FROM b EXCEPT ALL FROM labels)) AS changed)
SELECT shuffled = 0 AS same, changed = 0 AS altered FROM n
""")
def frames_equal(spark, sf):
    labels = table(spark, sf, "labels")
    lines = [(compare.frames_equal(labels, labels.orderBy(F.desc("doc_id"))),
              compare.frames_equal(labels, _altered(labels)))]
    return frame_from_rows(spark, lines, "same BOOLEAN, altered BOOLEAN")


@query("""
SELECT doc_id, quality, toxic FROM (SELECT DISTINCT * FROM (
  SELECT * FROM labels WHERE doc_id % 2 = 0 UNION ALL SELECT * FROM labels WHERE doc_id % 3 = 0))
UNION ALL SELECT doc_id, quality, toxic FROM labels WHERE doc_id % 3 = 0
UNION ALL SELECT doc_id, quality, toxic FROM labels WHERE doc_id % 2 = 1
""")
def history_append(spark, sf):
    labels = table(spark, sf, "labels")
    old = labels.filter("doc_id % 2 = 0").unionByName(labels.filter("doc_id % 3 = 0"))
    new = labels.filter("doc_id % 3 = 0").unionByName(labels.filter("doc_id % 2 = 1"))
    return compare.append_history(old, new)


@query("""
WITH s AS (SELECT o_custkey, min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders GROUP BY o_custkey)
SELECT o_custkey, CAST(year(m) AS INTEGER) AS year, CAST(month(m) AS INTEGER) AS month FROM (
  SELECT o_custkey, unnest(generate_series(date_trunc('month', a), b - INTERVAL 1 DAY, INTERVAL 1 MONTH)) AS m
  FROM s WHERE date_trunc('month', a) <= b - INTERVAL 1 DAY)
""")
def year_months(spark, sf):
    spans = table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"))
    return expand.year_months(spans, "first", "last").select("o_custkey", "year", "month")


@query("""
WITH s AS (SELECT user_id, date_trunc('hour', min(ts)) AS a, date_trunc('hour', max(ts)) AS b FROM events GROUP BY user_id),
x AS (SELECT user_id, unnest(generate_series(a, b, INTERVAL 30 MINUTE)) AS slot FROM s)
SELECT user_id, strftime(slot, '%Y-%m-%d') AS day, count(*) AS slots, strftime(max(slot), '%H:%M') AS last_slot
FROM x GROUP BY ALL
""")
def half_hour_range(spark, sf):
    spans = table(spark, sf, "events").groupBy("user_id").agg(
        F.date_trunc("hour", F.min("ts")).alias("first"), F.date_trunc("hour", F.max("ts")).alias("last"))
    slots = expand.explode_range(spans, "first", "last").select("user_id", "ts")
    return slots.groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(
        F.count(F.lit(1)).alias("slots"), F.date_format(F.max("ts"), "HH:mm").alias("last_slot"))


TOKENS_SQL = """
WITH t AS (SELECT lang, {words} AS words FROM documents)
SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest({kept}) AS word FROM t) GROUP BY lang, word
"""


def _tokens(spark, sf, words, keep):
    words = table(spark, sf, "documents").select("lang", words.alias("words"))
    spread = expand.explode_list(words, "words", keep_empty=keep, name="word")
    return spread.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))


@query(TOKENS_SQL.format(words="string_split(text, ' ')", kept="words"))
def explode_tokens_drop(spark, sf):
    """All words of all texts."""
    return _tokens(spark, sf, F.split("text", " "), False)


@query(TOKENS_SQL.format(words="regexp_extract_all(text, '[0-9]+')", kept="CASE WHEN len(words) = 0 THEN [NULL] ELSE words END"))
def explode_tokens_keep(spark, sf):
    """All numbers of all texts; a text without any counts as one missing number."""
    return _tokens(spark, sf, F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0)), True)


PAGE_PLAN_SQL = """
WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
p AS (SELECT source, n, CAST(unnest(generate_series(1, CAST(ceil(n / 25) AS BIGINT))) AS INTEGER) AS page FROM c)
"""


@query(PAGE_PLAN_SQL + "SELECT source, n, page, 'https://example.org/' || source || '/list-' || page AS url FROM p")
def page_plan(spark, sf):
    counts = table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    base = F.concat(F.lit("https://example.org/"), F.col("source"), F.lit("/list-"))
    return expand.page_url_plan(counts, "n", base)


@query(PAGE_PLAN_SQL + """
SELECT source, n, page, CASE WHEN page = 1 THEN 'q/' || source ELSE 'q/' || source || '&offset=' || (page - 1) * 25 END AS url
FROM p
""")
def offset_plan(spark, sf):
    counts = table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return expand.offset_plan(counts, "n", F.concat(F.lit("q/"), F.col("source")))


@query("SELECT n_name, n_regionkey FROM nation WHERE n_regionkey >= 2")
def sql_over_scan(spark, sf):
    return sql_over(spark, "SELECT n_name, n_regionkey FROM {data} WHERE n_regionkey >= 2",
                    data=table(spark, sf, "nation"))


@query("""
WITH p AS (SELECT * FROM (VALUES ('1-URGENT', 1), ('2-HIGH', 2), ('3-MEDIUM', 3)) v(priority, weight))
SELECT priority, weight, count(o_orderkey) AS n FROM p LEFT JOIN orders ON o_orderpriority = priority
GROUP BY priority, weight
""")
def frame_from_rows_joined(spark, sf):
    weights = frame_from_rows(spark, [("1-URGENT", 1), ("2-HIGH", 2), ("3-MEDIUM", 3)],
                              "priority STRING, weight INT")
    counted = table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return weights.join(counted, F.col("o_orderpriority") == F.col("priority"), "left").select(
        "priority", "weight", F.coalesce("n", F.lit(0)).alias("n"))
