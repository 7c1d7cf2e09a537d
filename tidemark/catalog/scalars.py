"""Text, number, calendar, JSON and array expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import query, table
from tidemark.functions import calendar, events, numeric, text
from tidemark.session import spread


@query("""
SELECT page_id, regexp_extract(url, '\\d+', 0) AS digits, string_split(url, '/')[-1] AS last_part,
       string_split(url, '/')[-2] AS second_last, replace(string_split(url, '/')[-1], '-', ' ') AS slug,
       substr(url, 1, 4) AS lead, substr(url, 1, length(url) - 1) AS cut, starts_with(url, 'https') AS secure,
       split_part(url, '?', 2) AS tail, lower(url) AS low, contains(url, 'ref=') AS has_ref
FROM pages
""")
def scalar_text(spark, sf):
    url = F.col("url")
    return table(spark, sf, "pages").select(
        "page_id", text.first_digits(url).alias("digits"), text.path_segment(url, 1).alias("last_part"),
        text.path_segment(url, 2).alias("second_last"), text.slug_address(url).alias("slug"),
        text.leading(url, 4).alias("lead"), text.drop_last(url).alias("cut"),
        url.startswith("https").alias("secure"), text.split_field(url, "?", 2).alias("tail"),
        F.lower(url).alias("low"), url.contains("ref=").alias("has_ref"),
    )


@query("""
SELECT p_partkey, CASE WHEN p_size < 5 THEN '1.00k' ELSE CAST(CAST(floor(p_retailprice) AS BIGINT) AS VARCHAR) END AS bare,
       CAST(CASE WHEN p_size < 5 THEN 1000 ELSE floor(p_retailprice) END AS DOUBLE) AS amount
FROM part
""")
def price_text(spark, sf):
    shown = F.when(F.col("p_size") < 5, F.lit(" $1.00k/w ")).otherwise(
        F.concat(F.lit(" $"), F.format_number(F.floor("p_retailprice"), 0), F.lit("/w")))
    return table(spark, sf, "part").select(
        "p_partkey", text.strip_price(shown).alias("bare"), text.thousands(shown).alias("amount"))


@query("""
SELECT source, CAST(count(*) AS BIGINT) AS found, CAST(ceil(count(*) / 25) AS BIGINT) AS pages
FROM documents GROUP BY source
""")
def result_pages(spark, sf):
    counts = table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    summary = F.format_string("25 of %d results", F.col("n"))
    return counts.select("source", text.result_count(summary).alias("found"), text.page_count(summary).alias("pages"))


@query("""
SELECT o_orderkey, printf('zips/%d/%02d/t#%d.zip', year(o_orderdate), month(o_orderdate), o_orderkey) AS path
FROM orders
""")
def archive_paths(spark, sf):
    name = F.concat(F.lit("t%23"), F.col("o_orderkey").cast("string"), F.lit(".zip"))
    return table(spark, sf, "orders").select(
        "o_orderkey",
        text.archive_path("zips", F.year("o_orderdate"), F.month("o_orderdate"), name).alias("path"))


@query("""
SELECT o_orderkey, strftime(o_orderdate, '%d %b %Y') AS shown, strftime(o_orderdate, '%Y-%m-%d') AS parsed,
       date_diff('second', TIMESTAMP '1995-01-01 00:00:00', o_orderdate) AS seconds,
       strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month
FROM orders
""")
def date_text(spark, sf):
    shown = F.date_format("o_orderdate", "dd MMM yyyy")
    start = F.lit("1995-01-01").cast("timestamp_ntz")
    return table(spark, sf, "orders").select(
        "o_orderkey", shown.alias("shown"),
        F.date_format(calendar.parse_date(shown), "yyyy-MM-dd").alias("parsed"),
        calendar.seconds_between(start, F.col("o_orderdate")).alias("seconds"),
        F.date_format(F.date_trunc("month", "o_orderdate"), "yyyy-MM-dd").alias("month"))


@query("""
SELECT event_id, CAST(((event_id - 5000) % 7 + 7) % 7 AS BIGINT) AS by7, CAST(((event_id - 5000) % 8 + 8) % 8 AS BIGINT) AS by8
FROM events
""")
def floor_mod(spark, sf):
    shifted = F.col("event_id") - 5000
    return table(spark, sf, "events").select(
        "event_id", numeric.floor_mod(shifted, 7).alias("by7"), numeric.floor_mod(shifted, 8).alias("by8"))


@query("""
SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice) AS BIGINT) AS down, CAST(ceil(l_extendedprice) AS BIGINT) AS up,
       round(l_extendedprice - floor(l_extendedprice), 6) AS part, round_even(l_quantity / 2, 0) AS even,
       abs(l_quantity - 25) AS off
FROM lineitem
""")
def math_scalars(spark, sf):
    price = F.col("l_extendedprice")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.floor(price).alias("down"), F.ceil(price).alias("up"),
        F.round(numeric.fraction(price), 6).alias("part"), numeric.half_even(F.col("l_quantity") / 2).alias("even"),
        F.abs(F.col("l_quantity") - 25).alias("off"))


@query("""
WITH e AS (SELECT *, o_orderkey % 5 AS n, unnest(CASE WHEN o_orderkey % 5 = 0 THEN [NULL] ELSE generate_series(1, o_orderkey % 5) END) AS i FROM orders)
SELECT o_orderkey, strftime(o_orderdate + to_days(CAST(i AS INTEGER)), '%Y-%m-%d') AS event_date,
       CAST(floor(o_totalprice) AS BIGINT) + i AS price,
       CASE WHEN n > 0 THEN strftime(o_orderdate + to_days(CAST(n AS INTEGER)), '%Y-%m-%d') END AS newest,
       n, CAST(-500 AS BIGINT) AS amount
FROM e
""")
def event_encode_decode(spark, sf):
    """Price events of each order, up to four, written as text and read back as rows; an order without any has one row."""
    entry = lambda i: F.struct(
        F.date_add(F.col("o_orderdate").cast("date"), i).alias("event_date"),
        (F.floor("o_totalprice") + i).alias("price"))
    count = (F.col("o_orderkey") % 5).cast("int")
    made = F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), entry)).otherwise(
        F.array().cast("array<struct<event_date: date, price: bigint>>"))
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    stored = spread(orders).select(
        "o_orderkey", events.price_change_text(count, F.lit(-500), events.encode_events(made)).alias("stored"))
    decoded = stored.withColumn("d", events.decode_price_change(F.col("stored")))
    return decoded.select(
        "o_orderkey", F.try_element_at("d.events", F.lit(-1))["event_date"].alias("newest"), F.col("d.count").alias("n"),
        F.col("d.amount").alias("amount"), F.inline_outer("d.events"),
    ).withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("event_date", "newest")})


@query("""
SELECT p_partkey, p_size AS low, p_size + 10 AS high, p_size + 1 AS private_low, p_size + 2 AS private_high,
       CASE WHEN p_size % 3 <> 0 THEN p_size + 3 END AS dealer_low, CASE WHEN p_size % 3 <> 0 THEN p_size + 4 END AS dealer_high
FROM part
""")
def price_guide_decode(spark, sf):
    size = F.col("p_size")
    dealer = [F.when(size % 3 != 0, size + n) for n in (3, 4)]
    stored = events.price_guide_text(size, size + 10, size + 1, size + 2, *dealer)
    decoded = table(spark, sf, "part").select("p_partkey", events.decode_price_guide(stored).alias("g"))
    return decoded.select("p_partkey", *[
        F.col(f"g.{c}").cast("int").alias(c)
        for c in ("low", "high", "private_low", "private_high", "dealer_low", "dealer_high")])


@query("""
SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, -1 AS missing, event_type AS fallback FROM events
""")
def json_values(spark, sf):
    read = table(spark, sf, "events").withColumn("j", F.from_json("props", "k INT, absent INT"))
    return read.select(
        "event_id", F.col("j.k").alias("k"), F.coalesce("j.absent", F.lit(-1)).alias("missing"),
        F.coalesce(F.get_json_object("props", "$.none"), F.col("event_type")).alias("fallback"))


@query("""
WITH t AS (SELECT doc_id, list_sort(list_distinct(string_split(text, ' '))) AS words FROM documents)
SELECT doc_id, CAST(len(words) AS INTEGER) AS n_words,
       array_to_string(list_sort(list_intersect(words, ['the', 'de', 'que', 'und', 'of'])), '/') AS common
FROM t
""")
def array_set_ops(spark, sf):
    wanted = F.array(*[F.lit(w) for w in ("the", "de", "que", "und", "of")])
    words = F.array_distinct(F.split("text", " "))
    return table(spark, sf, "documents").select(
        "doc_id", F.size(words).alias("n_words"),
        F.array_join(F.array_sort(F.array_intersect(words, wanted)), "/").alias("common"))


@query("""
WITH e AS (SELECT *, unnest(CASE WHEN o_orderkey % 3 = 0 THEN [NULL] ELSE generate_series(1, o_orderkey % 3) END) AS i FROM orders)
SELECT o_orderkey, o_orderkey % 3 AS n, o_orderkey % 7 - 3 AS amount, strftime(o_orderdate + to_days(CAST(i AS INTEGER)), '%Y-%m-%d') AS event_date,
       CAST(floor(o_totalprice) AS BIGINT) + i AS price FROM e
""")
def price_change_older(spark, sf):
    """The older layout of stored price changes, read as rows; an order without events has one row."""
    entry = lambda i: F.concat(
        F.date_format(F.date_add(F.col("o_orderdate").cast("date"), i), "yyyy-MM-dd"), F.lit(" "), (F.floor("o_totalprice") + i).cast("string"))
    count = (F.col("o_orderkey") % 3).cast("int")
    listed = F.when(count > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), entry), ",")).otherwise("")
    text = F.concat(F.lit("count:"), count.cast("string"), F.lit(";amount:"), (F.col("o_orderkey") % 7 - 3).cast("string"), F.lit(";events:"), listed)
    decoded = table(spark, sf, "orders").select("o_orderkey", events.decode_price_change(text).alias("d"))
    return decoded.select("o_orderkey", F.col("d.count").alias("n"), F.col("d.amount").alias("amount"), F.inline_outer("d.events")).withColumn(
        "event_date", F.date_format("event_date", "yyyy-MM-dd"))


@query("""
SELECT p_partkey, p_size AS low, p_size + 10 AS high, p_size + 1 AS private_low, p_size + 2 AS private_high,
       CASE WHEN p_size % 3 <> 0 THEN p_size + 3 END AS dealer_low, CASE WHEN p_size % 3 <> 0 THEN p_size + 4 END AS dealer_high
FROM part
""")
def price_guide_older(spark, sf):
    """The older layout of stored price guides; a missing side is written as nothing."""
    part = lambda n: (F.col("p_size") + n).cast("string")
    dealer = [F.when(F.col("p_size") % 3 != 0, part(n)).otherwise("") for n in (3, 4)]
    text = F.concat(F.lit("range:"), part(0), F.lit("-"), part(10), F.lit(";private:"), part(1), F.lit("-"), part(2), F.lit(";dealer:"),
                    dealer[0], F.lit("-"), dealer[1])
    decoded = table(spark, sf, "part").select("p_partkey", events.decode_price_guide(text).alias("g"))
    return decoded.select("p_partkey", *[
        F.col(f"g.{c}").cast("int").alias(c) for c in ("low", "high", "private_low", "private_high", "dealer_low", "dealer_high")])
