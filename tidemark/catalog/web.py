"""Stored pages: the driver's, and listing pages that Spark writes from orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import query, table
from tidemark.operators import pages as web
from tidemark.operators.page_functions import register_page_functions
from tidemark.operators.pages import Selector
from tidemark.plans import listings
from tidemark.session import spread, stored


@query("""
SELECT DISTINCT href FROM (SELECT unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages)
WHERE starts_with(href, '/e')
""")
def page_links(spark, sf):
    return web.page_links(table(spark, sf, "pages"), "/e")


@query("""
SELECT page_id, a[1] AS href, a[2] AS text FROM (
  SELECT page_id, unnest(list_zip(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1),
                                  regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2))) AS a FROM pages)
WHERE starts_with(a[2], 'd')
""")
def page_links_text(spark, sf):
    return web.page_links_by(table(spark, sf, "pages"), text_prefix="d")


def _unescaped(expr):
    """Entities as a browser reads them: a cut-off one may lack its semicolon."""
    for entity, sign in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#x27", "''"), ("amp", "&")):
        expr = f"regexp_replace({expr}, '&{entity};?', '{sign}', 'g')"
    return expr


@query(f"""
SELECT page_id, {_unescaped("regexp_extract(html, '<h1>(.*?)</h1>', 1, 's')")} AS heading,
       {_unescaped("regexp_extract(html, '<div class=.ad.>(.*?)</div>', 1, 's')")} AS ad, 'None' AS absent,
       array_to_string(list_transform(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1),
                       lambda x: {_unescaped("x")}), '|') AS links,
       regexp_extract(html, '<a href="([^"]*)"', 1) AS first_href
FROM pages
""")
def page_fields(spark, sf):
    found = web.page_fields(table(spark, sf, "pages"), {
        "heading": Selector("h1"), "ad": Selector("div", "ad"), "absent": Selector("span", "price"),
        "links": Selector("a", take="all"), "first_href": Selector("a", take="attr", attr="href")})
    return found.withColumn("links", F.array_join("links", "|"))


@query(f"SELECT page_id, {_unescaped('''regexp_extract(html, '<h1>(.*?)</h1>', 1, 's')''')} AS value FROM pages")
def first_text(spark, sf):
    return web.first_text(table(spark, sf, "pages"), "h1", None)


@query(f"SELECT page_id, {_unescaped('''regexp_extract(html, '<h1>(.*?)</h1>', 1, 's')''')} AS heading FROM pages")
def article_heading(spark, sf):
    """The heading inside the article."""
    return web.page_fields(table(spark, sf, "pages"), {"heading": Selector("h1")}, within=Selector("article"), missing=None)


ARTICLE_SQL = "regexp_replace(regexp_extract(html, '<article>(.*?)</article>', 1, 's'), '<[a-z0-9/]+>', '', 'g')"


@query(f"SELECT page_id, {_unescaped(ARTICLE_SQL)} AS value FROM pages")
def sibling_text(spark, sf):
    """The whole text of the article, the first one that follows the advertisement."""
    return web.sibling_text(table(spark, sf, "pages"), "div", "ad", ("article", None))


@query(f"""
SELECT page_id, array_to_string(list_transform(regexp_extract_all(html, '<li>(.*?)</li>', 1, 's'),
       lambda x: {_unescaped("regexp_replace(x, '<[^>]*>', '', 'g')")}), '|') AS texts FROM pages
""")
def all_text(spark, sf):
    """The texts of all list items of a page."""
    return web.all_text(table(spark, sf, "pages"), "li", None).withColumn("texts", F.array_join("texts", "|"))


@query("""
WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages),
m AS (SELECT DISTINCT href, page_id % 2 AS odd FROM l)
SELECT DISTINCT '/q' || href || CASE WHEN odd = 1 THEN '?a=1&b=2' ELSE '' END AS href FROM m
""")
def page_links_awkward(spark, sf):
    """Links without quotes, behind other attributes and with references; those in comments and scripts are none."""
    link = F.regexp_replace("html", '<a href="([^"]*)"', "<a data-href='/no' title=\"x href='/no2'\" HREF = '/q$1'")
    plain = F.regexp_replace("html", '<a href="([^"]*)"', "<a class=x href='/q$1?a=1&amp;b=2'")
    pages = table(spark, sf, "pages").select("page_id", F.concat(
        F.lit("<!-- <a href='/gone'>x</a> --><script>var a = \"<a href='/gone2'>\";</script>"),
        F.when(F.col("page_id") % 2 == 1, plain).otherwise(link)).alias("html"))
    return web.page_links(pages)

@query("SELECT page_id, CAST(regexp_extract(html, 'track\\((\\d+)\\)', 1) AS BIGINT) AS tracked FROM pages")
def script_calls(spark, sf):
    return table(spark, sf, "pages").select("page_id", web.script_call(F.col("html"), "track").alias("tracked"))


def _lines(spark, sf):
    """One to four entries per order, all made of its own row: no page gathers other rows."""
    entry = lambda i: F.struct(
        i.alias("n"), F.col("o_custkey").alias("part"), (F.col("o_orderkey") % 1000).alias("supp"),
        (F.col("o_custkey") % 50 + i).alias("qty"), (F.floor("o_totalprice") + i * 10).alias("price"),
        F.date_format(F.date_add(F.col("o_orderdate").cast("date"), i), "yyyy-MM-dd").alias("day"),
        F.date_format(F.date_add(F.col("o_orderdate").cast("date"), i), "dd MMM yyyy").alias("shown"),
        F.col("o_orderstatus").alias("flag"))
    count = (F.col("o_orderkey") % 4 + 1).cast("int")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderstatus")
    return spread(orders).select(
        "o_orderkey", F.transform(F.sequence(F.lit(1), count), entry).alias("es"),
        F.concat(F.lit("https://example.org/cars/2015-kluger-"), F.col("o_orderkey").cast("string"),
                 F.lit("/AD-"), F.col("o_orderkey").cast("string"), F.lit("/")).alias("url"))


# the same entries: k of them per order, i from 1 to k
ENTRIES_SQL = """
WITH o AS (SELECT *, o_orderkey % 4 + 1 AS k, CAST(floor(o_totalprice) AS BIGINT) AS down, o_custkey % 50 AS size FROM orders),
e AS (SELECT *, size + i AS qty, down + i * 10 AS price FROM (SELECT *, unnest(generate_series(1, k)) AS i FROM o))
"""
URL_SQL = "'https://example.org/cars/2015-kluger-' || o_orderkey || '/AD-' || o_orderkey || '/'"


def _number(c):
    return c.cast("string")


def result_pages(spark, sf):
    """A page of results per order: a JSON-LD block with its entries as items."""
    item = lambda e: F.struct(F.struct(
        F.concat(F.lit("https://example.org/x/"), _number(e["part"]), F.lit("-"), _number(e["n"]), F.lit("/")).alias("url"),
        F.concat(F.lit("2015 Toyota Kluger "), F.when(e["flag"] == "F", "Grande AWD").when(e["flag"] == "P", "GXL")
                 .otherwise("KX-R")).alias("name"),
        F.struct((e["qty"] * 5000).cast("double").alias("value")).alias("mileageFromOdometer"),  # a decimal, and a price in quotes
        F.struct(_number(e["price"]).alias("price")).alias("offers"),
        F.when(e["flag"] == "O", F.array().cast("array<struct<url: string>>")).otherwise(
            F.array(F.struct(F.when(e["flag"] == "F", "https://img/private/1").otherwise("https://img/d/1").alias("url")))
        ).alias("image"),
    ).alias("item"))
    block = F.to_json(F.struct(F.struct(
        F.size("es").alias("numberOfItems"), F.transform("es", item).alias("itemListElement")).alias("mainEntity")))
    html = F.concat(F.lit('<html><head><script type="application/ld+json">'), block, F.lit("</script></head></html>"))
    return _lines(spark, sf).select(F.col("o_orderkey").alias("page_id"), html.alias("html"))


ITEMS_SQL = ENTRIES_SQL + """, i AS (
  SELECT o_orderkey AS page_id, k AS number_of_items, '2015-' || o_custkey || '-' || i AS id,
    '2015 Toyota Kluger ' || CASE o_orderstatus WHEN 'F' THEN 'Grande AWD' WHEN 'P' THEN 'GXL' ELSE 'KX-R' END AS name,
    '2015' AS year, qty * 5000 AS odokm, price, CASE WHEN o_orderstatus = 'P' THEN 'dealer' ELSE 'private' END AS owner,
    'https://example.org/x/' || o_custkey || '-' || i || '/' AS url
  FROM e)
"""


@query(ITEMS_SQL + "SELECT page_id, number_of_items, id, name, year, odokm, price, owner, url FROM i")
def jsonld_items(spark, sf):
    return listings.listing_items(result_pages(spark, sf), keep=["page_id"])


@query(ITEMS_SQL + """
SELECT page_id, id, owner,
  CAST(CASE WHEN contains(name, 'Grande') THEN 3 WHEN contains(name, 'GXL') THEN 2 ELSE 1 END AS INTEGER) AS grade,
  CASE WHEN contains(name, 'AWD') THEN 'AWD' ELSE '2WD' END AS drive, CAST(2015 - 2026 AS INTEGER) AS age,
  round(CAST(2015 + CASE WHEN contains(name, 'Grande') THEN 0.3 + 0.12 WHEN contains(name, 'GXL') THEN 0 ELSE -0.3 END AS DOUBLE), 4) AS year,
  CASE WHEN odokm <= 50000 THEN '050k' WHEN odokm <= 75000 THEN '075k' WHEN odokm <= 100000 THEN '100k'
       WHEN odokm <= 125000 THEN '125k' ELSE '150k' END AS lvlkm, round(CAST(price AS DOUBLE) * 0.0001, 4) AS price,
  round(CAST(odokm AS DOUBLE) * 0.0001, 4) AS odokm
FROM i WHERE odokm <= 150000
""")
def listing_report(spark, sf):
    items = listings.listing_items(result_pages(spark, sf), keep=["page_id"])
    report = listings.listing_report(stored(items), "Kluger", 2026)
    return report.select("page_id", "id", "owner", "grade", "drive", "age", F.round("year", 4).alias("year"), "lvlkm",
                         F.round("price", 4).alias("price"), F.round("odokm", 4).alias("odokm"))


def detail_pages(spark, sf):
    """A detail page per order: features, tags, and price history and guide in scripts."""
    first, last = F.col("es")[0], F.element_at("es", -1)
    events = F.transform("es", lambda e: F.struct(
        F.concat(e["day"], F.lit("T10:00:00Z")).alias("eventDateTimeUtc"),
        F.concat(F.lit("$"), _number(e["price"])).alias("price")))
    vehicle = lambda a, b: F.struct(_number(a).alias("min"), _number(b).alias("max"))
    insights = F.to_json(F.struct(F.struct(
        F.struct(F.struct(
            F.size("es").alias("totalPriceChanges"), F.lit("-250").alias("totalPriceChangeAmount"),
            events.alias("priceChangeEvents")).alias("content")).alias("priceChangeHistory"),
        F.struct(F.struct(
            vehicle(first["qty"] + 10, first["qty"] + 20).alias("privateVehicle"),
            vehicle(first["qty"] + 30, first["qty"] + 40).alias("dealerVehicle")).alias("content")).alias("estimatedPriceGuide"),
    ).alias("priceInsights")))
    tags = F.to_json(F.struct(F.struct(
        _number(first["supp"]).alias("pcode"), F.concat(_number(first["qty"] + 10), F.lit("5")).alias("price_range"),
        _number(last["price"]).alias("price")).alias("tags")))
    cell = lambda kind, value: F.concat(
        F.lit(f'<div class="col features-item-value features-item-value-{kind}"> '), value, F.lit(" </div>"))
    html = F.concat(
        F.lit("<html><body>"), cell("colour", first["flag"]),
        F.when(first["flag"] == "O", F.lit("")).otherwise(cell("registration-expiry", last["shown"])),
        cell("last-modified", last["shown"]),
        F.lit("<script>window.Csn.PageData.advertTags = "), tags, F.lit("; other = 1;</script>"),
        F.lit("<script>var price_insights_data = "), insights, F.lit(";</script></body></html>"))
    return _lines(spark, sf).select("url", html.alias("html"))


@query(ENTRIES_SQL + f"""
SELECT {URL_SQL} AS url, strftime(o_orderdate + to_days(CAST(k AS INTEGER)), '%Y-%m-%d') AS last_price_date,
  down + k * 10 AS last_price_value, o_orderstatus AS color,
  CASE WHEN o_orderstatus = 'O' THEN 'None' ELSE strftime(o_orderdate + to_days(CAST(k AS INTEGER)), '%d %b %Y') END AS registration,
  CAST(o_orderkey % 1000 AS VARCHAR) AS post_code,
  strftime(o_orderdate + to_days(CAST(k AS INTEGER)), '%Y-%m-%d') AS last_modified,
  (size + 11) || '(' || (size + 11) || '.' || (size + 31) || ')-' || (down + k * 10) || '(' || (size + 21) || '.' || (size + 41)
    || ')' AS price_guide,
  'cnt:' || k || '-amt:-250-evts:[' || array_to_string(list_transform(generate_series(1, k),
    lambda i: strftime(o_orderdate + to_days(CAST(i AS INTEGER)), '%Y-%m-%d') || ':' || (down + i * 10)), ';') || ']' AS price_change
FROM o
""")
def listing_details(spark, sf):
    found = listings.listing_details(detail_pages(spark, sf))
    return found.withColumn("last_price_date", F.date_format("last_price_date", "yyyy-MM-dd"))


@query(ENTRIES_SQL + f"SELECT {URL_SQL} AS url, k AS changes, CAST(-250 AS BIGINT) AS amount FROM o")
def script_values(spark, sf):
    found = web.script_value(detail_pages(spark, sf), listings.INSIGHTS_PREFIX, listings.INSIGHTS, "v", keep=["url"])
    content = F.col("v.priceInsights.priceChangeHistory.content")
    return found.select(
        "url", web.json_or(content["totalPriceChanges"], 0).alias("changes"),
        web.json_or(content["totalPriceChangeAmount"].cast("bigint"), 0).alias("amount"))


def sale_pages(spark, sf):
    """A sold or rented house per order."""
    first, last = F.col("es")[0], F.element_at("es", -1)
    dated = lambda e: F.concat(F.lit('<div class="text-secondary"> '), e["shown"], F.lit("</div>"))
    priced = lambda kind, value: F.concat(
        F.lit(f'<div class="xlText bold600 PropertyHistory__{kind}">'), value, F.lit("</div>"))
    sold = F.when(first["flag"] == "O", F.lit("")).otherwise(F.concat(
        priced("salePrice--sNxkh", F.concat(F.lit(" $"), F.format_number(first["price"], 0), F.lit(" "))), F.lit("<br>"),
        dated(first)))
    rent = F.concat(priced("rentPrice--b9D1U", F.concat(F.lit("$"), _number(last["qty"]), F.lit("/w"))),
                    F.when(last["flag"] == "P", F.lit("")).otherwise(dated(last)))
    return _lines(spark, sf).select(
        F.concat(F.lit("/property/qld/area/7-some-st-"), _number(F.col("o_orderkey"))).alias("url"),
        F.concat(F.lit("<section><div>"), sold, F.lit("</div><div>"), rent, F.lit("</div></section>")).alias("html"))


@query(ENTRIES_SQL + """
SELECT CAST(down + 10 AS VARCHAR) AS sold_price, strftime(o_orderdate + to_days(1), '%Y-%m-%d') AS sold_date,
       CAST(size + k AS VARCHAR) AS rent_price, strftime(o_orderdate + to_days(CAST(k AS INTEGER)), '%Y-%m-%d') AS rent_date,
       '7 some st ' || o_orderkey AS house_address
FROM o WHERE o_orderstatus = 'F'
""")
def price_history(spark, sf):
    report = listings.rent_report(stored(web.price_history(sale_pages(spark, sf))))
    return report.drop("url").withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("sold_date", "rent_date")})


def card_pages(spark, sf):
    """A page per order with its entries as cards; some parts are left out."""
    part = lambda tag, cls, value: F.concat(F.lit(f'<{tag} class="{cls}">'), value, F.lit(f"</{tag}>"))
    icon = "general-features__icon general-features__"
    card = lambda e: F.concat(
        F.lit('<div class="residential-card__content"><a class="details-link residential-card__details-link" href="/p-'),
        _number(e["part"]), F.lit('">go</a>'),
        part("h2", "residential-card__address-heading", F.concat(F.lit("<b>"), _number(e["n"]), F.lit("</b> Some &amp; St"))),
        F.when(e["flag"] == "F", F.lit("")).otherwise(part("span", "property-price", F.concat(F.lit("$"), _number(e["price"])))),
        part("span", f"{icon}beds", _number(e["qty"])), part("span", f"{icon}cars", F.lit("2")),
        part("span", "residential-card__property-type", e["flag"]), F.lit("</div>"))
    html = F.concat(F.lit("<main>"), F.array_join(F.transform("es", card), "\n"), F.lit("</main>"))
    return _lines(spark, sf).select(F.col("o_orderkey").alias("page_id"), html.alias("html"))


@query(ENTRIES_SQL + """
SELECT o_orderkey AS page_id, 'https://example.org/p-' || o_custkey AS link, i || ' Some & St' AS address,
       CASE WHEN o_orderstatus = 'F' THEN 'None' ELSE '$' || price END AS price, CAST(qty AS VARCHAR) AS num_beds,
       'None' AS num_baths, '2' AS num_cars, 'None' AS property_area, 'None' AS land_area, o_orderstatus AS property_type
FROM e
""")
def listing_cards(spark, sf):
    return web.listing_cards(card_pages(spark, sf), "https://example.org")


@query(ENTRIES_SQL + """
SELECT o_orderkey AS page_id, '/p-' || o_custkey AS link, i || ' Some & St' AS address,
       CASE WHEN o_orderstatus <> 'F' THEN '$' || price END AS price, CAST(qty AS VARCHAR) AS num_beds
FROM e
""")
def listing_cards_lateral(spark, sf):
    """The cards by a table function, called from SQL."""
    register_page_functions(spark)
    return spark.sql("SELECT p.page_id, c.link, c.address, c.price, c.num_beds FROM {pages} p, LATERAL listing_cards(p.html) c",
                     pages=card_pages(spark, sf))


@query("""
SELECT c_custkey AS page_id, c_name AS address, '$' || CAST(abs(c_nationkey) AS VARCHAR) || '/w' AS price, 'None' AS num_beds,
       CAST(c_custkey % 4 AS VARCHAR) AS num_baths, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey % 3 AS VARCHAR) ELSE 'None' END AS num_cars,
       'None' AS property_area, CAST(c_custkey % 900 AS VARCHAR) || ' m2' AS land_area, 'Near ' || c_mktsegment || ' & more' AS description,
       'a' || c_custkey || '|b' AS features
FROM customer
""")
def property_details(spark, sf):
    """The fields of a page per customer; those that the page lacks read 'None'."""
    def part(tag, cls, *content):
        return F.concat(F.lit(f'<{tag} class="{cls}">'), *content, F.lit(f"</{tag}>"))

    key = F.col("c_custkey")
    html = F.concat(
        part("h1", "property-info-address", F.col("c_name")),
        part("span", "property-price property-info__price", F.lit("$"), _number(F.col("c_nationkey")), F.lit("/w")),
        part("span", "general-features__icon general-features__baths", _number(key % 4)),
        F.when(key % 2 == 0, part("span", "general-features__icon general-features__cars", _number(key % 3))).otherwise(""),
        part("span", "property-size__icon property-size__land", _number(key % 900), F.lit(" m2")),
        part("article", "property-description", F.lit("Near "), F.col("c_mktsegment"), F.lit(" &amp; more")),
        part("div", "property-features__feature", F.lit("a"), _number(key)), part("div", "property-features__feature", F.lit("b")))
    pages = spread(table(spark, sf, "customer")).select(key.alias("page_id"), html.alias("html"))
    return web.property_details(pages).withColumn("features", F.array_join("features", "|"))
