import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tidemark.operators import pages as web
from tidemark.operators.pages import Selector
from tidemark.plans import listings


def pages_of(spark, *htmls):
    return spark.createDataFrame([(i, f"u/{i}", h) for i, h in enumerate(htmls)], "page_id INT, url STRING, html STRING")


BROKEN = '<nav><a href="/a">A</a></nav><script>var t="</p>";track(7);</script><article><p>one<br><p>two &amp; three</p>' \
    '<p class="x y">four<b>five</b></p></article><p>last'


def test_text_of_unclosed_elements(spark):
    got = web.page_fields(pages_of(spark, BROKEN), {
        "first": Selector("p"), "all": Selector("p", take="all"), "worded": Selector("p", "y"),
        "whole": Selector("p", "x y"), "swapped": Selector("p", "y x"), "script": Selector("script"),
        "article": Selector("article"), "href": Selector("a", take="attr", attr="href"),
        "rel": Selector("a", take="attr", attr="rel")}).first()
    # an unclosed paragraph holds what follows, up to the end of its parent
    assert got["first"] == "onetwo & threefourfive"
    assert got["all"] == ["onetwo & threefourfive", "two & three", "fourfive", "last"]
    assert got["worded"] == got["whole"] == "fourfive" and got["swapped"] == "None"
    assert got["script"] == "" and got["article"] == "onetwo & threefourfive"
    assert got["href"] == "/a" and got["rel"] == "None"


def test_missing_as_null_and_empty_pages(spark):
    frame = pages_of(spark, "", None)
    got = web.page_fields(frame, {"a": Selector("p"), "b": Selector("p", take="all")}, missing=None)
    assert rows(got, "page_id") == [(0, None, []), (1, None, [])]


def test_links_agree_with_the_parser(spark):
    frame = pages_of(spark, '<a data-href="/x1" href="/e1?a=1&amp;b=2">t</a><a href=/e3>u</a><!-- <a href="/gone">v</a> -->',
                     "<script>var a='<a href=/gone2>';</script><A\n class='c' title=\"href='/no' > x\" HREF = '/e4&#233;'>w</A><abbr href=/no3>",
                     "<a href='/e3'>again</a><a name=x>none</a><a href=\"/e1?a=1&amp;b=2\"/>", None, "")
    want = {"/e1?a=1&b=2", "/e3", "/e4\xe9"}
    assert {r["href"] for r in web.page_links(frame).collect()} == want
    assert {r["href"] for r in web.page_links_by(frame).collect()} == want
    assert {r["href"] for r in web.page_links(frame, "/e3").collect()} == {"/e3"}


def test_jsonld_numbers_as_text_and_decimals(spark):
    def block(items):
        return ('<script type="application/ld+json">{"mainEntity": {"numberOfItems": 3, "itemListElement": [' + items + "]}}</script>")

    item = '{"item": {"url": "u/2015-x-%s/", "name": "n", "mileageFromOdometer": {"value": %s}, "offers": {"price": %s}, "image": []}}'
    pages = pages_of(spark, block(", ".join([item % (1, "5000.0", "20990.5"), item % (2, '"5000"', '"20990"'), item % (3, "7", "null")])), block(""))
    got = rows(listings.listing_items(pages, keep=["page_id"]).select("odokm", "price"), "price")
    assert got == [(7, None), (5000, 20990), (5000, 20990)]
    assert [(r["page_id"], r["item"]) for r in web.jsonld_items(pages).where("item IS NULL").collect()] == [(1, None)]


def test_calls_and_links(spark):
    frame = pages_of(spark, BROKEN, '<a class="page-link k" href="/b?page=2">2</a><a href="/s/1">Sold on 06 Jun</a><a>no</a>')
    assert rows(frame.select(web.script_call(F.col("html"), "track"))) == [(7,), (None,)]
    assert rows(web.page_links(frame), "href") == [("/a",), ("/b?page=2",), ("/s/1",)]
    assert rows(web.page_links(frame, "/s")) == [("/s/1",)]
    assert rows(web.page_links_by(frame, cls="page-link k").select("href")) == [("/b?page=2",)]
    assert rows(web.page_links_by(frame, text_prefix="Sold on").select("href", "text")) == [("/s/1", "Sold on 06 Jun")]


HISTORY = """
<div><div class="xlText bold600 PropertyHistory__salePrice--sNxkh">$815,000</div>
<div class="other">no</div><div class="text-secondary">22 Dec 2021</div></div>
<div><div class="xlText bold600 PropertyHistory__rentPrice--b9D1U"> $1.00k/w </div>
<p><div class="text-secondary">05 Dec 2021</div></p><div class="text-secondary">01 Nov 2022</div></div>"""


def test_price_history(spark):
    frame = pages_of(spark, HISTORY, "<p>none</p>").withColumn("url", F.concat(F.lit("/qld/7-senior-cl-"), "page_id"))
    found = web.price_history(frame)
    want = (dt.date(2021, 12, 22), dt.date(2022, 11, 1))
    row = found.first()
    assert found.count() == 1
    assert (row["sold_price"], row["rent_price"], row["house_address"]) == ("815000", "1.00k", "7 senior cl 0")
    assert (row["sold_date"], row["rent_date"]) == want
    assert listings.rent_report(found).first()["rent_price"] == "1000"


def test_cards(spark):
    card = '<div class="residential-card__content"><h2 class="residential-card__address-heading">{}</h2>{}</div>'
    extra = '<a class="details-link residential-card__details-link" href="/p"></a><span class="property-price">$5</span>'
    frame = pages_of(spark, "<div>" + card.format("A", extra) + card.format("B", "") + "</div>").withColumn("postcode", F.lit("2000"))
    got = rows(web.listing_cards(frame, "https://s", keep=["postcode"]).select("link", "address", "postcode", "price", "num_beds"), "address")
    assert got == [("https://s/p", "A", "2000", "$5", "None"), ("None", "B", "2000", "None", "None")]
    nulls = web.listing_cards(frame, missing=None, keep=[]).select("link", "price")
    assert (None, None) in rows(nulls)


def test_property_details(spark):
    html = '<h1 class="property-info-address">1 St</h1><span class="property-price property-info__price">$1</span>' \
        '<div class="property-features__feature">Pool</div><div class="property-features__feature">Shed</div>'
    got = web.property_details(pages_of(spark, html)).first()
    assert (got["address"], got["price"], got["features"], got["description"]) == ("1 St", "$1", ["Pool", "Shed"], "None")


LD = """<script type="application/ld+json">{"mainEntity": {"numberOfItems": 27, "itemListElement": [
 {"item": {"url": "https://x/details/2012-t/SSE-AD-1/", "name": "2012 Toyota Corolla", "mileageFromOdometer": {"value": 72131},
           "offers": {"price": 20990}, "image": []}},
 {"item": {"url": "https://x/details/2015-t/OAG-AD-2/", "name": "2015 Toyota Corolla", "mileageFromOdometer": {"value": 5},
           "offers": {"price": 9}, "image": [{"url": "https://i/dealer.jpg"}]}}]}}</script>"""


def test_jsonld(spark):
    got = rows(listings.listing_items(pages_of(spark, LD, "<p>no block</p>", '<script type="application/ld+json">{bad</script>')), "id")
    assert got == [
        (27, "2012-SSE-AD-1", "2012 Toyota Corolla", "2012", 72131, 20990, "private", "https://x/details/2012-t/SSE-AD-1/"),
        (27, "2015-OAG-AD-2", "2015 Toyota Corolla", "2015", 5, 9, "dealer", "https://x/details/2015-t/OAG-AD-2/")]


DETAIL = """<div class="col features-item-value features-item-value-colour"> white </div>
<div class="col features-item-value features-item-value-last-modified">4/6/2022</div>
<script>x = 1; window.Csn.PageData.advertTags = {"tags": {"pcode": "4152", "price_range": "$200255 to", "price": "24000"}}; y = 2;</script>
<script> var price_insights_data = {"priceInsights": {
 "priceChangeHistory": {"content": {"totalPriceChanges": 1, "totalPriceChangeAmount": "-2000", "priceChangeEvents": [
   {"eventDateTimeUtc": "2022-05-29T01:00:00Z", "price": "26000"}, {"eventDateTimeUtc": "2022-06-04T02:00:00Z", "price": "24000"}]}},
 "estimatedPriceGuide": {"content": {"privateVehicle": {"min": "18300", "max": "20800"}, "dealerVehicle": {"min": "19500", "max": "22100"}}}}}; </script>"""


def test_details(spark):
    got = rows(listings.listing_details(pages_of(spark, DETAIL, "<p></p>")), "url")
    assert got == [
        ("u/0", dt.date(2022, 6, 4), 24000, "white", "None", "4152", "2022-06-04",
         "20025(18300.19500)-24000(20800.22100)", "cnt:1-amt:-2000-evts:[2022-05-29:26000;2022-06-04:24000]"),
        ("u/1", None, None, "None", "None", "", "None", "(.)-(.)", "cnt:1-amt:0-evts:[]")]


def test_report(spark):
    frame = spark.createDataFrame([
        ("a", "2012 Kluger Grande AWD", "2012", 90000.0, 20000), ("b", "2015 Kluger GXL 2WD", "2015", 120000.0, None),
        ("c", "2009 Kluger", "2009", 1.0, 1), ("d", "2019 Kluger", "2019", 150001.0, 1), ("e", "Kluger", None, 1.0, 1),
        ("f", "2018 Kluger KX-S", "2018", None, 5)], "id STRING, name STRING, year STRING, odokm DOUBLE, price INT")
    got = [(r["id"], r["grade"], r["drive"], r["age"], round(r["year"], 4), r["lvlkm"], round(r["price"], 6), round(r["odokm"], 6))
           for r in listings.listing_report(frame, "Kluger", 2026).collect()]
    assert got == [
        ("b", 2, "2WD", -11, 2015.0, "125k", 0.0, 12.0), ("a", 3, "AWD", -14, 2012.42, "100k", 2.0, 9.0),
        ("f", 2, "2WD", -8, 2018.0, "050k", 0.0005, 0.0)]


def test_script_value_of_a_statement(spark):
    frame = pages_of(spark, '<script>a = 1; var v = {"k": 3}; b = {"k": 4};</script>', "<script>var v = {oops;</script>")
    got = web.script_value(frame, "var v = ", "k INT", statement=True)
    assert [r["value"] and r["value"]["k"] for r in got.orderBy("page_id").collect()] == [3, None]
