"""Pages of plain tags are cut at their brackets; they must read as the standard parser reads them."""

import random

from pyspark.sql import functions as F

from tidemark import session
from tidemark.operators import pages as web
from tidemark.operators.page_functions import register_page_functions

PIECES = ['<p>', '</p>', '<div class="a b">', '</div>', '<br>', "x", "a &amp; b", '<a href="/x" class="a">', "</a>", "\n", "</B>", "<b>", "&am",
          "<script>var a=\"<p>\";", "</script>", "<template>", "</template>", "<SCRIPT>", "</ script>", '<p title="a>b">', "<!-- c -->", "< y", "<br/>",
          "<a href='/y'>", '<a href="/z?a=1&amp;b=2">', "<title>", "</title>", '<p class="a" CLASS="b">', "<", "\xa0", '<p\xa0class="a">']


def outline(page):
    return [(e[web.TAG][1:], page.text(i), e[web.BEHIND]) for i, e in enumerate(page.elements)]


def test_plain_pages_read_as_by_the_standard_parser():
    draw = random.Random(7)
    plain = 0
    for _ in range(4000):
        html = "".join(draw.choice(PIECES if draw.random() < 0.2 else PIECES[:15]) for _ in range(draw.randrange(12)))
        page, slow = web._Outline(html), web._Outline("")
        parser = web._Parser(slow)
        parser.feed(html)
        parser.close()
        for element in slow.opened:
            element[web.END_TEXT], element[web.BEHIND] = len(slow.texts), len(slow.elements)
        assert outline(page) == outline(slow), html
        again = web._Outline("")
        plain += again._read_plain(html)
    assert plain > 1000


def test_table_functions_send_batches_of_pages(spark):
    """An Arrow stream for each page was most of the time."""
    register_page_functions(spark)
    pages = spark.range(3).select("id", F.lit('<div class="residential-card__content"><h2 class="residential-card__address-heading">x</h2></div>').alias("html"))
    found = spark.sql("SELECT p.id, c.address FROM {p} p, LATERAL listing_cards(p.html) c", p=pages)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPythonUDTF" in plan and "ArrowEvalPythonUDTF" not in plan
    assert sorted(tuple(r) for r in found.collect()) == [(i, "x") for i in range(3)]


def test_spread_bounds_the_input_of_a_task(spark, sf, monkeypatch):
    frame = spark.read.parquet(f"{sf}/orders.parquet")
    monkeypatch.setattr(session, "SPREAD_BYTES", 1000)
    size = int(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    assert session.spread(frame).rdd.getNumPartitions() == -(-size // 1000) > spark.sparkContext.defaultParallelism
