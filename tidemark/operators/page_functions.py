"""Table functions over stored pages, for SQL with LATERAL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from tidemark.operators.pages import CARD, CARD_FIELDS, TAG, _fits, _Outline, _Taker


class ListingCards:
    """A row per card of a page, with the fields of ``listing_cards``; absent ones are null. A null page has none."""

    def __init__(self):
        self.taker = _Taker(list(CARD_FIELDS.values()), None, CARD)

    def eval(self, html: str):
        return map(tuple, self.taker.rows(html))


class PageElements:
    """A row per element of a tag (null: any) and class (null: any), in page order: its number from 0, text and attributes."""

    def eval(self, html: str, tag: str, cls: str):
        page = _Outline(html or "")
        fitting = (at for at, e in enumerate(page.elements) if _fits(e[TAG][3], tag, cls))
        for n, at in enumerate(fitting):
            _, name, attrs, _ = page.elements[at][TAG]
            yield n, name, page.text(at), {k: v or "" for k, v in attrs.items()}


def register_page_functions(spark: SparkSession) -> None:
    """Make ``listing_cards(html)`` and ``page_elements(html, tag, class)`` known to the session's SQL.

    They run where the pages lie, and need no shuffle. Pages and rows travel in batches: with Arrow each page would be a stream of its own. Spark leaves out pages without a row, also under LEFT JOIN::

        SELECT p.page_id, c.* FROM pages p, LATERAL listing_cards(p.html) c
    """
    cards = ", ".join(f"{name} STRING" for name in CARD_FIELDS)
    spark.udtf.register("listing_cards", udtf(ListingCards, returnType=cards))
    spark.udtf.register("page_elements", udtf(
        PageElements, returnType="n INT, tag STRING, text STRING, attrs MAP<STRING, STRING>"))
