"""From stored result and detail pages to a cleaned, graded listing report."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.events import encode_events, price_change_text, price_guide_text
from tidemark.functions.numeric import bin_values
from tidemark.functions.text import drop_last, first_digits, first_match, item_id, leading, seller
from tidemark.functions.calendar import parse_time
from tidemark.operators.pages import Selector, jsonld_items, page_fields

# fixed values: keyword ladders, odometer bins, class names and script prefixes
LADDERS = {
    "kluger": {
        "grade": ([("grande", 3), (["kx-s", "gxl"], 2)], 1),
        "drive": ([("awd", "AWD")], "2WD"),
        "plain": "2WD",
    },
    "corolla": {
        "grade": ([("zr", 3), ("sx", 2)], 1),
        "drive": ([("hybrid", "hybrid")], "fuel"),
        "plain": "fuel",
    },
}
ODOMETER_EDGES = [0, 50_000, 75_000, 100_000, 125_000, 150_000, float("inf")]
ODOMETER_LABELS = ["050k", "075k", "100k", "125k", "150k", "maxk"]
COLOUR = "col features-item-value features-item-value-colour"
MODIFIED = "col features-item-value features-item-value-last-modified"
REGISTRATION = "col features-item-value features-item-value-registration-expiry"
TAGS_PREFIX = "window.Csn.PageData.advertTags = "
INSIGHTS_PREFIX = "var price_insights_data = "
TAGS = "tags STRUCT<pcode: STRING, price_range: STRING, price: STRING>"
VEHICLE = "STRUCT<min: STRING, max: STRING>"
INSIGHTS = (
    "priceInsights STRUCT<"
    "priceChangeHistory: STRUCT<content: STRUCT<totalPriceChanges: BIGINT, totalPriceChangeAmount: STRING, "
    "priceChangeEvents: ARRAY<STRUCT<eventDateTimeUtc: STRING, price: STRING>>>>, "
    f"estimatedPriceGuide: STRUCT<content: STRUCT<privateVehicle: {VEHICLE}, dealerVehicle: {VEHICLE}>>>"
)


def _whole(number: Column) -> Column:
    """A number written as text, decimals cut; null where it is none."""
    return number.try_cast("double").try_cast("bigint")


def listing_items(pages: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """id, name, year, odokm, price, owner and url of every item on the result pages."""
    keep = [] if keep is None else keep
    item = jsonld_items(pages, keep=keep).filter("item IS NOT NULL")
    name, url = F.col("item.name"), F.col("item.url")
    return item.select(
        *keep, "number_of_items",
        item_id(name, url).alias("id"), name.alias("name"), leading(name, 4).alias("year"),
        _whole(F.col("item.mileageFromOdometer.value")).alias("odokm"), _whole(F.col("item.offers.price")).alias("price"),
        seller(F.col("item.image")).alias("owner"), url.alias("url"),
    )


def _script_text(prefix: str, tail: str) -> Column:
    return F.regexp_extract("html", f"(?is){re.escape(prefix)}{tail}", 1)


def listing_details(pages: DataFrame, url: str = "url") -> DataFrame:
    """Colour, registration, postcode, price guide and price history of each detail page.

    The JSON parts are cut out and read by built-in functions and pass the page parser as plain
    text; one parse per page serves the three other fields.
    """
    texts = {
        "color": Selector(None, COLOUR, strip=True),
        "registration": Selector(None, REGISTRATION, strip=True),
        "last_modified": Selector(None, MODIFIED, strip=True),
    }
    staged = pages.select(
        url, "html", _script_text(TAGS_PREFIX, r"([^;<]*)").alias("_tags"),
        _script_text(INSIGHTS_PREFIX, r"(.*?)\s*;?\s*</script>").alias("_insights"),
    )
    found = page_fields(staged, texts, keep=[url, "_tags", "_insights"]).withColumns({
        "_tags": F.from_json(F.nullif("_tags", F.lit("")), TAGS)["tags"],
        "_insights": F.from_json(F.nullif("_insights", F.lit("")), INSIGHTS)["priceInsights"],
    })
    history = F.col("_insights.priceChangeHistory.content")
    guide = F.col("_insights.estimatedPriceGuide.content")
    events = F.transform(
        history["priceChangeEvents"],
        lambda e: F.struct(
            # the day in UTC, whatever the session's zone
            F.substring(e["eventDateTimeUtc"], 1, 10).try_cast("date").alias("event_date"),
            first_digits(e["price"]).alias("price"),
        ),
    )
    has_events = F.size(F.col("_events")) > 0
    last = F.try_element_at("_events", F.lit(-1))
    bound = {
        f"{kind}_{edge}": first_digits(guide[f"{kind}Vehicle"][edge])
        for kind in ("private", "dealer") for edge in ("min", "max")
    }
    modified = parse_time(F.col("last_modified"), "d/M/yyyy", "yyyy-MM-dd", "d MMM yyyy")
    return (
        found.withColumn("_events", F.coalesce(events, F.array().cast(
            "array<struct<event_date: date, price: string>>")))
        .select(
            url,
            F.when(has_events, last["event_date"]).alias("last_price_date"),
            F.when(has_events, last["price"].try_cast("bigint")).alias("last_price_value"),
            "color", "registration",
            F.coalesce("_tags.pcode", F.lit("")).alias("post_code"),
            F.coalesce(F.date_format(modified, "yyyy-MM-dd"), F.lit("None")).alias("last_modified"),
            price_guide_text(
                drop_last(first_digits(F.col("_tags.price_range"))), first_digits(F.col("_tags.price")),
                bound["private_min"], bound["private_max"], bound["dealer_min"], bound["dealer_max"],
            ).alias("price_guide"),
            price_change_text(
                F.coalesce(history["totalPriceChanges"], F.lit(1)),
                F.coalesce(history["totalPriceChangeAmount"].try_cast("bigint"), F.lit(0)),
                encode_events(F.col("_events")),
            ).alias("price_change"),
        )
    )


def listing_table(items: DataFrame, details: DataFrame, url: str = "url") -> DataFrame:
    """Items with their details, matched by URL."""
    return items.join(details, url, "inner")


def listing_report(
    listings: DataFrame, model: str, current_year: int,
    years: tuple[int, int] = (2010, 2020), max_km: float = 150_000,
) -> DataFrame:
    """Typed, filled, filtered and graded listings, longest driven first.

    Adds grade, drive, age (year minus the current year), the odometer bin, the year adjusted
    for grade and drive, and price and odometer in units of 10,000. Rows without a year go,
    as a missing number counts as 0. Sorting reads its input twice, once for the ranges: ``stored``
    listings spare parsing the pages again.
    """
    ladder = LADDERS[model.lower()]
    typed = listings.withColumns({
        "year": F.coalesce(F.col("year").try_cast("int"), F.lit(0)),
        "odokm": F.coalesce(F.col("odokm").try_cast("double"), F.lit(0.0)),
        "price": F.coalesce(F.col("price").try_cast("int"), F.lit(0)),
    })
    kept = typed.filter(
        (F.col("year") >= years[0]) & (F.col("year") < years[1]) & (F.col("odokm") <= max_km))
    graded = kept.withColumns({
        "grade": first_match(F.col("name"), *ladder["grade"]),
        "drive": first_match(F.col("name"), *ladder["drive"]),
    })
    bonus = F.when(F.col("drive") == ladder["plain"], 0.0).otherwise(0.12)
    return graded.withColumns({
        "age": F.col("year") - F.lit(current_year),
        "year": F.col("year") + (F.col("grade") - 2) * 0.3 + bonus,
        "lvlkm": bin_values(F.col("odokm"), ODOMETER_EDGES, ODOMETER_LABELS),
        "price": F.col("price") * 0.0001,
        "odokm": F.col("odokm") * 0.0001,
    }).orderBy(F.desc("odokm"), "id")


def rent_report(history: DataFrame) -> DataFrame:
    """Price history rows that have a rent date, '1.00k' read as 1000, newest first."""
    rent = F.when(F.col("rent_price") == "1.00k", F.lit("1000")).otherwise(F.col("rent_price"))
    return (
        history.withColumn("rent_price", rent).dropna(subset=["rent_date"])
        .orderBy(F.desc("rent_date"), "house_address")
    )
