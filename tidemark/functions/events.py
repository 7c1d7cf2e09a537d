"""Price events kept as text: encoding, and decoding of the two stored layouts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EVENT = "struct<event_date: date, price: bigint>"


def encode_events(events: Column, date_field: str = "event_date", price_field: str = "price") -> Column:
    """An array of events as 'yyyy-MM-dd:price;yyyy-MM-dd:price'."""
    texts = F.transform(
        events,
        lambda e: F.concat_ws(":", F.date_format(e[date_field], "yyyy-MM-dd"), e[price_field].cast("string")),
    )
    return F.array_join(texts, ";")


def price_change_text(count: Column, amount: Column, events: Column) -> Column:
    """The stored text of a price history."""
    return F.concat(
        F.lit("cnt:"), count.cast("string"), F.lit("-amt:"), amount.cast("string"),
        F.lit("-evts:["), F.coalesce(events, F.lit("")), F.lit("]"),
    )


def price_guide_text(low: Column, high: Column, private_low: Column, private_high: Column,
                     dealer_low: Column, dealer_high: Column) -> Column:
    """The stored text of a price guide; missing parts are empty."""
    t = [F.coalesce(c.cast("string"), F.lit("")) for c in
         (low, private_low, dealer_low, high, private_high, dealer_high)]
    return F.format_string("%s(%s.%s)-%s(%s.%s)", *t)


def _event_list(body: Column, between: str, within: str) -> Column:
    pieces = F.filter(F.split(body, between), lambda p: F.length(F.trim(p)) > 0)
    return F.transform(
        pieces,
        lambda p: F.struct(
            F.split_part(F.trim(p), F.lit(within), F.lit(1)).try_cast("date").alias("event_date"),
            F.split_part(F.trim(p), F.lit(within), F.lit(2)).try_cast("bigint").alias("price"),
        ),
    )


def decode_price_change(text: Column) -> Column:
    """struct(count, amount, events) from either stored layout.

    Newer: 'cnt:1-amt:-2000-evts:[2022-05-29:26000;...]'.
    Older: 'count:1;amount:1000;events:2022-06-10 38500,...'.
    """
    newer = F.struct(
        F.regexp_extract(text, r"^cnt:(-?\d+)", 1).try_cast("bigint").alias("count"),
        F.regexp_extract(text, r"-amt:(-?\d+)", 1).try_cast("bigint").alias("amount"),
        _event_list(F.regexp_extract(text, r"-evts:\[(.*)\]$", 1), ";", ":").alias("events"),
    )
    older = F.struct(
        F.regexp_extract(text, r"^count:(-?\d+)", 1).try_cast("bigint").alias("count"),
        F.regexp_extract(text, r";amount:(-?\d+)", 1).try_cast("bigint").alias("amount"),
        _event_list(F.regexp_extract(text, r";events:(.*)$", 1), ",", " ").alias("events"),
    )
    return F.when(text.startswith("cnt:"), newer).when(text.startswith("count:"), older)


def decode_price_guide(text: Column) -> Column:
    """struct of low/high for the asked range, private sale and dealer from either layout.

    Newer: 'low(private.dealer)-high(private.dealer)'; older: 'range:..;private:..;dealer:..'.
    """
    shape = r"^(\d*)\((\d*)\.(\d*)\)-(\d*)\((\d*)\.(\d*)\)$"
    named = r"^range:(\d*)-(\d*);private:(\d*)-(\d*);dealer:(\d*)-(\d*)$"
    fields = ["low", "high", "private_low", "private_high", "dealer_low", "dealer_high"]

    def parts(pattern: str, groups: list[int]) -> Column:
        return F.struct(*[
            F.regexp_extract(text, pattern, g).try_cast("bigint").alias(f) for f, g in zip(fields, groups)
        ])

    return F.when(text.startswith("range:"), parts(named, [1, 2, 3, 4, 5, 6])).when(
        text.isNotNull(), parts(shape, [1, 4, 2, 5, 3, 6])
    )
