"""Links, fields, cards and embedded JSON from stored web pages."""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass
from html import unescape
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.calendar import parse_date
from tidemark.functions.text import slug_address, strip_price

# fixed values: elements without content, and elements whose content is not text
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOT_TEXT = frozenset(["script", "style", "template"])


@dataclass(frozen=True)
class Selector:
    """What to take from a page.

    ``cls`` is the whole class attribute, or one of its words when it has no blank.
    ``take`` is 'first' (text of the first match), 'all' (texts of all), 'attr' (an attribute
    of the first match) or 'next' (text of the first later sibling that fits ``after``).
    """

    tag: str | None = None
    cls: str | None = None
    take: str = "first"
    attr: str | None = None
    after: tuple[str | None, str | None] | None = None
    strip: bool = False


# a tag as most are written: nothing for the standard parser to decide
PLAIN_TAG = re.compile(r'(/?)([A-Za-z][A-Za-z0-9]*)((?:[ \t\n]+[A-Za-z][A-Za-z0-9-]*="[^"<>&]*")*)[ \t\n]*')
PLAIN_ATTR = re.compile(r'([A-Za-z][A-Za-z0-9-]*)="([^"]*)"')
RAW = frozenset(["script", "style"])
#: Other elements whose content the standard parser of this Python does not read as tags.
UNREAD = (frozenset(HTMLParser.CDATA_CONTENT_ELEMENTS) | frozenset(getattr(HTMLParser, "RCDATA_CONTENT_ELEMENTS", ())) | {"plaintext"}) - RAW
#: Tags by their source, as many as are kept; then the table starts anew.
KNOWN_TAGS = 20_000
BEGIN, MUTE, ALONE, END = range(4)
_tags: dict[str, tuple] = {}


def _tag(name: str, attrs: dict[str, str | None]) -> tuple:
    """(what it does, name, attributes, (name, class)) of a start tag."""
    role = ALONE if name in VOID else MUTE if name in NOT_TEXT else BEGIN
    return role, name, attrs, (name, attrs.get("class") or "")


def _plain_tag(source: str) -> tuple | None:
    """The tag of a plain source, kept for the next time; None for any other source. Its attributes are shared and must not be changed."""
    found = PLAIN_TAG.fullmatch(source)
    if found is None or found[2].lower() in UNREAD or (found[1] and found[3]):
        return None
    name = found[2].lower()
    tag = (END, name, {}, (name, "")) if found[1] else _tag(name, {n.lower(): v for n, v in PLAIN_ATTR.findall(found[3])})
    if len(_tags) >= KNOWN_TAGS:
        _tags.clear()
    _tags[source] = tag
    return tag


# places in an element's line: its tag, its first text piece and the one behind its last, the element behind its content, its parent
TAG, FIRST_TEXT, END_TEXT, BEHIND, PARENT = range(5)


class _Outline:
    """Elements of a page by their number in document order, and its pieces of text.

    Pages of plain tags are cut at their brackets; at the first tag that is not plain the page goes through the standard parser instead.
    """

    def __init__(self, html: str):
        self._begin()
        if not self._read_plain(html):
            self._begin()
            parser = _Parser(self)
            parser.feed(html)
            parser.close()
        for element in self.opened:
            element[END_TEXT], element[BEHIND] = len(self.texts), len(self.elements)

    def _begin(self):
        self.elements, self.texts, self.opened, self.muted = [], [], [], 0

    def _read_plain(self, html: str) -> bool:
        """Read a page of plain tags; False, and nothing of use, where there is another."""
        head, *pieces = html.split("<")
        elements, texts, opened, known = self.elements, self.texts, self.opened, _tags
        if head:
            texts.append(unescape(head) if "&" in head else head)
        raw, muted = None, 0  # the script or style that is open; elements without text that are
        for piece in pieces:
            if raw is not None and piece[:len(raw) + 1].lower() != "/" + raw:
                if piece[:1] == "/" and piece[1:2].isspace():
                    return False
                continue
            source, close, text = piece.partition(">")
            if not close:
                return False
            tag = known.get(source) or _plain_tag(source)
            if tag is None:
                return False
            role = tag[0]
            if role == END:
                if opened and not muted and opened[-1][0][1] == tag[1]:
                    element = opened.pop()
                    element[2], element[3] = len(texts), len(elements)
                else:
                    self.end(tag[1])
                    muted = self.muted
                raw = None
            else:
                at = len(texts)
                element = [tag, at, at, len(elements) + 1, opened[-1] if opened else None]
                elements.append(element)
                if role != ALONE:
                    opened.append(element)
                    if role == MUTE:
                        self.muted = muted = muted + 1
                        raw = tag[1] if tag[1] in RAW else None
            if text and not muted:
                texts.append(unescape(text) if "&" in text else text)
        return raw is None

    def start(self, tag: tuple):
        at = len(self.texts)
        element = [tag, at, at, len(self.elements) + 1, self.opened[-1] if self.opened else None]
        self.elements.append(element)
        if tag[0] != ALONE:
            self.opened.append(element)
            self.muted += tag[0] == MUTE

    def end(self, name: str):
        # the nearest open element of that name ends, and all inside it; a stray end tag is ignored
        for depth in range(len(self.opened) - 1, -1, -1):
            if self.opened[depth][TAG][1] == name:
                for element in self.opened[depth:]:
                    element[END_TEXT], element[BEHIND] = len(self.texts), len(self.elements)
                    self.muted -= element[TAG][0] == MUTE
                del self.opened[depth:]
                return

    def text(self, at: int) -> str:
        _, first, end, _, _ = self.elements[at]
        return self.texts[first] if end - first == 1 else "".join(self.texts[first:end])


class _Parser(HTMLParser):
    """The standard parser, for pages whose tags are not all plain."""

    def __init__(self, page: _Outline):
        super().__init__(convert_charrefs=True)
        self.page = page

    def handle_starttag(self, tag, attrs):
        self.page.start(_tag(tag, dict(attrs) if attrs else {}))

    def handle_endtag(self, tag):
        self.page.end(tag)

    def handle_data(self, data):
        if not self.page.muted:
            self.page.texts.append(data)


def _fits(kind: tuple[str, str], tag: str | None, cls: str | None) -> bool:
    """Whether an element's name and class are those that are asked for."""
    if tag is not None and kind[0] != tag:
        return False
    return cls is None or kind[1] == cls or (" " not in cls and cls in kind[1].split())


class _Taker:
    """What some selectors take from a scope of a page, in one walk over its elements.

    Which selectors fit a name and class is found out once for each of them that a task meets.
    """

    KINDS = 20_000

    def __init__(self, selectors: list[Selector], missing: str | None, within: Selector | None = None):
        self.selectors, self.missing, self.within, self.known = list(selectors), missing, within, {}

    def _fitting(self, kind: tuple[str, str]) -> tuple[int, ...]:
        """Numbers of the selectors that fit; that of ``within`` is one more than theirs."""
        if len(self.known) >= self.KINDS:
            self.known.clear()
        asked = [*self.selectors, *([] if self.within is None else [self.within])]
        fitting = self.known[kind] = tuple(i for i, s in enumerate(asked) if _fits(kind, s.tag, s.cls))
        return fitting

    def rows(self, html: str | None) -> list[list]:
        """The fields of each scope of a page: the elements inside each match of ``within``, or all elements once."""
        page, known, hits, scopes = _Outline(html or ""), self.known, [], []
        number = len(self.selectors)
        for at, element in enumerate(page.elements):
            kind = element[0][3]
            fitting = known.get(kind)
            if fitting is None:
                fitting = self._fitting(kind)
            if fitting:
                if fitting[-1] == number:
                    scopes.append((at + 1, element[BEHIND]))
                hits += [(at, i) for i in fitting]
        if self.within is None:
            return [self._fields(page, hits, 0, len(page.elements))]
        return [self._fields(page, hits, *scope) for scope in scopes]

    def _fields(self, page: _Outline, hits: list[tuple[int, int]], begin: int, end: int) -> list:
        row, found = [[] if s.take == "all" else self.missing for s in self.selectors], {}
        for at, i in hits[bisect_left(hits, (begin, 0)):bisect_left(hits, (end, 0))]:
            if i not in found:
                found[i] = at
            if i < len(row) and self.selectors[i].take == "all":
                row[i].append(_clean(page.text(at), self.selectors[i]))
        for i, at in found.items():
            if i < len(row) and self.selectors[i].take != "all":
                row[i] = self._value(page, self.selectors[i], at, end)
        return row

    def _value(self, page: _Outline, selector: Selector, first: int, end: int):
        if selector.take == "next":
            parent = page.elements[first][PARENT]
            first = next((at for at in range(first + 1, end) if page.elements[at][PARENT] is parent
                          and _fits(page.elements[at][TAG][3], *selector.after)), None)
            if first is None:
                return self.missing
        if selector.take == "attr":
            value = page.elements[first][TAG][2].get(selector.attr)
            return self.missing if value is None else value
        return _clean(page.text(first), selector)


def _clean(text: str, selector: Selector) -> str:
    return text.strip() if selector.strip else text


def page_fields(
    pages: DataFrame,
    selectors: dict[str, Selector],
    *,
    missing: str | None = "None",
    keep: list[str] | None = None,
    within: Selector | None = None,
    html: str = "html",
) -> DataFrame:
    """One column per selector, all taken in a single parse of each page.

    With ``within`` there is one row per matching element and the selectors look inside it.
    Only ``keep`` and the page source travel to the parser.
    """
    keep = ["page_id"] if keep is None else keep
    kinds = {n: T.ArrayType(T.StringType()) if s.take == "all" else T.StringType() for n, s in selectors.items()}
    shape = T.StructType([pages.schema[c] for c in keep] + [T.StructField(n, k) for n, k in kinds.items()])

    def parse(batches):
        taker = _Taker(list(selectors.values()), missing, within)
        types = [pa.list_(pa.string()) if s.take == "all" else pa.string() for s in selectors.values()]
        for batch in batches:
            owner, rows = [], []
            for number, source in enumerate(batch.column(0).to_pylist()):
                found = taker.rows(source)
                owner += [number] * len(found)
                rows += found
            own = pa.array(owner, pa.int32())
            fields = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*[batch.column(i + 1).take(own) for i in range(len(keep))], *fields], shape.names)

    return pages.select(html, *keep).mapInArrow(parse, shape)


def first_text(pages: DataFrame, tag: str | None, cls: str | None, name: str = "value", **options) -> DataFrame:
    """Text of the first matching element per page."""
    return page_fields(pages, {name: Selector(tag, cls)}, **options)


def all_text(pages: DataFrame, tag: str | None, cls: str | None, name: str = "texts", **options) -> DataFrame:
    """Texts of all matching elements per page as an array."""
    return page_fields(pages, {name: Selector(tag, cls, take="all")}, **options)


def sibling_text(
    pages: DataFrame, tag: str | None, cls: str | None, after: tuple[str | None, str | None],
    name: str = "value", **options,
) -> DataFrame:
    """Text of the first later sibling, of a given tag and class, of the first match."""
    return page_fields(pages, {name: Selector(tag, cls, take="next", after=after)}, **options)


# an anchor up to the end of its href, whatever attributes stand before it
ANCHOR = r"""(?is)<a(?:\s+[^\s=>"']+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))?)*?\s+href\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)"""
TARGET = r"""(?is)\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))$"""
UNSEEN = r"(?is)<!--.*?(?:-->|$)|<(script|style|template)\b.*?(?:</\1\s*>|$)"


@F.pandas_udf(T.StringType())
def _decoded(values: pd.Series) -> pd.Series:
    """Texts with their character references resolved."""
    return values.map(unescape)


def page_links(pages: DataFrame, prefix: str | None = None, html: str = "html") -> DataFrame:
    """Distinct link targets over all pages, optionally of one prefix.

    Comments and scripts hold no links; targets may be unquoted. Only distinct targets with a character reference pass through Python.
    """
    anchors = F.regexp_extract_all(F.regexp_replace(html, UNSEEN, ""), F.lit(ANCHOR), F.lit(0))
    found = pages.select(F.explode(F.transform(anchors, lambda a: F.concat(*[F.regexp_extract(a, TARGET, i) for i in (1, 2, 3)]))).alias("href")).distinct()
    coded = found.filter(F.col("href").contains("&")).select(_decoded("href").alias("href"))
    links = found.filter(~F.col("href").contains("&")).union(coded)
    return (links.filter(F.col("href").startswith(prefix)) if prefix else links).distinct()


def page_links_by(
    pages: DataFrame, cls: str | None = None, text_prefix: str | None = None, keep: list[str] | None = None
) -> DataFrame:
    """Links by class and start of text as (kept columns, href, text), one row per link."""
    keep = ["page_id"] if keep is None else keep
    link = Selector("a", cls)
    found = _anchors(pages, link, keep)
    return found.filter(F.col("text").startswith(text_prefix)) if text_prefix else found


def _anchors(pages: DataFrame, link: Selector, keep: list[str]) -> DataFrame:
    shape = T.StructType([pages.schema[c] for c in keep] + [
        T.StructField("href", T.StringType()), T.StructField("text", T.StringType())])

    def parse(batches):
        for pdf in batches:
            rows = []
            for source, *kept in pdf[["html", *keep]].itertuples(index=False, name=None):
                page = _Outline(source or "")
                for at, element in enumerate(page.elements):
                    _, _, attrs, kind = element[TAG]
                    if _fits(kind, link.tag, link.cls) and attrs.get("href") is not None:
                        rows.append((*kept, attrs["href"], page.text(at)))
            yield pd.DataFrame(rows, columns=shape.names)

    return pages.select("html", *keep).mapInPandas(parse, shape)


# fixed values: class names of the listing cards and of the price history
CARD = Selector("div", "residential-card__content")
CARD_FIELDS = {
    "link": Selector("a", "details-link residential-card__details-link", take="attr", attr="href"),
    "address": Selector("h2", "residential-card__address-heading"),
    "price": Selector("span", "property-price"),
    "num_beds": Selector("span", "general-features__icon general-features__beds"),
    "num_baths": Selector("span", "general-features__icon general-features__baths"),
    "num_cars": Selector("span", "general-features__icon general-features__cars"),
    "property_area": Selector("span", "property-size__icon property-size__building"),
    "land_area": Selector("span", "property-size__icon property-size__land"),
    "property_type": Selector("span", "residential-card__property-type"),
}
DETAIL_FIELDS = {
    "address": Selector("h1", "property-info-address"),
    "price": Selector("span", "property-price property-info__price"),
    "num_beds": CARD_FIELDS["num_beds"],
    "num_baths": CARD_FIELDS["num_baths"],
    "num_cars": CARD_FIELDS["num_cars"],
    "property_area": CARD_FIELDS["property_area"],
    "land_area": CARD_FIELDS["land_area"],
    "description": Selector("article", "property-description"),
    "features": Selector("div", "property-features__feature", take="all"),
}
SOLD = Selector("div", "xlText bold600 PropertyHistory__salePrice--sNxkh", strip=True)
RENT = Selector("div", "xlText bold600 PropertyHistory__rentPrice--b9D1U", strip=True)
DATED = ("div", "text-secondary")


def listing_cards(
    pages: DataFrame, site: str = "", missing: str | None = "None", keep: list[str] | None = None
) -> DataFrame:
    """One row per card of a result page; the link is prefixed with ``site``."""
    cards = page_fields(pages, CARD_FIELDS, missing=missing, keep=keep, within=CARD)
    absent = F.col("link").isNull() if missing is None else F.col("link") == missing
    return cards.withColumn("link", F.when(absent, F.col("link")).otherwise(F.concat(F.lit(site), F.col("link"))))


def property_details(pages: DataFrame, missing: str | None = "None", keep: list[str] | None = None) -> DataFrame:
    """The fields of a single property's page."""
    return page_fields(pages, DETAIL_FIELDS, missing=missing, keep=keep)


def price_history(pages: DataFrame, url: str = "url", keep: list[str] | None = None) -> DataFrame:
    """Sold and rent price with date and address of each page that has a sold price."""
    keep = [url] if keep is None else [*keep, *([] if url in keep else [url])]
    fields = {
        "sold_price": SOLD,
        "sold_date": Selector(SOLD.tag, SOLD.cls, take="next", after=DATED, strip=True),
        "rent_price": RENT,
        "rent_date": Selector(RENT.tag, RENT.cls, take="next", after=DATED, strip=True),
    }
    found = page_fields(pages, fields, missing=None, keep=keep)
    return found.filter(F.col("sold_price").isNotNull()).withColumns({
        "sold_price": strip_price(F.col("sold_price")),
        "sold_date": parse_date(F.col("sold_date")),
        "rent_price": strip_price(F.col("rent_price")),
        "rent_date": parse_date(F.col("rent_date")),
        "house_address": slug_address(F.col(url)),
    })


LD_ITEM = (
    "url STRING, name STRING, mileageFromOdometer STRUCT<value: STRING>, offers STRUCT<price: STRING>, "
    "image ARRAY<STRUCT<url: STRING>>"
)


def jsonld_items(pages: DataFrame, item: str = LD_ITEM, keep: list[str] | None = None, html: str = "html") -> DataFrame:
    """Items of the first JSON-LD block of each page as (kept columns, number_of_items, item).

    A page whose list is empty or absent has one row without item. Numbers are read as text, so quoted ones and decimals are kept.
    """
    keep = ["page_id"] if keep is None else keep
    body = F.regexp_extract(
        html, r"""(?is)<script[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script>""", 1)
    schema = f"mainEntity STRUCT<numberOfItems: BIGINT, itemListElement: ARRAY<STRUCT<item: STRUCT<{_fields(item)}>>>>"
    return (
        pages.select(*keep, F.from_json(body, schema)["mainEntity"].alias("_e"))
        .select(*keep, F.col("_e.numberOfItems").alias("number_of_items"), F.explode_outer("_e.itemListElement").alias("_i"))
        .select(*keep, "number_of_items", F.col("_i.item").alias("item"))
    )


def _fields(ddl: str) -> str:
    """Top-level 'name TYPE' of a DDL list as 'name: TYPE' for a struct type."""
    return T.StructType.fromDDL(ddl).simpleString()[len("struct<"):-1]


def script_value(
    pages: DataFrame, prefix: str, schema: str, name: str = "value", statement: bool = False,
    keep: list[str] | None = None, html: str = "html",
) -> DataFrame:
    """JSON assigned in a script, such as ``var x = {...};``; null where absent or malformed.

    It reaches to the end of the script, or with ``statement`` to the next semicolon.
    """
    keep = ["page_id"] if keep is None else keep
    tail = r"([^;<]*)" if statement else r"(.*?)\s*;?\s*</script>"
    body = F.regexp_extract(html, "(?is)" + re.escape(prefix) + tail, 1)
    return pages.select(*keep, F.from_json(F.when(body != "", body), schema).alias(name))


def script_call(html: Column, function: str) -> Column:
    """First integer argument of a call of ``function`` in the page."""
    return F.regexp_extract(html, rf"\b{re.escape(function)}\((-?\d+)\)", 1).try_cast("bigint")


def json_or(value: Column, default: object) -> Column:
    """A JSON field, or a default where it is missing."""
    return F.coalesce(value, F.lit(default))
