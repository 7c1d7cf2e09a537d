"""Text expressions for prices, addresses, paths and page counters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_digits(text: Column) -> Column:
    """First run of digits, '' when there is none ('24,990' gives '24')."""
    return F.coalesce(F.regexp_extract(text.cast("string"), r"\d+", 0), F.lit(""))


def result_count(text: Column) -> Column:
    """The number in front of the word 'result', null when absent."""
    return F.regexp_extract(text, r"(\d+) result", 1).try_cast("bigint")


def page_count(text: Column, per_page: int = 25) -> Column:
    """How many pages a summary such as '26 results' needs."""
    return F.ceil(result_count(text) / F.lit(per_page)).cast("bigint")


def strip_price(text: Column) -> Column:
    """'$1,190,000' and '$780/w' without currency sign, separators and period."""
    return F.regexp_replace(F.trim(text), r"[$,]|/w", "")


def thousands(text: Column) -> Column:
    """A number that may carry a 'k' suffix ('1.00k' is 1000)."""
    bare = F.lower(strip_price(text))
    scaled = F.regexp_extract(bare, r"^(.*)k$", 1).try_cast("double") * 1000
    return F.when(bare.endswith("k"), scaled).otherwise(bare.try_cast("double"))


def path_segment(path: Column, from_end: int = 1) -> Column:
    """The n-th segment of a path counted from its end; null when the path is shorter."""
    return F.try_element_at(F.split(path, "/"), F.lit(-from_end))


def slug_address(url: Column) -> Column:
    """Last segment of a URL with dashes turned into spaces."""
    return F.replace(path_segment(url, 1), F.lit("-"), F.lit(" "))


def leading(text: Column, n: int) -> Column:
    """First ``n`` characters."""
    return F.substring(text, 1, n)


def drop_last(text: Column) -> Column:
    """Everything but the last character ('' stays '')."""
    return F.substring(text, F.lit(1), F.greatest(F.length(text) - 1, F.lit(0)))


def split_field(text: Column, separator: str, position: int) -> Column:
    """The 1-based field of a separated text, '' when it has fewer."""
    return F.split_part(text, F.lit(separator), F.lit(position))


def archive_path(folder: str, year: Column, month: Column, name: Column) -> Column:
    """``folder/year/month`` with a two-digit month, and '%23' in names read as '#'."""
    clean = F.replace(name, F.lit("%23"), F.lit("#"))
    return F.concat(F.lit(f"{folder}/"), F.format_string("%d/%02d/", year, month), clean)


def item_id(name: Column, url: Column) -> Column:
    """Year from the name, a dash, and the second-last segment of the URL."""
    return F.concat_ws("-", leading(name, 4), path_segment(url, 2))


def first_match(text: Column, ladder: list[tuple[list[str] | str, object]], default: object) -> Column:
    """Value of the first rung one of whose keywords occurs in the lower-cased text."""
    lowered = F.lower(text)
    result = None
    for keywords, value in ladder:
        words = [keywords] if isinstance(keywords, str) else list(keywords)
        hit = lowered.contains(words[0].lower())
        for word in words[1:]:
            hit = hit | lowered.contains(word.lower())
        result = F.when(hit, F.lit(value)) if result is None else result.when(hit, F.lit(value))
    return F.lit(default) if result is None else result.otherwise(F.lit(default))


def seller(images: Column) -> Column:
    """'private' when there is no image or the first image URL says so, else 'dealer'."""
    none = images.isNull() | (F.size(images) == 0)
    return F.when(none | F.get(images, F.lit(0))["url"].contains("private"), "private").otherwise("dealer")
