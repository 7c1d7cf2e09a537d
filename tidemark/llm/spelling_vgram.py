"""Spelling variants: words one edit apart, found by an index of variable-length grams, and the commonest form of each.

Words are maximal runs of ``[A-Za-z\\u00C0-\\u00FF]``, A to Z lower-cased. Two words are near if one inserted, deleted or replaced
code point turns one into the other. A null text has no word; texts are read whole; equal rows count as often as they occur.

The index follows the variable-length gram method. A word stands between a begin and an end mark. Its gram at a place begins with
``Q_MIN`` characters and is made longer, up to ``Q_MAX``, while it is one of the frequent grams; a gram that lies within an
earlier one is left out. The frequent grams are those with more than 1 / ``GRAMS`` of all gram occurrences, so there are fewer than
``GRAMS`` of them whatever the corpus, and they are all that a task needs to know.
An edit spoils the grams around it, of a word at most its ``affected`` number; near words share all others. So one of any affected + 1
grams of a word is in the near word, at its place or one further: the rarest are looked up, a pair must share as many grams as
both words' bounds demand, by a 64-bit parity of the grams that two words do not share, and the edit distance decides. Words so short that every gram may be affected have no bound;
two such words are near only if they agree before or behind the middle, and are met by their halves.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.text_arrays import plain, sliced
from tidemark.session import stored

Q_MIN, Q_MAX = 2, 3
#: Bound of the number of frequent grams, and the fewest occurrences of one.
GRAMS, FEWEST = 20_000, 16
#: Words counted in a task before they are handed on.
HELD = 1 << 17
BEGIN, END = "\x02", "\x03"
RUN = re.compile("[a-zÀ-ÿ]+")
CUT = 97


def damaged_words(text: bytes, doc_id: str) -> Counter:
    """Occurrences of a document's words; a word whose crc32 with the id is divisible by 97 loses the code point that the crc names."""
    out = Counter(RUN.findall(text.lower().decode("utf-8", "ignore")))
    start, crc = zlib.crc32(f"{doc_id}:".encode()), zlib.crc32
    for word in [w for w in out if crc(w.encode(), start) % CUT == 0]:
        at = crc(word.encode(), start) % len(word)
        out[word] = (out[word], word[:at] + word[at + 1:])
    moved = [(w, v) for w, v in out.items() if type(v) is tuple]
    for word, _ in moved:
        del out[word]
    for _, (n, short) in moved:
        out[short] += n
    return out


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 5) -> DataFrame:
    """(word, n) over all documents, words of ``shortest`` code points or more."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in sliced(batches):
            for doc, text in zip(batch.column("id").to_pylist(), plain(batch, "t")):
                for word, n in damaged_words(text, doc).items():
                    held[word] += n
            if len(held) >= HELD:
                yield flushed(held)
        yield flushed(held)

    def flushed(held: Counter) -> pa.RecordBatch:
        some = {w: n for w, n in held.items() if len(w) >= shortest}
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(list(some), pa.string()), pa.array(list(some.values()), pa.int64())], schema=schema)

    narrow = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("t"))
    return narrow.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_grams(words: DataFrame, q_min: int = Q_MIN, q_max: int = Q_MAX, grams: int = GRAMS, fewest: int = FEWEST) -> dict[str, int]:
    """The grams of ``q_min`` to ``q_max`` characters that occur in more than 1 / ``grams`` of all places; fewer than ``grams`` of them."""
    marked = words.select(F.concat(F.lit(BEGIN), "word", F.lit(END)).alias("w"))
    total = marked.agg(F.sum(F.length("w"))).first()[0] or 0
    least = max(fewest, total * (q_max - q_min + 1) // grams)
    every = marked.select("w", F.explode(F.array(*[F.lit(q) for q in range(q_min, q_max + 1)])).alias("q"))
    places = every.where(F.length("w") >= F.col("q")).select(
        "w", "q", F.explode(F.sequence(F.lit(1), F.length("w") - F.col("q") + 1)).alias("p"))
    counts = places.groupBy(F.substr("w", "p", "q").alias("g")).agg(F.count(F.lit(1)).alias("n"))
    return {r.g: r.n for r in counts.where(F.col("n") > least).collect()}


def decompose(word: str, frequent: dict[str, int], q_min: int = Q_MIN, q_max: int = Q_MAX) -> list[tuple[int, str]]:
    """(place, gram) of a marked word."""
    out, covered, n = [], 0, len(word)
    for p in range(n - q_min + 1):
        end = p + q_min
        while end < n and end - p < q_max and word[p:end] in frequent:
            end += 1
        if end > covered:
            out.append((p, word[p:end]))
            covered = end
    return out


def affected(grams: list[tuple[int, str]], n: int, q_max: int = Q_MAX) -> int:
    """The most grams of a marked word of n characters that one edit may change or hide.

    An edit changes the grams that hold its place. A changed gram may become as long as ``q_max`` and then hide those behind it.
    """
    most = 0
    for i in range(1, n):
        swapped = sum(p <= i < p + len(g) or i < p and p + len(g) <= i + q_max for p, g in grams) if i < n - 1 else 0
        added = sum(p < i < p + len(g) or i <= p and p + len(g) < i + q_max for p, g in grams)
        most = max(most, swapped, added)
    return most


def _signed(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode()) - (1 << 63)


def indexed(words: DataFrame, frequent: dict[str, int], q_min: int = Q_MIN, q_max: int = Q_MAX) -> DataFrame:
    """(word, len, bound, m, parity, places, rare) per word: how many of its m grams a near word shares at least, a bit per hashed gram
    that occurs an odd number of times, (hash, place) of all grams, and those to look up. A word without a bound looks up none."""
    place = pa.list_(pa.struct([("g", pa.int64()), ("p", pa.int32())]))
    schema = pa.schema([("word", pa.string()), ("len", pa.int32()), ("bound", pa.int32()), ("m", pa.int32()), ("parity", pa.int64()),
                        ("places", place), ("rare", place)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for word in batch.column("word").to_pylist():
                marked = f"{BEGIN}{word}{END}"
                found = decompose(marked, frequent, q_min, q_max)
                spoilt, parity = affected(found, len(marked), q_max), 0
                places = [{"g": _signed(g), "p": p} for p, g in found]
                for at in places:
                    parity ^= 1 << (at["g"] & 63)
                order = sorted(range(len(found)), key=lambda k: (frequent.get(found[k][1], 0), found[k]))
                bound = len(found) - spoilt
                rows.append({"word": word, "len": len(word), "bound": bound, "m": len(found), "parity": parity - (parity >> 63 << 64),
                             "places": places, "rare": [places[k] for k in order[:spoilt + 1]] if bound > 0 else []})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    kind = "array<struct<g:long,p:int>>"
    return words.select("word").mapInArrow(run, f"word string, len int, bound int, m int, parity long, places {kind}, rare {kind}")


def near_pairs(words: DataFrame, q_min: int = Q_MIN, q_max: int = Q_MAX, grams: int = GRAMS, fewest: int = FEWEST) -> DataFrame:
    """(a, b), a before b, of all near pairs of distinct ``word``."""
    index = stored(indexed(words, frequent_grams(words, q_min, q_max, grams, fewest), q_min, q_max))
    weak_lengths = [r.len for r in index.where("bound <= 0").select("len").distinct().collect()]  # short words only
    key = lambda weak, p, n: F.xxhash64(F.lit(weak), F.col("at.g"), p, n)
    p, n, kept = F.col("at.p"), F.col("len"), ["word", "bound", "m", "parity"]
    lists = index.select(*kept, "len", F.explode("places").alias("at"))
    mine = F.array(key(0, p, n))
    if weak_lengths:
        mine = F.when(F.col("bound") > 0, mine).otherwise(F.array(key(0, p, n), key(1, p, n)))
    lists = lists.select(*[F.col(c).alias(f"y_{c}") for c in kept], F.explode(mine).alias("k"))
    # a word of equal length has the gram at its place, a longer one there or one further; shorter ones without a bound look up nothing
    asks = F.array(key(0, p, n), key(0, p, n + 1), key(0, p + 1, n + 1))
    if weak_lengths:
        asks = F.when(n.isin([w + 1 for w in weak_lengths]), F.concat(asks, F.array(key(1, p, n - 1), key(1, p - 1, n - 1)))).otherwise(asks)
    asked = index.select(*kept, "len", F.explode("rare").alias("at")).select(*[F.col(c).alias(f"x_{c}") for c in kept], F.explode(asks).alias("k"))
    apart = F.bit_count(F.col("x_parity").bitwiseXOR(F.col("y_parity")))
    alike = apart <= F.col("x_m") + F.col("y_m") - 2 * F.greatest("x_bound", "y_bound")
    met = asked.join(lists, "k").where(alike & (F.col("x_word") != F.col("y_word")) & (F.levenshtein("x_word", "y_word", 1) == 1))
    return met.select(F.least("x_word", "y_word").alias("a"), F.greatest("x_word", "y_word").alias("b")).union(_by_halves(index)).distinct()


def _by_halves(index: DataFrame) -> DataFrame:
    """Near pairs of words without a bound: they agree before or behind the middle of the shorter one."""
    def half(length: Column, front: bool, skip: int) -> Column:
        middle = F.floor(length / 2).cast("int")
        part = F.substr("word", F.lit(1), middle) if front else F.substr("word", middle + 1 + skip)
        return F.struct(length.cast("int").alias("n"), F.lit(front).alias("front"), part.alias("part"))

    short, w = F.col("len"), index.where("bound <= 0").select("word", "len")
    own = w.select(F.col("word").alias("x"), F.explode(F.array(half(short, True, 0), half(short, False, 0))).alias("k"))
    longer = w.select(F.col("word").alias("y"), F.explode(F.array(half(short - 1, True, 0), half(short - 1, False, 1))).alias("k"))
    same = own.withColumnRenamed("x", "y")
    met = own.join(same, "k").where("x < y").union(own.join(longer, "k")).where(F.levenshtein("x", "y", 1) == 1)
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def last_forms(forms: DataFrame) -> DataFrame:
    """(word, root): from every word that has a ``form`` the end of its chain of forms; each round doubles the steps.

    A form is at least twice as frequent as its word, so a chain has no circle and is shorter than the logarithm of the largest count.
    """
    reach = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        on = reach.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = stored(reach.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        reach = new.drop("moved")
        if new.where("moved").isEmpty():
            return reach


def variants(counts: DataFrame, factor: int = 2, **grams) -> DataFrame:
    """(word, form, root, n, n_near, form_n) per row of (word, n), words distinct.

    ``form`` is the near word of largest n (ties: smallest in code-point order), if that n is ``factor`` times the word's or more.
    """
    counts = stored(counts.select("word", "n"))
    pairs = near_pairs(counts, **grams)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other")).union(pairs.select("b", "a"))
    known = both.join(counts.select(F.col("word").alias("other"), F.col("n").alias("m")), "other")
    best = known.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "other")).alias("best"))
    found = counts.join(best, "word", "left")
    enough = -F.col("best.less") >= factor * F.col("n")
    found = stored(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                F.when(enough, F.col("best.other")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")))
    roots = last_forms(found.where("form IS NOT NULL"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
