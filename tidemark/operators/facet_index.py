"""Facets from an index of bitmaps: choices and counts without another scan of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import stored


def facet_index(df: DataFrame, columns: list[str]) -> DataFrame:
    """(facet, value, bucket, bits): for each value of each column a bitmap per bucket of 32,768 row numbers, from one scan.

    Values are held as strings, null as null. A row number names the task that read the row, so each bitmap is filled within
    one task before the shuffle, and a value that holds a third of all rows is as many bitmaps as its rows fill. A bitmap has 4 KB however few
    rows it marks: meant for facets whose values repeat, not for identifiers. The index is stored.
    """
    numbered = df.select(*[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(columns)], F.monotonically_increasing_id().alias("_row"))
    cells = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(f"c{i}").alias("value")) for i, c in enumerate(columns)])
    return stored(numbered.select("_row", F.inline(cells)).groupBy("facet", "value", F.bitmap_bucket_number("_row").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_row")).alias("bits")))


def facet_counts(index: DataFrame, columns: list[str], chosen: dict[str, object], own: bool = False) -> DataFrame:
    """(facet, value, rows) for every value of the indexed columns under a selection, 0 where no row is left.

    A choice is a value or a list of values, any of which may hold; None, '' and an empty list leave a column free. The values of a
    facet are counted under the choices of the other facets, so its other values stay open; ``own`` applies its own
    choice too. Choices within a facet are united and facets intersected bitmap by bitmap, by bucket; the rows are not read.
    """
    wanted = {c: list(v) if isinstance(v, (list, tuple, set)) else [v] for c, v in chosen.items() if v is not None and v != ""}
    wanted = {c: v for c, v in wanted.items() if v}
    unknown = set(wanted) - set(columns)
    if unknown:
        raise ValueError(f"not in the index: {sorted(unknown)}")
    needs = {c: [w for w in wanted if own or w != c] for c in columns}
    values = index.where(F.col("facet").isin(columns)).select("facet", "value").distinct()
    free = [c for c in columns if not needs[c]]
    counted = index.where(F.col("facet").isin(free)).select("facet", "value", F.bitmap_count("bits").alias("n")) if free else None
    bound = [c for c in columns if needs[c]]
    if bound:
        held = F.lit(False)
        for c, v in wanted.items():
            held = held | ((F.col("facet") == c) & F.col("value").isin([F.lit(x).cast("string") for x in v]))
        united = index.where(held).groupBy("facet", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
        targets = F.create_map(*[x for w in wanted for x in (F.lit(w), F.array(*[F.lit(c) for c in bound if w in needs[c]]))])
        size = F.create_map(*[x for c in bound for x in (F.lit(c), F.lit(len(needs[c])))])
        left = united.select(F.explode(targets[F.col("facet")]).alias("facet"), "bucket", "bits").groupBy("facet", "bucket").agg(
            F.bitmap_and_agg("bits").alias("chosen"), F.count(F.lit(1)).alias("met")).where(F.col("met") == size[F.col("facet")])
        both = index.join(left.drop("met"), ["facet", "bucket"]).select("facet", "value", "bucket", F.explode(F.array("bits", "chosen")).alias("bits"))
        under = both.groupBy("facet", "value", "bucket").agg(F.bitmap_count(F.bitmap_and_agg("bits")).alias("n")).select("facet", "value", "n")
        counted = under if counted is None else counted.union(under)
    zero = values.withColumn("n", F.lit(0).cast("long"))
    return zero.union(counted).groupBy("facet", "value").agg(F.sum("n").alias("rows"))
