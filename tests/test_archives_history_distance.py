import math
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators.distance import nearest_l1, pairwise_l1
from tidemark.operators.windows import running_total
from tidemark.sources.archives import read_archive_tables, scan_archives
from tidemark.sources.sections import read_zip_lines, read_zip_tables
from tidemark.streaming.history import BUCKETS, read_distinct_history, stream_distinct_history


def sectioned(n):
    return f"C,note\nI,X,SALES,1,id,amount\nD,X,SALES,1,{n},{n * 10}\nI,X,STOCK,1,id,left\nD,X,STOCK,1,{n},{n + 1}\nD,X,STOCK,1,{n},{n + 2}\nC,end\n"


@pytest.fixture
def folder(tmp_path):
    with zipfile.ZipFile(tmp_path / "many.zip", "w", zipfile.ZIP_DEFLATED) as archive:
        for n in range(40):
            archive.writestr(f"m{n}.csv", sectioned(n))
        archive.writestr("readme.txt", "no table")
    with zipfile.ZipFile(tmp_path / "one.ZIP", "w") as archive:
        archive.writestr("m99.csv", sectioned(99))
    (tmp_path / "other.csv").write_text("I,X,NO,1,a\n")
    return str(tmp_path)


def test_every_member_is_a_task(spark, folder):
    lines = scan_archives(spark, folder)
    assert lines.rdd.getNumPartitions() == 41 and lines.count() == 41 * 7
    tables = read_archive_tables(spark, folder)
    assert sorted(map(tuple, tables["stock"].collect())) == sorted((str(n), str(n + k)) for n in [*range(40), 99] for k in (1, 2))
    one = f"{folder}/many.zip"
    order = ["member", "line_no"]
    by_archive = read_zip_lines(spark, one).select("member", "line_no", "text", "kind", "section_id", "table", "header").orderBy(*order).collect()
    assert scan_archives(spark, one).select("member", "line_no", "text", "kind", "section_id", "table", "header").orderBy(*order).collect() == by_archive
    old, new = read_zip_tables(one, spark, tables=["SALES"])["sales"], read_archive_tables(spark, one, tables=["SALES"])["sales"]
    assert sorted(old.collect()) == sorted(new.collect()) and old.columns == new.columns


def test_pruned_members_are_not_read(spark, folder):
    """Members that a filter rules out have no task; a broken one among them does no harm."""
    path = f"{folder}/many.zip"
    with zipfile.ZipFile(path) as archive:
        broken = archive.getinfo("m7.csv")
    with open(path, "r+b") as raw:
        raw.seek(broken.header_offset + 40)
        raw.write(b"\xff" * 12)
    lines = scan_archives(spark, path)
    some = lines.where(F.col("member").isin("m3.csv", "m21.csv") & (F.col("table") == "STOCK"))
    assert some.rdd.getNumPartitions() == 2
    assert sorted((r.member, r.kind) for r in some.collect()) == [(m, k) for m in ("m21.csv", "m3.csv") for k in "DDI"]
    assert lines.where("member = 'm5.csv' AND line_no = 1").count() == 1
    assert lines.where("member = 'none.csv'").count() == 0
    with pytest.raises(Exception):
        lines.where("member = 'm7.csv'").collect()


def test_a_folder_without_archives(spark, tmp_path):
    assert scan_archives(spark, str(tmp_path)).collect() == []


def test_old_rows_are_known_after_a_restart(spark, tmp_path):
    """Three deliveries with a start of the query for each: the rows are those of the batch rule, and reading needs no shuffle."""
    schema = "id long, price double, note string"
    deliveries = [[(1, 1.0, "a"), (1, 1.0, "a"), (2, None, None)], [(1, 1.0, "a"), (3, 2.5, "a"), (3, 2.5, "a"), (2, None, None)],
                  [(3, 2.5, "a"), (3, 2.5, "a"), (4, 1.0, None), (1, 1.0, "b")]]
    source, history, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    old: set = set()
    for rows in deliveries:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        query = stream_distinct_history(spark, source, history, schema, checkpoint=state)
        query.awaitTermination()
        assert query.exception() is None
        found = read_distinct_history(spark, history)
        key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r)
        assert sorted((tuple(r) for r in found.collect()), key=lambda r: str(key(r))) == sorted([*old, *rows], key=lambda r: str(key(r)))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "HashAggregate" not in plan
        old |= set(rows)
    stream_distinct_history(spark, source, history, schema, checkpoint=state).awaitTermination()  # nothing new: nothing changes
    assert read_distinct_history(spark, history).count() == len({*deliveries[0], *deliveries[1]}) + 4


def test_state_is_held_by_bucket_not_by_row(spark, tmp_path):
    source, history, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for low, high in ((0, 4000), (2000, 6000)):
        spark.range(low, high).union(spark.range(low, low + 10)).write.mode("append").parquet(source)
        query = stream_distinct_history(spark, source, history, "id long", checkpoint=state)
        query.awaitTermination()
    assert sum(op["numRowsTotal"] for p in query.recentProgress[-1:] for op in p["stateOperators"]) <= BUCKETS
    assert sorted(r.id for r in read_distinct_history(spark, history).collect()) == sorted([*range(4000), *range(2000, 6000), *range(2000, 2010)])


def test_large_numbers_beside_nulls_are_kept(spark, tmp_path):
    source, history, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows = [(2**53 + 1 + i if i % 3 else None, [float("inf"), 0.1, None][i % 3], None if i % 2 else True) for i in range(900)]
    schema = "id long, v double, b boolean"
    spark.createDataFrame(rows, schema).write.parquet(source)
    stream_distinct_history(spark, source, history, schema, checkpoint=state).awaitTermination()
    assert sorted(map(str, map(tuple, read_distinct_history(spark, history).collect()))) == sorted(map(str, rows))


def test_clustered_vectors_are_compared_in_part(spark):
    rng = np.random.default_rng(4)
    centres = rng.uniform(0, 1000, (16, 8))
    rows = [(i, f"k{i % 2}", (centres[i % 16] + rng.normal(0, 1, 8)).round(3).tolist()) for i in range(1600)]
    rows += [(1600 + i, "k0", rows[0][2]) for i in range(5)] + [(1700, None, rows[3][2]), (1701, None, rows[4][2]), (1702, "alone", rows[4][2])]
    frame = spark.createDataFrame(rows, "id long, kind string, v array<double>")
    compared = []
    got = nearest_l1(frame, "id", "v", 3, key="kind", block_rows=64, compared=compared)
    want = pairwise_l1(frame, "id", "v", key="kind", top=3)
    order = ["a", "rank"]
    assert [tuple(r) for r in got.orderBy(*order).collect()] == [tuple(r) for r in want.orderBy(*order).select(*got.columns).collect()]
    assert 0 < compared[0] < (2 * 800 ** 2) / 3
    assert nearest_l1(frame.limit(0), "id", "v", 3).collect() == []
    few = nearest_l1(frame.limit(3), "id", "v", 5, block_rows=1)
    assert few.count() == 6


def test_running_totals_lose_no_value(spark):
    rows = [(1, 1e17), (2, 1.0), (3, 1e-13), (4, None), (5, 0.1), (6, -1e17), (7, float("inf")), (8, 1.0), (9, float("nan"))]
    frame = spark.createDataFrame([("k", *r) for r in rows], "k string, i int, v double")
    for most in (1_000, 1):
        got = [r.running for r in running_total(frame, ["k"], ["i"], "v", max_group_rows=most).orderBy("i").collect()]
        assert got[:2] == [1e17, 1e17 + 1] and got[3] == got[2] and abs(got[5] - 1.1) < 20 and got[6] == got[7] == math.inf and math.isnan(got[8])
    small = spark.createDataFrame([("k", 1, 1.0), ("k", 2, 1e-13), ("k", 3, 1e-13)], "k string, i int, v double")
    for most in (1_000, 1):
        assert [r.running for r in running_total(small, ["k"], ["i"], "v", max_group_rows=most).orderBy("i").collect()] == pytest.approx(
            [1.0, 1 + 1e-13, 1 + 2e-13], abs=1e-15)
