import datetime as dt
import os
import zipfile

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tests.conftest import rows
from tidemark import session
from tidemark.operators.compare import append_history, frames_equal
from tidemark.session import shared_dir, spread, stored
from tidemark.sources import files, sections, synth
from tidemark.streaming.history import read_history, stream_history


def write(path, text):
    path.write_text(text)
    return str(path)


def test_csv_strings_keep_doubled_quotes(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'name,note\n"x, ""y""",1\n')
    frame = files.scan_csv(spark, path)
    assert [t for _, t in frame.dtypes] == ["string", "string"]
    assert rows(frame) == [('x, "y"', "1")]


def test_csv_range_reads_doubled_quotes(spark, tmp_path):
    path = write(tmp_path / "r.csv", 'junk\na,b\n1,"he said ""x"", twice"\n')
    found = files.scan_csv_range(spark, path, skip=1, n=1, columns={1: "b"})
    assert [r["b"] for r in found.collect()] == ['he said "x", twice']


def test_csv_round_trip_of_awkward_texts(spark, tmp_path):
    frame = spark.createDataFrame([(1, ' a, "b" '), (2, "x\ny\r\nz"), (3, "back\\slash"), (4, None)], "k INT, t STRING")
    files.write_csv(frame, str(tmp_path / "t"))
    assert frames_equal(frame, files.scan_csv(spark, str(tmp_path / "t"), "k INT, t STRING", multi_line=True))


def test_csv_typed_and_tolerant(spark, tmp_path):
    path = write(tmp_path / "a.csv", "k,v\n1,2\nbad,3,surplus\n4,\n")
    frame = files.scan_csv(spark, path, "k INT, v DOUBLE")
    assert rows(frame, "v") == [(4, None), (1, 2.0), (None, 3.0)]
    with pytest.raises(Exception):
        files.scan_csv(spark, path, "k INT, v DOUBLE", tolerant=False).collect()


def test_csv_inferred(spark, tmp_path):
    path = write(tmp_path / "a.csv", "i,f,s\n1,1.5,a\n2,2.5,b\n")
    assert files.scan_csv(spark, path, infer=True).dtypes == [("i", "int"), ("f", "double"), ("s", "string")]


def test_csv_dates_by_several_patterns(spark, tmp_path):
    path = write(tmp_path / "a.csv", "d\n1/12/2010 8:26\n2010-12-02\nnever\n")
    frame = files.scan_csv(spark, path, date_cols=["d"], fmt=["d/M/yyyy H:mm", "yyyy-MM-dd"])
    assert set(rows(frame)) == {(dt.datetime(2010, 12, 1, 8, 26),), (dt.datetime(2010, 12, 2),), (None,)}


def test_line_numbers_over_many_splits(spark, tmp_path):
    n = 5000
    write(tmp_path / "big.txt", "".join(f"row {i}\n" for i in range(1, n + 1)))
    write(tmp_path / "small.txt", "row 1\nrow 2\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        found = files.read_lines(spark, str(tmp_path)).cache()
        assert found.select("split").distinct().count() > 5
        assert found.count() == n + 2
        assert found.filter(F.col("text") != F.concat(F.lit("row "), F.col("line_no").cast("string"))).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "134217728")


def test_csv_range(spark, tmp_path):
    path = write(tmp_path / "s.csv", "title\n\na,b,c,d\n1,2,3,4\n5,6,7,8\n9,10,11,12\n")
    found = files.scan_csv_range(spark, path, skip=2, n=2, columns={1: "b", 3: "d"})
    assert rows(found.select("b", "d"), "d") == [("2", "4"), ("6", "8")]


def test_parquet_folders_prune(spark, tmp_path):
    path = str(tmp_path / "t")
    frame = spark.createDataFrame([(1, 2025, 12), (2, 2026, 1)], "v INT, year INT, month INT")
    files.write_parquet(frame, path, by=["year", "month"])
    found = files.scan_parquet(spark, path, "year = 2025")
    assert rows(found.select("v", "month")) == [(1, 12)]
    assert "PartitionFilters: [isnotnull(year" in found._jdf.queryExecution().toString()


def test_rows_and_empty_frames(spark):
    assert files.frame_from_rows(spark, [], "language STRING, user_count INT").count() == 0
    assert rows(files.frame_from_rows(spark, [("Java", 20000)], ["language", "user_count"])) == [("Java", 20000)]
    with pytest.raises(ValueError):
        files.frame_from_rows(spark, [], ["language"])


def test_inventory_counts_direct_files_only(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.bin").write_bytes(b"x" * 1024)
    (tmp_path / "b.bin").write_bytes(b"x" * 1024)
    (tmp_path / "sub" / "c.bin").write_bytes(b"x" * 4096)
    found = files.file_inventory(spark, str(tmp_path))
    assert rows(found.select("name", "length"), "name") == [("a.bin", 1024), ("b.bin", 1024)]
    assert files.size_mb(found).first()[0] == pytest.approx(2 / 1024)


SAMPLE = "D,x\nI,s,t,v\nD,s,t,2\nE,finished\n"
REPORT = (
    "C,HEAD,x\nI,DISPATCH,PRICE,1,Region,RRP\nD,DISPATCH,PRICE,1,QLD,10.5\nD,DISPATCH,PRICE,1,NSW,bad\n"
    "C,inside\nI,DISPATCH,LOAD,1,Unit,MW\nD,DISPATCH,LOAD,1,A,5,surplus\n"
    "I,DISPATCH,PRICE,1,Region,RRP\nD,DISPATCH,PRICE,1,VIC,7\nC,END,8\nD,DISPATCH,PRICE,1,LATE,1\n"
)


def lines_of(spark, *texts):
    data = [(f"f{i}", n, line) for i, t in enumerate(texts) for n, line in enumerate(t.splitlines(), 1)]
    return spark.createDataFrame(data, "file STRING, line_no BIGINT, text STRING")


def test_section_bytes_of_the_sample(spark):
    tagged = sections.tag_sections(lines_of(spark, SAMPLE))
    assert rows(sections.section_ranges(tagged).select("table", "start", "end")) == [("t", 4, 31)]
    assert len(SAMPLE) == 31


def test_no_section(spark):
    tagged = sections.tag_sections(lines_of(spark, "C,x\nD,y\n"))
    assert tagged.filter("section_id IS NOT NULL").count() == 0
    assert sections.read_sections(lines_of(spark, "C,x\nD,y\n")) == {}


def test_lines_are_tagged_in_tasks_of_bounded_text(spark, tmp_path, monkeypatch):
    for i in range(200):
        (tmp_path / f"f{i}.txt").write_text(SAMPLE)
    monkeypatch.setattr(session, "SPREAD_BYTES", 400)
    tagged = sections.tag_sections(files.read_lines(spark, str(tmp_path)))
    assert tagged.rdd.getNumPartitions() == -(-200 * len(SAMPLE) // 400) > spark.sparkContext.defaultParallelism
    assert rows(sections.section_ranges(tagged).groupBy("start", "end").count()) == [(4, 31, 200)]


@pytest.mark.parametrize("block", [1, 2, 3, 200_000])
def test_sections_by_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(sections, "BLOCK_LINES", block)
    tagged = sections.tag_sections(lines_of(spark, REPORT, SAMPLE))
    found = rows(tagged.filter("file = 'f0'").select("line_no", "section_id", "table"), "line_no")
    want = [None, 1, 1, 1, 1, 2, 2, 3, 3, None, None]
    names = {None: None, 1: "PRICE", 2: "LOAD", 3: "PRICE"}
    assert found == [(i, s, names[s]) for i, s in enumerate(want, 1)]
    ranges = rows(sections.section_ranges(tagged).filter("file = 'f0'").select("section_id", "start", "end"), "section_id")
    starts = [REPORT.index("I,DISPATCH,PRICE"), REPORT.index("I,DISPATCH,LOAD"), REPORT.rindex("I,DISPATCH,PRICE")]
    assert ranges == [(1, starts[0], starts[1]), (2, starts[1], starts[2]), (3, starts[2], REPORT.index("C,END"))]


def test_read_sections(spark):
    found = sections.read_sections(
        lines_of(spark, REPORT), schemas={"PRICE": {"RRP": "double"}}, drop_metadata=True,
        conditions={"price": [("region", "!=", "NSW")]})
    assert sorted(found) == ["load", "price"]
    assert rows(found["price"], "region") == [("QLD", 10.5), ("VIC", 7.0)]
    assert rows(found["load"]) == [("A", "5")]
    only = sections.read_sections(lines_of(spark, REPORT), tables=["LOAD"], columns={"LOAD": ["MW"]}, lower=False)
    assert list(only) == ["LOAD"] and rows(only["LOAD"]) == [("5",)] and only["LOAD"].columns == ["MW"]


def test_sections_with_different_headers_are_united(spark):
    other = "I,DISPATCH,PRICE,1,Region,Extra\nD,DISPATCH,PRICE,1,TAS,e\n"
    found = sections.read_sections(lines_of(spark, REPORT, other), tables=["PRICE"], drop_metadata=True)["price"]
    assert rows(found.filter("region = 'TAS'").select("region", "rrp", "extra")) == [("TAS", None, "e")]
    # the C line inside the first section belongs to its slice and has no fields
    assert found.count() == 5


def test_zip_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sections, "LINES_PER_BATCH", 2)
    for n in (1, 2):
        with zipfile.ZipFile(tmp_path / f"PUBLIC#{n}.zip", "w") as archive:
            archive.writestr("a.CSV", REPORT)
            archive.writestr("readme.txt", "I,no,no,1")
    found = sections.read_zip_tables(str(tmp_path), spark, schemas={"PRICE": {"RRP": "double"}})
    assert rows(found["price"].groupBy("region").count(), "region") == [
        (None, 2), ("NSW", 2), ("QLD", 2), ("VIC", 2)]
    # tags made while unzipping are those made by windows
    lines = sections.read_zip_lines(spark, str(tmp_path))
    tagged = sections.tag_sections(lines.select("file", "line_no", "text"))
    assert frames_equal(tagged, lines.select(*tagged.columns))
    only = sections.read_zip_lines(spark, str(tmp_path), tables=["LOAD"])
    assert rows(only.select("table", "kind").distinct(), "kind") == [("LOAD", "D"), ("LOAD", "I")]
    kept = sections.read_zip_tables(str(tmp_path), spark, drop_metadata=False)
    assert kept["load"].columns == ["i", "dispatch", "load", "1", "unit", "mw"]


def test_history_dedups_the_old_side_only(spark):
    old = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id INT, n STRING")
    new = spark.createDataFrame([(1, "a"), (1, "a")], "id INT, n STRING")
    assert rows(append_history(old, new), "id") == [(1, "a")] * 3 + [(2, "b")]
    assert append_history(old, new, dedup_old=False).count() == 5
    assert append_history(None, new) is new


def test_stream_equals_batch(spark, tmp_path):
    source, history, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    batches = [[(1, "a"), (1, "a"), (2, "b")], [(2, "b"), (2, "b")], [(3, "c")]]
    folded = None
    for batch in batches:
        frame = spark.createDataFrame(batch, "id INT, n STRING")
        frame.coalesce(1).write.mode("append").parquet(source)
        stream_history(spark, source, history, "id INT, n STRING", checkpoint=state).awaitTermination()
        folded = append_history(folded, frame)
        assert frames_equal(read_history(spark, history), folded)
    # nothing new: nothing changes
    stream_history(spark, source, history, "id INT, n STRING", checkpoint=state).awaitTermination()
    assert frames_equal(read_history(spark, history), folded)
    [stream] = [d for d in os.listdir(history) if d.startswith("stream=")]
    assert sorted(d for d in os.listdir(f"{history}/{stream}") if d.startswith("batch")) == ["batch=0", "batch=1", "batch=2"]


def test_two_checkpoints_share_a_history(spark, tmp_path):
    history = str(tmp_path / "out")
    for n, batch in enumerate([[(1, "a"), (2, "b"), (3, "c")], [(4, "d"), (1, "a")]]):
        source = str(tmp_path / f"in{n}")
        spark.createDataFrame(batch, "id INT, n STRING").coalesce(1).write.parquet(source)
        stream_history(spark, source, history, "id INT, n STRING", checkpoint=str(tmp_path / f"state{n}")).awaitTermination()
    assert rows(read_history(spark, history), "id") == [(1, "a"), (1, "a"), (2, "b"), (3, "c"), (4, "d")]


def test_random_table_is_repeatable_and_in_range(spark):
    spec = dict(
        str_cols={"count": 2, "name": ["id", "category"], "str_len": [8, (5, 20)], "str_count": [100, 30]},
        ts_cols={"count": 2, "name": ["start_date", "end_date"], "start_date": ["2020-01-01", "2023-01-01"],
                 "end_date": ["2023-01-01", "2025-01-01"], "freq": "MS", "random": True},
        int_cols={"count": 1, "low": 3, "high": 6}, float_cols={"count": 2, "low": 0.0, "high": 100.0, "missing_pct": 0.1})
    frame = synth.random_table(spark, 3000, **spec)
    assert frame.columns == ["id", "category", "start_date", "end_date", "i1", "f1", "f2"]
    assert frames_equal(frame, synth.random_table(spark, 3000, **spec))
    assert not frames_equal(frame, synth.random_table(spark, 3000, **spec, rand_seed=12))
    stats = frame.agg(
        F.min("i1"), F.max("i1"), F.min("f1") >= 0, F.max("f1") < 100, F.count_distinct("category"),
        F.max(F.length("id")), F.min(F.length("id")), F.count_distinct("start_date"),
        F.min("start_date"), F.max("end_date"), F.avg(F.isnull("f1").cast("double"))).first()
    assert stats[:8] == (3, 5, True, True, 30, 8, 8, 36)
    assert stats[8:10] == (dt.datetime(2020, 1, 1), dt.datetime(2024, 12, 1))
    assert 0.07 < stats[10] < 0.13


def test_running_timestamps(spark):
    frame = synth.random_table(spark, 3, ts_cols={"count": 1, "start_date": "2024-01-01", "end_date": "2024-01-04"})
    assert rows(frame) == [(dt.datetime(2024, 1, d),) for d in (1, 2, 3)]
    with pytest.raises(ValueError):
        synth.random_table(spark, 4, ts_cols={"count": 1, "start_date": "2024-01-01", "end_date": "2024-01-04"})


def test_spread_leaves_large_input_alone(spark, sf):
    frame = spark.read.parquet(f"{sf}/orders.parquet")
    assert spread(frame).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    try:
        assert spread(frame) is frame
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "134217728")


def test_stored_goes_to_the_shared_folder(spark):
    folder = shared_dir(spark)
    assert spark.sparkContext.getCheckpointDir().startswith(("file:" + folder, folder))
    frame = stored(spark.range(3))
    assert frame.count() == 3 and "RDD" in frame._jdf.queryExecution().toString()


def test_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"
        def getCheckpointDir(self):  # noqa: E301
            return None

    class Conf:
        def get(self, key, default):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())


def test_functions_travel_by_value():
    assert "tidemark" in cloudpickle.list_registry_pickle_by_value()
