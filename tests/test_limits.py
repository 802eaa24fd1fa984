"""Limits, prompts, metrics, archives and removal."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from inkveil.operators import limits as L
from inkveil.plans import limits as P
from inkveil.sinks import archive, staged
from inkveil.sources.tables import files
from tests.compare import check


@pytest.mark.parametrize("name", sorted(P.QUERIES))
def test_same_as_sql(spark, data, name):
    check(spark, data, P.QUERIES[name], P.ORACLE_SQL[name])


def test_uploads_and_answers(spark):
    rows = spark.createDataFrame([(5, 5), (5, 6), (99, 99), (5, None), (None, 5)], "e long, a long").select(L.arrived_error(F.col("e"), F.col("a"), 50).alias("x")).collect()
    assert [r.x for r in rows] == [None, "upload_size_mismatch", "upload_size_mismatch", "upload_missing", None]
    items = [[("x" * 200, "email")] * 100, [("x", "email")] * 101, [("x" * 201, "email")], [("x", "weather")], [(None, "email")], [], None]
    got = spark.createDataFrame([(i,) for i in items], "i array<struct<text:string,category:string>>").select(L.answer_within_bounds(F.col("i")).alias("x")).collect()
    assert [r.x for r in got] == [True, False, False, False, False, True, False]


def test_prompts_are_json(spark):
    grids = spark.createDataFrame([(1, 0, 'a "quoted"\n  grid {page_grid}'), (1, 1, ""), (2, 0, "é")], "doc_id long, page_index int, grid string")
    got = {(r.doc_id, r.page_index): json.loads(r.request) for r in L.prompts(grids, "m", "sys", "before {page_grid} after").collect()}
    assert set(got) == {(1, 0), (2, 0)} and got[1, 0]["messages"][1] == {"role": "user", "content": 'before a "quoted"\n  grid {page_grid} after'}
    assert got[2, 0]["messages"][0]["content"] == "sys" and got[2, 0]["response_format"]["json_schema"]["schema"]["properties"]["items"]["maxItems"] == 100


def test_metric_lines(spark):
    points = spark.createDataFrame([(1, "Visits", 2.0), (1, "ProcessingSeconds", 0.5), (2, "Visits", float("nan")), (2, "AppViews", 1.0), (3, "Secret", 1.0)], "k long, name string, value double")
    (row,) = L.emitted(points, "k", "N", "d", F.lit(7)).collect()
    line = json.loads(row.line)
    assert row.k == 1 and line["Visits"] == 2.0 and line["ProcessingSeconds"] == 0.5 and line["Deployment"] == "d" and line["_aws"]["Timestamp"] == 7
    assert [m["Unit"] for m in line["_aws"]["CloudWatchMetrics"][0]["Metrics"]] == ["Seconds", "Count"] and L.emitted(points, "k", "N", "d", F.lit(7), False).count() == 0


def test_archives(spark, tmp_path):
    """Order, nulls, the list last; names twice and too many files are told before; a bad name leaves nothing."""
    schema = "archive string, position int, name string, content binary, listed string"
    rows = [("a.zip", 2, "two", b"22", "2,two"), ("a.zip", 1, "one", None, "1,one"), ("b.zip", 1, "x", b"x" * 100_000, None)]
    archive.write_archives(spark.createDataFrame(rows, schema), f"file://{tmp_path}/out")
    found = {p.name: zipfile.ZipFile(p) for p in (tmp_path / "out").rglob("*.zip")}
    assert found["a.zip"].namelist() == ["one", "two", "index.csv"] and found["a.zip"].read("index.csv") == b"1,one\r\n2,two\r\n" and found["b.zip"].namelist() == ["x"]
    assert found["a.zip"].read("one") == b"" and len(found["b.zip"].read("x")) == 100_000
    twice = spark.createDataFrame([*rows, ("b.zip", 2, "x", b"", None)], schema)
    many = spark.range(65_536).select(F.lit("m.zip").alias("archive"), F.col("id").cast("string").alias("name"), F.lit(b"").alias("content"))
    assert {r.archive: r.error_code for r in archive.archive_errors(twice, True).collect()} == {"a.zip": None, "b.zip": "duplicate_name"}
    assert archive.archive_errors(many, False).first().error_code == "too_many_files"
    with pytest.raises(Exception, match="not the name of a file"):
        archive.write_archives(spark.createDataFrame([("../a.zip", 1, "x", b"", None)], schema), f"{tmp_path}/bad")
    assert not [p for p in (tmp_path / "bad").rglob("*") if p.is_file()]


def test_large_archives_are_whole(spark, tmp_path):
    """More files than a plain archive holds, written as ZIP64 and read back in spans, each entry once."""
    n = archive.MOST_FILES + 10
    rows = spark.range(n).select(F.lit("m.zip").alias("archive"), F.col("id").alias("position"), F.concat(F.lit("f"), "id").alias("name"), F.col("id").cast("string").cast("binary").alias("content"), F.lit("x").alias("listed"))
    assert archive.archive_errors(rows, True, wide=True).where("error_code is not null").isEmpty()
    archive.write_archives(rows, f"{tmp_path}/out")
    read = archive.archive_entries(files(spark, f"{tmp_path}/out", "*.zip"))
    assert read.where("name = 'index.csv'").select(F.length("content")).first()[0] == 3 * n
    found = read.where("name <> 'index.csv'")
    assert found.count() == n and found.where("name <> 'f' || cast(content as string)").isEmpty() and found.select("name").distinct().count() == n
    assert read.groupBy(F.spark_partition_id()).count().count() > 3


def test_prefixes_are_deleted_once(spark, tmp_path):
    for k in range(3):
        (tmp_path / "jobs" / str(k) / "deep").mkdir(parents=True)
        (tmp_path / "jobs" / str(k) / "deep" / "f").write_text("x")
    (tmp_path / "other").write_text("stays")
    df = spark.createDataFrame([("jobs/0",), ("jobs/1",), ("jobs/9",), ("../x",), ("/etc",), (None,)], "prefix string").coalesce(1)
    got = {r.prefix: (r.files, r.error) for r in staged.deleted_prefixes(df, str(tmp_path)).collect()}
    assert got == {"jobs/0": (1, None), "jobs/1": (1, None), "jobs/9": (0, None), "../x": (0, "invalid_prefix"), "/etc": (0, "invalid_prefix"), None: (0, "invalid_prefix")}
    assert [p.name for p in (tmp_path / "jobs").iterdir()] == ["2"] and (tmp_path / "other").exists()


def test_files_are_written_all_or_none(spark, tmp_path):
    rows = [("a.pdf", b"x" * 10), ("B.PDF", None), ("c.txt", b"y")]
    staged.write_files(spark.createDataFrame(rows, "name string, content binary").repartition(2), f"{tmp_path}/in")
    assert {p.name: p.read_bytes() for p in (tmp_path / "in").rglob("*") if p.is_file() and not p.name.startswith(".")} == {"a.pdf": b"x" * 10, "B.PDF": b"", "c.txt": b"y"}
    twice = spark.createDataFrame([*rows, ("a.pdf", b"z")], "name string, content binary").coalesce(1)
    with pytest.raises(Exception, match="more than one content"):
        staged.write_files(twice, f"{tmp_path}/bad")
    assert not [p for p in (tmp_path / "bad").rglob("*") if p.is_file()]
