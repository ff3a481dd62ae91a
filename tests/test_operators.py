"""Operators on small inputs, the sources, the stream, and every registered query against its SQL."""

import glob
import os
import struct
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from idweave import queries as core
from idweave.operators import layout, readings, review
from idweave.plans import cards
from idweave.sources import captures
from idweave.streaming import frames

SF = "/root/testdata/sf0.001"


def rows(df):
    names = sorted(df.columns)
    cell = lambda v: None if v is None or v != v else round(float(v), 6) + 0.0 if isinstance(v, float) else str(v)
    return names, sorted(tuple(str(cell(v)) for v in r) for r in df[names].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(core.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    assert rows(core.QUERIES[name](spark, SF).toPandas()) == rows(con.sql(core.ORACLE_SQL[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_captures(spark, tmp_path):
    for name, size in (("a.PNG", 3), ("b.txt", 3), ("c.jpg", 0)):
        (tmp_path / name).write_bytes(b"x" * size)
    got = captures.checked(captures.read_captures(spark, str(tmp_path))).collect()
    assert {r["path"].rsplit("/", 1)[1]: r["reason"] for r in got} == {"a.PNG": None, "b.txt": "extension"}  # Spark lists no empty files
    named = spark.createDataFrame([("/x/a.jpg", 0), ("/x/a.jpg", 11 << 20), ("/x/", 1), ("/x/a.webp", 1)], "path string, length long")
    assert [r["reason"] for r in captures.checked(named).collect()] == ["empty", "too_large", "no_name", None]
    assert captures.accepted(captures.read_captures(spark, str(tmp_path))).count() == 1


def png(path):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", 1, 1, 8, 2, 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"\0\1\2\3")) + chunk(b"IEND", b""))


def test_undecodable(spark, tmp_path):
    png(tmp_path / "good.png")
    (tmp_path / "bad.png").write_bytes(b"no picture")
    got = captures.undecodable(spark, captures.read_captures(spark, str(tmp_path)), str(tmp_path)).collect()
    assert [r["path"].rsplit("/", 1)[1] for r in got] == ["bad.png"]


def test_stream_equals_batch(spark, tmp_path):
    land = tmp_path / "land"
    land.mkdir()
    for k in range(5):
        (land / f"f{k}.{'png' if k % 2 else 'gif'}").write_bytes(b"x" * (k + 1))
    frames.drained(frames.gated(captures.read_stream(spark, str(land))), str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted(spark.read.parquet(str(tmp_path / "out")).collect(), key=str) == sorted(frames.gated(captures.read_captures(spark, str(land))).collect(), key=str)


def test_record(spark):
    read = spark.createDataFrame([(1, f, 0, v, 0.9) for f, v in (("national_id", "1234567891"), ("first_name", "محمد"), ("last_name", "رضایی"), ("birth_date", "1380/05/12"), ("expiry_date", "1409/01/02"))], "capture_id int, field string, attempt_no int, raw string, conf double")
    lines = spark.createDataFrame([(1, 0, "نام پدر", 0.9, 300.0, 100.0, 20.0), (1, 1, "حسین", 0.9, 100.0, 105.0, 20.0)], "capture_id int, line_no int, text string, confidence double, cx double, cy double, h double")
    made = cards.records(read, lines).first()
    assert made["data"]["national_id"] == "1234567891" and made["data"]["father_name"] == "حسین"
    assert made["missing_fields"] == [] and made["needs_review"] is False
    none = cards.records(read.limit(0), lines).collect()
    assert none == []


def test_best_reading_and_calibration(spark):
    some = spark.createDataFrame([(1, 0, "a", 0.6), (1, 1, "b", 0.6), (2, 0, None, 0.9), (3, 0, "c", 0.2)], "k int, attempt_no int, raw string, conf double")
    assert {r["k"]: (r["raw"], r["conflict"]) for r in readings.best_reading(some, ["k"]).collect()} == {1: ("a", True), 3: ("c", False)}
    boxes = spark.createDataFrame([("f", 50.0, 80.0, 10.0, 20.0, 100.0, 100.0)], "field string, ax double, ay double, bx double, by double, width double, height double")
    assert tuple(layout.calibrated(boxes).first()) == ("f", 0.1, 0.2, 0.5, 0.8)
    q = spark.range(1).select(review.issues(review.quality(F.lit(100), F.lit(900), F.lit(10.0), F.lit(250.0))).alias("i")).first()["i"]
    assert q == ["blurry", "low_resolution", "overexposed"]


def test_equal_candidates(spark):
    """Equal score, detector and seq: the same candidate whatever the order of rows."""
    quad = lambda x: [(x + 9.0, 9.0), (x, 0.0), (x + 9.0, 0.0), (x, 9.0)]
    own = [(1, 0.5, 4, quad(184.0)), (1, 0.5, 4, quad(32.0)), (1, 0.5, 4, quad(92.0)), (1, 0.25, 1, quad(1.0))]
    for some in (own, own[::-1]):
        df = spark.createDataFrame(some, "k int, score double, seq int, quad array<struct<x: double, y: double>>").coalesce(1)
        assert review.best_candidate([df, df], ["k"]).select("k", "score", "detector", F.col("quad")[1]["x"]).collect() == [(1, 0.5, 0, 32.0)]


def test_equal_line_items(spark, tmp_path):
    """Two line items of an order with the same number and score: the one that the table lists first, as the SQL's engine has it."""
    item = "k long, l_linenumber int, l_quantity double, l_partkey long, l_suppkey long, l_discount double"
    df = spark.createDataFrame([(k, 4, q, 72, 34, 0.0) for k, q in [(1, 8.0), (1, 46.0), (2, 46.0), (2, 8.0)]], item).withColumnRenamed("k", "l_orderkey")
    df.coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {r["l_orderkey"]: r["left_x"] for r in core.QUERIES["candidate_union_top1"](spark, str(tmp_path)).collect()}
    assert got == {1: 32.0, 2: 184.0}


def test_records_of_whole_rows(spark):
    """Captures whose fields are in one row are neither dealt nor gathered, and give what ``record`` gives of their fields."""
    from idweave.operators.layout import REQUIRED

    some = [(k, *[None if (k + i) % 4 == 0 else "1234567891" if f == "national_id" else f"v{k}" for i, f in enumerate(REQUIRED)]) for k in range(8)]
    flat = spark.createDataFrame(some, "k int, " + ", ".join(f"{f} string" for f in REQUIRED))
    own = review.record_of(flat.select("k", *[F.struct(F.col(f).alias("value"), F.lit(0.5).alias("confidence")).alias(f) for f in REQUIRED]), ["k"])
    fields = flat.select("k", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value"), F.lit(0.5).alias("confidence")) for f in REQUIRED])).alias("e")).select("k", "e.*")
    assert sorted(map(str, own.collect())) == sorted(map(str, review.record(fields, ["k"]).collect()))
    for name in ("missing_fields", "review_flag", "response_json"):
        assert "Exchange" not in core.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_labels_are_sought_once(spark):
    """A line's text is normalised by one translation, and a line that is no label is told by one expression."""
    from idweave.functions.text import normalize_text
    from idweave.operators.recovery import shown_fields

    texts = ["نام", "تاریخ تولد", "نام خانوادگی", "123", "", "اعتبار شماره ملی"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", normalize_text(F.col("t")).alias("n"), shown_fields(F.col("t"), layout.LABEL_PATTERNS).alias("s"))
    assert [r["s"] for r in df.collect()] == [["first_name"], ["birth_date"], ["last_name"], [], [], ["national_id", "expiry_date"]]
    assert df.select("n")._jdf.queryExecution().analyzed().toString().count("translate(") == 1
