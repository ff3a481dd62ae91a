"""Streams with late, repeated and unanswered frames, restarts from checkpoints, and the source of chunks."""

import datetime as dt

from pyspark.sql import functions as F

from idweave.sources.chunks import ChunkSource
from idweave.streaming import cameras, frames

DAY = dt.datetime(2024, 5, 1, 12)


def at(seconds):
    return DAY + dt.timedelta(seconds=seconds)


class Landing:
    """A folder of Parquet files that a stream reads one at a time."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema, self.n = spark, str(path), schema, 0
        spark.createDataFrame([], schema).write.parquet(self.path)

    def land(self, rows):
        self.n += 1
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.path)

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(self.path)


def drain(stream, tmp_path, name, mode="append"):
    """Runs the stream over what has landed, then again from its checkpoint with what lands later."""
    frames.drained(stream, str(tmp_path / f"{name}_out"), str(tmp_path / f"{name}_state"))
    return stream.sparkSession.read.schema(stream.schema).parquet(str(tmp_path / f"{name}_out"))


def test_windows_drop_late_rows_and_go_on(spark, tmp_path):
    land = Landing(spark, tmp_path / "events", "ts timestamp, event_type string")
    land.land([(at(0), "a"), (at(60), "b"), (at(4500), "a")])
    drain(frames.counts_by_window(land.stream()), tmp_path, "w")
    land.land([(at(30), "a"), (at(4600), "a"), (at(8000), "b")])  # the first is too late: its hour ended before the watermark
    drain(frames.counts_by_window(land.stream()), tmp_path, "w")
    land.land([(at(20000), "z")])
    drain(frames.counts_by_window(land.stream()), tmp_path, "w")
    drain(frames.counts_by_window(land.stream()), tmp_path, "w")
    got = {(r["start"], r["event_type"], r["n"]) for r in drain(frames.counts_by_window(land.stream()), tmp_path, "w").collect()}
    kept = spark.read.parquet(land.path).where(F.col("ts") != at(30))
    whole = {(r["start"], r["event_type"], r["n"]) for r in frames.counts_by_window(kept).collect() if r["event_type"] != "z"}
    assert got == whole


def test_repeated_frames_once(spark, tmp_path):
    land = Landing(spark, tmp_path / "frames", "camera string, frame_id long, ts timestamp")
    land.land([("c", 1, at(0)), ("c", 1, at(1)), ("c", 2, at(2))])
    drain(cameras.once(land.stream()), tmp_path, "o")
    land.land([("c", 2, at(5)), ("d", 1, at(5)), ("c", 3, at(6))])  # after a restart
    got = sorted((r["camera"], r["frame_id"]) for r in drain(cameras.once(land.stream()), tmp_path, "o").collect())
    assert got == [("c", 1), ("c", 2), ("c", 3), ("d", 1)]


def test_one_frame_in_flight(spark, tmp_path):
    land = Landing(spark, tmp_path / "events", "camera string, frame_id long, ts timestamp, event string")
    land.land([("a", 1, at(0), "frame"), ("a", 2, at(1), "frame"), ("b", 7, at(1), "frame"), (None, 1, at(1), "frame"), ("a", 9, at(2), "other")])
    drain(cameras.one_in_flight(land.stream()), tmp_path, "f")
    land.land([("a", 1, at(3), "answer"), ("a", 3, at(3), "frame"), ("a", 5, at(4), "answer")])  # after a restart: the state is there
    drain(cameras.one_in_flight(land.stream()), tmp_path, "f")
    land.land([("z", 1, at(100), "frame")])  # the watermark passes b's and a's waits
    drain(cameras.one_in_flight(land.stream()), tmp_path, "f")
    land.land([("b", 8, at(120), "frame")])
    out = drain(cameras.one_in_flight(land.stream()), tmp_path, "f")
    got = {c: [(r["frame_id"], r["decision"]) for r in sorted(out.where(F.col("camera") == c).collect(), key=lambda r: (r["ts"], r["decision"] != "answered"))] for c in "ab"}
    assert got["a"] == [(1, "sent"), (2, "skipped"), (1, "answered"), (3, "sent"), (5, "unasked"), (3, "timed_out")]
    assert got["b"] == [(7, "sent"), (7, "timed_out"), (8, "sent")]
    assert out.where("camera = 'b' and decision = 'timed_out'").first()["ts"] == at(31)


def test_frames_beside_readings(spark, tmp_path):
    shots = Landing(spark, tmp_path / "frames", "camera string, frame_id long, ts timestamp")
    reads = Landing(spark, tmp_path / "reads", "camera string, frame_id long, read_at timestamp, raw string")
    shots.land([("a", 1, at(0)), ("a", 2, at(5))])
    reads.land([("a", 1, at(4), "x"), ("a", 2, at(60), "late")])
    drain(cameras.answered(shots.stream(), reads.stream()), tmp_path, "j")
    shots.land([("a", 3, at(200))])
    reads.land([("a", 3, at(201), "y")])
    drain(cameras.answered(shots.stream(), reads.stream()), tmp_path, "j")
    shots.land([("a", 4, at(400))])
    reads.land([("a", 9, at(400), "z")])
    drain(cameras.answered(shots.stream(), reads.stream()), tmp_path, "j")
    out = drain(cameras.answered(shots.stream(), reads.stream()), tmp_path, "j")
    assert sorted((r["frame_id"], r["raw"]) for r in out.collect() if r["frame_id"] < 4) == [(1, "x"), (2, None), (3, "y")]


def test_chunks_once_each(spark, tmp_path):
    spark.dataSource.register(ChunkSource)
    land = tmp_path / "land"
    land.mkdir()
    (land / "one.bin").write_bytes(bytes(range(250)))
    (land / "two.part").write_bytes(b"a" * 150)
    stream = lambda: spark.readStream.format("chunks").option("path", str(land)).option("chunk", 100).option("chunks", 2).load()
    out = drain(stream(), tmp_path, "c")
    assert sorted((r["file"][-3:], r["chunk_no"], len(r["data"])) for r in out.collect()) == [("art", 0, 100), ("bin", 0, 100), ("bin", 1, 100), ("bin", 2, 50)]
    (land / "two.part").write_bytes(b"a" * 150 + b"b" * 260)  # it grew
    (land / "three.bin").write_bytes(b"c")
    out = drain(stream(), tmp_path, "c").collect()  # a second run, from the checkpoint
    names = [(r["file"], r["chunk_no"]) for r in out]
    assert len(names) == len(set(names)) == 8
    two = sorted((r["chunk_no"], bytes(r["data"])) for r in out if r["file"].endswith("part"))
    assert b"".join(d for _, d in two) == b"a" * 150 + b"b" * 250
    whole = spark.read.format("chunks").option("path", str(land)).option("chunk", 100).load()
    assert whole.count() == 8 and whole.where("file like '%one.bin'").selectExpr("max(position)").first()[0] == 200
    (tmp_path / "none").mkdir()
    assert spark.read.format("chunks").option("path", str(tmp_path / "none")).load().count() == 0
