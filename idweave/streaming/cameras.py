"""Camera frames as streams: one frame in flight a camera, each frame once, frames beside the readings that answer them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

WAIT_MS = 30_000
DECISION = "camera string, frame_id long, ts timestamp, decision string"
IN_FLIGHT = "frame_id long, since_ms long"


def once(frames: DataFrame, late: str = "10 minutes") -> DataFrame:
    """frames (camera, frame_id, ts) without those that were there before: a repeated frame within ``late`` of the first is dropped."""
    return frames.withWatermark("ts", late).dropDuplicatesWithinWatermark(["camera", "frame_id"])


def turns(wait_ms: int = WAIT_MS):
    """A camera's events in order of time against its frame in flight, which is the state."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        flying = state.get if state.exists else None
        out: list[tuple[int, int, str]] = []
        if state.hasTimedOut:
            out.append((flying[0], flying[1] + wait_ms, "timed_out"))
            flying = None
        else:
            events = pd.concat(list(batches), ignore_index=True)
            ms = events["ts"].astype("datetime64[ms]").astype("int64")
            order = sorted(zip(ms, events["event"] != "answer", events["frame_id"], events["event"]))  # of one time answers come first
            for at, _, frame, event in ((int(a), b, int(f), e) for a, b, f, e in order):
                if flying and at >= flying[1] + wait_ms:
                    out.append((flying[0], flying[1] + wait_ms, "timed_out"))
                    flying = None
                if event == "frame":
                    out.append((frame, at, "skipped" if flying else "sent"))
                    flying = flying or (frame, at)
                elif flying and frame == flying[0]:
                    out.append((frame, at, "answered"))
                    flying = None
                else:
                    out.append((frame, at, "unasked"))
        if flying:
            state.update(flying)
            state.setTimeoutTimestamp(max(flying[1] + wait_ms, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if out:
            frame, at, decision = zip(*out)
            yield pd.DataFrame({"camera": key[0], "frame_id": frame, "ts": pd.to_datetime(pd.Series(at), unit="ms"), "decision": decision})

    return run


def one_in_flight(events: DataFrame, wait_ms: int = WAIT_MS, late: str = "10 seconds") -> DataFrame:
    """camera, frame_id, ts, decision for events (camera, frame_id, ts, event: frame or answer) of a stream.

    A camera has one frame in flight: the first is ``sent``, further ones are ``skipped`` until it is ``answered``, or until
    ``wait_ms`` of event time have gone by without an answer, when it is ``timed_out`` as of that moment. An answer to any other
    frame is ``unasked``. Rows without a camera, frame or time, and other events, are left out. A camera's state is one frame.
    """
    sound = events.where("camera is not null and frame_id is not null and ts is not null and event in ('frame', 'answer')").select("camera", F.col("frame_id").cast("long").alias("frame_id"), "ts", "event")
    return sound.withWatermark("ts", late).groupBy("camera").applyInPandasWithState(turns(wait_ms), DECISION, IN_FLIGHT, "append", GroupStateTimeout.EventTimeTimeout)


def answered(frames: DataFrame, readings: DataFrame, within: str = "30 seconds", late: str = "10 seconds") -> DataFrame:
    """frames (camera, frame_id, ts) with the readings (camera, frame_id, read_at, raw) that came ``within`` that time of them.

    A frame without one has a null raw, once the watermark says that none can come any more; so state is kept for no longer.
    """
    frames = frames.withWatermark("ts", late)
    reads = readings.select(F.col("camera").alias("r_camera"), F.col("frame_id").alias("r_frame"), "read_at", "raw").withWatermark("read_at", late)
    near = (F.col("camera") == F.col("r_camera")) & (F.col("frame_id") == F.col("r_frame")) & (F.col("read_at") >= F.col("ts")) & (F.col("read_at") <= F.col("ts") + F.expr(f"interval {within}"))
    return frames.join(reads, near, "left_outer").drop("r_camera", "r_frame")
