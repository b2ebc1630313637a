"""Conflicts of a stream of conflict frames: runs of frames of a pair, closed by an event-time watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings


def stream_islands(frames: DataFrame, settings: Settings | None = None, late_sec: float = 10.0) -> DataFrame:
    """(scene_id, ego, tgt, start_frame, end_frame, t_conflict) of conflict frames (scene_id, ego, tgt, frameNum), each frame once.

    A frame's time is its number over the frames a second. A run ends where a frame is missing; rows that come more than late_sec behind
    the latest one are not counted. Over a table in place of a stream it gives what the plan conflict_islands gives.
    """
    s = settings or Settings()
    step = 1000 / s.fps
    timed = frames.withColumn("ts", F.timestamp_millis((F.col("frameNum") * step).cast("long"))).withWatermark("ts", f"{int(late_sec * 1000)} milliseconds")
    runs = timed.groupBy("scene_id", "ego", "tgt", F.session_window("ts", f"{int(step * 1.5)} milliseconds")).agg(F.min("frameNum").alias("start_frame"), F.max("frameNum").alias("end_frame"), F.count(F.lit(1)).alias("n"))
    return runs.where(F.col("n") >= s.least_frames).select("scene_id", "ego", "tgt", "start_frame", "end_frame", (F.col("start_frame") + F.floor(F.col("n") / 2)).alias("t_conflict"))
