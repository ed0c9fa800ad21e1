"""Windowed aggregates of event-time rows; the same functions serve streams and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tumbling_tracks(tracks: DataFrame, seconds: int = 5, late: str = "2 seconds") -> DataFrame:
    """(video_id, bin_start, tracks): about how many tracks each window of ts has."""
    rows = tracks.withWatermark("ts", late).where("track_id >= 0")
    out = rows.groupBy("video_id", F.window("ts", f"{seconds} seconds")).agg(F.approx_count_distinct("track_id").alias("tracks"))
    return out.select("video_id", F.col("window.start").alias("bin_start"), "tracks")


def sliding_congestion(rows: DataFrame, window: str = "5 seconds", slide: str = "500 milliseconds", late: str = "2 seconds") -> DataFrame:
    """(video_id, direction, window_start, vehicles, slow): sums over sliding windows of rows(ts,
    slow boolean). A window is known when it has passed, half its length after its middle."""
    marked = rows.withWatermark("ts", late)
    out = marked.groupBy("video_id", "direction", F.window("ts", window, slide)).agg(F.count("*").alias("vehicles"), F.count_if("slow").alias("slow"))
    return out.select("video_id", "direction", F.col("window.start").alias("window_start"), "vehicles", "slow")


def session_runs(rows: DataFrame, keys: list[str], gap: str | Column, late: str = "2 seconds") -> DataFrame:
    """(keys, start, end, samples) of flagged rows(ts) no more than a gap apart; the gap may be
    a column. end is the last sample plus the gap."""
    out = rows.withWatermark("ts", late).groupBy(*keys, F.session_window("ts", gap)).agg(F.count("*").alias("samples"))
    return out.select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "samples")
