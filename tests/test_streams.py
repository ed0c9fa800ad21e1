"""Streams against their batch forms, and causality."""

import math

import pytest
from pyspark.sql import functions as F

from roadgrain.operators import risk
from roadgrain.streaming import stateful, windows


def scenario():
    rows, ticks = [], []
    for f in range(0, 240):
        t = f / 30
        ticks.append(("v", f, t))
        if f % 6 == 0:
            a, b = 100 + 300 * t, 1900 - 300 * t
            rows += [("v", f, t, 1, 2, a, 500.0, 100.0), ("v", f, t, 2, 2, b, 500.0, 100.0), ("v", f, t, 3, 0, 900 + 3 * math.sin(t), 505.0, 120.0)]
    return rows, ticks


@pytest.fixture
def data(spark):
    rows, ticks = scenario()
    tracks = spark.createDataFrame([(*r[:4], r[4], r[5], r[6], r[6] - r[7], r[6]) for r in rows], "video_id string, frame_idx long, t_sec double, track_id long, cls int, gx double, gy double, y1 double, y2 double")
    return tracks, spark.createDataFrame(ticks, "video_id string, frame_idx long, t_sec double")


def streamed(spark, frames, build, tmp_path, name):
    folder = str(tmp_path / name)
    for k in range(4):  # four files, four batches
        frames.where(f"frame_idx >= {k * 60} and frame_idx < {k * 60 + 60}").coalesce(1).write.mode("append").parquet(folder)
    source = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    q = build(source).writeStream.format("memory").queryName(name).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


def test_risk_stream_equals_the_batch(spark, data, tmp_path):
    tracks, ticks = data
    want = {r["frame_idx"]: r["score"] for r in risk.risk_curve(ticks, tracks).collect()}
    assert max(want.values()) > 0.2 and want[0] == 0
    got = {r["frame_idx"]: r["score"] for r in streamed(spark, stateful.frames_of(tracks, ticks), stateful.risk_stream, tmp_path, "risk_all")}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    early = {r["frame_idx"]: r["score"] for r in risk.risk_curve(ticks.where("frame_idx < 150"), tracks.where("frame_idx < 150")).collect()}
    assert all(early[k] == want[k] for k in early)


def test_a_failing_estimator_holds_its_score(spark, data, tmp_path):
    class Flaky(stateful.Estimator):
        state_schema = "n long"

        def reset(self):
            return {"n": 0}

        def step(self, state, frame_idx, t_sec, boxes):
            state["n"] += 1
            return 0.5 if state["n"] == 1 else 1 / 0

    tracks, ticks = data
    got = streamed(spark, stateful.frames_of(tracks, ticks), lambda s: stateful.risk_stream(s, Flaky()), tmp_path, "risk_flaky")
    assert len(got) == 240 and {r["score"] for r in got} == {0.5} and max(r["failures"] for r in got) == 239


def test_windows(spark):
    rows = [("v", "a", 1, 0, True), ("v", "a", 1, 2, False), ("v", "a", 2, 7, True), ("v", "a", 3, 30, True)]
    df = spark.createDataFrame(rows, "video_id string, direction string, track_id long, s int, slow boolean").withColumn("ts", F.timestamp_seconds("s"))
    assert sorted(r["tracks"] for r in windows.tumbling_tracks(df).collect()) == [1, 1, 1]
    assert {(r["vehicles"], r["slow"]) for r in windows.sliding_congestion(df, "10 seconds", "10 seconds").collect()} == {(3, 2), (1, 1)}
    assert sorted(r["samples"] for r in windows.session_runs(df, ["video_id"], "6 seconds").collect()) == [1, 3]
