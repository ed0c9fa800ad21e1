"""Rules on small drawn scenarios, and the order-dependent parts against sequential versions."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from roadgrain.operators import kinematics, rules, runs, validation
from roadgrain.operators.zones import Lane, Scene
from roadgrain.sources import plugins

BOX = {0: (46, 150), 2: (170, 130)}
SCENE = Scene(
    1920, 1080, (((0, 290), (1920, 290), (1920, 1000), (0, 1000)),), (((900, 290), (1020, 290), (1020, 1000), (900, 1000)),), (((1300, 290), (1700, 290), (1700, 640), (1300, 640)),), ("q",),
    (Lane("a", ((0, 290), (1920, 290), (1920, 645), (0, 645)), (1.0, 0.0)), Lane("b", ((0, 645), (1920, 645), (1920, 1000), (0, 1000)), (-1.0, 0.0))),
)
COLUMNS = "video_id string, track_id long, frame_idx int, t_sec double, cls int, conf double, x1 double, y1 double, x2 double, y2 double, gx double, gy double, fps double, frame_stride int"


def track(tid, cls, points, video="v", stride=2, conf=0.9):
    w, h = BOX[cls]
    return [(video, tid, f, f / 25, cls, conf, float(x - w / 2), float(y - h), float(x + w / 2), float(y), float(x), float(y), 25.0, stride) for f, x, y in points]


def table(spark, *tracks):
    return spark.createDataFrame([r for t in tracks for r in t], COLUMNS)


def line(start, seconds, x, y, vx=0.0, vy=0.0, stride=2):
    return [(f, x + vx * (f - start) / 25, y + vy * (f - start) / 25) for f in range(start, start + int(seconds * 25), stride)]


def found(df):
    return sorted((r["track_ids"], r["start_frame"], r["end_frame"]) for r in df.collect())


def test_jaywalking(spark):
    walk = line(0, 6, 400, 600, vx=30)
    tracks = table(
        spark, track(1, 0, walk), track(2, 0, line(0, 6, 400, 250, vx=30)), track(3, 0, line(0, 6, 950, 600)), track(4, 0, walk, conf=0.2), track(-1, 0, walk),
        track(6, 0, line(0, 1, 300, 600)), track(7, 0, [p for p in line(0, 6, 500, 700, vx=10) if not 40 <= p[0] <= 60]), track(8, 0, line(0, 6, 1300, 800)), track(9, 2, line(0, 6, 1300, 830)),
    )
    assert [f[0] for f in found(rules.jaywalking(tracks, SCENE))] == [[1], [7]]


def test_wrong_way(spark):
    tracks = table(spark, track(1, 2, line(0, 6, 1500, 400, vx=-200)), track(2, 2, line(0, 6, 200, 400, vx=200)), track(3, 2, line(0, 6, 500, 400)), track(4, 2, line(0, 1, 1500, 400, vx=-200)), track(5, 0, line(0, 6, 1500, 400, vx=-200)))
    moving = kinematics.with_kinematics(tracks)
    assert [f[0] for f in found(rules.wrong_way(moving, SCENE))] == [[1]]
    assert found(rules.wrong_way(moving.withColumn("frame_stride", F.lit(15)), SCENE)) == []


def arrive_stop(start, stop, x, y, gap=()):
    come = [(f, x - 300 + 300 * (f - start) / 50, y) for f in range(start, start + 50, 2)]
    return [p for p in come + line(start + 50, stop, x, y) if not any(a <= p[0] <= b for a, b in gap)]


def test_stopped_vehicle(spark):
    tracks = table(
        spark, track(1, 2, arrive_stop(0, 16, 500, 800)), track(2, 2, arrive_stop(0, 5, 500, 400)), track(3, 2, arrive_stop(0, 16, 1450, 450)), track(4, 2, line(0, 16, 700, 600)),
        track(5, 2, arrive_stop(0, 8, 1500, 900)), track(6, 2, line(250, 8, 1500, 900)),
    )
    got = found(rules.stopped_vehicle(tracks, SCENE))
    assert [f[0] for f in got] == [[1], [5, 6]]
    queue = table(spark, track(1, 2, arrive_stop(0, 16, 500, 800)), track(2, 2, arrive_stop(0, 16, 640, 800)))
    assert found(rules.stopped_vehicle(queue, SCENE)) == []


def test_stop_sessions_are_exact(spark):
    rng = random.Random(8)
    th = rules.Stopped()
    rows = sorted((f, rng.uniform(0, 300), rng.uniform(0, 100), 100.0, rng.randint(1, 5)) for f in (rng.choice([0, 2000, 4000]) + 2 * rng.randint(0, 200) for _ in range(400)))
    column = lambda part, k: np.array([r[k] for r in part])
    session = lambda part: {n: column(part, k) for k, n in enumerate(("frame_idx", "gx", "gy", "size", "track_id"))}
    key = lambda c: (c["first"], c["last"], c["n"], round(c["x"], 6), tuple(sorted(c["ids"])))
    whole = sorted(map(key, rules.cluster_stops(session(rows), 52, th)))
    parts = [[rows[0]]]
    for a, b in zip(rows, rows[1:]):
        if b[0] - a[0] > 52:
            parts.append([])
        parts[-1].append(b)
    assert len(parts) > 2 and sorted(key(c) for p in parts for c in rules.cluster_stops(session(p), 52, th)) == whole


def test_congestion(spark):
    crawl = [track(i, 2, line(0, 40, 200 + 200 * i, 400, vx=2)) for i in range(1, 6)]
    free = [track(20 + i, 2, line(0, 40, 100 + 150 * i, 800, vx=-150)) for i in range(5)]
    got = rules.to_segments(rules.congestion(table(spark, *crawl, *free), SCENE)).collect()
    assert len(got) == 1 and got[0]["end"] - got[0]["start"] > 35
    assert rules.to_segments(rules.congestion(table(spark, *crawl[:3], *free), SCENE)).count() == 0


def test_runs_bridge_gaps_and_count_the_last_sample(spark):
    rows = [("v", f, 25.0, 2) for f in [0, 2, 4, 30, 32, 100, 102]]
    df = spark.createDataFrame(rows, "video_id string, frame_idx int, fps double, frame_stride int")
    got = [(r["start_frame"], r["end_frame"]) for r in runs.flag_runs(df, ["video_id"], F.lit(True), 0.1, 1.0).orderBy("start_frame").collect()]
    assert got == [(0, 32), (100, 102)]
    assert runs.flag_runs(df, ["video_id"], F.lit(True), 0.17, 1.0).count() == 1


def test_sustained_speed_against_interpolation(spark):
    rng = random.Random(4)
    rows = []
    for tid in (1, 2, 3, -1):
        t, pts = 0.0, []
        for k in range(60 if tid != 3 else 1):
            t += rng.choice([0.1, 0.2, 0.7])
            pts.append((round(t, 3), rng.uniform(0, 500), rng.uniform(0, 500)))
        rows += [("v", tid, k, *p) for k, p in enumerate(pts)]
    df = spark.createDataFrame(rows, "video_id string, track_id long, frame_idx int, t_sec double, gx double, gy double")
    for r in kinematics.with_sustained_speed(df).collect():
        mine = [x for x in rows if x[1] == r["track_id"]]
        t = np.array([x[3] for x in mine])
        if r["track_id"] < 0 or len(t) < 2:
            assert r["sustained_speed"] == math.inf
            continue
        a, b = max(t[0], r["t_sec"] - 1), min(t[-1], r["t_sec"] + 1)
        move = [np.interp(b, t, [x[k] for x in mine]) - np.interp(a, t, [x[k] for x in mine]) for k in (4, 5)]
        assert abs(r["sustained_speed"] - math.hypot(*move) / (b - a)) < 1e-6 * max(1, r["sustained_speed"])


def test_a_broken_rule_is_skipped(spark):
    @rules.rule("broken")
    def broken(tracks, scene, th=None):
        return tracks.select("no_such_column")

    try:
        skipped = []
        got = rules.run_rules(kinematics.with_kinematics(table(spark, track(1, 0, line(0, 6, 400, 600, vx=30)))), SCENE, skipped=skipped)
        assert skipped == ["broken"] and [r["label"] for r in got.collect()] == ["jaywalking"]
    finally:
        del rules.RULES["broken"]


def test_bridged_keeps_the_rows_between_a_runs_flagged_ones(spark):
    rows = spark.createDataFrame([("v", i * 15, i in (2, 4, 20, 21), 30.0, 15, 10 * i) for i in range(24)], "video_id string, frame_idx int, f boolean, fps double, frame_stride int, total int")
    kept = runs.bridged(rows, ["video_id"], F.col("f"), 3.0)
    assert sorted(r.frame_idx // 15 for r in kept.collect()) == [2, 3, 4, 20, 21]
    found = runs.flag_runs(kept, ["video_id"], F.lit(True), 0.5, 3.0, [F.max("total").alias("peak")]).collect()
    assert sorted((r.start_frame, r.end_frame, r.peak) for r in found) == [(30, 60, 40), (300, 315, 210)]
    assert runs.bridged(rows.where("false"), ["video_id"], F.col("f"), 3.0).count() == 0


def test_sources_and_labels(spark):
    @plugins.event_source("wrong_way")
    def source(session, path):
        return session.createDataFrame([(path, 1.0, 2.0)], "video_id string, start double, end double")

    try:
        assert [(r.source, r.video_id, r.label, r.score) for r in plugins.detected(spark, "p", ["wrong_way"]).collect()] == [("wrong_way", "p", "wrong_way", 1.0)]
    finally:
        del plugins.EVENT_SOURCES["wrong_way"]
    assert plugins.detected(spark, "p", []).count() == 0
    labels = spark.createDataFrame([("parking",), (None,), ("congestion",), ("congestion",)], "label string")
    assert {(r.label, r.events, r.kept, r.problem is None) for r in validation.class_check(labels).collect()} == {("parking", 1, False, False), (None, 1, False, False), ("congestion", 2, True, True)}
    assert validation.official(labels).count() == 2


def test_rescaled_boxes(spark):
    rows = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0, None), (0.0, 0.0, 8.0, 8.0, 5)], "x1 double, y1 double, x2 double, y2 double, track_id long")
    assert [tuple(r) for r in kinematics.rescaled(rows, (100, 200), (50, 400)).collect()] == [(0.5, 4.0, 1.5, 8.0, -1), (0.0, 0.0, 4.0, 16.0, 5)]
