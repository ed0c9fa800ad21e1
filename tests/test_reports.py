"""The composed reports: what went wrong in each video, and what a reviewer should look at."""

from pyspark.sql import functions as F

from roadgrain.operators import evaluation, intervals, kinematics, review, rules
from tests.test_rules import SCENE, arrive_stop, line, table, track

SEGMENTS = "video_id string, label string, start double, end double"


def test_error_analysis(spark):
    gt = spark.createDataFrame([("v", "jaywalking", 0.0, 10.0), ("v", "jaywalking", 20.0, 30.0), ("v", "congestion", 200.0, 400.0), ("w", "wrong_way", 5.0, 9.0)], SEGMENTS)
    pred = spark.createDataFrame([("v", "jaywalking", 1.0, 10.0), ("v", "jaywalking", 27.0, 40.0), ("v", "stopped_vehicle", 210.0, 400.0), ("x", "jaywalking", 0.0, 1.0)], SEGMENTS)
    videos = spark.createDataFrame([("v",), ("w",)], "video_id string")
    got = {(r["video_id"], r["label"]): r for r in evaluation.error_analysis(gt, pred, videos).collect()}
    assert {k: (r["tp"], r["fp"], r["fn"]) for k, r in got.items()} == {("v", "jaywalking"): (1, 1, 1), ("v", "congestion"): (0, 0, 1), ("v", "stopped_vehicle"): (0, 1, 0), ("w", "wrong_way"): (0, 0, 1)}
    j = got["v", "jaywalking"]
    assert [tuple(m) for m in j["matched"]] == [(0.0, 10.0, 0.9, 1.0, 10.0)]
    assert [tuple(m) for m in j["missed"]] == [(20.0, 30.0, 3 / 20)] and [tuple(m) for m in j["false"]] == [(27.0, 40.0, 3 / 20)]
    assert [tuple(c) for c in got["v", "congestion"]["confused"]] == [(200.0, 400.0, "stopped_vehicle", 210.0, 400.0, 0.95)] and got["w", "wrong_way"]["confused"] == []


def test_overlapping_pairs_come_once(spark):
    a = spark.createDataFrame([("k", 0.0, 500.0), ("k", 59.0, 61.0), ("k", 60.0, 60.0), ("k", None, 3.0)], "v string, gs double, ge double")
    b = spark.createDataFrame([("k", 30.0, 300.0), ("k", 500.0, 501.0), ("k", 61.0, 70.0), ("l", 0.0, 9.0)], "v string, ps double, pe double")
    got = sorted((r["gs"], r["ps"]) for r in intervals.overlapping(a, b, ["v"]).collect())
    assert got == [(0.0, 30.0), (0.0, 61.0), (59.0, 30.0), (60.0, 30.0)]


def test_review_report(spark):
    tracks = table(
        spark, track(1, 0, line(0, 6, 400, 600, vx=30)), track(2, 0, line(400, 2, 400, 600, vx=30), conf=0.4), track(3, 0, line(600, 2, 400, 600, vx=30), conf=0.4),
        track(4, 2, arrive_stop(0, 16, 500, 800)), track(5, 2, arrive_stop(600, 7, 1500, 900)),
    )
    tracks = kinematics.with_kinematics(tracks)
    durations = spark.createDataFrame([("v", 60.0)], "video_id string, duration double")
    seed = spark.createDataFrame([("v", "jaywalking", 15.0, 17.0), ("v", "wrong_way", 1.0, 2.0)], SEGMENTS)
    kept = []

    def keep(df, name):
        kept.append(name)
        return df

    out = review.review_report(tracks, SCENE, durations, seed, ["jaywalking", "stopped_vehicle", "wrong_way", "congestion"], True, keep)
    got = {(r["label"], round(r["start"], 2)): (r["sources"], r["track_ids"]) for r in out.collect()}
    assert kept == ["review-raw", "review-shipped", "review-probes"]
    assert got["jaywalking", 0.0] == (["predicted"], [1])
    assert got["jaywalking", 15.0] == (["seed"], []), "a probe that overlaps what is known is none"
    assert got["jaywalking", 24.0] == (["recall probe"], [3])
    # the car that comes to its stop drives against its lane for two seconds: the seed lies in that window
    assert [(k[1], ids) for k, (src, ids) in got.items() if k[0] == "wrong_way" and "seed" in src] == [(0.0, [4])]
    stops = {k: v for k, v in got.items() if k[0] == "stopped_vehicle"}
    assert any("predicted" in s and "scan: stationary" in s and ids == [4] for s, ids in stops.values())
    assert any("recall probe" in s and ids == [5] for s, ids in stops.values())
    shipped = intervals.finalise(rules.run_rules(tracks, SCENE).join(durations, "video_id")).where(F.col("label") == "jaywalking").count()
    assert shipped == 1
