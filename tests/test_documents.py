import json

import pytest
from pyspark.sql import functions as F

from roadgrain.operators import eda, poses, review, sampling, signals, validation, zones
from roadgrain.sources import documents, tables

GOOD = {"team": "t", "videos": {"a.mp4": {"events": [[0.5, 2, "jaywalking"], [3, 4.5, "congestion"]], "risk": [[0, 0.1], [0.5, 0.2]], "log": ["ok"]}}}


def docs(spark, *bodies):
    return spark.createDataFrame([(f"p{i}", b if isinstance(b, str) else json.dumps(b)) for i, b in enumerate(bodies)], "path string, doc string")


def problems(df):
    return sorted((r["video_id"], r["problem"]) for r in df.collect())


def test_predictions_and_their_problems(spark):
    bad = {"videos": {"x/y.mp4": {"events": [[2, 1, "jaywalking"], [0, 5, "wrong_way"], [4, 6, "wrong_way"], [True, 2, "jaywalking"], [0, 1, "parking"], [1, 99, "congestion"]], "risk": [[0, 0.1], [2, 0.2], [1, 3]]}}}
    entries = documents.predictions(docs(spark, GOOD, bad))
    events, risk = documents.events(entries), documents.risk(entries)
    assert events.where("video_id = 'a.mp4'").count() == 2 and risk.count() == 5
    truth = spark.createDataFrame([("a.mp4", 10.0), ("x/y.mp4", 10.0), ("gone.mp4", 5.0)], "video_id string, duration double")
    got = {(r["video_id"], r["severity"], r["problem"]) for r in validation.prediction_problems(entries, events, risk, truth).collect()}
    assert got == {
        ("x/y.mp4", "error", "start must be 0 or more and before end"), ("x/y.mp4", "error", "overlaps the one before"), ("x/y.mp4", "error", "times must be numbers"), ("x/y.mp4", "error", "unknown label"),
        ("x/y.mp4", "error", "ends after the video"), ("x/y.mp4", "error", "time goes back"), ("x/y.mp4", "error", "a video is named by its file, without folders"), ("gone.mp4", "error", "missing from predictions"), ("x/y.mp4", "warning", "missing team"),
    }
    assert validation.harness_problems(entries).select("problem").collect() == [("no log",)]
    assert documents.sanitised(entries).schema["entry"].dataType.names == ["events", "risk"]


def test_strict_json(spark):
    bad = docs(spark, '{"videos": {}, "videos": {}}', '{"videos": {"a": {}}, "team": NaN}', '{"videos": {"__proto__": {}}}', {"videos": {}, "extra": 1}, {"videos": {"a": {}, "b": {}}}, {"videos": {"a": {}}})
    got = {r["path"]: r["problem"] for r in validation.document_problems(bad, one_video=True).collect()}
    assert got == {"p0": "not strict JSON", "p1": "not strict JSON", "p2": "unsafe key", "p3": "unknown field", "p4": "need exactly one video"}


def test_documents_round_trip(spark, tmp_path):
    seg = spark.createDataFrame([("v", "jaywalking", 0.5, 2.0), ("v", "congestion", 0.25, 9.0)], "video_id string, label string, start double, end double")
    curve = spark.createDataFrame([("v", 0.0, 0.5)], "video_id string, t_sec double, score double")
    videos = spark.createDataFrame([("v",), ("w",)], "video_id string")
    made = documents.prediction_documents(seg, curve, videos, "team")
    documents.write_documents(made, str(tmp_path / "out"))
    back = documents.predictions(documents.read_documents(spark, str(tmp_path / "out" / "*")))
    assert {r["video_id"]: (len(r["entry"]["events"]), len(r["entry"]["risk"])) for r in back.collect()} == {"v": (2, 1), "w": (0, 0)}


def scene_document():
    sq = lambda x, y, s=100: [[x, y], [x + s, y], [x + s, y + s], [x, y + s]]
    return {
        "_comment": "x", "schema_version": 1, "authored_against": {"image_width": 1000, "image_height": 500, "source_video": "v", "source_frame_idx": 0},
        "carriageway": [{"id": "road", "polygon": sq(0, 0, 400)}],
        "lanes": [{"id": "l1", "polygon": sq(0, 0), "direction_from": [0, 0], "direction_to": [30, 40], "permitted_manoeuvres": ["straight"], "governed_by_stop_line": "s1", "direction_group": None}],
        "stop_lines": [{"id": "s1", "segment": [[0, 0], [10, 0]], "approach_side": 1, "governs_lanes": ["l1"]}], "crossings": [{"id": "c1", "polygon": sq(200, 0), "lanes": ["l1"]}],
        "signal_queue_zones": [], "traffic_lights": [{"id": "t1", "roi": [0, 0, 5, 5], "controls_lanes": ["l1"]}], "lane_markings": [{"id": "m1", "segment": [[0, 0], [9, 0]], "style": "solid", "separates": ["l1"]}],
    }


def test_scenes(spark):
    good, bad = scene_document(), scene_document()
    bad["lanes"][0].update(direction_to=[0, 0], governed_by_stop_line="nope", permitted_manoeuvres=["fly"])
    bad["carriageway"][0]["polygon"] = [[0, 0], [1, 1]]
    bad["traffic_lights"][0].update(roi=[5, 5, 1, 1], controls_lanes=["l9"])
    bad["crossings"][0]["id"] = "l1"
    bad["lane_markings"][0]["style"] = "wavy"
    parsed = documents.scenes(spark.createDataFrame([("good", json.dumps(good)), ("bad", json.dumps(bad))], "camera_id string, doc string"))
    got = sorted((r["camera_id"], r["problem"]) for r in validation.scene_problems(parsed).collect())
    assert [p for c, p in got if c == "good"] == []
    assert {p for _, p in got} == {"no direction", "unknown stop line", "unknown manoeuvre", "needs three vertices", "bad region", "unknown lane", "id missing or not unique", "unknown style"}
    assert {r["camera_id"]: r["authored"] for r in validation.is_authored(parsed).collect()} == {"good": True, "bad": False}
    sizes = spark.createDataFrame([("good", 2000, 500)], "camera_id string, width int, height int")
    zone = documents.scene_zones(parsed.where("camera_id = 'good'"), sizes).first()
    assert zone["carriageway"][0][2]["x"] == 800 and zone["carriageway"][0][2]["y"] == 400
    assert abs(zone["lanes"][0]["dx"] - 60 / (60**2 + 40**2) ** 0.5) < 1e-9
    sc = zones.Scene(1000, 500, (((0, 0), (1000, 0), (1000, 300), (0, 300)),))
    assert sc.border_edges()["carriageway"][0] == (True, True, False, True) and sc.rescaled(2000, 500).carriageway[0][1] == (2000, 0)


def test_tracks_table_prunes(spark, tmp_path):
    df = spark.range(20).selectExpr("concat('c', id % 2) as camera_id", "'k' as config_key", "'v' as video_id", "id as track_id", "cast(id as int) as frame_idx")
    tables.write_tracks(df, str(tmp_path / "t"))
    read = tables.read_tracks(spark, str(tmp_path / "t"), camera_id="c1")
    assert read.count() == 10 and "PartitionFilters: [isnotnull(camera_id" in read._jdf.queryExecution().toString()
    keys = spark.range(1).select(tables.content_key(F.lit(5), F.lit(b"a"), F.lit(b"b")).alias("a"), tables.config_key({"b": F.lit(1), "a": F.lit("x")}).alias("b"), tables.config_key({"a": F.lit("x"), "b": F.lit(1)}).alias("c")).first()
    assert len(keys["a"]) == 24 and len(keys["b"]) == 16 and keys["b"] == keys["c"]


def test_signals(spark):
    px = [("v", 0, "l", 5, 200, 200)] * 30 + [("v", 0, "l", 60, 200, 200)] * 5 + [("v", 1, "l", 60, 200, 200)] * 5 + [("v", 2, "l", 5, 200, 200)] * 10 + [("v", 2, "l", 60, 200, 200)] * 10 + [("v", 3, "l", 130, 200, 200)] * 20
    got = {r["frame_idx"]: r for r in signals.signal_votes(spark.createDataFrame(px, "video_id string, frame_idx int, light_id string, h int, s int, v int")).collect()}
    assert [(got[k]["state"], got[k]["reason"]) for k in range(4)] == [("red", "ok"), ("unknown", "few lit pixels"), ("unknown", "close runner-up"), ("unknown", "no known hue")]
    states = [("v", ["a", "b"], "red", 0.9), ("v", ["b"], "green", 0.8), ("v", ["c"], "unknown", 0.0)]
    lanes = {r["lane"]: r["state"] for r in signals.lane_signals(spark.createDataFrame(states, "video_id string, controls_lanes array<string>, state string, confidence double")).collect()}
    assert lanes == {"a": "red", "b": "unknown", "c": "unknown"}


def test_poses(spark):
    m = lambda v, t, a=0.0, tx=5.0, inl=80: (v, t, 1.0, tx, a, 1.0, inl, 100)
    rows = [m("ok", 0.0), m("ok", 1.0, tx=6.0), m("ok", 2.0, tx=7.0), m("weak", 0.0, inl=5), m("turned", 0.0, a=0.2), m("split", 0.0, tx=0.0), m("split", 1.0, tx=40.0)]
    got = {r["video_id"]: r["pose"] for r in poses.estimate_poses(spark.createDataFrame(rows, "video_id string, t_sec double, m00 double, m02 double, m10 double, m12 double, inliers int, matches int")).collect()}
    assert {k: v["reason"] for k, v in got.items()} == {"ok": "aligned", "weak": "weak match", "turned": "implausible rotation", "split": "frames disagree"}
    assert got["ok"]["tx"] == 6 and got["weak"]["scale"] == 1


def test_sampling_and_review(spark):
    frames = spark.createDataFrame([("v", f) for f in [0, 3, 5, 9, 10, 11, 20]], "video_id string, frame_idx int")
    assert [r["frame_idx"] for r in sampling.min_step(frames, 5).orderBy("frame_idx").collect()] == [0, 5, 10, 20]
    curve = spark.createDataFrame([("v", float(t), float(t % 7) / 10 + (t == 33)) for t in range(100)], "video_id string, t_sec double, score double")
    small = sampling.min_max_decimated(curve, 20)
    assert small.where("t_sec = 33").count() == 1 and small.count() <= 20 and sampling.min_max_decimated(curve, 100).count() == 100
    windows = spark.createDataFrame([("v", float(i), float(i) + 1, "wrong_way", "direction", [i], float(i)) for i in range(9)], review._WINDOW)
    assert sorted(r["rank"] for r in review.capped(windows).collect()) == [5.0, 6.0, 7.0, 8.0]
    names = spark.createDataFrame([("a.mp4",), ("../a.mp4",), ("a.exe",), ("a\tb.mov",), ("ok name.MOV",)], "name string")
    assert sorted(r["name"] for r in validation.filename_problems(names).collect()) == ["../a.mp4", "a\tb.mov", "a.exe"]
    tie = eda.longest_per_group(windows.withColumn("len", F.col("end") - F.col("start")), ["label"], "len", 2)
    assert sorted(r["start"] for r in tie.collect()) == [0.0, 1.0]


def test_documents_are_escaped(spark):
    seg = spark.createDataFrame([('v"1\\', 'jay"walking\n', 0.5, 2.0), ('v"1\\', "null", None, 3.0)], "video_id string, label string, start double, end double")
    curve = spark.createDataFrame([('v"1\\', 0.0, 0.5), ('v"1\\', 1.0, float("nan"))], "video_id string, t_sec double, score double")
    videos = spark.createDataFrame([('v"1\\',)], "video_id string")
    doc = json.loads(documents.prediction_documents(seg, curve, videos, 'the "team"').first()["doc"])
    assert doc == {"team": 'the "team"', "videos": {'v"1\\': {"events": [[None, 3.0, "null"], [0.5, 2.0, 'jay"walking\n']], "risk": [[0.0, 0.5], [1.0, None]]}}}


def test_documents_keep_their_log(spark):
    seg = spark.createDataFrame([("a", "wrong_way", 0.5, 2.0)], "video_id string, label string, start double, end double")
    curve = spark.createDataFrame([], "video_id string, t_sec double, score double")
    logs = spark.createDataFrame([("a", 2, 'second "line"'), ("a", 1, "first")], "video_id string, pos int, line string")
    docs = documents.prediction_documents(seg, curve, spark.createDataFrame([("a",), ("b",)], "video_id string"), "t", logs)
    got = {r["video_id"]: r["entry"] for r in documents.predictions(docs.select("doc")).collect()}
    assert got["a"]["log"] == ["first", 'second "line"'] and got["b"]["log"] is None
    assert [r["entry"]["events"] for r in documents.sanitised(documents.predictions(docs.select("doc"))).orderBy("video_id").collect()] == [[["0.5", "2.0", "wrong_way"]], []]


def test_every_problem_of_an_event(spark):
    rows = [("v", 0, -1.0, -2.0, "parking", 3), ("v", 1, 5.0, 4.0, "congestion", 3), ("v", 2, 1.0, 99.0, "parking", 3), ("v", 3, 1.0, 99.0, "congestion", 3), ("v", 4, None, 2.0, "parking", 3), ("v", 5, 1.0, None, None, 2)]
    df = spark.createDataFrame(rows, "video_id string, pos int, start double, end double, label string, width int")
    got = {(r["pos"], r["problem"]) for r in validation.event_problems(df, spark.createDataFrame([("v", 90.0)], "video_id string, duration double")).collect()}
    assert {g for g in got if g[1] != "overlaps the one before"} == {
        (0, "start must be 0 or more and before end"), (0, "unknown label"), (1, "start must be 0 or more and before end"), (2, "unknown label"), (3, "ends after the video"), (4, "times must be numbers"), (5, "an event needs a start, an end and a label"),
    }


def test_sketches_roll_up_within_their_bound(spark):
    tracks = spark.range(60000).selectExpr("concat('v', id % 7) as video_id", "id div 2 as track_id", "cast(id % 3600 as double) as t_sec", "cast(2 * (id % 2) as int) as cls")
    fine = eda.track_sketches(tracks, 5.0)
    hour = eda.rolled_up(fine, 720, []).collect()
    exact = tracks.select("video_id", "track_id").distinct().count()
    assert len(hour) == 1 and abs(hour[0]["n"] - exact) < 3 * exact / 64
    by = {r["video_id"]: r["n"] for r in eda.rolled_up(fine, 720).collect()}
    assert len(by) == 7 and all(abs(n - exact / 7) < 3 * exact / 7 / 64 for n in by.values())
    again = eda.rolled_up(eda.rolled_up(fine, 12), 60).collect()  # through minutes
    assert len(again) == 7 and all(abs(r["n"] - exact / 7) < 3 * exact / 7 / 64 for r in again)
    series = eda.object_series(spark.createDataFrame([("a", 0.0, 2), ("a", 0.5, 2), ("a", 0.5, 0), ("b", 0.0, 0)], "video_id string, t_sec double, cls int")).collect()
    assert {(r["video_id"], r["t_sec"], r["class"], r["n"]) for r in series} == {("a", 0.0, "car", 1), ("a", 0.5, "car", 1), ("a", 0.0, "person", 0), ("a", 0.5, "person", 1), ("b", 0.0, "person", 1)}


def test_bundles_name_every_fault(spark):
    videos = spark.createDataFrame([("ok", 10.0), ("bare", 5.0), ("odd", 2.0)], "video_id string, duration double")
    events = spark.createDataFrame([("ok", 4.0, 5.0, "wrong_way"), ("ok", 1.0, 2.0, "congestion"), ("odd", 0.0, 9.0, "congestion"), ("lost", 0.0, 1.0, "congestion")], "video_id string, start double, end double, label string")
    curve = spark.createDataFrame([("ok", k / 30, 0.5) for k in range(301)] + [("odd", 0.0, 0.1), ("odd", 0.0, 0.2)], "video_id string, t_sec double, score double")
    counts = spark.createDataFrame([("ok", float(k), k) for k in range(5)] + [("odd", 1.0, 1), ("odd", 2.0, 1)], "video_id string, t_sec double, car int")
    density = spark.createDataFrame([("ok", float(k), k) for k in range(5)] + [("odd", 1.0, 1)], "video_id string, t_sec double, east int")
    got = {r["video_id"]: r for r in tables.clip_bundles(videos, events, curve, counts, density).collect()}
    assert [e["label"] for e in got["ok"]["events"]] == ["congestion", "wrong_way"] and got["ok"]["problems"] == [] and got["ok"]["alarm_threshold"] == 0.5
    assert [round(p["t_sec"], 6) for p in got["ok"]["risk"]][:3] == [0.0, 0.2, 0.4] and len(got["ok"]["risk"]) == 51
    assert got["bare"]["problems"] == ["no risk", "no counts", "no density"] and got["bare"]["events"] == []
    assert got["odd"]["problems"] == ["counts and density differ in length", "repeated times in risk", "events outside the clip"]
    assert got["lost"]["problems"][:2] == ["not in videos", "no risk"] and set(got) == {"ok", "bare", "odd", "lost"}


def test_writes_keep_other_partitions_and_leave_out_incomplete_videos(spark, tmp_path):
    row = lambda camera, video, frame: (camera, video, frame, frame / 30, 1, 2, 0.5, 0.0, 0.0, 1.0, 1.0)
    schema = "camera_id string, video_id string, frame_idx int, t_sec double, track_id long, cls int, conf double, x1 double, y1 double, x2 double, y2 double"
    path = str(tmp_path / "tracks")
    tables.write_tracks(spark.createDataFrame([row("a", "v1", 0), row("b", "v2", 0)], schema), path)
    complete = spark.createDataFrame([("v3",)], "video_id string")
    tables.write_tracks(spark.createDataFrame([row("b", "v3", 5), row("b", "v4", 6)], schema), path, complete=complete)
    assert {(r["camera_id"], r["video_id"], r["frame_idx"]) for r in tables.read_tracks(spark, path).collect()} == {("a", "v1", 0), ("b", "v3", 5)}
    assert tables.read_tracks(spark, path, "a").count() == 1
    with pytest.raises(ValueError, match="track_id"):
        tables.write_tracks(spark.createDataFrame([("v", 1)], "video_id string, frame_idx int"), path)
    with pytest.raises(ValueError, match="speed"):
        tables.read_tracks(spark, path, columns=("conf", "speed"))
