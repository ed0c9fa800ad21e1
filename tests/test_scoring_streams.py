"""Labels, alarms and their matches as streams, against the batch forms on the same rows."""

import random

from roadgrain.operators import evaluation, runs
from roadgrain.streaming import scoring

CURVE, TRUTH = "video_id string, t_sec double, score double", "video_id string, label string, start double, end double"
END = 5000.0


def scenario(seed):
    """Three videos of 100 s at 5 Hz; one of them has a long near miss, one no accident."""
    rnd = random.Random(seed)
    risk, truth = [], [("b", "near_miss", 10.0, 75.0), ("b", "jaywalking", 0.0, 99.0), ("c", "near_miss", 50.0, 51.0)]
    for v in "abc":
        level = 0.2
        for k in range(500):
            level = rnd.random() if rnd.random() < 0.12 else level
            risk.append((v, k / 5, None if k == 77 else round(level, 3)))
    for v in "ab":
        for _ in range(7):
            start = rnd.randrange(0, 95) + rnd.choice([0.0, 0.2, 0.5])
            truth.append((v, "accident", start, start + rnd.choice([0.0, 1.5, 4.0])))
    return risk, truth


def dealt(rows, schema, when, spark, folder, seed):
    """Rows in four files by time, each shuffled, with neighbours up to 6 s early or late."""
    rnd = random.Random(seed)
    keyed = sorted((when(r) + rnd.uniform(-3, 3), i) for i, r in enumerate(rows))
    size = -(-len(keyed) // 4)
    for k in range(4):
        part = [rows[i] for _, i in keyed[k * size : (k + 1) * size]]
        rnd.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)


def run(spark, out, name):
    q = out.writeStream.format("memory").queryName(name).outputMode("append").start()
    q.processAllAvailable()
    state = [o["numRowsTotal"] for o in (q.lastProgress or {}).get("stateOperators", [])]
    q.stop()
    return spark.table(name), state


def stream(spark, schema, folder):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_labels_and_alarms_equal_the_batch(spark, tmp_path):
    risk, truth = scenario(5)
    curve, gt = spark.createDataFrame(risk, CURVE), spark.createDataFrame(truth, TRUTH)
    late = [("end", END, 0.0)], [("end", "accident", END, END)]  # moves the watermark past every row
    dealt(risk, CURVE, lambda r: r[1], spark, str(tmp_path / "risk"), 1)
    dealt(truth, TRUTH, lambda r: r[2], spark, str(tmp_path / "truth"), 2)
    spark.createDataFrame(late[0], CURVE).coalesce(1).write.mode("append").parquet(str(tmp_path / "risk"))
    spark.createDataFrame(late[1], TRUTH).coalesce(1).write.mode("append").parquet(str(tmp_path / "truth"))

    # incidents come about when they start, so they may be known 40 s late here; pieces of 20 s
    out = scoring.label_stream(stream(spark, CURVE, str(tmp_path / "risk")), stream(spark, TRUTH, str(tmp_path / "truth")), "60 seconds", 20.0)
    table, _ = run(spark, out, "labels_now")
    got = {(r["video_id"], r["t_sec"]): r["y"] for r in table.where("video_id <> 'end'").collect()}
    batch = evaluation.frame_labels(curve, gt.where("label = 'accident'"), gt.where("label = 'near_miss'"))
    want = {(r["video_id"], r["t_sec"]): r["y"] for r in batch.collect()}
    assert got == want
    assert {0, 1, None} == set(want.values())

    batch.write.parquet(str(tmp_path / "labelled_batch"))
    labelled = spark.read.parquet(str(tmp_path / "labelled_batch"))
    dealt([tuple(r) for r in labelled.select("video_id", "t_sec", "score", "y").collect()], CURVE + ", y int", lambda r: r[1], spark, str(tmp_path / "labelled"), 3)
    spark.createDataFrame([("end", END, 0.0, 0), ("end", END + 1000, 0.0, 0)], CURVE + ", y int").coalesce(1).write.mode("append").parquet(str(tmp_path / "labelled"))
    out = scoring.alarm_stream(stream(spark, CURVE + ", y int", str(tmp_path / "labelled")), stream(spark, TRUTH, str(tmp_path / "truth")), delay="60 seconds", idle_sec=30.0)
    table, state = run(spark, out, "alarms_now")
    found = table.where("video_id <> 'end'").collect()
    starts = runs.alarm_starts(curve, evaluation.THETA, evaluation.ALARM_GAP).join(labelled.where("y is not null").select("video_id", "t_sec"), ["video_id", "t_sec"])
    alarms = {(r["video_id"], r["t_sec"]) for r in starts.collect()}
    assert {(r["video_id"], r["t_sec"]) for r in found if r["kind"] == "alarm"} == alarms and len(alarms) > 5
    taken = evaluation.alarm_matches(starts, gt.where("label = 'accident'")).collect()
    key = lambda r, at: (r["video_id"], r[at], -1.0 if r["alarm"] is None else r["alarm"], round(r["tta"], 9))
    assert sorted(key(r, "t_sec") for r in found if r["kind"] == "accident") == sorted(key(r, "start") for r in taken)
    assert any(r["alarm"] is not None for r in taken) and any(r["alarm"] is None for r in taken)
    assert max(state) <= 8, "only the last video's rows and timers are left"


def test_pieces_cover_an_incident_once_cut(spark):
    truth = [("a", "accident", 7.0, 50.0), ("a", "near_miss", 3.0, 3.0), ("a", "congestion", 0.0, 9.0), ("a", "accident", 9.0, 2.0), ("a", "accident", None, 2.0)]
    rows = scoring.incident_pieces(spark.createDataFrame(truth, TRUTH), 20.0, 0.0).orderBy("label", "from_sec").collect()
    assert [(r["label"], r["from_sec"], r["to_sec"]) for r in rows] == [("accident", 2.0, 22.0), ("accident", 22.0, 42.0), ("accident", 42.0, 50.0), ("near_miss", -2.0, 3.0)]
    assert rows[0]["from_ts"].timestamp() == 2.0


def test_no_rows(spark, tmp_path):
    spark.createDataFrame([], CURVE).write.parquet(str(tmp_path / "risk"))
    spark.createDataFrame([], TRUTH).write.parquet(str(tmp_path / "truth"))
    out = scoring.label_stream(stream(spark, CURVE, str(tmp_path / "risk")), stream(spark, TRUTH, str(tmp_path / "truth")))
    assert run(spark, out, "labels_none")[0].count() == 0
