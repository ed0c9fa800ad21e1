"""Assignment against all matchings, linking in batch and as a stream, and what it keeps."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadgrain.functions import scalars as s
from roadgrain.operators import linking
from roadgrain.operators.linking import Linking
from roadgrain.streaming import stateful

DETECTIONS = "video_id string, frame_idx long, t_sec double, det long, cls int, conf double, x1 double, y1 double, x2 double, y2 double"


def all_matchings(gain):
    n, m = gain.shape
    best = 0.0
    for k in range(min(n, m) + 1):
        for rows in itertools.combinations(range(n), k):
            for cols in itertools.permutations(range(m), k):
                if all(gain[i, j] > 0 for i, j in zip(rows, cols)):
                    best = max(best, sum(gain[i, j] for i, j in zip(rows, cols)))
    return best


def test_assignment_is_the_best_of_all_matchings():
    rng = np.random.default_rng(3)
    for _ in range(400):
        n, m = rng.integers(0, 5, 2)
        gain = np.where(rng.random((n, m)) < 0.6, np.round(rng.random((n, m)), rng.integers(1, 4)), -1.0)
        got = linking.best_pairs(gain)
        assert len({i for i, _ in got}) == len(got) == len({j for _, j in got}) and all(gain[i, j] > 0 for i, j in got)
        assert sum(gain[i, j] for i, j in got) == pytest.approx(all_matchings(gain))
    big = rng.random((60, 80))
    cols = linking.least_cost(big)
    assert len(set(cols)) == 60 and big[np.arange(60), cols].sum() < big.min(1).sum() * 1.6


def box(x, y, h=100.0, w=60.0):
    return tuple(float(v) for v in (x - w / 2, y - h, x + w / 2, y))


def scenes_of(seed):
    rng = random.Random(seed)
    rows = []
    for v in ("a", "b"):
        det = 0
        actors = [(rng.uniform(0, 60), rng.uniform(4, 30), rng.uniform(0, 1500), rng.uniform(200, 900), rng.uniform(-80, 80), rng.choice([0, 2, 2, 5])) for _ in range(25)]
        for k in range(130):
            t = 0.5 * k + (6.0 if k > 60 else 0) + (1.9 if k > 100 else 0)
            for start, lasts, x, y, vx, cls in actors:
                if start <= t <= start + lasts and rng.random() < 0.85:
                    det += 1
                    rows.append((v, int(t * 30), t, det, cls, rng.choice([0.9, 0.6, 0.26, 0.2, 0.12, 0.05]), *box(x + vx * (t - start) + rng.uniform(-3, 3), y + rng.uniform(-3, 3))))
    return rows


def streamed(spark, frames, build, folder, name, cuts):
    for a, b in zip(cuts, cuts[1:]):
        frames.where(f"frame_idx >= {a} and frame_idx < {b}").coalesce(1).write.mode("append").parquet(folder)
    source = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    q = build(source).writeStream.format("memory").queryName(name).outputMode("append").start()
    q.processAllAvailable()
    progress = q.recentProgress
    q.stop()
    return spark.table(name).collect(), progress


def test_stream_equals_batch(spark, tmp_path):
    rows = scenes_of(1)
    df = spark.createDataFrame(rows, DETECTIONS).repartition(5)
    batch = linking.link(df)
    got = {(r["video_id"], r["det"]): r["track_id"] for r in batch.collect()}
    assert len(got) == len(rows)
    kept = [(v, d, i) for (v, d), i in got.items() if i >= 0]
    assert len({(v, i) for v, _, i in kept}) < len(kept) / 3  # tracks of several boxes
    assert all(got[(v, i)] == i for v, _, i in kept)  # an id is its first box's number
    frames = linking.frames_of(df).withColumn("ts", stateful.clock())
    out, _ = streamed(spark, frames, stateful.link_stream, str(tmp_path / "f"), "link_equal", [0, 500, 900, 1500, 9999])
    assert {(r["video_id"], r["det"]): r["track_id"] for r in out} == got
    # whole videos in one part give the same
    live, plain = {}, {}
    for v in ("a", "b"):
        mine = sorted((r for r in rows if r[0] == v), key=lambda r: (r[1], r[3]))
        live = linking.Live()
        for _, part in itertools.groupby(mine, key=lambda r: r[1]):
            part = list(part)
            live, ids = linking.link_sample(live, part[0][2], np.array([r[3] for r in part]), np.array([r[4] for r in part]), np.array([r[5] for r in part]), np.array([r[6:] for r in part]), Linking())
            plain |= {(v, r[3]): int(i) for r, i in zip(part, ids)}
    assert plain == got


def test_what_linking_keeps_and_parts(spark):
    th = Linking()
    rows, det = [], itertools.count(1)
    def add(frame, cls, conf, x, y, h=100.0):
        rows.append(("v", frame, frame / 30, next(det), cls, conf, *box(x, y, h)))
        return rows[-1][3]
    walk = [add(15 * k, 0, 0.9, 100 + 45 * k, 500) for k in range(6)]  # no overlap from one sample to the next
    fast = [add(15 * k, 2, 0.9 if k != 3 else 0.15, 900 - 120 * k, 300) for k in range(6)]  # once unsure
    faint = [add(15 * k, 2, 0.15, 1500, 300) for k in range(6)]  # never sure: no track
    near_car = [add(15 * k, 2, 0.9, 110 + 45 * k, 500) for k in range(6)]  # beside the person
    grown = [add(0, 2, 0.9, 1700, 900, 100), add(15, 2, 0.9, 1760, 900, 260)]
    lost = [add(0, 2, 0.9, 600, 900), add(45, 2, 0.9, 600, 900), add(45 + 75, 2, 0.9, 600, 900)]  # 1.5 s, then 2.5 s
    got = {r["det"]: r["track_id"] for r in linking.link(spark.createDataFrame(rows, DETECTIONS), th).collect()}
    of = lambda ds: [got[d] for d in ds]
    assert of(walk) == [walk[0]] * 6 and of(fast) == [fast[0]] * 6 and of(faint) == [-1] * 6 and of(near_car) == [near_car[0]] * 6
    assert of(grown) == grown and of(lost) == [lost[0], lost[0], lost[2]]
    assert linking.link(spark.createDataFrame([], DETECTIONS)).count() == 0


def test_similarity_agrees_with_the_columns(spark):
    rng = np.random.default_rng(5)
    th = Linking()
    a = [box(*rng.uniform(0, 300, 2), rng.uniform(40, 160)) for _ in range(30)]
    b = [box(*rng.uniform(0, 300, 2), rng.uniform(40, 160)) for _ in range(30)]
    ca, cb = rng.choice([0, 2], 30), rng.choice([0, 2], 30)
    got = linking.similarity(np.array(a), ca, np.array(b), cb, th)
    from roadgrain.functions import geometry as g

    rows = [(*map(float, (*p, *q)), int(x), int(y)) for p, x in zip(a, ca) for q, y in zip(b, cb)]
    names = ["a1", "a2", "a3", "a4", "b1", "b2", "b3", "b4"]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names) + ", x int, y int")
    c = F.col
    dist = F.hypot((c("a1") + c("a3") - c("b1") - c("b3")) / 2, (c("a2") + c("a4") - c("b2") - c("b4")) / 2)
    near = s.motion_similarity(dist, c("a4") - c("a2"), c("b4") - c("b2"), c("x") == 0, c("y") == 0, th.reach_person, th.reach_vehicle, th.max_size_ratio)
    both = F.greatest(F.when((c("x") == 0) == (c("y") == 0), g.box_iou(names[:4], names[4:])).otherwise(0.0), near)
    want = [r[0] for r in df.select(both).collect()]
    assert np.allclose(got.ravel(), want)
    buffer = df.limit(1).select(s.linker_buffer(2.0, F.lit(30.0), F.lit(15)), s.linker_buffer(0.01, F.lit(30.0), F.lit(15))).first()
    assert tuple(buffer) == (4, 1)


@pytest.mark.parametrize("kind", ["links", "risk"])
def test_a_finished_videos_state_is_removed(spark, tmp_path, kind):
    rows = [(v, 15 * k, 0.5 * k + off, k, 2, 0.9, *box(100.0 + 5 * k, 300)) for v, off, n in (("one", 0.0, 20), ("two", 200.0, 20), ("three", 400.0, 4)) for k in range(n)]
    df = spark.createDataFrame(rows, DETECTIONS).withColumn("frame_idx", (F.col("t_sec") * 30).cast("long"))
    frames = linking.frames_of(df).withColumn("ts", stateful.clock())
    if kind == "risk":
        boxes = F.transform("boxes", lambda b: F.struct(b["det"].alias("track_id"), b["cls"].alias("cls"), b["x1"].alias("gx"), b["y2"].alias("gy"), F.lit(100.0).alias("h")))
        frames = frames.withColumn("boxes", boxes)
    build = stateful.link_stream if kind == "links" else stateful.risk_stream
    out, progress = streamed(spark, frames, build, str(tmp_path / kind), f"evict_{kind}", [0, 3000, 9000, 99999])
    assert len(out) == 44
    totals = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    live = [p["numInputRows"] for p in progress]
    assert max(totals) > 0 and totals[-1] <= max(totals) and sum(live) == 44
    held = [t for t in totals if t > 0]
    assert totals[-1] == held[0], (totals, live)  # one video's rows after three videos


def test_late_and_repeated_frames_are_dropped(spark, tmp_path):
    rows = [("v", f, f / 30, i, 2, 0.9, *box(100.0 + f, 300)) for i, f in enumerate([0, 15, 30, 15, 45, 30, 60])]
    frames = spark.createDataFrame([(r[0], k, r[1], r[2], [dict(zip(linking.DETECTION, r[3:]))]) for k, r in enumerate(rows)], "video_id string, k int, frame_idx long, t_sec double, boxes array<struct<det:long,cls:long,conf:double,x1:double,y1:double,x2:double,y2:double>>").withColumn("ts", stateful.clock())
    folder = str(tmp_path / "late")
    for k in range(7):
        frames.where(f"k = {k}").drop("k").coalesce(1).write.mode("append").parquet(folder)
    source = spark.readStream.schema(frames.drop("k").schema).option("maxFilesPerTrigger", 1).parquet(folder)
    q = stateful.link_stream(source).writeStream.format("memory").queryName("late_frames").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["frame_idx"], r["track_id"]) for r in spark.table("late_frames").collect()) == [(f, 0) for f in (0, 15, 30, 45, 60)]
    with pytest.raises(ValueError):
        stateful.link_stream(source, idle_sec=1.0)
