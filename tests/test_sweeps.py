"""The tree of merges against runs found one setting at a time."""

import random

import pytest
from pyspark.sql import functions as F

from roadgrain.operators import kinematics, rules, runs, sweeps
from tests.test_rules import COLUMNS, SCENE, line, track


def test_tree_has_the_runs_of_every_gap(spark):
    rng = random.Random(7)
    rows = []
    for v in range(12):
        frame = 0
        for _ in range(rng.choice([1, 2, 40, 200])):
            frame += rng.choice([0, 2, 2, 2, 4, 10, 10, 30, 31, 90])
            rows.append((f"v{v % 4}", v, frame, 25.0, 2))
    df = spark.createDataFrame(rows, "video_id string, track_id long, frame_idx int, fps double, frame_stride int").repartition(3)
    keys = ["video_id", "track_id"]
    tree = sweeps.merge_tree(df, keys)
    assert tree.count() <= 2 * len(rows)
    settings = [{"setting": i, "flag": 0, "gap_sec": gap, "min_sec": least} for i, (gap, least) in enumerate((a, b) for a in (0.0, 0.1, 0.32, 1.12, 1.16, 3.6, 99.0) for b in (0.0, 0.5, 4.0))]
    got = sweeps.runs_of(tree.withColumn("flag", F.lit(0)), settings).collect()
    for x in settings:
        want = runs.flag_runs(df, keys, F.lit(True), x["min_sec"], x["gap_sec"]).collect()
        mine = [r for r in got if r["setting"] == x["setting"]]
        show = lambda rs: sorted((r["video_id"], r["track_id"], r["start_frame"], r["end_frame"], r["samples"]) for r in rs)
        assert show(mine) == show(want)
    assert sweeps.merge_tree(df.where("false"), keys).count() == 0


GRIDS = {
    "jaywalking": [{"min_conf": c, "gap_sec": gap, "min_sec": least, "kerb_margin": k, "rider_share": r} for c in (0.3, 0.6) for gap in (0.2, 1.0) for least in (1.0, 3.0) for k, r in ((0.75, 0.5), (0.2, 0.9))],
    "wrong_way": [{"min_conf": c, "gap_sec": gap, "min_angle_deg": a, "min_progress": p} for c in (0.3, 0.6) for gap in (0.2, 1.0) for a in (120.0, 170.0) for p in (0.5, 9.0)],
}


@pytest.mark.parametrize("label", sorted(GRIDS))
def test_sweeps_equal_single_settings(spark, label):
    rng = random.Random(5)
    tracks = [track(i, rng.choice([0, 0, 2]), [(f, x, y + rng.choice([0, 0, 25])) for f, x, y in line(2 * rng.randint(0, 60), rng.choice([2, 5, 9]), rng.uniform(300, 1700), rng.uniform(330, 900), vx=rng.choice([-150, -40, 0, 40, 150])) if rng.random() < 0.7], conf=rng.choice([0.35, 0.5, 0.9])) for i in range(70)]
    df = kinematics.with_kinematics(spark.createDataFrame([r for t in tracks for r in t], COLUMNS)).cache()
    found = sweeps.swept(df, SCENE, label, GRIDS[label])
    show = lambda rs: sorted((tuple(r["track_ids"]), round(r["start"], 6), round(r["end"], 6), round(r["score"], 6)) for r in rs)
    got = found.collect()
    base = {"jaywalking": rules.Jaywalking, "wrong_way": rules.WrongWay}[label]
    sizes = set()
    for i, x in enumerate(GRIDS[label][::5]):
        want = show(rules.to_segments(rules.RULES[label](df, SCENE, base(**x))).collect())
        assert show([r for r in got if r["setting"] == 5 * i]) == want
        sizes.add(len(want))
    assert len(sizes) > 1
    many, one = (sweeps.swept(df, SCENE, label, GRIDS[label][:n])._jdf.queryExecution().executedPlan().toString() for n in (16, 1))
    assert many.count("Sort [") == one.count("Sort [") and many.count("InMemoryTableScan") == one.count("InMemoryTableScan")
