"""Findings of round 3: documents in bundles, one pass over samples, pairs in short methods."""

import itertools
import math
from collections import defaultdict

from pyspark.sql import functions as F

from roadgrain import catalog
from roadgrain.operators import kinematics, review, risk
from roadgrain.plans import views
from roadgrain.sources import documents, staging
from roadgrain.sources.prediction_source import read_predictions
from tests.test_growth import longest_method

SF = "/root/testdata/sf0.001"


def test_documents_of_many_videos_are_read_as_those_of_one(spark, tmp_path):
    rows = spark.range(900).selectExpr("concat('v\"', id % 70) as video_id", "cast(id as double) / 3 as start", "cast(id as double) as `end`", "if(id % 2 = 0, 'a', 'b\"{}') as label")
    videos = rows.select("video_id").distinct().unionByName(spark.createDataFrame([("none",)], "video_id string"))
    empty = rows.select("video_id", F.lit(0.0).alias("t_sec"), F.lit(0.0).alias("score")).where("1 = 0")
    documents.write_documents(documents.bundled(documents.prediction_entries(rows, empty, videos), "team", 5), str(tmp_path / "many"), key="bundle")
    documents.write_documents(documents.prediction_documents(rows, empty, videos, "team"), str(tmp_path / "one"))
    assert len(list((tmp_path / "many").glob("bundle=*/*.txt"))) == 5 and len(list((tmp_path / "one").glob("video_id=*/*.txt"))) == 71
    found = {n: sorted(map(tuple, read_predictions(spark, str(tmp_path / n)).drop("file").collect())) for n in ("many", "one")}
    assert found["many"] == found["one"] and len(found["one"]) == 900


def test_prediction_source_writes_fewer_files_than_videos(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(staging, "shared_folder", lambda _: str(tmp_path))
    out = catalog.QUERIES["prediction_source"](spark, SF).collect()
    videos = views.predicted(spark, SF).select("video_id").distinct().count()
    assert len(out) > 50 and len(list(tmp_path.glob("documents-*/*/*.txt"))) < videos / 10


def test_clip_bundles_goes_through_the_samples_once(spark):
    # three series of their own samples before
    plan = catalog.QUERIES["clip_bundles"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" not in plan


def test_pairs_of_boxes_are_scored_in_short_methods_and_from_one_pass(spark):
    tracks = views.tracks(spark, SF)
    scores = risk.sample_scores(tracks)
    assert longest_method(scores) < 8000
    # one exchange of orders: velocities were worked out for both sides of a join before
    assert scores._jdf.queryExecution().optimizedPlan().toString().count("Window") == 1
    live = kinematics.history_velocity(tracks.where("track_id >= 0"), 0.4, 1.5).collect()
    th, frames, want = risk.Risk(), defaultdict(list), {}
    for r in live:
        frames[r["video_id"], r["frame_idx"]].append(r)
    for key, boxes in frames.items():
        want[key] = 0.0
        for a, b in itertools.combinations([r for r in boxes if r["hx"] is not None], 2):
            (rx, ry), (wx, wy) = (b["gx"] - a["gx"], b["gy"] - a["gy"]), (b["hx"] - a["hx"], b["hy"] - a["hy"])
            ww, rw, dist, size = wx * wx + wy * wy, rx * wx + ry * wy, math.hypot(rx, ry), (a["y2"] - a["y1"] + b["y2"] - b["y1"]) / 2
            if a["track_id"] != b["track_id"] and not a["cls"] == b["cls"] == 0 and ww > 1e-9 and -rw / ww > 0 and dist > 1e-9:
                t = -rw / ww
                if math.hypot(rx + wx * t, ry + wy * t) <= th.radius * size and -rw / dist >= th.min_closing * size:
                    want[key] = max(want[key], 0.5 ** (t / th.half_life))
    got = {(r["video_id"], r["frame_idx"]): r["raw"] for r in scores.collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], v, rel_tol=1e-9) for k, v in want.items())
    assert sum(v > 0 for v in want.values()) > 5


def test_the_scan_works_out_zones_and_speeds_once(spark):
    rows = kinematics.with_kinematics(views.tracks(spark, SF))
    alone, kept = review.scan(rows, views.scene()), review.scan(rows, views.scene(), staging.staged)
    assert "orders.parquet" not in kept._jdf.queryExecution().executedPlan().toString()
    show = lambda df: sorted((r["video_id"], r["label"], r["kind"], r["start"], r["end"], r["rank"]) for r in df.collect())
    assert show(kept) == show(alone) and len(show(kept)) > 20


def test_formulas_of_an_order_are_worked_out_once_an_order(spark):
    plan = views.tracks(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Generate")]
    assert not any(f"% {n})" in above for n in (120, 13, 1600, 1500, 60))
