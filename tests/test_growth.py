"""What keeps queries within their limits on larger tables: rounding, short methods, linking of many videos."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from roadgrain import catalog
from roadgrain.operators import kinematics, linking, runs


def longest_method(df):
    """The bytes of the longest generated method of a plan: over 8000 it is only interpreted."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # plans that adapt have no code before they run
    try:
        found = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenStringSeq(df.select("*")._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    return max(found.apply(i)._3().maxMethodCodeSize() for i in range(found.size()))


def test_rounding_is_that_of_sql(spark):
    rng = np.random.default_rng(11)
    values = [0.0, -0.0, 1.5e-6, -2.5e-6, 7.8125e-3, -7.8125e-3, 1e300, -3e12, float("inf"), *(np.round(rng.uniform(-50, 50, 3000), 6) + 5e-7).tolist()]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(catalog.r6("x")).collect()]
    wanted = [r[0] + 0.0 for r in duckdb.sql(f"SELECT round(x, 6) + 0e0 FROM (SELECT unnest({[v for v in values if v < 1e301]}) AS x)").fetchall()]
    assert [v for v in got if v < 1e301] == wanted and got[8] == float("inf")
    odd = spark.createDataFrame([(None,), (float("nan"),)], "x double").select(catalog.r6("x")).collect()
    assert odd[0][0] is None and odd[1][0] != odd[1][0]


def test_line_crossings_has_no_method_too_long_to_be_compiled(spark):
    rows = spark.range(2000).selectExpr("'v' as video_id", "id % 40 as track_id", "id as frame_idx", "cast(id as double) as t_sec", "cast(id * 7919 % 101 as double) as gx", "cast(id % 3 as double) as gy")
    crossed = kinematics.line_crossings(rows, (50.0, -5.0, 50.0, 5.0))
    assert longest_method(crossed) < 8000
    assert crossed.where(F.col("gx") == 50).count() > 0 and crossed.count() > 500


def test_speeds_and_persistence_share_one_sort(spark):
    rng = np.random.default_rng(5)
    rows = [("v", k % 7 - 1, int(f), float(f) / 30, float(rng.uniform(0, 40)), float(rng.uniform(0, 40)), 30.0, 15) for k in range(140) for f in rng.choice([15, 30, 45, 47, 120], 1) + 150 * (k // 7)]
    df = spark.createDataFrame(rows, "video_id string, track_id long, frame_idx int, t_sec double, gx double, gy double, fps double, frame_stride int")
    speeds = kinematics.with_sustained_speed(df, ordered=True)
    held = runs.persistent(speeds.withColumn("slow", F.col("sustained_speed") <= 10), "slow", 1.5)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = held.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plan.count("Sort [") == 1
    plain = runs.persistent(kinematics.with_sustained_speed(df).withColumn("slow", F.col("sustained_speed") <= 10), "slow", 1.5)
    assert sorted(map(tuple, held.select(plain.columns).collect())) == sorted(map(tuple, plain.collect()))
    # against interpolation
    for v in {r[1] for r in rows if r[1] >= 0}:
        mine = sorted((r[3], r[4], r[5]) for r in rows if r[1] == v)
        t, x, y = map(np.array, zip(*mine, strict=True))
        a, b = np.maximum(t - 1, t[0]), np.minimum(t + 1, t[-1])
        wanted = np.hypot(np.interp(b, t, x) - np.interp(a, t, x), np.interp(b, t, y) - np.interp(a, t, y)) / (b - a)
        got = [r["sustained_speed"] for r in plain.where(F.col("track_id") == v).orderBy("t_sec").collect()]
        assert np.allclose(got, wanted)


def test_parts_are_linked_side_by_side_as_alone(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows, wanted, th = [], {}, linking.Linking()
    for v in range(6):
        live, det = linking.Live(), 0
        for k in range(int(rng.integers(1, 40))):
            n = int(rng.integers(1, 14))
            x, y = np.round(rng.uniform(0, 500, (2, n)), -1)
            box = np.stack([x, y, x + 60, y + 90], 1)
            dets, cls, conf = np.arange(det, det + n), rng.choice([0, 2, 5], n), rng.choice([0.9, 0.3, 0.15, 0.05], n)
            det += n
            live, ids = linking.link_sample(live, k / 2, dets, cls, conf, box, th)
            wanted |= {(f"v{v}", int(d)): int(i) for d, i in zip(dets, ids, strict=True)}
            rows += [(f"v{v}", k * 15, k / 2, int(d), int(c), float(s), *map(float, b)) for d, c, s, b in zip(dets, cls, conf, box, strict=True)]
    calls = []
    sample = linking.link_sample
    monkeypatch.setattr(linking, "link_sample", lambda *a: calls.append(1) or sample(*a))
    part = np.array([int(r[0][1:]) for r in rows])
    plain = [np.array([r[k] for r in rows]) for k in (1, 2, 3, 4, 5)]
    got = linking.link_parts(part, *plain, np.array([r[6:] for r in rows]), th)
    assert {(r[0], r[3]): int(i) for r, i in zip(rows, got, strict=True)} == wanted and not calls
    df = spark.createDataFrame(rows, "video_id string, frame_idx long, t_sec double, det long, cls int, conf double, x1 double, y1 double, x2 double, y2 double").repartition(3)
    for most in (50, 1 << 17):  # parts longer than what is held, too
        monkeypatch.setattr(linking, "LINK_ROWS", most)
        assert {(r["video_id"], r["det"]): r["track_id"] for r in linking.link(df).collect()} == wanted


def test_small_assignments_equal_large_ones(monkeypatch):
    rng = np.random.default_rng(4)
    for _ in range(200):
        n = int(rng.integers(1, 7))
        cost = np.round(rng.random((n, n + int(rng.integers(0, 5)))), 1)
        small = linking.least_cost(cost)
        monkeypatch.setattr(linking, "SMALL", 0)
        assert (linking.least_cost(cost) == small).all()
        monkeypatch.undo()
