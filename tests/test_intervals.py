import random

from pyspark.sql import functions as F

from roadgrain.operators import eda, evaluation, intervals, runs

SEG = "video_id string, label string, start double, end double"


def random_segments(seed, n=300):
    rng = random.Random(seed)
    return [(f"v{rng.randint(0, 3)}", rng.choice("ab"), s := rng.randint(0, 300) / 2, s + rng.randint(0, 12) / 2) for _ in range(n)]


def merged(rows, gap, strict):
    out = {}
    for v, lab, s, e in sorted(rows):
        have = out.setdefault((v, lab), [])
        if have and (s - have[-1][1] < gap if strict else s - have[-1][1] <= gap):
            have[-1][1] = max(have[-1][1], e)
        else:
            have.append([s, e])
    return sorted((*k, *x) for k, v in out.items() for x in v)


def test_merge_and_no_overlap(spark):
    rows = random_segments(1)
    df = spark.createDataFrame(rows, SEG)
    got = sorted(map(tuple, intervals.merge(df, 1.0).select("video_id", "label", "start", "end").collect()))
    assert got == merged(rows, 1.0, False)
    once = intervals.enforce_no_overlap(df)
    got = sorted(map(tuple, once.select("video_id", "label", "start", "end").collect()))
    assert got == merged(rows, 0.0, True)
    assert sorted(map(tuple, intervals.enforce_no_overlap(once).select("video_id", "label", "start", "end").collect())) == got
    assert intervals.overlaps(once).isEmpty() and intervals.assert_no_overlap(once).count() == len(got)


def test_finalise_rescues_fragments_before_blips(spark):
    rows = [("v", "a", 0.0, 30.0), ("v", "a", 5.0, 8.0), ("v", "a", 7.0, 40.0), ("v", "a", 39.0, 50.0), ("v", "a", 60.0, 61.0), ("v", "a", -3.0, 2.0)]
    df = spark.createDataFrame(rows, SEG).withColumn("duration", F.lit(55.0))
    assert [tuple(r) for r in intervals.finalise(df).select("start", "end").collect()] == [(0.0, 50.0)]


def test_clean_events_keeps_the_earlier(spark):
    rng = random.Random(5)
    rows = [("v", i, rng.randint(-2, 60) / 2, rng.randint(0, 70) / 2, rng.choice(["jaywalking", "wrong_way", "parking", None]), 30.0) for i in range(200)]
    rows.append(("v", 200, None, 3.0, "jaywalking", 30.0))
    got = intervals.clean_events(spark.createDataFrame(rows, "video_id string, pos int, start double, end double, label string, duration double"), eda.LABELS).collect()
    assert len(got) == len(rows)
    kept, last = set(), {}
    good = [(lab, s, i, min(e, d)) for _, i, s, e, lab, d in rows if s is not None and lab in eda.LABELS and 0 <= s < min(e, d)]
    for lab, s, i, e in sorted(good):
        if s >= last.get(lab, -1):
            kept.add(i)
            last[lab] = e
    assert {r["pos"] for r in got if r["kept"]} == kept
    assert all((r["reason"] is None) == r["kept"] for r in got)


def greedy(gt, pred, thr):
    pairs = []
    for i, (a, b) in enumerate(gt):
        for j, (c, d) in enumerate(pred):
            inter = min(b, d) - max(a, c)
            if inter > 0:
                iou = inter / ((b - a) + (d - c) - inter)
                if iou >= thr:
                    pairs.append((iou, i, j))
    g, p, out = set(), set(), []
    for iou, i, j in sorted(pairs, reverse=True):
        if i not in g and j not in p:
            g.add(i)
            p.add(j)
            out.append((i, j))
    return sorted(out)


def test_greedy_matching_against_a_loop(spark):
    for seed in range(3):
        gt, pred = [sorted({r for r in random_segments(seed * 2 + k, 80) if r[3] > r[2]}) for k in (0, 1)]
        got = evaluation.matches(spark.createDataFrame(gt, SEG), spark.createDataFrame(pred, SEG), [0.3]).collect()
        for v in {r[0] for r in gt}:
            for lab in "ab":
                side = lambda rows: sorted((s, e) for a, b, s, e in rows if (a, b) == (v, lab))
                mine = sorted((r["g"], r["p"]) for r in got if (r["video_id"], r["label"]) == (v, lab))
                assert mine == greedy(side(gt), side(pred), 0.3)


def test_average_precision_takes_ties_together(spark):
    rng = random.Random(2)
    rows = [(rng.randint(0, 20) / 20, rng.choice([0, 0, 1, None])) for _ in range(400)]
    got = evaluation.average_precision(spark.createDataFrame(rows, "score double, y int"), buckets=7).first()
    rows = [r for r in rows if r[1] is not None]
    pos, ap, tp, n = sum(y for _, y in rows), 0.0, 0, 0
    for s in sorted({s for s, _ in rows}, reverse=True):
        tie = [y for t, y in rows if t == s]
        tp, n = tp + sum(tie), n + len(tie)
        ap += sum(tie) / pos * tp / n
    assert abs(got["ap_raw"] - ap) < 1e-9 and got["n"] == len(rows) and got["n_pos"] == pos
    none = evaluation.average_precision(spark.createDataFrame([], "score double, y int")).first()
    assert (none["ap_raw"], none["n"]) == (0.0, 0)


def test_alarms(spark):
    curve = [("v", float(t), float(s)) for t, s in enumerate([0, 0.6, 0.7, 0.1, 0.9, 0, 0, 0, 0.5, 0.5])]
    got = [r["t_sec"] for r in runs.alarm_starts(spark.createDataFrame(curve, "video_id string, t_sec double, score double")).orderBy("t_sec").collect()]
    assert got == [1.0, 4.0, 8.0]
    alarms = spark.createDataFrame([("v", 1.0), ("v", 2.0), ("v", 30.0)], "video_id string, t_sec double")
    accidents = spark.createDataFrame([("v", 5.0), ("v", 6.0), ("v", 20.0)], "video_id string, start double")
    got = {r["start"]: r["alarm"] for r in evaluation.alarm_matches(alarms, accidents).collect()}
    assert got == {5.0: 1.0, 6.0: 2.0, 20.0: None}


def test_as_of(spark):
    samples = spark.createDataFrame([("v", 1.0, 0.1), ("v", 3.0, 0.3)], "video_id string, t_sec double, score double")
    asked = spark.createDataFrame([("v", 0.5), ("v", 1.0), ("v", 2.0), ("v", 9.0), ("w", 1.0)], "video_id string, at double")
    back = {(r["video_id"], r["at"]): r["score"] for r in intervals.as_of_backward(samples, asked).collect()}
    assert back == {("v", 0.5): None, ("v", 1.0): 0.1, ("v", 2.0): 0.1, ("v", 9.0): 0.3, ("w", 1.0): None}
    ahead = {(r["video_id"], r["at"]): r["score"] for r in intervals.as_of_forward(samples, asked).collect()}
    assert ahead == {("v", 0.5): 0.1, ("v", 1.0): 0.1, ("v", 2.0): 0.3, ("v", 9.0): 0.3, ("w", 1.0): 0.0}
