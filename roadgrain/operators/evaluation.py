"""Scoring predicted segments and risk curves against ground truth.

gt, pred: video_id, label, start, end. risk: video_id, t_sec, score. A pair's
temporal IoU decides; greedy one-to-one matching is a fold per (video, label,
threshold), which needs no Python.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadgrain.functions import scalars as s
from roadgrain.operators import runs
from roadgrain.operators.intervals import overlapping, points_in_intervals

# fixed values: thresholds and weights of the scores
THRESHOLDS = (0.3, 0.5, 0.7)
HORIZON, ALARM_WINDOW, THETA, ALARM_GAP = 5.0, 10.0, 0.5, 2.0
WEIGHTS_B = {"ap": 0.4, "f1_alarm": 0.4, "mtta": 0.2}
WEIGHT_A, WEIGHT_B = 0.7, 0.3
_PAIRS = "array<struct<iou:double,g:int,p:int>>"


def numbered(segments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds ord: 0, 1, ... per key in the order of pos where there is one, else of start, end."""
    order = ["pos"] if "pos" in segments.columns else ["start", "end"]
    return segments.withColumn("ord", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def matches(gt: DataFrame, pred: DataFrame, thresholds: Sequence[float] = THRESHOLDS, keys: Sequence[str] = ("video_id", "label")) -> DataFrame:
    """(keys, threshold, g, p, iou) of matched pairs: pairs by falling IoU, then falling g
    and p, each taken if both its ends are still free."""
    a = numbered(gt, keys).select(*keys, F.col("ord").alias("g"), F.col("start").alias("gs"), F.col("end").alias("ge"))
    b = numbered(pred, keys).select(*keys, F.col("ord").alias("p"), F.col("start").alias("ps"), F.col("end").alias("pe"))
    iou = s.tiou(F.col("gs"), F.col("ge"), F.col("ps"), F.col("pe"))
    pairs = overlapping(a, b, keys).withColumn("iou", iou)
    pairs = pairs.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))).where("iou >= threshold")
    grouped = pairs.groupBy(*keys, "threshold").agg(F.reverse(F.array_sort(F.collect_list(F.struct("iou", "g", "p")))).alias("pairs"))

    def take(acc: Column, x: Column) -> Column:
        free = ~F.exists(acc, lambda y: (y["g"] == x["g"]) | (y["p"] == x["p"]))
        return F.when(free, F.concat(acc, F.array(x))).otherwise(acc)

    folded = F.aggregate(F.col("pairs").cast(_PAIRS), F.array().cast(_PAIRS), take)
    return grouped.select(*keys, "threshold", F.explode(folded).alias("m")).select(*keys, "threshold", "m.g", "m.p", "m.iou")


def class_universe(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """Labels of the ground truth and of all predictions, also of videos that have no truth."""
    return gt.select("label").union(pred.select("label")).distinct()


def counts(gt: DataFrame, pred: DataFrame, thresholds: Sequence[float] = THRESHOLDS, keys: Sequence[str] = ("video_id", "label")) -> DataFrame:
    """(keys, threshold, tp, fp, fn); predictions of videos without truth are left out before."""
    n = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    sides = n(gt, "n_gt").join(n(pred, "n_pred"), list(keys), "full").withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    hits = matches(gt, pred, thresholds, keys).groupBy(*keys, "threshold").agg(F.count("*").alias("tp"))
    tp, ng, np_ = (F.coalesce(c, F.lit(0)).cast("long") for c in ("tp", "n_gt", "n_pred"))
    return sides.join(hits, [*keys, "threshold"], "left").select(*keys, "threshold", tp.alias("tp"), (np_ - tp).alias("fp"), (ng - tp).alias("fn"))


def scored_videos(pred: DataFrame, videos: DataFrame) -> DataFrame:
    return pred.join(videos.select("video_id"), "video_id", "left_semi")


def class_scores(gt: DataFrame, pred: DataFrame, videos: DataFrame, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """(label, threshold, tp, fp, fn, precision, recall, f1), pooled over the videos with
    truth, and with label null over all classes (micro)."""
    per = counts(gt, scored_videos(pred, videos), thresholds)
    grid = class_universe(gt, pred).withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    full = grid.join(per, ["label", "threshold"], "left").select("label", "threshold", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("tp", "fp", "fn")])
    sums = full.groupingSets([["label", "threshold"], ["threshold"]], "label", "threshold").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return sums.withColumns(s.prf(F.col("tp"), F.col("fp"), F.col("fn")))


def macro_score(gt: DataFrame, pred: DataFrame, videos: DataFrame, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """One row, score_a: mean over classes of the mean F1 over the thresholds."""
    by_class = class_scores(gt, pred, videos, thresholds).where("label is not null").groupBy("label").agg(F.avg("f1").alias("f1"))
    return by_class.agg(F.coalesce(F.avg("f1"), F.lit(0.0)).alias("score_a"))


def agnostic_scores(gt: DataFrame, pred: DataFrame, videos: DataFrame, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """class_scores of one matching that ignores labels: (threshold, tp, fp, fn, ...)."""
    per = counts(gt, scored_videos(pred, videos), thresholds, ("video_id",))
    sums = per.groupBy("threshold").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return sums.withColumns(s.prf(F.col("tp"), F.col("fp"), F.col("fn")))


def video_cells(gt: DataFrame, pred: DataFrame, labels: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """One row per video with 'tp/fp/fn' for every label."""
    per = counts(gt, pred, [threshold]).withColumn("cell", F.concat_ws("/", "tp", "fp", "fn"))
    return per.groupBy("video_id").pivot("label", list(labels)).agg(F.first("cell"))


def frame_labels(risk: DataFrame, accidents: DataFrame, near_misses: DataFrame, width: float = 60.0) -> DataFrame:
    """Adds y to risk: null (ignored) inside an accident, else 1 up to HORIZON seconds before
    one, else null up to HORIZON before or inside a near miss, else 0."""
    inside = F.col("t_sec") >= F.col("s")
    a = accidents.select("video_id", (F.col("start") - HORIZON).alias("start"), "end", F.col("start").alias("s"))
    b = near_misses.select("video_id", (F.col("start") - HORIZON).alias("start"), "end")
    points = risk.select("video_id", "t_sec").distinct()
    hit = points_in_intervals(points, a, width, closed=True).groupBy("video_id", "t_sec").agg(F.max(inside).alias("inside"), F.max(~inside).alias("before"))
    near = points_in_intervals(points, b, width, closed=True).select("video_id", "t_sec", F.lit(True).alias("near")).distinct()
    joined = risk.join(hit, ["video_id", "t_sec"], "left").join(near, ["video_id", "t_sec"], "left")
    y = F.when(F.col("inside"), None).when(F.col("before"), 1).when(F.col("near"), None).otherwise(0)
    return joined.withColumn("y", y).drop("inside", "before", "near")


def average_precision(labelled: DataFrame, buckets: int = 64) -> DataFrame:
    """One row: ap_raw, positive_rate, n, n_pos of labelled(score, y), ties taken together.

    Ties are grouped first. The distinct scores are then dealt to ``buckets``
    ranges between the least and the largest, so that the running counts need
    no single task: each range starts from the sums of those above it.
    """
    ties = labelled.where("y is not null").groupBy("score").agg(F.sum("y").alias("pos"), F.count("*").alias("n"))
    ends = ties.agg(F.min("score").alias("lo"), F.max("score").alias("hi"), F.sum("pos").alias("all_pos"), F.sum("n").alias("all_n"))
    spread = ties.join(F.broadcast(ends))  # one row
    cell = F.least(F.floor((F.col("score") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-300)) * buckets), F.lit(buckets - 1))
    spread = spread.withColumn("cell", cell)
    sums = spread.groupBy("cell").agg(F.sum("pos").alias("cp"), F.sum("n").alias("cn"))
    above = Window.partitionBy(F.lit(0)).orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("cell", F.coalesce(F.sum("cp").over(above), F.lit(0)).alias("p0"), F.coalesce(F.sum("cn").over(above), F.lit(0)).alias("n0"))
    down = Window.partitionBy("cell").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = spread.join(F.broadcast(starts), "cell").withColumns({"tp": F.col("p0") + F.sum("pos").over(down), "seen": F.col("n0") + F.sum("n").over(down)})
    term = F.col("pos") / F.col("all_pos") * (F.col("tp") / F.col("seen"))
    return ranked.agg(
        F.coalesce(F.sum(F.when(F.col("all_pos") > 0, term)), F.lit(0.0)).alias("ap_raw"),
        F.coalesce(F.max(F.col("all_pos") / F.col("all_n")), F.lit(0.0)).alias("positive_rate"),
        F.coalesce(F.max("all_n"), F.lit(0)).alias("n"), F.coalesce(F.max("all_pos"), F.lit(0)).alias("n_pos"),
    )


def alarm_matches(alarms: DataFrame, accidents: DataFrame, window: float = ALARM_WINDOW) -> DataFrame:
    """(video_id, start, alarm, tta): accidents in order of start each take the earliest free
    alarm in [start - window, start); alarm null and tta 0 without one."""
    a = accidents.groupBy("video_id").agg(F.array_sort(F.collect_list("start")).alias("starts"))
    b = alarms.groupBy("video_id").agg(F.array_sort(F.collect_list("t_sec")).alias("free"))
    both = a.join(b, "video_id", "left").withColumn("free", F.coalesce("free", F.array().cast("array<double>")))
    zero = F.struct(F.col("free").alias("free"), F.array().cast("array<struct<start:double,alarm:double>>").alias("out"))

    def step(acc: Column, start: Column) -> Column:
        usable = F.filter(acc["free"], lambda t: (t >= start - window) & (t < start))
        alarm = F.try_element_at(usable, F.lit(1))
        # alarms are distinct times, so removing by value removes one
        left = F.when(alarm.isNull(), acc["free"]).otherwise(F.array_remove(acc["free"], F.coalesce(alarm, F.lit(-1e300))))
        return F.struct(left.alias("free"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), alarm.alias("alarm")))).alias("out"))

    folded = both.select("video_id", F.explode(F.aggregate("starts", zero, step, lambda acc: acc["out"])).alias("m"))
    return folded.select("video_id", "m.start", "m.alarm", F.coalesce(F.col("m.start") - F.col("m.alarm"), F.lit(0.0)).alias("tta"))


def risk_report(risk: DataFrame, gt: DataFrame) -> DataFrame:
    """One row with every number of the risk score; score_b is null without accidents.
    gt: video_id, label (accident, near_miss, ...), start, end."""
    accidents, near = gt.where("label = 'accident'"), gt.where("label = 'near_miss'")
    ap = average_precision(frame_labels(risk, accidents, near))
    starts = runs.alarm_starts(risk, THETA, ALARM_GAP)
    counted = frame_labels(starts.withColumn("score", F.lit(1.0)), accidents, near).where("y is not null")
    found = alarm_matches(counted.select("video_id", "t_sec"), accidents)
    totals = found.agg(F.count("*").alias("n_accidents"), F.count("alarm").alias("n_matched"), F.coalesce(F.sum("tta"), F.lit(0.0)).alias("tta"))
    n = counted.agg(F.count("*").alias("n_alarms"))
    one = ap.join(F.broadcast(totals)).join(F.broadcast(n))  # rows of aggregates, one each
    chance = F.when(F.col("positive_rate") < 1, F.greatest(F.lit(0.0), (F.col("ap_raw") - F.col("positive_rate")) / (1 - F.col("positive_rate")))).otherwise(0.0)
    p, r = s.ratio(F.col("n_matched"), F.col("n_alarms")), s.ratio(F.col("n_matched"), F.col("n_accidents"))
    out = one.withColumns({"ap": chance, "alarm_precision": p, "alarm_recall": r, "mtta": s.ratio(F.col("tta"), F.col("n_accidents"))})
    out = out.withColumn("f1_alarm", s.ratio(2 * F.col("alarm_precision") * F.col("alarm_recall"), F.col("alarm_precision") + F.col("alarm_recall")))
    score = WEIGHTS_B["ap"] * F.col("ap") + WEIGHTS_B["f1_alarm"] * F.col("f1_alarm") + WEIGHTS_B["mtta"] * F.least(F.lit(1.0), F.col("mtta") / ALARM_WINDOW)
    return out.withColumn("score_b", F.when(F.col("n_accidents") > 0, score)).drop("tta")


def model_score(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row from macro_score's and risk_report's: 0.7 a + 0.3 b, or a alone."""
    both = a.select("score_a").join(F.broadcast(b.select("score_b")))
    return both.select("score_a", "score_b", F.coalesce(WEIGHT_A * F.col("score_a") + WEIGHT_B * F.col("score_b"), F.col("score_a")).alias("model_score"))


def matched_listing(gt: DataFrame, pred: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(video_id, label, kind, start, end, best, other_start, other_end): kind tp (best: its IoU;
    other: the prediction), missed or false (best: the largest IoU with the other side, 0 if none)."""
    keys = ["video_id", "label"]
    m = matches(gt, pred, [threshold])
    a = numbered(gt, keys).select(*keys, F.col("ord").alias("g"), F.col("start").alias("gs"), F.col("end").alias("ge"))
    b = numbered(pred, keys).select(*keys, F.col("ord").alias("p"), F.col("start").alias("ps"), F.col("end").alias("pe"))
    met = overlapping(a, b, keys).withColumn("iou", s.tiou(F.col("gs"), F.col("ge"), F.col("ps"), F.col("pe")))
    tp = a.join(m, [*keys, "g"]).join(b, [*keys, "p"]).select(*keys, F.lit("tp").alias("kind"), F.col("gs").alias("start"), F.col("ge").alias("end"), F.col("iou").alias("best"), F.col("ps").alias("other_start"), F.col("pe").alias("other_end"))

    def rest(mine: DataFrame, side: str, kind: str, start: str, end: str) -> DataFrame:
        left = mine.join(m, [*keys, side], "left_anti")
        nearest = met.groupBy(*keys, side).agg(F.max("iou").alias("best"))
        none = F.lit(None).cast("double")
        return left.join(nearest, [*keys, side], "left").select(*keys, F.lit(kind).alias("kind"), F.col(start).alias("start"), F.col(end).alias("end"), F.coalesce("best", F.lit(0.0)).alias("best"), none.alias("other_start"), none.alias("other_end"))

    return tp.unionByName(rest(a, "g", "missed", "gs", "ge")).unionByName(rest(b, "p", "false", "ps", "pe"))


def confusions(gt: DataFrame, pred: DataFrame, least: float = 0.3) -> DataFrame:
    """Pairs of a true and a predicted segment of different labels with IoU >= least."""
    a = gt.select("video_id", F.col("label").alias("true_label"), F.col("start").alias("gs"), F.col("end").alias("ge"))
    b = pred.select("video_id", F.col("label").alias("pred_label"), F.col("start").alias("ps"), F.col("end").alias("pe"))
    both = overlapping(a, b, ["video_id"]).where("true_label <> pred_label")
    return both.withColumn("iou", s.tiou(F.col("gs"), F.col("ge"), F.col("ps"), F.col("pe"))).where(F.col("iou") >= least)


def error_analysis(gt: DataFrame, pred: DataFrame, videos: DataFrame, threshold: float = 0.5, least: float = 0.3) -> DataFrame:
    """(video_id, label, tp, fp, fn, matched, missed, false, confused), a row for each label of
    each video with truth: what a reader of errors needs of it. matched(start, end, best,
    other_start, other_end); missed and false (start, end, best) with the largest IoU they
    reached; confused (start, end, pred_label, pred_start, pred_end, iou): the label's segments
    that overlap predictions of others. All by time."""
    scored = scored_videos(pred, videos)
    listed = matched_listing(gt, scored, threshold)

    def those(kind: str, *columns: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct(*columns)))).alias({"tp": "matched"}.get(kind, kind))

    n = lambda kind, name: F.count_if(F.col("kind") == kind).alias(name)
    rows = listed.groupBy("video_id", "label").agg(n("tp", "tp"), n("false", "fp"), n("missed", "fn"), those("tp", "start", "end", "best", "other_start", "other_end"), those("missed", "start", "end", "best"), those("false", "start", "end", "best"))
    pair = F.struct(F.col("gs").alias("start"), F.col("ge").alias("end"), "pred_label", F.col("ps").alias("pred_start"), F.col("pe").alias("pred_end"), "iou")
    mixed = confusions(gt, scored, least).groupBy("video_id", F.col("true_label").alias("label")).agg(F.array_sort(F.collect_list(pair)).alias("confused"))
    return rows.join(mixed, ["video_id", "label"], "left").withColumn("confused", F.coalesce("confused", F.array().cast(mixed.schema["confused"].dataType)))


def error_totals(gt: DataFrame, pred: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(label, tp, fp, fn, precision, recall, f1) of every label that occurs, over all videos."""
    per = counts(gt, pred, [threshold]).groupBy("label").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return per.withColumns(s.prf(F.col("tp"), F.col("fp"), F.col("fn")))


def missing_and_extra(gt_videos: DataFrame, pred_videos: DataFrame) -> DataFrame:
    """(video_id, problem): missing from the predictions, or extra in them."""
    a, b = gt_videos.select("video_id").distinct(), pred_videos.select("video_id").distinct()
    return a.join(b, "video_id", "left_anti").withColumn("problem", F.lit("missing")).union(b.join(a, "video_id", "left_anti").withColumn("problem", F.lit("extra")))
