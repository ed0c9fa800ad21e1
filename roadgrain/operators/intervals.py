"""Interval algebra over segments(video_id, label, start, end, score, track_ids)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("video_id", "label")


def clamp(segments: DataFrame, duration: Column | str = "duration") -> DataFrame:
    """Segments cut to [0, duration]; what is left without length goes."""
    end = F.col(duration) if isinstance(duration, str) else duration
    cut = segments.withColumns({"start": F.greatest(F.col("start"), F.lit(0.0)), "end": F.least(F.col("end"), end)})
    return cut.where("end > start")


def drop_blips(segments: DataFrame, least: float = 0.5) -> DataFrame:
    return segments.where(F.col("end") - F.col("start") >= least)


def merge(segments: DataFrame, gap: float = 1.0, strict: bool = False, keys: Sequence[str] = KEYS) -> DataFrame:
    """Unions of segments of a key whose gap to all before them is at most ``gap`` (strict:
    under it). The largest score and all track ids stay."""
    order = Window.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    space = F.col("start") - before
    fresh = F.when((space >= gap) if strict else (space > gap), 1).otherwise(0)
    marked = segments.withColumn("__fresh", fresh).withColumn("__group", F.sum("__fresh").over(order))
    aggregates = [F.min("start").alias("start"), F.max("end").alias("end")]
    if "score" in segments.columns:
        aggregates.append(F.max("score").alias("score"))
    if "track_ids" in segments.columns:
        aggregates.append(F.array_sort(F.array_distinct(F.flatten(F.collect_list("track_ids")))).alias("track_ids"))
    return marked.groupBy(*keys, "__group").agg(*aggregates).drop("__group")


def enforce_no_overlap(segments: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Overlapping segments of a key become their union; touching ones stay apart."""
    return merge(segments, 0.0, strict=True, keys=keys)


def overlaps(segments: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Segments that begin before the one before them (by start, end, and pos where there is
    one) has ended: violations."""
    order = Window.partitionBy(*keys).orderBy("start", "end", *[c for c in ("pos",) if c in segments.columns])
    return segments.withColumn("previous_end", F.lag("end").over(order)).where("start < previous_end")


def finalise(segments: DataFrame, merge_gap: float = 1.0, least: float = 0.5) -> DataFrame:
    """Clamp to the duration column, merge, drop blips, and undo overlaps, in that order:
    a fragment may be rescued by merging before it is judged as a blip."""
    kept = clamp(segments).drop("duration")
    return enforce_no_overlap(drop_blips(merge(kept, merge_gap), least))


def assert_no_overlap(segments: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """segments; reading a row that overlaps its predecessor raises an error."""
    order = Window.partitionBy(*keys).orderBy("start", "end")
    bad = F.coalesce(F.col("start") < F.lag("end").over(order), F.lit(False))
    return segments.withColumn("__bad", bad).where(F.when(F.col("__bad"), F.raise_error(F.lit("segments overlap"))).isNull()).drop("__bad")


def clean_events(events: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Adds reason (null: kept) and kept to events(video_id, pos, start, end, label, duration).

    Numbers are needed; the label must be known; the end is cut to the duration;
    0 <= start < end. Times are rounded to thousandths. Of overlapping segments
    of a label the earlier one stays: in order of start (ties: pos) a segment goes
    if it begins before the last kept one has ended, so this is a fold.
    """
    end = F.least(F.col("end"), F.col("duration"))
    reason = (
        F.when(F.col("start").isNull() | F.col("end").isNull() | F.isnan("start") | F.isnan("end"), "not numbers")
        .when(F.col("label").isNull() | ~F.col("label").isin(list(labels)), "unknown label")
        .when(~((F.col("start") >= 0) & (F.col("start") < end)), "bad times")
    )
    base = events.withColumns({"reason": reason, "__e": end})
    good = base.where("reason is null").select("video_id", "label", F.round("start", 3).alias("start"), "pos", F.round("__e", 3).alias("end"))
    seq = F.array_sort(F.collect_list(F.struct("start", "pos", "end")))
    zero = F.struct(F.lit(-1.0).alias("last"), F.array().cast("array<struct<start:double,pos:int,end:double,kept:boolean>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        keep = x["start"] >= acc["last"]
        row = F.struct(x["start"].alias("start"), x["pos"].cast("int").alias("pos"), x["end"].alias("end"), keep.alias("kept"))
        return F.struct(F.when(keep, x["end"]).otherwise(acc["last"]).alias("last"), F.concat(acc["out"], F.array(row)).alias("out"))

    folded = good.groupBy("video_id", "label").agg(seq.alias("seq")).select("video_id", "label", F.explode(F.aggregate("seq", zero, step, lambda a: a["out"])).alias("x"))
    decided = folded.select("video_id", "label", "x.start", "x.end", "x.pos", "x.kept", F.when(~F.col("x.kept"), "overlaps an earlier one").alias("reason"))
    dropped = base.where("reason is not null").select("video_id", "label", "start", "end", F.col("pos").cast("int").alias("pos"), F.lit(False).alias("kept"), "reason")
    return decided.unionByName(dropped)


def bucketed(df: DataFrame, start: Column, end: Column, width: float, name: str = "bucket") -> DataFrame:
    """df with one row for each bucket of time that [start, end] touches, so that an
    interval join becomes an equi-join with a residual condition."""
    return df.withColumn(name, F.explode(F.sequence(F.floor(start / width), F.floor(end / width))))


def overlapping(a: DataFrame, b: DataFrame, keys: Sequence[str], width: float = 60.0) -> DataFrame:
    """Pairs of a(keys, gs, ge) and b(keys, ps, pe) with gs < pe and ps < ge, each once: where
    both have begun, in the later one's first bucket."""
    x = bucketed(a, F.col("gs"), F.col("ge"), width, "__bucket")
    y = bucketed(b, F.col("ps"), F.col("pe"), width, "__bucket")
    begun = F.greatest(F.floor(F.col("gs") / width), F.floor(F.col("ps") / width))
    return x.join(y, [*keys, "__bucket"]).where("gs < pe and ps < ge").where(F.col("__bucket") == begun).drop("__bucket")


def points_in_intervals(points: DataFrame, intervals: DataFrame, width: float = 60.0, closed: bool = False) -> DataFrame:
    """Pairs of points(video_id, t_sec) and intervals(video_id, start, end) with start <= t < end
    (closed: <= end)."""
    a = points.withColumn("__bucket", F.floor(F.col("t_sec") / width))
    b = bucketed(intervals, F.col("start"), F.col("end"), width, "__bucket")
    inside = (F.col("t_sec") >= F.col("start")) & ((F.col("t_sec") <= F.col("end")) if closed else (F.col("t_sec") < F.col("end")))
    return a.join(b, ["video_id", "__bucket"]).where(inside).drop("__bucket")


def rows_near(points: DataFrame, rows: DataFrame, reach: Column, width: float = 10.0) -> DataFrame:
    """Pairs of points(video_id, at) and rows(video_id, t_sec) at most ``reach`` (a column of
    points) apart."""
    a = bucketed(points.withColumn("__reach", reach), F.col("at") - F.col("__reach"), F.col("at") + F.col("__reach"), width, "__bucket")
    b = rows.withColumn("__bucket", F.floor(F.col("t_sec") / width))
    return a.join(b, ["video_id", "__bucket"]).where(F.abs(F.col("t_sec") - F.col("at")) <= F.col("__reach")).drop("__bucket", "__reach")


def padded(segments: DataFrame, pad: float = 2.0, clip_seconds: float = 20.0) -> DataFrame:
    """Adds clip_start, clip_end (padded, cut to the duration) and playback speed, which
    doubles for every begun ``clip_seconds``."""
    out = segments.withColumns({"clip_start": F.greatest(F.lit(0.0), F.col("start") - pad), "clip_end": F.least(F.col("duration"), F.col("end") + pad)})
    return out.withColumn("playback", 2 * F.ceil((F.col("clip_end") - F.col("clip_start")) / clip_seconds))


def as_of_backward(samples: DataFrame, queries: DataFrame) -> DataFrame:
    """queries(video_id, at) with score of the last sample at or before; null before the first."""
    rows = samples.selectExpr("video_id", "t_sec as t", "0 as side", "score").unionByName(queries.selectExpr("video_id", "at as t", "1 as side", "cast(null as double) as score"))
    w = Window.partitionBy("video_id").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("found", F.last("score", ignorenulls=True).over(w)).where("side = 1").selectExpr("video_id", "t as at", "found as score")


def as_of_forward(samples: DataFrame, queries: DataFrame) -> DataFrame:
    """queries with score of the first sample at or after, of the last one if none is, 0
    without samples."""
    rows = samples.selectExpr("video_id", "t_sec as t", "1 as side", "score").unionByName(queries.selectExpr("video_id", "at as t", "0 as side", "cast(null as double) as score"))
    ahead = Window.partitionBy("video_id").orderBy(F.desc("t"), F.desc("side")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = samples.groupBy("video_id").agg(F.max_by("score", "t_sec").alias("last"))
    found = rows.withColumn("found", F.last("score", ignorenulls=True).over(ahead)).where("side = 0")
    return found.join(last, "video_id", "left").select("video_id", F.col("t").alias("at"), F.coalesce("found", "last", F.lit(0.0)).alias("score"))
