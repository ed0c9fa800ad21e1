"""Exploratory series: counts, densities, heatmaps, trajectories, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadgrain.functions import scalars as s
from roadgrain.operators import kinematics

LABELS = ("jaywalking", "stopped_vehicle", "wrong_way", "congestion")


def event_counts(segments: DataFrame) -> DataFrame:
    return segments.groupBy("label").agg(F.count("*").alias("n"))


def object_counts(tracks: DataFrame, *more: Column) -> DataFrame:
    """(video_id, t_sec, person, bicycle, ..., more): boxes per time and class, zeros filled, and
    more aggregates of the same rows."""
    names = list(s.CLASS_NAMES.items())
    return tracks.groupBy("video_id", "t_sec").agg(*[F.count_if(F.col("cls") == c).alias(n) for c, n in names], *more)


def object_series(tracks: DataFrame) -> DataFrame:
    """(video_id, t_sec, class, n): object_counts as rows, without the classes that a video
    never has."""
    names = list(s.CLASS_NAMES.values())
    each = object_counts(tracks).select("video_id", "t_sec", F.explode(F.array(*[F.struct(F.lit(n).alias("class"), F.col(n).alias("n")) for n in names])).alias("x")).select("video_id", "t_sec", "x.*")
    return each.withColumn("most", F.max("n").over(Window.partitionBy("video_id", "class"))).where("most > 0").drop("most")


def density(tracks: DataFrame, groups: Sequence[str]) -> DataFrame:
    """(video_id, t_sec, group..., other): vehicles per time and direction (column direction)."""
    known = F.col("direction").isin(list(groups))
    columns = [F.count_if(F.col("direction") == g).alias(g) for g in groups] + [F.count_if(F.coalesce(~known, F.lit(True))).alias("other")]
    return tracks.groupBy("video_id", "t_sec").agg(*columns)


def motion_heatmap(tracks: DataFrame, width: int, height: int, cell: int = 8, least_speed: float = 0.5) -> DataFrame:
    """(video_id, bx, by, n): moving ground points per cell; the far edges belong to the last
    cell, points outside are left out."""
    rows = kinematics.with_sustained_speed(tracks).where((F.col("sustained_speed") > least_speed * s.box_height()) & (F.col("sustained_speed") < float("inf")))
    nx, ny = max(1, width // cell), max(1, height // cell)
    inside = rows.where(F.col("gx").between(0, width) & F.col("gy").between(0, height))
    bx = F.least(F.floor(F.col("gx") / (width / nx)), F.lit(nx - 1))
    by = F.least(F.floor(F.col("gy") / (height / ny)), F.lit(ny - 1))
    return inside.groupBy("video_id", bx.alias("bx"), by.alias("by")).agg(F.count("*").alias("n"))


def clip_summary(tracks: DataFrame) -> DataFrame:
    """Per video: tracks, boxes, samples, boxes per sample, and tracks per class."""
    tracked = F.when(F.col("track_id") >= 0, F.col("track_id"))
    per_class = [F.count_distinct(F.when(F.col("cls") == c, tracked)).alias(f"{n}_tracks") for c, n in s.CLASS_NAMES.items()]
    out = tracks.groupBy("video_id").agg(F.count_distinct(tracked).alias("tracks"), F.count("*").alias("boxes"), F.count_distinct("t_sec").alias("samples"), *per_class)
    return out.withColumn("per_sample", F.col("boxes") / F.col("samples"))


def tracks_per_bin(tracks: DataFrame, seconds: float = 5.0) -> DataFrame:
    """(video_id, bin, n): different tracks per bin of time."""
    return tracks.where("track_id >= 0").groupBy("video_id", F.floor(F.col("t_sec") / seconds).alias("bin")).agg(F.count_distinct("track_id").alias("n"))


def track_sketches(tracks: DataFrame, seconds: float = 5.0, lg_k: int = 12) -> DataFrame:
    """(video_id, bin, sketch): a mergeable sketch of the different tracks of each bin of time.
    Sketches add up to any longer span or to several videos; the relative error of what is
    read from them is about 1 / sqrt(2 ** lg_k), however many tracks there are."""
    key = F.xxhash64("video_id", "track_id")
    return tracks.where("track_id >= 0").groupBy("video_id", F.floor(F.col("t_sec") / seconds).alias("bin")).agg(F.hll_sketch_agg(key, lg_k).alias("sketch"))


def rolled_up(sketches: DataFrame, factor: int, keys: Sequence[str] = ("video_id",)) -> DataFrame:
    """(keys, bin, n, sketch): the sketches of every ``factor`` bins, and of all rows with equal
    keys, in one, and about how many tracks it has."""
    out = sketches.groupBy(*keys, F.floor(F.col("bin") / factor).alias("bin")).agg(F.hll_union_agg("sketch").alias("sketch"))
    return out.withColumn("n", F.hll_sketch_estimate("sketch"))


def track_marks(tracks: DataFrame, seconds: float = 5.0) -> DataFrame:
    """(video_id, bin, track_id): the different tracks of each bin of time, a row each. They add
    up to longer spans exactly, where sketches may be off at any count."""
    return tracks.where("track_id >= 0").select("video_id", F.floor(F.col("t_sec") / seconds).alias("bin"), "track_id").distinct()


def marks_rolled_up(marks: DataFrame, factor: int) -> DataFrame:
    """(video_id, bin, n): how many different tracks every ``factor`` bins have."""
    wide = marks.select("video_id", F.floor(F.col("bin") / factor).alias("bin"), "track_id").distinct()
    return wide.groupBy("video_id", "bin").agg(F.count("*").alias("n"))


def trajectories(tracks: DataFrame, least: int = 4) -> DataFrame:
    """(video_id, track_id, n, points, net_heading): each track's points in order of time, and
    the direction from its first to its last."""
    point = F.struct(F.col("t_sec").alias("t"), F.col("gx").alias("x"), F.col("gy").alias("y"))
    rows = tracks.where("track_id >= 0").groupBy("video_id", "track_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(point)).alias("points"))
    ends = F.element_at("points", -1), F.element_at("points", 1)
    return rows.where(F.col("n") >= least).withColumn("net_heading", F.atan2(ends[0]["y"] - ends[1]["y"], ends[0]["x"] - ends[1]["x"]))


def timeline(segments: DataFrame, risk: DataFrame, hints: DataFrame) -> DataFrame:
    """(video_id, extent, lanes): the length to draw, and per label in the official order its
    segments. hints: video_id, hint (a duration, may be null)."""
    a = segments.groupBy("video_id").agg(F.max("end").alias("e"))
    b = risk.groupBy("video_id").agg(F.max("t_sec").alias("t"))
    order = F.array_position(F.array(*[F.lit(x) for x in LABELS]), F.col("label"))
    lanes = segments.groupBy("video_id", "label").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("segments")).withColumn("ord", order)
    lanes = lanes.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("ord", "label", "segments"))).alias("lanes"))
    one = hints.join(a, "video_id", "left").join(b, "video_id", "left").join(lanes, "video_id", "left")
    return one.select("video_id", F.greatest(F.coalesce("e", F.lit(0.0)), F.coalesce("t", F.lit(0.0)), F.coalesce("hint", F.lit(0.0)), F.lit(1.0)).alias("extent"), "lanes")


def all_zero_risk(risk: DataFrame) -> DataFrame:
    """(video_id, all_zero): whether every score of a video is 0."""
    return risk.groupBy("video_id").agg((F.max(F.abs("score")) == 0).alias("all_zero"))


def active_at(segments: DataFrame, times: DataFrame, width: float = 60.0) -> DataFrame:
    """(video_id, t_sec, label) of segments with start <= t < end."""
    from roadgrain.operators.intervals import points_in_intervals

    return points_in_intervals(times, segments.select("video_id", "label", "start", "end"), width)


def longest_per_group(rows: DataFrame, keys: Sequence[str], length: str, k: int) -> DataFrame:
    """The k rows of the largest ``length`` per key (ties: by start)."""
    w = Window.partitionBy(*keys).orderBy(F.desc(length), "start")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
