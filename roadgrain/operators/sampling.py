"""Choosing frames, and statistics of how a video was sampled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadgrain.functions import scalars as s


def every_nth_frame(rows: DataFrame, stride: Column | int) -> DataFrame:
    return rows.where(F.col("frame_idx") % (F.lit(stride) if isinstance(stride, int) else stride) == 0)


def keyframes(frames: DataFrame) -> DataFrame:
    return frames.where("is_keyframe")


def min_step(frames: DataFrame, least: int) -> DataFrame:
    """(video_id, frame_idx) of frames at least ``least`` after the last one kept: a fold."""

    def step(acc: Column, f: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        return F.when(last.isNull() | (f - last >= least), F.concat(acc, F.array(f))).otherwise(acc)

    seq = F.array_sort(F.collect_set(F.col("frame_idx").cast("long")))
    kept = F.aggregate("seq", F.array().cast("array<long>"), step)
    return frames.groupBy("video_id").agg(seq.alias("seq")).select("video_id", F.explode(kept).alias("frame_idx"))


def sampling_policy(videos: DataFrame, longest_gap: float = 1.0, interval: float = 0.5) -> DataFrame:
    """Adds policy: 'interval' (one sample per ``interval`` seconds) where the keyframe gap, in
    frames, is unknown or long, else 'keyframes'."""
    gap = F.col("median_gop") / s.frame_rate()
    return videos.withColumns({"policy": F.when(gap.isNull() | (gap > longest_gap), "interval").otherwise("keyframes"), "interval_frames": F.greatest(F.lit(1), F.rint(interval * s.frame_rate()).cast("int"))})


def sample_step_of(frames: DataFrame, use_max: bool = False) -> DataFrame:
    """(video_id, step): median (or largest) gap between consecutive sampled frames, at least 1."""
    w = Window.partitionBy("video_id").orderBy("frame_idx")
    gaps = frames.select("video_id", "frame_idx").distinct().withColumn("gap", F.col("frame_idx") - F.lag("frame_idx").over(w))
    agg = F.max("gap").cast("double") if use_max else F.median("gap")
    return gaps.groupBy("video_id").agg(F.greatest(F.lit(1.0), F.coalesce(agg, F.lit(1.0))).alias("step"))


def keyframe_intervals(packets: DataFrame) -> DataFrame:
    """Per video of packets(video_id, pos, pts, is_keyframe, picture): keyframes, least,
    median and largest distance between them in packets, and reordered packets."""
    w = Window.partitionBy("video_id").orderBy("pos")
    marked = packets.withColumn("reordered", F.col("pts") < F.lag("pts").over(w))
    keys = marked.where("is_keyframe").withColumn("gop", F.col("pos") - F.lag("pos").over(w)).groupBy("video_id").agg(
        F.count("*").alias("keyframes"), F.min("gop").alias("min_gop"), F.median("gop").alias("median_gop"), F.max("gop").alias("max_gop")
    )
    return marked.groupBy("video_id").agg(F.count("*").alias("packets"), F.count_if("reordered").alias("reordered")).join(keys, "video_id", "left")


def picture_types(packets: DataFrame) -> DataFrame:
    return packets.groupBy("video_id", "picture").agg(F.count("*").alias("n"))


def decimated(risk: DataFrame, per_second: float = 5.0) -> DataFrame:
    """Every n-th sample of a video, n = its frame rate over ``per_second``, at least 1."""
    w = Window.partitionBy("video_id").orderBy("t_sec")
    step = F.greatest(F.lit(1), F.rint(s.frame_rate() / per_second).cast("int"))
    return risk.withColumn("__rn", F.row_number().over(w) - 1).where(F.col("__rn") % step == 0).drop("__rn")


def min_max_decimated(risk: DataFrame, most: int = 600) -> DataFrame:
    """Per bucket of a video's samples the first, least, largest and last (the first of ties);
    all samples where there are no more than ``most``."""
    w = Window.partitionBy("video_id").orderBy("t_sec")
    whole = Window.partitionBy("video_id")
    rows = risk.withColumns({"__rn": F.row_number().over(w) - 1, "__n": F.count("*").over(whole)})
    size = F.ceil(F.col("__n") / F.lit(max(1, most // 4)))
    rows = rows.withColumn("__b", F.floor(F.col("__rn") / size))
    b = Window.partitionBy("video_id", "__b")
    ends = [F.min("__rn").over(b), F.max("__rn").over(b), F.min(F.struct("score", "__rn")).over(b)["__rn"], -F.max(F.struct("score", -F.col("__rn"))).over(b)["col2"]]
    chosen = F.col("__n") <= most
    for i, e in enumerate(ends):
        rows = rows.withColumn(f"__e{i}", e)
        chosen = chosen | (F.col("__rn") == F.col(f"__e{i}"))
    return rows.where(chosen).select(*risk.columns)


def times_to_frames(videos: DataFrame, frames: DataFrame, n: int = 9) -> DataFrame:
    """(video_id, frame_idx): for n times spread over a video's duration the first sampled
    frame at or after each; times hit by one frame collapse."""
    targets = videos.select("video_id", F.explode(s.sample_times(F.col("duration"), n)).alias("target"))
    pairs = targets.join(frames.select("video_id", "frame_idx", "t_sec"), "video_id").where("t_sec >= target")
    return pairs.groupBy("video_id", "target").agg(F.min_by("frame_idx", "t_sec").alias("frame_idx")).select("video_id", "frame_idx").distinct()


def frame_audit(frames: DataFrame) -> DataFrame:
    """Per video of frames(video_id, frame_no, pos_ms, width, height, fps): decoded frames,
    whether size is constant and time never falls, and the duration they prove."""
    w = Window.partitionBy("video_id").orderBy("frame_no")
    marked = frames.withColumn("back", F.col("pos_ms") < F.lag("pos_ms").over(w))
    fps = F.max(s.frame_rate())
    return marked.groupBy("video_id").agg(
        F.count("*").alias("frames"), (F.count_distinct("width", "height") == 1).alias("constant_size"), (F.count_if("back") == 0).alias("monotone"),
        F.greatest(F.count("*") / fps, F.max("pos_ms") / 1000 + 1 / fps).alias("duration"),
    )
