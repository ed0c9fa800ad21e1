"""Collision risk per video from tracked boxes: the batch form of the streaming job.

Every sample's score is 0.5 ** (time to collision / half-life) of its most
urgent pair; the risk is the least of the last few samples' scores, and frames
between samples hold it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadgrain.functions import scalars as s
from roadgrain.operators import kinematics


@dataclass(frozen=True)
class Risk:
    """Lengths in mean box heights, times in seconds."""

    every: int = 6
    least_span: float = 0.4
    most_span: float = 1.5
    radius: float = 0.4
    min_closing: float = 3.0
    half_life: float = 0.5
    persist: int = 3


def with_pair_score(pairs: DataFrame, th: Risk) -> DataFrame:
    """Adds score for the pairs' structs a and b of id, x, y, vx, vy, h, person; null if a pair is no
    danger. In steps: as one formula it makes a method too long to be compiled."""
    terms = {f"__{n}": s.settled(F.col(f"b.{p}") - F.col(f"a.{p}")) for n, p in (("rx", "x"), ("ry", "y"), ("wx", "vx"), ("wy", "vy"))}
    apart = (F.col("a.id") != F.col("b.id")) & ~(F.col("a.person") & F.col("b.person"))
    out = pairs.withColumns(terms | {"__size": s.settled((F.col("a.h") + F.col("b.h")) / 2), "__apart": s.settled(apart)}).drop("a", "b")
    rx, ry, wx, wy, size = (F.col(f"__{n}") for n in ("rx", "ry", "wx", "wy", "size"))
    out = out.withColumns({"__ww": s.settled(wx * wx + wy * wy), "__rw": s.settled(rx * wx + ry * wy), "__dist": s.settled(F.hypot(rx, ry))})
    out = out.withColumn("__t", s.settled(F.when(F.col("__apart") & (F.col("__ww") > 1e-9), -F.col("__rw") / F.col("__ww"))))
    t, closing = F.col("__t"), F.when(F.col("__dist") > 1e-9, -F.col("__rw") / F.col("__dist")).otherwise(0.0)
    danger = (t > 0) & (closing >= th.min_closing * size) & (F.hypot(rx + wx * t, ry + wy * t) <= th.radius * size)
    out = out.withColumn("score", s.settled(F.when(danger, F.pow(F.lit(0.5), t / th.half_life))))
    return out.drop(*terms, "__size", "__apart", "__ww", "__rw", "__dist", "__t")


def sample_scores(tracks: DataFrame, th: Risk | None = None) -> DataFrame:
    """(video_id, frame_idx, t_sec, raw) for every sampled frame with tracked boxes: the
    largest pair score, 0 without a dangerous pair."""
    th = th or Risk()
    rows = kinematics.history_velocity(tracks.where("track_id >= 0"), th.least_span, th.most_span)
    rows = rows.select("video_id", "frame_idx", "t_sec", "track_id", F.struct(F.col("gx").alias("x"), F.col("gy").alias("y"), F.col("hx").alias("vx"), F.col("hy").alias("vy"), (F.col("y2") - F.col("y1")).alias("h"), (F.col("cls") == s.PERSON).alias("person")).alias("o"))
    # a frame's boxes are gathered once and each pair of them is a row: samples and velocities are
    # worked out once, and no side of a join is held. A pair's score is the same from both sides
    live = F.when(F.col("o.vx").isNotNull(), F.struct(F.col("track_id").alias("id"), "o.*"))
    frames = rows.groupBy("video_id", "frame_idx").agg(F.min("t_sec").alias("t_sec"), F.collect_list(live).alias("all"))
    keys = ["video_id", "frame_idx", "t_sec"]
    one = frames.select(*keys, "all", F.posexplode_outer("all").alias("i", "a"))
    two = one.select(*keys, "a", F.explode_outer(F.slice("all", F.col("i") + 2, F.greatest(F.size("all") - F.col("i") - 1, F.lit(0)))).alias("b"))
    return with_pair_score(two, th).groupBy("video_id", "frame_idx").agg(F.min("t_sec").alias("t_sec"), F.coalesce(F.max("score"), F.lit(0.0)).alias("raw"))


def persistent_risk(samples: DataFrame, persist: int = 3) -> DataFrame:
    """samples with score: the least raw value of the last ``persist`` samples, 0 before so many."""
    w = Window.partitionBy("video_id").orderBy("frame_idx").rowsBetween(-(persist - 1), Window.currentRow)
    return samples.withColumn("score", F.when(F.count("*").over(w) >= persist, F.min("raw").over(w)).otherwise(0.0))


def held_risk(ticks: DataFrame, samples: DataFrame, default: float = 0.0) -> DataFrame:
    """A score for every tick(video_id, frame_idx, t_sec): that of the last sample at or
    before it, the default before the first; cut to [0, 1] and rounded to 4 digits."""
    rows = ticks.select("video_id", "frame_idx", "t_sec").join(samples.select("video_id", "frame_idx", "score"), ["video_id", "frame_idx"], "left")
    w = Window.partitionBy("video_id").orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = F.coalesce(F.last(F.when(F.isnan("score"), default).otherwise(F.col("score")), ignorenulls=True).over(w), F.lit(default))
    return rows.select("video_id", "frame_idx", "t_sec", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), held)), 4).alias("score"))


def risk_curve(ticks: DataFrame, tracks: DataFrame, th: Risk | None = None) -> DataFrame:
    """ticks with the causal risk of every frame. Sampled frames are every ``th.every``-th
    frame_idx; one without boxes counts as a sample of 0."""
    th = th or Risk()
    scored = sample_scores(tracks.where(F.col("frame_idx") % th.every == 0), th).select("video_id", "frame_idx", "raw")
    grid = ticks.where(F.col("frame_idx") % th.every == 0).select("video_id", "frame_idx", "t_sec").join(scored, ["video_id", "frame_idx"], "left")
    return held_risk(ticks, persistent_risk(grid.withColumn("raw", F.coalesce("raw", F.lit(0.0))), th.persist))
