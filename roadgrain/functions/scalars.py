"""Scalar expressions over tracks, segments and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PERSON, BICYCLE, CAR, MOTORCYCLE, BUS, TRUCK = 0, 1, 2, 3, 5, 7
VEHICLES = (CAR, MOTORCYCLE, BUS, TRUCK)
CLASS_NAMES = {PERSON: "person", BICYCLE: "bicycle", CAR: "car", MOTORCYCLE: "motorcycle", BUS: "bus", TRUCK: "truck"}
DEFAULT_FPS = 25.0


def settled(c: str | Column) -> Column:
    """The column, worked out once: filters and expressions over it stop at what is not
    deterministic, where they would else repeat its formula until methods are too long to
    be compiled."""
    return F.when(F.spark_partition_id() >= 0, F.col(c) if isinstance(c, str) else c)


def apart(c: Column) -> Column:
    """The column, by a function without generated code: what is below it and what is above are
    methods of their own, where one for both would be too long to be compiled."""
    return F.get(F.transform(F.array(c), lambda x: x), F.lit(0))


def frame_rate(fps: Column | str = "fps") -> Column:
    """Frames a second; 25 where unknown or zero."""
    fps = F.col(fps) if isinstance(fps, str) else fps
    return F.coalesce(F.nullif(fps.cast("double"), F.lit(0.0)), F.lit(DEFAULT_FPS))


def sample_step(stride: Column | str = "frame_stride") -> Column:
    return F.greatest(F.lit(1), F.coalesce(F.col(stride) if isinstance(stride, str) else stride, F.lit(1)))


def span_seconds(start_frame: Column, end_frame: Column, fps: Column, stride: Column) -> Column:
    """Length of a run of frames: its last sample lasts one stride."""
    return (end_frame - start_frame + sample_step(stride)) / frame_rate(fps)


def frame_start(start_frame: Column, fps: Column) -> Column:
    return start_frame / frame_rate(fps)


def frame_end(end_frame: Column, fps: Column, stride: Column) -> Column:
    return (end_frame + sample_step(stride)) / frame_rate(fps)


def velocity_samples(fps: Column, stride: Column, seconds: float = 0.4) -> Column:
    """Samples in a velocity window, rounded half to even, at least two."""
    return F.greatest(F.lit(2), F.rint(seconds * frame_rate(fps) / sample_step(stride)).cast("int"))


def pts_to_frame(pts: Column, start_pts: Column, time_base: Column, fps: Column) -> Column:
    return F.rint((pts - start_pts) * time_base * fps).cast("long")


def sample_times(duration: Column, n: int = 9) -> Column:
    """n evenly spaced times from 0, the end left out."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i * duration / n)


def linker_buffer(seconds: Column | float, fps: Column, stride: Column) -> Column:
    """Samples for which a lost track is remembered."""
    seconds = seconds if isinstance(seconds, Column) else F.lit(seconds)
    return F.greatest(F.lit(1), F.ceil(seconds / (sample_step(stride) / frame_rate(fps))).cast("int"))


def box_height(y1: Column | str = "y1", y2: Column | str = "y2") -> Column:
    """The unit of length of a box: its height, at least one pixel."""
    return F.greatest(F.col(y2) - F.col(y1), F.lit(1.0)) if isinstance(y1, str) else F.greatest(y2 - y1, F.lit(1.0))


def cut_by_frame(width: Column, height: Column, margin: float = 2.0) -> Column:
    """Whether a box touches the left, right or lower border (not the upper)."""
    return (F.col("x1") <= margin) | (F.col("x2") >= width - margin) | (F.col("y2") >= height - margin)


def overlap_seconds(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(e1, e2) - F.greatest(s1, s2))


def tiou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Temporal intersection over union; 0 if the union is empty."""
    shared = overlap_seconds(s1, e1, s2, e2)
    union = (e1 - s1) + (e2 - s2) - shared
    return F.when(union > 0, shared / union).otherwise(0.0)


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def prf(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """precision, recall and f1; 0 where undefined."""
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {"precision": p, "recall": r, "f1": ratio(2 * p * r, p + r)}


def motion_similarity(dist: Column, h1: Column, h2: Column, person1: Column, person2: Column, reach_person: float, reach_vehicle: float, max_size_ratio: float) -> Column:
    """1 at no distance, 0 at the reach in mean box heights; 0 for different kinds or sizes."""
    h1, h2 = F.greatest(h1, F.lit(1e-3)), F.greatest(h2, F.lit(1e-3))
    reach = F.when(person1, reach_person).otherwise(reach_vehicle)
    near = F.greatest(F.lit(0.0), 1 - dist / ((h1 + h2) / 2) / reach)
    same = (person1 == person2) & (h2 / h1 < max_size_ratio) & (h2 / h1 > 1 / max_size_ratio)
    return F.when(same, near).otherwise(0.0)


def pretty_label(label: Column) -> Column:
    return F.replace(label, F.lit("_"), F.lit(" "))


def clock(seconds: Column, precise: bool = False) -> Column:
    """m:ss, or m:ss.hh from rounded hundredths."""
    if not precise:
        whole = F.floor(F.greatest(seconds, F.lit(0.0))).cast("long")
        return F.format_string("%d:%02d", F.floor(whole / 60).cast("long"), whole % 60)
    cents = F.floor(F.greatest(seconds, F.lit(0.0)) * 100 + 0.5).cast("long")
    return F.format_string("%d:%02d.%02d", F.floor(cents / 6000).cast("long"), F.floor(cents % 6000 / 100).cast("long"), cents % 100)


def safe_filename(name: Column, extensions: tuple[str, ...] = ("mp4", "mov", "avi", "mkv"), most: int = 120) -> Column:
    """A plain file name with a known extension: no path, no control characters."""
    ok = (F.length(name) <= most) & F.rlike(name, F.lit(r"(?i)^[^/\\\x00-\x1f\x7f]+\.(" + "|".join(extensions) + ")$")) & ~F.contains(name, F.lit(".."))
    return F.coalesce(ok, F.lit(False))


def safe_team(name: Column, most: int = 80) -> Column:
    ok = F.length(F.trim(name)).between(1, most) & ~F.rlike(name, F.lit(r"[\x00-\x1f\x7f]"))
    return F.coalesce(ok, F.lit(False))
