"""Partitioned tables of tracks and videos, content keys, and exports of series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Columns that every table of tracks has.
TRACK_KEYS = ("video_id", "track_id", "frame_idx")


def with_columns(tracks: DataFrame, columns: Sequence[str]) -> DataFrame:
    """tracks, if it has the columns; a table of another layout is refused by their names."""
    missing = [c for c in columns if c not in tracks.columns]
    if missing:
        raise ValueError(f"not such a table of tracks: no {', '.join(missing)}")
    return tracks


def write_tracks(tracks: DataFrame, path: str, mode: str = "overwrite", complete: DataFrame | None = None) -> None:
    """Parquet by camera and configuration, rows of a track together within a file: readers
    prune by camera_id, and by the statistics of video_id and frame_idx. Overwriting replaces
    only the partitions that tracks has rows of. Of videos that complete(video_id, ...) does
    not list, nothing is written."""
    rows = with_columns(tracks, TRACK_KEYS)
    if complete is not None:
        rows = rows.join(complete.select("video_id"), "video_id", "left_semi")
    keys = [c for c in ("camera_id", "config_key") if c in tracks.columns]
    sorted_rows = rows.repartition(*keys, "video_id").sortWithinPartitions("video_id", "track_id", "frame_idx")
    sorted_rows.write.mode(mode).option("partitionOverwriteMode", "dynamic" if keys else "static").partitionBy(*keys).parquet(path)


def read_tracks(spark: SparkSession, path: str, camera_id: str | None = None, config_key: str | None = None, columns: Sequence[str] = ()) -> DataFrame:
    """The tracks of all or one camera and configuration; columns: others that must be there."""
    rows = with_columns(spark.read.parquet(path), (*TRACK_KEYS, *columns))
    for c, v in (("camera_id", camera_id), ("config_key", config_key)):
        rows = rows.where(F.col(c) == v) if v is not None else rows
    return rows


def attach_videos(tracks: DataFrame, videos: DataFrame) -> DataFrame:
    """tracks with fps, frame_stride, width and height of their videos."""
    return tracks.join(videos.select("video_id", "fps", "frame_stride", "width", "height"), "video_id")


def content_key(size: Column, head: Column, tail: Column) -> Column:
    """24 hex digits of the SHA-256 of a file's size and its first and last bytes."""
    return F.substring(F.sha2(F.concat(size.cast("string").cast("binary"), head, tail), 256), 1, 24)


def config_key(columns: dict[str, Column]) -> Column:
    """16 hex digits of the SHA-256 of the sorted settings as JSON."""
    return F.substring(F.sha2(F.to_json(F.struct(*[columns[k].alias(k) for k in sorted(columns)])).cast("binary"), 256), 1, 16)


def write_series(series: DataFrame, path: str, key: str = "video_id", mode: str = "overwrite") -> None:
    """JSON lines in one folder per key; overwriting replaces only the keys that series has."""
    series.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(key).json(path)


def clip_bundles(videos: DataFrame, events: DataFrame, risk: DataFrame, counts: DataFrame, density: DataFrame, alarm_threshold: float = 0.5, rate: float = 5.0) -> DataFrame:
    """(video_id, duration, alarm_threshold, events, risk, counts, density, problems): all that is
    shown of a clip in one row, ready to be written as its document.

    videos(video_id, duration); events(video_id, start, end, label); risk(video_id,
    t_sec, score), thinned to about ``rate`` points a second, the first of every so
    many; counts and density: video_id, t_sec and numbers. Arrays are in order of
    time. problems names every fault: a series that is missing or empty, series of
    different lengths, repeated times, events or points outside the clip, a clip
    that videos lacks. A row holds one clip, so its size goes with the clip's length.
    """
    w = Window.partitionBy("video_id").orderBy("t_sec")
    whole = Window.partitionBy("video_id")
    span = F.max("t_sec").over(whole) - F.min("t_sec").over(whole)
    every = F.greatest(F.lit(1), F.round((F.count("*").over(whole) - 1) / F.nullif(span, F.lit(0.0)) / rate).cast("int"))
    thin = risk.withColumns({"__every": F.coalesce(every, F.lit(1)), "__row": F.row_number().over(w) - 1}).where("__row % __every = 0").drop("__every", "__row")

    def series(df: DataFrame, name: str, first: str) -> DataFrame:
        point = F.struct(first, *[c for c in df.columns if c not in ("video_id", first)])
        return df.groupBy("video_id").agg(F.array_sort(F.collect_list(point)).alias(name))

    out = videos.select("video_id", "duration", F.lit(True).alias("known"))
    for name, df, first in (("events", events.select("video_id", "start", "end", "label"), "start"), ("risk", thin, "t_sec"), ("counts", counts, "t_sec"), ("density", density, "t_sec")):
        out = out.join(series(df, name, first), "video_id", "full")
    sized = lambda c: F.coalesce(F.size(c), F.lit(0))
    times = lambda c: F.transform(c, lambda x: x["t_sec"])
    late = lambda c, end: F.exists(c, lambda x: (x[end] > F.col("duration") + 0.5) | (x[end] < 0))
    faults = [F.when(F.col("known").isNull(), "not in videos")]
    faults += [F.when(sized(c) == 0, f"no {c}") for c in ("risk", "counts", "density")]
    faults += [F.when((sized("counts") > 0) & (sized("density") > 0) & (sized("counts") != sized("density")), "counts and density differ in length")]
    faults += [F.when(sized(c) != F.size(F.array_distinct(times(c))), f"repeated times in {c}") for c in ("risk", "counts", "density")]
    faults += [F.when(late(c, end), f"{c} outside the clip") for c, end in (("events", "end"), ("risk", "t_sec"), ("counts", "t_sec"), ("density", "t_sec"))]
    empty = {"events": F.coalesce("events", F.array().cast(out.schema["events"].dataType))}
    return out.withColumns(empty).select("video_id", "duration", F.lit(alarm_threshold).alias("alarm_threshold"), "events", "risk", "counts", "density", F.array_compact(F.array(*faults)).alias("problems"))
