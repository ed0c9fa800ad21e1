"""Motion of tracks: smoothed velocity, sustained speed, resampling, line crossings.

tracks: video_id, track_id (-1: untracked), frame_idx, t_sec, gx, gy, ... All
windows are over one (video, track); untracked rows are dealt by frame as well,
so that they never gather in one partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadgrain.functions import geometry as g
from roadgrain.functions import scalars as s


#: A column that deals untracked rows by frame; windows that share it share a sort.
PART = "__part"


def _lone() -> Column:
    return F.when(F.col("track_id") < 0, F.col("frame_idx")).otherwise(-1)


def _part() -> list[Column]:
    return [F.col("video_id"), F.col("track_id"), _lone()]


def micros(t: str = "t_sec") -> Column:
    """Seconds as whole microseconds: range frames have exact ends on them."""
    return F.round(F.col(t) * 1_000_000).cast("long")


def with_ground_point(tracks: DataFrame) -> DataFrame:
    """Adds gx, gy, the middle of a box's lower side."""
    return tracks.withColumns({"gx": (F.col("x1") + F.col("x2")) / 2, "gy": F.col("y2").cast("double")})


def rescaled(detections: DataFrame, size: tuple[float, float], to: tuple[float, float]) -> DataFrame:
    """Boxes of frames of ``size`` (width, height) in the pixels of frames of ``to``; a
    missing track_id becomes -1."""
    sx, sy = to[0] / size[0], to[1] / size[1]
    scaled = {c: F.col(c) * F.lit(sx if c[0] == "x" else sy) for c in ("x1", "y1", "x2", "y2")}
    return detections.withColumns(scaled | {"track_id": F.coalesce("track_id", F.lit(-1).cast("long"))})


def with_kinematics(tracks: DataFrame, half: int = 1) -> DataFrame:
    """Adds vx, vy, speed, heading: centred differences over up to ``half`` rows to either
    side, over the whole track where those do not span any time. Untracked rows
    and tracks of one row have zeros."""
    order = Window.partitionBy(*_part()).orderBy("t_sec", "frame_idx")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # plain columns by offset, the track's ends where it has no such row: no frame is added up again a row
    sides, point = {"a": (F.lag, F.first), "b": (F.lead, F.last)}, ("t_sec", "gx", "gy")
    found = {f"__{n}": off(F.lit(True), half).over(order) for n, (off, _) in sides.items()}
    for n, (off, end) in sides.items():
        found |= {f"__{n}_{p}": off(p, half).over(order) for p in point} | {f"__{n}_end_{p}": end(p).over(whole) for p in point}
    value = lambda n, p, has: F.when(has, F.col(f"__{n}_{p}")).otherwise(F.col(f"__{n}_end_{p}"))
    near = value("b", "t_sec", F.col("__b")) - value("a", "t_sec", F.col("__a"))
    out = tracks.withColumns(found).withColumn("__close", s.settled(near <= 1e-6))
    use = {n: F.col(f"__{n}") & ~F.col("__close") for n in sides}
    out = out.withColumn("__dt", s.settled(value("b", "t_sec", use["b"]) - value("a", "t_sec", use["a"])))
    live = (F.col("track_id") >= 0) & (F.col("__dt") > 1e-6)
    out = out.withColumns({v: s.settled(F.when(live, (value("b", p, use["b"]) - value("a", p, use["a"])) / F.col("__dt")).otherwise(0.0)) for v, p in (("vx", "gx"), ("vy", "gy"))})
    out = out.withColumns({"speed": F.hypot("vx", "vy"), "heading": F.when((F.col("vx") == 0) & (F.col("vy") == 0), 0.0).otherwise(F.atan2("vy", "vx"))})
    return out.drop("__close", "__dt", *found)


def _share(outer: Column | dict[str, Column], inner: Column | dict[str, Column], when: Column) -> Column:
    """How far a time lies from the outer to the inner of two samples; null without an outer one."""
    return F.when((outer["t_sec"] != inner["t_sec"]) & outer["t_sec"].isNotNull(), (when - outer["t_sec"]) / (inner["t_sec"] - outer["t_sec"]))


def _at(outer: Column | dict[str, Column], inner: Column | dict[str, Column], when: Column, w: Column) -> Column:
    """The point at a time between two samples; the inner sample where there is no outer one."""
    mid = lambda p: F.when(w.isNull(), inner[p]).otherwise(outer[p] + w * (inner[p] - outer[p]))
    return F.struct(F.when(w.isNull(), inner["t_sec"]).otherwise(when).alias("t_sec"), mid("gx").alias("gx"), mid("gy").alias("gy"))


def with_sustained_speed(tracks: DataFrame, window_sec: float = 2.0, also: Sequence[str] = (), ordered: bool = False) -> DataFrame:
    """Adds sustained_speed: net movement between the interpolated positions half a window
    before and after (cut to the track), by the time between them. Infinite for
    untracked rows and tracks that span no time. also: columns that part a track's rows too.

    The later side's outer sample is the one after its inner one: a frame that reaches to the
    end of a partition would take quadratic time, and a descending order another sort. With
    ``ordered`` the columns of the order, PART and "__us", stay: persistent (runs) goes on in it.
    """
    half, reach = window_sec / 2, round(window_sec * 500_000)
    names = ("t_sec", "gx", "gy")
    point = F.struct(*names)
    rows = tracks.withColumns({PART: s.settled(_lone()), "__us": s.settled(micros())})
    keys = ["video_id", "track_id", PART, *also]
    fine, up = Window.partitionBy(*keys).orderBy("__us", "frame_idx"), Window.partitionBy(*keys).orderBy("__us")
    rows = rows.withColumn("__next", F.lead(F.struct("__us", *names)).over(fine))
    found = {
        "__back_outer": F.last(point).over(up.rangeBetween(Window.unboundedPreceding, -reach)), "__back_inner": F.first(point).over(up.rangeBetween(-reach, Window.currentRow)),
        "__ahead": F.last(F.struct("__us", *names, F.col("__next").alias("next"))).over(up.rangeBetween(Window.currentRow, reach)),
    }
    out = rows.withColumns(found)
    # a sample exactly half a window ahead is both the inner and the outer one
    exact = F.col("__ahead.__us") == F.col("__us") + reach
    out = out.withColumn("__exact", s.settled(exact))
    inner = {c: F.col(f"__ahead.{c}") for c in names}
    outer = {c: F.when(F.col("__exact"), F.col(f"__ahead.{c}")).otherwise(F.col(f"__ahead.next.{c}")) for c in names}
    back = F.col("__back_outer"), F.col("__back_inner"), F.col("t_sec") - half
    ahead = outer, inner, F.col("t_sec") + half
    out = out.withColumns({"__wa": s.settled(_share(*back)), "__wb": s.settled(_share(*ahead))})
    a, b = _at(*back, F.col("__wa")), _at(*ahead, F.col("__wb"))
    out = out.withColumns({"__a": s.settled(a), "__b": s.settled(b)})
    span = F.col("__b.t_sec") - F.col("__a.t_sec")
    moved = F.hypot(F.col("__b.gx") - F.col("__a.gx"), F.col("__b.gy") - F.col("__a.gy"))
    out = out.withColumn("sustained_speed", s.settled(F.when((F.col("track_id") >= 0) & (span > 1e-9), moved / span).otherwise(float("inf"))))
    return out.drop("__a", "__b", "__wa", "__wb", "__next", "__exact", *found, *(() if ordered else (PART, "__us")))


def resample_tracks(tracks: DataFrame, step_sec: float) -> DataFrame:
    """(video_id, track_id, k, t_sec, gx, gy) of every track on its own uniform grid, from
    its first time by steps to at most half a step after its last; values between
    samples are interpolated, the ends held."""
    key = ["video_id", "track_id"]
    order = Window.partitionBy(*key).orderBy("t_sec")
    rows = tracks.where("track_id >= 0").select(*key, "t_sec", "gx", "gy")
    rows = rows.withColumns({"__next": F.lead(F.struct("t_sec", "gx", "gy")).over(order), "__t0": F.min("t_sec").over(Window.partitionBy(*key))})
    # a sample answers for the grid points from it to the next sample (the last one, for half a step)
    low = F.ceil((F.col("t_sec") - F.col("__t0")) / step_sec - 1e-9).cast("long")
    high = F.when(F.col("__next").isNull(), F.ceil((F.col("t_sec") - F.col("__t0") + step_sec / 2) / step_sec - 1e-9)).otherwise(F.ceil((F.col("__next.t_sec") - F.col("__t0")) / step_sec - 1e-9)).cast("long") - 1
    grid = rows.withColumns({"__low": low, "__high": high}).where("__high >= __low").withColumn("k", F.explode(F.sequence("__low", "__high")))
    t = F.col("__t0") + F.col("k") * step_sec
    w = F.coalesce((t - F.col("t_sec")) / F.nullif(F.col("__next.t_sec") - F.col("t_sec"), F.lit(0.0)), F.lit(0.0))
    mid = lambda p: F.col(p) + w * (F.coalesce(F.col(f"__next.{p}"), F.col(p)) - F.col(p))
    return grid.select(*key, "k", t.alias("t_sec"), mid("gx").alias("gx"), mid("gy").alias("gy"))


def path_lengths(tracks: DataFrame) -> DataFrame:
    """(video_id, track_id, length): summed steps between consecutive samples."""
    order = Window.partitionBy("video_id", "track_id").orderBy("t_sec", "frame_idx")
    step = F.hypot(F.col("gx") - F.lag("gx").over(order), F.col("gy") - F.lag("gy").over(order))
    rows = tracks.where("track_id >= 0").select("video_id", "track_id", F.coalesce(step, F.lit(0.0)).alias("step"))
    return rows.groupBy("video_id", "track_id").agg(F.sum("step").alias("length"))


def line_crossings(tracks: DataFrame, line: Sequence[float], approach_side: int = 1) -> DataFrame:
    """Rows at which a track has just crossed a line: side (-1 or 1, where it ended) and
    inbound, whether it came from the approach side."""
    order = Window.partitionBy("video_id", "track_id").orderBy("t_sec", "frame_idx")
    before = tracks.where("track_id >= 0").withColumns({"__x": F.lag("gx").over(order), "__y": F.lag("gy").over(order)})
    # geometry.crossing_direction in steps: in one formula it makes methods too long to be compiled
    old, new = (F.col("__x"), F.col("__y")), (F.col("gx"), F.col("gy"))
    sides = before.withColumns({"__old": s.settled(g.side_of_line(*old, *line)), "__new": s.settled(g.side_of_line(*new, *line))}).where("__old <> __new")
    met = sides.withColumn("__met", s.settled(g.segments_intersect((*old, *new), line))).where("__met")
    out = met.withColumn("side", F.when(F.col("__new") != 0, F.col("__new")).otherwise(-F.col("__old")))
    return out.drop("__x", "__y", "__old", "__new", "__met").withColumn("inbound", F.col("side") == -approach_side)


def history_velocity(tracks: DataFrame, least_sec: float = 0.4, most_sec: float = 1.5) -> DataFrame:
    """Adds hx, hy: velocity against the newest earlier sample that is at least ``least_sec``
    and at most ``most_sec`` old; null without one."""
    window = Window.partitionBy(*_part()).orderBy("__us").rangeBetween(-round(most_sec * 1_000_000), -round(least_sec * 1_000_000))
    old = F.last(F.struct("t_sec", "gx", "gy")).over(window)
    out = tracks.withColumn("__us", micros()).withColumn("__old", F.when(F.col("track_id") >= 0, old))
    dt = F.col("t_sec") - F.col("__old.t_sec")
    return out.withColumns({"hx": (F.col("gx") - F.col("__old.gx")) / dt, "hy": (F.col("gy") - F.col("__old.gy")) / dt}).drop("__old", "__us")
