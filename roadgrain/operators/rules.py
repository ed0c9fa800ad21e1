"""Traffic events from tracks and a scene: pedestrians on the road, stopped vehicles,
wrong-way travel, congestion. Every rule returns frame segments
(video_id, label, start_frame, end_frame, fps, frame_stride, score, track_ids).

A scene is one camera's ``Scene``, or a ``SceneTable`` of many, whose key the tracks carry.
``prepared`` adds the zones and speeds that rules share; rules take them from there.

tracks: video_id, frame_idx, t_sec, track_id, cls, conf, x1, y1, x2, y2, gx, gy, fps,
frame_stride (and vx, vy, speed for wrong-way travel).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadgrain.functions import geometry as g
from roadgrain.functions import scalars as s
from roadgrain.operators import kinematics, runs
from roadgrain.operators.scenes import SceneTable
from roadgrain.operators.zones import Scene, border_list, zone_index

SEGMENT = ("video_id", "label", "start_frame", "end_frame", "fps", "frame_stride", "score", "track_ids")
RULES: dict[str, Callable[..., DataFrame]] = {}


# fixed values: the rules' thresholds; lengths in box heights (L)
@dataclass(frozen=True)
class Jaywalking:
    min_sec: float = 2.0
    gap_sec: float = 1.0
    min_conf: float = 0.45
    kerb_margin: float = 0.75
    crossing_margin: float = 0.25
    rider_share: float = 0.5


@dataclass(frozen=True)
class WrongWay:
    min_angle_deg: float = 135.0
    min_speed: float = 0.5
    min_sec: float = 2.5
    min_progress: float = 2.0
    gap_sec: float = 1.0
    min_conf: float = 0.40
    max_sample_sec: float = 0.2


@dataclass(frozen=True)
class Congestion:
    crawl_speed: float = 0.35
    min_vehicles: int = 4
    slow_share: float = 0.85
    min_sec: float = 30.0
    window_sec: float = 5.0
    gap_sec: float = 3.0
    group_tolerance_deg: float = 45.0
    max_sample_sec: float = 0.6
    persist_sec: float = 1.5
    min_distinct: int = 4


@dataclass(frozen=True)
class Stopped:
    min_sec: float = 10.0
    min_conf: float = 0.30
    max_speed: float = 0.6
    radius: float = 0.5
    max_gap_sec: float = 2.0
    max_drift: float = 0.6
    min_coverage: float = 0.6
    queue_margin: float = 0.5
    motion_evidence: float = 1.5
    neighbour: float = 1.5
    queue_share: float = 0.5
    kerb_margin: float = 0.3
    min_box_share: float = 0.02


RELAXED_WRONG_WAY = WrongWay(min_angle_deg=120.0, min_speed=0.3, min_sec=1.5, min_progress=1.0, min_conf=0.30, max_sample_sec=10.0)
RELAXED_CONGESTION = Congestion(min_vehicles=3, slow_share=0.6, min_sec=15.0, max_sample_sec=10.0)


def rule(label: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Registers a function (tracks, scene, th=None) -> frame segments."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        RULES[label] = f
        return f

    return add


def of_classes(tracks: DataFrame, classes: Sequence[int]) -> DataFrame:
    return tracks.where(F.col("cls").isin(list(classes)))


def vehicles(tracks: DataFrame) -> DataFrame:
    return of_classes(tracks, s.VEHICLES)


def persons(tracks: DataFrame) -> DataFrame:
    return of_classes(tracks, (s.PERSON,))


def dense_enough(tracks: DataFrame, max_sample_sec: float) -> DataFrame:
    """Rows of videos whose samples are no sparser than this."""
    return tracks.where(F.col("frame_stride") / s.frame_rate() <= max_sample_sec)


def _indexed(tracks: DataFrame, scene: Scene | SceneTable) -> DataFrame:
    if "on_road" in tracks.columns:
        return tracks
    return scene.index(tracks) if isinstance(scene, SceneTable) else zone_index(tracks, scene)


def _with_speed(rows: DataFrame, ordered: bool = False) -> DataFrame:
    return rows if "sustained_speed" in rows.columns else kinematics.with_sustained_speed(rows, ordered=ordered)


def _frame(scene: Scene | SceneTable) -> tuple[Column, Column]:
    return scene.frame() if isinstance(scene, SceneTable) else (F.lit(scene.width), F.lit(scene.height))


def _clear_of(rows: DataFrame, scene: Scene | SceneTable, kind: str, margin: Column) -> DataFrame:
    """The rows that lie ``margin`` or more from the edges of a kind of area."""
    if isinstance(scene, SceneTable):
        return scene.clear_of(rows, kind, margin)
    x, y = F.col("gx").cast("double"), F.col("gy").cast("double")
    close = lambda e: g.distance_to_segment(x, y, e["ax"], e["ay"], e["bx"], e["by"]) < margin
    return rows.where(~F.exists(border_list(scene, kind), close)) if getattr(scene, kind) else rows


_BOX = ("x1", "y1", "x2", "y2")


def with_vehicle_boxes(tracks: DataFrame, wanted: Column) -> DataFrame:
    """The wanted rows, none of them vehicles, with vehicles: the boxes of their frame's
    vehicles. A window instead of a join: a frame's vehicles are few, all vehicles many, and
    samples made from few rows look small enough to planners to be broadcast."""
    vehicle = F.col("cls").isin(list(s.VEHICLES))
    boxes = F.collect_list(F.when(vehicle & F.col("video_id").isNotNull() & F.col("frame_idx").isNotNull(), F.struct(*_BOX)))
    rows = tracks.withColumn("__wanted", s.settled(wanted)).where(vehicle | F.col("__wanted"))
    return rows.withColumn("vehicles", boxes.over(Window.partitionBy("video_id", "frame_idx"))).where("__wanted").drop("__wanted")


def vehicle_share(vehicle: Column) -> Column:
    """The share of the row's box that lies in a box of with_vehicle_boxes."""
    return g.box_share(_BOX, tuple(vehicle[c] for c in _BOX))


def prepared(tracks: DataFrame, scene: Scene | SceneTable) -> DataFrame:
    """tracks with the zone index, and the sustained speeds of vehicles, that the rules share."""
    moving = F.col("cls").isin(list(s.VEHICLES))
    return kinematics.with_sustained_speed(_indexed(tracks, scene).withColumn("__vehicle", moving), also=["__vehicle"]).drop("__vehicle")


def _named(found: DataFrame, label: str, score: Column, ids: Column) -> DataFrame:
    return found.withColumns({"label": F.lit(label), "score": score.cast("double"), "track_ids": ids.cast("array<long>")})


@rule("jaywalking")
def jaywalking(tracks: DataFrame, scene: Scene | SceneTable, th: Jaywalking | None = None) -> DataFrame:
    """Tracked people on the road, off the crossings and clear of kerbs, not riding."""
    th = th or Jaywalking()
    size = s.box_height()
    tracked = (F.col("cls") == s.PERSON) & (F.col("track_id") >= 0) & (F.col("conf") >= th.min_conf)
    on_foot = F.col("on_road") & ~F.col("in_crossing") & ~s.cut_by_frame(*_frame(scene))
    # plain polygons and known zones come first; a table's zones are a join, for those it concerns
    known = not isinstance(scene, SceneTable) or "on_road" in tracks.columns
    rows = _indexed(tracks, scene) if known else tracks
    rows = with_vehicle_boxes(rows, tracked & on_foot if known else tracked)
    rows = rows.where(~F.coalesce(F.exists("vehicles", lambda v: vehicle_share(v) >= th.rider_share), F.lit(False))).drop("vehicles")
    rows = rows if known else _indexed(rows, scene).where(on_foot)
    walking = _clear_of(_clear_of(rows, scene, "carriageway", th.kerb_margin * size), scene, "crossings", th.crossing_margin * size)
    found = runs.flag_runs(walking, ["video_id", "track_id"], F.lit(True), th.min_sec, th.gap_sec)
    return _named(found, "jaywalking", F.lit(1.0), F.array("track_id")).select(*SEGMENT)


def opposed(th: WrongWay) -> Column:
    """Whether a row, with its lane and velocity, is one of those that wrong_way makes runs of."""
    angle = g.heading_vs_lane(F.col("vx"), F.col("vy"), F.col("lane_dx"), F.col("lane_dy"))
    return (F.col("track_id") >= 0) & (F.col("speed") >= th.min_speed * s.box_height()) & F.col("lane_judged") & (F.col("conf") >= th.min_conf) & (angle >= th.min_angle_deg)


@rule("wrong_way")
def wrong_way(tracks: DataFrame, scene: Scene | SceneTable, th: WrongWay | None = None) -> DataFrame:
    """Tracks that move against their lane, by angle and by net progress along its axis.
    lane_id: the lane of most of a run's samples, the first drawn of equal ones."""
    th = th or WrongWay()
    rows = _indexed(vehicles(dense_enough(tracks, th.max_sample_sec)), scene)
    point = F.struct("gx", "gy")
    aggregates = [F.avg("lane_dx").alias("ax"), F.avg("lane_dy").alias("ay"), F.min_by(point, "frame_idx").alias("a"), F.max_by(point, "frame_idx").alias("b"), F.median(s.box_height()).alias("unit"), F.mode(F.struct("lane_ord", "lane_id"), True).alias("lane")]
    found = runs.flag_runs(rows, ["video_id", "track_id"], opposed(th), th.min_sec, th.gap_sec, aggregates)
    norm = F.hypot("ax", "ay")
    against = -((F.col("b.gx") - F.col("a.gx")) * F.col("ax") + (F.col("b.gy") - F.col("a.gy")) * F.col("ay")) / norm
    found = found.where((F.col("samples") >= 2) & (norm >= 1e-6)).withColumn("against", against)
    bar = th.min_progress * F.col("unit")
    found = found.where(F.col("against") >= bar)
    return _named(found, "wrong_way", F.least(F.lit(1.0), F.col("against") / F.greatest(bar, F.lit(1e-6))), F.array("track_id")).select(*SEGMENT, F.col("lane.lane_id").alias("lane_id"))


def direction_groups(scene: Scene, tolerance_deg: float = 45.0) -> dict[str, str]:
    """Lane id -> group: the named groups if any lane has one (lanes without are left out),
    else lanes by the first lane whose direction is within the tolerance, in drawing order."""
    named = {x.id: x.group for x in scene.lanes if x.group}
    if named:
        return named
    leaders: list[tuple[str, tuple[float, float]]] = []
    out = {}
    for lane in scene.lanes:
        (dx, dy), n = lane.direction, math.hypot(*lane.direction)
        for name, (lx, ly) in leaders:
            m = math.hypot(lx, ly)
            cosine = (dx * lx + dy * ly) / (n * m) if n > 0 and m > 0 else -1.0
            if math.degrees(math.acos(max(-1.0, min(1.0, cosine)))) <= tolerance_deg:
                out[lane.id] = name
                break
        else:
            leaders.append((f"cluster{len(leaders)}", lane.direction))
            out[lane.id] = leaders[-1][0]
    return out


def with_lane_direction_group(rows: DataFrame, scene: Scene | SceneTable, tolerance_deg: float = 45.0) -> DataFrame:
    """Adds direction, the group of the row's lane (null: none); a table's index has it."""
    if isinstance(scene, SceneTable):
        return rows
    pairs = [F.lit(x) for kv in direction_groups(scene, tolerance_deg).items() for x in kv]
    return rows.withColumn("direction", F.create_map(*pairs)[F.col("lane_id")] if pairs else F.lit(None).cast("string"))


def _every_direction(frames: DataFrame, scene: Scene | SceneTable, tolerance_deg: float) -> DataFrame:
    """frames times the direction groups of their scene."""
    if isinstance(scene, SceneTable):
        return scene.every_direction(frames, tolerance_deg)
    groups = sorted(set(direction_groups(scene, tolerance_deg).values()))
    return frames.withColumn("direction", F.explode(F.array(*[F.lit(x) for x in groups]) if groups else F.array().cast("array<string>")))


def congestion_grid(tracks: DataFrame, scene: Scene | SceneTable, th: Congestion) -> DataFrame:
    """Per frame with any vehicle and direction: total and slow countable vehicles, and the
    window's sums: (video_id, frame_idx, direction, total, slow, frames, w_total, w_slow, distinct).

    distinct counts the tracks that are slow somewhere in the window without holding their
    ids: a track's slow samples, each reaching half a window to both sides, cover intervals;
    where one opens the count rises, behind its end it falls, and a running sum is the count.
    """
    rows = _with_speed(vehicles(dense_enough(tracks, th.max_sample_sec)), ordered=True)
    rows = rows.withColumn("slow_now", F.col("sustained_speed") <= th.crawl_speed * s.box_height())
    rows = runs.persistent(rows, "slow_now", th.persist_sec)
    rows = with_lane_direction_group(_indexed(rows, scene), scene, th.group_tolerance_deg)
    countable = F.col("direction").isNotNull() & ~F.col("in_queue") & (F.col("track_id") >= 0)
    # frames in millionths of half a window: its two ends are whole numbers away
    half, reach = 1_000_000, th.window_sec * s.frame_rate()
    rows = rows.withColumns({"__at": F.round(2 * half * F.col("frame_idx").cast("double") / reach).cast("long"), "__slow": countable & F.col("persistent")})
    w = Window.partitionBy("video_id", "track_id", F.when(F.col("track_id") < 0, F.col("frame_idx")).otherwise(-1), "direction", "__slow").orderBy("__at")
    opens = F.col("__slow") & F.coalesce(F.col("__at") - F.lag("__at").over(w) > 2 * half + 1, F.lit(True))
    ends = F.col("__slow") & F.coalesce(F.lead("__at").over(w) - F.col("__at") > 2 * half + 1, F.lit(True))
    rows = rows.withColumns({"__opens": opens, "__ends": ends})
    key = [F.max(scene.key).alias(scene.key)] if isinstance(scene, SceneTable) and scene.key != "video_id" else []
    per = rows.groupBy("video_id", "frame_idx", F.when(countable, F.col("direction")).alias("direction")).agg(
        F.count("*").alias("total"), F.count_if("__slow").alias("slow"), F.count_if("__opens").alias("opens"), F.count_if("__ends").alias("ends"), F.max("__at").alias("at"), F.max("fps").alias("fps"), F.max("frame_stride").alias("frame_stride"), *key
    )
    more = [F.max(scene.key).alias(scene.key)] if key else []
    frames = per.groupBy("video_id", "frame_idx").agg(F.max("fps").alias("fps"), F.max("frame_stride").alias("frame_stride"), F.max("at").alias("at"), F.collect_list(F.struct("direction", "total", "slow", "opens", "ends")).alias("seen"), *more)
    # a row per frame and group, also where the group has no vehicle: zero-filled, without a join
    grid = _every_direction(frames, scene, th.group_tolerance_deg)
    mine = F.try_element_at(F.filter("seen", lambda x: x["direction"] == F.col("direction")), F.lit(1))
    grid = grid.withColumn("__mine", mine).withColumns({c: F.coalesce(F.col(f"__mine.{c}"), F.lit(0)).cast("long") for c in ("total", "slow", "opens", "ends")}).drop("__mine", "seen")
    zero = F.lit(0).cast("long")
    shown = F.struct(F.col("at"), F.lit(True).alias("shown"), F.col("total"), F.col("slow"), zero.alias("step"))
    change = lambda at, step: F.struct(at.alias("at"), F.lit(False).alias("shown"), zero.alias("total"), zero.alias("slow"), step.alias("step"))
    every = F.filter(F.array(shown, change(F.col("at") - half, F.col("opens")), change(F.col("at") + half + 1, -F.col("ends"))), lambda x: x["shown"] | (x["step"] != 0))
    dealt = grid.select("video_id", "direction", "frame_idx", "fps", "frame_stride", F.explode(every).alias("x")).select("video_id", "direction", "frame_idx", "fps", "frame_stride", "x.*")
    order = Window.partitionBy("video_id", "direction").orderBy("at")
    near = order.rangeBetween(-half, half)
    sums = {"frames": F.count_if("shown").over(near), "w_total": F.sum("total").over(near), "w_slow": F.sum("slow").over(near), "distinct": F.sum("step").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))}
    return dealt.withColumns(sums).where("shown").drop("at", "shown", "step")


@rule("congestion")
def congestion(tracks: DataFrame, scene: Scene | SceneTable, th: Congestion | None = None) -> DataFrame:
    """Directions on which, over a sliding window, enough vehicles are present, almost all
    crawl, and enough different ones do. Vehicles waiting at a signal do not count.
    peak_vehicles: the most at one sample between a jam's ends."""
    th = th or Congestion()
    grid = congestion_grid(tracks, scene, th)
    jam = (F.col("w_total") / F.col("frames") >= th.min_vehicles) & (F.col("w_slow") >= th.slow_share * F.col("w_total")) & (F.col("w_total") > 0)
    if th.min_distinct > 1:
        jam = jam & (F.col("distinct") >= th.min_distinct)
    keys = ["video_id", "direction"]
    spans = runs.bridged(grid, keys, jam, th.gap_sec)
    found = runs.flag_runs(spans, keys, F.lit(True), th.min_sec, th.gap_sec, [F.max("total").alias("peak_vehicles")])
    return _named(found, "congestion", F.lit(1.0), F.array()).select(*SEGMENT, "direction", "peak_vehicles")


def stop_candidates(tracks: DataFrame, scene: Scene | SceneTable, th: Stopped) -> DataFrame:
    """Vehicle rows that may be part of a stop."""
    rows = _indexed(_with_speed(vehicles(tracks)), scene)
    size = s.box_height()
    rows = rows.withColumns({"size": size, "calm": F.when(F.col("track_id") >= 0, F.col("sustained_speed")).otherwise(0.0)})
    cheap = F.col("on_road") & ~F.col("in_queue") & ~s.cut_by_frame(*_frame(scene)) & (F.col("size") >= th.min_box_share * _frame(scene)[1]) & (F.col("conf") >= th.min_conf) & (F.col("calm") <= th.max_speed * F.col("size"))
    return _clear_of(_clear_of(rows.where(cheap), scene, "carriageway", th.kerb_margin * F.col("size")), scene, "queues", th.queue_margin * F.col("size"))


def cluster_stops(session: dict[str, np.ndarray], gap: float, th: Stopped) -> list[dict]:
    """Stops of one session, in order of frames: a row joins the nearest open stop within
    the radius whose anchor it is not too far from, else it opens one."""
    stops: list[dict] = []
    live: list[dict] = []
    for f, x, y, size, tid in zip(*(session[k].tolist() for k in ("frame_idx", "gx", "gy", "size", "track_id")), strict=True):
        live = [c for c in live if f - c["last"] <= gap]
        near = []
        for k, c in enumerate(live):
            mean = c["l"] / c["n"]
            d = math.hypot(x - c["x"] / c["n"], y - c["y"] / c["n"])
            if d <= th.radius * mean and math.hypot(x - c["ax"], y - c["ay"]) <= th.max_drift * mean:
                near.append((d, k))
        if near:
            c = live[min(near)[1]]
        else:
            c = {"first": f, "ax": x, "ay": y, "x": 0.0, "y": 0.0, "l": 0.0, "n": 0, "ids": set(), "frames": set()}
            stops.append(c)
            live.append(c)
        c["last"], c["n"] = f, c["n"] + 1
        c["x"] += x
        c["y"] += y
        c["l"] += size
        c["ids"].add(tid)
        c["frames"].add(f)
    return stops


@rule("stopped_vehicle")
def stopped_vehicle(tracks: DataFrame, scene: Scene | SceneTable, th: Stopped | None = None) -> DataFrame:
    """Vehicles that stand on the road, outside queues, though they moved before or after.

    Only the order-dependent clustering runs in Python, on one session at a time:
    a gap in a video's candidates longer than any stop survives divides them
    exactly. Motion evidence and queue neighbours are joins.
    """
    th = th or Stopped()
    rows = stop_candidates(tracks, scene, th)
    gap = th.max_gap_sec * s.frame_rate() + s.sample_step()
    need = rows.select("video_id", "frame_idx", "gx", "gy", "size", "track_id", "fps", "frame_stride")
    sessions = runs.with_islands(need, ["video_id"], "frame_idx", gap)
    schema = "video_id string, stop long, first long, last long, x double, y double, size double, ids array<long>, frames long, fps double, frame_stride int"

    def cluster(table: pa.Table) -> pa.Table:
        table = table.sort_by([("frame_idx", "ascending"), ("track_id", "ascending"), ("gx", "ascending"), ("gy", "ascending")])
        fps, stride = table.column("fps")[0].as_py(), max(1, table.column("frame_stride")[0].as_py() or 1)
        columns = {k: table.column(k).to_numpy() for k in ("frame_idx", "gx", "gy", "size", "track_id")}
        found = cluster_stops(columns, th.max_gap_sec * (fps or s.DEFAULT_FPS) + stride, th)
        video, island = table.column("video_id")[0].as_py(), table.column("island")[0].as_py()
        out = [
            {"video_id": video, "stop": (island << 20) + k, "first": c["first"], "last": c["last"], "x": c["x"] / c["n"], "y": c["y"] / c["n"], "size": c["l"] / c["n"], "ids": sorted(c["ids"]), "frames": len(c["frames"]), "fps": fps, "frame_stride": stride}
            for k, c in enumerate(found)
        ]
        kinds = pa.schema([("video_id", pa.string()), ("stop", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("x", pa.float64()), ("y", pa.float64()), ("size", pa.float64()), ("ids", pa.list_(pa.int64())), ("frames", pa.int64()), ("fps", pa.float64()), ("frame_stride", pa.int32())])
        return pa.Table.from_pylist(out, kinds)

    need = sessions.select("video_id", "island", F.col("frame_idx").cast("long").alias("frame_idx"), "gx", "gy", F.col("size").cast("double").alias("size"), "track_id", F.col("fps").cast("double").alias("fps"), F.col("frame_stride").cast("int").alias("frame_stride"))
    stops = need.groupBy("video_id", "island").applyInArrow(cluster, schema)
    step = s.sample_step()
    long_enough = (F.col("last") - F.col("first") + step) / s.frame_rate() >= th.min_sec
    covered = F.col("frames") >= th.min_coverage * (F.floor((F.col("last") - F.col("first")) / step) + 1)
    stops = stops.where(long_enough & covered)
    # one line of joins, each grouped back to stops, so that the clustering runs once
    held = [F.first(c).alias(c) for c in stops.columns if c not in ("video_id", "stop")]
    # merge joins: both sides are rows of vehicles, which no driver can hold to broadcast them
    seen = vehicles(tracks).select("video_id", F.col("track_id").alias("id"), F.col("gx").alias("px"), F.col("gy").alias("py")).where("id >= 0").hint("merge")
    reach = F.max(F.hypot(F.col("px") - F.col("x"), F.col("py") - F.col("y"))).alias("reach")
    moved = stops.withColumn("id", F.explode("ids")).join(seen, ["video_id", "id"]).groupBy("video_id", "stop").agg(*held, reach)
    moved = moved.where(F.col("reach") >= th.motion_evidence * F.col("size"))
    calm = _with_speed(vehicles(tracks)).where((F.col("track_id") >= 0) & (F.col("sustained_speed") <= th.max_speed * s.box_height()))
    width = 600  # frames a bucket
    beside = calm.select(F.col("video_id").alias("v"), F.floor(F.col("frame_idx") / width).alias("b"), F.col("frame_idx").alias("f"), F.col("track_id").alias("other"), F.col("gx").alias("px"), F.col("gy").alias("py")).hint("merge")
    spread = moved.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("first") / width), F.floor(F.col("last") / width))))
    near = F.col("f").between(F.col("first"), F.col("last")) & ~F.array_contains("ids", F.col("other")) & (F.hypot(F.col("px") - F.col("x"), F.col("py") - F.col("y")) <= th.neighbour * F.col("size"))
    met = spread.join(beside, (F.col("video_id") == F.col("v")) & (F.col("bucket") == F.col("b")) & near, "left")
    lonely = met.groupBy("video_id", "stop").agg(*held, F.count_distinct("f").alias("beside")).where(F.col("beside") < th.queue_share * F.col("frames"))
    seconds = (F.col("last") - F.col("first") + step) / s.frame_rate()
    scored = lonely.withColumn("strength", F.least(F.lit(1.0), seconds / F.lit(max(th.min_sec, 1e-6))))
    named = _named(scored.withColumnsRenamed({"first": "start_frame", "last": "end_frame"}), "stopped_vehicle", F.col("strength"), F.filter("ids", lambda i: i >= 0))
    return named.select(*SEGMENT)


def to_segments(found: DataFrame, *more: str) -> DataFrame:
    """Frame segments in seconds: (video_id, label, start, end, score, track_ids, more)."""
    fps, stride = F.col("fps"), F.col("frame_stride")
    return found.select("video_id", "label", s.frame_start(F.col("start_frame"), fps).alias("start"), s.frame_end(F.col("end_frame"), fps, stride).alias("end"), "score", "track_ids", *more)


def run_rules(tracks: DataFrame, scene: Scene | SceneTable, labels: Sequence[str] | None = None, thresholds: dict[str, object] | None = None, skipped: list[str] | None = None, keep: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """Segments of all (or some) rules. A rule whose plan cannot be made is skipped, its name
    put into ``skipped``. With ``keep`` (sources.staging.staged) the zones and speeds are
    worked out once, kept as a table and shared by all rules; a single rule works out what it
    needs of them itself."""
    out = None
    if keep is not None and len(labels or RULES) > 1:
        tracks = keep(prepared(tracks, scene), "rule-tracks")
    for label in labels or list(RULES):
        try:
            found = normalised(RULES[label](tracks, scene, (thresholds or {}).get(label)), label)
            found.schema  # noqa: B018  analysed here, so that a broken rule fails alone
        except Exception:  # any rule may be a plug-in
            if skipped is None:
                raise
            skipped.append(label)
            continue
        out = found if out is None else out.unionByName(found)
    if out is None:
        return tracks.sparkSession.createDataFrame([], "video_id string, label string, start double, end double, score double, track_ids array<long>")
    return out


def normalised(found: DataFrame, label: str) -> DataFrame:
    """Segments from what a rule returned: frame segments, segments in seconds, or just
    (video_id, start, end)."""
    if "start_frame" in found.columns:
        return to_segments(found)
    defaults = {"label": F.lit(label), "score": F.lit(1.0), "track_ids": F.array().cast("array<long>")}
    return found.select("video_id", *[(F.col(c) if c in found.columns else v).alias(c) for c, v in defaults.items() if c == "label"], "start", "end", *[(F.col(c) if c in found.columns else defaults[c]).alias(c) for c in ("score", "track_ids")])
