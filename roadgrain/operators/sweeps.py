"""Rules under many thresholds in one job.

Runs are kept as a tree of merges. Between two neighbouring samples of a key lies a gap;
as the gap that is bridged grows, runs join at those levels and never part. Each node is
a run that exists for the bridged gaps from ``birth`` (its largest inner gap) up to, but
not, ``death`` (the smaller gap beside it), so the runs for any gap and least length are
the nodes that span it: samples are read and sorted once, whatever the settings.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadgrain.functions import geometry as g
from roadgrain.functions import scalars as s
from roadgrain.operators import rules, runs
from roadgrain.operators.scenes import SceneTable
from roadgrain.operators.zones import Scene, border_list

NODE = "start_frame long, end_frame long, samples long, birth double, death double, fps double, frame_stride int"


class Merges:
    """The merge tree of one key's samples, which come in order; add() and close() give the
    nodes that are complete: (start, end, samples, birth, death)."""

    def __init__(self) -> None:
        # open runs, each with the gap to its left; those gaps fall from the first to the last
        self.open: list[list] = []

    def _join_last(self) -> Iterator[tuple]:
        """Joins the last open run to the one before: at that gap both end."""
        *last, gap = self.open.pop()
        into = self.open[-1]
        for start, end, samples, birth in (last, into[:4]):
            if birth < gap:
                yield start, end, samples, birth, gap
        into[1:4] = last[1], into[2] + last[2], gap

    def add(self, frame: int) -> Iterator[tuple]:
        gap = float(frame - self.open[-1][1]) if self.open else float("inf")
        while len(self.open) > 1 and self.open[-1][4] <= gap:
            yield from self._join_last()
        self.open.append([frame, frame, 1, 0.0, gap])

    def close(self) -> Iterator[tuple]:
        while len(self.open) > 1:
            yield from self._join_last()
        for start, end, samples, birth, left in self.open:
            yield start, end, samples, birth, left
        self.open = []


def merge_tree(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, the columns of NODE) for rows(keys, frame_idx, fps, frame_stride): all their runs
    for every gap, in frames, that may be bridged; n samples have at most 2 n - 1. Rows are
    dealt by the keys and streamed in order; a task holds the open runs of one key."""
    kinds = rows.select(*keys).schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds.fields) + ", " + NODE
    names = [*keys, *(c.split()[0] for c in NODE.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tree, rate, shape = None, Merges(), (0.0, 0), None
        for batch in batches:
            shape = shape or [batch.schema.field(k).type for k in keys] + [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int32()]
            columns = [batch.column(c).to_pylist() for c in (*keys, "frame_idx", "fps", "frame_stride")]
            out = []
            for *key, frame, fps, stride in zip(*columns, strict=True):
                if key != now:
                    out += [(*now, *n, *rate) for n in tree.close()] if now is not None else []
                    now, rate = key, (fps, stride)
                out += [(*key, *n, *rate) for n in tree.add(frame)]
            yield _batch(out, names, shape)
        if now is not None:
            yield _batch([(*now, *n, *rate) for n in tree.close()], names, shape)

    need = rows.select(*keys, F.col("frame_idx").cast("long").alias("frame_idx"), F.col("fps").cast("double").alias("fps"), F.col("frame_stride").cast("int").alias("frame_stride"))
    return need.repartition(*keys).sortWithinPartitions(*keys, "frame_idx").mapInArrow(run, schema)


def _batch(rows: list[tuple], names: list[str], shape: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * len(names), shape, strict=True)], names)


def _settings(values: Sequence[dict]) -> Column:
    return F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in x.items()]) for x in values])


def runs_of(tree: DataFrame, settings: Sequence[dict]) -> DataFrame:
    """The runs of merge_tree's nodes under each of settings(setting, flag, gap_sec, min_sec), as
    runs.flag_runs has them; adds setting. Nodes have a column flag: whose samples they are."""
    step = s.sample_step()

    def holds(x: Column) -> Column:
        gap = x["gap_sec"] * s.frame_rate() + step
        long_enough = s.span_seconds(F.col("start_frame"), F.col("end_frame"), F.col("fps"), F.col("frame_stride")) >= x["min_sec"]
        return (x["flag"] == F.col("flag")) & (F.col("birth") <= gap) & (gap < F.col("death")) & long_enough

    return tree.withColumn("x", F.explode(F.filter(_settings(settings), holds))).withColumn("setting", F.col("x.setting")).drop("x", "birth", "death")


def _distinct(grid: Sequence[object], fields: Sequence[str]) -> tuple[list[dict], list[int]]:
    """The different values of the fields in grid, and for every entry which of them it has."""
    seen: dict[tuple, int] = {}
    at = [seen.setdefault(tuple(getattr(x, f) for f in fields), len(seen)) for x in grid]
    return [dict(zip(fields, values, strict=True)) | {"flag": k} for values, k in seen.items()], at


def jaywalking(tracks: DataFrame, scene: Scene | SceneTable, grid: Sequence[rules.Jaywalking]) -> DataFrame:
    """rules.jaywalking under every entry of grid, with setting, its place there: each person's
    measures once, then which settings they meet, then one merge tree."""
    flags, at = _distinct(grid, ("min_conf", "kerb_margin", "crossing_margin", "rider_share"))
    loosest = {f: min(x[f] for x in flags) for f in ("min_conf", "kerb_margin", "crossing_margin")}
    size = s.box_height()
    tracked = (F.col("cls") == s.PERSON) & (F.col("track_id") >= 0) & (F.col("conf") >= loosest["min_conf"])
    on_foot = F.col("on_road") & ~F.col("in_crossing") & ~s.cut_by_frame(*rules._frame(scene))
    known = not isinstance(scene, SceneTable) or "on_road" in tracks.columns
    rows = rules._indexed(tracks, scene) if known else tracks
    rows = rules.with_vehicle_boxes(rows, tracked & on_foot if known else tracked)
    # least and greatest pass nulls over: a vehicle without a box needs its own case
    shares = F.transform("vehicles", lambda v: F.when(v["x1"].isNotNull(), rules.vehicle_share(v)).otherwise(0.0))
    rows = rows.withColumn("share", F.coalesce(F.array_max(shares), F.lit(0.0))).drop("vehicles")
    rows = rows if known else rules._indexed(rows, scene).where(on_foot)
    rows = _with_distance(rows, scene, "carriageway", "kerb").where(F.col("kerb") >= loosest["kerb_margin"] * size)
    measured = _with_distance(rows, scene, "crossings", "zebra").where(F.col("zebra") >= loosest["crossing_margin"] * size)
    meets = lambda x: (F.col("conf") >= x["min_conf"]) & (F.col("kerb") >= x["kerb_margin"] * size) & (F.col("zebra") >= x["crossing_margin"] * size) & (F.col("share") < x["rider_share"])
    flagged = measured.select("video_id", "track_id", "frame_idx", "fps", "frame_stride", F.explode(F.filter(_settings(flags), meets)["flag"]).alias("flag"))
    tree = merge_tree(flagged, ["video_id", "track_id", "flag"])
    found = runs_of(tree, [{"setting": i, "flag": k, "gap_sec": x.gap_sec, "min_sec": x.min_sec} for i, (x, k) in enumerate(zip(grid, at, strict=True))])
    return rules._named(found, "jaywalking", F.lit(1.0), F.array("track_id")).select(*rules.SEGMENT, "setting")


def wrong_way(tracks: DataFrame, scene: Scene | SceneTable, grid: Sequence[rules.WrongWay]) -> DataFrame:
    """rules.wrong_way under every entry of grid, with setting. A run's median height is no sum
    of its parts', so the rows that meet a setting's conditions are repeated for it instead
    of a tree; still one scan and one sort."""
    rows = rules._indexed(rules.vehicles(rules.dense_enough(tracks, max(x.max_sample_sec for x in grid))), scene)
    angle = g.heading_vs_lane(F.col("vx"), F.col("vy"), F.col("lane_dx"), F.col("lane_dy"))
    rows = rows.where((F.col("track_id") >= 0) & F.col("lane_judged") & (F.col("conf") >= min(x.min_conf for x in grid))).withColumn("angle", angle)
    seconds = F.col("frame_stride") / s.frame_rate()
    settings = _settings([dataclasses.asdict(x) | {"setting": i} for i, x in enumerate(grid)])
    meets = lambda x: (F.col("angle") >= x["min_angle_deg"]) & (F.col("speed") >= x["min_speed"] * s.box_height()) & (F.col("conf") >= x["min_conf"]) & (seconds <= x["max_sample_sec"])
    each = rows.withColumn("x", F.explode(F.filter(settings, meets))).select("*", F.col("x.setting").alias("setting"))
    keys, point = ["video_id", "track_id", "setting"], F.struct("gx", "gy")
    marked = runs.with_islands(each, keys, "frame_idx", F.col("x.gap_sec") * s.frame_rate() + s.sample_step())
    found = marked.groupBy(*keys, "island").agg(
        F.min("frame_idx").alias("start_frame"), F.max("frame_idx").alias("end_frame"), F.count("*").alias("samples"), F.max("fps").alias("fps"), F.max("frame_stride").alias("frame_stride"), F.first("x").alias("x"),
        F.avg("lane_dx").alias("ax"), F.avg("lane_dy").alias("ay"), F.min_by(point, "frame_idx").alias("a"), F.max_by(point, "frame_idx").alias("b"), F.median(s.box_height()).alias("unit"),
    )
    found = found.where(s.span_seconds(F.col("start_frame"), F.col("end_frame"), F.col("fps"), F.col("frame_stride")) >= F.col("x.min_sec"))
    norm, bar = F.hypot("ax", "ay"), F.col("x.min_progress") * F.col("unit")
    against = -((F.col("b.gx") - F.col("a.gx")) * F.col("ax") + (F.col("b.gy") - F.col("a.gy")) * F.col("ay")) / norm
    found = found.where((F.col("samples") >= 2) & (norm >= 1e-6)).withColumn("against", against).where(F.col("against") >= bar)
    return rules._named(found, "wrong_way", F.least(F.lit(1.0), F.col("against") / F.greatest(bar, F.lit(1e-6))), F.array("track_id")).select(*rules.SEGMENT, "setting")


def _with_distance(rows: DataFrame, scene: Scene | SceneTable, kind: str, name: str) -> DataFrame:
    """Adds the distance to the nearest real edge of a kind of area; infinite without one."""
    if not isinstance(scene, SceneTable):
        near = rows.withColumn("__edges", border_list(scene, kind))
    else:
        near = rows.join(scene.scenes.select(scene.key, F.col(f"{kind}_edges").alias("__edges")), scene.key, "left")
    x, y = F.col("gx").cast("double"), F.col("gy").cast("double")
    far = F.array_min(F.transform("__edges", lambda e: g.distance_to_segment(x, y, e["ax"], e["ay"], e["bx"], e["by"])))
    return near.withColumn(name, F.coalesce(far, F.lit(float("inf")))).drop("__edges")


SWEPT = {"jaywalking": (jaywalking, rules.Jaywalking), "wrong_way": (wrong_way, rules.WrongWay)}


def swept(tracks: DataFrame, scene: Scene | SceneTable, label: str, grid: Sequence[dict]) -> DataFrame:
    """A rule's segments under every entry of grid, thresholds that differ from the rule's own;
    adds setting, the entry's place. The two rules with runs of rows are swept in one pass;
    the others, whose windows or clusters the thresholds change, once for each entry."""
    if label in SWEPT:
        rule, thresholds = SWEPT[label]
        found = rule(tracks, scene, [dataclasses.replace(thresholds(), **x) for x in grid])
        return rules.to_segments(found, "setting")
    base = {"congestion": rules.Congestion, "stopped_vehicle": rules.Stopped}[label]()
    out = None
    for i, over in enumerate(grid):
        part = rules.to_segments(rules.RULES[label](tracks, scene, dataclasses.replace(base, **over))).withColumn("setting", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return out
