"""Scenes (hand-drawn zones of a camera) and the membership of points in them.

A Scene is one camera's zones, known when the plan is made: its polygons become
plain expressions. ``zone_index_by_camera`` does the same against a table of
scenes, for many cameras in one job, by a join on camera_id and higher-order
functions, without multiplying rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadgrain.functions import geometry as g
from roadgrain.functions import scalars as s

Point = tuple[float, float]


@dataclass(frozen=True)
class Lane:
    id: str
    polygon: tuple[Point, ...]
    direction: Point = (1.0, 0.0)
    group: str | None = None
    stop_line: str | None = None
    manoeuvres: tuple[str, ...] = ()


@dataclass(frozen=True)
class StopLine:
    id: str
    segment: tuple[float, float, float, float]
    approach_side: int = 1
    lanes: tuple[str, ...] = ()


@dataclass(frozen=True)
class Scene:
    """Polygons in the pixels of an image of width x height. frame_edges: per area polygon
    (by kind), which edges lie on the image border and so are no kerbs."""

    width: int
    height: int
    carriageway: tuple[tuple[Point, ...], ...] = ()
    crossings: tuple[tuple[Point, ...], ...] = ()
    queues: tuple[tuple[Point, ...], ...] = ()
    queue_ids: tuple[str, ...] = ()
    lanes: tuple[Lane, ...] = ()
    stop_lines: tuple[StopLine, ...] = ()
    markings: tuple[tuple[str, tuple[str, ...]], ...] = ()
    frame_edges: dict[str, tuple[tuple[bool, ...], ...]] = field(default_factory=dict)

    def painted(self) -> frozenset[str]:
        """Lanes that some marking separates."""
        return frozenset(lane for _, lanes in self.markings for lane in lanes)

    def solid_markings(self) -> tuple[tuple[str, tuple[str, ...]], ...]:
        return tuple(m for m in self.markings if m[0] != "dashed")

    def rescaled(self, width: int, height: int) -> Scene:
        """The scene for frames of another size; directions keep unit length."""
        sx, sy = width / self.width, height / self.height
        ring = lambda p: tuple((x * sx, y * sy) for x, y in p)

        def turned(d: Point) -> Point:
            n = (d[0] * sx) ** 2 + (d[1] * sy) ** 2
            return (d[0] * sx / n**0.5, d[1] * sy / n**0.5) if n > 0 else (0.0, 0.0)

        return replace(
            self, width=width, height=height, carriageway=tuple(map(ring, self.carriageway)), crossings=tuple(map(ring, self.crossings)), queues=tuple(map(ring, self.queues)),
            lanes=tuple(replace(x, polygon=ring(x.polygon), direction=turned(x.direction)) for x in self.lanes),
            stop_lines=tuple(replace(x, segment=(x.segment[0] * sx, x.segment[1] * sy, x.segment[2] * sx, x.segment[3] * sy)) for x in self.stop_lines),
            frame_edges=self.border_edges(),
        )

    def border_edges(self, tolerance: float = 2.0) -> dict[str, tuple[tuple[bool, ...], ...]]:
        """Edges that lie on the border of the image the scene was drawn on."""

        def on(a: Point, b: Point) -> bool:
            return any(abs(a[k] - v) <= tolerance and abs(b[k] - v) <= tolerance for k, v in ((0, 0), (0, self.width), (1, 0), (1, self.height)))

        return {k: tuple(tuple(on(a, b) for a, b in zip(p, [*p[1:], p[0]], strict=True)) for p in getattr(self, k)) for k in ("carriageway", "crossings", "queues")}


def in_any(x: Column | str, y: Column | str, polygons: Sequence[Sequence[Point]]) -> Column:
    out = F.lit(False)
    for p in polygons:
        out = out | g.point_in_polygon(x, y, p)
    return out


def border_distance(scene: Scene, kind: str, x: Column | str = "gx", y: Column | str = "gy") -> Column:
    """Distance to the nearest real edge of any polygon of a kind; infinite without one."""
    skips = scene.frame_edges.get(kind, ())
    found = [g.boundary_distance(x, y, p, skips[i] if i < len(skips) else ()) for i, p in enumerate(getattr(scene, kind))]
    return F.least(*found) if len(found) > 1 else found[0] if found else F.lit(float("inf"))


def border_list(scene: Scene, kind: str) -> Column:
    """The real edges of all polygons of a kind, as an array: for the few rows that cheaper
    conditions leave. Formulas for each edge would make methods too long to be compiled."""
    skips = scene.frame_edges.get(kind, ())
    found = [e for i, p in enumerate(getattr(scene, kind)) for e in g.real_edges([tuple(c) for c in p], skips[i] if i < len(skips) else ())]
    each = [F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(("ax", "ay", "bx", "by"), (*a, *b), strict=True)]) for a, b in found]
    return F.array(*each).cast("array<struct<ax:double,ay:double,bx:double,by:double>>") if each else F.expr("cast(array() as array<struct<ax:double,ay:double,bx:double,by:double>>)")


def zone_index(tracks: DataFrame, scene: Scene) -> DataFrame:
    """Adds on_road, in_crossing, in_queue and the first lane (in drawing order) that holds
    the ground point: lane_ord (-1: none), lane_id, lane_dx, lane_dy, lane_group, lane_judged."""
    areas = {"on_road": in_any("gx", "gy", scene.carriageway), "in_crossing": in_any("gx", "gy", scene.crossings), "in_queue": in_any("gx", "gy", scene.queues)}
    ordinal = F.lit(-1)
    for i, lane in reversed(list(enumerate(scene.lanes))):
        ordinal = F.when(g.point_in_polygon("gx", "gy", lane.polygon), i).otherwise(ordinal)
    out = tracks.withColumns(areas | {"lane_ord": s.settled(ordinal)})
    painted = scene.painted()
    of = lambda values, kind: F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("lane_ord") + 2)
    return out.withColumns({
        "lane_id": of([None, *[x.id for x in scene.lanes]], "string"),
        "lane_dx": of([0.0, *[x.direction[0] for x in scene.lanes]], "double"),
        "lane_dy": of([0.0, *[x.direction[1] for x in scene.lanes]], "double"),
        "lane_group": of([None, *[x.group for x in scene.lanes]], "string"),
        "lane_judged": of([False, *[(x.id in painted) or not painted for x in scene.lanes]], "boolean"),
    })


def zone_index_by_camera(tracks: DataFrame, scenes: DataFrame) -> DataFrame:
    """zone_index against scenes(camera_id, carriageway, crossings, queues: array<polygon>,
    lanes: array<struct<id,polygon,dx,dy,grp>> in drawing order); tracks has camera_id.
    Rows of cameras without a scene are in no zone."""
    # each scene's edges and hulls are worked out once; a point outside a hull tests no edges
    span = lambda p, n, f: f(F.transform(p, lambda c: c[n]))
    shape = lambda p: F.struct(span(p, "x", F.array_min).alias("x0"), span(p, "x", F.array_max).alias("x1"), span(p, "y", F.array_min).alias("y0"), span(p, "y", F.array_max).alias("y1"), g.edges(p).alias("edges"))
    shaped = {k: F.transform(F.filter(k, lambda p: F.size(p) >= 3), shape) for k in ("carriageway", "crossings", "queues")}
    lane = lambda z: F.struct(z["id"].alias("id"), z["dx"].alias("dx"), z["dy"].alias("dy"), z["grp"].alias("grp"), shape(z["polygon"]).alias("shape"))
    ready = scenes.withColumns(shaped | {"lanes": F.transform(F.filter("lanes", lambda z: F.size(z["polygon"]) >= 3), lane)})
    joined = tracks.join(ready, "camera_id", "left")
    x, y = F.col("gx").cast("double"), F.col("gy").cast("double")
    # the slack of a pixel covers the tolerance on edges
    holds = lambda p: F.when((x >= p["x0"] - 1) & (x <= p["x1"] + 1) & (y >= p["y0"] - 1) & (y <= p["y1"] + 1), g.in_edges(x, y, p["edges"])).otherwise(False)
    within = lambda c: s.settled(F.coalesce(F.exists(c, holds), F.lit(False)))
    hit = F.filter("lanes", lambda z: holds(z["shape"]))
    out = joined.withColumns({"on_road": within("carriageway"), "in_crossing": within("crossings"), "in_queue": within("queues"), "__lane": s.settled(F.try_element_at(hit, F.lit(1)))})
    lane = {"lane_id": F.col("__lane.id"), "lane_dx": F.coalesce(F.col("__lane.dx"), F.lit(0.0)), "lane_dy": F.coalesce(F.col("__lane.dy"), F.lit(0.0)), "lane_group": F.col("__lane.grp")}
    return out.withColumns(lane).drop("__lane", "carriageway", "crossings", "queues", "lanes")


def lane_stop_lines(rows: DataFrame, scene: Scene) -> DataFrame:
    """Adds stop_line, that of the row's lane."""
    known = [F.lit(x) for lane in scene.lanes if lane.stop_line for x in (lane.id, lane.stop_line)]
    return rows.withColumn("stop_line", F.create_map(*known)[F.col("lane_id")] if known else F.lit(None).cast("string"))
