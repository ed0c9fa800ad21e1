"""Plane geometry as Column expressions. Image coordinates: x right, y down.

A polygon is a column of array<struct<x,y>>, or a list of vertices where it is
known when the plan is made: then its edges are written out as plain
expressions, which stay inside whole-stage code generation. Higher-order
functions over polygon columns are interpreted, so use those where the zones
differ from row to row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Vertices = Sequence[tuple[float, float]]
TOLERANCE, TINY = 1e-6, 1e-9
POLYGON = "array<struct<x:double,y:double>>"


def _d(v: Column | float | str) -> Column:
    return F.col(v).cast("double") if isinstance(v, str) else v.cast("double") if isinstance(v, Column) else F.lit(float(v))


def edges(polygon: Column) -> Column:
    """array<struct<ax,ay,bx,by>>: the closed ring's edges, in order."""
    n = F.size(polygon)
    after = F.when(n > 0, F.concat(F.slice(polygon, 2, F.greatest(n, F.lit(1))), F.slice(polygon, 1, 1))).otherwise(polygon)
    return F.zip_with(polygon, after, lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))


def _on_edge(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    dx, dy = bx - ax, by - ay
    cross = dx * (y - ay) - dy * (x - ax)
    along = (x - ax) * dx + (y - ay) * dy
    return (F.abs(cross) <= TOLERANCE * F.greatest(F.lit(1.0), F.abs(dx) + F.abs(dy))) & (along >= -TOLERANCE) & (along <= dx * dx + dy * dy + TOLERANCE)


def _crossed(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Whether a ray to the right of (x, y) crosses the edge whose end is b."""
    return ((by > y) != (ay > y)) & (x < (ax - bx) * (y - by) / (ay - by + TINY) + bx)


def point_on_segment(x: Column | str, y: Column | str, ax: Column | float, ay: Column | float, bx: Column | float, by: Column | float) -> Column:
    return _on_edge(*map(_d, (x, y, ax, ay, bx, by)))


def point_in_polygon(x: Column | str, y: Column | str, polygon: Column | Vertices) -> Column:
    """Even-odd containment; points on an edge are inside; under three vertices nothing is."""
    x, y = _d(x), _d(y)
    if not isinstance(polygon, Column):
        ring = [tuple(map(float, p)) for p in polygon]
        if len(ring) < 3:
            return F.lit(False)
        sides = [tuple(map(F.lit, (*a, *b))) for a, b in zip(ring, [*ring[1:], ring[0]], strict=True)]
        low_x, high_x = min(p[0] for p in ring) - 1, max(p[0] for p in ring) + 1
        low_y, high_y = min(p[1] for p in ring) - 1, max(p[1] for p in ring) + 1
        if len(ring) == 4 and len({p[0] for p in ring}) == 2 and len({p[1] for p in ring}) == 2 and len(set(ring)) == 4 and all((a[0] == b[0]) != (a[1] == b[1]) for a, b in zip(ring, ring[1:], strict=False)):
            slack = 1 - TOLERANCE  # an upright rectangle needs no edges
            return x.between(low_x + slack, high_x - slack) & y.between(low_y + slack, high_y - slack)
        near = x.between(low_x, high_x) & y.between(low_y, high_y)
        edge, odd = F.lit(False), F.lit(0)
        for s in sides:
            edge = edge | _on_edge(x, y, *s)
            odd = odd + _crossed(x, y, *s).cast("int")
        return near & (edge | (odd % 2 == 1))
    return F.coalesce((F.size(polygon) >= 3) & in_edges(x, y, edges(polygon)), F.lit(False))


def in_edges(x: Column, y: Column, ring: Column) -> Column:
    """Containment by a polygon's edges, or by those of them that a ray to the right may meet."""
    parts = lambda e: (e["ax"], e["ay"], e["bx"], e["by"])
    return F.exists(ring, lambda e: _on_edge(x, y, *parts(e))) | (F.size(F.filter(ring, lambda e: _crossed(x, y, *parts(e)))) % 2 == 1)


def distance_to_segment(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    dx, dy = bx - ax, by - ay
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - ax) * dx + (y - ay) * dy) / F.greatest(dx * dx + dy * dy, F.lit(TINY))))
    return F.hypot(x - (ax + t * dx), y - (ay + t * dy))


def real_edges(ring: Vertices, skip: Sequence[bool] = ()) -> list[tuple[tuple[float, float], tuple[float, float]]]:
    """A known polygon's edges without those of no length, those that another retraces in
    reverse (slits that join an island to the ring) and those to skip."""
    pairs = list(zip(ring, [*ring[1:], *ring[:1]], strict=True))
    known = {(tuple(a), tuple(b)) for a, b in pairs}
    use = skip if len(skip) == len(pairs) else [False] * len(pairs)
    return [(a, b) for (a, b), s in zip(pairs, use, strict=True) if not s and (tuple(b), tuple(a)) not in known and math.dist(a, b) > 1e-8]


def boundary_distance(x: Column | str, y: Column | str, polygon: Column | Vertices, skip: Sequence[bool] | Column = ()) -> Column:
    """Distance to the nearest real edge; infinite if there is none. skip: per edge."""
    x, y = _d(x), _d(y)
    if not isinstance(polygon, Column):
        found = [distance_to_segment(x, y, *map(F.lit, map(float, (*a, *b)))) for a, b in real_edges([tuple(p) for p in polygon], skip)]
        return F.least(*found) if len(found) > 1 else found[0] if found else F.lit(float("inf"))
    ring = edges(polygon)
    used = ring if not isinstance(skip, Column) else F.filter(F.zip_with(ring, skip, lambda e, s: F.when(~F.coalesce(s, F.lit(False)), e)), lambda e: e.isNotNull())
    reverse = lambda e, o: (o["ax"] == e["bx"]) & (o["ay"] == e["by"]) & (o["bx"] == e["ax"]) & (o["by"] == e["ay"])
    real = F.filter(used, lambda e: (F.hypot(e["bx"] - e["ax"], e["by"] - e["ay"]) > 1e-8) & ~F.exists(ring, lambda o: reverse(e, o)))
    return F.coalesce(F.array_min(F.transform(real, lambda e: distance_to_segment(x, y, e["ax"], e["ay"], e["bx"], e["by"]))), F.lit(float("inf")))


def signed_distance(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Signed distance to the line through a and b; to the point a if they are one."""
    x, y, ax, ay, bx, by = map(_d, (x, y, ax, ay, bx, by))
    length = F.hypot(bx - ax, by - ay)
    return F.when(length < TINY, F.hypot(x - ax, y - ay)).otherwise(((bx - ax) * (y - ay) - (by - ay) * (x - ax)) / length)


def side_of_line(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """-1, 0 or 1; 0 within a millionth of the line."""
    d = signed_distance(x, y, ax, ay, bx, by)
    return F.when(F.abs(d) < TOLERANCE, 0).otherwise(F.signum(d).cast("int"))


def _turn(ox: Column, oy: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return (ax - ox) * (by - oy) - (ay - oy) * (bx - ox)


def segments_intersect(p: Sequence[Column | str | float], q: Sequence[Column | str | float]) -> Column:
    """Whether segments p and q (each x1, y1, x2, y2) share a point."""
    (a, b, c, d), (e, f, g, h) = (tuple(map(_d, s)) for s in (p, q))
    t1, t2, t3, t4 = _turn(e, f, g, h, a, b), _turn(e, f, g, h, c, d), _turn(a, b, c, d, e, f), _turn(a, b, c, d, g, h)
    proper = (((t1 > 0) & (t2 < 0)) | ((t1 < 0) & (t2 > 0))) & (((t3 > 0) & (t4 < 0)) | ((t3 < 0) & (t4 > 0)))
    touch = _on_edge(a, b, e, f, g, h) | _on_edge(c, d, e, f, g, h) | _on_edge(e, f, a, b, c, d) | _on_edge(g, h, a, b, c, d)
    return proper | touch


def segment_intersection(p: Sequence[Column | str | float], q: Sequence[Column | str | float]) -> Column:
    """struct<x,y> where two segments meet; null if they don't, or are parallel."""
    (x1, y1, x2, y2), (x3, y3, x4, y4) = (tuple(map(_d, s)) for s in (p, q))
    den = (x1 - x2) * (y3 - y4) - (y1 - y2) * (x3 - x4)
    safe = F.when(F.abs(den) >= TINY, den)
    t = ((x1 - x3) * (y3 - y4) - (y1 - y3) * (x3 - x4)) / safe
    u = ((x1 - x3) * (y1 - y2) - (y1 - y3) * (x1 - x2)) / safe
    return F.when(t.between(0, 1) & u.between(0, 1), F.struct((x1 + t * (x2 - x1)).alias("x"), (y1 + t * (y2 - y1)).alias("y")))


def crossing_direction(before: Sequence[Column | str], after: Sequence[Column | str], line: Sequence[Column | float]) -> Column:
    """The side (-1 or 1) on which a step across the line ended, else 0; a step that ends
    on the line counts as away from where it began."""
    old, new = side_of_line(*before, *line), side_of_line(*after, *line)
    met = segments_intersect((*before, *after), line) & (old != new)
    return F.coalesce(F.when(met, F.when(new != 0, new).otherwise(-old)), F.lit(0))


def heading(dx: Column, dy: Column) -> Column:
    return F.atan2(_d(dy), _d(dx))


def unit(dx: Column, dy: Column) -> Column:
    """struct<x,y> of length one; (0, 0) for a vector without length."""
    dx, dy = _d(dx), _d(dy)
    n = F.hypot(dx, dy)
    return F.struct(F.when(n > TINY, dx / n).otherwise(0.0).alias("x"), F.when(n > TINY, dy / n).otherwise(0.0).alias("y"))


def angle_between(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Radians in [0, pi]; pi if either vector has no length."""
    ax, ay, bx, by = map(_d, (ax, ay, bx, by))
    n, m = F.hypot(ax, ay), F.hypot(bx, by)
    cosine = (ax / n) * (bx / m) + (ay / n) * (by / m)
    return F.when((n > TINY) & (m > TINY), F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))).otherwise(math.pi)


def heading_vs_lane(dx: Column, dy: Column, lane_x: Column, lane_y: Column) -> Column:
    """Degrees between a movement and its lane: 0 with it, 180 against it or standing."""
    return F.degrees(angle_between(dx, dy, lane_x, lane_y))


def polygon_area(polygon: Column) -> Column:
    total = F.aggregate(edges(polygon), F.lit(0.0), lambda acc, e: acc + e["ax"] * e["by"] - e["bx"] * e["ay"])
    return F.abs(total) / 2


def ground_point(x1: Column | str, x2: Column | str, y2: Column | str) -> Column:
    """struct<x,y>: the middle of a box's lower side."""
    return F.struct(((_d(x1) + _d(x2)) / 2).alias("x"), _d(y2).alias("y"))


def box_overlap(a: Sequence[Column | str], b: Sequence[Column | str]) -> Column:
    """Area shared by two boxes (x1, y1, x2, y2)."""
    (a1, b1, a2, b2), (c1, d1, c2, d2) = (tuple(map(_d, s)) for s in (a, b))
    zero = F.lit(0.0)
    return F.greatest(zero, F.least(a2, c2) - F.greatest(a1, c1)) * F.greatest(zero, F.least(b2, d2) - F.greatest(b1, d1))


def box_share(a: Sequence[Column | str], b: Sequence[Column | str]) -> Column:
    """The share of box a that lies in box b."""
    x1, y1, x2, y2 = map(_d, a)
    return box_overlap(a, b) / F.greatest((x2 - x1) * (y2 - y1), F.lit(1e-6))


def box_iou(a: Sequence[Column | str], b: Sequence[Column | str]) -> Column:
    (a1, b1, a2, b2), (c1, d1, c2, d2) = (tuple(map(_d, s)) for s in (a, b))
    shared = box_overlap(a, b)
    union = (a2 - a1) * (b2 - b1) + (c2 - c1) * (d2 - d1) - shared
    return F.when(union > 0, shared / union).otherwise(0.0)


def similarity_point(x: Column, y: Column, scale: Column, angle_deg: Column, tx: Column, ty: Column) -> Column:
    """struct<x,y>: a point scaled and turned about the origin, then shifted."""
    c, s = F.cos(F.radians(angle_deg)) * scale, F.sin(F.radians(angle_deg)) * scale
    return F.struct((c * x - s * y + tx).alias("x"), (s * x + c * y + ty).alias("y"))
