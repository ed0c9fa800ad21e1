import math
import random

import pytest
from pyspark.sql import functions as F

from roadgrain.functions import geometry as g

HOOK = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (6.0, 10.0), (6.0, 4.0), (3.0, 4.0), (3.0, 10.0), (0.0, 10.0)]
SQUARE = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]


def on_edge(p, a, b):
    cross = (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
    dot = (p[0] - a[0]) * (b[0] - a[0]) + (p[1] - a[1]) * (b[1] - a[1])
    return abs(cross) <= 1e-6 * max(1, abs(b[0] - a[0]) + abs(b[1] - a[1])) and -1e-6 <= dot <= math.dist(a, b) ** 2 + 1e-6


def inside(p, ring):
    odd = False
    for a, b in zip(ring, ring[1:] + ring[:1]):
        if on_edge(p, a, b):
            return True
        if (a[1] > p[1]) != (b[1] > p[1]) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0]:
            odd = not odd
    return odd


def ring_column(ring):
    return F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ring])


@pytest.mark.parametrize("ring", [HOOK, SQUARE])
def test_containment_agrees_with_a_scalar_ray_cast(spark, ring):
    rng = random.Random(3)
    pts = [(rng.choice([rng.uniform(-2, 12), rng.randint(-1, 11)]), rng.choice([rng.uniform(-2, 12), rng.randint(-1, 11)])) for _ in range(2000)]
    pts = [(float(x), float(y)) for x, y in pts]
    df = spark.createDataFrame(pts, "x double, y double").withColumns({"lit": g.point_in_polygon("x", "y", ring), "col": g.point_in_polygon("x", "y", ring_column(ring))})
    for r in df.collect():
        assert r["lit"] == r["col"] == inside((r["x"], r["y"]), ring), r


def test_degenerate_polygons(spark):
    row = spark.range(1).select(g.point_in_polygon(F.lit(0.0), F.lit(0.0), SQUARE[:2]).alias("a"), g.point_in_polygon(F.lit(0.0), F.lit(0.0), F.array().cast(g.POLYGON)).alias("b"), g.boundary_distance(F.lit(0.0), F.lit(0.0), []).alias("c")).first()
    assert not row["a"] and not row["b"] and row["c"] == math.inf


def test_boundary_distance_skips_slits_and_marked_edges(spark):
    slit = [(0.0, 0.0), (5.0, 0.0), (5.0, 3.0), (5.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    row = spark.range(1).select(
        g.boundary_distance(F.lit(5.5), F.lit(2.0), slit).alias("slit"), g.boundary_distance(F.lit(5.5), F.lit(2.0), ring_column(slit)).alias("slit_col"),
        g.boundary_distance(F.lit(1.0), F.lit(2.0), SQUARE, [False, False, False, True]).alias("skip"), g.boundary_distance(F.lit(1.0), F.lit(2.0), ring_column(SQUARE), F.array(*map(F.lit, [False, False, False, True]))).alias("skip_col"),
    ).first()
    assert row["slit"] == row["slit_col"] == 2.0 and row["skip"] == row["skip_col"] == 2.0


def test_lines_and_headings(spark):
    line = (0.0, 0.0, 10.0, 0.0)
    c = lambda x, y: (F.lit(float(x)), F.lit(float(y)))
    row = spark.range(1).select(
        g.crossing_direction(c(5, -1), c(5, 1), line).alias("down"), g.crossing_direction(c(5, 1), c(5, -1), line).alias("up"), g.crossing_direction(c(20, -1), c(20, 1), line).alias("beside"),
        g.crossing_direction(c(5, -1), c(5, 0), line).alias("onto"), g.side_of_line(*c(5, 0), *map(F.lit, line)).alias("on"),
        g.segment_intersection((0, 0, 4, 4), (0, 4, 4, 0)).alias("meet"), g.segment_intersection((0, 0, 4, 0), (0, 1, 4, 1)).alias("apart"),
        g.heading_vs_lane(*c(1, 0), *c(-1, 0)).alias("against"), g.heading_vs_lane(*c(0, 0), *c(1, 0)).alias("still"), g.polygon_area(ring_column(HOOK)).alias("area"),
        g.box_share((0, 0, 2, 2), (1, 0, 3, 2)).alias("share"), g.box_iou((0, 0, 2, 2), (1, 0, 3, 2)).alias("iou"),
    ).first()
    assert (row["down"], row["up"], row["beside"], row["onto"], row["on"]) == (1, -1, 0, 1, 0)
    assert (row["meet"]["x"], row["meet"]["y"]) == (2, 2) and row["apart"] is None
    assert row["against"] == row["still"] == 180 and row["area"] == 82 and row["share"] == 0.5 and abs(row["iou"] - 1 / 3) < 1e-12
