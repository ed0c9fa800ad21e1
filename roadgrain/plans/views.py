"""Trajectory views over the given tables, as Spark plans and as DuckDB SQL.

The given tables hold no detections, so each order becomes an actor that is
sampled every half second on a road of eight lanes: persons who cross, vehicles
that pass, stop, crawl or go the wrong way, with jitter, dropouts and lost ids.
Both forms are made from the same expressions; everything grows with orders,
lineitem and events.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadgrain.functions.scalars import settled
from roadgrain.operators.zones import Lane, Scene

SAMPLES, WIDTH, HEIGHT, FPS, STRIDE = 44, 1920, 1080, 30.0, 15
#: Orders in a task: some 600,000 samples.
ACTORS = 20_000
_VIDEO = "'v' || CAST(c - c % 4 AS STRING)"

_LAYERS = (
    (
        f"{_VIDEO} AS video_id", "a", "k", "(a * 7) % 120 + k AS sample", "(a * 11) % 8 AS lane_no", "(c - c % 4) % 20 = 0 AS jam",
        "CASE WHEN a % 7 < 2 THEN 0 WHEN a % 7 < 4 THEN 2 WHEN a % 7 = 4 THEN 7 WHEN a % 7 = 5 THEN 5 ELSE 3 END AS cls",
        "CASE WHEN a % 6 = 0 THEN least(k, 8) + greatest(0, k - 30) ELSE k END AS moved", "(a * 31 + k * 17) % 7 - 3 AS jitter",
    ),
    (
        "video_id", "a", "k", "sample", "cls", "jitter",
        "CASE WHEN (lane_no < 4) <> (a % 13 = 0) THEN 1 ELSE -1 END AS way", "CASE WHEN jam THEN 3 ELSE 60 + (a % 5) * 20 END AS pace", "moved", "jam", "lane_no",
    ),
    (
        "video_id", "a", "k", "sample", "cls",
        "CASE WHEN cls = 0 THEN 150 + (a * 29) % 1600 + jitter WHEN jam THEN 200 + (a * 37) % 1500 + way * pace * moved ELSE 960 - way * 860 + way * pace * moved + jitter END AS x",
        "CASE WHEN cls = 0 THEN CASE WHEN a % 2 = 0 THEN 250 ELSE 240 + 14 * k END ELSE 320 + 59 * lane_no + jitter END AS y",
        "CASE cls WHEN 0 THEN 46 WHEN 2 THEN 170 WHEN 3 THEN 70 WHEN 5 THEN 230 ELSE 220 END AS w", "CASE cls WHEN 0 THEN 150 WHEN 2 THEN 130 WHEN 3 THEN 130 WHEN 5 THEN 260 ELSE 220 END AS h",
    ),
    (
        "video_id", f"CAST(sample * {STRIDE} AS INT) AS frame_idx", f"CAST(sample * {STRIDE} AS DOUBLE) / 30e0 AS t_sec", "CASE WHEN (a + k) % 23 = 0 THEN CAST(-1 AS BIGINT) ELSE CAST(a AS BIGINT) END AS track_id", "CAST(cls AS INT) AS cls",
        "CAST(30 + a % 60 AS DOUBLE) / 100e0 AS conf", "CAST(x AS DOUBLE) - CAST(w AS DOUBLE) / 2e0 AS x1", "CAST(y - h AS DOUBLE) AS y1", "CAST(x AS DOUBLE) + CAST(w AS DOUBLE) / 2e0 AS x2", "CAST(y AS DOUBLE) AS y2",
        "CAST(x AS DOUBLE) AS gx", "CAST(y AS DOUBLE) AS gy", "30e0 AS fps", f"{STRIDE} AS frame_stride",
    ),
)
#: What depends on the order alone, of the layers' columns and within their formulas: Spark works it out
#: once an order instead of once a sample.
_OF_ORDER = ("lane_no", "jam", "cls", "way", "pace")
_ONCE = {"a7": "(a * 7) % 120", "a31": "a * 31", "a29": "(a * 29) % 1600", "a37": "(a * 37) % 1500", "a5": "a * 5", "a6": "a % 6 = 0", "a2": "a % 2 = 0", "sure": "CAST(30 + a % 60 AS DOUBLE) / 100e0"}
_KEPT = "x BETWEEN 0 AND 1920 AND (a * 5 + k) % 19 <> 0"

_SEGMENTS = (
    "'v' || CAST(c - c % 4 AS STRING) AS video_id", "CASE a % 4 WHEN 0 THEN 'jaywalking' WHEN 1 THEN 'stopped_vehicle' WHEN 2 THEN 'wrong_way' ELSE 'congestion' END AS label",
    "CAST((a * 7) % 100 AS DOUBLE) + CAST(a % 10 AS DOUBLE) / 10e0 AS start_sec", "CAST(3 + a % 9 AS DOUBLE) AS seconds", "a",
)
_TRUTH = ("video_id", "label", 'start_sec AS "start"', 'start_sec + seconds AS "end"', "a")
_LATE = "CAST(a % 7 - 3 AS DOUBLE) / 2e0 + CASE WHEN a % 5 = 0 THEN 40e0 ELSE 0e0 END"
_PREDICTED = (
    # one video in fifty goes by another name, one segment in five comes much too late, some have another label
    "CASE WHEN CAST(substr(video_id, 2) AS BIGINT) % 200 = 0 THEN 'w' || substr(video_id, 2) ELSE video_id END AS video_id", "CASE WHEN a % 17 = 0 THEN 'wrong_way' ELSE label END AS label",
    f'greatest(0e0, start_sec + {_LATE}) AS "start"', f'start_sec + {_LATE} + seconds + CAST(a % 3 AS DOUBLE) AS "end"', "a",
)


def _spark(expressions: tuple[str, ...]) -> list[str]:
    return [e.replace('"', "`") for e in expressions]


def _known(expression: str) -> str:
    """An expression that reads what is worked out once an order."""
    for name, e in _ONCE.items():
        expression = expression.replace(e, name)
    return expression


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def actors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").selectExpr("o_orderkey as a", "o_custkey as c")


def _samples(spark: SparkSession, sf_dir: str, waves: int | None = None) -> DataFrame:
    """The layers' rows that are kept. Orders are dealt by video before they become samples:
    two numbers an order are shuffled instead of a row a sample, and windows and groups over
    (video, ...) need no other shuffle. A task gets about ACTORS orders however many there are;
    with waves there are at most that many tasks a core, for tasks that hold little."""
    rows = actors(spark, sf_dir).selectExpr(f"{_VIDEO} as video_id", "a", "c")
    cores = spark.sparkContext.defaultParallelism
    tasks = max(cores, math.ceil(rows.count() / ACTORS))
    tasks = tasks if waves is None else min(tasks, waves * cores)
    rows = rows.repartition(tasks, "video_id")
    for layer in _LAYERS[:2]:
        rows = rows.selectExpr("*", *[e for e in _spark(layer) if e.split(" AS ")[-1] in _OF_ORDER and " AS " in e])
    rows = rows.selectExpr("*", *[f"{e} AS {n}" for n, e in _ONCE.items()]).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(SAMPLES - 1))))
    for layer in _LAYERS[:-1]:
        rows = rows.selectExpr("video_id", *[_known(e) for e in _spark(layer) if e.split(" AS ")[-1] not in ("video_id", *_OF_ORDER)], *_OF_ORDER, *_ONCE)
    return rows.withColumn("x", settled("x")).where(_known(_KEPT))


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections with ground points (see the module), dealt by video."""
    return _samples(spark, sf_dir).selectExpr(*map(_known, _spark(_LAYERS[-1])))


def spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gx, gy): the ground points of the tracks, once each. A task sends each of its points once,
    which for many small tasks would be almost every sample."""
    return _samples(spark, sf_dir, waves=4).selectExpr("CAST(x AS DOUBLE) AS gx", "CAST(y AS DOUBLE) AS gy").distinct()


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tracks' boxes without their ids, numbered within a video by det."""
    named = [_known(e) for e in _spark(_LAYERS[-1]) if "AS track_id" not in e]
    return _samples(spark, sf_dir).selectExpr(*named, "cast(a as bigint) * 64 + k as det")


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments video_id, label, start, end, a."""
    return actors(spark, sf_dir).selectExpr(*_spark(_SEGMENTS)).selectExpr(*_spark(_TRUTH))


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The truth shifted and lengthened, some of it much, with some other labels and videos."""
    return actors(spark, sf_dir).selectExpr(*_spark(_SEGMENTS)).selectExpr(*_spark(_PREDICTED))


def risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as a risk curve: video_id, t_sec, score, one per time."""
    rows = read(spark, sf_dir, "events").selectExpr("user_id", "cast(unix_micros(cast(ts as timestamp)) as double) / 1e6 as t_sec", "least(1e0, greatest(0e0, value / 500e0)) as score")
    return rows.groupBy(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("video_id"), "t_sec").agg(F.max("score").alias("score"))


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per video with a truth: video_id, duration."""
    return truth(spark, sf_dir).groupBy("video_id").agg((F.max("end") + 5.0).alias("duration"))


def _rect(x1: float, y1: float, x2: float, y2: float) -> tuple[tuple[float, float], ...]:
    return ((x1, y1), (x2, y1), (x2, y2), (x1, y2))


def scene() -> Scene:
    """Eight lanes, four to each side, a crossing and a queue zone."""
    lanes = tuple(Lane(f"lane{i}", _rect(0, 290 + 59 * i, WIDTH, 349 + 59 * i), (1.0, 0.0) if i < 4 else (-1.0, 0.0), "east" if i < 4 else "west") for i in range(8))
    return Scene(WIDTH, HEIGHT, (_rect(0, 290, WIDTH, 762),), (_rect(900, 290, 1020, 762),), (_rect(1100, 290, 1500, 460),), ("queue0",), lanes)


# cameras: one for each nation, its zones drawn by formulas in k, the nation's key, and d. Kind,
# number, corners in the pixels of 1920 x 1080, some bent or slanted
_D = "CAST((k % 5) * 6 AS DOUBLE)"
_ZONES = (
    ("carriageway", 0, (("0e0", "290.25e0 + d"), ("960e0", "302.75e0 + d"), ("1920e0", "290.25e0"), ("1920e0", "761.75e0"), ("1000e0", "745.25e0"), ("0e0", "761.75e0 - d"))),
    ("crossings", 0, (("900.25e0", "290.25e0"), ("1020.25e0", "290.25e0"), ("1020.25e0 + d", "762.25e0"), ("900.25e0 + d", "762.25e0"))),
    ("queues", 0, (("1100.25e0", "290.25e0"), ("1500.25e0", "290.25e0"), ("1500.25e0 - d", "460.25e0"), ("1100.25e0", "460.25e0"))),
    *(("lane", i, (("0e0", f"{290.25 + 59 * i}e0"), ("1920e0", f"{290.25 + 59 * i}e0"), ("1920e0", f"{349.25 + 59 * i}e0 + d / 2e0"), ("0e0", f"{349.25 + 59 * i}e0"))) for i in range(8)),
)


def cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(camera_id, doc, width, height): a scene document for each nation, and the size of its
    videos. Every fourth is drawn on frames of half the size; those with odd keys name no
    direction groups; every seventh paints a marking between two lanes."""
    rows = read(spark, sf_dir, "nation").selectExpr("n_nationkey as k", "'c' || n_nationkey as camera_id").selectExpr("*", f"{_D} as d", "if(k % 4 = 3, 0.5d, 1d) as z")
    ring = lambda corners: "array(" + ", ".join(f"array(({x}) * z, ({y}) * z)".replace("e0", "d") for x, y in corners) + ")"
    kinds = {kind: [(i, c) for k, i, c in _ZONES if k == kind] for kind in ("carriageway", "crossings", "queues", "lane")}
    zone = lambda kind: "array(" + ", ".join(f"named_struct('id', '{kind}{i}', 'polygon', {ring(c)})" for i, c in kinds[kind]) + ")"
    lane = lambda i, c: f"named_struct('id', 'lane{i}', 'polygon', {ring(c)}, 'direction_from', array({0 if i < 4 else 300}d * z, 5d), 'direction_to', array({300 if i < 4 else 0}d * z, 5d), 'direction_group', if(k % 2 = 0, '{'east' if i < 4 else 'west'}', null))"
    doc = f"""to_json(named_struct('schema_version', 1, 'authored_against', named_struct('image_width', cast(1920 * z as int), 'image_height', cast(1080 * z as int)), 'carriageway', {zone('carriageway')},
      'crossings', {zone('crossings')}, 'signal_queue_zones', {zone('queues')}, 'lanes', array({', '.join(lane(i, c) for i, c in kinds['lane'])}),
      'lane_markings', if(k % 7 = 0, array(named_struct('id', 'm', 'segment', array(array(0d, 5d), array(9d, 5d)), 'style', 'solid', 'separates', array('lane1', 'lane5'))), null)))"""
    return rows.selectExpr("camera_id", f"{doc} as doc", f"{WIDTH} as width", f"{HEIGHT} as height")


def with_camera(tracks: DataFrame) -> DataFrame:
    """Adds camera_id: the videos are dealt to the cameras."""
    return tracks.withColumn("camera_id", F.expr("'c' || cast(cast(substr(video_id, 2) as bigint) div 4 % 25 as string)"))


#: DuckDB tables over the cameras: the edges of their zones, the tracks with their camera and zones.
CAMERA_SQL = f"""cam AS (SELECT 'c' || n_nationkey AS camera_id, n_nationkey AS k, {_D.replace("k %", "n_nationkey %")} AS d FROM nation),
    corners AS ({" UNION ALL ".join(f"SELECT camera_id, k, '{kind}' AS kind, {i} AS ord, {n} AS i, {x} AS x, {y} AS y FROM cam" for kind, i, c in _ZONES for n, (x, y) in enumerate(c))}),
    zone_edges AS MATERIALIZED (SELECT camera_id, k, kind, ord, x AS ax, y AS ay, coalesce(lead(x) OVER w, first_value(x) OVER w) AS bx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS by_
      FROM corners WINDOW w AS (PARTITION BY camera_id, kind, ord ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
    kerbs AS (SELECT * FROM zone_edges WHERE kind <> 'carriageway' OR NOT (greatest(ax, bx) <= 2 OR least(ax, bx) >= 1918)),
    seen AS MATERIALIZED (SELECT *, 'c' || CAST(CAST(substr(video_id, 2) AS BIGINT) // 4 % 25 AS VARCHAR) AS camera_id FROM tracks),
    held AS (SELECT camera_id, any_value(k) AS k, gx, gy, kind, ord FROM (SELECT DISTINCT camera_id, gx, gy FROM seen) JOIN zone_edges USING (camera_id) GROUP BY camera_id, gx, gy, kind, ord
      HAVING count(*) FILTER ((by_ > gy) <> (ay > gy) AND gx < (ax - bx) * (gy - by_) / (ay - by_ + 1e-9) + bx) % 2 = 1
        OR bool_or(abs((bx - ax) * (gy - ay) - (by_ - ay) * (gx - ax)) <= 1e-6 * greatest(1, abs(bx - ax) + abs(by_ - ay)) AND (gx - ax) * (bx - ax) + (gy - ay) * (by_ - ay) BETWEEN -1e-6 AND (bx - ax)**2 + (by_ - ay)**2 + 1e-6)),
    zone AS MATERIALIZED (SELECT camera_id, gx, gy, bool_or(kind = 'carriageway') AS on_road, bool_or(kind = 'crossings') AS in_crossing, bool_or(kind = 'queues') AS in_queue, min(ord) FILTER (kind = 'lane') AS lane_no, any_value(k) AS k FROM held GROUP BY 1, 2, 3),
    zoned AS MATERIALIZED (SELECT seen.*, coalesce(on_road, FALSE) AS on_road, coalesce(in_crossing, FALSE) AS in_crossing, coalesce(in_queue, FALSE) AS in_queue, coalesce(lane_no, -1) AS lane,
      coalesce(lane_no >= 0 AND (k % 7 <> 0 OR lane_no IN (1, 5)), FALSE) AS judged, CASE WHEN lane_no IS NOT NULL THEN CASE WHEN k % 2 = 0 THEN CASE WHEN lane_no < 4 THEN 'east' ELSE 'west' END ELSE CASE WHEN lane_no < 4 THEN 'cluster0' ELSE 'cluster1' END END END AS direction
      FROM seen LEFT JOIN zone ON zone.camera_id = seen.camera_id AND zone.gx = seen.gx AND zone.gy = seen.gy)"""


def duckdb(sql: str) -> str:
    """A DuckDB query over the views: tracks, truth, predicted, risk, videos."""
    steps = ["actors AS (SELECT o_orderkey AS a, o_custkey AS c FROM orders)", f"samples AS (SELECT a, c, k FROM actors, (SELECT CAST(unnest(range(0, {SAMPLES})) AS INT) AS k))"]
    source = "samples"
    for i, layer in enumerate(_LAYERS):
        where = f" WHERE {_KEPT}" if i == len(_LAYERS) - 1 else ""
        name = "tracks" if i == len(_LAYERS) - 1 else f"layer{i}"
        steps.append(f"{name} AS (SELECT {', '.join(layer)} FROM {source}{where})")
        source = name
    seg = ", ".join(_SEGMENTS)
    steps.append(f"truth AS (SELECT {', '.join(_TRUTH)} FROM (SELECT {seg} FROM actors))")
    steps.append(f"predicted AS (SELECT {', '.join(_PREDICTED)} FROM (SELECT {seg} FROM actors))")
    steps.append("risk AS (SELECT 'u' || CAST(user_id AS VARCHAR) AS video_id, CAST(epoch_us(ts) AS DOUBLE) / 1e6 AS t_sec, max(least(1e0, greatest(0e0, value / 500e0))) AS score FROM events GROUP BY 1, 2)")
    steps.append("videos AS (SELECT video_id, max(\"end\") + 5e0 AS duration FROM truth GROUP BY video_id)")
    return f"WITH RECURSIVE {', '.join(steps)} {sql}"
