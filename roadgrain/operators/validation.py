"""Checks of documents and tables. Each returns rows (where..., problem), none if all is well."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadgrain.functions import scalars as s
from roadgrain.operators.intervals import overlaps

LABELS = ("jaywalking", "stopped_vehicle", "wrong_way", "congestion")


def event_problems(events: DataFrame, durations: DataFrame | None = None, labels: Sequence[str] = LABELS) -> DataFrame:
    """(video_id, pos, problem), all problems of every one of events(video_id, pos, start, end,
    label[, width]); with durations(video_id, duration) also ends over half a second late,
    of events whose label is known. Then overlaps. What is no event, or has no times, has no
    further problems."""
    rows = events if durations is None else events.join(durations, "video_id", "left")
    finite = F.col("start").isNotNull() & F.col("end").isNotNull() & ~F.isnan("start") & ~F.isnan("end")
    width = (F.col("width") != 3) if "width" in events.columns else F.lit(False)
    known = F.coalesce(F.col("label").isin(list(labels)), F.lit(False))
    late = F.coalesce(F.col("end") > F.col("duration") + 0.5, F.lit(False)) if durations is not None else F.lit(False)
    whole = [F.when(~((F.col("start") >= 0) & (F.col("start") < F.col("end"))), "start must be 0 or more and before end"), F.when(~known, "unknown label"), F.when(known & late, "ends after the video")]
    found = F.when(width, F.array(F.lit("an event needs a start, an end and a label"))).when(~finite, F.array(F.lit("times must be numbers"))).otherwise(F.array_compact(F.array(*whole)))
    alone = rows.select("video_id", "pos", F.explode(found).alias("problem"))
    double = overlaps(events.where(finite & known)).select("video_id", "pos", F.lit("overlaps the one before").alias("problem"))
    return alone.unionByName(double)


def class_check(segments: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """(label, events, kept, problem) of every label that occurs in segments; those outside
    ``labels`` (null too) are not kept, and the problem says so."""
    known = F.coalesce(F.col("label").isin(list(labels)), F.lit(False))
    seen = segments.groupBy("label").agg(F.count("*").alias("events")).withColumn("kept", known)
    return seen.withColumn("problem", F.when(~F.col("kept"), "not an official label: its events are left out"))


def official(segments: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """The segments of class_check's kept labels."""
    return segments.where(F.col("label").isin(list(labels)))


def risk_problems(risk: DataFrame) -> DataFrame:
    """(video_id, pos, problem): the first problem of each video's curve(video_id, pos, t_sec, score)."""
    w = Window.partitionBy("video_id").orderBy("pos")
    problem = (
        F.when(F.col("t_sec").isNull() | F.col("score").isNull() | F.isnan("t_sec") | F.isnan("score"), "not [t, score]")
        .when(F.col("t_sec") < F.coalesce(F.lag("t_sec").over(w), F.lit(-1.0)), "time goes back").when(~F.col("score").between(0, 1), "score outside [0, 1]")
    )
    rows = risk.withColumn("problem", problem).where("problem is not null")
    return rows.groupBy("video_id").agg(F.min_by(F.struct("pos", "problem"), "pos").alias("x")).select("video_id", "x.pos", "x.problem")


def prediction_problems(entries: DataFrame, events: DataFrame, risk: DataFrame, truth: DataFrame | None = None) -> DataFrame:
    """(video_id, severity, problem) over whole documents: entries(team, video_id, entry) with
    their events and risk, and, with truth(video_id, duration), missing and extra videos."""
    error = lambda df: df.select("video_id", F.lit("error").alias("severity"), "problem")
    warning = lambda df, text: df.select("video_id", F.lit("warning").alias("severity"), F.lit(text).alias("problem"))
    path = entries.where(F.rlike("video_id", F.lit(r"[/\\]"))).withColumn("problem", F.lit("a video is named by its file, without folders"))
    shape = entries.where("entry is null or entry.events is null").withColumn("problem", F.lit("events must be a list"))
    out = error(event_problems(events, truth)).unionByName(error(risk_problems(risk))).unionByName(error(path)).unionByName(error(shape))
    out = out.unionByName(warning(entries.where("entry.risk is null or size(entry.risk) = 0"), "no risk curve")).unionByName(warning(entries.where("team is null"), "missing team"))
    if truth is not None:
        have, want = entries.select("video_id").distinct(), truth.select("video_id").distinct()
        out = out.unionByName(error(want.join(have, "video_id", "left_anti").withColumn("problem", F.lit("missing from predictions"))))
        out = out.unionByName(warning(have.join(want, "video_id", "left_anti"), "not in the ground truth"))
    return out


def document_problems(docs: DataFrame, allowed: Sequence[str] = ("team", "videos"), doc: str = "doc", one_video: bool = False) -> DataFrame:
    """(path, problem) of raw documents: no strict JSON (duplicate keys too), unknown or unsafe
    fields, and, if asked, other than exactly one video."""
    top = F.from_json(doc, "map<string,string>")
    videos = F.map_keys(F.from_json(F.get_json_object(doc, "$.videos"), "map<string,string>"))
    unsafe = F.array(*[F.lit(x) for x in ("__proto__", "constructor", "prototype")])
    problem = (
        F.when(F.try_parse_json(doc).isNull(), "not strict JSON").when(F.arrays_overlap(F.concat(F.map_keys(top), F.coalesce(videos, F.array().cast("array<string>"))), unsafe), "unsafe key")
        .when(F.size(F.array_except(F.map_keys(top), F.array(*[F.lit(a) for a in allowed]))) > 0, "unknown field").when(F.lit(one_video) & (F.coalesce(F.size(videos), F.lit(0)) != 1), "need exactly one video")
    )
    return docs.select("path", problem.alias("problem")).where("problem is not null")


def harness_problems(entries: DataFrame) -> DataFrame:
    """(video_id, problem): entries without a log, or with an error in it."""
    log = F.col("entry.log")
    bad = F.exists(log, lambda x: F.contains(F.lower(x), F.lit("error")))
    problem = F.when(log.isNull(), "no log").when(bad, "log has an error")
    return entries.select("video_id", problem.alias("problem")).where("problem is not null")


def sidecar_problems(points: DataFrame) -> DataFrame:
    """(video_id, problem) of points(video_id, t_sec, track_id, x, y) in normalised units."""
    bad = F.col("t_sec").isNull() | F.isnan("t_sec") | (F.col("t_sec") < 0)
    out = F.coalesce(~(F.col("x").between(0, 1) & F.col("y").between(0, 1)), F.lit(True))
    problem = F.when(bad, "bad time").when(F.col("track_id").isNull(), "no track").when(out, "point outside")
    return points.select("video_id", problem.alias("problem")).where("problem is not null")


def scene_problems(parsed: DataFrame) -> DataFrame:
    """(camera_id, zone, problem) of parsed scene documents: version, ids, references, shapes,
    directions, enums and regions, for all cameras at once."""
    kinds = ("carriageway", "lanes", "stop_lines", "crossings", "signal_queue_zones", "traffic_lights", "lane_markings")
    out = parsed.where("scene is null or scene.schema_version is null or scene.schema_version <> 1").select("camera_id", F.lit("document").alias("zone"), F.lit("unsupported version").alias("problem"))
    size = parsed.where("scene is not null and (scene.authored_against is null or coalesce(scene.authored_against.image_width, 0) <= 0 or coalesce(scene.authored_against.image_height, 0) <= 0)")
    out = out.unionByName(size.select("camera_id", F.lit("document").alias("zone"), F.lit("bad image size").alias("problem")))
    each = {k: parsed.select("camera_id", F.explode(f"scene.{k}").alias("z")) for k in kinds}

    def add(df: DataFrame, test: Column, text: str) -> None:
        nonlocal out
        out = out.unionByName(df.where(test).select("camera_id", F.coalesce("z.id", F.lit("?")).alias("zone"), F.lit(text).alias("problem")))

    ids = None
    for df in each.values():
        part = df.select("camera_id", F.col("z.id").alias("zone"))
        ids = part if ids is None else ids.unionByName(part)
    twice = ids.groupBy("camera_id", "zone").agg(F.count("*").alias("n")).where("n > 1 or zone is null")
    out = out.unionByName(twice.select("camera_id", F.coalesce("zone", F.lit("?")).alias("zone"), F.lit("id missing or not unique").alias("problem")))
    empty = parsed.where("size(coalesce(scene.carriageway, array())) = 0").select("camera_id", F.lit("carriageway").alias("zone"), F.lit("no carriageway").alias("problem"))
    out = out.unionByName(empty)
    area = lambda p: F.abs(F.aggregate(F.sequence(F.lit(0), F.size(p) - 1), F.lit(0.0), lambda acc, i: acc + p[i][0] * F.element_at(p, (i + 1) % F.size(p) + 1)[1] - F.element_at(p, (i + 1) % F.size(p) + 1)[0] * p[i][1])) / 2
    for k in ("carriageway", "lanes", "crossings", "signal_queue_zones"):
        p = F.col("z.polygon")
        add(each[k], F.coalesce(F.size(p), F.lit(0)) < 3, "needs three vertices")
        add(each[k].where(F.size("z.polygon") >= 3), F.coalesce(area(p) < 1, F.lit(True)), "no area")
    lanes = each["lanes"]
    length = F.hypot(F.col("z.direction_to")[0] - F.col("z.direction_from")[0], F.col("z.direction_to")[1] - F.col("z.direction_from")[1])
    add(lanes, F.coalesce(length < 1, F.lit(True)), "no direction")
    turns = F.array(*[F.lit(x) for x in ("straight", "left", "right", "uturn")])
    add(lanes, F.size(F.array_except(F.coalesce("z.permitted_manoeuvres", F.array().cast("array<string>")), turns)) > 0, "unknown manoeuvre")
    for k in ("stop_lines", "lane_markings"):
        p = F.col("z.segment")
        add(each[k], F.coalesce(F.hypot(p[1][0] - p[0][0], p[1][1] - p[0][1]) < 1, F.lit(True)), "segment too short")
    add(each["stop_lines"], ~F.coalesce(F.col("z.approach_side").isin(-1, 1), F.lit(False)), "bad approach side")
    add(each["lane_markings"], ~F.coalesce(F.col("z.style").isin("solid", "dashed", "double"), F.lit(False)), "unknown style")
    roi = F.col("z.roi")
    add(each["traffic_lights"], ~F.coalesce((F.size(roi) == 4) & (roi[0] < roi[2]) & (roi[1] < roi[3]), F.lit(False)), "bad region")
    known = lanes.select("camera_id", F.col("z.id").alias("ref")).distinct()
    for k, field in (("stop_lines", "governs_lanes"), ("crossings", "lanes"), ("signal_queue_zones", "lanes"), ("traffic_lights", "controls_lanes"), ("lane_markings", "separates")):
        refs = each[k].select("camera_id", F.col("z.id").alias("zone"), F.explode(f"z.{field}").alias("ref"))
        out = out.unionByName(refs.join(known, ["camera_id", "ref"], "left_anti").select("camera_id", "zone", F.lit("unknown lane").alias("problem")))
    stops = each["stop_lines"].select("camera_id", F.col("z.id").alias("ref")).distinct()
    refs = lanes.where("z.governed_by_stop_line is not null").select("camera_id", F.col("z.id").alias("zone"), F.col("z.governed_by_stop_line").alias("ref"))
    return out.unionByName(refs.join(stops, ["camera_id", "ref"], "left_anti").select("camera_id", "zone", F.lit("unknown stop line").alias("problem")))


def is_authored(parsed: DataFrame) -> DataFrame:
    """(camera_id, authored): whether a camera's scene has no problem."""
    bad = scene_problems(parsed).select("camera_id").distinct().withColumn("bad", F.lit(True))
    return parsed.select("camera_id").distinct().join(bad, "camera_id", "left").select("camera_id", F.col("bad").isNull().alias("authored"))


def filename_problems(names: DataFrame) -> DataFrame:
    """(name, problem): names that are no plain video file names."""
    return names.where(~s.safe_filename(F.col("name"))).select("name", F.lit("unsafe file name").alias("problem"))
