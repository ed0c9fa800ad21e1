"""One camera pose per video from frame matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: what a believable match and pose are
MIN_INLIERS, MIN_SHARE, MIN_GOOD, MAX_ANGLE, MAX_SCALE, MAX_SHIFT, MAX_DRIFT = 40, 0.30, 1, 4.0, 0.06, 0.10, 8.0


def parameters(m00: Column, m02: Column, m10: Column, m12: Column) -> Column:
    """struct<scale, angle_deg, tx, ty> of a similarity matrix."""
    return F.struct(F.hypot(m00, m10).alias("scale"), F.degrees(F.atan2(m10, m00)).alias("angle_deg"), m02.alias("tx"), m12.alias("ty"))


def corner_gap(p: Column, q: Column, width: float, height: float) -> Column:
    """The largest distance between an image corner moved by p and by q."""

    def moved(pose: Column, x: float, y: float) -> tuple[Column, Column]:
        c, s = F.cos(F.radians(pose["angle_deg"])) * pose["scale"], F.sin(F.radians(pose["angle_deg"])) * pose["scale"]
        return c * x - s * y + pose["tx"], s * x + c * y + pose["ty"]

    gaps = []
    for x, y in ((0, 0), (width, 0), (0, height), (width, height)):
        (a, b), (c, d) = moved(p, x, y), moved(q, x, y)
        gaps.append(F.hypot(a - c, b - d))
    return F.greatest(*gaps)


def estimate_poses(matches: DataFrame, width: float = 640.0, height: float = 360.0) -> DataFrame:
    """(video_id, pose) from matches(video_id, t_sec, m00, m02, m10, m12, inliers, matches):
    the median of the good frames' parameters, or no change with a reason."""
    share = F.col("inliers") / F.greatest(F.col("matches"), F.lit(1))
    good = F.col("m00").isNotNull() & (F.col("inliers") >= MIN_INLIERS) & (share >= MIN_SHARE)
    rows = matches.withColumns({"good": F.coalesce(good, F.lit(False)), "p": parameters(*[F.col(c) for c in ("m00", "m02", "m10", "m12")])})
    median = lambda c: F.median(F.when(F.col("good"), F.col(f"p.{c}"))).alias(c)
    mid = rows.groupBy("video_id").agg(F.count("*").alias("frames"), F.count_if("good").alias("good_frames"), F.floor(F.median("inliers")).cast("int").alias("median_inliers"), *[median(c) for c in ("scale", "angle_deg", "tx", "ty")])
    med = mid.select("video_id", F.struct("scale", "angle_deg", "tx", "ty").alias("m"))
    drift = rows.where("good").join(med, "video_id").groupBy("video_id").agg(F.max(corner_gap(F.col("p"), F.col("m"), width, height)).alias("drift"))
    out = mid.join(drift, "video_id", "left")
    reason = (
        F.when(F.col("good_frames") < MIN_GOOD, "weak match").when(F.abs("angle_deg") > MAX_ANGLE, "implausible rotation").when(F.abs(F.col("scale") - 1) > MAX_SCALE, "implausible scale")
        .when(F.hypot("tx", "ty") > MAX_SHIFT * width, "implausible shift").when(F.col("drift") > MAX_DRIFT, "frames disagree").otherwise("aligned")
    )
    out = out.withColumn("reason", reason)
    ok = F.col("reason") == "aligned"
    pick = lambda c, other: F.when(ok, F.col(c)).otherwise(other).alias(c)
    pose = F.struct(pick("scale", 1.0), pick("angle_deg", 0.0), pick("tx", 0.0), pick("ty", 0.0), "good_frames", "frames", "median_inliers", F.round("drift", 2).alias("drift_px"), "reason")
    return out.select("video_id", pose.alias("pose"))
