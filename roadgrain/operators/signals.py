"""Traffic-light states from pixels, and per lane."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: hue bands (0-179), least saturation, value, lit pixels, share and lead
BANDS = {"red": ((0, 10), (170, 179)), "amber": ((11, 27),), "green": ((40, 95),)}
MIN_SATURATION, MIN_VALUE, MIN_LIT, MIN_SHARE, MIN_LEAD = 90, 110, 12, 0.5, 1.6


def signal_votes(pixels: DataFrame) -> DataFrame:
    """(video_id, frame_idx, light_id, state, confidence, lit, reason) from pixels(..., h, s, v).
    Ties go to red, then amber, then green."""
    lit = (F.col("s") >= MIN_SATURATION) & (F.col("v") >= MIN_VALUE)

    def band(name: str):  # noqa: ANN202
        out = F.lit(False)
        for low, high in BANDS[name]:
            out = out | F.col("h").between(low, high)
        return F.count_if(lit & out).alias(name)

    n = pixels.groupBy("video_id", "frame_idx", "light_id").agg(F.count_if(lit).alias("lit"), *[band(b) for b in BANDS])
    ranked = F.reverse(F.array_sort(F.array(*[F.struct(F.col(b).alias("n"), F.lit(-i).alias("o"), F.lit(b).alias("state")) for i, b in enumerate(BANDS)])))
    n = n.withColumn("ranked", ranked).withColumns({"first": F.col("ranked")[0], "second": F.col("ranked")[1]["n"]})
    share = F.when(F.col("lit") > 0, F.col("first.n") / F.col("lit")).otherwise(0.0)
    reason = (
        F.when(F.col("lit") < MIN_LIT, "few lit pixels").when(F.col("first.n") == 0, "no known hue").when(share < MIN_SHARE, "no majority")
        .when((F.col("second") > 0) & (F.col("first.n") / F.greatest(F.col("second"), F.lit(1)) < MIN_LEAD), "close runner-up").otherwise("ok")
    )
    out = n.withColumns({"reason": reason, "share": share})
    good = F.col("reason") == "ok"
    return out.select("video_id", "frame_idx", "light_id", F.when(good, F.col("first.state")).otherwise("unknown").alias("state"), F.when(good, F.col("share")).otherwise(0.0).alias("confidence"), "lit", "reason")


def lane_signals(states: DataFrame) -> DataFrame:
    """(lane, state, confidence) per video and frame from states(..., controls_lanes, state,
    confidence): unknown if no light is readable or they disagree, else the surest."""
    each = states.withColumn("lane", F.explode("controls_lanes"))
    known = F.when(F.col("state") != "unknown", F.col("state"))
    keys = [c for c in ("video_id", "frame_idx") if c in states.columns]
    out = each.groupBy(*keys, "lane").agg(F.count_distinct(known).alias("kinds"), F.max(known).alias("state"), F.max(F.when(known.isNotNull(), F.col("confidence"))).alias("confidence"))
    one = F.col("kinds") == 1
    return out.select(*keys, "lane", F.when(one, F.col("state")).otherwise("unknown").alias("state"), F.when(one, F.col("confidence")).otherwise(0.0).alias("confidence"))
