"""Scoring of risk curves while they come in: labels of the samples, where alarms begin, and
which accident takes which alarm. On the same rows each gives what its batch form in
operators.evaluation and operators.runs gives, in whatever order rows arrive within the
delay; rows behind the watermark are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from roadgrain.operators.evaluation import ALARM_GAP, ALARM_WINDOW, HORIZON, THETA
from roadgrain.streaming.stateful import PROVIDER, STARTED, clock

ALARM_OUT = "video_id string, kind string, t_sec double, alarm double, tta double"


def incident_pieces(incidents: DataFrame, piece_sec: float, started: float) -> DataFrame:
    """(said_of, label, start, from_sec, to_sec, from_ts): the seconds that accidents and near
    misses say something about, cut into pieces of at most ``piece_sec``, so that the state of
    the join is bounded whatever an incident's length. Others, and incidents that lack a time or
    end over HORIZON before they start, say nothing."""
    rows = incidents.where("label in ('accident', 'near_miss')").withColumn("__from", F.col("start") - HORIZON).where("end >= __from")
    cut = rows.select(F.col("video_id").alias("said_of"), "label", "start", "end", "__from", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("end") - F.col("__from")) / piece_sec))).alias("k"))
    cut = cut.withColumn("from_sec", F.col("__from") + F.col("k") * piece_sec).withColumn("to_sec", F.least("end", F.col("__from") + (F.col("k") + 1) * piece_sec))
    return cut.select("said_of", "label", "start", "from_sec", "to_sec", clock("from_sec", started).alias("from_ts"))


def label_stream(risk: DataFrame, incidents: DataFrame, delay: str = "10 seconds", piece_sec: float = 60.0, started: float = STARTED) -> DataFrame:
    """The distinct rows of risk(video_id, t_sec, score, ...) with ts and y, as
    evaluation.frame_labels labels them. An interval join of two streams, outer on the side of
    the samples: a sample waits until the watermark has passed it, a piece of an incident until
    it has passed the piece, then the group of a sample's pieces is one row. incidents
    (video_id, label, start, end) must be known ``delay`` after the first second they speak of."""
    samples = risk.withColumn("ts", clock("t_sec", started)).withWatermark("ts", delay)
    pieces = incident_pieces(incidents, piece_sec, started).withWatermark("from_ts", delay)
    # the times bound the state, a millisecond wider than the seconds that decide
    when = F.expr(f"ts >= from_ts - interval 1 millisecond and ts <= from_ts + interval {round(piece_sec * 1000) + 1} milliseconds")
    within = (F.col("video_id") == F.col("said_of")) & (F.col("t_sec") >= F.col("from_sec")) & (F.col("t_sec") <= F.col("to_sec"))
    accident, inside = F.col("label") == "accident", F.col("t_sec") >= F.col("start")
    said = samples.join(pieces, within & when, "leftOuter").groupBy(*risk.columns, "ts").agg(F.max(accident & inside).alias("__in"), F.max(accident & ~inside).alias("__before"), F.max(~accident).alias("__near"))
    y = F.when(F.col("__in"), None).when(F.col("__before"), 1).when(F.col("__near"), None).otherwise(0)
    return said.withColumn("y", y).drop("__in", "__before", "__near")


class AlarmProcessor(StatefulProcessor):
    """One video's samples and accidents in the order of their time. Rows wait in a list until
    the watermark has passed them, since earlier ones may still come; what stays is whether the
    last sample was high, when the last high one was, and the alarms still free."""

    def __init__(self, merge_gap: float, window: float, idle_sec: float | None):
        self.merge_gap, self.window = merge_gap, window
        self.idle_ms = None if idle_sec is None else int(max(idle_sec, window, merge_gap) * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "t_sec double, accident boolean, high boolean, counted boolean, ms long")
        self.held = handle.getValueState("held", "high boolean, last_high double, last_ms long, free array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        fresh = []
        for part in rows:
            for ts, t, accident, high, counted in zip(part["ts"], part["t_sec"], part["accident"], part["high"], part["counted"], strict=True):
                ms = pd.Timestamp(ts).value // 1_000_000
                if ms >= mark:
                    fresh.append((float(t), bool(accident), bool(high), bool(counted), int(ms)))
        if fresh:
            self.waiting.appendList(fresh)
            self.handle.registerTimer(min(r[4] for r in fresh) + 1)
        yield self._table(key[0], [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        rows = list(self.waiting.get()) if self.waiting.exists() else []
        due = sorted((tuple(r) for r in rows if r[4] < mark), key=lambda r: (r[0], not r[1]))
        later = [tuple(r) for r in rows if r[4] >= mark]
        high, last_high, last_ms, free = self.held.get() if self.held.exists() else (False, None, -1, [])
        out, free = [], list(free)
        for t, accident, now, counted, ms in due:
            last_ms = max(last_ms, ms)
            free = [a for a in free if a >= t - self.window]  # later accidents reach no further back
            if accident:
                usable = [a for a in free if a < t]
                if usable:
                    free.remove(usable[0])
                out.append(("accident", t, usable[0] if usable else None, t - usable[0] if usable else 0.0))
                continue
            if now and not high and (last_high is None or t - last_high >= self.merge_gap):
                if counted:
                    free.append(t)
                    out.append(("alarm", t, None, None))
            high, last_high = now, t if now else last_high
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(min(r[4] for r in later) + 1)
        else:
            self.waiting.clear()
        self.held.update((high, last_high, last_ms, free))
        if not later and self.idle_ms is not None:
            if last_ms + self.idle_ms < mark:
                self.held.clear()
            else:
                self.handle.registerTimer(last_ms + self.idle_ms + 1)
        yield self._table(key[0], out)

    @staticmethod
    def _table(video: str, out: list[tuple]) -> pd.DataFrame:
        table = pd.DataFrame([(video, *r) for r in out], columns=["video_id", "kind", "t_sec", "alarm", "tta"])
        return table.astype({"t_sec": float, "alarm": float, "tta": float})

    def close(self) -> None:
        pass


def alarm_stream(labelled: DataFrame, incidents: DataFrame, theta: float = THETA, merge_gap: float = ALARM_GAP, window: float = ALARM_WINDOW, delay: str = "10 seconds", idle_sec: float | None = None, started: float = STARTED) -> DataFrame:
    """(video_id, kind, t_sec, alarm, tta): a row for every alarm that counts (kind alarm: y of its
    first sample is not null), as runs.alarm_starts, and one for every accident with the alarm it
    takes (kind accident; alarm null and tta 0 without one), as evaluation.alarm_matches.
    labelled(video_id, t_sec, score, y): one row per sample; read label_stream's table. A
    video silent for ``idle_sec`` of the watermark is over and its state goes; None: it stays, a
    few numbers a video."""
    samples = labelled.select("video_id", "t_sec", F.lit(False).alias("accident"), F.coalesce(F.col("score") >= theta, F.lit(False)).alias("high"), F.col("y").isNotNull().alias("counted"))
    accidents = incidents.where("label = 'accident'").select("video_id", F.col("start").alias("t_sec"), F.lit(True).alias("accident"), F.lit(False).alias("high"), F.lit(False).alias("counted"))
    rows = samples.unionByName(accidents).where("t_sec is not null").withColumn("ts", clock("t_sec", started)).withWatermark("ts", delay)
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return rows.groupBy("video_id").transformWithStateInPandas(statefulProcessor=AlarmProcessor(merge_gap, window, idle_sec), outputStructType=ALARM_OUT, outputMode="append", timeMode="EventTime")
