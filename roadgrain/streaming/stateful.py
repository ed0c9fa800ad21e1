"""Per-video stateful streams: causal risk and detection linking.

Input rows are frames: video_id, frame_idx, t_sec, ts and boxes, an array of structs
(empty where nothing was seen, so that a frame without boxes still counts). The frames
of a video arrive in order; rows that go back in time, or come behind the watermark,
are dropped. State is typed and keyed by video. An event-time timer stands ``idle``
after a video's last frame: when the watermark passes it the video's state is removed,
so the store holds live videos only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from roadgrain.functions.scalars import PERSON
from roadgrain.operators.linking import Linking, Live, boxes_of, link_sample
from roadgrain.operators.risk import Risk

RISK_OUT = "video_id string, frame_idx long, t_sec double, score double, failures long"
LINK_OUT = "video_id string, frame_idx long, t_sec double, det long, track_id long"
#: Seconds without a frame after which a video is over: what is remembered is younger.
IDLE_SEC = 5.0
#: When recordings without a known start begin, in seconds: the watermark itself begins at 0.
STARTED = 1_000_000_000.0
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Estimator:
    """A plug-in for risk_stream. state_schema: the columns of its state, for one video;
    reset() gives the first state, a dict of them, step() a score for one frame from the
    state so far (which it may change). Never looks ahead."""

    state_schema = "nothing int"

    def reset(self) -> dict:
        return {"nothing": 0}

    def step(self, state: dict, frame_idx: int, t_sec: float, boxes: list[dict]) -> float:
        raise NotImplementedError


class PairRisk(Estimator):
    """Collision risk of tracked boxes(track_id, cls, gx, gy, h), as roadgrain.operators.risk.
    State: the last scores, and the places of the last ``most_span`` seconds, a row a place."""

    state_schema = "score double, raw array<double>, ids array<long>, ts array<double>, xs array<double>, ys array<double>"

    def __init__(self, th: Risk | None = None):
        self.th = th or Risk()

    def reset(self) -> dict:
        return {"score": 0.0, "raw": [], "ids": [], "ts": [], "xs": [], "ys": []}

    def step(self, state: dict, frame_idx: int, t_sec: float, boxes: list[dict]) -> float:
        if frame_idx % self.th.every == 0:
            score = self._sample(state, t_sec, boxes)
            if score == score:  # not NaN
                state["score"] = min(1.0, max(0.0, score))
        return round(state["score"], 4)

    def _sample(self, state: dict, t: float, boxes: list[dict]) -> float:
        th = self.th
        ids, ts, xs, ys = (np.array(state[k], kind) for k, kind in (("ids", np.int64), ("ts", float), ("xs", float), ("ys", float)))
        young = t - ts <= th.most_span
        ids, ts, xs, ys = ids[young], ts[young], xs[young], ys[young]
        mine = np.array([b["track_id"] for b in boxes], np.int64)
        here = np.array([(b["gx"], b["gy"], max(b["h"], 0.0), b["cls"] == PERSON) for b in boxes], float).reshape(-1, 4)
        old = np.full(len(mine), -1)
        ready = np.flatnonzero(t - ts >= th.least_span)
        if len(ready) and len(mine):
            same = ids[ready][None, :] == mine[:, None]
            last = np.where(same, ready[None, :], -1).max(1)
            old = last
        live = np.flatnonzero(old >= 0)
        p, at = here[live], old[live]
        v = (p[:, :2] - np.stack([xs[at], ys[at]], 1)) / (t - ts[at])[:, None] if len(live) else np.zeros((0, 2))
        worst = self._worst(p, v)
        state |= {"ids": np.concatenate([ids, mine]).tolist(), "ts": np.concatenate([ts, np.full(len(mine), t)]).tolist(), "xs": np.concatenate([xs, here[:, 0]]).tolist(), "ys": np.concatenate([ys, here[:, 1]]).tolist()}
        state["raw"] = [*state["raw"], worst][-th.persist :]
        return min(state["raw"]) if len(state["raw"]) == th.persist else 0.0

    def _worst(self, p: np.ndarray, v: np.ndarray) -> float:
        """The most urgent pair's score."""
        i, j = np.triu_indices(len(p), 1)
        r, w = p[j, :2] - p[i, :2], v[j] - v[i]
        ww, rw, dist = (w * w).sum(1), (r * w).sum(1), np.hypot(r[:, 0], r[:, 1])
        size = (p[i, 2] + p[j, 2]) / 2
        ok = (ww > 1e-9) & (rw < 0) & (dist > 1e-9) & ~((p[i, 3] > 0) & (p[j, 3] > 0))
        when = np.where(ok, -rw / np.where(ok, ww, 1), 0)
        near = np.hypot(r[:, 0] + w[:, 0] * when, r[:, 1] + w[:, 1] * when) <= self.th.radius * size
        closing = np.where(ok, -rw / np.where(ok, dist, 1), 0) >= self.th.min_closing * size
        hit = ok & near & closing
        return float((0.5 ** (when[hit] / self.th.half_life)).max()) if hit.any() else 0.0


class VideoProcessor(StatefulProcessor):
    """Frames of a video in order over one typed state; subclasses say what a frame does."""

    state_schema = ""

    def __init__(self, columns: list[str], idle_sec: float):
        self.columns, self.idle_ms = columns, int(idle_sec * 1000)

    def fresh(self) -> dict:
        raise NotImplementedError

    def frame(self, state: dict, frame_idx: int, t_sec: float, boxes: list[dict]) -> list[tuple]:
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "last_frame long, last_ms long")
        self.own = handle.getValueState("own", self.state_schema)
        self.names = [c.split()[0] for c in self.state_schema.split(", ")]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrived = pd.concat(list(rows)).sort_values("frame_idx")
        mark = timerValues.getCurrentWatermarkInMs()
        held = self.place.get() if self.place.exists() else (-(1 << 62), -1)
        last, last_ms = int(held[0]), int(held[1])
        state = dict(zip(self.names, self.own.get(), strict=True)) if self.own.exists() else self.fresh()
        out, before = [], last_ms
        for f, t, ts, boxes in zip(arrived["frame_idx"], arrived["t_sec"], arrived["ts"], arrived["boxes"], strict=True):
            at = int(pd.Timestamp(ts).timestamp() * 1000)
            if f > last and at >= mark:  # late and repeated frames are dropped
                last, last_ms = int(f), max(last_ms, at)
                plain = [b.asDict() if hasattr(b, "asDict") else dict(b) for b in (boxes if boxes is not None else [])]
                out += [(key[0], int(f), float(t), *r) for r in self.frame(state, int(f), float(t), plain)]
        if last_ms != before:
            if before >= 0:
                self.handle.deleteTimer(before + self.idle_ms)
            self.handle.registerTimer(last_ms + self.idle_ms)
            self.place.update((last, last_ms))
            self.own.update(tuple(state[n] for n in self.names))
        yield pd.DataFrame(out, columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.place.clear()
        self.own.clear()
        yield pd.DataFrame([], columns=self.columns)

    def close(self) -> None:
        pass


class RiskProcessor(VideoProcessor):
    def __init__(self, columns: list[str], idle_sec: float, estimator: Estimator):
        super().__init__(columns, idle_sec)
        self.estimator = estimator
        self.state_schema = "held double, failed long, " + estimator.state_schema

    def fresh(self) -> dict:
        return {"held": 0.0, "failed": 0, **self.estimator.reset()}

    def frame(self, state: dict, frame_idx: int, t_sec: float, boxes: list[dict]) -> list[tuple]:
        try:
            state["held"] = float(self.estimator.step(state, frame_idx, t_sec, boxes))
        except Exception:  # a plug-in's failure must not stop the other videos of the batch; it is counted
            state["failed"] += 1
        return [(state["held"], state["failed"])]


class LinkProcessor(VideoProcessor):
    state_schema = "ids array<long>, kinds array<long>, box array<double>, move array<double>, seen array<double>"

    def __init__(self, columns: list[str], idle_sec: float, th: Linking):
        super().__init__(columns, idle_sec)
        self.th = th

    def fresh(self) -> dict:
        return {n: [] for n in ("ids", "kinds", "box", "move", "seen")}

    def frame(self, state: dict, frame_idx: int, t_sec: float, boxes: list[dict]) -> list[tuple]:
        array = lambda n, kind, *shape: np.array(state[n], kind).reshape(*shape)
        live = Live(array("ids", np.int64, -1), array("kinds", np.int64, -1), array("box", float, -1, 4), array("move", float, -1, 2), array("seen", float, -1))
        det, cls, conf, box = boxes_of(boxes)
        live, ids = link_sample(live, t_sec, det, cls, conf, box, self.th)
        state |= {"ids": live.ids.tolist(), "kinds": live.cls.tolist(), "box": live.box.ravel().tolist(), "move": live.move.ravel().tolist(), "seen": live.seen.tolist()}
        return list(zip(det.tolist(), ids.tolist(), strict=True))


def _stream(frames: DataFrame, processor: VideoProcessor, schema: str) -> DataFrame:
    # typed state needs the RocksDB store, which also keeps it out of the executors' heaps
    frames.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return frames.groupBy("video_id").transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="append", timeMode="EventTime")


def _columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def risk_stream(frames: DataFrame, estimator: Estimator | None = None, delay: str = "2 seconds", idle_sec: float = IDLE_SEC) -> DataFrame:
    """(video_id, frame_idx, t_sec, score, failures) for every frame of a stream, in order per
    video. An estimator that fails on a frame leaves the score at its last value; failures
    counts the video's so far."""
    return _stream(frames.withWatermark("ts", delay), RiskProcessor(_columns(RISK_OUT), idle_sec, estimator or PairRisk()), RISK_OUT)


def link_stream(frames: DataFrame, th: Linking | None = None, delay: str = "2 seconds", idle_sec: float = IDLE_SEC) -> DataFrame:
    """(video_id, frame_idx, t_sec, det, track_id) for every box of a stream of frames, as
    operators.linking.link gives them. idle_sec must not be under the tracks' buffer."""
    th = th or Linking()
    if idle_sec < th.buffer_sec:
        raise ValueError("a video's state would go before its tracks end")
    return _stream(frames.withWatermark("ts", delay), LinkProcessor(_columns(LINK_OUT), idle_sec, th), LINK_OUT)


def clock(t_sec: str = "t_sec", started: float = STARTED) -> Column:
    """The time of a frame as a timestamp, for recordings that began at ``started``."""
    return F.timestamp_seconds(F.col(t_sec) + started)


def frames_of(tracks: DataFrame, ticks: DataFrame) -> DataFrame:
    """ticks(video_id, frame_idx, t_sec) with the boxes of tracks in each frame, and ts."""
    box = F.struct("track_id", "cls", "gx", "gy", (F.col("y2") - F.col("y1")).alias("h"))
    boxes = tracks.where("track_id >= 0").groupBy("video_id", "frame_idx").agg(F.array_sort(F.collect_list(box)).alias("boxes"))
    joined = ticks.join(boxes, ["video_id", "frame_idx"], "left")
    return joined.select("video_id", "frame_idx", "t_sec", clock().alias("ts"), F.coalesce("boxes", F.array().cast(boxes.schema["boxes"].dataType)).alias("boxes"))
