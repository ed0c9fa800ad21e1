"""Linking detections to tracks: the best one-to-one assignment at every sample.

A detection resembles a track by the larger of two numbers: the overlap of its box with
the track's last one, carried on at the track's speed, and how near the two centres are,
in box heights (scalars.motion_similarity says the same for Columns). At each sample the
sure detections are assigned first, to all tracks, then the unsure ones to the tracks
that are left; every assignment has the greatest sum of similarities above the least
that counts. A track that no detection joins for ``buffer_sec`` ends. A track's id is
the number of its first detection, so batch and stream, which run the same steps, agree.

Departure: a track moves on at the speed between its last two samples, without a filter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadgrain.functions.scalars import PERSON
from roadgrain.operators import runs

DETECTION = ("det", "cls", "conf", "x1", "y1", "x2", "y2")


@dataclass(frozen=True)
class Linking:
    """Confidences; similarities that a match must be over; reach in mean box
    heights a sample; the factor by which a box's height may change."""

    high: float = 0.25
    low: float = 0.10
    fresh: float = 0.25
    least: float = 0.2
    least_unsure: float = 0.5
    buffer_sec: float = 2.0
    reach_person: float = 1.5
    reach_vehicle: float = 2.5
    max_size_ratio: float = 1.5


def least_cost(cost: np.ndarray) -> np.ndarray:
    """The column of every row (no more rows than columns) such that the sum is least:
    rows are added one by one along shortest augmenting paths."""
    n, m = cost.shape
    if m <= SMALL:
        return np.array(_least_cost_of_few(cost.tolist(), n, m), int)
    row_price, col_price = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for added in range(n):
        dist, via, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, col, base = added, -1, 0.0
        while True:
            step = base + cost[row] - row_price[row] - col_price
            better = ~done & (step < dist)
            dist[better], via[better] = step[better], col
            col = int(np.argmin(np.where(done, np.inf, dist)))
            base, done[col] = dist[col], True
            if owner[col] < 0:
                break
            row = owner[col]
        row_price[added] += base
        settled = np.flatnonzero(done & (owner >= 0))
        row_price[owner[settled]] += base - dist[settled]
        col_price[done] -= base - dist[done]
        while col >= 0:
            before = via[col]
            owner[col] = added if before < 0 else owner[before]
            col = before
    out = np.empty(n, int)
    taken = np.flatnonzero(owner >= 0)
    out[owner[taken]] = taken
    return out


#: Columns up to which plain lists are faster than arrays.
SMALL = 24


def _least_cost_of_few(cost: list[list[float]], n: int, m: int) -> list[int]:
    """least_cost step by step on lists: the same sums in the same order."""
    row_price, col_price, owner = [0.0] * n, [0.0] * m, [-1] * m
    for added in range(n):
        dist, via, done = [math.inf] * m, [-1] * m, [False] * m
        row, col, base = added, -1, 0.0
        while True:
            mine, price, best, least = cost[row], row_price[row], -1, math.inf
            for j in range(m):
                if not done[j]:
                    step = base + mine[j] - price - col_price[j]
                    if step < dist[j]:
                        dist[j], via[j] = step, col
                    if dist[j] < least:
                        best, least = j, dist[j]
            col, base = best, least
            done[col] = True
            if owner[col] < 0:
                break
            row = owner[col]
        row_price[added] += base
        for j in range(m):
            if done[j]:
                if owner[j] >= 0:
                    row_price[owner[j]] += base - dist[j]
                col_price[j] -= base - dist[j]
        while col >= 0:
            before = via[col]
            owner[col] = added if before < 0 else owner[before]
            col = before
    out = [0] * n
    for j, i in enumerate(owner):
        if i >= 0:
            out[i] = j
    return out


def best_pairs(gain: np.ndarray) -> list[tuple[int, int]]:
    """One-to-one pairs of rows and columns with the greatest sum of gains; only gains over 0
    count. Rows and columns that no chain of gains connects are settled apart."""
    rows, cols = np.nonzero(gain > 0)
    if not len(rows):
        return []
    part = np.arange(gain.shape[0] + gain.shape[1])
    ends = cols + gain.shape[0]
    while True:
        low = np.minimum(part[rows], part[ends])
        before = part.copy()
        np.minimum.at(part, rows, low)
        np.minimum.at(part, ends, low)
        if (part == before).all():
            break
    out = []
    for p in np.unique(part[rows]):
        r, c = np.flatnonzero(part[: gain.shape[0]] == p), np.flatnonzero(part[gain.shape[0] :] == p)
        small = gain[np.ix_(r, c)]
        if len(r) == 1 or len(c) == 1:
            at = int(np.argmax(small))
            got = [(at // len(c), at % len(c))]
        elif len(r) <= len(c):
            got = list(enumerate(least_cost(small.max() - np.maximum(small, 0)).tolist()))
        else:
            got = [(i, j) for j, i in enumerate(least_cost((small.max() - np.maximum(small, 0)).T).tolist())]
        out += [(int(r[i]), int(c[j])) for i, j in got if small[i, j] > 0]
    return out


def similarity(a: np.ndarray, a_cls: np.ndarray, b: np.ndarray, b_cls: np.ndarray, th: Linking) -> np.ndarray:
    """(tracks, detections) max(overlap, nearness) of boxes x1, y1, x2, y2; 0 between people
    and vehicles."""
    return _likeness(a[:, None, :], (a_cls == PERSON)[:, None], b[None, :, :], (b_cls == PERSON)[None, :], th)


def _likeness(a: np.ndarray, a_person: np.ndarray, b: np.ndarray, b_person: np.ndarray, th: Linking) -> np.ndarray:
    """similarity of boxes that are already set against each other, along the last axis."""
    x1, y1, x2, y2 = (a[..., k] for k in range(4))
    u1, v1, u2, v2 = (b[..., k] for k in range(4))
    shared = np.maximum(0, np.minimum(x2, u2) - np.maximum(x1, u1)) * np.maximum(0, np.minimum(y2, v2) - np.maximum(y1, v1))
    union = (x2 - x1) * (y2 - y1) + (u2 - u1) * (v2 - v1) - shared
    overlap = np.where(union > 0, shared / np.where(union > 0, union, 1), 0)
    tall, high = np.maximum(y2 - y1, 1e-3), np.maximum(v2 - v1, 1e-3)
    apart = np.hypot((x1 + x2 - u1 - u2) / 2, (y1 + y2 - v1 - v2) / 2) / ((tall + high) / 2)
    near = np.clip(1 - apart / np.where(a_person, th.reach_person, th.reach_vehicle), 0, 1)
    ratio = high / tall
    near = np.where((ratio < th.max_size_ratio) & (ratio > 1 / th.max_size_ratio), near, 0)
    return np.where(a_person == b_person, np.maximum(overlap, near), 0)


@dataclass
class Live:
    """The tracks of a video that may go on. move: of the centre, a second."""

    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    cls: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    box: np.ndarray = field(default_factory=lambda: np.zeros((0, 4)))
    move: np.ndarray = field(default_factory=lambda: np.zeros((0, 2)))
    seen: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def kept(self, which: np.ndarray) -> Live:
        return Live(self.ids[which], self.cls[which], self.box[which], self.move[which], self.seen[which])


def link_sample(live: Live, t: float, det: np.ndarray, cls: np.ndarray, conf: np.ndarray, box: np.ndarray, th: Linking) -> tuple[Live, np.ndarray]:
    """The tracks after a sample at time t, and its detections' track ids (-1: none)."""
    live = live.kept(t - live.seen <= th.buffer_sec)
    ids, found = np.full(len(det), -1, np.int64), np.full(len(live.ids), -1)
    shift = live.move * (t - live.seen)[:, None]
    ahead = live.box + np.concatenate([shift, shift], 1)
    for which, least in ((conf >= th.high, th.least), ((conf >= th.low) & (conf < th.high), th.least_unsure)):
        free, here = np.flatnonzero(found < 0), np.flatnonzero(which)
        if len(free) and len(here):
            for i, j in best_pairs(similarity(ahead[free], live.cls[free], box[here], cls[here], th) - least):
                found[free[i]], ids[here[j]] = here[j], live.ids[free[i]]
    at = np.flatnonzero(found >= 0)
    new = found[at]
    if len(at):
        centre = lambda b: (b[:, :2] + b[:, 2:]) / 2
        dt = np.maximum(t - live.seen[at], 1e-6)[:, None]
        live.move[at] = (centre(box[new]) - centre(live.box[at])) / dt
        live.box[at], live.cls[at], live.seen[at] = box[new], cls[new], t
    born = np.flatnonzero((ids < 0) & (conf >= max(th.fresh, th.high)))
    ids[born] = det[born]
    more = (np.concatenate(p) for p in ((live.ids, det[born]), (live.cls, cls[born]), (live.box, box[born]), (live.move, np.zeros((len(born), 2))), (live.seen, np.full(len(born), t))))
    return Live(*more), ids


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its count, one range after the other."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def listed_pairs(rows: np.ndarray, cols: np.ndarray, gain: np.ndarray, n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """best_pairs for gains over 0 that are listed, by row, then column: of n rows and m columns.
    Rows and columns of different videos have no gains, so they are settled in one go."""
    row_n, col_n = np.bincount(rows, minlength=n), np.bincount(cols, minlength=m)
    alone = (row_n[rows] == 1) & (col_n[cols] == 1)
    got_r, got_c = [rows[alone]], [cols[alone]]
    rows, cols, gain = rows[~alone], cols[~alone], gain[~alone]
    if len(rows):
        part, ends = np.arange(n + m), cols + n
        while True:
            low, before = np.minimum(part[rows], part[ends]), part.copy()
            np.minimum.at(part, rows, low)
            np.minimum.at(part, ends, low)
            if (part == before).all():
                break
        order = np.argsort(part[rows], kind="stable")
        rows, cols, gain, of = rows[order], cols[order], gain[order], part[rows][order]
        firsts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        # one row or one column: the greatest gain, the first of equal ones
        star = (np.minimum.reduceat(rows, firsts) == np.maximum.reduceat(rows, firsts)) | (np.minimum.reduceat(cols, firsts) == np.maximum.reduceat(cols, firsts))
        best = np.lexsort((-gain, of))[firsts[star]]
        got_r.append(rows[best])
        got_c.append(cols[best])
        ends = np.concatenate([firsts[1:], [len(of)]])
        pairs = []
        for a, b in zip(firsts[~star].tolist(), ends[~star].tolist(), strict=True):
            edges = list(zip(rows[a:b].tolist(), cols[a:b].tolist(), gain[a:b].tolist(), strict=True))
            r, c = sorted({e[0] for e in edges}), sorted({e[1] for e in edges})
            at_r, at_c = {v: k for k, v in enumerate(r)}, {v: k for k, v in enumerate(c)}
            small = np.zeros((len(r), len(c)))
            for x, y, v in edges:
                small[at_r[x], at_c[y]] = v
            if len(r) <= len(c):
                got = enumerate(least_cost(small.max() - small).tolist())
            else:
                got = ((i, j) for j, i in enumerate(least_cost((small.max() - small).T).tolist()))
            pairs += [(r[i], c[j]) for i, j in got if small[i, j] > 0]
        if pairs:
            got_r.append(np.array([p[0] for p in pairs]))
            got_c.append(np.array([p[1] for p in pairs]))
    return np.concatenate(got_r), np.concatenate(got_c)


def link_parts(part: np.ndarray, frame: np.ndarray, t: np.ndarray, det: np.ndarray, cls: np.ndarray, conf: np.ndarray, box: np.ndarray, th: Linking) -> np.ndarray:
    """The track ids of the detections of many parts of videos, rows in order of part (0, 1, ...),
    frame and det: link_sample over the samples of each, but the first samples of all parts at
    once, then the second ones, and so on."""
    out = np.full(len(part), -1, np.int64)
    begins = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (frame[1:] != frame[:-1])]))
    lengths, owner = np.diff(np.concatenate([begins, [len(part)]])), part[begins]
    parts = int(part[-1]) + 1
    samples = np.bincount(owner, minlength=parts)
    nth = _spread(np.zeros(parts, np.int64), samples)
    by_nth = np.argsort(nth, kind="stable")
    cuts = np.concatenate([[0], np.cumsum(np.bincount(nth))])
    live, mine = Live(), np.zeros(0, np.int64)
    for k in range(len(cuts) - 1):
        now = by_nth[cuts[k] : cuts[k + 1]]  # frames, in order of their parts
        time = np.full(parts, -np.inf)
        time[owner[now]] = t[begins[now]]
        rows = _spread(begins[now], lengths[now])
        with np.errstate(invalid="ignore"):
            stays = (samples[mine] > k) & (time[mine] - live.seen <= th.buffer_sec)
        live, mine = live.kept(stays), mine[stays]
        seen_n = np.bincount(part[rows], minlength=parts)
        # every track with every detection of its part
        width = seen_n[mine]
        i, j = np.repeat(np.arange(len(mine)), width), _spread((np.cumsum(seen_n) - seen_n)[mine], width)
        shift = live.move * (time[mine] - live.seen)[:, None]
        ahead = live.box + np.concatenate([shift, shift], 1)
        c, b, sure = cls[rows], box[rows], conf[rows]
        like = _likeness(ahead[i], live.cls[i] == PERSON, b[j], c[j] == PERSON, th)
        found, ids = np.full(len(mine), -1), np.full(len(rows), -1, np.int64)
        for which, least in ((sure >= th.high, th.least), ((sure >= th.low) & (sure < th.high), th.least_unsure)):
            pick = np.flatnonzero((like - least > 0) & which[j] & (found[i] < 0))
            if len(pick):
                x, y = listed_pairs(i[pick], j[pick], like[pick] - least, len(mine), len(rows))
                found[x], ids[y] = y, live.ids[x]
        at = np.flatnonzero(found >= 0)
        new = found[at]
        centre = lambda v: (v[:, :2] + v[:, 2:]) / 2
        when = time[mine[at]]
        live.move[at] = (centre(b[new]) - centre(live.box[at])) / np.maximum(when - live.seen[at], 1e-6)[:, None]
        live.box[at], live.cls[at], live.seen[at] = b[new], c[new], when
        born = np.flatnonzero((ids < 0) & (sure >= max(th.fresh, th.high)))
        ids[born] = det[rows[born]]
        out[rows] = ids
        home = part[rows[born]]
        more = Live(*(np.concatenate(p) for p in ((live.ids, ids[born]), (live.cls, c[born]), (live.box, b[born]), (live.move, np.zeros((len(born), 2))), (live.seen, time[home]))))
        mine = np.concatenate([mine, home])
        order = np.argsort(mine, kind="stable")
        live, mine = more.kept(order), mine[order]
    return out


#: Rows that a task links at once (a longer part of a video by itself).
LINK_ROWS = 1 << 17


def _parts(table: pa.Table) -> tuple[np.ndarray, int]:
    """The number of each row's part of a video, and the row where the last one begins."""
    video = table.column("video_id").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
    island = table.column("island").to_numpy()
    part = np.cumsum(np.concatenate([[0], (video[1:] != video[:-1]) | (island[1:] != island[:-1])]))
    return part, int(np.searchsorted(part, part[-1]))


def _ids(table: pa.Table, part: np.ndarray, th: Linking) -> pa.Table:
    got = {c: table.column(c).to_numpy() for c in ("frame_idx", "t_sec", *DETECTION)}
    box = np.stack([got[c] for c in ("x1", "y1", "x2", "y2")], 1).astype(float)
    ids = link_parts(part, got["frame_idx"], got["t_sec"].astype(float), got["det"].astype(np.int64), got["cls"].astype(np.int64), got["conf"].astype(float), box, th)
    return table.drop_columns(["t_sec", "island"]).append_column("track_id", pa.array(ids))


def link(detections: DataFrame, th: Linking | None = None) -> DataFrame:
    """Adds track_id to detections(video_id, frame_idx, t_sec, det, cls, conf, x1, y1, x2, y2);
    -1 for those that join no track. det: a number of its own within the video.

    A video is cut where no sample comes for longer than a track lives: no track
    crosses such a gap, so the parts are linked apart and give what the whole would. The
    window deals and sorts rows by video; a task links many parts side by side.
    Samples without detections need no rows.
    """
    th = th or Linking()
    kinds = detections.select("video_id", "frame_idx", *DETECTION)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds.schema.fields) + ", track_id long"

    limit = LINK_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, most = [], limit
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= most:
                table = pa.Table.from_batches(held)
                part, last = _parts(table)
                if last:
                    yield from _ids(table.slice(0, last), part[:last], th).to_batches()
                held, most = table.slice(last).to_batches(), limit if last else 2 * most
        if sum(b.num_rows for b in held):
            table = pa.Table.from_batches(held)
            yield from _ids(table, _parts(table)[0], th).to_batches()

    cut = runs.with_islands(detections.select("video_id", "frame_idx", *DETECTION, "t_sec"), ["video_id"], "t_sec", F.lit(th.buffer_sec))
    return cut.sortWithinPartitions("video_id", "island", "frame_idx", "det").mapInArrow(run, schema)


def frames_of(detections: DataFrame) -> DataFrame:
    """(video_id, frame_idx, t_sec, boxes) of detections, boxes in the order of det."""
    return detections.groupBy("video_id", "frame_idx").agg(F.min("t_sec").alias("t_sec"), F.array_sort(F.collect_list(F.struct(*DETECTION))).alias("boxes"))


def boxes_of(rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """det, cls, conf and box arrays of a frame's boxes."""
    plain = [tuple(r[c] for c in DETECTION) for r in rows]
    det, cls = (np.array([p[k] for p in plain], np.int64) for k in (0, 1))
    return det, cls, np.array([p[2] for p in plain], float), np.array([p[3:] for p in plain], float).reshape(-1, 4)


def steps(frames: Iterator[tuple[float, list]], live: Live, th: Linking) -> Iterator[tuple[Live, np.ndarray, np.ndarray]]:
    """Links frame after frame: the tracks after each, its dets and their track ids."""
    for t, rows in frames:
        det, cls, conf, box = boxes_of(rows)
        live, ids = link_sample(live, t, det, cls, conf, box, th)
        yield live, det, ids
