"""Live tracking of sessions on a stream: buffered in event order, throttled, inspected, calibrated, smoothed.

Ticks may arrive in any order within the watermark's delay. They wait in pages of event time, and a timer at the oldest waiting tick
works off what the watermark has passed, page by page and in order, so neither a micro-batch nor a session is ever one list in memory.
A session's state is one small value. A session that was idle long enough starts anew; a timer clears its state if no tick comes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import signals as S

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
THROTTLE_MS, INSPECT_MS = 1000 / 30, 500
PAGE_MS, IDLE_MS = 60_000, 1_800_000
TICK = ("t", "seq", "source_t", *S.CHANNELS, "detected", "blocked")
TICK_SCHEMA = "t bigint, seq bigint, source_t bigint, " + ", ".join(f"{c} double" for c in S.CHANNELS) + ", detected boolean, blocked boolean"
LIVE_SCHEMA = "session_id bigint, t bigint, seq bigint, kept boolean, inspected boolean, status string, relaxing boolean, " + ", ".join(f"{c} double" for c in S.CHANNELS)
TRACK = ("last bigint, start bigint, seen bigint, detect bigint, source bigint, inspect bigint, blocked boolean, n bigint,"
         " calibration array<double>, goal array<double>, now array<double>")
FIELDS = [item.split()[0] for item in TRACK.split(", ")]


def fresh() -> dict:
    neutral = [S.NEUTRAL[c] for c in S.CHANNELS]
    return {f: None for f in FIELDS} | {"n": 0, "blocked": False, "goal": neutral, "now": list(neutral)}


def calibrated(samples: list[tuple]) -> list[float]:
    """Nearest-rank value of each channel among the samples."""
    out = []
    for j, c in enumerate(S.CHANNELS):
        quantile, floor = S.CALIBRATION[c]
        ordered = sorted(s[j] for s in samples)
        value = ordered[math.floor((len(ordered) - 1) * quantile + 0.5)]
        out.append(value if floor is None else max(floor, value))
    return out


def goal_of(values: tuple, calibration: list[float]) -> list[float]:
    yaw, pitch, eye_l, eye_r, mouth = values
    c_yaw, c_pitch, c_eye_l, c_eye_r, c_mouth = calibration
    clamp = lambda v, low, high: min(high, max(low, v))
    return [clamp(yaw - c_yaw, -15.0, 15.0), clamp(pitch - c_pitch, -10.0, 10.0), clamp(eye_l / c_eye_l, 0.0, 1.0), clamp(eye_r / c_eye_r, 0.0, 1.0),
            clamp((mouth - c_mouth) * 1.65, 0.0, 1.0)]


def advance(track: dict, samples: list[tuple], tick: tuple, throttle_ms: float, inspect_ms: int) -> tuple:
    """One tick: changes ``track`` and ``samples`` and returns (t, seq, kept, inspected, status, relaxing, channels...).

    A tick is looked at for a detection only if the interval has passed since the last one looked at and its source time is new; what is
    not looked at neither counts as seen nor calibrates nor moves the target. The frame's condition is taken at most once an interval
    and holds in between. Smoothing happens at every tick.
    """
    t, seq, source, *values, detected, blocked = tick
    dt = 0 if track["last"] is None else min(S.TICK_CAP_MS, t - track["last"])
    if track["last"] is None:
        track["start"] = t
    track["last"] = t
    kept = track["detect"] is None or (t - track["detect"] >= throttle_ms and source != track["source"])
    if kept:
        track["detect"], track["source"] = t, source
        if detected:
            track["seen"], track["n"] = t, track["n"] + 1
            if track["calibration"] is None:
                samples.append(tuple(values))
                if track["n"] >= S.SAMPLES:
                    track["calibration"] = calibrated(samples)
                    samples.clear()
            if track["calibration"] is not None:
                track["goal"] = goal_of(values, track["calibration"])
    inspected = track["inspect"] is None or t - track["inspect"] >= inspect_ms
    if inspected:
        track["inspect"], track["blocked"] = t, bool(blocked)
    elapsed = t - (track["start"] if track["seen"] is None else track["seen"])
    relaxing = elapsed >= S.RELAX_AFTER_MS
    status = ("blocked" if track["blocked"] else "lost") if elapsed > S.LOST_AFTER_MS else "calibrating" if track["n"] < S.SAMPLES else "tracking"
    for j, c in enumerate(S.CHANNELS):
        goal = S.NEUTRAL[c] if relaxing else track["goal"][j]
        share = 1.0 - math.exp(-max(1, dt) / (S.RELAX_CONSTANT if relaxing else S.TIME_CONSTANT[c]))
        track["now"][j] += (goal - track["now"][j]) * share
    return (t, seq, kept, inspected, status, relaxing, *track["now"])


class LiveTracks(StatefulProcessor):
    """Keyed by session: a value for the track, a list for calibration samples, a map of pages of waiting ticks, one timer."""

    def __init__(self, throttle_ms: float, inspect_ms: int, page_ms: int, idle_ms: int) -> None:
        self.throttle_ms, self.inspect_ms, self.page_ms, self.idle_ms = throttle_ms, inspect_ms, page_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.track = handle.getValueState("track", TRACK)
        self.samples = handle.getListState("samples", ", ".join(f"{c} double" for c in S.CHANNELS))
        self.pages = handle.getMapState("pages", "page bigint", f"ticks array<struct<{TICK_SCHEMA.replace(' ', ': ').replace(',: ', ', ')}>>")

    def _wake(self, at: int) -> None:
        """Keep one timer, at the earliest time asked for."""
        timers = list(self.handle.listTimers())
        if timers and min(timers) <= at:
            return
        for timer in timers:
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        earliest = None
        for chunk in rows:
            for page, part in chunk.groupby(chunk["t"] // self.page_ms):
                ticks = [tuple(x) for x in part[list(TICK)].astype(object).itertuples(index=False)]
                page = (int(page),)
                if self.pages.containsKey(page):
                    ticks += [tuple(x) for x in self.pages.getValue(page)[0]]
                self.pages.updateValue(page, (ticks,))
            earliest = int(chunk["t"].min()) if earliest is None else min(earliest, int(chunk["t"].min()))
        if earliest is not None:
            self._wake(earliest)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs()
        waiting = sorted(p[0] for p in self.pages.keys())
        track = dict(zip(FIELDS, self.track.get(), strict=True)) if self.track.exists() else fresh()
        track |= {f: None if track[f] is None else list(track[f]) for f in ("calibration", "goal", "now")}
        samples = [tuple(s) for s in self.samples.get()]
        left = None
        for page in waiting:
            if page * self.page_ms > passed:
                left = page if left is None else left
                break
            ticks = sorted(tuple(x) for x in self.pages.getValue((page,))[0])
            due = [x for x in ticks if x[0] <= passed]
            if due:
                out = []
                for tick in due:
                    if track["last"] is not None and tick[0] > track["last"] + self.idle_ms:
                        track, samples = fresh(), []
                    out.append((key[0], *advance(track, samples, tick, self.throttle_ms, self.inspect_ms)))
                yield pd.DataFrame(out, columns=["session_id", "t", "seq", "kept", "inspected", "status", "relaxing", *S.CHANNELS])
            if len(due) < len(ticks):
                self.pages.updateValue((page,), (ticks[len(due) :],))
                left = page
                break
            self.pages.removeKey((page,))
        if left is not None:
            first = min(x[0] for x in self.pages.getValue((left,))[0])
        elif passed >= track["last"] + self.idle_ms:
            self.track.clear()
            self.samples.clear()
            return
        else:
            first = track["last"] + self.idle_ms
        self.track.update(tuple(track[f] for f in FIELDS))
        self.samples.clear()
        if samples:
            self.samples.put(samples)
        self._wake(first)

    def close(self) -> None:
        pass


def live_tracks(stream: DataFrame, delay: str = "10 seconds", throttle_ms: float = THROTTLE_MS, inspect_ms: int = INSPECT_MS, page_ms: int = PAGE_MS, idle_ms: int = IDLE_MS) -> DataFrame:
    """One row for every tick of every session, with all that a live preview shows at that tick.

    ``stream``: (session_id, t, seq, source_t, yaw, pitch, eye_l, eye_r, mouth, detected, blocked), ``t`` in milliseconds and (t, seq) a total
    order. Rows come out when the watermark has passed them; ticks that arrive later than the delay are dropped by the engine, as in
    any append-mode stream. A session that stays idle for ``idle_ms`` starts anew. Needs the RocksDB state store (``ROCKSDB``).
    """
    ticks = stream.select("session_id", *TICK, F.timestamp_millis("t").alias("at")).withWatermark("at", delay)
    return ticks.groupBy("session_id").transformWithStateInPandas(LiveTracks(throttle_ms, inspect_ms, page_ms, idle_ms), LIVE_SCHEMA, "append", "eventTime")


def closing(ticks: DataFrame, session_id: int, delay_ms: int) -> DataFrame:
    """One row after the end of all ``ticks``, to union to a stream that ends: the watermark then passes every tick.

    The session it names must not occur among the ticks; its own row never comes out.
    """
    empty = {"source_t": F.lit(0).cast("bigint"), **{c: F.lit(0.0) for c in S.CHANNELS}, "detected": F.lit(False), "blocked": F.lit(False)}
    end = ticks.agg((F.max("t") + delay_ms + 1000).alias("t")).where("t is not null")
    return end.select(F.lit(session_id).cast("bigint").alias("session_id"), "t", F.lit(0).cast("bigint").alias("seq"), *[v.alias(k) for k, v in empty.items()])
