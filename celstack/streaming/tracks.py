"""Structured Streaming forms of the signal and ledger operators.

Keyed state is the session or the (run, stage): one small record per key, updated in event order inside a micro-batch.
The step functions are self-contained, so executors need nothing but pandas.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import signals as S
from .live import ROCKSDB

TRACK_SCHEMA = ("session_id bigint, t bigint, seq bigint, status string, relaxing boolean, kept boolean, yaw double, pitch double,"
                " eye_l double, eye_r double, mouth double")
TRACK_STATE = "document string"


def track_sessions(stream: DataFrame, throttle_ms: float = 1000 / 30) -> DataFrame:
    """Calibrate, map, throttle, track and smooth every session statefully; one output row per tick.

    ``stream``: (session_id, t, seq, yaw, pitch, eye_l, eye_r, mouth, detected, blocked). ``kept`` says whether the tick
    passed the throttle (at most one per interval, new source time only); calibration and targets use detected ticks.
    """
    channels, quantiles, neutral, constants = S.CHANNELS, dict(S.CALIBRATION), dict(S.NEUTRAL), dict(S.TIME_CONSTANT)
    samples, lost, relax, cap, slow = S.SAMPLES, S.LOST_AFTER_MS, S.RELAX_AFTER_MS, S.TICK_CAP_MS, S.RELAX_CONSTANT

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import json
        import math

        pdf = pd.concat(list(batches)).sort_values(["t", "seq"], kind="stable")
        s = json.loads(state.get[0]) if state.exists else {
            "last": None, "seen": None, "kept": None, "n": 0, "samples": {c: [] for c in channels}, "cal": None, "goal": dict(neutral), "now": dict(neutral)}
        rows = []
        for row in pdf.itertuples(index=False):
            t = int(row.t)
            dt = min(cap, t - s["last"]) if s["last"] is not None else 0
            if s["last"] is None:
                s["start"] = t
            kept = s["kept"] is None or (t - s["kept"] >= throttle_ms and t != s["last"])
            s["kept"], s["last"] = (t if kept else s["kept"]), t
            if row.detected:
                s["seen"], s["n"] = t, s["n"] + 1
                if s["cal"] is None:
                    for c in channels:
                        s["samples"][c].append(float(getattr(row, c)))
                    if s["n"] >= samples:
                        s["cal"] = {}
                        for c in channels:
                            q, low = quantiles[c]
                            ordered = sorted(s["samples"][c])
                            value = ordered[math.floor((len(ordered) - 1) * q + 0.5)]
                            s["cal"][c] = value if low is None else max(low, value)
                if s["cal"] is not None:
                    cal = s["cal"]
                    s["goal"] = {
                        "yaw": min(15.0, max(-15.0, row.yaw - cal["yaw"])), "pitch": min(10.0, max(-10.0, row.pitch - cal["pitch"])),
                        "eye_l": min(1.0, max(0.0, row.eye_l / cal["eye_l"])), "eye_r": min(1.0, max(0.0, row.eye_r / cal["eye_r"])),
                        "mouth": min(1.0, max(0.0, (row.mouth - cal["mouth"]) * 1.65))}
            elapsed = t - (s["seen"] if s["seen"] is not None else s["start"])
            relaxing = elapsed >= relax
            status = ("blocked" if row.blocked else "lost") if elapsed > lost else "calibrating" if s["n"] < samples else "tracking"
            goal = neutral if relaxing else s["goal"]
            for c in channels:
                keep = math.exp(-max(1, dt) / (slow if relaxing else constants[c]))
                s["now"][c] += (goal[c] - s["now"][c]) * (1.0 - keep)
            rows.append((key[0], t, int(row.seq), status, relaxing, kept, *[s["now"][c] for c in channels]))
        state.update((json.dumps(s),))
        yield pd.DataFrame(rows, columns=["session_id", "t", "seq", "status", "relaxing", "kept", *channels])

    return stream.groupBy("session_id").applyInPandasWithState(step, TRACK_SCHEMA, TRACK_STATE, "append", GroupStateTimeout.NoTimeout)


def rate_stream(stream: DataFrame, delay: str = "10 seconds", window: str = "750 milliseconds") -> DataFrame:
    """Ticks per second in tumbling event-time windows; ``stream`` has an event-time column ``ts``.

    Run it in ``update`` mode keyed by session and window: ``append`` holds back the windows after the last watermark.
    """
    counts = stream.withWatermark("ts", delay).groupBy("session_id", F.window("ts", window).alias("w")).agg(F.count("*").alias("n"))
    width = (F.unix_millis("w.end") - F.unix_millis("w.start")) / 1000.0
    return counts.select("session_id", F.unix_millis("w.start").alias("window_start"), (F.col("n") / width).alias("rate"))


def deduplicated(stream: DataFrame, keys: list[str], event_time: str, delay: str) -> DataFrame:
    """Drop repeated deliveries of the same keys that arrive within the watermark delay."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def progress_stream(stream: DataFrame) -> DataFrame:
    """Latest state per (run, phase) as an updating aggregate; later sequence numbers win."""
    return stream.groupBy("run_id", "phase").agg(F.max_by("state", "seq").alias("state"), F.max("seq").alias("seq"))


@contextmanager
def options(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session options for the streams started inside; the earlier values come back afterwards."""
    names = {k: f"spark.sql.streaming.{k.replace('__', '.')}" for k in values}
    before = {n: spark.conf.get(n, None) for n in names.values()}
    for k, name in names.items():
        spark.conf.set(name, values[k])
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def run_batches(stream: DataFrame, checkpoint: str, write) -> None:
    """Run a stream with state variables over everything available now, each batch through ``write(batch, id)``.

    Batches without data are off: there are no timers to serve, and entries expire with the next batch that has some.
    """
    with options(stream.sparkSession, stateStore__providerClass=ROCKSDB, noDataMicroBatches__enabled="false"):
        stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


def run_available(stream: DataFrame, folder: str, mode: str = "append", keys: tuple[str, ...] = (), rocksdb: bool = False) -> DataFrame:
    """Run a stream over everything available now into a parquet folder and read the result back.

    ``complete`` results replace each other. ``update`` results are kept per batch (a repeated batch replaces itself), and the
    newest row of each of ``keys`` counts, so windows that are still open at the end of the run are part of the result.
    """
    spark = stream.sparkSession
    target, checkpoint = f"{folder}/out", f"{folder}/checkpoint"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        with options(spark, stateStore__providerClass=ROCKSDB) if rocksdb else nullcontext():
            query = writer.format("parquet").option("path", target).start()
    elif mode == "update":
        query = writer.foreachBatch(lambda batch, i: batch.write.mode("overwrite").parquet(f"{target}/batch={i}")).start()
        query.awaitTermination()
        batches = spark.read.schema(stream.schema.add("batch", "long")).parquet(target)
        others = [c for c in stream.columns if c not in keys]
        newest = batches.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("row"))
        return newest.select(*keys, *[F.col(f"row.{c}").alias(c) for c in others])
    else:
        query = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(target)).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(target)
