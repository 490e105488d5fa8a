"""Per-session numeric signal tracks in batch: calibration, mapping, targets, smoothing, tracking state, rates.

Rows are ticks ``(session_id, t, seq, yaw, pitch, eye_l, eye_r, mouth, detected)`` with ``t`` in whole milliseconds and
``(t, seq)`` a total order. A session may hold a large share of all rows, so ordered work is cut into time buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import hotkeys

CHANNELS = ("yaw", "pitch", "eye_l", "eye_r", "mouth")
# Channel: (quantile, floor, neutral value, time constant in ms).
CALIBRATION = {"yaw": (0.5, None), "pitch": (0.5, None), "eye_l": (0.9, 0.2), "eye_r": (0.9, 0.2), "mouth": (0.15, None)}
NEUTRAL = {"yaw": 0.0, "pitch": 0.0, "eye_l": 1.0, "eye_r": 1.0, "mouth": 0.0}
TIME_CONSTANT = {"yaw": 88.0, "pitch": 88.0, "eye_l": 42.0, "eye_r": 42.0, "mouth": 58.0}
RELAX_CONSTANT = 180.0
SAMPLES, LOST_AFTER_MS, RELAX_AFTER_MS, TICK_CAP_MS = 18, 450, 1800, 100
BUCKET_MS = 60_000


def calibrate(signals: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Nearest-rank percentiles of the first detected samples of each session.

    The rank filter becomes a window group limit, so each task forwards at most ``samples`` rows of a session, and the
    sorted arrays never exceed that length.
    """
    order = Window.partitionBy("session_id").orderBy("t", "seq")
    first = signals.where("detected").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= samples)
    lists = first.groupBy("session_id").agg(F.count("*").alias("n"), *[F.sort_array(F.collect_list(c)).alias(c) for c in CHANNELS])

    def rank(name: str) -> Column:
        q, low = CALIBRATION[name]
        value = F.expr(f"element_at({name}, cast(floor((n - 1) * {q}D + 0.5D) as int) + 1)")
        return (F.greatest(F.lit(low), value) if low is not None else value).alias(f"c_{name}")

    return lists.select("session_id", "n", (F.col("n") >= samples).alias("complete"), *[rank(c) for c in CHANNELS])


def mapped(name: str) -> Column:
    """Calibrated parameter value of a channel, clamped to its range."""
    text = {
        "yaw": "least(15.0D, greatest(-15.0D, yaw - c_yaw))", "pitch": "least(10.0D, greatest(-10.0D, pitch - c_pitch))",
        "eye_l": "least(1.0D, greatest(0.0D, eye_l / c_eye_l))", "eye_r": "least(1.0D, greatest(0.0D, eye_r / c_eye_r))",
        "mouth": "least(1.0D, greatest(0.0D, (mouth - c_mouth) * 1.65D))",
    }
    return F.expr(text[name])


def map_signals(signals: DataFrame, calibration: DataFrame) -> DataFrame:
    joined = signals.join(calibration.select("session_id", *[f"c_{c}" for c in CHANNELS]), "session_id")
    return joined.withColumns({f"p_{c}": mapped(c) for c in CHANNELS}).drop(*[f"c_{c}" for c in CHANNELS])


def targets(signals: DataFrame, calibration: DataFrame, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Target parameters of every tick, time since the last detection, tick length and relax flag.

    A detection sets the target once the session is calibrated (its 18th detection included); ticks without one keep the
    last target, and after 1,800 ms without detection the target is neutral.
    """
    keys, order, bucket = ["session_id"], ["t", "seq"], F.expr(f"t div {bucket_ms}")
    df = hotkeys.running(signals, keys, bucket, order, "detections", F.col("detected").cast("bigint"), "sum")
    df = hotkeys.lag(df, keys, bucket, order, {"previous_t": "t"})
    df = hotkeys.running(df, keys, bucket, order, "last_seen", F.when(F.col("detected"), F.col("t")), "last")
    start = df.groupBy("session_id").agg(F.min("t").alias("started"))
    cal = calibration.select("session_id", *[f"c_{c}" for c in CHANNELS])
    df = df.join(start, keys).join(cal, keys, "left")
    ready = F.expr(f"detected and detections >= {SAMPLES}")
    own = F.when(ready, F.struct(*[mapped(c).alias(c) for c in CHANNELS]))
    df = hotkeys.running(df.withColumn("__own", own), keys, bucket, order, "held", F.col("__own"), "last")
    df = df.withColumn("elapsed", F.expr("t - coalesce(last_seen, started)")).withColumn("relaxing", F.expr(f"elapsed >= {RELAX_AFTER_MS}"))
    df = df.withColumn("dt", F.expr(f"least({TICK_CAP_MS}, t - coalesce(previous_t, t))"))
    chosen = {f"g_{c}": F.when(F.col("relaxing") | F.col("held").isNull(), F.lit(NEUTRAL[c])).otherwise(F.col(f"held.{c}")) for c in CHANNELS}
    return df.withColumns(chosen).select("session_id", "t", "seq", "detected", "detections", "elapsed", "dt", "relaxing", *chosen)


def tracking_state(ticks: DataFrame, frame_class: Column) -> DataFrame:
    """calibrating, tracking, lost or blocked for every tick of ``targets``.

    Within 450 ms of a detection the status is the one that detection set; later it is blocked on a blocked frame, else lost.
    """
    status = F.when(F.col("elapsed") > LOST_AFTER_MS, F.when(frame_class == "blocked", "blocked").otherwise("lost")).when(
        F.col("detections") < SAMPLES, "calibrating").otherwise("tracking")
    return ticks.withColumn("status", status)


def smooth(ticks: DataFrame, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Exponential smoothing towards the targets, from neutral, with per-channel time constants.

    One step is the affine map s -> k s + (1 - k) g, and affine maps compose. Each (session, bucket) is reduced to the map
    of its ticks, the bucket maps of a session are chained (one row per bucket), and every tick applies its prefix map to
    the value entering its bucket. No task sees more than a bucket's ticks or a session's buckets.
    """
    named = [f"{p}_{c}" for c in CHANNELS for p in ("k", "b")]
    tau = lambda c: F.when(F.col("relaxing"), RELAX_CONSTANT).otherwise(TIME_CONSTANT[c])
    steps = ticks.withColumn("bucket", F.expr(f"t div {bucket_ms}")).withColumns(
        {f"k_{c}": F.exp(-F.greatest(F.lit(1), F.col("dt")) / tau(c)) for c in CHANNELS}).select(
        "session_id", "bucket", "t", "seq", *[f"k_{c}" for c in CHANNELS], *[f"g_{c}" for c in CHANNELS])
    channels = CHANNELS
    prefix_schema = "session_id bigint, bucket bigint, t bigint, seq bigint, " + ", ".join(f"{n} double" for n in named)
    entry_schema = "session_id bigint, bucket bigint, " + ", ".join(f"s_{c} double" for c in CHANNELS)
    neutral = [NEUTRAL[c] for c in CHANNELS]

    def prefix(batches):
        """Prefix maps of rows sorted by (session, bucket, t, seq); groups may span Arrow batches."""
        import numpy as np

        key, product, value = None, None, None
        for pdf in batches:
            k, g = pdf[[f"k_{c}" for c in channels]].to_numpy(), pdf[[f"g_{c}" for c in channels]].to_numpy()
            ks, bs = np.empty_like(k), np.empty_like(k)
            for i, now in enumerate(zip(pdf["session_id"].tolist(), pdf["bucket"].tolist())):
                if now != key:
                    key, product, value = now, np.ones(k.shape[1]), np.zeros(k.shape[1])
                product, value = product * k[i], value + (g[i] - value) * (1.0 - k[i])
                ks[i], bs[i] = product, value
            out = pdf[["session_id", "bucket", "t", "seq"]].copy()
            for j, c in enumerate(channels):
                out[f"k_{c}"], out[f"b_{c}"] = ks[:, j], bs[:, j]
            yield out

    def chain(batches):
        """Value entering each bucket, for bucket maps sorted by (session, bucket)."""
        import numpy as np

        session, value = None, None
        for pdf in batches:
            k, b = pdf[[f"k_{c}" for c in channels]].to_numpy(), pdf[[f"b_{c}" for c in channels]].to_numpy()
            entering = np.empty_like(k)
            for i, now in enumerate(pdf["session_id"].tolist()):
                if now != session:
                    session, value = now, np.array(neutral)
                entering[i] = value
                value = k[i] * value + b[i]
            out = pdf[["session_id", "bucket"]].copy()
            for j, c in enumerate(channels):
                out[f"s_{c}"] = entering[:, j]
            yield out

    local = steps.repartition("session_id", "bucket").sortWithinPartitions("session_id", "bucket", "t", "seq").mapInPandas(prefix, prefix_schema)
    last = local.groupBy("session_id", "bucket").agg(F.max(F.struct("t", "seq", *named)).alias("m")).select("session_id", "bucket", *[f"m.{n}" for n in named])
    entries = last.repartition("session_id").sortWithinPartitions("session_id", "bucket").mapInPandas(chain, entry_schema)
    return local.join(entries, ["session_id", "bucket"]).select(
        "session_id", "t", "seq", *[F.expr(f"k_{c} * s_{c} + b_{c}").alias(c) for c in CHANNELS])


def rate_metric(ticks: DataFrame, window_ms: int = 750) -> DataFrame:
    """Processed ticks per second in aligned windows of at least 750 ms."""
    counts = ticks.groupBy("session_id", F.expr(f"t div {window_ms}").alias("slot")).agg(F.count("*").alias("n"))
    return counts.select("session_id", (F.col("slot") * window_ms).alias("window_start"), (F.col("n") * 1000.0 / window_ms).alias("rate"))


def latest_progress(events: DataFrame) -> DataFrame:
    """Latest state of every (run, phase), and runs still active; the later sequence number wins."""
    latest = events.groupBy("run_id", "phase").agg(F.max_by("state", F.col("seq")).alias("state"), F.max("seq").alias("seq"))
    return latest.withColumn("active", F.col("state").isin("pending", "running", "submitted"))
