"""Queries over session signals in batch and as streams. Sessions are users; event time is compressed so that a session's
ticks are a fraction of a second apart."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import signals as S
from ..session import work_folder
from ..streaming import guard as G
from ..streaming import live as L
from ..streaming import tracks as T
from . import inputs as I
from .inputs import sql
from .registry import query

BUCKET = 1000
SHAPE = ("user_id as session_id", "unix_micros(cast(ts as timestamp)) div 200000000 as t", "event_id as seq", "value - 10 as yaw", "cast(event_id % 21 - 10 as double) as pitch",
         "cast(get_json_object(props, '$.k') as int) / 100 as eye_l", "(100 - cast(get_json_object(props, '$.k') as int)) / 100 as eye_r",
         "cast(get_json_object(props, '$.k') as int) / 150 as mouth", "event_type <> 'error' as detected", "event_type = 'error' and event_id % 2 = 0 as blocked")


def _signals(spark, d) -> DataFrame:
    return I.table(spark, d, "events").selectExpr(*SHAPE)


I.CTES["sig"] = """
SELECT user_id AS session_id, epoch_us(ts) // 200000000 AS t, event_id AS seq, value - 10 AS yaw, (event_id % 21 - 10)::DOUBLE AS pitch, k / 100 AS eye_l, (100 - k) / 100 AS eye_r, k / 150 AS mouth,
  event_type <> 'error' AS detected, event_type = 'error' AND event_id % 2 = 0 AS blocked FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)"""


def _rank(c: str, q: float, low: float | None) -> str:
    text = f"list_sort(list({c}))[CAST(floor((count(*) - 1) * {q} + 0.5) AS INT) + 1]"
    return (f"greatest({low}::DOUBLE, {text})" if low is not None else text) + f" AS c_{c}"


I.CTES["cal"] = ("SELECT session_id, count(*) AS n, count(*) >= 18 AS complete, " + ", ".join(_rank(c, *S.CALIBRATION[c]) for c in S.CHANNELS)
                 + " FROM (SELECT * FROM sig WHERE detected QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY t, seq) <= 18) GROUP BY 1")
MAPPED = {"yaw": "least(15.0::DOUBLE, greatest(-15.0::DOUBLE, yaw - c_yaw))", "pitch": "least(10.0::DOUBLE, greatest(-10.0::DOUBLE, pitch - c_pitch))", "eye_l": "least(1.0::DOUBLE, greatest(0.0::DOUBLE, eye_l / c_eye_l))",
          "eye_r": "least(1.0::DOUBLE, greatest(0.0::DOUBLE, eye_r / c_eye_r))", "mouth": "least(1.0::DOUBLE, greatest(0.0::DOUBLE, (mouth - c_mouth) * 1.65::DOUBLE))"}
COLS = " ".join(f"c_{c}:d" for c in S.CHANNELS)


@query("calibrate_sessions", f"session_id:l n:l complete:b {COLS}", sql("SELECT * FROM cal"))
def _(spark, d):
    return S.calibrate(_signals(spark, d))


@query("map_signals", "session_id:l seq:l p_yaw:d p_pitch:d p_eye_l:d p_eye_r:d p_mouth:d",
       sql("SELECT session_id, seq, " + ", ".join(f"round({MAPPED[c]}, 9) + 0.0 AS p_{c}" for c in S.CHANNELS) + " FROM sig JOIN cal USING (session_id)"))
def _(spark, d):
    s = _signals(spark, d)
    return S.map_signals(s, S.calibrate(s)).withColumns({f"p_{c}": F.expr(f"round(p_{c}, 9) + 0.0D") for c in S.CHANNELS})


I.CTES["trk"] = ("""
SELECT session_id, t, seq, detected, blocked, detections, elapsed, dt, elapsed >= 1800 AS relaxing, """ + ", ".join(
    f"CASE WHEN elapsed >= 1800 OR held IS NULL THEN {S.NEUTRAL[c]} ELSE held.{c} END AS g_{c}" for c in S.CHANNELS) + """
FROM (SELECT *, t - coalesce(last_value(CASE WHEN detected THEN t END IGNORE NULLS) OVER w, min(t) OVER (PARTITION BY session_id)) AS elapsed, least(100, t - coalesce(lag(t) OVER w2, t)) AS dt,
    last_value(CASE WHEN detected AND detections >= 18 THEN {""" + ", ".join(f"'{c}': {MAPPED[c]}" for c in S.CHANNELS) + """} END IGNORE NULLS) OVER w AS held
  FROM (SELECT *, count(*) FILTER (WHERE detected) OVER w AS detections FROM sig WINDOW w AS (PARTITION BY session_id ORDER BY t, seq ROWS UNBOUNDED PRECEDING)) JOIN cal USING (session_id)
  WINDOW w AS (PARTITION BY session_id ORDER BY t, seq ROWS UNBOUNDED PRECEDING), w2 AS (PARTITION BY session_id ORDER BY t, seq))""")


def _targets(spark, d) -> DataFrame:
    s = _signals(spark, d)
    return S.targets(s, S.calibrate(s), BUCKET)


STATUS = "CASE WHEN elapsed > 450 THEN CASE WHEN blocked THEN 'blocked' ELSE 'lost' END WHEN detections < 18 THEN 'calibrating' ELSE 'tracking' END"


@query("tracking_state", "session_id:l t:l seq:l elapsed:l relaxing:b status:s", sql(f"SELECT session_id, t, seq, elapsed, relaxing, {STATUS} AS status FROM trk"))
def _(spark, d):
    flags = _signals(spark, d).select("session_id", "t", "seq", "blocked")
    ticks = _targets(spark, d).join(flags, ["session_id", "t", "seq"])
    return S.tracking_state(ticks, F.when(F.col("blocked"), "blocked").otherwise("usable"))


I.CTES["tick"] = "SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY t, seq) AS i FROM trk"
STEP = ", ".join(
    f"s.{c} + (k.g_{c} - s.{c}) * (1 - exp(-greatest(1, k.dt) / CASE WHEN k.relaxing THEN 180.0::DOUBLE ELSE {S.TIME_CONSTANT[c]}::DOUBLE END))" for c in S.CHANNELS)
TICK_TEXT = sql("SELECT * FROM tick")
SMOOTH = f"""
WITH RECURSIVE ticks AS MATERIALIZED ({TICK_TEXT}), s AS (
  SELECT DISTINCT session_id, 0::BIGINT AS i, 0::BIGINT AS t, 0::BIGINT AS seq, {', '.join(f'{S.NEUTRAL[c]}::DOUBLE AS {c}' for c in S.CHANNELS)} FROM ticks UNION ALL
  SELECT s.session_id, k.i, k.t, k.seq, {STEP} FROM s JOIN ticks k ON k.session_id = s.session_id AND k.i = s.i + 1)"""
ROUNDED = ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in S.CHANNELS)


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.expr(f"round({c}, 6) + 0.0D") for c in S.CHANNELS})


@query("smooth_signals", "session_id:l t:l seq:l yaw:d pitch:d eye_l:d eye_r:d mouth:d", f"{SMOOTH} SELECT session_id, t, seq, {ROUNDED} FROM s WHERE i > 0")
def _(spark, d):
    return _rounded(S.smooth(_targets(spark, d), BUCKET))


@query("rate_metric", "session_id:l window_start:l rate:d", sql("SELECT session_id, t // 750 * 750 AS window_start, count(*) * 1000.0 / 750 AS rate FROM sig GROUP BY 1, 2"))
def _(spark, d):
    return S.rate_metric(_signals(spark, d))


PROGRESS = ("user_id as run_id", "cast(event_id % 4 as int) as phase", "event_id as seq", "element_at(array('pending', 'running', 'completed', 'failed'), cast(floor(value) as int) % 4 + 1) as state")


@query("progress_latest", "run_id:l phase:l state:s seq:l active:b", sql("""
SELECT run_id, phase, arg_max(state, seq) AS state, max(seq) AS seq, arg_max(state, seq) IN ('pending', 'running') AS active FROM (
  SELECT user_id AS run_id, event_id % 4 AS phase, event_id AS seq, ['pending', 'running', 'completed', 'failed'][CAST(floor(value) AS INT) % 4 + 1] AS state FROM events) GROUP BY 1, 2"""))
def _(spark, d):
    return S.latest_progress(I.table(spark, d, "events").selectExpr(*PROGRESS))


# --- streams --------------------------------------------------------------------------------------------------------

def _stream(spark, d) -> DataFrame:
    """The events table as a file stream."""
    schema = I.table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


def _folder(spark) -> str:
    return f"{work_folder(spark)}/stream-{uuid.uuid4().hex}"


@query("stream_tracks", "session_id:l t:l seq:l status:s relaxing:b yaw:d pitch:d eye_l:d eye_r:d mouth:d",
       f"{SMOOTH} SELECT s.session_id, s.t, s.seq, {STATUS} AS status, relaxing, {ROUNDED} FROM s JOIN ticks k ON k.session_id = s.session_id AND k.i = s.i")
def _(spark, d):
    return _rounded(T.run_available(T.track_sessions(_stream(spark, d).selectExpr(*SHAPE)), _folder(spark)))


# Ticks as the live preview sees them: throttled and inspected first, then calibrated, targeted and smoothed by what was looked at.
_GOAL = ", ".join(f"CASE WHEN elapsed >= 1800 OR held IS NULL THEN {S.NEUTRAL[c]} ELSE held.{c} END AS g_{c}" for c in S.CHANNELS)
LIVE_SQL = f"""
WITH RECURSIVE sig AS ({I.CTES["sig"]}), numbered AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY t, seq) AS i, epoch_us(ts) // 400000000 AS source_t FROM (SELECT sig.*, ts FROM sig JOIN events ON event_id = seq)),
looked AS (
  SELECT DISTINCT session_id, 0::BIGINT AS i, NULL::BIGINT AS detect, NULL::BIGINT AS source, NULL::BIGINT AS inspect, false AS dark, false AS kept, false AS inspected FROM numbered UNION ALL
  SELECT session_id, i, CASE WHEN kept THEN t ELSE detect END, CASE WHEN kept THEN source_t ELSE source END, CASE WHEN inspected THEN t ELSE inspect END,
         CASE WHEN inspected THEN blocked ELSE dark END, kept, inspected FROM (
    SELECT k.session_id, k.i, k.t, k.source_t, k.blocked, l.detect, l.source, l.inspect, l.dark,
           l.detect IS NULL OR (k.t - l.detect >= 1000.0::DOUBLE / 30 AND k.source_t <> l.source) AS kept, l.inspect IS NULL OR k.t - l.inspect >= 500 AS inspected
    FROM looked l JOIN numbered k ON k.session_id = l.session_id AND k.i = l.i + 1)),
shown AS (
  SELECT n.* EXCLUDE (blocked, detected), l.kept, l.inspected, l.dark, n.detected AND l.kept AS detected FROM numbered n JOIN looked l USING (session_id, i)),
calibration AS (SELECT session_id, {", ".join(_rank(c, *S.CALIBRATION[c]) for c in S.CHANNELS)} FROM (
  SELECT * FROM shown WHERE detected QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY t, seq) <= 18) GROUP BY 1),
aimed AS MATERIALIZED (
  SELECT *, elapsed >= 1800 AS relaxing, {_GOAL} FROM (
    SELECT *, t - coalesce(last_value(CASE WHEN detected THEN t END IGNORE NULLS) OVER w, min(t) OVER (PARTITION BY session_id)) AS elapsed, least(100, t - coalesce(lag(t) OVER w2, t)) AS dt,
      last_value(CASE WHEN detected AND detections >= 18 THEN {{{", ".join(f"'{c}': {MAPPED[c]}" for c in S.CHANNELS)}}} END IGNORE NULLS) OVER w AS held
    FROM (SELECT *, count(*) FILTER (WHERE detected) OVER w AS detections FROM shown WINDOW w AS (PARTITION BY session_id ORDER BY t, seq ROWS UNBOUNDED PRECEDING)) LEFT JOIN calibration USING (session_id)
    WINDOW w AS (PARTITION BY session_id ORDER BY t, seq ROWS UNBOUNDED PRECEDING), w2 AS (PARTITION BY session_id ORDER BY t, seq))),
s AS (
  SELECT DISTINCT session_id, 0::BIGINT AS i, {", ".join(f"{S.NEUTRAL[c]}::DOUBLE AS {c}" for c in S.CHANNELS)} FROM aimed UNION ALL
  SELECT s.session_id, k.i, {STEP} FROM s JOIN aimed k ON k.session_id = s.session_id AND k.i = s.i + 1)
SELECT k.session_id, k.t, k.seq, kept, inspected, CASE WHEN elapsed > 450 THEN CASE WHEN dark THEN 'blocked' ELSE 'lost' END WHEN detections < 18 THEN 'calibrating' ELSE 'tracking' END AS status,
  relaxing, {', '.join(f'round(s.{c}, 6) + 0.0 AS {c}' for c in S.CHANNELS)} FROM s JOIN aimed k ON k.session_id = s.session_id AND k.i = s.i"""
NOBODY = -1


@query("stream_throttle", "session_id:l t:l seq:l kept:b inspected:b status:s relaxing:b yaw:d pitch:d eye_l:d eye_r:d mouth:d", LIVE_SQL)
def _(spark, d):
    """The live preview over all events; a row behind the last tick lets the watermark pass them all."""
    shape = (*SHAPE, "unix_micros(cast(ts as timestamp)) div 400000000 as source_t")
    folder = _folder(spark)
    L.closing(I.table(spark, d, "events").selectExpr(*shape), NOBODY, 10_000).write.parquet(f"{folder}/end")
    ticks = _stream(spark, d).selectExpr(*shape)
    end = spark.readStream.schema(spark.read.parquet(f"{folder}/end").schema).parquet(f"{folder}/end")
    return _rounded(T.run_available(L.live_tracks(ticks.unionByName(end), "10 seconds"), folder, rocksdb=True))


@query("stream_rate", "session_id:l window_start:l rate:d", sql("SELECT session_id, t // 750 * 750 AS window_start, count(*) * 1000.0 / 750 AS rate FROM sig GROUP BY 1, 2"))
def _(spark, d):
    ticks = _stream(spark, d).selectExpr(*SHAPE).withColumn("ts", F.timestamp_millis("t"))
    return T.run_available(T.rate_stream(ticks), _folder(spark), "update", ("session_id", "window_start"))


@query("stream_progress", "run_id:l phase:l state:s seq:l", sql("""
SELECT run_id, phase, arg_max(state, seq) AS state, max(seq) AS seq FROM (
  SELECT user_id AS run_id, event_id % 4 AS phase, event_id AS seq, ['pending', 'running', 'completed', 'failed'][CAST(floor(value) AS INT) % 4 + 1] AS state FROM events) GROUP BY 1, 2"""))
def _(spark, d):
    return T.run_available(T.progress_stream(_stream(spark, d).selectExpr(*PROGRESS)), _folder(spark), "complete")


@query("stream_late_results", "run_id:l stage:l seq:l attempt:l owner:l verdict:s", sql("""
SELECT run_id, stage, seq, attempt, owner, CASE WHEN NOT owned THEN 'lost_ownership' WHEN seq = min(CASE WHEN owned THEN seq END) OVER (PARTITION BY run_id, stage) THEN 'accepted' ELSE 'already_published' END AS verdict
FROM (SELECT *, attempt IS NOT DISTINCT FROM owner AS owned FROM (
  SELECT *, last_value(CASE WHEN is_open THEN attempt END IGNORE NULLS) OVER (PARTITION BY run_id, stage ORDER BY seq) AS owner FROM (
    SELECT user_id AS run_id, event_id % 3 AS stage, event_id AS seq, event_type IN ('click', 'view', 'signup') AS is_open, CAST(floor(value) AS BIGINT) % 2 AS attempt FROM events)) WHERE NOT is_open)"""))
def _(spark, d):
    log = _stream(spark, d).selectExpr(
        "user_id as run_id", "cast(event_id % 3 as int) as stage", "event_id as seq",
        "if(event_type in ('click', 'view', 'signup'), 'open', 'result') as kind", "cast(floor(value) as bigint) % 2 as attempt")
    folder = _folder(spark)
    T.run_batches(G.late_result_guard(log), f"{folder}/checkpoint", G.committing_sink(folder))
    return G.committed(spark, folder, G.GUARD_SCHEMA)
