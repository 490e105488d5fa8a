"""Queries over run ledgers. Stage attempts are events: the run is the user, the position is the event id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import digests as D
from ..functions import fixed
from ..operators import ledger as L
from . import inputs as I
from .inputs import sql
from .registry import query

HOUR = "cast(floor(unix_micros(cast(ts as timestamp)) / 3600000000) as bigint)"
STAGES = "array(" + ", ".join(f"'{s}'" for s in fixed.STAGE_ORDER) + ")"
STAGES_SQL = "[" + ", ".join(f"'{s}'" for s in fixed.STAGE_ORDER) + "]"


def _attempts(spark, d) -> DataFrame:
    """Stage attempts: errors fail, every fourth sign-up blocks, views need review, one stage name in 97 is unknown."""
    return I.table(spark, d, "events").selectExpr(
        "user_id as run_id", "event_id as position", "ts",
        f"if(event_id % 97 = 0, 'MYSTERY', element_at({STAGES}, cast((event_id + user_id) % 11 + 1 as int))) as stage",
        "case when event_type = 'error' and value > 30 then 'failed' when event_type = 'signup' and event_id % 4 = 0 then 'blocked'"
        " when event_type = 'view' and value > 40 then 'needs_review' when event_type = 'click' and value > 40 then 'fallback' else 'succeeded' end as status",
        "case when event_type = 'error' and value > 31 then 'STAGE_INTERNAL_ERROR' when event_type = 'signup' and event_id % 4 = 0 then 'INPUT_UNSUPPORTED'"
        " when event_type = 'purchase' and event_id % 50 = 0 then 'UNEXPECTED' end as reason_code",
        "cast(event_id % 3 as int) as output_count", "cast(value * 1000 as bigint) as wall_ms", "cast(value * 700 as bigint) as cpu_ms",
        "cast(floor(value * 100) as bigint) as output_bytes")


I.CTES["attempts"] = f"""
SELECT user_id AS run_id, event_id AS position, ts,
  CASE WHEN event_id % 97 = 0 THEN 'MYSTERY' ELSE {STAGES_SQL}[(event_id + user_id) % 11 + 1] END AS stage,
  CASE WHEN event_type = 'error' AND value > 30 THEN 'failed' WHEN event_type = 'signup' AND event_id % 4 = 0 THEN 'blocked'
    WHEN event_type = 'view' AND value > 40 THEN 'needs_review' WHEN event_type = 'click' AND value > 40 THEN 'fallback' ELSE 'succeeded' END AS status,
  CASE WHEN event_type = 'error' AND value > 31 THEN 'STAGE_INTERNAL_ERROR' WHEN event_type = 'signup' AND event_id % 4 = 0 THEN 'INPUT_UNSUPPORTED'
    WHEN event_type = 'purchase' AND event_id % 50 = 0 THEN 'UNEXPECTED' END AS reason_code,
  event_id % 3 AS output_count, CAST(trunc(value * 1000) AS BIGINT) AS wall_ms, CAST(trunc(value * 700) AS BIGINT) AS cpu_ms,
  CAST(floor(value * 100) AS BIGINT) AS output_bytes FROM events"""


def _hour():
    return F.expr(HOUR)


@query("stage_order_check", "run_id:l stages:l unknown:l out_of_order:l", sql(f"""
SELECT run_id, count(*) AS stages, count(*) FILTER (WHERE rank IS NULL) AS unknown, count(*) FILTER (WHERE rank < prev) AS out_of_order
FROM (SELECT *, lag(rank) OVER (PARTITION BY run_id ORDER BY position) AS prev FROM (
  SELECT *, list_position({STAGES_SQL}, stage) - 1 AS rank FROM attempts)) GROUP BY 1"""))
def _(spark, d):
    return L.stage_order_check(_attempts(spark, d), _hour())


@query("run_rollup", "run_id:l stages:l status:s reason_code:s ended_at:l", sql("""
SELECT a.run_id, count(*) AS stages, coalesce(max(t.status), CASE WHEN bool_or(a.status = 'needs_review') THEN 'needs_review'
    WHEN bool_or(a.status = 'fallback') THEN 'fallback' ELSE 'succeeded' END) AS status, max(t.reason_code) AS reason_code, max(t.position) AS ended_at
FROM attempts a LEFT JOIN (SELECT run_id, position, status, reason_code FROM attempts WHERE status IN ('failed', 'blocked', 'cancelled')
  QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY position) = 1) t ON t.run_id = a.run_id GROUP BY 1"""))
def _(spark, d):
    return L.run_rollup(_attempts(spark, d))


def _ledger_log(spark, d) -> DataFrame:
    """Each event opens an attempt or publishes the result of the current or an earlier attempt number."""
    return I.table(spark, d, "events").selectExpr(
        "user_id as run_id", "cast(event_id % 3 as int) as stage", "event_id as seq", "ts",
        "if(event_type in ('click', 'view', 'signup'), 'open', 'result') as kind", "cast(floor(value) as bigint) % 2 as attempt")


@query("owned_results", "run_id:l stage:l seq:l attempt:l owner:l verdict:s", sql("""
WITH log AS (SELECT user_id AS run_id, event_id % 3 AS stage, event_id AS seq, event_type IN ('click', 'view', 'signup') AS is_open, CAST(floor(value) AS BIGINT) % 2 AS attempt FROM events),
own AS (SELECT *, last_value(CASE WHEN is_open THEN attempt END IGNORE NULLS) OVER (PARTITION BY run_id, stage ORDER BY seq) AS owner FROM log),
res AS (SELECT *, attempt IS NOT DISTINCT FROM owner AS owned FROM own WHERE NOT is_open)
SELECT run_id, stage, seq, attempt, owner, CASE WHEN NOT owned THEN 'lost_ownership'
  WHEN seq = min(CASE WHEN owned THEN seq END) OVER (PARTITION BY run_id, stage) THEN 'accepted' ELSE 'already_published' END AS verdict FROM res"""))
def _(spark, d):
    return L.owned_results(_ledger_log(spark, d), _hour())


@query("outcome_contract", "run_id:l position:l reason:s", sql("""
SELECT run_id, position, reason FROM (SELECT run_id, position, CASE
  WHEN status IN ('failed', 'blocked', 'cancelled') AND coalesce(reason_code, '') = '' THEN 'REASON_MISSING'
  WHEN status NOT IN ('failed', 'blocked', 'cancelled') AND coalesce(reason_code, '') <> '' THEN 'REASON_UNEXPECTED'
  WHEN status IN ('failed', 'cancelled') AND output_count > 0 THEN 'OUTPUTS_UNEXPECTED' END AS reason FROM attempts) WHERE reason IS NOT NULL"""))
def _(spark, d):
    return L.contract_errors(_attempts(spark, d))


@query("budget_violations", "run_id:l position:l violation:s", sql("""
SELECT run_id, position, unnest(list_filter([CASE WHEN wall_ms > 60000 THEN 'wall_ms' END, CASE WHEN cpu_ms > 50000 THEN 'cpu_ms' END,
  CASE WHEN output_bytes > 9000 THEN 'output_bytes' END], lambda v: v IS NOT NULL)) AS violation FROM attempts WHERE status NOT IN ('failed', 'cancelled')"""))
def _(spark, d):
    return L.budget_violations(_attempts(spark, d), {"wall_ms": 60000, "cpu_ms": 50000, "output_bytes": 9000})


@query("output_budget", "attempt_id:l files:l stopped_at:l within_budget:l", sql("""
SELECT attempt_id, count(*) AS files, min(CASE WHEN nth > 50 OR total > 60000 THEN position END) AS stopped_at, count(*) FILTER (WHERE NOT (nth > 50 OR total > 60000)) AS within_budget
FROM (SELECT run_id AS attempt_id, position, row_number() OVER w AS nth, sum(output_bytes) OVER w AS total FROM attempts WINDOW w AS (PARTITION BY run_id ORDER BY position)) GROUP BY 1"""))
def _(spark, d):
    files = _attempts(spark, d).select(F.col("run_id").alias("attempt_id"), "position", "ts", F.col("output_bytes").alias("byte_length"))
    return L.output_budget(files, _hour(), 50, 60000)


@query("phase_states", "run_id:l position:l state:s final_state:s", sql("""
SELECT run_id, position, state, CASE WHEN coalesce(bool_or(state IN ('failed', 'blocked', 'cancelled')) OVER
    (PARTITION BY run_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) OR state IN ('pending', 'running') THEN 'unavailable' ELSE state END AS final_state
FROM (SELECT run_id, position, CASE WHEN position % 6 = 0 THEN 'running' ELSE status END AS state FROM attempts)"""))
def _(spark, d):
    phases = _attempts(spark, d).withColumn("state", F.expr("if(position % 6 = 0, 'running', status)"))
    return L.phase_states(phases, _hour())


@query("input_chain", "run_id:l position:l", sql("""
SELECT run_id, position FROM (SELECT run_id, position, position // 2 % 5 AS i, lag(position % 5) OVER (PARTITION BY run_id ORDER BY position) AS p FROM attempts) WHERE i <> p"""))
def _(spark, d):
    artifact = lambda k: f"array(named_struct('sha', sha2(cast({k} as string), 256), 'n', {k}))"
    stages = _attempts(spark, d).selectExpr("run_id", "position", "ts", f"{artifact('position div 2 % 5')} as inputs", f"{artifact('position % 5')} as outputs")
    return L.input_chain_breaks(stages, _hour())


@query("single_result", "run_id:l matches:l single:b", sql("""
SELECT run_id, CASE position % 4 WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END AS matches, position % 4 IN (1, 2) AS single
FROM attempts QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY position DESC) = 1"""))
def _(spark, d):
    stages = _attempts(spark, d).selectExpr(
        "run_id", "position", "element_at(array(array('other'), array('result'), array('other', 'result'), array('result', 'result')), cast(position % 4 + 1 as int)) as output_roles")
    return L.single_result(stages, "result")


@query("descriptor_lookup", "report_id:l artifact_id:s status:s", sql("""
WITH des AS (SELECT o_orderkey AS report_id, unnest(['n' || o_orderkey % 7, 'l0', 'l' || o_orderkey % 3, 's' || o_custkey % 5, 'd' || o_custkey % 4, 'd' || o_orderkey % 4]) AS id FROM orders),
c AS (SELECT report_id, id, count(*) AS n FROM des GROUP BY 1, 2),
look AS (SELECT o_orderkey AS report_id, unnest(['n3', 'l0', 'd1', 's' || o_custkey % 5]) AS artifact_id FROM orders)
SELECT look.report_id, artifact_id, CASE WHEN n IS NULL THEN 'unknown' WHEN n > 1 THEN 'ambiguous' ELSE 'found' END AS status
FROM look LEFT JOIN c ON c.report_id = look.report_id AND c.id = artifact_id"""))
def _(spark, d):
    item = lambda text: f"named_struct('id', {text}, 'role', 'x')"
    orders = I.table(spark, d, "orders")
    reports = orders.selectExpr(
        "o_orderkey as report_id", f"array({item(chr(39) + 'n' + chr(39) + ' || (o_orderkey % 7)')}) as normalization",
        f"array({item(chr(39) + 'l0' + chr(39))}, {item(chr(39) + 'l' + chr(39) + ' || (o_orderkey % 3)')}) as layers",
        f"array({item(chr(39) + 's' + chr(39) + ' || (o_custkey % 5)')}) as source",
        f"array({item(chr(39) + 'd' + chr(39) + ' || (o_custkey % 4)')}, {item(chr(39) + 'd' + chr(39) + ' || (o_orderkey % 4)')}) as depth")
    lookups = orders.selectExpr("o_orderkey as report_id", "explode(array('n3', 'l0', 'd1', 's' || (o_custkey % 5))) as artifact_id")
    return L.descriptor_lookup(reports, lookups, ["normalization", "layers", "source", "depth"])


@query("discover_runs", "run_id:s origin:s state:s", sql("""
SELECT 'run.' || run_id AS run_id, ['job', 'model', 'baseline'][p + 1] AS origin, state FROM (
  SELECT user_id AS run_id, 0 AS p, CASE WHEN event_type = 'error' AND user_id % 4 = 1 THEN 'failed' WHEN event_type = 'click' AND user_id % 5 = 2 THEN 'running' END AS state FROM events UNION ALL
  SELECT o_custkey, 1, CASE WHEN o_custkey % 3 = 0 THEN 'unreadable' ELSE o_orderstatus END FROM orders UNION ALL
  SELECT c_custkey, 2, c_mktsegment FROM customer)
WHERE state IS NOT NULL AND state <> 'unreadable' QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY p, state) = 1"""))
def _(spark, d):
    """Every event is a job record, most of them completed; a third of the customers have no readable model result."""
    jobs = I.table(spark, d, "events").selectExpr(
        "concat('run.', user_id) as run_id", "case when event_type = 'error' and user_id % 4 = 1 then 'failed' when event_type = 'click' and user_id % 5 = 2 then 'running' else 'completed' end as state")
    model = I.table(spark, d, "orders").selectExpr("concat('run.', o_custkey) as run_id", "if(o_custkey % 3 = 0, 'unreadable', o_orderstatus) as state").where("state <> 'unreadable'")
    baseline = I.table(spark, d, "customer").selectExpr("concat('run.', c_custkey) as run_id", "c_mktsegment as state")
    return L.discover_runs(model, baseline, jobs)


SEED_SQL = "lpad(('0x' || substr(sha256(o_orderkey::VARCHAR), 1, 16))::UBIGINT::VARCHAR, 20, '0')"


def _seeds(spark, d) -> DataFrame:
    return I.table(spark, d, "orders").select("o_orderkey", "o_orderpriority", D.u64_from_hash(F.sha2(F.col("o_orderkey").cast("string"), 256)).alias("seed"))


I.CTES["seeds"] = f"SELECT o_orderkey, o_orderpriority, {SEED_SQL} AS seed FROM orders"


@query("derive_seed", "o_orderkey:l seed:s derived:s", sql("""
SELECT o_orderkey, seed, lpad(('0x' || substr(sha256(seed || chr(31) || 'DECOMPOSE' || chr(31) || o_orderpriority), 1, 16))::UBIGINT::VARCHAR, 20, '0') AS derived FROM seeds"""))
def _(spark, d):
    return _seeds(spark, d).withColumn("derived", D.derive_seed(F.col("seed"), F.lit("DECOMPOSE"), F.col("o_orderpriority")))


@query("derive_stage_seed", "o_orderkey:l derived:s", sql(r"""
SELECT o_orderkey, lpad(('0x' || substr(sha256('celstack.stage-seed.v1'::BLOB || '\x00'::BLOB || unhex(lpad(to_hex(seed::UBIGINT), 16, '0')) || '\x00'::BLOB || encode('stage.' || o_orderkey % 11)), 1, 16))::UBIGINT::VARCHAR, 20, '0') AS derived FROM seeds"""))
def _(spark, d):
    stage = F.concat(F.lit("stage."), (F.col("o_orderkey") % 11).cast("string"))
    return _seeds(spark, d).withColumn("derived", D.derive_stage_seed(F.col("seed"), stage, "celstack.stage-seed.v1"))


@query("framed_digest", "doc_id:l digest:s", sql("""
SELECT doc_id, sha256(unhex('0000000000000010') || encode('celstack.text.v1') || unhex(lpad(to_hex(octet_length(encode(lang))), 16, '0')) || encode(lang)
  || unhex(lpad(to_hex(octet_length(encode(text))), 16, '0')) || encode(text)) AS digest FROM documents"""))
def _(spark, d):
    digest = D.framed_digest("celstack.text.v1", F.encode("lang", "utf-8"), F.encode("text", "utf-8"))
    return I.table(spark, d, "documents").select("doc_id", digest.alias("digest"))
