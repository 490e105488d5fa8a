"""Queries over review ballots and paired outcomes. Assets are conversations or orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import digests as D
from ..operators import experiment as E
from . import inputs as I
from .inputs import sql
from .registry import query


def _ballots(spark, d) -> DataFrame:
    """Every turn is a ballot; a conversation's turns are dealt out to assets of one to four ballots."""
    return I.table(spark, d, "conversations").selectExpr(
        "concat(conv_id, '-', turn div (1 + conv_id % 4)) as asset_id", "cast(turn % (1 + conv_id % 4) as int) as seq", "element_at(array('left', 'right', 'tie'), cast((length(text) + turn) % 3 + 1 as int)) as vote")


I.CTES["ballots"] = "SELECT conv_id || '-' || turn // (1 + conv_id % 4) AS asset_id, turn % (1 + conv_id % 4) AS seq, ['left', 'right', 'tie'][(length(text) + turn) % 3 + 1] AS vote FROM conversations"
I.CTES["adjudicated"] = """
SELECT asset_id, n AS ballots, CASE WHEN n NOT IN (2, 3) OR v0 IS NULL OR v1 IS NULL THEN 'invalid' WHEN v0 = v1 THEN v0 WHEN v2 IS NULL THEN 'third_required'
  WHEN v2 IN (v0, v1) THEN v2 ELSE 'tie' END AS outcome
FROM (SELECT asset_id, count(*) AS n, max(vote) FILTER (WHERE seq = 0) AS v0, max(vote) FILTER (WHERE seq = 1) AS v1, max(vote) FILTER (WHERE seq = 2) AS v2 FROM ballots GROUP BY 1)"""


@query("adjudicate_ballots", "asset_id:s ballots:l outcome:s", sql("SELECT asset_id, ballots, outcome FROM adjudicated"))
def _(spark, d):
    return E.adjudicate(_ballots(spark, d))


def _mapping(spark, d) -> DataFrame:
    assets = _ballots(spark, d).select("asset_id").distinct()
    return E.blind_mapping(assets.withColumn("seed", D.u64_from_hash(F.sha2("asset_id", 256))), "celstack.blind-mapping.v1")


I.CTES["mapping"] = r"""
SELECT asset_id, CASE WHEN even THEN 'candidate' ELSE 'comparator' END AS left_arm, CASE WHEN even THEN 'comparator' ELSE 'candidate' END AS right_arm
FROM (SELECT asset_id, ('0x' || substr(sha256('celstack.blind-mapping.v1'::BLOB || '\x00'::BLOB || unhex(substr(sha256(asset_id), 1, 16)) || '\x00'::BLOB || encode(asset_id)), 1, 2))::INT % 2 = 0 AS even
      FROM (SELECT DISTINCT asset_id FROM ballots))"""


@query("blind_mapping", "asset_id:s left_arm:s right_arm:s", sql("SELECT asset_id, left_arm, right_arm FROM mapping"))
def _(spark, d):
    return _mapping(spark, d)


@query("reveal_outcomes", "asset_id:s outcome:s revealed:s", sql("""
SELECT asset_id, outcome, CASE WHEN outcome = 'tie' THEN 'tie' WHEN outcome IN ('left', 'right') THEN
  CASE WHEN CASE outcome WHEN 'left' THEN left_arm ELSE right_arm END = 'candidate' THEN 'candidate_win' ELSE 'comparator_win' END END AS revealed
FROM mapping JOIN adjudicated USING (asset_id)"""))
def _(spark, d):
    return E.reveal(_mapping(spark, d), E.adjudicate(_ballots(spark, d)))


def _pairs(spark, d) -> DataFrame:
    """One pair per order line; statuses and reviews from its flags."""
    return I.table(spark, d, "lineitem").selectExpr(
        "l_orderkey div 20 as experiment_id", "concat(l_orderkey, '-', l_linenumber, '-', l_partkey) as asset_id",
        "if(l_partkey % 37 = 0, 'failed', 'succeeded') as candidate_status", "if(l_orderkey div 20 % 5 = 0 and l_partkey % 41 = 0, 'failed', 'succeeded') as comparator_status",
        "element_at(array('candidate_win', 'comparator_win', 'tie', null, 'candidate_win', 'candidate_win'), cast((l_partkey * 7 + l_orderkey div 20) % 6 + 1 as int)) as review_outcome",
        "l_quantity > 15 as candidate_usable")


I.CTES["pairs"] = """
SELECT *, CASE WHEN comparator_status <> 'succeeded' THEN 'invalid' WHEN candidate_status <> 'succeeded' THEN 'comparator_win' WHEN review_outcome IS NULL THEN 'tie' ELSE review_outcome END AS outcome,
  comparator_status = 'succeeded' AND candidate_status = 'succeeded' AND candidate_usable AS usable,
  CASE WHEN comparator_status <> 'succeeded' THEN 'comparator_infrastructure_failure' WHEN candidate_status <> 'succeeded' THEN 'candidate_failure' WHEN review_outcome IS NULL THEN 'missing_review_evidence' ELSE 'reviewed' END AS reason
FROM (SELECT l_orderkey // 20 AS experiment_id, l_orderkey || '-' || l_linenumber || '-' || l_partkey AS asset_id,
  CASE WHEN l_partkey % 37 = 0 THEN 'failed' ELSE 'succeeded' END AS candidate_status, CASE WHEN l_orderkey // 20 % 5 = 0 AND l_partkey % 41 = 0 THEN 'failed' ELSE 'succeeded' END AS comparator_status,
  ['candidate_win', 'comparator_win', 'tie', NULL, 'candidate_win', 'candidate_win'][(l_partkey * 7 + l_orderkey // 20) % 6 + 1] AS review_outcome, l_quantity > 15 AS candidate_usable FROM lineitem)"""


@query("classify_pairs", "asset_id:s outcome:s usable:b reason:s", sql("SELECT asset_id, outcome, usable, reason FROM pairs"))
def _(spark, d):
    return E.classify_pairs(_pairs(spark, d))


def _twenty(spark, d) -> DataFrame:
    """Experiments of one order line per order, twenty orders each; some orders have no such line."""
    classified = E.classify_pairs(_pairs(spark, d))
    order = F.split("asset_id", "-")[0]
    first = classified.groupBy("experiment_id", order.alias("order_id")).agg(F.min(F.struct("asset_id", "outcome", "usable")).alias("p"))
    return first.select("experiment_id", "p.asset_id", "p.outcome", "p.usable")


I.CTES["twenty"] = """
SELECT experiment_id, asset_id, outcome, usable FROM pairs QUALIFY row_number() OVER (PARTITION BY experiment_id, split_part(asset_id, '-', 1) ORDER BY asset_id, outcome, usable) = 1"""
TAIL_SQL = "list_sum(list_transform(range(w, w + l + 1), lambda k: list_reduce(list_prepend(1::HUGEINT, range(1, k + 1)), lambda acc, i: acc * (w + l - i + 1) // i)))"


@query("evaluate_experiments", "experiment_id:l assets:l wins:l losses:l ties:l usable:l problem:s p:d superiority:b passes:b", sql(f"""
SELECT experiment_id, assets, w AS wins, l AS losses, t AS ties, usable, problem,
  CASE WHEN problem IS NULL THEN CASE WHEN w + l = 0 THEN 1 ELSE {TAIL_SQL} / pow(2, w + l) END END AS p,
  coalesce(problem IS NULL AND w - l >= 4 AND {TAIL_SQL} / pow(2, w + l) < 0.05, false) AS superiority,
  coalesce(problem IS NULL AND w - l >= 4 AND {TAIL_SQL} / pow(2, w + l) < 0.05, false) AND usable >= 12 AS passes
FROM (SELECT *, CASE WHEN assets <> 20 THEN 'DENOMINATOR_INVALID' WHEN bad > 0 THEN 'INVALID_PAIR' END AS problem FROM (
  SELECT experiment_id, count(*) AS assets, count(*) FILTER (WHERE outcome = 'invalid') AS bad, count(*) FILTER (WHERE outcome = 'candidate_win') AS w,
    count(*) FILTER (WHERE outcome = 'comparator_win') AS l, count(*) FILTER (WHERE outcome = 'tie') AS t, count(*) FILTER (WHERE usable) AS usable FROM twenty GROUP BY 1))"""))
def _(spark, d):
    return E.evaluate_experiments(_twenty(spark, d))


def _scores(spark, d) -> DataFrame:
    """Wins and losses per customer from order statuses; some customers' are multiplied past the exact range and into the thousands."""
    scale = "case o_custkey % 7 when 0 then 8 when 1 then 200 else 1 end"
    return I.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("arm_id")).agg(
        F.sum(F.expr(f"if(o_orderstatus = 'F', {scale}, 0)")).alias("wins"), F.sum(F.expr(f"if(o_orderstatus = 'O', {scale}, 0)")).alias("losses"))


I.CTES["scores"] = """
SELECT o_custkey AS arm_id, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN s ELSE 0 END) AS BIGINT) AS w, CAST(sum(CASE WHEN o_orderstatus = 'O' THEN s ELSE 0 END) AS BIGINT) AS l
FROM (SELECT *, CASE o_custkey % 7 WHEN 0 THEN 8 WHEN 1 THEN 200 ELSE 1 END AS s FROM orders) GROUP BY 1"""


@query("binomial_upper_tail", "arm_id:l wins:l losses:l p:d problem:s", sql(f"""
SELECT arm_id, w AS wins, l AS losses, round({TAIL_SQL} / pow(2, w + l), 9) AS p, NULL AS problem FROM scores WHERE w + l > 0 AND w + l <= 60 UNION ALL
SELECT arm_id, w, l, round(list_sum(list_transform(range(w, w + l + 1), lambda k: exp(lgamma(w + l + 1) - lgamma(k + 1) - lgamma(w + l - k + 1) - (w + l) * ln(2)))), 9), NULL FROM scores WHERE w + l > 60 UNION ALL
SELECT arm_id, w, l, NULL, 'NO_TRIALS' FROM scores WHERE w + l = 0"""))
def _(spark, d):
    return E.binomial_upper_tail(_scores(spark, d)).withColumn("p", F.round("p", 9))


@query("clopper_pearson", "arm_id:l wins:l losses:l lower:d upper:d problem:s", ("""
WITH RECURSIVE u AS (SELECT DISTINCT w, l FROM scores WHERE w + l > 0),
step AS (SELECT w, l, 0 AS i, 0.0::DOUBLE AS alo, w / (w + l) AS ahi, w / (w + l) AS blo, 1.0::DOUBLE AS bhi FROM u UNION ALL
  SELECT w, l, i + 1, CASE WHEN 1 - cdf_a > 0.025 THEN alo ELSE ma END, CASE WHEN 1 - cdf_a > 0.025 THEN ma ELSE ahi END,
    CASE WHEN cdf_b > 0.025 THEN mb ELSE blo END, CASE WHEN cdf_b > 0.025 THEN bhi ELSE mb END
  FROM (SELECT *, CASE WHEN w = 0 THEN 0 ELSE list_sum(list_transform(range(0, w), lambda k: exp(lgamma(w + l + 1) - lgamma(k + 1) - lgamma(w + l - k + 1) + k * ln(ma) + (w + l - k) * ln(1 - ma)))) END AS cdf_a,
      CASE WHEN l = 0 THEN 1 ELSE list_sum(list_transform(range(0, w + 1), lambda k: exp(lgamma(w + l + 1) - lgamma(k + 1) - lgamma(w + l - k + 1) + k * ln(mb) + (w + l - k) * ln(1 - mb)))) END AS cdf_b
    FROM (SELECT *, CASE WHEN w = 0 THEN 0.5 ELSE (alo + ahi) / 2 END AS ma, CASE WHEN l = 0 THEN 0.5 ELSE (blo + bhi) / 2 END AS mb FROM step WHERE i < 60)))
SELECT arm_id, w AS wins, l AS losses, CASE WHEN w = 0 THEN 0 ELSE round((alo + ahi) / 2, 6) END AS lower, CASE WHEN l = 0 THEN 1 ELSE round((blo + bhi) / 2, 6) END AS upper, NULL AS problem
FROM scores JOIN step USING (w, l) WHERE i = 60 UNION ALL SELECT arm_id, w, l, NULL, NULL, 'NO_TRIALS' FROM scores WHERE w + l = 0""".replace("WITH RECURSIVE u AS", "WITH RECURSIVE scores AS (" + I.CTES["scores"] + "), u AS")))
def _(spark, d):
    solved = E.clopper_pearson(_scores(spark, d))
    return solved.withColumn("lower", F.round("lower", 6)).withColumn("upper", F.round("upper", 6))


@query("arm_parity", "asset_id:s differing:s parity:b", sql("""
SELECT p_partkey::VARCHAR AS asset_id, concat_ws(',', CASE WHEN p_partkey % 31 = 0 THEN 'source_sha256' END, CASE WHEN p_partkey % 43 = 0 THEN 'width' END,
   CASE WHEN p_partkey % 29 = 0 THEN 'frame_ids' END) AS differing, differing = '' AS parity FROM part"""))
def _(spark, d):
    def arm(side: str) -> DataFrame:
        flip = lambda k: f"if({str(side == 'comparator').lower()} and p_partkey % {k} = 0, 1, 0)"
        return I.table(spark, d, "part").selectExpr(
            "cast(p_partkey as string) as asset_id", f"sha2(cast(p_partkey + {flip(31)} as string), 256) as source_sha256", "p_brand as sequence_sha256",
            "p_type as contract_id", "p_name as profile_id", f"p_size + {flip(43)} as width", "p_size as height",
            f"if({flip(29)} = 1, array('b', 'a'), array('a', 'b')) as frame_ids")
    return E.arm_parity(arm("candidate"), arm("comparator")).withColumn("differing", F.array_join("differing", ","))


@query("acceptance_summary", "run_id:l local_status:s ready_for_scoring:b gate_status:s", sql("""
SELECT l_orderkey AS run_id, CASE WHEN bool_and(l_partkey % 11 <> 0) AND bool_and(l_quantity > 2) AND bool_and(l_tax < 0.08) THEN 'LOCAL_TECHNICAL_PREFLIGHT_PASS' ELSE 'LOCAL_TECHNICAL_PREFLIGHT_FAIL' END AS local_status,
  false AS ready_for_scoring, 'NOT_EVALUATED' AS gate_status FROM lineitem GROUP BY 1"""))
def _(spark, d):
    runs = I.table(spark, d, "lineitem").selectExpr("l_orderkey as run_id", "l_partkey % 11 <> 0 as parity", "l_quantity > 2 as statistics", "l_tax < 0.08 as structure")
    return E.acceptance_summary(runs)
