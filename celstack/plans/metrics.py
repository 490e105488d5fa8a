"""Queries for the documented reliability, cost, calibration and review metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import families as N
from ..operators import metrics as M
from . import inputs as I
from .experiment import _ballots
from .inputs import sql
from .ledger import HOUR
from .registry import query


def _starts(spark, d) -> DataFrame:
    return I.table(spark, d, "orders").selectExpr(
        "o_orderpriority as cohort", "o_orderstatus = 'F' as usable_first", "o_orderstatus = 'F' and o_custkey % 10 > 1 as verified", "o_orderstatus = 'P' and o_custkey % 4 = 0 as user_cancelled",
        "cast(o_totalprice as bigint) as cents")


I.CTES["starts"] = """
SELECT o_orderpriority AS cohort, o_orderstatus = 'F' AS usable_first, o_orderstatus = 'F' AND o_custkey % 10 > 1 AS verified, o_orderstatus = 'P' AND o_custkey % 4 = 0 AS user_cancelled, CAST(trunc(o_totalprice) AS BIGINT) AS cents FROM orders"""


@query("first_usable_rate", "cohort:s starts:l usable:l verified:l cancelled:l usable_rate:d reliability:d", sql("""
SELECT cohort, count(*) AS starts, count(*) FILTER (WHERE usable_first) AS usable, count(*) FILTER (WHERE s.verified) AS verified, count(*) FILTER (WHERE user_cancelled) AS cancelled,
  count(*) FILTER (WHERE usable_first) / count(*) AS usable_rate, count(*) FILTER (WHERE s.verified) / (count(*) - count(*) FILTER (WHERE user_cancelled)) AS reliability FROM starts s GROUP BY 1"""))
def _(spark, d):
    return M.first_usable(_starts(spark, d))


@query("start_costs", "cohort:s starts:l spend:l failed_spend:l verified:l per_success:d failed_share:d", sql("""
SELECT cohort, count(*) AS starts, sum(cents) AS spend, sum(CASE WHEN s.verified THEN 0 ELSE cents END) AS failed_spend, count(*) FILTER (WHERE s.verified) AS verified,
  sum(cents) / count(*) FILTER (WHERE s.verified) AS per_success, sum(CASE WHEN s.verified THEN 0 ELSE cents END) / sum(cents) AS failed_share FROM starts s GROUP BY 1"""))
def _(spark, d):
    return M.start_costs(_starts(spark, d))


WILSON = "((k / n) + 3.8414588206941227 / (2 * n) {s} 1.959963984540054 * sqrt((k / n) * (1 - k / n) / n + 3.8414588206941227 / (4 * n * n))) / (1 + 3.8414588206941227 / n)"


def _w(k: str, n: str, sign: str) -> str:
    import re

    text = re.sub(r"\b(k|n)\b", lambda m: {"k": k, "n": n}[m.group(1)], WILSON.format(s=sign))
    return f"CASE WHEN {n} > 0 THEN least(1.0, greatest(0.0, round({text}, 9))) + 0.0 END"


@query("eligibility", "slice:s ineligible:l eligible:l recall:d recall_low:d false_block:d false_block_high:d", sql(f"""
SELECT slice, ineligible, eligible, CASE WHEN ineligible > 0 THEN caught / ineligible END AS recall, {_w('caught', 'ineligible', '-')} AS recall_low, CASE WHEN eligible > 0 THEN fb / eligible END AS false_block, {_w('fb', 'eligible', '+')} AS false_block_high
FROM (SELECT lang AS slice, count(*) FILTER (WHERE quality = 0) AS ineligible, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS caught, count(*) FILTER (WHERE quality = 1) AS eligible, count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS fb
  FROM labels JOIN documents USING (doc_id) GROUP BY 1)"""))
def _(spark, d):
    rows = I.table(spark, d, "labels").join(I.table(spark, d, "documents").select("doc_id", "lang"), "doc_id").selectExpr("lang as slice", "quality = 1 as eligible", "toxic = 1 as blocked")
    return M.eligibility(rows).withColumn("recall_low", F.expr("round(recall_low, 9) + 0.0D")).withColumn("false_block_high", F.expr("round(false_block_high, 9) + 0.0D"))


@query("slice_report", "dimension:s level:s n:l wins:l rate:d verdict:s", sql("""
WITH i AS (SELECT lang, source, quality = 1 AS success FROM labels JOIN documents USING (doc_id)),
f AS (SELECT CASE WHEN GROUPING(lang) = 0 THEN 'lang' WHEN GROUPING(source) = 0 THEN 'source' ELSE 'overall' END AS dimension, coalesce(lang, source, 'all') AS level, count(*) AS n, count(*) FILTER (WHERE success) AS wins FROM i GROUP BY GROUPING SETS ((), (lang), (source)))
SELECT dimension, level, n, wins, wins / n AS rate, CASE WHEN n >= 3 AND wins = 0 THEN 'zero_success' WHEN n < 20 THEN 'exploratory' WHEN wins / n < 0.65 THEN 'below_minimum'
  WHEN wins / n < (SELECT wins / n FROM f WHERE dimension = 'overall') - 0.15 THEN 'far_below_overall' ELSE 'ok' END AS verdict FROM f"""))
def _(spark, d):
    items = I.table(spark, d, "labels").join(I.table(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id").selectExpr("lang", "source", "quality = 1 as success")
    return M.slice_report(items, ["lang", "source"])


@query("session_latency", "session_id:l n:l p50:l p95:l p99:l long_rate:d drop_rate:d", sql("""
SELECT user_id AS session_id, count(*) AS n, list_sort(list(us))[ceil(count(*) * 0.5)::INT] AS p50, list_sort(list(us))[ceil(count(*) * 0.95)::INT] AS p95, list_sort(list(us))[ceil(count(*) * 0.99)::INT] AS p99,
  count(*) FILTER (WHERE us > 33300) / count(*) AS long_rate, count(*) FILTER (WHERE event_type = 'error') / count(*) AS drop_rate FROM (SELECT *, CAST(floor(value * 1000) AS BIGINT) AS us FROM events) GROUP BY 1"""))
def _(spark, d):
    return M.session_latency(I.table(spark, d, "events").selectExpr("user_id as session_id", "cast(floor(value * 1000) as bigint) as frame_us", "event_type = 'error' as dropped"), 33.3)


@query("event_quality", "day:l missing:l late:l duplicates:l invalid:l", sql("""
WITH e AS (SELECT event_id, event_id // 500 AS day, event_id % 90 AS delay, event_type <> 'error' AS valid FROM events WHERE event_id % 37 <> 0 UNION ALL SELECT event_id, event_id // 500, event_id % 90 + 5, true FROM events WHERE event_id % 41 = 0 AND event_id % 37 <> 0),
s AS (SELECT event_id, min(day) AS sd, count(*) AS c, min(delay) AS delay, bool_or(valid) AS valid FROM e GROUP BY 1)
SELECT coalesce(x.day, sd) AS day, count(*) FILTER (WHERE c IS NULL) AS missing, count(*) FILTER (WHERE delay > 60) AS late, sum(greatest(coalesce(c, 1) - 1, 0)) AS duplicates, count(*) FILTER (WHERE NOT valid) AS invalid
FROM (SELECT event_id, event_id // 500 AS day FROM events WHERE event_id % 53 <> 0) x FULL JOIN s ON s.event_id = x.event_id GROUP BY 1"""))
def _(spark, d):
    events = I.table(spark, d, "events")
    first = events.where("event_id % 37 <> 0").selectExpr("event_id", "event_id div 500 as day", "event_id % 90 as delay_seconds", "event_type <> 'error' as valid")
    again = events.where("event_id % 41 = 0 and event_id % 37 <> 0").selectExpr("event_id", "event_id div 500 as day", "event_id % 90 + 5 as delay_seconds", "true as valid")
    expected = events.where("event_id % 53 <> 0").selectExpr("event_id", "event_id div 500 as day")
    return M.event_quality(first.unionByName(again), expected, 60)


@query("retention_deadlines", "content_id:l clear_at:s overdue:b", sql("""
WITH c AS (SELECT o_orderkey AS id, o_orderdate AS created, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate + to_hours(CAST(o_custkey % 90 AS INT)) END AS terminal, CASE WHEN o_orderkey % 4 <> 0 THEN CASE WHEN o_orderstatus = 'F' THEN 'verified' ELSE 'failed' END END AS outcome,
   CASE WHEN o_orderkey % 9 = 0 THEN o_orderdate + to_hours(5) END AS del, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate + to_hours(CAST(o_orderkey % 100 AS INT)) END AS cleared FROM orders),
r AS (SELECT *, least(del, coalesce(terminal, created) + INTERVAL 24 HOUR, CASE WHEN outcome IS DISTINCT FROM 'verified' THEN created + INTERVAL 72 HOUR - INTERVAL 15 MINUTE END) + INTERVAL 15 MINUTE AS clear_at FROM c)
SELECT id AS content_id, strftime(clear_at, '%Y-%m-%d %H:%M:%S') AS clear_at, coalesce(cleared, TIMESTAMP '2030-01-01 00:00:00') > clear_at AS overdue FROM r"""))
def _(spark, d):
    content = I.table(spark, d, "orders").selectExpr(
        "o_orderkey as content_id", "o_orderdate as created_at", "if(o_orderkey % 4 <> 0, o_orderdate + make_dt_interval(0, cast(o_custkey % 90 as int)), null) as terminal_at",
        "if(o_orderkey % 4 <> 0, if(o_orderstatus = 'F', 'verified', 'failed'), null) as outcome", "if(o_orderkey % 9 = 0, o_orderdate + interval 5 hours, null) as delete_requested_at",
        "if(o_orderkey % 3 <> 0, o_orderdate + make_dt_interval(0, cast(o_orderkey % 100 as int)), null) as cleared_at")
    return M.retention_deadlines(content, "2030-01-01 00:00:00").withColumn("clear_at", F.date_format("clear_at", "yyyy-MM-dd HH:mm:ss"))


@query("forbidden_fields", "row_id:l unknown_keys:s forbidden_content:b", sql("""
SELECT event_id AS row_id, CASE WHEN event_id % 7 = 0 THEN 'filename' ELSE '' END AS unknown_keys, event_id % 11 = 0 AS forbidden_content FROM events WHERE event_id % 7 = 0 OR event_id % 11 = 0"""))
def _(spark, d):
    rows = I.table(spark, d, "events").selectExpr(
        "event_id as row_id", "to_json(map_concat(map('k', get_json_object(props, '$.k'), 'reason', if(event_id % 11 = 0, 'a@example.com', event_type)), if(event_id % 7 = 0, map('filename', 'x'), map()))) as doc")
    return M.forbidden_fields(rows, "doc", ["k", "reason"], r"[\w.]+@[\w.]+\.\w+").withColumn("unknown_keys", F.array_join("unknown_keys", ","))


@query("mask_overlap", "image_id:l class:s iou:d dice:d", sql("""
SELECT image_id, class, both_n / (nt + np - both_n) AS iou, 2 * both_n / (nt + np) AS dice FROM (
  SELECT image_id, CASE WHEN g % 2 = 0 THEN 'even' ELSE 'odd' END AS class, count(*) FILTER (WHERE a > 31) AS nt, count(*) FILTER (WHERE a > 90 OR r % 5 = 0) AS np, count(*) FILTER (WHERE a > 31 AND (a > 90 OR r % 5 = 0)) AS both_n FROM px GROUP BY 1, 2)"""))
def _(spark, d):
    p = I.pixels(spark, d).withColumn("class", F.expr("if(g % 2 = 0, 'even', 'odd')"))
    return M.mask_overlap(p.where("a > 31"), p.where("a > 90 or r % 5 = 0"))


@query("colour_error", "image_id:l l1:d psnr:d", sql("""
SELECT image_id, round(s / (3.0::DOUBLE * n), 9) AS l1, round(10 * log10(65025.0::DOUBLE * 3 * n / q), 9) AS psnr FROM (SELECT image_id, count(*) AS n, sum(d0 + d1 + d2) AS s, sum(d0 * d0 + d1 * d1 + d2 * d2) AS q FROM (
  SELECT image_id, abs(s.r - c.r) AS d0, abs(s.g - c.g) AS d1, abs(s.b - c.b) AS d2 FROM spx s JOIN comp c USING (image_id, x, y)) GROUP BY 1)"""))
def _(spark, d):
    from ..operators import compose as C

    found = M.colour_error(I.source_pixels(spark, d), C.composite_over(I.layer_pixels(spark, d)))
    return found.withColumn("l1", F.round("l1", 9)).withColumn("psnr", F.round("psnr", 9))


def _predictions(spark, d) -> DataFrame:
    return I.table(spark, d, "events").selectExpr(
        "event_type as model", "if(event_id % 17 = 0, null, least(1000, cast(floor(value * 10) as bigint))) as score_milli", "event_id % 100 < least(100, value) as correct")


I.CTES["preds"] = "SELECT event_type AS model, CASE WHEN event_id % 17 <> 0 THEN least(1000, CAST(floor(value * 10) AS BIGINT)) END AS score, event_id % 100 < least(100, value) AS correct FROM events"


@query("calibration", "model:s n:l unavailable:l ece:d brier:d", sql("""
SELECT model, sum(n) AS n, sum(un) AS unavailable, round(sum(abs(conf - hits)) / sum(n) / 1000, 9) AS ece, round(sum(sq) / sum(n) / 1e6, 9) AS brier FROM (
  SELECT model, least(9, score * 10 // 1000) AS bin, count(score) AS n, coalesce(sum(score), 0) AS conf, coalesce(sum(CASE WHEN score IS NOT NULL AND correct THEN 1000 ELSE 0 END), 0) AS hits, coalesce(sum((score - CASE WHEN correct THEN 1000 ELSE 0 END) ^ 2), 0) AS sq,
    count(*) - count(score) AS un FROM preds GROUP BY 1, 2) GROUP BY 1"""))
def _(spark, d):
    return M.calibration(_predictions(spark, d)).withColumn("ece", F.round("ece", 9)).withColumn("brier", F.round("brier", 9))


@query("risk_coverage", "model:s score_milli:l coverage:d risk:d", sql("""
SELECT model, score AS score_milli, kept / sum(n) OVER (PARTITION BY model) AS coverage, errors / kept AS risk FROM (SELECT *, sum(n) OVER w AS kept, sum(wrong) OVER w AS errors FROM (
  SELECT model, score, count(*) AS n, count(*) FILTER (WHERE NOT correct) AS wrong FROM preds WHERE score IS NOT NULL GROUP BY 1, 2) WINDOW w AS (PARTITION BY model ORDER BY score DESC))"""))
def _(spark, d):
    return M.risk_coverage(_predictions(spark, d))


@query("rater_agreement", "asset_id:s first:s second:s state:s", sql("""
SELECT asset_id, v0 AS first, v1 AS second, CASE WHEN v0 IS NULL OR v1 IS NULL THEN 'incomplete' WHEN v0 = v1 THEN 'agree' ELSE 'disagree' END AS state FROM (
  SELECT asset_id, max(vote) FILTER (WHERE seq = 0) AS v0, max(vote) FILTER (WHERE seq = 1) AS v1 FROM ballots GROUP BY 1)"""))
def _(spark, d):
    return M.rater_agreement(_ballots(spark, d))


@query("acknowledgment_match", "project_id:l code:s instance_id:l reason:s", sql("""
WITH f AS (SELECT l_orderkey AS p, l_shipmode AS code, l_linenumber AS i, max(r) AS rank, max(dg) AS dg, max(pol) AS pol FROM (SELECT l_orderkey, l_returnflag AS l_shipmode, l_linenumber, CAST(l_quantity AS BIGINT) % 3 AS r, l_partkey % 4 AS dg, l_suppkey % 2 AS pol FROM lineitem) GROUP BY 1, 2, 3)
SELECT project_id, code, instance_id, reason FROM (SELECT a.*, CASE WHEN rank IS NULL THEN 'NO_FINDING' WHEN rank <> 1 THEN 'NOT_REVIEW' WHEN a.dg <> f.dg THEN 'DIGEST_CHANGED' WHEN a.pol <> f.pol THEN 'POLICY_CHANGED' END AS reason FROM (
  SELECT o_orderkey AS project_id, ['A', 'N', 'R'][o_custkey % 3 + 1] AS code, o_custkey % 7 + 1 AS instance_id, o_custkey % 4 AS dg, 0 AS pol FROM orders) a LEFT JOIN f ON f.p = project_id AND f.code = a.code AND f.i = instance_id) WHERE reason IS NOT NULL"""))
def _(spark, d):
    findings = I.table(spark, d, "lineitem").selectExpr("l_orderkey as project_id", "l_returnflag as code", "cast(l_linenumber as bigint) as instance_id", "cast(l_quantity as bigint) % 3 as severity_rank", "l_partkey % 4 as digest", "l_suppkey % 2 as policy")
    acks = I.table(spark, d, "orders").selectExpr("o_orderkey as project_id", "element_at(array('A', 'N', 'R'), cast(o_custkey % 3 + 1 as int)) as code", "o_custkey % 7 + 1 as instance_id", "o_custkey % 4 as digest", "0L as policy")
    return M.acknowledgment_errors(acks, findings)


@query("override_replay", "project_id:l targets:l unresolved:l without_reason:l publishable:b", sql("""
WITH o AS (SELECT l_orderkey AS p, l_linenumber AS t, l_partkey * 1000 + l_suppkey AS seq, ['clean', 'applied', 'conflict', 'rejected'][CAST(l_quantity AS BIGINT) % 4 + 1] AS status, CASE WHEN l_tax > 0.01 THEN 'R' END AS reason FROM lineitem),
l AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY p, t ORDER BY seq DESC, status DESC, reason DESC NULLS LAST) = 1)
SELECT p AS project_id, count(*) AS targets, count(*) FILTER (WHERE status IN ('conflict', 'rejected')) AS unresolved, count(*) FILTER (WHERE status IN ('conflict', 'rejected') AND reason IS NULL) AS without_reason, unresolved = 0 AS publishable FROM l GROUP BY 1"""))
def _(spark, d):
    return M.override_replay(I.table(spark, d, "lineitem").selectExpr(
        "l_orderkey as project_id", "l_linenumber as target_id", "l_partkey * 1000 + l_suppkey as seq", "element_at(array('clean', 'applied', 'conflict', 'rejected'), cast(cast(l_quantity as bigint) % 4 + 1 as int)) as status",
        "if(l_tax > 0.01, 'R', null) as reason_code"))


@query("clean_streak", "series:l longest:l passes:b", sql("""
SELECT u.series, coalesce(max(n), 0) AS longest, coalesce(max(n), 0) >= 12 AS passes FROM (SELECT DISTINCT user_id AS series FROM events) u LEFT JOIN (SELECT series, f, count(*) AS n FROM (
  SELECT user_id AS series, event_type <> 'error' AS clean, count(*) FILTER (WHERE event_type = 'error') OVER (PARTITION BY user_id ORDER BY event_id) AS f FROM events) WHERE clean GROUP BY 1, 2) s ON s.series = u.series GROUP BY 1"""))
def _(spark, d):
    runs = I.table(spark, d, "events").selectExpr("user_id as series", "event_id as seq", "event_type <> 'error' as clean", "ts")
    return M.longest_clean_streak(runs, F.expr(HOUR), 12)


@query("budget_ladder", "account:l spent:l at_50:l at_75:l at_90:l at_100:l action:s", sql("""
SELECT account, max(spent) AS spent, min(CASE WHEN spent * 100 >= 250000 * 50 THEN seq END) AS at_50, min(CASE WHEN spent * 100 >= 250000 * 75 THEN seq END) AS at_75, min(CASE WHEN spent * 100 >= 250000 * 90 THEN seq END) AS at_90, min(CASE WHEN spent >= 250000 THEN seq END) AS at_100,
  CASE WHEN at_100 IS NOT NULL THEN 'reject_new_starts' WHEN at_90 IS NOT NULL THEN 'pause_costly_profiles' WHEN at_75 IS NOT NULL THEN 'limit_invitations' WHEN at_50 IS NOT NULL THEN 'observe' ELSE 'normal' END AS action
FROM (SELECT user_id AS account, event_id AS seq, sum(CAST(floor(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id) AS spent FROM events) GROUP BY 1"""))
def _(spark, d):
    spend = I.table(spark, d, "events").selectExpr("user_id as account", "event_id as seq", "cast(floor(value * 100) as bigint) as cents", "ts")
    return M.budget_ladder(spend, F.expr(HOUR), 250000)


@query("split_leakage", "family:l items:l splits:s", """
WITH RECURSIVE held AS (SELECT doc_id, md5(text) AS g FROM documents UNION SELECT doc_id, md5(split_part(text, chr(10), 1) || '|' || lang) FROM documents),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, y.doc_id FROM reach r JOIN held x ON r.b = x.doc_id JOIN held y ON x.g = y.g),
family AS (SELECT b AS doc_id, min(a) AS family FROM reach GROUP BY 1)
SELECT family, count(*) AS items, string_agg(DISTINCT s, ',' ORDER BY s) AS splits FROM (SELECT family, CASE WHEN doc_id % 10 < 8 THEN 'train' ELSE 'test' END AS s FROM family) GROUP BY 1 HAVING count(DISTINCT s) > 1""")
def _(spark, d):
    """Documents with one text, or one opening line and language, are one family."""
    docs = I.table(spark, d, "documents")
    groups = docs.selectExpr("doc_id as item_id", "explode(array(struct('text' as kind, md5(text) as value), struct('opening' as kind, md5(concat(split(text, '\\n')[0], '|', lang)) as value))) as g")
    found = M.split_leakage(docs.selectExpr("doc_id as item_id", "if(doc_id % 10 < 8, 'train', 'test') as split"), groups.select("item_id", "g.kind", "g.value"))
    return found.withColumn("splits", F.array_join("splits", ","))


I.CTES["doc_words"] = r"""
SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents"""
I.CTES["doc_shingles"] = """
SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM doc_words"""
I.CTES["doc_spread"] = "SELECT doc_id, len(sh) AS n, unnest(sh) AS s FROM doc_shingles"
I.CTES["doc_links"] = """
SELECT a.doc_id AS a, b.doc_id AS b FROM doc_spread a JOIN doc_spread b ON a.s = b.s AND a.doc_id <> b.doc_id AND a.n * 4 <= b.n * 5 AND b.n * 4 <= a.n * 5
  GROUP BY ALL HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))"""
FAMILIES_SQL = """
WITH RECURSIVE {ctes}, reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, doc_links.b FROM reach JOIN doc_links ON reach.b = doc_links.a),
family AS (SELECT doc_id, len(sh) AS n, family FROM doc_shingles JOIN (SELECT a AS doc_id, min(b) AS family FROM reach GROUP BY a) USING (doc_id))
""".format(ctes=", ".join(f"{name} AS ({I.CTES[name]})" for name in ("doc_words", "doc_shingles", "doc_spread", "doc_links")))


def _families(spark, d) -> DataFrame:
    return N.near_duplicate_families(I.table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), "text"))


@query("near_duplicate_families", "doc_id:l n_shingles:l family:l members:l", FAMILIES_SQL + """
SELECT doc_id, n AS n_shingles, family, count(*) OVER (PARTITION BY family) AS members FROM family""")
def _(spark, d):
    return _families(spark, d).withColumnRenamed("item_id", "doc_id")


@query("near_duplicate_leakage", "family:l items:l splits:s", FAMILIES_SQL + """
SELECT family, count(*) AS items, string_agg(DISTINCT s, ',' ORDER BY s) AS splits FROM (SELECT family, CASE WHEN doc_id % 10 < 8 THEN 'train' ELSE 'test' END AS s FROM family) GROUP BY 1 HAVING count(DISTINCT s) > 1""")
def _(spark, d):
    """Families of near-duplicate documents that lie in more than one split."""
    found = _families(spark, d)
    items = found.selectExpr("item_id", "if(item_id % 10 < 8, 'train', 'test') as split")
    groups = found.where("members > 1").selectExpr("item_id", "'near duplicate' as kind", "cast(family as string) as value")
    return M.split_leakage(items, groups).withColumn("splits", F.array_join("splits", ","))
