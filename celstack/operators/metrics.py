"""Documented quality, reliability, cost and calibration metrics over result tables.

Failures stay in every denominator. Exact percentiles go through value counts and a bucketed running total, so a session
holding a large share of all measurements is neither sorted nor collected in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hotkeys
from .graph import connected_components
from .pixels import PX

WILSON_Z = 1.959963984540054


def wilson(successes: str, trials: str, upper: bool) -> Column:
    """Bound of the two-sided 95% Wilson interval, null without trials."""
    z, sign = WILSON_Z, "+" if upper else "-"
    p = f"({successes} / {trials})"
    bound = f"({p} + {z * z}D / (2 * {trials}) {sign} {z}D * sqrt({p} * (1 - {p}) / {trials} + {z * z}D / (4 * {trials} * {trials}))) / (1 + {z * z}D / {trials})"
    return F.expr(f"case when {trials} > 0 then least(1.0D, greatest(0.0D, {bound})) end")


def first_usable(starts: DataFrame) -> DataFrame:
    """First-usable rate and verified reliability per cohort; only explicit early user cancels leave the reliability denominator."""
    facts = starts.groupBy("cohort").agg(
        F.count("*").alias("starts"), F.count_if("usable_first").alias("usable"), F.count_if("verified").alias("verified"), F.count_if("user_cancelled").alias("cancelled"))
    return facts.withColumn("usable_rate", F.expr("usable / starts")).withColumn("reliability", F.expr("try_divide(verified, starts - cancelled)"))


def eligibility(labels: DataFrame) -> DataFrame:
    """Ineligible recall and eligible false-block with Wilson bounds per slice of ``(slice, eligible, blocked)``."""
    facts = labels.groupBy("slice").agg(
        F.count_if(~F.col("eligible")).alias("ineligible"), F.count_if(~F.col("eligible") & F.col("blocked")).alias("caught"),
        F.count_if("eligible").alias("eligible"), F.count_if(F.col("eligible") & F.col("blocked")).alias("false_blocked"))
    return facts.select(
        "slice", "ineligible", "eligible", F.expr("try_divide(caught, ineligible)").alias("recall"), wilson("caught", "ineligible", False).alias("recall_low"),
        F.expr("try_divide(false_blocked, eligible)").alias("false_block"), wilson("false_blocked", "eligible", True).alias("false_block_high"))


def slice_report(items: DataFrame, dimensions: list[str]) -> DataFrame:
    """Success per slice level and overall, with the slice rules: n >= 3 must not be zero; n >= 20 needs 65% and at most
    15 points below overall; smaller slices are exploratory. Every item is expanded to its levels once (grouping sets)."""
    levels = F.array(F.struct(F.lit("overall").alias("dimension"), F.lit("all").alias("level")),
                     *[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("level")) for d in dimensions])
    facts = items.select("success", F.inline(levels)).groupBy("dimension", "level").agg(F.count("*").alias("n"), F.count_if("success").alias("wins"))
    # every item has exactly one level per dimension, so each dimension's levels sum to the overall counts
    overall = facts.groupBy("dimension").agg((F.sum("wins") / F.sum("n")).alias("overall_rate"))
    joined = facts.join(overall, "dimension").withColumn("rate", F.expr("wins / n"))
    verdict = F.expr("case when n >= 3 and wins = 0 then 'zero_success' when n < 20 then 'exploratory' when rate < 0.65D then 'below_minimum'"
                     " when rate < overall_rate - 0.15D then 'far_below_overall' else 'ok' end")
    return joined.select("dimension", "level", "n", "wins", "rate", verdict.alias("verdict"))


def exact_percentiles(measures: DataFrame, keys: list[str], value: str, ratios: dict[str, float], bucket: str) -> DataFrame:
    """Nearest-rank percentiles per key from value counts and a bucketed running total."""
    counts = measures.groupBy(*keys, value).agg(F.count("*").alias("n"))
    running = hotkeys.running(counts, keys, F.expr(bucket), [value], "upto", F.col("n"), "sum")
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    joined = running.join(totals, keys)
    picks = [F.min(F.when(F.col("upto") >= F.ceil(F.col("total") * q), F.col(value))).alias(name) for name, q in ratios.items()]
    return joined.groupBy(*keys).agg(F.max("total").alias("n"), *picks)


def session_latency(frames: DataFrame, long_ms: float) -> DataFrame:
    """p50, p95, p99, long-frame and drop rate per session, never pooled: ``(session_id, frame_us, dropped)``."""
    percentiles = exact_percentiles(frames, ["session_id"], "frame_us", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, "frame_us div 1000")
    rates = frames.groupBy("session_id").agg(F.count_if(F.col("frame_us") > long_ms * 1000).alias("long"), F.count_if("dropped").alias("dropped"))
    return percentiles.join(rates, "session_id").withColumn("long_rate", F.expr("long / n")).withColumn("drop_rate", F.expr("dropped / n"))


def start_costs(starts: DataFrame) -> DataFrame:
    """Spend per start by cohort: blended cost per verified success (infinite without one) and the failed share. Cents are integers."""
    facts = starts.groupBy("cohort").agg(
        F.count("*").alias("starts"), F.sum("cents").alias("spend"), F.coalesce(F.sum(F.when(~F.col("verified"), F.col("cents"))), F.lit(0)).alias("failed_spend"),
        F.count_if("verified").alias("verified"))
    return facts.withColumn("per_success", F.expr("if(verified = 0, double('infinity'), spend / verified)")).withColumn("failed_share", F.expr("try_divide(failed_spend, spend)"))


def event_quality(events: DataFrame, expected: DataFrame, late_seconds: int) -> DataFrame:
    """Daily missing, late, duplicate and invalid events against authoritative state ``(event_id, day)``.

    ``events``: (event_id, day, delay_seconds, valid). Deliveries are reduced per event before the full join.
    """
    seen = events.groupBy("event_id").agg(
        F.min("day").alias("seen_day"), F.count("*").alias("copies"), F.min("delay_seconds").alias("delay"), F.max("valid").alias("valid"))
    joined = expected.join(seen, "event_id", "full").withColumn("day", F.coalesce("day", "seen_day"))
    return joined.groupBy("day").agg(
        F.count_if(F.col("copies").isNull()).alias("missing"), F.count_if(F.col("delay") > late_seconds).alias("late"),
        F.sum(F.greatest(F.coalesce("copies", F.lit(1)) - 1, F.lit(0))).alias("duplicates"), F.count_if(~F.col("valid")).alias("invalid"))


def retention_deadlines(content: DataFrame, now: str) -> DataFrame:
    """Earliest applicable revoke deadline and the inventory-clear deadline 15 minutes later, with an overdue flag.

    Columns: created_at, terminal_at, outcome, delete_requested_at, cleared_at. Failed content is cleared at most 72 hours
    after its upload.
    """
    revoke = ("least(delete_requested_at, case when terminal_at is null then created_at + interval 24 hours else terminal_at + interval 24 hours end,"
              " if(outcome <> 'verified' or outcome is null, created_at + interval 72 hours - interval 15 minutes, null))")
    timed = content.withColumn("revoke_at", F.expr(revoke)).withColumn("clear_at", F.expr("revoke_at + interval 15 minutes"))
    return timed.withColumn("overdue", F.expr(f"coalesce(cleared_at, timestamp_ntz'{now}') > clear_at"))


def forbidden_fields(rows: DataFrame, document: str, allowed: list[str], forbidden: str) -> DataFrame:
    """Keys outside the allowlist and values matching a forbidden pattern, per JSON document."""
    listed = F.array(*[F.lit(a) for a in allowed])
    keys = F.array_except(F.json_object_keys(document), listed)
    return rows.withColumn("unknown_keys", keys).withColumn("forbidden_content", F.col(document).rlike(forbidden)).where("size(unknown_keys) > 0 or forbidden_content")


def mask_overlap(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """IoU and Dice per (image, class) from sparse masks ``(image, class, pixel)``; counts come from one full join."""
    key = ["class", *PX]
    joined = truth.select(*key, F.lit(True).alias("t")).join(predicted.select(*key, F.lit(True).alias("p")), key, "full")
    facts = joined.groupBy("image_id", "class").agg(F.count_if(F.expr("t and p")).alias("both"), F.count("*").alias("either"), F.count("t").alias("nt"), F.count("p").alias("np"))
    return facts.select("image_id", "class", F.expr("both / either").alias("iou"), F.expr("2 * both / (nt + np)").alias("dice"))


def colour_error(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Mean absolute error and PSNR per image over the pixels both images have; integer sums."""
    joined = expected.select(*PX, "r", "g", "b").join(actual.select(*PX, *[F.col(c).alias(f"o{c}") for c in "rgb"]), PX)
    d = [F.abs(F.col(c) - F.col(f"o{c}")).cast("bigint") for c in "rgb"]
    sums = joined.groupBy("image_id").agg(F.count("*").alias("n"), F.sum(d[0] + d[1] + d[2]).alias("s"), F.sum(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]).alias("q"))
    return sums.select("image_id", F.expr("s / (3.0D * n)").alias("l1"), F.expr("if(q = 0, double('infinity'), 10 * log10(65025.0D * 3 * n / q))").alias("psnr"))


def calibration(predictions: DataFrame, bins: int = 10) -> DataFrame:
    """Expected calibration error and Brier score per model of ``(model, score_milli, correct)``; an unavailable score is
    counted apart and never as a pass. Scores are integer thousandths, so all sums are exact."""
    scored = predictions.withColumn("bin", F.least(F.lit(bins - 1), F.expr(f"score_milli * {bins} div 1000")))
    target = F.when(F.col("correct"), 1000).otherwise(0)
    per_bin = scored.groupBy("model", "bin").agg(
        F.count("score_milli").alias("n"), F.sum("score_milli").alias("conf"), F.sum(F.when(F.col("score_milli").isNotNull(), target)).alias("hits"),
        F.sum((F.col("score_milli") - target) * (F.col("score_milli") - target)).alias("sq"), F.count_if(F.col("score_milli").isNull()).alias("unavailable"))
    return per_bin.groupBy("model").agg(
        F.sum("n").alias("n"), F.sum("unavailable").alias("unavailable"), (F.sum(F.abs(F.col("conf") - F.col("hits"))) / F.sum("n") / 1000.0).alias("ece"),
        (F.sum("sq") / F.sum("n") / 1e6).alias("brier"))


def risk_coverage(predictions: DataFrame) -> DataFrame:
    """Risk among the predictions kept at every confidence threshold; at most 1,001 thresholds per model reach the window."""
    counts = predictions.where("score_milli is not null").groupBy("model", "score_milli").agg(F.count("*").alias("n"), F.count_if(~F.col("correct")).alias("wrong"))
    ranked = counts.withColumn("rank", -F.col("score_milli"))
    kept = hotkeys.running(ranked, ["model"], F.expr("floor(rank / 100)"), ["rank"], "kept", F.col("n"), "sum")
    errors = hotkeys.running(kept, ["model"], F.expr("floor(rank / 100)"), ["rank"], "errors", F.col("wrong"), "sum")
    total = counts.groupBy("model").agg(F.sum("n").alias("total"))
    return errors.join(total, "model").select("model", "score_milli", F.expr("kept / total").alias("coverage"), F.expr("errors / kept").alias("risk"))


def rater_agreement(ballots: DataFrame) -> DataFrame:
    """First two raters per asset ``(asset_id, seq, vote)``: agreement flag; assets with one ballot are incomplete."""
    wide = ballots.groupBy("asset_id").agg(F.max(F.when(F.col("seq") == 0, F.col("vote"))).alias("first"), F.max(F.when(F.col("seq") == 1, F.col("vote"))).alias("second"))
    return wide.withColumn("state", F.expr("case when first is null or second is null then 'incomplete' when first = second then 'agree' else 'disagree' end"))


def acknowledgment_errors(acks: DataFrame, findings: DataFrame) -> DataFrame:
    """Acknowledgments that match no current review finding of the same code, instance, digest and policy.

    Copies of one finding are merged first; a blocking finding can never be acknowledged.
    """
    keys = ["project_id", "code", "instance_id"]
    current = findings.groupBy(*keys).agg(F.max("severity_rank").alias("rank"), F.max("digest").alias("digest_now"), F.max("policy").alias("policy_now"))
    reason = F.expr("case when rank is null then 'NO_FINDING' when rank <> 1 then 'NOT_REVIEW' when digest <> digest_now then 'DIGEST_CHANGED' when policy <> policy_now then 'POLICY_CHANGED' end")
    return acks.join(current, keys, "left").withColumn("reason", reason).where("reason is not null")


def override_replay(overrides: DataFrame) -> DataFrame:
    """Latest replay per (project, target); an unresolved conflict or rejection blocks publishing, and needs a reason."""
    latest = overrides.groupBy("project_id", "target_id").agg(F.max(F.struct("seq", "status", "reason_code")).alias("l"))
    bad = F.col("l.status").isin("conflict", "rejected")
    return latest.groupBy("project_id").agg(
        F.count("*").alias("targets"), F.count_if(bad).alias("unresolved"), F.count_if(bad & F.col("l.reason_code").isNull()).alias("without_reason")).withColumn(
        "publishable", F.col("unresolved") == 0)


def longest_clean_streak(runs: DataFrame, bucket: Column, required: int = 100) -> DataFrame:
    """Longest run of consecutive clean results per series: a streak is the rows sharing one count of earlier failures."""
    counted = hotkeys.running(runs, ["series"], bucket, ["seq"], "failures", F.when(~F.col("clean"), F.lit(1)).otherwise(0).cast("bigint"), "sum")
    streaks = counted.where("clean").groupBy("series", "failures").agg(F.count("*").alias("length"))
    best = streaks.groupBy("series").agg(F.max("length").alias("longest"))
    return runs.select("series").distinct().join(best, "series", "left").na.fill(0, ["longest"]).withColumn("passes", F.col("longest") >= required)


def budget_ladder(spend: DataFrame, bucket: Column, budget: int) -> DataFrame:
    """First position at which each account's running spend reaches 50, 75, 90 and 100 percent, and the current action."""
    total = hotkeys.running(spend, ["account"], bucket, ["seq"], "spent", F.col("cents"), "sum")
    reached = [F.min(F.when(F.col("spent") * 100 >= budget * p, F.col("seq"))).alias(f"at_{p}") for p in (50, 75, 90, 100)]
    action = F.expr("case when at_100 is not null then 'reject_new_starts' when at_90 is not null then 'pause_costly_profiles' when at_75 is not null then 'limit_invitations'"
                    " when at_50 is not null then 'observe' else 'normal' end")
    return total.groupBy("account").agg(F.max("spent").alias("spent"), *reached).withColumn("action", action)


def split_leakage(items: DataFrame, memberships: DataFrame) -> DataFrame:
    """Families of items ``(item_id, split)`` that share a group ``(item_id, kind, value)``, directly or over others, and lie in
    more than one split: family (its smallest item), number of items, and the splits."""
    node = lambda kind, item, value: F.struct(kind.alias("kind"), item.alias("item"), value.alias("value"))
    groups = memberships.where("item_id is not null and kind is not null and value is not null").select(
        node(F.lit(""), F.col("item_id"), F.lit("")).alias("a"), node(F.col("kind"), F.lit(0).cast("bigint"), F.col("value")).alias("b"))
    labels = connected_components(groups).where("node.kind = ''").select(F.col("node.item").alias("item_id"), F.col("component.item").alias("family"))
    placed = items.join(labels, "item_id", "left").withColumn("family", F.coalesce("family", "item_id"))
    counted = placed.groupBy("family", "split").agg(F.count("*").alias("n"))
    families = counted.groupBy("family").agg(F.sum("n").alias("items"), F.array_sort(F.collect_set("split")).alias("splits"))
    return families.where("size(splits) > 1")
