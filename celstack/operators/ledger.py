"""Run ledgers: stage order, roll-ups, attempt ownership, contracts, budgets and lineage of one run's stages.

Ordered checks use ``hotkeys`` scans, so a run holding a large share of all attempts is still cut into buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from . import hotkeys

TERMINAL = ("failed", "blocked", "cancelled")


def stage_rank(stage: Column) -> Column:
    """0-based position in the stage order, null for an unknown stage."""
    position = F.array_position(F.array(*[F.lit(s) for s in fixed.STAGE_ORDER]), stage)
    return F.when(position > 0, position - 1)


def stage_order_check(rows: DataFrame, bucket: Column) -> DataFrame:
    """Per run: stages, unknown stages and stages supplied before an earlier one of the order."""
    ranked = rows.withColumn("rank", stage_rank(F.col("stage")))
    previous = hotkeys.lag(ranked, ["run_id"], bucket, ["position"], {"previous_rank": "rank"})
    return previous.groupBy("run_id").agg(
        F.count("*").alias("stages"), F.count_if(F.col("rank").isNull()).alias("unknown"),
        F.count_if(F.col("rank") < F.col("previous_rank")).alias("out_of_order"))


def run_rollup(rows: DataFrame) -> DataFrame:
    """Terminal status of each run: the first failed, blocked or cancelled stage ends it and gives the reason;
    otherwise review beats fallback beats success. One combinable aggregate per run."""
    terminal = F.col("status").isin(*TERMINAL)
    first = F.min(F.when(terminal, F.struct("position", "status", "reason_code")))
    review = F.max(F.col("status").isin("needs_review", "review"))
    fallback = F.max(F.col("status") == "fallback")
    merged = rows.groupBy("run_id").agg(F.count("*").alias("stages"), first.alias("first"), review.alias("review"), fallback.alias("fallback"))
    status = F.expr("case when first is not null then first.status when review then 'needs_review' when fallback then 'fallback' else 'succeeded' end")
    return merged.select("run_id", "stages", status.alias("status"), F.col("first.reason_code").alias("reason_code"),
                         F.col("first.position").alias("ended_at"))


def owned_results(log: DataFrame, bucket: Column) -> DataFrame:
    """Verdict on every published result of a ledger log ``(run_id, stage, seq, kind, attempt)`` in ``seq`` order.

    A result counts only if its attempt is the last one opened before it, and only the first such result of a stage
    is accepted; the others lost ownership or came after publication.
    """
    opened = F.when(F.col("kind") == "open", F.col("attempt"))
    owners = hotkeys.running(log, ["run_id", "stage"], bucket, ["seq"], "owner", opened, "last")
    results = owners.where("kind = 'result'").withColumn("owned", F.expr("attempt <=> owner"))
    first = results.where("owned").groupBy("run_id", "stage").agg(F.min("seq").alias("first_seq"))
    verdict = F.expr("case when not owned then 'lost_ownership' when seq = first_seq then 'accepted' else 'already_published' end")
    return results.join(first, ["run_id", "stage"], "left").withColumn("verdict", verdict).drop("first_seq", "kind")


def contract_errors(rows: DataFrame) -> DataFrame:
    """A terminal status requires a reason code and only it may carry one; failed or cancelled stages have no outputs."""
    reason = F.expr(
        "case when status in ('failed', 'blocked', 'cancelled') and coalesce(reason_code, '') = '' then 'REASON_MISSING'"
        " when status not in ('failed', 'blocked', 'cancelled') and coalesce(reason_code, '') <> '' then 'REASON_UNEXPECTED'"
        " when status in ('failed', 'cancelled') and output_count > 0 then 'OUTPUTS_UNEXPECTED' end"
    )
    return rows.withColumn("reason", reason).where("reason is not null")


def budget_violations(rows: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Attempts over a limit; ``limits`` maps measure columns to maxima. Failed and cancelled attempts are not judged."""
    broken = F.array_compact(F.array(*[F.when(F.col(c) > limit, c) for c, limit in limits.items()]))
    return rows.where("status not in ('failed', 'cancelled')").withColumn("violation", F.explode(broken))


def output_budget(files: DataFrame, bucket: Column, max_files: int, max_bytes: int) -> DataFrame:
    """Per attempt: files accepted before the file or byte budget is first exceeded, in write order."""
    counted = hotkeys.row_number(files, ["attempt_id"], bucket, ["position"], "nth")
    summed = hotkeys.running(counted, ["attempt_id"], bucket, ["position"], "running_bytes", F.col("byte_length"), "sum")
    over = F.expr(f"nth > {max_files} or running_bytes > {max_bytes}")
    return summed.groupBy("attempt_id").agg(
        F.count("*").alias("files"), F.min(F.when(over, F.col("position"))).alias("stopped_at"),
        F.count_if(~over).alias("within_budget"))


def phase_states(phases: DataFrame, bucket: Column) -> DataFrame:
    """Final phase states: everything after the first terminal phase is unavailable, and so is pending or running."""
    ended = hotkeys.running(phases, ["run_id"], bucket, ["position"], "ended", F.col("state").isin(*TERMINAL), "max", exclusive=True)
    state = F.expr("case when coalesce(ended, false) or state in ('pending', 'running') then 'unavailable' else state end")
    return ended.withColumn("final_state", state).drop("ended")


def input_chain_breaks(stages: DataFrame, bucket: Column) -> DataFrame:
    """Stages whose inputs (arrays of digest and length) are not exactly the previous stage's outputs."""
    previous = hotkeys.lag(stages, ["run_id"], bucket, ["position"], {"previous_outputs": "outputs"})
    broken = F.expr("previous_outputs is not null and (size(array_except(inputs, previous_outputs)) > 0 or size(array_except(previous_outputs, inputs)) > 0)")
    return previous.where(broken)


def single_result(stages: DataFrame, expected_role: str) -> DataFrame:
    """Runs whose last stage does not publish exactly one output of the expected role."""
    last = stages.groupBy("run_id").agg(F.max_by("output_roles", "position").alias("roles"))
    matches = F.size(F.filter("roles", lambda r: r == expected_role))
    return last.select("run_id", matches.alias("matches")).withColumn("single", F.col("matches") == 1)


def descriptor_lookup(reports: DataFrame, lookups: DataFrame, sections: list[str]) -> DataFrame:
    """Resolve artifact ids over the nested report sections (arrays of structs with ``id``); exactly one match is found.

    Sections are concatenated and exploded per report, ids are counted before the join.
    """
    flat = reports.select("report_id", F.explode(F.concat(*[F.coalesce(F.col(s), F.array().cast(reports.schema[s].dataType)) for s in sections])).alias("d"))
    counted = flat.groupBy("report_id", F.col("d.id").alias("artifact_id")).agg(F.count("*").alias("n"))
    status = F.expr("case when n is null then 'unknown' when n > 1 then 'ambiguous' else 'found' end")
    return lookups.join(counted, ["report_id", "artifact_id"], "left").withColumn("status", status)


def discover_runs(model_runs: DataFrame, baseline_runs: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row per run, newest first (ids descend as text): an unfinished job outranks disk, a model result outranks a baseline report.

    Precedence is an integer, so the choice is a combinable aggregate instead of a row number per run.
    """
    ranked = (
        jobs.where("state <> 'completed'").select("run_id", F.lit(0).alias("precedence"), "state")
        .unionByName(model_runs.select("run_id", F.lit(1).alias("precedence"), "state"))
        .unionByName(baseline_runs.select("run_id", F.lit(2).alias("precedence"), "state"))
    )
    best = ranked.groupBy("run_id").agg(F.min(F.struct("precedence", "state")).alias("b"))
    origin = F.element_at(F.array(F.lit("job"), F.lit("model"), F.lit("baseline")), F.col("b.precedence") + 1)
    return best.select("run_id", origin.alias("origin"), F.col("b.state").alias("state")).orderBy(F.col("run_id").cast("string").desc())
