"""Paired experiments: blinding, ballots, outcomes and exact statistics."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import digests

EXACT_BIGINT_TRIALS = 60


def blind_mapping(assets: DataFrame, domain: str) -> DataFrame:
    """Left and right arm of each ``(asset_id, seed)`` from the low bit of the first hash byte."""
    nul = F.unhex(F.lit("00"))
    digest = F.sha2(F.concat(F.encode(F.lit(domain), "utf-8"), nul, digests.u64_bytes(F.col("seed")), nul, F.encode("asset_id", "utf-8")), 256)
    even = digests.low_bit_of_first_byte(digest) == 0
    return assets.withColumn("left_arm", F.when(even, "candidate").otherwise("comparator")).withColumn(
        "right_arm", F.when(even, "comparator").otherwise("candidate"))


def adjudicate(ballots: DataFrame) -> DataFrame:
    """Majority of two or three ballots per asset; a disagreement of two needs a third, three different votes tie.

    The first three ballots are pivoted by position with combinable aggregates; more than three are invalid.
    """
    vote = lambda i: F.max(F.when(F.col("seq") == i, F.col("vote"))).alias(f"v{i}")
    wide = ballots.groupBy("asset_id").agg(
        F.count("*").alias("ballots"), F.count_if(~F.col("vote").isin("left", "right", "tie")).alias("bad"), vote(0), vote(1), vote(2))
    outcome = F.expr(
        "case when ballots not in (2, 3) or bad > 0 or v0 is null or v1 is null then 'invalid' when v0 = v1 then v0"
        " when v2 is null then 'third_required' when v2 = v0 or v2 = v1 then v2 else 'tie' end"
    )
    return wide.select("asset_id", "ballots", outcome.alias("outcome"))


def reveal(mapping: DataFrame, outcomes: DataFrame) -> DataFrame:
    arm = F.expr("case outcome when 'left' then left_arm when 'right' then right_arm end")
    revealed = F.expr("case when outcome = 'tie' then 'tie' when arm = 'candidate' then 'candidate_win' when arm = 'comparator' then 'comparator_win' end")
    return mapping.join(outcomes, "asset_id").withColumn("arm", arm).withColumn("revealed", revealed).drop("arm")


def classify_pairs(pairs: DataFrame) -> DataFrame:
    """Comparator failure is invalid, candidate failure loses, a missing review ties, otherwise the reviewed outcome."""
    comparator_failed, candidate_failed = "comparator_status <> 'succeeded'", "candidate_status <> 'succeeded'"
    outcome = F.expr(f"case when {comparator_failed} then 'invalid' when {candidate_failed} then 'comparator_win' when review_outcome is null then 'tie' else review_outcome end")
    reason = F.expr(f"case when {comparator_failed} then 'comparator_infrastructure_failure' when {candidate_failed} then 'candidate_failure'"
                    " when review_outcome is null then 'missing_review_evidence' else 'reviewed' end")
    usable = F.expr(f"not ({comparator_failed}) and not ({candidate_failed}) and candidate_usable")
    return pairs.select("*", outcome.alias("outcome"), usable.alias("usable"), reason.alias("reason"))


IDENTITY = ("source_sha256", "sequence_sha256", "contract_id", "profile_id", "width", "height", "frame_ids")


def arm_parity(candidate: DataFrame, comparator: DataFrame) -> DataFrame:
    """Identity fields that differ between the two arms of each asset; ``frame_ids`` is compared as an ordered list."""
    l = candidate.select("asset_id", *[F.col(c).alias(f"l_{c}") for c in IDENTITY])
    r = comparator.select("asset_id", *[F.col(c).alias(f"r_{c}") for c in IDENTITY])
    differing = F.array_compact(F.array(*[F.when(~F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}")), c) for c in IDENTITY]))
    return l.join(r, "asset_id", "full").select("asset_id", differing.alias("differing"), (F.size(differing) == 0).alias("parity"))


def tail_count(wins: str, losses: str) -> str:
    """Number of outcomes with at least ``wins`` successes, exact in BIGINT for up to 60 trials (SQL text)."""
    n = f"({wins} + {losses})"
    return (f"aggregate(sequence(0, cast({n} as int)), named_struct('c', 1L, 's', 0L),"
            f" (acc, k) -> named_struct('c', if(k < {n}, (acc.c * ({n} - k)) div (k + 1), 0L), 's', acc.s + if(k >= {wins}, acc.c, 0L)),"
            f" acc -> acc.s)")


def _big_tail():
    """Vectorised big-integer tail; self-contained so that executors need not import this package."""

    @F.pandas_udf("struct<numerator: string, denominator: string, p: double>")
    def tail(wins: pd.Series, losses: pd.Series) -> pd.DataFrame:
        import math

        known: dict[tuple[int, int], tuple[str, str, float]] = {}
        for w, l in zip(wins, losses):
            if (w, l) not in known:
                n = int(w) + int(l)
                count, total = sum(math.comb(n, k) for k in range(int(w), n + 1)), 2**n
                shared = math.gcd(count, total)
                known[w, l] = (str(count // shared), str(total // shared), count / total)
        return pd.DataFrame([known[pair] for pair in zip(wins, losses)], columns=["numerator", "denominator", "p"])

    return tail


def binomial_upper_tail(pairs: DataFrame) -> DataFrame:
    """Exact one-sided tail of ``(wins, losses)`` as a reduced fraction and a double; pairs without trials carry a ``problem``.

    Up to 60 trials stay in generated code; larger ones go through one Arrow batch of big-integer arithmetic.
    """
    none = pairs.where("not coalesce(wins + losses > 0, false)").selectExpr(
        *pairs.columns, "cast(null as string) as numerator", "cast(null as string) as denominator", "cast(null as double) as p", "'NO_TRIALS' as problem")
    small = pairs.where(f"wins + losses between 1 and {EXACT_BIGINT_TRIALS}")
    large = pairs.where(f"wins + losses > {EXACT_BIGINT_TRIALS}")
    counted = small.withColumn("count", F.expr(tail_count("wins", "losses"))).withColumn("total", F.expr("shiftleft(1L, cast(wins + losses as int))"))
    # gcd with a power of two: the lowest set bit of the count, at most the total
    exact = counted.withColumn("shared", F.expr("least(total, count & (-count))")).select(
        *pairs.columns, F.expr("cast(count div shared as string)").alias("numerator"),
        F.expr("cast(total div shared as string)").alias("denominator"), F.expr("count / total").alias("p"), F.lit(None).cast("string").alias("problem"))
    big = large.withColumn("t", _big_tail()("wins", "losses")).select(*pairs.columns, "t.numerator", "t.denominator", "t.p", F.lit(None).cast("string").alias("problem"))
    return exact.unionByName(big).unionByName(none)


def _interval(alpha: float):
    """Vectorised exact interval: bisection on the regularised incomplete beta function, by its continued fraction in logs."""

    @F.pandas_udf("struct<lower: double, upper: double>")
    def solve(wins: pd.Series, losses: pd.Series) -> pd.DataFrame:
        import math

        import numpy as np

        def fraction(a, b, x):
            tiny = 1e-300
            guard = lambda v: np.where(np.abs(v) < tiny, tiny, v)
            c, d = np.ones_like(x), 1 / guard(1 - (a + b) * x / (a + 1))
            value, m, moving = d.copy(), 0, True
            while moving and m < 100_000:
                m += 1
                for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                    d, c = 1 / guard(1 + step * d), guard(1 + step / c)
                    value = value * (d * c)
                moving = bool((np.abs(d * c - 1) > 1e-15).any())
            return value

        def beta_part(a, b, x):
            swap = x > (a + 1) / (a + b + 2)
            p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
            gamma = np.vectorize(math.lgamma)
            front = np.exp(gamma(p + q) - gamma(p) - gamma(q) + p * np.log(y) + q * np.log1p(-y)) / p
            part = front * fraction(p, q, y)
            return np.where(swap, 1 - part, part)

        def root(a, b, goal):
            low, high = np.zeros_like(a), np.ones_like(a)
            for _ in range(60):
                middle = (low + high) / 2
                under = beta_part(a, b, middle) < goal
                low, high = np.where(under, middle, low), np.where(under, high, middle)
            return (low + high) / 2

        w, l = wins.to_numpy(float), losses.to_numpy(float)
        lower = np.where(w == 0, 0.0, root(np.maximum(w, 1), l + 1, alpha / 2)) if len(w) else w
        upper = np.where(l == 0, 1.0, root(w + 1, np.maximum(l, 1), 1 - alpha / 2)) if len(w) else w
        return pd.DataFrame({"lower": lower, "upper": upper})

    return solve


def clopper_pearson(pairs: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Exact interval of the win rate, evaluated once per distinct ``(wins, losses)``; pairs without trials carry a ``problem``."""
    unique = pairs.select("wins", "losses").where("wins + losses > 0").distinct()
    solved = unique.withColumn("i", _interval(alpha)("wins", "losses")).select("wins", "losses", "i.lower", "i.upper")
    problem = F.when(~F.coalesce(F.expr("wins + losses > 0"), F.lit(False)), "NO_TRIALS")
    return pairs.join(solved, ["wins", "losses"], "left").withColumn("problem", problem)


def evaluate_experiments(outcomes: DataFrame, expected_assets: int = 20, margin: int = 4, usable_minimum: int = 12) -> DataFrame:
    """Per experiment: denominators, wins, losses, ties, exact p, and the pair rule."""
    count = lambda o: F.count_if(F.col("outcome") == o)
    # one row per (experiment, asset) first, so that distinct assets are counted with map-side combine
    per_asset = outcomes.groupBy("experiment_id", "asset_id").agg(
        F.count("*").alias("rows"), count("invalid").alias("invalid"), count("candidate_win").alias("wins"),
        count("comparator_win").alias("losses"), count("tie").alias("ties"), F.count_if("usable").alias("usable"))
    totals = per_asset.groupBy("experiment_id").agg(
        F.count("*").alias("assets"), *[F.sum(c).alias(c) for c in ("rows", "invalid", "wins", "losses", "ties", "usable")])
    problem = F.expr(
        f"case when rows <> {expected_assets} or assets <> {expected_assets} then 'DENOMINATOR_INVALID' when invalid > 0 then 'INVALID_PAIR'"
        f" when wins + losses + ties <> {expected_assets} then 'UNCOVERED_DENOMINATOR' end"
    )
    valid = totals.withColumn("problem", problem)
    tails = binomial_upper_tail(valid.where("problem is null and wins + losses > 0").select("wins", "losses").distinct()).select("wins", "losses", F.col("p").alias("tail"))
    exact = F.expr("case when problem is not null then null when wins + losses = 0 then 1.0D else tail end")
    out = valid.join(tails, ["wins", "losses"], "left").withColumn("p", exact).drop("tail")
    superiority = F.expr(f"problem is null and wins - losses >= {margin} and p < 0.05D")
    return out.withColumn("superiority", superiority).withColumn("usable_pass", F.expr(f"problem is null and usable >= {usable_minimum}")).withColumn(
        "passes", F.expr("superiority and usable_pass"))


def acceptance_summary(runs: DataFrame) -> DataFrame:
    """Conjunction of parity, statistics and structure; the real gate is never evaluated here."""
    merged = runs.groupBy("run_id").agg(*[F.min(c).alias(c) for c in ("parity", "statistics", "structure")])
    passed = F.expr("parity and statistics and structure")
    return merged.withColumn("local_status", F.when(passed, "LOCAL_TECHNICAL_PREFLIGHT_PASS").otherwise("LOCAL_TECHNICAL_PREFLIGHT_FAIL")).withColumn(
        "ready_for_scoring", F.lit(False)).withColumn("gate_status", F.lit("NOT_EVALUATED"))
