"""Exact statistics and review rules with known values."""

from __future__ import annotations

import math
from fractions import Fraction
from math import comb

from celstack.operators import experiment


def test_exact_tails(spark):
    known = {(5, 0): (1, 32), (4, 0): (1, 16), (10, 3): (378, 8192)}
    cases = [*known, (0, 3), (60, 0), (30, 30), (61, 0), (70, 40), (100, 120)]
    df = spark.createDataFrame([(w, l) for w, l in cases], "wins bigint, losses bigint")
    for r in experiment.binomial_upper_tail(df).collect():
        n = r["wins"] + r["losses"]
        want = Fraction(sum(comb(n, k) for k in range(r["wins"], n + 1)), 2**n)
        assert (int(r["numerator"]), int(r["denominator"])) == (want.numerator, want.denominator)
        assert r["p"] == float(want)
    assert all(Fraction(*v) == Fraction(sum(comb(sum(k), i) for i in range(k[0], sum(k) + 1)), 2 ** sum(k)) for k, v in known.items())


def test_pair_rule(spark):
    def rows(experiment_id, wins, losses, ties, usable):
        outcomes = ["candidate_win"] * wins + ["comparator_win"] * losses + ["tie"] * ties
        return [(experiment_id, f"a{i}", o, i < usable) for i, o in enumerate(outcomes)]

    data = rows(1, 10, 3, 7, 12) + rows(2, 4, 0, 16, 20) + rows(3, 10, 3, 6, 12) + rows(4, 10, 3, 7, 11)
    df = spark.createDataFrame(data, "experiment_id int, asset_id string, outcome string, usable boolean")
    got = {r["experiment_id"]: r for r in experiment.evaluate_experiments(df).collect()}
    assert got[1]["passes"] and got[1]["p"] == 378 / 8192
    assert not got[2]["superiority"] and got[2]["p"] == 1 / 16
    assert got[3]["problem"] == "DENOMINATOR_INVALID" and not got[3]["passes"]
    assert got[4]["superiority"] and not got[4]["usable_pass"]


def test_ballots(spark):
    votes = {"a": ["left", "right", "left"], "b": ["left", "right", "tie"], "c": ["left", "right"], "d": ["tie", "tie"], "e": ["left"]}
    df = spark.createDataFrame([(k, i, v) for k, vs in votes.items() for i, v in enumerate(vs)], "asset_id string, seq int, vote string")
    got = {r["asset_id"]: r["outcome"] for r in experiment.adjudicate(df).collect()}
    assert got == {"a": "left", "b": "tie", "c": "third_required", "d": "tie", "e": "invalid"}


def test_clopper_pearson_edges(spark):
    df = spark.createDataFrame([(0, 5), (5, 0), (10, 3)], "wins bigint, losses bigint")
    got = {(r["wins"], r["losses"]): (r["lower"], r["upper"]) for r in experiment.clopper_pearson(df).collect()}
    assert got[0, 5][0] == 0.0 and abs(got[0, 5][1] - (1 - 0.025 ** (1 / 5))) < 1e-9
    assert got[5, 0][1] == 1.0 and abs(got[5, 0][0] - 0.025 ** (1 / 5)) < 1e-9
    low, high = got[10, 3]
    cdf = lambda k, p: sum(comb(13, i) * p**i * (1 - p) ** (13 - i) for i in range(k + 1))
    assert abs(1 - cdf(9, low) - 0.025) < 1e-9 and abs(cdf(10, high) - 0.025) < 1e-9


def test_clopper_pearson_of_thousands_and_of_none(spark):
    df = spark.createDataFrame([(1500, 1500), (2990, 10), (0, 4000), (0, 0), (30, 30)], "wins bigint, losses bigint")
    got = {(r["wins"], r["losses"]): (r["lower"], r["upper"], r["problem"]) for r in experiment.clopper_pearson(df).collect()}
    assert got[0, 0] == (None, None, "NO_TRIALS")
    for (w, l), (low, high, problem) in got.items():
        if w + l:
            n = w + l
            tail = lambda k0, k1, p: sum(math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)) for k in range(k0, k1 + 1))
            assert problem is None and (w == 0 and low == 0.0 or abs(tail(w, n, low) - 0.025) < 1e-8) and (l == 0 and high == 1.0 or abs(tail(0, w, high) - 0.025) < 1e-8)
    assert abs(got[1500, 1500][0] - 0.482) < 1e-3 and abs(got[1500, 1500][1] - 0.518) < 1e-3


def test_tails_around_the_exact_range_and_without_trials(spark):
    df = spark.createDataFrame([(n - 3, 3) for n in (59, 60, 61, 62)] + [(0, 0)], "wins bigint, losses bigint")
    got = {(r["wins"], r["losses"]): (r["numerator"], r["denominator"], r["problem"]) for r in experiment.binomial_upper_tail(df).collect()}
    for n in (59, 60, 61, 62):
        exact = Fraction(sum(comb(n, k) for k in range(n - 3, n + 1)), 2**n)
        assert got[n - 3, 3] == (str(exact.numerator), str(exact.denominator), None)
    assert got[0, 0] == (None, None, "NO_TRIALS")


def test_experiments_of_many_assets(spark):
    rows = [(1, f"a{k}", "candidate_win" if k < 50 else "comparator_win", True) for k in range(80)]
    df = spark.createDataFrame(rows, "experiment_id bigint, asset_id string, outcome string, usable boolean")
    r = experiment.evaluate_experiments(df, expected_assets=80).collect()[0]
    assert r["problem"] is None and abs(r["p"] - sum(comb(80, k) for k in range(50, 81)) / 2**80) < 1e-12
