"""Tails, exact branches, ranks and intervals against known values and brute force."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pruefwerk.functions import tails
from pruefwerk.operators import bootstrap, sampling
from pruefwerk.operators import statistics as S


def test_tails():
    assert tails.normal_sf(1.959963984540054) == pytest.approx(0.025, abs=1e-9)
    assert tails.student_sf(2.228, 10) == pytest.approx(0.025, abs=2e-4)
    assert tails.chi2_sf(5.991, 2) == pytest.approx(0.05, abs=1e-4) and tails.chi2_sf(3.841, 1) == pytest.approx(0.05, abs=1e-4)


def test_exact_distributions_by_enumeration():
    for n in (1, 4, 7):
        sums = [sum(r for r, s in zip(range(1, n + 1), signs) if s) for signs in itertools.product((0, 1), repeat=n)]
        for w in range(n * (n + 1) // 2 + 1):
            assert tails.signed_rank_exact_sf(w, n) == pytest.approx(sum(s >= w for s in sums) / len(sums))
    for n1, n2 in ((1, 1), (2, 3), (4, 3), (5, 4)):
        us = [sum(first) - n1 * (n1 + 1) / 2 for first in itertools.combinations(range(1, n1 + n2 + 1), n1)]
        for u in range(n1 * n2 + 1):
            assert tails.rank_sum_exact_sf(u, n1, n2) == pytest.approx(sum(x >= u for x in us) / len(us))


def test_shapiro_by_published_examples():
    # weights of eleven men (Shapiro and Wilk 1965): W = 0.79, p under 0.01
    w, p = tails.shapiro_w(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236.0]), np.ones(11, int))
    assert w == pytest.approx(0.79, abs=0.005) and p < 0.01
    # in equal steps of quantiles the order statistics are nearly those of a normal sample
    even = np.array([tails.normal_quantile((i + 0.5) / 60) for i in range(60)])
    w, p = tails.shapiro_w(even, np.ones(60, int))
    assert w > 0.99 and p > 0.9
    repeated = tails.shapiro_w(np.array([0.0, 0.5, 1.0]), np.array([40, 5, 55]))
    assert repeated[0] < 0.75 and repeated[1] < 1e-6
    assert tails.shapiro_w(np.array([1.0, 2.0]), np.array([1, 1])) == (None, None) and tails.shapiro_w(np.array([1.0]), np.array([9])) == (None, None)


def test_p_values_are_exact_where_samples_are_small(spark):
    wide = spark.createDataFrame([(float(i), float(i) - d) for i, d in enumerate([0.5, 1.5, -0.25, 2.5, 3.5])], "x double, y double")
    row = S.wilcoxon_p(wide, "x", "y").first()
    assert row.w_plus == 14 and row.p == pytest.approx(2 / 32)
    scores = spark.createDataFrame([(0.9, True), (0.8, True), (0.1, False), (0.2, False), (0.85, False)], "score double, first boolean")
    row = S.mann_whitney_p(scores, F.col("first")).first()
    assert row.u == 5 and row.p == pytest.approx(2 / 10)
    tied = wide.unionByName(wide)
    assert S.wilcoxon_p(tied, "x", "y").first().p == pytest.approx(tails.normal_sf(S.wilcoxon(tied, "x", "y").first().z))
    assert S.wilcoxon_p(wide.limit(0), "x", "y", "x").count() == 0


def test_ranks_by_ranges_are_those_of_all_values(spark):
    rnd = random.Random(1)
    values = [(rnd.choice("ab"), rnd.choice([0.5, rnd.random(), round(rnd.random(), 1)])) for _ in range(4000)] + [(None, 0.5), ("a", None)]
    df = spark.createDataFrame(values, "g string, value double")
    for groups in ((), ("g",)):
        rows = S.value_ranks(df, *groups).collect()
        for g in {None, "a", "b"} if groups else {0}:
            own = sorted(v for k, v in values if v is not None and (not groups or k == g))
            got = {r.value: (r.t, r.rank) for r in rows if not groups or r.g == g}
            assert got == {v: (own.count(v), own.index(v) + (own.count(v) + 1) / 2) for v in set(own)}


def test_bootstrap_of_differences_and_correlations(spark):
    rnd = random.Random(2)
    rows = [(round(rnd.random(), 2),) for _ in range(500)]
    wide = spark.createDataFrame([(x, round(x - rnd.gauss(0.1, 0.2), 2), "t") for (x,) in rows] + [(None, 0.5, "t")], "x double, y double, test string")
    row = bootstrap.bootstrap_paired_difference(wide, {"d": ("x", "y")}).first()
    differences = np.array([r.x - r.y for r in wide.dropna().collect()])
    half = 1.96 * differences.std(ddof=1) / math.sqrt(500)
    assert row.n == 500 and row.mean == pytest.approx(differences.mean())
    assert row.low == pytest.approx(row.mean - half, abs=0.2 * half) and row.high == pytest.approx(row.mean + half, abs=0.2 * half)
    corr = bootstrap.bootstrap_spearman(wide, "test", "x", "y", 400).first()
    rho = S.spearman(wide, "x", "y").first()
    assert corr.n == 500 and corr.low < rho.rho < corr.high
    assert corr.low == pytest.approx(rho.rho_low, abs=0.03) and corr.high == pytest.approx(rho.rho_high, abs=0.03)
    constant = spark.createDataFrame([(1.0, 2.0, "t")] * 5, "x double, y double, test string")
    assert bootstrap.bootstrap_spearman(constant, "test", "x", "y", 50).count() == 0
    assert bootstrap.bootstrap_mean(wide.limit(0), "test", "x").count() == 0


def test_quota_is_filled_up_from_other_kinds(spark):
    df = spark.createDataFrame([(i, "a") for i in range(4)] + [(100 + i, "b") for i in range(50)] + [(200 + i, "c") for i in range(50)], "id bigint, kind string")
    counts = {r.kind: r["count"] for r in sampling.balanced_quota(df, "kind", "id", 30, ["a", "b", "c"]).groupBy("kind").count().collect()}
    assert counts["a"] == 4 and sum(counts.values()) == 30 and min(counts["b"], counts["c"]) >= 10
    assert sampling.balanced_quota(df.where("kind = 'a'"), "kind", "id", 30, ["a", "b", "c"]).count() == 4
