"""Descriptive statistics, agreement and rank tests over scores.

Ranks come from counts of the distinct values, cut into ranges: no window ever orders all rows or all values. Statistics and z are relational; tail probabilities are in ``functions.tails``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import tails

TIE = 1e-9
SCORES = ("base_corr", "sem_corr", "raw_corr", "sem_faith", "raw_faith")
ALPHA, Z95 = 0.05, 1.959963984540054
RANGES = 64
#: Exact distributions are used up to so many differences, and so many rows of the smaller side of two.
EXACT_SIGNED, EXACT_SIDE, EXACT_PRODUCT = 50, 8, 100_000


def long_scores(wide: DataFrame) -> DataFrame:
    """``question_id, question_type, measure, score`` of the scores that are there."""
    pairs = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).alias("score")) for m in SCORES)))
    return wide.select("question_id", "question_type", pairs.alias("s")).select("question_id", "question_type", "s.*").where("score IS NOT NULL")


def described(scores: DataFrame, *keys: str) -> DataFrame:
    """Number, mean, deviation, quartiles and extremes for each group."""
    q = F.percentile("score", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = scores.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"), F.stddev_samp("score").alias("sd"), F.min("score").alias("low"), F.max("score").alias("high"), q.alias("q"))
    return out.select(*keys, "n", "mean", "sd", "low", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "high")


def value_ranks(values: DataFrame, *groups: str) -> DataFrame:
    """``groups, value, t, rank``: how often each value is there and its mean rank within its group.

    The values are cut into ranges at their approximate quantiles. Ranks are counted within a range and raised by the
    totals of the ranges before it, at most ``RANGES`` rows of each group, so that no task orders all values.
    """
    counts = values.where("value IS NOT NULL").groupBy(*groups, "value").agg(F.count(F.lit(1)).alias("t"))
    edges = counts.agg(F.percentile_approx("value", [i / RANGES for i in range(1, RANGES)], 10_000).alias("edges"))
    ranged = counts.join(F.broadcast(edges), F.lit(True)).withColumn("range", F.size(F.filter("edges", lambda edge: edge < F.col("value")))).drop("edges")
    totals = ranged.groupBy(*groups, "range").agg(F.sum("t").alias("total"))
    until = Window.partitionBy(*groups).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*(F.col(g).alias(f"{g}_") for g in groups), F.col("range").alias("range_"), F.coalesce(F.sum("total").over(until), F.lit(0)).alias("offset"))
    same = F.col("range") == F.col("range_")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"{g}_"))
    own = Window.partitionBy(*groups, "range").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    within = ranged.withColumn("within", F.coalesce(F.sum("t").over(own), F.lit(0)))
    return within.join(offsets, same).select(*groups, "value", "t", (F.col("offset") + F.col("within") + (F.col("t") + 1) / 2).alias("rank"))


def wilcoxon(wide: DataFrame, x: str, y: str, *groups: str) -> DataFrame:
    """Signed ranks of ``x - y`` without zeros: W+, z with tie correction, effect, and how the pairs differ."""
    return _signed_ranks(wide, x, y, *groups).drop("m", "ties")


def wilcoxon_p(wide: DataFrame, x: str, y: str, *groups: str) -> DataFrame:
    """``groups, n, w_plus, z, p``: p that ``x`` is greater; exact for at most 50 differences without zeros and ties."""
    tested = _signed_ranks(wide, x, y, *groups)
    exact = (F.col("m") <= EXACT_SIGNED) & (F.col("ties") == 0) & (F.col("n_ties") == 0)
    p = F.when(exact, tails.signed_rank_of("w_plus", "m")).otherwise(tails.normal_sf_of("z"))
    return tested.select(*groups, "n", "w_plus", "z", p.alias("p"))


def _signed_ranks(wide: DataFrame, x: str, y: str, *groups: str) -> DataFrame:
    d = wide.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*groups, F.round(F.col(x) - F.col(y), 9).alias("d"))
    signs = d.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean_diff"), F.stddev_samp("d").alias("sd_diff"),
        F.count_if(F.col("d") > TIE).alias("n_pos"), F.count_if(F.col("d") < -TIE).alias("n_neg"), F.count_if(F.abs("d") <= TIE).alias("n_ties"),
    )
    moved = d.where(F.abs("d") > TIE).select(*groups, F.abs("d").alias("value"), (F.col("d") > 0).alias("up"))
    ups = moved.groupBy(*groups, "value").agg(F.count_if("up").alias("n_up"))
    ranks = value_ranks(moved, *groups).join(ups, [*groups, "value"])
    sums = ranks.groupBy(*groups).agg(F.sum(F.col("n_up") * F.col("rank")).alias("w_plus"), F.sum("t").alias("m"), F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    m = F.col("m").cast("double")
    z = F.try_divide(F.col("w_plus") - m * (m + 1) / 4, F.sqrt(m * (m + 1) * (2 * m + 1) / 24 - F.col("ties") / 48))
    joined = signs.join(sums, list(groups)) if groups else signs.join(F.broadcast(sums), F.lit(True))
    return joined.select(
        *groups, "n", "n_pos", "n_neg", "n_ties", "mean_diff", F.coalesce(F.try_divide("mean_diff", "sd_diff"), F.lit(0.0)).alias("d_z"),
        "w_plus", z.alias("z"), (z / F.sqrt(m)).alias("rank_biserial"), "m", "ties",
    )


def mann_whitney(scores: DataFrame, group: Column) -> DataFrame:
    """U of the rows where ``group`` holds against the rest, z with tie and continuity correction, effect."""
    return _rank_sums(scores, group).drop("ties")


def mann_whitney_p(scores: DataFrame, group: Column) -> DataFrame:
    """``n1, n2, u, z, p``: p that the rows of ``group`` are greater; exact where one side has at most 8 and no ties."""
    tested = _rank_sums(scores, group)
    exact = (F.least("n1", "n2") <= EXACT_SIDE) & (F.col("n1") * F.col("n2") <= EXACT_PRODUCT) & (F.col("ties") == 0)
    p = F.when(exact, tails.rank_sum_of("u", "n1", "n2")).otherwise(tails.normal_sf_of("z"))
    return tested.select("n1", "n2", "u", "z", p.alias("p"))


def _rank_sums(scores: DataFrame, group: Column) -> DataFrame:
    values = scores.select(F.round("score", 9).alias("value"), group.alias("first"))
    firsts = values.groupBy("value").agg(F.count_if("first").alias("n_first"))
    ranks = value_ranks(values.select("value")).join(firsts, "value")
    sums = ranks.agg(F.sum(F.col("n_first") * F.col("rank")).alias("r1"), F.sum("n_first").alias("n1"), F.sum("t").alias("n"), F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    n1, n = F.col("n1").cast("double"), F.col("n").cast("double")
    n2 = n - n1
    u = F.col("r1") - n1 * (n1 + 1) / 2
    z = F.try_divide(u - n1 * n2 / 2 - 0.5, F.sqrt(n1 * n2 / 12 * (n + 1 - F.col("ties") / (n * (n - 1)))))
    return sums.select("n1", (F.col("n") - F.col("n1")).alias("n2"), u.alias("u"), z.alias("z"), (F.try_divide(2 * u, n1 * n2) - 1).alias("rank_biserial"), "ties")


def friedman(wide: DataFrame, columns: list[str], *groups: str) -> DataFrame:
    """Chi square over three scores of each item, Kendall's W and p, which is exact for two degrees of freedom."""
    complete = wide.dropna(subset=columns)
    values = F.array(*(F.round(c, 9) for c in columns))
    rank = lambda v: F.aggregate(values, F.lit(0.5), lambda a, w: a + F.when(w < v, 1.0).when(w == v, 0.5).otherwise(0.0))
    same = F.transform(values, lambda v: F.size(F.filter(values, lambda w: w == v)))
    ties = F.aggregate(same, F.lit(0).cast("bigint"), lambda a, t: a + t * t - 1)
    ranked = complete.select(*groups, *(rank(F.round(c, 9)).alias(f"r_{i}") for i, c in enumerate(columns)), ties.alias("ties"))
    k = len(columns)
    sums = ranked.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), *(F.sum(f"r_{i}").alias(f"s_{i}") for i in range(k)), F.sum("ties").alias("ties"))
    squares = sum((F.col(f"s_{i}") * F.col(f"s_{i}") for i in range(1, k)), F.col("s_0") * F.col("s_0"))
    n = F.col("n").cast("double")
    chi = F.try_divide(12 / (n * k * (k + 1)) * squares - 3 * n * (k + 1), 1 - F.col("ties") / (n * k * (k * k - 1)))
    return sums.where("n >= 3").select(*groups, "n", chi.alias("chi2"), (chi / (n * (k - 1))).alias("kendall_w"), F.exp(-chi / 2).alias("p"))


def scheirer_ray_hare(scores: DataFrame, a: str, b: str) -> DataFrame:
    """H of both factors and of their interaction on the joint ranks, a row for each effect."""
    values = scores.select(a, b, F.round("score", 9).alias("value"))
    cells = values.groupBy(a, b, "value").agg(F.count(F.lit(1)).alias("c")).join(value_ranks(values.select("value")), "value")
    sums = cells.groupBy(a, b).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("rank")).alias("s"), F.sum(F.col("c") * F.col("rank") * F.col("rank")).alias("q"))
    share = F.sum("s") * F.sum("s") / F.sum("n")
    total = sums.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("cells"))
    of = lambda f: sums.groupBy(f).agg(share.alias("x")).agg(F.sum("x").alias(f"ss_{f}"), F.count(F.lit(1)).alias(f"levels_{f}"))
    joined = total.join(of(a), F.lit(True)).join(of(b), F.lit(True))
    mean = F.col("s") * F.col("s") / F.col("n")
    ms = (F.col("q") - mean) / (F.col("n") - 1)
    ss_a, ss_b = F.col(f"ss_{a}") - mean, F.col(f"ss_{b}") - mean
    df_a, df_b = F.col(f"levels_{a}") - 1, F.col(f"levels_{b}") - 1
    effects = [(a, ss_a, df_a), (b, ss_b, df_b), ("interaction", F.col("cells") - mean - ss_a - ss_b, df_a * df_b)]
    return joined.select(F.explode(F.array(*(F.struct(F.lit(e).alias("effect"), F.try_divide(ss, ms).alias("h"), df.alias("df")) for e, ss, df in effects))).alias("e")).select("e.*")


def scheirer_ray_hare_p(scores: DataFrame, a: str, b: str) -> DataFrame:
    """The test with p of each effect by the chi square distribution."""
    return scheirer_ray_hare(scores, a, b).withColumn("p", tails.chi2_sf_of("h", "df"))


def spearman(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation of two columns with its Fisher interval, and the mean absolute difference."""
    both = pairs.dropna(subset=[x, y]).select(F.round(x, 9).alias("x"), F.round(y, 9).alias("y"))
    cells = both.groupBy("x", "y").agg(F.count(F.lit(1)).alias("c"))
    rank = lambda c: value_ranks(both.select(F.col(c).alias("value"))).select(F.col("value").alias(c), F.col("rank").alias(f"r{c}"))
    ranked = cells.join(rank("x"), "x").join(rank("y"), "y")
    return _correlated(ranked)


def _correlated(ranked: DataFrame, *groups: str) -> DataFrame:
    """Correlation of the ranks ``rx, ry`` of pairs ``x, y`` that are there ``c`` times."""
    w = lambda e: F.sum(F.col("c") * e)
    m = ranked.groupBy(*groups).agg(F.sum("c").alias("n"), w(F.col("rx")).alias("sx"), w(F.col("ry")).alias("sy"), w(F.col("rx") * F.col("rx")).alias("sxx"), w(F.col("ry") * F.col("ry")).alias("syy"), w(F.col("rx") * F.col("ry")).alias("sxy"), w(F.abs(F.col("x") - F.col("y"))).alias("gap"))
    n = F.col("n").cast("double")
    rho = F.try_divide(n * F.col("sxy") - F.col("sx") * F.col("sy"), F.sqrt((n * F.col("sxx") - F.col("sx") * F.col("sx")) * (n * F.col("syy") - F.col("sy") * F.col("sy"))))
    out = m.select(*groups, "n", rho.alias("rho"), (F.col("gap") / n).alias("mae"))
    half = Z95 / F.sqrt(F.col("n") - 3)
    bound = lambda sign: F.when(F.col("n") > 3, F.when(F.abs("rho") >= 1, F.signum("rho")).otherwise(F.tanh(F.atanh("rho") + sign * half)))
    return out.select(*groups, "n", "rho", bound(-1).alias("rho_low"), bound(1).alias("rho_high"), "mae")


def spearman_by(pairs: DataFrame, x: str, y: str, group: str) -> DataFrame:
    """``spearman`` for each group."""
    both = pairs.dropna(subset=[group, x, y]).select(group, F.round(x, 9).alias("x"), F.round(y, 9).alias("y"))
    rank = lambda c: value_ranks(both.select(group, F.col(c).alias("value")), group).select(group, F.col("value").alias(c), F.col("rank").alias(f"r{c}"))
    ranked = both.groupBy(group, "x", "y").agg(F.count(F.lit(1)).alias("c")).join(rank("x"), [group, "x"]).join(rank("y"), [group, "y"])
    return _correlated(ranked, group)


def spearman_p(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """``spearman`` with the two-sided p of no correlation, by Student's distribution with n - 2 degrees of freedom."""
    t = F.abs("rho") * F.sqrt((F.col("n") - 2) / (1 - F.col("rho") * F.col("rho")))
    p = F.when(F.col("n") > 2, F.when(F.abs("rho") >= 1, 0.0).otherwise(2 * tails.student_sf_of(t, F.col("n") - 2)))
    return spearman(pairs, x, y).withColumn("p", F.least(F.lit(1.0), p))


def shapiro(scores: DataFrame, group: str, alpha: float = ALPHA) -> DataFrame:
    """``group, n, w, p, normal`` by Royston's approximation, over how often each value is there; no W under 3 values.

    A group's different values go to one task; scores are rounded to three digits, so that there are few of them.
    """
    counts = scores.where("score IS NOT NULL").groupBy(F.col(group).cast("string").alias("name"), F.round("score", 3).alias("value")).agg(F.count(F.lit(1)).alias("t"))
    return counts.groupBy("name").applyInPandas(tails.shapiro_rows, "name string, n bigint, w double, p double").select(
        F.col("name").alias(group), "n", "w", "p", F.coalesce(F.col("p") > alpha, F.lit(False)).alias("normal")
    )


def confusion(pairs: DataFrame, *groups: str) -> DataFrame:
    return pairs.where("a IS NOT NULL AND b IS NOT NULL").groupBy(*groups, "a", "b").agg(F.count(F.lit(1)).alias("n"))


def weighted_kappa(pairs: DataFrame, n_categories: int = 5, *groups: str) -> DataFrame:
    """Quadratic kappa of ratings ``a, b`` from 1 to ``n_categories``, mean difference and exact agreement."""
    cells = confusion(pairs.where(F.col("a").between(1, n_categories) & F.col("b").between(1, n_categories)), *groups)
    n = F.col("n").cast("double")
    square = lambda e: F.sum(e * n)
    m = cells.groupBy(*groups).agg(
        F.sum("n").alias("n"), square((F.col("a") - F.col("b")) * (F.col("a") - F.col("b"))).alias("observed"),
        square(F.col("a")).alias("sa"), square(F.col("b")).alias("sb"), square(F.col("a") * F.col("a")).alias("saa"), square(F.col("b") * F.col("b")).alias("sbb"),
        (square(F.abs(F.col("a") - F.col("b"))) / F.sum(n)).alias("mean_diff"), (100.0 * square((F.col("a") == F.col("b")).cast("double")) / F.sum(n)).alias("pct_equal"),
    )
    expected = F.col("saa") + F.col("sbb") - 2 * F.col("sa") * F.col("sb") / F.col("n")
    kappa = F.when(expected != 0, 1 - F.col("observed") / expected).when(F.col("observed") == 0, 1.0)
    return m.select(*groups, "n", kappa.alias("kappa"), "mean_diff", "pct_equal")


def nominal_kappa(pairs: DataFrame, *groups: str) -> DataFrame:
    """Unweighted kappa of labels ``a, b``."""
    cells = confusion(pairs, *groups)
    total = cells.groupBy(*groups).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("equal"))
    side = lambda c: cells.groupBy(*groups, F.col(c).alias("label")).agg(F.sum("n").alias(f"n_{c}"))
    by_chance = side("a").join(side("b"), [*groups, "label"]).groupBy(*groups).agg(F.sum(F.col("n_a").cast("double") * F.col("n_b")).alias("chance"))
    joined = total.join(by_chance, list(groups), "left") if groups else total.join(F.broadcast(by_chance), F.lit(True), "left")
    po, pe = F.col("equal") / F.col("n"), F.coalesce("chance", F.lit(0.0)) / (F.col("n").cast("double") * F.col("n"))
    return joined.select(*groups, "n", po.alias("agreement"), F.when(pe < 1, (po - pe) / (1 - pe)).when(po == 1, 1.0).alias("kappa"))


def classification(pairs: DataFrame, *groups: str) -> DataFrame:
    """For each label of either side true positives, precision and recall of ``a`` against ``b``."""
    cells = confusion(pairs, *groups)
    side = lambda c, name: cells.select(*groups, F.col(c).alias("label"), F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0).alias("tp"), *(F.col("n").alias(x) if x == name else F.lit(0).cast("bigint").alias(x) for x in ("n_a", "n_b")))
    both = side("a", "n_a").withColumn("tp", F.col("tp")).unionByName(side("b", "n_b").withColumn("tp", F.lit(0).cast("bigint")))
    out = both.groupBy(*groups, "label").agg(F.sum("tp").alias("tp"), F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"))
    return out.select(*groups, "label", "tp", F.try_divide("tp", F.nullif("n_a", F.lit(0))).alias("precision"), F.try_divide("tp", F.nullif("n_b", F.lit(0))).alias("recall"))


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    """The 95 % interval of a share, null where there is none."""
    p, z2 = k / n, Z95 * Z95
    centre, half = (p + z2 / (2 * n)) / (1 + z2 / n), Z95 * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return F.when(n > 0, F.greatest(F.lit(0.0), centre - half)), F.when(n > 0, F.least(F.lit(1.0), centre + half))


def corrected(p_values: DataFrame) -> DataFrame:
    """``test, p`` with the corrections for several tests; one row for each of the few tests."""
    m = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    up = Window.partitionBy(F.lit(0)).orderBy("p", "test")
    r = p_values.withColumn("m", m).withColumn("at", F.row_number().over(up))
    holm = F.least(F.lit(1.0), F.max((F.col("m") - F.col("at") + 1) * F.col("p")).over(up.rowsBetween(Window.unboundedPreceding, 0)))
    bh = F.least(F.lit(1.0), F.min(F.col("m") / F.col("at") * F.col("p")).over(up.rowsBetween(0, Window.unboundedFollowing)))
    return r.select("test", "p", F.least(F.lit(1.0), F.col("p") * F.col("m")).alias("bonferroni"), holm.alias("holm"), bh.alias("bh"))
