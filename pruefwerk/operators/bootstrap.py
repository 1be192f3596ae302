"""Percentile intervals by resampling, spread over the cluster.

A bootstrap sample of n rows gives every row a Poisson(1) weight, and n equal rows together a Poisson(n) weight. The
weights are drawn once for each different value of a group, seeded by group and value, for all resamples at a time, so
that values contribute to all resamples where they are counted and only sums are shuffled. In place of draws of indexes,
which need all rows of a group in one order, the number of rows varies by its root from resample to resample; the means
are those of the weighted rows, so that their spread is the same up to terms of 1 / n.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

N_RESAMPLES = 2000


def _limits(samples: DataFrame, keys: list[str], value: Column) -> DataFrame:
    ci = samples.groupBy(*keys).agg(F.percentile(value, F.array(F.lit(0.025), F.lit(0.975))).alias("ci"))
    return ci.select(*keys, F.col("ci")[0].alias("low"), F.col("ci")[1].alias("high"))


def bootstrap_mean(values: DataFrame, group: str, value: str, n_resamples: int = N_RESAMPLES, seed: int = 42) -> DataFrame:
    """``group, n, mean, low, high``: the 95 % interval of the mean of each group; no row for a group without values."""

    def resample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, key, x, n in zip(batch["name"], batch["key"], batch["x"], batch["n"]):
                weights = np.random.default_rng([seed, int(key) & (2**63 - 1)]).poisson(n, n_resamples)
                sums.setdefault(name, np.zeros((2, n_resamples)))[:] += weights, weights * x
        for name, own in sums.items():
            yield pd.DataFrame({"name": name, "resample": np.arange(n_resamples), "w": own[0], "wx": own[1]})

    rows = values.where(F.col(value).isNotNull() & F.col(group).isNotNull()).select(F.col(group).cast("string").alias("name"), F.col(value).cast("double").alias("x"))
    counts = rows.groupBy("name", "x").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.withColumn("key", F.xxhash64("name", "x")).mapInPandas(resample, "name string, resample int, w double, wx double").groupBy("name", "resample").agg(F.sum("w").alias("w"), F.sum("wx").alias("wx"))
    known = counts.groupBy("name").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("x")) / F.sum("n")).alias("mean"))
    out = known.join(_limits(totals.where("w > 0"), ["name"], F.col("wx") / F.col("w")), "name")
    return out.select(F.col("name").alias(group), "n", "mean", "low", "high")


def bootstrap_paired_difference(wide: DataFrame, pairs: dict[str, tuple[str, str]], n_resamples: int = N_RESAMPLES, seed: int = 42) -> DataFrame:
    """``test, n, mean, low, high`` of the mean of ``x - y`` for each named pair of columns; incomplete pairs are left out."""
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("test"), F.round(F.col(x) - F.col(y), 9).alias("difference")) for name, (x, y) in pairs.items())))
    return bootstrap_mean(wide.select(each.alias("d")).select("d.*"), "test", "difference", n_resamples, seed)


def bootstrap_spearman(pairs: DataFrame, test: str, x: str, y: str, n_resamples: int = N_RESAMPLES, seed: int = 42, digits: int = 3) -> DataFrame:
    """``test, n, low, high``: the 95 % interval of the rank correlation of each test; constant resamples are left out.

    Scores count to ``digits`` digits. Each different pair of scores is weighted in all resamples where it is counted;
    ranks are sums of the weights of smaller scores of the same resample.
    """
    cells = pairs.dropna(subset=[test, x, y]).groupBy(F.col(test).alias("test"), F.round(x, digits).alias("x"), F.round(y, digits).alias("y")).agg(F.count(F.lit(1)).alias("n"))

    def resample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, a, b, n, key in zip(batch["test"], batch["x"], batch["y"], batch["n"], batch["key"]):
                weights = np.random.default_rng([seed, int(key) & (2**63 - 1)]).poisson(n, n_resamples)
                drawn = np.flatnonzero(weights)
                yield pd.DataFrame({"test": name, "resample": drawn, "x": a, "y": b, "w": weights[drawn].astype(float)})

    drawn = cells.withColumn("key", F.xxhash64("test", "x", "y")).mapInPandas(resample, "test string, resample int, x double, y double, w double")

    def ranks(c: str) -> DataFrame:
        sums = drawn.groupBy("test", "resample", c).agg(F.sum("w").alias("t"))
        before = Window.partitionBy("test", "resample").orderBy(c).rowsBetween(Window.unboundedPreceding, -1)
        return sums.select("test", "resample", c, (F.coalesce(F.sum("t").over(before), F.lit(0.0)) + (F.col("t") + 1) / 2).alias(f"r{c}"))

    ranked = drawn.join(ranks("x"), ["test", "resample", "x"]).join(ranks("y"), ["test", "resample", "y"])
    total = lambda e: F.sum(F.col("w") * e)
    m = ranked.groupBy("test", "resample").agg(
        F.sum("w").alias("n"), total(F.col("rx")).alias("sx"), total(F.col("ry")).alias("sy"),
        total(F.col("rx") * F.col("rx")).alias("sxx"), total(F.col("ry") * F.col("ry")).alias("syy"), total(F.col("rx") * F.col("ry")).alias("sxy"),
    )
    spread = (F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")) * (F.col("n") * F.col("syy") - F.col("sy") * F.col("sy"))
    rho = m.where(spread > 0).withColumn("rho", (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt(spread))
    known = cells.groupBy("test").agg(F.sum("n").alias("n"))
    return known.join(_limits(rho, ["test"], F.col("rho")), "test").select("test", "n", "low", "high")
