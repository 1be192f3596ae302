"""Samples that depend on a seed and the key alone, in any order of rows and on any number of tasks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def seeded(key: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def random_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement."""
    return df.withColumn("draw", seeded(F.col(key), seed)).orderBy("draw", key).limit(n)


def random_share(df: DataFrame, key: str, size: Callable[[Column], Column], seed: int = 42) -> DataFrame:
    """``size`` of the number of rows without replacement, where it may grow with them.

    The draws are counted by their first digits; a row is ranked within its digits only, so that no task orders all rows.
    """
    drawn = df.withColumn("draw", seeded(F.col(key), seed)).withColumn("digits", F.left("draw", F.lit(3)))
    order = Window.orderBy("digits").rowsBetween(Window.unboundedPreceding, -1)
    counts = drawn.groupBy("digits").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("digits", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"), size(F.sum("n").over(Window.partitionBy())).alias("size"))
    ranked = drawn.join(F.broadcast(before.where("before < size")), "digits")
    rank = F.col("before") + F.row_number().over(Window.partitionBy("digits").orderBy("draw", key))
    return ranked.withColumn("rank", rank).where("rank <= size").drop("digits", "before", "size", "rank")


def review_size(n: Column, share: float = 0.3, least: int = 15) -> Column:
    return F.least(F.greatest(F.lit(least), F.floor(n * share + 0.999)), n)


def stratified_sample(df: DataFrame, stratum: str, key: str, per_stratum: int = 10, seed: int = 42) -> DataFrame:
    """At most ``per_stratum`` rows of each stratum; small strata whole."""
    order = Window.partitionBy(stratum).orderBy(seeded(F.col(key), seed), key)
    return df.withColumn("draw", F.row_number().over(order)).where(F.col("draw") <= per_stratum)


def balanced_quota(df: DataFrame, kind: str, key: str, target: int, kinds: list[str], seed: int = 42) -> DataFrame:
    """An equal share of the target of each kind; the remainder goes to the first kinds in order.

    What a kind lacks is filled up with rows of the other kinds in the order of their draws.
    """
    quota = F.lit(target // len(kinds)) + F.coalesce(*(F.when(F.col(kind) == k, F.lit(int(i < target % len(kinds)))) for i, k in enumerate(kinds)))
    order = Window.partitionBy(kind).orderBy(seeded(F.col(key), seed), key)
    # the constant lets Spark drop rows before they are shuffled and sorted; at most target rows of each kind are left
    drawn = df.where(F.col(kind).isin(kinds)).withColumn("draw", F.row_number().over(order)).where(F.col("draw") <= target)
    marked = drawn.withColumn("within", F.col("draw") <= quota)
    n_within = F.count_if("within").over(Window.partitionBy())
    ranked = marked.withColumn("n_within", n_within).withColumn("at", F.row_number().over(Window.partitionBy("within").orderBy("draw", seeded(F.col(key), seed), key)))
    return ranked.where(F.col("within") | (F.col("at") <= target - F.col("n_within"))).drop("within", "n_within", "at")
