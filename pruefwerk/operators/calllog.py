"""The log of model calls: roll-ups, the sliding token sum, and admission against a budget."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

WINDOW_SECONDS, TOKEN_LIMIT = 60, 25_000
EPOCH = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"


def calls_once(calls: DataFrame) -> DataFrame:
    """Each call once by its id, its status in one spelling; only the columns that are used later are shuffled."""
    return calls.dropDuplicates(["call_id"]).withColumn("status", F.lower(F.trim("status")))


def usage_rollup(calls: DataFrame) -> DataFrame:
    """Calls, tokens and latency by kind, model and status, with the totals of each level."""
    level = F.grouping_id().cast("int")
    return calls.rollup("kind", "model", "status").agg(
        level.alias("level"), F.count(F.lit(1)).alias("n_calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"),
        F.sum("total_tokens").alias("total_tokens"), F.round(F.sum("latency_s"), 3).alias("sum_latency"), F.percentile("latency_s", 0.95).alias("p95_latency"),
    )


def sliding_tokens(calls: DataFrame) -> DataFrame:
    """``call_id, model, window_tokens``: the tokens of a model in the minute up to a call.

    The minute is cut into buckets: a call is a row of its own bucket and a helper of the next one, so that one busy
    model is spread over as many tasks as it has minutes.
    """
    timed = calls.select("call_id", F.coalesce("model", F.lit("")).alias("model"), F.coalesce("total_tokens", F.lit(0)).cast("bigint").alias("tokens"), F.expr(EPOCH).alias("us"))
    minute = F.floor(F.col("us") / (WINDOW_SECONDS * 1_000_000))
    copies = timed.withColumn("own", minute).select("*", F.explode(F.array(F.col("own"), F.col("own") + 1)).alias("bucket"))
    frame = Window.partitionBy("model", "bucket").orderBy("us").rangeBetween(-(WINDOW_SECONDS * 1_000_000 - 1), 0)
    return copies.withColumn("window_tokens", F.sum("tokens").over(frame)).where("bucket = own").select("call_id", "model", "window_tokens")


def hourly(calls: DataFrame) -> DataFrame:
    """Calls and tokens by kind in windows of an hour."""
    return calls.groupBy(F.window("ts", "1 hour").alias("w"), "kind").agg(
        F.count(F.lit(1)).alias("n_calls"), F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("tokens")
    ).select(F.col("w.start").alias("hour"), "kind", "n_calls", "tokens")


def _spans(timed: DataFrame, limit: int) -> DataFrame:
    """``model, minute, span, next_span``: the minutes of a model's calls, cut where no earlier call matters any more.

    A bound on the backlog: start calls only at full minutes, in order, as many as fit. That is admissible, and the fold is
    never later. A minute that leaves a call over takes more than ``limit`` less the need of that call; the part of the need
    above ``small`` is counted with the call a second time, so that such a minute takes ``limit - small`` at least. If nothing
    is left over at minute m - 2 and m - 2 and m - 1 together fit into ``limit``, the calls of m - 1 start when they come and
    those before have left the window by m: a span begins with m and needs the calls of m - 1 only to fill its window.
    """
    small = limit // 8
    minutes = timed.groupBy("model", "minute").agg(F.sum("need").alias("need"), F.sum(F.col("need") + F.greatest(F.col("need") - small, F.lit(0))).alias("weight"))
    order = Window.partitionBy("model").orderBy("minute")
    until = lambda last: order.rangeBetween(Window.unboundedPreceding, last)
    free = lambda came, minute: F.coalesce(came, F.lit(0)) - minute * (limit - small)
    level = minutes.withColumn("level", free(F.sum("weight").over(until(-1)), F.col("minute")))
    early, least = free(F.sum("weight").over(until(-3)), F.col("minute") - 2), F.min("level").over(until(-2))
    fits = F.coalesce(F.sum("need").over(order.rangeBetween(-2, -1)), F.lit(0)) <= limit
    cut = level.withColumn("cut", fits & (least.isNull() | (early <= least)))
    spans = cut.withColumn("span", F.max(F.when(F.col("cut"), F.col("minute"))).over(until(0)))
    follows = (F.lead("minute").over(order) == F.col("minute") + 1) & F.lead("cut").over(order)
    return spans.select("model", "minute", "span", F.when(follows, F.col("minute") + 1).alias("next_span"))


def admitted(calls: DataFrame, limit: int = TOKEN_LIMIT) -> DataFrame:
    """``call_id, model, day, start_s``: when each call may start if its model's tokens in a minute stay under ``limit``.

    Admission is a fold over a model's calls in time order, read batch by batch; it keeps only what was admitted within the
    last minute. A model is cut into spans that don't depend on each other, each with the minute before it as helpers.
    A call without a time has no start.
    """
    need = F.least(F.coalesce("total_tokens", F.lit(0)).cast("bigint"), F.lit(max(limit - 1, 1)))
    timed = calls.where("ts IS NOT NULL").select(
        F.coalesce("model", F.lit("")).alias("model"), F.to_date("ts").alias("day"), F.expr(EPOCH).alias("us"), "call_id", F.greatest(need, F.lit(0)).alias("need")
    ).withColumn("minute", F.floor(F.col("us") / (WINDOW_SECONDS * 1_000_000)))
    spans = F.array_compact(F.array(F.struct("span", F.lit(False).alias("helper")), F.when(F.col("next_span").isNotNull(), F.struct(F.col("next_span").alias("span"), F.lit(True).alias("helper")))))
    copies = timed.join(_spans(timed, limit), ["model", "minute"]).select("model", "day", "us", "call_id", "need", F.inline(spans))
    ordered = copies.select("*", (F.col("us") / 1e6).alias("at")).repartition("model", "span").sortWithinPartitions("model", "span", "us", "call_id")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, recent, used, clock = None, deque(), 0, 0.0
        for batch in batches:
            starts = []
            for model, span, at, need in zip(batch["model"], batch["span"], batch["at"], batch["need"]):
                if (model, span) != key:
                    key, recent, used, clock = (model, span), deque(), 0, 0.0
                clock = max(clock, at)
                while True:
                    while recent and recent[0][0] <= clock - WINDOW_SECONDS:
                        used -= recent.popleft()[1]
                    if used + need <= limit or not recent:
                        break
                    clock = recent[0][0] + WINDOW_SECONDS
                recent.append((clock, need))
                used += need
                starts.append(clock)
            yield batch.assign(start_s=starts).loc[~batch["helper"], ["call_id", "model", "day", "start_s"]]

    untimed = calls.where("ts IS NULL").select("call_id", F.coalesce("model", F.lit("")).alias("model"), F.to_date("ts").alias("day"), F.lit(None).cast("double").alias("start_s"))
    return ordered.mapInPandas(fold, "call_id bigint, model string, day date, start_s double").unionByName(untimed)
