"""Models behind one interface, called from Arrow batches, and steps that resume.

A remote model implements ``Provider``; the shipped one is deterministic and needs no network.
"""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import append_calls

DIMENSIONS = 64
EMBEDDED_TOGETHER = 100


class Provider(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...

    def complete(self, prompt: str) -> str: ...


class OfflineProvider:
    """Embeds by hashing words and answers with the sentence of the context that shares most words with the question."""

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            vector = [0.0] * DIMENSIONS
            for word in text.lower().split():
                digest = hashlib.blake2b(word.encode(), digest_size=8).digest()
                vector[digest[0] % DIMENSIONS] += 1.0 if digest[1] % 2 else -1.0
            length = sum(x * x for x in vector) ** 0.5
            out.append([x / length for x in vector] if length else vector)
        return out

    def complete(self, prompt: str) -> str:
        context, _, question = prompt.rpartition("\n\n")
        words = lambda s: set(re.findall(r"\w+", s.lower()))
        sentences = re.split(r"(?<=[.!?])\s+", context)
        return max(sentences, key=lambda s: (len(words(question) & words(s)), -len(s)))


def with_retries(call: Callable[[], str], attempts: int = 6, wait: float = 1.0, most: float = 30.0) -> tuple[str | None, str | None, int]:
    """Result, error and number of attempts, with growing pauses between them."""
    error = None
    for attempt in range(1, attempts + 1):
        try:
            return call(), None, attempt
        except Exception as e:  # noqa: BLE001
            error = f"{type(e).__name__}: {e}"
            if attempt < attempts:
                time.sleep(min(wait * 2 ** (attempt - 1), most))
    return None, error, attempts


def completed(df: DataFrame, key: str, prompt: str, make: Callable[[], Provider], attempts: int = 6, wait: float = 1.0) -> DataFrame:
    """``key, result, error, attempts, latency_s``: a row for every row of ``df``, failed ones with their error.

    Equal prompts are answered once. ``make`` builds the provider in the worker.
    """

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = make()
        for batch in batches:
            rows = []
            for text in batch["prompt"]:
                began = time.perf_counter()
                result, error, n = with_retries(lambda t=text: provider.complete(t), attempts, wait)
                rows.append((result, error, n, time.perf_counter() - began))
            yield batch.assign(**dict(zip(("result", "error", "attempts", "latency_s"), zip(*rows)))) if rows else batch.assign(result=[], error=[], attempts=[], latency_s=[])

    hashed = df.where(F.col(prompt).isNotNull()).select(key, F.sha2(prompt, 256).alias("hash"), F.col(prompt).alias("prompt"))
    once = hashed.groupBy("hash").agg(F.first("prompt").alias("prompt"))
    answered = once.mapInPandas(call, "hash string, prompt string, result string, error string, attempts int, latency_s double")
    return hashed.select(key, "hash").join(answered.drop("prompt"), "hash").drop("hash")


def embedded(df: DataFrame, key: str, text: str, make: Callable[[], Provider]) -> DataFrame:
    """``key, embedding, error`` of every text, ``EMBEDDED_TOGETHER`` at a time; null for a null text.

    Where texts can't be embedded, they have the error instead, and the others go on.
    """

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = make()
        for batch in batches:
            for begin in range(0, len(batch), EMBEDDED_TOGETHER):
                part = batch.iloc[begin : begin + EMBEDDED_TOGETHER]
                filled = part[text].notna()
                try:
                    vectors, error = iter(provider.embed(list(part[text][filled]))), None
                    made = [next(vectors) if there else None for there in filled]
                except Exception as e:  # noqa: BLE001
                    made, error = [None] * len(part), f"{type(e).__name__}: {e}"
                yield pd.DataFrame({key: part[key], "embedding": made, "error": error})

    return df.select(key, text).mapInPandas(call, f"{key} {dict(df.dtypes)[key]}, embedding array<float>, error string")


def store_index(made: DataFrame, path: str, quarantine: str) -> None:
    """Write what could be embedded to ``path`` and the rest, with its errors, to ``quarantine``."""
    kept = made.persist()
    kept.where("error IS NULL").drop("error").write.mode("overwrite").parquet(path)
    kept.where("error IS NOT NULL").write.mode("overwrite").parquet(quarantine)
    kept.unpersist()


def resumed(pending: DataFrame, key: str, step: Callable[[DataFrame], DataFrame], path: str, log: str | None = None) -> DataFrame:
    """Run ``step`` over what ``path`` doesn't hold yet, append its rows there, and give all rows.

    Rows that failed (``error``) aren't kept, so that the next run takes them up again.
    """
    spark = pending.sparkSession
    try:
        done = spark.read.parquet(path)
        pending = pending.join(done.select(key), key, "left_anti")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    made, kept = step(pending), None
    if log and "latency_s" in made.columns:
        made = kept = made.persist()
        append_calls(made.select(F.current_timestamp().alias("ts"), "attempts", "latency_s", F.when(F.col("error").isNull(), "ok").otherwise("error").alias("status")), log)
    (made.where("error IS NULL") if "error" in made.columns else made).write.mode("append").parquet(path)
    if kept is not None:
        kept.unpersist()
    return spark.read.parquet(path)
