"""Problem 7: fill containers of fixed capacity with whole documents.

Method: shortest-pack-first over the length histogram. The lengths are placed longest first, each into the packs that
hold least so far, as counts of packing patterns; the patterns are then joined back to the documents by their rank
among the documents of the same length.

What passes the driver is the histogram and the patterns. Both are bounded by the capacity, not by the number of
documents: a histogram has at most ``capacity`` lengths, and placing one length splits at most one group of packs and
opens at most one.

Defined cases: a document of more tokens than the capacity comes out in the fewest parts, all but the last full;
null, empty and blank-free texts without tokens take no room and are put into container 0; repeated rows are items of
their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..session import cut_lineage
from .tokenizers import DEFAULT_FOLDER, PATTERN, PretokenCounts

#: Items of a common length are ranked in parts of about so many, and meet only the slots of their block of ranks.
RANKED_TOGETHER, RANK_BLOCK = 20_000, 64


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Groups ``(number of packs, [(length, items of it in each pack), ...])`` by shortest-pack-first."""
    room: list[tuple[int, int, int, tuple | None]] = []  # (-room left, age, packs, items as a linked list)
    age = 0
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if room and -room[0][0] >= length:
                free, _, packs, items = heapq.heappop(room)
                if packs > left:  # some packs of the group stay as they are
                    heapq.heappush(room, (free, age, packs - left, items))
                    packs = left
                next_room = -room[0][0] if room else 0
                copies = max(1, min((-free - next_room) // length, left // packs, -free // length))
                heapq.heappush(room, (free + copies * length, age + 1, packs, ((length, copies), items)))
                left -= copies * packs
            else:
                # a pack that was just opened is the shortest, so that the next ones of this length go there too
                each = min(left, capacity // length)
                packs, copies = left // each, each
                heapq.heappush(room, (copies * length - capacity, age, packs, ((length, copies), None)))
                left -= packs * copies
            age += 2
    groups = []
    for _, _, packs, items in sorted(room, key=lambda x: x[:2]):
        counts: dict[int, int] = {}
        while items:
            (length, copies), items = items
            counts[length] = counts.get(length, 0) + copies
        groups.append((packs, sorted(counts.items(), reverse=True)))
    return groups


def slot_table(groups: list[tuple[int, list[tuple[int, int]]]]) -> pd.DataFrame:
    """For each length the ranges of ranks and the containers they go to."""
    taken: dict[int, int] = {}
    rows, first = [], 0
    for packs, items in groups:
        for length, copies in items:
            begin = taken.get(length, 0)
            taken[length] = begin + packs * copies
            rows.append((length, begin, taken[length], first, copies))
        first += packs
    return pd.DataFrame(rows, columns=["size", "from_rank", "to_rank", "first_container", "copies"], dtype="int64")


def token_counts(df: DataFrame, id_column: str, text_column: str, tokenizers: list[str], folder: str = DEFAULT_FOLDER) -> DataFrame:
    """``doc_id`` and one column of token counts for each tokenizer; null and empty texts count 0."""
    texts = df.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        pretokens, memos = regex.compile(PATTERN).findall, [PretokenCounts(name, folder) for name in tokenizers]
        for batch in batches:
            found = [pretokens(text) if text else [] for text in batch.column(1).to_pylist()]
            counts = [pa.array([sum(map(memo.__getitem__, x)) for x in found], pa.int64()) for memo in memos]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts], ["doc_id", *tokenizers])

    schema = ", ".join([f"doc_id {dict(texts.dtypes)['doc_id']}", *(f"`{name}` bigint" for name in tokenizers)])
    return texts.mapInArrow(count, schema)


def ranked_items(items: DataFrame, sizes: DataFrame, together: int = RANKED_TOGETHER) -> DataFrame:
    """``items`` with a ``rank`` from 0 among the items of one kind and size, without one task for a common size.

    ``sizes`` has ``container_kind, size, n``, at most a row for each length up to the capacity.
    """
    buckets = F.ceil(F.col("n") / together)
    salted = items.join(F.broadcast(sizes), ["container_kind", "size"]).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "part_no"), buckets)).drop("n")
    counts = salted.groupBy("container_kind", "size", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("container_kind", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("container_kind", "size", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    own = Window.partitionBy("container_kind", "size", "bucket").orderBy("doc_id", "part_no")
    numbered = salted.withColumn("own_rank", F.row_number().over(own) - 1)
    return numbered.join(offsets, ["container_kind", "size", "bucket"]).withColumn("rank", F.col("own_rank") + F.col("offset"))


def placed_items(ranked: DataFrame, slots: DataFrame, block: int = RANK_BLOCK) -> DataFrame:
    """``ranked`` with the slot of each item. Both are cut into blocks of ranks, so that an item of a common size meets
    the few slots that reach into its block, not all of its size."""
    of = lambda rank: F.floor(rank / block)
    reached = slots.withColumn("block", F.explode(F.sequence(of(F.col("from_rank")), of(F.col("to_rank") - 1))))
    return ranked.withColumn("block", of(F.col("rank"))).join(reached, ["container_kind", "size", "block"]).where("rank >= from_rank and rank < to_rank")


def pack_documents(df: DataFrame, id_column: str, text_column: str, settings: DataFrame, folder: str = DEFAULT_FOLDER, together: int = RANKED_TOGETHER) -> DataFrame:
    """``container_kind, doc_id, part_no, n_parts, part_tokens, container_id`` for every document and kind."""
    spark = df.sparkSession
    kinds = [row.asDict() for row in settings.select("container_kind", "tokenizer", "capacity").distinct().collect()]
    if not kinds:
        return spark.createDataFrame([], "container_kind string, doc_id bigint, part_no int, n_parts int, part_tokens bigint, container_id bigint")
    names = sorted({kind["tokenizer"] for kind in kinds})
    counts = cut_lineage(token_counts(df, id_column, text_column, names, folder))
    per_kind = F.explode(F.array(*[
        F.struct(F.lit(k["container_kind"]).alias("container_kind"), F.lit(int(k["capacity"])).cast("bigint").alias("capacity"), F.col(k["tokenizer"]).alias("tokens"))
        for k in kinds
    ]))
    sized = counts.select("doc_id", per_kind.alias("k")).select("doc_id", "k.*")
    n_parts = F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.col("capacity"))).cast("int")
    parts = sized.withColumn("n_parts", n_parts).select("*", F.explode(F.sequence(F.lit(1), F.col("n_parts"))).alias("part_no"))
    size = F.when(F.col("part_no") < F.col("n_parts"), F.col("capacity")).otherwise(F.col("tokens") - F.col("capacity") * (F.col("n_parts") - 1))
    items = parts.select("container_kind", "doc_id", "part_no", "n_parts", size.alias("size"))

    capacities = {k["container_kind"]: int(k["capacity"]) for k in kinds}
    histograms: dict[str, dict[int, int]] = {kind: {} for kind in capacities}
    counted = items.where("size > 0").groupBy("container_kind", "size").agg(F.count(F.lit(1)).alias("n")).collect()
    for kind, length, n in counted:
        histograms[kind][length] = n
    slots = [slot_table(pack_histogram(histograms[kind], capacities[kind])).assign(container_kind=kind) for kind in capacities]
    slot_rows = spark.createDataFrame(pd.concat(slots), "size bigint, from_rank bigint, to_rank bigint, first_container bigint, copies bigint, container_kind string")

    sizes = spark.createDataFrame(counted, "container_kind string, size bigint, n bigint")
    placed = placed_items(ranked_items(items.where("size > 0"), sizes, together), slot_rows)
    container = F.col("first_container") + F.floor((F.col("rank") - F.col("from_rank")) / F.col("copies"))
    columns = ["container_kind", "doc_id", "part_no", "n_parts", F.col("size").alias("part_tokens")]
    full = placed.select(*columns, container.cast("bigint").alias("container_id"))
    return full.unionByName(items.where("size = 0").select(*columns, F.lit(0).cast("bigint").alias("container_id")))


def packing_report(packed: DataFrame, settings: DataFrame) -> DataFrame:
    """How full the containers of each kind are, against the fewest that the tokens could fill."""
    by_kind = packed.groupBy("container_kind").agg(
        F.max("container_id").alias("last"), F.sum("part_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_parts")
    )
    joined = by_kind.join(settings.select("container_kind", F.col("capacity").cast("bigint").alias("capacity")), "container_kind")
    containers = F.col("last") + 1
    return joined.select(
        "container_kind", "capacity", "n_parts", "tokens",
        containers.alias("n_containers"),
        F.ceil(F.col("tokens") / F.col("capacity")).cast("bigint").alias("fewest_containers"),
        (F.col("tokens") / (containers * F.col("capacity"))).alias("fill"),
    )
