"""Chunks of texts, the pages they come from, and windows of chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from ..functions.text import normalize_whitespace, page_marker

TARGET_SIZE, OVERLAP = 1200, 150
WINDOW_SIZE, WINDOW_STRIDE = 7, 3
#: Chunks of a script that are looked at together for their page.
PAGE_BLOCK = 1000


class _Packer:
    """Packs pieces into buffers of about ``target`` characters; a buffer that is full leaves its tail to the next."""

    def __init__(self, target: int, overlap: int):
        self.target, self.overlap, self.buffer, self.chunks = target, overlap, "", []

    def add(self, piece: str) -> None:
        if len(self.buffer) + len(piece) > self.target:
            self.emit()
            self.buffer = self.buffer[-self.overlap :] if self.overlap else ""
        self.buffer += "\n\n" + piece

    def emit(self) -> None:
        if self.buffer.strip():
            self.chunks.append(self.buffer.strip())

    def flush(self) -> None:
        self.emit()
        self.buffer = ""


def semantic_pieces(text: str, target: int = TARGET_SIZE, overlap: int = OVERLAP) -> list[str]:
    """Chunks along headings; sections of more than twice the target along paragraphs, apart from their neighbours."""
    packer = _Packer(target, overlap)
    for section in filter(None, map(str.strip, re.split(r"(?=\n#{1,3} )", text))):
        if len(section) <= 2 * target:
            packer.add(section)
            continue
        packer.flush()
        for paragraph in re.split(r"\n\n+", section):
            if paragraph.strip():
                packer.add(paragraph)
        packer.flush()
    packer.flush()
    return packer.chunks


def _semantic(text: Column, target: int, overlap: int) -> Column:
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def pieces(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([semantic_pieces(t, target, overlap) if t else [] for t in texts], dtype=object)

    return pieces(text)


def _raw(text: Column, target: int) -> Column:
    """Greedy packing of paragraphs as a fold over their array."""
    paragraphs = F.filter(F.split(text, r"\n\n+"), lambda p: F.trim(F.translate(p, "\n\t\r", "   ")) != "")
    nothing = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"))

    def step(state: Column, p: Column) -> Column:
        fits = F.length(state["cur"]) + F.length(p) <= target
        out = F.when(fits | (state["cur"] == ""), state["out"]).otherwise(F.concat(state["out"], F.array(state["cur"])))
        return F.struct(out.alias("out"), F.concat(F.when(fits, state["cur"]).otherwise(F.lit("")), p, F.lit("\n\n")).alias("cur"))

    packed = F.aggregate(paragraphs, nothing, step, lambda s: F.when(s["cur"] == "", s["out"]).otherwise(F.concat(s["out"], F.array(s["cur"]))))
    return F.transform(packed, lambda c: F.regexp_replace(F.regexp_replace(c, r"^[ \t\n\x0B\f\r]+", ""), r"[ \t\n\x0B\f\r]+$", ""))


def chunks_of(df: DataFrame, key: str, text: str, mode: str, target: int = TARGET_SIZE, overlap: int = OVERLAP) -> DataFrame:
    """``key, mode, chunk_index, chunk_id, content`` of every text, by the ``raw`` or ``semantic`` way."""
    pieces = _semantic(F.col(text), target, overlap) if mode == "semantic" else _raw(F.col(text), target)
    each = df.where(F.col(text).isNotNull()).select(key, F.posexplode(pieces).alias("chunk_index", "content"))
    return each.select(key, F.lit(mode).alias("mode"), "chunk_index", F.concat(F.lit("chunk_"), "chunk_index").alias("chunk_id"), "content")


def page_map(chunks: DataFrame) -> DataFrame:
    """``script_id, chunk_index, page_number``: the page of the last marker before or in each chunk.

    The last marker of each block of chunks is carried over the blocks of a script, and looked for within a block only,
    so that a long script is spread over many tasks.
    """
    marked = chunks.select("script_id", "chunk_index", page_marker(F.col("content")).alias("own"), F.floor(F.col("chunk_index") / PAGE_BLOCK).alias("block"))
    earlier = Window.partitionBy("script_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = marked.groupBy("script_id", "block").agg(F.max_by("own", F.when(F.col("own").isNotNull(), F.col("chunk_index"))).alias("last"))
    carried = ends.select("script_id", "block", F.last("last", ignorenulls=True).over(earlier).alias("carried"))
    before = Window.partitionBy("script_id", "block").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, 0)
    within = marked.withColumn("within", F.last("own", ignorenulls=True).over(before))
    return within.join(carried, ["script_id", "block"]).select("script_id", "chunk_index", F.coalesce("within", "carried").alias("page_number"))


def generation_windows(chunks: DataFrame, size: int = WINDOW_SIZE, stride: int = WINDOW_STRIDE) -> DataFrame:
    """``script_id, start, n_chunks, source_reference, text`` of all complete windows, cut before a new topic.

    A chunk goes to the at most ``size / stride`` windows that hold it, so that windows are built in parallel, however
    many chunks one script has.
    """
    first = F.greatest(F.lit(0), F.ceil((F.col("chunk_index") - size + 1) / stride).cast("int"))
    starts = F.sequence(first, F.floor(F.col("chunk_index") / stride).cast("int"))
    placed = chunks.select("script_id", "chunk_index", "chunk_id", "content", F.explode(F.transform(starts, lambda s: s * stride)).alias("start"))
    block = placed.groupBy("script_id", "start").agg(F.sort_array(F.collect_list(F.struct("chunk_index", "chunk_id", "content"))).alias("block"))
    whole = block.where(F.size("block") == size)
    breaks = F.transform(F.slice("block", 2, size), lambda c: F.coalesce(F.regexp_replace(c["content"], r"^[ \t\n\x0B\f\r]+", ""), F.lit("")).rlike(r"^#{1,2}\s"))
    kept = F.when(F.array_contains(breaks, True), F.array_position(breaks, True)).otherwise(F.lit(size)).cast("int")
    cut = whole.withColumn("n_chunks", kept).where("n_chunks >= 2").withColumn("block", F.slice("block", F.lit(1), F.col("n_chunks")))
    text = F.array_join(F.transform("block", lambda c: F.coalesce(c["content"], F.lit(""))), "\n\n")
    reference = F.concat(F.element_at("block", 1)["chunk_id"], F.lit("_to_"), F.element_at("block", -1)["chunk_id"])
    return cut.select("script_id", "start", "n_chunks", reference.alias("source_reference"), normalize_whitespace(text).alias("text"))
