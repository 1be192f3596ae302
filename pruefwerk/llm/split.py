"""Problem 1: cut oversized texts into overlapping pieces at natural boundaries.

Method: recursive bisection. A text longer than the limit is cut at the strongest boundary near its midpoint, and
each half that still exceeds the limit minus the overlap is cut again; then every piece but the first is extended to
the left by the overlap. Pieces without their overlaps therefore join up to the text exactly.

Only texts over the limit reach Python, and only their cut positions come back; the pieces are taken by the JVM.

Defined cases: null texts and texts of at most ``max_chars`` code points give no piece; an empty table gives an empty
result; a text without any boundary is cut at its middle; repeated rows are cut each on their own; columns of the
input other than the two named ones are ignored, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Boundaries from the strongest to the weakest; the cut is at the end of the match.
BOUNDARIES = [re.compile(p) for p in (
    r"\n(?=#{1,6} )",
    r"\n[ \t]*\n\s*",
    r"(?<=[.!?:;|`])[ \t]*\n",
    r"[.!?][\"“”»)\]]*[ \t]+(?=[^\Wa-z_]|[\"„«(])",
    r"\n",
    r"[,;:–—][ \t]+",
    r"\s+",
)]


def boundary_positions(text: str) -> list[list[int]]:
    """For each kind of boundary the cut positions in ascending order."""
    return [[m.end() for m in pattern.finditer(text)] for pattern in BOUNDARIES]


def nearest(positions: list[int], middle: int, low: int, high: int) -> int | None:
    """The position in ``[low, high]`` that lies nearest to ``middle``."""
    at = bisect_left(positions, middle)
    near = [p for p in positions[max(0, at - 1) : at + 1] if low <= p <= high]
    return min(near, key=lambda p: (abs(p - middle), p)) if near else None


def cut_positions(text: str, max_chars: int, overlap: int) -> list[int]:
    """Start positions of the pieces (the first is 0), by recursive bisection."""
    leaf = max_chars - overlap
    kinds, starts, todo = boundary_positions(text), [0], [(0, len(text))]
    while todo:
        begin, end = todo.pop()
        size = end - begin
        if size <= leaf and not (begin == 0 and end == len(text)):
            continue
        middle = begin + size // 2
        # every piece must hold the overlap of the next one
        margin = min(max(size // 4, min(overlap, size // 2), 1), size // 2)
        low, high = begin + margin, end - margin
        cut = next((p for p in (nearest(kind, middle, low, high) for kind in kinds) if p is not None), middle)
        starts.append(cut)
        todo += [(begin, cut), (cut, end)]
    return sorted(starts)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _cuts(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for texts, limits, overlaps in batches:
        yield pd.Series([cut_positions(t, int(m), int(o)) for t, m, o in zip(texts, limits, overlaps)], dtype=object)


def split_oversized(df: DataFrame, id_column: str, text_column: str, max_chars: Column | int, overlap_chars: Column | int) -> DataFrame:
    """``record_id, n_pieces, piece_no, start_char, piece`` for every text of more than ``max_chars`` code points.

    ``start_char`` counts from 0 and is where the piece begins, its overlap included. A limit that isn't above twice
    the overlap is an error, as no piece could hold the overlap of the next.
    """
    as_column = lambda x: F.lit(x).cast("int") if isinstance(x, int) else x
    limit, overlap = as_column(max_chars), as_column(overlap_chars)
    fits = F.assert_true(limit > 2 * overlap, F.lit("max_chars must be above twice overlap_chars"))
    long = df.select(
        F.col(id_column).alias("record_id"), F.col(text_column).alias("text"), limit.alias("limit"), overlap.alias("overlap")
    ).where(F.length("text") > F.col("limit"))
    cut = long.where(fits.isNull()).withColumn("starts", _cuts("text", "limit", "overlap"))
    pieces = cut.select("record_id", "text", "overlap", "starts", F.posexplode("starts").alias("at", "core"))
    following = F.coalesce(F.try_element_at("starts", F.col("at") + 2), F.length("text"))
    begin = F.when(F.col("at") == 0, F.lit(0)).otherwise(F.col("core") - F.col("overlap"))
    return pieces.select(
        "record_id",
        F.size("starts").alias("n_pieces"),
        (F.col("at") + 1).alias("piece_no"),
        begin.alias("start_char"),
        F.substring("text", begin + 1, following - begin).alias("piece"),
    )
