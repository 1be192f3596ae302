"""Problem 6: token ids of a whole corpus.

Method: tree concatenation. Texts are cut where a token can never cross, between a character and the white space
after it. A stretch without such a place that is longer than ``unit`` is unsplit text: its halves (and theirs, down to
``unit``) are rows of their own that Spark encodes in parallel, and neighbours are then joined in tree order, each
join encoding again a window around it that grows until its tokens agree with both sides.

Defined cases: null, empty and missing texts give an empty list; strings that look like special tokens are ordinary
text; repeated rows give a row each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokenizers import DEFAULT_FOLDER, encoding

#: Code points that are encoded in one go.
UNIT = 4096
_SAFE = re.compile(r"[0-9A-Za-zÀ-ÖØ-öø-ÿ.,;:!?)\]}$|](?=[ \n])")


def segments(text: str, unit: int = UNIT) -> list[tuple[int, str, bool]]:
    """Consecutive parts ``(no, part, joins)`` of at most ``unit`` code points that together are the text.

    ``joins`` says that the part must be joined to the one before it, as it begins inside unsplit text.
    """
    parts: list[tuple[str, bool]] = []
    begin = 0
    while begin < len(text):
        end = min(begin + unit, len(text))
        if end < len(text):
            safe = [m.end() for m in _SAFE.finditer(text, begin, end + 1) if m.end() <= end]
            if safe:
                end = safe[-1]
            else:
                further = _SAFE.search(text, end)
                end = further.end() if further else len(text)
        parts += [(part, i > 0) for i, part in enumerate(halves(text[begin:end], unit))]
        begin = end
    return [(i, part, joins) for i, (part, joins) in enumerate(parts)]


def halves(text: str, unit: int) -> list[str]:
    """Leaves of the halving of an unsplit text."""
    if len(text) <= unit:
        return [text]
    middle = len(text) // 2
    return halves(text[:middle], unit) + halves(text[middle:], unit)


def join(left: list[int], right: list[int], encode, decode_bytes) -> list[int]:
    """The ids of the concatenation of two encoded texts.

    The window takes tokens from both sides at code point borders and grows until half of its tokens on either side
    are those that were there; at the latest it is all of both sides, which is the definition.
    """
    if not left or not right:
        return left + right
    size = 8
    while True:
        i, j = max(0, len(left) - size), min(len(right), size)
        window, i, j = _window(left, right, i, j, decode_bytes)
        ids = encode(window)
        if i == 0 and j == len(right):
            return ids
        keep_left, keep_right = (len(left) - i) // 2, j // 2
        good_left = i == 0 or ids[:keep_left] == left[i : i + keep_left]
        good_right = j == len(right) or (keep_right and ids[-keep_right:] == right[j - keep_right : j])
        if good_left and good_right and len(ids) >= keep_left + keep_right:
            return left[:i] + ids + right[j:]
        size *= 2


def _window(left: list[int], right: list[int], i: int, j: int, decode_bytes) -> tuple[str, int, int]:
    """The text of ``left[i:] + right[:j]``, widened to whole code points."""
    while True:
        try:
            return decode_bytes(left[i:] + right[:j]).decode("utf-8"), i, j
        except UnicodeDecodeError as error:
            if error.start == 0 and i > 0:
                i -= 1
            elif j < len(right):
                j += 1
            elif i > 0:
                i -= 1
            else:
                raise


def join_tree(parts: list[list[int]], encode, decode_bytes) -> list[int]:
    """Join neighbours pairwise, level by level."""
    while len(parts) > 1:
        level = [join(a, b, encode, decode_bytes) for a, b in zip(parts[::2], parts[1::2])]
        parts = level + ([parts[-1]] if len(parts) % 2 else [])
    return parts[0] if parts else []


def encode_parts(parts: list[list[int]], joins: list[bool], encode, decode_bytes) -> list[int]:
    """Ids of a text from the ids of its segments in order."""
    out: list[int] = []
    run: list[list[int]] = []
    for ids, joined in zip(parts, joins):
        if not joined and run:
            out += join_tree(run, encode, decode_bytes)
            run = []
        run.append(ids)
    return out + join_tree(run, encode, decode_bytes)


def id_lists(lists: list[list[int]]) -> pa.Array:
    """Python lists as an Arrow list array, by offsets."""
    offsets = np.zeros(len(lists) + 1, np.int32)
    np.cumsum([len(x) for x in lists], out=offsets[1:])
    flat = np.fromiter((i for x in lists for i in x), np.int32, int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def token_ids(df: DataFrame, id_column: str, text_column: str, tokenizer: str = "byte_bpe_50k", folder: str = DEFAULT_FOLDER, unit: int = UNIT) -> DataFrame:
    """``doc_id, ids``: the ids of every text by ``tokenizer``, without special tokens.

    Texts of at most ``unit`` code points are encoded where they are read. Longer ones are spread over the cluster as
    segments and come back together by their row, so that no task encodes a very long text alone.
    """
    texts = df.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    short = F.coalesce(F.length("text"), F.lit(0)) <= unit

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(tokenizer, folder).encode_ordinary
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("text")).to_pylist()
            lists = [encode(text) if text else [] for text in column]
            yield pa.RecordBatch.from_arrays([batch.column(0), id_lists(lists)], ["doc_id", "ids"])

    @F.pandas_udf("array<struct<no: int, part: string, joins: boolean>>")
    def cut(column: pd.Series) -> pd.Series:
        return pd.Series([[{"no": n, "part": p, "joins": x} for n, p, x in segments(text, unit)] for text in column])

    @F.pandas_udf("array<int>")
    def encoded(column: pd.Series) -> pd.Series:
        encode = encoding(tokenizer, folder).encode_ordinary
        return pd.Series([encode(text) for text in column], dtype=object)

    @F.pandas_udf("array<int>")
    def joined(parts: pd.Series) -> pd.Series:
        own = encoding(tokenizer, folder)
        out = []
        for row in parts:
            ordered = sorted(row, key=lambda part: part["no"])
            out.append(encode_parts([list(map(int, p["ids"])) for p in ordered], [bool(p["joins"]) for p in ordered], own.encode_ordinary, own.decode_bytes))
        return pd.Series(out, dtype=object)

    type_of = dict(texts.dtypes)["doc_id"]
    near = texts.where(short).mapInArrow(whole, f"doc_id {type_of}, ids array<int>")
    # repeated ids stay apart by a row id of their own
    far = texts.where(~short).withColumn("row", F.monotonically_increasing_id())
    parts = far.select("doc_id", "row", F.explode(cut("text")).alias("p")).select("doc_id", "row", "p.no", "p.part", "p.joins")
    spread = parts.repartition("row", "no").select("doc_id", "row", F.struct("no", encoded("part").alias("ids"), "joins").alias("p"))
    together = spread.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.collect_list("p").alias("parts"))
    return near.unionByName(together.select("doc_id", joined("parts").alias("ids")))
