"""Problem 2: groups of records that share most of their words.

Two texts are near copies if the words they have in common, counted as often as both have them and in any order, are
at least ``share`` of the words of the longer one. A word is a lower-cased run of letters and digits.

Method: sequential Bayesian verification of banded candidates.

1. The bag of words is a set of features (word, how often it came before). Exact bags are collapsed to their first
   record, as their similarity to anything is the same.
2. Min-hash bands give the candidates. A word is common if it stands in ``COMMON_SHARE`` of all records; there are at
   most (words of a record) / COMMON_SHARE of them, a number that doesn't grow with the records. Of two near copies the
   common or the uncommon features agree by ``share`` at least, so that there are bands of uncommon rows, of one
   uncommon and some common rows, and of common rows, the more of them the more texts agree in them by chance. Which of
   these a record has is decided by the share of its features that are uncommon; records with hardly any uncommon
   feature are banded over all of them too.
3. Candidates compare their signatures in batches. After each batch a pair is dropped if the posterior probability
   that its Jaccard similarity reaches the least one of a near copy is under ``MISS``.
4. What is left is verified exactly on the words of both texts.

Nothing is capped: a band that very many records share is a skewed join, which Spark splits at run time.

Defined cases: null texts and texts without words are in no pair and no group; exact copies are pairs; repeated rows
with one id count once; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from fractions import Fraction
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from ..session import cut_lineage

SHARE = Fraction(3, 4)
COMMON_SHARE, COMMON_LEAST = 0.02, 50
#: Numbers of bands, and of rows over uncommon and over common features in each.
BANDS = [(24, 4, 0), (12, 1, 6), (8, 0, 12)]
#: Bands with common rows need this share and number of common features.
COMMON_BANDED, COMMON_FEATURES = 0.12, 8
#: Records with a smaller share of uncommon features have bands of so many rows over all features besides.
FEW_UNCOMMON, ALL_BANDS, ALL_ROWS = 0.125, 24, 4
SIGNATURE, BATCH = 64, 16
MISS = 1e-3

_WORD = re.compile(r"[^\W_]+")
_RANDOM = np.random.default_rng(20240229)
_UNCOMMON, _COMMON = (sum(band[0] * band[i] for band in BANDS) for i in (1, 2))
_N_BANDS = sum(n for n, _, _ in BANDS)
_FUNCTIONS = SIGNATURE + _UNCOMMON + _COMMON + ALL_BANDS * ALL_ROWS
_FACTORS = _RANDOM.integers(1, 2**63, _FUNCTIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _RANDOM.integers(0, 2**63, _FUNCTIONS, dtype=np.uint64)
_ROW_FACTORS = _RANDOM.integers(1, 2**63, _FUNCTIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND_SEEDS = _RANDOM.integers(0, 2**63, _N_BANDS + ALL_BANDS, dtype=np.uint64)


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def shares_words(a: str, b: str, share: Fraction = SHARE) -> bool:
    """The definition, on two texts."""
    x, y = Counter(words(a)), Counter(words(b))
    longer = max(x.total(), y.total())
    return longer > 0 and (x & y).total() * share.denominator >= longer * share.numerator


def least_matches(jaccard: float, miss: float = MISS) -> list[tuple[int, int]]:
    """For each number of compared hashes the fewest matches at which a pair stays.

    With a uniform prior and m matches among n, the similarity is Beta(m + 1, n - m + 1) distributed, and it reaches
    ``jaccard`` with the probability that a binomial variable of n + 1 trials is at most m.
    """
    out = []
    for n in range(BATCH, SIGNATURE + 1, BATCH):
        below = np.cumsum([comb(n + 1, k) * jaccard**k * (1 - jaccard) ** (n + 1 - k) for k in range(n + 1)])
        out.append((n, int(np.argmax(below >= miss))))
    return out


class _WordHashes(dict):
    """64-bit hashes of the words seen; emptied at ``most`` words."""

    def __init__(self, most: int = 500_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _hashed(text: str, hashes: _WordHashes) -> np.ndarray:
    found = words(text)
    return np.sort(np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found)))


def _features(hashed: np.ndarray) -> np.ndarray:
    """(word, occurrence) as 64-bit values, in the order of the sorted words."""
    at = np.arange(len(hashed))
    first = np.r_[True, hashed[1:] != hashed[:-1]]
    occurrence = at - np.maximum.accumulate(np.where(first, at, 0))
    return _mix(hashed + occurrence.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def _minima(features: np.ndarray, begin: int, end: int) -> np.ndarray:
    """Min-hashes by the functions ``begin`` to ``end``; long texts in blocks."""
    factors, offsets = _FACTORS[None, begin:end], _OFFSETS[None, begin:end]
    blocks = [(features[i : i + 4096, None] * factors + offsets).min(axis=0) for i in range(0, len(features), 4096)]
    return blocks[0] if len(blocks) == 1 else np.min(blocks, axis=0)


def _rows(features: np.ndarray, begin: int, end: int, rows: int) -> np.ndarray:
    """For each band the sum of its min-hashes, each times a factor of its own, by the functions ``begin`` to ``end``."""
    return (_minima(features, begin, end) * _ROW_FACTORS[begin:end]).reshape(-1, rows).sum(axis=1, dtype=np.uint64)


def _band_keys(features: np.ndarray, is_common: np.ndarray, field: int) -> np.ndarray:
    """The keys of a record's bands; their lowest eight bits are the code of the field."""
    common, uncommon = features[is_common], features[~is_common]
    banded = len(common) >= max(COMMON_FEATURES, COMMON_BANDED * len(features))
    keys, u, c, at = [], SIGNATURE, SIGNATURE + _UNCOMMON, 0
    for n, of_uncommon, of_common in BANDS:
        if (not of_uncommon or len(uncommon)) and (not of_common or banded):
            key = _BAND_SEEDS[at : at + n].copy()
            if of_uncommon:
                key += _rows(uncommon, u, u + n * of_uncommon, of_uncommon)
            if of_common:
                key += _rows(common, c, c + n * of_common, of_common)
            keys.append(key)
        u, c, at = u + n * of_uncommon, c + n * of_common, at + n
    if len(uncommon) < FEW_UNCOMMON * len(features):
        begin = SIGNATURE + _UNCOMMON + _COMMON
        keys.append(_BAND_SEEDS[at:] + _rows(features, begin, begin + ALL_BANDS * ALL_ROWS, ALL_ROWS))
    return _mix(np.concatenate(keys)) & ~np.uint64(255) | np.uint64(field)


def common_words(records: DataFrame) -> np.ndarray:
    """Hashes of the words that stand in ``COMMON_SHARE`` of the records of all fields, counted over all of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen, n = _WordHashes(), Counter(), 0

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
            seen.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(set(words(text)))
                n += 1
            if len(seen) > 200_000:
                yield flush()
        seen[""] = n  # the number of records
        del hashes
        yield flush()

    counted = records.select("text").mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    counted = cut_lineage(counted)
    total = counted.where("word = ''").agg(F.sum("n")).first()[0] or 0
    least = max(COMMON_LEAST, COMMON_SHARE * total)
    hashes = _WordHashes()
    return np.array(sorted(hashes[row["word"]] for row in counted.where((F.col("n") >= least) & (F.col("word") != "")).collect()), np.uint64)


def signed_records(records: DataFrame, common: np.ndarray) -> DataFrame:
    """``field, id, bag, signature, bands`` of the records that have words.

    A signature is the number of words in four bytes and two bytes for each min-hash.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        names = ["field", "id", "bag", "signature", "bands"]
        for batch in batches:
            fields, ids, texts = (column.to_pylist() for column in batch.columns)
            rows: list[tuple] = []
            bands: list[np.ndarray] = []
            for field, record, text in zip(fields, ids, texts):
                hashed = _hashed(text, hashes)
                if not len(hashed):
                    continue
                features = _features(hashed)
                at = np.searchsorted(common, hashed)
                is_common = common[np.minimum(at, len(common) - 1)] == hashed if len(common) else np.zeros(len(hashed), bool)
                signature = (_minima(features, 0, SIGNATURE) * np.uint64(0xFF51AFD7ED558CCD) >> np.uint64(48)).astype(np.uint16)
                bag = hashlib.blake2b(hashed.tobytes(), digest_size=16, salt=bytes([field])).digest()
                rows.append((field, record, bag, np.uint32(len(hashed)).tobytes() + signature.tobytes()))
                bands.append(_band_keys(features, is_common, field).view(np.int64))
            offsets = np.r_[0, np.cumsum([len(x) for x in bands])].astype(np.int32)
            flat = np.concatenate(bands) if bands else np.empty(0, np.int64)
            columns = list(zip(*rows)) or [[]] * 4
            arrays = [pa.array(list(c), t) for c, t in zip(columns, [pa.int32(), pa.int64(), pa.binary(), pa.binary()])]
            yield pa.RecordBatch.from_arrays([*arrays, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names)

    return records.select("field", "id", "text").mapInArrow(sign, "field int, id bigint, bag binary, signature binary, bands array<bigint>")


def candidate_pairs(representatives: DataFrame) -> DataFrame:
    """Distinct pairs ``field, id_a, id_b`` of representatives that share a band."""
    rows = representatives.select(F.explode("bands").alias("band"), "id")
    # merge join: a band that many records share is split by the adaptive skew join
    a, b = (rows.select("band", F.col("id").alias(f"id_{side}")) for side in "ab")
    joined = a.hint("merge").join(b, "band").where("id_a < id_b")
    return joined.select(F.col("band").bitwiseAND(255).cast("int").alias("field"), "id_a", "id_b").distinct()


def _attached(pairs: DataFrame, records: DataFrame, column: str) -> DataFrame:
    for side in "ab":
        own = records.select("field", F.col("id").alias(f"id_{side}"), F.col(column).alias(f"{column}_{side}"))
        pairs = pairs.join(own, ["field", f"id_{side}"])
    return pairs


def likely_pairs(candidates: DataFrame, representatives: DataFrame, share: Fraction = SHARE) -> DataFrame:
    """Candidates whose lengths allow a near copy and that the sequential comparison of their signatures doesn't drop."""
    least = least_matches(float(share / (2 - share)))

    @F.pandas_udf(T.BooleanType())
    def stays(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y = (np.frombuffer(b"".join(bytes(v) for v in s), np.uint16).reshape(len(s), SIGNATURE + 2) for s in (a, b))
        m, n = (np.ascontiguousarray(z[:, :2]).view(np.uint32)[:, 0].astype(np.int64) for z in (x, y))
        x, y = x[:, 2:], y[:, 2:]
        alive = np.flatnonzero(np.minimum(m, n) * share.denominator >= np.maximum(m, n) * share.numerator)
        matches = np.zeros(len(a), np.int64)
        for n, fewest in least:
            batch = slice(n - BATCH, n)
            matches[alive] += (x[alive, batch] == y[alive, batch]).sum(axis=1)
            alive = alive[matches[alive] >= fewest]
        return pd.Series(np.isin(np.arange(len(a)), alive))

    return _attached(candidates, representatives, "signature").where(stays("signature_a", "signature_b")).select("field", "id_a", "id_b")


def verified_pairs(pairs: DataFrame, records: DataFrame, share: Fraction = SHARE) -> DataFrame:
    """Pairs whose texts fulfil the definition."""

    @F.pandas_udf(T.BooleanType())
    def holds(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([shares_words(x, y, share) for x, y in zip(a, b)], dtype=bool)

    return _attached(pairs, records, "text").where(holds("text_a", "text_b")).select("field", "id_a", "id_b")


def near_copies(records: DataFrame, share: Fraction = SHARE) -> tuple[DataFrame, DataFrame]:
    """Members ``field, id, bag, representative`` and links ``field, id_a, id_b`` between representatives.

    ``records`` has ``field INT, id BIGINT, text STRING``, an id once in a field; fields are from 0 to 255.
    """
    with_text = records.where(F.col("text").isNotNull())
    signed = cut_lineage(signed_records(with_text, common_words(with_text)))
    by_bag = Window.partitionBy("field", "bag").orderBy("id")
    representatives = signed.withColumn("at", F.row_number().over(by_bag)).where("at = 1").drop("at")
    links = verified_pairs(likely_pairs(candidate_pairs(representatives), representatives, share), with_text, share)
    first = signed.groupBy("field", "bag").agg(F.min("id").alias("representative"))
    members = signed.select("field", "id", "bag").join(first, ["field", "bag"])
    return members, links


def all_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """Every pair ``field, id_a, id_b`` of near copies, exact copies included."""
    x, y = (members.select("field", F.col("representative").alias(f"representative_{s}"), F.col("id").alias(f"id_{s}")) for s in "xy")
    linked = links.withColumnsRenamed({"id_a": "representative_x", "id_b": "representative_y"})
    across = linked.join(x, ["field", "representative_x"]).join(y, ["field", "representative_y"])
    bag = members.select("field", "representative", "id")
    within = bag.withColumnRenamed("id", "id_x").join(bag.withColumnRenamed("id", "id_y"), ["field", "representative"]).where("id_x < id_y")
    both = across.select("field", "id_x", "id_y").unionByName(within.select("field", "id_x", "id_y"))
    return both.select("field", F.least("id_x", "id_y").alias("id_a"), F.greatest("id_x", "id_y").alias("id_b"))


def components(links: DataFrame) -> DataFrame:
    """``field, id, group`` of all linked ids: the least id of their component.

    Alternating star contraction: each round every vertex hands its larger neighbours to its least one, then all its
    smaller ones; the number of rounds is logarithmic in the size of a component. Rounds are cut by checkpoints.
    """
    edges = cut_lineage(links.select("field", F.col("id_a").alias("u"), F.col("id_b").alias("v")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select("field", F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("field", "u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, ["field", "u"]).where("v > u").select("field", F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        down = large.select("field", F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        lowest = down.groupBy("field", "u").agg(F.min("v").alias("m"))
        small = down.join(lowest, ["field", "u"])
        next_edges = small.select("field", "u", F.col("m").alias("v")).unionByName(small.select("field", F.col("v").alias("u"), F.col("m").alias("v")))
        edges = cut_lineage(next_edges.where("u <> v").distinct())
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("field", "u", "v").cast("decimal(38,0)"))).first()
        if before == tuple(state):
            break
        before = tuple(state)
    roots = edges.select("field", F.col("v").alias("id"), F.col("v").alias("group")).distinct()
    return edges.select("field", F.col("u").alias("id"), F.col("v").alias("group")).unionByName(roots)


def groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """One row ``field, id, group_id, n_links`` for each record with words.

    ``group_id`` is the least id of the group, ``n_links`` the number of other records that are near copies of it.
    """
    copies = members.groupBy("field", "representative").agg(F.count(F.lit(1)).alias("copies"))
    ends = links.select("field", F.col("id_a").alias("representative"), F.col("id_b").alias("other")).unionByName(
        links.select("field", F.col("id_b").alias("representative"), F.col("id_a").alias("other"))
    )
    others = ends.join(copies.withColumnRenamed("representative", "other"), ["field", "other"])
    linked = others.groupBy("field", "representative").agg(F.sum("copies").alias("linked"))
    found = components(links).withColumnRenamed("id", "representative")
    summary = copies.join(linked, ["field", "representative"], "left").join(found, ["field", "representative"], "left")
    summary = summary.select(
        "field", "representative",
        F.coalesce("group", "representative").alias("group_id"),
        (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"),
    )
    return members.join(summary, ["field", "representative"]).select("field", "id", "group_id", "n_links")


def field_names(column: Column, names: list[str]) -> Column:
    """The name of a field code."""
    return F.element_at(F.array(*map(F.lit, names)), column + 1)
