"""Nearest neighbours by cosine similarity and the context made of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from ..functions.text import collapse_whitespace

TOP_K = 8
QUERY_BLOCK, VECTOR_BLOCK = 256, 4096
#: Cells of the index, and the bound of the rows they are fitted on.
N_CELLS, N_PROBE, FIT_ROWS = 32, 22, 20_000


def _blocks(vectors: DataFrame, size: int, name: str) -> DataFrame:
    """Vectors in about equal blocks by the hash of their id, a row for each block."""
    n = max(1, -(-vectors.count() // size))
    return vectors.groupBy(F.pmod(F.xxhash64("id"), F.lit(n)).alias(name)).agg(F.collect_list(F.struct("id", "embedding")).alias(f"{name}_rows"))


def top_k_neighbors(queries: DataFrame, vectors: DataFrame, k: int = TOP_K) -> DataFrame:
    """``query_id, rank, vec_id, similarity``: for each query its ``k`` nearest vectors but itself.

    Both have ``id BIGINT, embedding ARRAY<FLOAT>``. Every block of queries meets every block of vectors as one matrix
    product, which keeps only the ``k`` best of each query; nothing is collected or sent whole to all workers.
    """
    query_blocks = _blocks(queries, QUERY_BLOCK, "q")
    numbers = query_blocks.agg(F.array_sort(F.collect_list("q")).alias("qs"))
    targets = _blocks(vectors, VECTOR_BLOCK, "v").withColumn("qs", numbers.scalar()).withColumn("q", F.explode("qs")).drop("qs")
    return _best(targets.join(query_blocks, "q").select("q_rows", "v_rows"), k)


def _best(pairs: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each query over all pairs ``q_rows, v_rows`` of blocks."""

    def unit(rows) -> tuple[np.ndarray, np.ndarray]:
        matrix = np.array([np.asarray(r["embedding"], np.float64) for r in rows])
        return np.array([r["id"] for r in rows]), matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for q_rows, v_rows in zip(batch["q_rows"], batch["v_rows"]):
                (q, x), (v, y) = unit(q_rows), unit(v_rows)
                similarity = x @ y.T
                similarity[q[:, None] == v[None, :]] = -np.inf
                best = np.argsort(-similarity, axis=1, kind="stable")[:, :k]
                out = pd.DataFrame({"query_id": np.repeat(q, best.shape[1]), "vec_id": v[best].ravel(), "similarity": np.take_along_axis(similarity, best, 1).ravel()})
                yield out[np.isfinite(out["similarity"])]

    partial = pairs.mapInPandas(multiply, "query_id bigint, vec_id bigint, similarity double")
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "similarity")


def cells_of(vectors: DataFrame, n_cells: int, fit_rows: int = FIT_ROWS, seed: int = 42) -> np.ndarray:
    """Centres of cells of directions, fitted on about ``fit_rows`` rows drawn by the hash of their id."""
    share = min(1.0, fit_rows / max(1, vectors.count()))
    drawn = vectors.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share * 1_000_000).select(array_to_vector("embedding").alias("v"))
    model = KMeans(k=n_cells, maxIter=10, seed=seed, featuresCol="v").fit(Normalizer(inputCol="v", outputCol="u").transform(drawn).select(F.col("u").alias("v")))
    centres = np.array(model.clusterCenters())
    return centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-300)


def ann_neighbors(queries: DataFrame, vectors: DataFrame, centres: np.ndarray, n_probe: int, k: int = TOP_K) -> DataFrame:
    """``query_id, rank, vec_id, similarity`` by an index of cells: every vector is in the cell of its nearest centre, and
    a query meets the vectors of the ``n_probe`` cells nearest to it.

    Large cells are cut into blocks by their number of rows. What is sent to all workers are the centres.
    """

    def nearest(n: int):
        @F.pandas_udf(T.ArrayType(T.IntegerType()))
        def cells(embeddings: pd.Series) -> pd.Series:
            scores = np.stack(embeddings.to_numpy()).astype(np.float64) @ centres.T if len(embeddings) else np.empty((0, len(centres)))
            return pd.Series(list(np.argsort(-scores, axis=1, kind="stable")[:, :n].astype(np.int32)), dtype=object)

        return cells(F.col("embedding"))

    placed = vectors.where("embedding IS NOT NULL").select("id", "embedding", nearest(1)[0].alias("cell"))
    sizes = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / VECTOR_BLOCK).alias("n_blocks"))
    cut = placed.join(F.broadcast(sizes), "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("n_blocks")))
    targets = cut.groupBy("cell", "block").agg(F.collect_list(F.struct("id", "embedding")).alias("v_rows"))
    asked = queries.where("embedding IS NOT NULL").select("id", "embedding", F.explode(nearest(n_probe)).alias("cell"))
    n = F.ceil(F.count(F.lit(1)) / QUERY_BLOCK)
    split = asked.join(F.broadcast(asked.groupBy("cell").agg(n.alias("n_blocks"))), "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("n_blocks")))
    blocks = split.groupBy("cell", "block").agg(F.collect_list(F.struct("id", "embedding")).alias("q_rows"))
    return _best(targets.drop("block").join(blocks.drop("block"), "cell").select("q_rows", "v_rows"), k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """``n_exact, n_found, recall``: how many of the exact neighbours an index finds."""
    both = exact.select("query_id", "vec_id").join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return both.agg(F.count(F.lit(1)).alias("n_exact"), F.count("hit").alias("n_found"), (F.count("hit") / F.count(F.lit(1))).alias("recall"))


def contexts(neighbors: DataFrame, texts: DataFrame) -> DataFrame:
    """``query_id, n_passages, context``: the texts of the neighbours by rank, each text once; ``texts``: ``vec_id, text``."""
    keyed = neighbors.join(texts.where("text IS NOT NULL"), "vec_id").withColumn("key", F.sha2(collapse_whitespace(F.col("text")), 256))
    first = keyed.groupBy("query_id", "key").agg(F.min(F.struct("rank", "text")).alias("p"))
    passages = first.groupBy("query_id").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    return passages.select("query_id", F.size("ps").cast("bigint").alias("n_passages"), F.array_join(F.col("ps.text"), "\n\n---\n\n").alias("context"))
