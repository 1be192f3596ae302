"""Fallbacks, sheets, the index of cells and blocks, on small fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pruefwerk.operators import calllog, chunking, evaluation, models, retrieval
from pruefwerk.plans.reports import padded
from pruefwerk.sources import files


def test_index_finds_nine_of_ten_neighbours(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "VECTOR_BLOCK", 40)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 8)
    rng = np.random.default_rng(3)
    # a third of all vectors in one direction: a cell that is cut into blocks
    x = np.vstack([rng.normal(size=(400, 16)), rng.normal(size=16) * 3 + 0.3 * rng.normal(size=(200, 16))])
    vectors = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(900, None)], "id bigint, embedding array<float>")
    queries = vectors.where("id % 20 = 0")
    centres = retrieval.cells_of(vectors.where("embedding IS NOT NULL"), 8)
    found = retrieval.ann_neighbors(queries, vectors, centres, 6)
    exact = retrieval.top_k_neighbors(queries.where("embedding IS NOT NULL"), vectors.where("embedding IS NOT NULL"))
    row = retrieval.recall(found, exact).first()
    assert row.n_exact == 30 * 8 and row.recall >= 0.9
    assert {r.query_id: r["count"] for r in found.groupBy("query_id").count().collect()} == {20 * i: 8 for i in range(30)}
    every = retrieval.ann_neighbors(queries, vectors, centres, 8)
    assert retrieval.recall(every, exact).first().recall == 1.0
    assert retrieval.ann_neighbors(queries.limit(0), vectors, centres, 3).count() == 0


def test_arrays_are_padded_or_cut(spark):
    df = spark.createDataFrame([([True], 3), ([True, False], 1), ([], 2), ([], 0)], "v array<boolean>, n int")
    assert [r[0] for r in df.select(padded(F.col("v"), F.col("n"), False)).collect()] == [[True, False, False], [True], [False, False], []]


def test_scores_of_nested_and_flat_records(spark):
    records = ['{"rag": {"correctness": {"score": 0.5}}, "rag_correctness": 0.1}', '{"rag_correctness": 0.25}', '{"rag": {"correctness": 3}, "rag_correctness": "x"}', '{"rag_correctness": true}', "{}", None, "kein JSON"]
    df = spark.createDataFrame([(r,) for r in records], "r string")
    assert [x[0] for x in df.select(files.score_of(F.col("r"), "rag", "correctness")).collect()] == [0.5, 0.25, None, 1.0, None, None, None]


def test_validation_sheet(spark, tmp_path):
    df = spark.createDataFrame([(1, "A", "A"), (2, "A", "B"), (3, None, "B"), (4, None, None)], "id int, m string, h string")
    sheet = files.validation_sheet(df, "m", "h")
    assert [r.agreement for r in sheet.orderBy("id").collect()] == [1, 0, 0, 1]
    files.write_validation(sheet, str(tmp_path / "sheet"))
    assert spark.read.option("sep", ";").option("header", True).csv(str(tmp_path / "sheet")).count() == 4


def test_no_page_is_read_after_the_last(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"eins|zwei|drei|FEHLER")

    def pages(content):
        for text in content.decode().split("|"):
            if text == "FEHLER":
                raise ValueError("read too far")
            yield text

    got = files.extracted_pages(spark, str(tmp_path), pages, 2, 3).orderBy("page_number").collect()
    assert [(r.page_number, r.text, r.error) for r in got] == [(2, "zwei", None), (3, "drei", None)]
    assert files.extracted_pages(spark, str(tmp_path), pages, 2).where("error IS NOT NULL").count() == 1


def test_what_cannot_be_embedded_is_kept_apart(spark, tmp_path):
    class Failing(models.OfflineProvider):
        def embed(self, texts):
            if "schlecht" in texts:
                raise RuntimeError("limit")
            return super().embed(texts)

    rows = [(i, "schlecht" if i == 5 else None if i == 7 else f"Text {i}") for i in range(250)]
    df = spark.createDataFrame(rows, "id bigint, text string").coalesce(1)
    made = models.embedded(df, "id", "text", Failing)
    models.store_index(made, str(tmp_path / "index"), str(tmp_path / "quarantine"))
    assert spark.read.parquet(str(tmp_path / "index")).count() == 150
    bad = spark.read.parquet(str(tmp_path / "quarantine"))
    assert bad.count() == 100 and bad.first().error == "RuntimeError: limit"


def test_chunks_keep_their_target(spark):
    df = spark.createDataFrame([(1, "a" * 500 + "\n\n" + "b" * 500)], "id int, text string")
    assert chunking.chunks_of(df, "id", "text", "semantic", 100, 0).count() == chunking.chunks_of(df, "id", "text", "raw", 100).count() == 2


def test_pages_are_carried_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(chunking, "PAGE_BLOCK", 3)
    marks = {1: 4, 8: 5, 9: 6}
    rows = [("s", i, f"### Seite {marks[i]}\nx" if i in marks else "x" if i % 2 else None) for i in range(14)] + [("t", 0, "x")]
    got = {(r.script_id, r.chunk_index): r.page_number for r in chunking.page_map(spark.createDataFrame(rows, "script_id string, chunk_index int, content string")).collect()}
    expected = {("s", i): None if i < 1 else 4 if i < 8 else 5 if i < 9 else 6 for i in range(14)} | {("t", 0): None}
    assert got == expected


def test_repeats_of_the_baseline_stay_rows(spark):
    rows = [(1, "q", "baseline"), (2, "q", "baseline"), (3, "q", "rag_semantic"), (4, "q", "rag_semantic"), (5, "q", "rag_raw"), (6, "p", "baseline"), (7, "p", "rag_raw"), (8, None, "baseline")]
    df = spark.createDataFrame([(i, q, s, f"a{i}", i) for i, q, s in rows], "answer_id bigint, question_id string, system string, answer string, answered_at int")
    assert sorted((r.baseline_id, r.rag_semantic_id, r.rag_raw_id) for r in evaluation.aligned(df).collect()) == [(1, 4, 5), (2, 4, 5)]


def test_calls_are_counted_once_by_their_id(spark):
    df = spark.createDataFrame([(1, " OK", 5), (1, " OK", 5), (2, "ok", 7)], "call_id bigint, status string, total_tokens int")
    assert sorted((r.call_id, r.status) for r in calllog.calls_once(df).collect()) == [(1, "ok"), (2, "ok")]


@pytest.mark.parametrize("rows, expected", [([], []), ([("x", 1.0)], [1.0])])
def test_ranks_of_small_tables(spark, rows, expected):
    from pruefwerk.operators import statistics as S

    df = spark.createDataFrame(rows, "g string, value double")
    assert [r.rank for r in S.value_ranks(df).collect()] == expected
