import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from pruefwerk.functions import tails
from pruefwerk.functions import text as X
from pruefwerk.operators import bootstrap, calllog, chunking, evaluation, models, retrieval, sampling
from pruefwerk.operators import statistics as S
from pruefwerk.sources import files


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_text_functions(spark):
    df = spark.createDataFrame([("a \t b  \n\n\n\nc\x07 ",), (None,)], "t string")
    assert [r[0] for r in df.select(X.normalize_whitespace(F.col("t"))).collect()] == ["a b\n\nc", ""]
    latex = spark.createDataFrame([("x \\(a\\) und \\[b\nc\\]",)], "t string")
    assert latex.select(X.sanitize_latex(F.col("t"))).first()[0] == "x $a$ und $$b\nc$$"
    asked = spark.createDataFrame([("Was steht im Skript auf Seite 3 in der Wahrheitstabelle?",), ("Was ist ein Baum?",)], "q string")
    assert [r[0] for r in asked.select(X.script_references(F.col("q"))).collect()] == [["im Skript", "auf Seite 3", "in der Wahrheitstabelle"], []]
    post = spark.createDataFrame([("Hier ist der Text:\n```markdown\nInhalt\n```",), ("Text\n 12 ",)], "t string")
    assert [r[0] for r in post.select(X.post_process(F.col("t"))).collect()] == ["Inhalt", "Text"]
    wait = spark.createDataFrame([("Please try again in 2.5s",), ("try again in 900s",), ("no",)], "m string")
    assert [r[0] for r in wait.select(X.retry_after(F.col("m"))).collect()] == [2.6, 60.0, None]


def test_semantic_chunks_keep_sections_and_overlap():
    text = "# A\n" + "a" * 30 + "\n## B\n" + "b" * 60
    chunks = chunking.semantic_pieces(text, 70, 10)
    assert chunks[0].startswith("# A") and chunks[1].startswith("a" * 10) and chunks[1].endswith("b" * 60)
    long = "# L\n" + "\n\n".join("p" * 40 for _ in range(6))
    pieces = chunking.semantic_pieces("kurz\n" + long, 60, 5)
    assert pieces[0] == "kurz" and len(pieces) == 7 and all(p.startswith("p" * 5) for p in pieces[2:])
    assert chunking.semantic_pieces("") == [] and chunking.semantic_pieces("x" * 5000, 60, 5) == ["x" * 5000]


def test_raw_chunks_and_windows(spark):
    df = spark.createDataFrame([(1, "aa\n\nbb\n\n\ncc"), (2, None), (3, " \n\n "), (4, "y" * 50)], "id bigint, t string")
    got = rows(chunking.chunks_of(df, "id", "t", "raw", 6).select("id", "chunk_index", "content"))
    assert got == [(1, 0, "aa\n\nbb"), (1, 1, "cc"), (4, 0, "y" * 50)] or [g[2] for g in got if g[0] == 1] == ["aa", "bb", "cc"]
    chunks = spark.createDataFrame([("s", i, f"chunk_{i}", "# Neu" if i == 4 else f"c{i}") for i in range(10)], "script_id string, chunk_index int, chunk_id string, content string")
    windows = rows(chunking.generation_windows(chunks).select("start", "n_chunks", "source_reference"))
    assert windows == [(0, 4, "chunk_0_to_chunk_3")]
    marked = spark.createDataFrame([("s", 0, "x"), ("s", 1, "### Seite 3\n y\n### Seite 4"), ("s", 2, "z")], "script_id string, chunk_index int, content string")
    assert rows(chunking.page_map(marked)) == [("s", 0, None), ("s", 1, 3), ("s", 2, 3)]


def test_neighbors_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "VECTOR_BLOCK", 16)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    rnd = random.Random(1)
    vectors = {i: [rnd.gauss(0, 1) for _ in range(8)] for i in range(60)}
    df = spark.createDataFrame(list(vectors.items()), "id bigint, embedding array<float>")
    unit = {i: [x / math.dist(v, [0] * 8) for x in v] for i, v in vectors.items()}
    for r in retrieval.top_k_neighbors(df.where("id < 10"), df, 4).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id"))).alias("n")).collect():
        best = sorted((i for i in unit if i != r.query_id), key=lambda i: -sum(a * b for a, b in zip(unit[i], unit[r.query_id])))[:4]
        assert [x.vec_id for x in r.n] == best


def test_alignment_and_canonical_context(spark):
    t = dt.datetime(2025, 1, 1)
    answers = [("Q1", "baseline", 1, "b", None, t), ("Q2", "baseline", 2, "b", None, t), ("Q1", "rag_semantic", 3, "alt", "c", t), ("Q1", "rag_semantic", 4, "neu", "c", t + dt.timedelta(1)), ("Q1", "rag_raw", 5, "r", "c", t)]
    df = spark.createDataFrame(answers, "question_id string, system string, answer_id bigint, answer string, retrieved_context string, answered_at timestamp")
    assert [(r.question_id, r.rag_semantic_answer) for r in evaluation.aligned(df).collect()] == [("Q1", "neu")]
    assert rows(evaluation.missing_systems(df)) == [("Q2", "rag_raw"), ("Q2", "rag_semantic")]
    pages = spark.createDataFrame([("s", 1, 1, "eins", [], t), ("s", 2, 2, "zwei", ["Bild"], t), ("s", 3, 3, "drei", None, t)], "script_id string, page_number int, page_id bigint, text string, image_descriptions array<string>, extracted_at timestamp")
    chunks = spark.createDataFrame([("s", "chunk_0", 1, "x"), ("s", "chunk_1", None, "### Seite 2\ny")], "script_id string, chunk_id string, page_number int, content string")
    refs = spark.createDataFrame([(1, "s", "chunk_1_to_chunk_1"), (2, "s", "chunk_0_to_chunk_9"), (3, "s", "nichts"), (4, "s", None)], "key bigint, script_id string, source_reference string")
    got = {r.key: r.context for r in evaluation.canonical_context(refs, chunks, pages).collect()}
    assert got == {1: "eins\n\nzwei\n\n[BILD-INFO: Bild]\n\ndrei", 2: "eins\n\nzwei\n\n[BILD-INFO: Bild]"}


def test_scores(spark):
    df = spark.createDataFrame([(1, "Alpha Beta. Gamma Delta.", "alpha beta", "Was?")], "id bigint, a string, c string, question string")
    r = evaluation.proportional(evaluation.judged_claims(df, "id", "a", "c"), "id").first()
    assert (r.n_claims, r.n_supported, r.score) == (2, 1, 0.5)
    votes = spark.createDataFrame([(1, [4, 4]), (2, [5]), (3, [2, 5]), (4, [])], "eval_id bigint, raw_scores array<int>")
    assert {r.eval_id: (r.score, r.disagreement) for r in evaluation.likert(votes).collect()} == {1: (0.75, 0), 2: (1.0, 0), 3: (0.625, 3), 4: (None, 0)}


def test_rank_statistics(spark):
    pairs = spark.createDataFrame([(1.0, 0.5), (0.5, 0.5), (0.9, 0.6), (0.2, 0.4)], "x double, y double")
    w = S.wilcoxon(pairs, "x", "y").first()
    assert (w.n, w.n_pos, w.n_neg, w.n_ties, w.w_plus) == (4, 2, 1, 1, 5.0)
    groups = spark.createDataFrame([(float(i), i >= 10) for i in range(20)], "score double, g boolean")
    u = S.mann_whitney(groups, F.col("g")).first()
    assert u.u == 100.0 and u.rank_biserial == 1.0
    assert S.mann_whitney(groups, ~F.col("g")).first().rank_biserial == -1.0
    cells = [(a, b, float(10 * i + j)) for i, a in enumerate("xy") for j, b in enumerate("pqr") for _ in range(3)]
    h = {r.effect: r for r in S.scheirer_ray_hare(spark.createDataFrame(cells, "a string, b string, score double"), "a", "b").collect()}
    assert h["a"].df == 1 and h["a"].h > h["b"].h and abs(h["interaction"].h) < 1e-9
    assert S.spearman(spark.createDataFrame([(float(i), float(i * i)) for i in range(9)], "x double, y double"), "x", "y").first().rho_high == 1.0


def test_agreement(spark):
    same = spark.createDataFrame([(i, i) for i in range(1, 6)], "a int, b int")
    assert S.weighted_kappa(same).first().kappa == 1.0 and S.nominal_kappa(same).first().kappa == 1.0
    assert S.weighted_kappa(same.select("a", (6 - F.col("b")).alias("b"))).first().kappa < 0
    df = spark.createDataFrame([(55, 528), (0, 30), (30, 30), (0, 0)], "k int, n int")
    low, high = S.wilson(F.col("k"), F.nullif("n", F.lit(0)))
    got = [tuple(r) for r in df.select(low, high).collect()]
    assert got[0] == pytest.approx((0.0808, 0.133), abs=2e-3) and 0 <= got[1][0] and got[2][1] <= 1 and got[3] == (None, None)


def test_corrections(spark):
    p = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "test string, p double")
    got = {r.test: r for r in S.corrected(p).collect()}
    assert got["a"].holm == pytest.approx(0.03) and got["b"].holm == pytest.approx(0.06) and all(r.bh <= r.bonferroni for r in got.values())


def test_tails():
    assert tails.normal_sf(1.959963984540054) == pytest.approx(0.025, abs=1e-9)
    assert tails.chi2_sf(5.991464547, 2) == pytest.approx(0.05, abs=1e-8) and tails.chi2_sf(3.841458821, 1) == pytest.approx(0.05, abs=1e-8) and tails.chi2_sf(7.814727903, 3) == pytest.approx(0.05, abs=1e-8)
    assert tails.student_sf(2.085963447, 20) == pytest.approx(0.025, abs=2e-5)
    assert tails.power_paired_t(0.5, 40, 0.0167) == pytest.approx(0.827, abs=0.003)
    assert tails.power_paired_t(tails.least_effect(40, 0.0167), 40, 0.0167) == pytest.approx(0.8, abs=0.02)
    assert tails.signed_rank_exact_sf(15, 5) == 1 / 32


def test_bootstrap_and_samples(spark):
    rnd = random.Random(0)
    df = spark.createDataFrame([(i, "g", rnd.gauss(0.5, 0.1)) for i in range(400)], "id bigint, m string, v double")
    r = bootstrap.bootstrap_mean(df, "m", "v", 400).first()
    assert r.low < r.mean < r.high and r.high - r.low < 0.05
    again = bootstrap.bootstrap_mean(df.repartition(3), "m", "v", 400).first()
    assert again.low == pytest.approx(r.low) and again.high == pytest.approx(r.high)
    assert sampling.random_sample(df, "id", 15).select("id").collect() == sampling.random_sample(df.repartition(5), "id", 15).select("id").collect()
    assert sampling.stratified_sample(df, "m", "id", 10).count() == 10


def test_call_log(spark):
    start = dt.datetime(2025, 1, 1)
    calls = [(i, "m", start + dt.timedelta(seconds=s), 10, "OK ") for i, s in enumerate([0, 30, 59, 60, 61, 200])]
    df = spark.createDataFrame(calls + calls[:2], "call_id bigint, model string, ts timestamp_ntz, total_tokens int, status string")
    once = calllog.calls_once(df)
    assert once.count() == 6 and {r.status for r in once.collect()} == {"ok"}
    assert [r.window_tokens for r in calllog.sliding_tokens(once).orderBy("call_id").collect()] == [10, 20, 30, 30, 40, 10]
    begun = [r.start_s - start.replace(tzinfo=dt.timezone.utc).timestamp() for r in calllog.admitted(once, 20).orderBy("call_id").collect()]
    assert begun == [0, 30, 60, 90, 120, 200]


def test_stream(spark, tmp_path):
    from pruefwerk.streaming.calllog import call_stream, windowed_usage

    df = spark.createDataFrame([(i % 5, dt.datetime(2025, 1, 1, i % 3), "chat", 7) for i in range(15)], "call_id bigint, ts timestamp, kind string, total_tokens int").distinct()
    df.write.parquet(str(tmp_path / "in"))
    run = windowed_usage(call_stream(spark, str(tmp_path / "in"), df.schema)).writeStream.format("memory").queryName("usage").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert run.exception() is None


def test_files_and_models(spark, tmp_path):
    df = spark.createDataFrame([(1, "Frage; eins\nzwei"), (2, None)], "id bigint, text string")
    files.write_json(df, str(tmp_path / "j"))
    assert rows(spark.read.schema(df.schema).json(str(tmp_path / "j"))) == rows(df)
    files.write_review(df, str(tmp_path / "r"))
    back = files.read_review(spark, str(tmp_path / "r"))
    assert back.count() == 2 and back.where("human_correctness_raw IS NOT NULL").count() == 0
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.bin").write_bytes("eins\fzwei\fdrei".encode())
    (tmp_path / "docs" / "b.bin").write_bytes(b"\xff")
    pages = files.extracted_pages(spark, str(tmp_path / "docs"), lambda b: b.decode().split("\f"), 2)
    assert sorted(r.text for r in pages.where("error IS NULL").collect()) == ["drei", "zwei"] and pages.where("error IS NOT NULL").count() == 1
    image = spark.createDataFrame([("a ![x](y) b ![z](w) c", ["eins", None])], "t string, d array<string>")
    assert image.select(files.with_images("t", "d")).first()[0] == "a \n[BILD-INFO: eins]\n b  c"
    asked = spark.createDataFrame([(1, "Der Baum ist grün. Der Takt ist kurz.\n\nWas ist der Takt?"), (2, None)], "id bigint, p string")
    step = lambda d: models.completed(d, "id", "p", models.OfflineProvider, 1)
    for _ in range(2):
        out = models.resumed(asked, "id", step, str(tmp_path / "out"), str(tmp_path / "log"))
        assert [(r.id, r.result) for r in out.collect()] == [(1, "Der Takt ist kurz.")]
    assert models.embedded(df, "id", "text", models.OfflineProvider).where("embedding IS NULL").count() == 1
