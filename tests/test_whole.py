"""Queries do their whole job where tables are longer, larger or later than a cut would show."""

import datetime as dt
import random

from pruefwerk.operators import calllog, sampling
from pruefwerk.plans import QUERIES


def test_token_estimate_takes_the_whole_context(spark, tmp_path):
    answers = [(1, "q" * 100, "c" * 1500), (2, "q" * 100, "c" * 2600), (3, "q" * 100, None)]
    spark.createDataFrame(answers, "answer_id bigint, question string, retrieved_context string").write.parquet(str(tmp_path / "answers.parquet"))
    got = {r.answer_id: r.tokens for r in QUERIES["token_estimate"](spark, str(tmp_path)).collect()}
    assert got == {1: 1680, 2: 2010, 3: 1230}


def test_sample_review_grows_with_the_questions(spark, tmp_path):
    at = dt.datetime(2025, 1, 1)
    for n, wanted in ((10, 10), (40, 15), (1000, 300)):
        answers = [(3 * i + j, f"q{i}", s, "a", "c", at) for i in range(n) for j, s in enumerate(("baseline", "rag_semantic", "rag_raw"))]
        answers += [(3 * n + i, f"only{i}", "baseline", "a", None, at) for i in range(50)]
        schema = "answer_id bigint, question_id string, system string, answer string, retrieved_context string, answered_at timestamp_ntz"
        spark.createDataFrame(answers, schema).write.parquet(str(tmp_path / str(n) / "answers.parquet"))
        got = QUERIES["sample_review"](spark, str(tmp_path / str(n))).collect()
        ids = {r.question_id for r in got}
        assert len(got) == len(ids) == wanted and not any(i.startswith("only") for i in ids)
        drawn = max(r.draw for r in got)
        assert QUERIES["align_answers"](spark, str(tmp_path / str(n))).where(f"md5(concat('42|', baseline_id)) <= '{drawn}'").count() == wanted


CALLS = "call_id bigint, model string, ts timestamp_ntz, total_tokens int"


def _folded(calls, limit):
    starts, recent, clock = {}, {}, {}
    for i, model, ts, tokens in sorted(calls, key=lambda c: (c[2], c[0])):
        need, now = min(tokens or 0, limit - 1), max(clock.get(model, 0.0), ts.replace(tzinfo=dt.timezone.utc).timestamp())
        kept = recent.setdefault(model, [])
        while sum(n for s, n in kept if s > now - 60) + need > limit:
            now = min(s for s, _ in kept if s > now - 60) + 60
        kept[:] = [k for k in kept if k[0] > now - 60] + [(now, need)]
        starts[i] = clock[model] = now
    return starts


def test_admission_goes_on_after_midnight(spark):
    late = dt.datetime(2025, 1, 1, 23, 59, 30)
    calls = [(i, "m", late + dt.timedelta(seconds=s), 10) for i, s in enumerate([0, 1, 2, 3, 40, 41, 300])] + [(7, "m", None, 10)]
    got = {r.call_id: r.start_s for r in calllog.admitted(spark.createDataFrame(calls, CALLS), 20).collect()}
    first = late.replace(tzinfo=dt.timezone.utc).timestamp()
    assert [None if got[i] is None else got[i] - first for i in range(8)] == [0, 1, 60, 61, 120, 121, 300, None]


def test_admission_by_spans_is_the_fold_of_a_model(spark):
    rnd, start = random.Random(3), dt.datetime(2025, 1, 1, 20)
    calls = []
    for model, mean in (("calm", 20), ("even", 9), ("busy", 5.6), ("above", 4)):
        at = 0.0
        for _ in range(1500):
            at += rnd.expovariate(1 / mean) * (20 if rnd.random() < 0.01 else 1)
            calls.append((len(calls), model, start + dt.timedelta(seconds=round(at, 3)), 150 if rnd.random() < 0.01 else rnd.randint(1, 18)))
    df = spark.createDataFrame(calls, CALLS)
    got = {r.call_id: r.start_s for r in calllog.admitted(df, 100).collect()}
    assert got == _folded(calls, 100)
    timed = df.selectExpr("model", f"floor({calllog.EPOCH} / 60e6) AS minute", "cast(least(total_tokens, 99) AS bigint) AS need")
    spans = {r.model: r["count"] for r in calllog._spans(timed, 100).select("model", "span").distinct().groupBy("model").count().collect()}
    assert spans["calm"] > 100 and spans["even"] > 10


def test_quota_limits_before_the_shuffle(spark):
    df = spark.createDataFrame([(i, "abc"[min(i % 10, 2)]) for i in range(3000)], "id bigint, kind string")
    got = sampling.balanced_quota(df, "kind", "id", 50, ["a", "b", "c"])
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()
    assert {r.kind: r["count"] for r in got.groupBy("kind").count().collect()} == {"a": 17, "b": 17, "c": 16}
