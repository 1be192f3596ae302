"""The registered queries, each over its whole tables. Their SQL counterparts are in ``oracle``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tails
from ..functions import text as X
from ..operators import bootstrap, calllog, chunking, evaluation, retrieval, sampling
from ..operators import statistics as S
from ..sources import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TYPES = ["Definition", "Anwendung", "Transfer"]


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.scores_wide(table(spark, sf_dir, "evaluation_results"), table(spark, sf_dir, "golden"))


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to six digits, so that the order of a sum doesn't show."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "golden")


# retrieval -----------------------------------------------------------------------------------------------------------


def _neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return retrieval.top_k_neighbors(vectors.where("id % 20 = 0"), vectors)


@query
def rag_topk_neighbors(spark, sf_dir):
    return _rounded(_neighbors(spark, sf_dir), 5)


def _indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    centres = retrieval.cells_of(vectors, retrieval.N_CELLS)
    return retrieval.ann_neighbors(vectors.where("id % 20 = 0"), vectors, centres, retrieval.N_PROBE)


@query
def ann_neighbors(spark, sf_dir):
    return _rounded(_indexed(spark, sf_dir), 5)


@query
def ann_recall(spark, sf_dir):
    """The index against the exact neighbours of all queries."""
    return retrieval.recall(_indexed(spark, sf_dir), _neighbors(spark, sf_dir))


@query
def rag_topk_context(spark, sf_dir):
    return retrieval.contexts(_neighbors(spark, sf_dir), table(spark, sf_dir, "documents", F.col("doc_id").alias("vec_id"), "text"))


# text ----------------------------------------------------------------------------------------------------------------


@query
def normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "pages_raw").select("page_id", X.normalize_whitespace(F.col("text")).alias("text"))


@query
def sanitize_latex(spark, sf_dir):
    return table(spark, sf_dir, "answers").select("answer_id", X.sanitize_latex(F.col("answer")).alias("text"))


@query
def collapse_whitespace(spark, sf_dir):
    return table(spark, sf_dir, "chunks").select("chunk_uid", X.collapse_whitespace(F.col("content")).alias("text"))


@query
def post_process(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", X.post_process(F.col("text")).alias("text"))


@query
def page_routing(spark, sf_dir):
    text, images = F.col("text"), F.coalesce(F.size("image_descriptions"), F.lit(0))
    return table(spark, sf_dir, "pages_raw").where("text IS NOT NULL").select(
        "page_id", X.is_math_heavy(text).alias("math_heavy"), X.needs_page_scan(text, images).alias("page_scan"), X.heuristic_valid(text).alias("valid")
    )


@query
def script_references(spark, sf_dir):
    found = X.script_references(F.col("question"))
    return _golden(spark, sf_dir).where("question IS NOT NULL").select("golden_id", F.size(found).cast("bigint").alias("n_references"), F.array_join(found, "|").alias("found"))


@query
def useful_image_descriptions(spark, sf_dir):
    each = table(spark, sf_dir, "pages_raw").select("page_id", F.posexplode("image_descriptions").alias("position", "description"))
    useless = F.trim("description").isin("", "KEINE_INFO", "KEINE_GRAFIK")
    return each.where(F.col("description").isNotNull() & ~useless)


@query
def image_dedup(spark, sf_dir):
    each = useful_image_descriptions(spark, sf_dir).withColumn("hash", F.sha2("description", 256))
    return each.groupBy("hash").agg(F.min(F.struct("page_id", "position")).alias("first"), F.count(F.lit(1)).alias("n")).select("hash", "first.page_id", "first.position", "n")


@query
def token_estimate(spark, sf_dir):
    chars = F.coalesce(F.length("question"), F.lit(0)) + F.coalesce(F.length("retrieved_context"), F.lit(0))
    return table(spark, sf_dir, "answers").select("answer_id", X.token_estimate(chars, 1200).alias("tokens"))


# chunking ------------------------------------------------------------------------------------------------------------


@query
def raw_chunks(spark, sf_dir):
    return chunking.chunks_of(table(spark, sf_dir, "pages_raw"), "page_id", "text", "raw")


@query
def semantic_chunks(spark, sf_dir):
    return chunking.chunks_of(table(spark, sf_dir, "documents"), "doc_id", "text", "semantic")


@query
def chunk_stats(spark, sf_dir):
    length = F.coalesce(F.length("content"), F.lit(0)).cast("bigint")
    return _rounded(table(spark, sf_dir, "chunks").groupBy("script_id", "mode").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.avg(length).alias("mean_chars"), F.max(length).alias("max_chars"), F.count_if(F.col("page_number").isNull()).alias("n_without_page")
    ))


@query
def chunk_page_map(spark, sf_dir):
    return chunking.page_map(table(spark, sf_dir, "chunks").where("mode = 'semantic'"))


@query
def generation_windows(spark, sf_dir):
    return chunking.generation_windows(table(spark, sf_dir, "chunks").where("mode = 'semantic'"))


# alignment and scores ------------------------------------------------------------------------------------------------


@query
def align_answers(spark, sf_dir):
    return evaluation.aligned(table(spark, sf_dir, "answers"))


@query
def resume_pending(spark, sf_dir):
    return evaluation.missing_systems(table(spark, sf_dir, "answers"))


@query
def canonical_context(spark, sf_dir):
    references = _golden(spark, sf_dir).select(F.col("golden_id").alias("key"), "script_id", "source_reference")
    semantic = table(spark, sf_dir, "chunks").where("mode = 'semantic'")
    return evaluation.canonical_context(references, semantic, table(spark, sf_dir, "pages_raw")).withColumnRenamed("key", "golden_id")


@query
def canonical_coverage(spark, sf_dir):
    covered = canonical_context(spark, sf_dir).select("golden_id", F.lit(True).alias("covered"))
    return _rounded(_golden(spark, sf_dir).join(covered, "golden_id", "left").groupBy("question_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("covered").alias("n_covered"), (F.count_if("covered") / F.count(F.lit(1))).alias("share")
    ))


@query
def claims_flat(spark, sf_dir):
    return evaluation.claims(table(spark, sf_dir, "answers"), "answer_id", "answer")


def _faithful(spark, sf_dir):
    answers = table(spark, sf_dir, "answers").where("system <> 'baseline'")
    return evaluation.judged_claims(answers, "answer_id", "answer", "retrieved_context", "system", "question_type")


@query
def faithfulness_proportional(spark, sf_dir):
    return _rounded(evaluation.proportional(_faithful(spark, sf_dir), "answer_id"))


@query
def correctness_proportional(spark, sf_dir):
    answers = table(spark, sf_dir, "answers")
    return _rounded(evaluation.proportional(evaluation.judged_claims(answers, "answer_id", "ground_truth", "answer"), "answer_id"))


@query
def category_distribution(spark, sf_dir):
    judged = _faithful(spark, sf_dir)
    levels = judged.rollup("question_type", "system").agg(
        F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("category") == c).alias(f"n_{c.lower()}") for c in "ABC"),
        F.count_if(~F.col("verdict")).alias("n_unsupported"),
    )
    low, high = S.wilson(F.col("n_c"), F.col("n"))
    return _rounded(levels.withColumn("share_c", F.col("n_c") / F.col("n")).withColumn("share_c_low", low).withColumn("share_c_high", high))


@query
def likert_scores(spark, sf_dir):
    return _rounded(evaluation.likert(table(spark, sf_dir, "evaluation_results", "eval_id", "raw_scores").distinct()))


@query
def scores_wide(spark, sf_dir):
    return _rounded(_wide(spark, sf_dir))


# statistics ----------------------------------------------------------------------------------------------------------


@query
def describe_scores(spark, sf_dir):
    return _rounded(S.described(S.long_scores(_wide(spark, sf_dir)), "measure"))


@query
def describe_by_type(spark, sf_dir):
    return _rounded(S.described(S.long_scores(_wide(spark, sf_dir)), "measure", "question_type"))


@query
def wilcoxon_correctness(spark, sf_dir):
    return _rounded(S.wilcoxon(_wide(spark, sf_dir), "sem_corr", "base_corr"))


@query
def wilcoxon_faithfulness_by_type(spark, sf_dir):
    return _rounded(S.wilcoxon(_wide(spark, sf_dir), "sem_faith", "raw_faith", "question_type"))


@query
def mann_whitney_faithfulness(spark, sf_dir):
    scores = S.long_scores(_wide(spark, sf_dir)).where("measure = 'sem_faith'")
    return _rounded(S.mann_whitney(scores, F.coalesce(F.col("question_type") == "Definition", F.lit(False))))


@query
def friedman_correctness(spark, sf_dir):
    return _rounded(S.friedman(_wide(spark, sf_dir), ["base_corr", "sem_corr", "raw_corr"], "question_type"))


@query
def scheirer_ray_hare(spark, sf_dir):
    scores = S.long_scores(_wide(spark, sf_dir)).where("measure IN ('base_corr', 'sem_corr', 'raw_corr') AND question_type IS NOT NULL")
    return _rounded(S.scheirer_ray_hare(scores.select("measure", "question_type", "score"), "measure", "question_type"))


@query
def spearman_modes(spark, sf_dir):
    return _rounded(S.spearman(_wide(spark, sf_dir), "sem_corr", "raw_corr"))


def _votes(spark, sf_dir):
    votes = table(spark, sf_dir, "evaluation_results", "eval_id", "system", "raw_scores").where("size(raw_scores) >= 2").distinct()
    return votes.select("system", F.col("raw_scores")[0].alias("a"), F.col("raw_scores")[1].alias("b"))


@query
def irr_kappa_quadratic(spark, sf_dir):
    return _rounded(S.weighted_kappa(_votes(spark, sf_dir), 5, "system"))


@query
def kappa_nominal(spark, sf_dir):
    return _rounded(S.nominal_kappa(_votes(spark, sf_dir), "system"))


@query
def classification_metrics(spark, sf_dir):
    return _rounded(S.classification(_votes(spark, sf_dir), "system").withColumn("label", F.col("label").cast("bigint")))


def _hypotheses(spark, sf_dir):
    wide = _wide(spark, sf_dir)
    first = S.wilcoxon(wide, "sem_corr", "base_corr").select(F.lit("H1").alias("test"), "n", "z", "d_z")
    third = S.wilcoxon(wide, "sem_faith", "raw_faith").select(F.lit("H3").alias("test"), "n", "z", "d_z")
    scores = S.long_scores(wide).where("measure = 'sem_faith'")
    second = S.mann_whitney(scores, F.coalesce(F.col("question_type") == "Definition", F.lit(False))).select(F.lit("H2").alias("test"), (F.col("n1") + F.col("n2")).alias("n"), "z", F.lit(None).cast("double").alias("d_z"))
    return first.unionByName(second).unionByName(third)


@query
def hypothesis_report(spark, sf_dir):
    """p, its corrections, and the decisions at the single and at the doubly corrected level."""
    tests = _hypotheses(spark, sf_dir).withColumn("p", tails.normal_sf_of("z"))
    out = S.corrected(tests.select("test", "p")).join(tests.select("test", "n", "z"), "test")
    level = S.ALPHA / 3
    return _rounded(out).withColumn("significant_single", F.col("bonferroni") < S.ALPHA).withColumn("significant_reference", F.col("bonferroni") < level)


@query
def power_mdes(spark, sf_dir):
    level = F.lit(S.ALPHA / 3)
    return _hypotheses(spark, sf_dir).where("d_z IS NOT NULL").select("test", "n", "d_z", tails.power_of("d_z", "n", level).alias("power"), tails.least_effect_of("n", level).alias("mdes"))


@query
def bootstrap_means(spark, sf_dir):
    return bootstrap.bootstrap_mean(S.long_scores(_wide(spark, sf_dir)), "measure", "score")


@query
def pvalue_corrections(spark, sf_dir):
    """Corrections over the share of tied pairs of each question type, taken as p values."""
    shares = S.wilcoxon(_wide(spark, sf_dir), "sem_corr", "raw_corr", "question_type").where("question_type IS NOT NULL")
    return _rounded(S.corrected(shares.select(F.col("question_type").alias("test"), (F.col("n_ties") / F.col("n")).alias("p"))))


# samples -------------------------------------------------------------------------------------------------------------


@query
def sample_review(spark, sf_dir):
    """Of the questions that all systems answered, the share that the reference gives to a person to review."""
    questions = evaluation.aligned(table(spark, sf_dir, "answers"))
    return sampling.random_share(questions, "baseline_id", sampling.review_size)


@query
def sample_stratified(spark, sf_dir):
    return sampling.stratified_sample(_golden(spark, sf_dir).where("question_type IS NOT NULL").select("golden_id", "question_type"), "question_type", "golden_id")


@query
def quota_balanced(spark, sf_dir):
    usable = _golden(spark, sf_dir).where("requires_context").select("golden_id", "question_type")
    return sampling.balanced_quota(usable, "question_type", "golden_id", 50, TYPES)


# call log ------------------------------------------------------------------------------------------------------------


def _calls(spark, sf_dir):
    return calllog.calls_once(table(spark, sf_dir, "api_calls"))


@query
def usage_rollup(spark, sf_dir):
    return _rounded(calllog.usage_rollup(_calls(spark, sf_dir)))


@query
def sliding_token_usage(spark, sf_dir):
    return calllog.sliding_tokens(_calls(spark, sf_dir))


@query
def call_log_windows(spark, sf_dir):
    return calllog.hourly(_calls(spark, sf_dir))


@query
def token_budget_admission(spark, sf_dir):
    return calllog.admitted(_calls(spark, sf_dir))
