"""Alignment of systems, canonical context, claims and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import BLANKS, any_page_marker, reference_ends

SYSTEMS = ("baseline", "rag_semantic", "rag_raw")
OVERLAP_SHARE = 0.6


def last_per_key(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Of the rows of a key the last by ``order``; aggregated before the shuffle, so that a hot key is no burden."""
    rest = [c for c in df.columns if c not in keys]
    kept = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row"))
    return kept.select(*keys, "row.*")


def aligned(answers: DataFrame) -> DataFrame:
    """A row for each baseline answer with the last answers of the other systems to its question, where all have one.

    Repeated runs of the baseline stay rows of their own.
    """
    own = answers.select("question_id", "system", "answer_id", "answer", "answered_at")
    last = last_per_key(own.where(F.col("system").isin(*SYSTEMS[1:])), ["question_id", "system"], "answered_at", "answer_id")
    of = lambda system, column: F.max(F.when(F.col("system") == system, F.col(column)))
    others = last.groupBy("question_id").agg(*(of(s, c).alias(f"{s}_{n}") for s in SYSTEMS[1:] for c, n in (("answer_id", "id"), ("answer", "answer"))))
    base = own.where(F.col("system") == SYSTEMS[0]).select("question_id", F.col("answer_id").alias("baseline_id"), F.col("answer").alias("baseline_answer"))
    joined = base.join(others.where(" AND ".join(f"{s}_id IS NOT NULL" for s in SYSTEMS[1:])), "question_id")
    return joined.select("question_id", *(f"{s}_id" for s in SYSTEMS), *(f"{s}_answer" for s in SYSTEMS))


def missing_systems(answers: DataFrame) -> DataFrame:
    """``question_id, system`` of the answers that are still to be made."""
    questions = answers.select("question_id").distinct()
    wanted = questions.select("question_id", F.explode(F.array(*map(F.lit, SYSTEMS))).alias("system"))
    return wanted.join(answers.select("question_id", "system").distinct(), ["question_id", "system"], "left_anti")


def page_texts(pages: DataFrame) -> DataFrame:
    """``script_id, page_number, page_text``: of pages read again the last, with its image descriptions."""
    last = last_per_key(pages.select("script_id", "page_number", "page_id", "text", "image_descriptions", "extracted_at"), ["script_id", "page_number"], "extracted_at", "page_id")
    described = F.array_join(F.transform(F.filter("image_descriptions", lambda d: d.isNotNull() & (d != "")), lambda d: F.concat(F.lit("[BILD-INFO: "), d, F.lit("]"))), "\n\n")
    with_images = F.when(F.coalesce(F.col("text"), F.lit("")) == "", described).otherwise(F.concat("text", F.lit("\n\n"), described))
    has_images = F.coalesce(F.size("image_descriptions"), F.lit(0)) > 0
    return last.select("script_id", "page_number", F.when(has_images, with_images).otherwise(F.coalesce("text", F.lit(""))).alias("page_text"))


def canonical_context(references: DataFrame, chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """``key, n_pages, context``: the pages around a source reference, one page more on either side.

    ``references``: ``key, script_id, source_reference``. The range of pages is exploded and joined by equality.
    """
    first, last = reference_ends(F.col("source_reference"))
    ends = references.select("key", "script_id", first.alias("first_id"), last.alias("last_id")).where("first_id <> ''")
    page = chunks.select("script_id", "chunk_id", F.coalesce("page_number", any_page_marker(F.col("content"))).alias("page"))
    start = page.select("script_id", F.col("chunk_id").alias("first_id"), F.col("page").alias("first_page"))
    end = page.select("script_id", F.col("chunk_id").alias("last_id"), F.col("page").alias("last_page"))
    spans = ends.join(start, ["script_id", "first_id"]).where("first_page IS NOT NULL").join(end, ["script_id", "last_id"], "left")
    low, high = F.greatest(F.lit(1), F.col("first_page") - 1), F.coalesce("last_page", "first_page") + 1
    each = spans.where(low <= high).select("key", "script_id", F.explode(F.sequence(low, high)).alias("page_number"))
    found = each.join(page_texts(pages), ["script_id", "page_number"])
    ordered = found.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("page_number", "page_text"))).alias("p"))
    return ordered.select("key", F.size("p").cast("bigint").alias("n_pages"), F.array_join(F.col("p.page_text"), "\n\n").alias("context"))


def claims_of(text: Column) -> Column:
    """Sentences and lines of a text, by the offline way of making claims."""
    trimmed = lambda c: F.regexp_replace(F.regexp_replace(c, f"^{BLANKS}+", ""), f"{BLANKS}+$", "")
    return F.filter(F.transform(F.split(text, r"[.!?][ \t\n\x0B\f\r]|\n"), trimmed), lambda c: c != "")


def claims(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, claim_index, claim`` of every claim of a text."""
    return df.where(F.col(text).isNotNull()).select(key, F.posexplode(claims_of(F.col(text))).alias("claim_index", "claim"))


def token_set(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[a-zäöüß0-9]+"), F.lit(0)))


def is_supported(claim: Column, reference: Column) -> Column:
    """The offline verdict: enough of the claim's words are words of the reference; null where either has none."""
    own = token_set(claim)
    return F.when(F.size(own) > 0, F.size(F.array_intersect(own, reference)) / F.size(own) >= OVERLAP_SHARE)


def judged_claims(df: DataFrame, key: str, statement: str, reference: str, *carried: str) -> DataFrame:
    """``key, claim_index, claim, verdict, category`` of every claim of ``statement`` against ``reference``.

    ``df`` also has ``question``; the columns ``carried`` come along. Category C repeats the question, B calculates, A states a fact.
    """
    tokens = [token_set(F.coalesce(F.col(c), F.lit(""))).alias(f"{name}_tokens") for name, c in (("reference", reference), ("question", "question"))]
    # what a claim is held against goes along with it, so that there is nothing to join
    joined = df.where(F.col(statement).isNotNull()).select(key, *carried, *tokens, F.posexplode(claims_of(F.col(statement))).alias("claim_index", "claim"))
    own = token_set(F.col("claim"))
    repeats = (F.size(own) > 0) & (F.size(F.array_except(own, F.col("question_tokens"))) == 0)
    category = F.when(repeats, "C").when(F.col("claim").rlike("[0-9]") & F.col("claim").rlike(r"[=+*/]"), "B").otherwise("A")
    return joined.select(key, *carried, "claim_index", "claim", is_supported(F.col("claim"), F.col("reference_tokens")).alias("verdict"), category.alias("category"))


def proportional(judged: DataFrame, *keys: str) -> DataFrame:
    """``keys, n_claims, n_supported, score`` and the claims of each category; a missing verdict isn't support."""
    counts = judged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_claims"), F.count_if("verdict").alias("n_supported"),
        *(F.count_if(F.col("category") == c).alias(f"n_{c.lower()}") for c in "ABC"),
    )
    return counts.withColumn("score", F.try_divide("n_supported", "n_claims"))


def likert(evaluations: DataFrame) -> DataFrame:
    """``eval_id, n_votes, score, disagreement`` of position-swapped votes from 1 to 5."""
    votes = F.filter("raw_scores", lambda v: v.isNotNull())
    score = F.try_divide(F.aggregate(votes, F.lit(0.0), lambda a, v: a + (v - 1) / 4), F.size(votes))
    apart = F.when(F.size(votes) >= 2, F.abs(F.element_at(votes, 1) - F.element_at(votes, 2))).otherwise(F.lit(0))
    return evaluations.where("raw_scores IS NOT NULL").select("eval_id", F.size(votes).cast("bigint").alias("n_votes"), score.alias("score"), apart.cast("bigint").alias("disagreement"))


def scores_wide(evaluations: DataFrame, golden: DataFrame) -> DataFrame:
    """A row for each question with its type and the scores of all systems; of repeated judgements the last."""
    last = last_per_key(evaluations.select("question_id", "system", "metric", "eval_id", "score", "evaluated_at"), ["question_id", "system", "metric"], "evaluated_at", "eval_id")
    of = lambda system, metric: F.max(F.when((F.col("system") == system) & (F.col("metric") == metric), F.col("score")))
    wide = last.groupBy("question_id").agg(
        of("baseline", "correctness").alias("base_corr"), of("rag_semantic", "correctness").alias("sem_corr"), of("rag_raw", "correctness").alias("raw_corr"),
        of("rag_semantic", "faithfulness").alias("sem_faith"), of("rag_raw", "faithfulness").alias("raw_faith"),
    )
    types = last_per_key(golden.select("question_id", "golden_id", "question_type", "requires_context", "created_at"), ["question_id"], "created_at", "golden_id")
    return wide.join(types.select("question_id", "question_type", "requires_context"), "question_id")
