"""Registered queries of test reports, sub-populations, fallbacks and listings, with their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.text import page_marker
from ..operators import bootstrap, evaluation
from ..operators import statistics as S
from ..sources import files, table
from ..sources.files import cropped
from .catalogue import _golden, _rounded, _votes, _wide, canonical_context, query
from .oracle import ORACLE, PAGES, SCORES, VOTES, claims, wilcoxon

# p values ------------------------------------------------------------------------------------------------------------


@query
def wilcoxon_p_by_type(spark, sf_dir):
    return _rounded(S.wilcoxon_p(_wide(spark, sf_dir), "sem_corr", "base_corr", "question_type"))


@query
def mann_whitney_p(spark, sf_dir):
    scores = S.long_scores(_wide(spark, sf_dir)).where("measure = 'sem_faith'")
    return _rounded(S.mann_whitney_p(scores, F.coalesce(F.col("question_type") == "Definition", F.lit(False))))


@query
def scheirer_ray_hare_p(spark, sf_dir):
    scores = S.long_scores(_wide(spark, sf_dir)).where("measure IN ('base_corr', 'sem_corr', 'raw_corr') AND question_type IS NOT NULL")
    return _rounded(S.scheirer_ray_hare_p(scores.select("measure", "question_type", "score"), "measure", "question_type"))


@query
def spearman_p(spark, sf_dir):
    """Student's tail is summed up over a grid here and in the SQL, hence three digits of p."""
    return _rounded(S.spearman_p(_wide(spark, sf_dir), "sem_corr", "raw_corr")).withColumn("p", F.round("p", 3))


@query
def shapiro_flags(spark, sf_dir):
    return _rounded(S.shapiro(S.long_scores(_wide(spark, sf_dir)), "measure"))


@query
def bootstrap_paired_differences(spark, sf_dir):
    pairs = {"H1": ("sem_corr", "base_corr"), "H3": ("sem_faith", "raw_faith")}
    return bootstrap.bootstrap_paired_difference(_wide(spark, sf_dir), pairs)


def _ratings(spark, sf_dir) -> DataFrame:
    """``system, score, likert`` of the questions that were judged both ways; of repeated judgements the last."""
    rows = table(spark, sf_dir, "evaluation_results", "question_id", "system", "metric", "eval_id", "score", "evaluated_at")
    last = evaluation.last_per_key(rows, ["question_id", "system", "metric"], "evaluated_at", "eval_id")
    of = lambda metric: F.max(F.when(F.col("metric") == metric, F.col("score")))
    return last.groupBy("question_id", "system").agg(of("correctness").alias("score"), of("correctness_likert").alias("likert")).dropna()


@query
def rating_validation(spark, sf_dir):
    """For each system how the scores by claims agree with the scores by votes; under three pairs there is no row."""
    ratings = _ratings(spark, sf_dir)
    return _rounded(S.spearman_by(ratings, "score", "likert", "system").where("n >= 3"))


@query
def bootstrap_spearman(spark, sf_dir):
    return bootstrap.bootstrap_spearman(_ratings(spark, sf_dir), "system", "score", "likert")


# sub-populations -----------------------------------------------------------------------------------------------------


@query
def sensitivity_report(spark, sf_dir):
    """H1 and H3 on all questions and on sub-populations of them, which have five pairs at least and aren't all."""
    last = evaluation.last_per_key(_golden(spark, sf_dir).select("question_id", "golden_id", "created_at"), ["question_id"], "created_at", "golden_id")
    covered = last.join(canonical_context(spark, sf_dir).select("golden_id"), "golden_id").select("question_id", F.lit(True).alias("canonical"))
    flagged = _wide(spark, sf_dir).join(covered, "question_id", "left")
    subsets = F.array_compact(F.array(F.lit("all"), F.when(F.col("requires_context"), "requires_context"), F.when(~F.col("requires_context"), "no_context"), F.when(F.col("canonical"), "canonical")))
    each = flagged.withColumn("subset", F.explode(subsets))
    out = None
    for test, x, y in (("H1", "sem_corr", "base_corr"), ("H3", "sem_faith", "raw_faith")):
        rows = S.wilcoxon(each, x, y, "subset").select(F.lit(test).alias("test"), "subset", "n", "n_ties", "mean_diff", "d_z", "w_plus", "z", "rank_biserial")
        out = rows if out is None else out.unionByName(rows)
    total = out.where("subset = 'all'").select("test", F.col("n").alias("n_all"))
    return _rounded(out.join(F.broadcast(total), "test").where("n >= 5 AND (subset = 'all' OR n < n_all)").drop("n_all"))


@query
def score_coverage(spark, sf_dir):
    """For each measure how many questions have it, and whether these are under 95 %."""
    wide = _wide(spark, sf_dir)
    counts = wide.agg(F.count(F.lit(1)).alias("n_all"), *(F.count(m).alias(m) for m in S.SCORES))
    each = counts.select("n_all", F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).alias("n")) for m in S.SCORES))).alias("m")).select("m.measure", "m.n", "n_all")
    share = F.col("n") / F.col("n_all")
    return _rounded(each.select("measure", "n", (F.col("n_all") - F.col("n")).alias("n_missing"), share.alias("share"), (share < 0.95).alias("warn")))


# contexts, claims and answers ----------------------------------------------------------------------------------------


@query
def judged_context(spark, sf_dir):
    """What an answer with a context is judged against: the canonical context of its question, else what was retrieved."""
    last = evaluation.last_per_key(_golden(spark, sf_dir).select("question_id", "golden_id", "created_at"), ["question_id"], "created_at", "golden_id")
    known = last.join(canonical_context(spark, sf_dir).select("golden_id", F.col("context").alias("canonical")), "golden_id").select("question_id", "canonical")
    answers = table(spark, sf_dir, "answers", "answer_id", "question_id", "system", "retrieved_context").where("system <> 'baseline'")
    own = F.nullif(F.col("canonical"), F.lit(""))
    return answers.join(known, "question_id", "left").select("answer_id", F.coalesce(own, "retrieved_context").alias("context"), own.isNotNull().alias("canonical_context_used"))


@query
def answers_with_context(spark, sf_dir):
    """Answers made from a context; those whose context is missing or blank are no record."""
    return table(spark, sf_dir, "answers", "answer_id", "question_id", "system", "question", "answer", "retrieved_context").where("system <> 'baseline'").where(F.col("retrieved_context").rlike(r"\S"))


def padded(values, n, fill):
    """An array cut or filled up to ``n``."""
    return F.slice(F.concat(values, F.array_repeat(F.lit(fill), F.greatest(n, F.lit(1)))), F.lit(1), n)


@query
def claim_verdict_pad(spark, sf_dir):
    """Numbered claims, with a verdict and a category for each: missing verdicts are no support, missing categories A."""
    answers = table(spark, sf_dir, "answers", "answer_id", "question", "answer", "retrieved_context").where("answer IS NOT NULL")
    made = answers.select("answer_id", evaluation.claims_of(F.col("answer")).alias("claims"), evaluation.token_set(F.coalesce("retrieved_context", F.lit(""))).alias("tokens"))
    said = F.filter(F.transform("claims", lambda c: evaluation.is_supported(c, F.col("tokens"))), lambda v: v.isNotNull())
    n = F.size("claims")
    labels = F.filter(F.transform("claims", lambda c: F.when(c.rlike("[0-9]"), "B")), lambda c: c.isNotNull())
    numbered = F.array_join(F.transform("claims", lambda c, i: F.concat((i + 1).cast("string"), F.lit(". "), c)), "\n")
    verdicts = F.array_join(F.transform(padded(said, n, False), lambda v: F.when(v, "1").otherwise("0")), "")
    return made.select("answer_id", n.cast("bigint").alias("n_claims"), numbered.alias("numbered"), verdicts.alias("verdicts"), F.array_join(padded(labels, n, "A"), "").alias("categories"))


@query
def page_text_from_chunks(spark, sf_dir):
    """Pages as the semantic chunks have them, by their page number, else by the first marker; without either, no page."""
    chunks = table(spark, sf_dir, "chunks", "script_id", "mode", "chunk_index", "content", "page_number").where("mode = 'semantic' AND content IS NOT NULL")
    paged = chunks.withColumn("page", F.coalesce("page_number", page_marker(F.col("content")))).where("page IS NOT NULL")
    pages = paged.groupBy("script_id", "page").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))).alias("c"))
    return pages.select("script_id", "page", F.size("c").cast("bigint").alias("n_chunks"), F.trim(F.array_join(F.col("c.content"), "\n\n")).alias("text"))


@query
def crop_margins(spark, sf_dir):
    return cropped(table(spark, sf_dir, "pages_raw", "page_id", "text").where("text IS NOT NULL"), 0.0, 0.1)


# labels --------------------------------------------------------------------------------------------------------------


@query
def label_dissent(spark, sf_dir):
    """Judgements whose two votes differ, with the beginning of their reason, as in a listing for a person."""
    rows = table(spark, sf_dir, "evaluation_results", "eval_id", "system", "raw_scores", "reasoning").where("size(raw_scores) >= 2").distinct()
    first, second = F.col("raw_scores")[0], F.col("raw_scores")[1]
    return rows.where(first != second).select("eval_id", "system", first.alias("a"), second.alias("b"), F.left("reasoning", F.lit(90)).alias("reason"))


@query
def category_robustness(spark, sf_dir):
    """Whether two votes agree well enough: seven of ten equal, and kappa 0.6 or none."""
    kappa = S.nominal_kappa(_votes(spark, sf_dir), "system")
    robust = (F.col("agreement") >= 0.7) & (F.col("kappa").isNull() | (F.col("kappa") >= 0.6))
    return _rounded(kappa.withColumn("robust", robust))


@query
def type_counts(spark, sf_dir):
    """Questions of each type, and those of them that need no context."""
    return _golden(spark, sf_dir).groupBy("question_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("requires_context", F.lit(True))).alias("n_counted"), F.count_if(~F.col("requires_context")).alias("n_general")
    )


@query
def validation_rows(spark, sf_dir):
    """What a validation sheet holds of each judgement with two votes."""
    rows = table(spark, sf_dir, "evaluation_results", "eval_id", "system", "raw_scores", "reasoning").where("size(raw_scores) >= 2").distinct()
    return files.validation_sheet(rows.select("eval_id", "system", F.col("raw_scores")[0].alias("machine"), F.col("raw_scores")[1].alias("human")), "machine", "human")


@query
def irr_pooled(spark, sf_dir):
    return _rounded(S.weighted_kappa(_votes(spark, sf_dir), 5))


@query
def model_route(spark, sf_dir):
    """Which model is to clean a page, and what it is sent: short pages pass as they are, others up to 12,000 characters."""
    pages = table(spark, sf_dir, "pages_raw", "page_id", "text").where("text IS NOT NULL")
    route = F.when(F.length("text") < 50, "none").when(X.is_math_heavy(F.col("text")), "advanced").otherwise("plain")
    return pages.select("page_id", route.alias("route"), F.when(F.length("text") < 50, F.col("text")).otherwise(F.left("text", F.lit(12_000))).alias("sent"))


INSTRUCTIONS = {"Definition": "Definieren Sie knapp.", "Anwendung": "Zeigen Sie die Anwendung Schritt für Schritt.", "Transfer": "Begründen Sie die Übertragung."}


@query
def answer_prompts(spark, sf_dir):
    """A prompt for each question by its type; an unknown type has no instruction of its own."""
    known = spark.createDataFrame(list(INSTRUCTIONS.items()), "question_type string, instruction string")
    joined = _golden(spark, sf_dir).where("question IS NOT NULL").join(F.broadcast(known), "question_type", "left")
    return joined.select("golden_id", F.concat_ws("\n", F.nullif(F.coalesce("instruction", F.lit("")), F.lit("")), "question").alias("prompt"))


@query
def justifications(spark, sf_dir):
    """The score of an answer by its claims in words."""
    judged = evaluation.judged_claims(table(spark, sf_dir, "answers"), "answer_id", "ground_truth", "answer")
    counts = evaluation.proportional(judged, "answer_id")
    return counts.select("answer_id", F.format_string("%d von %d Aussagen belegt (A %d, B %d, C %d)", "n_supported", "n_claims", "n_a", "n_b", "n_c").alias("justification"))


# SQL -----------------------------------------------------------------------------------------------------------------


def normal_sf(z: str) -> str:
    """The upper tail of the normal distribution by its series."""
    terms = f"list_prepend({{'t': ({z})::DOUBLE, 's': ({z})::DOUBLE}}, list_transform(range(1, 400), lambda k: {{'t': k::DOUBLE, 's': 0::DOUBLE}}))"
    fold = f"list_reduce({terms}, lambda a, k: {{'t': a.t * ({z}) ^ 2 / (2 * k.t + 1), 's': a.s + a.t * ({z}) ^ 2 / (2 * k.t + 1)}}).s"
    return f"CASE WHEN abs({z}) > 25 THEN ({z} < 0)::INT ELSE 0.5 - exp(-(({z}) ^ 2) / 2) / sqrt(2 * pi()) * {fold} END"


LAST_GOLDEN = "lg AS (SELECT question_id, golden_id FROM golden QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY created_at DESC, golden_id DESC) = 1)"
RATINGS = """l AS (SELECT DISTINCT question_id, system, metric, eval_id, score, evaluated_at FROM evaluation_results),
m AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY question_id, system, metric ORDER BY evaluated_at DESC, eval_id DESC) = 1),
p AS (SELECT question_id, system, round(max(score) FILTER (metric = 'correctness'), 9) AS x, round(max(score) FILTER (metric = 'correctness_likert'), 9) AS y FROM m GROUP BY question_id, system HAVING x IS NOT NULL AND y IS NOT NULL)"""
SUBSETS = f"""{PAGES.strip()}, {LAST_GOLDEN}, sub AS (SELECT 'all' AS subset, * FROM w UNION ALL SELECT 'requires_context', * FROM w WHERE requires_context
UNION ALL SELECT 'no_context', * FROM w WHERE NOT requires_context UNION ALL SELECT 'canonical', * FROM w WHERE question_id IN (SELECT question_id FROM lg JOIN ctx USING (golden_id)))"""


def _sensitivity() -> str:
    parts = []
    for test, x, y in (("H1", "sem_corr", "base_corr"), ("H3", "sem_faith", "raw_faith")):
        own = wilcoxon(x, y, "subset")
        head, rest = own.split(", d AS (SELECT subset,", 1)
        rest = rest.replace(" FROM w WHERE", " FROM sub WHERE", 1)
        parts.append(f"SELECT '{test}' AS test, subset, n, n_ties, mean_diff, d_z, w_plus, z, rank_biserial FROM ({head}, {SUBSETS}, d AS (SELECT subset,{rest})")
    return f"WITH u AS ({' UNION ALL '.join(parts)}) SELECT u.* FROM u JOIN u t ON t.test = u.test AND t.subset = 'all' WHERE u.n >= 5 AND (u.subset = 'all' OR u.n < t.n)"


STRIPPED = r"regexp_replace(regexp_replace({0}, '^[\s\x0B\x1C-\x1F\x{{85}}\p{{Z}}]+', ''), '[\s\x0B\x1C-\x1F\x{{85}}\p{{Z}}]+$', '')"
EMITTED = f"CASE WHEN {STRIPPED.format('a.buf')} <> '' THEN list_append(a.out, {STRIPPED.format('a.buf')}) ELSE a.out END"
OP = "{{'out': []::VARCHAR[], 'buf': '', 'flush': {0}, 'x': {1}}}"
SEMANTIC = rf"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '
(#{{1,3}} )', chr(57344) || chr(10) || '\1', 'g'), chr(57344)), lambda x: {STRIPPED.format('x')}), lambda x: x <> '') AS ss FROM documents WHERE text IS NOT NULL AND text <> ''),
o AS (SELECT doc_id, list_append(flatten(list_transform(ss, lambda x: CASE WHEN length(x) <= 2400 THEN [{OP.format('false', 'x')}] ELSE
list_concat([{OP.format('true', "''")}], list_transform(list_filter(string_split_regex(x, '

+'), lambda p: {STRIPPED.format('p')} <> ''), lambda p: {OP.format('false', 'p')}), [{OP.format('true', "''")}]) END)), {OP.format('true', "''")}) AS ops FROM s),
r AS (SELECT doc_id, list_reduce(list_prepend({OP.format('false', "''")}, ops), lambda a, e: {{
'out': CASE WHEN e.flush OR length(a.buf) + length(e.x) > 1200 THEN {EMITTED} ELSE a.out END,
'buf': CASE WHEN e.flush THEN '' WHEN length(a.buf) + length(e.x) > 1200 THEN right(a.buf, 150) || chr(10) || chr(10) || e.x ELSE a.buf || chr(10) || chr(10) || e.x END, 'flush': false, 'x': ''}}).out AS cs FROM o)
SELECT doc_id, 'semantic' AS mode, unnest(range(len(cs)))::INT AS chunk_index, 'chunk_' || unnest(range(len(cs))) AS chunk_id, unnest(cs) AS content FROM r"""
RAW_Z = {
    "H1": wilcoxon("sem_corr", "base_corr").replace("round(z, 6) AS z", "z AS zz"), "H3": wilcoxon("sem_faith", "raw_faith").replace("round(z, 6) AS z", "z AS zz"),
    "H2": ORACLE["mann_whitney_faithfulness"].replace("round((u - n1 * n2 / 2.0 - 0.5)", "((u - n1 * n2 / 2.0 - 0.5)").replace(", 6) AS z", ") AS zz").replace("SELECT n1, n2,", "SELECT n1 + n2 AS n,"),
}
HYPOTHESES = " UNION ALL ".join(f"SELECT '{test}' AS test, n, zz, {normal_sf('zz')} AS p FROM ({sql})" for test, sql in RAW_Z.items())
PARTS = claims("answer_id", "answer", "answers").split("unnest(p) AS claim FROM ", 1)[1]
WORDS = "list_distinct(regexp_extract_all(lower({0}), '[a-zäöüß0-9]+'))"

ORACLE |= {
    "semantic_chunks": SEMANTIC,
    "hypothesis_report": f"""WITH h AS ({HYPOTHESES}), r AS (SELECT *, row_number() OVER (ORDER BY p, test) AS pos FROM h),
c AS (SELECT test, n, zz, p, least(1.0, p * 3) AS bonferroni, least(1.0, max((4 - pos) * p) OVER (ORDER BY p, test)) AS holm, least(1.0, min(3 / pos::DOUBLE * p) OVER (ORDER BY p DESC, test DESC)) AS bh FROM r)
SELECT test, round(p, 6) AS p, round(bonferroni, 6) AS bonferroni, round(holm, 6) AS holm, round(bh, 6) AS bh, n, round(zz, 6) AS z, round(bonferroni, 6) < 0.05 AS significant_single, round(bonferroni, 6) < 0.05 / 3 AS significant_reference FROM c""",
    "wilcoxon_p_by_type": f"SELECT question_type, n, w_plus, z, round({normal_sf('zz')}, 6) AS p FROM ({wilcoxon('sem_corr', 'base_corr', 'question_type').replace('round(z, 6) AS z', 'round(z, 6) AS z, z AS zz')})",
    "mann_whitney_p": f"""WITH q AS ({ORACLE['mann_whitney_faithfulness'].replace('round(2 * u /', '(u - n1 * n2 / 2.0 - 0.5) / sqrt(n1 * n2 / 12.0 * (n + 1 - ties / (n * (n - 1)))) AS zz, round(2 * u /')})
SELECT n1, n2, u, z, round({normal_sf('zz')}, 6) AS p FROM q""",
    "scheirer_ray_hare_p": f"WITH q AS ({ORACLE['scheirer_ray_hare']}) SELECT effect, h, df, round(exp(-h / 2) * CASE df WHEN 2 THEN 1 WHEN 4 THEN 1 + h / 2 END, 6) AS p FROM q",
    "spearman_p": f"""WITH q AS ({ORACLE['spearman_modes']}), g AS (SELECT (i + 0.5) * pi() / 2000000 AS a FROM range(1000000) t(i))
SELECT q.*, (SELECT round(sum(CASE WHEN a > atan(abs(rho) / sqrt(1 - rho ^ 2)) THEN cos(a) ^ (n - 3) ELSE 0 END) / sum(cos(a) ^ (n - 3)), 3) FROM g) AS p FROM q""",
    "rating_validation": f"""WITH {RATINGS}, r AS (SELECT *, rank() OVER (PARTITION BY system ORDER BY x) + (count(*) OVER (PARTITION BY system, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY system ORDER BY y) + (count(*) OVER (PARTITION BY system, y) - 1) / 2.0 AS ry FROM p),
s AS (SELECT system, count(*) AS n, corr(rx, ry) AS rho, avg(abs(x - y)) AS mae FROM r GROUP BY system)
SELECT system, n, round(rho, 6) AS rho, round(tanh(atanh(rho) - 1.959963984540054 / sqrt(n - 3)), 6) AS rho_low, round(tanh(atanh(rho) + 1.959963984540054 / sqrt(n - 3)), 6) AS rho_high, round(mae, 6) AS mae FROM s WHERE n >= 3""",
    "sensitivity_report": _sensitivity(),
    "score_coverage": f"""WITH {SCORES}, c AS (SELECT count(*) AS n_all, count(base_corr) AS base_corr, count(sem_corr) AS sem_corr, count(raw_corr) AS raw_corr, count(sem_faith) AS sem_faith, count(raw_faith) AS raw_faith FROM w),
u AS (UNPIVOT c ON base_corr, sem_corr, raw_corr, sem_faith, raw_faith INTO NAME measure VALUE n)
SELECT measure, n, n_all - n AS n_missing, round(n / n_all::DOUBLE, 6) AS share, n / n_all::DOUBLE < 0.95 AS warn FROM u""",
    "judged_context": f"""WITH {PAGES.strip()}, {LAST_GOLDEN}, k AS (SELECT question_id, nullif(context, '') AS canonical FROM lg JOIN ctx USING (golden_id))
SELECT answer_id, coalesce(canonical, retrieved_context) AS context, canonical IS NOT NULL AS canonical_context_used FROM answers LEFT JOIN k USING (question_id) WHERE system <> 'baseline'""",
    "answers_with_context": r"SELECT answer_id, question_id, system, question, answer, retrieved_context FROM answers WHERE system <> 'baseline' AND regexp_matches(retrieved_context, '\S')",
    "claim_verdict_pad": f"""WITH c AS (SELECT a.answer_id, p, {WORDS.format("coalesce(retrieved_context, '')")} AS ref FROM {PARTS} q JOIN answers a USING (answer_id)),
v AS (SELECT *, list_filter(list_transform(p, lambda c: CASE WHEN len({WORDS.format('c')}) > 0 THEN len(list_intersect({WORDS.format('c')}, ref)) / len({WORDS.format('c')})::DOUBLE >= 0.6 END), lambda x: x IS NOT NULL) AS said,
list_filter(list_transform(p, lambda c: CASE WHEN regexp_matches(c, '[0-9]') THEN 'B' END), lambda x: x IS NOT NULL) AS labels FROM c)
SELECT answer_id, len(p) AS n_claims, coalesce(array_to_string(list_transform(range(1, len(p) + 1), lambda i: i || '. ' || p[i]), chr(10)), '') AS numbered,
coalesce(array_to_string(list_transform(range(1, len(p) + 1), lambda i: CASE WHEN coalesce(said[i], false) THEN '1' ELSE '0' END), ''), '') AS verdicts,
coalesce(array_to_string(list_transform(range(1, len(p) + 1), lambda i: coalesce(labels[i], 'A')), ''), '') AS categories FROM v""",
    "page_text_from_chunks": r"""WITH c AS (SELECT script_id, chunk_index, content, coalesce(page_number, nullif(regexp_extract(content, '(?m)^###\s+Seite\s+(\d+)\b', 1), '')::INT) AS page FROM chunks WHERE mode = 'semantic' AND content IS NOT NULL)
SELECT script_id, page, count(*) AS n_chunks, trim(string_agg(content, chr(10) || chr(10) ORDER BY chunk_index)) AS text FROM c WHERE page IS NOT NULL GROUP BY script_id, page""",
    "crop_margins": """WITH l AS (SELECT page_id, string_split(text, chr(10)) AS ls FROM pages_raw WHERE text IS NOT NULL)
SELECT page_id, array_to_string(ls[1:len(ls) - floor(len(ls) * 0.1::DOUBLE)::INT], chr(10)) AS text FROM l""",
    "validation_rows": """SELECT DISTINCT eval_id, system, raw_scores[1] AS machine, raw_scores[2] AS human, (raw_scores[1] = raw_scores[2])::INT AS agreement, 'checked by hand' AS note FROM evaluation_results WHERE len(raw_scores) >= 2""",
    "irr_pooled": f"""WITH {VOTES}, p AS (SELECT * FROM v WHERE a BETWEEN 1 AND 5 AND b BETWEEN 1 AND 5), o AS (SELECT count(*) AS n, sum((a - b) ^ 2) AS o, avg(abs(a - b)) AS d, 100.0 * avg((a = b)::INT) AS q FROM p),
e AS (SELECT sum((x.i - y.j) ^ 2 * x.n * y.n) AS e FROM (SELECT a AS i, count(*) AS n FROM p GROUP BY a) x CROSS JOIN (SELECT b AS j, count(*) AS n FROM p GROUP BY b) y)
SELECT n, round(1 - o / (e / n), 6) AS kappa, round(d, 6) AS mean_diff, round(q::DOUBLE, 6) AS pct_equal FROM o, e""",
    "model_route": f"""SELECT page_id, CASE WHEN length(text) < 50 THEN 'none' WHEN math_heavy THEN 'advanced' ELSE 'plain' END AS route, CASE WHEN length(text) < 50 THEN text ELSE left(text, 12000) END AS sent
FROM pages_raw JOIN ({ORACLE['page_routing']}) r USING (page_id)""",
    "answer_prompts": """SELECT golden_id, CASE question_type WHEN 'Definition' THEN 'Definieren Sie knapp.' || chr(10) WHEN 'Anwendung' THEN 'Zeigen Sie die Anwendung Schritt für Schritt.' || chr(10)
WHEN 'Transfer' THEN 'Begründen Sie die Übertragung.' || chr(10) ELSE '' END || question AS prompt FROM golden WHERE question IS NOT NULL""",
    "justifications": f"SELECT answer_id, n_supported || ' von ' || n_claims || ' Aussagen belegt (A ' || n_a || ', B ' || n_b || ', C ' || n_c || ')' AS justification FROM ({ORACLE['correctness_proportional']}) q",
    "label_dissent": """SELECT DISTINCT eval_id, system, raw_scores[1] AS a, raw_scores[2] AS b, left(reasoning, 90) AS reason FROM evaluation_results WHERE len(raw_scores) >= 2 AND raw_scores[1] <> raw_scores[2]""",
    "category_robustness": f"WITH q AS ({ORACLE['kappa_nominal']}) SELECT *, agreement >= 0.7 AND (kappa IS NULL OR kappa >= 0.6) AS robust FROM q",
    "type_counts": "SELECT question_type, count(*) AS n, count(*) FILTER (coalesce(requires_context, true)) AS n_counted, count(*) FILTER (NOT requires_context) AS n_general FROM golden GROUP BY question_type",
}
