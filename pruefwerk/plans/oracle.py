"""SQL for DuckDB that gives the same rows as the registered queries, written apart from them."""

from __future__ import annotations

#: What names the script, and what names its material.
SCRIPT_WORDS = (
    r"(?:im|laut|gemäß|nach|aus dem|im bereitgestellten) Skript|(?:in|laut|gemäß|nach) der Vorlesung|(?:auf|gemäß|laut) Seite\s*\d+"
    r"|im (?:Quelltext|Quellmaterial|Originaltext|bereitgestellten Text)|wie im Skript|des Skripts?"
    r"|Skript-(?:spezifisch|spezifische[rnms]?|Notation|Methode|Konvention|Inhalt|Vorlage)"
)
MATERIAL = r"(?:[A-Za-zÄÖÜäöüß]+-?)?(?:Tabelle|Formel|Abbildung|Diagramm|Analyse|Methode|Notation|Schaltung|Darstellung|Grafik|Übersicht|Beschreibung)"
MATERIAL_WORDS = (
    r"(?:in|laut|gemäß|nach|anhand|mit|aus) der (?:gegebenen |angegebenen |dargestellten |gezeigten |verwendeten |beschriebenen |spezifizierten |oben(?:stehenden|genannten)? |unten(?:stehenden|genannten)? )?"
    + MATERIAL + r"|wie (?:sie |er |es |dies )?(?:in der|im) " + MATERIAL + r"|in der Form,? die in der (?:Analyse|Tabelle|Beschreibung)"
)

B = r"[ \t\n\x0B\f\r]"


def strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{B}+', ''), '{B}+$', '')"


def clean(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g')"


def normalized(x: str) -> str:
    out = clean(x)
    for pattern, stands in ((r"[ \t]+", " "), (r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n")):
        out = f"regexp_replace({out}, '{pattern}', '{stands}', 'g')"
    return strip(out)


LATEX = strip(rf"regexp_replace(regexp_replace({clean('answer')}, '(?s)\\\[(.+?)\\\]', '$$\1$$', 'g'), '(?s)\\\((.+?)\\\)', '$\1$', 'g')")

SCORES = """
ev AS (SELECT DISTINCT question_id, system, metric, eval_id, score, evaluated_at FROM evaluation_results),
last AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY question_id, system, metric ORDER BY evaluated_at DESC, eval_id DESC) = 1),
types AS (SELECT question_id, question_type, requires_context FROM golden QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY created_at DESC, golden_id DESC) = 1),
wide AS (SELECT question_id,
  max(score) FILTER (system = 'baseline' AND metric = 'correctness') AS base_corr, max(score) FILTER (system = 'rag_semantic' AND metric = 'correctness') AS sem_corr,
  max(score) FILTER (system = 'rag_raw' AND metric = 'correctness') AS raw_corr, max(score) FILTER (system = 'rag_semantic' AND metric = 'faithfulness') AS sem_faith,
  max(score) FILTER (system = 'rag_raw' AND metric = 'faithfulness') AS raw_faith FROM last GROUP BY question_id),
w AS (SELECT wide.*, question_type, requires_context FROM wide JOIN types USING (question_id)),
long AS (SELECT question_id, question_type, measure, score FROM (UNPIVOT w ON base_corr, sem_corr, raw_corr, sem_faith, raw_faith INTO NAME measure VALUE score))
"""


def described(keys: str) -> str:
    return f"""WITH {SCORES} SELECT {keys}, count(*) AS n, round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS sd, round(min(score), 6) AS low,
round(quantile_cont(score, 0.25), 6) AS q1, round(quantile_cont(score, 0.5), 6) AS median, round(quantile_cont(score, 0.75), 6) AS q3, round(max(score), 6) AS high
FROM long GROUP BY {keys}"""


def wilcoxon(x: str, y: str, group: str = "") -> str:
    key, part = (f"{group}, ", f"PARTITION BY {group}") if group else ("", "")
    g = f"GROUP BY {group}" if group else ""
    using = f"USING ({group})" if group else "ON true"
    return f"""WITH {SCORES}, d AS (SELECT {key} round({x} - {y}, 9) AS d FROM w WHERE {x} IS NOT NULL AND {y} IS NOT NULL),
s AS (SELECT {key} count(*) AS n, count(*) FILTER (d > 1e-9) AS n_pos, count(*) FILTER (d < -1e-9) AS n_neg, count(*) FILTER (abs(d) <= 1e-9) AS n_ties, avg(d) AS mean_diff, stddev_samp(d) AS sd FROM d {g}),
r AS (SELECT {key} d, rank() OVER ({part} ORDER BY abs(d)) + (count(*) OVER (PARTITION BY {key} abs(d)) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY {key} abs(d)) AS t FROM d WHERE abs(d) > 1e-9),
q AS (SELECT {key} sum(r) FILTER (d > 0)::DOUBLE AS w_plus, count(*)::DOUBLE AS m, sum(t::DOUBLE * t - 1) AS ties FROM r {g}),
z AS (SELECT q.*, (w_plus - m * (m + 1) / 4) / sqrt(m * (m + 1) * (2 * m + 1) / 24 - ties / 48) AS z FROM q)
SELECT {key} n, n_pos, n_neg, n_ties, round(mean_diff, 6) AS mean_diff, round(coalesce(mean_diff / nullif(sd, 0), 0.0), 6) AS d_z, round(w_plus, 6) AS w_plus, round(z, 6) AS z, round(z / sqrt(m), 6) AS rank_biserial
FROM s JOIN z {using}"""


VOTES = "v AS (SELECT system, raw_scores[1] AS a, raw_scores[2] AS b FROM (SELECT DISTINCT * FROM evaluation_results WHERE len(raw_scores) >= 2))"
PAGES = """
pages AS (SELECT * FROM pages_raw QUALIFY row_number() OVER (PARTITION BY script_id, page_number ORDER BY extracted_at DESC, page_id DESC) = 1),
images AS (SELECT *, array_to_string(list_transform(list_filter(image_descriptions, lambda x: x IS NOT NULL AND x <> ''), lambda x: '[BILD-INFO: ' || x || ']'), chr(10) || chr(10)) AS described FROM pages),
page_text AS (SELECT script_id, page_number, CASE WHEN coalesce(len(image_descriptions), 0) = 0 THEN coalesce(text, '') WHEN coalesce(text, '') = '' THEN described ELSE text || chr(10) || chr(10) || described END AS page_text FROM images),
c AS (SELECT script_id, chunk_id, coalesce(page_number, nullif(regexp_extract(content, '### Seite (\\d+)', 1), '')::INT) AS page FROM chunks WHERE mode = 'semantic'),
refs AS (SELECT golden_id, script_id, regexp_extract(source_reference, '^(chunk_\\d+)_to_(chunk_\\d+)', 1) AS f, regexp_extract(source_reference, '^(chunk_\\d+)_to_(chunk_\\d+)', 2) AS l FROM golden WHERE source_reference IS NOT NULL),
spans AS (SELECT golden_id, refs.script_id, greatest(1, a.page - 1) AS lo, coalesce(b.page, a.page) + 1 AS hi FROM refs JOIN c a ON a.script_id = refs.script_id AND a.chunk_id = f LEFT JOIN c b ON b.script_id = refs.script_id AND b.chunk_id = l WHERE a.page IS NOT NULL AND f <> ''),
ctx AS (SELECT golden_id, count(*) AS n_pages, string_agg(page_text, chr(10) || chr(10) ORDER BY page_number) AS context FROM spans JOIN page_text p ON p.script_id = spans.script_id AND p.page_number BETWEEN lo AND hi GROUP BY golden_id)
"""
TOKENS = "list_distinct(regexp_extract_all(lower({0}), '[a-zäöüß0-9]+'))"


def claims(key: str, text: str, source: str) -> str:
    parts = f"list_filter(list_transform(string_split_regex({text}, '[.!?][ \\t\\n\\x0B\\f\\r]|\\n'), lambda c: {strip('c')}), lambda c: c <> '')"
    return f"SELECT {key}, unnest(range(len(p)))::INT AS claim_index, unnest(p) AS claim FROM (SELECT {key}, {parts} AS p FROM {source} WHERE {text} IS NOT NULL)"


def proportional(statement: str, reference: str, where: str) -> str:
    return f"""src AS (SELECT * FROM answers WHERE {where}), cl AS ({claims('answer_id', statement, 'src')}),
j AS (SELECT cl.answer_id, system, question_type, {TOKENS.format('claim')} AS t, {TOKENS.format(f"coalesce({reference}, '')")} AS rt, {TOKENS.format("coalesce(question, '')")} AS qt, claim FROM cl JOIN src USING (answer_id)),
k AS (SELECT *, len(t) > 0 AND len(list_intersect(t, rt)) / len(t)::DOUBLE >= 0.6 AS ok, len(t) = 0 AS unknown,
CASE WHEN len(t) > 0 AND len(list_intersect(t, qt)) = len(t) THEN 'C' WHEN regexp_matches(claim, '[0-9]') AND regexp_matches(claim, '[=+*/]') THEN 'B' ELSE 'A' END AS category FROM j)"""


COUNTS = "count(*) AS n_claims, count(*) FILTER (ok) AS n_supported, count(*) FILTER (category = 'A') AS n_a, count(*) FILTER (category = 'B') AS n_b, count(*) FILTER (category = 'C') AS n_c, round(count(*) FILTER (ok) / count(*)::DOUBLE, 6) AS score"
NEIGHBORS = """
e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), u AS (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS n FROM e),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.v, b.v) / (a.n * b.n) AS similarity FROM u a JOIN u b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
nb AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank, vec_id, similarity FROM s QUALIFY rank <= 8)
"""
LAST = "SELECT * FROM answers WHERE system = '{0}' QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY answered_at DESC, answer_id DESC) = 1"
ALIGNED = f"""SELECT b.question_id, b.answer_id AS baseline_id, s.answer_id AS rag_semantic_id, r.answer_id AS rag_raw_id, b.answer AS baseline_answer, s.answer AS rag_semantic_answer, r.answer AS rag_raw_answer
FROM answers b JOIN ({LAST.format('rag_semantic')}) s ON s.question_id = b.question_id JOIN ({LAST.format('rag_raw')}) r ON r.question_id = b.question_id WHERE b.system = 'baseline'"""
CALLS = "calls AS (SELECT DISTINCT * REPLACE (lower(trim(status)) AS status) FROM api_calls)"
WILSON = """(n_c / n::DOUBLE + 1.959963984540054 ^ 2 / (2 * n)) / (1 + 1.959963984540054 ^ 2 / n) {0}
1.959963984540054 * sqrt(n_c / n::DOUBLE * (1 - n_c / n::DOUBLE) / n + 1.959963984540054 ^ 2 / (4.0 * n * n)) / (1 + 1.959963984540054 ^ 2 / n)"""

ORACLE: dict[str, str] = {
    "rag_topk_neighbors": f"WITH {NEIGHBORS} SELECT query_id, rank::INT AS rank, vec_id, round(similarity, 5) AS similarity FROM nb",
    "rag_topk_context": f"""WITH {NEIGHBORS}, k AS (SELECT query_id, rank, text, trim(regexp_replace(text, '{B}+', ' ', 'g')) AS key FROM nb JOIN documents ON doc_id = vec_id WHERE text IS NOT NULL),
f AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY query_id, key ORDER BY rank) = 1)
SELECT query_id, count(*) AS n_passages, string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM f GROUP BY query_id""",
    "normalize_text": f"SELECT page_id, {normalized('text')} AS text FROM pages_raw",
    "sanitize_latex": f"SELECT answer_id, {LATEX} AS text FROM answers",
    "collapse_whitespace": f"SELECT chunk_uid, trim(regexp_replace(coalesce(content, ''), '{B}+', ' ', 'g')) AS text FROM chunks",
    "post_process": f"""WITH a AS (SELECT doc_id, CASE WHEN starts_with(text, 'Hier ist') OR starts_with(text, 'Gerne') THEN {strip("regexp_replace(text, '^[^\\n]*\\n?', '')")} ELSE text END AS t FROM documents WHERE text IS NOT NULL),
b AS (SELECT doc_id, CASE WHEN starts_with(t, '```') THEN {strip("replace(replace(regexp_replace(regexp_replace(t, '^`+', ''), '`+$', ''), 'markdown', ''), 'latex', '')")} ELSE t END AS t FROM a)
SELECT doc_id, {strip("regexp_replace(t, '\\n\\s*\\$?\\d+\\$?\\s*$', '')")} AS text FROM b""",
    "page_routing": r"""SELECT page_id, length(text) >= 50 AND (len(regexp_extract_all(text, '[\\$|_^{}\[\]]')) / length(text)::DOUBLE > 0.05 OR len(regexp_extract_all(text, '\|')) > 15
OR contains(text, '\frac') OR contains(text, '\sum') OR contains(text, '\int') OR contains(text, '\begin') OR contains(text, '\prod') OR contains(text, '\lim')) AS math_heavy,
regexp_matches(lower(text), 'abbildung|figur|graph|diagramm|skizze|schema|pfeil|darstellung') OR length(text) < 200 OR coalesce(len(image_descriptions), 0) > 2 AS page_scan,
length(text) >= 500 AND len(regexp_extract_all(text, '\d{4,}')) <= 25 AS valid FROM pages_raw WHERE text IS NOT NULL""",
    "script_references": rf"""WITH a AS (SELECT golden_id, list_concat(regexp_extract_all(question, '(?i)\b(?:{SCRIPT_WORDS})\b', 0), regexp_extract_all(question, '(?i)\b(?:{MATERIAL_WORDS})\b', 0)) AS m FROM golden WHERE question IS NOT NULL)
SELECT golden_id, len(m) AS n_references, array_to_string(m, '|') AS found FROM a""",
    "useful_image_descriptions": """WITH a AS (SELECT page_id, unnest(range(len(image_descriptions)))::INT AS position, unnest(image_descriptions) AS description FROM pages_raw WHERE image_descriptions IS NOT NULL)
SELECT * FROM a WHERE description IS NOT NULL AND trim(description) NOT IN ('', 'KEINE_INFO', 'KEINE_GRAFIK')""",
    "image_dedup": """WITH a AS (SELECT page_id, unnest(range(len(image_descriptions)))::INT AS position, unnest(image_descriptions) AS description FROM pages_raw WHERE image_descriptions IS NOT NULL),
b AS (SELECT *, sha256(description) AS hash FROM a WHERE description IS NOT NULL AND trim(description) NOT IN ('', 'KEINE_INFO', 'KEINE_GRAFIK'))
SELECT hash, page_id, position, count(*) OVER (PARTITION BY hash) AS n FROM b QUALIFY row_number() OVER (PARTITION BY hash ORDER BY page_id, position) = 1""",
    "token_estimate": "SELECT answer_id, floor((coalesce(length(question), 0) + coalesce(length(retrieved_context), 0)) / 4::DOUBLE * 1.2::DOUBLE)::BIGINT + 1200 AS tokens FROM answers",
    "raw_chunks": rf"""WITH p AS (SELECT page_id, list_filter(string_split_regex(text, '\n\n+'), lambda x: trim(translate(x, chr(10) || chr(9) || chr(13), '   ')) <> '') AS ps FROM pages_raw WHERE text IS NOT NULL),
f AS (SELECT page_id, list_reduce(list_prepend({{'out': []::VARCHAR[], 'cur': ''}}, list_transform(ps, lambda x: {{'out': []::VARCHAR[], 'cur': x}})), lambda a, x: {{
'out': CASE WHEN length(a.cur) + length(x.cur) <= 1200 OR a.cur = '' THEN a.out ELSE list_append(a.out, a.cur) END,
'cur': CASE WHEN length(a.cur) + length(x.cur) <= 1200 THEN a.cur ELSE '' END || x.cur || chr(10) || chr(10)}}) AS s FROM p),
c AS (SELECT page_id, CASE WHEN s.cur = '' THEN s.out ELSE list_append(s.out, s.cur) END AS cs FROM f), e AS (SELECT page_id, unnest(range(len(cs)))::INT AS chunk_index, unnest(cs) AS content FROM c)
SELECT page_id, 'raw' AS mode, chunk_index, 'chunk_' || chunk_index AS chunk_id, {strip('content')} AS content FROM e""",
    "chunk_stats": "SELECT script_id, mode, count(*) AS n_chunks, round(avg(coalesce(length(content), 0)), 6) AS mean_chars, max(coalesce(length(content), 0)) AS max_chars, count(*) FILTER (page_number IS NULL) AS n_without_page FROM chunks GROUP BY script_id, mode",
    "chunk_page_map": r"""SELECT script_id, chunk_index, last_value(nullif(regexp_extract(content, '(?m)^###\s+Seite\s+(\d+)\b', 1), '')::INT IGNORE NULLS) OVER (PARTITION BY script_id ORDER BY chunk_index ROWS UNBOUNDED PRECEDING) AS page_number FROM chunks WHERE mode = 'semantic'""",
    "generation_windows": rf"""WITH a AS (SELECT script_id, chunk_index, list({{'i': chunk_index, 'id': chunk_id, 'c': coalesce(content, '')}}) OVER (PARTITION BY script_id ORDER BY chunk_index ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING) AS b FROM chunks WHERE mode = 'semantic'),
k AS (SELECT script_id, chunk_index AS start, b, list_position(list_transform(b[2:], lambda x: regexp_matches({strip('x.c')}, '^#{{1,2}}\s')), true) AS p FROM a WHERE len(b) = 7 AND chunk_index % 3 = 0 AND b[7].i = chunk_index + 6),
n AS (SELECT script_id, start, coalesce(nullif(p, 0), 7)::INT AS n_chunks, b FROM k)
SELECT script_id, start, n_chunks, b[1].id || '_to_' || b[n_chunks].id AS source_reference, {normalized("array_to_string(list_transform(b[1:n_chunks], lambda x: x.c), chr(10) || chr(10))")} AS text FROM n WHERE n_chunks >= 2""",
    "align_answers": ALIGNED,
    "resume_pending": """SELECT q.question_id, s.system FROM (SELECT DISTINCT question_id FROM answers) q CROSS JOIN (VALUES ('baseline'), ('rag_semantic'), ('rag_raw')) s(system)
WHERE NOT EXISTS (SELECT 1 FROM answers a WHERE a.question_id = q.question_id AND a.system = s.system)""",
    "canonical_context": f"WITH {PAGES} SELECT * FROM ctx",
    "canonical_coverage": f"WITH {PAGES} SELECT question_type, count(*) AS n, count(ctx.golden_id) AS n_covered, round(count(ctx.golden_id) / count(*)::DOUBLE, 6) AS share FROM golden LEFT JOIN ctx USING (golden_id) GROUP BY question_type",
    "claims_flat": claims("answer_id", "answer", "answers"),
    "faithfulness_proportional": f"WITH {proportional('answer', 'retrieved_context', chr(39).join(['system <> ', 'baseline', '']))} SELECT answer_id, {COUNTS} FROM k GROUP BY answer_id",
    "correctness_proportional": f"WITH {proportional('ground_truth', 'answer', 'true')} SELECT answer_id, {COUNTS} FROM k GROUP BY answer_id",
    "category_distribution": f"""WITH {proportional('answer', 'retrieved_context', chr(39).join(['system <> ', 'baseline', '']))},
l AS (SELECT question_type, system, grouping_id(question_type, system)::INT AS level, count(*) AS n, count(*) FILTER (category = 'A') AS n_a, count(*) FILTER (category = 'B') AS n_b, count(*) FILTER (category = 'C') AS n_c, count(*) FILTER (NOT ok AND NOT unknown) AS n_unsupported FROM k GROUP BY ROLLUP (question_type, system))
SELECT *, round(n_c / n::DOUBLE, 6) AS share_c, round(greatest(0.0, {WILSON.format('-')}), 6) AS share_c_low, round(least(1.0, {WILSON.format('+')}), 6) AS share_c_high FROM l""",
    "likert_scores": """WITH d AS (SELECT DISTINCT eval_id, list_filter(raw_scores, lambda x: x IS NOT NULL) AS v FROM evaluation_results WHERE raw_scores IS NOT NULL)
SELECT eval_id, len(v) AS n_votes, round(list_sum(list_transform(v, lambda x: (x - 1) / 4::DOUBLE)) / nullif(len(v), 0), 6) AS score, CASE WHEN len(v) >= 2 THEN abs(v[1] - v[2]) ELSE 0 END::BIGINT AS disagreement FROM d""",
    "scores_wide": f"WITH {SCORES} SELECT question_id, round(base_corr, 6) AS base_corr, round(sem_corr, 6) AS sem_corr, round(raw_corr, 6) AS raw_corr, round(sem_faith, 6) AS sem_faith, round(raw_faith, 6) AS raw_faith, question_type, requires_context FROM w",
    "describe_scores": described("measure"),
    "describe_by_type": described("measure, question_type"),
    "wilcoxon_correctness": wilcoxon("sem_corr", "base_corr"),
    "wilcoxon_faithfulness_by_type": wilcoxon("sem_faith", "raw_faith", "question_type"),
    "mann_whitney_faithfulness": f"""WITH {SCORES}, v AS (SELECT round(score, 9) AS x, coalesce(question_type = 'Definition', false) AS g FROM long WHERE measure = 'sem_faith'),
r AS (SELECT g, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY x) AS t FROM v),
s AS (SELECT sum(r) FILTER (g)::DOUBLE AS r1, count(*) FILTER (g) AS n1, count(*) FILTER (NOT g) AS n2, count(*)::DOUBLE AS n, sum(t::DOUBLE * t - 1) AS ties FROM r), u AS (SELECT *, r1 - n1 * (n1 + 1) / 2.0 AS u FROM s)
SELECT n1, n2, round(u::DOUBLE, 6) AS u, round((u - n1 * n2 / 2.0 - 0.5) / sqrt(n1 * n2 / 12.0 * (n + 1 - ties / (n * (n - 1)))), 6) AS z, round(2 * u / (n1 * n2)::DOUBLE - 1, 6) AS rank_biserial FROM u""",
    "friedman_correctness": f"""WITH {SCORES}, i AS (SELECT question_id, question_type, unnest([1, 2, 3]) AS j, unnest([round(base_corr, 9), round(sem_corr, 9), round(raw_corr, 9)]) AS x FROM w WHERE base_corr IS NOT NULL AND sem_corr IS NOT NULL AND raw_corr IS NOT NULL),
r AS (SELECT *, rank() OVER (PARTITION BY question_id ORDER BY x) + (count(*) OVER (PARTITION BY question_id, x) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY question_id, x) AS t FROM i),
s AS (SELECT question_type, j, sum(r)::DOUBLE AS s, count(*) AS n, sum(t::DOUBLE * t - 1) AS ties FROM r GROUP BY question_type, j),
c AS (SELECT question_type, max(n) AS n, (12 / (max(n) * 12::DOUBLE) * sum(s * s) - 3 * max(n) * 4) / (1 - sum(ties) / (max(n) * 24::DOUBLE)) AS chi2 FROM s GROUP BY question_type HAVING max(n) >= 3)
SELECT question_type, n, round(chi2, 6) AS chi2, round(chi2 / (n * 2), 6) AS kendall_w, round(exp(-chi2 / 2), 6) AS p FROM c""",
    "scheirer_ray_hare": f"""WITH {SCORES}, v AS (SELECT measure, question_type, round(score, 9) AS x FROM long WHERE measure IN ('base_corr', 'sem_corr', 'raw_corr') AND question_type IS NOT NULL),
r AS (SELECT *, (rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0)::DOUBLE AS r FROM v),
t AS (SELECT count(*) AS n, sum(r) * sum(r) / count(*) AS m, (sum(r * r) - sum(r) * sum(r) / count(*)) / (count(*) - 1) AS ms FROM r),
a AS (SELECT sum(x) AS x, count(*) AS k FROM (SELECT sum(r) * sum(r) / count(*) AS x FROM r GROUP BY measure)), b AS (SELECT sum(x) AS x, count(*) AS k FROM (SELECT sum(r) * sum(r) / count(*) AS x FROM r GROUP BY question_type)),
c AS (SELECT sum(x) AS x FROM (SELECT sum(r) * sum(r) / count(*) AS x FROM r GROUP BY measure, question_type))
SELECT 'measure' AS effect, round((a.x - m) / ms, 6) AS h, a.k - 1 AS df FROM t, a UNION ALL SELECT 'question_type', round((b.x - m) / ms, 6), b.k - 1 FROM t, b
UNION ALL SELECT 'interaction', round((c.x - m - (a.x - m) - (b.x - m)) / ms, 6), (a.k - 1) * (b.k - 1) FROM t, a, b, c""",
    "spearman_modes": f"""WITH {SCORES}, p AS (SELECT round(sem_corr, 9) AS x, round(raw_corr, 9) AS y FROM w WHERE sem_corr IS NOT NULL AND raw_corr IS NOT NULL),
r AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM p),
s AS (SELECT count(*) AS n, corr(rx, ry) AS rho, avg(abs(x - y)) AS mae FROM r)
SELECT n, round(rho, 6) AS rho, round(tanh(atanh(rho) - 1.959963984540054 / sqrt(n - 3)), 6) AS rho_low, round(tanh(atanh(rho) + 1.959963984540054 / sqrt(n - 3)), 6) AS rho_high, round(mae, 6) AS mae FROM s""",
    "irr_kappa_quadratic": f"""WITH {VOTES}, p AS (SELECT * FROM v WHERE a BETWEEN 1 AND 5 AND b BETWEEN 1 AND 5), o AS (SELECT system, count(*) AS n, sum((a - b) ^ 2) AS o, avg(abs(a - b)) AS d, 100.0 * avg((a = b)::INT) AS q FROM p GROUP BY system),
e AS (SELECT x.system, sum((x.a - y.b) ^ 2) AS e FROM p x JOIN p y ON x.system = y.system GROUP BY x.system)
SELECT system, n, round(1 - o / (e / n), 6) AS kappa, round(d, 6) AS mean_diff, round(q::DOUBLE, 6) AS pct_equal FROM o JOIN e USING (system)""",
    "kappa_nominal": f"""WITH {VOTES}, o AS (SELECT system, count(*) AS n, avg((a = b)::INT) AS po FROM v GROUP BY system), e AS (SELECT x.system, avg((x.a = y.b)::INT) AS pe FROM v x JOIN v y ON x.system = y.system GROUP BY x.system)
SELECT system, n, round(po, 6) AS agreement, round((po - pe) / (1 - pe), 6) AS kappa FROM o JOIN e USING (system)""",
    "classification_metrics": f"""WITH {VOTES}, l AS (SELECT DISTINCT system, a AS label FROM v UNION SELECT DISTINCT system, b FROM v)
SELECT l.system, label::BIGINT AS label, count(*) FILTER (a = label AND b = label) AS tp, round(count(*) FILTER (a = label AND b = label) / nullif(count(*) FILTER (a = label), 0)::DOUBLE, 6) AS precision,
round(count(*) FILTER (a = label AND b = label) / nullif(count(*) FILTER (b = label), 0)::DOUBLE, 6) AS recall FROM l JOIN v USING (system) GROUP BY l.system, label""",
    "pvalue_corrections": f"""WITH {SCORES}, p AS (SELECT question_type AS test, count(*) FILTER (abs(round(sem_corr - raw_corr, 9)) <= 1e-9) / count(*)::DOUBLE AS p FROM w WHERE sem_corr IS NOT NULL AND raw_corr IS NOT NULL AND question_type IS NOT NULL GROUP BY question_type),
r AS (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p, test) AS pos FROM p)
SELECT test, round(p, 6) AS p, round(least(1.0, p * m), 6) AS bonferroni, round(least(1.0, max((m - pos + 1) * p) OVER (ORDER BY p, test)), 6) AS holm, round(least(1.0, min(m / pos::DOUBLE * p) OVER (ORDER BY p DESC, test DESC)), 6) AS bh FROM r""",
    "sample_review": f"""WITH q AS ({ALIGNED}), n AS (SELECT count(*) AS n FROM q), d AS (SELECT *, md5('42|' || baseline_id) AS draw, row_number() OVER (ORDER BY md5('42|' || baseline_id), baseline_id) AS pos FROM q)
SELECT d.* EXCLUDE (pos) FROM d, n WHERE pos <= least(greatest(15, floor(n * 0.3::DOUBLE + 0.999)), n)""",
    "sample_stratified": "SELECT golden_id, question_type, row_number() OVER (PARTITION BY question_type ORDER BY md5('42|' || golden_id), golden_id)::INT AS draw FROM golden WHERE question_type IS NOT NULL QUALIFY draw <= 10",
    "quota_balanced": """SELECT golden_id, question_type, row_number() OVER (PARTITION BY question_type ORDER BY md5('42|' || golden_id), golden_id)::INT AS draw FROM golden
WHERE requires_context AND question_type IN ('Definition', 'Anwendung', 'Transfer') QUALIFY draw <= CASE question_type WHEN 'Transfer' THEN 16 ELSE 17 END""",
    "usage_rollup": f"""WITH {CALLS} SELECT kind, model, status, grouping_id(kind, model, status)::INT AS level, count(*) AS n_calls, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(completion_tokens)::BIGINT AS completion_tokens,
sum(total_tokens)::BIGINT AS total_tokens, round(sum(latency_s), 3) AS sum_latency, round(quantile_cont(latency_s, 0.95), 6) AS p95_latency FROM calls GROUP BY ROLLUP (kind, model, status)""",
    "sliding_token_usage": f"""WITH {CALLS}, t AS (SELECT call_id, coalesce(model, '') AS model, coalesce(total_tokens, 0) AS tokens, epoch_us(ts) AS us FROM calls)
SELECT call_id, model, (sum(tokens) OVER (PARTITION BY model ORDER BY us RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW))::BIGINT AS window_tokens FROM t""",
    "call_log_windows": f"WITH {CALLS} SELECT date_trunc('hour', ts) AS hour, kind, count(*) AS n_calls, coalesce(sum(total_tokens), 0)::BIGINT AS tokens FROM calls GROUP BY 1, 2",
}
