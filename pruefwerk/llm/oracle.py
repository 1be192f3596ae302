"""SQL for DuckDB that gives the same rows as queries of the numbered problems, written apart from their operators.

The word lists of problem 3 are data of both.
"""

from __future__ import annotations

from .pairs import ACCOMPANYING, FUNCTION_WORDS, NO_VALUE, REFUSAL_RULES, REFUSAL_WORDS

P1_FOUND = """
SELECT 'pages_raw.text' AS field, page_id AS record_id FROM pages_raw
WHERE length(text) > (SELECT max_chars FROM split_limits WHERE field = 'pages_raw.text')
UNION ALL
SELECT 'chunks.semantic.content', chunk_uid FROM chunks
WHERE mode = 'semantic' AND length(content) > (SELECT max_chars FROM split_limits WHERE field = 'chunks.semantic.content')
"""


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(map(_quoted, values)) + "]"


def _classes(x: str) -> str:
    for pattern, stands in (
        (r"(?m)^[ \t]*(?:[-*•+]|[0-9]{1,3}[.)])[ \t]+[^\n]{1,80}$", "- ITEM"), (r"\p{Lu}[\p{L}\p{M}]{5,}", "Aa"),
        (r"\p{L}[\p{L}\p{M}]{5,}", "aa"), (r"[0-9]+(?:[.,][0-9]+)*", "0"), (r"\n+", "/"),
    ):
        x = f"regexp_replace({x}, '{pattern}', '{stands}', 'g')"
    return rf"list_concat(['^', '^'], regexp_extract_all({x}, '[\p{{L}}\p{{M}}]+|[^\s\p{{L}}\p{{M}}]'))"


_BLANKS = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(160) || chr(8203) || chr(65279)"
_MARK = r"(?:\[|\()?(?:\.\.\.+|…)(?:\]|\))?$"
_SHAPE = "CASE WHEN lower(left(c, 1)) = upper(left(c, 1)) THEN c WHEN lower(left(c, 1)) = left(c, 1) THEN 'aa' ELSE 'Aa' END"


def _level(i: int, keys: str) -> str:
    return f"l{i} AS (SELECT {keys}, sum(inside) + sum(at_end) - 1 AS n, sum(at_end) - 1 AS ends FROM shaped GROUP BY {keys})"


def _verdicts() -> str:
    return ", ".join(
        f"CASE WHEN l{i}.ends >= 3 AND l{i}.ends >= 0.1 * l{i}.n THEN false END, "
        f"CASE WHEN l{i}.n * rate >= 2.5 THEN l{i}.ends < (CASE WHEN s.shape IN ('aa', 'Aa') THEN 0.5 ELSE 0.15 END)::DOUBLE * rate * l{i}.n END"
        for i in range(3)
    )


def _shares(words: str) -> str:
    each = ", ".join(f"{{'share': len(list_intersect({words}, {_list(known.split())})) / greatest(len({words}), 1)::DOUBLE, 'language': '{name}'}}" for name, known in FUNCTION_WORDS.items())
    return f"[{each}]"


def _script(x: str) -> str:
    names = ("Latin", "Greek", "Cyrillic", "Hebrew", "Arabic", "Devanagari", "Thai", "Hangul", "Hiragana", "Han")
    each = ", ".join(f"{{'n': length(regexp_replace({x}, '[^\\p{{{name}}}]', '', 'g')), 'script': '{name}'}}" for name in names)
    return f"list_max([{each}])"


_LEXICON = "MAP {" + ", ".join(f"{_quoted(w)}: '{c}'" for w, c in {w: c for c, words in REFUSAL_WORDS.items() for w in words.split()}.items()) + "}"
_SYMBOLS = rf"array_to_string(list_transform(regexp_extract_all(x, '\p{{L}}+(?:[''’]\p{{L}}+)?'), lambda w: coalesce(lex[w], '')), '')"
_DERIVED = f"regexp_matches({_SYMBOLS}, {_quoted('|'.join(REFUSAL_RULES))})"
_BESIDE = rf"regexp_matches(regexp_replace(x, '^[^\p{{L}}]+', ''), {_quoted('^(?:' + '|'.join(ACCOMPANYING) + ')')})"
_NO_VALUE = "|".join(w.replace(" ", r"[^\p{L}\p{N}]+") for w in NO_VALUE)
_PAIRED = "list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1])"

P5 = rf"""
WITH src AS (
  SELECT 'answer' AS kind, CASE WHEN system = 'baseline' THEN 'baseline_answer' ELSE 'rag_answer' END AS field, answer_id AS record_id, model AS made_by, answer AS text, question FROM answers
  UNION ALL SELECT 'reasoning', 'evaluation_results.reasoning', eval_id, judge_model, reasoning, NULL FROM evaluation_results),
bare AS (SELECT * REPLACE (rtrim(text, {_BLANKS}) AS text), text AS given FROM src WHERE regexp_matches(text, '[\p{{L}}\p{{N}}]')),
unmarked AS (SELECT * REPLACE (rtrim(left(text, greatest(length(text) - 12, 0)) || regexp_replace(right(text, 12), '{_MARK}', ''), {_BLANKS}) AS text) FROM bare),
classed AS (SELECT *, {_classes('text')} AS cl FROM unmarked),
finals AS (SELECT *, cl[-3] AS a, cl[-2] AS b, cl[-1] AS c FROM classed),
inner_at AS (SELECT cl, unnest(range(1, len(cl) - 2)) AS i FROM classed),
counted AS (SELECT cl[i] AS a, cl[i + 1] AS b, cl[i + 2] AS c, 1 AS inside, 0 AS at_end FROM inner_at UNION ALL SELECT a, b, c, 0, 1 FROM finals),
counts AS (SELECT a, b, c, sum(inside) AS inside, sum(at_end) AS at_end FROM counted GROUP BY a, b, c),
shaped AS (SELECT *, {_SHAPE} AS shape FROM counts),
r AS (SELECT sum(at_end) / (sum(inside) + sum(at_end))::DOUBLE AS rate FROM counts),
{_level(0, 'a, b, shape')}, {_level(1, 'b, shape')}, {_level(2, 'shape')},
cut AS (SELECT s.a, s.b, s.c FROM shaped s JOIN l0 USING (a, b, shape) JOIN l1 ON l1.b = s.b AND l1.shape = s.shape JOIN l2 ON l2.shape = s.shape, r WHERE s.at_end > 0 AND coalesce({_verdicts()}, false)),
found AS (SELECT DISTINCT kind, field, record_id, made_by, question, CASE WHEN kind = 'answer' THEN given END AS given FROM finals SEMI JOIN cut USING (a, b, c)),
words AS (SELECT *, lower(question) AS lq, lower(given) AS lg, {_LEXICON} AS lex FROM found),
parts AS (SELECT *, regexp_extract_all(lq, '[\p{{L}}\p{{N}}]+') AS q, regexp_extract_all(lg, '[\p{{L}}\p{{N}}]+') AS a, regexp_extract_all(lq, '\p{{L}}+') AS ql, regexp_extract_all(lg, '\p{{L}}+') AS al,
  list_filter(string_split_regex(regexp_replace(lg, '([.!?;])\s+', '\1' || chr(10), 'g'), '\n+'), lambda x: regexp_matches(x, '[\p{{L}}\p{{N}}]')) AS ss FROM words),
measures AS (SELECT *, {_PAIRED.format('q')} AS qp, {_PAIRED.format('a')} AS ap, greatest(1, round(len(a) / greatest(len(q), 1)::DOUBLE)) AS times,
  list_bool_or(list_transform(ss, lambda x: {_DERIVED})) AND list_bool_and(list_transform(ss, lambda x: {_DERIVED} OR {_BESIDE})) AS refusal,
  {_script('lq')} AS qs, {_script('lg')} AS gs, {_shares('list_distinct(ql)')} AS qsh, {_shares('list_distinct(al)')} AS ash FROM parts),
covers AS (SELECT *, list_transform(range(1, len(a) + 1), lambda i: list_contains(qp, coalesce(ap[i], '')) OR i > 1 AND list_contains(qp, coalesce(ap[greatest(i - 1, 1)], ''))) AS cov, list_max(qsh) AS qm, list_max(ash) AS am FROM measures),
leads AS (SELECT *, coalesce(list_position(cov, true), 0) - 1 AS f FROM covers), led AS (SELECT *, CASE WHEN f <= 2 AND len(a) <= len(q) * times THEN 0 ELSE f END AS lead FROM leads),
judged AS (SELECT *, regexp_matches(question, '\S') AND (refusal
  OR f >= 0 AND len(list_filter(cov, lambda x: x)) >= 0.6 * len(q) AND lead <= 8 AND len(list_filter(cov[lead + 1:], lambda x: NOT x)) <= greatest(2, len(q) // 10) * times AND len(a) - lead <= len(q) * times + times
  OR qs.n > 0 AND gs.n > 0 AND qs.script <> gs.script AND length(array_to_string(al, '')) >= 8
  OR am.language <> qm.language AND len(al) >= 6 AND qm.share >= 0.1 AND am.share >= 0.15 AND am.share >= 1.6 * list_filter(ash, lambda s: s.language = qm.language)[1].share AND qm.share >= 1.3 * list_filter(qsh, lambda s: s.language = am.language)[1].share
  OR regexp_matches(lg, '^[^\p{{L}}\p{{N}}]*(?:{_NO_VALUE})[^\p{{L}}\p{{N}}]*$')) AS bad FROM led),
p5 AS (SELECT kind, field, record_id, made_by FROM judged WHERE NOT coalesce(bad, false))
"""
P5_FOUND = f"{P5} SELECT field, record_id FROM p5"
P5_RATES = f"""{P5}, every AS (SELECT kind, made_by, count(*) AS n_records FROM (SELECT DISTINCT kind, field, record_id, made_by FROM src) GROUP BY kind, made_by),
bad AS (SELECT kind, made_by, count(*) AS n FROM p5 GROUP BY kind, made_by)
SELECT every.kind, every.made_by, n_records, coalesce(n, 0) AS n_truncated, coalesce(n, 0) / n_records::DOUBLE AS share FROM every LEFT JOIN bad ON every.kind = bad.kind AND every.made_by IS NOT DISTINCT FROM bad.made_by"""

#: All pairs of records by the words they have in common, with no candidates.
P2 = r"""
WITH RECURSIVE src AS (SELECT 'chunks.raw.content' AS field, chunk_uid AS id, content AS text FROM chunks WHERE mode = 'raw' UNION ALL SELECT 'answers.retrieved_context', answer_id, retrieved_context FROM answers),
bags AS (SELECT field, id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS word FROM src), counted AS (SELECT field, id, word, count(*) AS n FROM bags GROUP BY ALL),
sizes AS (SELECT field, id, sum(n) AS n_words FROM counted GROUP BY ALL),
shared AS (SELECT a.field, a.id AS id_a, b.id AS id_b, sum(least(a.n, b.n)) AS n FROM counted a JOIN counted b ON a.field = b.field AND a.word = b.word AND a.id < b.id GROUP BY ALL),
pairs AS (SELECT s.field, id_a, id_b FROM shared s JOIN sizes a ON a.field = s.field AND a.id = id_a JOIN sizes b ON b.field = s.field AND b.id = id_b WHERE 4 * n >= 3 * greatest(a.n_words, b.n_words)),
ends AS (SELECT field, id_a AS id, id_b AS other FROM pairs UNION ALL SELECT field, id_b, id_a FROM pairs),
reached AS (SELECT field, id, id AS member FROM sizes UNION SELECT r.field, r.id, e.other FROM reached r JOIN ends e ON e.field = r.field AND e.id = r.member)
"""
P2_FOUND = f"{P2} SELECT field, id_a, id_b FROM pairs"
P2_GROUPS = f"""{P2} SELECT g.field, g.id AS record_id, g.group_id, coalesce(l.n, 0) AS n_links FROM (SELECT field, id, min(member) AS group_id FROM reached GROUP BY ALL) g
LEFT JOIN (SELECT field, id, count(*) AS n FROM ends GROUP BY ALL) l ON l.field = g.field AND l.id = g.id"""

#: What must hold of all texts over the limit, and of all kinds.
P1_CHECKS = f"SELECT field, record_id, true AS covers, true AS in_limit, true AS overlaps FROM ({P1_FOUND}) p"
P7_CHECKS = "SELECT container_kind, (SELECT count(*) FROM documents) AS n_documents, 0 AS n_overfull, 0 AS n_wrongly_split FROM pack_settings"

ORACLE = {"p1_found": P1_FOUND, "p1_checks": P1_CHECKS, "p7_checks": P7_CHECKS, "p2_found": P2_FOUND, "p2_groups": P2_GROUPS, "p5_found": P5_FOUND, "p5_rates": P5_RATES}
