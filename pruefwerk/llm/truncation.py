"""Problem 5: texts that were cut off by a field limit or in transfer.

Method: word trigrams inside texts against word trigrams at their ends, in SQL alone. Long words stand for their
shape, so that the trigrams repeat; punctuation and line breaks are words. A text is cut if its final trigram is
frequent inside texts and almost never at an end. The last word stands for its shape even
where it is short, as it may be the rest of a word. Where the trigram is too rare to tell, its last two words decide,
then its last one; whatever is counted is counted over all texts.

A mark of the cut (dots, an ellipsis) and white space are taken off the end first. Items of a list are one word each,
as an item may end in any word.

An answer with another defect of problem 3 is no case; ``other_defect`` has these defects in SQL as well.

Defined cases: null, blank and sign-only texts are never cut; texts of one or two words are padded at the left;
repeated rows count as often as they are there, and give a row each; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .pairs import ACCOMPANYING, FUNCTION_WORDS, REFUSAL_RULES, REFUSAL_WORDS, is_empty

#: A suffix is judged where so many ends would be expected if all suffixes ended texts equally often.
EVIDENCE = 2.5
#: It is almost never terminal, and marks a cut, if it ends less than this share of the texts that it would end if all
#: places of texts were alike as ends. The ends that are cut count too; more of them fall into words, which are longer.
WORD_END_SHARE, SIGN_END_SHARE = 0.5, 0.15
#: From so many ends on, a suffix of which at least the share are ends is sound.
SOUND_ENDS, SOUND_SHARE = 3, 0.1
#: Words of at most so many letters stand for themselves.
SHORT_WORD = 5

_BLANKS = r"' \t\n\r\f\u00a0\u200b\ufeff'"
_MARK = r"(?:\\[|\\()?(?:\\.\\.\\.+|…)(?:\\]|\\))?$"
_UNMARKED = f"concat(left(text, length(text) - 12), regexp_replace(right(text, 12), '{_MARK}', ''))"
#: Patterns and what stands for them; applied in this order.
_CLASSES = [
    (r"(?m)^[ \\t]*(?:[-*•+]|[0-9]{1,3}[.)])[ \\t]+[^\\n]{1,80}$", "- ITEM"),
    (rf"\\p{{Lu}}[\\p{{L}}\\p{{M}}]{{{SHORT_WORD},}}", "Aa"),
    (rf"\\p{{L}}[\\p{{L}}\\p{{M}}]{{{SHORT_WORD},}}", "aa"),
    (r"[0-9]+(?:[.,][0-9]+)*", "0"),
    (r"\\n+", "/"),
]
_LAST_LINES = "substring_index(text, '\\n', -3)"
_SHAPE = "CASE WHEN lower(left(c, 1)) = upper(left(c, 1)) THEN c WHEN lower(left(c, 1)) = left(c, 1) THEN 'aa' ELSE 'Aa' END"


def _classes(text: str) -> str:
    for pattern, stands in _CLASSES:
        text = f"regexp_replace({text}, '{pattern}', '{stands}')"
    return f"concat(array('^', '^'), regexp_extract_all({text}, '[\\\\p{{L}}\\\\p{{M}}]+|[^\\\\s\\\\p{{L}}\\\\p{{M}}]', 0))"


def stripped(records: DataFrame) -> DataFrame:
    """The records with letters or digits, ``text`` without the blanks and the mark of a cut at its end."""
    return records.where(r"text rlike '[\\p{L}\\p{N}]'").withColumn("text", F.expr(f"rtrim({_BLANKS}, text)")).withColumn("text", F.expr(f"rtrim({_BLANKS}, {_UNMARKED})"))


def final_classes(records: DataFrame) -> DataFrame:
    """``records`` with the classes ``a, b, c`` of the last three words in place of the text.

    Classes don't reach over line breaks, so that the last lines are enough where they have three words.
    """
    keys = [f"`{k}`" for k in records.columns if k != "text"]
    near = records.selectExpr(*keys, "text", f"{_classes(_LAST_LINES)} AS near")
    last = near.selectExpr(*keys, f"CASE WHEN size(near) >= 5 THEN near ELSE {_classes('text')} END AS classes")
    return last.selectExpr(*keys, *(f"element_at(classes, {i}) AS {c}" for i, c in ((-3, "a"), (-2, "b"), (-1, "c"))))


def suffix_counts(records: DataFrame, finals: DataFrame) -> DataFrame:
    """``a, b, c, inside, at_end`` of every trigram of classes of all texts; ``finals`` are their final ones."""
    ends = finals.groupBy("a", "b", "c").agg(F.count(F.lit(1)).alias("at_end"))
    classed = records.selectExpr(f"{_classes('text')} AS classes")
    n = "size(classes) - 3"
    inner = classed.where(f"{n} > 0").selectExpr(f"inline(arrays_zip(slice(classes, 1, {n}), slice(classes, 2, {n}), slice(classes, 3, {n})))")
    inside = inner.toDF("a", "b", "c").groupBy("a", "b", "c").agg(F.count(F.lit(1)).alias("inside"))
    none = F.lit(0).cast("bigint")
    both = inside.withColumn("at_end", none).unionByName(ends.withColumn("inside", none))
    return both.groupBy("a", "b", "c").agg(F.sum("inside").alias("inside"), F.sum("at_end").alias("at_end"))


def cut_endings(counts: DataFrame) -> DataFrame:
    """The final trigrams ``a, b, c`` that mark a text as cut."""
    shaped = counts.withColumn("shape", F.expr(_SHAPE))
    judged = shaped.where("at_end > 0").select("a", "b", "c", "shape")
    end_rate = counts.agg(F.sum("at_end") / (F.sum("inside") + F.sum("at_end"))).scalar()
    judged = judged.withColumn("end_rate", end_rate)
    end_share = F.when(F.col("shape").isin("aa", "Aa"), WORD_END_SHARE).otherwise(SIGN_END_SHARE)
    verdicts = []
    for level, keys in enumerate((["a", "b", "shape"], ["b", "shape"], ["shape"])):
        # without the text itself
        stats = shaped.groupBy(*keys).agg((F.sum("inside") + F.sum("at_end") - 1).alias(f"n_{level}"), (F.sum("at_end") - 1).alias(f"ends_{level}"))
        judged = judged.join(stats, keys)
        n, ends = F.col(f"n_{level}"), F.col(f"ends_{level}")
        verdicts += [F.when((ends >= SOUND_ENDS) & (ends >= SOUND_SHARE * n), False), F.when(n * F.col("end_rate") >= EVIDENCE, ends < end_share * F.col("end_rate") * n)]
    return judged.where(F.coalesce(*verdicts, F.lit(False))).select("a", "b", "c")


def truncated(records: DataFrame) -> DataFrame:
    """The rows of ``records`` (``text`` and any keys) whose text stops inside a word or sentence."""
    keys = [c for c in records.columns if c != "text"]
    written = stripped(records)
    finals = cut_lineage(final_classes(written))
    cut = cut_endings(cut_lineage(suffix_counts(written, finals)))
    return finals.join(cut, ["a", "b", "c"], "left_semi").select(*keys)


def truncation_rates(records: DataFrame, cut: DataFrame, source: str) -> DataFrame:
    """For each value of ``source`` how many of its records are cut; null is a source of its own."""
    every = records.groupBy("kind", source).agg(F.count(F.lit(1)).alias("n_records"))
    bad = cut.groupBy("kind", source).agg(F.count(F.lit(1)).alias("n_truncated"))
    joined = every.alias("e").join(bad.alias("b"), F.col("e.kind").eqNullSafe(F.col("b.kind")) & F.col(f"e.{source}").eqNullSafe(F.col(f"b.{source}")), "left")
    n = F.coalesce("n_truncated", F.lit(0))
    return joined.select("e.kind", f"e.{source}", "n_records", n.alias("n_truncated"), (n / F.col("n_records")).alias("share"))


def _texts(values) -> str:
    return "array(" + ", ".join(f'"{v}"' for v in values) + ")"


def _spoken(words: str) -> str:
    """For each language the share of different words that are its function words."""
    shares = (f"named_struct('share', size(array_intersect({words}, {_texts(known.split())})) / greatest(size({words}), 1), 'language', '{language}')" for language, known in FUNCTION_WORDS.items())
    return f"array({', '.join(shares)})"


_SCRIPTS = ("Latin", "Greek", "Cyrillic", "Hebrew", "Arabic", "Devanagari", "Thai", "Hangul", "Hiragana", "Han")


def _written(text: str) -> str:
    counts = (f"named_struct('n', length(regexp_replace({text}, '[^\\\\p{{Is{script}}}]', '')), 'script', '{script}')" for script in _SCRIPTS)
    only_latin = f"NOT {text} rlike '[\\\\p{{L}}&&[^\\\\p{{IsLatin}}]]'"
    return f"CASE WHEN {only_latin} THEN named_struct('n', cast({text} rlike '\\\\p{{L}}' AS int), 'script', 'Latin') ELSE array_max(array({', '.join(counts)})) END"


def other_defect(asked: DataFrame, question: str, answer: str) -> DataFrame:
    """``asked`` with ``defective``: whether an answer is a word for no value, a refusal, a copy of its question, or in another language.

    Refusals by the grammar over classes of words, copies by the pairs of words that both have, in place of tiles of two
    words and more, languages by their scripts and function words. False without a question.
    """
    lexicon = {word: symbol for symbol, words in REFUSAL_WORDS.items() for word in words.split()}
    symbols = f"array_join(transform(regexp_extract_all(x, \"\\\\p{{L}}+(?:['’]\\\\p{{L}}+)?\", 0), w -> coalesce(try_element_at(lexicon, w), '')), '')"
    derived = f"{symbols} rlike '{'|'.join(REFUSAL_RULES)}'"
    accompanies = f"regexp_replace(x, '^[^\\\\p{{L}}]+', '') rlike \"^(?:{'|'.join(ACCOMPANYING)})\""
    lower = asked.selectExpr("*", f"lower(`{question}`) AS asked_text", f"lower(`{answer}`) AS given_text")
    words = lower.selectExpr(
        "*", "regexp_extract_all(asked_text, '[\\\\p{L}\\\\p{N}]+', 0) AS q", "regexp_extract_all(given_text, '[\\\\p{L}\\\\p{N}]+', 0) AS a",
        "filter(split(regexp_replace(given_text, '([.!?;])\\\\s+', '$1\\n'), '\\n+'), x -> x rlike '[\\\\p{L}\\\\p{N}]') AS sentences",
        f"map_from_arrays({_texts(lexicon)}, {_texts(lexicon.values())}) AS lexicon",
        "regexp_extract_all(asked_text, '\\\\p{L}+', 0) AS q_letters", "regexp_extract_all(given_text, '\\\\p{L}+', 0) AS a_letters",
    )
    pairs = lambda x: f"transform(arrays_zip(slice({x}, 1, greatest(size({x}) - 1, 0)), slice({x}, 2, size({x}))), p -> concat(p['0'], ' ', p['1']))"
    measured = words.selectExpr(
        "*", f"{pairs('q')} AS q_pairs", f"{pairs('a')} AS a_pairs", "greatest(1, round(size(a) / greatest(size(q), 1))) AS times",
        # the first sentence settles most answers
        f"forall(slice(sentences, 1, 1), x -> {derived} OR {accompanies}) AND forall(sentences, x -> {derived} OR {accompanies}) AND exists(sentences, x -> {derived}) AS refusal",
        f"{_written('asked_text')} AS q_script", f"{_written('given_text')} AS a_script",
        f"{_spoken('array_distinct(q_letters)')} AS q_shares", f"{_spoken('array_distinct(a_letters)')} AS a_shares",
    )
    # Spark would put what lambdas use into them and evaluate it for each word
    measured = cut_lineage(measured)
    covered = "transform(a, (w, i) -> array_contains(q_pairs, coalesce(try_element_at(a_pairs, i + 1), '')) OR i > 0 AND array_contains(q_pairs, coalesce(try_element_at(a_pairs, greatest(i, 1)), ''))) AS covered"
    judged = measured.selectExpr("*", covered, "array_max(q_shares) AS q_most", "array_max(a_shares) AS a_most")
    share = lambda shares, language: f"filter({shares}, s -> s.language = {language})[0].share"
    lead = "CASE WHEN first <= 2 AND size(a) <= size(q) * times THEN 0 ELSE first END"
    copied = (
        f"first >= 0 AND size(filter(covered, c -> c)) >= 0.6 * size(q) AND {lead} <= 8 AND size(filter(slice(covered, cast({lead} AS int) + 1, size(a)), c -> NOT c)) <= greatest(2, size(q) div 10) * times"
        f" AND size(a) - {lead} <= size(q) * times + times"
    )
    other_script = "q_script.n > 0 AND a_script.n > 0 AND q_script.script <> a_script.script AND size(a_letters) > 0 AND length(array_join(a_letters, '')) >= 8"
    expected, spoken = share("a_shares", "q_most.language"), share("q_shares", "a_most.language")
    language = (
        f"a_most.language <> q_most.language AND size(a_letters) >= 6 AND q_most.share >= 0.1 AND a_most.share >= 0.15 AND a_most.share >= 1.6 * {expected} AND q_most.share >= 1.3 * {spoken}"
    )
    verdict = f"coalesce(asked_text rlike '\\\\S' AND (refusal OR {copied} OR {other_script} OR {language}), false) AS defective"
    out = judged.selectExpr("*", "cast(array_position(covered, true) AS int) - 1 AS first").selectExpr(*(f"`{c}`" for c in asked.columns), verdict)
    return out.withColumn("defective", F.col("defective") | F.coalesce(F.col(question).rlike(r"\S") & is_empty(F.col(answer)), F.lit(False)))
