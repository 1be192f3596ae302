"""Text functions as Column -> Column, evaluated by the JVM. A null text counts as empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns, words and limits that results depend on.
BLANKS = r"[ \t\n\x0B\f\r]"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"
MATH_COMMANDS = ("\\frac", "\\sum", "\\int", "\\begin", "\\prod", "\\lim")
DIAGRAM_WORDS = ("abbildung", "figur", "graph", "diagramm", "skizze", "schema", "pfeil", "darstellung")
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


def ensure_str(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def strip(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"^{BLANKS}+", ""), f"{BLANKS}+$", "")


def normalize_whitespace(text: Column) -> Column:
    """No control characters, single blanks, none at line ends, at most one empty line."""
    out = F.regexp_replace(ensure_str(text), CONTROL, "")
    for pattern, stands in ((r"[ \t]+", " "), (r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n")):
        out = F.regexp_replace(out, pattern, stands)
    return strip(out)


def sanitize_latex(text: Column) -> Column:
    """Formulas between backslash brackets and parentheses get dollar signs."""
    out = F.regexp_replace(ensure_str(text), CONTROL, "")
    out = F.regexp_replace(out, r"(?s)\\\[(.+?)\\\]", r"\$\$$1\$\$")
    return strip(F.regexp_replace(out, r"(?s)\\\((.+?)\\\)", r"\$$1\$"))


def collapse_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(ensure_str(text), f"{BLANKS}+", " "))


def post_process(text: Column) -> Column:
    """Without an introducing first line, code fence and trailing page number."""
    first = F.substring_index(text, "\n", 1)
    rest = F.regexp_replace(text, r"^[^\n]*\n?", "")
    body = F.when(first.startswith("Hier ist") | first.startswith("Gerne"), strip(rest)).otherwise(text)
    fenced = strip(F.replace(F.replace(F.regexp_replace(body, "^`+|`+$", ""), F.lit("markdown"), F.lit("")), F.lit("latex"), F.lit("")))
    body = F.when(body.startswith("```"), fenced).otherwise(body)
    return strip(F.regexp_replace(body, r"\n\s*\$?\d+\$?\s*$", ""))


def is_math_heavy(text: Column) -> Column:
    special = F.regexp_count(text, F.lit(r"[\\$|_^{}\[\]]"))
    commands = F.lit(False)
    for command in MATH_COMMANDS:
        commands = commands | F.contains(text, F.lit(command))
    return (F.length(text) >= 50) & ((special / F.length(text) > 0.05) | (F.regexp_count(text, F.lit(r"\|")) > 15) | commands)


def needs_page_scan(text: Column, n_images: Column) -> Column:
    """Whether a page is looked at as a whole: it speaks of a figure, is short, or has more than two images."""
    return F.lower(text).rlike("|".join(DIAGRAM_WORDS)) | (F.length(text) < 200) | (n_images > 2)


def heuristic_valid(text: Column) -> Column:
    return (F.length(text) >= 500) & (F.regexp_count(text, F.lit(r"\d{4,}")) <= 25)


def script_references(question: Column) -> Column:
    """Explicit references to the script, then implicit ones to its material."""
    found = lambda words: F.regexp_extract_all(question, F.lit(rf"(?iu)\b(?:{words})\b"), F.lit(0))
    return F.concat(found(SCRIPT_WORDS), found(MATERIAL_WORDS))


def page_marker(content: Column) -> Column:
    """The number of the first page marker."""
    return F.nullif(F.regexp_extract(content, r"(?m)^###\s+Seite\s+(\d+)\b", 1), F.lit("")).cast("int")


def any_page_marker(content: Column) -> Column:
    """The number of the first page marker, also within a line; what a canonical context goes by."""
    return F.nullif(F.regexp_extract(content, r"### Seite (\d+)", 1), F.lit("")).cast("int")


def reference_ends(reference: Column) -> tuple[Column, Column]:
    """First and last chunk id of a source reference; empty where it is none."""
    return tuple(F.regexp_extract(reference, r"^(chunk_\d+)_to_(chunk_\d+)", i) for i in (1, 2))


def token_estimate(n_chars: Column, max_tokens: int) -> Column:
    return F.floor(n_chars / 4 * 1.2).cast("bigint") + max_tokens


def retry_after(message: Column) -> Column:
    """Seconds to wait by a hint in an error message, at most a minute."""
    hint = F.nullif(F.regexp_extract(message, r"(?i)try again in ([\d.]+)s", 1), F.lit(""))
    return F.when(hint.try_cast("double").isNotNull(), F.least(hint.try_cast("double") + 0.1, F.lit(60.0)))
