"""Problem 3: unusable answers, each with the first defect that fits.

``empty``            null, or nothing but blanks, signs or a word that stands for "no value"
``refusal``          every sentence accompanies a refusal or is one by a grammar over classes of words; at least one is
``copied_question``  greedy string tiling covers the answer by the question but for a lead-in and a changed word
``other_language``   another script, or the function words of another language than the question's
``truncated``        a pushdown parser over fences, formulas, brackets, quotations, lists, tables and markup ends inside
                     one, or the text ends without the end of a sentence, item, row, label or formula

Empty answers are found by the JVM; the rest reach Python as Arrow batches of question and answer, a row at a time
and independent of all others.

Defined cases: records without a question (null or blank) are no case; a null answer to a question is ``empty``;
repeated rows give a row each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, deque

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What stands for "no value", in lower case and without signs and blanks.
NO_VALUE = (
    "antwort", "answer", "empty", "fehlt", "k a", "ka", "kein eintrag", "kein wert", "keine angabe", "keine antwort", "leer", "na", "n a",
    "nan", "nichts", "nil", "no answer", "none", "null", "ohne antwort", "respuesta", "réponse", "tbd", "todo", "undefined", "unbekannt",
)

#: The lexicon of the refusal grammar, lower-case words by their class.
REFUSAL_WORDS = {
    # speaker
    "S": "ich wir mir uns mich i we me us je nous me yo nosotros io noi eu nós ik wij ja",
    # ability or permission
    "M": "kann können darf dürfen möchte möchten werde werden will wollen könnte wird can could will would may able allowed peux pouvons puedo podemos posso possiamo consigo kan kunnen mogę",
    # negation
    "N": "nicht kein keine keinen keiner keinerlei keines not no nor pas aucune aucun non não niet geen nie",
    # negated ability in one word
    "U": "cannot unable won can't can’t won't won’t",
    # negated verbs of having
    "H": "don't don’t doesn't doesn’t",
    # answering and helping
    "A": "beantworten beantwortet beantworte antworten antwort antworte auskunft auskünfte helfen weiterhelfen hilfe behilflich stellung bearbeiten bearbeitet bearbeite aussage help assist assistance answer answers provide respond "
    "comply discuss répondre réponse aider fournir responder contestar ayudar informar proporcionar rispondere aiutare fornire responda ajudar beantwoorden helpen odpowiedzieć pomóc",
    # declining
    "D": "verzichten ablehnen passen decline refuse",
    # knowledge and what it rests on
    "B": "bekannt",
    "O": "ahnung",
    "K": "weiß weiss kenntnis know knowledge information informations informationen information angaben daten data context kontext sais información sé saber informazioni informação informações",
    "E": "muss müssen must",
    "X": "fehlt fehlen liegt liegen vorliegen have haben habe tengo dispongo dispone tenho gebe",
    "P": "möglich possible posible",
    "Q": "anfrage frage aufgabe question request",
}
_CLASS_OF = {word: symbol for symbol, words in REFUSAL_WORDS.items() for word in words.split()}
#: The grammar: what the classes of the words of a sentence that declines have to contain, in this order.
REFUSAL_RULES = [
    "M[^A]*N.*A", "S.*[UH].*[AK]", "S.*N.*M.*A", "U[SQ]*A", "[UH].*A", "M.*S.*N.*A",  # kann ... nicht beantworten; I cannot help
    "E.*D", "S.*D.*E",  # muss ... ablehnen; ich passen muss
    "XS", "SX.*[NK]", "SX$", "X.*S.*N", "SNB", "S.*N[^A]*[KBO]", "S.*N.*P", "NP.*A",  # mir fehlen; mir ... nicht bekannt; mir nicht möglich
    "X.*S.*N.*A", "Q.*M.*N.*A", "Q.*A.*N", "S[^A]*K.*N", "NO", "S.*N.*X.*K", "S.*[NH].*X.*K", "SH.*K", "NM.*A", "NX.*A", "S.*N.*A",
]
_RULES = re.compile("|".join(REFUSAL_RULES))
#: How sentences begin that only accompany such a sentence.
ACCOMPANYING = (
    "es tut mir leid", "es tut mir sehr leid", "tut mir leid", "tut mir sehr leid", "entschuldig", "verzeih", "bitte ", "gern", "ich bitte", "wenden sie", "i'm sorry", "i’m sorry", "i am sorry", "sorry", "unfortunately", "please ",
    "i would be happy", "i can be happy", "let me know", "feel free", "apolog", "désolé", "je suis", "je regrette", "veuillez", "lo siento", "por favor", "mi dispiace", "desculp",
)

#: Frequent function words by language.
FUNCTION_WORDS = {
    "de": "der die das den dem des ein eine einen einem einer eines und oder nicht ist sind wird werden mit für auf von zu im am bei aus als auch nach nur wenn dass durch über sich man sie er es welche was wie unter zwischen ohne ob warum wodurch",
    "en": "the a an of and or not is are be with for on from to in at by as also only when that this which what how why it its than into without between does each whether both",
    "fr": "le la les un une des du de et ou ne pas est sont avec pour sur dans par que qui ce cette il elle on au aux plus se sa son ses en afin donc lorsque",
    "es": "el la los las un una unos del de y o no es son con para por que se su sus en al lo más como cuando este esta esto debe hay además",
    "it": "il lo la gli le un una di del della e o non è sono con per che si su nel nella da dal come quando questo questa più deve",
    "pt": "o a os as um uma do da dos das e ou não é são com para por que se em no na ao como quando este esta isto mais deve",
    "nl": "de het een en of niet is zijn wordt met voor op van te in bij uit als ook naar door over zich men dat die deze wanneer zonder",
    "pl": "i w na z do nie jest są się że to jak przez dla od po za oraz lub który która które gdy przy",
    "tr": "ve bir bu için ile olarak da de ne gibi daha çok olan değil ise kadar sonra",
    "sv": "och en ett den det de som inte är med för på av till i vid från om att när eller utan mellan",
}
_LANGUAGES = {language: frozenset(words.split()) for language, words in FUNCTION_WORDS.items()}
_SPOKEN_IN: dict[str, list[str]] = {}
for _language, _words in _LANGUAGES.items():
    for _word in _words:
        _SPOKEN_IN.setdefault(_word, []).append(_language)
_SCRIPTS = [("latin", 0x41, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x77F), ("indic", 0x900, 0xDFF), ("thai", 0xE00, 0xE7F), ("hangul", 0xAC00, 0xD7AF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF)]

_WORDS = re.compile(r"[^\W_]+")
_LETTERS = re.compile(r"[^\W\d_]+")
_SENTENCES = re.compile(r"(?<=[.!?;])\s+|\n+")
_SPOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")


def classes(sentence: str) -> str:
    """The classes of the words of a sentence that the refusal grammar knows."""
    return "".join(_CLASS_OF.get(word, "") for word in _SPOKEN.findall(sentence))


def declines(answer: str) -> bool:
    """Whether an answer consists of sentences that the grammar derives and of such that accompany them."""
    found = False
    for sentence in _SENTENCES.split(answer.lower()):
        sentence = sentence.strip(" \t\"'„“”*_-–.!;,")
        if not sentence:
            continue
        if _RULES.search(classes(sentence)):
            found = True
        elif not sentence.startswith(ACCOMPANYING):
            return False
    return found


def tiles(a: list[str], b: list[str], least: int = 2) -> list[tuple[int, int, int]]:
    """Greedy string tiling: maximal common runs ``(at in a, at in b, length)``, long ones first, none overlapping.

    Runs are looked for by their first words, half as many each time; each place of ``b`` is tried once for a length, so
    that words that are there again and again cost no more than others.
    """
    used_a, used_b, out = bytearray(len(a)), bytearray(len(b)), []
    length = 1 << max(min(len(a), len(b)), 1).bit_length() - 1
    while length >= least:
        places: dict[tuple[str, ...], deque[int]] = {}
        for j in range(len(b) - length + 1):
            if not any(used_b[j : j + length]):
                places.setdefault(tuple(b[j : j + length]), deque()).append(j)
        i = 0
        while i <= len(a) - length:
            found = None if any(used_a[i : i + length]) else places.get(tuple(a[i : i + length]))
            while found and any(used_b[found[0] : found[0] + length]):
                found.popleft()
            if not found:
                i += 1
                continue
            j, n = found.popleft(), length
            while i + n < len(a) and j + n < len(b) and not used_a[i + n] and not used_b[j + n] and a[i + n] == b[j + n]:
                n += 1
            used_a[i : i + n], used_b[j : j + n] = b"\1" * n, b"\1" * n
            out.append((i, j, n))
            i += n
        if length == least:
            break
        length = max(least, length // 2)
    return out


def copies_question(question: str, answer: str) -> bool:
    """Whether the question covers the answer but for a lead-in before it and a changed word in each repetition."""
    q, a = _WORDS.findall(question.lower()), _WORDS.findall(answer.lower())
    if not q or not a:
        return False
    common = Counter(q)
    if sum(word in common for word in a) < 0.6 * len(a):
        return False
    times = max(1, round(len(a) / len(q)))
    changed = max(2, len(q) // 10) * times
    # no tiling covers a word more often than the question has it
    if len(a) - sum(min(n, common[word] * times) for word, n in Counter(a).items()) > 8 + changed:
        return False
    covered = [False] * len(a)
    for i, _, n in tiles(a, q * times):
        covered[i : i + n] = [True] * n
    if sum(covered) < 0.6 * len(q):
        return False
    first = covered.index(True)
    lead = 0 if first <= 2 and len(a) <= len(q) * times else first
    open_words = covered[lead:].count(False)
    return lead <= 8 and open_words <= changed and len(a) - lead <= len(q) * times + times


def script_of(text: str) -> str | None:
    """The script of most letters."""
    if text.isascii():
        return "latin" if _LETTERS.search(text) else None
    counts: Counter[str] = Counter()
    for run in _LETTERS.findall(text):
        code = ord(run[0])
        counts[next((name for name, low, high in _SCRIPTS if low <= code <= high), "other")] += len(run)
    return counts.most_common(1)[0][0] if counts else None


_MARKUP = re.compile(r"```.*?(?:```|$)|\$\$?[^$]*\$\$?|`[^`\n]*`|[„“\"»«][^„“”\"»«]{0,80}[“”\"»«]", re.S)


def language_shares(text: str) -> tuple[dict[str, float], int]:
    """For each language the share of the text's words that are its function words, and the number of words."""
    found = _LETTERS.findall(_MARKUP.sub(" ", text).lower())
    counts = dict.fromkeys(_LANGUAGES, 0)
    for word in found:
        for language in _SPOKEN_IN.get(word, ()):
            counts[language] += 1
    return {language: n / max(1, len(found)) for language, n in counts.items()}, len(found)


def other_language(question: str, answer: str) -> bool:
    """Whether an answer of some length is in another language than its question."""
    asked, given = script_of(question), script_of(answer)
    if asked and given and asked != given:
        return sum(len(w) for w in _LETTERS.findall(answer)) >= 8
    question_shares, _ = language_shares(question)
    answer_shares, n = language_shares(answer)
    expected = max(question_shares, key=lambda k: question_shares[k])
    spoken = max(answer_shares, key=lambda k: answer_shares[k])
    if spoken == expected or n < 6 or question_shares[expected] < 0.1:
        return False
    return answer_shares[spoken] >= 0.15 and answer_shares[spoken] >= 1.6 * answer_shares[expected] and question_shares[expected] >= 1.3 * question_shares[spoken]


_BRACKETS = {"(": ")", "[": "]", "{": "}", "„": "“”", "«": "»", "»": "«", "\\(": "\\)", "\\[": "\\]"}
#: Structures that one sign opens and closes.
_PAIRED = ("```", "$$", "$", "`", "**", "__", "~~", '"')
#: What may go on over a blank line.
_BLOCKS = ("```", "$$", "\\[", "pre", "table", "ul", "ol", "div")
_CLOSED_TAGS = frozenset("a b blockquote code div em i ol pre s span strong sub sup table u ul".split())
_CUT_MARK = re.compile(r"(?:\[|\()?(?:\.{3,}|…)(?:\]|\))?$")
_ITEM = re.compile(r"^\s*(?:([-*•+])|(\d{1,3})[.)])(?:\s+(\S.*))?$")
_SOUND_LINE = re.compile(
    r"^\s*#{1,6}\s+\S"  # a heading
    r"|^[^\W\d_][\w ()/-]{0,40}:\s*[^\s.]+(?:\s[^\s.]+){0,2}$"  # a label with its value
    r"|(?:[.!?]\s+|^)[A-ZÄÖÜ][\w-]*:\s*[^\s.]+(?:\s[^\s.]+)?$"
)
_TOKENS = re.compile(r"```|\$\$|\\[()\[\]]|\\[{}$|\\]|\n\s*\n|</?[A-Za-z][A-Za-z0-9]*(?:\s[^<>\n]*)?/?>|\*\*|__|~~|[()\[\]{}„“”«»$`\"]")
_OPEN_TAG = re.compile(r"</?[A-Za-z]*(?:\s[^<>\n]*)?$")
_STRUCTURED = re.compile(r"[`$\\()\[\]{}„“”«»\"<]|\*\*|__|~~")


def open_structures(text: str) -> list[str]:
    """Pushdown parse: the structures that a text leaves open, the innermost last."""
    stack: list[str] = []
    for match in _TOKENS.finditer(text):
        token, top = match.group(), stack[-1] if stack else ""
        before, after = text[match.start() - 1 : match.start()] or " ", text[match.end() : match.end() + 1] or " "
        if token[0] == "\n":
            # a paragraph ends what stands within lines
            while stack and stack[-1] not in _BLOCKS:
                stack.pop()
        elif top in ("```", "`", "$", "$$", "\\(", "\\[") and token != top and token != _BRACKETS.get(top):
            if token == "```" and "```" in stack:
                del stack[stack.index("```") :]
        elif token in _PAIRED:
            if top == token:
                stack.pop()
            elif token in stack:
                del stack[stack.index(token) :]
            elif token in ("```", "$$", "$", "`") or not after.isspace() and not before.isalnum():
                # emphasis and quotations begin before a word
                stack.append(token)
        elif token[0] == "<":
            name = token.strip("</>").split()[0].lower()
            if name in _CLOSED_TAGS and token[1] != "/" and token[-2] != "/":
                stack.append(name)
            elif token[1] == "/" and name in stack:
                del stack[len(stack) - 1 - stack[::-1].index(name) :]
        elif stack and top in _BRACKETS and token in (_BRACKETS[top] if len(top) == 1 else (_BRACKETS[top],)):
            stack.pop()
        elif token in _BRACKETS:
            stack.append(token)
    return stack


def _open_item(line: str, before: list[str]) -> bool | None:
    """Whether a last line is an item or a row that isn't finished; nothing if it is neither."""
    row = line.strip()
    if row.startswith("|"):
        rows = [x.strip() for x in before if x.strip().startswith("|")]
        return not row.endswith("|") or len(row) == 1 or bool(rows) and rows[-1].count("|") != row.count("|")
    item = _ITEM.match(line)
    if not item:
        return None
    others = [m for m in map(_ITEM.match, before) if m]
    bullet, number, rest = item.groups()
    if rest is None:
        return any(m.group(1) == bullet if bullet else (m.group(2) or "") == str(int(number) - 1) for m in others)
    # an item of a list of sentences is one itself
    sentences = [m.group(3) for m in others if m.group(3)]
    return len(sentences) >= 2 and all(x.rstrip()[-1] in ".!?" for x in sentences) and rest.rstrip("*_~ ")[-1:] not in tuple(".!?:)`$\"“”»]}")


def stops_inside(text: str) -> bool:
    """Whether a text ends inside a structure, an item or a row, or without an end of its own."""
    text = text.rstrip(" \t\r\n​﻿ ")
    if not _WORDS.search(text):
        return False
    if _CUT_MARK.search(text) or _OPEN_TAG.search(text, text.rfind("<") if "<" in text else len(text)):
        return True
    if _STRUCTURED.search(text) and any(opened not in ("»", "“") for opened in open_structures(text)):
        return True
    lines = text.split("\n")
    unfinished = _open_item(lines[-1], lines[:-1])
    if unfinished is not None:
        return unfinished
    if text.rstrip("*_~")[-1:] in tuple(".!?:|`$)]}“”\"»«>"):
        return False
    return not _SOUND_LINE.search(lines[-1])


def defect_of(question: str, answer: str) -> str | None:
    """The first defect of an answer that isn't empty."""
    if declines(answer):
        return "refusal"
    if copies_question(question, answer):
        return "copied_question"
    if other_language(question, answer):
        return "other_language"
    return "truncated" if stops_inside(answer) else None


@F.pandas_udf(T.StringType())
def _defects(questions: pd.Series, answers: pd.Series) -> pd.Series:
    return pd.Series([None if q is None or a is None else defect_of(q, a) for q, a in zip(questions, answers)], dtype=object)


def is_empty(text: Column) -> Column:
    """Null, or nothing but blanks, signs or a word that stands for "no value"."""
    sign = r"[^\p{L}\p{N}]"
    words = "|".join(word.replace(" ", f"{sign}++") for word in NO_VALUE)
    return text.isNull() | F.lower(text).rlike(rf"^{sign}*+(?:{words}){sign}*+\z") | ~text.rlike(r"[\p{L}\p{N}]")


def with_defect(df: DataFrame, question: str, answer: str) -> DataFrame:
    """``df`` with the column ``defect``, null for sound pairs and for records without a question."""
    asked, empty = F.col(question).rlike(r"\S"), is_empty(F.col(answer))
    # only pairs that the JVM can't settle are sent to Python
    looked_at = [F.when(asked & ~empty, F.col(c)) for c in (question, answer)]
    return df.withColumn("defect", F.when(asked & empty, "empty").otherwise(_defects(*looked_at)))


def defective_pairs(df: DataFrame, question: str, answer: str) -> DataFrame:
    """``df`` with a column ``defect`` in place of question and answer; only defective pairs remain."""
    return with_defect(df, question, answer).where("defect IS NOT NULL").drop(question, answer)
