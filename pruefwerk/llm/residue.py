"""Problem 8: records that hold template residue, filler, error pages or script notices instead of content.

Method: a regularized linear classifier over hashed word n-grams, length, shape and title features of the parts of a
text (sentences and lines), trained on weak labels from response statuses, phrases and shapes. What a weak label says of
a short record isn't believed inside a text of other parts: there, such a part explains or quotes. The classifier is
fitted on at most ``TRAIN_SHORT`` short and ``TRAIN_LONGER`` longer documents and ``TRAIN_PARTS`` parts of each kind,
from most hosts; the hosts left out validate it. Every part of every document is scored, many documents at a time as
one sparse product, and the scores alone decide.

A document is a ``placeholder`` if any part is one; it is ``filler``, ``error_page`` or ``script_notice`` if parts of
these kinds hold at least half of its words.

Defined cases: null, empty and blank texts are never found; repeated rows give a row each; an empty table, or one in
which no kind can be learned, gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from ..session import cut_lineage

KINDS = ["content", "placeholder", "filler", "error_page", "script_notice"]
#: Bounds of what the classifier is fitted on; of the parts of content four times as many.
TRAIN_SHORT, TRAIN_LONGER, TRAIN_PARTS = 10_000, 3_000, 3_000
#: What a part of residue counts in the training; one of content counts 1.
RESIDUE_WEIGHT = 2.0
#: Short documents have at most so many code points; most residue is among them.
SHORT_TEXT = 600
#: A host in so many is left out of the training.
HELD_OUT = 4
BUCKETS = 1 << 14
#: Share of a document's words in residue from which on it is residue.
RESIDUE_SHARE = 0.5
#: So many characters are featurized and scored at once.
BLOCK_CHARS = 1 << 18

#: Marks of a field of a template and of left-out code, from the private-use area, so that no text has them.
FIELD, CODE = "\ue000", "\ue001"

#: Formulas and code; each pattern with what it begins with, as a text without that needn't be searched.
_CODE = [
    ("```", re.compile(r"```.*?(?:```|\Z)", re.S)), ("`", re.compile(r"`[^`\n]*`")), ("$", re.compile(r"\$\$?[^$\n]{1,160}\$\$?")),
    ('f"', re.compile(r'f"[^"\n]{0,120}"')), ("printf(", re.compile(r"printf\([^)\n]*\)")),
]
_FIELD = re.compile(
    r"\{\{[^{}\n]{1,60}\}\}|\{%[^%\n]{1,60}%\}|<%=?[^%\n]{1,60}%>|\$\{\w[\w.]{0,40}\}|\{[^\W\d]\w{1,40}\}|\[\[[^\[\]\n]{1,60}\]\]"
    r"|@@\w{2,40}@@|#[A-ZÄÖÜ][A-ZÄÖÜ_]{2,40}#|%[A-ZÄÖÜ][A-ZÄÖÜ_]{2,40}%|__[A-ZÄÖÜ][A-ZÄÖÜ_]{1,40}__|«\w{2,40}»|<insert [^>\n]{1,60}>|<[A-ZÄÖÜ][A-ZÄÖÜ_ ]{2,50}>|\bX{4,}\b"
    r"|\[[^\[\]\n]{1,50}?(?:\.\.\.|…|ergänzen|eintragen|einfügen|einsetzen|angeben|folgt|here|TODO)\]"
)
_FIELD_SIGNS = ("{", "<", "[", "@@", "«", "__", "%", "#", "XXXX")
_PARTS = re.compile(r"\s(?:(?<=[.!?]\s)|(?<=\n))\s*")
_WORD = re.compile(rf"\w+|\n|{FIELD}|[<>|=~*#]{{2,}}|[-.]{{4,}}")
_DIGITS = re.compile(r"\d+")
#: Keys of the left hand and of the home row, and words that have no other letters.
_HOME_ROW = frozenset("qwertzasdfghjklöäyxcvb")
_WRITTEN = frozenset("das der des er erst es fast hat ist jede jeder lesen letzte rest satz sehr statt takt wert werte".split())
_SCRIPT = re.compile(r"script|skript|\bjs\b|inhalte|active content", re.I)
#: A response status at the beginning of a part.
_STATUS = re.compile(r"^\W*(?:http\S*|status|error|fehler|code)?\W{0,3}[45]\d\d\b", re.I)
#: Phrases that give weak labels.
_WEAK = {
    "script_notice": re.compile(
        r"(?:javascript|\bjs\b|skripte?n?\b|scripts?\b|scripting|aktive[nr]? inhalte|active content).{0,90}(?:aktivier|einschalt|einzuschalt|schalten|erlaub|zulassen|zugelassen|freigeb|blockier|unterdrück|verweiger|deaktiviert|abgeschaltet|benötig|erforderlich|enable|turn(?:ed)? o|requir|needs|disabled|blocked|allow)"
        r"|(?:aktivier|einschalt|eingeschalt|schalten|erlaub|zulassen|freigeb|blockier|unterdrück|verweiger|benötigt|erforderlich|enable|turn on|requires?|needs?|blocking|unterstützt keine|without|ohne).{0,60}(?:javascript|\bjs\b|skripte?\b|scripts?\b|scripting|aktive inhalte|active content)", re.I),
    "error_page": re.compile(
        r"traceback \(most recent|^\W*[\w.]*(?:error|exception): |^\s*(?:warning|fatal error|fehler): |\bon line \d+|^file \"|^at \w+\.[\w.$]+|connection (?:refused|reset|closed)"
        r"|nicht gefunden|not found|(?:zugriff|kein zugriff).{0,20}(?:verweigert|rolle)|access (?:denied|forbidden)|forbidden|timed out|abgelaufen after|bad gateway|unerwarteter fehler|ein fehler aufgetreten|fehlgeschlagen \(|konnte nicht (?:geladen|gefunden)|could not be (?:loaded|found)"
        r"|existiert nicht|does not exist|(?:wurde|been) (?:entfernt|removed|verschoben)|nicht vorhanden|temporarily (?:blocked|unavailable)|vorübergehend|wartungsarbeiten|maintenance|something went wrong|erforderlichen rechte|hoppla", re.I),
    "filler": re.compile(
        r"lorem|\bipsum\b|^\W*(?:dies ist )?(?:ein )?blindtext|platzhaltertext|nur ein platzhalter|sample text|dummy (?:text|words)\b|coming soon|your (?:own )?(?:text|content)\b|^\W*(?:text |inhalt |weiteres )?folgt\b|noch geschrieben|später der eigentliche|richtige text folgt|hier entsteht|den platz zu füllen|under construction|im aufbau\b|^\W*(?:tbd|todo)\b|to be added|\basdf\b|in kürze", re.I),
}
#: Words from which on a part is a sentence, and unlabelled words from which on there is real content.
_PROSE, _CONTENT = 6, 10


def parts_of(text: str) -> list[str]:
    """The sentences and lines of a text, fields of a template marked."""
    plain = text
    for begin, pattern in _CODE:
        if begin in plain:
            plain = pattern.sub(f" {CODE} ", plain)
    if any(sign in plain for sign in _FIELD_SIGNS):
        plain = _FIELD.sub(f" {FIELD} ", plain)
    return [part for part in _PARTS.split(plain) if part.strip()]


#: What is known of a word: its hash in the low bits, then flags, then its number of letters, 255 at most.
_HASH, _NARROW, _HOME, _ALPHA, _LETTERS = np.uint64((1 << 34) - 1), np.uint64(1 << 40), np.uint64(1 << 41), np.uint64(1 << 42), np.uint64(48)


class _Hashes(dict):
    """Hash and flags of the words seen, numbers alike; emptied at ``most``. A line break, between two parts, is 0."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        if word == "\n":
            value = 0
        else:
            letters = "".join(filter(str.isalpha, word))
            value = crc32(("longrun" if len(word) >= 30 else _DIGITS.sub("0", word)).encode()) + 1
            if letters:
                signs = set(letters)
                value |= int(_ALPHA) | (int(_NARROW) if len(signs) <= 2 else 0) | (int(_HOME) if signs <= _HOME_ROW and word not in _WRITTEN else 0) | min(len(letters), 255) << 48
        self[word] = value
        return value


_SHAPES = {name: [crc32(f"shape {name} {i}".encode()) % BUCKETS for i in range(12)] for name in ("repeats", "keys", "one", "field")}
_LENGTHS = np.array([crc32(f"length {i}".encode()) % BUCKETS for i in range(8)])
_FIELD_HASH = np.uint64(crc32(FIELD.encode()) + 1)
_SIGNS, _LOWER = ([crc32(name) % BUCKETS] for name in (b"shape signs", b"shape lower"))


@dataclass
class Features:
    """Buckets ``ids`` of parts, the part ``of`` each, and for each part its document, words and whether its shape is odd."""

    ids: np.ndarray
    of: np.ndarray
    document: np.ndarray
    n_words: np.ndarray
    odd: np.ndarray


def _distinct(of: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
    """How many different words each of ``n`` owners has; ``words`` are under 2 ** 33."""
    own = np.sort((of.astype(np.uint64) << np.uint64(33)) + words)
    first = np.r_[True, own[1:] != own[:-1]][: len(own)]
    return np.bincount((own[first] >> np.uint64(33)).astype(np.int64), minlength=n)


def features(documents: list[list[str]], hashes: _Hashes) -> Features:
    """N-grams, length, shape and title features of the parts of documents, all documents at once."""
    parts = [part for document in documents for part in document]
    document = np.repeat(np.arange(len(documents)), [len(x) for x in documents])
    words = _WORD.findall("\n" + "\n".join(parts).lower() + "\n")
    known = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    hashed = known & _HASH
    breaks = hashed == 0
    part = np.cumsum(breaks) - 1
    of_words, own, known = part[~breaks], hashed[~breaks], known[~breaks]
    pairs = ((hashed[:-1] * np.uint64(0x9E3779B1) + hashed[1:] * np.uint64(0x85EBCA77)) >> np.uint64(7)) % np.uint64(BUCKETS)
    pair_part = np.where(breaks[1:], part[:-1], part[1:])
    # the first words of a document are its title
    begins = np.flatnonzero(np.r_[True, document[1:] != document[:-1]][: len(document)])
    places = np.arange(len(own)) - np.searchsorted(of_words, of_words)
    titled = np.isin(of_words, begins) & (places < 6)
    titles = ((own[titled] * np.uint64(0xC2B2AE35)) >> np.uint64(9)) % np.uint64(BUCKETS)

    count = lambda which=None: np.bincount(of_words if which is None else of_words[which], minlength=len(parts))
    n_words, alpha = count(), (known & _ALPHA) > 0
    n_alpha, letters = count(alpha), np.bincount(of_words, known >> _LETTERS, len(parts))
    in_document = np.bincount(document, n_words, len(documents)).astype(np.int64)
    few = (in_document >= 6) & (_distinct(document[of_words], own, len(documents)) <= np.minimum(3, in_document // 4))
    shapes = {
        "repeats": few[document] | (n_words >= 4) & (3 * _distinct(of_words, own, len(parts)) <= n_words),
        "keys": (n_alpha >= 3) & (letters >= 8) & (count(alpha & ((known & _HOME) == 0)) == 0),
        "one": (letters >= 5) & (count(alpha & ((known & _NARROW) == 0)) == 0),
        "field": count(own == _FIELD_HASH) > 0,
    }
    plain = [(_SIGNS, n_alpha == 0), (_LOWER, np.fromiter((p[:1].islower() for p in parts), bool, len(parts)))]
    # n-grams of a part that repeats itself count once
    spoken = np.concatenate([own % np.uint64(BUCKETS), pairs]).astype(np.int64), np.concatenate([of_words, pair_part])
    again = shapes["repeats"][spoken[1]]
    once = np.unique(spoken[1][again] * BUCKETS + spoken[0][again])
    shaped = [(np.tile(buckets, int(which.sum())), np.repeat(np.flatnonzero(which), len(buckets))) for buckets, which in [*((_SHAPES[k], v) for k, v in shapes.items()), *plain]]
    ids = [spoken[0][~again], once % BUCKETS, titles, _LENGTHS[np.minimum(n_words, 21) // 3], *(x for x, _ in shaped)]
    of = [spoken[1][~again], once // BUCKETS, of_words[titled], np.arange(len(parts)), *(x for _, x in shaped)]
    odd = shapes["repeats"] | shapes["keys"] | shapes["one"]
    return Features(np.concatenate([x.astype(np.int64) for x in ids]), np.concatenate(of), document, np.maximum(n_words, 1), odd)


def weak_kinds(parts: list[str], odd: np.ndarray) -> list[str | None]:
    """Weak labels of the parts of a text, some of them of an ``odd`` shape; null where there is no opinion."""
    found = []
    for part, is_odd in zip(parts, odd):
        kind = "placeholder" if FIELD in part else "error_page" if _STATUS.search(part) else None
        if kind is None:
            kind = next((k for k, pattern in _WEAK.items() if (k != "script_notice" or _SCRIPT.search(part)) and pattern.search(part)), None)
        found.append("filler" if kind is None and is_odd else kind)
    sizes = [len(p.split()) for p in parts]
    prose = sum(n for n, kind in zip(sizes, found) if kind is None and n >= _PROSE)
    residue = sum(n for n, kind in zip(sizes, found) if kind not in (None, "placeholder"))
    if not residue or prose >= max(residue, _CONTENT):
        # real content surrounds the phrase: it explains or quotes
        return [kind if kind == "placeholder" else "content" if kind or n >= _PROSE or CODE in part else None for kind, n, part in zip(found, sizes, parts)]
    main = max(set(found) - {None, "placeholder"}, key=lambda k: (sum(n for n, x in zip(sizes, found) if x == k), k))
    return [kind if kind else main if n < 2 * _PROSE else None for kind, n in zip(found, sizes)]


def blocks(texts: list[str]) -> Iterator[list[str]]:
    """Texts in their order, together about ``BLOCK_CHARS`` long."""
    begin = size = 0
    for at, text in enumerate(texts):
        size += len(text)
        if size >= BLOCK_CHARS:
            yield texts[begin : at + 1]
            begin, size = at + 1, 0
    if begin < len(texts):
        yield texts[begin:]


def training_parts(documents: DataFrame) -> DataFrame:
    """``label, ids`` of a bounded number of weakly labelled parts."""

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            keys = iter(batch.column(0).to_pylist())
            for texts in blocks(batch.column(1).to_pylist()):
                documents = [parts_of(text) for text in texts]
                found = features(documents, hashes)
                order = np.argsort(found.of, kind="stable")
                ids, ends = found.ids[order], np.cumsum(np.bincount(found.of, minlength=len(found.document)))
                rows, at = [], 0
                for parts in documents:
                    doc = next(keys)
                    for i, kind in enumerate(weak_kinds(parts, found.odd[at : at + len(parts)])):
                        if kind is not None:
                            rows.append((float(KINDS.index(kind)), crc32(f"{doc} {i}".encode()), ids[ends[at - 1] if at else 0 : ends[at]]))
                        at += 1
                columns = list(zip(*rows)) or [[]] * 3
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.float64(), pa.int64(), pa.list_(pa.int64())))], ["label", "at", "ids"])

    labelled = documents.select("doc_id", "text").mapInArrow(label, "label double, at bigint, ids array<bigint>")
    # four shares of content, each limited before the shuffle
    share = F.when(F.col("label") == 0, F.pmod(F.col("at"), F.lit(4))).otherwise(0)
    numbered = labelled.withColumn("n", F.row_number().over(Window.partitionBy("label", share).orderBy("at")))
    return numbered.where(F.col("n") <= TRAIN_PARTS).select("label", F.col("ids").cast("array<string>").alias("ids"))


def fitted(documents: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """Weights and intercepts of the classifier, from hosts that aren't held out; nothing if only content is known."""
    open_hosts = documents.where(~held_out())
    short = F.length("text") <= SHORT_TEXT
    n = open_hosts.agg(F.count_if(short).alias("short"), F.count_if(~short).alias("longer")).first()
    share = F.when(short, TRAIN_SHORT / max(1, n["short"])).otherwise(TRAIN_LONGER / max(1, n["longer"]))
    bounded = open_hosts.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000)
    parts = cut_lineage(training_parts(bounded).repartition(8))
    if parts.select("label").distinct().count() < 2:
        return None
    counted = CountVectorizerModel.from_vocabulary([str(i) for i in range(BUCKETS)], "ids", "features").transform(parts)
    counted = counted.withColumn("weight", F.when(F.col("label") == 0, 1.0).otherwise(RESIDUE_WEIGHT))
    model = LogisticRegression(family="multinomial", weightCol="weight", regParam=2e-5, maxIter=60, standardization=False).fit(counted)
    weights, intercepts = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    full_weights, full_intercepts = np.zeros((len(KINDS), BUCKETS)), np.full(len(KINDS), -1e9)
    full_weights[: len(weights)], full_intercepts[: len(intercepts)] = weights, intercepts
    return full_weights, full_intercepts


def held_out():
    return F.pmod(F.xxhash64(F.coalesce("source", F.lit(""))), F.lit(HELD_OUT)) == 0


def kinds_of(texts: list[str], weights: np.ndarray, intercepts: np.ndarray, hashes: _Hashes) -> list[str | None]:
    """The kinds of residue that texts are; ``weights`` has a row for each kind."""
    found = features([parts_of(text) for text in texts], hashes)
    n = len(KINDS)
    scores = np.stack([np.bincount(found.of, w[found.ids], len(found.document)) + b for w, b in zip(weights, intercepts)], axis=1)
    best = scores.argmax(axis=1)
    words = np.bincount(found.document * n + best, found.n_words, len(texts) * n).reshape(-1, n)
    kinds = 2 + words[:, 2:].argmax(axis=1)
    kinds[words[:, 2:].sum(axis=1) < RESIDUE_SHARE * words.sum(axis=1)] = 0
    kinds[words.sum(axis=1) == 0] = 0
    kinds[words[:, 1] > 0] = 1
    return [KINDS[k] if k else None for k in kinds]


def residue(documents: DataFrame) -> DataFrame:
    """``doc_id, kind`` of the documents without real content. ``documents``: ``doc_id, source, text``."""
    return scored(documents).where("kind IS NOT NULL").select("doc_id", "kind")


def scored(documents: DataFrame) -> DataFrame:
    """``doc_id, source, kind``: what the classifier says of each document with a text."""
    filled = documents.select("doc_id", "source", "text").where(r"text rlike '\\S'")
    model = fitted(filled)
    schema = "doc_id bigint, source string, kind string"
    if model is None:
        return documents.sparkSession.createDataFrame([], schema)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, intercepts, hashes = *shared.value, _Hashes()
        for batch in batches:
            kinds = [kind for texts in blocks(batch.column(2).to_pylist()) for kind in kinds_of(texts, weights, intercepts, hashes)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kinds, pa.string())], ["doc_id", "source", "kind"])

    return filled.mapInArrow(score, schema)


def validation(documents: DataFrame) -> DataFrame:
    """On the hosts left out: for each kind how many documents the weak labels and the classifier name, and both."""

    @F.pandas_udf(T.StringType())
    def weak_kind(texts: pd.Series) -> pd.Series:
        out = []
        hashes = _Hashes()
        for text in texts:
            parts = parts_of(text)
            kinds = weak_kinds(parts, features([parts], hashes).odd)
            named = [k for k in kinds if k not in (None, "content")]
            out.append("placeholder" if "placeholder" in kinds else max(sorted(set(named)), key=named.count) if named else None)
        return pd.Series(out, dtype=object)

    unseen = documents.where(held_out() & F.col("text").rlike(r"\S"))
    weak = unseen.select("doc_id", weak_kind("text").alias("weak_label"))
    both = scored(documents).where(held_out()).join(weak, "doc_id")
    kinds = both.select(F.explode(F.array_distinct(F.array(F.coalesce("kind", F.lit("content")), F.coalesce("weak_label", F.lit("content"))))).alias("label"), "kind", "weak_label")
    is_found, is_weak = (F.coalesce(c, F.lit("content")) == F.col("label") for c in ("kind", "weak_label"))
    return kinds.groupBy(F.col("label").alias("kind")).agg(
        F.count_if(is_weak).alias("n_weak"), F.count_if(is_found).alias("n_found"), F.count_if(is_weak & is_found).alias("n_both")
    )
