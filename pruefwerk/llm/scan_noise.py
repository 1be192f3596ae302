"""Problem 4: text from scanned pages as continuous readable paragraphs, with the traces that were in it.

Method: lines at the page edges that recur within a script are running headers. They are compared by what character
recognition leaves alike, and beyond that by edit distance from the majority of each character, so that a header that is
garbled on every page is found as well. Numbers there that keep one distance from the page number are printed page numbers. Both are taken
out, and the remaining lines are joined by rules over the vocabulary of the corpus: a word divided at a line end is
put together if the whole corpus knows it in one piece, and a word that only few places have is a misreading if it
looks, to character recognition, like a frequent one.

All counts are over all pages and chunks. To the workers go the frequent words, at most ``1 / WORD_SHARE`` of them, as
sorted hashes and one block of characters (under 40 MB at that bound), and the furniture of the scripts: a row for each
script, sent to all workers only where there are few scripts.

``hyphenation``, ``misread``, ``running_header`` and ``page_number`` are the kinds of traces.

Defined cases: null texts stay null and have no traces; empty and blank texts become empty; a text without a script
has only traces that need none; repeated rows give a row each; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..session import cut_lineage

#: Words with at least this share of all words, and at least so many occurrences, are frequent.
WORD_SHARE, WORD_LEAST = 1e-6, 4
#: Of words that look alike, those with less than this share of the most frequent one are misreadings of it.
MISREAD_SHARE = 0.1
#: A line is furniture from this share of a script's pages on, and at least so many pages.
FURNITURE_SHARE, FURNITURE_LEAST = 0.1, 3
TOP_LINES, BOTTOM_LINES = 2, 3
#: Furniture of more scripts than this is joined by a shuffle instead of being sent to all workers.
BROADCAST_SCRIPTS = 20_000
#: And candidates of garbled headers only where there are no more than this.
BROADCAST_PIECES = 100_000
#: A header that no two pages spell alike counts from this share of the pages on, and at least so many pages.
GARBLED_SHARE, GARBLED_LEAST = 0.3, 4
#: Letters of a key in each of the four pieces by which garbled headers are brought together.
PIECE = 6
#: Two keys are one header if they differ by one edit in so many letters.
EDIT_EVERY = 8

#: What characters look like; those with equal images are confused.
_LOOKS = str.maketrans({
    "i": "l", "1": "l", "|": "l", "c": "e", "f": "t", "v": "u", "q": "g", "9": "g", "0": "o", "8": "b", "5": "s",
    "h": "ll", "ü": "ll", "n": "rl", "m": "rrl", "k": "le", "d": "el", "w": "uu",
})
_WORD = re.compile(r"[^\W_]+")
_LETTER_SPACED = re.compile(r"\b[^\W\d_](?: [^\W\d_]){3,}\b")
#: Code and formulas are left as they are.
_UNREAD = re.compile(r"(```.*?(?:```|\Z)|\$[^$\n]*\$|^[^\n]*\b0x[0-9A-F]{2}, [^\n]*$)", re.S | re.M)
_UNREAD_MARKED, _BYTES = re.compile(r"(```.*?(?:```|\Z)|\$[^$\n]*\$)", re.S), re.compile(r"\b0x[0-9A-F]{2}, ")
_DIGIT_INSIDE = re.compile(r"[^\W\d_]{2}[01568]+[^\W\d_]{2}|^[01568][^\W\d_]{4,}$|^[^\W\d_]{5,}[01]$")
_NUMBER = r"(?:(?:seite|blatt|page|s\.|p\.|bl\.)\s*)?\d{1,5}(?:\s*(?:/|von|of)\s*\d{1,5})?"
_NUMBER_LINE = re.compile(rf"^\s*([\[(–—|·•-]*\s*{_NUMBER}\s*[\])–—|·•-]*)\s*$", re.I)
_NUMBER_BESIDE = re.compile(rf"^\s*([\[(–—|·•-]*\s*{_NUMBER}\s*[\])–—|·•-]*)(?:\s{{2,}}|\t|\s*\|\s*)(\S.*?)\s*$|^\s*(\S.*?)(?:\s{{2,}}|\t|\s*\|\s*)([\[(–—|·•-]*\s*{_NUMBER}\s*[\])–—|·•-]*)\s*$", re.I)
_NUMBERED_TITLE = re.compile(r"^\s*([^\W\d_]{3,20})\s+(?:\d{1,3}|[IVXL]{1,6})\s*[:.–-]\s*\S")
_SENTENCE_END = re.compile(r"[.!?](?:\s|$)")
_WIDE = re.compile(r"\s{3,}")
#: Letters that a page number with its words has at most, as images.
_NUMBER_LETTERS = 20
_MARKS = ("-", "‐", "\u00ad", "¬")
_HEAD = re.compile(r"\s*([^\W\d_]+)")
_KEPT_LINE = re.compile(r"^\s*(?:[-*•+]\s|\d{1,3}[.)]\s|\||#{1,6}\s|```|\d+(?:\.\d+)+\s)")
#: Words after a hyphen that stands for the rest of another word.
_SUSPENDED = frozenset("und oder bzw sowie noch als bis statt and or to nor".split())


def looks_length(line: str) -> int:
    """The length of the image of the letters and digits of a lower-case line."""
    return sum(map(str.isalnum, line)) + sum(map(line.count, "hünkdw")) + 2 * line.count("m")


def looks(word: str) -> str:
    """The image of a lower-case word; words with equal images may be read for one another."""
    return word.translate(_LOOKS)


def line_parts(line: str) -> tuple[str, int | None, str, str | None]:
    """Key of the words of a line of furniture, its page number, the style of the number, and the kind of its title.

    The title of a chapter stands on the pages of that chapter only; its kind, as in "Chapter 3:", on all of them.
    """
    line = _WIDE.sub("  ", line)
    plain = _NUMBER_LINE.match(line)
    if plain:
        number, words = plain.group(1), ""
    else:
        beside = _NUMBER_BESIDE.match(line)
        if beside:
            number, words = (beside.group(1), beside.group(2)) if beside.group(1) else (beside.group(4), beside.group(3))
        else:
            number, words = "", line
    key = looks("".join(_WORD.findall(words.lower())))
    digits = re.search(r"\d+", number)
    title = None if _SENTENCE_END.search(words) else _NUMBERED_TITLE.match(words)
    style = re.sub(r"\d+", "#", re.sub(r"\s+", " ", number.strip()))
    return key, int(digits.group()) if digits else None, style, f"{looks(title.group(1).lower())} #" if title else None


def edges(lines: list[str]) -> list[int]:
    """The indexes of the first and last lines that aren't blank."""
    filled = [i for i, line in enumerate(lines) if line.strip()]
    return sorted({*filled[:TOP_LINES], *filled[-BOTTOM_LINES:]})


def edge_lines(pages: DataFrame) -> DataFrame:
    """``script_id, page_number, key, number, style`` of the lines at the edges of all pages."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for script, page, text in zip(*(column.to_pylist() for column in batch.columns)):
                lines = text.split("\n")
                for i in edges(lines):
                    *parts, title = line_parts(lines[i])
                    rows.append((script, page, *parts))
                    if title:
                        rows.append((script, page, title, None, ""))
            columns = list(zip(*rows)) or [[]] * 5
            types = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], ["script_id", "page_number", "key", "number", "style"])

    known = pages.where("text IS NOT NULL AND script_id IS NOT NULL").select("script_id", F.col("page_number").cast("int"), "text")
    return known.mapInArrow(read, "script_id string, page_number int, key string, number bigint, style string")


def garbled_headers(keys: DataFrame, pages: DataFrame) -> DataFrame:
    """``script_id, key`` of headers that hardly two pages spell alike.

    ``keys`` has ``script_id, key, n``, ``pages`` the ``least`` number of pages for each script. Keys with a piece in
    common are brought together, the majority of each of their letters is the header, and it counts if enough pages have
    a key at most one edit in ``EDIT_EVERY`` letters away from it.
    """
    size = F.length("key")
    places = [(0, F.lit(1)), (1, F.lit(PIECE + 1)), (2, size - 2 * PIECE + 1), (3, size - PIECE + 1)]
    pieces = F.array(*(F.struct(F.lit(i).alias("place"), F.substring(F.col("key"), at, F.lit(PIECE)).alias("piece")) for i, at in places))
    group = ["script_id", "place", "piece"]
    apart = keys.where(size >= 2 * PIECE).select("script_id", "key", "n", F.inline(pieces))
    together = apart.groupBy(*group).agg(F.sum("n").alias("n_pages"), F.count(F.lit(1)).alias("n_keys"))
    candidates = cut_lineage(together.join(pages, "script_id").where("n_keys > 1 AND n_pages >= least").select(*group, "least"))
    n = candidates.count()
    if not n:
        return keys.select("script_id", "key").limit(0)
    # a piece on so many pages is rare; if there are many, they are joined by a shuffle
    few = F.broadcast if n <= BROADCAST_PIECES else lambda df: df
    lengths = apart.join(few(candidates), group).groupBy(*group, "least", size.alias("length")).agg(F.sum("n").alias("m"))
    usual = lengths.groupBy(*group, "least").agg(F.max_by("length", F.struct("m", "length")).alias("length"))
    members = apart.join(few(usual), group)
    letters = members.where(size == F.col("length")).select(*group, "n", F.posexplode(F.split("key", "")).alias("at", "letter"))
    votes = letters.groupBy(*group, "at", "letter").agg(F.sum("n").alias("m")).groupBy(*group, "at").agg(F.max_by("letter", F.struct("m", "letter")).alias("letter"))
    spelled = votes.groupBy(*group).agg(F.array_join(F.array_sort(F.collect_list(F.struct("at", "letter")))["letter"], "").alias("header"))
    most = F.greatest(F.lit(1), F.floor(F.length("header") / EDIT_EVERY).cast("int"))
    near = members.join(few(spelled), group).where((F.abs(size - F.length("header")) <= most) & (F.levenshtein("key", "header") <= most))
    return near.groupBy(*group, "least", "header").agg(F.sum("n").alias("m")).where("m >= least").select("script_id", F.col("header").alias("key")).distinct()


def furniture(pages: DataFrame) -> DataFrame:
    """For each script its header keys and the style, distance and range of its page numbers."""
    lines = cut_lineage(edge_lines(pages))
    by_script = pages.where("script_id IS NOT NULL").groupBy("script_id").agg(
        F.countDistinct("page_number").alias("n_pages"), F.min("page_number").alias("first_page"), F.max("page_number").alias("last_page")
    )
    least = by_script.select("script_id", F.greatest(F.lit(FURNITURE_LEAST), FURNITURE_SHARE * F.col("n_pages")).alias("least"))
    counted = cut_lineage(lines.where("length(key) >= 5").groupBy("script_id", "key").agg(F.countDistinct("page_number").alias("n")).join(least, "script_id"))
    rare = counted.where("n < least").select("script_id", "key", "n")
    garbled = by_script.select("script_id", F.greatest(F.lit(GARBLED_LEAST), GARBLED_SHARE * F.col("n_pages")).alias("least"))
    every = counted.where("n >= least").select("script_id", "key").unionByName(garbled_headers(rare, garbled)).distinct()
    headers = every.groupBy("script_id").agg(F.array_sort(F.collect_list("key")).alias("headers"))
    distances = lines.where("number IS NOT NULL AND page_number IS NOT NULL").groupBy(
        "script_id", "style", (F.col("number") - F.col("page_number")).cast("int").alias("distance")
    ).agg(F.countDistinct("page_number").alias("n"))
    best = distances.where(F.col("n") >= FURNITURE_LEAST).groupBy("script_id").agg(F.max_by(F.struct("style", "distance"), F.struct("n", "style", "distance")).alias("number"))
    joined = by_script.join(headers, "script_id", "left").join(best, "script_id", "left")
    return joined.select(
        "script_id", F.coalesce("headers", F.array().cast("array<string>")).alias("headers"),
        F.col("number.style").alias("style"), F.col("number.distance").alias("distance"),
        (F.col("first_page") + F.col("number.distance")).alias("first_number"), (F.col("last_page") + F.col("number.distance")).alias("last_number"),
    )


def _hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")


class Vocabulary:
    """The frequent words of a corpus and what they look like, as sorted hashes beside one block of characters."""

    def __init__(self, known=(), by_looks: dict[str, str] | None = None):
        self.hashes = np.sort(np.fromiter(map(_hash, known), np.uint64))
        alike = sorted((_hash(image), word) for image, word in (by_looks or {}).items())
        self.images = np.array([h for h, _ in alike], np.uint64)
        self.ends = np.cumsum([len(word) for _, word in alike], dtype=np.int64)
        self.letters = "".join(word for _, word in alike)
        self._memo = _Memo(self)

    def __getstate__(self):
        return {**self.__dict__, "_memo": None}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._memo = _Memo(self)

    @property
    def knows(self) -> dict[str, bool]:
        """Whether a lower-case word is frequent, for any word."""
        return self._memo

    def alike(self, word: str) -> str | None:
        """The frequent word that a lower-case word looks like."""
        own = np.uint64(_hash(looks(word)))
        at = int(np.searchsorted(self.images, own))
        return self.letters[self.ends[at - 1] if at else 0 : self.ends[at]] if at < len(self.images) and self.images[at] == own else None

    def reading(self, word: str) -> str | None:
        """The frequent word that a lower-case word is or looks like."""
        return word if self.knows[word] else self.alike(word)


class _Memo(dict):
    """What a vocabulary said of the words seen; emptied at ``most``."""

    def __init__(self, words: Vocabulary, most: int = 200_000):
        super().__init__()
        self.hashes, self.most = words.hashes, most

    def __missing__(self, word: str) -> bool:
        if len(self) >= self.most:
            self.clear()
        own = np.uint64(_hash(word))
        at = int(np.searchsorted(self.hashes, own))
        known = self[word] = at < len(self.hashes) and bool(self.hashes[at] == own)
        return known


def word_counts(texts: DataFrame) -> DataFrame:
    """``word, looks, n`` of all words of letters, those at line ends left out, as they may be divided."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inner = re.compile(r"[^\W\d_]{2,}(?![^\W_]|[-‐­¬]\s*\n)")
        seen: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            words = list(seen)
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([looks(w) for w in words], pa.string()), pa.array([seen[w] for w in words], pa.int64())], ["word", "looks", "n"])
            seen.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(inner.findall(text.lower()))
            if len(seen) > 200_000:
                yield flush()
        yield flush()

    counts = texts.where("text IS NOT NULL").select("text").mapInArrow(count, "word string, looks string, n bigint")
    return counts.groupBy("word", "looks").agg(F.sum("n").alias("n"))


def vocabulary(texts: DataFrame) -> Vocabulary:
    """The frequent words; no more than ``1 / WORD_SHARE`` can be, whatever the size of the corpus."""
    counts = cut_lineage(word_counts(texts))
    total = counts.agg(F.sum("n")).first()[0] or 0
    frequent = counts.where(F.col("n") >= max(WORD_LEAST, WORD_SHARE * total))
    alike = Window.partitionBy("looks")
    ranked = frequent.withColumn("most", F.max("n").over(alike)).where(F.col("n") >= MISREAD_SHARE * F.col("most"))
    rows = ranked.select("word", "looks", "n").collect()
    best = {row["looks"]: row["word"] for row in sorted(rows, key=lambda row: (row["n"], row["word"]))}
    return Vocabulary((row["word"] for row in rows), best)


def close(a: str, b: str, most: int) -> bool:
    """Whether two keys differ by at most ``most`` edits, kept small by comparing only near the diagonal."""
    if abs(len(a) - len(b)) > most:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        previous, row[0] = row[0], i
        for j in range(1, len(b) + 1):
            previous, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, previous + (x != b[j - 1]))
        if min(row) > most:
            return False
    return row[-1] <= most


def is_header(key: str, title: str | None, headers: list[str]) -> bool:
    return title in headers or len(key) >= 5 and any(key == h or close(key, h, max(1, len(h) // EDIT_EVERY)) for h in headers)


def without_furniture(lines: list[str], page: int | None, script: dict, whole_page: bool) -> tuple[list[str], set[str]]:
    """The lines that aren't furniture, and the kinds of furniture that were there."""
    kinds: set[str] = set()
    headers, style = script["headers"] or [], script["style"]
    longest = max(map(len, headers), default=0)
    longest += longest // EDIT_EVERY + 1 + _NUMBER_LETTERS
    places = edges(lines) if whole_page else range(len(lines))
    dropped = set()
    for i in places:
        line = lines[i]
        if not line.strip():
            continue
        if 2 * len(line) > longest and looks_length(line.lower()) > longest and not _NUMBERED_TITLE.match(line):
            continue  # more letters than any header with a number
        key, number, found_style, title = line_parts(line)
        if key:
            if headers and is_header(key, title, headers):
                kinds.add("running_header")
                dropped.add(i)
                if number is not None and style is not None:
                    kinds.add("page_number")
            continue
        if number is None or style is None or found_style != style:
            continue
        if whole_page and page is not None:
            fits = number - page == script["distance"]
        else:
            before = next((lines[k].rstrip() for k in range(i - 1, -1, -1) if lines[k].strip()), "")
            fits = script["first_number"] <= number <= script["last_number"] and not (style == "#" and before.endswith(":"))
        if fits:
            kinds.add("page_number")
            dropped.add(i)
    return [line for i, line in enumerate(lines) if i not in dropped], kinds


def divides(head: str, mark: str, tail: str, words: Vocabulary) -> bool:
    """Whether a mark at a line end divides a word that is written without it."""
    if mark in "­¬":
        return True
    if tail.lower() in _SUSPENDED or not tail[0].islower():
        return False
    if words.reading((head + tail).lower()):
        return True
    return not (words.reading(tail.lower()) and words.reading(head.lower()))


def _word_begin(line: str) -> int:
    """Where the word of letters begins that stands before the last sign of a line."""
    at = len(line) - 1
    while at and line[at - 1].isalpha():
        at -= 1
    return at


def paragraphs(lines: list[str], words: Vocabulary) -> tuple[str, bool]:
    """Lines joined to paragraphs, and whether a divided word was among them."""
    out: list[str] = []
    divided = fenced = broken = False
    for line in lines:
        text = line.rstrip()
        if text.lstrip().startswith("```"):
            out.append(text)
            fenced, broken = not fenced, True
            continue
        if fenced:
            out.append(text)
            continue
        if not text.strip():
            if out and out[-1]:
                out.append("")
            continue
        mark = out[-1][-1:] if out and not broken else ""
        begin = _word_begin(out[-1]) if mark and mark in _MARKS else 0
        word = out[-1][begin:-1] if mark and mark in _MARKS else ""
        head = _HEAD.match(text) if word else None
        if head:
            if divides(word, mark, head.group(1), words):
                divided = True
                out[-1] = out[-1][:-1] + text.lstrip()
            else:
                out[-1] = out[-1] + ("" if not head.group(1)[0].islower() else " ") + text.lstrip()
        elif not out or broken or not out[-1] or _KEPT_LINE.match(text) or _KEPT_LINE.match(out[-1]) or "  " in text.strip():
            # a paragraph goes on behind furniture that was taken out of it
            if len(out) > 1 and not out[-1] and not broken and out[-2] and text.lstrip()[0].islower() and out[-2][-1] not in ".!?:`|":
                out.pop()
                out[-1] += " " + text.lstrip()
            else:
                out.append(text)
        else:
            out[-1] += " " + text.lstrip()
        broken = False
    return "\n".join(out).strip("\n"), divided


def _whole(text: str, word: str) -> Iterator[int]:
    """Where a word stands in a text, not within another one."""
    at = text.find(word)
    while at >= 0:
        end = at + len(word)
        if not text[at - 1 : at].isalnum() and not text[end : end + 1].isalnum():
            yield at
        at = text.find(word, at + 1)


def corrected(text: str, words: Vocabulary) -> tuple[str, bool]:
    """The text with misread words put right, and whether there were any. Code stays as it is."""
    found = False

    def joined(match: re.Match) -> str:
        nonlocal found
        word = match.group().replace(" ", "")
        reading = words.reading(word.lower())
        if not reading and len(word) < 6:
            return match.group()
        found = True
        return word

    def put_right(word: str, first: bool) -> str:
        nonlocal found
        lower = word.lower()
        if len(word) < 3 or word.isdigit() or words.knows[lower]:
            return word
        letters = sum(map(str.isalpha, word))
        if letters < 2 or letters * 2 < len(word):
            return word
        reading = words.alike(lower)
        if reading is None or len(reading) < 3:
            found = found or bool(_DIGIT_INSIDE.search(word))
            return word
        found = True
        return reading.upper() if len(word) > 1 and word.isupper() else reading[0].upper() + reading[1:] if word[0].isupper() or word[0].isdigit() and first else reading

    parts = _UNREAD.split(text) if _BYTES.search(text) else _UNREAD_MARKED.split(text) if "$" in text or "```" in text else [text]
    known = words.knows
    for i in range(0, len(parts), 2):
        part = _LETTER_SPACED.sub(joined, parts[i])
        # most words are known; only the places of those that aren't are looked at
        lower = part.lower()
        unknown = [word for word in set(_WORD.findall(lower)) if not known[word] and len(word) > 2 and not word.isdigit()]
        if unknown and len(lower) != len(part):
            part = _WORD.sub(lambda match: put_right(match.group(), match.start() == 0), part)
        elif unknown:
            places = sorted((at, at + len(word)) for word in unknown for at in _whole(lower, word))
            pieces, end = [], 0
            for begin, stop in places:
                pieces += [part[end:begin], put_right(part[begin:stop], begin == 0)]
                end = stop
            part = "".join(pieces) + part[end:]
        parts[i] = part
    return "".join(parts), found


def repaired(text: str, page: int | None, script: dict, whole_page: bool, words: Vocabulary) -> tuple[str, list[str]]:
    """The text as paragraphs, and the kinds of traces that were in it."""
    lines, kinds = without_furniture(text.split("\n"), page, script, whole_page)
    joined, divided = paragraphs(lines, words)
    result, misread = corrected(joined, words)
    kinds |= {"hyphenation"} if divided else set()
    return result, sorted(kinds | ({"misread"} if misread else set()))


def repair(records: DataFrame, pages: DataFrame) -> DataFrame:
    """``field, record_id, text, noise`` of all ``records``: ``field, record_id, script_id, page_number, text``.

    ``pages`` has ``script_id, page_number, text``. A record with a page number is a whole page; others are passages.
    """
    shared = records.sparkSession.sparkContext.broadcast(vocabulary(records))
    scripts = cut_lineage(furniture(pages))
    if scripts.count() <= BROADCAST_SCRIPTS:
        scripts = F.broadcast(scripts)
    nothing = {"headers": [], "style": None, "distance": None, "first_number": None, "last_number": None}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in batches:
            rows = batch.to_pylist()
            texts, noise = [], []
            for row in rows:
                script = row if row["headers"] is not None else nothing
                done = (None, []) if row["text"] is None else repaired(row["text"], row["page_number"], script, row["page_number"] is not None, words)
                texts.append(done[0])
                noise.append(done[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(noise, pa.list_(pa.string()))], ["field", "record_id", "text", "noise"])

    joined = records.select("field", "record_id", "script_id", "page_number", "text").join(scripts, "script_id", "left")
    return joined.select("field", "record_id", "page_number", "text", "headers", "style", "distance", "first_number", "last_number").mapInArrow(
        work, "field string, record_id bigint, text string, noise array<string>"
    )
