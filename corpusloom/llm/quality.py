"""Operator 8: line-first quality rules.

Every line is judged on its own: too many symbols, navigation bars, shouting or words that end in runs of marks,
boilerplate, or no letter at all.  Failing lines are removed; a document that loses too large a part of its text is
rejected, as is one that is too short or repeats itself.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import map_batches

#: Per cent of word characters that symbols may be; bars per words of a navigation line; words of a boilerplate line.
SYMBOLS_PERCENT, WORDS_A_BAR, BOILERPLATE_WORDS = 8, 4, 30
#: Per cent of the word characters that a kept document may lose.
LOST_PERCENT = 50
#: Words that a document needs, and per cent of them that may lie in repeated windows of three.
LEAST_WORDS, REPEATED_PERCENT = 50, 50

SYMBOL = "#*$%&|<>"
#: Phrases of licence lines, notices and calls to act.
BOILERPLATE = (
    "all rights reserved", "licensed under", "released under", "copyright", "cookie policy", "privacy policy",
    "terms of use", "terms of service", "click here", "subscribe to", "sign up for", "log in to", "javascript",
)
_BOILERPLATE = re.compile("|".join(map(re.escape, BOILERPLATE)))
_MARKS = re.compile(r"[!?#*$%&]{2,}[.,]?$")
_SPACE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))


def words_of(text: str) -> list[str]:
    """Runs of anything but the six ASCII white-space characters."""
    return [w.decode("utf-8", "surrogatepass") for w in text.encode("utf-8", "surrogatepass").split()]


def line_fault(line: str, words: list[str]) -> str:
    """Why a line with words is removed; '' if it stays."""
    chars = sum(map(len, words))
    data = line.encode("utf-8", "surrogatepass")
    bars = line.count("|")
    if bars >= 2 and bars * WORDS_A_BAR >= len(words):
        return "navigation"
    if 100 * (len(data) - len(data.translate(None, SYMBOL.encode()))) > SYMBOLS_PERCENT * chars:
        return "symbols"
    if 2 * sum(1 for w in words if _MARKS.search(w)) > len(words):
        return "punctuation"
    upper = len(data) - len(data.translate(None, _UPPER))
    lower = len(data) - len(data.translate(None, _LOWER))
    if upper >= 8 and upper > 4 * lower:
        return "capitals"
    if not upper and not lower and data.isascii():
        return "letters"
    if len(words) <= BOILERPLATE_WORDS and _BOILERPLATE.search(line.lower()):
        return "boilerplate"
    return ""


def repeated_words(words: list[str]) -> int:
    """Words that lie in a window of three found twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts, covered, end = Counter(windows), 0, 0
    for k, w in enumerate(windows):
        if counts[w] > 1:
            covered += k + 3 - max(k, end)
            end = k + 3
    return covered


def judge(text: str | None) -> tuple[int, int, int, int, int, bool, bool, int, str]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lost_chars, cleaned text."""
    text = text or ""
    words, seen, dups, lost, good = words_of(text), set(), 0, 0, []
    for line in text.split("\n"):
        own = words_of(line)
        if not own:
            good.append(line)
            continue
        if line in seen:
            dups += 1
        seen.add(line)
        if line_fault(line, own):
            lost += sum(map(len, own))
        else:
            good.append(line)
    chars = sum(map(len, words))
    symbols = sum(map(text.count, SYMBOL))
    again = repeated_words(words)
    failed = len(words) < LEAST_WORDS or 100 * again > REPEATED_PERCENT * len(words)
    kept = not failed and 100 * lost <= LOST_PERCENT * chars
    return len(words), chars, symbols, dups, again, failed, kept, lost, "\n".join(good) if lost else text


def quality(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: doc_id, counts, base_failed, kept, lost_chars and the cleaned text.

    Null and empty texts have no words and fail; null ids and repeated rows stay.
    """

    def rows(columns):
        for k, t in zip(*columns, strict=True):
            yield (k, *judge(t))

    schema = (
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, kept boolean, lost_chars long, cleaned string"
    )
    return map_batches(docs.select(F.col(key).cast("long"), F.col(text)), rows, schema)


def clean(docs: DataFrame) -> DataFrame:
    """``docs`` without the rejected rows, their text without the failing lines, n_chars (if there) to match."""
    names = docs.columns
    at = names.index("text")

    def rows(columns):
        for row in zip(*columns, strict=True):
            verdict = judge(row[at])
            if verdict[6]:
                out = dict(zip(names, row, strict=True)) | {"text": verdict[8]}
                if verdict[7] and out.get("n_chars") is not None:
                    out["n_chars"] = len(verdict[8])
                yield tuple(out[c] for c in names)

    return map_batches(docs, rows, docs.schema)
