"""Text functions, each from columns to a column."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: what counts as white space, the same set in every engine.
PY_WS = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c != " ")
#: Token patterns.
WORD_OR_MARK = r"(?U)\w+|[^\w\s]"
TERM = r"[a-zA-Z][a-zA-Z0-9_]{1,}"
LONG_TERM = r"[a-zA-Z][a-zA-Z0-9_]{2,}"
#: Characters stripped from the ends of entity names, and names that are no entities.
NAME_ENDS = " .,;:()[]{}\"'"
NO_NAMES = ("court", "state", "united states", "opinion")


def computed(df: DataFrame, *keep: Column | str, **columns: Column) -> DataFrame:
    """The kept columns and the computed ones, each worked out once a row.

    A generator of one row stands between them and what uses them, since projections and filters above would otherwise be
    merged into the one below and spell out a costly column at each place of use.
    """
    row = F.explode_outer(F.array(F.struct(*[c.alias(name) for name, c in columns.items()])))
    made = df.select(*keep, row.alias("loom_made"))
    return made.select(*[F.col(f"`{c}`") for c in made.columns[:-1]], *[F.col("loom_made")[name].alias(name) for name in columns])


def or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def collapse(c: Column) -> Column:
    """White-space runs become one space; none at the ends."""
    return F.array_join(_between_spaces(c), " ")


def _between_spaces(c: Column) -> Column:
    """What stands between white space.  Its kinds become one first: a split at one plain character is many times faster."""
    return F.filter(F.split(F.translate(c, _SPACES, " " * len(_SPACES)), " "), lambda x: x != "")


def clean_text(c: Column, fast: bool = False) -> Column:
    """Markup (if both angle brackets occur) to text with a space between nodes, NUL to space, white space collapsed.

    ``fast`` cuts tags by a pattern; otherwise a parser runs, and only over the texts that need it.
    """
    marked = c.contains("<") & c.contains(">")
    plain = F.regexp_replace(c, r"<[^>]*>", " ") if fast else markup_text(F.when(marked, c))
    return collapse(F.translate(F.when(marked, plain).otherwise(c), "\u0000", " "))


class _Nodes(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.mute = [], 0

    def handle_starttag(self, tag, attrs):
        self.mute += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.mute -= tag in ("script", "style") and self.mute > 0

    def handle_data(self, data):
        if not self.mute:
            self.parts.append(data)


def _nodes(text: str) -> str:
    parser = _Nodes()
    parser.feed(text)
    parser.close()
    return " ".join(parser.parts)


@F.pandas_udf(T.StringType())
def markup_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Text nodes of markup, joined by a space; null stays null."""
    for texts in batches:
        yield texts.map(_nodes, na_action="ignore")


def token_count(c: Column, mode: str = "words_and_marks") -> Column:
    """Tokens of a text: ``words_and_marks`` (1 at least) or ``whitespace``."""
    if mode == "whitespace":
        return F.size(ws_tokens(c))
    if mode != "words_and_marks":
        raise ValueError(f"unknown mode {mode}")
    return F.greatest(F.lit(1), F.regexp_count(c, F.lit(WORD_OR_MARK)))


def bpe_pieces(path: str):
    """A function from a text column to its pieces, one for each token of the tokenizer file; joined by '' they are the text.

    A character that takes several tokens stands in the first of them.  Null has no pieces.
    """

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def pieces(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)

        def cut(text: str) -> list[str]:
            starts = [a for a, _ in tokenizer.encode(text, add_special_tokens=False).offsets]
            at, ends = 0, [*starts[1:], len(text)]
            out = []
            for end in ends:
                out.append(text[at : max(at, end)])
                at = max(at, end)
            return out

        for texts in batches:
            yield texts.fillna("").map(cut)

    return pieces


def ws_tokens(c: Column) -> Column:
    return _between_spaces(or_empty(c))


def safe_text(c: Column, delimiter: str = "|") -> Column:
    """Null to '', white space collapsed, and then the delimiter to a space."""
    return F.translate(collapse(or_empty(c)), delimiter, " ")


def entity_name(c: Column) -> Column:
    """Lower case, ends stripped, white space collapsed."""
    return F.regexp_replace(F.btrim(F.lower(c), F.lit(NAME_ENDS)), PY_WS + "+", " ")


def is_entity(name: Column) -> Column:
    """Whether a name in that form is long enough and none of those that are no entities; false for null."""
    return F.coalesce((F.length(name) >= 3) & ~name.isin(*NO_NAMES), F.lit(False))


def normalise_entity(c: Column) -> Column:
    """The name's form for comparison; null for names that are too short or no entities."""
    return F.when(is_entity(entity_name(c)), entity_name(c))


def tokenize(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(TERM), 0)


def query_terms(c: Column, stopwords: tuple[str, ...]) -> Column:
    """Terms of a question in order, repeats included, without stop words and terms of up to two letters."""
    stop = F.array(*map(F.lit, stopwords)) if stopwords else F.array().cast("array<string>")
    return F.filter(tokenize(c), lambda t: ~F.array_contains(stop, t) & (F.length(t) > 2))


def hits(haystack: Column, needles: Column) -> Column:
    """How many of the needles occur in a text."""
    return F.size(F.filter(needles, lambda n: F.contains(haystack, n)))


def score_text(text: Column, terms: Column, phrases: Column, names: Column, weight: float = 1.0) -> Column:
    """1 a term, 2.5 a phrase, 8 a name that occurs in the text, times a weight."""
    low = F.lower(or_empty(text))
    return (hits(low, terms) + 2.5 * hits(low, phrases) + 8.0 * hits(low, names)) * F.lit(float(weight))


def norm_words(c: Column, stopwords: tuple[str, ...]) -> Column:
    """Distinct words of three letters or more without stop words."""
    stop = F.array(*map(F.lit, stopwords))
    words = F.regexp_extract_all(F.lower(or_empty(c)), F.lit(LONG_TERM), 0)
    return F.array_distinct(F.filter(words, lambda w: ~F.array_contains(stop, w)))


def short_hash(prefix: str, c: Column) -> Column:
    """A content key: a prefix and the first 16 hex digits of the sha1."""
    return F.concat(F.lit(prefix), F.substring(F.sha1(c.cast("binary")), 1, 16))
