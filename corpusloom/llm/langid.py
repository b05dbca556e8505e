"""Operator 4: language identification by compression.

Each language has a zstandard dictionary of raw text from labelled documents.  A text is encoded with every dictionary,
in pieces that each start from the dictionary alone; the language whose dictionary gives the fewest bytes is chosen, and
the choice is not accepted where the runner-up is about as good.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import map_batches, remainder, saved

#: The documented bound of the training sample: documents of a language; languages that go to the tasks at a time.
SAMPLE_DOCS, LANGUAGES = 250, 64
#: Bytes of a piece that is encoded at a time, the level, and the least margin (share of the runner-up's bytes).
PIECE_BYTES, LEVEL, MARGIN = 1 << 13, 3, 0.02
UNKNOWN = "und"

_OTHER = regex.compile(r"\P{L}+")


def letters_of(text: str | None) -> str:
    """Lower-case letters of a text, one space for anything between; '' if there is none."""
    return _OTHER.sub(" ", text.lower()).strip() if text else ""


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Iterator[dict[str, bytes]]:
    """Raw dictionaries by language, the most frequent first (ties by name), LANGUAGES of them at a time; one group at least.

    Rows without text, language or id are left out.  Of each language at most SAMPLE_DOCS documents, drawn by hashes of the
    ids, come to the driver, whole; all of them are the dictionary.
    """
    d = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    d = d.where("doc_id is not null and text is not null and lang is not null")
    counts = [(r["lang"], r["n"]) for r in d.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").collect()]  # a row a language
    for at in range(0, max(1, len(counts)), LANGUAGES):
        group = counts[at : at + LANGUAGES]
        yield _dictionaries(d, group) if group else {}


def _dictionaries(d: DataFrame, counts: list[tuple[str, int]]) -> dict[str, bytes]:
    # a fraction that gives the sample with a margin; then the smallest hashes of each language
    shares = d.sparkSession.createDataFrame([(x, min(1.0, 1.3 * SAMPLE_DOCS / n)) for x, n in counts], "lang string, share double")
    h = F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(1 << 30))
    drawn = d.join(F.broadcast(shares), "lang").where(h < F.col("share") * F.lit(1 << 30)).select("lang", h.alias("h"), "text")  # LANGUAGES rows at most
    # one id may stand in any number of rows, so the bound is taken by row
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    by: dict[str, list[str]] = {}
    for r in drawn.withColumn("n", place).where(F.col("n") <= SAMPLE_DOCS).drop("n", "h").collect():
        if t := letters_of(r["text"]):
            by.setdefault(r["lang"], []).append(t)
    return {name: " ".join(sorted(by[name])).encode("utf-8", "surrogatepass") for name, _ in counts if name in by}


class Coders:
    """Encoders with the dictionaries of some languages; each may refer to all of its dictionary."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.coders = []
        for data in dictionaries.values():
            d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            more = {"window_log": min(27, (len(data) + PIECE_BYTES).bit_length())} if len(data) > 1 << 20 else {}
            params = zstandard.ZstdCompressionParameters.from_level(LEVEL, dict_size=len(data), write_checksum=False, write_content_size=False, write_dict_id=False, **more)
            d.precompute_compress(compression_params=params)
            self.coders.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params))

    def sizes(self, letters: str) -> list[int]:
        data = letters.encode("utf-8", "surrogatepass")
        pieces = [data[k : k + PIECE_BYTES] for k in range(0, len(data), PIECE_BYTES)]
        return [sum(len(c.compress(p)) for p in pieces) for c in self.coders]


def choose(names: list[str], sizes: list[int]) -> tuple[str, float, bool]:
    """Language, score and whether the margin is wide enough; at equal size the language most frequent in training."""
    if not names or not sizes:
        return UNKNOWN, 0.0, False
    best = min(range(len(sizes)), key=lambda k: (sizes[k], k))
    scale = 1 + 0.02 * sizes[best]
    weights = [math.exp(max(-700.0, (sizes[best] - s) / scale)) for s in sizes]
    rival = min((s for k, s in enumerate(sizes) if k != best), default=2 * sizes[best])
    return names[best], 1 / sum(weights), rival - sizes[best] >= MARGIN * rival


@lru_cache(maxsize=1)
def _coders(items: tuple[tuple[str, bytes], ...]) -> Coders:
    return Coders(dict(items))


def predict(docs: DataFrame, groups: Iterable[dict[str, bytes]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, accepted), one row per row.

    All languages compete: each group of dictionaries goes to the tasks in turn, and where there are several, rows are
    stored with their sizes so far in between.  ``und`` with score 0 where the text is null or has no letter, or nothing was
    learned; null ids and repeated rows stay.
    """
    held = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.array().cast("array<long>").alias("sizes"))
    names: list[str] = []
    groups = iter(groups)
    group = next(groups, {})
    while True:
        names, coming = [*names, *group], next(groups, None)
        handle = docs.sparkSession.sparkContext.broadcast(tuple(group.items()))

        def rows(columns, handle=handle, names=tuple(names), last=coming is None):
            coders = _coders(handle.value)
            for k, t, sizes in zip(*columns, strict=True):
                letters = letters_of(t)
                sizes = [*sizes, *coders.sizes(letters)] if letters else sizes
                yield (k, *choose(names, sizes)) if last else (k, t, sizes)

        if coming is None:
            return map_batches(held, rows, "doc_id long, lang_pred string, score double, accepted boolean")
        held, group = saved(map_batches(held, rows, "doc_id long, text string, sizes array<long>")), coming


def identify(docs: DataFrame) -> DataFrame:
    """Learns from the rows whose remainder is not 2 and predicts all: doc_id, held_out, lang_pred, score, accepted."""
    out = predict(docs, train(docs.where(remainder(F.col("doc_id"), 4) != 2)))
    return out.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")
