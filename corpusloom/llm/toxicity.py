"""Operator 5: toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

A lexicon of words and word beginnings is learned from the labelled documents: entries that toxic documents use and
others do not.  Features of a text: densities and strengths of its lexicon hits, how near they stand to a second-person
word, capitals, marks and obfuscation.  The features of a training document count its own label out of the lexicon, so
that the trees see what they will see on new texts.  Trees and calibration are fitted by Spark ML on parts of a sample
that hashes draw; scoring runs over all texts.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass, field

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import map_batches, remainder, saved

#: The documented bound of the sample: labelled documents at most (by hash).
SAMPLE_DOCS = 12_000
#: Lengths of word beginnings, documents that must use an entry, and the least log-odds of a hit.
BEGINNINGS, LEAST_DOCS, LEAST_ODDS = (4, 5, 6), 2, 2.0
#: Score from which a text is predicted toxic.
THRESHOLD = 0.3
TREES, DEPTH = 20, 3

#: Second-person words, and what stands for letters in disguised words.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros os".split()
)
DISGUISE = str.maketrans("013457@$!", "oieastasi")

_RUN = re.compile(r"[^\s|]+")
_INNER = re.compile(r"[\W_]+")
FEATURES = (
    "length", "hits", "density", "strongest", "sum_odds", "second_near", "second_density", "capitals", "bangs", "marks", "obfuscated", "digits",
)


def normal_words(text: str | None) -> list[tuple[str, bool]]:
    """(lower-case word with disguises undone, was disguised) in order."""
    out = []
    for run in _RUN.findall(text or ""):
        low = run.lower()
        if low.isalpha():
            out.append((low, False))
            continue
        core = low.strip(".,;:!?\"'()[]{}#*%&-")
        if core.isalpha() or not core:
            if core:
                out.append((core, False))
            continue
        plain = _INNER.sub("", core.translate(DISGUISE))
        if plain:
            out.append((plain, any(c.isalpha() for c in core)))
    return out


def entries(word: str) -> list[str]:
    """The lexicon entries that a word could match: itself, and its beginnings."""
    return [word] + [word[:n] + "*" for n in BEGINNINGS if len(word) > n]


def signature(words: list[tuple[str, bool]]) -> int:
    """The least hash of runs of five words; near copies mostly share it."""
    w = [x for x, _ in words]
    runs = (" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4)))
    return min(zlib.crc32(r.encode("utf-8", "surrogatepass")) for r in runs)


@dataclass
class Lexicon:
    counts: dict[str, tuple[int, int]] = field(default_factory=dict)  # entry -> toxic and other documents
    toxic: int = 0
    other: int = 0

    def odds(self, entry: str, own: int | None = None) -> float:
        """Log-odds of an entry, a document of label ``own`` left out; 0 if it doesn't count."""
        found = self.counts.get(entry)
        if found is None:
            return 0.0
        a, b = found[0] - (own == 1), max(0, found[1] - (own == 0))
        if a < LEAST_DOCS:
            return 0.0
        x = math.log((a + 0.5) / (self.toxic + 1)) - math.log((b + 0.5) / (self.other + 1))
        return x if x >= LEAST_ODDS else 0.0


def _least_gap(a: list[int], b: list[int]) -> int:
    """The least distance between a place of one list and one of the other, both in order."""
    i = j = 0
    least = abs(a[0] - b[0])
    while i < len(a) and j < len(b):
        least = min(least, abs(a[i] - b[j]))
        i, j = (i + 1, j) if a[i] < b[j] else (i, j + 1)
    return least


def features(text: str | None, lexicon: Lexicon, own: int | None = None) -> list[float]:
    words = normal_words(text)
    text = text or ""
    n, hits, seconds, disguised, strongest, total = len(words), [], [], 0, 0.0, 0.0
    counts = lexicon.counts
    for k, (w, hidden) in enumerate(words):
        disguised += hidden
        if w in SECOND_PERSON:
            seconds.append(k)
        best = 0.0
        for e in (w, *(w[:m] + "*" for m in BEGINNINGS if len(w) > m)):
            if e in counts:
                best = max(best, lexicon.odds(e, own))
        if best:
            hits.append(k)
            strongest = max(strongest, best)
            total += best
    near = 1 / (1 + _least_gap(hits, seconds)) if hits and seconds else 0.0
    chars = max(1, len(text))
    upper = sum(len(x) for x in re.findall(r"[A-ZÀ-ÖØ-Þ]+", text))
    bangs = text.count("!") + text.count("?")
    marks = sum(map(text.count, "#*$%&@|<>"))
    return [
        math.log1p(n), float(len(hits)), len(hits) / max(1, n), strongest, total, near, len(seconds) / max(1, n),
        upper / chars, bangs / chars, marks / chars, disguised / max(1, n), sum(map(text.count, "0123456789")) / chars,
    ]


def _drawn(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic) of at most about SAMPLE_DOCS labelled documents outside the held-out part.

    A document is one id: of rows that share it the least text counts, of its labels the largest.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where(remainder(F.col("doc_id"), 4) != 2)
    n = known.count()
    draw = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) < F.lit(int(min(1.0, SAMPLE_DOCS / max(1, n)) * (1 << 30)) + 1)
    # ids first, so that the texts of the sample alone are kept
    picked = known.where(draw)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # bounded by SAMPLE_DOCS
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """From (text, toxic); near copies of one text count once a label."""

    def rows(columns):
        for t, label in zip(*columns, strict=True):
            words = normal_words(t)
            if words:
                yield signature(words), label, sorted({e for w, _ in words for e in entries(w)})

    one = map_batches(sample.select("text", "toxic"), rows, "sig long, toxic int, entries array<string>", most=256)
    one = one.groupBy("sig", "toxic").agg(F.first("entries").alias("entries"))
    sizes = {r["toxic"]: r["n"] for r in one.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    lexicon = Lexicon({}, sizes.get(1, 0), sizes.get(0, 0))
    if not lexicon.toxic or not lexicon.other:
        return lexicon
    counts = one.select(F.explode("entries").alias("entry"), "toxic").groupBy("entry").agg(
        F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("a"), F.sum(F.when(F.col("toxic") == 1, 0).otherwise(1)).alias("b")
    )
    odds = F.log((F.col("a") + 0.5) / (lexicon.toxic + 1)) - F.log((F.col("b") + 0.5) / (lexicon.other + 1))
    best = counts.where((F.col("a") >= LEAST_DOCS) & (odds >= LEAST_ODDS))  # of the sample
    lexicon.counts = {r["entry"]: (r["a"], r["b"]) for r in best.collect()}
    return lexicon


def _featured(df: DataFrame, lexicon: Lexicon, own: str | None = None) -> DataFrame:
    handle = df.sparkSession.sparkContext.broadcast(lexicon)

    def rows(columns):
        known = handle.value
        for row in zip(*columns, strict=True):
            yield (row[0], *row[2:], features(row[1], known, row[2] if own else None))

    extra = f"{own} int, " if own else ""
    cols = ["doc_id", "text", *([own] if own else [])]
    return map_batches(df.select(*cols), rows, f"doc_id long, {extra}features array<double>")


def _assembled(df: DataFrame) -> DataFrame:
    wide = df.select("*", *[F.col("features")[k].alias(f"f_{name}") for k, name in enumerate(FEATURES)]).drop("features")
    return VectorAssembler(inputCols=[f"f_{n}" for n in FEATURES], outputCol="features").transform(wide).drop(*[f"f_{n}" for n in FEATURES])


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Null and empty texts have no hits and get the score of such a text; null ids are not held out; repeated rows stay.
    Without both labels in the training part every score is the share of toxic labels (0 without labels).
    """
    sample = saved(_drawn(docs, labels))
    lexicon = learn_lexicon(sample)
    held = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if not lexicon.toxic or not lexicon.other:
        share = sample.agg(F.coalesce(F.avg("toxic"), F.lit(0.0)).alias("p")).first()["p"]
        return plain.select("doc_id", held, F.lit(float(share)).alias("score"), F.lit(int(share >= THRESHOLD)).alias("predicted"))
    train = saved(_assembled(_featured(sample, lexicon, "toxic")).withColumn("label", F.col("toxic").cast("double")).coalesce(6))
    fitted = F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(4)) != 0
    part = train.where(fitted)
    if part.select("label").distinct().count() < 2:
        part = train
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7).fit(part)
    margin = lambda df: trees.transform(df).withColumn("margin", vector_to_array("rawPrediction")[1])
    aside = margin(train.where(~fitted)).select("margin", "label")
    if aside.isEmpty():
        aside = margin(train).select("margin", "label")
    shape = IsotonicRegression(featuresCol="margin", labelCol="label", predictionCol="score").fit(aside)
    scored = shape.transform(margin(_assembled(_featured(plain, lexicon))).select("doc_id", "margin"))
    value = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score")))
    return scored.select("doc_id", held, value.alias("score"), (value >= THRESHOLD).cast("int").alias("predicted"))
