"""Phrases whose words come together more often than apart, by language.

Toivonen's method: a sample proposes phrases; a pass over all texts counts them and their negative border, which is every
other phrase whose parts without the first and without the last word are proposed.  Where one of the border is frequent,
the proposals were too few: an expansion pass counts every phrase of frequent words with such a part, which closes the
border.  Proposals go to the tasks as Bloom filters of bounded size, which let some more phrases be counted but none less;
counts are of phrases by their text.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm import bloom
from corpusloom.llm.common import map_tasks, saved

#: Occurrences of a phrase, words of a phrase, hundredths of its occurrences inside a longer one that drop a
#: phrase, scale of the score, phrases of a language.
LEAST, MOST_WORDS, INSIDE, SCALE, BEST = 30, 4, 80, 2_000_000, 2_000
#: Bytes of text in the sample, whatever the input; the share of the expected count that proposes a phrase.
SAMPLE_BYTES, LOWERED = 16 << 20, 0.5
#: Phrases of a filter that a task reads, parts that the sample is dealt into.
PHRASES, SAMPLE_PARTS = 100_000, 12
#: Words that a task counts before it sends the counts, and counts of a batch.
CHUNK, SENT = 1_000_000, 50_000
#: Words whose numbers a task keeps from one run of texts to the next.
KEPT_WORDS = 200_000
#: A-Z to a-z, marks and line ends that end a piece to one of them.
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _word_hashes(lang: str, words: Iterable[bytes]) -> list[int]:
    """64-bit hashes of words of a language."""
    seed, digest = zlib.crc32(lang.encode()), xxhash.xxh64_intdigest
    return [digest(w, seed) for w in words]


def _mixed(rolled: np.ndarray) -> np.ndarray:
    """Hashes of phrases from the sums over their words."""
    return (rolled ^ rolled >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)


class _Words:
    """Numbers of words by language, from 1; 0 stands between pieces."""

    def __init__(self):
        self.number = count(1)
        self.known: dict[str, defaultdict[bytes, int]] = {}
        self.names, self.prefixes, self.langs = [b""], [], [0]
        self.hashes = np.zeros(1, np.uint64)

    def of(self, lang: str) -> defaultdict[bytes, int]:
        if lang not in self.known:
            self.known[lang] = defaultdict(self.number.__next__, {b"\n": 0, b"": -1})
        return self.known[lang]

    def told(self) -> int:
        """Brings names, languages and hashes up to the words met so far, whose number it gives."""
        old, total = len(self.names), next(self.number)
        self.number = count(total)
        names, langs, hashes = [b""] * (total - old), [0] * (total - old), np.zeros(total - old, np.uint64)
        for known in self.known.values():
            known.default_factory = self.number.__next__
        for at, (lang, words) in enumerate(self.known.items()):
            if at == len(self.prefixes):
                self.prefixes.append(lang.encode() + b"\n")
            new = list(_newest(words, old))
            for w, k in new:
                names[k], langs[k] = w, at
            if new:
                hashes[[k for _, k in new]] = _word_hashes(lang, [w for w, _ in new])
        self.names += names
        self.langs += langs
        self.hashes = np.r_[self.hashes, hashes]
        return total


def _newest(words: dict[bytes, int], old: int) -> Iterator[tuple[bytes, int]]:
    """Words from number ``old`` on, less that number; numbers rise in the order in which words came in."""
    for w, k in reversed(words.items()):
        if k < max(1, old):
            return
        yield w, k - old


class _Chunk:
    """Some texts as numbers of words."""

    def __init__(self, words: _Words):
        self.words, self.parts, self.size = words, [], 0

    def add(self, lang: str, text: str | None) -> None:
        words = (text or "").encode().translate(_PLAIN).replace(b"\n", b" \n ").split(b" ")
        ids = np.fromiter(map(self.words.of(lang).__getitem__, words), np.int32, len(words))
        self.parts += [ids[ids >= 0], np.zeros(1, np.int32)]
        self.size += len(words)

    def counted(self, now: bloom.Filter, before: bloom.Filter | None, fresh: bloom.Filter | None, most: int) -> Iterator[tuple[int, tuple[list, list]]]:
        """Words of phrases, and their keys and counts.

        In a first pass: single words, and phrases all of whose shorter parts the filter holds.  In the other one, ``before``
        is that filter, ``now`` holds all that was frequent, and ``fresh`` what of it was not held: phrases of frequent words
        with a fresh part, but those that the first pass counted or that have a part which it counted and found rare.
        """
        ids, total = np.concatenate(self.parts), self.words.told()
        self.parts = []
        hashes, told = self.words.hashes, lambda at, k: _told(ids, at, k, total, self.words)
        hashed, word = _mixed(hashes), np.arange(total) > 0
        rolled = [hashes[ids]]  # sums over the words from each place on, by number of words
        chain = (now.holds(hashed) & word)[ids]  # places of words that the filter holds
        if before is None:
            for columns in told(np.flatnonzero(ids), 1):
                yield 1, columns
        new = np.zeros(len(ids), bool)  # places of phrases with a fresh part
        for k in range(2, most + 1):  # phrases of k words from parts of k - 1
            if not chain.any():
                return
            held = np.flatnonzero(chain)
            if before is None:
                if k > 2:
                    chain[held] = now.holds(_mixed(rolled[-1][held]))
                chain = np.r_[chain[:-1] & chain[1:], False]
                at = np.flatnonzero(chain)
            else:
                if k == 2:
                    new |= (fresh.holds(hashed) & word)[ids]
                else:
                    new[held] |= fresh.holds(_mixed(rolled[-1][held]))
                chain = np.r_[chain[:-1] & chain[1:], False]  # all words are frequent
                new = (new | np.r_[new[1:], False]) & chain
                at = np.flatnonzero(new)
                at = at[~_whole(before, rolled, at, k)]
                for n in range(2, k):
                    for start in range(k - n + 1):
                        rare = _whole(before, rolled, at + start, n) & ~now.holds(_mixed(rolled[n - 1][at + start]))
                        at = at[~rare]
            for columns in told(at, k):
                yield k, columns
            rolled.append(np.r_[rolled[-1][: 1 - k] * _STEP + rolled[0][k - 1 :], np.zeros(min(k - 1, len(ids)), np.uint64)])


def _whole(f: bloom.Filter, rolled: list[np.ndarray], at: np.ndarray, k: int) -> np.ndarray:
    """Whether the filter holds all shorter parts of the phrases of k words at some places."""
    out = np.ones(len(at), bool)
    for n in range(k - 1, 0, -1):
        for start in range(k - n + 1):
            some = np.flatnonzero(out)
            out[some] = f.holds(_mixed(rolled[n - 1][at[some] + start]))
    return out


def _told(ids: np.ndarray, at: np.ndarray, k: int, total: int, known: _Words) -> Iterator[tuple[list, list]]:
    """The distinct phrases of k words at some places, as keys, with their counts."""
    names, langs, prefixes = known.names, known.langs, known.prefixes
    key, most = ids[at].astype(np.int64), total
    for j in range(1, k):
        if most * total >= 1 << 62:
            _, key = np.unique(key, return_inverse=True)
            most = len(at)
        key, most = key * total + ids[at + j], most * total
    order = np.argsort(key)
    edges = np.flatnonzero(np.diff(key[order], prepend=-1))
    n, first = np.diff(edges, append=len(order)), at[order[edges]]
    for lo in range(0, len(first), SENT):
        some = first[lo : lo + SENT]
        words = [[prefixes[langs[x]] + names[x] for x in ids[some].tolist()], *[[names[x] for x in ids[some + j].tolist()] for j in range(1, k)]]
        yield list(map(b" ".join, zip(*words))), n[lo : lo + SENT].tolist()


def _counts(docs: DataFrame, now: bloom.Filter, before: bloom.Filter | None, fresh: bloom.Filter | None, most: int, least: int) -> DataFrame:
    """(lang, words, phrase, n, held) of one pass, of phrases that come often enough; with 0 words, in a first pass, all words.

    Tasks send counts by key, which is the language, a line end and the phrase.
    """
    handle = docs.sparkSession.sparkContext.broadcast((now, before, fresh))

    def rows(batches: Iterator[list[list]]) -> Iterator[tuple[list, ...]]:
        now, before, fresh = handle.value
        words = _Words()
        chunk = _Chunk(words)

        def sent() -> Iterator[tuple[list, ...]]:
            totals: dict[bytes, int] = defaultdict(int)
            for k, (keys, n) in chunk.counted(now, before, fresh, most):
                yield keys, n
                if k == 1:
                    for key, m in zip(keys, n, strict=True):
                        totals[key[: key.rindex(b"\n") + 1]] += m
            yield list(totals), list(totals.values())

        for langs, texts in batches:
            for lang, text in zip(langs, texts, strict=True):
                chunk.add(lang, text)
                if chunk.size >= CHUNK:
                    yield from sent()
                    words = words if len(words.names) < KEPT_WORDS else _Words()
                    chunk = _Chunk(words)
        if chunk.parts:
            yield from sent()

    def told(batches: Iterator[list[list]]) -> Iterator[tuple[list, ...]]:
        for keys, n in batches:
            langs, phrases = map(list, zip(*[key.rsplit("\n", 1) for key in keys], strict=True))
            held = handle.value[0].holds(_hashes([langs, phrases])).tolist()
            yield langs, [p.count(" ") + 1 if p else 0 for p in phrases], phrases, n, held

    parts = map_tasks(docs.select("lang", "text"), rows, "key string, n long").groupBy("key").agg(F.sum("n").alias("n"))
    often = parts.where((F.col("n") >= least) | F.col("key").endswith("\n"))
    return map_tasks(often, told, "lang string, words int, phrase string, n long, held boolean")


def _hashes(columns: list[list]) -> np.ndarray:
    """Hashes of languages and phrases."""
    out = np.empty(len(columns[0]), np.uint64)
    by_kind: dict[tuple[str, int], list[tuple[int, list[bytes]]]] = defaultdict(list)
    for row, (lang, phrase) in enumerate(zip(*columns, strict=True)):
        words = phrase.encode().split(b" ")
        by_kind[lang, len(words)].append((row, words))
    for (lang, _), held in by_kind.items():
        words = [np.array(_word_hashes(lang, w), np.uint64) for w in zip(*[w for _, w in held], strict=True)]
        rolled = words[0]
        for w in words[1:]:
            rolled = rolled * _STEP + w
        out[[row for row, _ in held]] = _mixed(rolled)
    return out


def _filter(phrases: DataFrame, n: int) -> bloom.Filter:
    """The filter of n phrases (lang, phrase), which are read by a task for each PHRASES of them."""
    return bloom.build(phrases.select("lang", "phrase").coalesce(n // PHRASES + 1), _hashes, bloom.blocks_for(n), False)


def frequent(docs: DataFrame, least: int, proposed: DataFrame | None = None, most: int = MOST_WORDS) -> DataFrame:
    """(lang, words, phrase, n): every phrase of up to ``most`` words that occurs ``least`` times in its language, and with
    0 words the number of all words.  Proposals (lang, phrase) save passes and change nothing else.
    """
    now = bloom.Filter(1) if proposed is None else _filter(proposed, proposed.count())
    first = saved(_counts(docs, now, None, None, most, least))
    shorter = F.col("words").between(1, most - 1)
    size, missed = first.where(shorter).agg(F.count(F.lit(1)), F.count(F.when(~F.col("held"), 1))).first()
    if not missed:
        return first.drop("held")
    # a frequent phrase that was not counted has a shortest part that was not; the parts of that one were counted, are
    # frequent, and one of them was not proposed: so one pass over what has such a part finds all that is left
    fresh = _filter(first.where(shorter & ~F.col("held")), missed)
    rest = saved(_counts(docs, _filter(first.where(shorter), size), now, fresh, most, least))
    return first.unionByName(rest.where("words > 0")).drop("held")


def collocations(
    docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", least: int = LEAST, most: int = MOST_WORDS, best: int = BEST, sample_bytes: int = SAMPLE_BYTES
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of two words or more of each language.

    Words are lower-cased (A-Z) and lie between marks, line ends, spaces and tabs; phrases do not go over marks and line
    ends.  ``a`` is how often a phrase occurs, ``l`` and ``r`` how often its parts do, n the words of its language; of its
    cuts the one of the lowest score counts (ties: the earliest).  A phrase that mostly occurs inside a longer candidate is
    dropped.  Ties of rank: by a, then by phrase.  A null language is ``und``, a null text is empty; repeated rows count each.
    """
    size = F.coalesce(F.octet_length(text), F.lit(0))
    held = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"), F.xxhash64(key, text).alias("at"))
    total = docs.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first()["n"]
    share = min(1.0, sample_bytes / max(1, total))
    sample = saved(held.where(F.pmod("at", F.lit(1_000_000)) < round(share * 1_000_000)).select("lang", "text").repartition(SAMPLE_PARTS))
    proposed = frequent(sample, least if share == 1 else max(2, int(LOWERED * share * least)), most=most - 1).where("words > 0")
    return best_of(frequent(held.select("lang", "text"), least, proposed, most), best)


def best_of(counts: DataFrame, best: int = BEST) -> DataFrame:
    """The ranked phrases from (lang, words, phrase, n) of all frequent ones."""
    counts = saved(counts)
    phrases = counts.where("words > 0").select("lang", "words", "phrase", "n")
    candidates = phrases.where("words > 1").withColumnRenamed("n", "a")
    w = F.split("phrase", " ")
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    part = lambda first, n: F.array_join(F.slice(w, first, n), " ")

    cuts = candidates.select("lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("left"), part(F.col("cut") + 1, F.col("words") - F.col("cut")).alias("right"))
    of = lambda side, name: phrases.select("lang", F.col("phrase").alias(side), F.col("n").alias(name))
    cuts = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"])
    score = F.expr(f"(cast(a as decimal(20,0)) * cast({SCALE} as decimal(10,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    lowest = cuts.select("lang", "phrase", "a", F.struct(score.alias("score"), "cut", "l", "r").alias("c")).groupBy("lang", "phrase", "a").agg(F.min("c").alias("c"))

    inner = candidates.where("words > 2").select("lang", "words", "a", w.alias("w"), F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    inner = inner.select("lang", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("at"))
    inside = inner.groupBy("lang", F.array_join(F.slice("w", F.col("at"), F.col("size")), " ").alias("phrase")).agg(F.max("a").alias("longer"))
    rows = lowest.join(inside, ["lang", "phrase"], "left")
    rows = rows.where(F.col("longer").isNull() | (100 * exact("longer") < INSIDE * exact("a")))
    rows = rows.select("lang", "phrase", "a", "c.l", "c.r", "c.score")

    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    totals = counts.where("words = 0").select("lang", "n")
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
