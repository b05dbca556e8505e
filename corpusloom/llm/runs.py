"""Stretches of a text that repeat a group of words.

A document's word ids are compressed to a grammar by Re-Pair: the most frequent pair of neighbours becomes a new symbol as
long as one occurs twice.  The runs that cross the border between a symbol's two parts are found once, where it occurs
first, and hold at all of its places; the largest of the intervals of a period are the runs.  A document is the work of one
task and needs memory in proportion to its words.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction
from itertools import count

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import map_tasks

#: Words of a run, and periods in it, at least.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: An odd base for hashes of stretches; what they find is compared word by word.
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _stretches(ids: np.ndarray) -> list[tuple[int, int]]:
    """The parts of a text that can hold runs.

    In a run of four periods and six words each triple of words comes three times at least, so rarer triples end a part.
    """
    if len(ids) < LEAST_WORDS:
        return []
    w = ids.astype(np.uint64) * _BASE
    triples = (w[:-2] * _BASE + w[1:-1]) * _BASE + w[2:]
    kept = np.arange(len(triples))
    while len(kept):
        _, at, n = np.unique(triples[kept], return_inverse=True, return_counts=True)
        some = kept[n[at] >= 3]
        ends = np.flatnonzero(np.diff(some) > 1)
        lo, hi = some[np.r_[0, ends + 1]] if len(some) else some, some[np.r_[ends, len(some) - 1]] if len(some) else some
        long = hi - lo + 3 >= LEAST_WORDS
        stays = some[np.repeat(long, np.searchsorted(some, hi, "right") - np.searchsorted(some, lo))]
        if len(stays) == len(kept):
            return list(zip(lo[long].tolist(), (hi[long] + 3).tolist(), strict=True))
        kept = stays
    return []


def grammar(ids: list[int], parts: list[tuple[int, int]]) -> list[tuple[int, int, list[int]]]:
    """Re-Pair over parts of a text: (words before the inner border, words, places) of each symbol with two parts.

    Of pairs of one frequency the one that was there first is taken.  What is left of each part is paired up as a tree.
    """
    sym, size = list(ids), {}
    after, before = [-1] * len(ids), [-1] * len(ids)
    for lo, hi in parts:
        after[lo : hi - 1], before[lo + 1 : hi] = range(lo + 1, hi), range(lo, hi - 1)
    fresh = max(ids, default=0) + 1
    width = lambda s: size.get(s, 1)
    places: dict[tuple[int, int], list[int]] = {}
    for lo, hi in parts:
        for i in range(lo, hi - 1):
            places.setdefault((sym[i], sym[i + 1]), []).append(i)
    order = count()
    heap = [(-len(at), next(order), pair) for pair, at in places.items() if len(at) > 1]
    heapq.heapify(heap)
    rules = []
    while heap:
        claimed, turn, pair = heapq.heappop(heap)
        a, b = pair
        at, last = [], -1
        for i in places.pop(pair, ()):
            if sym[i] == a and i != last and (j := after[i]) >= 0 and sym[j] == b:
                at.append(i)
                last = j if a == b else -1  # places of a pair of equals do not overlap
        if len(at) < 2:
            continue
        if len(at) < -claimed:
            places[pair] = at
            heapq.heappush(heap, (-len(at), turn, pair))
            continue
        new = {}
        for i in at:
            j = after[i]
            left, right = before[i], after[j]
            sym[i], sym[j], after[i] = fresh, -1, right
            if right >= 0:
                before[right] = i
                new.setdefault((fresh, sym[right]), []).append(i)
            if left >= 0:
                new.setdefault((sym[left], fresh), []).append(left)
        size[fresh] = width(a) + width(b)
        rules.append((width(a), size[fresh], at))
        for key, got in new.items():
            if len(got) > 1:
                places[key] = got
                heapq.heappush(heap, (-len(got), next(order), key))
        fresh += 1
    for lo, _ in parts:
        row, i = [], lo
        while i >= 0:
            row.append((i, width(sym[i])))
            i = after[i]
        while len(row) > 1:
            pairs = [(x[0], x[1] + y[1]) for x, y in zip(row[::2], row[1::2])]
            rules += [(x[1], n, [i]) for x, (i, n) in zip(row[::2], pairs)]
            row = pairs + row[len(pairs) * 2 :]
    return rules


def _same(ids: np.ndarray, i: int, j: int, end: int) -> int:
    """How many words from i on equal those from j on, which end at ``end``."""
    n, step = 0, 32
    while j + n < end:
        m = min(step, end - j - n)
        if len(x := np.flatnonzero(ids[i + n : i + n + m] != ids[j + n : j + n + m])):
            return n + int(x[0])
        n, step = n + m, step * 2
    return n


def _same_back(ids: np.ndarray, i: int, j: int, start: int) -> int:
    """How many words before i, from ``start`` on, equal those before j."""
    n, step = 0, 32
    while i - n > start:
        m = min(step, i - n - start)
        if len(x := np.flatnonzero(ids[i - n - m : i - n] != ids[j - n - m : j - n])):
            return n + m - 1 - int(x[-1])
        n, step = n + m, step * 2
    return n


class _Text:
    """Word ids with hashes of their stretches."""

    def __init__(self, ids: np.ndarray):
        self.ids, n = ids, len(ids)
        self.pairs = np.full(n, -1)  # of each word with the one before
        self.pairs[1:] = ids[:-1] * (int(ids.max()) + 1) + ids[1:]
        self.power = np.cumprod(np.r_[np.uint64(1), np.full(n, _BASE)], dtype=np.uint64)
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        self.sums = np.r_[np.uint64(0), np.cumsum(mixed * self.power[:n], dtype=np.uint64)]

    def crossing(self, start: int, border: int, end: int) -> list[tuple[int, int, int]]:
        """(first, end, period) of the runs inside [start, end) that hold the words on both sides of a border.

        Such a run has two periods on one side, so the two words at the border come again a period away on that side.
        """
        most, out, ids, sums = (end - start) // LEAST_PERIODS, {}, self.ids, self.sums
        two = self.pairs[border]
        right = np.flatnonzero(self.pairs[border + 1 : min(border + most, border + (end - border) // 2) + 1] == two) + 1
        left = np.flatnonzero(self.pairs[max(border - most, border - (border - start) // 2, 1) : border][::-1] == two) + 1
        for periods, side in ((right, 1), (left, -1)):
            if not len(periods):
                continue
            first = np.full(len(periods), border) if side > 0 else border - 2 * periods
            one, next_one = sums[first + periods] - sums[first], sums[first + 2 * periods] - sums[first + periods]
            found: list[tuple[int, int]] = []  # periods, and words on this side
            for q in periods[one * self.power[periods] == next_one].tolist():
                if any(q % p == 0 and n >= q + p for p, n in found):
                    continue  # the same run
                i = border - _same_back(ids, border, border + q, start) if side > 0 else border - q - _same_back(ids, border - q, border, start)
                j = border + q + _same(ids, border, border + q, end) if side > 0 else border + _same(ids, border - q, border, end)
                if j - i >= max(LEAST_WORDS, LEAST_PERIODS * q) and i < border < j:
                    found.append((q, j - border if side > 0 else border - i))
                    out[i, j] = min(q, out.get((i, j), q))
        return [(i, j, q) for (i, j), q in out.items()]


def find_runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, words, period) of all runs of a text of word ids, by start and period."""
    parts = _stretches(ids)
    if not parts:
        return []
    # the parts, one after the other; places in them to places in the text
    origin = np.concatenate([np.arange(lo, hi) for lo, hi in parts])
    edges = np.cumsum([0, *[hi - lo for lo, hi in parts]]).tolist()
    text = _Text(ids[origin])
    intervals: dict[int, list[np.ndarray]] = {}
    for before, n, places in grammar(text.ids.tolist(), list(zip(edges, edges[1:]))):
        if n < LEAST_WORDS:
            continue
        for i, j, q in text.crossing(places[0], places[0] + before, places[0] + n):
            at = origin[np.array(places) + (i - places[0])]
            intervals.setdefault(q, []).append(np.stack([at, at + (j - i)], 1))
    out = []
    for q, held in intervals.items():
        rows = np.concatenate(held)
        rows = rows[np.lexsort((-rows[:, 1], rows[:, 0]))]
        furthest = np.maximum.accumulate(rows[:, 1])
        largest = np.r_[True, rows[1:, 1] > furthest[:-1]]
        out += [(i, j - i, q) for i, j in rows[largest].tolist()]
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(n: int, h: int) -> np.ndarray | None:
    """Which original word stands at each of n places of a document whose id has the crc32 h; none if all stay."""
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def text_runs(text: str | None, h: int = 1) -> tuple[list[tuple[int, int, int]], str]:
    """The runs of a text, and the text without their later periods, its words joined by a space."""
    words = (text or "").encode().split()
    if (at := planted(len(words), h)) is not None:
        words = [words[i] for i in at.tolist()]
    known: defaultdict[bytes, int] = defaultdict(count().__next__)
    ids = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    runs = find_runs(ids)
    if runs:
        stay = np.ones(len(words), bool)
        for start, n, q in runs:
            stay[start + q : start + n] = False
        words = [words[i] for i in np.flatnonzero(stay).tolist()]
    return runs, b" ".join(words).decode()


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", plant: bool = False) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs, collapsed) of every row.

    A run is a stretch in which words a period apart are the same, of six words and four periods at least, that no
    neighbour extends; the one with the most periods is told (ties: by start, then period), and all of them as lines
    ``start,length,period``.  ``collapsed`` is the text with one period of each run, words joined by a space.  Null and
    empty texts have no words and no runs.  ``plant`` first repeats words in the documents whose id's crc32 ends in 0, as
    the check of this operator wants it; null ids have none.  Rows are independent; only the named columns are read.
    """

    def rows(batches: Iterator[list[list]]) -> Iterator[tuple[list, ...]]:
        for ids, texts in batches:
            out: list[tuple] = []
            for doc_id, whole in zip(ids, texts, strict=True):
                h = zlib.crc32(str(doc_id).encode()) if plant and doc_id is not None else 1
                runs, left = text_runs(whole, h)
                best = min(runs, key=lambda r: (Fraction(-r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
                milli = 1000 * best[1] // best[2] if runs else None
                out.append((doc_id, len(runs), *best, milli, "".join(f"{a},{n},{q}\n" for a, n, q in runs), left))
            yield tuple(map(list, zip(*out, strict=True)))

    held = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_tasks(held, rows, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs string, collapsed string")
