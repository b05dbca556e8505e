"""Operator 10: benchmark passages in documents, by a distributed positional inverted index.

The index is split by documents: a row of it holds the postings of a run of documents, for each term the list of its
positions, terms in order of their 64-bit hash.  It is stored, so that any number of test items can be looked up without
reading a text again, and holds every term, so it does not depend on the items.  A phrase is looked up from its rarest
term on: that term's list, moved back by the term's place in the phrase, is intersected with the moved lists of the next
rarest terms until nothing or only matches are left.  A proximity match asks for all words of a phrase, in any order,
within a stretch of words.  Test items are a stated query set: they go to the tasks in blocks of bounded size.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import map_batches, saved

#: Words of a window; words of a stretch that a proximity match may span.
WINDOW, SPAN = 13, 26
#: Words of test items that go to the tasks at a time, and words of documents in a row of the index.
BLOCK_WORDS, INDEX_WORDS = 400_000, 200_000
#: Blocks that a worker of the filter keeps built, and that go to it in one pass.
KEPT_BLOCKS = 4
#: Words whose hash a worker remembers.
KEPT_HASHES = 500_000

#: Bytes of words as they are, A-Z in lower case, all others a space; bytes beyond ASCII belong to words.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split() if text else []


def windows_of(words: list, size: int = WINDOW) -> list[tuple]:
    """Every run of ``size`` words; a shorter list, if it has words, is one window itself."""
    if not words:
        return []
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


class _Hashes(dict):
    """word -> its unsigned 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_HASHES:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_HASHES = _Hashes()


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))


class Queries:
    """Windows of some test items as rows of term numbers; ``terms`` holds the terms' hashes in order."""

    def __init__(self, items: list[tuple[int, str | None]], size: int = WINDOW):
        found: dict[tuple[int, ...], set[int]] = {}
        for item, text in items:
            for w in windows_of(hashes_of(words_of(text)).tolist(), size):
                found.setdefault(w, set()).add(item)
        self.items = [sorted(of) for of in found.values()]
        self.sizes = np.array([len(w) for w in found], dtype=np.int64)
        self.terms = np.unique(np.array([t for w in found for t in w], dtype=np.uint64))
        self.windows = np.full((len(found), size), len(self.terms), dtype=np.int64)  # padded by a term that all runs hold
        for k, w in enumerate(found):
            self.windows[k, : len(w)] = np.searchsorted(self.terms, np.array(w, dtype=np.uint64))


class Index:
    """Postings of a run of documents; documents are kept apart by a gap of one position."""

    def __init__(self, starts: np.ndarray, lengths: np.ndarray, terms: np.ndarray, at: np.ndarray, positions: np.ndarray):
        self.starts, self.lengths, self.terms, self.at, self.positions = starts, lengths, terms, at, positions

    @classmethod
    def of(cls, texts: list[str | None]) -> Index:
        parts = [hashes_of(words_of(t)) for t in texts]
        lengths = np.array([len(p) for p in parts], dtype=np.int32)
        starts = np.cumsum(lengths + 1) - lengths - 1
        codes = np.concatenate([*parts, np.empty(0, np.uint64)])
        order = np.argsort(codes, kind="stable")
        terms, first = np.unique(codes[order], return_index=True)
        places = np.arange(len(codes)) + np.repeat(np.arange(len(parts)), lengths)  # one gap a document before
        return cls(starts.astype(np.int32), lengths, terms, np.append(first, len(codes)).astype(np.int32), places[order].astype(np.int32))

    def lists(self, queries: Queries) -> tuple[np.ndarray, np.ndarray]:
        """First and end of each term's list, and of the padding term."""
        if not len(self.terms):
            none = np.zeros(len(queries.terms) + 1, dtype=np.int64)
            return none, none
        k = np.minimum(np.searchsorted(self.terms, queries.terms), len(self.terms) - 1)
        known = self.terms[k] == queries.terms
        first, end = np.where(known, self.at[k], 0), np.where(known, self.at[k + 1], 0)
        return np.append(first, 0), np.append(end, np.iinfo(np.int32).max)

    def alive(self, queries: Queries) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows all of whose terms occur in the run, and the terms' lists."""
        first, end = self.lists(queries)
        counts = (end - first)[queries.windows] if len(queries.windows) else np.zeros((0, 1))
        return np.flatnonzero(counts.min(axis=1) > 0) if len(counts) else np.empty(0, np.int64), first, end

    def phrase(self, lists: list[np.ndarray]) -> np.ndarray:
        """Positions where the phrase of these terms' lists begins."""
        ranked = sorted(range(len(lists)), key=lambda k: len(lists[k]))
        begin = lists[ranked[0]] - ranked[0]
        for k in ranked[1:]:
            if not len(begin):
                break
            begin = begin[_within(lists[k], begin + k, begin + k)]
        return begin

    def near(self, lists: list[np.ndarray], span: int) -> set[int]:
        """Documents of the run in which some stretch of ``span`` words holds a word of each list."""
        lists = sorted(lists, key=len)
        here = lists[0]
        doc = np.searchsorted(self.starts, here, side="right") - 1
        low = np.maximum(here - (span - 1), self.starts[doc])
        high = np.minimum(here + (span - 1), self.starts[doc] + self.lengths[doc] - 1)
        for other in lists[1:]:
            if not len(here):
                return set()
            keep = _within(other, low, high)
            here, doc, low, high = here[keep], doc[keep], low[keep], high[keep]
        found: set[int] = set()
        for d, a, b in zip(doc.tolist(), low.tolist(), high.tolist(), strict=True):
            if d not in found and _covered([x[np.searchsorted(x, a) : np.searchsorted(x, b, side="right")] for x in lists], span):
                found.add(d)
        return found


def _within(positions: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each stretch from low to high, both included, whether one of the positions lies in it."""
    k = np.searchsorted(positions, low)
    return (k < len(positions)) & (positions[np.minimum(k, len(positions) - 1)] <= high)


def _covered(lists: list[np.ndarray], span: int) -> bool:
    """Whether some stretch of ``span`` positions holds one of each list: from each position on, the first of each list."""
    for begin in np.sort(np.concatenate(lists)).tolist():
        firsts = [x[k] if (k := np.searchsorted(x, begin)) < len(x) else begin + span for x in lists]
        if max(firsts) - begin < span:
            return True
    return False


def _runs(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of documents of bounded text size; a longer text is a run of its own."""
    first = size = 0
    for k, t in enumerate(texts):
        n = len(t or "") // 6 + 1
        if size and size + n > INDEX_WORDS:
            yield first, k
            first, size = k, 0
        size += n
    if texts:
        yield first, len(texts)


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str | None]]]:
    """The items in blocks of at most BLOCK_WORDS words (one item at least), read partition by partition; one at least."""
    block, size, any_block = [], 0, False
    items = benchmark.select(F.col("item_id").cast("long").alias("i"), F.col("text").alias("t")).where("i is not null")
    for row in items.toLocalIterator():
        n = len(words_of(row["t"]))
        if block and size + n > BLOCK_WORDS:
            yield block
            block, size, any_block = [], 0, True
        block.append((row["i"], row["t"]))
        size += n
    if block or not any_block:
        yield block


def found_in(index: Index, queries: Queries, span: int = SPAN) -> list[tuple[list[int], list[int], list[int]]]:
    """For each document of the run: the stretches that windows hit, the items by phrase, and (not at span 0) by proximity."""
    n = len(index.lengths)
    hits: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    items: list[set[int]] = [set() for _ in range(n)]
    close: list[set[int]] = [set() for _ in range(n)]
    alive, first, end = index.alive(queries)
    for w in alive.tolist():
        size, of = int(queries.sizes[w]), queries.items[w]
        terms = queries.windows[w, :size].tolist()
        lists = {t: index.positions[first[t] : end[t]] for t in set(terms)}
        begins = index.phrase([lists[t] for t in terms])
        for b, d in zip(begins.tolist(), (np.searchsorted(index.starts, begins, side="right") - 1).tolist(), strict=True):
            hits[d].append((b - int(index.starts[d]), b - int(index.starts[d]) + size))
            items[d].update(of)
        for d in index.near(list(lists.values()), span) if span else ():
            close[d].update(of)
    out = []
    for k in range(n):
        merged: list[int] = []
        for a, b in sorted(hits[k]):
            if merged and a <= merged[-1]:
                merged[-1] = max(merged[-1], b)
            else:
                merged += [a, b]
        out.append((merged, sorted(items[k]), sorted(close[k])))
    return out


_BUILT: dict[str, Queries] = {}


def _queries(name: str, handle, most: int = 1) -> Queries:
    """The block's queries, built once a worker, which keeps those of the last ``most`` blocks."""
    if name not in _BUILT:
        while len(_BUILT) >= most:
            del _BUILT[next(iter(_BUILT))]
        _BUILT[name] = Queries(handle.value)
    return _BUILT[name]


def _n_hit(spans: list[int]) -> int:
    hit = upto = 0
    for a, b in sorted(zip(spans[::2], spans[1::2], strict=True)):  # stretches of different blocks may overlap
        hit += max(0, b - max(a, upto))
        upto = max(upto, b)
    return hit


def _contaminated(n_words: int, spans: list[int]) -> bool:
    hit = _n_hit(spans)
    return hit > 0 and 20 * hit >= n_words


def build_index(docs: DataFrame) -> DataFrame:
    """The index, stored: a row for each run of documents.

    ``doc_ids``, ``rows``, ``starts`` and ``lengths`` are by document; ``terms`` (hashes in order), ``at`` (where each
    term's list begins) and ``positions`` (the lists one after the other) are by term, as bytes of fixed-size numbers.
    Null and empty texts are documents without words; null ids and repeated rows stay, told apart by their row number.
    """

    def rows(columns):
        ids, numbers, texts = columns
        for first, end in _runs(texts):
            x = Index.of(texts[first:end])
            yield ids[first:end], numbers[first:end], x.starts.tobytes(), x.lengths.tobytes(), x.terms.tobytes(), x.at.tobytes(), x.positions.tobytes()

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("n"), F.col("text").alias("text"))
    schema = "doc_ids array<long>, rows array<long>, starts binary, lengths binary, terms binary, at binary, positions binary"
    return saved(map_batches(plain, rows, schema, most=8))


def lookup(index: DataFrame, handle, name: str, every: bool, span: int = SPAN) -> DataFrame:
    """(row, doc_id, n_words, spans, items, near_items) of each document, or without ``every`` of those with a match."""

    def rows(columns):
        queries = _queries(name, handle)
        for ids, numbers, *parts in zip(*columns, strict=True):
            x = Index(*(np.frombuffer(p, dtype=t) for p, t in zip(parts, (np.int32, np.int32, np.uint64, np.int32, np.int32), strict=True)))
            for doc, number, n, (spans, items, near) in zip(ids, numbers, x.lengths.tolist(), found_in(x, queries, span), strict=True):
                if every or spans or near:
                    yield number, doc, n, spans, items, near

    schema = "row long, doc_id long, n_words long, spans array<int>, items array<long>, near_items array<long>"
    return map_batches(index, rows, schema)


def matches(docs: DataFrame, benchmark: DataFrame, span: int = SPAN) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, spans (begin and end of each stretch of hit words), items, near_items.

    ``spans`` is flat: begin, end, begin, end.  ``near_items`` are the items some window of which has all of its words,
    in any order, within ``span`` words of the document.  Texts that are null or without words have no words and no
    match; items without words or id never match; repeated rows and null ids stay; other columns are left out.
    """
    index, context, parts = build_index(docs), docs.sparkSession.sparkContext, []
    for block in _blocks(benchmark):
        # each block is looked up and its matches are kept before the next one is read
        if parts:
            parts[-1] = saved(parts[-1])
        parts.append(lookup(index, context.broadcast(block), uuid.uuid4().hex, not parts, span))
    if len(parts) == 1:
        return parts[0].drop("row")
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    flat = lambda c: F.flatten(F.collect_list(c))
    return every.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), flat("spans").alias("spans"),
        F.array_sort(F.array_distinct(flat("items"))).alias("items"), F.array_sort(F.array_distinct(flat("near_items"))).alias("near_items"),
    ).drop("row")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest of :func:`matches`: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near_items."""

    def rows(columns):
        for doc, n, spans, items, near in zip(*columns, strict=True):
            digest = hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
            yield doc, n, _n_hit(spans), len(items), digest, _contaminated(n, spans), len(near)

    found = matches(docs, benchmark).select("doc_id", "n_words", "spans", "items", "near_items")
    return map_batches(found, rows, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, n_near_items long")


def _judged(batches: Iterator[pa.RecordBatch], text: int, spans: int, handles: list, last: bool) -> Iterator[pa.RecordBatch]:
    """Batches whose column of spans has those of some more blocks; or, in the last pass, the good rows without that column."""
    for batch in batches:
        texts, found = batch.columns[text].to_pylist(), batch.columns[spans].to_pylist()
        runs = list(_runs(texts))
        indexes = [Index.of(texts[a:b]) for a, b in runs]
        for name, handle in handles:
            queries = _queries(name, handle, KEPT_BLOCKS)
            for (a, _), index in zip(runs, indexes, strict=True):
                for k, hit in enumerate(found_in(index, queries, 0)):
                    found[a + k] += hit[0]
        if last:
            n_words = [n for index in indexes for n in index.lengths.tolist()]
            good = [not _contaminated(n, x) for n, x in zip(n_words, found, strict=True)]
            rest = [c for k, c in enumerate(batch.columns) if k != spans], [n for k, n in enumerate(batch.schema.names) if k != spans]
            yield pa.RecordBatch.from_arrays(*rest).filter(pa.array(good, pa.bool_()))
        else:
            columns = [pa.array(found, pa.list_(pa.int32())) if k == spans else c for k, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the contaminated rows; the columns stay as they are.

    Each task indexes its own rows and judges them by the blocks of test items, so no text is shuffled, and rows without an
    id or with a repeated one are judged like any other at every size of the benchmark.  A pass takes KEPT_BLOCKS blocks,
    which a worker builds once; a larger benchmark takes more passes, and rows with their spans so far are stored between.
    """
    context, name = docs.sparkSession.sparkContext, "loom_spans"
    while name in docs.columns:
        name += "_"
    rows = docs.withColumn(name, F.array().cast("array<int>"))
    text, spans = docs.columns.index("text"), len(docs.columns)
    blocks = _blocks(benchmark)
    group = list(islice(blocks, KEPT_BLOCKS))
    while group:
        handles = [(uuid.uuid4().hex, context.broadcast(block)) for block in group]
        group = list(islice(blocks, KEPT_BLOCKS))
        last = not group

        def work(batches, handles=handles, last=last):
            return _judged(batches, text, spans, handles, last)

        if last:
            return rows.mapInArrow(work, docs.schema)
        rows = saved(rows.mapInArrow(work, rows.schema))
    return docs
