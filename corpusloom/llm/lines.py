"""Lines that many documents share.

One pass sets two Bloom filters, of the hashes of lines seen once and seen twice.  A second pass sends only lines that the
second filter holds, counted a task first, to be confirmed by their text.  A third pass drops them in place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import bloom
from corpusloom.llm.common import map_tasks, saved
from corpusloom.llm.simhash import looked_up

#: Characters that a line's key has at least, documents that share a line which is dropped.
LEAST_CHARS, LEAST_DOCS = 40, 5
#: Confirmed lines that are broadcast at most (some 200 bytes each); more of them are joined.
KEPT_LINES = 200_000
#: Suspected lines that a task counts before it sends them.
COUNTED = 100_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = b" \t\n\x0b\x0c\r"


def line_keys(text: str | None, least: int = LEAST_CHARS) -> list[bytes | None]:
    """A key for each line: ends stripped, A-Z lower-cased; none for lines of fewer characters."""
    out = []
    for line in (text or "").encode().translate(_LOWER).split(b"\n"):
        key = line.strip(_SPACE)
        long = len(key) >= least and (key.isascii() or len(key) >= 4 * least or len(key.decode()) >= least)
        out.append(key if long else None)
    return out


def _digests(keys: list[bytes | None]) -> dict[bytes, bytes]:
    """Distinct keys with their 128-bit hashes."""
    return {k: xxhash.xxh3_128_digest(k) for k in dict.fromkeys(keys) if k is not None}


def _hashes(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.uint64)[::2]


def shared_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> tuple[DataFrame, bloom.Filter]:
    """(digest, top) of the lines of ``docs`` (doc_id, text) in enough documents, with the largest id, and the filter of
    lines that may come twice."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]  # a key has a byte a character
    blocks = bloom.blocks_for(size // (least_chars + 1))

    def of_texts(columns: list[list]) -> np.ndarray:
        return _hashes([d for t in columns[0] for d in _digests(line_keys(t, least_chars)).values()])

    twice = bloom.build(docs.select("text"), of_texts, blocks, True)
    handle = docs.sparkSession.sparkContext.broadcast(twice)

    def suspects(batches: Iterator[list[list]]) -> Iterator[tuple[list, ...]]:
        found: dict[bytes, list] = {}

        def columns() -> tuple[list, ...]:
            return [k.decode() for k in found], [v[0] for v in found.values()], [v[1] for v in found.values()], [v[2] for v in found.values()]

        for ids, texts in batches:
            for doc_id, text in zip(ids, texts, strict=True):
                digests = _digests(line_keys(text, least_chars))
                for (key, digest), held in zip(digests.items(), handle.value.holds(_hashes(list(digests.values()))).tolist(), strict=True):
                    if not held:
                        continue
                    if (row := found.get(key)) is None:
                        found[key] = [digest, 1, doc_id]
                        continue
                    row[1] += 1
                    if row[2] is None or doc_id is not None and doc_id > row[2]:
                        row[2] = doc_id
                if len(found) >= COUNTED:
                    yield columns()
                    found = {}
        if found:
            yield columns()

    counts = map_tasks(docs.select("doc_id", "text"), suspects, "key string, digest binary, n long, top long")
    lines = counts.groupBy("key").agg(F.first("digest").alias("digest"), F.sum("n").alias("n"), F.max("top").alias("top"))
    return saved(lines.where(F.col("n") >= least_docs).select("digest", "top")), twice


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, kept_lines: int = KEPT_LINES) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept): every row's text without the lines that enough documents share, which only the
    document of the largest id keeps.

    Each row is a document, also where rows or ids repeat: rows of the largest id all keep such a line.  A null id is
    smaller than all others.  A null or empty text is one empty line.  Only the two named columns are read.
    """
    held = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    confirmed, twice = shared_lines(held, least_chars, least_docs)
    few = confirmed.limit(kept_lines + 1).collect()  # of that many at most
    context = docs.sparkSession.sparkContext
    many = len(few) > kept_lines
    known = context.broadcast({} if many else {bytes(r["digest"]): r["top"] for r in few})
    rows = _with_drops(held, confirmed, context.broadcast(twice), least_chars) if many else held.withColumn("drops", F.lit(None).cast("array<binary>"))

    def kept(batches: Iterator[list[list]]) -> Iterator[tuple[list, ...]]:
        tops = known.value
        for ids, texts, drops in batches:
            n_lines, n_dropped, out = [], [], []
            for doc_id, whole, drop in zip(ids, texts, drops, strict=True):
                keys, lines, own = line_keys(whole, least_chars), (whole or "").split("\n"), set(drop or ())
                gone = {k for k, d in _digests(keys).items() if d in own or d in tops and tops[d] != doc_id}
                stay = [x for x, k in zip(lines, keys, strict=True) if k not in gone] if gone else lines
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(stay))
                out.append("\n".join(stay))
            yield ids, n_lines, n_dropped, out

    return map_tasks(rows, kept, "doc_id long, n_lines long, n_dropped long, kept string")


def _with_drops(docs: DataFrame, confirmed: DataFrame, twice, least_chars: int) -> DataFrame:
    """(doc_id, text, drops): hashes of the lines that each row loses, by joins.  Equal rows lose the same."""
    row = F.struct("doc_id", F.xxhash64("text").alias("a"), F.hash("text").alias("b"), F.length("text").alias("c"))

    def suspects(batches: Iterator[list[list]]) -> Iterator[tuple[list, ...]]:
        for rows, ids, texts in batches:
            out: tuple[list, ...] = ([], [], [])
            for r, doc_id, text in zip(rows, ids, texts, strict=True):
                digests = list(_digests(line_keys(text, least_chars)).values())
                for digest, may in zip(digests, twice.value.holds(_hashes(digests)).tolist(), strict=True):
                    if may:
                        for column, x in zip(out, (r, doc_id, digest), strict=True):
                            column.append(x)
            yield out

    told = docs.select(row.alias("row"), "doc_id", "text").select(F.to_json("row").alias("row"), "doc_id", "text")
    pairs = map_tasks(told, suspects, "row string, doc_id long, digest binary")
    lost = looked_up(pairs, confirmed, "digest").where(~F.col("doc_id").eqNullSafe(F.col("top")))
    drops = lost.groupBy("row").agg(F.collect_set("digest").alias("drops"))
    return told.join(drops, "row", "left").select("doc_id", "text", "drops")
