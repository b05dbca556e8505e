"""Hashed bag-of-words vectors and dense vectors."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.best import KEPT_WORDS, best_rows

#: Fixed value: dimensions of a hashed vector.
DIMS = 4096
#: Tokens of a text in lower case.
_TOKEN = re.compile(r"[a-z][a-z0-9_]+")


def slot_of(hashing: str) -> Callable[[str], tuple[int, int]]:
    """Dimension and sign of a token, of its md5 or of its 8-byte blake2b, for work inside tasks."""

    def md5(token: str) -> tuple[int, int]:
        h = hashlib.md5(token.encode(), usedforsecurity=False).hexdigest()
        return int(h[:8], 16) % DIMS, -1 if h[8] >= "8" else 1

    def blake2b(token: str) -> tuple[int, int]:
        h = int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "big")
        return h % DIMS, -1 if h >> 63 else 1

    return {"md5": md5, "blake2b": blake2b}[hashing]


def hashed_rows(df: DataFrame, key: str, text: str, hashing: str = "md5") -> DataFrame:
    """(key, idx, w, norm), one row a key: dimensions in order, signed token counts without zeros, the vector's length.

    Texts are counted where they are; of their vectors those of one key are brought together and added up.  Null keys are
    left out, and so are texts without tokens.
    """
    slot, held = slot_of(hashing), df.select(key, F.lower(text).alias("low")).where(F.col(key).isNotNull() & F.col("low").isNotNull())
    lists = "idx array<int>, w array<long>"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, int]] = {}
        for batch in batches:
            ends, dims, counts = [0], [], []
            for low in batch.column(1).to_pylist():
                row: dict[int, int] = {}
                for token, n in Counter(_TOKEN.findall(low)).items():
                    if (s := known.get(token)) is None:
                        if len(known) >= KEPT_WORDS:
                            known.clear()
                        s = known[token] = slot(token)
                    row[s[0]] = row.get(s[0], 0) + n * s[1]
                dims += row.keys()
                counts += row.values()
                ends.append(len(dims))
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(ends, np.array(dims, np.int32)), _lists(ends, np.array(counts, np.int64))], [key, "idx", "w"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []

        def close() -> tuple[np.ndarray, np.ndarray]:
            dims, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
            if len(parts) > 1:
                dims, at = np.unique(dims, return_inverse=True)
                total = np.zeros(len(dims), np.int64)
                np.add.at(total, at, counts)
                counts = total
            order = np.argsort(dims, kind="stable")
            order = order[counts[order] != 0]
            return dims[order], counts[order]

        def made(keys: list, rows: list) -> pa.RecordBatch:
            kept = [n for n, r in enumerate(rows) if len(r[0])]
            rows, ends = [rows[n] for n in kept], np.cumsum([0, *[len(rows[n][0]) for n in kept]])
            norms = [float(np.sqrt(float((c * c).sum()))) for _, c in rows]
            dims, counts = (np.concatenate([r[n] for r in rows]) if rows else np.zeros(0, kind) for n, kind in ((0, np.int32), (1, np.int64)))
            return pa.RecordBatch.from_arrays([pa.array([keys[n] for n in kept], kind_of_key), _lists(ends, dims), _lists(ends, counts), pa.array(norms, pa.float64())], [key, "idx", "w", "norm"])

        kind_of_key = None
        for batch in batches:
            keys, rows, kind_of_key = [], [], batch.schema.field(0).type
            for k, own in zip(batch.column(0).to_pylist(), zip(_arrays(batch.column(1)), _arrays(batch.column(2)), strict=True), strict=True):
                if k != now:
                    if parts:
                        keys.append(now)
                        rows.append(close())
                    now, parts = k, []
                parts.append(own)
                if len(parts) > 1_000:
                    parts[:] = [close()]
            yield made(keys, rows)
        if parts:
            yield made([now], [close()])

    kind = df.schema[key].dataType.simpleString()
    counted = held.mapInArrow(count, f"`{key}` {kind}, {lists}").where(F.size("idx") > 0)
    return counted.repartition(key).sortWithinPartitions(key).mapInArrow(add, f"`{key}` {kind}, {lists}, norm double")


def _lists(ends: list[int] | np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))


def _arrays(column: pa.ListArray) -> list[np.ndarray]:
    """The lists of a column as arrays."""
    ends = column.offsets.to_numpy()
    return np.split(column.values.to_numpy()[ends[0] : ends[-1]], ends[1:-1] - ends[0]) if len(column) else []


def entries(rows: DataFrame, key: str) -> DataFrame:
    """(key, idx, w, norm) with a row a dimension, of rows with a vector each."""
    return rows.select(key, F.explode(F.arrays_zip("idx", "w")).alias("e"), "norm").select(key, "e.idx", "e.w", "norm")


def hashed_embedding(df: DataFrame, key: str, text: str, hashing: str = "md5") -> DataFrame:
    """(key, idx, w, norm): counts and the vector's length; texts without tokens have no rows."""
    return entries(hashed_rows(df, key, text, hashing), key)


def l2_normalize(vector: Column) -> Column:
    """A vector over its length; a zero vector stays as it is."""
    v = vector.cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(v, lambda x: x / F.when(norm == 0, F.lit(1.0)).otherwise(norm))


def build_index(chunks: DataFrame, path: str, hashing: str = "md5", limit: int | None = None) -> DataFrame:
    """Writes the sparse index, dealt and sorted by chunk; gives the one-row manifest, which is written beside it."""
    held = chunks.orderBy("source_id", "chunk_index").limit(limit) if limit else chunks
    hashed_embedding(held, "id", "text", hashing).repartition("id").sortWithinPartitions("id", "idx").write.mode("overwrite").parquet(f"{path}/index")
    manifest = held.agg(F.count(F.lit(1)).alias("chunks")).select(F.lit(f"hashing-{hashing}").alias("provider"), F.lit(DIMS).alias("dims"), "chunks", F.lit(limit).cast("int").alias("limit"))
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return manifest


def sparse_scores(index: DataFrame, queries: DataFrame) -> DataFrame:
    """(q, id, score): cosine of each query with each chunk that shares a dimension.

    ``queries`` is a query set (q, idx, w, norm).  Products of counts are added as integers and divided once.
    """
    q = queries.select("q", "idx", F.col("w").alias("qw"), F.col("norm").alias("qnorm"))
    dots = index.join(q, "idx").groupBy("q", "id").agg(F.sum(F.col("w") * F.col("qw")).alias("dot"), F.first("norm").alias("n"), F.first("qnorm").alias("m"))
    return dots.select("q", "id", (F.col("dot") / (F.col("n") * F.col("m"))).alias("score"))


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(q, key, score, rank): the k nearest vectors by cosine of each query of a query set.  Ties: the smaller key.

    Rows and queries without a vector are left out; a zero vector is at distance one of all.
    """

    def unit(rows: list[list[float]]) -> np.ndarray:
        a = np.array(rows, dtype=float)
        n = np.linalg.norm(a, axis=1, keepdims=True)
        return a / np.where(n == 0, 1, n)

    def scorer(block: list):
        matrix = unit([r["v"] for r in block]).T
        return lambda columns: unit(columns["v"]) @ matrix

    held = vectors.select(key, F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    return best_rows(held, queries.select("q", F.col(vector).cast("array<double>").alias("v")).where("v is not null"), key, scorer, k)
