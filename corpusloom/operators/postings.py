"""Top rows by sparse cosine through stored postings, without reading what cannot matter.

Vectors are stored in parts of a bounded number of entries, each with the postings of its own rows: a dimension's entries in
blocks of a fixed number, by falling share of the entry in its vector's length, with the largest and smallest share a block.
Entries name a row by its number in the part, and are not dealt out when they are stored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpusloom.operators.retrieval import _perhaps
from corpusloom.operators.vectors import _arrays, _lists, entries
from corpusloom.sources.io import saved

#: Entries of a block; dimensions of a question whose first blocks tell the parts that are scored first; entries of a part;
#: rows of a part that are scored one by one, beyond which the part is scored as a whole.
BLOCK, OPENING, PART, FEW = 256, 4, 1 << 21, 32
#: Scores that differ by less are ties, and go by id.
TIE = 1e-9


def write_postings(index: DataFrame, path: str, block: int = BLOCK) -> None:
    """Stores an index as (part, block, idx, top, low, ids, ws), and (part, names, norms) once a part.

    ``index`` has (id, idx, w, norm), with arrays idx and w a row (:func:`vectors.hashed_rows`), which stay where they are,
    or with an entry a row, which are brought together.  Null ids and zero lengths are left out.
    """
    rows = index.where("id is not null and norm > 0").select(F.col("id").cast("string").alias("id"), "idx", "w", "norm")
    if not isinstance(index.schema["idx"].dataType, T.ArrayType):
        rows = rows.groupBy("id").agg(F.collect_list(F.struct("idx", "w")).alias("e"), F.first("norm").alias("norm")).select("id", "e.idx", "e.w", "norm")
    rows = rows.select("id", F.col("idx").cast("array<int>").alias("idx"), F.col("w").cast("array<long>").alias("w"), "norm")
    kind = "part long, idx int, top double, low double, ids array<int>, ws array<long>, names array<string>, norms array<double>"
    schema = to_arrow_schema(T.StructType.fromDDL(kind))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, names, norms, dims, counts, n = TaskContext.get().partitionId() << 32, [], [], [], [], 0

        def close() -> pa.RecordBatch:
            size = [len(x) for x in dims]
            idx, w, row, norm = np.concatenate(dims), np.concatenate(counts), np.repeat(np.arange(len(dims), dtype=np.int32), size), np.array(norms)
            share = w / norm[row]
            order = np.lexsort((row, -share, idx))
            idx, w, row, share = idx[order], w[order], row[order], share[order]
            first = np.flatnonzero(np.diff(idx, prepend=idx[:1] - 1))
            at = np.arange(len(idx)) - np.repeat(first, np.diff([*first, len(idx)]))
            start = np.flatnonzero(at % block == 0)
            ends = np.array([*start, len(idx)])
            none = [None] * len(start)
            columns = ([part] * (len(start) + 1), [*idx[start].tolist(), None], [*share[start].tolist(), None], [*share[ends[1:] - 1].tolist(), None], _lists([*ends, len(idx)], row), _lists([*ends, len(idx)], w), [*none, names], [*none, norms])
            return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            for name, idx, w, norm in zip(batch.column(0).to_pylist(), _arrays(batch.column(1)), _arrays(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                if n and n + len(idx) > PART:
                    yield close()
                    part, names, norms, dims, counts, n = part + 1, [], [], [], [], 0
                if len(idx):
                    names.append(name)
                    norms.append(norm)
                    dims.append(idx)
                    counts.append(w)
                    n += len(idx)
        if n:
            yield close()

    blocks = rows.mapInArrow(cut, kind)
    blocks.withColumn("block", F.monotonically_increasing_id()).write.mode("overwrite").option("compression", "zstd").parquet(path)


def _exact(pairs: DataFrame, index: DataFrame, asked: DataFrame) -> DataFrame:
    """(q, id, score) of given pairs, which are kept; rows that no pair names are not dealt out."""
    held = _perhaps(index.select(F.col("id").cast("string").alias("id"), "idx", "w", "norm"), "id", pairs)
    held = entries(held, "id") if isinstance(index.schema["idx"].dataType, T.ArrayType) else held
    held = pairs.join(_perhaps(held, "idx", asked), "id").join(asked.select("q", "idx", "qw", "qnorm"), ["q", "idx"])
    dots = held.groupBy("q", "id").agg(F.sum(F.col("w") * F.col("qw")).alias("dot"), F.first("norm").alias("n"), F.first("qnorm").alias("m"))
    return dots.select("q", "id", F.round(F.col("dot") / (F.col("n") * F.col("m")), 9).alias("score"))


def _scored(blocks: DataFrame, wanted: DataFrame, k: int | None = None) -> DataFrame:
    """(q, part, id, score) by the wanted blocks (q, part, block, qw, qnorm, least, rest) of each part, added up in its task.

    With ``k`` the k best rows of a question and part that score above 0, ties by id.  Otherwise rows that may reach the
    bound with what is not read; where they are more than FEW, one row without id stands for all.  Blocks that no question
    wants are not dealt out; names of rows go with their part.
    """
    asked = wanted.schema["q"].dataType
    own = [("q", asked.simpleString()), ("qw", "long"), ("qnorm", "double"), ("least", "double"), ("rest", "double")]
    stored = ["ids", "ws", "names", "norms"]
    columns = lambda names: [F.col(c) if c in names else F.lit(None).cast(t).alias(c) for c, t in (*((c, blocks.schema[c].dataType) for c in stored), *own)]
    named = -F.col("part") - 1
    keyed = blocks.withColumn("loom_key", F.when(F.col("idx").isNull(), named).otherwise(F.col("block")))
    held = _perhaps(keyed, "loom_key", wanted.select(F.explode(F.array("block", named)).alias("loom_key")))
    rows = held.select("part", F.when(F.col("idx").isNull(), 0).otherwise(1).alias("turn"), "block", *columns(stored))
    asks = wanted.select("part", F.lit(2).alias("turn"), "block", *columns([c for c, _ in own]))
    dealt = rows.unionByName(asks).repartition("part").sortWithinPartitions("part", "turn", "q")
    schema = T.StructType([T.StructField("q", asked), T.StructField("part", T.LongType()), T.StructField("id", T.StringType()), T.StructField("score", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now, known, names, norms, dot, seen, ask = None, None, {}, [], None, None, None, None

        def close() -> list[pa.RecordBatch]:
            if now is None:
                return []
            at = np.flatnonzero(seen)
            score = dot[at] / (norms[at] * ask[0])
            if k is None:
                keep = np.flatnonzero(score + ask[2] >= ask[1] - TIE).tolist()
            else:
                told = np.round(score, 9)
                keep = np.flatnonzero(told > 0)
                if len(keep) > k:
                    keep = keep[told[keep] >= np.partition(told[keep], -k)[-k]]
                keep = sorted(keep.tolist(), key=lambda n: (-told[n], names[at[n]]))[:k]
            dot[at], seen[at] = 0, False
            if k is None and len(keep) > FEW:
                rows = ([now], [part], [None], [None])
            else:
                rows = ([now] * len(keep), [part] * len(keep), [names[n] for n in at[keep].tolist()] if keep else [], score[keep] if keep else [])
            return [pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, arrow, strict=True)], schema=arrow)]

        for batch in batches:
            parts, turns, numbers, asking, weights = (batch.column(n).to_pylist() for n in (0, 1, 2, 7, 8))
            lists = [batch.column(n) for n in (3, 4, 5, 6)]
            for n, (p, turn) in enumerate(zip(parts, turns, strict=True)):
                if p != part:
                    yield from close()
                    part, now, known = p, None, {}
                if turn == 0:
                    names, norms = lists[2][n].as_py(), lists[3][n].values.to_numpy()
                    dot, seen = np.zeros(len(names), np.int64), np.zeros(len(names), bool)
                elif turn == 1:
                    known[numbers[n]] = lists[0][n].values.to_numpy().copy(), lists[1][n].values.to_numpy().copy()
                else:
                    if asking[n] != now:
                        yield from close()
                        now, ask = asking[n], [batch.column(c)[n].as_py() for c in (9, 10, 11)]
                    ids, ws = known[numbers[n]]
                    dot[ids] += ws * weights[n]
                    seen[ids] = True
        yield from close()

    return dealt.mapInArrow(work, schema).withColumn("score", F.round("score", 9))


def sparse_topk(blocks: DataFrame, index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(q, id, score, rank, n_blocks, n_read): the k best rows of each query that score above 0; ties by id.

    ``blocks`` is what :func:`write_postings` stored of ``index``, ``queries`` (q, idx, w, norm) a query set.  The first
    blocks of a query's weightiest dimensions tell in which parts it is scored first, by all of its blocks there, and the
    k-th of these scores is a bound.  Dimensions that together cannot reach it are not read elsewhere, nor are blocks whose
    entries cannot with all other dimensions at their best; what is read adds up to partial scores.  Where few rows of a part
    may reach the bound, these are scored by the index, otherwise the part is by all of the query's blocks, as are at once
    the parts of a query that would not be spared half of its blocks.  The result is that of scoring all rows.  Null ids, rows without entries and queries without any have no result.  ``n_read`` counts the
    blocks read under the bound, not those that give it.
    """
    asked = saved(queries.where("norm > 0 and q is not null").select("q", "idx", F.col("w").alias("qw"), F.col("norm").alias("qnorm")))
    meta = blocks.where("idx is not null").select("idx", "part", "block", "top", "low")
    best = lambda top, low: F.greatest(F.col("qw") / F.col("qnorm") * F.col(top), F.col("qw") / F.col("qnorm") * F.col(low), F.lit(0.0))
    first, last = F.max_by("part", F.struct("top", -F.col("block"))), F.min_by("part", F.struct("low", "block"))
    dims = meta.groupBy("idx").agg(F.max("top").alias("dim_top"), F.min("low").alias("dim_low"), F.count(F.lit(1)).alias("n"), first.alias("top_part"), last.alias("low_part"))  # a row a dimension
    by_q = Window.partitionBy("q")
    bounds = asked.join(dims, "idx").withColumn("most", best("dim_top", "dim_low"))
    bounds = bounds.withColumn("all", F.sum("most").over(by_q)).withColumn("place", F.row_number().over(by_q.orderBy(F.desc("most"), "idx")))
    bounds = saved(bounds)

    opening = bounds.where((F.col("place") <= OPENING) & (F.col("most") > 0)).select("q", F.when(F.col("qw") > 0, F.col("top_part")).otherwise(F.col("low_part")).alias("part")).distinct()
    kth = Window.partitionBy("q").orderBy(F.desc("score"), "id")

    def whole(parts: DataFrame) -> DataFrame:
        """All blocks of each question in given parts (q, part)."""
        held = bounds.join(meta.select("idx", "part", "block"), "idx").join(parts, ["q", "part"])
        return saved(held.select("q", "part", "block", "qw", "qnorm", F.lit(0.0).alias("least"), F.lit(0.0).alias("rest")))

    first = saved(_scored(blocks, whole(opening), k))
    least = first.withColumn("turn", F.row_number().over(kth)).where(F.col("turn") == k).select("q", "score").withColumnRenamed("score", "least")

    up = by_q.orderBy("most", "idx").rowsBetween(Window.unboundedPreceding, 0)
    ruled = bounds.join(least, "q", "left").withColumn("least", F.coalesce("least", F.lit(0.0)) - TIE).withColumn("below", F.sum("most").over(up))
    ruled = ruled.withColumn("open", F.col("below") >= F.col("least"))
    ruled = ruled.withColumn("rest", F.sum(F.when(~F.col("open"), F.col("most")).otherwise(0.0)).over(by_q))
    wanted = ruled.where("open").join(meta, "idx").withColumn("gain", best("top", "low")).where(F.col("gain") + F.col("all") - F.col("most") >= F.col("least"))
    wanted = saved(wanted.select("q", "part", "block", "qw", "qnorm", "least", "rest"))
    counts = bounds.groupBy("q").agg(F.sum("n").alias("n_blocks"))
    much = wanted.groupBy("q").agg(F.count(F.lit(1)).alias("n")).join(counts, "q").where(F.col("n") * 2 >= F.col("n_blocks")).select("q")
    fewer = wanted.join(much, "q", "left_anti")
    found = saved(_scored(blocks, fewer))
    parts = found.where("id is null").select("q", "part").unionByName(wanted.join(much, "q", "left_semi").select("q", "part").distinct())
    rest = whole(parts.join(opening, ["q", "part"], "left_anti"))
    scored = first.unionByName(_scored(blocks, rest, k)).select("q", "id", "score")
    scored = scored.unionByName(_exact(found.where("id is not null").select("q", "id"), index, asked)).dropDuplicates(["q", "id"])
    ranked = scored.where("score > 0").withColumn("rank", F.row_number().over(kth)).where(F.col("rank") <= k)
    read = fewer.select("q", "block").unionByName(rest.select("q", "block")).distinct().groupBy("q").agg(F.count(F.lit(1)).alias("n_read"))
    told = counts.join(read, "q", "left")
    return ranked.join(told, "q").select("q", "id", "score", "rank", "n_blocks", F.coalesce("n_read", F.lit(0)).alias("n_read"))
