"""The best rows of a large table for each question of a query set.

The query set goes to the tasks in blocks of bounded size; each task scores its own rows against a block, one matrix an
Arrow batch, and keeps the best k a question, so that at most tasks x questions x k rows are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Questions that go to the tasks at a time, and rows that are scored at a time.
BLOCK, ROWS = 4096, 1024
#: Words that a worker remembers the needles of.
KEPT_WORDS = 200_000


def blocks_of(questions: DataFrame, block: int | None = None) -> Iterator[list]:
    """The questions in blocks of rows.  They are read when the plan is made, partition by partition."""
    held = []
    for row in questions.toLocalIterator():
        held.append(row)
        if len(held) == (block or BLOCK):
            yield held
            held = []
    if held:
        yield held


def _merge(best: tuple[np.ndarray, np.ndarray] | None, keys: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best (keys, scores) a column of those kept so far and of new rows; ties by key."""
    order = np.argsort(keys, kind="stable")
    rank = np.argsort(-scores[order], axis=0, kind="stable")[:k]
    new = keys[order][rank], np.take_along_axis(scores[order], rank, 0)
    if best is None:
        return new
    both, values = np.concatenate([best[0], new[0]]), np.concatenate([best[1], new[1]])
    first = np.argsort(both, axis=0, kind="stable")
    both, values = np.take_along_axis(both, first, 0), np.take_along_axis(values, first, 0)
    rank = np.argsort(-values, axis=0, kind="stable")[:k]
    return np.take_along_axis(both, rank, 0), np.take_along_axis(values, rank, 0)


def best_rows(
    df: DataFrame | Callable[[Broadcast], DataFrame], questions: DataFrame, key: str, scorer: Callable[[list], Callable[[dict[str, list]], np.ndarray]], k: int | Callable[[list], int], least: float = -np.inf, kind: T.DataType | None = None
) -> DataFrame:
    """(q, key, score, rank): the k best rows of ``df`` for each question; ties by key.

    ``scorer(block)`` is called in the task and gives a function from the columns of some rows to their scores, one column
    a question; scores not above ``least`` are left out.  Rows without a key are left out, repeated ones count each.
    ``df`` may be a function of a broadcast block, where the rows depend on what is asked; ``kind`` is then the key's type.
    """
    spark, out = questions.sparkSession, None
    kind, asked = kind or df.schema[key].dataType, questions.schema["q"].dataType
    schema = T.StructType([T.StructField("q", asked), T.StructField(key, kind), T.StructField("score", T.DoubleType())])
    arrow = to_arrow_schema(schema)
    for block in blocks_of(questions):
        handle = spark.sparkContext.broadcast(block)

        def work(batches: Iterator[pa.RecordBatch], handle=handle) -> Iterator[pa.RecordBatch]:
            rows, best = handle.value, None
            score, most = scorer(rows), k(rows) if callable(k) else k
            for whole in batches:
                for at in range(0, whole.num_rows, ROWS):
                    columns = {n: c.to_pylist() for n, c in zip(whole.schema.names, whole.slice(at, ROWS).columns, strict=True)}
                    best = _merge(best, np.array(columns[key]), score(columns), most)
            if best is None:
                return
            n, at = np.nonzero(best[1].T > least)
            keys, scores = best[0].T[n, at], best[1].T[n, at]
            names = [rows[i]["q"] for i in n.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((names, keys.tolist(), scores), arrow, strict=True)], schema=arrow)

        rows = df(handle) if callable(df) else df
        part = rows.where(F.col(key).isNotNull()).mapInArrow(work, schema)
        out = part if out is None else out.unionAll(part)
    if out is None:
        out = spark.createDataFrame([], schema)
    w = Window.partitionBy("q").orderBy(F.desc("score"), key)
    ranked = out.withColumn("rank", F.row_number().over(w))
    return ranked if callable(k) else ranked.where(F.col("rank") <= k)


class Needles:
    """Which of a set of plain words (letters, digits, underscores) lie in a text, as parts of its words.

    A needle that occurs in a text lies inside one of the text's runs of such characters, so each distinct run is looked
    through once a worker, by the needles' lengths.
    """

    def __init__(self, needles: list[str]):
        self.at = {n: k for k, n in enumerate(dict.fromkeys(needles))}
        self.lengths = sorted({len(n) for n in self.at})
        self.known: dict[str, tuple[int, ...]] = {}

    def of_word(self, word: str) -> tuple[int, ...]:
        at, n = self.at.get, len(word)
        parts = {word[i : i + k] for k in self.lengths if k <= n for i in range(n - k + 1)}
        found = tuple({k for p in parts if (k := at(p)) is not None})
        if n <= 64:
            if len(self.known) >= KEPT_WORDS:
                self.known.clear()
            self.known[word] = found
        return found

    def present(self, texts: list[list[str]]) -> np.ndarray:
        """A row of ones and zeros a text, given the texts' words."""
        known, columns, ends = self.known, [], []
        for words in texts:
            for word in set(words):
                found = known.get(word)
                columns += self.of_word(word) if found is None else found
            ends.append(len(columns))
        out = np.zeros((len(texts), len(self.at)))
        out[np.repeat(np.arange(len(texts)), np.diff([0, *ends])), np.array(columns, dtype=np.int64)] = 1.0
        return out

    def weights(self, lists: list[list[str]]) -> np.ndarray:
        """How often each needle stands in each list: one column a list."""
        out = np.zeros((len(self.at), len(lists)))
        for column, needles in enumerate(lists):
            for n in needles:
                out[self.at[n], column] += 1.0
        return out
