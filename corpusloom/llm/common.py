"""Small helpers shared by the text operators."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, types as T
from pyspark.sql import functions as F

from corpusloom.sources.io import shared_folder

#: Words are runs of anything but the six ASCII white-space bytes.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept where every executor can read them again: the session's shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def map_batches(
    df: DataFrame, rows: Callable[[list[list]], Iterable[tuple]], schema: str | T.StructType, most: int = 2048
) -> DataFrame:
    """``rows(columns)`` for each Arrow batch of ``df``: takes one list a column, gives tuples in the order of ``schema``."""
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(kind)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pack(got: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(c), f.type) for c, f in zip(zip(*got, strict=True), arrow, strict=True)], schema=arrow
            )

        for batch in batches:
            if batch.num_rows == 0:
                continue
            got: list[tuple] = []
            for row in rows([c.to_pylist() for c in batch.columns]):
                got.append(row)
                if len(got) >= most:
                    yield pack(got)
                    got = []
            if got:
                yield pack(got)

    return df.mapInArrow(work, kind)


def map_tasks(df: DataFrame, rows: Callable[[Iterator[list[list]]], Iterable[tuple[list, ...]]], schema: str) -> DataFrame:
    """``rows(batches)`` for each task: takes the columns of its Arrow batches one after the other, gives columns of results."""
    kind = T.StructType.fromDDL(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(kind)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in rows([c.to_pylist() for c in b.columns] for b in batches if b.num_rows):
            whole = [pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)]
            for at in range(0, len(whole[0]), 100_000):
                yield pa.RecordBatch.from_arrays([c.slice(at, 100_000) for c in whole], schema=arrow)

    return df.mapInArrow(work, kind)


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo ``by`` (null for a null id)."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(by))


def tokenizer_file(name: str) -> str:
    """Where a public vocabulary lies: LOOM_TOKENIZERS, or the installed ``public_tokenizers`` package."""
    if folder := os.environ.get("LOOM_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
