"""Incremental chunking of new record files, and a graph that grows with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.functions.text import clean_text
from corpusloom.operators.chunking import chunk_corpus
from corpusloom.operators.loads import load_graph
from corpusloom.packs import LEGAL, Pack


def stream_chunks(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, schema: str = "id string, text string", fmt: str = "json", fast: bool = True, available_now: bool = True) -> StreamingQuery:
    """Reads record files as they come (ids present), cleans and cuts texts, appends chunk rows as Parquet.

    Stateless and row by row: a restart goes on from the checkpoint.
    """
    rows = spark.readStream.schema(schema).format(fmt).load(in_dir).where("id is not null")
    chunks = chunk_corpus(rows.withColumn("text", clean_text(F.coalesce("text", F.lit("")), fast)))
    sink = chunks.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    return (sink.trigger(availableNow=True) if available_now else sink).start(out_dir)


def stream_graph(
    spark: SparkSession, in_dir: str, folder: str, checkpoint: str, pack: Pack = LEGAL, schema: str = "id string, text string", fmt: str = "json", fast: bool = True, available_now: bool = True, files: int | None = None
) -> StreamingQuery:
    """Reads record files as they come, at most ``files`` a batch, and adds their chunks to the stored graph.

    A batch is a load of its own number.  After a restart the stream runs the batch that was not finished again, with the
    same rows and number, so each chunk's entities and pairs are counted once.
    """
    reader = spark.readStream.schema(schema).format(fmt)
    reader = reader.option("maxFilesPerTrigger", files) if files else reader
    rows = reader.load(in_dir).where("id is not null")
    chunks = chunk_corpus(rows.withColumn("text", clean_text(F.coalesce("text", F.lit("")), fast)))

    def add(batch: DataFrame, number: int) -> None:
        load_graph(batch, folder, number, pack)

    sink = chunks.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (sink.trigger(availableNow=True) if available_now else sink).start()
