"""Overlapping token windows over texts, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import computed, ws_tokens

#: Tokens of a window and of an overlap.
SIZE, OVERLAP = 384, 64


def chunk_windows(tokens: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """array<(chunk_index, token_start, token_end, tokens)>; the last window is the first to reach the end."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the window")
    step, n = size - overlap, F.size(tokens)
    last = F.greatest(F.lit(0), F.ceil((n - F.lit(size)) / F.lit(step))).cast("int")
    windows = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.struct(
            i.alias("chunk_index"),
            (i * step).alias("token_start"),
            F.least(i * step + size, n).alias("token_end"),
            F.slice(tokens, i * step + 1, F.lit(size)).alias("tokens"),
        ),
    )
    return F.when(n > 0, windows)


def chunk_id(source_id: Column, index: Column, text: Column) -> Column:
    key = F.concat(source_id, F.lit(":"), index.cast("string"), F.lit(":"), F.substring(text, 1, 200))
    return F.substring(F.sha1(key.cast("binary")), 1, 16)


def chunk_corpus(opinions: DataFrame, size: int = SIZE, overlap: int = OVERLAP, tokens: Column | None = None, joint: str = " ") -> DataFrame:
    """Chunk rows of opinions (id, text and, where there, source_dataset and metadata); texts without tokens give none.

    ``tokens``, an array of the text's tokens, replaces white-space words; with ``joint`` between them they give a chunk's
    text.  Tokens that keep their spaces, such as the pieces of a subword tokenizer, are joined by ''.  Null ids give
    chunks with null ids; repeated rows are cut each.
    """
    carried = [c for c in ("source_dataset", "metadata") if c in opinions.columns]
    own = F.col("id").cast("string").alias("source_id")
    split = computed(opinions, own, *carried, loom_tokens=ws_tokens(F.col("text")) if tokens is None else tokens)
    # the outer form lets no filter on the windows' number down to the scan, where they would be cut once more
    rows = split.select("source_id", *carried, F.explode_outer(chunk_windows(F.col("loom_tokens"), size, overlap)).alias("w")).where("w is not null")
    at = ("chunk_index", "token_start", "token_end")
    cut = computed(rows, "source_id", *carried, *[f"w.{c}" for c in at], text=F.trim(F.array_join("w.tokens", joint)))
    return cut.where("text <> ''").select(
        chunk_id(F.col("source_id"), F.col("chunk_index"), F.col("text")).alias("id"), "source_id", *carried, *at,
        (F.col("token_end") - F.col("token_start")).alias("token_count"), "text",
    )


def chunk_report(opinions: DataFrame, chunks: DataFrame, wanted: int = 2_000_000) -> DataFrame:
    """One row: documents and chunks, tokens before and with overlaps."""
    a = opinions.select(F.size(ws_tokens(F.col("text"))).alias("n")).where("n > 0").agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("input_tokens"))
    b = chunks.agg(F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("chunked_tokens"))
    return F.broadcast(a).crossJoin(b).select("documents", "chunks", "input_tokens", "chunked_tokens", (F.col("input_tokens") >= wanted).alias("enough"))
