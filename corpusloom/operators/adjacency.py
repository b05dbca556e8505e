"""The first mentions and edges of each entity, stored by entity.

Paths read the first few mentions and edges of their seeds.  Stored in buckets by entity, only those are read, whatever an
entity's number of mentions, and joins by entity do not deal the table out again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.retrieval import DIRECT, EDGES, top

#: Buckets of a stored table.
BUCKETS = 32


def first_mentions(mentions: DataFrame, n: int = DIRECT) -> DataFrame:
    """(entity_id, mention_rank, chunk_id, weight): the first n mentions of each entity by chunk; null ids are left out.

    Tasks keep n rows an entity before rows are dealt, so an entity with most of the mentions is no large group.
    """
    held = mentions.where("entity_id is not null and chunk_id is not null")
    return top(held, ["entity_id"], [F.col("chunk_id")], n, "mention_rank").select("entity_id", "mention_rank", "chunk_id", "weight")


def first_edges(related: DataFrame, n: int = EDGES, edge_order: str = "file") -> DataFrame:
    """(entity_id, edge_rank, other, weight): the first n edges at each entity, read both ways, by (from, to) or by weight."""
    out = related.select(F.col("from_entity_id").alias("entity_id"), F.col("to_entity_id").alias("other"), "from_entity_id", "to_entity_id", "weight")
    back = related.select(F.col("to_entity_id").alias("entity_id"), F.col("from_entity_id").alias("other"), "from_entity_id", "to_entity_id", "weight")
    ids = [F.col("from_entity_id"), F.col("to_entity_id")]
    held = out.unionByName(back).where("from_entity_id is not null and to_entity_id is not null")
    return top(held, ["entity_id"], [F.desc("weight"), *ids] if edge_order == "weight" else ids, n, "edge_rank").select("entity_id", "edge_rank", "other", "weight")


def write_adjacency(mentions: DataFrame, related: DataFrame, name: str, path: str, buckets: int = BUCKETS, edge_order: str = "file") -> None:
    """Stores both as tables ``name``_mentions and ``name``_edges under a path, in buckets by entity, sorted inside."""
    for part, rows, order in (("mentions", first_mentions(mentions), "mention_rank"), ("edges", first_edges(related, edge_order=edge_order), "edge_rank")):
        sink = rows.repartition(buckets, "entity_id").write.mode("overwrite").option("path", f"{path}/{part}")
        sink.bucketBy(buckets, "entity_id").sortBy("entity_id", order).saveAsTable(f"{name}_{part}")


def read_adjacency(spark: SparkSession, name: str) -> tuple[DataFrame, DataFrame]:
    """The stored mentions and edges, for the path operators."""
    return spark.table(f"{name}_mentions"), spark.table(f"{name}_edges")
