"""A stored graph that grows by loads.

Each load writes, under its own number, what only its new chunks add: their rows, and their counts of entities and pairs.
Reading adds the counts up.  A load that is run again, after an end between two of its writes too, replaces its own rows and
nothing else, and chunks that another load has brought count once, so any overlap of loads gives the graph of all chunks.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import graph
from corpusloom.packs import LEGAL, Pack
from corpusloom.schemas import GRAPH
from corpusloom.sources.io import dedup_vertices, saved

_FIRST = "first struct<chunk_index: int, chunk_id: string>"
#: What a load stores; other tables of the graph are made of these.
STORED = {
    "legal_cases": f"{GRAPH['legal_cases']}, {_FIRST}",
    **{name: GRAPH[name] for name in ("chunks", "citations", "has_chunk", "cites", "entities", "mentions", "related_to")},
}


def _stored(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Rows of all loads, with the number of the load."""
    try:
        return spark.read.schema(f"{STORED[name]}, load long").parquet(f"{folder.rstrip('/')}/{name}")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], f"{STORED[name]}, load long")


def load_graph(chunks: DataFrame, folder: str, load: int, pack: Pack = LEGAL) -> None:
    """Adds a batch of chunks to the stored graph as load number ``load``.

    Chunks of one id count once, inside a batch and over all loads; null ids are left out.  Every table is written to a
    folder of the load alone, so running the same load again changes nothing.
    """
    spark = chunks.sparkSession
    known = _stored(spark, folder, "chunks").where(F.col("load") != load).select(F.col("chunk_id").alias("id"))
    own = dedup_vertices(chunks.where("id is not null"), "id", ["source_id", "chunk_index"])
    new = saved(own.join(known, "id", "left_anti"))
    kept = graph.chunk_entities(new, pack)
    kept = saved(kept)
    citations, cites = graph.build_citations(new)
    firsts = new.groupBy(F.col("source_id").alias("case_id")).agg(F.min(F.struct("chunk_index", F.col("id").alias("chunk_id"))).alias("first"))
    tables = {
        "legal_cases": graph.build_cases(new, pack).join(firsts, "case_id"), "chunks": graph.build_chunk_vertices(new), "citations": citations, "has_chunk": graph.build_has_chunk(new),
        "cites": cites, "entities": graph.build_entities(kept), "mentions": graph.build_mentions(kept), "related_to": graph.build_related(kept),
    }
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}/load={load}")


def read_loads(spark: SparkSession, folder: str, pack: Pack = LEGAL) -> dict[str, DataFrame]:
    """The ten tables of the graph of all loads.

    A source whose chunks came by several loads has the name and citations of its first chunk; a folder without loads gives
    empty tables, but for the reports of topics.
    """
    t = {name: _stored(spark, folder, name).drop("load") for name in STORED}
    cases = t["legal_cases"].groupBy("case_id").agg(
        F.min_by(F.struct("case_name", "citations"), "first").alias("m"), F.max("court").alias("court"), F.max("decision_date").alias("decision_date")
    )
    entities = t["entities"].groupBy("entity_id").agg(F.min("name").alias("name"), F.min("type").alias("type"), F.sum("frequency").alias("frequency"))
    related = t["related_to"].groupBy("from_entity_id", "to_entity_id", "relation_type").agg(F.sum("weight").alias("weight"))
    return {
        "legal_cases": cases.select("case_id", "m.case_name", "m.citations", "court", "decision_date"), "chunks": t["chunks"], "citations": t["citations"].distinct(), "has_chunk": t["has_chunk"],
        "next_chunk": graph.build_next_chunk(t["chunks"].withColumnRenamed("chunk_id", "id")), "cites": t["cites"].distinct(), "entities": entities, "mentions": t["mentions"], "related_to": related,
        "community_reports": graph.type_communities(entities).unionByName(graph.topic_communities(entities, pack)),
    }
