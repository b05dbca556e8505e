"""The corpus graph as tables, built from chunks.

Chunks come from :mod:`corpusloom.operators.chunking`; ``metadata`` may hold case_name and citations.  All strings pass
``safe_text`` first.  Entity candidates, their counts and pairs stay inside the chunk's row; only entity, mention and pair
counts are shuffled.
"""

from __future__ import annotations

from functools import partial

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import computed, entity_name, is_entity, safe_text, short_hash
from corpusloom.packs import LEGAL, Pack

#: Entities of a chunk, names in a type's summary, ids of a type's report.
PER_CHUNK, NAMED, LISTED = 16, 20, 200


def _meta(df: DataFrame, name: str) -> Column:
    if "metadata" in df.columns and name in df.schema["metadata"].dataType.names:
        return F.col(f"metadata.{name}")
    return F.lit(None).cast("array<string>" if name == "citations" else "string")


def _citations(df: DataFrame) -> Column:
    """Non-empty citations of a row, delimiter-safe."""
    c = _meta(df, "citations")
    return F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: safe_text(x)), lambda x: x != "")


def extract_court(text: Column, pack: Pack = LEGAL) -> Column:
    """The first court of a text, cut where a month begins and stripped of spaces and dots; '' if none."""
    found = F.regexp_extract(text, pack.court, 0)
    return F.btrim(F.split(found, pack.months, 2)[0], F.lit(" .")) if pack.months else F.btrim(found, F.lit(" ."))


def extract_date(text: Column, pack: Pack = LEGAL) -> Column:
    return F.regexp_extract(text, pack.date, 0)


def build_cases(chunks: DataFrame, pack: Pack = LEGAL) -> DataFrame:
    """One row a source: name (else the id) and citations of its first chunk, court and date of its chunk 0."""
    text = safe_text(F.col("text"))
    zero = F.col("chunk_index") == 0
    first = F.struct("chunk_index", "id")
    rows = chunks.select(
        F.col("source_id").alias("case_id"), first.alias("first"), safe_text(_meta(chunks, "case_name")).alias("name"), F.array_join(_citations(chunks), "; ").alias("cites"),
        F.when(zero, extract_court(text, pack)).alias("court"), F.when(zero, extract_date(text, pack)).alias("decision_date"),
    )
    got = rows.groupBy("case_id").agg(
        F.min_by(F.struct("name", "cites"), "first").alias("m"), F.coalesce(F.max("court"), F.lit("")).alias("court"),
        F.coalesce(F.max("decision_date"), F.lit("")).alias("decision_date"),
    )
    name = F.when(F.col("m.name") != "", F.col("m.name")).otherwise(safe_text(F.col("case_id")))
    return got.select("case_id", name.alias("case_name"), F.col("m.cites").alias("citations"), "court", "decision_date")


def build_chunk_vertices(chunks: DataFrame) -> DataFrame:
    return chunks.select(F.col("id").alias("chunk_id"), "source_id", F.coalesce("chunk_index", F.lit(0)).alias("chunk_index"), F.coalesce("token_count", F.lit(0)).alias("token_count"), safe_text(F.col("text")).alias("text"))


def build_has_chunk(chunks: DataFrame) -> DataFrame:
    return chunks.select(F.col("source_id").alias("case_id"), F.col("id").alias("chunk_id"))


def build_next_chunk(chunks: DataFrame) -> DataFrame:
    """Edges between chunks that follow each other in a source; gaps in the index are bridged."""
    w = Window.partitionBy("source_id").orderBy("chunk_index", "id")
    return chunks.select("source_id", "chunk_index", "id").select(F.col("id").alias("from_chunk_id"), F.lead("id").over(w).alias("to_chunk_id")).where("to_chunk_id is not null")


def build_citations(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct citations, and distinct (case, citation) edges, from metadata."""
    pairs = chunks.select(F.col("source_id").alias("case_id"), _citations(chunks).alias("c")).distinct().select("case_id", F.explode("c").alias("citation_text"))
    pairs = pairs.distinct().withColumn("citation_id", short_hash("citation_", F.col("citation_text")))
    return pairs.select("citation_id", "citation_text").distinct(), pairs.select("case_id", "citation_id").distinct()


def entity_id(kind: Column, name: Column) -> Column:
    return short_hash("entity_", F.concat(kind, F.lit(":"), name))


def entity_candidates(chunks: DataFrame, pack: Pack = LEGAL) -> DataFrame:
    """(chunk_id, candidates): array<(type, name)> of each chunk, repeats included.

    Candidates are metadata names, pattern matches, and lexicon phrases that occur.
    """

    def made(kind: str, name: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), name.alias("name"))

    base = computed(chunks, F.col("id").alias("chunk_id"), st=safe_text(F.col("text")), case_name=safe_text(_meta(chunks, "case_name")), cited=_citations(chunks))
    parts = [F.array(made("CASE", F.col("case_name"))), F.transform("cited", partial(made, "CITATION"))]
    for kind, pattern in pack.patterns:
        matches = F.regexp_extract_all("st", F.lit(pattern), 0)
        if kind == "CASE" and "v" in pattern:  # the costly pattern only where its fixed part occurs
            matches = F.when(F.col("st").contains(" v. "), matches).otherwise(F.array().cast("array<string>"))
        parts.append(F.transform(matches, partial(made, kind)))
    if pack.lexicon:
        words = [F.when(F.contains(F.lower("st"), F.lit(phrase)), made(kind, F.lit(phrase))) for phrase, kind in pack.lexicon.items()]
        parts.append(F.array_compact(F.array(*words)))
    named = F.transform(F.concat(*parts), lambda x: F.struct(x["type"].alias("type"), entity_name(x["name"]).alias("name")))
    return computed(base, "chunk_id", candidates=F.filter(named, lambda x: is_entity(x["name"])))


def top_entities(candidates: Column, k: int = PER_CHUNK) -> Column:
    """array<(n, type, name)>: the k most frequent candidates of a chunk; ties by type and name.

    ``candidates`` is used once for each distinct one: hand in a column that is computed.
    """
    counted = F.transform(
        F.array_distinct(candidates), lambda d: F.struct((-F.size(F.filter(candidates, lambda x: x == d))).alias("n"), d["type"].alias("type"), d["name"].alias("name"))
    )
    return F.slice(F.array_sort(counted), 1, k)


def chunk_entities(chunks: DataFrame, pack: Pack = LEGAL, k: int = PER_CHUNK) -> DataFrame:
    """(chunk_id, entities): the kept entities of each chunk as array<(entity_id, type, name, tf)>, by entity_id."""
    full = F.transform(
        top_entities(F.col("candidates"), k),
        lambda x: F.struct(entity_id(x["type"], x["name"]).alias("entity_id"), x["type"].alias("type"), x["name"].alias("name"), (-x["n"]).alias("tf")),
    )
    return computed(entity_candidates(chunks, pack), "chunk_id", entities=F.array_sort(full))


def build_mentions(kept: DataFrame, weight: str = "chunks") -> DataFrame:
    """(chunk_id, entity_id, weight): 1, or with ``weight='tf'`` the matches in the chunk."""
    rows = kept.select("chunk_id", F.explode_outer("entities").alias("e")).where("e is not null")
    value = F.sum("e.tf") if weight == "tf" else F.count(F.lit(1))
    return rows.groupBy("chunk_id", F.col("e.entity_id").alias("entity_id")).agg(value.cast("long").alias("weight"))


def build_entities(kept: DataFrame) -> DataFrame:
    """Entities with the number of chunks that kept them."""
    rows = kept.select(F.explode_outer("entities").alias("e")).where("e is not null").select("e.entity_id", "e.name", "e.type")
    return rows.groupBy("entity_id").agg(F.min("name").alias("name"), F.min("type").alias("type"), F.count(F.lit(1)).alias("frequency"))


def build_related(kept: DataFrame) -> DataFrame:
    """Entity pairs of the same chunk, smaller id first, with the number of chunks; pairs are made inside the row."""
    ids = F.transform("entities", lambda e: e["entity_id"])
    pairs = F.flatten(F.transform(ids, lambda x, i: F.transform(F.slice(ids, i + 2, PER_CHUNK), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return (
        kept.select(F.explode_outer(pairs).alias("p"))
        .where("p is not null")
        .groupBy(F.col("p.a").alias("from_entity_id"), F.col("p.b").alias("to_entity_id"))
        .agg(F.count(F.lit(1)).alias("weight"))
        .select("from_entity_id", "to_entity_id", F.lit("CO_OCCURS_WITH").alias("relation_type"), "weight")
    )


def type_communities(entities: DataFrame) -> DataFrame:
    """A report of level 1 for each entity type: its most frequent names and ids."""
    w = Window.partitionBy("type").orderBy(F.desc("frequency"), "name", "entity_id")
    top = entities.withColumn("n", F.row_number().over(w)).where(F.col("n") <= LISTED)
    got = top.groupBy("type").agg(F.array_sort(F.collect_list(F.struct("n", "name", "entity_id"))).alias("e"))
    names = F.array_join(F.transform(F.slice("e", 1, NAMED), lambda x: x["name"]), "; ")
    return got.select(
        F.concat(F.lit("community_"), F.lower("type")).alias("community_id"), F.lit(1).alias("level"),
        safe_text(F.concat(F.col("type"), F.lit(" community: "), names)).alias("summary"), F.array_join(F.transform("e", lambda x: x["entity_id"]), ";").alias("entity_ids"),
    )


def topic_communities(entities: DataFrame, pack: Pack = LEGAL) -> DataFrame:
    """A report of level 2 for each topic: its terms with their frequencies (0 if absent), and the ids that were found.

    Where types share a name, the entity of the largest id counts.
    """
    spark = entities.sparkSession
    rows = [(t, title, note, n, term) for t, (title, terms, note) in pack.topics.items() for n, term in enumerate(terms)]
    terms = spark.createDataFrame(rows, "community_id string, title string, note string, n int, term string")
    known = entities.join(F.broadcast(terms.select("term").distinct()), F.col("name") == F.col("term"), "left_semi")
    known = known.groupBy("name").agg(F.max_by(F.struct("entity_id", "frequency"), "entity_id").alias("e"))
    joined = terms.join(known, F.col("term") == F.col("name"), "left")
    entry = F.struct("n", F.concat("term", F.lit(" (freq="), F.coalesce("e.frequency", F.lit(0)), F.lit(")")).alias("said"), F.col("e.entity_id").alias("id"))
    got = joined.groupBy("community_id", "title", "note").agg(F.array_sort(F.collect_list(entry)).alias("t"))
    said = F.array_join(F.transform("t", lambda x: x["said"]), "; ")
    ids = F.array_join(F.filter(F.transform("t", lambda x: x["id"]), lambda x: x.isNotNull()), ";")
    summary = F.concat("title", F.lit(". Salient extracted concepts: "), said, F.lit(". "), "note", F.lit(" Use this report for corpus-wide/global synthesis questions."))
    return got.select("community_id", F.lit(2).alias("level"), safe_text(summary).alias("summary"), ids.alias("entity_ids"))


def build_graph(chunks: DataFrame, pack: Pack = LEGAL) -> dict[str, DataFrame]:
    """All ten tables.

    Four of them come from the entities of chunks, which are kept in memory or on disk once worked out; an executor's loss
    brings them back from ``chunks``.
    """
    kept = chunk_entities(chunks, pack).persist(StorageLevel.MEMORY_AND_DISK)
    entities = build_entities(kept)
    citations, cites = build_citations(chunks)
    return {
        "legal_cases": build_cases(chunks, pack), "chunks": build_chunk_vertices(chunks), "citations": citations, "has_chunk": build_has_chunk(chunks),
        "next_chunk": build_next_chunk(chunks), "cites": cites, "entities": entities, "mentions": build_mentions(kept), "related_to": build_related(kept),
        "community_reports": type_communities(entities).unionByName(topic_communities(entities, pack)),
    }


def graph_report(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n_rows) of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = one if out is None else out.unionAll(one)
    return out
