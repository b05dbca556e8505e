"""Retrieval for tables of questions: flat (vectors and words) and over the graph.

Questions are a query set that is put against all rows, in blocks.  What follows from them joins by key, and Spark chooses
by size how.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import computed, hits, or_empty, query_terms, score_text
from corpusloom.operators import vectors
from corpusloom.operators.best import KEPT_WORDS, Needles, best_rows
from corpusloom.operators.case_search import case_search_docs, rank_cases  # noqa: F401
from corpusloom.operators.needles import Automaton, Weights, containing
from corpusloom.packs import FLAT_STOPWORDS, LEGAL, Pack
from corpusloom.sources.io import saved

#: Hits of a question, weight of the lexical score, limits of graph retrieval.
TOP_K, ALPHA = 8, 0.35
TOP_CASES, CHUNKS_PER_CASE, MAX_TOKENS = 2, 5, 2200
GLOBAL_CASES, MULTI_HOP_CASES = 8, 5
#: Seeds of a question, mentions and edges of a seed, mentions of a related entity, the hop's share.
SEEDS, DIRECT, EDGES, PER_EDGE, HOP = 5, 12, 12, 8, 0.9
#: Slots of the set of hashed keys that goes to the tasks, whatever the number of keys.
SLOTS = 1 << 20
_RUNS = re.compile(r"[a-z0-9_]+")
_TOKEN = re.compile(r"[a-z][a-z0-9_]+")


def lexical_scores(chunks: DataFrame, questions: DataFrame, stopwords: tuple[str, ...] = FLAT_STOPWORDS) -> DataFrame:
    """(q, id, lexical): share of a question's terms that occur in a chunk's text, case name or citations, where any does.

    ``chunks`` has id and haystack; ``questions`` has q and question.  A term that occurs lies inside a word, so terms are
    looked up in an index of the distinct words, and words lead to chunks.  All other pairs score 0 and are not made: null
    and empty haystacks, null questions and questions without terms have none.  Rows of one id count as one chunk.
    """
    terms = computed(questions, "q", terms=query_terms(F.col("question"), stopwords)).where(F.size("terms") > 0)
    asked = terms.select("q", F.size("terms").alias("size"), F.explode("terms").alias("term")).groupBy("q", "size", "term").agg(F.count(F.lit(1)).alias("times"))
    runs = F.array_distinct(F.regexp_extract_all(F.lower(or_empty(F.col("haystack"))), F.lit(_RUNS.pattern), 0))
    words = chunks.select("id", F.explode(runs).alias("word"))
    known = containing(words.select(F.col("word").alias("text")), asked.select(F.col("term").alias("needle")))
    held = words.join(known.select(F.col("text").alias("word"), F.col("needle").alias("term")), "word").select("id", "term").distinct()
    found = held.join(asked, "term").groupBy("q", "id", "size").agg(F.sum("times").alias("found"))
    return found.select("q", "id", (F.col("found") / F.col("size")).alias("lexical"))


def hybrid_topk(chunks: DataFrame, questions: DataFrame, k: int = TOP_K, alpha: float = ALPHA, hashing: str = "md5", stopwords: tuple[str, ...] = FLAT_STOPWORDS) -> DataFrame:
    """(q, id, score, rank): dense plus weighted lexical score, the best k; ties by id.

    ``chunks`` has id, text and haystack; ``questions``, a query set, has q and question.  Both scores are made in one pass
    over the chunks, which are not shuffled; null texts have no tokens.  Texts are not carried: join them to the hits.
    """

    def scorer(block: list):
        slot, known = vectors.slot_of(hashing), {}
        needles = Needles([t for r in block for t in r["terms"]])
        shares = needles.weights([r["terms"] for r in block]) / np.maximum(1, [len(r["terms"]) for r in block])

        def counts(texts: list[list[str]]) -> np.ndarray:
            out = np.zeros((len(texts), vectors.DIMS))
            for row, tokens in zip(out, texts, strict=True):
                for t, n in Counter(tokens).items():
                    if (s := known.get(t)) is None:
                        if len(known) >= KEPT_WORDS:
                            known.clear()
                        s = known[t] = slot(t)
                    row[s[0]] += n * s[1]
            return out

        def norms(m: np.ndarray) -> np.ndarray:
            return np.sqrt((m * m).sum(1))

        asked = counts([_TOKEN.findall(r["low"]) for r in block])
        own = np.maximum(norms(asked), 1e-300)

        def score(columns: dict[str, list]) -> np.ndarray:
            held = counts([_TOKEN.findall(t) for t in columns["text"]])
            dense = (held @ asked.T) / np.maximum(np.outer(norms(held), own), 1e-300)
            return np.round(dense + alpha * (needles.present([_RUNS.findall(t) for t in columns["haystack"]]) @ shares), 9)

        return score

    low = lambda c: F.lower(or_empty(F.col(c)))
    asked = questions.select("q", low("question").alias("low"), query_terms(F.col("question"), stopwords).alias("terms"))
    asked = asked.withColumn("terms", F.coalesce("terms", F.array().cast("array<string>")))
    return best_rows(chunks.select("id", low("text").alias("text"), low("haystack").alias("haystack")), asked, "id", scorer, k)


def top(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group; tasks keep k before the rows are dealt."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def build_prompt(hit: DataFrame) -> DataFrame:
    """(q, prompt): header and text of each hit in order of rank, and the question.

    ``hit`` has q, question, rank, score, case_name, citations (array) and text.
    """
    block = F.format_string(
        "[Chunk %d | score=%.4f | case=%s | citations=%s]\n%s", "rank", "score", F.coalesce("case_name", F.lit("unknown case")), F.array_join(F.coalesce("citations", F.array().cast("array<string>")), ", "), "text"
    )
    rows = hit.groupBy("q", "question").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))).alias("blocks"))
    return rows.select("q", F.concat(F.lit("Context:\n"), F.array_join(F.transform("blocks", lambda x: x["b"]), "\n\n"), F.lit("\n\nQuestion: "), "question").alias("prompt"))


# --- questions ---------------------------------------------------------------------------------------------------


def route(question: Column, label: Column | None = None, pack: Pack = LEGAL) -> Column:
    """local, global or multi_hop: a known label wins, then the markers."""
    terms = query_terms(question, pack.stopwords)
    low = F.lower(question)
    words = lambda m: F.arrays_overlap(terms, F.array(*map(F.lit, m)))
    by_text = (
        F.when(words(pack.multi_hop_markers) | low.contains("how do") | low.contains("how did"), "multi_hop")
        .when(words(pack.global_markers), "global")
        .otherwise("local")
    )
    if label is None:
        return by_text
    return F.when(label == "local_factual", "local").when(label == "global_synthesis", "global").when(label == "multi_hop", "multi_hop").otherwise(by_text)


def route_limits(profile: Column, top_cases: int = TOP_CASES, chunks: int = CHUNKS_PER_CASE) -> tuple[Column, Column]:
    """Cases of a question and chunks of a case, by route."""
    cases = F.when(profile == "global", max(top_cases, GLOBAL_CASES)).when(profile == "multi_hop", max(top_cases, MULTI_HOP_CASES)).otherwise(top_cases)
    return cases, F.when(profile == "global", 2).when(profile == "multi_hop", min(max(chunks, 4), 5)).otherwise(chunks)


def needs_community(question: Column, pack: Pack = LEGAL) -> Column:
    return hits(F.lower(question), F.array(*map(F.lit, pack.community_markers))) > 0


def expand_phrases(question: Column, pack: Pack = LEGAL, strict: bool = False) -> Column:
    """Phrases of the aliases that a question triggers and the citations in it, distinct, in order.

    A trigger fires if it, or any word of it, is part of the question; with ``strict`` only the whole trigger counts.
    """
    low = F.lower(question)
    none = F.array().cast("array<string>")
    parts = []
    for trigger, phrases in pack.aliases.items():
        fired = low.contains(trigger)
        for word in () if strict else trigger.split():
            fired = fired | low.contains(word)
        parts.append(F.when(fired, F.array(*map(F.lit, phrases))).otherwise(none))
    cited = F.transform(F.regexp_extract_all(question, F.lit(pack.citation_in_question), 0), F.lower)
    return F.array_distinct(F.concat(*parts, cited))


def prepare_questions(questions: DataFrame, pack: Pack = LEGAL, top_cases: int = TOP_CASES, chunks: int = CHUNKS_PER_CASE) -> DataFrame:
    """Questions (q, question and perhaps type) with what retrieval asks of them."""
    label = F.col("type") if "type" in questions.columns else None
    q = F.coalesce("question", F.lit(""))
    base = questions.select(
        "q", q.alias("question"), route(q, label, pack).alias("profile"), route(q, None, pack).alias("text_profile"), query_terms(q, pack.stopwords).alias("terms"),
        expand_phrases(q, pack).alias("phrases"), F.transform(F.regexp_extract_all(q, F.lit(pack.name_in_question), 0), F.lower).alias("names"), needs_community(q, pack).alias("wants_community"),
    )
    n_cases, n_chunks = route_limits(F.col("profile"), top_cases, chunks)
    return base.withColumn("n_cases", n_cases).withColumn("n_chunks", n_chunks)


def _asked(text: Column, weight: float = 1.0) -> Column:
    return score_text(text, F.col("terms"), F.col("phrases"), F.col("names"), weight)


# --- cases and chunks --------------------------------------------------------------------------------------------


def select_chunks(prepared: DataFrame, ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """(q, case_id, case_rank, chunk_id, chunk_index, token_count, text, score, place) of the chosen chunks of ranked cases.

    For questions that read as local the first chunk comes first; then chunks that score, by score; then the others by
    index, up to the limit.  The limit holds always.
    """
    pairs = ranked.select("q", "case_id", F.col("rank").alias("case_rank")).join(prepared, "q")
    rows = chunks.join(pairs, chunks["source_id"] == pairs["case_id"])
    scored = rows.withColumn("score", _asked(F.col("text")))
    in_case = Window.partitionBy("q", "case_id")
    first = F.row_number().over(in_case.orderBy("chunk_index", "chunk_id")) == 1
    scored = scored.withColumn("kind", F.when(first & (F.col("text_profile") == "local"), 0).when(F.col("score") > 0, 1).otherwise(2))
    order = in_case.orderBy("kind", F.when(F.col("kind") == 1, -F.col("score")).otherwise(0.0), "chunk_index", "chunk_id")
    chosen = scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= F.col("n_chunks"))
    return chosen.select("q", "case_id", "case_rank", "chunk_id", "chunk_index", "token_count", "text", "score", "place")


def case_citations(cases: DataFrame, cites: DataFrame, citations: DataFrame) -> DataFrame:
    """(case_id, citations): texts of a case's citations, the id where the text is unknown, in order of id."""
    known = cites.join(citations, "citation_id", "left").select("case_id", F.struct("citation_id", F.coalesce("citation_text", "citation_id").alias("text")).alias("c"))
    got = known.groupBy("case_id").agg(F.array_sort(F.collect_set("c")).alias("c"))
    return cases.select("case_id").join(got, "case_id", "left").select("case_id", F.coalesce(F.transform("c", lambda x: x["text"]), F.array().cast("array<string>")).alias("citations"))


def case_context(case_ids: DataFrame, chunks: DataFrame, cites: DataFrame, citations: DataFrame, n: int = 8) -> DataFrame:
    """(case_id, role, id, place): the first n chunks of the given cases, and their citations."""
    wanted = case_ids.select("case_id").distinct()
    near = chunks.select(F.col("source_id").alias("case_id"), "chunk_index", F.col("chunk_id").alias("id")).join(wanted, "case_id", "left_semi")
    first = top(near, ["case_id"], [F.col("chunk_index"), F.col("id")], n, "place").select("case_id", F.lit("chunk").alias("role"), "id", "place")
    known = cites.join(wanted, "case_id", "left_semi").join(citations, "citation_id").select("case_id", F.col("citation_id").alias("id"))
    w = Window.partitionBy("case_id").orderBy("id")
    return first.unionByName(known.select("case_id", F.lit("citation").alias("role"), "id", F.row_number().over(w).alias("place")))


# --- entities and paths ------------------------------------------------------------------------------------------


def entity_context(keywords: DataFrame, entities: DataFrame, related: DataFrame, mentions: DataFrame, e: int = 5, c: int = 8) -> DataFrame:
    """(keyword, role, id): entities whose name contains a keyword, those they relate to, and chunks that mention either.

    At most ``e`` entities and ``e`` related ones, and ``c`` chunks for each of the two, by id.  Case counts.  Names are
    found through an index of their grams.  Null names and keywords match nothing; the empty keyword matches every name.
    """
    known = containing(entities.select(F.col("name").alias("text")), keywords.select(F.col("keyword").alias("needle")))
    found = entities.select("entity_id", "name").join(known.select(F.col("text").alias("name"), F.col("needle").alias("keyword")), "name")
    seed = top(found, ["keyword"], [F.col("entity_id")], e).select("keyword", F.col("entity_id").alias("id"))
    near = related.join(seed, related["from_entity_id"] == seed["id"]).select("keyword", F.col("to_entity_id").alias("id")).distinct()
    near = top(near, ["keyword"], [F.col("id")], e).select("keyword", "id")

    def told(of: DataFrame) -> DataFrame:
        rows = mentions.join(of, mentions["entity_id"] == of["id"]).select("keyword", F.col("chunk_id").alias("id")).distinct()
        return top(rows, ["keyword"], [F.col("id")], c).select("keyword", "id")

    parts = {"entity": seed, "related_entity": near, "chunk": told(seed), "related_chunk": told(near)}
    out = None
    for role, df in parts.items():
        one = df.select("keyword", F.lit(role).alias("role"), "id")
        out = one if out is None else out.unionByName(one)
    return out


def seed_entities(prepared: DataFrame, entities: DataFrame, k: int = SEEDS) -> DataFrame:
    """(q, entity_id, name, type, score, seed_rank): entities of a question; ties by entity_id.

    One automaton for all terms, phrases and names of a block of questions reads each entity's name once; tasks keep k
    entities a question.  A null name matches nothing, a null or zero frequency counts as 1, null ids are left out; frequent
    entities come also where nothing matches.
    """

    def scorer(block: list):
        needles = Automaton(n for r in block for n in (*r["terms"], *r["phrases"], *r["names"]))
        worth = (("terms", 1.0), ("phrases", 2.5), ("names", 8.0))
        weights = Weights(len(needles.at), len(block), [(needles.at[n], column, w) for column, r in enumerate(block) for of, w in worth for n in r[of]])

        def score(columns: dict[str, list]) -> np.ndarray:
            found = [needles.found(t) for t in columns["low"]]
            text = np.repeat(np.arange(len(found)), [len(f) for f in found])
            hundredths = weights.sums(len(found), text, np.array([n for f in found for n in f], dtype=np.int64)) * 200.0
            return np.round(hundredths * np.array(columns["factor"])[:, None] + np.array(columns["base"])[:, None], 4)

        return score

    frequency = F.coalesce("frequency", F.lit(0))
    base = 2.0 * F.least(F.when(frequency == 0, 1).otherwise(frequency), F.lit(20))
    factor = F.when(F.col("type").isin("CASE", "LAW", "CONCEPT"), 1.25).otherwise(1.0)
    rows = entities.select("entity_id", F.lower(or_empty(F.col("name"))).alias("low"), factor.alias("factor"), base.alias("base"))
    best = best_rows(rows, prepared.select("q", "terms", "phrases", "names"), "entity_id", scorer, k, 10.0)
    told = entities.select("entity_id", "name", "type").join(best, "entity_id")
    return told.select("q", "entity_id", "name", "type", (F.col("score") / 100).alias("score"), F.col("rank").alias("seed_rank"))


def _finish(paths: DataFrame, prepared: DataFrame, chunks: DataFrame, cases: DataFrame, penalty: float) -> DataFrame:
    """Adds chunk, case and score to paths (q, ..., path, flow, chunk_id); paths without their chunk fall away.

    Paths are kept, since they tell first which chunks are dealt out at all, and then join them.
    """
    paths = saved(paths)
    named = _perhaps(chunks.select("chunk_id", "source_id", "chunk_index", "token_count", "text"), "chunk_id", paths)
    held = paths.join(named, "chunk_id")
    held = held.join(cases.select("case_id", "case_name"), held["source_id"] == F.col("case_id"), "left")
    held = held.join(prepared.select("q", "terms", "phrases", "names"), "q")
    name = F.coalesce("case_name", "source_id")
    path = F.concat("path", F.lit(" -> "), "chunk_id", F.lit(" -> "), name)
    score = F.round(_asked(F.concat(path, F.lit(" "), F.col("text"))) * F.col("flow") * F.lit(penalty), 6)
    return held.select(
        "q", "seed_rank", "kind", "edge_rank", "mention_rank", path.alias("path"), "chunk_id", F.col("source_id").alias("case_id"), name.alias("case_name"), "chunk_index",
        "token_count", "text", "flow", F.lit(round(penalty, 6)).alias("hop_penalty"), score.alias("score"),
    )


def _perhaps(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows whose key is wanted, and a few others: slots of hashed keys are broadcast, so rows stay where they are."""
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(SLOTS)).cast("int")
    slots = wanted.select(slot(key).alias("loom_slot")).distinct()
    return rows.join(F.broadcast(slots), slot(key) == F.col("loom_slot"), "left_semi")


def _first_of(rows: DataFrame, wanted: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each wanted entity_id, found once for an entity however many questions ask for it."""
    held = rows.join(wanted.select("entity_id").distinct(), "entity_id", "left_semi")
    return top(held, ["entity_id"], order, k, "loom_n").drop("loom_n")


def direct_paths(prepared: DataFrame, seeds: DataFrame, mentions: DataFrame, chunks: DataFrame, cases: DataFrame) -> DataFrame:
    """Paths seed -> chunk -> case over the first mentions of each seed; null ids lead nowhere.

    ``mentions`` may be the stored first ones (:mod:`corpusloom.operators.adjacency`), which are not dealt out again.
    """
    if "mention_rank" in mentions.columns:
        at = mentions.join(seeds, "entity_id").where(F.col("mention_rank") <= DIRECT)
    else:
        seeds = saved(seeds)
        at = _first_of(mentions, seeds, [F.col("chunk_id")], DIRECT).join(seeds, "entity_id")
        at = top(at, ["q", "entity_id"], [F.col("chunk_id")], DIRECT, "mention_rank")
    paths = at.select("q", "seed_rank", F.lit(0).alias("kind"), F.lit(0).alias("edge_rank"), "mention_rank", F.col("name").alias("path"), F.greatest(F.lit(1), "weight").cast("long").alias("flow"), "chunk_id")
    return _finish(paths, prepared, chunks, cases, HOP**2)


def related_paths(prepared: DataFrame, seeds: DataFrame, related: DataFrame, entities: DataFrame, mentions: DataFrame, chunks: DataFrame, cases: DataFrame, edge_order: str = "file") -> DataFrame:
    """Paths seed -> related entity -> chunk -> case; edges are read both ways, the first ones of each seed.

    Edges come by (from, to), or with ``edge_order='weight'`` by weight.  ``related`` and ``mentions`` may be the stored
    first ones (:mod:`corpusloom.operators.adjacency`), whose edges come in the order in which they were stored.
    """
    ends = saved(seeds.select("q", "seed_rank", "entity_id", F.col("name").alias("seed_name")))
    if "edge_rank" in related.columns:
        edges = related.join(ends, "entity_id").where(F.col("edge_rank") <= EDGES)
    else:
        edges = _edges_at(ends, related, edge_order)
    edges = edges.select("q", "seed_rank", "seed_name", "edge_rank", "other", F.col("weight").alias("edge_weight"))
    if "mention_rank" in mentions.columns:
        held = mentions.where(F.col("mention_rank") <= PER_EDGE).join(edges.withColumnRenamed("other", "entity_id"), "entity_id").withColumn("other", F.col("entity_id"))
    else:
        edges = saved(edges)
        first = _first_of(mentions, edges.select(F.col("other").alias("entity_id")), [F.col("chunk_id")], PER_EDGE)
        held = first.withColumnRenamed("entity_id", "other").join(edges, "other")
        held = top(held, ["q", "seed_rank", "edge_rank"], [F.col("chunk_id")], PER_EDGE, "mention_rank")
    held = held.join(entities.select(F.col("entity_id").alias("other"), F.col("name").alias("other_name")), "other")
    flow = F.greatest(F.lit(1), F.least("edge_weight", "weight")).cast("long")
    paths = held.select("q", "seed_rank", F.lit(1).alias("kind"), "edge_rank", "mention_rank", F.concat("seed_name", F.lit(" -> "), "other_name").alias("path"), flow.alias("flow"), "chunk_id")
    return _finish(paths, prepared, chunks, cases, HOP**3)


def _edges_at(ends: DataFrame, related: DataFrame, edge_order: str) -> DataFrame:
    """The first edges of each seed, with the entity at the other end."""
    end = lambda own, other: F.struct(F.col(own).alias("entity_id"), F.col(other).alias("other"))
    ways = F.explode(F.array(end("from_entity_id", "to_entity_id"), end("to_entity_id", "from_entity_id")))
    both = related.select("from_entity_id", "to_entity_id", "weight", ways.alias("e")).select("e.*", "from_entity_id", "to_entity_id", "weight")
    order = [F.col("from_entity_id"), F.col("to_entity_id")]
    order = [F.desc("weight"), *order] if edge_order == "weight" else order
    return top(_first_of(both, ends, order, EDGES).join(ends, "entity_id"), ["q", "entity_id"], order, EDGES, "edge_rank")
