"""Queries over the given tables, one or more for each operator, and the same in SQL.

``documents`` stand for opinions (id, case_name = source, citations = [lang, source]), ``benchmark`` for questions,
``conversations`` for answers (user turn = reference, next assistant turn = answer), ``labels`` for judgements and
``events`` for usage rows.  The prose pack replaces the legal one, whose patterns find nothing in these tables.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import adjacency, chunking, context, evaluate, graph, ingest, loads, postings, retrieval, vectors
from corpusloom.packs import FLAT_STOPWORDS, PROSE
from corpusloom.plans.graph_context import graph_context as graph_context_plan
from corpusloom.sources import io
from corpusloom.streaming.ingest import stream_chunks as stream_chunks_job
from corpusloom.streaming.ingest import stream_graph as stream_graph_job

_QUERIES: dict = {}


def _query(f):
    _QUERIES[f.__name__] = f
    return f


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _spread(df: DataFrame) -> DataFrame:
    """Rows of a table of few files dealt out to all cores; a table of many files stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _opinions(spark: SparkSession, d: str) -> DataFrame:
    docs = _spread(_read(spark, d, "documents")).where("doc_id is not null and text is not null")
    meta = F.struct(F.col("source").alias("case_name"), F.array("lang", "source").alias("citations"))
    return docs.select(F.col("doc_id").cast("string").alias("id"), F.col("doc_id").alias("record_index"), "text", meta.alias("metadata"))


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_corpus(_opinions(spark, d))


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "benchmark").where("item_id is not null").select(F.col("item_id").alias("q"), F.col("text").alias("question"))


def _graph(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return graph.build_graph(_chunks(spark, d), PROSE)


# --- sources, cleaning, sampling ---------------------------------------------------------------------------------


@_query
def clean_text_fast(spark, d):
    pages = _read(spark, d, "pages")
    return pages.select("page_id", tx.clean_text(F.coalesce("html", F.lit("")), fast=True).alias("text"))


@_query
def clean_text_parsed(spark, d):
    pages = _read(spark, d, "pages")
    return pages.select("page_id", tx.clean_text(F.coalesce("html", F.lit(""))).alias("text"))


@_query
def token_counts_by_mode(spark, d):
    docs = _read(spark, d, "documents")
    t = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", tx.token_count(t, "whitespace").cast("long").alias("n_ws"), tx.token_count(t).cast("long").alias("n_words_and_marks"))


@_query
def choose_text_field(spark, d):
    docs = _read(spark, d, "documents")
    nested = docs.select("doc_id", F.struct(F.struct("source", "lang").alias("meta"), F.struct("text", F.array(F.substring("text", 1, 700)).alias("notes")).alias("body")).alias("r"))
    fields = F.transform(ingest.string_fields(nested, "r"), lambda f: F.struct(f["path"].alias("path"), tx.collapse(f["value"]).alias("value")))
    best = ingest.choose_text_field(fields)
    return nested.select("doc_id", best.alias("b")).where("b is not null").select("doc_id", "b.path", F.length("b.text").alias("n_chars"))


@_query
def variant_fields(spark, d):
    """Strings of records of mixed shape, made of documents and their labels."""
    docs = _read(spark, d, "documents").select("doc_id", "text", "lang", "source")
    lines = F.slice(F.split("text", "\n"), 1, 30)
    record = F.struct(F.struct("lang", F.array("source", "lang").alias("tags"), F.col("doc_id").alias("n")).alias("meta"), F.transform(lines, lambda x: F.struct(x.alias("t"))).alias("body"), F.create_map(F.coalesce("source", F.lit("none")), "lang").alias("by"))
    r = docs.select("doc_id", F.parse_json(F.to_json(record)).alias("r"))
    fields = r.select("doc_id", ingest.string_fields(r, "r").alias("f"))
    told = F.concat_ws("|", F.transform("f", lambda x: F.concat(x["path"], F.lit("="), x["value"])))
    return fields.select("doc_id", F.size("f").alias("n_fields"), F.md5(told.cast("binary")).alias("digest"))


@_query
def sample_half(spark, d):
    """Half of the documents, by the hash of their ids."""
    docs = _opinions(spark, d)
    return ingest.sample_n(docs, docs.count() // 2, 7, by=F.md5(F.concat(F.col("id"), F.lit(":7")).cast("binary"))).select("id")


@_query
def take_until_tokens(spark, d):
    docs = _opinions(spark, d).withColumn("token_count", tx.token_count(F.col("text"), "whitespace"))
    return ingest.take_until_tokens(docs, "record_index", 200_000).select("record_index", F.col("token_count").cast("long").alias("token_count"))


@_query
def corpus_report(spark, d):
    docs = _opinions(spark, d).withColumn("token_count", tx.token_count(F.col("text"), "whitespace")).where("length(text) >= 500")
    return ingest.corpus_report(docs)


@_query
def sample_n(spark, d):
    docs = _opinions(spark, d)
    return ingest.sample_n(docs, 50, 42, by=F.md5(F.concat(F.col("id"), F.lit(":42")).cast("binary"))).select("id")


@_query
def safe_text(spark, d):
    return _read(spark, d, "documents").select("doc_id", F.md5(tx.safe_text(F.col("text")).cast("binary")).alias("digest"))


@_query
def compact_metadata(spark, d):
    docs = _read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("case_name"), F.col("lang").alias("court"), "text")
    return docs.select(ingest.compact_metadata(docs, F.when(F.length("text") >= 500, "text")).alias("m")).select("m.id", "m.case_name", "m.court", "m.selected_text_field")


@_query
def dedup_vertices(spark, d):
    return io.dedup_vertices(_read(spark, d, "documents").select("source", "lang", "doc_id"), "source", ["lang", "doc_id"])


def _folder(spark, name: str) -> str:
    return f"{io.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@_query
def jsonl_round_trip(spark, d):
    """Documents written as JSON lines and read again."""
    path = _folder(spark, "rows")
    io.write_rows(_read(spark, d, "documents").select("doc_id", "text", "lang"), path, "json")
    return io.read_jsonl(spark, path, "doc_id long, text string, lang string").select("doc_id", "lang", F.md5(F.col("text").cast("binary")).alias("digest"))


@_query
def questions_round_trip(spark, d):
    """Questions written as files of JSON lists and read again; every third one is without id.  A file has a bounded number."""
    items = _read(spark, d, "benchmark").where("item_id is not null")
    path, n = _folder(spark, "questions"), F.col("item_id") % 20 + 20 * F.floor(F.col("item_id") / 20_000)
    asked = items.select(n.alias("file"), F.struct(F.when(F.col("item_id") % 3 > 0, F.col("item_id").cast("string")).alias("id"), F.col("text").alias("question"), F.col("item_id").alias("n")).alias("q"))
    lists = asked.groupBy("file").agg(F.array_sort(F.collect_list("q"), lambda a, b: (a["n"] - b["n"]).cast("int")).alias("q"))
    lists.select(F.to_json("q")).write.option("maxRecordsPerFile", 1).text(path)
    return io.read_questions(spark, path).select("id", F.md5(F.col("question").cast("binary")).alias("digest"))


@_query
def report_round_trip(spark, d):
    path = _folder(spark, "report")
    io.write_report(corpus_report(spark, d), path)
    return spark.read.json(path).select("total_tokens", "written_records", "scanned_records", "skipped_records", "enough")


@_query
def graph_round_trip(spark, d):
    """The graph's tables written pipe-separated and read again: rows and characters of all string columns."""
    path, out = _folder(spark, "graph"), None
    io.write_graph(_graph(spark, d), path, "psv")
    for name, df in io.read_graph(spark, path, "psv").items():
        chars = sum((F.length(c) for c, t in df.dtypes if t == "string"), F.lit(0))
        one = df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(chars).cast("long").alias("n_chars")).select(F.lit(name).alias("table_name"), "n_rows", "n_chars")
        out = one if out is None else out.unionAll(one)
    return out


def _digests(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n_rows, digest): rows of each table, and a sum over all of their values."""
    out = None
    for name, df in tables.items():
        row = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in df.columns]).cast("binary"))
        one = df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(F.conv(F.substring(row, 1, 8), 16, 10).cast("long")), F.lit(0)).alias("digest"))
        one = one.select(F.lit(name).alias("table_name"), "n_rows", "digest")
        out = one if out is None else out.unionAll(one)
    return out


@_query
def graph_digests(spark, d):
    """The graph's tables written pipe-separated and read again: rows and all their values."""
    path = _folder(spark, "graph")
    io.write_graph(_graph(spark, d), path, "psv")
    return _digests(io.read_graph(spark, path, "psv"))


@_query
def graph_by_loads(spark, d):
    """The graph of two overlapping loads, each of them run twice."""
    path, docs = _folder(spark, "loads"), _opinions(spark, d)
    parts = [chunking.chunk_corpus(docs.where(f"record_index % 3 <> {n}")) for n in (0, 1)]
    for load in (0, 1, 0, 1):
        loads.load_graph(parts[load], path, load, PROSE)
    return _digests(loads.read_loads(spark, path, PROSE))


@_query
def graph_by_stream(spark, d):
    """The graph of a stream over files, one a batch."""
    folder = _folder(spark, "graph-stream")
    meta = "metadata struct<case_name: string, citations: array<string>>"
    _opinions(spark, d).select("id", "text", "metadata").repartition(3, "id").write.json(f"{folder}/in")
    stream_graph_job(spark, f"{folder}/in", f"{folder}/graph", f"{folder}/state", PROSE, f"id string, text string, {meta}", files=1).awaitTermination()
    return _digests(loads.read_loads(spark, f"{folder}/graph", PROSE))


# --- chunks and graph --------------------------------------------------------------------------------------------


@_query
def chunk_windows(spark, d):
    c = _chunks(spark, d)
    return c.select("id", "source_id", "chunk_index", "token_start", "token_end", "token_count")


@_query
def subword_windows(spark, d):
    """Windows of the tokens of a public vocabulary, which lies in the folder LOOM_TOKENIZERS."""
    path = os.path.join(os.environ.get("LOOM_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.json")
    c = chunking.chunk_corpus(_opinions(spark, d), tokens=tx.bpe_pieces(path)(F.col("text")), joint="")
    return c.select("id", "source_id", "chunk_index", "token_start", "token_end", "token_count")


@_query
def chunk_report(spark, d):
    return chunking.chunk_report(_opinions(spark, d), _chunks(spark, d))


@_query
def case_table(spark, d):
    return graph.build_cases(_chunks(spark, d), PROSE).select("case_id", "case_name", "citations", "court", "decision_date")


@_query
def chunk_vertices(spark, d):
    return graph.build_chunk_vertices(_chunks(spark, d)).select("chunk_id", "source_id", "chunk_index", "token_count", F.length("text").alias("n_chars"))


@_query
def has_chunk(spark, d):
    return graph.build_has_chunk(_chunks(spark, d))


@_query
def next_chunk(spark, d):
    return graph.build_next_chunk(_chunks(spark, d))


@_query
def citations(spark, d):
    return graph.build_citations(_chunks(spark, d))[0]


@_query
def cites(spark, d):
    return graph.build_citations(_chunks(spark, d))[1]


@_query
def entities(spark, d):
    return graph.build_entities(graph.chunk_entities(_chunks(spark, d), PROSE))


@_query
def mentions(spark, d):
    return graph.build_mentions(graph.chunk_entities(_chunks(spark, d), PROSE))


@_query
def related_to(spark, d):
    return graph.build_related(graph.chunk_entities(_chunks(spark, d), PROSE))


@_query
def type_communities(spark, d):
    return graph.type_communities(graph.build_entities(graph.chunk_entities(_chunks(spark, d), PROSE)))


@_query
def topic_communities(spark, d):
    return graph.topic_communities(graph.build_entities(graph.chunk_entities(_chunks(spark, d), PROSE)), PROSE)


@_query
def graph_report(spark, d):
    return graph.graph_report(_graph(spark, d))


# --- flat retrieval ----------------------------------------------------------------------------------------------


def _hay(chunks: DataFrame) -> DataFrame:
    return chunks.select("id", "text", F.concat_ws(" ", "text", "metadata.case_name", F.array_join("metadata.citations", " ")).alias("haystack"))


@_query
def hashed_embedding(spark, d):
    e = vectors.hashed_embedding(_chunks(spark, d), "id", "text")
    return e.groupBy("id").agg(F.count(F.lit(1)).alias("n_dims"), F.sum("w").alias("sum_w"), F.sum(F.col("idx") * F.col("w")).alias("check_sum"), F.round(F.max("norm"), 6).alias("norm"))


@_query
def built_index(spark, d):
    """The index as written and read again, with its manifest."""
    path = _folder(spark, "index")
    vectors.build_index(_chunks(spark, d), path)
    rows = spark.read.parquet(f"{path}/index").agg(F.count(F.lit(1)).alias("entries"), F.countDistinct("id").alias("vectors"), F.sum("w").alias("sum_w"), F.sum(F.col("idx") * F.col("w")).alias("check_sum"))
    return rows.crossJoin(F.broadcast(spark.read.json(f"{path}/manifest").select("provider", "dims", "chunks")))  # one row


@_query
def lexical_scores(spark, d):
    """Of all pairs of a question with a chunk: their number, and the sum and the best of their scores."""
    chunks, asked = _chunks(spark, d), _questions(spark, d)
    s = retrieval.lexical_scores(_hay(chunks), asked).groupBy("q").agg(F.sum(F.round("lexical", 9)).alias("total"), F.max("lexical").alias("best"))
    each = chunks.agg(F.count(F.lit(1))).scalar()  # pairs that score 0 add nothing but their number
    return asked.join(s, "q", "left").select("q", each.alias("n"), F.round(F.coalesce("total", F.lit(0.0)), 5).alias("total"), F.round(F.coalesce("best", F.lit(0.0)), 6).alias("best"))


@_query
def hybrid_topk(spark, d):
    hits = retrieval.hybrid_topk(_hay(_chunks(spark, d)), _questions(spark, d))
    return hits.select("q", "rank", "id", F.round("score", 6).alias("score"))


def _sparse(spark, d):
    return vectors.hashed_embedding(_chunks(spark, d), "id", "text"), vectors.hashed_embedding(_questions(spark, d), "q", "question")


@_query
def sparse_scores(spark, d):
    """Of the chunks that share a dimension with a question: their number, and the sum and the best of their scores."""
    s = vectors.sparse_scores(*_sparse(spark, d))
    return s.groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.round("score", 9)), 5).alias("total"), F.round(F.max("score"), 6).alias("best"))


@_query
def sparse_topk(spark, d):
    """The best chunks by sparse cosine, from stored postings."""
    path, asked = _folder(spark, "postings"), vectors.hashed_embedding(_questions(spark, d), "q", "question")
    vectors.hashed_rows(_chunks(spark, d), "id", "text").write.option("compression", "zstd").parquet(f"{path}/index")
    index = spark.read.parquet(f"{path}/index")
    postings.write_postings(index, f"{path}/blocks")
    return postings.sparse_topk(spark.read.parquet(f"{path}/blocks"), index, asked, 8).select("q", "rank", "id", F.round("score", 6).alias("score"))


@_query
def prompts(spark, d):
    chunks, asked = _chunks(spark, d), _questions(spark, d)
    hits = retrieval.hybrid_topk(_hay(chunks), asked)
    full = hits.select("q", "rank", "id", "score").join(chunks.select("id", "text", "metadata.case_name", "metadata.citations"), "id").join(asked, "q")
    return retrieval.build_prompt(full)


@_query
def l2_normalize(spark, d):
    e = _read(spark, d, "embeddings").select("vec_id", vectors.l2_normalize(F.col("embedding")).alias("v"))
    return e.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x), 6).alias("length"), F.round(F.col("v")[0], 6).alias("first"))


@_query
def dense_topk(spark, d):
    e = _read(spark, d, "embeddings")
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), "embedding")
    return vectors.dense_topk(e, asked, 5).select("q", "vec_id", "rank")


# --- graph retrieval ---------------------------------------------------------------------------------------------


def _prepared(spark, d):
    return retrieval.prepare_questions(_questions(spark, d), PROSE)


@_query
def route(spark, d):
    return _prepared(spark, d).select("q", "profile", "n_cases", "n_chunks", "wants_community")


@_query
def expand_phrases(spark, d):
    return _prepared(spark, d).select("q", F.size("terms").alias("n_terms"), F.array_join("phrases", ";").alias("phrases"))


@_query
def rank_cases(spark, d):
    g = _graph(spark, d)
    ranked = retrieval.rank_cases(_prepared(spark, d), retrieval.case_search_docs(g["legal_cases"], g["chunks"]), PROSE)
    return ranked.select("q", "case_id", "rank", F.round("score", 6).alias("score"))


@_query
def select_chunks(spark, d):
    g, asked = _graph(spark, d), _prepared(spark, d)
    ranked = retrieval.rank_cases(asked, retrieval.case_search_docs(g["legal_cases"], g["chunks"]), PROSE)
    return retrieval.select_chunks(asked, ranked, g["chunks"]).select("q", "case_id", "chunk_id", "place", "score")


@_query
def case_citations(spark, d):
    g = _graph(spark, d)
    return retrieval.case_citations(g["legal_cases"], g["cites"], g["citations"]).select("case_id", F.array_join("citations", ";").alias("citations"))


@_query
def case_context(spark, d):
    g = _graph(spark, d)
    return retrieval.case_context(g["legal_cases"], g["chunks"], g["cites"], g["citations"])


@_query
def entity_context(spark, d):
    g = _graph(spark, d)
    words = _read(spark, d, "documents").select(F.lower("lang").alias("keyword")).where("keyword is not null").distinct()
    return retrieval.entity_context(words, g["entities"], g["related_to"], g["mentions"])


@_query
def seed_entities(spark, d):
    return retrieval.seed_entities(_prepared(spark, d), _graph(spark, d)["entities"]).select("q", "entity_id", "seed_rank", F.round("score", 4).alias("score"))


def _stored_chunks(spark, d):
    """The chunks as written and read again, where more than one table is made of them: texts are cut once."""
    path = _folder(spark, "chunks")
    _chunks(spark, d).write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def _seeded(spark, d):
    """The graph, the questions and their seeds.  Entities are counted first, which keeps the entities of chunks once."""
    g, asked = graph.build_graph(_stored_chunks(spark, d), PROSE), _prepared(spark, d)
    g["entities"] = io.saved(g["entities"])
    return g, asked, io.saved(retrieval.seed_entities(asked, g["entities"]))


def _near(g, asked, seeds):
    return retrieval.direct_paths(asked, seeds, g["mentions"], g["chunks"], g["legal_cases"])


def _far(g, asked, seeds):
    return retrieval.related_paths(asked, seeds, g["related_to"], g["entities"], g["mentions"], g["chunks"], g["legal_cases"])


@_query
def direct_paths(spark, d):
    return _near(*_seeded(spark, d)).select("q", "seed_rank", "mention_rank", "chunk_id", "path", "flow", F.round("score", 4).alias("score"))


@_query
def related_paths(spark, d):
    return _far(*_seeded(spark, d)).select("q", "seed_rank", "edge_rank", "mention_rank", "chunk_id", "path", "flow", F.round("score", 4).alias("score"))


def _stored(spark, d):
    """The graph with its first mentions and edges as stored by entity."""
    g, asked, name = _graph(spark, d), _prepared(spark, d), f"loom_{uuid.uuid4().hex}"
    adjacency.write_adjacency(g["mentions"], g["related_to"], name, _folder(spark, "adjacency"))
    return g, asked, retrieval.seed_entities(asked, g["entities"]), *adjacency.read_adjacency(spark, name)


@_query
def stored_direct_paths(spark, d):
    g, asked, seeds, mentions, _ = _stored(spark, d)
    paths = retrieval.direct_paths(asked, seeds, mentions, g["chunks"], g["legal_cases"])
    return paths.select("q", "seed_rank", "mention_rank", "chunk_id", "path", "flow", F.round("score", 4).alias("score"))


@_query
def stored_related_paths(spark, d):
    g, asked, seeds, mentions, edges = _stored(spark, d)
    paths = retrieval.related_paths(asked, seeds, edges, g["entities"], mentions, g["chunks"], g["legal_cases"])
    return paths.select("q", "seed_rank", "edge_rank", "mention_rank", "chunk_id", "path", "flow", F.round("score", 4).alias("score"))


@_query
def prune_paths(spark, d):
    seeded = _seeded(spark, d)
    return context.prune_paths(_near(*seeded).unionByName(_far(*seeded))).drop("text", "block")


@_query
def select_communities(spark, d):
    return context.select_communities(_prepared(spark, d), _graph(spark, d)["community_reports"], PROSE).drop("block")


@_query
def graph_context(spark, d):
    done = graph_context_plan(_questions(spark, d), _graph(spark, d), PROSE)
    return done.select("q", "profile", "context", "n_blocks", "used_tokens", F.array_join("case_ids", ";").alias("case_ids"), F.array_join("chunk_ids", ";").alias("chunk_ids"))


# --- results -----------------------------------------------------------------------------------------------------


def _answers(spark, d):
    """Results and questions from conversations: a user turn and the assistant's next one; the turn's parity is the pipeline."""
    c = _read(spark, d, "conversations").where("conv_id is not null and turn is not null")
    one = c.groupBy("conv_id", "turn").agg(F.max("role").alias("role"), F.max("text").alias("text"))
    after = one.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("next_role"), F.col("text").alias("answer"))
    pairs = one.where("role = 'user'").join(after.where("next_role = 'assistant'"), ["conv_id", "turn"])
    rows = pairs.select(
        F.concat_ws("-", "conv_id", "turn").alias("question_id"), F.when(F.col("conv_id") % 2 == 0, "even").otherwise("odd").alias("pipeline"), F.col("text").alias("reference_answer"), "answer",
        F.length("text").alias("prompt_tokens"), F.length("answer").alias("completion_tokens"), (F.length("text") + F.length("answer")).alias("total_tokens"), F.col("turn").cast("double").alias("latency_ms"),
    )
    return rows.drop("reference_answer"), rows.select(F.col("question_id").alias("id"), "reference_answer")


@_query
def lexical_f1(spark, d):
    return evaluate.scored(*_answers(spark, d)).select("question_id", F.round("lexical_f1", 6).alias("lexical_f1"), "heuristic_pass")


@_query
def summarize(spark, d):
    s = evaluate.summarize(*_answers(spark, d))
    return s.select("pipeline", "questions", *[F.round(f"avg_{m}", 4).alias(f"avg_{m}") for m in evaluate.MEASURES], F.round("heuristic_pass_rate", 6).alias("heuristic_pass_rate"))


@_query
def compare_pipelines(spark, d):
    c = evaluate.compare_to(evaluate.summarize(*_answers(spark, d)), "odd", "even")
    return c.select(F.round("token_reduction_pct", 5).alias("token_reduction_pct"), F.round("latency_reduction_pct", 5).alias("latency_reduction_pct"))


@_query
def per_question(spark, d):
    rows = evaluate.per_question(*_answers(spark, d), ["even", "odd"])
    return rows.select("question_id", "even_total_tokens", "odd_total_tokens", F.coalesce("even_answer_preview", "odd_answer_preview").alias("preview"))


@_query
def coverage(spark, d):
    return evaluate.coverage(_answers(spark, d)[0].withColumn("field", F.nullif(F.col("latency_ms"), F.lit(0.0)).cast("long")), "field")


def _judged(spark, d):
    docs = _read(spark, d, "documents").groupBy("doc_id").agg(F.max("lang").alias("pipeline"), F.max("source").alias("type"))
    rows = _read(spark, d, "labels").join(docs, "doc_id").select("pipeline", F.col("doc_id").alias("question_id"), F.when(F.col("quality") == 1, "PASS").otherwise("FAIL").alias("verdict"), "toxic", "quality")
    return rows, docs.select(F.col("doc_id").alias("id"), "type")


@_query
def judge_summary(spark, d):
    return evaluate.judge_summary(_judged(spark, d)[0]).withColumn("pass_rate", F.round("pass_rate", 6))


@_query
def accuracy_table(spark, d):
    rows = _judged(spark, d)[0]
    scores = evaluate.score_summary(rows.where("pipeline <> 'es'").select("pipeline", F.col("quality").cast("double").alias("f1_raw"), (1 - F.col("toxic").cast("double")).alias("f1_rescaled")))
    table = evaluate.accuracy_table(evaluate.judge_summary(rows), scores)
    return evaluate.merge_accuracy(rows.select("pipeline").distinct(), table).select(
        "pipeline", "pass_count", F.round("pass_rate", 6).alias("pass_rate"), F.round("f1_raw", 6).alias("f1_raw"), F.round("f1_rescaled", 6).alias("f1_rescaled"), "raw_goal_met", "rescaled_goal_met"
    )


@_query
def breakdown(spark, d):
    return evaluate.breakdown(*_judged(spark, d)).withColumn("pass_rate", F.round("pass_rate", 6))


@_query
def compute_cost(spark, d):
    e = _read(spark, d, "events").select("event_id", F.col("event_type").alias("model"), F.round(F.col("value") * 100).cast("long").alias("prompt_tokens"), (F.col("event_id") % 97).alias("completion_tokens"))
    return evaluate.compute_cost(e, {"click": (0.1, 0.4), "view": (0.15, 0.6)}).select("event_id", "cost_usd")


@_query
def fill_usage(spark, d):
    rows, refs = _answers(spark, d)
    rows = rows.join(refs.withColumnRenamed("id", "question_id"), "question_id")
    rows = rows.withColumn("prompt_tokens", F.when(F.col("latency_ms") > 0, F.col("prompt_tokens"))).withColumn("completion_tokens", F.lit(0)).withColumn("total_tokens", F.lit(0))
    filled = evaluate.fill_usage(rows.withColumnRenamed("reference_answer", "question"))
    return filled.select("question_id", F.col("prompt_tokens").cast("long").alias("prompt_tokens"), F.col("total_tokens").cast("long").alias("total_tokens"))


@_query
def refusal_verdict(spark, d):
    c = _read(spark, d, "conversations")
    return c.select("conv_id", "turn", evaluate.refusal_verdict(F.col("text")).alias("verdict"), evaluate.parse_verdict(F.col("role"), F.col("text")).alias("parsed"))


@_query
def match_questions(spark, d):
    asked = _read(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("question"))
    live = _read(spark, d, "documents").select(F.col("lang").alias("pipeline"), "doc_id", F.explode(F.split("text", "\n")).alias("question"))
    live = live.unionByName(asked.select(F.lit("en").alias("pipeline"), (-F.col("id")).alias("doc_id"), F.concat(F.lit("  "), "question", F.lit(" ")).alias("question")))
    stored = asked.where("id % 2 = 0").select(F.lit("en").alias("pipeline"), F.col("id").alias("question_id"), F.lit("PASS").alias("verdict"))
    defaults = spark.createDataFrame([("en", None), ("fr", "PASS")], "pipeline string, default_verdict string")
    return evaluate.match_questions(live, asked, stored, defaults).groupBy("pipeline", "question_id", "verdict").agg(F.count(F.lit(1)).alias("n"))


@_query
def missing_questions(spark, d):
    docs = _read(spark, d, "documents").select(F.col("doc_id").alias("id"))
    return evaluate.missing(docs, _read(spark, d, "labels").select(F.col("doc_id").alias("question_id")))


@_query
def replace_rows(spark, d):
    rows = _read(spark, d, "labels").select(F.col("doc_id").alias("question_id"), F.col("quality").alias("v"))
    new = rows.withColumn("v", F.lit(9))
    return evaluate.replace_rows(rows, new, rows.where("question_id % 3 = 0").select("question_id"))


@_query
def stream_chunks(spark, d):
    folder = f"{io.shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    _opinions(spark, d).select("id", "text").write.json(f"{folder}/in")
    stream_chunks_job(spark, f"{folder}/in", f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("id", "source_id", "chunk_index", "token_start", "token_end", "token_count")


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from corpusloom import oracle

    return oracle.oracle_sql()
