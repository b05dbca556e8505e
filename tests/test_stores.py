"""Stored postings, adjacency and loads of a graph against what they replace."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import adjacency, chunking, context, graph, loads, postings, retrieval, vectors
from corpusloom.packs import LEGAL
from corpusloom.sources import io
from corpusloom.streaming.ingest import stream_graph


@pytest.fixture(scope="module")
def sparse(spark):
    """Vectors with some dimensions that most of them have, with signs, and a few odd ones."""
    rng = random.Random(12)
    rows = []
    for k in range(1500):
        dims = {0, 1} | {min(200, int(rng.paretovariate(0.7))) for _ in range(rng.randrange(1, 9))}
        w = {d: rng.choice([1, 1, 2, 5, -1]) for d in dims if d > 1 or rng.random() < 0.8}
        norm = sum(x * x for x in w.values()) ** 0.5
        rows += [(f"v{k:04}", d, x, norm) for d, x in w.items()]
    rows += [(None, 3, 1, 1.0), ("zero", 3, 0, 0.0)]
    index = spark.createDataFrame(rows, "id string, idx int, w long, norm double").repartition(6)
    asked = [(q, d, w, norm) for q in range(25) for own in [{rng.randrange(2, 30): rng.choice([4, 9]), rng.randrange(30, 200): 3, 0: 1, 1: -1}] for norm in [sum(x * x for x in own.values()) ** 0.5] for d, w in own.items()]
    asked += [(99, 5000, 1, 1.0), (None, 3, 1, 1.0)]
    return index, spark.createDataFrame(asked, "q int, idx int, w long, norm double")


@pytest.mark.parametrize("block, k", [(8, 5), (64, 1), (4096, 40)])
def test_postings_give_the_best_of_all_rows(spark, sparse, tmp_path, block, k):
    index, asked = sparse
    postings.write_postings(index, f"{tmp_path}/b", block)
    blocks = spark.read.parquet(f"{tmp_path}/b")
    assert blocks.agg(F.max(F.size("ids"))).first()[0] <= block
    assert blocks.agg(F.sum(F.size("ids"))).first()[0] == index.where("id is not null and norm > 0").count()
    got = postings.sparse_topk(blocks, index, asked, k).collect()
    full = vectors.sparse_scores(index.where("id is not null and norm > 0"), asked.where("q is not null")).collect()
    want = []
    for q in {r["q"] for r in full}:
        best = sorted((-round(r["score"], 9), r["id"]) for r in full if r["q"] == q and round(r["score"], 9) > 0)[:k]
        want += [(q, i, n) for n, (_, i) in enumerate(best, 1)]
    assert sorted((r["q"], r["id"], r["rank"]) for r in got) == sorted(want)
    if block == 8:  # most blocks stay unread
        told = {r["q"]: (r["n_blocks"], r["n_read"]) for r in got}
        assert sum(n for _, n in told.values()) < 0.5 * sum(n for n, _ in told.values())
    assert postings.sparse_topk(blocks, index, asked.limit(0), k).count() == 0
    postings.write_postings(index.limit(0), f"{tmp_path}/none")
    assert postings.sparse_topk(spark.read.parquet(f"{tmp_path}/none"), index.limit(0), asked, k).count() == 0


@pytest.fixture(scope="module")
def legal(spark):
    meta = "struct<case_name:string,citations:array<string>>"
    words = ["waiver", "habeas corpus", "Miranda", "contract", "de novo", "jurisdiction", "double jeopardy", 'a "quoted" \\ path']
    rng = random.Random(5)
    rows = [(f"s{k}", " ".join(rng.choice(words) + "." for _ in range(rng.choice([3, 30, 900]))), (f"State v. Roe{k % 4}", [f"{k} OK CR 5", ""])) for k in range(30)]
    return spark.createDataFrame(rows, f"id string, text string, metadata {meta}")


def test_stored_adjacency_gives_the_same_paths(spark, legal, tmp_path):
    g = graph.build_graph(chunking.chunk_corpus(legal))
    asked = retrieval.prepare_questions(spark.createDataFrame([(1, "waiver of jurisdiction and contract"), (2, "habeas corpus miranda"), (3, "")], "q int, question string"))
    seeds = retrieval.seed_entities(asked, g["entities"])
    adjacency.write_adjacency(g["mentions"], g["related_to"], "test_adjacency", str(tmp_path / "a"), buckets=4)
    mentions, edges = adjacency.read_adjacency(spark, "test_adjacency")
    try:
        rows = lambda df: sorted(map(repr, df.collect()))
        near = retrieval.direct_paths(asked, seeds, mentions, g["chunks"], g["legal_cases"])
        assert rows(near) == rows(retrieval.direct_paths(asked, seeds, g["mentions"], g["chunks"], g["legal_cases"])) and near.count() > 5
        far = retrieval.related_paths(asked, seeds, edges, g["entities"], mentions, g["chunks"], g["legal_cases"])
        assert rows(far) == rows(retrieval.related_paths(asked, seeds, g["related_to"], g["entities"], g["mentions"], g["chunks"], g["legal_cases"])) and far.count() > 5
        # a large side by entity is dealt to the buckets; the stored table is not
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = mentions.join(seeds, "entity_id")._jdf.queryExecution().sparkPlan().toString()
        done = mentions.join(seeds.repartition(7), "entity_id")
        done.count()
        plan = done._jdf.queryExecution().executedPlan().toString()
        scan = plan.index("Bucketed: true")
        assert "SelectedBucketsCount: 4 out of 4" in plan[scan : scan + 3000]
        side = plan[: plan.index("FileScan parquet spark_catalog.default.test_adjacency_mentions")].splitlines()[-4:]
        assert not any("Exchange" in line for line in side)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for part in ("mentions", "edges"):
            spark.sql(f"DROP TABLE IF EXISTS test_adjacency_{part}")


def test_a_hub_of_a_million_mentions(spark, tmp_path):
    """Only its first mentions are stored and read."""
    mentions = spark.range(1_000_000).select(F.format_string("c%07d", "id").alias("chunk_id"), F.lit("hub").alias("entity_id"), F.lit(1).cast("long").alias("weight"))
    related = spark.range(200_000).select(F.lit("hub").alias("from_entity_id"), F.format_string("x%06d", "id").alias("to_entity_id"), F.lit("CO_OCCURS_WITH").alias("relation_type"), F.col("id").alias("weight"))
    adjacency.write_adjacency(mentions, related, "test_hub", str(tmp_path / "h"), buckets=4, edge_order="weight")
    try:
        near, edges = adjacency.read_adjacency(spark, "test_hub")
        assert sorted(r["chunk_id"] for r in near.collect()) == [f"c{k:07}" for k in range(12)]
        hub = sorted((r["edge_rank"], r["other"]) for r in edges.where("entity_id = 'hub'").collect())
        assert hub == [(k + 1, f"x{199_999 - k:06}") for k in range(12)]
        assert edges.count() == 200_012  # the other ends have one edge each
    finally:
        for part in ("mentions", "edges"):
            spark.sql(f"DROP TABLE IF EXISTS test_hub_{part}")


def rows_of(tables):
    return {name: sorted(map(repr, df.select(*sorted(df.columns)).collect())) for name, df in tables.items()}


def test_loads_add_up_to_one_graph(spark, legal, tmp_path, monkeypatch):
    """Overlapping loads, run again, also after an end between two writes."""
    cut = lambda text: chunking.chunk_corpus(legal.where(text))
    want = rows_of(graph.build_graph(chunking.chunk_corpus(legal)))
    folder = str(tmp_path / "g")
    loads.load_graph(cut("id < 's2'"), folder, 0)
    stop = graph.build_mentions
    monkeypatch.setattr(graph, "build_mentions", lambda kept: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        loads.load_graph(cut("id >= 's15'"), folder, 1)
    monkeypatch.setattr(graph, "build_mentions", stop)
    real = loads.graph.build_graph
    assert real is graph.build_graph
    for load, text in ((1, "id >= 's15'"), (0, "id < 's2'"), (1, "id >= 's15'"), (2, "id is not null")):
        loads.load_graph(cut(text).unionByName(cut(text).limit(3)), folder, load)
    assert rows_of(loads.read_loads(spark, folder)) == want
    again = loads.read_loads(spark, str(tmp_path / "none"))
    assert {name: df.count() for name, df in again.items()} == {name: len(LEGAL.topics) if name == "community_reports" else 0 for name in want}
    loads.load_graph(cut("false"), folder, 3)
    assert rows_of(loads.read_loads(spark, folder)) == want


def test_streamed_graph_after_a_restart(spark, legal, tmp_path, monkeypatch):
    """Three files, the second batch breaks between two tables, and the stream is started again."""
    for k in range(3):
        legal.where(F.pmod(F.crc32("id"), F.lit(3)) == k).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    legal.limit(4).coalesce(1).write.mode("append").json(f"{tmp_path}/in")  # rows that come again
    schema = "id string, text string, metadata struct<case_name: string, citations: array<string>>"
    start = lambda: stream_graph(spark, f"{tmp_path}/in", f"{tmp_path}/g", f"{tmp_path}/state", schema=schema, files=1)
    calls, real = [], graph.build_related
    monkeypatch.setattr(graph, "build_related", lambda kept: calls.append(1) or (real(kept) if len(calls) != 2 else kept.select(F.raise_error(F.lit("lost")).alias("from_entity_id"))))
    with pytest.raises(Exception, match="lost"):
        start().awaitTermination()
    start().awaitTermination()
    assert len(calls) > 3
    want = rows_of(graph.build_graph(chunking.chunk_corpus(legal.withColumn("text", F.col("text")))))
    assert rows_of(loads.read_loads(spark, f"{tmp_path}/g")) == want


def test_psv_keeps_quotes_and_backslashes(spark, tmp_path):
    df = spark.createDataFrame([('a "b" \\ c\\', "x"), ("", " y "), ('\\"', "\\\\")], "citation_id string, citation_text string")
    io.write_graph({"citations": df}, str(tmp_path), "psv")
    got = spark.read.schema("citation_id string, citation_text string").csv(f"{tmp_path}/citations", sep="|", header=True, quote="\u0000", escape="\u0000", emptyValue="", nullValue="\u0000")
    back = got.select(*[F.regexp_replace(F.coalesce(c, F.lit("")), r'\\(["\\])', "$1").alias(c) for c in got.columns])
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def rows_made(spark, make):
    """What ``make`` gives, and the most rows that a step of any query inside it made."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty(30_000)
    known, most = {e.executionId() for e in each(store.executionsList())}, 0
    got = make()
    bus.waitUntilEmpty(30_000)
    for e in each(store.executionsList()):
        if e.executionId() not in known:
            told = {x._1(): x._2() for x in each(store.executionMetrics(e.executionId()))}
            counts = [told.get(m.accumulatorId(), "0") for m in each(e.metrics()) if m.name() == "number of output rows"]
            most = max([most, *[int(c.replace(",", "")) for c in counts]])
    return got, most


def each(seq):
    at = seq.iterator()
    while at.hasNext():
        yield at.next()


@pytest.fixture(scope="module")
def hub(spark):
    """Two entities of 20,000 chunks each, which all of 50 questions ask for, and an edge between them."""
    ids = F.format_string("c%05d", "id")
    mentions = spark.range(20_000).select(ids.alias("chunk_id"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("entity_id"), F.lit(1).cast("long").alias("weight"))
    related = spark.createDataFrame([("a", "b", "CO_OCCURS_WITH", 20_000)], "from_entity_id string, to_entity_id string, relation_type string, weight long")
    entities = spark.createDataFrame([("a", "waiver", "CONCEPT", 20_000), ("b", "contract", "CONCEPT", 20_000)], "entity_id string, name string, type string, frequency long")
    chunks = spark.range(20_000).select(ids.alias("chunk_id"), F.lit("s").alias("source_id"), F.col("id").cast("int").alias("chunk_index"), F.lit(2).alias("token_count"), F.lit("waiver contract").alias("text"))
    cases = spark.createDataFrame([("s", "State")], "case_id string, case_name string")
    asked = retrieval.prepare_questions(spark.range(50).select(F.col("id").alias("q"), F.lit("waiver of a contract").alias("question")))
    return asked, retrieval.seed_entities(asked, entities), related, entities, mentions, chunks, cases


def test_direct_paths_of_a_hub_count_its_mentions_once(spark, hub):
    asked, seeds, _, _, mentions, chunks, cases = hub
    rows, most = rows_made(spark, lambda: retrieval.direct_paths(asked, seeds, mentions, chunks, cases).collect())
    assert len(rows) == 50 * 2 * 12 and {r["chunk_id"] for r in rows} == {f"c{k:05}" for k in range(12)}
    assert all(r["mention_rank"] == int(r["chunk_id"][1:]) + 1 for r in rows)
    assert most <= 50_000  # not questions times mentions


def test_prune_paths_deals_texts_out_once(spark, hub):
    asked, seeds, related, entities, mentions, chunks, cases = hub
    paths = retrieval.direct_paths(asked, seeds, mentions, chunks, cases)
    kept = context.prune_paths(paths)
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Evidence" in line for line in plan.splitlines() if "collect_list" in line or "min(struct" in line)
    rows = kept.where("q = 7").orderBy("place").collect()
    assert [r["place"] for r in rows] == list(range(1, 8)) and all(r["block"].endswith(f"{r['path']}\nEvidence: {r['text']}") for r in rows)


def test_related_paths_of_a_hub_count_its_mentions_once(spark, hub):
    asked, seeds, related, entities, mentions, chunks, cases = hub
    rows, most = rows_made(spark, lambda: retrieval.related_paths(asked, seeds, related, entities, mentions, chunks, cases).collect())
    assert len(rows) == 50 * 2 * 8 and {r["chunk_id"] for r in rows} == {f"c{k:05}" for k in range(8)} and {r["edge_rank"] for r in rows} == {1}
    assert most <= 50_000


@pytest.mark.parametrize("few", [0, 32])
def test_postings_deal_out_no_entries(spark, tmp_path, monkeypatch, few):
    """Fifty questions that ask for the same common dimensions, over small parts: not an entry a question."""
    monkeypatch.setattr(postings, "PART", 2_000)
    monkeypatch.setattr(postings, "FEW", few)
    rng = random.Random(3)
    words = [f"word{k}" for k in range(40)]
    texts = [(f"t{k % 590:03}", " ".join(rng.choices(words, k=60))) for k in range(600)] + [(None, "word1"), ("empty", ""), ("null", None)]
    df = spark.createDataFrame(texts, "id string, text string").repartition(3)
    asked = vectors.hashed_embedding(spark.createDataFrame([(q, " ".join(rng.choices(words, k=12))) for q in range(50)], "q int, text string"), "q", "text")
    vectors.hashed_rows(df, "id", "text").write.parquet(f"{tmp_path}/i")
    index = spark.read.parquet(f"{tmp_path}/i")
    flat = vectors.entries(index, "id")
    n = flat.count()
    want = {}
    for r in vectors.sparse_scores(flat, asked).collect():
        want.setdefault(r["q"], []).append((-round(r["score"], 9), r["id"]))
    want = sorted((q, i, n) for q, rows in want.items() for n, (_, i) in enumerate(sorted(x for x in rows if x[0] < 0)[:4], 1))

    def search():
        postings.write_postings(index, f"{tmp_path}/b", 64)
        return postings.sparse_topk(spark.read.parquet(f"{tmp_path}/b"), index, asked, 4).collect()

    got, most = rows_made(spark, search)
    assert sorted((r["q"], r["id"], r["rank"]) for r in got) == want and len(want) == 200
    assert spark.read.parquet(f"{tmp_path}/b").select("part").distinct().count() > 5
    assert all(r["n_read"] <= r["n_blocks"] for r in got) and most <= 2 * n  # questions times entries before


def test_vectors_of_one_key_add_up(spark):
    """Rows of a key in several partitions are one vector, and counts that cancel out leave no dimension."""
    rows = [(k % 3, f"alpha beta{k % 5} beta") for k in range(40)] + [(7, "!"), (8, None), (None, "alpha")]
    for hashing in ("md5", "blake2b"):
        got = vectors.hashed_rows(spark.createDataFrame(rows, "k int, text string").repartition(5), "k", "text", hashing).collect()
        slot, want = vectors.slot_of(hashing), {}
        for k, text in rows[:40]:
            for token in text.split():
                idx, sign = slot(token)
                own = want.setdefault(k, {})
                own[idx] = own.get(idx, 0) + sign
        assert {r["k"]: dict(zip(r["idx"], r["w"], strict=True)) for r in got} == {k: {d: n for d, n in v.items() if n} for k, v in want.items()}
        assert len(got) == 3 and all(abs(r["norm"] - sum(w * w for w in r["w"]) ** 0.5) < 1e-9 and r["idx"] == sorted(r["idx"]) for r in got)
