"""The library on hand-made rows with known results."""

import json
import math
import os

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import best, chunking, context, evaluate, graph, ingest, retrieval, vectors
from corpusloom.packs import LEGAL
from corpusloom.plans.graph_context import graph_context
from corpusloom.sources import io
from corpusloom.streaming.ingest import stream_chunks


def value(spark, column, *rows, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], schema).select(column).collect()]


@pytest.fixture(scope="module")
def legal(spark):
    meta = "struct<case_name:string,citations:array<string>>"
    rows = [
        ("s1", "State v. Howerton, Court of Criminal Appeals of Oklahoma. June 3, 1981. The defendant raised habeas corpus and waiver. " * 2, ("State v. Howerton", ["1981 OK CR 5"])),
        ("s2", "Bruce v. Turner, 933 F. Supp. 781. Standard of review is de novo. " + "word " * 500, ("Bruce v. Turner", ["933 F. Supp. 781", ""])),
        ("s3", "No names here at all, only a contractor and a waiver.", (None, None)),
    ]
    return spark.createDataFrame(rows, f"id string, text string, metadata {meta}")


def test_clean_text(spark):
    assert value(spark, tx.clean_text(F.col("x")), "a\x00b  <c", "x<p>y</p>", "p<script>q</script>r &amp; s", None) == ["a b <c", "x y", "p r & s", None]
    assert value(spark, tx.clean_text(F.col("x"), fast=True), "x<p>y</p>") == ["x y"]
    assert value(spark, tx.safe_text(F.col("x")), None, " a|b  c ", "|") == ["", "a b c", " "]


def test_token_counts(spark):
    assert value(spark, tx.token_count(F.col("x")), "", "a b.", "été, x_1") == [1, 3, 3]
    assert value(spark, tx.token_count(F.col("x"), "whitespace"), "", " a  b ", None) == [0, 2, 0]


def test_names(spark):
    assert value(spark, tx.normalise_entity(F.col("x")), "The Court.", "Court", "J.", "(U.S.)", "A  B") == ["the court", None, None, "u.s", "a b"]


@pytest.mark.parametrize(
    "n, want",
    [(1, [(0, 1)]), (384, [(0, 384)]), (385, [(0, 384), (320, 385)]), (704, [(0, 384), (320, 704)]), (705, [(0, 384), (320, 704), (640, 705)]), (1025, [(0, 384), (320, 704), (640, 1024), (960, 1025)])],
)
def test_windows(spark, n, want):
    df = spark.createDataFrame([("s", " ".join(["w"] * n))], "id string, text string")
    got = sorted((r["token_start"], r["token_end"]) for r in chunking.chunk_corpus(df).collect())
    assert got == want


def test_windows_of_nothing(spark):
    df = spark.createDataFrame([("s", ""), ("t", None), ("u", " \n")], "id string, text string")
    assert chunking.chunk_corpus(df).count() == 0
    with pytest.raises(ValueError):
        chunking.chunk_windows(F.array(F.lit("a")), 5, 5)


def test_token_budget(spark):
    df = spark.createDataFrame([(k, n) for k, n in enumerate([4, 5, 3, 7])], "record_index long, token_count int").repartition(3)
    assert sorted(r[0] for r in ingest.take_until_tokens(df, "record_index", 10).collect()) == [0, 1, 2]
    assert ingest.take_until_tokens(df, "record_index", 10, max_records=2).count() == 2
    assert ingest.corpus_report(df).first()["total_tokens"] == 19


def test_text_field(spark):
    long, longer = "a" * 600, "b" * 700
    df = spark.createDataFrame([((longer, [(long, "x")]),), (("s", [("t", "u")]),)], "r struct<note:string,opinions:array<struct<opinion_text:string,author:string>>>")
    fields = ingest.string_fields(df, "r")
    assert [x["path"] for x in df.select(fields).first()[0]] == ["r.note", "r.opinions.0.opinion_text", "r.opinions.0.author"]
    got = [r[0] for r in df.select(ingest.choose_text_field(fields)).collect()]
    assert got[0]["path"] == "r.opinions.0.opinion_text" and got[1] is None


def test_text_fields_of_unknown_shape(spark):
    """Maps and variants hold fields like structs do; null ones hold none."""
    rows = [(1, {"b": "x", "a": "y"}, '{"name": "n", "opinions": [{"opinion_text": "t", "k": 1}], "deep": {"z": "w"}}'), (2, None, None), (3, {}, '"plain"')]
    df = spark.createDataFrame(rows, "id int, m map<string,string>, j string").select("id", "m", F.parse_json("j").alias("v"), F.array(F.create_map(F.lit("k"), "m")).alias("l"))
    got = {r["id"]: {(x["path"], x["value"]) for x in r["f"]} for r in df.select("id", ingest.string_fields(df, "m", "v", "l").alias("f")).collect()}
    assert got[1] == {("m.b", "x"), ("m.a", "y"), ("v.name", "n"), ("v.opinions.0.opinion_text", "t"), ("v.deep.z", "w"), ("l.0.k.b", "x"), ("l.0.k.a", "y")}
    assert got[2] == set() and got[3] == {("v", "plain")}


def test_variants_are_walked_without_python(spark):
    """Lists are cut to their first items, keys come in order, other kinds hold no text, and too deep a record is an error."""
    rows = ['{"b":{"d":"x","c":[["p"],{"k":"q"},7,null,true]},"a":"s","":"e"}', "[" + ",".join(f'"{k}"' for k in range(30)) + "]", "3.5", "null", None, '{"a":{}}', "[]"]
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "id int, j string").select("id", F.parse_json("j").alias("v"))
    fields = df.select("id", ingest.string_fields(df, "v").alias("f"))
    got = {r["id"]: [(x["path"], x["value"]) for x in r["f"]] for r in fields.collect()}
    assert got[0] == [("v.", "e"), ("v.a", "s"), ("v.b.c.0.0", "p"), ("v.b.c.1.k", "q"), ("v.b.d", "x")]
    assert got[1] == [(f"v.{k}", str(k)) for k in range(ingest.LIST_ITEMS)]
    assert all(got[k] == [] for k in range(2, 7))
    assert "Python" not in fields._jdf.queryExecution().executedPlan().toString()
    depth = lambda n: spark.createDataFrame([("[" * n + '"x"' + "]" * n,)], "j string").select(F.parse_json("j").alias("v"))
    assert len(depth(ingest.DEPTH).select(ingest.string_fields(depth(ingest.DEPTH), "v")).first()[0]) == 1
    with pytest.raises(Exception, match="nested deeper"):
        depth(ingest.DEPTH + 1).select(ingest.string_fields(depth(ingest.DEPTH + 1), "v")).collect()


def test_a_sample_of_half_a_table(spark, monkeypatch):
    """Exactly the least rows, no task sorts them, and finer ranges give the same."""
    df = spark.range(4000).select(F.col("id").cast("string").alias("id")).repartition(5)
    h = F.md5(F.col("id").cast("binary"))
    want = {r[0] for r in df.orderBy(h, "id").limit(2000).collect()}
    half = ingest.sample_n(df, 2000, 1, by=h)
    assert {r[0] for r in half.collect()} == want and half.count() == 2000
    assert "TakeOrderedAndProject" not in half._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(ingest, "NUMBERED", 0)
    assert {r[0] for r in ingest.sample_n(df, 2000, 1, by=h).collect()} == want
    assert ingest.sample_n(df, 9999, 1).count() == 4000 and ingest.sample_n(df, 0, 1).count() == 0 and ingest.sample_n(df.limit(0), 5, 1).count() == 0
    same = spark.createDataFrame([("a",)] * 50 + [(None,)] * 50 + [("b",)], "id string")
    assert [ingest.sample_n(same, n, 3).count() for n in (1, 49, 51, 100, 101)] == [1, 49, 51, 100, 101]


def test_token_budgets_read_only_up_to_their_end(spark, tmp_path):
    """Rows past the bound are filtered by the scan, so files and row groups sorted by the order are not read."""
    spark.range(20_000).select(F.col("id").alias("n"), F.lit(10).alias("token_count"), F.lit("text").alias("text")).repartitionByRange(20, "n").sortWithinPartitions("n").write.parquet(f"{tmp_path}/t")
    stored = spark.read.parquet(f"{tmp_path}/t")
    kept = ingest.take_until_tokens(stored, "n", 12_345)
    assert sorted(r["n"] for r in kept.collect()) == list(range(1235))
    end = ingest.reading_end(stored, "n", "token_count", 12_345)
    assert 1234 <= end < 1400
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert f"LessThanOrEqual(n,{end})" in plan
    part = stored.where(f"n <= {end}")
    assert part.select(F.input_file_name()).distinct().count() <= 2  # of 20 files
    assert ingest.take_until_tokens(stored, "n", 10**9).count() == 20_000 and ingest.take_until_tokens(stored.limit(0), "n", 5).count() == 0
    odd = spark.createDataFrame([(None, 5), (3, None), (-(1 << 62), 4), (1 << 62, 9), (7, 2)], "n long, token_count int")
    assert sorted(str(r["n"]) for r in ingest.take_until_tokens(odd, "n", 10).collect()) == sorted(["None", str(-(1 << 62)), "3", "7"])


def test_windows_of_subword_tokens(spark):
    """Windows of a tokenizer's tokens: as many as it gives, and texts that follow each other without loss."""
    tokenizers = pytest.importorskip("tokenizers")
    path = "/opt/tokenizers/byte_bpe_50k.json"
    if not os.path.exists(path):
        pytest.skip("no vocabulary file")
    text = "The caf\u00e9 \U0001f600 said: tokenisation isn't hard at all, is it? " * 9
    df = spark.createDataFrame([("s", text), ("t", None), ("u", "")], "id string, text string")
    got = sorted((r["token_start"], r["token_end"], r["text"]) for r in chunking.chunk_corpus(df, 40, 10, tx.bpe_pieces(path)(F.col("text")), "").collect())
    n = len(tokenizers.Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids)
    assert got[0][0] == 0 and got[-1][1] == n and all(b[0] == a[0] + 30 for a, b in zip(got, got[1:]))
    assert text.startswith(got[0][2]) and all(x[2] in text for x in got)


def test_sample_is_stable(spark):
    df = spark.createDataFrame([(str(k),) for k in range(100)], "id string")
    a = {r[0] for r in ingest.sample_n(df, 10, 1).collect()}
    assert a == {r[0] for r in ingest.sample_n(df.repartition(7), 10, 1).collect()} and len(a) == 10
    assert a != {r[0] for r in ingest.sample_n(df, 10, 2).collect()}


def test_graph(spark, legal, tmp_path):
    chunks = chunking.chunk_corpus(legal)
    g = {k: v.cache() for k, v in graph.build_graph(chunks).items()}
    n = {r["table_name"]: r["n_rows"] for r in graph.graph_report(g).collect()}
    assert n["has_chunk"] == n["chunks"] and n["next_chunk"] == n["chunks"] - n["legal_cases"]
    types = {r["type"] for r in g["entities"].collect()}
    assert n["community_reports"] == len(types) + len(LEGAL.topics)
    cases = {r["case_id"]: r for r in g["legal_cases"].collect()}
    assert cases["s1"]["court"] == "Court of Criminal Appeals of Oklahoma" and cases["s1"]["decision_date"] == "June 3, 1981"
    assert cases["s2"]["citations"] == "933 F. Supp. 781" and cases["s3"]["case_name"] == "s3"
    names = {(r["type"], r["name"]) for r in g["entities"].collect()}
    assert {("CASE", "state v. howerton"), ("CONCEPT", "habeas corpus"), ("CONCEPT", "contract"), ("CITATION", "933 f. supp. 781"), ("CONCEPT", "de novo")} <= names
    assert g["related_to"].where("from_entity_id >= to_entity_id").count() == 0
    for fmt in ("parquet", "psv"):
        io.write_graph(g, f"{tmp_path}/{fmt}", fmt)
        back = io.read_graph(spark, f"{tmp_path}/{fmt}", fmt)
        for k in g:
            assert sorted(map(str, back[k].select(*g[k].columns).collect())) == sorted(map(str, g[k].collect())), (fmt, k)
    asked = spark.createDataFrame(
        [("1", "What court decided the case State v. Howerton?", "local_factual"), ("2", "How do cited precedents influence a court's reasoning?", None), ("3", "What types of waiver are common across the corpus?", None)],
        "q string, question string, type string",
    )
    rows = {r["q"]: r for r in graph_context(asked, g).collect()}
    assert [rows[k]["profile"] for k in "123"] == ["local", "multi_hop", "global"]
    assert rows["1"]["case_ids"][0] == "s1" and "State v. Howerton" in rows["1"]["context"]
    assert rows["3"]["context"].startswith("Corpus community reports:")
    assert all(r["used_tokens"] <= retrieval.MAX_TOKENS or r["n_blocks"] == 1 for r in rows.values())


def kept(spark, chunks):
    make = lambda names: [(n, "T", n, 1) for n in names]
    return spark.createDataFrame([(c, make(e)) for c, e in chunks], "chunk_id string, entities array<struct<entity_id:string,type:string,name:string,tf:int>>")


def test_co_occurrence(spark):
    k = kept(spark, [("1", "ABC"), ("2", "AB"), ("3", "A")])
    assert {(r[0], r[1], r[3]) for r in graph.build_related(k).collect()} == {("A", "B", 2), ("A", "C", 1), ("B", "C", 1)}
    assert {(r["entity_id"], r["frequency"]) for r in graph.build_entities(k).collect()} == {("A", 3), ("B", 2), ("C", 1)}


def test_ranking_of_candidates(spark):
    c = [("LAW", "x"), ("CASE", "b"), ("LAW", "a"), ("CASE", "a"), ("LAW", "x")]
    df = spark.createDataFrame([(c,)], "c array<struct<type:string,name:string>>")
    assert [(r["name"], r["type"]) for r in df.select(graph.top_entities(F.col("c"))).first()[0]] == [("x", "LAW"), ("a", "CASE"), ("b", "CASE"), ("a", "LAW")]


def test_greedy_fill(spark):
    def pick(tokens, budget, most):
        df = spark.createDataFrame([([(t, 1.0) for t in tokens],)], "b array<struct<tokens:int,score:double>>")
        return [r["tokens"] for r in df.select(context.greedy_fill(F.col("b"), F.lit(budget), F.lit(most))).first()[0]]

    assert pick([900, 300, 80], 1000, 7) == [900, 80]
    assert pick([1500, 100], 1000, 7) == [1500]
    assert pick([1, 1, 1], 10, 2) == [1, 1]


def test_routes(spark):
    q = ["What court decided X?", "What types of courts are represented across the case corpus?", "How do courts act?", "Opinions across states"]
    assert value(spark, retrieval.route(F.col("x")), *q) == ["local", "global", "multi_hop", "local"]


def test_seed_threshold(spark):
    asked = retrieval.prepare_questions(spark.createDataFrame([("1", "zebra")], "q string, question string"))
    e = spark.createDataFrame([("e5", "alpha", "ORG", 5), ("e6", "beta", "ORG", 6)], "entity_id string, name string, type string, frequency long")
    assert [(r["entity_id"], r["score"]) for r in retrieval.seed_entities(asked, e).collect()] == [("e6", 0.12)]


def test_hashing(spark):
    df = spark.createDataFrame([("a", "one two two"), ("b", "")], "id string, text string")
    for hashing in ("md5", "blake2b"):
        rows = vectors.hashed_embedding(df, "id", "text", hashing).collect()
        assert {r["id"] for r in rows} == {"a"} and sorted(abs(r["w"]) for r in rows) == [1, 2]
        assert all(abs(r["norm"] - math.sqrt(5)) < 1e-12 for r in rows)


def test_dense(spark):
    v = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(6)] + [(9, None)], "vec_id long, embedding array<double>")
    got = vectors.dense_topk(v, v.where("vec_id in (0, 5)").select(F.col("vec_id").alias("q"), "embedding"), 2).collect()
    assert {(r["q"], r["rank"], r["vec_id"]) for r in got} == {(0, 1, 0), (0, 2, 1), (5, 1, 5), (5, 2, 4)}
    assert value(spark, vectors.l2_normalize(F.col("x")), [0.0, 0.0], [3.0, 4.0], schema="x array<double>") == [[0.0, 0.0], [0.6, 0.8]]


def test_published_scores(spark):
    ref = "The case State v. Howerton was decided by the Court of Criminal Appeals of Oklahoma."
    df = spark.createDataFrame([(ref, ref), (ref, ""), (ref, "The answer is not available."), (ref, "Something else entirely")], "r string, a string")
    got = df.select(evaluate.lexical_f1(F.col("r"), F.col("a")), evaluate.heuristic_pass(F.col("r"), F.col("a"))).collect()
    assert [tuple(x) for x in got] == [(1.0, True), (0.0, False), (0.0, False), (0.0, False)]


def test_verdicts_and_cost(spark):
    df = spark.createDataFrame([("pass.", "x"), ("FAIL", "x"), ("", "x"), ("unclear", "x"), ("PASS", " "), ("PASS or FAIL", "x")], "raw string, a string")
    assert [r[0] for r in df.select(evaluate.parse_verdict(F.col("raw"), F.col("a"))).collect()] == ["PASS", "FAIL", "FAIL", "FAIL", "FAIL", "PASS"]
    r = spark.createDataFrame([("gemini-2.5-flash-lite", 3660, 87), ("other", 1_000_000, 0)], "model string, prompt_tokens int, completion_tokens int")
    assert sorted(x["cost_usd"] for x in evaluate.compute_cost(r).collect()) == [0.0004008, 0.1]
    s = spark.createDataFrame([("a", 100.0, 0.0), ("b", 63.39, 1.0)], "pipeline string, avg_total_tokens double, avg_latency_ms double")
    assert [round(x, 2) for x in evaluate.compare_to(s, "a", "b").first()] == [36.61, 0.0]


def test_files(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps([{"id": "a", "question": "x"}, {"question": "y"}]))
    assert [(r["id"], r["question"]) for r in io.read_questions(spark, str(tmp_path / "q.json")).orderBy("question").collect()] == [("a", "x"), ("q002", "y")]
    assert io.read_jsonl(spark, str(tmp_path / "none"), "id string, text string").count() == 0
    (tmp_path / "r.jsonl").write_text('{"id": "1", "text": "a"}\n\n{"id": "2", "text": ""}\n')
    assert io.read_jsonl(spark, str(tmp_path / "r.jsonl"), "id string, text string").count() == 1


def test_stream_equals_batch(spark, legal, tmp_path):
    legal.select("id", "text").write.json(f"{tmp_path}/in")
    stream_chunks(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    want = chunking.chunk_corpus(legal.select("id", tx.clean_text(F.col("text"), True).alias("text")))
    assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == sorted(r["id"] for r in want.collect())


def test_plans_spell_out_costly_columns_once(spark, legal):
    """Each pattern of the pack stands once in the plan of the entities, and the split of a text once in that of chunks."""
    spark.catalog.clearCache()
    chunks = chunking.chunk_corpus(legal)
    plan = graph.build_entities(graph.chunk_entities(chunks))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == len(LEGAL.patterns)
    assert chunks._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_best_rows_in_blocks(spark, monkeypatch):
    """Blocks of questions and batches of rows change nothing; ties go by key, repeated rows count each."""
    chunks = spark.createDataFrame(
        [(f"c{k:02d}", t, t + " case") for k, t in enumerate(["alpha beta gamma", "alpha alpha delta", "", "beta_x 12 gamma", "alpha beta gamma", "zeta"])] + [("c98", None, "x"), (None, "alpha", "alpha")],
        "id string, text string, haystack string",
    )
    asked = spark.createDataFrame([(1, "Alpha gamma?"), (2, "beta"), (3, ""), (4, None)], "q int, question string")
    whole = sorted(map(tuple, retrieval.hybrid_topk(chunks, asked, 3).collect()))
    assert {r[1] for r in whole if r[0] == 1 and r[3] <= 2} == {"c00", "c04"}
    monkeypatch.setattr(best, "BLOCK", 2)
    monkeypatch.setattr(best, "ROWS", 2)
    small = sorted(map(tuple, retrieval.hybrid_topk(chunks.repartition(2), asked, 3).collect()))
    assert small == whole
    index = vectors.sparse_scores(vectors.hashed_embedding(chunks.where("id is not null and text is not null"), "id", "text"), vectors.hashed_embedding(asked.where("question is not null"), "q", "question"))
    dense = {(r["q"], r["id"]): r["score"] for r in index.collect()}
    shares = {(r["q"], r["id"]): r["lexical"] for r in retrieval.lexical_scores(chunks, asked).collect() if r["lexical"] is not None}
    for q, key, score, _ in whole:
        assert abs(score - dense.get((q, key), 0.0) - 0.35 * shares.get((q, key), 0.0)) < 1e-8
