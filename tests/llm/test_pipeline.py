"""The pipeline's stages, each on the output of the one before."""

import corpus_pipeline
from corpusloom.llm import quality, sharding, simhash
from tests.llm.test_operators import brute_contamination

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(120)
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, DATA).cache()
        if name != "sharding":
            assert after.columns == docs.columns
        rows = {r["doc_id"]: r["text"] for r in before.collect()}
        left = after.collect()
        if name == "quality":
            want = {k: quality.judge(t)[8] for k, t in rows.items() if quality.judge(t)[6]}
            assert {r["doc_id"]: r["text"] for r in left} == want
        elif name == "near_duplicates":
            prints = {k: simhash.fingerprint(t) for k, t in rows.items()}
            kept = {r["doc_id"] for r in left}
            near = lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2
            assert not any(near(a, b) for a in kept for b in kept if a < b)
            assert all(any(near(k, j) for j in rows if j < k) for k in set(rows) - kept)
        elif name == "decontamination":
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
            assert {r["doc_id"] for r in left} == {k for k, t in rows.items() if not brute_contamination(t, items)[4]}
        elif name == "sharding":
            table = sharding.lookup_table(sharding.shard_names())
            assert all(r["shard"] == table[r["slot"]] for r in left)
        before = after


def test_run(spark):
    rows = corpus_pipeline.run(spark, DATA)
    assert {"doc_id", "text", "slot", "shard"} <= set(rows.columns) and rows.count() > 50


def test_stages_on_odd_rows(spark):
    """Null ids and texts, one id with several texts, repeated rows, an extra column and an empty table."""
    a, b = (" ".join(f"{x}{k} goes{k} on{k}" for k in range(30)) for x in ("alpha", "beta"))
    kind = "doc_id long, text string, lang string, source string, n_chars long, slot string, loom_row long"
    rows = [(1, a), (2, a), (2, b), (None, b), (3, None), (None, None), (4, ""), (5, "short"), (5, "short")]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t) if t else None, "x", 7) for k, t in rows], kind).repartition(2)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), DATA).count() == 0, name
        left = stage(spark, docs, DATA)
        got = sorted((str(r["doc_id"]), str(r["text"])) for r in left.collect())
        if name == "quality":
            assert got == sorted([("1", a), ("2", a), ("2", b), ("None", b)])
        elif name == "near_duplicates":
            assert got == sorted([("1", a), ("2", b), ("3", "None"), ("5", "short")]), name
        elif name == "decontamination":
            assert len(got) == len(rows)
        elif name == "sharding":
            assert len(got) == len(rows)
        if name != "sharding":
            assert left.columns == docs.columns
