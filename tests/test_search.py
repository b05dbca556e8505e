"""Searches through indexes, bits and automata against plain versions, and the plans they make."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import case_search, needles, retrieval
from corpusloom.packs import FLAT_STOPWORDS, LEGAL

NO_PAIRS = ("CartesianProduct", "BroadcastNestedLoopJoin")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_automaton_finds_all_parts():
    rng = random.Random(2)
    for _ in range(200):
        some = {"".join(rng.choice("ab é") for _ in range(rng.randrange(0, 5))) for _ in range(rng.randrange(6))}
        text = "".join(rng.choice("ab é") for _ in range(rng.randrange(30)))
        found = needles.Automaton(sorted(some))
        assert {n for n, k in found.at.items() if k in found.found(text)} == {n for n in some if n in text}


@pytest.mark.parametrize("with_empty", [False, True])
def test_containing_equals_a_plain_search(spark, with_empty):
    rng = random.Random(3)
    word = lambda least, most: "".join(rng.choice("abcDé😀") for _ in range(rng.randrange(least, most)))
    texts = [word(0, 12) for _ in range(300)] + [None, "", "a", "ab"] + ["abc"] * 50
    some = [word(1, 6) for _ in range(60)] + [None, "zzz", "a", "ab"] + [""] * with_empty
    got = needles.containing(spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(n,) for n in some], "needle string"))
    want = {(t, n) for t in texts for n in some if t is not None and n is not None and n in t}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    nothing = spark.createDataFrame([], "text string")
    assert needles.containing(nothing, nothing.withColumnRenamed("text", "needle")).count() == 0


@pytest.fixture(scope="module")
def corpus(spark):
    """Cases of pieces of any length, with phrases over their borders."""
    rng = random.Random(7)
    words = ["fourth", "amendment", "Waiver", "of", "rights", "appeal", "defendant", "post-conviction", "x", "criminal", "Σ", "tort"]
    cases = [(f"c{k}", rng.choice(["State v. Roe", "", None, "waiver of rights"]), "933 F. Supp. 781", "", "") for k in range(12)] + [(None, "State v. Roe", "", "", "")]
    chunks = []
    for k in range(14):  # two of them are no case
        for i in range(rng.choice([0, 1, 3, 40])):
            text = None if rng.random() < 0.05 else " ".join(rng.choice(words) for _ in range(rng.choice([1, 1, 2, 30])))
            chunks.append((f"k{k}-{i}", f"c{k}", rng.choice([i, i, i // 2]), 9, text))
    chunks += [("n1", None, 0, 1, "fourth amendment"), ("n2", "c1", None, 1, "fourth"), ("n3", "c1", 0, 1, "")]
    asked = [(k, q) for k, q in enumerate([
        "Was the fourth amendment raised in a criminal appeal?", "State v. Roe", "waiver of rights", "appeal defendant", "What of tort and 933 F. Supp. 781?", "", None, "of x", "constitutional rights and government waiver rights waiver",
        " Fourth amendment WAIVER of ",
    ])]
    return (
        spark.createDataFrame(cases, "case_id string, case_name string, citations string, court string, decision_date string"),
        spark.createDataFrame(chunks, "chunk_id string, source_id string, chunk_index int, token_count int, text string").repartition(5),
        spark.createDataFrame(asked, "q int, question string"), cases, chunks,
    )


def plain_ranks(prepared, cases, chunks):
    import re

    out = []
    for r in prepared.collect():
        scored = []
        for case_id, *meta_of in cases:
            if case_id is None:
                continue
            meta = " ".join(x for x in (case_id, *meta_of) if x is not None).lower()
            own = sorted((c for c in chunks if c[1] == case_id and c[4] is not None), key=lambda c: (c[2] is not None, c[2] or 0, c[0]))
            hay = " ".join([meta, *[c[4].lower() for c in own]])
            tokens, whole = set(re.findall(r"[a-z][a-z0-9_]+", hay)), r["question"].strip(" ").lower()
            score = sum(2.0 * (t in meta) + (t in tokens) for t in r["terms"])
            score += sum(5.0 * (p in meta) + 2.5 * (p in hay) for p in r["phrases"]) + sum(24.0 * (n in meta) for n in r["names"])
            if {"criminal", "appeal"} & set(r["terms"]):
                score += 1.25 * min(5, sum(m in hay for m in LEGAL.case_markers))
            score += 5.0 * bool(whole and whole in hay)
            if r["terms"] and score > 0:
                scored.append((-score / len(r["terms"]), case_id))
        best = [(r["q"], c, k, round(-s, 6)) for k, (s, c) in enumerate(sorted(scored)[: r["n_cases"]], 1)]
        out += best or [(r["q"], min(c[0] for c in cases if c[0]), 1, 0.0)]
    return sorted(out)


@pytest.mark.parametrize("gathered", [case_search.GATHERED, 2])
def test_case_ranks_equal_whole_texts(spark, corpus, gathered, monkeypatch):
    monkeypatch.setattr(case_search, "GATHERED", gathered)
    cases, chunks, asked, case_rows, chunk_rows = corpus
    prepared = retrieval.prepare_questions(asked)
    got = retrieval.rank_cases(prepared, retrieval.case_search_docs(cases, chunks))
    assert sorted((r["q"], r["case_id"], r["rank"], round(r["score"], 6)) for r in got.collect()) == plain_ranks(prepared, case_rows, chunk_rows)


def test_borders_hold_what_crosses_them(spark, corpus):
    cases, chunks, _, case_rows, chunk_rows = corpus
    docs = retrieval.case_search_docs(cases, chunks)
    for most in (2, 5, 40, 300):
        held = {}
        for r in case_search.borders(docs, most).collect():
            held.setdefault(r["case_id"], []).append(r["text"])
        for case_id in {c[1] for c in chunk_rows if c[1]}:
            rows = docs.where(F.col("case_id") == case_id).collect()
            texts = [r["text"] for r in sorted(rows, key=lambda r: (r["kind"], r["chunk_index"] is not None, r["chunk_index"] or 0, r["chunk_id"] or ""))]
            whole, at = " ".join(texts), 0
            assert all(t in whole for t in held.get(case_id, []))
            for t in texts[:-1]:
                at += len(t) + 1  # the next piece begins here
                for start in range(max(0, at - most), at):
                    part = whole[start : start + most]
                    if start + most > at and start < at - 1 and len(part) == most:
                        assert any(part in b for b in held[case_id]), (most, part)
    assert case_search.borders(docs, 0).count() == 0 and case_search.borders(docs.limit(0), 9).count() == 0


def test_a_case_of_100_000_chunks(spark):
    """Its text stands in no row: a phrase over a border and a word of the last chunk are found, and tasks share the case."""
    n = 100_000
    text = F.when(F.col("id") == 70_000, "the habeas").when(F.col("id") == 70_001, "corpus of").when(F.col("id") == n - 1, "zebra").otherwise("plain words")
    chunks = spark.range(n).select(F.concat(F.lit("k"), F.col("id")).alias("chunk_id"), F.lit("big").alias("source_id"), F.col("id").cast("int").alias("chunk_index"), text.alias("text"))
    cases = spark.createDataFrame([("big", "", "", "", ""), ("a", "", "", "", "")], "case_id string, case_name string, citations string, court string, decision_date string")
    prepared = retrieval.prepare_questions(spark.createDataFrame([(1, "zebra"), (2, "habeas corpus petitions collateral direct appeals")], "q int, question string"))
    docs = retrieval.case_search_docs(cases, chunks.withColumn("token_count", F.lit(2)))
    ranked = retrieval.rank_cases(prepared, docs)
    got = {r["q"]: (r["case_id"], r["score"]) for r in ranked.collect()}
    assert got[1] == ("big", 1.0 + 5.0)
    terms = prepared.where("q = 2").first()["terms"]
    assert got[2] == ("big", (2 + 2.5) / len(terms))
    assert "collect_list(text" not in plan_of(ranked)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the case is small in bytes
    try:
        sizes = case_search.borders(docs, 30).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(r["count"] for r in sizes) < 0.6 * n


def test_case_search_of_nothing(spark, corpus):
    cases, chunks, asked, *_ = corpus
    prepared = retrieval.prepare_questions(asked)
    assert retrieval.rank_cases(prepared, retrieval.case_search_docs(cases.limit(0), chunks)).count() == 0
    only = retrieval.rank_cases(prepared, retrieval.case_search_docs(cases, chunks.limit(0)))
    assert {r["q"] for r in only.collect()} == set(range(10))
    assert retrieval.rank_cases(prepared.limit(0), retrieval.case_search_docs(cases, chunks)).count() == 0


def test_lexical_scores_equal_a_plain_search(spark):
    rng = random.Random(1)
    hay = [(f"d{k}", " ".join(rng.choice(["taxes", "taxation", "Tax", "re_tax1", "é", "law", "outlaw", "lawyer's"]) for _ in range(rng.randrange(6)))) for k in range(80)]
    hay += [("n", None), ("e", "")]
    asked = [(1, "tax law"), (2, "law law outlaw"), (3, "nothing"), (4, ""), (5, None), (6, "of it"), (7, "TAX retax tax1")]
    q = spark.createDataFrame(asked, "q int, question string")
    got = retrieval.lexical_scores(spark.createDataFrame(hay, "id string, haystack string"), q)
    terms = {r[0]: r[1] for r in q.select("q", retrieval.query_terms(F.coalesce("question", F.lit("")), FLAT_STOPWORDS)).collect()}
    want = {(k, i, sum(t in (h or "").lower() for t in ts) / len(ts)) for k, ts in terms.items() if ts for i, h in hay}
    assert {tuple(r) for r in got.collect()} == {x for x in want if x[2] > 0}
    assert not any(x in plan_of(got) for x in NO_PAIRS)


def test_seed_entities_equal_all_pairs(spark, corpus):
    rng = random.Random(4)
    names = ["fourth amendment", "waiver", "state v. roe", "the waiver of rights", "rights", None, "", "court", "933 f. supp. 781"]
    entities = [(f"e{k:03}", rng.choice(names), rng.choice(["CASE", "LAW", "WORD", None]), rng.choice([None, 0, 1, 3, 6, 25])) for k in range(150)] + [(None, "waiver", "LAW", 50)]
    df = spark.createDataFrame(entities, "entity_id string, name string, type string, frequency long")
    prepared = retrieval.prepare_questions(corpus[2])
    got = retrieval.seed_entities(prepared, df)
    want = []
    for r in prepared.collect():
        rows = []
        for i, name, kind, n in entities:
            low = (name or "").lower()
            hits = sum(t in low for t in r["terms"]) + 2.5 * sum(p in low for p in r["phrases"]) + 8 * sum(x in low for x in r["names"])
            s = round(200 * hits * (1.25 if kind in ("CASE", "LAW", "CONCEPT") else 1) + 2 * min(n or 1, 20), 4)
            if s > 10 and i is not None:
                rows.append((-s, i, name, kind))
        want += [(r["q"], i, name, kind, -s / 100, k) for k, (s, i, name, kind) in enumerate(sorted(rows, key=lambda x: x[:2])[:5], 1)]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert not any(x in plan_of(got) for x in NO_PAIRS)
    assert retrieval.seed_entities(prepared, df.limit(0)).count() == 0


def test_entity_context_of_short_keywords(spark):
    entities = spark.createDataFrame([("e1", "Oak"), ("e2", "oak tree"), ("e3", "a"), ("e4", None), ("e5", "tree"), ("e6", "x oak")], "entity_id string, name string")
    related = spark.createDataFrame([("e2", "e5"), ("e2", "e3"), (None, "e1")], "from_entity_id string, to_entity_id string")
    mentions = spark.createDataFrame([("c1", "e2"), ("c2", "e5"), ("c3", None)], "chunk_id string, entity_id string")
    words = spark.createDataFrame([("oak",), ("a",), ("ee",), ("zz",), ("",), (None,)], "keyword string")
    got = retrieval.entity_context(words, entities, related, mentions, e=2)
    rows = {}
    for r in got.collect():
        rows.setdefault((r["keyword"], r["role"]), []).append(r["id"])
    rows = {k: sorted(v) for k, v in rows.items()}
    assert rows[("oak", "entity")] == ["e2", "e6"] and rows[("a", "entity")] == ["e1", "e2"] and rows[("ee", "entity")] == ["e2", "e5"] and rows[("", "entity")] == ["e1", "e2"]
    assert rows[("oak", "related_entity")] == ["e3", "e5"] and rows[("oak", "chunk")] == ["c1"] and rows[("oak", "related_chunk")] == ["c2"]
    assert not any(k[0] in ("zz", None) for k in rows)
    assert not any(x in plan_of(got) for x in NO_PAIRS)
    assert retrieval.entity_context(words, entities.limit(0), related, mentions).count() == 0
