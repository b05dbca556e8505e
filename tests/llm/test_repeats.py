"""Periodic runs, shared lines and phrases against brute-force versions, and on odd rows."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import bloom, lines, phrases, runs
from corpusloom.llm import queries as llm_queries

DOC = "doc_id long, text string, lang string, key string, digest string, n long, top long, row int, words int"


@pytest.fixture(scope="module")
def table(spark):
    """Documents as given, with columns whose names clash with those that operators use."""

    def of(rows):
        return spark.createDataFrame([(i, t, lang, "k", "d", 1, 2, 3, 4) for i, t, lang in rows], DOC).repartition(3)

    return of


# --- 11 ----------------------------------------------------------------------------------------------------------


def plain_runs(words):
    n, out = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                out.setdefault((i, j - i + q), q)
            i = j
    return sorted(((i, n, q) for (i, n), q in out.items()), key=lambda r: (r[0], r[2]))


def repetitive(rng, most):
    letters, out = rng.choice([1, 2, 3, 5, 9]), []
    n = rng.randrange(most)
    while len(out) < n:
        out += [rng.randrange(letters) for _ in range(rng.randrange(1, 8))] * rng.choice([1, 1, 3, 4, 5, 9])
    return out


def test_runs_equal_a_plain_search():
    rng = random.Random(11)
    for _ in range(1500):
        x = repetitive(rng, 120)
        assert runs.find_runs(np.array(x, dtype=np.int64)) == plain_runs(x), x


def test_runs_of_known_words():
    assert runs.find_runs(np.zeros(6, np.int64)) == [(0, 6, 1)]
    assert runs.find_runs(np.zeros(5, np.int64)) == []
    assert runs.find_runs(np.array([7] + [1, 2] * 4)) == [(1, 8, 2)]
    assert runs.find_runs(np.array([1, 2, 1, 2, 1, 2, 1])) == []
    long = list(range(3000)) * 5 + [1, 1, 2, 3]
    assert runs.find_runs(np.array(long)) == [(0, 15_000, 3000)]


def test_grammar_spells_the_text():
    """Each symbol stands for the same words at all of its places."""
    rng = random.Random(4)
    for _ in range(100):
        x = repetitive(rng, 200)
        for before, n, places in runs.grammar(x, [(0, len(x))]):
            assert 0 < before < n
            assert len({tuple(x[i : i + n]) for i in places}) == 1


def test_long_repetitive_texts_take_little_time():
    rng, began = random.Random(6), time.process_time()
    for x in ([0] * 200_000, [0, 1] * 100_000, list(range(500)) * 400, [rng.randrange(2) for _ in range(50_000)], [bin(i).count("1") % 2 for i in range(1 << 16)]):
        runs.find_runs(np.array(x))
    assert time.process_time() - began < 30


def told(doc_id, text):
    """A row of the operator's query, by its contract."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    gone = {k for i, m, q in found for k in range(i + q, i + m)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None,) * 3
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    lines_of = "".join(f"{i},{m},{q}\n" for i, m, q in found)
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, sha(lines_of), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def test_periodic_runs_rows(spark, table, tmp_path):
    rng = random.Random(8)
    rows = [(None, "a b " * 9, "en"), (None, None, None), (1, None, "en"), (2, "", "en"), (3, " \t\n", "en"), (4, "é é é é é é", "en"), (4, "é é é é é é", "en"), (5, "x\x0by\x1cz " * 7, "en")]
    rows += [(10 + k, " ".join(f"w{x}" for x in repetitive(rng, 150)), "en") for k in range(150)]
    rows += [(500 + k, " ".join(f"w{k}" for k in range(200)), "en") for k in range(60)]
    docs = table(rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = llm_queries.op11_periodic_runs(spark, str(tmp_path))
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(repr(told(i, t)) for i, t, _ in rows)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _, _ in rows if i)
    assert runs.periodic_runs(docs.limit(0)).count() == 0
    plain = runs.periodic_runs(table([(1, "a b a b a b a b c", "en")])).first()
    assert (plain["runs"], plain["collapsed"], plain["exponent_milli"]) == ("0,8,2\n", "a b c", 4000)


def test_periodic_runs_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text is null or length(text) < 6000")
    got = llm_queries.op11_periodic_runs(spark, "/root/testdata/sf0.001").collect()
    by_id = defaultdict(list)
    for r in got:
        by_id[r["doc_id"]].append((r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"], r["runs_sha256"], r["collapsed_sha256"]))
    for r in docs.select("doc_id", "text").collect():
        assert told(r["doc_id"], r["text"])[1:] in by_id[r["doc_id"]]


# --- 12 ----------------------------------------------------------------------------------------------------------


def plain_lines(rows, least=40, docs=5):
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(list)
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= least:
                held[k].append(i)
    top = {k: max((i for i in ids if i is not None), default=None) for k, ids in held.items() if len(ids) >= docs}
    out = []
    for i, t in rows:
        all_lines = (t or "").split("\n")
        stay = [x for x in all_lines if key(x) not in top or top[key(x)] == i]
        out.append((i, len(all_lines), len(all_lines) - len(stay), "\n".join(stay)))
    return sorted(map(repr, out))


@pytest.fixture(scope="module")
def lined():
    rng = random.Random(3)
    pool = [" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(rng.choice([4, 7, 12]))) for _ in range(40)]
    pool += ["é" * 40, "é" * 39, "x" * 40, "x" * 39, "İ" * 45, "漢" * 41]
    rows = [(None, None), (None, "\n".join(pool[:9])), (None, "\n".join(pool[:5])), (1, None), (2, ""), (3, "\n\n"), (4, " \t"), (5, "y" * 300_000 + "\n" + pool[3])]
    for k in range(120):
        text = [rng.choice(pool) for _ in range(rng.randrange(1, 6))]
        text = [x.upper() if x.isascii() and rng.random() < 0.2 else x for x in text]
        rows.append((10 + k // 2, rng.choice(["\n", "\r\n", " \n\t"]).join(text)))
    return rows + [(9000 + k, f"only here {k} " + "z" * 40) for k in range(50)] + [rows[-1]] * 3


@pytest.mark.parametrize("kept_lines, flush", [(lines.KEPT_LINES, bloom.FLUSH), (3, 16)])
def test_shared_lines(table, lined, kept_lines, flush, monkeypatch):
    """The same by broadcast and by joins, with bitmaps sent at once or many times."""
    monkeypatch.setattr(bloom, "FLUSH", flush)
    monkeypatch.setattr(lines, "COUNTED", 5)
    docs = table([(i, t, "en") for i, t in lined])
    got = lines.dedup_lines(docs, kept_lines=kept_lines)
    assert sorted(repr((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"])) for r in got.collect()) == plain_lines(lined)


def test_shared_lines_with_a_full_filter(table, lined, monkeypatch):
    """A filter that holds all bits only suspects more lines."""
    real = bloom.build

    def full(*args):
        out = real(*args)
        out.bits[:] = 255
        return out

    monkeypatch.setattr(bloom, "build", full)
    got = lines.dedup_lines(table([(i, t, "en") for i, t in lined]))
    assert sorted(repr((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"])) for r in got.collect()) == plain_lines(lined)


def test_shared_lines_of_nothing(table):
    assert lines.dedup_lines(table([])).count() == 0
    got = lines.dedup_lines(table([(None, "q" * 50, "en")] * 6)).collect()
    assert {(r["doc_id"], r["n_dropped"]) for r in got} == {(None, 0)}  # all of them have the largest id
    assert {r["kept"] for r in lines.dedup_lines(table([(1, None, None)])).collect()} == {""}


def test_few_lines_are_suspected(spark):
    """Only lines that come again, and few others, leave their task."""
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("a line of its own, that no other document has: "), F.col("id")).alias("text"))
    more = docs.unionAll(docs.where("doc_id < 50").withColumn("doc_id", F.col("doc_id") + 100_000))
    _, twice = lines.shared_lines(more)
    own = lambda i: lines._hashes([d for d in lines._digests(lines.line_keys(f"a line of its own, that no other document has: {i}")).values()])
    held = [bool(twice.holds(own(i))[0]) for i in range(20_000)]
    assert all(held[:50])
    assert sum(held[50:]) < 400


# --- 13 ----------------------------------------------------------------------------------------------------------


def plain_phrases(rows, least, best):
    n, f = Counter(), Counter()
    for _, text, lang in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang or "und", tuple(w[i : i + k])] += 1
    known = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    inside = defaultdict(int)
    for (lang, w), a in known.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                inside[lang, w[i : i + k]] = max(inside[lang, w[i : i + k]], a)
    out = []
    for lang in n:
        held = []
        for (of, w), a in known.items():
            if of == lang and not 100 * inside[of, w] >= 80 * a:
                score, k = min((2_000_000 * a // (f[of, w[:k]] + f[of, w[k:]]), k) for k in range(1, len(w)))
                held.append((-score, -a, " ".join(w).encode(), f[of, w[:k]], f[of, w[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(held)[:best], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(9)
    pool = ["The", "of", "new", "york", "city", "hall", "é", "Über", "漢", "\x1c", "x\xa0y", "a", "b"]
    rows = [(None, "new york city hall " * 30, None), (1, None, "en"), (2, "", "en"), (3, " .,\t\n", None), (4, "a" * 100_000 + " new york", "en")]
    for k in range(200):
        text = "".join(rng.choice(pool) + rng.choice([" ", " ", "  ", "\t", ", ", ".\n", "\x0b"]) for _ in range(rng.randrange(1, 60)))
        rows.append((10 + k, text + " New York City hall" * rng.randrange(3), rng.choice(["en", "en", "de", None, "und"])))
    return rows + rows[20:30] * 2


@pytest.mark.parametrize("sample, chunk", [(0, 300), (2_000, phrases.CHUNK), (1 << 30, 5_000)])
@pytest.mark.parametrize("least, best", [(30, 2000), (4, 9)])
def test_collocations(table, prose, sample, chunk, least, best, monkeypatch):
    """The same whatever the sample proposes, none of it or all of it."""
    monkeypatch.setattr(phrases, "CHUNK", chunk)
    got = phrases.collocations(table(prose), least=least, best=best, sample_bytes=sample)
    names = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.select(*names).collect())) == plain_phrases(prose, least, best)


def test_passes_go_on_until_the_border_is_closed(table, prose, monkeypatch):
    passes = []
    real = phrases._counts
    monkeypatch.setattr(phrases, "_counts", lambda docs, now, before, *more: passes.append(before is not None) or real(docs, now, before, *more))
    docs = table(prose).select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    full = phrases.frequent(docs, 30)
    assert passes == [False, True]  # words, then all that has a frequent one
    passes.clear()
    again = phrases.frequent(docs, 30, full.where("words between 1 and 3"))
    assert passes == [False]  # all was proposed
    passes.clear()
    some = full.where("words between 1 and 3").where(F.pmod(F.xxhash64("phrase"), F.lit(3)) > 0)
    third = phrases.frequent(docs, 30, some)
    assert passes == [False, True]
    assert sorted(map(tuple, full.collect())) == sorted(map(tuple, third.collect()))
    assert sorted(map(tuple, full.collect())) == sorted(map(tuple, again.collect()))


def test_scores_pass_64_bits(spark):
    big = 9_000_000_000_000_000
    counts = spark.createDataFrame([("en", 0, "", 3 * big), ("en", 1, "a", big + 1), ("en", 1, "b", big), ("en", 2, "a b", big)], "lang string, words int, phrase string, n long")
    row = phrases.best_of(counts).first()
    assert row["score"] == 2_000_000 * big // (2 * big + 1)


def test_collocations_of_nothing(table):
    assert phrases.collocations(table([])).count() == 0
    assert phrases.collocations(table([(1, None, None), (2, "", "en")])).count() == 0


def test_filters_hold_what_was_put_in(spark):
    rng = np.random.default_rng(1)
    put = rng.integers(0, 1 << 63, 50_000).astype(np.uint64)
    df = spark.createDataFrame([(int(x),) for x in np.r_[put, put[:1000]]], "x long").repartition(7)
    of = lambda columns: np.array(columns[0], np.int64).view(np.uint64)
    once, twice = (bloom.build(df, of, bloom.blocks_for(len(put)), flag) for flag in (False, True))
    other = rng.integers(0, 1 << 63, 50_000).astype(np.uint64)
    assert once.holds(put).all() and twice.holds(put[:1000]).all()
    assert once.holds(other).mean() < 0.05 and twice.holds(put[1000:]).mean() < 0.05
    assert not bloom.build(df.limit(0), of, 1, False).holds(put).any()
