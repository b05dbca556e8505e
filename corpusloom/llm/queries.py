"""Queries over the text tables: one for each operator, and the pipeline's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import decontam, html, langid, lines, lm, mixing, phrases, quality, runs, sharding, simhash, tokens, toxicity
from corpusloom.llm.common import read


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(read(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_rates(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(read(spark, sf_dir, "documents").select("doc_id"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(read(spark, sf_dir, "documents"), whole=True)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read(spark, sf_dir, "documents")).drop("cleaned")


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(read(spark, sf_dir, "pages"))


def op10_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(read(spark, sf_dir, "documents"), plant=True)
    digests = F.sha2("runs", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", *digests)


def op12_shared_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedup_lines(read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    own = (
        op1_token_counts, op2_mixing, op3_sharding, op4_language, op5_toxicity, op6_near_duplicates, op7_lm_score, op8_quality, op9_main_text,
        op10_contamination, op11_periodic_runs, op12_shared_lines, op13_collocations, pipeline,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    table = ",".join(map(str, sharding.lookup_table(sharding.shard_names())))
    return {
        "op3_sharding": f"""
            SELECT doc_id, slot, CAST(string_split('{table}', ',')[slot + 1] AS INTEGER) AS shard
            FROM (SELECT doc_id, CAST(('0x' || substr(md5(COALESCE(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT % {sharding.SLOTS} AS INTEGER) AS slot FROM documents)
        """,
        "op8_quality": QUALITY_SQL,
        "op10_contamination": CONTAMINATION_SQL,
        "op12_shared_lines": SHARED_LINES_SQL,
        "op13_collocations": COLLOCATIONS_SQL,
    }


#: The quality rules over lines and words.
QUALITY_SQL = r"""
WITH d AS (SELECT doc_id, COALESCE(text, '') AS text, row_number() OVER () AS r FROM documents),
w AS (SELECT r, list_filter(regexp_split_to_array(text, '[ \t\n\v\f\r]+'), lambda x: x <> '') AS w FROM d),
n AS (SELECT r, len(w) AS n_words, COALESCE(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars FROM w),
l AS (SELECT r, line, k, list_filter(regexp_split_to_array(line, '[ \t\n\v\f\r]+'), lambda x: x <> '') AS lw
      FROM (SELECT r, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS k FROM d)),
m AS (SELECT r, line, k, len(lw) AS n, list_sum(list_transform(lw, lambda x: length(x))) AS c,
             length(regexp_replace(line, '[^|]', '', 'g')) AS bars, length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) AS s,
             len(list_filter(lw, lambda x: regexp_matches(x, '[!?#*$%&]{2,}[.,]?$'))) AS marks,
             length(regexp_replace(line, '[^A-Z]', '', 'g')) AS up, length(regexp_replace(line, '[^a-z]', '', 'g')) AS low
      FROM l WHERE len(lw) > 0),
f AS (SELECT r, c, row_number() OVER (PARTITION BY r, line ORDER BY k) > 1 AS dup,
             (bars >= 2 AND bars * 4 >= n) OR 100 * s > 8 * c OR 2 * marks > n OR (up >= 8 AND up > 4 * low)
             OR (up = 0 AND low = 0 AND NOT regexp_matches(line, '[^\x00-\x7F]'))
             OR (n <= 30 AND regexp_matches(lower(line), 'all rights reserved|licensed under|released under|copyright|cookie policy|privacy policy|terms of use|terms of service|click here|subscribe to|sign up for|log in to|javascript')) AS bad
      FROM m),
g AS (SELECT r, count(*) FILTER (WHERE dup) AS n_dup_lines, COALESCE(sum(c) FILTER (WHERE bad), 0) AS lost_chars FROM f GROUP BY r),
p AS (SELECT r, unnest(w) AS x, unnest(range(len(w))) AS i FROM w),
t AS (SELECT r, i, x || ' ' || lead(x) OVER (PARTITION BY r ORDER BY i) || ' ' || lead(x, 2) OVER (PARTITION BY r ORDER BY i) AS t FROM p),
u AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, t) AS n FROM t WHERE t IS NOT NULL) WHERE n > 1),
v AS (SELECT r, count(DISTINCT i + o) AS n_repeat_words FROM u, (SELECT unnest([0, 1, 2]) AS o) GROUP BY r),
a AS (SELECT d.doc_id, n_words, word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
             COALESCE(n_dup_lines, 0) AS n_dup_lines, COALESCE(n_repeat_words, 0) AS n_repeat_words, COALESCE(lost_chars, 0) AS lost_chars
      FROM d JOIN n USING (r) LEFT JOIN g USING (r) LEFT JOIN v USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND 100 * lost_chars <= 50 * word_chars AS kept, CAST(lost_chars AS BIGINT) AS lost_chars
FROM b
"""

#: Windows of test items joined to windows of documents by their text; stretches of 26 words that hold all words of a window.
CONTAMINATION_SQL = r"""
WITH texts AS (SELECT 'd' AS side, row_number() OVER () AS r, doc_id AS id, text FROM documents
              UNION ALL SELECT 'b', row_number() OVER (), item_id, text FROM benchmark WHERE item_id IS NOT NULL),
w AS (SELECT side, r, id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
q AS (SELECT DISTINCT id, array_to_string(w[i + 1 : i + 13], ' ') AS t, least(len(w), 13) AS n
      FROM (SELECT id, w, unnest(range(greatest(1, len(w) - 12))) AS i FROM w WHERE side = 'b' AND len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM q),
p AS (SELECT r, n, unnest(range(len(w) - n + 1)) AS i, w FROM w, sizes WHERE side = 'd' AND len(w) >= n),
x AS (SELECT r, i, n, array_to_string(w[i + 1 : i + n], ' ') AS t FROM p),
h AS (SELECT x.r, x.i, x.n, q.id FROM x JOIN q ON x.t = q.t AND x.n = q.n),
c AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT r, i, n FROM h)) GROUP BY r),
wk AS (SELECT row_number() OVER (ORDER BY t) AS k, t FROM (SELECT DISTINCT t FROM q)),
wt AS (SELECT k, len(list_distinct(string_split(t, ' '))) AS n, unnest(list_distinct(string_split(t, ' '))) AS t FROM wk),
wi AS (SELECT DISTINCT k, id FROM wk JOIN q USING (t)),
o AS (SELECT r, unnest(w) AS t, unnest(range(len(w))) AS pos FROM w WHERE side = 'd'),
oc AS (SELECT r, pos, t FROM o WHERE t IN (SELECT t FROM wt)),
dc AS (SELECT r, k, n FROM (SELECT DISTINCT r, t FROM oc) JOIN wt USING (t) GROUP BY r, k, n HAVING count(*) = n),
nr AS (SELECT r, k, n, count(DISTINCT oc.t) OVER (PARTITION BY r, k ORDER BY pos RANGE BETWEEN CURRENT ROW AND 25 FOLLOWING) AS have FROM dc JOIN wt USING (k, n) JOIN oc USING (r, t)),
nn AS (SELECT r, count(DISTINCT id) AS n_near_items FROM nr JOIN wi USING (k) WHERE have = n GROUP BY r),
s AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, CAST(id AS VARCHAR) AS id FROM h) GROUP BY r)
SELECT w.id AS doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(COALESCE(n_hit, 0) AS BIGINT) AS n_hit, CAST(COALESCE(n_items, 0) AS BIGINT) AS n_items,
       sha256(COALESCE(ids, '')) AS items_sha256, COALESCE(n_hit, 0) > 0 AND 20 * COALESCE(n_hit, 0) >= len(w.w) AS contaminated,
       CAST(COALESCE(n_near_items, 0) AS BIGINT) AS n_near_items
FROM w LEFT JOIN c USING (r) LEFT JOIN s USING (r) LEFT JOIN nn USING (r) WHERE side = 'd'
"""

#: Lines of rows by key; the rows of the largest id keep theirs.
SHARED_LINES_SQL = r"""
WITH d AS (SELECT doc_id, COALESCE(text, '') AS text, row_number() OVER () AS r FROM documents),
l AS (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS k FROM d),
m AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS top FROM (SELECT DISTINCT r, doc_id, key FROM m WHERE length(key) >= 40) GROUP BY key HAVING count(*) >= 5),
x AS (SELECT m.*, c.key IS NOT NULL AND m.doc_id IS DISTINCT FROM c.top AS dropped FROM m LEFT JOIN c ON m.key = c.key),
a AS (SELECT r, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped, COALESCE(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT dropped), '') AS kept FROM x GROUP BY r)
SELECT d.doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_dropped AS BIGINT) AS n_dropped, sha256(kept) AS kept_sha256 FROM d JOIN a USING (r)
"""

#: All phrases of one to four words counted, then joined by their parts.
COLLOCATIONS_SQL = r"""
WITH d AS (SELECT COALESCE(lang, 'und') AS lang, translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\n\x0B\x0C\r]')) AS piece FROM d),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w FROM p),
s AS (SELECT lang, w, unnest(range(len(w))) AS i FROM w),
g AS (SELECT lang, k, array_to_string(w[i + 1 : i + k], ' ') AS phrase FROM s, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k <= len(w)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY lang, k, phrase),
n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 30),
x AS (SELECT lang, k, phrase, a, w, unnest(range(1, k)) AS j FROM c),
y AS (SELECT x.lang, x.phrase, x.a, j, l.f AS l, r.f AS r, (2000000 * CAST(a AS HUGEINT)) // (CAST(l.f AS HUGEINT) + r.f) AS score
      FROM x JOIN f AS l ON l.lang = x.lang AND l.phrase = array_to_string(w[1 : j], ' ') JOIN f AS r ON r.lang = x.lang AND r.phrase = array_to_string(w[j + 1 : x.k], ' ')),
z AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
i AS (SELECT lang, array_to_string(w[b + 1 : b + m], ' ') AS phrase, max(a) AS longer
      FROM (SELECT lang, w, k, a, m, unnest(range(k - m + 1)) AS b FROM (SELECT lang, w, k, a, unnest(range(2, k)) AS m FROM c WHERE k > 2)) GROUP BY ALL),
o AS (SELECT z.*, row_number() OVER (PARTITION BY z.lang ORDER BY score DESC, a DESC, z.phrase) AS rank
      FROM z LEFT JOIN i ON i.lang = z.lang AND i.phrase = z.phrase WHERE longer IS NULL OR 100 * CAST(longer AS HUGEINT) < 80 * CAST(a AS HUGEINT))
SELECT o.lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM o JOIN n ON n.lang = o.lang WHERE rank <= 2000
"""
