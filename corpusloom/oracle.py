"""The library's queries in DuckDB's SQL, for side-by-side checks."""

from __future__ import annotations

from corpusloom.functions.text import NO_NAMES
from corpusloom.operators import evaluate
from corpusloom.packs import FLAT_STOPWORDS, PROSE, SCORE_STOPWORDS

_WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _list(items) -> str:
    return "[" + ", ".join("'" + str(x).replace("'", "''") + "'" for x in items) + "]"


def _words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{_WS}'), lambda x: x <> '')"


def _collapse(text: str) -> str:
    return f"trim(regexp_replace({text}, '{_WS}', ' ', 'g'))"


def _safe(text: str) -> str:
    return f"translate({_collapse(f'COALESCE({text}, chr(32))')}, '|', ' ')"


_CHUNKS = f"""
op AS (SELECT CAST(doc_id AS VARCHAR) AS source_id, doc_id AS record_index, text, lang, source, {_words('text')} AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
cw AS (SELECT source_id, lang, source, w, len(w) AS n, unnest(range(0, 1 + CAST(greatest(0, ceil((len(w) - 384) / 320.0)) AS INT))) AS i FROM op WHERE len(w) > 0),
ct AS (SELECT source_id, lang, source, CAST(i AS INT) AS chunk_index, CAST(i * 320 AS INT) AS token_start, CAST(least(i * 320 + 384, n) AS INT) AS token_end,
              array_to_string(w[i * 320 + 1 : i * 320 + 384], ' ') AS text FROM cw),
ch AS (SELECT substr(sha1(source_id || ':' || chunk_index || ':' || substr(text, 1, 200)), 1, 16) AS id, *, token_end - token_start AS token_count FROM ct)"""

_KINDS = ["CASE", "CITATION", *[k for k, _ in PROSE.patterns], *sorted(set(PROSE.lexicon.values()))]
_PATTERN_CANDIDATES = "".join(
    f" UNION ALL SELECT id, '{kind}', unnest(regexp_extract_all(st, '{p}')) FROM cs" for kind, p in PROSE.patterns
)
_LEXICON_CANDIDATES = "".join(f" UNION ALL SELECT id, '{kind}', '{w}' FROM cs WHERE contains(lower(st), '{w}')" for w, kind in PROSE.lexicon.items())
_ENTITIES = f"""{_CHUNKS},
cs AS (SELECT id, source, lang, {_safe('text')} AS st FROM ch),
ca AS (SELECT id, 'CASE' AS type, source AS raw FROM cs UNION ALL SELECT id, 'CITATION', unnest(list_filter([lang, source], lambda x: x <> '')) FROM cs{_PATTERN_CANDIDATES}{_LEXICON_CANDIDATES}),
cn AS (SELECT id, type, regexp_replace(trim(lower(raw), ' .,;:()[]{{}}"'''), '{_WS}', ' ', 'g') AS name FROM ca),
cc AS (SELECT id, type, name, count(*) AS tf FROM cn WHERE length(name) >= 3 AND name NOT IN ({', '.join(f"'{x}'" for x in NO_NAMES)}) GROUP BY ALL),
ce AS (SELECT id AS chunk_id, type, name, tf, 'entity_' || substr(sha1(type || ':' || name), 1, 16) AS entity_id FROM cc QUALIFY row_number() OVER (PARTITION BY id ORDER BY tf DESC, type, name) <= 16),
en AS (SELECT entity_id, min(name) AS name, min(type) AS type, count(*) AS frequency FROM ce GROUP BY entity_id),
me AS (SELECT chunk_id, entity_id, count(*) AS weight FROM ce GROUP BY ALL),
re AS (SELECT a.entity_id AS from_entity_id, b.entity_id AS to_entity_id, 'CO_OCCURS_WITH' AS relation_type, count(*) AS weight FROM ce a JOIN ce b ON a.chunk_id = b.chunk_id AND a.entity_id < b.entity_id GROUP BY ALL)"""

_CASES = f"""
ck AS (SELECT source_id AS case_id, {_safe('source')} AS case_name, array_to_string(list_filter([{_safe('lang')}, {_safe('source')}], lambda x: x <> ''), '; ') AS citations,
              regexp_extract({_safe('text')}, '{PROSE.date}') AS decision_date, {_safe('text')} AS st FROM ch WHERE chunk_index = 0)"""
_CITED = f"cp AS (SELECT DISTINCT source_id AS case_id, unnest(list_filter([{_safe('lang')}, {_safe('source')}], lambda x: x <> '')) AS citation_text FROM ch), cx AS (SELECT case_id, citation_text, 'citation_' || substr(sha1(citation_text), 1, 16) AS citation_id FROM cp)"

#: tokens of chunks and questions as signed, hashed counts
_SLOT = "CAST(('0x' || substr(md5(t), 1, 8))::BIGINT % 4096 AS INT)"
_SIGN = "CASE WHEN substr(md5(t), 9, 1) >= '8' THEN -1 ELSE 1 END"


def _embedding(name: str, key: str, table: str, text: str) -> str:
    return f"""
{name}0 AS (SELECT {key} AS k, unnest(regexp_extract_all(lower({text}), '[a-zA-Z][a-zA-Z0-9_]{{1,}}')) AS t FROM {table}),
{name}1 AS (SELECT k, {_SLOT} AS idx, CAST(sum({_SIGN}) AS BIGINT) AS w FROM {name}0 GROUP BY ALL HAVING sum({_SIGN}) <> 0),
{name} AS (SELECT k, idx, w, sqrt(CAST(sum(w * w) OVER (PARTITION BY k) AS DOUBLE)) AS norm FROM {name}1)"""


def _terms(text: str, stop) -> str:
    return f"list_filter(regexp_extract_all(lower({text}), '[a-zA-Z][a-zA-Z0-9_]{{1,}}'), lambda t: NOT list_contains({_list(stop)}, t) AND length(t) > 2)"


def _hits(hay: str, needles: str) -> str:
    return f"len(list_filter({needles}, lambda n: contains({hay}, n)))"


_QUESTIONS = "qs AS (SELECT item_id AS q, text AS question FROM benchmark WHERE item_id IS NOT NULL)"
_LEXICAL = f"""qt AS (SELECT q, {_terms('question', FLAT_STOPWORDS)} AS terms FROM qs),
hs AS (SELECT id, lower(concat_ws(' ', text, source, array_to_string([lang, source], ' '))) AS hay FROM ch),
lx AS (SELECT q, id, CASE WHEN len(terms) > 0 THEN {_hits('hay', 'terms')} / len(terms) ELSE 0.0 END AS lexical FROM hs, qt)"""
_HYBRID = f"""{_CHUNKS}, {_QUESTIONS}, {_LEXICAL}, {_embedding('ce', 'id', 'ch', 'text')}, {_embedding('qe', 'q', 'qs', 'question')},
dn AS (SELECT qe.k AS q, ce.k AS id, sum(ce.w * qe.w) / (min(ce.norm) * min(qe.norm)) AS dense FROM ce JOIN qe USING (idx) GROUP BY ALL),
hy AS (SELECT lx.q, lx.id, round(COALESCE(dense, 0.0) + 0.35 * lexical, 9) AS score FROM lx LEFT JOIN dn ON lx.q = dn.q AND lx.id = dn.id),
tk AS (SELECT q, id, score, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS INT) AS rank FROM hy)"""

_ALIASES = "list_concat(" + ", ".join(
    f"CASE WHEN {' OR '.join(f'''contains(low, '{w}')''' for w in [t, *t.split()])} THEN {_list(p)} ELSE [] END" for t, p in PROSE.aliases.items()
) + ", list_transform(regexp_extract_all(question, '" + PROSE.citation_in_question + "'), lambda x: lower(x)))"


def _distinct_in_order(items: str) -> str:
    return f"list_filter({items}, lambda x, i: list_position({items}, x) = i)"


_PREPARED = f"""{_QUESTIONS},
p0 AS (SELECT q, COALESCE(question, '') AS question, lower(COALESCE(question, '')) AS low FROM qs),
p1 AS (SELECT *, {_terms('question', PROSE.stopwords)} AS terms, {_ALIASES} AS ph, list_transform(regexp_extract_all(question, '{PROSE.name_in_question}'), lambda x: lower(x)) AS names FROM p0),
pq AS (SELECT q, question, low, terms, {_distinct_in_order('ph')} AS phrases, names,
              CASE WHEN list_has_any(terms, {_list(PROSE.multi_hop_markers)}) OR contains(low, 'how do') OR contains(low, 'how did') THEN 'multi_hop'
                   WHEN list_has_any(terms, {_list(PROSE.global_markers)}) THEN 'global' ELSE 'local' END AS profile,
              {' OR '.join(f"contains(low, '{m}')" for m in PROSE.community_markers)} AS wants_community FROM p1),
pr AS (SELECT *, CASE profile WHEN 'global' THEN 8 WHEN 'multi_hop' THEN 5 ELSE 2 END AS n_cases, CASE profile WHEN 'global' THEN 2 ELSE 5 END AS n_chunks FROM pq)"""


def _asked(hay: str) -> str:
    return f"CAST({_hits(hay, 'terms')} + 2.5 * {_hits(hay, 'phrases')} + 8.0 * {_hits(hay, 'names')} AS DOUBLE)"


_VERTICES = f"cv AS (SELECT id AS chunk_id, source_id, chunk_index, token_count, {_safe('text')} AS text FROM ch)"
_RANKING = f"""ms AS (SELECT case_id, lower(concat_ws(' ', case_id, case_name, citations, trim(split_part(regexp_replace(regexp_extract(st, '{PROSE.court}'), '{PROSE.months}', chr(1)), chr(1), 1), ' .'), decision_date)) AS meta FROM ck),
hd AS (SELECT case_id, meta, meta || ' ' || lower((SELECT string_agg(text, ' ' ORDER BY chunk_index, chunk_id) FROM cv WHERE source_id = case_id)) AS hay FROM ms),
sk AS (SELECT case_id, meta, hay, list_distinct(regexp_extract_all(hay, '[a-zA-Z][a-zA-Z0-9_]{{1,}}')) AS toks FROM hd),
sc AS (SELECT q, n_cases, case_id, CASE WHEN len(terms) > 0 THEN (2.0 * {_asked('meta')} + len(list_filter(terms, lambda t: list_contains(toks, t))) + 2.5 * {_hits('hay', 'phrases')}
          + CASE WHEN list_has_any(terms, ['criminal', 'appeal']) THEN 1.25 * least({_hits('hay', _list(PROSE.case_markers))}, 5) ELSE 0 END
          + CASE WHEN trim(low) <> '' AND contains(hay, trim(low)) THEN 5.0 ELSE 0 END::DOUBLE + 8.0 * {_hits('meta', 'names')}) / greatest(1, len(terms)) ELSE 0.0 END AS score FROM sk, pr),
rk AS (SELECT q, case_id, score, n_cases, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, case_id) AS INT) AS rank FROM sc WHERE score > 0),
rc AS (SELECT q, case_id, rank, score FROM rk WHERE rank <= n_cases
       UNION ALL SELECT q, (SELECT min(case_id) FROM sk), 1, 0.0 FROM pr WHERE q NOT IN (SELECT q FROM rk))"""
_RANKED = f"{_CHUNKS}, {_CASES}, {_PREPARED}, {_VERTICES}, {_RANKING}"

_CHOOSING = f"""s1 AS (SELECT rc.q, rc.case_id, rc.rank AS case_rank, cv.text, token_count, chunk_id, chunk_index, profile, n_chunks, {_asked('lower(cv.text)')} AS score FROM rc JOIN pr USING (q) JOIN cv ON source_id = rc.case_id),
s2 AS (SELECT *, CASE WHEN profile = 'local' AND row_number() OVER (PARTITION BY q, case_id ORDER BY chunk_index, chunk_id) = 1 THEN 0 WHEN score > 0 THEN 1 ELSE 2 END AS kind FROM s1),
s3 AS (SELECT *, CAST(row_number() OVER (PARTITION BY q, case_id ORDER BY kind, CASE WHEN kind = 1 THEN -score ELSE 0 END, chunk_index, chunk_id) AS INT) AS place FROM s2)"""

_CHOSEN = f"{_RANKED}, {_CHOOSING}"

_SEEDING = f"""z1 AS (SELECT q, entity_id, name, round(CAST(200 AS DOUBLE) * {_asked('name')} * CASE WHEN type IN ('CASE', 'LAW', 'CONCEPT') THEN 1.25 ELSE 1.0 END::DOUBLE + 2 * least(frequency, 20), 4) AS s FROM en, pr),
sd AS (SELECT q, entity_id, name, s / 100 AS score, CAST(row_number() OVER (PARTITION BY q ORDER BY s DESC, entity_id) AS INT) AS seed_rank FROM z1 WHERE s > 10 QUALIFY seed_rank <= 5)"""
_SEEDS = f"{_ENTITIES}, {_PREPARED}, {_CASES}, {_SEEDING}, {_VERTICES}"


def _path(of: str, penalty: str, extra: str) -> str:
    return f"""SELECT q, seed_rank, {extra} mention_rank, chunk_id, full_path AS path, flow, round(round({_asked("lower(full_path || ' ' || text)")} * flow * CAST({penalty} AS DOUBLE), 6), 4) AS score
FROM (SELECT p.*, cv.text, p.path || ' -> ' || p.chunk_id || ' -> ' || COALESCE(ck.case_name, cv.source_id) AS full_path FROM {of} p JOIN cv USING (chunk_id) LEFT JOIN ck ON ck.case_id = cv.source_id) JOIN pr USING (q)"""


_HOPS = """dp AS (SELECT q, seed_rank, 0 AS kind, 0 AS edge_rank, mention_rank, chunk_id, name AS path, greatest(1, weight) AS flow, 0.81::DOUBLE AS hop
    FROM (SELECT *, row_number() OVER (PARTITION BY q, entity_id ORDER BY chunk_id) AS mention_rank FROM me JOIN sd USING (entity_id)) WHERE mention_rank <= 12),
r2 AS (SELECT q, seed_rank, entity_id, name AS seed_name, from_entity_id AS f, to_entity_id AS t, weight, to_entity_id AS other FROM re JOIN sd ON from_entity_id = entity_id
       UNION ALL SELECT q, seed_rank, entity_id, name, from_entity_id, to_entity_id, weight, from_entity_id FROM re JOIN sd ON to_entity_id = entity_id),
r3 AS (SELECT *, row_number() OVER (PARTITION BY q, entity_id ORDER BY f, t) AS edge_rank FROM r2 QUALIFY edge_rank <= 12),
r4 AS (SELECT q, seed_rank, seed_name, edge_rank, other, r3.weight AS ew, me.weight AS mw, chunk_id, row_number() OVER (PARTITION BY q, seed_rank, edge_rank ORDER BY chunk_id) AS mention_rank
       FROM r3 JOIN me ON me.entity_id = other QUALIFY mention_rank <= 8),
ap AS (SELECT * FROM dp UNION ALL SELECT q, seed_rank, 1, edge_rank, mention_rank, chunk_id, seed_name || ' -> ' || en.name, greatest(1, least(ew, mw)), 0.729::DOUBLE FROM r4 JOIN en ON en.entity_id = other)"""


def _greedy(rows: str, budget: int, most: str, fits: str = "") -> str:
    """Rows (q, n in order, tokens, score) that fit: the first always, then each that fits the rest of the budget."""
    room = f"len(a.k) < {most} AND (len(a.k) = 0 OR (a.u + x.u <= {budget}{fits}))"
    return f"""gl AS (SELECT q, max({most}) AS m, list({{'u': CAST(tokens AS BIGINT), 's': CAST(score AS DOUBLE), 'k': [CAST(n AS BIGINT)]}} ORDER BY n) AS l FROM {rows} GROUP BY q),
gf AS (SELECT q, list_reduce(list_prepend({{'u': CAST(0 AS BIGINT), 's': CAST(0 AS DOUBLE), 'k': CAST([] AS BIGINT[])}}, l),
          lambda a, x: CASE WHEN {room.replace(most, 'm', 1)} THEN {{'u': a.u + x.u, 's': x.s, 'k': list_concat(a.k, x.k)}} ELSE a END).k AS k FROM gl),
gk AS (SELECT q, unnest(k) AS n, CAST(unnest(range(1, len(k) + 1)) AS INT) AS place FROM gf)"""


_ANSWERS = """
c1 AS (SELECT conv_id, turn, max(role) AS role, max(text) AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
an AS (SELECT a.conv_id || '-' || a.turn AS question_id, CASE WHEN a.conv_id % 2 = 0 THEN 'even' ELSE 'odd' END AS pipeline, a.text AS ref, b.text AS answer,
              length(a.text) AS prompt_tokens, length(b.text) AS completion_tokens, length(a.text) + length(b.text) AS total_tokens, CAST(a.turn AS DOUBLE) AS latency_ms
       FROM c1 a JOIN c1 b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant')"""
_NW = lambda t: f"list_distinct(list_filter(regexp_extract_all(lower(COALESCE({t}, '')), '[a-zA-Z][a-zA-Z0-9_]{{2,}}'), lambda x: NOT list_contains({_list(SCORE_STOPWORDS)}, x)))"
_SCORED = f"""{_ANSWERS},
s0 AS (SELECT *, {_NW('ref')} AS a, {_NW('answer')} AS b FROM an),
s1 AS (SELECT *, CASE WHEN len(list_intersect(a, b)) > 0 THEN 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) ELSE 0.0 END AS f1 FROM s0),
so AS (SELECT *, trim(COALESCE(answer, '')) <> '' AND NOT contains(lower(answer), 'not available') AND NOT contains(lower(answer), 'insufficient') AND f1 >= 0.22 AS ok FROM s1),
sm AS (SELECT pipeline, count(*) AS questions, avg(total_tokens) AS avg_total_tokens, avg(prompt_tokens) AS avg_prompt_tokens, avg(completion_tokens) AS avg_completion_tokens, avg(latency_ms) AS avg_latency_ms, avg(CAST(ok AS INT)) AS rate FROM so GROUP BY pipeline)"""
_JUDGED = """
dj AS (SELECT doc_id, max(lang) AS pipeline, max(source) AS type FROM documents GROUP BY doc_id),
jd AS (SELECT pipeline, type, quality, toxic, CASE WHEN quality = 1 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM labels JOIN dj USING (doc_id))"""
_REFUSED = " OR ".join(f"contains(lower(text), '{p}')" for p in evaluate.REFUSALS)


def oracle_sql() -> dict[str, str]:
    type_rows = "ty AS (SELECT type, name, entity_id, row_number() OVER (PARTITION BY type ORDER BY frequency DESC, name, entity_id) AS n FROM en)"
    topics = ", ".join(f"('{t}', '{title}', '{note}', {n}, '{term}')" for t, (title, terms, note) in PROSE.topics.items() for n, term in enumerate(terms))
    type_sql = f"SELECT 'community_' || lower(type) AS community_id, CAST(1 AS INT) AS level, {_safe('''type || ' community: ' || string_agg(name, '; ' ORDER BY n) FILTER (WHERE n <= 20)''')} AS summary, string_agg(entity_id, ';' ORDER BY n) AS entity_ids FROM ty WHERE n <= 200 GROUP BY type"
    topic_ctes = f"""tp(community_id, title, note, n, term) AS (VALUES {topics}),
te AS (SELECT name, max_by(frequency, entity_id) AS f, max(entity_id) AS e FROM en GROUP BY name)"""
    topic_sql = f"""SELECT community_id, CAST(2 AS INT) AS level, {_safe('''title || '. Salient extracted concepts: ' || string_agg(term || ' (freq=' || COALESCE(f, 0) || ')', '; ' ORDER BY n) || '. ' || note || ' Use this report for corpus-wide/global synthesis questions.' ''')} AS summary,
COALESCE(string_agg(e, ';' ORDER BY n) FILTER (WHERE e IS NOT NULL), '') AS entity_ids FROM tp LEFT JOIN te ON name = term GROUP BY community_id, title, note"""
    reduction = lambda m, alias: f"round(COALESCE((max({m}) FILTER (WHERE pipeline = 'odd') - max({m}) FILTER (WHERE pipeline = 'even')) / nullif(max({m}) FILTER (WHERE pipeline = 'odd'), 0) * 100, 0.0), 5) AS {alias}"
    marks = r"(?:[\w\p{L}\p{N}\p{M}\p{Pc}]+|[^\s\w\p{L}\p{N}\p{M}\p{Pc}])"
    path_rows = f"""f1 AS (SELECT ap.*, cv.text, cv.source_id AS case_id, cv.chunk_index, COALESCE(ck.case_name, cv.source_id) AS case_name, ap.path || ' -> ' || ap.chunk_id || ' -> ' || COALESCE(ck.case_name, cv.source_id) AS full_path
                   FROM ap JOIN cv USING (chunk_id) LEFT JOIN ck ON ck.case_id = cv.source_id),
            f2 AS (SELECT f1.*, round({_asked("lower(full_path || ' ' || text)")} * flow * hop, 6) AS score FROM f1 JOIN pr USING (q)),
            f3 AS (SELECT *, greatest(1, len(regexp_extract_all('Path score=' || printf('%.4f', score) || ' flow=' || flow || ' hop_penalty=' || printf('%.3f', hop) || chr(10) || full_path || chr(10) || 'Evidence: ' || text, '{marks}'))) AS tokens FROM f2),
            f4 AS (SELECT * FROM f3 QUALIFY row_number() OVER (PARTITION BY q, chunk_id, full_path ORDER BY score DESC, seed_rank, kind, edge_rank, mention_rank) = 1)"""
    report_rows = f"""k1 AS (SELECT q, terms, phrases, names, community_id, level, summary, CASE profile WHEN 'multi_hop' THEN 4 ELSE 3 END AS most,
                          CASE community_id {' '.join(f"WHEN '{c}' THEN {_list(h)}" for c, h in PROSE.hints.items())} ELSE [] END AS hint FROM cr, pr),
            k2 AS (SELECT q, community_id, level, summary, most, {_asked("lower(community_id || ' ' || summary)")} + CASE WHEN starts_with(community_id, 'global_') THEN 2.0 ELSE 0.0 END::DOUBLE
                          + 2.0 * len(list_filter(list_distinct(terms), lambda t: list_contains(hint, t))) AS score FROM k1),
            k3 AS (SELECT *, greatest(1, len(regexp_extract_all('Community report score=' || printf('%.4f', score) || ' level=' || level || ' id=' || community_id || chr(10) || summary, '{marks}'))) AS tokens,
                          row_number() OVER (PARTITION BY q ORDER BY score DESC, level, community_id) AS n FROM k2)"""
    of_path = "'Path score=' || printf('%.4f', score) || ' flow=' || flow || ' hop_penalty=' || printf('%.3f', hop) || chr(10) || full_path || chr(10) || 'Evidence: ' || text"
    of_report = "'Community report score=' || printf('%.4f', score) || ' level=' || level || ' id=' || community_id || chr(10) || summary"
    tokens = lambda text: f"greatest(1, len(regexp_extract_all({text}, '{marks}')))"
    packed = lambda greedy, gk, gl, gf: greedy.replace("gk AS", f"{gk} AS").replace("gl AS", f"{gl} AS").replace("gf AS", f"{gf} AS").replace("FROM gl)", f"FROM {gl})").replace("FROM gf)", f"FROM {gf})")
    lengths = lambda name, table, columns: f"SELECT '{name}' AS table_name, count(*) AS n_rows, CAST(sum({' + '.join(f'length({c})' for c in columns)}) AS BIGINT) AS n_chars FROM {table}"
    court = f"trim(split_part(regexp_replace(regexp_extract(st, '{PROSE.court}'), '{PROSE.months}', chr(1)), chr(1), 1), ' .')"
    digest = lambda name, table, columns: f"SELECT '{name}' AS table_name, count(*) AS n_rows, CAST(COALESCE(sum(CAST(('0x' || substr(md5(concat_ws('|', {', '.join(columns)})), 1, 8)) AS BIGINT)), 0) AS BIGINT) AS digest FROM {table}"
    digests = f"""WITH {_ENTITIES}, {_CITED}, {_CASES}, {type_rows}, {topic_ctes},
            nx AS (SELECT * FROM (SELECT id AS a, lead(id) OVER (PARTITION BY source_id ORDER BY chunk_index) AS b FROM ch) WHERE b IS NOT NULL), cl AS (SELECT DISTINCT citation_id, citation_text FROM cx), ce2 AS (SELECT DISTINCT case_id, citation_id FROM cx),
            cr AS ({type_sql} UNION ALL {topic_sql}), cz AS (SELECT case_id, case_name, citations, {court} AS court, decision_date FROM ck), {_VERTICES}
            {' UNION ALL '.join(digest(*x) for x in [("legal_cases", "cz", ["case_id", "case_name", "citations", "court", "decision_date"]), ("chunks", "cv", ["chunk_id", "source_id", "chunk_index", "token_count", "text"]), ("citations", "cl", ["citation_id", "citation_text"]), ("has_chunk", "ch", ["source_id", "id"]), ("next_chunk", "nx", ["a", "b"]), ("cites", "ce2", ["case_id", "citation_id"]), ("entities", "en", ["entity_id", "name", "type", "frequency"]), ("mentions", "me", ["chunk_id", "entity_id", "weight"]), ("related_to", "re", ["from_entity_id", "to_entity_id", "relation_type", "weight"]), ("community_reports", "cr", ["community_id", "level", "summary", "entity_ids"])])}"""
    own = {
        "graph_digests": digests, "graph_by_loads": digests, "graph_by_stream": digests,
        "clean_text_fast": f"SELECT page_id, {_collapse('''CASE WHEN contains(h, '<') AND contains(h, '>') THEN regexp_replace(h, '<[^>]*>', ' ', 'g') ELSE h END''')} AS text FROM (SELECT page_id, COALESCE(html, '') AS h FROM pages)",
        "token_counts_by_mode": f"SELECT doc_id, len({_words('t')}) AS n_ws, greatest(1, len(regexp_extract_all(t, '{marks}'))) AS n_words_and_marks FROM (SELECT doc_id, COALESCE(text, '') AS t FROM documents)",
        "choose_text_field": f"SELECT doc_id, 'r.body.text' AS path, length({_collapse('text')}) AS n_chars FROM documents WHERE length({_collapse('text')}) >= 500",
        "variant_fields": """WITH d AS (SELECT doc_id, lang, source, list_slice(string_split(text, chr(10)), 1, 20) AS l FROM documents),
            f AS (SELECT doc_id, list_concat(COALESCE(list_transform(l, lambda x, i: 'r.body.' || (i - 1) || '.t=' || x), []), list_filter(['r.by.' || COALESCE(source, 'none') || '=' || lang, 'r.meta.lang=' || lang, 'r.meta.tags.0=' || source, 'r.meta.tags.1=' || lang], lambda x: x IS NOT NULL)) AS f FROM d)
            SELECT doc_id, CAST(len(f) AS INT) AS n_fields, md5(array_to_string(f, '|')) AS digest FROM f""",
        "sample_half": f"WITH {_CHUNKS.strip()} SELECT source_id AS id FROM op QUALIFY row_number() OVER (ORDER BY md5(source_id || ':7'), source_id) <= (SELECT count(*) // 2 FROM op)",
        "take_until_tokens": f"WITH {_CHUNKS.strip()} SELECT record_index, token_count FROM (SELECT record_index, len(w) AS token_count, COALESCE(sum(len(w)) OVER (ORDER BY record_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM op) WHERE b < 200000",
        "corpus_report": f"WITH {_CHUNKS.strip()} SELECT CAST(COALESCE(sum(len(w)), 0) AS BIGINT) AS total_tokens, count(*) AS written_records, COALESCE(max(record_index), 0) AS scanned_records, COALESCE(max(record_index), 0) - count(*) AS skipped_records, COALESCE(sum(len(w)), 0) >= 2000000 AS enough FROM op WHERE length(text) >= 500",
        "sample_n": f"WITH {_CHUNKS.strip()} SELECT source_id AS id FROM op ORDER BY md5(source_id || ':42'), source_id LIMIT 50",
        "safe_text": f"SELECT doc_id, md5({_safe('text')}) AS digest FROM documents",
        "chunk_windows": f"WITH {_CHUNKS} SELECT id, source_id, chunk_index, token_start, token_end, token_count FROM ch",
        "stream_chunks": f"WITH {_CHUNKS} SELECT id, source_id, chunk_index, token_start, token_end, token_count FROM ch",
        "chunk_report": f"WITH {_CHUNKS} SELECT (SELECT count(*) FROM op WHERE len(w) > 0) AS documents, count(*) AS chunks, (SELECT CAST(sum(len(w)) AS BIGINT) FROM op) AS input_tokens, CAST(sum(token_count) AS BIGINT) AS chunked_tokens, (SELECT sum(len(w)) FROM op) >= 2000000 AS enough FROM ch",
        "case_table": f"WITH {_CHUNKS}, {_CASES} SELECT case_id, case_name, citations, {court} AS court, decision_date FROM ck",
        "compact_metadata": "SELECT doc_id AS id, source AS case_name, lang AS court, CASE WHEN length(text) >= 500 THEN 'text' END AS selected_text_field FROM documents",
        "dedup_vertices": "SELECT source, lang, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY lang NULLS FIRST, doc_id NULLS FIRST) = 1",
        "jsonl_round_trip": "SELECT doc_id, lang, md5(text) AS digest FROM documents WHERE COALESCE(text, '') <> ''",
        "questions_round_trip": "SELECT COALESCE(CASE WHEN item_id % 3 > 0 THEN CAST(item_id AS VARCHAR) END, printf('q%03d', row_number() OVER (PARTITION BY item_id % 20 ORDER BY item_id))) AS id, md5(text) AS digest FROM benchmark WHERE item_id IS NOT NULL",
        "report_round_trip": f"WITH {_CHUNKS.strip()} SELECT CAST(COALESCE(sum(len(w)), 0) AS BIGINT) AS total_tokens, count(*) AS written_records, COALESCE(max(record_index), 0) AS scanned_records, COALESCE(max(record_index), 0) - count(*) AS skipped_records, COALESCE(sum(len(w)), 0) >= 2000000 AS enough FROM op WHERE length(text) >= 500",
        "graph_round_trip": f"""WITH {_ENTITIES}, {_CITED}, {_CASES}, {type_rows}, {topic_ctes},
            nx AS (SELECT * FROM (SELECT id AS a, lead(id) OVER (PARTITION BY source_id ORDER BY chunk_index) AS b FROM ch) WHERE b IS NOT NULL), cl AS (SELECT DISTINCT citation_id, citation_text FROM cx), ce2 AS (SELECT DISTINCT case_id, citation_id FROM cx),
            cr AS ({type_sql} UNION ALL {topic_sql}), cz AS (SELECT case_id, case_name, citations, decision_date, {court} AS court FROM ck), cv AS (SELECT id, source_id, {_safe('text')} AS text FROM ch)
            {' UNION ALL '.join(lengths(*x) for x in [("legal_cases", "cz", ["case_id", "case_name", "citations", "court", "decision_date"]), ("chunks", "cv", ["id", "source_id", "text"]), ("citations", "cl", ["citation_id", "citation_text"]), ("has_chunk", "ch", ["source_id", "id"]), ("next_chunk", "nx", ["a", "b"]), ("cites", "ce2", ["case_id", "citation_id"]), ("entities", "en", ["entity_id", "name", "type"]), ("mentions", "me", ["chunk_id", "entity_id"]), ("related_to", "re", ["from_entity_id", "to_entity_id", "relation_type"]), ("community_reports", "cr", ["community_id", "summary", "entity_ids"])])}""",
        "built_index": f"WITH {_CHUNKS}, {_embedding('ce', 'id', 'ch', 'text')} SELECT count(*) AS entries, count(DISTINCT k) AS vectors, CAST(sum(w) AS BIGINT) AS sum_w, CAST(sum(idx * w) AS BIGINT) AS check_sum, 'hashing-md5' AS provider, CAST(4096 AS BIGINT) AS dims, (SELECT count(*) FROM ch) AS chunks FROM ce",
        "chunk_vertices": f"WITH {_CHUNKS} SELECT id AS chunk_id, source_id, chunk_index, token_count, CAST(length({_safe('text')}) AS INT) AS n_chars FROM ch",
        "has_chunk": f"WITH {_CHUNKS} SELECT source_id AS case_id, id AS chunk_id FROM ch",
        "next_chunk": f"WITH {_CHUNKS} SELECT * FROM (SELECT id AS from_chunk_id, lead(id) OVER (PARTITION BY source_id ORDER BY chunk_index) AS to_chunk_id FROM ch) WHERE to_chunk_id IS NOT NULL",
        "citations": f"WITH {_CHUNKS}, {_CITED} SELECT DISTINCT citation_id, citation_text FROM cx",
        "cites": f"WITH {_CHUNKS}, {_CITED} SELECT DISTINCT case_id, citation_id FROM cx",
        "entities": f"WITH {_ENTITIES} SELECT entity_id, name, type, frequency FROM en",
        "mentions": f"WITH {_ENTITIES} SELECT chunk_id, entity_id, weight FROM me",
        "related_to": f"WITH {_ENTITIES} SELECT * FROM re",
        "type_communities": f"WITH {_ENTITIES}, {type_rows} {type_sql}",
        "topic_communities": f"WITH {_ENTITIES}, {topic_ctes} {topic_sql}",
        "graph_report": f"""WITH {_ENTITIES}, {_CITED}, {_CASES}
            SELECT 'legal_cases' AS table_name, count(*) AS n_rows FROM ck UNION ALL SELECT 'chunks', count(*) FROM ch UNION ALL SELECT 'citations', count(DISTINCT citation_id) FROM cx
            UNION ALL SELECT 'has_chunk', count(*) FROM ch UNION ALL SELECT 'next_chunk', (SELECT count(*) FROM ch) - (SELECT count(*) FROM ck) UNION ALL SELECT 'cites', count(*) FROM (SELECT DISTINCT case_id, citation_id FROM cx)
            UNION ALL SELECT 'entities', count(*) FROM en UNION ALL SELECT 'mentions', count(*) FROM me UNION ALL SELECT 'related_to', count(*) FROM re
            UNION ALL SELECT 'community_reports', count(DISTINCT type) + {len(PROSE.topics)} FROM en""",
        "hashed_embedding": f"WITH {_CHUNKS}, {_embedding('ce', 'id', 'ch', 'text')} SELECT k AS id, count(*) AS n_dims, CAST(sum(w) AS BIGINT) AS sum_w, CAST(sum(idx * w) AS BIGINT) AS check_sum, round(max(norm), 6) AS norm FROM ce GROUP BY k",
        "lexical_scores": f"WITH {_CHUNKS}, {_QUESTIONS}, {_LEXICAL} SELECT q, count(*) AS n, round(sum(round(lexical, 9)), 5) AS total, round(max(lexical), 6) AS best FROM lx GROUP BY q",
        "sparse_scores": f"WITH {_HYBRID} SELECT q, count(*) AS n, round(sum(round(dense, 9)), 5) AS total, round(max(dense), 6) AS best FROM dn GROUP BY q",
        "sparse_topk": f"""WITH {_HYBRID}, sr AS (SELECT q, id, round(dense, 9) AS score FROM dn),
st AS (SELECT q, id, score, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS INT) AS rank FROM sr WHERE score > 0) SELECT q, rank, id, round(score, 6) AS score FROM st WHERE rank <= 8""",
        "hybrid_topk": f"WITH {_HYBRID} SELECT q, rank, id, round(score, 6) AS score FROM tk WHERE rank <= 8",
        "prompts": f"""WITH {_HYBRID} SELECT q, 'Context:' || chr(10) || string_agg('[Chunk ' || rank || ' | score=' || printf('%.4f', score) || ' | case=' || source || ' | citations=' || lang || ', ' || source || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY rank)
            || chr(10) || chr(10) || 'Question: ' || question AS prompt FROM tk JOIN ch USING (id) JOIN qs USING (q) WHERE rank <= 8 GROUP BY q, question""",
        "l2_normalize": "SELECT vec_id, round(sqrt(list_sum(list_transform(e, lambda x: x * x))) / CASE WHEN n = 0 THEN 1 ELSE n END, 6) AS length, round(e[1] / CASE WHEN n = 0 THEN 1 ELSE n END, 6) AS first FROM (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings))",
        "dense_topk": """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL), s AS (SELECT a.vec_id AS q, b.vec_id, list_cosine_similarity(a.e, b.e) AS s FROM v a, v b WHERE a.vec_id % 100 = 0)
            SELECT q, vec_id, CAST(row_number() OVER (PARTITION BY q ORDER BY round(s, 12) DESC, vec_id) AS INT) AS rank FROM s QUALIFY rank <= 5""",
        "route": f"WITH {_PREPARED} SELECT q, profile, n_cases, n_chunks, wants_community FROM pr",
        "expand_phrases": f"WITH {_PREPARED} SELECT q, CAST(len(terms) AS INT) AS n_terms, array_to_string(phrases, ';') AS phrases FROM pr",
        "rank_cases": f"WITH {_RANKED} SELECT q, case_id, rank, round(score, 6) AS score FROM rc",
        "select_chunks": f"WITH {_CHOSEN} SELECT q, case_id, chunk_id, place, CAST(score AS DOUBLE) AS score FROM s3 WHERE place <= n_chunks",
        "case_citations": f"WITH {_CHUNKS}, {_CITED} SELECT case_id, string_agg(citation_text, ';' ORDER BY citation_id) AS citations FROM (SELECT DISTINCT * FROM cx) GROUP BY case_id",
        "case_context": f"""WITH {_CHUNKS}, {_CITED} SELECT source_id AS case_id, 'chunk' AS role, id, CAST(row_number() OVER (PARTITION BY source_id ORDER BY chunk_index, id) AS INT) AS place FROM ch QUALIFY place <= 8
            UNION ALL SELECT case_id, 'citation', citation_id, CAST(row_number() OVER (PARTITION BY case_id ORDER BY citation_id) AS INT) FROM (SELECT DISTINCT case_id, citation_id FROM cx)""",
        "entity_context": f"""WITH {_ENTITIES}, kw AS (SELECT DISTINCT lower(lang) AS keyword FROM documents WHERE lang IS NOT NULL),
            sd AS (SELECT keyword, entity_id AS id FROM en, kw WHERE contains(name, keyword) QUALIFY row_number() OVER (PARTITION BY keyword ORDER BY entity_id) <= 5),
            nr AS (SELECT keyword, id FROM (SELECT DISTINCT keyword, to_entity_id AS id FROM re JOIN sd ON from_entity_id = sd.id) QUALIFY row_number() OVER (PARTITION BY keyword ORDER BY id) <= 5)
            SELECT keyword, 'entity' AS role, id FROM sd UNION ALL SELECT keyword, 'related_entity', id FROM nr
            UNION ALL SELECT keyword, 'chunk', id FROM (SELECT keyword, id FROM (SELECT DISTINCT keyword, chunk_id AS id FROM me JOIN sd ON entity_id = sd.id) QUALIFY row_number() OVER (PARTITION BY keyword ORDER BY id) <= 8)
            UNION ALL SELECT keyword, 'related_chunk', id FROM (SELECT keyword, id FROM (SELECT DISTINCT keyword, chunk_id AS id FROM me JOIN nr ON entity_id = nr.id) QUALIFY row_number() OVER (PARTITION BY keyword ORDER BY id) <= 8)""",
        "seed_entities": f"WITH {_SEEDS} SELECT q, entity_id, seed_rank, round(score, 4) AS score FROM sd",
        "direct_paths": f"""WITH {_SEEDS}, dp AS (SELECT q, seed_rank, chunk_id, name AS path, greatest(1, weight) AS flow, CAST(row_number() OVER (PARTITION BY q, entity_id ORDER BY chunk_id) AS INT) AS mention_rank FROM me JOIN sd USING (entity_id) QUALIFY mention_rank <= 12)
            {_path('dp', '0.81', '')}""",
        "related_paths": f"""WITH {_SEEDS}, r1 AS (SELECT from_entity_id AS f, to_entity_id AS t, weight FROM re),
            r2 AS (SELECT q, seed_rank, entity_id, name AS seed_name, f, t, weight, t AS other FROM r1 JOIN sd ON f = entity_id UNION ALL SELECT q, seed_rank, entity_id, name, f, t, weight, f FROM r1 JOIN sd ON t = entity_id),
            r3 AS (SELECT *, CAST(row_number() OVER (PARTITION BY q, entity_id ORDER BY f, t) AS INT) AS edge_rank FROM r2 QUALIFY edge_rank <= 12),
            r4 AS (SELECT q, seed_rank, seed_name, edge_rank, other, r3.weight AS ew, me.weight AS mw, chunk_id, CAST(row_number() OVER (PARTITION BY q, seed_rank, edge_rank ORDER BY chunk_id) AS INT) AS mention_rank FROM r3 JOIN me ON me.entity_id = other QUALIFY mention_rank <= 8),
            rp AS (SELECT q, seed_rank, edge_rank, mention_rank, chunk_id, seed_name || ' -> ' || en.name AS path, greatest(1, least(ew, mw)) AS flow FROM r4 JOIN en ON en.entity_id = other)
            {_path('rp', '0.729', 'edge_rank,')}""",
        "prune_paths": f"""WITH {_SEEDS}, {_HOPS},
            {path_rows},
            f5 AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, seed_rank, kind, edge_rank, mention_rank) AS n FROM f4), {_greedy('f5', 2200, '7')}
            SELECT q, place, score, flow, hop AS hop_penalty, full_path AS path, case_id, case_name, chunk_id, chunk_index, CAST(tokens AS INT) AS tokens FROM gk JOIN f5 USING (q, n)""",
        "select_communities": f"""WITH {_ENTITIES}, {_PREPARED}, {type_rows}, {topic_ctes}, cr AS ({type_sql} UNION ALL {topic_sql}),
            {report_rows}, {_greedy('k3', 900, 'most', ' AND x.s > 0')}
            SELECT q, place, community_id, level, CAST(score AS DOUBLE) AS score, CAST(tokens AS INT) AS tokens FROM gk JOIN k3 USING (q, n)""",
        "graph_context": f"""WITH {_ENTITIES}, {_CITED}, {_CASES}, {_PREPARED}, {_VERTICES}, {_RANKING}, {_CHOOSING},
            mq AS (SELECT * FROM pr WHERE profile = 'multi_hop'), z0 AS (SELECT 1), {_SEEDING.replace("FROM en, pr)", "FROM en, mq pr)")}, {_HOPS}, {path_rows},
            f5 AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, seed_rank, kind, edge_rank, mention_rank) AS n FROM f4), {packed(_greedy('f5', 2200, '7'), 'pk', 'pl', 'pf')},
            pb AS (SELECT q, string_agg({of_path}, chr(10) || chr(10) ORDER BY place) AS b FROM pk JOIN f5 USING (q, n) GROUP BY q),
            {type_rows}, {topic_ctes}, cr AS ({type_sql} UNION ALL {topic_sql}), {report_rows.replace("FROM cr, pr)", "FROM cr, pr WHERE profile = 'global' OR profile = 'multi_hop' AND wants_community)")},
            {packed(_greedy('k3', 1000, 'most', ' AND x.s > 0'), 'ck2', 'cl2', 'cf2')},
            cb AS (SELECT q, string_agg({of_report}, chr(10) || chr(10) ORDER BY place) AS b FROM ck2 JOIN k3 USING (q, n) GROUP BY q),
            ctd AS (SELECT case_id, string_agg(citation_text, '; ' ORDER BY citation_id) AS cited FROM (SELECT DISTINCT * FROM cx) GROUP BY case_id),
            cas AS (SELECT case_id, CASE WHEN case_name <> '' THEN case_name ELSE case_id END AS case_name, CASE WHEN citations <> '' THEN citations ELSE COALESCE(cited, '') END AS told,
                           COALESCE(nullif({court}, ''), 'unknown') AS court, COALESCE(nullif(decision_date, ''), 'unknown') AS decision_date FROM ck LEFT JOIN ctd USING (case_id)),
            sel AS (SELECT * FROM s3 WHERE place <= n_chunks),
            bl AS (SELECT q, case_rank, chunk_index, chunk_id, 'Case: ' || case_name || chr(10) || 'Case ID: ' || case_id || chr(10) || 'Court: ' || court || chr(10) || 'Decision Date: ' || decision_date || chr(10) || 'Citations: ' || told
                          || chr(10) || 'Chunk: ' || chunk_index || ' | token_count=' || token_count || chr(10) || trim(text) AS block FROM sel JOIN cas USING (case_id) WHERE trim(text) <> ''),
            kb AS (SELECT q, list({{'u': CAST({tokens('block')} AS BIGINT), 'k': [block]}} ORDER BY case_rank, chunk_index, chunk_id) AS l FROM bl GROUP BY q),
            u1 AS (SELECT q, profile, cb.b AS c, pb.b AS p, COALESCE({tokens('cb.b')}, 0) AS ct, COALESCE({tokens('pb.b')}, 0) AS pt, l FROM pr LEFT JOIN cb USING (q) LEFT JOIN pb USING (q) LEFT JOIN kb USING (q)),
            u2 AS (SELECT *, c IS NOT NULL AND ct <= 2200 AS use_c, CASE WHEN c IS NOT NULL AND ct <= 2200 THEN ct ELSE 0 END AS t1 FROM u1),
            u3 AS (SELECT *, p IS NOT NULL AND t1 + pt <= 2200 AS use_p FROM u2),
            u4 AS (SELECT q, profile, list_reduce(list_prepend({{'u': CAST(t1 + CASE WHEN use_p THEN pt ELSE 0 END AS BIGINT),
                          'k': list_filter([CASE WHEN use_c THEN 'Corpus community reports:' || chr(10) || c END, CASE WHEN use_p THEN 'Structured graph paths:' || chr(10) || p END], lambda x: x IS NOT NULL)}}, COALESCE(l, [])),
                          lambda a, x: CASE WHEN a.u + x.u <= 2200 OR len(a.k) = 0 THEN {{'u': a.u + x.u, 'k': list_concat(a.k, x.k)}} ELSE a END) AS f FROM u3),
            ids AS (SELECT q, (SELECT string_agg(c, ';' ORDER BY c) FROM (SELECT DISTINCT case_id AS c FROM sel b WHERE b.q = a.q)) AS case_ids, string_agg(chunk_id, ';' ORDER BY case_rank, chunk_index, chunk_id) AS chunk_ids FROM sel a GROUP BY q)
            SELECT q, profile, array_to_string(f.k, chr(10) || chr(10) || '---' || chr(10) || chr(10)) AS context, CAST(len(f.k) AS INT) AS n_blocks, f.u AS used_tokens, case_ids, chunk_ids FROM u4 LEFT JOIN ids USING (q)""",
        "lexical_f1": f"WITH {_SCORED} SELECT question_id, round(f1, 6) AS lexical_f1, ok AS heuristic_pass FROM so",
        "summarize": f"WITH {_SCORED} SELECT pipeline, questions, round(avg_total_tokens, 4) AS avg_total_tokens, round(avg_prompt_tokens, 4) AS avg_prompt_tokens, round(avg_completion_tokens, 4) AS avg_completion_tokens, round(avg_latency_ms, 4) AS avg_latency_ms, round(rate, 6) AS heuristic_pass_rate FROM sm",
        "compare_pipelines": f"WITH {_SCORED} SELECT {reduction('avg_total_tokens', 'token_reduction_pct')}, {reduction('avg_latency_ms', 'latency_reduction_pct')} FROM sm",
        "per_question": f"WITH {_ANSWERS} SELECT question_id, CAST(max(total_tokens) FILTER (WHERE pipeline = 'even') AS INT) AS even_total_tokens, CAST(max(total_tokens) FILTER (WHERE pipeline = 'odd') AS INT) AS odd_total_tokens, max(replace(substr(COALESCE(answer, ''), 1, 180), chr(10), ' ')) AS preview FROM an GROUP BY question_id",
        "coverage": f"WITH {_ANSWERS} SELECT count(*) AS n, count(*) FILTER (WHERE latency_ms <> 0) AS n_with, count(*) = count(*) FILTER (WHERE latency_ms <> 0) AS all_rows, min_by(CAST(CAST(latency_ms AS BIGINT) AS VARCHAR), question_id) FILTER (WHERE latency_ms <> 0) AS first_value FROM an",
        "judge_summary": f"WITH {_JUDGED} SELECT pipeline, count(*) FILTER (WHERE verdict = 'PASS') AS pass_count, round(avg(CAST(verdict = 'PASS' AS INT)), 6) AS pass_rate, avg(CAST(verdict = 'PASS' AS INT)) >= 0.9 AS judge_goal_met FROM jd GROUP BY pipeline",
        "accuracy_table": f"""WITH {_JUDGED} SELECT pipeline, count(*) FILTER (WHERE verdict = 'PASS') AS pass_count, round(avg(CAST(verdict = 'PASS' AS INT)), 6) AS pass_rate,
            CASE WHEN pipeline <> 'es' THEN round(avg(quality), 6) END AS f1_raw, CASE WHEN pipeline <> 'es' THEN round(avg(1 - toxic), 6) END AS f1_rescaled,
            CASE WHEN pipeline <> 'es' THEN avg(quality) >= 0.88 END AS raw_goal_met, CASE WHEN pipeline <> 'es' THEN avg(1 - toxic) >= 0.55 END AS rescaled_goal_met FROM jd GROUP BY pipeline""",
        "breakdown": f"WITH {_JUDGED} SELECT CASE WHEN grouping(pipeline) = 1 THEN 'all' ELSE pipeline END AS pipeline, CASE WHEN grouping(type) = 1 THEN 'all' ELSE type END AS question_type, count(*) FILTER (WHERE verdict = 'PASS') AS passed, count(*) AS n, round(avg(CAST(verdict = 'PASS' AS INT)), 6) AS pass_rate FROM jd GROUP BY ROLLUP (pipeline, type)",
        "compute_cost": "SELECT event_id, round(COALESCE(CAST(round(value * 100) AS BIGINT), 0) / 1000000 * CASE event_type WHEN 'click' THEN 0.1 WHEN 'view' THEN 0.15 ELSE 0.1 END::DOUBLE + (event_id % 97) / 1000000 * CASE event_type WHEN 'click' THEN 0.4 WHEN 'view' THEN 0.6 ELSE 0.4 END::DOUBLE, 8) AS cost_usd FROM events",
        "fill_usage": f"WITH {_ANSWERS}, fu AS (SELECT question_id, CASE WHEN latency_ms > 0 AND prompt_tokens > 0 THEN prompt_tokens ELSE greatest(1, len(regexp_extract_all(COALESCE(ref, ''), '{marks}'))) END AS p, greatest(1, len(regexp_extract_all(COALESCE(answer, ''), '{marks}'))) AS c FROM an) SELECT question_id, CAST(p AS BIGINT) AS prompt_tokens, CAST(p + c AS BIGINT) AS total_tokens FROM fu",
        "refusal_verdict": f"SELECT conv_id, turn, CASE WHEN trim(COALESCE(text, '')) = '' OR {_REFUSED} THEN 'FAIL' ELSE 'PASS' END AS verdict, CASE WHEN trim(COALESCE(text, '')) <> '' AND contains(upper(role), 'PASS') THEN 'PASS' ELSE 'FAIL' END AS parsed FROM conversations",
        "match_questions": """WITH lv AS (SELECT lang AS pipeline, unnest(string_split(text, chr(10))) AS question FROM documents UNION ALL SELECT 'en', '  ' || text || ' ' FROM benchmark),
            kn AS (SELECT lower(trim(text)) AS t, min(item_id) AS question_id FROM benchmark GROUP BY ALL),
            mt AS (SELECT pipeline, question_id FROM lv LEFT JOIN kn ON lower(trim(question)) = t)
            SELECT pipeline, question_id, CASE WHEN question_id IS NOT NULL THEN CASE WHEN pipeline = 'en' AND question_id % 2 = 0 THEN 'PASS' WHEN pipeline = 'fr' THEN 'PASS' ELSE 'N/A' END END AS verdict, count(*) AS n FROM mt GROUP BY ALL""",
        "missing_questions": "SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)",
        "replace_rows": "SELECT doc_id AS question_id, CAST(CASE WHEN doc_id % 3 = 0 THEN 9 ELSE quality END AS INT) AS v FROM labels",
    }
    return own | {"stored_direct_paths": own["direct_paths"], "stored_related_paths": own["related_paths"]}
