"""SQL for DuckDB of what pages show: tokens with their places, highlights, snippets, responses and suggestions.

Texts are taken apart into characters, so that marks are put around them one by one.
"""

from __future__ import annotations

from plumbline.oracle import BATCH, BUCKET, CUR, DECADE, EXPAND, FACETS, REQ, SPACE, _broken, _page, _ranked, osa, search
from plumbline.oracle import SQL as OTHERS
from plumbline.queries import RESPONSES, SEARCHES

_ESCAPE = """replace(replace(replace(replace(replace(c.ch, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')"""

#: The tokens of ``rows_(k, x)`` with their places.
TOKENS_AT = r"""chars AS (SELECT k, i, substr(x, i + 1, 1) AS ch FROM (SELECT k, x, unnest(range(length(x))) AS i FROM rows_)),
folded AS (SELECT *, replace(replace(translate(lower(strip_accents(ch)), 'øłđ', 'old'), 'ß', 'ss'), 'æ', 'ae') AS f FROM chars),
kinds AS (SELECT *, CASE WHEN ch IN ('''', '’', 'ʼ') THEN 'join' WHEN regexp_matches(ch, '\p{M}') THEN 'mark' WHEN regexp_matches(f, '^[\p{L}\p{N}]+$') THEN 'part' ELSE 'stop' END AS kind,
  regexp_matches(ch, '\p{Ll}') AS low, regexp_matches(ch, '\p{Lu}') AS high FROM folded),
before AS (SELECT *, lag(kind) OVER w AS last_kind, lag(low) OVER w AS last_low FROM kinds WHERE kind IN ('part', 'stop') WINDOW w AS (PARTITION BY k ORDER BY i)),
begun_at AS (SELECT a.k, a.i, a.f, a.kind, coalesce(b.kind = 'part' AND (b.last_kind IS DISTINCT FROM 'part' OR (b.last_low AND b.high)), false) AS new, b.kind AS own
  FROM kinds a LEFT JOIN before b USING (k, i) WHERE a.kind <> 'join'),
numbered AS (SELECT *, sum(new::INT) OVER w AS t, last_value(own IGNORE NULLS) OVER w AS state FROM begun_at WINDOW w AS (PARTITION BY k ORDER BY i ROWS UNBOUNDED PRECEDING)),
token_at AS MATERIALIZED (SELECT k, t, string_agg(f, '' ORDER BY i) FILTER (kind = 'part') AS term, min(i) AS s, max(i) + 1 AS e FROM numbered WHERE state = 'part' GROUP BY k, t)"""

_PAGE = "SELECT doc_ord FROM ranked WHERE rank < 100"
_MARKED = f"""words_of AS (SELECT doc_ord AS k, term, min(idx) AS word FROM ({_PAGE}) CROSS JOIN (SELECT DISTINCT idx, term FROM capped) SEMI JOIN tok USING (doc_ord, term) GROUP BY ALL),
{TOKENS_AT},
marks AS MATERIALIZED (SELECT k, t, s, e, word FROM token_at JOIN words_of USING (k, term)),
shown AS (SELECT c.k, c.i, c.ch, CASE WHEN m.s IS NOT NULL THEN '<mark>' ELSE '' END || {_ESCAPE} || CASE WHEN n.e IS NOT NULL THEN '</mark>' ELSE '' END AS out
  FROM chars c LEFT JOIN marks m ON m.k = c.k AND m.s = c.i LEFT JOIN marks n ON n.k = c.k AND n.e = c.i + 1),
level AS (SELECT k, CASE WHEN count(DISTINCT word) >= 3 THEN 'full' ELSE 'partial' END AS level FROM marks GROUP BY k)"""

_AGAIN = EXPAND
for _old, _new in (
    ("rough AS", "rough2 AS"), ("FROM rough WHERE", "FROM rough2 WHERE"), ("begun AS", "begun2 AS"), ("FROM begun ", "FROM begun2 "), ("near AS", "near2 AS"), ("FROM near ", "FROM near2 "), ("cands AS", "cands2 AS"),
    ("SELECT q.*", "SELECT p.*"), ("FROM q JOIN", "FROM (SELECT DISTINCT 0 AS idx, word, k, prefix FROM parts) p JOIN"),
):
    _AGAIN = _AGAIN.replace(_old, _new)

#: The queries that are tried for requests without hits, in their order, and which of them have hits.
_NO_HITS = f"""WITH {BATCH},
asks AS (SELECT request_id, list(word ORDER BY word_idx) AS w FROM words WHERE request_id NOT IN (SELECT request_id FROM asked SEMI JOIN capped USING (idx))
  AND request_id NOT IN (SELECT request_id FROM (SELECT request_id, unnest(flatten(list_filter(facet_filters, lambda g: g IS NOT NULL))) AS x FROM req) WHERE strpos(x, ':') > 1) GROUP BY request_id),
each AS (SELECT request_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM asks),
r AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY distance, df DESC, term) AS place FROM
  (SELECT word, term, df, {osa("word", "term")} AS distance FROM (SELECT DISTINCT word FROM each) JOIN terms ON abs(length(word) - length(term)) <= 2 AND word <> term AND damerau_levenshtein(word, term) <= 2)
  WHERE distance <= CASE WHEN length(word) >= 4 THEN 2 ELSE 1 END),
others AS (SELECT word, list(term ORDER BY place) AS alt FROM r WHERE place <= 4 GROUP BY word),
looked AS (SELECT e.*, coalesce(alt, []) AS alt, word IN (SELECT term FROM terms) AS known FROM each e LEFT JOIN others USING (word)),
whole AS (SELECT request_id, list(word ORDER BY i) AS w, list(CASE WHEN known THEN word ELSE coalesce(alt[1], word) END ORDER BY i) AS base, bool_or(NOT known) AS odd FROM looked GROUP BY request_id),
vary AS (SELECT request_id, i, alt, w, CASE WHEN odd THEN base ELSE w END AS b FROM looked JOIN whole USING (request_id) WHERE NOT odd OR NOT known),
tried AS (
  SELECT request_id, 0 AS phase, 0 AS i, 0 AS n, array_to_string(base, ' ') AS text FROM whole WHERE odd
  UNION ALL SELECT request_id, 1, i, n, array_to_string(b[:i - 1] || [alt[n]] || b[i + 1:], ' ') FROM (SELECT *, unnest(range(1, len(alt) + 1)) AS n FROM vary)
  UNION ALL SELECT request_id, 2, i, 0, array_to_string(w[:i - 1] || w[i + 1:], ' ') FROM vary WHERE len(w) > 1),
once AS (SELECT request_id, text, row_number() OVER (PARTITION BY request_id ORDER BY min(phase * 1000000 + i * 1000 + n)) AS o FROM tried GROUP BY request_id, text),
left_ AS (SELECT request_id, text, o FROM once JOIN whole USING (request_id) WHERE o <= 24 AND text <> array_to_string(w, ' ')),
parts AS (SELECT text, w[j] AS word, CASE WHEN length(w[j]) < 4 THEN 0 WHEN length(w[j]) < 8 THEN 1 ELSE 2 END AS k, j = len(w) AS prefix
  FROM (SELECT text, string_split(text, ' ') AS w, unnest(range(1, len(string_split(text, ' ')) + 1)) AS j FROM (SELECT DISTINCT text FROM left_))),
{_AGAIN},
good AS (SELECT DISTINCT text FROM parts SEMI JOIN cands2 USING (word, k, prefix)),
placed AS (SELECT request_id, text, row_number() OVER (PARTITION BY request_id ORDER BY o) - 1 AS place FROM left_ SEMI JOIN good USING (text))"""


def _encoded(text: str) -> str:
    """Percent-encoding that leaves what a query's value may keep."""
    out = f"url_encode({text})"
    for code, ch in (("%21", "!"), ("%2A", "*"), ("%27", "''"), ("%28", "("), ("%29", ")")):
        out = f"replace({out}, '{code}', '{ch}')"
    return out


_FOLDED = """replace(replace(translate(lower(strip_accents({})), 'øłđ', 'old'), 'ß', 'ss'), 'æ', 'ae')"""
# A number in a body must be finite and not below its least value; a null field isn't in the body.
_VALID = """(page IS NULL OR (isfinite(page) AND page >= 0)) AND (hits_per_page IS NULL OR (isfinite(hits_per_page) AND hits_per_page >= 1)) AND (snippet_length IS NULL OR snippet_length >= 1)
  AND (facet_filters IS NULL OR len(list_filter(facet_filters, lambda g: g IS NULL OR len(list_filter(g, lambda x: x IS NULL)) > 0)) = 0)
  AND (facets IS NULL OR len(list_filter(facets, lambda x: x IS NULL)) = 0)"""


def _response(name: str) -> str:
    """A search's response; facets are counted under the filters of the others."""
    query, _, _, size, groups = SEARCHES[name]
    first, rows = _page(name)
    worded = any(ch.isalnum() for ch in query)
    chosen: dict[str, list[str]] = {}
    for item in (x for g in groups or [] for x in g):
        chosen.setdefault(item.partition(":")[0], []).append(item.partition(":")[2])
    text = "SELECT doc_ord FROM scored" if worded else "SELECT doc_ord FROM cur"
    passed = lambda skip: "".join(f" AND doc_ord IN (SELECT doc_ord FROM fv WHERE facet = '{f}' AND value IN ({', '.join(chr(39) + v + chr(39) for v in vs)}))" for f, vs in chosen.items() if f != skip)
    count = lambda f: f"(SELECT count(*) FROM fv WHERE facet = '{f}' AND doc_ord IN ({text}){passed(f)})"
    plan = "(SELECT string_agg(word || ':' || k || ':' || prefix || ':' || n, ' ' ORDER BY idx) FROM (SELECT q.idx, q.word, q.k, q.prefix, count(c.term) AS n FROM q LEFT JOIN capped c USING (idx) GROUP BY ALL))" if worded else "''"
    kind = "CASE attribute WHEN 0 THEN 'title' WHEN 1 THEN 'genres' ELSE 'description' END" if worded else "'none'"
    return f"""SELECT * FROM ({_ranked(name)}, {_broken("ranked", "ORDER BY rank")}, paged AS (SELECT * FROM broken WHERE rank >= {first} AND rank < {first} + {rows}), total AS (SELECT count(*) AS n FROM ranked)
SELECT '{name}' AS search, n AS nb_hits, ({first}) // {rows} AS page, ceil(n / {rows})::BIGINT AS nb_pages, {int(size)}::BIGINT AS hits_per_page, {plan} AS plan,
  coalesce((SELECT string_agg(id || '/' || coalesce(criterion, '-') || '/' || {kind}, ' ' ORDER BY rank) FROM paged), '') AS hits,
  {count("genre")} AS genres, {count("decade")} AS decades, {count("rating")} AS ratings FROM total)"""


SQL = OTHERS | {
    "normalized_genres": rf"""WITH {CUR} SELECT DISTINCT g AS genre, regexp_replace({_FOLDED.format("g")}, '[^\p{{L}}\p{{N}}]+', '', 'g') AS folded FROM (SELECT unnest(genres) AS g FROM cur) WHERE g IS NOT NULL""",
    "capitalized_queries": f"WITH {REQ} SELECT request_id, upper(left(query, 1)) || substr(query, 2) AS capitalized FROM req",
    "formatted_numbers": f"""WITH {CUR} SELECT id, format('{{:,}}', popularity) AS grouped,
  CASE WHEN popularity >= 100 THEN format('{{:.0f}}', popularity::DOUBLE) WHEN popularity >= 10 THEN format('{{:.1f}}', popularity::DOUBLE) ELSE format('{{:.2f}}', popularity::DOUBLE) END AS ms,
  CASE WHEN popularity < 1024 THEN popularity || ' B' WHEN popularity < 1048576 THEN format('{{:.0f}}', popularity / 1024) || ' KB' ELSE format('{{:.1f}}', popularity / 1024 / 1024) || ' MB' END AS bytes
FROM cur WHERE popularity IS NOT NULL""",
    "canonical_params": f"""WITH {REQ} SELECT request_id, 'query=' || {_encoded("coalesce(query, '')")} || '&hitsPerPage=20&page=0'
  || CASE WHEN len(facet_filters) > 0 THEN '&facetFilters=' || {_encoded("to_json(facet_filters)::VARCHAR")} ELSE '' END
  || CASE WHEN facets IS NOT NULL THEN '&facets=' || {_encoded("array_to_string(facets, ',')")} ELSE '' END AS params FROM req""",
    "valid_bodies": f"WITH {REQ} SELECT request_id, coalesce({_VALID}, false) AS valid, CASE WHEN {_VALID} THEN coalesce(query, '') END AS query FROM req",
    "valid_requests": f"WITH {REQ} SELECT request_id, coalesce(request_id >= 0 AND query IS NOT NULL AND {_VALID}, false) AS valid FROM req",
    "request_curls": f"""WITH {REQ} SELECT request_id, 'curl -X POST http://localhost/1/indexes/records/query -H ''Content-Type: application/json'' -d '''
  || replace('{{"query": ' || to_json(query) || '}}', '''', '''\\\\''''') || '''' AS curl FROM req""",
    # splitmix32 gives the four words, each step of xoshiro128** a number.
    "prng_numbers": """WITH RECURSIVE mix AS (SELECT i, (7 + i * 2654435769::HUGEINT) % 4294967296 AS x FROM (SELECT unnest([1, 2, 3, 4]) AS i)),
y AS (SELECT i, (xor(x::UBIGINT, x::UBIGINT >> 16)::HUGEINT * 569420461) % 4294967296 AS x FROM mix),
z AS (SELECT i, (xor(x::UBIGINT, x::UBIGINT >> 15)::HUGEINT * 1935289751) % 4294967296 AS x FROM y),
w AS (SELECT i, xor(x::UBIGINT, x::UBIGINT >> 15) AS x FROM z),
s AS (SELECT 0 AS i, max(x) FILTER (i = 1) AS a, max(x) FILTER (i = 2) AS b, max(x) FILTER (i = 3) AS c, max(x) FILTER (i = 4) AS d FROM w
  UNION ALL SELECT i + 1, xor(a, xor(d, b)), xor(b, xor(c, a)), xor(xor(c, a), (b * 512) % 4294967296), (xor(d, b) * 2048) % 4294967296 + xor(d, b) // 2097152 FROM s WHERE i < 199),
n AS (SELECT i, (b * 5) % 4294967296 AS x FROM s)
SELECT i::BIGINT AS i, ((((x * 128) % 4294967296 + x // 33554432) * 9) % 4294967296)::BIGINT AS number FROM n""",
    "hit_explanations": f"""{_ranked("search_page_two")}, {_broken("ranked", "ORDER BY rank")},
named AS (SELECT *, CASE criterion WHEN 'typos' THEN 0 WHEN 'words' THEN 1 WHEN 'proximity' THEN 2 WHEN 'attribute' THEN 3 WHEN 'exactness' THEN 4 WHEN 'popularity' THEN 5 END AS c,
  ['misspelt letters', 'query words found', 'distance between the words', 'field of the best match', 'words matched in full', 'popularity'] AS m FROM broken),
shown AS (SELECT *, CASE WHEN c = 5 THEN format('{{:,}}', previous::BIGINT) ELSE previous::VARCHAR END AS p,
  CASE WHEN c = 5 THEN format('{{:,}}', current::BIGINT) WHEN c = 3 THEN CASE attribute WHEN 0 THEN 'title' WHEN 1 THEN 'genres' ELSE 'description' END ELSE current::VARCHAR END AS o FROM named)
SELECT (rank + 1)::BIGINT AS rank, id, CASE WHEN criterion IS NULL THEN 'Equal to number ' || rank || ' in every respect, and later in the collection.'
  ELSE CASE WHEN c > 0 THEN 'Level with number ' || rank || ' in ' || array_to_string(m[1:c], ', ') || '. ' ELSE '' END || 'Number ' || rank || ' has ' || coalesce(p, 'None') || ' against ' || coalesce(o, 'None')
  || ' here in ' || m[c + 1] || ', where the ' || CASE WHEN c IN (0, 2, 3) THEN 'fewest' ELSE 'most' END || ' come first.' END AS explanation
FROM shown WHERE rank >= {_page("search_page_two")[0]} AND rank < {_page("search_page_two")[0]} + 40""",
    "url_states": rf"""WITH {REQ}, items AS (SELECT request_id, unnest(flatten(list_filter(facet_filters, lambda g: g IS NOT NULL))) AS x FROM req),
v AS (SELECT DISTINCT request_id, left(x, strpos(x, ':') - 1) AS f, substr(x, strpos(x, ':') + 1) AS v FROM items WHERE strpos(x, ':') > 1),
ok AS (SELECT * FROM v WHERE f IN ('genre', 'decade', 'rating') AND v <> '' AND strpos(v, ',') = 0 AND NOT regexp_matches(v, '^[\s\p{{Z}}]|[\s\p{{Z}}]$'))
SELECT request_id, coalesce(query, '') AS query, coalesce((SELECT list(v ORDER BY v) FROM ok WHERE ok.request_id = req.request_id AND f = 'genre'), []) AS genres,
  (SELECT count(*) FROM ok WHERE ok.request_id = req.request_id) AS count FROM req""",
    "json_round_trip": f"""WITH {CUR} SELECT id, title, description, genres, year, CASE WHEN NOT isnan(rating) THEN rating END AS rating, popularity, coalesce(isnan(rating), false) AS rating_is_nan FROM cur""",
    "facet_accessors": f"WITH {CUR}, {FACETS} SELECT DISTINCT facet, value FROM fv",
    "text_hit_counts": f"""WITH {BATCH.replace("typo_tolerance IS DISTINCT FROM false AS tol", "true AS tol")},
met AS (SELECT DISTINCT idx, doc_ord FROM capped JOIN (SELECT DISTINCT term, doc_ord FROM tok) USING (term)),
n AS (SELECT request_id, count(DISTINCT doc_ord) AS n FROM asked JOIN met USING (idx) GROUP BY request_id)
SELECT request_id, CASE WHEN request_id IN (SELECT request_id FROM words) THEN coalesce(n, 0) ELSE (SELECT count(*) FROM cur) END AS n FROM req LEFT JOIN n USING (request_id)""",
    "search_responses": " UNION ALL ".join(map(_response, RESPONSES)),
    "did_you_mean": f"{_NO_HITS} SELECT request_id, place::INT AS place, text AS suggestion FROM placed WHERE place < 3",
    "token_offsets_titles": f"""WITH {CUR}, rows_ AS (SELECT id AS k, title AS x FROM cur WHERE title IS NOT NULL), {TOKENS_AT}
SELECT k AS id, term AS text, s::INT AS start, e::INT AS "end" FROM token_at""",
    "highlight_title": f"""{_ranked("search_three_words")}, rows_ AS (SELECT doc_ord AS k, title AS x FROM cur SEMI JOIN ({_PAGE}) USING (doc_ord)), {_MARKED},
whole AS (SELECT k, string_agg(out, '' ORDER BY i) AS value FROM shown GROUP BY k),
named AS (SELECT k, list(w ORDER BY s) AS m FROM (SELECT k, word, min(s) AS s, CASE word WHEN 0 THEN 'the' WHEN 1 THEN 'dead' ELSE 'baker' END AS w FROM marks GROUP BY k, word) GROUP BY k)
SELECT r.rank::INT AS hit_pos, r.id, coalesce(value, '') AS value, coalesce(level, 'none') AS "matchLevel", coalesce(m, []) AS "matchedWords"
FROM ranked r LEFT JOIN whole v ON v.k = r.doc_ord LEFT JOIN level l ON l.k = r.doc_ord LEFT JOIN named n ON n.k = r.doc_ord WHERE rank < 100""",
    "snippet_description": f"""{_ranked("search_three_words")}, rows_ AS (SELECT doc_ord AS k, description AS x FROM cur SEMI JOIN ({_PAGE}) USING (doc_ord)), {_MARKED},
line AS (SELECT k, s, e, row_number() OVER (PARTITION BY k ORDER BY s) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM token_at),
starts AS (SELECT k, i AS a, s AS begin_, n, least(12, n) AS size FROM line WHERE i <= n - least(12, n)),
hit_at AS (SELECT line.k, line.i FROM line JOIN marks USING (k, s)),
seen AS (SELECT st.k, st.a, st.begin_, st.n, st.size, count(h.i) AS c, min(h.i) AS first FROM starts st LEFT JOIN hit_at h ON h.k = st.k AND h.i >= st.a AND h.i < st.a + st.size GROUP BY ALL),
best AS (SELECT * FROM seen QUALIFY row_number() OVER (PARTITION BY k ORDER BY -c, CASE WHEN c > 0 THEN abs(first - a - 3) ELSE a END, a) = 1),
ends AS (SELECT k, max(i) + 1 AS length FROM chars GROUP BY k),
cut AS (SELECT best.*, coalesce(line.s, ends.length) AS stop FROM best JOIN ends USING (k) LEFT JOIN line ON line.k = best.k AND line.i = best.a + best.size),
last_ AS (SELECT c.k, max(h.i) AS last FROM cut c JOIN chars h ON h.k = c.k AND h.i < c.stop AND h.i >= c.begin_ AND NOT regexp_matches(h.ch, '{SPACE}') GROUP BY c.k),
body AS (SELECT c.k, string_agg(s.out, '' ORDER BY s.i) AS value FROM cut c JOIN last_ USING (k) JOIN shown s ON s.k = c.k AND s.i >= c.begin_ AND s.i <= last GROUP BY c.k),
whole AS (SELECT k, string_agg(out, '' ORDER BY i) AS value FROM shown GROUP BY k)
SELECT r.rank::INT AS hit_pos, r.id, coalesce(CASE WHEN c.a > 0 THEN '…' ELSE '' END || b.value || CASE WHEN c.a + c.size < c.n THEN '…' ELSE '' END, w.value, '') AS value,
  coalesce(level, 'none') AS "matchLevel"
FROM ranked r LEFT JOIN cut c ON c.k = r.doc_ord LEFT JOIN body b ON b.k = r.doc_ord LEFT JOIN whole w ON w.k = r.doc_ord LEFT JOIN level l ON l.k = r.doc_ord WHERE rank < 100""",
    "response_json": f"""WITH page AS ({search("search_typo")}) SELECT '{{"hit_pos":' || hit_pos || ',"id":"' || id || '","typos":' || typos || ',"words":' || words || ',"proximity":' || proximity
  || ',"attribute":' || attribute || ',"exactness":' || exactness || ',"popularity":' || coalesce(popularity::VARCHAR, 'null') || '}}' AS json FROM page""",
}
