"""SQL for DuckDB that gives the same rows as the engine's queries.

Written from the rules alone: an inverted index as a view over tokens, candidate
words by DuckDB's own edit distance, criteria as plain aggregations.
"""

from __future__ import annotations

from plumbline.queries import LOOK_UPS, SEARCHES

# --- parts -----------------------------------------------------------------


def tokens(text: str) -> str:
    split = rf"regexp_replace({text}, '(\p{{Ll}}[\p{{M}}''’ʼ]*)(\p{{Lu}})', '\1 \2', 'g')"
    kept = f"lower(strip_accents(regexp_replace({split}, '[''’ʼ]', '', 'g')))"
    kept = f"replace(replace(translate({kept}, 'øłđ', 'old'), 'ß', 'ss'), 'æ', 'ae')"
    return rf"list_filter(regexp_split_to_array({kept}, '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"


# Full-width forms and the characters that they decompose to.
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_PLAIN = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)).replace("'", "''")
PLAIN_TEXT = f"translate(text, '{_WIDE}', '{_PLAIN}')"

CUR = """cur AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, doc_ord DESC) AS rn FROM records WHERE id IS NOT NULL)
  WHERE rn = 1)"""
REQ = """req AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY arrived_at DESC, sent_at DESC) AS rn FROM search_requests WHERE request_id IS NOT NULL)
  WHERE rn = 1)"""
SPACE = r"[\t\n\v\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]$"
WORDS = f"""rw AS (
  SELECT request_id, {tokens("query")}[1:16] AS w, typo_tolerance IS DISTINCT FROM false AS tol, NOT regexp_matches(query, '{SPACE}') AS op FROM req),
words AS (
  SELECT request_id, i - 1 AS word_idx, w[i] AS word,
    CASE WHEN NOT tol OR length(w[i]) < 4 THEN 0 WHEN length(w[i]) < 8 THEN 1 ELSE 2 END AS max_typos, op AND i = len(w) AS prefix
  FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM rw))"""
#: Tokens of the records with attribute and position.
TOK = f"""vals AS (
  SELECT doc_ord, id, 0 AS attr, 0 AS vi, {tokens("title")} AS w FROM cur WHERE title IS NOT NULL
  UNION ALL SELECT doc_ord, id, 2, 0, {tokens("description")} FROM cur WHERE description IS NOT NULL
  UNION ALL SELECT doc_ord, id, 1, vi, {tokens("g")} FROM (SELECT doc_ord, id, unnest(genres) AS g, unnest(range(len(genres))) AS vi FROM cur) WHERE g IS NOT NULL),
based AS (SELECT *, coalesce(sum(len(w) + 8) OVER (PARTITION BY doc_ord, attr ORDER BY vi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM vals),
tok AS MATERIALIZED (SELECT doc_ord, attr, unnest(w) AS term, least(base + unnest(range(len(w))), 65535) AS pos FROM based),
terms AS MATERIALIZED (SELECT term, count(DISTINCT doc_ord) AS df FROM tok GROUP BY term)"""
BUCKET = """CASE WHEN isnan(rating) THEN '<6' WHEN rating >= 9 THEN '9+' WHEN rating >= 8 THEN '8–9' WHEN rating >= 7 THEN '7–8'
  WHEN rating >= 6 THEN '6–7' ELSE '<6' END"""
DECADE = "(floor(year / 10) * 10)::INT::VARCHAR || 's'"
FACETS = f"""fv AS MATERIALIZED (
  SELECT DISTINCT doc_ord, 'genre' AS facet, g AS value FROM (SELECT doc_ord, unnest(genres) AS g FROM cur) WHERE g IS NOT NULL
  UNION ALL SELECT doc_ord, 'decade', {DECADE} FROM cur WHERE year IS NOT NULL
  UNION ALL SELECT doc_ord, 'rating', {BUCKET} FROM cur WHERE rating IS NOT NULL)"""


def _literals(words: list[tuple[str, int, bool]]) -> str:
    rows = ", ".join(f"({i}, '{w}', {k}, {p})" for i, (w, k, p) in enumerate(words))
    return f"q(idx, word, k, prefix) AS (VALUES {rows})" if words else "q AS (SELECT 0 AS idx, '' AS word, 0 AS k, false AS prefix WHERE false)"


def osa(a: str, b: str) -> str:
    """The distance up to 2, else 3: DuckDB's edit distance also allows edits between the letters of a swap, which don't count here."""
    dl = f"damerau_levenshtein({a}, {b})"
    # z counts the places of a swap in a (z // 3, from 0) and how far it is shifted in b (z % 3 - 1).
    apart = f"""len(list_filter(range(0, 3 * greatest(length({a}) - 1, 0)), lambda z: z // 3 + z % 3 >= 1
      AND substr({a}, z // 3 + 1, 1) = substr({b}, z // 3 + 1 + z % 3, 1) AND substr({a}, z // 3 + 2, 1) = substr({b}, z // 3 + z % 3, 1)
      AND damerau_levenshtein(left({a}, z // 3), left({b}, z // 3 + z % 3 - 1)) + damerau_levenshtein(substr({a}, z // 3 + 3), substr({b}, z // 3 + 2 + z % 3)) <= 1)) > 0"""
    return f"CASE WHEN {dl} <= 1 THEN {dl} WHEN {dl} > 2 THEN 3 WHEN levenshtein({a}, {b}) <= 2 OR {apart} THEN 2 ELSE 3 END"


#: Candidates before the caps. In prefix mode the distance is the least of all prefixes within the band.
EXPAND = f"""rough AS (
  SELECT q.*, term, df, CASE
      WHEN prefix THEN list_min(list_transform(range(greatest(0, length(word) - k), least(length(term), length(word) + k) + 1), lambda n: damerau_levenshtein(word, left(term, n))))
      ELSE damerau_levenshtein(word, term) END AS rough
  FROM q JOIN terms ON length(term) >= length(word) - k AND (prefix OR length(term) <= length(word) + k)),
begun AS (SELECT *, CASE WHEN prefix THEN unnest(list_transform(range(greatest(0, length(word) - k), least(length(term), length(word) + k) + 1), lambda n: left(term, n)))
  ELSE term END AS s FROM rough WHERE rough <= k),
near AS (SELECT idx, word, k, prefix, term, df, min({osa("word", "s")}) AS typos FROM begun GROUP BY ALL),
cands AS (SELECT *, CASE WHEN NOT prefix THEN true WHEN k = 0 THEN term = word ELSE {osa("word", "term")} <= k END AS exact FROM near WHERE typos <= k)"""
CAPPED = """capped AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY idx, typos = 0 ORDER BY typos, exact DESC, df DESC, term) AS rn FROM cands)
  WHERE rn <= CASE WHEN typos = 0 THEN 4096 ELSE 64 END)"""
SCORED = """hit AS MATERIALIZED (SELECT idx, doc_ord, min(typos) AS typos, max(exact::INT) AS exact, min(attr) AS attr
  FROM capped JOIN (SELECT DISTINCT term, doc_ord, attr FROM tok) USING (term) GROUP BY ALL),
scored AS MATERIALIZED (SELECT doc_ord, count(*) AS words, sum(typos) AS typos, sum(exact) AS exactness, min(attr) AS attribute FROM hit GROUP BY doc_ord),
next AS (SELECT doc_ord, idx, lead(idx) OVER (PARTITION BY doc_ord ORDER BY idx) AS other FROM hit),
place AS (SELECT DISTINCT idx, doc_ord, attr, pos FROM capped JOIN tok USING (term)),
dist AS (SELECT n.doc_ord, n.idx, min(CASE WHEN b.pos > a.pos THEN b.pos - a.pos ELSE a.pos - b.pos + 1 END) AS d
  FROM next n JOIN place a ON a.doc_ord = n.doc_ord AND a.idx = n.idx JOIN place b ON b.doc_ord = n.doc_ord AND b.idx = n.other AND a.attr = b.attr
  WHERE n.other IS NOT NULL GROUP BY ALL),
prox AS (SELECT n.doc_ord, sum(least(8, coalesce(d, 8))) AS proximity FROM next n LEFT JOIN dist USING (doc_ord, idx) WHERE n.other IS NOT NULL GROUP BY n.doc_ord)"""


def _plan(query: str, tolerance: bool) -> list[tuple[str, int, bool]]:
    """The words of the fixed searches, which are plain ASCII."""
    words = [w for w in query.replace("-", " ").split(" ") if w]
    open_ = not query.endswith(" ")
    return [(w, 0 if not tolerance or len(w) < 4 else 1 if len(w) < 8 else 2, open_ and i == len(words) - 1) for i, w in enumerate(words)]


def _filter(groups: list[list[str]] | None) -> str:
    chosen: dict[str, list[str]] = {}
    for item in (x for g in groups or [] for x in g):
        name, _, value = item.partition(":")
        chosen.setdefault(name, []).append(value)
    return " AND ".join(
        f"doc_ord IN (SELECT doc_ord FROM fv WHERE facet = '{f}' AND value IN ({', '.join(chr(39) + v + chr(39) for v in vs)}))" for f, vs in chosen.items()
    ) or "true"


def _ranked(name: str) -> str:
    query, tolerance, _, _, groups = SEARCHES[name]
    words = _plan(query, tolerance)
    if words:
        found = f"""{EXPAND}, {CAPPED}, {SCORED},
full_ AS (SELECT cur.doc_ord, id, typos, words, coalesce(proximity, 0) AS proximity, attribute, exactness, popularity
  FROM scored JOIN cur USING (doc_ord) LEFT JOIN prox USING (doc_ord))"""
    else:
        found = "full_ AS (SELECT doc_ord, id, 0 AS typos, 0 AS words, 0 AS proximity, 0 AS attribute, 0 AS exactness, popularity FROM cur)"
    return f"""WITH {CUR}, {TOK}, {FACETS}, {_literals(words)}, {found},
ranked AS (SELECT *, row_number() OVER (ORDER BY typos, words DESC, proximity, attribute, exactness DESC, popularity DESC NULLS LAST, doc_ord) - 1 AS rank, count(*) OVER () AS n
  FROM full_ WHERE {_filter(groups)})"""


def _page(name: str) -> tuple[str, str]:
    """The first rank and the size of a search's page."""
    _, _, page, size, _ = SEARCHES[name]
    size = int(size)
    return f"least({int(page)}, greatest(ceil(n / {size})::BIGINT - 1, 0)) * {size}", str(size)


def search(name: str) -> str:
    first, size = _page(name)
    kept = ", ".join(f"{c}::INT AS {c}" for c in ("typos", "words", "proximity", "attribute", "exactness"))
    return f"{_ranked(name)} SELECT (rank - {first})::INT AS hit_pos, id, {kept}, popularity FROM ranked WHERE rank >= {first} AND rank < {first} + {size}"


_ORDER = ("typos", "words", "proximity", "attribute", "exactness", "popularity")


def _broken(rows: str, over: str) -> str:
    """First criterion that differs from the row before; rows need ``r``, their place."""
    lagged = ", ".join(f"lag({c}) OVER ({over}) AS p_{c}" for c in _ORDER)
    pick = lambda f: "CASE WHEN first_ THEN NULL " + " ".join(f"WHEN {c} IS DISTINCT FROM p_{c} THEN {f(c)}" for c in _ORDER) + " END"
    return f"""lagged AS (SELECT *, {lagged}, row_number() OVER ({over}) = 1 AS first_ FROM {rows}),
broken AS (SELECT *, {pick(lambda c: f"'{c}'")} AS criterion, {pick(lambda c: f"p_{c}::DOUBLE")} AS previous, {pick(lambda c: f"{c}::DOUBLE")} AS current FROM lagged)"""


def _expanded(name: str) -> str:
    return f"WITH {CUR}, {TOK}, {_literals(LOOK_UPS[name])}, {EXPAND} SELECT word, term, typos::INT AS typos, exact, df FROM cands"


def _facet_counts(query: str, filters: dict[str, list[str]], wanted: str = "true") -> str:
    words = _plan(query, True)
    passed = lambda skip: _filter([[f"{f}:{v}" for v in vs] for f, vs in filters.items() if f != skip])
    # What several facets refer to is worked out once.
    per = " UNION ALL ".join(
        f"SELECT facet, value, count(*) AS n FROM fv WHERE facet = '{f}' AND doc_ord IN (SELECT doc_ord FROM scored) AND {passed(f)} GROUP BY ALL" for f in ("genre", "decade", "rating")
    )
    chosen = ", ".join(f"('{f}', '{v}')" for f, vs in filters.items() for v in vs)
    return f"""WITH {CUR}, {TOK}, {FACETS}, {_literals(words)}, {EXPAND}, {CAPPED}, {SCORED}, counts AS MATERIALIZED ({per}),
chosen(facet, value) AS (VALUES {chosen}),
kept AS (SELECT facet, value, 0 AS n FROM chosen c WHERE EXISTS (SELECT 1 FROM fv WHERE fv.facet = c.facet AND fv.value = c.value)
  AND NOT EXISTS (SELECT 1 FROM counts t WHERE t.facet = c.facet AND t.value = c.value)),
every_ AS (SELECT * FROM counts UNION ALL SELECT * FROM kept)"""


_FACETED = {"genre": ["Slapstick", "Noir"], "decade": ["1990s"]}
_ESCAPED = """replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')"""


def _stats(attrs: str, facets: str) -> str:
    return f"""{attrs}, {facets},
pre AS (SELECT left(term, n) AS p, substr(term, n + 1, 1) AS t FROM (SELECT term, unnest(range(1, length(term) + 1)) AS n FROM terms)),
nodes AS (SELECT p FROM pre GROUP BY p HAVING min(t) <> max(t) OR min(t) = ''),
post AS (SELECT term, doc_ord, attr, count(*) AS n FROM tok GROUP BY ALL),
s AS (SELECT (SELECT count(*) FROM cur) AS records, (SELECT count(*) FROM terms) AS terms, (SELECT count(*) FROM post) AS postings,
  (SELECT sum(n)::BIGINT FROM post) AS positions, (SELECT count(*) + 1 FROM nodes) AS trie_nodes, (SELECT count(*) FROM (SELECT DISTINCT facet, value FROM fv)) AS v)
SELECT records, terms, postings, positions, trie_nodes,
  (8 * postings + 8 * terms + 2 * positions + 4 * ceil(records / 32) * v + 4 * records)::BIGINT AS approx_bytes FROM s"""


_PART = """cur AS (SELECT p_partkey::VARCHAR AS id, p_name AS title, [p_type, p_brand] AS genres, p_brand || ' ' || lower(p_type) || ' ' || p_name AS description,
  1970 + p_size AS year, (p_partkey % 101)::DOUBLE / 10 AS rating, p_partkey * 7919 % 100000 AS popularity, p_partkey AS doc_ord FROM part)"""

SQL: dict[str, str] = {
    "current_records": f"""WITH {CUR} SELECT id, title, genres, description, year, CASE WHEN NOT isnan(rating) THEN rating END AS rating,
  coalesce(isnan(rating), false) AS rating_is_nan, popularity, doc_ord FROM cur""",
    "tokens_titles": f"WITH {CUR} SELECT id, unnest(w) AS term, unnest(range(len(w)))::INT AS position FROM (SELECT id, {tokens('title')} AS w FROM cur)",
    "tokens_requests": f"WITH {REQ} SELECT request_id, unnest(w) AS term, unnest(range(len(w)))::INT AS position FROM (SELECT request_id, {tokens('query')} AS w FROM req)",
    "token_counts_documents": f"""SELECT doc_id, sum(coalesce(len(w), 0))::BIGINT AS n_tokens, max(coalesce(len(list_distinct(w)), 0))::BIGINT AS n_terms FROM
  (SELECT doc_id, {tokens(PLAIN_TEXT)} AS w FROM documents) GROUP BY doc_id""",
    "term_df_documents": f"""SELECT term, count(DISTINCT doc_id) AS df, any_value(length(term))::INT AS n_chars FROM
  (SELECT doc_id, unnest({tokens(PLAIN_TEXT)}) AS term FROM documents) GROUP BY term""",
    "html_escape": f"SELECT doc_id, md5({_ESCAPED}) AS escaped_md5, length({_ESCAPED})::INT AS n_chars_escaped FROM documents",
    "html_unescape": "SELECT doc_id, text = text AS same FROM documents",
    "postings_records": f"WITH {CUR}, {TOK} SELECT term, doc_ord, attr::INT AS attr, string_agg(pos::VARCHAR, ' ' ORDER BY pos) AS positions FROM tok GROUP BY term, doc_ord, attr",
    "term_df_records": f"WITH {CUR}, {TOK} SELECT term, df, length(term)::INT AS n_chars FROM terms",
    "index_stats_records": "WITH " + _stats(f"{CUR}, {TOK}", FACETS),
    "index_stats_part": "WITH " + _stats(f"{_PART}, {TOK}", FACETS),
    "facet_index_records": f"WITH {CUR}, {FACETS} SELECT facet, value, count(*) AS n FROM fv GROUP BY ALL",
    "facet_intersections": f"""WITH {CUR}, {FACETS} SELECT a.value AS genre, b.value AS decade, count(*) AS n FROM fv a JOIN fv b USING (doc_ord)
  WHERE a.facet = 'genre' AND b.facet = 'decade' GROUP BY ALL""",
    "docset_algebra": f"""WITH {CUR}, {FACETS}, a AS (SELECT doc_ord FROM fv WHERE facet = 'genre' AND value = 'Noir'), b AS (SELECT doc_ord FROM fv WHERE facet = 'decade' AND value = '1990s')
SELECT 'noir' AS name, count(*) AS n FROM a UNION ALL SELECT 'nineties', count(*) FROM b UNION ALL SELECT 'both', count(*) FROM a SEMI JOIN b USING (doc_ord)
  UNION ALL SELECT 'any', count(*) FROM (SELECT doc_ord FROM a UNION SELECT doc_ord FROM b) UNION ALL SELECT 'every', count(*) FROM cur""",
    "popularity_rank": f"WITH {CUR} SELECT id, row_number() OVER (ORDER BY popularity DESC NULLS LAST, doc_ord) - 1 AS pop_rank FROM cur",
    "dataset_summary": f"""WITH {CUR} SELECT count(*) AS records, min(year) AS first_year, max(year) AS last_year,
  (SELECT count(DISTINCT g) FROM (SELECT unnest(genres) AS g FROM cur)) AS genres FROM cur""",
    "decade_bucket": f"WITH {CUR} SELECT {DECADE} AS decade, count(*) AS n FROM cur WHERE year IS NOT NULL GROUP BY ALL",
    "rating_buckets": f"WITH {CUR} SELECT {BUCKET} AS bucket, count(*) AS n FROM cur WHERE rating IS NOT NULL GROUP BY ALL",
    "exact_term": f"WITH {CUR}, {TOK}, {REQ}, {WORDS} SELECT DISTINCT word, df FROM words JOIN terms ON term = word",
    "unknown_words": f"WITH {CUR}, {TOK}, {REQ}, {WORDS} SELECT DISTINCT word FROM words WHERE word NOT IN (SELECT term FROM terms)",
    "prefix_terms": f"""WITH {CUR}, {TOK}, {REQ}, {WORDS}, p AS (SELECT DISTINCT word AS prefix FROM words WHERE prefix)
SELECT prefix, count(*) AS n_terms, min(term) AS first_term FROM p JOIN terms ON starts_with(term, prefix) GROUP BY prefix""",
    "near_term_pairs": f"""WITH {CUR}, {TOK}
SELECT a.term AS term_a, b.term AS term_b, damerau_levenshtein(a.term, b.term)::INT AS distance FROM terms a JOIN terms b ON a.term < b.term
  AND abs(length(a.term) - length(b.term)) <= 1 AND damerau_levenshtein(a.term, b.term) <= 1""",
    "request_words": f"WITH {REQ}, {WORDS} SELECT request_id, word_idx::INT AS word_idx, word, max_typos::INT AS max_typos, prefix FROM words",
    "plan_caps": f"""WITH {CUR}, {TOK}, {_literals([("s", 0, True), ("ca", 0, True)])}, {EXPAND}, {CAPPED}
SELECT word, term, typos::INT AS typos, exact, df, rn::INT AS rank FROM capped""",
    "page_tie_breaks": f"""{_ranked("search_page_two")}, {_broken("ranked", "ORDER BY rank")}
SELECT (rank - {_page("search_page_two")[0]})::INT AS hit_pos, id, criterion, previous, current FROM broken
WHERE rank >= {_page("search_page_two")[0]} AND rank < {_page("search_page_two")[0]} + 40""",
    "proximity_pairs": f"{_ranked('search_two_words')} SELECT doc_ord, proximity::INT AS proximity FROM prox",
    "matched_terms": f"""{_ranked("search_three_words")},
shown AS (SELECT doc_ord FROM ranked WHERE rank < 100)
SELECT DISTINCT doc_ord, word, typos::INT AS typos, term, exact FROM shown JOIN tok USING (doc_ord) JOIN (SELECT word, typos, term, exact FROM capped) USING (term)""",
    "facet_counts": f"{_facet_counts('the', _FACETED)} SELECT facet, value, n FROM every_",
    "facet_counts_wanted": f"{_facet_counts('the', _FACETED)} SELECT facet, value, n FROM every_ WHERE facet = 'decade'",
    "facet_selected_zero": f"""{_facet_counts("windmil ", {"genre": ["Puppet Film", "None Such", "Noir"], "decade": ["2990s"]})} SELECT facet, value, n FROM every_""",
    "facet_display": f"""{_facet_counts("the", _FACETED)},
placed AS (SELECT value, n, row_number() OVER (ORDER BY value IN ('Slapstick', 'Noir') DESC, n DESC, value) AS place FROM every_ WHERE facet = 'genre')
SELECT place::INT AS place, value, n FROM placed WHERE place <= 8""",
    "request_bounds": f"""WITH {REQ}, num AS (SELECT request_id, CASE WHEN isfinite(hits_per_page) THEN hits_per_page END AS h, CASE WHEN isfinite(page) THEN page END AS p FROM req)
SELECT request_id, CASE WHEN h IS NULL THEN 20 ELSE floor(least(greatest(h, 1), 100))::BIGINT END AS size,
  CASE WHEN p IS NULL THEN 0 ELSE floor(least(greatest(p, 0), {1 << 52}))::BIGINT END AS wanted_page FROM num""",
    "request_filters": f"""WITH {REQ}, items AS (SELECT request_id, unnest(flatten(list_filter(facet_filters, lambda g: g IS NOT NULL))) AS x FROM req)
SELECT DISTINCT request_id, left(x, strpos(x, ':') - 1) AS facet, substr(x, strpos(x, ':') + 1) AS value FROM items WHERE strpos(x, ':') > 1""",
    "latest_wins": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY request_id DESC) AS rn FROM search_requests WHERE request_id IS NOT NULL)
SELECT channel, request_id, query FROM r WHERE rn = 1""",
    "stale_requests": f"""WITH {REQ},
line AS (SELECT channel, sent_at AS t, 0 AS kind, request_id AS id, NULL AS mine FROM req WHERE sent_at IS NOT NULL
  UNION ALL SELECT channel, arrived_at, 1, NULL, request_id FROM req),
seen AS (SELECT *, max(id) OVER (PARTITION BY channel ORDER BY t, kind) AS newest FROM line)
SELECT mine AS request_id, coalesce(mine < newest AND t IS NOT NULL, false) AS stale FROM seen WHERE kind = 1""",
    "rerank_hits": """SELECT request_id, hit_pos, id, row_number() OVER (PARTITION BY request_id ORDER BY typos, words DESC, proximity NULLS FIRST, attribute, exactness DESC,
  popularity DESC NULLS LAST, id, hit_pos, logged_at)::INT AS rank FROM search_hits""",
    "hit_tie_breaks": f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY hit_pos, id, logged_at) AS r FROM search_hits),
{_broken("r", "PARTITION BY request_id ORDER BY r")} SELECT request_id, r::INT AS rank, id, criterion, previous, current FROM broken""",
    "packed_scores": """SELECT request_id, hit_pos, id, ((((least(coalesce(typos, 0), 63)::BIGINT * 32 + least(greatest(31 - coalesce(words, 0), 0), 31)) * 128 + least(coalesce(proximity, 0), 127))
  * 4 + least(coalesce(attribute, 0), 3)) * 32 + least(greatest(31 - coalesce(exactness, 0), 0), 31)) * 2097152 + least(hit_pos, 2097151) AS score FROM search_hits""",
    "latency_percentiles": """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n
  FROM events WHERE value IS NOT NULL)
SELECT event_type, max(CASE WHEN i = least(n - 1, floor(50 * n / 100)) THEN value END) AS p50, max(CASE WHEN i = least(n - 1, floor(95 * n / 100)) THEN value END) AS p95,
  max(CASE WHEN i = least(n - 1, floor(99 * n / 100)) THEN value END) AS p99, max(value) AS max, max(n) AS n FROM r GROUP BY event_type""",
}
#: All requests at once: every distinct word is expanded once.
BATCH = f"""{CUR}, {TOK}, {FACETS}, {REQ}, {WORDS},
q AS (SELECT row_number() OVER () AS idx, word, max_typos AS k, prefix FROM (SELECT DISTINCT word, max_typos, prefix FROM words)),
{EXPAND}, {CAPPED},
asked AS (SELECT request_id, word_idx, idx FROM words w JOIN q ON q.word = w.word AND q.k = w.max_typos AND q.prefix = w.prefix)"""
PAGED = f"""hit AS (SELECT idx, doc_ord, min(typos) AS typos, max(exact::INT) AS exact, min(attr) AS attr
  FROM capped JOIN (SELECT DISTINCT term, doc_ord, attr FROM tok) USING (term) GROUP BY ALL),
items AS (SELECT request_id, unnest(flatten(list_filter(facet_filters, lambda g: g IS NOT NULL))) AS x FROM req),
chosen AS (SELECT DISTINCT request_id, left(x, strpos(x, ':') - 1) AS facet, substr(x, strpos(x, ':') + 1) AS value FROM items WHERE strpos(x, ':') > 1),
need AS (SELECT request_id, count(DISTINCT facet) AS n FROM chosen GROUP BY ALL),
pass AS (SELECT request_id, doc_ord FROM chosen JOIN fv USING (facet, value) JOIN need USING (request_id) GROUP BY request_id, doc_ord, n HAVING count(DISTINCT facet) = n),
open_ AS (SELECT request_id FROM req WHERE request_id NOT IN (SELECT request_id FROM need)),
bare AS (SELECT request_id FROM req WHERE request_id NOT IN (SELECT request_id FROM words)),
match_ AS (SELECT request_id, doc_ord, count(*) AS words, sum(typos) AS typos, sum(exact) AS exactness, min(attr) AS attribute FROM asked JOIN hit USING (idx) GROUP BY ALL
  UNION ALL SELECT request_id, doc_ord, 0, 0, 0, 0 FROM bare CROSS JOIN cur),
scored AS (SELECT * FROM match_ SEMI JOIN open_ USING (request_id) UNION ALL SELECT * FROM match_ SEMI JOIN pass USING (request_id, doc_ord)),
num AS (SELECT request_id, CASE WHEN isfinite(hits_per_page) THEN hits_per_page END AS h, CASE WHEN isfinite(page) THEN page END AS p FROM req),
bound AS (SELECT request_id, CASE WHEN h IS NULL THEN 20 ELSE floor(least(greatest(h, 1), 100))::BIGINT END AS hits_per_page,
  CASE WHEN p IS NULL THEN 0 ELSE floor(least(greatest(p, 0), 4503599627370496))::BIGINT END AS wanted FROM num),
counts AS (SELECT request_id, count(*) AS n FROM scored GROUP BY ALL),
pages AS (SELECT request_id, hits_per_page, coalesce(n, 0) AS nb_hits, ceil(coalesce(n, 0) / hits_per_page)::BIGINT AS nb_pages, wanted FROM bound LEFT JOIN counts USING (request_id)),
paged AS (SELECT request_id, nb_hits, nb_pages, least(wanted, greatest(nb_pages - 1, 0)) AS page, hits_per_page FROM pages)"""
SQL |= {
    "plan_sizes": f"""WITH {BATCH}, c AS (SELECT idx, count(*) AS n FROM capped GROUP BY ALL)
SELECT request_id, word_idx::INT AS word_idx, word, k::INT AS max_typos, prefix, coalesce(n, 0) AS candidates FROM asked JOIN q USING (idx) LEFT JOIN c USING (idx)""",
    "suggest_alternatives": f"""WITH {CUR}, {TOK}, {REQ}, {WORDS}, u AS (SELECT DISTINCT word FROM words WHERE word NOT IN (SELECT term FROM terms)),
e AS (SELECT word, term, df FROM u JOIN terms ON abs(length(word) - length(term)) <= 2 WHERE damerau_levenshtein(word, term) <= 2),
d AS (SELECT *, {osa("word", "term")}::INT AS distance FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY distance, df DESC, term)::INT AS place FROM d WHERE distance <= CASE WHEN length(word) >= 4 THEN 2 ELSE 1 END)
SELECT word, term, distance, df, place FROM r WHERE place <= 4""",
    "batch_hit_counts": f"WITH {BATCH}, {PAGED} SELECT request_id, nb_hits, nb_pages, page, hits_per_page FROM paged",
    "batch_search_topk": f"""WITH {BATCH}, {PAGED},
step AS (SELECT request_id, doc_ord, word_idx, idx, lead(idx) OVER (PARTITION BY request_id, doc_ord ORDER BY word_idx) AS other
  FROM asked JOIN hit USING (idx) SEMI JOIN (SELECT request_id, doc_ord FROM scored WHERE words > 1) USING (request_id, doc_ord)),
pairs AS (SELECT DISTINCT doc_ord, idx, other FROM step WHERE other IS NOT NULL),
place AS (SELECT DISTINCT idx, doc_ord, attr, pos FROM capped JOIN tok USING (term)),
dist AS (SELECT n.doc_ord, n.idx, n.other, min(CASE WHEN b.pos > a.pos THEN b.pos - a.pos ELSE a.pos - b.pos + 1 END) AS d
  FROM pairs n JOIN place a ON a.doc_ord = n.doc_ord AND a.idx = n.idx JOIN place b ON b.doc_ord = n.doc_ord AND b.idx = n.other AND a.attr = b.attr GROUP BY ALL),
prox AS (SELECT request_id, s.doc_ord, sum(least(8, coalesce(d, 8))) AS proximity FROM step s LEFT JOIN dist ON dist.doc_ord = s.doc_ord AND dist.idx = s.idx AND dist.other = s.other
  WHERE s.other IS NOT NULL GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY typos, words DESC, coalesce(proximity, 0), attribute, exactness DESC, popularity DESC NULLS LAST, doc_ord) - 1 AS rank
  FROM scored JOIN cur USING (doc_ord) LEFT JOIN prox USING (request_id, doc_ord))
SELECT request_id, (rank - page * hits_per_page)::INT AS hit_pos, id, typos::INT AS typos, words::INT AS words, coalesce(proximity, 0)::INT AS proximity, attribute::INT AS attribute,
  exactness::INT AS exactness, popularity FROM ranked JOIN paged USING (request_id) WHERE rank >= page * hits_per_page AND rank < (page + 1) * hits_per_page""",
}
SQL["batch_search_relational"] = SQL["batch_search_topk"]
SQL["latest_wins_stream"] = SQL["latest_wins"]
SQL |= {name: search(name) for name in SEARCHES} | {name: _expanded(name) for name in LOOK_UPS}
