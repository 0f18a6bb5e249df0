"""SQL for DuckDB that gives the same rows as this subpackage's queries.

Written from the statements of the problems, without any of the operators'
methods: plain joins, windows and aggregations over whole tables.
"""

# The letters and characters that the tables' texts hold, and their canonical ones.
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_PLAIN = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
_BLANKS = "".join(chr(c) for c in [0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000])
_SEEN = "АВЕЅІЈКМНОРСТУХаеѕіјорсухёЁΑΒΕΖΗΙΚΜΝΟΡΤΥΧαιονρυ"
_LATIN = "ABESIJKMHOPCTYXaesijopcyxëËABEZHIKMNOPTYXaiovpu"
_GONE = "­​‌‍⁠﻿"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def canonical(text: str) -> str:
    kept = f"regexp_replace({text}, '[{_GONE}]', '', 'g')"
    kept = f"translate({kept}, {_quoted(_BLANKS)}, '{' ' * len(_BLANKS)}')"
    kept = f"translate({kept}, {_quoted(_WIDE)}, {_quoted(_PLAIN)})"
    return f"nfc_normalize(translate({kept}, '{_SEEN}', '{_LATIN}'))"


def tokens(text: str) -> str:
    split = rf"regexp_replace({text}, '(\p{{Ll}}[\p{{M}}''’ʼ]*)(\p{{Lu}})', '\1 \2', 'g')"
    kept = f"lower(strip_accents(regexp_replace({split}, '[''’ʼ]', '', 'g')))"
    kept = f"replace(replace(translate({kept}, 'øłđ', 'old'), 'ß', 'ss'), 'æ', 'ae')"
    return rf"list_filter(regexp_split_to_array({kept}, '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"


_CURRENT = """cur AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, doc_ord DESC) AS rn FROM records WHERE id IS NOT NULL)
  WHERE rn = 1)"""
_VALUES = r"""vals AS (
  SELECT DISTINCT id, lower(regexp_replace(g, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS g FROM (SELECT id, unnest(genres) AS g FROM cur)
  WHERE regexp_replace(g, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') <> '')"""
_BOTH = f"""toks AS (
  SELECT id, unnest({tokens("coalesce(title, '')")} || {tokens("coalesce(description, '')")}) AS t FROM cur)"""

_PAIRS = f"""WITH {_CURRENT}, {_VALUES},
one AS (SELECT g, count(*) AS n FROM vals GROUP BY g),
al AS (SELECT count(*) AS n FROM cur),
two AS (SELECT a.g AS ga, b.g AS gb, count(*) AS n FROM vals a JOIN vals b ON a.id = b.id AND a.g < b.g GROUP BY ALL),
p AS (SELECT two.ga, two.gb, two.n, x.n AS n_a, y.n AS n_b, al.n AS n_all
      FROM two JOIN one x ON x.g = two.ga JOIN one y ON y.g = two.gb CROSS JOIN al)"""

_MARKS = f"""WITH {_CURRENT}, {_VALUES}, al AS (SELECT count(*) AS n FROM cur),
words AS (
  SELECT 'title' AS field, id, unnest({tokens("title")}) AS value FROM cur
  UNION ALL SELECT 'description', id, unnest({tokens("description")}) FROM cur
  UNION ALL SELECT 'genres', id, g FROM vals),
counts AS (SELECT field, value, count(*) AS occurrences, count(DISTINCT id) AS records FROM words GROUP BY ALL),
marked AS (SELECT field, value, occurrences, records,
  CASE WHEN records <= 1 THEN 'rare' WHEN records * 5 >= al.n THEN 'common' END AS mark FROM counts CROSS JOIN al)"""

_RANKED = f"""WITH {_CURRENT},
part AS (SELECT id, rating, popularity, count(*) OVER () AS m FROM cur
         WHERE rating BETWEEN 0 AND 10 AND NOT isnan(rating) AND popularity >= 0),
above AS (SELECT *, rank() OVER (ORDER BY rating DESC) - 1 AS a, rank() OVER (ORDER BY popularity DESC) - 1 AS b FROM part)"""

_DOCS = f"""docs AS (SELECT doc_id, {tokens(canonical("text"))} AS w FROM documents WHERE text IS NOT NULL),
items AS (SELECT item_id, {tokens(canonical("text"))} AS w FROM eval_items WHERE text IS NOT NULL)"""

# Byte-pair encoding by the public vocabulary's ranks: of each piece of text the adjacent parts of lowest rank are joined until none are in it.
_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_SPACE, _INK = r"[\t\n\x0b\f\r\x{85}\p{Z}]", r"[^\t\n\x0b\f\r\x{85}\p{Z}]"
_PIECE = rf"''(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^\t\n\x0b\f\r\x{{85}}\p{{Z}}\p{{L}}\p{{N}}]+|{_SPACE}+"
_SIZES = rf"""WITH RECURSIVE ranks AS MATERIALIZED (SELECT from_base64(b) AS b, r FROM read_csv('{_RANKS}', delim = ' ', header = false, quote = '', escape = '', columns = {{'b': 'VARCHAR', 'r': 'BIGINT'}})),
split_ AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '({_SPACE}+)({_SPACE}{_INK})', '\1' || chr(1) || '\2', 'g'), chr(1))) AS x FROM documents WHERE text IS NOT NULL),
piece AS MATERIALIZED (SELECT doc_id, unnest(regexp_extract_all(x, '{_PIECE}')) AS p FROM split_),
bytes AS (SELECT p, list_transform(range(1, octet_length(encode(p)) + 1), lambda i: unhex(substr(hex(encode(p)), 2 * i - 1, 2))) AS w FROM (SELECT DISTINCT p FROM piece)),
steps AS (SELECT p, w, true AS more FROM bytes
  UNION ALL SELECT s.p, CASE WHEN n.i IS NULL THEN w ELSE w[:n.i - 1] || [w[n.i] || w[n.i + 1]] || w[n.i + 2:] END, n.i IS NOT NULL FROM (SELECT * FROM steps WHERE more) s
  LEFT JOIN (SELECT p, arg_min(i, r * 1000000 + i) AS i FROM (SELECT p, i, w[i] || w[i + 1] AS b FROM (SELECT p, w, unnest(range(1, len(w))) AS i FROM steps WHERE more)) JOIN ranks USING (b) GROUP BY p) n ON n.p = s.p),
counted AS (SELECT doc_id, sum(len(w))::BIGINT AS tokens FROM piece JOIN steps USING (p) WHERE NOT more GROUP BY doc_id),
sized AS MATERIALIZED (SELECT doc_id, lower(regexp_replace(source, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')) AS source, coalesce(tokens, 0) AS tokens FROM documents LEFT JOIN counted USING (doc_id)),
goal AS (SELECT lower(regexp_replace(source, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')) AS source, target_share AS share, greatest(max_repeats, 0)::BIGINT AS max_repeats FROM mix_targets),
per AS (SELECT source, count(*) AS documents, sum(tokens)::BIGINT AS tokens FROM sized WHERE tokens > 0 GROUP BY source),
room AS (SELECT sum(tokens) AS n FROM sized)"""

# Blocks of 1,024 tokens and the golden-ratio schedule of slots.
_MIXED = rf"""{_SIZES},
plan AS (SELECT goal.*, coalesce(documents, 0) AS documents, coalesce(tokens, 0) AS tokens, (coalesce(tokens, 0) + 1023) // 1024 AS blocks,
  row_number() OVER (ORDER BY goal.source) - 1 AS place, sum(share) OVER (ORDER BY goal.source ROWS UNBOUNDED PRECEDING) / (SELECT sum(share) FROM goal) AS upto FROM goal LEFT JOIN per USING (source)),
line AS (SELECT doc_id, source, tokens, coalesce(sum(tokens) OVER (PARTITION BY source ORDER BY md5('17:' || doc_id), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begin_
  FROM sized SEMI JOIN goal USING (source) WHERE tokens > 0),
part AS (SELECT *, unnest(range(begin_ // 1024, (begin_ + tokens - 1) // 1024 + 1)) AS block FROM line),
slots AS (SELECT slot, ((((slot + 1)::UHUGEINT * 11400714819323198485) % 18446744073709551616) // 2048)::DOUBLE / 9007199254740992 AS point
  FROM (SELECT unnest(range((SELECT (n::BIGINT + 1023) // 1024 FROM room))) AS slot)),
chosen AS (SELECT slot, least((SELECT count(*) FROM plan WHERE upto <= point), (SELECT count(*) - 1 FROM plan)) AS place FROM slots),
filled AS (SELECT slot, source, k % nullif(blocks, 0) AS block, k < blocks * max_repeats AS fits FROM (SELECT *, row_number() OVER (PARTITION BY place ORDER BY slot) - 1 AS k FROM chosen) JOIN plan USING (place)),
uses AS (SELECT source, block, count(*) AS repeats, min(slot) AS first_slot FROM filled WHERE fits GROUP BY ALL),
mixed AS (SELECT doc_id, source, greatest(begin_, block * 1024) - begin_ AS first_token, least(begin_ + tokens, (block + 1) * 1024) - greatest(begin_, block * 1024) AS tokens, repeats, first_slot
  FROM part JOIN uses USING (source, block))"""

_SIMILAR = f"""WITH {_CURRENT}, {_BOTH},
able AS (SELECT id FROM cur WHERE len(list_distinct({tokens("coalesce(description, '')")})) >= 12),
sets AS (SELECT DISTINCT id, t FROM toks SEMI JOIN able USING (id)),
keys AS (SELECT id, row_number() OVER (ORDER BY id)::INT AS k, count(*)::INT AS n FROM sets GROUP BY id),
coded AS (SELECT k, n, dense_rank() OVER (ORDER BY t)::INT AS t FROM sets JOIN keys USING (id)),
two AS (SELECT a.k AS x, b.k AS y, any_value(a.n) + any_value(b.n) AS n, count(*) AS common
        FROM coded a JOIN coded b ON a.t = b.t AND a.k < b.k AND 10 * a.n >= 6 * b.n AND 10 * b.n >= 6 * a.n GROUP BY ALL
        HAVING 10 * count(*) >= 6 * (any_value(a.n) + any_value(b.n) - count(*))),
alike AS (SELECT p.id AS id_a, q.id AS id_b FROM two JOIN keys p ON p.k = x JOIN keys q ON q.k = y)"""

# Two scores have a first component whose loadings are alike but for the sign.
_PROJECTED = f"""{_RANKED},
tied AS (SELECT *, count(*) OVER (PARTITION BY rating) AS ta, count(*) OVER (PARTITION BY popularity) AS tb FROM above),
placed AS (SELECT *, 1 - (a + (ta - 1) / 2) / m AS x, 1 - (b + (tb - 1) / 2) / m AS y FROM tied),
spread AS (SELECT stddev_pop(x) AS sx, stddev_pop(y) AS sy, CASE WHEN covar_pop(x, y) < 0 THEN -1 ELSE 1 END AS turn FROM placed),
projected AS (SELECT *, round(((x - 0.5) / sx + turn * (y - 0.5) / sy) / sqrt(2), 9) AS projection FROM placed CROSS JOIN spread)"""

# The maximum of the likelihood in one step: in the order of background by count, terms have a share as long as it is positive.
_WEIGHED = f"""WITH {_CURRENT}, {_BOTH},
held AS (SELECT id, t, count(*) AS n FROM toks GROUP BY id, t),
back AS (SELECT t, count(*) AS records, sum(n) AS occurrences FROM held GROUP BY t),
priced AS (SELECT id, t, n, records, 9 * occurrences::DOUBLE / (SELECT sum(n) FROM held) AS price FROM held JOIN back USING (t)),
upto AS (SELECT *, row_number() OVER w AS place, (1 + sum(price) OVER w) / sum(n) OVER w AS slope FROM priced WINDOW w AS (PARTITION BY id ORDER BY price / n, t ROWS UNBOUNDED PRECEDING)),
best AS (SELECT id, arg_max(slope, place) AS slope FROM upto WHERE n * slope > price GROUP BY id),
weighed AS (SELECT u.id, u.t AS term, u.n, u.records, greatest(u.n * best.slope - u.price, 0) AS weight FROM upto u JOIN best USING (id))"""

# A passage with one edit: a window of the text and the passage agree once a term is left out of either, or of the longer one.
_LEAKS = f"""WITH {_DOCS},
long AS (SELECT item_id, w, least(len(w), 10) AS n, least(len(w), 10) // least(len(w), 2) AS piece FROM items WHERE len(w) > 0),
passage AS (SELECT DISTINCT item_id, n, w[i:i + n - 1] AS p FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM long)),
sizes AS (SELECT DISTINCT n FROM long),
shown AS (SELECT DISTINCT doc_id, n, w[i:i + n - 2] AS less, CASE WHEN i + n - 1 <= len(w) THEN w[i:i + n - 1] END AS same, CASE WHEN i + n <= len(w) THEN w[i:i + n] END AS more
  FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - greatest(n - 1, 1) + 2)) AS i FROM docs CROSS JOIN sizes WHERE len(w) >= n - 1)),
cut AS (SELECT item_id, n, k, list_concat(p[:k - 1], p[k + 1:]) AS q FROM (SELECT *, unnest(range(1, n + 1)) AS k FROM passage WHERE n > 1)),
met AS (
  SELECT doc_id, item_id, 0 AS distance FROM shown s JOIN passage p ON p.n = s.n AND p.p = s.same
  UNION ALL SELECT doc_id, item_id, 1 FROM shown s JOIN cut c ON c.n = s.n AND c.q = s.less
  UNION ALL SELECT doc_id, item_id, 1 FROM (SELECT doc_id, n, k, list_concat(same[:k - 1], same[k + 1:]) AS q FROM (SELECT *, unnest(range(1, n + 1)) AS k FROM shown WHERE same IS NOT NULL))
    JOIN cut USING (n, k, q)
  UNION ALL SELECT doc_id, item_id, 1 FROM (SELECT doc_id, n, list_concat(more[:k - 1], more[k + 1:]) AS p FROM (SELECT *, unnest(range(1, n + 2)) AS k FROM shown WHERE more IS NOT NULL AND n > 1))
    JOIN passage USING (n, p)),
pairs AS (SELECT doc_id, item_id, min(distance) AS distance FROM met GROUP BY ALL),
a AS (SELECT doc_id, piece, i, w[i:i + piece - 1] AS p FROM (SELECT doc_id, w, piece, unnest(range(1, len(w) - piece + 2)) AS i FROM docs CROSS JOIN (SELECT DISTINCT piece FROM long))),
b AS (SELECT item_id, piece, j, w[j:j + piece - 1] AS p FROM (SELECT *, unnest(range(1, len(w) - piece + 2)) AS j FROM long)),
c AS (SELECT doc_id, item_id, piece, i, i - j AS d FROM a JOIN b USING (piece, p) SEMI JOIN pairs USING (doc_id, item_id)),
r AS (SELECT doc_id, item_id, count(*) + any_value(piece) - 1 AS run FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, d ORDER BY i) AS g FROM c) GROUP BY doc_id, item_id, d, g)"""

SQL = {
    "p1_found": f"{_SIMILAR} SELECT id_a, id_b FROM alike",
    "p1_groups": f"""{_SIMILAR.replace("WITH ", "WITH RECURSIVE ", 1)},
ends AS MATERIALIZED (SELECT id_a AS a, id_b AS b FROM alike UNION ALL SELECT id_b, id_a FROM alike),
reach AS (SELECT id, id AS seen FROM cur UNION SELECT reach.id, b FROM reach JOIN ends ON a = seen),
least_ AS (SELECT id, min(seen) AS class FROM reach GROUP BY id)
SELECT id, class, (SELECT count(*) FROM ends WHERE a = id) AS links FROM least_""",
    "p2_pairs": f"""{_PAIRS} SELECT ga AS item_a, gb AS item_b, n, n_a, n_b, n_all,
  n::DOUBLE * n_all / (n_a::DOUBLE * n_b) AS lift,
  CASE WHEN n < n_a THEN (1 - n_b::DOUBLE / n_all) / (1 - n::DOUBLE / n_a) END AS conviction FROM p""",
    "p2_found": f"{_PAIRS} SELECT ga AS genre_a, gb AS genre_b FROM p WHERE n >= 5 AND n * 2000 >= n_all AND n * n_all >= 3 * n_a * n_b",
    "p3_counts": f"{_MARKS} SELECT field, value, occurrences, records, mark FROM marked",
    "p3_found": f"{_MARKS} SELECT field, value, mark FROM marked WHERE mark IS NOT NULL",
    "p4_found": f"{_RANKED} SELECT id FROM above WHERE a * 100 < m AND b * 100 < m",
    "p4_ranking": f"""{_PROJECTED} SELECT id, rating, popularity, a AS above_rating, x AS rank_rating, b AS above_popularity, y AS rank_popularity, projection,
  row_number() OVER (ORDER BY projection DESC, id) AS position, m AS ranked FROM projected""",
    "p5_top": f"""WITH {_CURRENT}, {_VALUES},
r AS (SELECT g AS genre, id, popularity, row_number() OVER (PARTITION BY g ORDER BY popularity DESC, id) AS rank
      FROM vals JOIN cur USING (id) WHERE popularity >= 0)
SELECT genre, id, popularity, rank::INT AS rank FROM r WHERE rank <= 5""",
    "p6_found": f"""WITH {_CURRENT}, {_BOTH},
held AS (SELECT id, t, count(*) AS n, count(*) OVER (PARTITION BY t) AS records FROM toks GROUP BY id, t)
SELECT id, t AS term FROM held WHERE n >= 3 AND records <= 5""",
    "p6_weights": f"{_WEIGHED} SELECT id, term, n, records, weight FROM weighed",
    "p6_terms": f"""{_WEIGHED} SELECT id, term, n, records, weight FROM
  (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(weight, 9) DESC, term) AS place FROM weighed) WHERE place <= 10""",
    "p7_leaks": f"""{_LEAKS} SELECT doc_id, item_id, any_value(distance)::INT AS distance, max(run)::INT AS run FROM pairs JOIN r USING (doc_id, item_id) GROUP BY ALL""",
    "p7_found": f"""WITH {_DOCS},
d AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 8), lambda i: array_to_string(w[i:i+9], ' '))) AS s FROM docs WHERE len(w) >= 10),
e AS (SELECT item_id, unnest(list_transform(range(1, len(w) - 8), lambda i: array_to_string(w[i:i+9], ' '))) AS s FROM items WHERE len(w) >= 10)
SELECT DISTINCT doc_id, item_id FROM d JOIN e USING (s)""",
    "p8_mix": f"{_MIXED} SELECT doc_id, source, first_token, tokens, repeats, first_slot FROM mixed",
    "p8_report": f"""{_MIXED}, got AS (SELECT source, sum(tokens * repeats)::BIGINT AS n FROM mixed GROUP BY source), rest AS (SELECT source, count(*) AS n FROM filled WHERE NOT fits GROUP BY source)
SELECT source, share AS target_share, max_repeats, documents, tokens, tokens * max_repeats AS capacity_tokens, share * room.n AS target_tokens, coalesce(got.n, 0) AS mixed_tokens,
  coalesce(got.n, 0) / (SELECT sum(n) FROM got) AS actual_share, coalesce(rest.n, 0) AS empty_slots, tokens * max_repeats >= share * room.n AS reachable
FROM plan CROSS JOIN room LEFT JOIN got USING (source) LEFT JOIN rest USING (source)""",
    "p8_found": f"""{_SIZES}
SELECT g.source FROM goal g LEFT JOIN per USING (source) CROSS JOIN room WHERE coalesce(tokens, 0) * max_repeats < share * n""",
    "p9_texts": f"""SELECT doc_id, md5({canonical("text")}) AS canonical_md5, {canonical("text")} <> text AS changed FROM documents""",
    "p9_found": f"""WITH c AS (SELECT doc_id, text, {canonical("text")} AS k FROM documents WHERE text <> '')
SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM c a JOIN c b ON a.k = b.k AND a.text <> b.text AND a.doc_id < b.doc_id""",
}
SQL["p5_found"] = f"SELECT genre, id FROM ({SQL['p5_top']})"
