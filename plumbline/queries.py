"""The engine's queries over the project's tables, each over whole tables.

Records are the current ones, the latest state of every id.  The index over
them is built once per session and data folder.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.functions import text
from plumbline.functions.distance import osa_column
from plumbline.functions.values import escape_html_column, unescape_html_column
from plumbline.operators import docsets, facets, highlight, scorer, suggest
from plumbline.operators.current import latest
from plumbline.operators.index import Index, build_index, decade, index_stats, invert, rating_bucket, term_table
from plumbline.operators.index import IndexConfig
from plumbline.operators.ordinals import running_totals
from plumbline.operators.planner import WORD, cap_candidates, describe_plan, near_strings, plan_candidates, prefixes_of, query_words, scan_words
from plumbline.operators.shards import build_shards
from plumbline.plans import batch, scatter
from plumbline.plans.engine import SearchEngine, explain
from plumbline.plans.params import (
    FACET_NAMES, InvalidParams, SearchState, count_refinements, parse_query_body, parse_search_params, request_as_curl, serialize_params, serialize_search_params, to_query_params,
)
from plumbline.plans.service import is_request
from plumbline.session import materialize, shared_dir, table_path
from plumbline.sources.dataset import Xoshiro
from plumbline.sources.io import as_json, read_json_lines, summary, write_json_lines
from plumbline.streaming.requests import latest_requests, read_requests, stale_answers

Query = Callable[[SparkSession, str], DataFrame]
_indexes: dict[tuple[str, str], Index] = {}
_shards: dict[tuple[str, str], DataFrame] = {}
_REQUEST = "request_id bigint, query string, page double, hits_per_page double, typo_tolerance boolean, facet_filters array<array<string>>"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def latest_records(spark: SparkSession, sf: str) -> DataFrame:
    columns = ["title", "genres", "description", "year", "rating", "popularity", "doc_ord"]
    return latest(table(spark, sf, "records"), "id", ["updated_at", "doc_ord"], columns)


def current_records(spark: SparkSession, sf: str) -> DataFrame:
    """The latest state of every id; a NaN, which not every comparison holds equal to itself, is a null rating with a flag."""
    odd = F.coalesce(F.isnan("rating"), F.lit(False))
    return latest_records(spark, sf).withColumn("rating_is_nan", odd).withColumn("rating", F.when(~odd, F.col("rating")))


def current_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Each request once, as it arrived last."""
    given = table(spark, sf, "search_requests")
    return latest(given, "request_id", ["arrived_at", "sent_at"], [c for c in given.columns if c != "request_id"])


def record_index(spark: SparkSession, sf: str) -> Index:
    key = (spark.sparkContext.applicationId, sf)
    if key not in _indexes:
        _indexes[key] = build_index(materialize(latest_records(spark, sf), "records"))
    return _indexes[key]


def part_records(spark: SparkSession, sf: str) -> DataFrame:
    """The parts of the sales tables in the shape of records."""
    return table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title"), F.array("p_type", "p_brand").alias("genres"),
        F.concat_ws(" ", "p_brand", F.lower("p_type"), "p_name").alias("description"), (F.lit(1970) + F.col("p_size")).alias("year"),
        ((F.col("p_partkey") % 101).cast("double") / 10).alias("rating"), (F.col("p_partkey") * 7919 % 100000).alias("popularity"), F.col("p_partkey").alias("doc_ord"),
    )


# --- text ------------------------------------------------------------------


def _token_rows(df: DataFrame, key: str, column: str) -> DataFrame:
    """``(key, position, term)`` of every token of a text column."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            keys, places, found = [], [], []
            for row, value in enumerate(b.column(1).to_pylist()):
                cut = text.terms(value)
                keys += [row] * len(cut)
                places += range(len(cut))
                found += cut
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keys, pa.int64())), pa.array(places, pa.int32()), pa.array(found, pa.string())], names=["k", "position", "term"])

    kind = dict(df.dtypes)[key]
    return df.select(key, column).mapInArrow(run, f"k {kind}, position int, term string").withColumnRenamed("k", key)


def tokens_titles(spark, sf):
    return _token_rows(latest_records(spark, sf), "id", "title")


def tokens_requests(spark, sf):
    return _token_rows(current_requests(spark, sf), "request_id", "query")


def token_counts_documents(spark, sf):
    """Of every document the number of its tokens and of its different terms, 0 for one without tokens."""
    docs = table(spark, sf, "documents")
    found = _token_rows(docs, "doc_id", "text").select("doc_id", "term").unionByName(docs.select("doc_id", F.lit(None).cast("string").alias("term")))
    return found.groupBy("doc_id").agg(F.count("term").alias("n_tokens"), F.count_distinct("term").alias("n_terms"))


def token_offsets_titles(spark, sf):
    """Tokens with their places in the original string."""

    def cut(values):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("text", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        return pa.array([[dict(zip(("text", "start", "end"), t, strict=True)) for t in text.tokens(v)] for v in values.to_pylist()], kind)

    import pyarrow as pa

    cut.__annotations__ = {"values": pa.Array, "return": pa.Array}
    offsets = F.arrow_udf(cut, "array<struct<text string, start int, end int>>")
    return latest_records(spark, sf).select("id", F.explode(offsets("title")).alias("t")).select("id", "t.*")


def html_escape(spark, sf):
    escaped = escape_html_column(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.md5(escaped).alias("escaped_md5"), F.length(escaped).alias("n_chars_escaped"))


def html_unescape(spark, sf):
    """Escaping and unescaping gives every text back."""
    back = unescape_html_column(escape_html_column(F.col("text")))
    return table(spark, sf, "documents").select("doc_id", (back == F.col("text")).alias("same"))


def _mapped(function, kind: str):
    """A text column through a function of one text; null stays null."""
    import pyarrow as pa

    def run(values):
        return pa.array([None if v is None else function(v) for v in values.to_pylist()])

    run.__annotations__ = {"values": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, kind)


def normalized_genres(spark, sf):
    """Every genre as written, and folded to its letters and digits."""
    genres = latest_records(spark, sf).select(F.explode("genres").alias("genre")).filter(F.col("genre").isNotNull()).distinct()
    return genres.select("genre", _mapped(text.normalize_word, "string")("genre").alias("folded"))


def capitalized_queries(spark, sf):
    return current_requests(spark, sf).select("request_id", _mapped(text.capitalize, "string")("query").alias("capitalized"))


def formatted_numbers(spark, sf):
    """Popularity with separators of thousands, and as milliseconds and bytes are shown."""
    n = latest_records(spark, sf).filter(F.col("popularity").isNotNull()).select("id", "popularity")
    show = lambda f: _mapped(f, "string")("popularity")
    return n.select("id", show(text.format_int).alias("grouped"), show(text.format_ms).alias("ms"), show(text.format_bytes).alias("bytes"))


# --- requests as texts --------------------------------------------------------


def canonical_params(spark, sf):
    """Every request's canonical string of parameters, as of its first page of twenty."""
    import pyarrow as pa

    def run(queries, filters, facets_):
        rows = zip(queries.to_pylist(), filters.to_pylist(), facets_.to_pylist(), strict=True)
        return pa.array([serialize_params({"query": q, "facetFilters": f, "facets": n}, 20, 0) for q, f, n in rows])

    run.__annotations__ = {"queries": pa.Array, "filters": pa.Array, "facets_": pa.Array, "return": pa.Array}
    return current_requests(spark, sf).select("request_id", F.arrow_udf(run, "string")("query", "facet_filters", "facets").alias("params"))


def _body():
    return F.to_json(F.struct("query", "page", F.col("hits_per_page").alias("hitsPerPage"), F.col("typo_tolerance").alias("typoTolerance"), F.col("facet_filters").alias("facetFilters"), "facets", F.col("snippet_length").alias("snippetLength")))


def valid_bodies(spark, sf):
    """Whether every request's JSON body is accepted, and its query."""

    def accepted(body):
        try:
            return parse_query_body(body)["query"]
        except InvalidParams:
            return None

    parsed = _mapped(accepted, "string")(_body()).alias("query")
    return current_requests(spark, sf).select("request_id", parsed).select("request_id", F.col("query").isNotNull().alias("valid"), "query")


def valid_requests(spark, sf):
    """Whether every request is accepted as a message to the service."""

    def accepted(message):
        return is_request(json.loads(message))

    message = F.concat(F.lit('{"type": "query", "id": '), F.col("request_id").cast("string"), F.lit(', "params": '), _body(), F.lit("}"))
    return current_requests(spark, sf).select("request_id", _mapped(accepted, "boolean")(message).alias("valid"))


def request_curls(spark, sf):
    """Every request's query as a command line."""
    return current_requests(spark, sf).select("request_id", _mapped(lambda q: request_as_curl({"query": q}), "string")("query").alias("curl"))


def prng_numbers(spark, sf):
    """The first numbers of the generator of the synthetic corpus."""
    rng = Xoshiro(7)
    return spark.createDataFrame([(i, rng._next()) for i in range(200)], "i bigint, number bigint")


def url_states(spark, sf):
    """What is left of every request's query and values after a turn through the URL."""
    import pyarrow as pa

    kind = pa.struct([("query", pa.string()), ("genres", pa.list_(pa.string())), ("count", pa.int64())])

    def run(queries, filters):
        out = []
        for q, f in zip(queries.to_pylist(), filters.to_pylist(), strict=True):
            chosen = {n: sorted({v for v in facets.parse_filters(f).get(n, []) if v.strip() == v and v and "," not in v}) for n in FACET_NAMES}
            state = parse_search_params(serialize_search_params(SearchState(q or "", chosen)))
            asked = facets.parse_filters(to_query_params(state).get("facetFilters"))
            out.append({"query": state.query, "genres": asked.get("genre", []), "count": count_refinements(state.refinements)})
        return pa.array(out, kind)

    run.__annotations__ = {"queries": pa.Array, "filters": pa.Array, "return": pa.Array}
    turned = F.arrow_udf(run, "query string, genres array<string>, count bigint")("query", "facet_filters")
    return current_requests(spark, sf).select("request_id", turned.alias("s")).select("request_id", "s.*")


# --- sources -------------------------------------------------------------------


def json_round_trip(spark, sf):
    """The current records, written as lines of JSON and read again."""
    path = table_path(spark, "json")
    write_json_lines(latest_records(spark, sf).drop("doc_ord"), path)
    odd = F.coalesce(F.isnan("rating"), F.lit(False))
    return read_json_lines(spark, path).withColumn("rating_is_nan", odd).withColumn("rating", F.when(~odd, F.col("rating")))


# --- index -----------------------------------------------------------------


def postings_records(spark, sf):
    return record_index(spark, sf).postings.select("term", "doc_ord", "attr", F.concat_ws(" ", F.transform("positions", lambda p: p.cast("string"))).alias("positions"))


def term_df_records(spark, sf):
    return record_index(spark, sf).terms.select("term", "df", "n_chars")


def term_df_documents(spark, sf):
    docs = table(spark, sf, "documents").filter(F.col("doc_id").isNotNull())
    return term_table(invert(docs, IndexConfig(key="doc_id", ordinal="doc_id", attributes=("text",))))


def index_stats_records(spark, sf):
    return index_stats(record_index(spark, sf))


def index_stats_part(spark, sf):
    return index_stats(build_index(part_records(spark, sf)))


def facet_index_records(spark, sf):
    return record_index(spark, sf).facet_values().groupBy("facet", "value").agg(F.count("*").alias("n"))


def facet_intersections(spark, sf):
    """How many records have a genre and are of a decade."""
    values = record_index(spark, sf).facet_values()
    pick = lambda name: values.filter(F.col("facet") == name).select(F.col("value").alias(name), "doc_ord")
    return docsets.common_counts(pick("genre"), pick("decade"), "genre", "decade")


def docset_algebra(spark, sf):
    """The sizes of two sets of records, of what they have in common and together, and of all, by bitmaps."""
    index = record_index(spark, sf)
    values = index.facet_values()
    noir, nineties = (docsets.pack(values.filter((F.col("facet") == f) & (F.col("value") == v))) for f, v in (("genre", "Noir"), ("decade", "1990s")))
    sets = {"noir": noir, "nineties": nineties, "both": docsets.combine([noir, nineties], True), "any": docsets.combine([noir, nineties], False), "every": docsets.pack(docsets.every(index))}
    return reduce(DataFrame.unionByName, [s.agg(F.coalesce(F.sum(F.bitmap_count("bitmap")), F.lit(0)).alias("n")).select(F.lit(name).alias("name"), "n") for name, s in sets.items()])


def facet_accessors(spark, sf):
    """The facets' names and values as the engine tells them."""
    engine = SearchEngine(record_index(spark, sf), parts=record_shards(spark, sf))
    return spark.createDataFrame([(f, v) for f in engine.facet_names() for v in engine.values_of(f)], "facet string, value string")


def popularity_rank(spark, sf):
    return record_index(spark, sf).docs.select("id", "pop_rank")


def dataset_summary(spark, sf):
    return summary(latest_records(spark, sf))


def decade_bucket(spark, sf):
    return latest_records(spark, sf).filter(F.col("year").isNotNull()).groupBy(decade(F.col("year")).alias("decade")).agg(F.count("*").alias("n"))


def rating_buckets(spark, sf):
    return latest_records(spark, sf).filter(F.col("rating").isNotNull()).groupBy(rating_bucket(F.col("rating")).alias("bucket")).agg(F.count("*").alias("n"))


# --- dictionary and planning ------------------------------------------------


def exact_term(spark, sf):
    """Request words that are terms, with their document frequency."""
    words = _request_words(spark, sf).select("word").distinct()
    return words.join(record_index(spark, sf).terms.withColumnRenamed("term", "word"), "word").select("word", "df")


def unknown_words(spark, sf):
    """Request words that no record holds."""
    words = _request_words(spark, sf).select("word").distinct()
    return words.join(record_index(spark, sf).terms.withColumnRenamed("term", "word"), "word", "left_anti")


def prefix_terms(spark, sf):
    """For every request word that may be a prefix, the number of terms that begin with it."""
    words = _request_words(spark, sf).filter("prefix").select(F.col("word").alias("prefix")).distinct()
    return words.join(prefixes_of(record_index(spark, sf).terms), "prefix").groupBy("prefix").agg(F.count("*").alias("n_terms"), F.min("term").alias("first_term"))


def _request_words(spark, sf):
    return query_words(current_requests(spark, sf).withColumnRenamed("request_id", "query_id"))


def _expanded(words):
    def run(spark, sf):
        return scan_words(words, record_index(spark, sf).terms).select("word", "term", "typos", "exact", "df")

    return run


def near_term_pairs(spark, sf):
    """All pairs of terms that are one edit apart."""
    terms = record_index(spark, sf).terms
    near = near_strings(terms.select(F.col("term").alias("word"), F.lit(1).alias("k")), terms.select(F.col("term").alias("s"), F.lit(1).alias("depth")))
    return near.filter("word < s").select(F.col("word").alias("term_a"), F.col("s").alias("term_b"), osa_column("word", "s").alias("distance"))


def request_words(spark, sf):
    """The plan of every request: its words, budgets and prefix flags."""
    return _request_words(spark, sf).select(F.col("query_id").alias("request_id"), "word_idx", *WORD)


def plan_sizes(spark, sf):
    """Of every word of every request the number of candidates after the caps."""
    words = materialize(_request_words(spark, sf), "words")
    return describe_plan(words, plan_candidates(words, record_index(spark, sf).terms)).withColumnRenamed("query_id", "request_id")


def plan_caps(spark, sf):
    """The kept candidates of one open letter, far more than there is room for."""
    return cap_candidates(scan_words([("s", 0, True), ("ca", 0, True)], record_index(spark, sf).terms)).select("word", "term", "typos", "exact", "df", "rank")


# --- search ------------------------------------------------------------------

#: name -> (query, tolerance, page, size, filters); their words are also in the SQL.
SEARCHES: dict[str, tuple[str, bool, float, float, list[list[str]] | None]] = {
    "search_word": ("kettle ", True, 0.0, 100.0, None),
    "search_prefix": ("sta", True, 0.0, 100.0, None),
    "search_typo": ("windmil ", True, 0.0, 100.0, None),
    "search_two_words": ("dusty kettle ", True, 0.0, 100.0, None),
    "search_three_words": ("the dead baker", True, 0.0, 100.0, None),
    "search_empty": ("", True, 0.0, 100.0, None),
    "search_no_tokens": ("---", True, 1.0, 50.0, None),
    "search_closed_word": ("sta ", True, 0.0, 100.0, None),
    "search_no_typo_tolerance": ("windmil", False, 0.0, 100.0, None),
    "search_repeated_word": ("star star ", True, 0.0, 100.0, None),
    "search_page_two": ("dusty kettle ", True, 1.0, 40.0, None),
    "search_page_clamped": ("windmil ", True, 1e15, 7.0, None),
    "search_faceted": ("the", True, 0.0, 100.0, [["genre:Slapstick", "genre:Noir"], ["decade:1990s"]]),
    "search_faceted_empty": ("", True, 0.0, 100.0, [["genre:Caper"], ["rating:8–9"]]),
    "search_unknown_facet": ("the", True, 0.0, 100.0, [["studio:Any"]]),
}


def _search(name):
    def run(spark, sf):
        query, tolerance, page, size, filters = SEARCHES[name]
        asked = spark.createDataFrame([(0, query, page, size, tolerance, filters)], _REQUEST)
        return scatter.search(record_index(spark, sf), record_shards(spark, sf), asked).drop("request_id")

    run.__name__ = name
    return run


def _asked(spark, sf, name):
    query, tolerance, page, size, filters = SEARCHES[name]
    return batch.prepare_one(record_index(spark, sf), query, tolerance, page, size, filters)


def page_tie_breaks(spark, sf):
    """The second page's hits with the criterion that parts each from the one before, across the page's border."""
    hits = _asked(spark, sf, "search_page_two").hits(tie_break=True)
    return hits.select("hit_pos", "id", "tie_break.criterion", "tie_break.previous", "tie_break.current")


def proximity_pairs(spark, sf):
    """Of every record holding both words their least distance, whatever its rank."""
    asked = _asked(spark, sf, "search_two_words")
    both = asked.scored.filter("words = 2").select("scope", "doc_ord")
    return scorer.proximities(both, asked.words, asked.candidates, asked.index.postings, "scope").select("doc_ord", "proximity")


def matched_terms(spark, sf):
    asked = _asked(spark, sf, "search_three_words")
    found = scorer.matched_terms(asked.hits().withColumn("scope", F.lit(asked.scopes.first()["scope"])), asked.words, asked.candidates, asked.index.postings, "scope")
    return found.select("doc_ord", F.explode("matches").alias("m")).select("doc_ord", "m.word", "m.typos", "m.term", "m.exact")


def facet_counts(spark, sf):
    """Live counts under two filters, each value under the other facets' filters."""
    return _asked(spark, sf, "search_faceted").facet_counts().select("facet", "value", "n")


def facet_counts_wanted(spark, sf):
    return _asked(spark, sf, "search_faceted").facet_counts(F.col("facet").isin("decade", "nothing")).select("facet", "value", "n")


def facet_selected_zero(spark, sf):
    """Selected values that count nothing are kept, unknown ones aren't."""
    row = (0, "windmil ", 0.0, 20.0, True, [["genre:Puppet Film", "genre:None Such", "genre:Noir"], ["decade:2990s"]])
    asked = batch.prepare(record_index(spark, sf), spark.createDataFrame([row], _REQUEST))
    return asked.facet_counts().select("facet", "value", "n")


def facet_display(spark, sf):
    """The first eight genre values as they are shown: chosen ones first, then by count."""
    counts = _asked(spark, sf, "search_faceted").facet_counts(F.col("facet") == "genre")
    order = [F.col("value").isin("Slapstick", "Noir").desc(), F.desc("n"), F.asc("value")]
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("facet").orderBy(*order))).filter(F.col("place") <= facets.COLLAPSED).select("place", "value", "n")


def _shown(spark, sf):
    asked = _asked(spark, sf, "search_three_words")
    hits = asked.hits().withColumn("scope", F.lit(asked.scopes.first()["scope"]))
    found = scorer.matched_terms(hits, asked.words, asked.candidates, asked.index.postings, "scope")
    words = F.array(*(F.lit(w) for w in ("the", "dead", "baker")))
    page = F.broadcast(hits.select("scope", "doc_ord", "hit_pos").join(found, ["scope", "doc_ord"]).select("doc_ord", "hit_pos", "matches"))
    return asked.index.records.join(page, "doc_ord"), words


def highlight_title(spark, sf):
    rows, words = _shown(spark, sf)
    return rows.select("hit_pos", "id", highlight.highlight_column("title", "matches", words).alias("h")).select("hit_pos", "id", "h.*")


def snippet_description(spark, sf):
    rows, words = _shown(spark, sf)
    return rows.select("hit_pos", "id", highlight.snippet_column("description", "matches", words, F.lit(12)).alias("s")).select("hit_pos", "id", "s.*")


def response_json(spark, sf):
    """The page of hits of a search, each as the JSON text in which it is answered."""
    return as_json(_asked(spark, sf, "search_typo").hits().select("hit_pos", "id", *scorer.CRITERIA))


def suggest_alternatives(spark, sf):
    """The nearest terms of every request word that no record holds."""
    found = suggest.alternatives(unknown_words(spark, sf), record_index(spark, sf).terms)
    return found.select("word", "term", "distance", "df", "place")


def did_you_mean(spark, sf):
    """Suggestions for every request that has words, no filters and no hits."""
    index, requests = record_index(spark, sf), current_requests(spark, sf)
    asked = batch.without_hits(index, requests.filter(F.size(facets.selections(F.col("facet_filters"))) == 0))
    return batch.suggestions(index, asked.select(F.col("request_id").alias("query_id"), "query")).withColumnRenamed("query_id", "request_id")


# --- batches of requests -------------------------------------------------------


def record_shards(spark: SparkSession, sf: str) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf)
    if key not in _shards:
        _shards[key] = build_shards(record_index(spark, sf))
    return _shards[key]


def batch_search_topk(spark, sf):
    """The page of hits of every request, by shards."""
    return scatter.search(record_index(spark, sf), record_shards(spark, sf), current_requests(spark, sf))


def batch_search_relational(spark, sf):
    """The same by joins and aggregations."""
    hits = batch.prepare(record_index(spark, sf), current_requests(spark, sf)).hits()
    return hits.select("request_id", "hit_pos", "id", *scorer.CRITERIA)


def batch_hit_counts(spark, sf):
    """Of every request the number of hits and the page that is shown."""
    counted = scatter.hit_counts(record_index(spark, sf), current_requests(spark, sf))
    pages = F.ceil(F.col("nb_hits") / F.col("hits_per_page")).cast("bigint").alias("nb_pages")
    counted = counted.select("request_id", "nb_hits", pages, "page", "hits_per_page")
    return counted.withColumn("page", F.least("page", F.greatest(F.col("nb_pages") - 1, F.lit(0))))


def text_hit_counts(spark, sf):
    """Of every request's text the number of documents that it matches, with typo tolerance and whatever its filters."""
    plain = {"page": F.lit(None).cast("double"), "hits_per_page": F.lit(None).cast("double"), "typo_tolerance": F.lit(True), "facet_filters": F.lit(None).cast("array<array<string>>")}
    asked = current_requests(spark, sf).select("request_id", "query", *(value.alias(name) for name, value in plain.items()))
    return scatter.hit_counts(record_index(spark, sf), asked).select("request_id", F.col("nb_hits").alias("n"))


#: Searches whose whole responses are compared.
RESPONSES = ("search_prefix", "search_typo", "search_three_words", "search_page_two", "search_page_clamped", "search_closed_word", "search_faceted", "search_unknown_facet", "search_empty")


def search_responses(spark, sf):
    """What the engine's facade answers to fixed searches: its counts, page, plan, hits and facets."""
    engine = SearchEngine(record_index(spark, sf), parts=record_shards(spark, sf))
    rows = []
    for name in RESPONSES:
        query, tolerance, page, size, filters = SEARCHES[name]
        r = engine.search({"query": query, "typoTolerance": tolerance, "page": page, "hitsPerPage": size, "facetFilters": filters or []})
        hits = [h["objectID"] + "/" + (h["_rankingInfo"]["tieBreak"] or {}).get("criterion", "-") + "/" + h["_rankingInfo"]["attributeName"] for h in r.hits]
        plan = [f"{w['word']}:{w['maxTypos']}:{w['prefix']}:{w['candidates']}".lower() for w in r.parsedQuery]
        counts = [sum(r.facets[f].values()) for f in ("genre", "decade", "rating")]
        rows.append((name, r.nbHits, r.page, r.nbPages, r.hitsPerPage, " ".join(plan), " ".join(hits), *counts))
    return spark.createDataFrame(rows, "search string, nb_hits bigint, page bigint, nb_pages bigint, hits_per_page bigint, plan string, hits string, genres bigint, decades bigint, ratings bigint")


def hit_explanations(spark, sf):
    """Why each hit of the second page stands behind the one before it."""
    query, tolerance, page, size, _ = SEARCHES["search_page_two"]
    engine = SearchEngine(record_index(spark, sf), parts=record_shards(spark, sf))
    hits = engine.search({"query": query, "typoTolerance": tolerance, "page": page, "hitsPerPage": size, "facets": []}).hits
    first = int(page) * int(size) + 1
    return spark.createDataFrame([(first + i, h["objectID"], explain(h, first + i)) for i, h in enumerate(hits)], "rank bigint, id string, explanation string")


def request_bounds(spark, sf):
    """Page and size of every request within their bounds."""
    return current_requests(spark, sf).select(
        "request_id", batch.bounded(F.col("hits_per_page"), 20, 1, 100).alias("size"), batch.bounded(F.col("page"), 0, 0, batch.FAR).alias("wanted_page")
    )


def request_filters(spark, sf):
    """The facet values that every request selects."""
    chosen = current_requests(spark, sf).select("request_id", F.explode(facets.selections(F.col("facet_filters"))).alias("facet", "values"))
    return chosen.select("request_id", "facet", F.explode("values").alias("value"))


def latest_wins(spark, sf):
    return latest_requests(table(spark, sf, "search_requests")).select("channel", "request_id", "query")


def latest_wins_stream(spark, sf):
    """The same, over a stream of the requests' files."""
    import uuid

    schema: StructType = table(spark, sf, "search_requests").schema
    path = f"{sf}/search_requests.parquet"
    name = f"latest_{uuid.uuid4().hex}"
    source = path if os.path.isdir(path) else f"{sf}/search_requests*.parquet"
    newest = latest_requests(read_requests(spark, source, schema).select("channel", "request_id", "query"))
    stream = newest.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{shared_dir(spark)}/{name}")
    stream.trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def stale_requests(spark, sf):
    """Of every request whether a later one of its channel had been sent when it arrived."""
    return stale_answers(current_requests(spark, sf)).select("request_id", "stale")


# --- logged hits ----------------------------------------------------------------


def rerank_hits(spark, sf):
    """The logged hits of every request in the order of their criteria."""
    hits = table(spark, sf, "search_hits").withColumnRenamed("hit_pos", "doc_ord")
    order = Window.partitionBy("request_id").orderBy(*(c for c in scorer.ranking_order()[:-1]), F.asc("id"), F.asc("doc_ord"), F.asc("logged_at"))
    # A null proximity comes first, as nothing is known against it.
    return hits.select("request_id", F.col("doc_ord").alias("hit_pos"), "id", F.row_number().over(order).alias("rank"))


def hit_tie_breaks(spark, sf):
    """Of every logged hit the criterion that parts it from the one before in its request."""
    place = Window.partitionBy("request_id").orderBy("hit_pos", "id", "logged_at")
    hits = table(spark, sf, "search_hits").withColumn("rank", F.row_number().over(place))
    broken = scorer.with_tie_break(hits, "request_id")
    return broken.select("request_id", "rank", "id", "tie_break.criterion", "tie_break.previous", "tie_break.current")


def packed_scores(spark, sf):
    """The criteria of every logged hit in one number."""
    columns = {c: F.coalesce(F.col(c), F.lit(0)) for c in scorer.CRITERIA[:-1]} | {"pop_rank": F.col("hit_pos")}
    return table(spark, sf, "search_hits").select("request_id", "hit_pos", "id", scorer.packed_score(columns).alias("score"))


def latency_percentiles(spark, sf):
    """Percentiles of the values by kind of event: the element at floor(p / 100 * n), the last at most."""
    given = table(spark, sf, "events").filter(F.col("value").isNotNull()).select("event_type", "value")
    counts = given.groupBy("event_type", "value").agg(F.count("*").alias("c"))
    # Sums over ranges of values, so a kind with a fifth of all events isn't sorted by one task.
    summed = materialize(running_totals(counts, ["event_type", "value"], "c", "before"), "summed")
    kinds = summed.groupBy("event_type").agg(F.sum("c").alias("n"), F.min("before").alias("base"))
    every = summed.join(F.broadcast(kinds), "event_type").withColumn("upto", F.col("before") - F.col("base") + F.col("c"))  # a row per kind of event
    at = lambda p: F.least(F.col("n") - 1, F.floor(F.lit(p) * F.col("n") / 100))
    pick = lambda p: F.min(F.when(F.col("upto") > at(p), F.col("value")))
    return every.groupBy("event_type").agg(pick(50).alias("p50"), pick(95).alias("p95"), pick(99).alias("p99"), F.max("value").alias("max"), F.max("n").alias("n"))


_FUNCTIONS = (
    current_records, tokens_titles, tokens_requests, token_counts_documents, token_offsets_titles, html_escape, html_unescape, normalized_genres, capitalized_queries, formatted_numbers, canonical_params,
    valid_bodies, valid_requests, request_curls, url_states, prng_numbers, json_round_trip, hit_explanations, facet_accessors, text_hit_counts, search_responses, postings_records,
    term_df_records, term_df_documents, index_stats_records, index_stats_part, facet_index_records, facet_intersections, docset_algebra, popularity_rank, dataset_summary, decade_bucket,
    rating_buckets, exact_term, unknown_words, prefix_terms, near_term_pairs, request_words, plan_sizes, plan_caps, page_tie_breaks, proximity_pairs,
    matched_terms, facet_counts, facet_counts_wanted, facet_selected_zero, facet_display, highlight_title, snippet_description, response_json,
    suggest_alternatives, did_you_mean, batch_search_topk, batch_search_relational, batch_hit_counts, request_bounds, request_filters, latest_wins, latest_wins_stream,
    stale_requests, rerank_hits, hit_tie_breaks, packed_scores, latency_percentiles,
)

#: name -> the word that is looked up, its budget and whether it is open.
LOOK_UPS = {
    "fuzzy_terms_1": [("windmil", 1, False), ("ketle", 1, False), ("brige", 1, False)],
    "fuzzy_terms_2": [("screwdrivr", 2, False), ("wendmill", 2, False)],
    "fuzzy_prefix_terms_1": [("windm", 1, True), ("ketl", 1, True)],
    "fuzzy_prefix_terms_2": [("screwdrv", 2, True)],
    "prefix_terms_zero": [("sta", 0, True)],
}

QUERIES: dict[str, Query] = {f.__name__: f for f in _FUNCTIONS} | {n: _search(n) for n in SEARCHES} | {n: _expanded(w) for n, w in LOOK_UPS.items()}
