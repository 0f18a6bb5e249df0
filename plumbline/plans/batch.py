"""Answering many requests in one job: every request is a row."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators import facets, scorer, suggest
from plumbline.operators.index import Index
from plumbline.operators.planner import WORD, cap_candidates, plan_candidates, plan_words, query_words, scan_words
from plumbline.plans.params import bounded_integer
from plumbline.session import brief_shuffles, materialize

DEFAULT_SIZE, LARGEST_SIZE = 20, 100
#: No page is asked beyond this one; it is clamped to the last page anyway.
FAR = 1 << 52


def bounded(value: Column, fallback: int, low: int, high: int) -> Column:
    """The floor of a number within bounds; null, NaN and the infinities give the fallback."""
    value = value.cast("double")
    usable = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    return F.when(usable, F.floor(F.least(F.greatest(value, F.lit(float(low))), F.lit(float(high))))).otherwise(F.lit(fallback)).cast("bigint")


@dataclass(frozen=True)
class Batch:
    """What a batch shares: ``requests`` with their scope, ``scopes``, ``words``, ``candidates`` and ``scored`` documents.

    Requests with the same query, tolerance and filters have one scope, which is
    answered once.  Scopes are 64-bit hashes.
    """

    index: Index
    requests: DataFrame
    scopes: DataFrame
    words: DataFrame
    candidates: DataFrame
    scored: DataFrame
    #: Of a single request its page, which the driver has worked out already.
    place: dict | None = None

    def hit_counts(self) -> DataFrame:
        """``(scope, nb_hits)`` of every scope."""
        counted = self.scored.groupBy("scope").agg(F.count("*").alias("n"))
        every = self.scopes.select("scope", "everything").join(counted, "scope", "left")
        return every.select("scope", F.when(F.col("everything"), F.lit(self.index.size)).otherwise(F.coalesce("n", F.lit(0))).cast("bigint").alias("nb_hits"))

    def pages(self) -> DataFrame:
        """``(request_id, scope, hits_per_page, nb_hits, nb_pages, page)`` with the clamped page."""
        if self.place:
            kind = "request_id bigint, scope bigint, hits_per_page bigint, nb_hits bigint, nb_pages bigint, page bigint"
            return self.index.spark.createDataFrame([tuple(self.place[c.split()[0]] for c in kind.split(", "))], kind)
        counted = self.requests.join(self.hit_counts(), "scope")
        last = F.ceil(F.col("nb_hits") / F.col("hits_per_page"))
        counted = counted.withColumn("nb_pages", last.cast("bigint"))
        return counted.withColumn("page", F.least("page", F.greatest(F.col("nb_pages") - 1, F.lit(0)))).select(
            "request_id", "scope", "hits_per_page", "nb_hits", "nb_pages", "page"
        )

    def ranked(self, asked: DataFrame) -> DataFrame:
        """The first ``asked(scope, k)`` documents of scopes that have words or filters."""
        if self.place:
            deepest = (self.place["page"] + 1) * self.place["hits_per_page"]
        else:
            deepest = asked.agg(F.coalesce(F.max("k"), F.lit(0)).alias("k")).first()["k"]
        return scorer.ranked_documents(self.scored, asked, self.words, self.candidates, self.index.postings, self.index.docs, "scope", deepest)

    def hits(self, tie_break: bool = False) -> DataFrame:
        """``(request_id, hit_pos, doc_ord, id, criteria...)`` of every request's page, ``hit_pos`` from 0."""
        pages = self.pages() if self.place else materialize(self.pages(), "pages")
        first = F.col("page") * F.col("hits_per_page")
        asked = pages.groupBy("scope").agg(F.max(first + F.col("hits_per_page")).alias("k"))
        ranked = self.ranked(asked)
        if tie_break:
            ranked = scorer.with_tie_break(ranked, "scope")
        on_page = (F.col("rank") > first) & (F.col("rank") <= first + F.col("hits_per_page"))
        found = pages.join(ranked, "scope").filter(on_page).withColumn("hit_pos", (F.col("rank") - first - 1).cast("int"))
        kept = ["request_id", "hit_pos", "doc_ord", "id", *scorer.CRITERIA, *(["tie_break"] if tie_break else [])]
        # Requests without words or filters walk down the popularity ranks of the whole index.
        plain = pages.join(self.scopes.filter("everything").select("scope"), "scope").filter("nb_hits > 0")
        steps = F.explode(F.sequence(first - F.when(first > 0, 1).otherwise(0), F.least(first + F.col("hits_per_page"), F.col("nb_hits")) - 1))
        plain = plain.select("request_id", first.alias("first"), steps.alias("pop_rank"))
        plain = plain.join(self.index.docs.select("pop_rank", "doc_ord", "id", "popularity"), "pop_rank")
        for name in scorer.CRITERIA[:-1]:
            plain = plain.withColumn(name, F.lit(0))
        plain = plain.withColumn("rank", F.col("pop_rank") + 1)
        if tie_break:
            plain = scorer.with_tie_break(plain, "request_id")
        plain = plain.filter("pop_rank >= first").withColumn("hit_pos", (F.col("pop_rank") - F.col("first")).cast("int"))
        return found.select(*kept).unionByName(plain.select(*kept))

    def facet_counts(self, wanted: Column | None = None) -> DataFrame:
        """``(scope, facet, value, n)``; ``wanted`` is a boolean over ``facet``.

        Counts take all documents that the text matches, or all if it has no words, filtered by the other facets.
        """
        matches = self.text_matches().join(self.scopes.select("scope", "selected"), "scope")
        matches = matches.join(self.index.docs.select("doc_ord", "facets"), "doc_ord")
        counts = facets.facet_counts(matches, "scope", wanted=wanted).unionByName(self._plain_counts(wanted))
        return facets.with_selected(counts, self.scopes, self.index.facet_values(), "scope", wanted)

    def text_matches(self) -> DataFrame:
        """``(scope, doc_ord)`` of the scopes that have words, without the filters."""
        if self.place and self.place["plain"]:
            return self.scored.select("scope", "doc_ord")
        return scorer.scored_documents(self.words, scorer.word_matches(self.candidates, self.index.postings), "scope").select("scope", "doc_ord")

    def _plain_counts(self, wanted: Column | None) -> DataFrame:
        """The counts of scopes without words: of whole values where no other facet filters, else of the documents that pass."""
        values = self.index.facet_values() if wanted is None else self.index.facet_values().filter(wanted)
        names = F.array(*(F.lit(n) for n in self.index.config.facets()))
        asked = self.scopes.filter("n_words = 0").select("scope", F.explode(names).alias("facet"), "selected")
        asked = asked.select("scope", "facet", F.map_filter("selected", lambda f, _: f != F.col("facet")).alias("selected"))
        free = asked.filter(F.size("selected") == 0).join(values.groupBy("facet", "value").agg(F.count("*").alias("n")), "facet")
        others = asked.filter(F.size("selected") > 0).withColumn("of", F.struct("scope", "facet"))
        passing = docs_passing(self.index, others.select(F.col("of").alias("scope"), "selected")).select("scope.*", "doc_ord")
        held = passing.join(values, ["doc_ord", "facet"]).groupBy("scope", "facet", "value").agg(F.count("*").alias("n"))
        return free.select("scope", "facet", "value", "n").unionByName(held)


def prepare(index: Index, requests: DataFrame) -> Batch:
    """Plan and score ``requests(request_id, query, page, hits_per_page, typo_tolerance, facet_filters)``.

    Request ids must be unique.  Null, NaN, infinite or negative numbers, null
    queries and malformed filters get their defaults; nothing is rejected.
    """
    asked = requests.select(
        "request_id", F.coalesce("query", F.lit("")).alias("query"), F.coalesce("typo_tolerance", F.lit(True)).alias("typo_tolerance"),
        bounded(F.col("hits_per_page"), DEFAULT_SIZE, 1, LARGEST_SIZE).alias("hits_per_page"), bounded(F.col("page"), 0, 0, FAR).alias("page"),
        facets.selections(F.col("facet_filters")).alias("selected"),
    )
    filters = F.to_json(F.struct("selected"))
    asked = asked.withColumn("plan", F.xxhash64("query", "typo_tolerance")).withColumn("scope", F.xxhash64("plan", filters))
    asked = materialize(asked, "requests")
    scopes = asked.select("scope", "plan", "query", "typo_tolerance", "selected")
    scopes = scopes.groupBy("scope").agg(*(F.first(c).alias(c) for c in scopes.columns[1:]))
    plans = asked.groupBy(F.col("plan").alias("query_id")).agg(F.first("query").alias("query"), F.first("typo_tolerance").alias("typo_tolerance"))
    words = materialize(query_words(plans), "words")
    candidates = materialize(plan_candidates(words, index.terms), "candidates")
    sizes = words.groupBy(F.col("query_id").alias("plan")).agg(F.first("n_words").alias("n_words"))
    scopes = scopes.join(sizes, "plan", "left").withColumn("n_words", F.coalesce("n_words", F.lit(0)))
    scopes = materialize(scopes.withColumn("everything", (F.col("n_words") == 0) & (F.size("selected") == 0)), "scopes")

    by_scope = words.withColumnRenamed("query_id", "plan").join(scopes.select("plan", "scope"), "plan")
    scored = materialize(score(index, scopes, by_scope, candidates), "scored")
    return Batch(index, asked, scopes, by_scope, candidates, scored)


def score(index: Index, scopes: DataFrame, words: DataFrame, candidates: DataFrame, any_filters: bool | None = None) -> DataFrame:
    """``(scope, doc_ord, words, typos, exactness, attribute)`` of the documents that match and pass the filters.

    ``any_filters`` tells whether a scope has filters, if that is known.  Scopes without words match every document, and appear only if they have filters.
    """
    matches = scorer.word_matches(candidates, index.postings)
    filtering = scopes.filter(F.size("selected") > 0).select("scope", "selected")
    if any_filters is False or any_filters is None and filtering.isEmpty():
        return scorer.scored_documents(words, matches, "scope")
    plain = scorer.scored_documents(words.join(filtering, "scope", "left_anti"), matches, "scope")
    passing = docs_passing(index, filtering)
    chosen = scorer.scored_documents(words.join(filtering, "scope", "left_semi"), matches, "scope").join(passing, ["scope", "doc_ord"], "left_semi")
    bare = passing.join(scopes.filter("n_words = 0").select("scope"), "scope")
    for name in ("words", "typos", "exactness", "attribute"):
        bare = bare.withColumn(name, F.lit(0))
    return plain.unionByName(chosen).unionByName(bare)


def prepare_one(index: Index, query: str, typo_tolerance: bool, page: object, hits_per_page: object, filters: list[list[str]] | None) -> Batch:
    """``prepare`` for one request: its words and candidates, which are bounded, are planned on the driver."""
    spark = index.spark
    planned = plan_words(query, typo_tolerance)
    selected = {f: sorted(set(v)) for f, v in facets.parse_filters(filters).items()}
    size, page = bounded_integer(hits_per_page, DEFAULT_SIZE, 1, LARGEST_SIZE), bounded_integer(page, 0, 0, FAR)
    requests = spark.createDataFrame([(0, 0, size, page)], "request_id bigint, scope bigint, hits_per_page bigint, page bigint")
    everything = not planned and not selected
    scope = (0, selected, len(planned), everything)
    scopes = spark.createDataFrame([scope], "scope bigint, selected map<string, array<string>>, n_words int, everything boolean")
    words = spark.createDataFrame([(0, i, len(planned), *w) for i, w in enumerate(planned)], "scope bigint, word_idx int, n_words int, word string, max_typos int, prefix boolean")
    kind = "word string, max_typos int, prefix boolean, term string, typos int, exact boolean, df bigint, rank int"
    kept = cap_candidates(scan_words(planned, index.terms)).collect() if planned else []
    candidates = spark.createDataFrame([tuple(r) for r in kept], kind)
    # The rows of one request are used at once; a lost block is computed again.
    scored = score(index, scopes, words, candidates, bool(selected)).persist()
    hits = index.size if everything else scored.count()
    pages = -(-hits // size)
    place = {"request_id": 0, "scope": 0, "hits_per_page": size, "nb_hits": hits, "nb_pages": pages, "page": min(page, max(pages - 1, 0)), "plain": bool(planned) and not selected}
    counts = Counter((r["word"], r["max_typos"], r["prefix"]) for r in kept)
    place["plan"] = [{"word": w[0], "maxTypos": w[1], "prefix": w[2], "candidates": counts[w]} for w in planned]
    return Batch(index, requests, scopes, words, candidates, scored, place)


def docs_passing(index: Index, chosen: DataFrame) -> DataFrame:
    """``(scope, doc_ord)`` of the documents that pass all facets of ``chosen(scope, selected)``; different filters are worked out once."""
    named = chosen.withColumn("filter", F.xxhash64(F.to_json(F.struct("selected"))))
    distinct = named.groupBy("filter").agg(F.first("selected").alias("selected"))
    asked = distinct.select("filter", F.size("selected").alias("n"), F.explode("selected").alias("facet", "values"))
    asked = asked.select("filter", "n", "facet", F.explode("values").alias("value"))
    found = asked.join(index.facet_values(), ["facet", "value"]).groupBy("filter", "doc_ord", "n").agg(F.count_distinct("facet").alias("m"))
    return found.filter("m = n").select("filter", "doc_ord").join(named.select("filter", "scope"), "filter").select("scope", "doc_ord")


_TRIED = "query_id {}, query string, place int"


def _try_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(query_id, [(word_idx, word, known, other terms)]) to the queries that are tried instead, in their order."""
    for batch in batches:
        rows, tried, places = [], [], []
        for row, words in enumerate(batch.column(1).to_pylist()):
            words.sort(key=lambda w: w["word_idx"])
            given = [w["word"] for w in words]
            others = [[o["term"] for o in sorted(w["others"], key=lambda o: o["place"])] for w in words]
            found = [q for q in suggest.candidate_queries(given, others, [w["known"] for w in words]) if q != " ".join(given)]
            rows += [row] * len(found)
            tried += found
            places += range(len(found))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(tried, pa.string()), pa.array(places, pa.int32())], names=["query_id", "query", "place"])


def suggestions(index: Index, queries: DataFrame) -> DataFrame:
    """``(query_id, place, suggestion)``: for each of ``queries(query_id, query)`` the first few queries near it that have hits, place from 0.

    Words are looked up once however many queries have them, and all queries
    that are tried are looked up in one batch: a text has hits if any of its words
    has a candidate, as every term is of some document.  Queries without words have none.
    """
    kind = dict(queries.dtypes)["query_id"]
    words = materialize(query_words(queries.select("query_id", "query", F.lit(True).alias("typo_tolerance"))).select("query_id", "word_idx", "word"), "words")
    distinct = words.select("word").distinct()
    near = suggest.alternatives(distinct, index.terms).groupBy("word").agg(F.collect_list(F.struct("place", "term")).alias("others"))
    known = index.terms.select(F.col("term").alias("word"), F.lit(True).alias("known"))
    looked = distinct.join(near, "word", "left").join(known, "word", "left")
    no_others = F.array().cast("array<struct<place: int, term: string>>")
    looked = looked.select("word", F.coalesce("known", F.lit(False)).alias("known"), F.coalesce("others", no_others).alias("others"))
    asked = words.join(looked, "word").groupBy("query_id").agg(F.collect_list(F.struct("word_idx", "word", "known", "others")).alias("w"))
    with brief_shuffles(index.spark):
        tried = materialize(asked.mapInArrow(_try_batch, _TRIED.format(kind)), "tried")
    held = tried.withColumn("of", F.xxhash64("query")).join(known_texts(index, tried.select(F.xxhash64("query").alias("query_id"), "query").distinct(), F.lit(True)).select(F.col("query_id").alias("of")), "of", "left_semi")
    order = Window.partitionBy("query_id").orderBy("place")
    ranked = held.select("query_id", (F.row_number().over(order) - 1).alias("place"), F.col("query").alias("suggestion"))
    return ranked.filter(F.col("place") < suggest.SUGGESTIONS)


def known_texts(index: Index, queries: DataFrame, tolerance: Column) -> DataFrame:
    """The ``query_id`` of those ``queries(query_id, query)`` that have a word with a candidate, so at least one hit; the dictionary alone tells."""
    words = materialize(query_words(queries.withColumn("typo_tolerance", tolerance)), "words")
    with brief_shuffles(index.spark):  # neighbourhoods take far more room than what comes out
        found = materialize(plan_candidates(words, index.terms).select(*WORD).distinct(), "found")
    return words.join(found, WORD, "left_semi").select("query_id").distinct()


def without_hits(index: Index, requests: DataFrame) -> DataFrame:
    """The ``requests(request_id, query, typo_tolerance, ...)`` whose text has no word with a candidate, whatever their filters; token-less ones are among them."""
    named = requests.withColumn("of", F.xxhash64(F.coalesce("query", F.lit("")), F.coalesce("typo_tolerance", F.lit(True))))
    texts = named.groupBy("of").agg(F.first("query").alias("query"), F.first("typo_tolerance").alias("typo_tolerance"))
    held = known_texts(index, texts.withColumnRenamed("of", "query_id"), F.col("typo_tolerance"))
    return named.join(held.select(F.col("query_id").alias("of")), "of", "left_anti").drop("of")


def count_hits(index: Index, queries: DataFrame) -> DataFrame:
    """``(query_id, n)``: the number of documents that the text of ``queries(query_id, query)`` matches, with typo tolerance; all of a token-less one."""
    asked = queries.withColumn("typo_tolerance", F.lit(True))
    words = materialize(query_words(asked), "words")
    matches = scorer.word_matches(plan_candidates(words, index.terms), index.postings)
    found = scorer.with_word_key(words).select("query_id", "wk").join(matches.select("wk", "doc_ord"), "wk")
    counts = found.groupBy("query_id").agg(F.count_distinct("doc_ord").alias("n"))
    sized = queries.select("query_id").join(words.select("query_id", F.lit(True).alias("worded")).distinct(), "query_id", "left").join(counts, "query_id", "left")
    every = F.lit(index.size)
    return sized.select("query_id", F.when(F.col("worded"), F.coalesce("n", F.lit(0))).otherwise(every).cast("bigint").alias("n"))
