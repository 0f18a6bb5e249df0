"""Matching and scoring: candidate terms against postings, for many queries at once.

A word (text, typo budget, prefix flag) is matched once, however many queries
have it.  Proximity, the only criterion that needs positions, is worked out
just for documents that can still reach the asked ranks by the criteria before it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from plumbline.operators.index import ATTRIBUTE_SPAN
from plumbline.operators.planner import WORD

PROXIMITY_CAP = 8
CRITERIA = ("typos", "words", "proximity", "attribute", "exactness", "popularity")
#: +1: lower wins, -1: higher wins.
DIRECTIONS = {"typos": 1, "words": -1, "proximity": 1, "attribute": 1, "exactness": -1, "popularity": -1}


def with_word_key(df: DataFrame) -> DataFrame:
    """``df`` with ``wk``, a number for (word, max_typos, prefix)."""
    return df.withColumn("wk", F.xxhash64(*WORD))


def word_matches(candidates: DataFrame, postings: DataFrame) -> DataFrame:
    """``(wk, doc_ord, typos, exact, attr)``: the least typos, any exact candidate and the best attribute, each by itself."""
    hits = with_word_key(candidates).select("wk", "term", "typos", "exact").join(postings.select("term", "doc_ord", "attr"), "term")
    return hits.groupBy("wk", "doc_ord").agg(F.min("typos").alias("typos"), F.max("exact").alias("exact"), F.min("attr").alias("attr"))


def scored_documents(words: DataFrame, matches: DataFrame, key: str) -> DataFrame:
    """``(key, doc_ord, words, typos, exactness, attribute)`` of all documents that match any word of a query."""
    hits = with_word_key(words).select(key, "wk").join(matches, "wk")
    return hits.groupBy(key, "doc_ord").agg(
        F.count("*").cast("int").alias("words"), F.sum("typos").cast("int").alias("typos"),
        F.sum(F.col("exact").cast("int")).cast("int").alias("exactness"), F.min("attr").alias("attribute"),
    )


def least_distances(pairs: list[tuple[list[int], list[int]]], cap: int = PROXIMITY_CAP) -> np.ndarray:
    """Least directed distance between two sorted position lists, for many pairs of lists at once.

    From a to a later b it is b - a, to one that isn't later a - b + 1.
    """
    out = np.full(len(pairs), cap, np.int64)
    first = np.array([x for a, _ in pairs for x in a], np.int64)
    second = np.array([x for _, b in pairs for x in b], np.int64)
    if not len(first) or not len(second):
        return out
    row = np.repeat(np.arange(len(pairs)), [len(a) for a, _ in pairs])
    wide = np.int64(1) << 40
    other = np.repeat(np.arange(len(pairs)), [len(b) for _, b in pairs]) * wide + second
    mine = row * wide + first
    after = np.searchsorted(other, mine, "right")
    ahead = np.where(after < len(other), other[np.minimum(after, len(other) - 1)] - mine, cap)
    back = np.where(after > 0, mine - other[np.maximum(after - 1, 0)] + 1, cap)
    np.minimum.at(out, row, np.minimum(np.minimum(ahead, back), cap))
    return out


def _proximity_batch(lists: pa.Array) -> pa.Array:
    rows = lists.to_pylist()
    pairs, of = [], []
    for i, words in enumerate(rows):
        for a, b in zip(words[:-1], words[1:], strict=True):
            pairs.append((a, b))
            of.append(i)
    total = np.bincount(np.array(of, np.int64), least_distances(pairs), len(rows)) if pairs else np.zeros(len(rows))
    return pa.array(total.astype(np.int32))


proximity_column = F.arrow_udf(_proximity_batch, IntegerType())


def global_position(attr: Column, position: Column) -> Column:
    return attr * F.lit(ATTRIBUTE_SPAN) + position


def proximities(pairs: DataFrame, words: DataFrame, candidates: DataFrame, postings: DataFrame, key: str) -> DataFrame:
    """``(key, doc_ord, proximity)`` of ``pairs(key, doc_ord)``: least distances of consecutive matched words, summed."""
    needed = pairs.join(with_word_key(words).select(key, "word_idx", "wk"), key)
    asked = needed.select("wk", "doc_ord").distinct()
    hits = with_word_key(candidates).select("wk", "term").join(postings, "term").join(asked, ["wk", "doc_ord"], "left_semi")
    placed = F.transform("positions", lambda p: global_position(F.col("attr"), p))
    places = hits.groupBy("wk", "doc_ord").agg(F.array_sort(F.flatten(F.collect_list(placed))).alias("places"))
    listed = needed.join(places, ["wk", "doc_ord"]).groupBy(key, "doc_ord").agg(F.array_sort(F.collect_list(F.struct("word_idx", "places"))).alias("w"))
    return listed.select(key, "doc_ord", proximity_column(F.transform("w", lambda x: x["places"])).alias("proximity"))


def ranking_order(popularity: str = "popularity") -> list[Column]:
    return [F.asc("typos"), F.desc("words"), F.asc("proximity"), F.asc("attribute"), F.desc("exactness"), F.desc_nulls_last(popularity), F.asc("doc_ord")]


def contenders(scored: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """The rows of ``scored`` that can be among the first ``asked(key, k)`` of their query.

    Counted by (typos, words): a tier is out if the tiers before it hold k documents.
    """
    tiers = scored.groupBy(key, "typos", "words").agg(F.count("*").alias("n"))
    before = Window.partitionBy(key).orderBy("typos", F.desc("words")).rowsBetween(Window.unboundedPreceding, -1)
    tiers = tiers.withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0))).join(asked, key).filter("ahead < k")
    return scored.join(tiers.select(key, "typos", "words", "k"), [key, "typos", "words"])


def ranked_documents(
    scored: DataFrame, asked: DataFrame, words: DataFrame, candidates: DataFrame, postings: DataFrame, docs: DataFrame, key: str, deepest: int
) -> DataFrame:
    """``(key, doc_ord, id, rank, criteria...)``: of each query the first ``asked(key, k)`` documents, rank from 1.

    ``deepest`` is the greatest k; as a constant it lets every task drop rows before the shuffle.
    """
    near = contenders(scored, asked, key)
    near_words = proximities(near.filter("words > 1").select(key, "doc_ord"), words, candidates, postings, key)
    full = near.join(near_words, [key, "doc_ord"], "left").withColumn("proximity", F.coalesce("proximity", F.lit(0)))
    full = full.join(docs.select("doc_ord", "id", "popularity"), "doc_ord")
    ranked = full.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*ranking_order())))
    return ranked.filter((F.col("rank") <= deepest) & (F.col("rank") <= F.col("k"))).select(key, "doc_ord", "id", "rank", *CRITERIA)


def with_tie_break(ranked: DataFrame, key: str) -> DataFrame:
    """``ranked`` with ``tie_break``: the first criterion that differs from the hit one rank before; null if none does."""
    order = Window.partitionBy(key).orderBy("rank")
    chain = F.lit(None)
    for name in reversed(CRITERIA):
        before = F.lag(name).over(order)
        this = F.struct(F.lit(name).alias("criterion"), before.cast("double").alias("previous"), F.col(name).cast("double").alias("current"))
        chain = F.when(~F.col(name).eqNullSafe(before), this).otherwise(chain)
    return ranked.withColumn("tie_break", F.when(F.lag("rank").over(order).isNotNull(), chain))


def tie_break(before, this) -> dict | None:
    """``with_tie_break`` for two rows on the driver."""
    for name in CRITERIA:
        if before[name] != this[name]:
            number = lambda v: None if v is None else float(v)
            return {"criterion": name, "previous": number(before[name]), "current": number(this[name])}
    return None


def matched_terms(hits: DataFrame, words: DataFrame, candidates: DataFrame, postings: DataFrame, key: str) -> DataFrame:
    """``(key, doc_ord, matches)`` of ``hits(key, doc_ord)``: the distinct (word, typos, term, exact) that matched, in that order."""
    needed = hits.select(key, "doc_ord").join(with_word_key(words).select(key, "word_idx", "word", "wk"), key)
    asked = needed.select("doc_ord").distinct()
    found = with_word_key(candidates).select("wk", "term", "typos", "exact").join(
        postings.select("term", "doc_ord").join(asked, "doc_ord", "left_semi").distinct(), "term"
    )
    each = F.struct("word_idx", "typos", "term", "exact", "word")
    return needed.join(found, ["wk", "doc_ord"]).groupBy(key, "doc_ord").agg(F.array_sort(F.collect_set(each)).alias("matches"))


#: Bits of each packed criterion, the most important first, and what a value is taken from where higher wins.
PACKED = {"typos": (6, None), "words": (5, 31), "proximity": (7, None), "attribute": (2, None), "exactness": (5, 31), "pop_rank": (21, None)}


def packed_score(columns: dict[str, Column]) -> Column:
    """All criteria in one BIGINT, lower is better; values saturate at their width."""
    score = F.lit(0).cast("bigint")
    for name, (bits, top) in PACKED.items():
        value = columns[name].cast("bigint")
        value = F.greatest(F.lit(0), F.lit(top) - value) if top else value
        score = F.shiftleft(score, bits).bitwiseOR(F.least(value, F.lit((1 << bits) - 1)))
    return score
