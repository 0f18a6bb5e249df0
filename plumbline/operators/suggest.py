""""Did you mean": alternatives for words, and queries made of them that have hits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.planner import near_strings

ALTERNATIVES, CANDIDATES, SUGGESTIONS = 4, 24, 3


def alternatives(words: DataFrame, terms_: DataFrame, limit: int = ALTERNATIVES) -> DataFrame:
    """``(word, term, distance, df, place)``: the nearest other terms of ``words(word)``, ties by frequency, then by term."""
    asked = words.select("word").distinct().filter("word <> ''").withColumn("k", F.when(F.length("word") >= 4, 2).otherwise(1))
    strings = terms_.select(F.col("term").alias("s"), F.when(F.col("n_chars") >= 2, 2).otherwise(1).alias("depth"))
    near = near_strings(asked, strings).filter("s <> word").join(terms_.select(F.col("term").alias("s"), "df").hint("merge"), "s")
    order = Window.partitionBy("word").orderBy("distance", F.desc("df"), "s")
    ranked = near.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)
    return ranked.select("word", F.col("s").alias("term"), "distance", "df", "place")


def candidate_queries(words: list[str], others: list[list[str]], known: list[bool]) -> list[str]:
    """Replacement queries in the order in which they are tried, at most ``CANDIDATES``."""
    tried: list[str] = []
    strange = [i for i, k in enumerate(known) if not k]
    varied = strange or list(range(len(words)))
    base = list(words)
    if strange:
        for i in strange:
            base[i] = others[i][0] if others[i] else words[i]
        tried.append(" ".join(base))
    for i in varied:
        tried += [" ".join([*base[:i], other, *base[i + 1 :]]) for other in others[i]]
    if len(words) > 1:
        tried += [" ".join(words[:i] + words[i + 1 :]) for i in varied]
    return list(dict.fromkeys(tried))[:CANDIDATES]


def suggest(words: list[str], others: list[list[str]], known: list[bool], counts: Callable[[list[str]], dict[str, int]], limit: int = SUGGESTIONS) -> list[str]:
    """The first candidate queries that have hits; ``counts`` answers for all of them at once."""
    tried = [q for q in candidate_queries(words, others, known) if q != " ".join(words)]
    hits = counts(tried) if tried else {}
    return [q for q in tried if hits.get(q, 0) > 0][:limit]
