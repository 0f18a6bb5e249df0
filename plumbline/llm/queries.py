"""The problems' queries over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.text import terms
from plumbline.functions.values import clean_values
from plumbline.llm import burst, distinctive, leakage, lookalike, mixing, near_duplicates, ranking, topn
from plumbline.llm.baskets import co_occurrences
from plumbline.operators.current import latest


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def current(spark: SparkSession, sf: str, *columns) -> DataFrame:
    """The current records: of each id the row with the latest updated_at."""
    return latest(_table(spark, sf, "records"), "id", ["updated_at", "doc_ord"], list(columns))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    rows = current(spark, sf, "title", "description")
    return near_duplicates.near_duplicates(rows, "id", ["title", "description"], counted=1, least_terms=12, t=0.6)


def p1_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Every current record with the class of the same entry that it is in, and its number of links."""
    rows = current(spark, sf, "title", "description")
    return near_duplicates.near_duplicate_groups(rows, "id", ["title", "description"], counted=1, least_terms=12, t=0.6)


def _genre_pairs(spark: SparkSession, sf: str, **least) -> DataFrame:
    return co_occurrences(current(spark, sf, "genres"), clean_values(F.col("genres")), **least)


def p2_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Every pair of genre values that stand together, with its count and excess over chance."""
    return _genre_pairs(spark, sf)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    n, a, b, all_ = (F.col(c).cast("decimal(19,0)") for c in ("n", "n_a", "n_b", "n_all"))
    found = _genre_pairs(spark, sf, min_count=5, min_share=1 / 2000).filter((n >= 5) & (n * 2000 >= all_) & (n * all_ >= a * b * 3))
    return found.select(F.col("item_a").alias("genre_a"), F.col("item_b").alias("genre_b"))


def _listed(values: list[str] | None) -> list[str]:
    return values or []


def p3_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Every distinct term and genre value with its counts and mark."""
    rows = current(spark, sf, "title", "description", clean_values(F.col("genres")).alias("genres"))
    counts = burst.count_values(rows, {"title": terms, "description": terms, "genres": _listed})
    total = _table(spark, sf, "records").agg(F.count_distinct("id").alias("n")).first()["n"]
    return burst.marked_values(counts, total)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return p3_counts(spark, sf).filter(F.col("mark").isNotNull()).select("field", "value", "mark")


def p4_ranking(spark: SparkSession, sf: str) -> DataFrame:
    rows = current(spark, sf, "rating", "popularity")
    rows = rows.filter(~F.isnan("rating") & F.col("rating").between(0, 10) & (F.col("popularity") >= 0))
    return ranking.combined_ranking(rows, "id", {"rating": 1, "popularity": 1})


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    above_r, above_p = F.col("above_rating") * 100, F.col("above_popularity") * 100
    return p4_ranking(spark, sf).filter((above_r < F.col("ranked")) & (above_p < F.col("ranked"))).select("id")


def p5_top(spark: SparkSession, sf: str) -> DataFrame:
    rows = current(spark, sf, clean_values(F.col("genres")).alias("genres"), "popularity").filter(F.col("popularity") >= 0)
    rows = rows.select(F.explode("genres").alias("genre"), "id", "popularity")
    return topn.top_n(rows, "genre", "popularity", "id", 5)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return p5_top(spark, sf).select("genre", "id")


def p6_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Every term of every current record with its weight."""
    rows = current(spark, sf, "title", "description")
    return distinctive.distinctive_terms(rows, "id", ["title", "description"])


def p6_terms(spark: SparkSession, sf: str) -> DataFrame:
    """The ten most distinctive terms of every current record."""
    rows = current(spark, sf, "title", "description")
    return distinctive.distinctive_terms(rows, "id", ["title", "description"], top=10)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    rows = current(spark, sf, "title", "description")
    found = distinctive.distinctive_terms(rows, "id", ["title", "description"], min_count=3, max_records=5)
    return found.select("id", "term")


def p7_leaks(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and the items of which they hold a passage of ten terms, with at most one edit."""
    docs, items = _table(spark, sf, "documents"), _table(spark, sf, "eval_items")
    return leakage.leaks(docs, "doc_id", "text", items, "item_id", "text", window=10, budget=1)


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return p7_leaks(spark, sf).filter("run >= 10").select("doc_id", "item_id")


def _mix(spark: SparkSession, sf: str) -> mixing.Mix:
    docs, targets = _table(spark, sf, "documents"), _table(spark, sf, "mix_targets")
    return mixing.mix(docs, "doc_id", "text", "source", targets)


def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    """The parts of documents that the mix uses, with the number of times."""
    return _mix(spark, sf).documents


def p8_report(spark: SparkSession, sf: str) -> DataFrame:
    """Each source with its target and the share it reaches."""
    return _mix(spark, sf).report


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return p8_report(spark, sf).filter(~F.col("reachable")).select("source")


def p9_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with the hash of its canonical text and whether that differs from the text."""
    docs = lookalike.with_canonical(_table(spark, sf, "documents").select("doc_id", "text"), "text")
    return docs.select("doc_id", F.md5("canonical").alias("canonical_md5"), (F.col("canonical") != F.col("text")).alias("changed"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = lookalike.look_alike_pairs(_table(spark, sf, "documents"), "doc_id", "text")
    return pairs.select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_groups, p2_pairs, p2_found, p3_counts, p3_found, p4_ranking, p4_found, p5_top, p5_found, p6_weights, p6_terms,
        p6_found, p7_leaks, p7_found, p8_mix, p8_report, p8_found, p9_texts, p9_found,
    )
}
