"""Sets of documents: frames of ``doc_ord``, and their packed form, bitmaps by bucket.

A packed set is ``(bucket, bitmap)``, a row per 32,768 ordinals that holds any
member; sets are combined bucket by bucket, so no set is ever one object.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.index import Index


def every(index: Index) -> DataFrame:
    return index.docs.select("doc_ord")


def from_ordinals(spark: SparkSession, ordinals: list[int]) -> DataFrame:
    return spark.createDataFrame([(o,) for o in sorted(set(ordinals))], "doc_ord bigint")


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, "doc_ord", "left_semi")


def unite(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def without(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, "doc_ord", "left_anti")


def pack(docs: DataFrame, *keys: str) -> DataFrame:
    """``docs(keys..., doc_ord)`` to ``(keys..., bucket, bitmap)``; repeated ordinals don't matter, null ones are left out."""
    given = docs.filter(F.col("doc_ord").isNotNull())
    bucket = F.bitmap_bucket_number(F.col("doc_ord") + 1).alias("bucket")
    return given.groupBy(*keys, bucket).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("doc_ord") + 1)).alias("bitmap"))


def combine(sets: list[DataFrame], both: bool) -> DataFrame:
    """Intersection (``both``) or union of packed sets without keys."""
    rows = reduce(DataFrame.unionByName, sets)
    if not both:
        return rows.groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    met = rows.groupBy("bucket").agg(F.bitmap_and_agg("bitmap").alias("bitmap"), F.count("*").alias("n"))
    return met.filter(F.col("n") == len(sets)).drop("n")


def size(packed: DataFrame) -> int:
    return packed.agg(F.coalesce(F.sum(F.bitmap_count("bitmap")), F.lit(0)).alias("n")).first()["n"]


def common_counts(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """``(a, b, n)``: the number of documents that a set of ``left(a, doc_ord)`` and one of ``right(b, doc_ord)`` have in common, if any.

    Sets meet in their documents, so what is made is a row per document and pair
    of sets that hold it, never a pair of sets that don't meet.  A document counts once however often it stands in a set.
    """
    met = left.select(a, "doc_ord").distinct().join(right.select(b, "doc_ord").distinct(), "doc_ord")
    return met.groupBy(a, b).agg(F.count("*").alias("n"))
