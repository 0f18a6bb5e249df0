"""Joins that a hot key doesn't hold up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_by_heat(rows: DataFrame, few: DataFrame, on: list[str], hot: Column) -> DataFrame:
    """The inner join of ``rows`` with ``few``, which has each key once; rows of keys that are ``hot`` aren't shuffled.

    ``hot`` is a condition on ``few``, which is broadcast as far as it holds; it
    must be one that only a bounded number of keys can meet, such as having more
    than a thousandth of all rows.  Rows with a null in a key have no partner.
    """
    met = rows.join(F.broadcast(few.filter(hot).withColumn("__hot", F.lit(True))), on, "left")
    cold = met.filter(F.col("__hot").isNull()).select(rows.columns).join(few.filter(~hot), on)
    return met.filter(F.col("__hot")).drop("__hot").select(cold.columns).unionByName(cold)
