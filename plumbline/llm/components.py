"""Connected components: the classes that links make, by large- and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import materialize

def _directed(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours, all greater ones (large) or all smaller ones and itself (small), are linked to its least neighbour."""
    around = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    met = around.join(least, "u")
    if large:
        return _directed(met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
    return _directed(met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(met.select("u", F.col("m").alias("v"))))


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, component)``: every node of a link with the least node that it is connected to.

    Links with a null end are left out; loops make components of one node; repeated links don't matter;
    an empty table gives no rows.  Each round is written, and only the number
    of its links and their sums come to the driver.  Rounds go on until one
    changes nothing; their number grows with the logarithm of the longest path.

    A node's links meet its least neighbour in a join by the node; the side of
    many rows for a hub with very many links is left to Spark's skew join
    (``spark.sql.adaptive.skewJoin.enabled``, on by default), which splits it over
    tasks, as the other side has one row for each node.
    """
    kind = dict(links.dtypes)[a]
    given = links.select(F.col(a).alias("u"), F.col(b).alias("v")).dropna()
    nodes = given.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    edges = materialize(_directed(given), "edges")
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = mark(edges)
    while True:
        edges = materialize(_star(_star(edges, True), False), "edges")
        after = mark(edges)
        if after == before:
            break
        before = after
    found = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").cast(kind).alias("component"))


def grouped(rows: DataFrame, key: str, links: DataFrame, a: str, b: str) -> DataFrame:
    """``(key, class, links)``: one row per row of ``rows`` with the least key of its class and its number of links; null keys are left out."""
    classes = components(links, a, b)
    ends = links.select(F.explode(F.array(a, b)).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    joined = rows.select(F.col(key).alias("node")).dropna().join(classes, "node", "left").join(ends, "node", "left")
    return joined.select(F.col("node").alias(key), F.coalesce("component", "node").alias("class"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))
