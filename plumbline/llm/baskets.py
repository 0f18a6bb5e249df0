"""Items that appear together: pair counts, lift and conviction by basket collapsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import materialize


def collapse_baskets(df: DataFrame, items: Column) -> DataFrame:
    """``(basket, weight)``: identical item sets grouped into one row.

    ``items`` must be an array column of distinct non-null strings.  The order
    of the items doesn't matter.  Records without items keep the empty basket,
    as they count for the chance of the others.  The count is pre-aggregated
    before the shuffle, so a basket that a third of all rows have is one row
    per task.
    """
    return df.select(F.array_sort(items).alias("basket")).groupBy("basket").agg(F.count("*").alias("weight"))


def co_occurrences(df: DataFrame, items: Column, min_count: int = 1, min_share: float = 0.0) -> DataFrame:
    """Each pair of items in the same record, with its count and its excess over chance.

    Columns ``item_a < item_b, n, n_a, n_b, n_all, lift, conviction``: ``n``
    records hold both, ``n_a`` and ``n_b`` either, ``n_all`` is the number of
    records (also those without items); lift is ``n * n_all / (n_a * n_b)``,
    conviction of ``a -> b`` is ``(1 - n_b / n_all) / (1 - n / n_a)``, null
    where a always comes with b.  Only pairs with at least ``min_count``
    records and a share of ``min_share`` of all records come out.

    Pairs are enumerated once per distinct basket.  Null arrays count as empty;
    an empty table gives no rows; one item alone gives no pair; repeated rows
    count as often as they stand.
    """
    baskets = materialize(collapse_baskets(df, items), "baskets")
    total = baskets.agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("n")).first()["n"]
    singles = baskets.select(F.explode("basket").alias("item"), "weight").groupBy("item").agg(F.sum("weight").alias("n"))
    firsts = baskets.filter(F.size("basket") > 1).select("basket", "weight", F.posexplode("basket").alias("at", "item_a"))
    rest = F.slice("basket", F.col("at") + 2, F.greatest(F.size("basket") - F.col("at") - 1, F.lit(0)))
    least = max(min_count, -(-int(total * min_share * 10**9) // 10**9))
    pairs = (
        firsts.select("item_a", F.explode(rest).alias("item_b"), "weight")
        .groupBy("item_a", "item_b").agg(F.sum("weight").alias("n")).filter(F.col("n") >= least)
    )
    all_ = F.lit(total).cast("bigint")
    n, a, b = (F.col(c).cast("double") for c in ("n", "n_a", "n_b"))
    return (
        pairs.join(singles.select(F.col("item").alias("item_a"), F.col("n").alias("n_a")), "item_a")
        .join(singles.select(F.col("item").alias("item_b"), F.col("n").alias("n_b")), "item_b")
        .select(
            "item_a", "item_b", "n", "n_a", "n_b", all_.alias("n_all"),
            (n * all_ / (a * b)).alias("lift"),
            F.when(F.col("n") < F.col("n_a"), (1 - b / all_) / (1 - n / a)).alias("conviction"),
        )
    )
