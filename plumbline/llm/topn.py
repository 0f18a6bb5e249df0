"""Top N items within every group by partition lower bounds."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from plumbline.session import materialize

#: Held rows are cut back to the local best when this many new ones have come.
HELD = 200_000


def _local_best(n: int, kind: pa.DataType):
    def best(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["score", "item"], ascending=[False, True], kind="stable")
        return df[df.groupby("group", sort=False).cumcount() < n]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pd.DataFrame | None = None
        waiting: list[pd.DataFrame] = []
        count = 0

        def fold() -> pd.DataFrame | None:
            parts = ([] if held is None else [held]) + waiting
            return best(pd.concat(parts, ignore_index=True)) if parts else None

        for batch in batches:
            if batch.num_rows:
                waiting.append(batch.to_pandas(types_mapper=pd.ArrowDtype))
                count += batch.num_rows
            if count >= HELD + (0 if held is None else len(held)):
                held, waiting, count = fold(), [], 0
        held = fold()
        if held is None or held.empty:
            return
        rank = held.groupby("group", sort=False).cumcount()
        held["bound"] = held["score"].where(rank == n - 1)
        yield from pa.Table.from_pandas(held, schema=pa.schema(
            [("group", pa.string()), ("score", kind), ("item", pa.string()), ("bound", kind)]
        ), preserve_index=False).to_batches(max_chunksize=50_000)

    return run


def top_n(rows: DataFrame, group: str, score: str, item: str, n: int) -> DataFrame:
    """``(group, item, score, rank)``: of each group the ``n`` rows of highest score, ties by the smaller item.

    ``score`` is a column of whole numbers, which come out as bigint, or of any other type
    with an order, such as double, decimal, date or timestamp, which it keeps; -0.0 equals 0.0.
    ``group`` and ``item`` are strings.  Rows with a null or NaN in any of the three are left out.  Repeated rows each take a place, in
    an order that no longer matters as they are equal.  Groups with fewer than
    ``n`` rows come out whole; an empty table gives no rows.

    Each partition keeps its ``n`` best rows per group and reports its n-th best
    score, which is a lower bound for the group's n-th best; rows under the
    greatest bound of their group are dropped before the survivors are ranked.
    What is shuffled is at most ``n`` rows per group and partition, so a group
    with a third of all rows is no larger there than any other.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    kind = dict(rows.dtypes)[score]
    kind = "bigint" if kind in ("tinyint", "smallint", "int") else kind
    value = F.col(score).cast(kind)
    value = value + F.lit(0.0).cast(kind) if kind in ("float", "double") else value
    given = rows.select(F.col(group).cast("string").alias("group"), value.alias("score"), F.col(item).cast("string").alias("item")).dropna()
    local = given.mapInArrow(_local_best(n, to_arrow_type(given.schema["score"].dataType)), f"group string, score {kind}, item string, bound {kind}")
    local = materialize(local, "topn")
    bounds = local.filter(F.col("bound").isNotNull()).groupBy("group").agg(F.max("bound").alias("least"))
    kept = local.join(bounds, "group", "left").filter(F.col("least").isNull() | (F.col("score") >= F.col("least")))
    order = Window.partitionBy("group").orderBy(F.desc("score"), "item")
    return (
        kept.select("group", "item", "score", F.row_number().over(order).alias("rank")).filter(F.col("rank") <= n)
        .select(F.col("group").alias(group), F.col("item").alias(item), F.col("score").alias(score), "rank")
    )
