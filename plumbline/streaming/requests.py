"""A stream of requests: the latest of every channel wins, and micro-batches are answered in one job each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from plumbline.operators.index import Index
from plumbline.plans import batch
from plumbline.session import scratch


def latest_requests(requests: DataFrame, channel: str = "channel", order: str = "request_id") -> DataFrame:
    """Of each channel the request with the greatest ``order``, all its columns; null channels are one of their own.

    Works on a table and, in complete mode, on a stream: the state is one row per channel.
    """
    rest = [c for c in requests.columns if c != channel]
    newest = requests.filter(F.col(order).isNotNull()).groupBy(channel).agg(F.max_by(F.struct(*rest), order).alias("r"))
    return newest.select(channel, "r.*")


def stale_answers(requests: DataFrame, channel: str = "channel", order: str = "request_id", sent: str = "sent_at", arrival: str = "arrived_at") -> DataFrame:
    """``requests`` with ``stale``: whether a later one of its channel had been sent when its answer arrived.

    Of a request without a time of sending, none is taken to have been sent; one
    without an arrival isn't stale.  Channels may be hot: the latest number sent
    is taken over whole hours first, then within the hour.
    """
    rows = requests.withColumn("__row", F.struct(*requests.columns))
    out = F.lit(None).cast("bigint")
    sends = rows.filter(F.col(sent).isNotNull()).select(F.col(channel).alias("c"), F.col(sent).alias("t"), F.lit(0).alias("kind"), F.col(order).alias("id"), F.lit(None).cast(rows.schema["__row"].dataType).alias("__row"))
    comes = rows.filter(F.col(arrival).isNotNull()).select(F.col(channel).alias("c"), F.col(arrival).alias("t"), F.lit(1).alias("kind"), out.alias("id"), "__row")
    line = sends.unionByName(comes).withColumn("hour", F.date_trunc("hour", "t"))
    hours = line.groupBy("c", "hour").agg(F.max("id").alias("m"))
    before = Window.partitionBy("c").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    hours = hours.select(F.col("c").alias("hc"), F.col("hour").alias("hh"), F.max("m").over(before).alias("ahead"))
    inside = Window.partitionBy("c", "hour").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
    near = line.withColumn("near", F.max("id").over(inside)).filter("kind = 1")
    seen = near.join(hours, F.col("c").eqNullSafe(F.col("hc")) & F.col("hour").eqNullSafe(F.col("hh")))
    late = F.col(f"__row.{order}") < F.greatest("near", "ahead")
    stale = seen.select("__row.*", F.coalesce(late, F.lit(False)).alias("stale"))
    return stale.unionByName(requests.filter(F.col(arrival).isNull()).withColumn("stale", F.lit(False)))


def read_requests(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def answer_stream(requests: DataFrame, index: Index, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Answer each micro-batch's requests against a static index; ``sink(hits, epoch)`` must be idempotent per epoch.

    A request that was delivered more than once within a micro-batch is answered once.
    ``sink`` must save the hits: the tables that a micro-batch has written are removed after it.
    """

    def answer(rows: DataFrame, epoch: int) -> None:
        once = rows.dropDuplicates(["request_id"])
        with scratch():
            sink(batch.prepare(index, once).hits(), epoch)

    return requests.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
