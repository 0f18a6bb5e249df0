"""Mixing sources to target weights by a low-discrepancy schedule.

The mix is a row of slots of equally many tokens.  Golden-ratio points, mapped
through the cumulative weights, give each slot its source, so every stretch of
the mix is close to the target shares.  A source's shuffled documents, one after
the other, are cut into blocks of a slot's tokens, so a document can be in
several blocks and only the last block of a source can be shorter.  The k-th slot of a source takes its
k-th block, starting again after the last one as
often as the source's documents may be repeated; a slot whose source is used
up stays empty.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.ordinals import running_totals
from plumbline.session import materialize

#: A public byte-level tokenizer; its path is a parameter of every function here.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Slots are ranked in chunks of so many.
CHUNK = 1 << 16
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def token_counts(df: DataFrame, text: str, path: str = TOKENIZER) -> DataFrame:
    """``df`` with the number of tokens of ``text`` in column ``tokens``; a null text has none."""

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        for batch in texts:
            counts: list[int] = []
            values = [t or "" for t in batch.to_pylist()]
            for at in range(0, len(values), 256):
                counts += [len(e) for e in tokenizer.encode_batch_fast(values[at : at + 256], add_special_tokens=False)]
            yield pa.array(counts, pa.int64())

    run.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return df.withColumn("tokens", F.arrow_udf(run, "bigint")(text))


def source_name(source: Column) -> Column:
    """A source without surrounding blanks, in lower case."""
    return F.lower(F.regexp_replace(source, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


@dataclass
class Mix:
    documents: DataFrame
    report: DataFrame


def _schedule(shares: list[float]):
    """Slot numbers to the place of their source in ``shares``."""
    ends = np.cumsum(shares)
    ends = ends / ends[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = batch.column(0).to_numpy()
            point = ((slot.astype(np.uint64) + np.uint64(1)) * _GOLDEN >> np.uint64(11)) / 2.0**53
            place = np.minimum(np.searchsorted(ends, point, "right"), len(ends) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(place.astype(np.int32))], names=["slot", "place"])

    return run


def mix(
    docs: DataFrame, key: str, text: str, source: str, targets: DataFrame, mix_tokens: int | None = None, block_tokens: int = 1024,
    seed: int = 17, tokenizer: str = TOKENIZER,
) -> Mix:
    """Mix ``docs`` so that each source of ``targets(source, target_share, max_repeats)`` has its share of the tokens.

    The mix has room for ``mix_tokens`` tokens, by default as many as all
    documents have together (whatever their source).  ``documents`` are
    ``(key, source, first_token, tokens, repeats, first_slot)``, a row for each used document and block that
    it is in: where its part begins, how many tokens it has, and the
    number of times that it is used; ``report`` has a row per target:
    ``source, target_share, max_repeats, documents, tokens, capacity_tokens,
    target_tokens, mixed_tokens, actual_share, empty_slots, reachable``, where
    capacity is what the source has with all its repeats and ``reachable``
    says whether that is at least the target.

    Sources are compared trimmed and in lower case; a target listed twice adds
    its shares and takes the greatest repeats, one with a null source or share
    is left out, and null or negative repeats or shares count as 0.  Documents
    without tokens, of a null or an unlisted source, or with a null key are
    never used, but all of them count in the corpus.  A listed source without
    documents is reported with zeros.  Empty tables give an empty mix.

    The order within a source is a seeded hash; tokens before each document are
    summed over range partitions, so no source is ever gathered in one task.
    A source that can reach its target misses it by the few slots by which golden-ratio points differ from
    their shares, and by what its last block lacks.
    """
    wanted = (
        targets.select(source_name(F.col("source")).alias("source"), F.greatest(F.col("target_share"), F.lit(0.0)).alias("target_share"), F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).cast("bigint").alias("max_repeats"))
        .filter(F.col("source").isNotNull() & F.col("target_share").isNotNull())
        .groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    )
    sized = token_counts(docs.select(F.col(key).alias("key"), F.col(text).alias("text"), source_name(F.col(source)).alias("source")), "text", tokenizer)
    sized = materialize(sized.select("key", "source", "tokens"), "sized")
    total = sized.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n")).first()["n"]
    room = total if mix_tokens is None else mix_tokens
    usable = sized.filter(F.col("key").isNotNull() & (F.col("tokens") > 0))
    held = usable.groupBy("source").agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens"))
    # One row per target: a list that people write, not one that grows with the corpus.
    plan = wanted.join(held, "source", "left").fillna(0, ["documents", "tokens"]).orderBy("source").collect()
    spark = docs.sparkSession
    blocks = {p["source"]: -(-p["tokens"] // block_tokens) for p in plan}
    kinds = "source string, place int, target_share double, max_repeats bigint, documents bigint, tokens bigint, base bigint, blocks bigint"
    rows, base = [], 0
    for place, p in enumerate(plan):
        rows.append((p["source"], place, p["target_share"], p["max_repeats"], p["documents"], p["tokens"], base, blocks[p["source"]]))
        base += p["tokens"]
    known = F.broadcast(spark.createDataFrame(rows, kinds))

    order = usable.join(F.broadcast(known.select("source", "base")), "source").withColumn("shuffle", F.md5(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string"))))
    order = running_totals(order, ["source", "shuffle", "key"], "tokens", "before")
    begin = (F.col("before") - F.col("base")).alias("begin")
    span = F.explode(F.sequence(F.expr(f"begin div {block_tokens}"), F.expr(f"(begin + tokens - 1) div {block_tokens}")))
    blocked = order.select("key", "source", "tokens", begin).withColumn("block", span)
    low, high = F.greatest("begin", F.col("block") * block_tokens), F.least(F.col("begin") + F.col("tokens"), (F.col("block") + 1) * block_tokens)
    blocked = blocked.select("key", "source", "block", (low - F.col("begin")).alias("first_token"), (high - low).alias("tokens"))

    slots = -(-room // block_tokens) if plan and sum(p["target_share"] for p in plan) > 0 else 0
    chosen = spark.range(slots).withColumnRenamed("id", "slot")
    chosen = chosen.mapInArrow(_schedule([p["target_share"] for p in plan] or [1.0]), "slot bigint, place int")
    chosen = materialize(chosen.withColumn("chunk", F.floor(F.col("slot") / CHUNK).cast("bigint")), "slots")
    counts = chosen.groupBy("place", "chunk").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("place").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("place", "chunk", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("place", "chunk").orderBy("slot")
    ranked = chosen.withColumn("k", F.row_number().over(inside) - 1).join(counts, ["place", "chunk"])
    ranked = ranked.join(known, "place").withColumn("k", F.col("k") + F.col("ahead"))
    fits = F.col("k") < F.col("blocks") * F.col("max_repeats")
    ranked = ranked.select("slot", "source", fits.alias("fits"), F.when(fits, F.expr("k % blocks")).alias("block"))
    ranked = materialize(ranked, "ranked")
    uses = ranked.filter("fits").groupBy("source", "block").agg(F.count("*").alias("repeats"), F.min("slot").alias("first_slot"))
    mixed = blocked.join(uses, ["source", "block"]).select(F.col("key").alias(key), "source", "first_token", "tokens", "repeats", "first_slot")
    mixed = materialize(mixed, "mix")

    got = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("mixed_tokens"))
    whole = mixed.agg(F.sum(F.col("tokens") * F.col("repeats")).alias("n")).first()["n"] or 0
    empty = ranked.filter("not fits").groupBy("source").agg(F.count("*").alias("empty_slots"))
    report = known.join(got, "source", "left").join(empty, "source", "left").fillna(0, ["mixed_tokens", "empty_slots"])
    capacity, target = F.col("tokens") * F.col("max_repeats"), F.col("target_share") * F.lit(room)
    report = report.select(
        "source", "target_share", "max_repeats", "documents", "tokens", capacity.alias("capacity_tokens"), target.alias("target_tokens"),
        "mixed_tokens", (F.col("mixed_tokens") / F.lit(max(whole, 1))).alias("actual_share"), "empty_slots", (capacity >= target).alias("reachable"),
    )
    return Mix(mixed, report)
