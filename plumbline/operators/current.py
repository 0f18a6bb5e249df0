"""The latest state of every key (de-duplication of an append-only table).

Which rows stay is found from keys alone: the keys, their order and the *address*
of each row, the file it stands in and its place there, are shuffled, and the
addresses of the rows that stay become bitmaps, one bit per row.  The rows
themselves, texts included, are then filtered where they are read.  The plan is
the same for every size of table and any number of repeated keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import materialize, table_path

#: The address of a row: a hash of its file's path, and its place in the file.
FILE, ROW = "__file", "__row"
#: A page of a bitmap stands for 2^15 consecutive rows, in 2^9 words of 64 bits.
PAGE_BITS, WORD_BITS = 15, 6
WORDS = 1 << PAGE_BITS - WORD_BITS
#: So many pages are broadcast at a time; they are 4 KB each, so 128 MB for a thousand million rows.
PAGES = 1 << 15


def _is_scan(df: DataFrame) -> bool:
    """Whether each row of ``df`` is a row of a Parquet file."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.deterministic() and plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation" and plan.toString().rstrip().endswith("parquet")


def addressed(df: DataFrame) -> tuple[DataFrame, list[Column]]:
    """A table with the rows of ``df``, and its columns ``__file`` and ``__row``; anything but a scan of Parquet files is written first."""
    if not _is_scan(df):
        df = materialize(df, "addressed")
    found = df.metadataColumn("_metadata")
    return df, [F.xxhash64(found["file_path"]).alias(FILE), found["row_index"].alias(ROW)]


def _bit() -> Column:
    """The bit of a row within its word."""
    return F.expr(f"shiftleft(1L, cast({ROW} & {(1 << WORD_BITS) - 1} as int))")


def bitmaps(marks: DataFrame) -> DataFrame:
    """Addresses to a written table of the pages that hold any, ``(__file, __page, __words)``.

    Bits are first put together per word, so a page is made of at most ``WORDS`` rows.
    """
    words = marks.groupBy(FILE, F.shiftright(ROW, WORD_BITS).alias("w")).agg(F.bit_or(_bit()).alias("bits"))
    entry = F.struct(F.expr(f"cast(w & {WORDS - 1} as int)").alias("at"), "bits")
    held = words.groupBy(FILE, F.shiftright("w", PAGE_BITS - WORD_BITS).alias("__page")).agg(F.map_from_entries(F.collect_list(entry)).alias("m"))
    every = F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("bigint")))
    return materialize(held.select(FILE, "__page", every.alias("__words")), "pages")


def _blocks(sizes: dict[int, int], limit: int) -> list[list[tuple[int, int, int]]]:
    """Files of so many pages to blocks of ``(file, from, below)`` with at most ``limit`` pages."""
    blocks: list[list[tuple[int, int, int]]] = [[]]
    room = limit
    for file, size in sorted(sizes.items()):
        at = 0
        while at < size:
            if not room:
                blocks.append([])
                room = limit
            take = min(room, size - at)
            blocks[-1].append((file, at, at + take))
            at, room = at + take, room - take
    return blocks


def _inside(block: list[tuple[int, int, int]], sizes: dict[int, int]) -> Column:
    """Whether a row or a page is of a block; only its first and last file can be parts of files."""
    whole = [f for f, low, high in block if not low and high == sizes[f]]
    inside = F.col(FILE).isin(whole)
    for f, low, high in block:
        if f not in whole:
            inside = inside | ((F.col(FILE) == f) & F.col("__page").between(low, high - 1 if high < sizes[f] else 1 << 62))
    return F.col(FILE).isin([f for f, _, _ in block]) & inside


def kept(rows: DataFrame, pages: DataFrame, marked: bool = True) -> DataFrame:
    """The rows of an addressed table whose bit is set, or those whose bit isn't (``marked`` false), without a shuffle.

    The pages are broadcast.  If there are more than ``PAGES`` of them, one
    block of files after the other is filtered and what stays is written, so no
    more is ever broadcast at once, and each file is read for its own block.
    """
    paged = rows.withColumn("__page", F.shiftright(ROW, PAGE_BITS))
    bits = F.coalesce(F.get("__words", F.shiftright(ROW, WORD_BITS).bitwiseAND(F.lit(WORDS - 1)).cast("int")).bitwiseAND(_bit()), F.lit(0))

    def chosen(some: DataFrame, of: DataFrame) -> DataFrame:
        met = some.join(F.broadcast(of), [FILE, "__page"], "left" if not marked else "inner")
        return met.filter(bits != 0 if marked else bits == 0).select(rows.columns)

    sizes = {r[FILE]: r["n"] for r in pages.groupBy(FILE).agg((F.max("__page") + 1).alias("n")).collect()}
    blocks = _blocks(sizes, PAGES)
    if len(blocks) == 1:
        return chosen(paged, pages)
    path = table_path(rows.sparkSession, "kept")
    for block in blocks:
        chosen(paged.filter(_inside(block, sizes)), pages.filter(_inside(block, sizes))).write.mode("append").parquet(path)
    if not marked:
        rows.filter(~F.col(FILE).isin(list(sizes))).write.mode("append").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def latest(
    df: DataFrame, key: str, order: Sequence[str], columns: Sequence[str | Column], where: Column | None = None
) -> DataFrame:
    """Of each ``key`` the row that is greatest by ``order``; ``key`` and ``columns`` come out.

    Exact copies count once.  Rows with a null key are left out; nulls in
    ``order`` come before any value; rows equal in ``order`` are settled by a
    hash of their output columns, so the result never depends on the reading
    order, and no other columns are read.  ``where`` filters the latest rows (not the states
    before them).  Only keys, order and addresses are shuffled, as pre-aggregated
    maxima, so a key that holds a third of all rows is one row per task.
    """
    table, address = addressed(df)
    table = table.filter(F.col(key).isNotNull())
    wanted = F.struct(*(F.col(c) if isinstance(c, str) else c for c in columns))
    has_map = "map<" in table.select(wanted).dtypes[0][1]  # maps have no hash
    tie = F.xxhash64(F.to_json(wanted) if has_map else wanted).alias("__t")
    narrow = table.select(F.col(key).alias("__k"), F.struct(*order).alias("__o"), tie, *address)
    best = narrow.groupBy("__k").agg(F.max(F.struct("__o", "__t", FILE, ROW)).alias("__b"))
    rows = kept(table.select(F.col(key).alias("__k"), wanted.alias("__c"), *address), bitmaps(best.select(f"__b.{FILE}", f"__b.{ROW}")))
    out = rows.select(F.col("__k").alias(key), "__c.*")
    return out if where is None else out.filter(where)
