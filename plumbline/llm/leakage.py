"""Evaluation texts leaking into a corpus: pigeonhole edit matching over terms.

A passage is a window of consecutive terms of an item.  Split into one piece
more than the edits it may have, at least one piece is left untouched; so
documents are searched for the exact pieces of all passages, and where one is
found the passages around it are verified by Myers' bit-parallel distance.
Texts are compared in their canonical look-alike form.

The corpus is read and cut once, whatever the number of items: a bounded filter
of all pieces is broadcast, and what leaves a document are the stretches around
the places that pass it, as hashes of terms.  These meet the table of pieces in
a join, and are verified many at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import terms
from plumbline.llm.lookalike import canonical
from plumbline.operators.joins import join_by_heat
from plumbline.session import materialize

#: Bits of the filter for each piece, the most bits that it may have in all (128 MB), and how many of them a piece sets.
#: With more pieces than these are for, more places pass that the join then drops.
FILTER_BITS, MOST_BITS, FILTER_HASHES = 32, 1 << 30, 4
#: A key of the join with the pieces takes about so many rows of either side.
BLOCK = 1024
#: Items with more than this share of the candidates are hot; there can't be more than its inverse of them.
HOT_SHARE = 1 / 1000

_BASE = np.uint64(0x9E3779B97F4A7C15)


def looked_terms(text: str | None) -> list[str]:
    return terms(canonical(text))


def _hashes(words: list[str]) -> np.ndarray:
    """64-bit hashes of terms, each distinct one hashed once."""
    coded = pa.array(words, pa.string()).dictionary_encode()
    known = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    return known[coded.indices.to_numpy()] if len(words) else np.empty(0, np.uint64)


def _rolled(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` consecutive terms, and of their number."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out = (out ^ hashes[i : i + n]) * _BASE
        out ^= out >> np.uint64(29)
    return out


def _counted(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for every c of ``counts``, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def best_distances(patterns: np.ndarray, texts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The least edit distance of each pattern to any part of the first ``lengths`` terms of its text (Myers 1999).

    ``patterns`` is pairs x m, ``texts`` pairs x n; all pairs take their steps together, each in one machine word.
    """
    pairs, m = patterns.shape
    if m > 64:
        raise ValueError("a passage has at most 64 terms")
    one = np.uint64(1)
    full = np.uint64((1 << m) - 1)
    high = np.uint64(m - 1)
    bits = one << np.arange(m, dtype=np.uint64)
    up, down = np.full(pairs, full), np.zeros(pairs, np.uint64)
    score = np.full(pairs, m)
    best = score.copy()
    for t in range(texts.shape[1]):
        eq = np.where(patterns == texts[:, t : t + 1], bits, np.uint64(0)).sum(axis=1, dtype=np.uint64) if m else up
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph, mh = (down | ~(xh | up)) & full, up & xh
        score = score + (ph >> high & one).astype(np.int64) - (mh >> high & one).astype(np.int64)
        ph, mh = ph << one & full, mh << one & full
        up, down = (mh | ~(xv | ph)) & full, ph & xv
        best = np.where(t < lengths, np.minimum(best, score), best)
    return best


def _shape(size: int, window: int, budget: int) -> tuple[int, int, int]:
    """Of an item of ``size`` terms: terms of a passage, its edits, and terms of a piece."""
    length = min(size, window)
    edits = min(budget, length - 1)
    return length, edits, length // (edits + 1)


_ITEMS = "item string, terms array<bigint>"
_PIECES = "h bigint, item string, place int"


def _cut_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cut = [_hashes(looked_terms(t)).view(np.int64) for t in batch.column(1).to_pylist()]
        kept = [i for i, c in enumerate(cut) if len(c)]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, pa.int64())), pa.array([cut[i] for i in kept], pa.list_(pa.int64()))], names=["item", "terms"])


def _cut_pieces(window: int, budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found, places = [], [], []
            for row, cell in enumerate(batch.column(1)):
                hashed = cell.values.to_numpy().view(np.uint64)
                rolled = _rolled(hashed, _shape(len(hashed), window, budget)[2])
                rows.append(np.full(len(rolled), row))
                found.append(rolled)
                places.append(np.arange(len(rolled), dtype=np.int32))
            if rows:
                columns = [pa.array(np.concatenate(found).view(np.int64)), batch.column(0).take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(places))]
                yield pa.RecordBatch.from_arrays(columns, names=["h", "item", "place"])

    return run


class Filter:
    """A Bloom filter of 64-bit hashes."""

    def __init__(self, bits: int):
        self.words = np.zeros(bits // 64, np.uint64)

    def places(self, hashes: np.ndarray, k: int) -> np.ndarray:
        first = hashes * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(20)
        step = (hashes ^ hashes >> np.uint64(31)) * _BASE >> np.uint64(20) | np.uint64(1)
        return first + np.uint64(k) * step & np.uint64(64 * len(self.words) - 1)

    def passing(self, hashes: np.ndarray) -> np.ndarray:
        """The places of ``hashes`` that may be among the pieces."""
        at = np.arange(len(hashes))
        for k in range(FILTER_HASHES):
            bit = self.places(hashes[at], k)
            at = at[(self.words[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)]
        return at


def _filter(pieces: DataFrame, bits: int) -> Filter:
    """Built where the pieces are; what comes to the driver are its words, at most ``MOST_BITS`` in all."""
    made = Filter(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Filter(bits)
        for batch in batches:
            hashes = batch.column(0).to_numpy().view(np.uint64)
            for k in range(FILTER_HASHES):
                bit = own.places(hashes, k)
                np.bitwise_or.at(own.words, bit >> np.uint64(6), np.uint64(1) << (bit & np.uint64(63)))
        held = np.flatnonzero(own.words)
        for at in range(0, len(held), 1 << 20):
            part = held[at : at + (1 << 20)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(own.words[part].view(np.int64))], names=["w", "bits"])

    words = pieces.select("h").mapInArrow(run, "w bigint, bits bigint").groupBy("w").agg(F.bit_or("bits").alias("bits")).toArrow()
    made.words[words.column("w").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return made


_STRETCH = pa.schema([("stretch", pa.int64()), ("doc", pa.string()), ("terms", pa.list_(pa.int64())), ("at", pa.list_(pa.int32())), ("h", pa.list_(pa.int64()))])
_STRETCH_SQL = "stretch bigint, doc string, terms array<bigint>, at array<int>, h array<bigint>"


def _search(known, sizes: list[int], reach: int):
    """Documents to the stretches around their places that pass the filter; ``reach`` terms stand on either side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 36
        for batch in batches:
            cut = [looked_terms(t) for t in batch.column(1).to_pylist()]
            ends = np.cumsum([len(c) for c in cut])
            hashes = _hashes([t for c in cut for t in c])
            found = [np.empty((3, 0), np.int64)]
            for size in sizes:
                rolled = _rolled(hashes, size)
                hit = known.value.passing(rolled)
                text = np.searchsorted(ends, hit, "right")
                inside = hit + size <= ends[text]
                found.append(np.stack([text[inside], hit[inside], rolled[hit[inside]].view(np.int64)]))
            text, hit, h = np.concatenate(found, axis=1)
            if not len(text):
                continue
            by = np.lexsort((hit, text))
            text, hit, h = text[by], hit[by], h[by]
            starts = ends - np.diff(np.r_[0, ends])
            low, high = np.maximum(hit - reach, starts[text]), np.minimum(hit + reach, ends[text])
            new = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (low[1:] > high[:-1])])
            rows = []
            for a, b in zip(new.tolist(), [*new[1:].tolist(), len(text)], strict=True):
                rows.append((number, int(text[a]), hashes[low[a] : high[b - 1]].view(np.int64), (hit[a:b] - low[a]).astype(np.int32), h[a:b]))
                number += 1
            for at in range(0, len(rows), 5000):
                columns = list(zip(*rows[at : at + 5000], strict=True))
                columns[1] = batch.column(0).take(pa.array(columns[1]))
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, _STRETCH.types, strict=True)], schema=_STRETCH)

    return run


_FOUND = "doc string, item string, distance int, run int"


def _verify(window: int, budget: int):
    """Rows (doc, terms, item, its terms, at, place), of one stretch and item each, to those with a passage."""

    def passages(lines: np.ndarray, length: int, edits: int, sizes: np.ndarray) -> np.ndarray:
        """Of runs (row, at, place, run) the passages around them, as (row, start in the item, start in the stretch)."""
        row, at, place, run = lines
        first = np.maximum(0, place + np.minimum(run, length) - length)
        last = np.minimum(place + np.maximum(run - length, 0), sizes[row] - length)
        spread = np.maximum(last - first + 1, 0)
        start = np.repeat(first, spread) + _counted(spread)
        return np.stack([np.repeat(row, spread), start, np.repeat(at - place, spread) + start])

    def verified(texts: list[np.ndarray], items: list[np.ndarray], row: np.ndarray, start: np.ndarray, at: np.ndarray, length: int, edits: int) -> np.ndarray:
        low = np.maximum(at - edits, 0)
        high = np.minimum(at + length + edits, np.array([len(texts[r]) for r in row]))
        wide = length + 2 * edits
        pattern, text = np.empty((len(row), length), np.int64), np.zeros((len(row), wide), np.int64)
        for i, (r, s, a, b) in enumerate(zip(row.tolist(), start.tolist(), low.tolist(), high.tolist(), strict=True)):
            pattern[i] = items[r][s : s + length]
            text[i, : b - a] = texts[r][a:b]
        return best_distances(pattern, text, high - low)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            texts, items, ats, places = ([c.values.to_numpy() for c in batch.column(n)] for n in ("terms", "item_terms", "at", "place"))
            shapes = np.array([_shape(len(i), window, budget) for i in items])
            sizes = np.array([len(i) for i in items])
            distance = shapes[:, 1] + 1
            longest = np.zeros(batch.num_rows, np.int64)
            for length, edits, piece in np.unique(shapes, axis=0).tolist():
                of = np.flatnonzero((shapes == (length, edits, piece)).all(axis=1))
                row = np.repeat(of, [len(ats[r]) for r in of])
                at, place = (np.concatenate([x[r] for r in of]).astype(np.int64) for x in (ats, places))
                # Hits that follow each other on a diagonal are one exact run.
                by = np.lexsort((at, at - place, row))
                row, at, place = row[by], at[by], place[by]
                new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1) | (place[1:] != place[:-1] + 1)])
                runs = np.diff(np.r_[new, len(row)]) + piece - 1
                row, at, place = row[new], at[new], place[new]
                np.maximum.at(longest, row, runs)
                distance[row[runs >= length]] = 0
                open_ = distance[row] > 0
                row, start, where = passages(np.stack([row, at, place, runs])[:, open_], length, edits, sizes)
                for k in range(0, len(row), 100_000):
                    part = slice(k, k + 100_000)
                    np.minimum.at(distance, row[part], verified(texts, items, row[part], start[part], where[part], length, edits))
            kept = np.flatnonzero(distance <= shapes[:, 1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc").take(pa.array(kept)), batch.column("item").take(pa.array(kept)), pa.array(distance[kept].astype(np.int32)), pa.array(longest[kept].astype(np.int32))],
                names=["doc", "item", "distance", "run"],
            )

    return run


def _in_blocks(hits: DataFrame, pieces: DataFrame) -> DataFrame:
    """The join of both by ``h``, the rows of a key in blocks of about ``BLOCK`` by ``BLOCK``."""
    sides = [x.groupBy("h").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(n)) for x, n in ((hits, "is"), (pieces, "js"))]
    parts = materialize(sides[0].join(sides[1], "h"), "parts")
    many = parts.filter((F.col("is") > 1) | (F.col("js") > 1))
    span = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cut = lambda n, *by: F.pmod(F.xxhash64(*by), F.col(n)).cast("int")
    left = hits.join(many, "h").select(*hits.columns, cut("is", "stretch", "at").alias("i"), span("js").alias("j"))
    right = pieces.join(many, "h").select(*pieces.columns, cut("js", "item", "place").alias("j"), span("is").alias("i"))
    few = parts.filter((F.col("is") == 1) & (F.col("js") == 1)).select("h")
    return hits.join(few, "h").join(pieces, "h").unionByName(left.join(right, ["h", "i", "j"]).drop("i", "j"))


def _key(c: str, alias: str) -> Column:
    return F.col(c).cast("string").alias(alias)


def leaks(
    docs: DataFrame, doc_key: str, doc_text: str, items: DataFrame, item_key: str, item_text: str, window: int = 10, budget: int = 1
) -> DataFrame:
    """``(doc_key, item_key, distance, run)``: documents that hold a passage of an item with at most ``budget`` edits.

    A passage is ``window`` consecutive terms of the item, at most 64, or the whole of a
    shorter item, of which at least one term must stand; an edit inserts, deletes or replaces a term.  ``distance`` is the least
    of all passages found, ``run`` the longest run of terms that the document has in common with the item.

    Whole texts are searched.  Null and empty texts and items, and null keys,
    give no rows; a repeated key counts as one document or item.
    """
    if not budget < window <= 64:
        raise ValueError("a passage needs a term for each piece, and has at most 64")
    spark = docs.sparkSession
    given = items.select(_key(item_key, "item"), F.col(item_text).alias("text")).dropna()
    known = materialize(given.mapInArrow(_cut_items, _ITEMS).withColumn("number", F.monotonically_increasing_id()), "items")
    pieces = materialize(known.select(F.col("number").cast("string").alias("item"), "terms").mapInArrow(_cut_pieces(window, budget), _PIECES), "pieces")
    # Passages come in as many sizes as a window has terms, at most.
    shapes = known.select(F.least(F.size("terms"), F.lit(window)).alias("n")).distinct().collect()
    sizes = sorted({_shape(r["n"], window, budget)[2] for r in shapes})
    asked = pieces.agg(F.count("*").alias("n")).first()["n"]
    bits = 1 << min(max(asked * FILTER_BITS, 64).bit_length(), MOST_BITS.bit_length() - 1)
    held = spark.sparkContext.broadcast(_filter(pieces, bits))

    texts = docs.select(_key(doc_key, "doc"), F.col(doc_text).alias("text")).dropna()
    shown = materialize(texts.mapInArrow(_search(held, sizes, 2 * window + budget), _STRETCH_SQL), "stretches")
    hits = shown.select("stretch", F.explode(F.arrays_zip("at", "h")).alias("e")).select("stretch", "e.at", "e.h")
    met = _in_blocks(hits, pieces).groupBy("stretch", "item").agg(F.collect_list(F.struct("at", "place")).alias("e"))
    met = materialize(met.select("stretch", F.col("item").cast("bigint").alias("number"), F.col("e.at").alias("at"), F.col("e.place").alias("place")), "met")
    counts = met.groupBy("number").agg(F.count("*").alias("n"))
    total = met.count()
    cut = known.select("number", "item", F.col("terms").alias("item_terms")).join(counts, "number")
    both = join_by_heat(met, cut, ["number"], F.col("n") > total * HOT_SHARE)
    both = both.join(shown.select("stretch", "doc", "terms"), "stretch").select("doc", "terms", "item", "item_terms", "at", "place")
    found = both.mapInArrow(_verify(window, budget), _FOUND)
    doc_type, item_type = dict(docs.dtypes)[doc_key], dict(items.dtypes)[item_key]
    return (
        found.groupBy("doc", "item").agg(F.min("distance").alias("distance"), F.max("run").alias("run"))
        .select(F.col("doc").cast(doc_type).alias(doc_key), F.col("item").cast(item_type).alias(item_key), "distance", "run")
    )
