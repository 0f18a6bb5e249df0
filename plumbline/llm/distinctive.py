"""How distinctive a term is for a record: parsimonious language models.

Texts are cut once.  What is kept of them is a *model* per some thousand
records: its different terms, and for each record which of these it holds how
often.  Counts of the whole collection are joined to the terms of models, each
of which has a term once however many of its records hold it; texts and pairs of
record and term are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import terms
from plumbline.llm.burst import sum_counts
from plumbline.session import materialize

#: Terms that make up more than this share of all occurrences meet the models by a broadcast; there can't be more than its inverse of them.
HOT_SHARE = 1 / 100_000
#: A model ends after so many terms, counted with repeats, or at the end of its Arrow batch.
MODEL = 2_000_000
#: The share of a record's mass that is its own; how little its shares move when its maximum is looked for; and the least that this is lowered to.
OWN, CLOSE, LEAST = 0.1, 1e-6, 1e-14


def _sums(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, starts) if len(x) else x


def _settled(counts: np.ndarray, background: np.ndarray, spread: np.ndarray, support: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shares at which rounds stand still if only the terms of ``support`` have one, and for which records these are the maximum.

    There the likelihood's slope is the same at all terms with a share and no
    greater at those without.  Terms whose share isn't positive are left out.
    """
    starts = np.cumsum(spread) - spread
    price = (1 - OWN) / OWN * background
    while True:
        slope = (1 + _sums(np.where(support, price, 0.0), starts)) / np.maximum(_sums(np.where(support, counts, 0.0), starts), 1e-300)
        share = counts * np.repeat(slope, spread) - price
        fewer = support & (share > 0)
        if (fewer == support).all():
            return np.where(support, share, 0.0), np.logical_and.reduceat(support | (share <= 1e-9 * price), starts)
        support = fewer


def own_mass(of: np.ndarray, counts: np.ndarray, background: np.ndarray) -> np.ndarray:
    """Expectation-maximisation for many records at once: the converged probability of each (record, term).

    ``of`` is the record of each entry, in ascending order.  Two rounds and a
    step along the way that they went alternate.  When none of a record's shares moves
    by ``CLOSE``, the terms that still have one are tried: if the shares at
    which the rounds would stand still are the maximum of the likelihood, the
    record is done, with these; else its rounds go on, to a hundredth of that movement.
    So a record's shares don't depend on where its rounds end or on the other records.
    """
    if not len(of):
        return np.zeros(0)
    # Sums are taken in an order that only the record itself sets.
    at = np.lexsort((background, counts, of))
    counts, background = counts[at], background[at]
    starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    spread = np.diff(np.r_[starts, len(of)])
    share = counts / np.repeat(_sums(counts, starts), spread)
    close = np.full(len(starts), CLOSE)
    out = np.empty(len(of))

    def next_round(x: np.ndarray) -> np.ndarray:
        mass = counts * OWN * x / (OWN * x + (1 - OWN) * background)
        return mass / np.repeat(np.maximum(_sums(mass, starts), 1e-300), spread)

    while len(at):
        one = next_round(share)
        two = next_round(one)
        slow = np.maximum.reduceat(np.abs(two - one), starts) < close
        if slow.any():
            tried = np.repeat(slow, spread)
            settled, best = _settled(counts[tried], background[tried], spread[slow], two[tried] > np.repeat(close, spread)[tried])
            done = np.zeros(len(starts), bool)
            done[slow] = best
            kept = np.repeat(best, spread[slow])
            out[at[tried][kept]] = settled[kept]
            spent = slow & ~done & (close < LEAST)  # no rounds can tell these terms apart any more
            out[at[np.repeat(spent, spread)]] = two[np.repeat(spent, spread)]
            close[slow] /= 100
            left = ~(done | spent)
            stay = np.repeat(left, spread)
            at, counts, background, share, one, two = (x[stay] for x in (at, counts, background, share, one, two))
            spread, close = spread[left], close[left]
            starts = np.cumsum(spread) - spread
            if not len(at):
                break
        first, bend = one - share, two - 2 * one + share
        far = np.sqrt(_sums(first * first, starts) / np.maximum(_sums(bend * bend, starts), 1e-300))
        far = np.repeat(np.clip(far, 1, 1000), spread)
        ahead = np.maximum(share + 2 * far * first + far * far * bend, two / 10)
        share = next_round(ahead / np.repeat(_sums(ahead, starts), spread))
    return out


_MODEL = pa.schema([
    ("model", pa.int64()), ("values", pa.list_(pa.string())), ("occurrences", pa.list_(pa.int64())), ("records", pa.list_(pa.int64())),
    ("keys", pa.list_(pa.string())), ("blob", pa.binary()),
])
_MODEL_SQL = "model bigint, values array<string>, occurrences array<bigint>, records array<bigint>, keys array<string>, blob binary"


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))


def _pack(*arrays: np.ndarray) -> bytes:
    small = [_narrow(a) for a in arrays]
    head = np.array([len(small), *(v for a in small for v in (a.itemsize, len(a)))], np.int64)
    return b"".join(x.tobytes() for x in (head, *small))


def _unpack(blob: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    sizes = np.frombuffer(blob, np.int64, 2 * n, 8).tolist()
    at, out = 8 + 16 * n, []
    for width, length in zip(sizes[::2], sizes[1::2], strict=True):
        out.append(np.frombuffer(blob, f"u{width}", length, at).astype(np.int64))
        at += width * length
    return out


def _model(number: int, keys: list[str], found: list[list[str]]) -> tuple:
    coded = pa.array([t for f in found for t in f], pa.string()).dictionary_encode()
    words = len(coded.dictionary)
    of = np.repeat(np.arange(len(found)), [len(f) for f in found])
    both, counts = np.unique(of * words + coded.indices.to_numpy(), return_counts=True)
    of, word = both // words, both % words
    occurrences = np.bincount(word, counts, words).astype(np.int64)
    return number, coded.dictionary.to_pylist(), occurrences.tolist(), np.bincount(word, minlength=words).tolist(), keys, _pack(np.bincount(of, minlength=len(found)), word, counts)


def _models(most: int):
    """Rows (key, texts) to models; records without terms have no part in any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            keys: list[str] = []
            found: list[list[str]] = []
            size = 0
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            for last, (key, cells) in enumerate(rows, 1):
                cut = [t for cell in cells for t in terms(cell)]
                if cut:
                    keys.append(key)
                    found.append(cut)
                    size += len(cut)
                if keys and (size >= most or last == batch.num_rows):
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(_model(number, keys, found), _MODEL.types, strict=True)], schema=_MODEL)
                    keys, found, size, number = [], [], 0, number + 1

    return run


_OUT = pa.schema([("key", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("records", pa.int64()), ("weight", pa.float64())])


def _weigh(total: int, min_count: int, max_records: int | None, top: int | None):
    def run(models: pa.Table, known: pa.Table) -> pa.Table:
        out = []
        by = np.argsort(known.column("at").to_numpy(), kind="stable")
        occurrences, records = (known.column(c).to_numpy()[by] for c in ("occurrences", "records"))
        for keys, words, blob in zip(models.column("keys"), models.column("values"), models.column("blob"), strict=True):
            spread, word, counts = _unpack(blob.as_py())
            of = np.repeat(np.arange(len(spread)), spread)
            weight = own_mass(of, counts.astype(float), occurrences[word] / total)
            keep = counts >= min_count
            if max_records is not None:
                keep &= records[word] <= max_records
            held = np.flatnonzero(keep)
            if top is not None and len(held):
                rank = np.unique(words.as_py(), return_inverse=True)[1]
                order = held[np.lexsort((rank[word[held]], -np.round(weight[held], 9), of[held]))]
                starts = np.flatnonzero(np.r_[True, of[order][1:] != of[order][:-1]])
                place = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
                held = order[place < top]
            out.append(pa.RecordBatch.from_arrays(
                [keys.values.take(pa.array(of[held])), words.values.take(pa.array(word[held])), pa.array(counts[held]), pa.array(records[word[held]]), pa.array(weight[held])], schema=_OUT,
            ))
        return pa.Table.from_batches(out, _OUT)

    return run


def distinctive_terms(
    rows: DataFrame, key: str, texts: list[str], min_count: int = 1, max_records: int | None = None, top: int | None = None
) -> DataFrame:
    """``(key, term, n, records, weight)``: how characteristic each term is of its record.

    ``n`` is the term's count over all ``texts`` of the record, ``records`` the
    number of rows holding it, ``weight`` its probability in the record's
    parsimonious model: expectation-maximisation takes away the mass that the
    background, the frequencies of the whole collection, explains, and that of terms that it explains wholly is 0.  Only terms
    with ``n >= min_count`` and ``records <= max_records`` come out, of these
    the ``top`` heaviest of each record (ties by term) if that is given.

    The background covers all rows and all terms.  Hot terms, at most the
    inverse of ``HOT_SHARE``, meet the models by a broadcast, all others by a join.

    Null or empty texts have no terms, and records without terms no rows; rows
    with a null key are left out; repeated rows count as records of their own,
    each with its rows.  An empty table gives no rows.
    """
    cells = rows.filter(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), F.array(*texts).alias("cells"))
    models = materialize(cells.mapInArrow(_models(MODEL), _MODEL_SQL), "models")
    counts = materialize(sum_counts(models).withColumnRenamed("value", "word"), "background")
    total = counts.agg(F.coalesce(F.sum("occurrences"), F.lit(0)).alias("n")).first()["n"]
    hot = F.col("occurrences") > total * HOT_SHARE
    asked = models.select(F.col("model").alias("of"), F.posexplode("values").alias("at", "word"))
    met = asked.join(F.broadcast(counts.filter(hot)), "word", "left")
    met = met.filter("occurrences is not null").unionByName(met.filter("occurrences is null").select("of", "at", "word").join(counts.filter(~hot), "word"))
    known = met.select("of", "at", "occurrences", "records").groupBy("of")
    found = models.select("model", "values", "keys", "blob").groupBy("model").cogroup(known)
    out = found.applyInArrow(_weigh(max(total, 1), min_count, max_records, top), "key string, term string, n bigint, records bigint, weight double")
    return out.withColumnRenamed("key", key)
