"""Near-duplicate records by token-combination prefixes.

Two records are near duplicates if their sets of distinct terms have a Jaccard
similarity of at least ``t``.  With all sets in one global order, rare terms
first, a set of ``s`` terms has at most ``s - ceil(t * s)`` terms that a similar
set lacks.  Terms are divided into classes by frequency: a term of class k is
indexed only in combinations of k terms of the same class and group, rare ones
alone (k = 1).  Whatever d terms are deleted from a prefix that covers d + 1
(each group of class k with n terms covers n - k + 1), one whole combination is
left; so prefixes are extended until they cover enough, and any similar pair
shares a combination.  The smaller set of a pair needs the shorter *index*
prefix, the larger one the *probe* prefix, of which the former is a part.

Candidates sharing a combination are filtered by size and by the Hamming
distance of 128-bit parity sketches, which never exceeds the size of the
symmetric difference, and verified on the sets themselves.  A combination that
very many sets share is cut into parts, and each two of them are joined apart.

A sketch goes to each bucket of combinations that its set has one in, so the more
buckets, the more bytes.  Combinations are therefore joined in waves, by their last terms, each
of which shuffles a bounded multiple of the sets and is off the disk before the next.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import terms
from plumbline.llm.components import components
from plumbline.operators.current import FILE, ROW, bitmaps, kept
from plumbline.operators.joins import join_by_heat
from plumbline.session import brief_shuffles, materialize, table_path

#: At most so many terms have their frequency broadcast: those that fill at least this fraction of all sets' places.
DICTIONARY = 500_000
#: A combination should be in about so many records.
POSTINGS = 64
#: A task joins about so many combinations, in pieces of so many pairs; the cores share them as long as each has so many.
BUCKET, PIECE, LEAST_BUCKET = 6_000_000, 2_000_000, 1_000_000
#: A wave shuffles about so many bytes for each term of all sets; they are weighed by one of so many sets.
WAVE, WEIGHED = 12, 64
#: A combination that more than four times so many sets share is joined in parts of so many, each two of them apart.
PART = 4096
#: A key of the join of two classes takes about so many rows of either.
BLOCK = 1024
#: Classes of more than this share of the rows are hot; there can't be more than its inverse of them.
HOT_SHARE = 1 / 1000
#: Groups of the classes of pairs and of triples, from the least to the most losses: (pair groups, triple groups).
GROUPINGS = ((0, 0), (1, 1), (1, 3), (2, 6))

#: Sets are numbered by their task, above so many bits, and within it.
_TASK = 36
#: Terms are of one of 256 slots, by their top bits.
SLOTS, _SLOT, _BELOW = 256, np.uint64(56), np.uint64(8)
_C = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = (x ^ (x >> np.uint64(32))) * _C[3]
    x = (x ^ (x >> np.uint64(29))) * _C[1]
    return x ^ (x >> np.uint64(32))


def _ceil(x: np.ndarray | float) -> np.ndarray:
    return np.ceil(np.asarray(x) - 1e-9).astype(np.int64)


def _starts(sorted_ids: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, sorted_ids[1:] != sorted_ids[:-1]]) if len(sorted_ids) else np.empty(0, np.int64)


def _by(keys: np.ndarray, below: int) -> np.ndarray:
    """The order of keys from 0 and ``below`` that, equal ones as they come; by one sort of numbers where key and place fit one."""
    bits = len(keys).bit_length()
    if below << bits >= 1 << 63:
        return np.argsort(keys, kind="stable")
    packed = keys << bits
    packed |= np.arange(len(keys))
    packed.sort()
    packed &= (1 << bits) - 1
    return packed


def _place(starts: np.ndarray, n: int) -> np.ndarray:
    """The place of each of ``n`` entries within its run."""
    return np.arange(n) - np.repeat(starts, np.diff(np.r_[starts, n]))


def _counted(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for every c of ``counts``, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


_SETS = pa.schema([("id", pa.string()), ("rec", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("whole", pa.binary()), ("terms", pa.list_(pa.int64()))])


def _whole(texts: list[str | None]) -> bytes:
    """A 128-bit hash of a row's texts: equal only for exact copies."""
    return xxhash.xxh3_128_digest("".join("-" if t is None else f"{len(t)}:{t}" for t in texts))


def _analyse(counted: int, least: int):
    """Rows (id, text...) to sets of 64-bit term hashes; ``counted`` text columns must have ``least`` distinct terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId() << _TASK, 0
        for batch in batches:
            texts = [c.to_pylist() for c in batch.columns[1:]]
            cut = [[terms(t) for t in col] for col in texts]
            keep, flat, sizes = [], [], []
            for row in range(batch.num_rows):
                both = set().union(*(col[row] for col in cut[-counted:]))
                if len(both) >= least:
                    both.update(*(col[row] for col in cut[:-counted]))
                    keep.append(row)
                    sizes.append(len(both))
                    flat += both
            if not keep or not flat:
                continue
            coded = pa.array(flat, pa.string()).dictionary_encode()
            known = np.array([xxhash.xxh3_64_intdigest(t) for t in coded.dictionary.to_pylist()], np.uint64)
            # The hashes of each set in ascending order, by one sort of small numbers.
            by = np.argsort(known)
            rank = np.empty(len(known), np.int64)
            rank[by] = np.arange(len(known))
            places = np.repeat(np.arange(len(keep)) * len(known), sizes) + rank[coded.indices.to_numpy()]
            places.sort()
            hashed = known[by][places % len(known)]
            ends = np.cumsum(sizes)
            filled = np.flatnonzero(sizes)
            h1, h2 = np.zeros(len(keep), np.uint64), np.zeros(len(keep), np.uint64)
            h1[filled] = np.add.reduceat(_mix(hashed), (ends - sizes)[filled])
            h2[filled] = np.add.reduceat(_mix(hashed * _C[0] + _C[2]), (ends - sizes)[filled])
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(hashed.view(np.int64)))
            ids = batch.column(0).take(pa.array(keep))
            recs = pa.array(part + seen + np.arange(len(keep)))
            seen += len(keep)
            whole = pa.array([_whole([col[row] for col in texts]) for row in keep], pa.binary())
            yield pa.RecordBatch.from_arrays([ids, recs, pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), whole, lists], schema=_SETS)

    return run


@dataclass
class Order:
    """The global order: terms without an entry are rarer than any with one, and ordered by hash."""

    hashes: np.ndarray  # uint64, sorted
    frequency: np.ndarray  # of each, in sets
    unknown: float  # what terms without an entry have at most
    sets: int
    t: float
    postings: int = POSTINGS

    def __post_init__(self):
        # Of unknown terms first, then of each known one: the place of its frequency among all, and its class.
        frequency = np.r_[0, self.frequency]
        self.ranks = np.searchsorted(np.unique(frequency), frequency)
        share = np.clip(np.maximum(frequency, self.unknown) / max(self.sets, 1), 1e-12, 0.999)
        needed = math.log(max(self.sets / self.postings, 1.0))
        self.kinds = np.clip(_ceil(needed / -np.log(share)), 1, 3)

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank by frequency (0 for unknown terms) and class of each term."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64), np.full(len(hashes), self.kinds[0])
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        at = np.where(self.hashes[at] == hashes, at + 1, 0)
        return self.ranks[at], self.kinds[at]

    def schemes(self) -> list[tuple[int, float, int, int]]:
        """``(from, below, pair groups, triple groups)`` by the smaller set's size.

        Every group costs k - 1 of the cover; a grouping fits sizes whose least
        overlap exceeds all it can cost.
        """
        out, below = [], math.inf
        for pairs, triples in reversed(GROUPINGS):
            cost = pairs + 2 * triples
            low = next(s for s in range(1, 10**6) if _ceil(self.t * s) >= cost + 1)
            if low < below:
                out.append((low, below, pairs, triples))
                below = low
        return out


def _pairs_before(n: int) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j), i < j < n, ordered by j: the first c * (c - 1) / 2 are those under c."""
    j = np.repeat(np.arange(n), np.arange(n))
    return _counted(np.arange(n)), j


def combinations(order: Order, sizes: np.ndarray, hashes: np.ndarray, slots: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(set, signature, is_index)`` of all combinations of sets given as sizes and concatenated hashes, those of each set ascending.

    The top bits of a signature are the slot of the combination's last term in
    the global order; with ``slots``, a flag for each, only theirs come out.
    """
    of = np.repeat(np.arange(len(sizes)), sizes)
    frequency, kind = order.look_up(hashes)
    rank = _by(of * len(order.ranks) + frequency, len(sizes) * len(order.ranks))
    of, hashes, kind = of[rank], hashes[rank], kind[rank]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    probe = sizes - _ceil(order.t * sizes) + 1
    index = sizes - _ceil(2 * order.t / (1 + order.t) * sizes) + 1
    for number, (low, below, pair_groups, triple_groups) in enumerate(order.schemes()):
        takes = (sizes >= low) & (_ceil(order.t * sizes) < below)
        here = np.flatnonzero(takes[of])
        if not len(here):
            continue
        o, h = of[here], hashes[here]
        top = 3 if triple_groups else 2 if pair_groups else 1
        k = np.minimum(kind[here], top)
        spread = np.where(k == 1, 1, np.where(k == 2, pair_groups, triple_groups))
        group = (k << 8) + ((h >> np.uint64(40)).astype(np.int64) % spread)
        by = _by((o << 10) + group, len(sizes) << 10)
        starts = _starts((o[by] << 10) + group[by])
        place = np.empty(len(here), np.int64)
        place[by] = _place(starts, len(here))
        covers = place >= k - 1
        before = np.cumsum(covers) - covers
        first = _starts(o)
        before -= np.repeat(before[first], np.diff(np.r_[first, len(o)]))
        used = before < probe[o]
        flag = before < index[o]
        # In the order of groups, the used terms of each are its first ones.
        by = by[used[by]]
        o, h, k, group, flag = o[by], h[by], k[by], group[by], flag[by]
        starts = _starts((o << 16) + group)
        place = _place(starts, len(o))
        start = np.arange(len(o)) - place
        salt = _mix(group.astype(np.uint64) + np.uint64(number << 16))
        own = True if slots is None else slots[h >> _SLOT]
        for size in range(1, top + 1):
            last = np.flatnonzero((k == size) & (place >= size - 1) & own)
            if not len(last):
                continue
            slot, s = h[last] >> _SLOT << _SLOT, h[last] * _C[0] + salt[last]
            if size == 2:
                times = place[last]
                last, s, slot = np.repeat(last, times), np.repeat(s, times), np.repeat(slot, times)
                s = s + h[start[last] + _counted(times)] * _C[1]
            elif size == 3:
                p, q = _pairs_before(int(place[last].max()))
                times = place[last] * (place[last] - 1) // 2
                last, s, slot = np.repeat(last, times), np.repeat(s, times), np.repeat(slot, times)
                at = _counted(times)
                s = s + h[start[last] + p[at]] * _C[1] + h[start[last] + q[at]] * _C[2]
            found.append((o[last], slot | _mix(s) >> _BELOW, flag[last]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, bool)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def sketches(sizes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """128-bit parity sketches, as two words per set."""
    out = np.zeros((len(sizes), 2), np.uint64)
    filled = np.flatnonzero(sizes)
    at = (np.cumsum(sizes) - sizes)[filled]
    bit = np.uint64(1) << (hashes & np.uint64(63))
    high = (hashes >> np.uint64(6)) & np.uint64(1) == 1
    for word in (0, 1):
        out[filled, word] = np.bitwise_xor.reduceat(np.where(high == bool(word), bit, np.uint64(0)), at)
    return out


def _narrow(x: np.ndarray) -> np.ndarray:
    """Unsigned numbers in as few bytes as they need."""
    most = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64)


def _bucket(sig: np.ndarray, buckets: int) -> np.ndarray:
    return ((sig >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _weigh(order, buckets: int):
    """Sets to the bytes that their combinations of each slot take in blobs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros(SLOTS, np.int64)
        for batch in batches:
            sizes, hashes = _flat(batch.column(0))
            of, sig, _ = combinations(order.value, sizes, hashes)
            slot = (sig >> _SLOT).astype(np.int64)
            _, first = np.unique(of * buckets + _bucket(sig, buckets), return_index=True)
            weights += 20 * np.bincount(slot[first], minlength=SLOTS) + 4 * np.bincount(slot, minlength=SLOTS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SLOTS, dtype=np.int32)), pa.array(weights)], names=["slot", "bytes"])

    return run


def _waves(weights: dict[int, int], limit: float, most: int) -> list[np.ndarray]:
    """Slots shared out, the heaviest first, to as few waves, ``most`` at most, as their bytes fill; a flag for each slot."""
    waves = np.zeros((min(most, SLOTS, max(1, math.ceil(sum(weights.values()) / limit))), SLOTS), bool)
    filled = np.zeros(len(waves), np.int64)
    for slot in sorted(range(SLOTS), key=lambda s: -weights.get(s, 0)):
        least = int(filled.argmin())
        waves[least, slot] = True
        filled[least] += max(weights.get(slot, 0), 1)
    return list(waves)


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and concatenated hashes."""
    offsets = lists.offsets.to_numpy()
    return np.diff(offsets).astype(np.int64), lists.values.to_numpy()[offsets[0] : offsets[-1]].view(np.uint64)


def _emit(order, buckets: int, slots: np.ndarray | None = None, first: int = 0):
    """Sets to one blob per batch and bucket, holding the combinations of the slots that fall there; buckets are numbered from ``first``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            recs = batch.column(0).to_numpy()
            base = int(recs.min())
            sizes, hashes = _flat(batch.column(1))
            of, sig, flag = combinations(order.value, sizes, hashes, slots)
            sketch = sketches(sizes, hashes)
            place = _bucket(sig, buckets) * len(sizes) + of
            value = (sig.astype(np.uint32) & np.uint32(0xFFFFFFFE)) | flag.astype(np.uint32)
            by = _by(place, buckets * len(sizes))
            place, value = place[by], value[by]
            # Each set of each bucket, with its number of combinations there.
            starts = _starts(place)
            ends = np.r_[starts[1:], len(place)].astype(np.int64)
            bucket, held = np.divmod(place[starts], len(sizes))
            heads = _starts(bucket)
            out: tuple[list, list] = ([], [])
            for a, b in zip(heads, np.r_[heads[1:], len(starts)], strict=True):
                columns = [_narrow(x) for x in (recs[held[a:b]] - base, sizes[held[a:b]], ends[a:b] - starts[a:b])]
                head = np.array([base, b - a, ends[b - 1] - starts[a], *(c.itemsize for c in columns)], np.int64)
                out[0].append(first + int(bucket[a]))
                out[1].append(b"".join(x.tobytes() for x in (head, *columns, sketch[held[a:b]], value[starts[a] : ends[b - 1]])))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary())], names=["bucket", "blob"])

    return run


def _read(blob: pa.Buffer):
    """First record number, numbers after it, sizes, numbers of combinations, sketches and combinations, all as they stand in the blob."""
    base, n, m, *widths = np.frombuffer(blob, np.int64, 6)
    at, columns = 48, []
    for w in widths:
        columns.append(np.frombuffer(blob, f"u{w}", n, at))
        at += n * w
    return base, *columns, np.frombuffer(blob, np.uint64, 2 * n, at).reshape(n, 2), np.frombuffer(blob, np.uint32, m, at + 16 * n)


def _near(t: float, sets: tuple[np.ndarray, ...], x: np.ndarray, y: np.ndarray, fx: np.ndarray, fy: np.ndarray) -> np.ndarray:
    """Of pairs of sets, with the flags of the combination that they share, those that may be similar, as pairs of record numbers."""
    recs, sizes, sketch = sets
    sx, sy = sizes[x], sizes[y]
    good = ((fx & (sx <= sy)) | (fy & (sy <= sx))) & (np.minimum(sx, sy) >= t * np.maximum(sx, sy) - 1e-9) & (x != y)
    x, y = x[good], y[good]
    limit = (1 - t) / (1 + t) * (sizes[x].astype(np.int64) + sizes[y]) + 1e-9
    apart = np.bitwise_count(sketch[x, 0] ^ sketch[y, 0])
    near = apart <= limit
    x, y, limit, apart = x[near], y[near], limit[near], apart[near]
    near = apart + np.bitwise_count(sketch[x, 1] ^ sketch[y, 1]) <= limit
    x, y = recs[x[near]], recs[y[near]]
    return np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1)


_RAW = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("run", pa.int64()), ("part", pa.int32()), ("parts", pa.int32()), ("blob", pa.binary())])
_RAW_SQL = "a bigint, b bigint, run bigint, part int, parts int, blob binary"


def _joined(t: float, longest: int, part: int):
    """Pairs of sets in a bucket that share a combination and pass the filters; runs of more than ``longest`` come out in parts instead."""

    def pairs(run: np.ndarray, place: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Each entry with every one before it in its run, in pieces."""
        a = 0
        while a < len(run):
            total = np.cumsum(place[a : a + PIECE])
            b = a + max(1, int(np.searchsorted(total, PIECE, "right")))
            times = place[a:b]
            later = np.repeat(np.arange(a, b), times)
            yield later, later - 1 - _counted(times)
            a = b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, parts = None, []
        for batch in batches:
            first = batch.column("bucket")[0].as_py() if first is None and batch.num_rows else first
            parts += [_read(blob.as_buffer()) for blob in batch.column("blob")]
        if not parts:
            return
        # A set of few combinations here takes more room than these: narrow columns, and no second copy of any.
        sizes, counts, sketch, sig = (np.concatenate([p[i] for p in parts]) for i in range(2, 6))
        recs, at = np.empty(len(sizes), np.int64), 0
        for p in parts:
            recs[at : at + len(p[1])] = p[1]
            recs[at : at + len(p[1])] += p[0]
            at += len(p[1])
        del parts, p, batch
        packed = sig.astype(np.uint64)
        packed <<= np.uint64(32)
        packed |= np.repeat(np.arange(len(recs), dtype=np.uint32), counts)
        del sig, counts
        packed.sort()
        top = packed >> np.uint64(33)
        same = np.r_[top[1:] == top[:-1], False]
        packed = packed[same | np.r_[False, same[:-1]]]
        del top, same
        starts = _starts(packed >> np.uint64(33))
        ends = np.r_[starts[1:], len(packed)]
        rest = np.ones(len(packed), bool)
        for a, b in zip(starts[ends - starts > longest].tolist(), ends[ends - starts > longest].tolist(), strict=True):
            rest[a:b] = False
            name = (first << 31) + int(packed[a] >> np.uint64(33))
            for k in range(0, b - a, part):
                some = packed[a + k : min(a + k + part, b)]
                of = (some & np.uint64(0xFFFFFFFF)).astype(np.int64)
                flag = (some >> np.uint64(32)).astype(np.uint8) & np.uint8(1)
                blob = b"".join(v.tobytes() for v in (np.array([len(of)], np.int64), recs[of], sizes[of].astype(np.int64), sketch[of], flag))
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((None, None, name, k // part, -(-(b - a) // part), blob), _RAW, strict=True)], schema=_RAW)
        packed = packed[rest]
        place = _place(_starts(packed >> np.uint64(33)), len(packed))
        of = (packed & np.uint64(0xFFFFFFFF)).astype(np.int64)
        flag = (packed >> np.uint64(32)) & np.uint64(1) == 1
        del packed, rest
        kept = []
        sets = recs, sizes, sketch
        for i, j in pairs(of, place):
            fi, fj = flag[i], flag[j]
            either = np.flatnonzero(fi | fj)
            kept.append(_near(t, sets, of[i[either]], of[j[either]], fi[either], fj[either]))
            if sum(map(len, kept)) > PIECE:
                kept = [np.unique(np.concatenate(kept), axis=0)]
                if len(kept[0]) > PIECE // 2:
                    yield _links(kept.pop())
        if kept:
            yield _links(np.unique(np.concatenate(kept), axis=0))

    return run


def _joined_parts(t: float):
    """The pairs of two parts of a long run, or of one part with itself."""

    def entries(blob: bytes) -> tuple[np.ndarray, ...]:
        n = int(np.frombuffer(blob, np.int64, 1)[0])
        recs, sizes = np.frombuffer(blob, np.int64, n, 8), np.frombuffer(blob, np.int64, n, 8 + 8 * n)
        return recs, sizes, np.frombuffer(blob, np.uint64, 2 * n, 8 + 16 * n).reshape(n, 2), np.frombuffer(blob, np.uint8, n, 8 + 32 * n) == 1

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        x, y = entries(left.column("blob")[0].as_py()), entries(right.column("blob")[0].as_py())
        n, m = len(x[0]), len(y[0])
        recs, sizes, sketch, flag = (np.concatenate([a, b]) for a, b in zip(x, y, strict=True))
        own = left.column("i")[0].as_py() == left.column("j")[0].as_py()
        sets, kept = (recs, _narrow(sizes), sketch), [np.empty((0, 2), np.int64)]
        step = max(1, PIECE // m)
        for a in range(0, n, step):
            i, j = (v.ravel() for v in np.meshgrid(np.arange(a, min(a + step, n)), np.arange(n, n + m), indexing="ij"))
            use = (flag[i] | flag[j]) & ((j - n > i) | (not own))
            i, j = i[use], j[use]
            kept.append(_near(t, sets, i, j, flag[i], flag[j]))
        found = np.unique(np.concatenate(kept), axis=0)
        return pa.table({"a": pa.array(found[:, 0]), "b": pa.array(found[:, 1])})

    return run


def _candidates(raw: DataFrame, t: float) -> DataFrame:
    """The distinct pairs of a written table of pairs and of parts of long runs, which are joined part by part, each two of them by a task's key of their own."""
    parts = raw.filter("run is not null").select("run", "part", "parts", "blob")
    left = parts.select("run", F.col("part").alias("i"), F.explode(F.expr("sequence(part, parts - 1)")).alias("j"), "blob")
    right = parts.select("run", F.explode(F.expr("sequence(0, part)")).alias("i"), F.col("part").alias("j"), "blob")
    long = left.groupBy("run", "i", "j").cogroup(right.groupBy("run", "i", "j")).applyInArrow(_joined_parts(t), "a bigint, b bigint")
    return raw.filter("run is null").select("a", "b").unionByName(long).distinct()


def _links(pairs: np.ndarray) -> pa.RecordBatch:
    none = [pa.nulls(len(pairs), f.type) for f in list(_RAW)[2:]]
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), *none], schema=_RAW)


def _addresses(rec: str) -> list:
    """Where a set stands in the bitmaps: sets are numbered within the task that made them."""
    return [F.shiftright(rec, _TASK).alias(FILE), F.col(rec).bitwiseAND(F.lit((1 << _TASK) - 1)).alias(ROW)]


def similar_sets(sets: DataFrame, t: float) -> DataFrame:
    """``(a, b, ida, idb, similarity)``: all pairs of ``sets(rec, id, terms, __file, __row)`` with a Jaccard similarity of at least ``t``.

    No two sets may be equal.
    """
    spark = sets.sparkSession
    whole = sets.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("m")).first()
    least = max(whole["m"] / DICTIONARY, whole["n"] * 1e-4, 2.0)
    known = sets.select(F.explode("terms").alias("h")).groupBy("h").count().filter(F.col("count") >= least).toArrow()
    hashes = known.column("h").to_numpy().view(np.uint64)
    by = np.argsort(hashes)
    order = spark.sparkContext.broadcast(Order(hashes[by], known.column("count").to_numpy()[by].astype(np.int64), least, whole["n"], t, POSTINGS))
    buckets = max(1, round(whole["m"] * 2 / BUCKET), min(spark.sparkContext.defaultParallelism, round(whole["m"] * 2 / LEAST_BUCKET)))
    weights: dict[int, int] = {}
    if buckets > 1:
        some = sets.filter(F.pmod(F.xxhash64("rec"), F.lit(WEIGHED)) == 0).select("terms").mapInArrow(_weigh(order, buckets), "slot int, bytes bigint")
        weights = {r["slot"]: WEIGHED * r["n"] for r in some.groupBy("slot").agg(F.sum("bytes").alias("n")).collect()}
    waves = _waves(weights, max(WAVE * whole["m"], 1), buckets)
    each = -(-buckets // len(waves))
    path = table_path(spark, "raw")
    with brief_shuffles(spark):
        for number, slots in enumerate(waves):
            blobs = sets.select("rec", "terms").mapInArrow(_emit(order, each, slots if len(waves) > 1 else None, number * each), "bucket int, blob binary")
            # Each bucket is a task of its own; two that met in one would only make more candidates.
            blobs = blobs.repartitionById(each, F.col("bucket") - number * each)
            blobs.mapInArrow(_joined(t, 4 * PART, PART), _RAW_SQL).write.mode("append").parquet(path)
        found = materialize(_candidates(spark.read.schema(_RAW_SQL).parquet(path), t), "candidates")
    # Only sets that are in a candidate are shuffled for the verification.
    held = kept(sets, bitmaps(found.select(F.explode(F.array("a", "b")).alias("rec")).select(*_addresses("rec"))))
    both = found.join(held.select(F.col("rec").alias("a"), F.col("id").alias("ida"), F.col("terms").alias("ta")), "a")
    both = both.join(held.select(F.col("rec").alias("b"), F.col("id").alias("idb"), F.col("terms").alias("tb")), "b")
    both = both.withColumn("common", F.size(F.array_intersect("ta", "tb")))
    union = F.size("ta") + F.size("tb") - F.col("common")
    return both.filter(F.col("common") >= F.lit(t) * union - 1e-9).select(
        "a", "b", "ida", "idb", (F.col("common") / union).alias("similarity")
    )


@dataclass
class Classes:
    """Rows with equal term sets, and the links between such classes; rows alone in their class are no members."""

    members: DataFrame  # rec, head, id, n, whole: the rows of classes of n > 1 rows, with the class's smallest key and a hash of the texts
    linked: DataFrame  # a, b, ida, idb, similarity, na, nb: linked classes by their heads, with their numbers of rows


def classes(rows: DataFrame, key: str, texts: list[str], counted: int, least_terms: int, t: float) -> Classes:
    named = [F.col(key).cast("string").alias("id"), *(F.col(c).alias(f"t{i}") for i, c in enumerate(texts))]
    sets = rows.filter(F.col(key).isNotNull()).select(*named).mapInArrow(
        _analyse(counted, max(least_terms, 1)), "id string, rec bigint, h1 bigint, h2 bigint, whole binary, terms array<bigint>"
    )
    sets = materialize(sets, "sets")
    with brief_shuffles(sets.sparkSession):
        firsts = materialize(sets.groupBy("h1", "h2").agg(F.min(F.struct("id", "rec", "whole")).alias("r"), F.count("*").alias("n")), "classes")
    total = firsts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    heads = bitmaps(firsts.select("r.rec").select(*_addresses("rec")))
    placed = sets.select("*", *_addresses("rec"))
    links = similar_sets(kept(placed.select("id", "rec", "terms", FILE, ROW), heads), t)
    many = firsts.filter("n > 1").select("h1", "h2", F.col("r.id").alias("head"), F.col("r.rec").alias("rec"), "n", F.col("r.whole").alias("first"))
    # The other rows of a class; those of hot classes find it without a shuffle.
    others = kept(placed.select("h1", "h2", "id", "whole", FILE, ROW), heads, marked=False).select("h1", "h2", "id", "whole")
    met = join_by_heat(others, many, ["h1", "h2"], F.col("n") > total * HOT_SHARE).select("rec", "head", "id", "n", "whole")
    members = materialize(met.unionByName(many.select("rec", "head", F.col("head").alias("id"), "n", F.col("first").alias("whole"))), "members")
    size = lambda rec, n: many.select(F.col("rec").alias(rec), F.col("n").alias(n))
    sized = links.join(size("a", "na"), "a", "left").join(size("b", "nb"), "b", "left").fillna(1, ["na", "nb"])
    return Classes(members, materialize(sized, "linked"))


def near_duplicates(
    rows: DataFrame, key: str, texts: list[str], counted: int = 1, least_terms: int = 12, t: float = 0.6, expand: int = 16
) -> DataFrame:
    """``(id_a, id_b)``, id_a < id_b: keys of rows whose distinct terms, over all ``texts``, agree by at least ``t``.

    Only rows whose last ``counted`` text columns have ``least_terms`` distinct
    terms take part, and none without a term or with a null key; keys must be unique.  A null or
    empty text has no terms; texts are used whole, whatever their length.
    Rows with equal term sets form a class that is joined once; all pairs of
    its rows and of the rows of linked classes come out.  Only exact copies,
    equal in all ``texts``, are abbreviated: of more than ``expand`` of them
    all but the smallest key are paired with every row but such copies, and
    so with that smallest key too, not with each other.
    An empty table gives no rows; extra columns don't matter.

    The rows of two classes are joined in blocks of about ``BLOCK`` by ``BLOCK``.
    """
    found = classes(rows, key, texts, counted, least_terms, t)
    copies = found.members.groupBy("rec", "whole").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).filter(F.col("copies") > expand)
    members = found.members.join(copies, ["rec", "whole"], "left").withColumn("full", F.col("rep").isNull() | (F.col("rep") == F.col("id")))
    members = materialize(members.select("rec", "head", "id", "full"), "rows")
    sizes = members.groupBy("rec", "head").agg(F.count("*").alias("n"), F.count_if("full").alias("n_full"))
    parts = materialize(sizes.select("rec", "head", *(F.ceil(F.col(n) / BLOCK).cast("int").alias(p) for n, p in (("n", "parts"), ("n_full", "full_parts")))), "parts")
    alone = (F.col("na") == 1) & (F.col("nb") == 1)
    linked = found.linked.filter(~alone)
    ends = lambda a, b: linked.select(F.col(a).alias("a"), F.col(b).alias("b"), F.col(f"id{a}").alias("ida"), F.col(f"id{b}").alias("idb"))
    ways = ends("a", "b").unionByName(ends("b", "a")).unionByName(parts.select(F.col("rec").alias("a"), F.col("rec").alias("b"), F.col("head").alias("ida"), F.col("head").alias("idb")))
    ways = ways.join(parts.select(F.col("rec").alias("a"), "parts"), "a", "left").join(parts.select(F.col("rec").alias("b"), "full_parts"), "b", "left")
    span = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1))
    ways = materialize(ways.withColumn("i", span("parts")).withColumn("j", span("full_parts")), "ways")
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    placed = members.join(parts.drop("head"), "rec")
    every = placed.select(F.col("rec").alias("a"), block("parts").alias("i"), F.col("id").alias("x"), "full")
    whole = placed.filter("full").select(F.col("rec").alias("b"), block("full_parts").alias("j"), F.col("id").alias("y"))
    # A class without parts is one row, its head.
    left = ways.join(every, ["a", "i"], "left").select("a", "b", "i", "j", F.when(F.col("parts").isNull(), F.col("ida")).otherwise(F.col("x")).alias("x"), F.coalesce("full", F.lit(True)).alias("full"))
    right = ways.join(whole, ["b", "j"], "left").select("a", "b", "i", "j", F.when(F.col("full_parts").isNull(), F.col("idb")).otherwise(F.col("y")).alias("y"))
    pairs = left.join(right, ["a", "b", "i", "j"]).filter("x < y or (not full and x <> y)").select("x", "y")
    pairs = pairs.unionByName(found.linked.filter(alone).select(F.col("ida").alias("x"), F.col("idb").alias("y")))
    return pairs.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def near_duplicate_groups(rows: DataFrame, key: str, texts: list[str], counted: int = 1, least_terms: int = 12, t: float = 0.6) -> DataFrame:
    """``(key, class, links)``: every row with the least key of the group it is linked into, and its number of near duplicates.

    The groups and links are those of all similar pairs, whatever the size of a
    class of equal term sets: a row is linked to the others of its class and
    to every row of the classes linked to it, so sizes are added up and no
    pair is made.  Rows that take no part are groups of their own; null keys
    are left out.
    """
    found = classes(rows, key, texts, counted, least_terms, t)
    ends = found.linked.select(F.explode(F.array(F.struct(F.col("ida").alias("head"), F.col("nb").alias("n")), F.struct(F.col("idb").alias("head"), F.col("na").alias("n")))).alias("e"))
    ends = ends.groupBy("e.head").agg(F.sum("e.n").alias("others"))
    groups = components(found.linked, "ida", "idb").withColumnRenamed("node", "head")
    own = found.members.select(F.col("id").alias("__id"), F.col("head").alias("__head"), F.col("n").alias("__n"))
    every = rows.select(F.col(key).alias("__key"), F.col(key).cast("string").alias("__id")).dropna().join(own, "__id", "left")
    every = every.select("__key", F.coalesce("__head", "__id").alias("head"), F.coalesce("__n", F.lit(1)).alias("n"))
    joined = every.join(groups, "head", "left").join(ends, "head", "left")
    links = F.col("n") - 1 + F.coalesce("others", F.lit(0))
    return joined.select(F.col("__key").alias(key), F.coalesce("component", "head").alias("class"), links.cast("bigint").alias("links"))
