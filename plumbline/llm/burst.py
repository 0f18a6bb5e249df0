"""Frequency of every distinct value by burst-trie counting.

Each worker counts its rows into a burst trie: inner nodes branch on one
character, leaves are containers of suffixes with their two counters, and a
container that grows past a bound bursts into an inner node.  The containers,
keyed by their path, are written; heavy paths of the whole collection make a
routing table; matching subtrees are merged under it, suffix by suffix.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import materialize

#: A container bursts beyond so many suffixes.
CONTAINER = 2048
#: A merged subtree should hold about so many entries of all workers.
SUBTREE = 200_000
#: The longest prefix by which entries are routed.
DEPTH = 24


class BurstTrie:
    """Counters of strings; ``containers`` gives the leaves with their paths."""

    def __init__(self, container: int = CONTAINER):
        self.limit = container
        self.root: dict = {}  # a leaf: suffix -> [occurrences, records]

    class Node(dict):
        """Character -> child; ``at`` are the counters of the string that ends here."""

        at: list[int] | None = None

    def add(self, term: str, occurrences: int, records: int) -> None:
        node, parent, at = self.root, None, 0
        while isinstance(node, BurstTrie.Node):
            if at == len(term):
                if node.at is None:
                    node.at = [0, 0]
                node.at[0] += occurrences
                node.at[1] += records
                return
            parent, ch = node, term[at]
            at += 1
            node = parent.get(ch)
            if node is None:
                node = parent[ch] = {}
        suffix = term[at:]
        held = node.get(suffix)
        if held is not None:
            held[0] += occurrences
            held[1] += records
            return
        node[suffix] = [occurrences, records]
        if len(node) > self.limit:
            burst = BurstTrie.Node()
            for rest, counts in node.items():
                if rest:
                    burst.setdefault(rest[0], {})[rest[1:]] = counts
                else:
                    burst.at = counts
            if parent is None:
                self.root = burst
            else:
                parent[term[at - 1]] = burst

    def containers(self) -> Iterator[tuple[str, dict[str, list[int]]]]:
        """``(path, suffixes)`` of each leaf, and of each inner node's own string."""
        todo = [("", self.root)]
        while todo:
            path, node = todo.pop()
            if isinstance(node, BurstTrie.Node):
                if node.at is not None:
                    yield path, {"": node.at}
                todo.extend((path + ch, child) for ch, child in node.items())
            elif node:
                yield path, node


def _pack(entries: dict[str, list[int]]) -> bytes:
    terms = sorted(entries)
    return pickle.dumps((terms, [entries[t][0] for t in terms], [entries[t][1] for t in terms]), protocol=5)


def _unpack(blob: bytes) -> Iterable[tuple[str, int, int]]:
    return zip(*pickle.loads(blob), strict=True)


_ROUTED = pa.schema([("field", pa.string()), ("path", pa.string()), ("part", pa.int32()), ("blob", pa.binary())])
_LEAF = pa.schema([("field", pa.string()), ("path", pa.string()), ("entries", pa.int64()), ("blob", pa.binary())])
_COUNT = pa.schema([("field", pa.string()), ("value", pa.string()), ("occurrences", pa.int64()), ("records", pa.int64())])


def _leaves(tries: dict[str, BurstTrie]) -> Iterator[pa.RecordBatch]:
    for field, trie in tries.items():
        rows = [(field, path, len(held), _pack(held)) for path, held in trie.containers()]
        for i in range(0, len(rows), 2000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 2000], strict=True), _LEAF.types, strict=True)], schema=_LEAF)


def _count_partition(split: dict[str, Callable[[object], list[str]]], container: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries = {f: BurstTrie(container) for f in split}
        for batch in batches:
            for field, cut in split.items():
                occurrences: Counter[str] = Counter()
                records: Counter[str] = Counter()
                for value in batch.column(field).to_pylist():
                    found = cut(value)
                    occurrences.update(found)
                    records.update(set(found))
                trie = tries[field]
                for term, n in occurrences.items():
                    trie.add(term, n, records[term])
        yield from _leaves(tries)

    return run


def _add_partition(container: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = BurstTrie(container)
        for batch in batches:
            for lists in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for term, n, m in zip(*lists, strict=True):
                    trie.add(term, n, m)
        yield from _leaves({"": trie})

    return run


def _route(routes: dict[str, dict[str, int]]):
    """Splits each container by the longest route that its entries pass, and those by a hash where the route asks for parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for field, path, _, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                known = routes.get(field, {})
                split: dict[tuple[str, int], dict[str, list[int]]] = {}
                for suffix, n, m in _unpack(blob):
                    term = path + suffix
                    at, parts = 0, 1
                    while at < len(term) and term[:at] in known:  # heavy prefixes are closed under prefixes
                        parts = known[term[:at]]
                        at += 1
                    part = xxhash.xxh3_64_intdigest(term) % parts if parts > 1 else 0
                    split.setdefault((term[:at], part), {})[term[at:]] = [n, m]
                rows += [(field, route, part, _pack(held)) for (route, part), held in split.items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ROUTED.types, strict=True)], schema=_ROUTED)

    return run


def _merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges the subtrees of all workers that have the same route, suffix by suffix."""
    field, path, total = key[0].as_py(), key[1].as_py(), {}
    for batch in batches:
        for blob in batch.column("blob").to_pylist():
            for suffix, n, m in _unpack(blob):
                held = total.get(suffix)
                if held is None:
                    total[suffix] = [n, m]
                else:
                    held[0] += n
                    held[1] += m
    found = sorted(total)
    for i in range(0, len(found), 50_000):
        part = found[i : i + 50_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array([field] * len(part)), pa.array([path + t for t in part]), pa.array([total[t][0] for t in part]), pa.array([total[t][1] for t in part])], schema=_COUNT
        )


def _merged(leaves: DataFrame, subtree: int) -> DataFrame:
    leaves = materialize(leaves, "tries")
    sizes = leaves.select("field", "entries", F.substring("path", 1, DEPTH).alias("path")).groupBy("field", "path").agg(F.sum("entries").alias("n"))
    every = F.transform(F.sequence(F.lit(0), F.length("path")), lambda i: F.substring("path", F.lit(1), i))
    heavy = (
        sizes.select("field", "n", "path", F.explode(every).alias("prefix"))
        .groupBy("field", "prefix").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("prefix") == F.col("path"), F.col("n")).otherwise(0)).alias("own"))
        .filter(F.col("n") > subtree)
    )
    routes: dict[str, dict[str, int]] = {}
    for row in heavy.collect():
        routes.setdefault(row["field"], {})[row["prefix"]] = -(-row["own"] // subtree) or 1
    routed = leaves.mapInArrow(_route(routes), "field string, path string, part int, blob binary")
    return routed.groupBy("field", "path", "part").applyInArrow(_merge, "field string, value string, occurrences bigint, records bigint")


_TRIES = "field string, path string, entries bigint, blob binary"


def count_values(
    rows: DataFrame, split: dict[str, Callable[[object], list[str]]], container: int = CONTAINER, subtree: int = SUBTREE
) -> DataFrame:
    """``(field, value, occurrences, records)`` for every distinct value of every field.

    ``split`` maps columns of ``rows`` to a function that gives the list of a
    cell's terms; it must give an empty list for null.  ``records`` counts the
    rows holding the value, ``occurrences`` all its places; repeated rows count
    as often as they stand.  Empty tables give no rows; an empty string is a
    value like any other.

    A value is at most one entry per worker, however frequent it is.  A subtree
    with more than ``subtree`` entries is split at its next character, down to
    ``DEPTH``, and what the workers hold under one path without having burst it
    by a hash of the value; so what a task merges stays bounded, also
    where values agree in a long prefix.  The routing table that reaches the driver has
    at most ``DEPTH`` prefixes per ``subtree`` entries of the containers.
    """
    return _merged(rows.select(*split).mapInArrow(_count_partition(split, container), _TRIES), subtree)


def sum_counts(lists: DataFrame, container: int = CONTAINER, subtree: int = SUBTREE) -> DataFrame:
    """``(value, occurrences, records)``: the counters of ``lists(values, occurrences, records)``, arrays of one length, added up in the same way."""
    found = lists.select("values", "occurrences", "records").mapInArrow(_add_partition(container), _TRIES)
    return _merged(found, subtree).drop("field")


def marked_values(counts: DataFrame, n_records: int, rare: int = 1, common: float = 0.2) -> DataFrame:
    """``counts`` with ``mark``: rare (at most ``rare`` records), common (at least the share ``common``), else null."""
    return counts.withColumn(
        "mark",
        F.when(F.col("records") <= rare, "rare").when(F.col("records") >= n_records * common, "common"),
    )
