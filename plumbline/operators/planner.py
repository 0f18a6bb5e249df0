"""Query planning: query texts to words, and words to candidate terms."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.distance import PAIRS, WIDE, Scanner, deletions, osa_column, osa_pairs
from plumbline.functions.text import terms

MAX_WORDS = 16
MAX_ZERO_TYPO, MAX_TYPO = 4096, 64
# What closes the last word of a query.
SPACES = frozenset("\t\n\v\f\r \xa0     　﻿" + "".join(map(chr, range(0x2000, 0x200B))))
WORD = ["word", "max_typos", "prefix"]


def typo_budget(word: str, enabled: bool = True) -> int:
    return 0 if not enabled or len(word) < 4 else 1 if len(word) < 8 else 2


def plan_words(query: str | None, typo_tolerance: bool = True) -> list[tuple[str, int, bool]]:
    """``(word, max_typos, prefix)`` of each word that counts."""
    query = query or ""
    found = terms(query)[:MAX_WORDS]
    is_open = query[-1:] not in SPACES
    return [(w, typo_budget(w, typo_tolerance), is_open and i == len(found) - 1) for i, w in enumerate(found)]


_WORDS = "query_id {}, word_idx int, n_words int, word string, max_typos int, prefix boolean"


def query_words(queries: DataFrame) -> DataFrame:
    """``queries(query_id, query, typo_tolerance)`` to one row per word; a null tolerance is on.  Token-less queries have no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: tuple[list, ...] = ([], [], [], [], [], [])
            for row, (query, on) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                planned = plan_words(query, on is not False)
                for i, word in enumerate(planned):
                    for column, value in zip(columns, (row, i, len(planned), *word), strict=True):
                        column.append(value)
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.bool_()]
            rest = [pa.array(c, t) for c, t in zip(columns[1:], kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(columns[0], pa.int64())), *rest], names=["query_id", "word_idx", "n_words", *WORD])

    kind = dict(queries.dtypes)["query_id"]
    return queries.select("query_id", "query", "typo_tolerance").mapInArrow(run, _WORDS.format(kind))


def prefixes_of(terms_: DataFrame) -> DataFrame:
    """``(prefix, term, df)``."""
    at = F.explode(F.sequence(F.lit(1), F.length("term"))).alias("n")
    return terms_.select("term", "df", at).select(F.substring("term", F.lit(1), F.col("n")).alias("prefix"), "term", "df")


def near_strings(words: DataFrame, strings: DataFrame) -> DataFrame:
    """``(word, s, distance)``: words(word, k) and strings(s, depth) within k edits.

    An equi-join of deletion neighbourhoods; ``depth`` must be at least the k of
    any word that may be that near.  Long lists of strings are never compared one by one, and never broadcast:
    sizes are estimated from files, before rows are exploded.
    """
    left = words.select("word", "k", F.explode(deletions(F.col("word"), F.col("k"))).alias("v"))
    right = strings.select("s", F.explode(deletions(F.col("s"), F.col("depth"))).alias("v"))
    left, right = left.withColumn("v", F.xxhash64("v")), right.withColumn("v", F.xxhash64("v"))
    pairs = left.join(right.hint("merge"), "v").filter(F.abs(F.length("word") - F.length("s")) <= F.col("k")).select("word", "k", "s").distinct()
    return pairs.withColumn("distance", osa_column("word", "s")).filter(F.col("distance") <= F.col("k")).select("word", "k", "s", "distance")


def expand_words(words: DataFrame, terms_: DataFrame) -> DataFrame:
    """All candidates ``(word, max_typos, prefix, term, typos, exact, df)`` of distinct words, before the caps.

    The dictionary and its prefixes are never broadcast, whatever their estimated size.
    """
    words = words.select(*WORD).distinct()
    whole = words.filter(~F.col("prefix")).join(terms_.select(F.col("term"), F.col("term").alias("word"), "df").hint("merge"), "word")
    whole = whole.select(*WORD, "term", F.lit(0).alias("typos"), F.lit(True).alias("exact"), "df")
    begun = prefixes_of(terms_)
    starts = words.filter("prefix").join(begun.withColumnRenamed("prefix", "word").hint("merge"), "word")
    grown = F.length("term") - F.length("word")
    starts = starts.select(*WORD, "term", F.lit(0).alias("typos"), (grown <= F.col("max_typos")).alias("exact"), "df")

    fuzzy = words.filter("max_typos > 0")
    depth = F.when(F.length("s") >= 6, 2).otherwise(1).alias("depth")
    full = near_strings(
        fuzzy.filter(~F.col("prefix")).select("word", F.col("max_typos").alias("k")), terms_.filter("n_chars >= 3").select(F.col("term").alias("s"), F.when(F.col("n_chars") >= 6, 2).otherwise(1).alias("depth")),
    )
    full = full.join(terms_.select(F.col("term").alias("s"), "df").hint("merge"), "s")
    full = full.select("word", F.col("k").alias("max_typos"), F.lit(False).alias("prefix"), F.col("s").alias("term"), F.col("distance").alias("typos"), F.lit(True).alias("exact"), "df")
    opened = fuzzy.filter("prefix").select("word", F.col("max_typos").alias("k"))
    near = near_strings(opened, begun.filter(F.length("prefix") >= 3).select(F.col("prefix").alias("s")).distinct().select("s", depth))
    near = near.join(begun.withColumnRenamed("prefix", "s").hint("merge"), "s")
    near = near.select("word", F.col("k").alias("max_typos"), F.lit(True).alias("prefix"), "term", F.col("distance").alias("typos"), (F.col("s") == F.col("term")).alias("exact"), "df")
    every = whole.unionByName(starts).unionByName(full).unionByName(near)
    return every.groupBy(*WORD, "term").agg(F.min("typos").alias("typos"), F.max("exact").alias("exact"), F.first("df").alias("df"))


def letters(strings: list[str]) -> np.ndarray:
    """The set of letters of each string as a mask of 64 bits; letters may share a bit."""
    out = np.zeros(len(strings), np.uint64)
    for i, x in enumerate(strings):
        mask = 0
        for ch in x:
            mask |= 1 << (ord(ch) & 63)
        out[i] = mask
    return out


def scan_words(words: list[tuple[str, int, bool]], terms_: DataFrame) -> DataFrame:
    """``expand_words`` for a few words: one pass over the dictionary, whose terms are compared with each word.

    For a single query this is quicker than the neighbourhoods, which pay off over many words.
    """
    asked = list(dict.fromkeys(words))
    plain = [i for i, (w, k, _) in enumerate(asked) if k and len(w) <= WIDE]
    spelled = {i: n for n, i in enumerate(plain)}
    lengths = np.array([len(w) for w, _, _ in asked])
    budgets = np.array([k for _, k, _ in asked])
    opened = np.array([p for _, _, p in asked])

    def matched(found: list[str]) -> Iterator[tuple[np.ndarray, ...]]:
        """(word, term, typos, exact), as numbers of words and terms."""
        sizes = np.array([len(t) for t in found])
        by = np.argsort(np.array(found, object), kind="stable") if found else np.empty(0, int)
        ordered = [found[i] for i in by]
        # Without typos: the term itself, and what begins with an open word.
        for i, (word, k, is_open) in enumerate(asked):
            low = bisect_left(ordered, word)
            high = bisect_left(ordered, word + "\U0010ffff") if is_open else low + (low < len(ordered) and ordered[low] == word)
            at = by[low:high]
            if len(at):
                yield np.full(len(at), i), at, np.zeros(len(at), np.int64), (sizes[at] - len(word) <= k) if is_open else np.ones(len(at), bool)
        if plain and found:
            scanner = Scanner([asked[i][0] for i in plain])
            codes, _ = scanner.strings(found)
            own, others = letters([w for w, _, _ in asked]), letters(found)
            for at in range(0, len(plain), max(1, PAIRS // len(found))):
                part = np.array(plain[at : at + max(1, PAIRS // len(found))])
                apart = sizes[None, :] - lengths[part][:, None]
                most, is_open = budgets[part][:, None], opened[part][:, None]
                near = (apart >= -most) & (is_open | (apart <= most))
                # An edit brings in or takes away one letter: of most terms the letters alone tell that they are too far.
                near &= np.bitwise_count(own[part][:, None] & ~others[None, :]) <= most
                near &= is_open | (np.bitwise_count(others[None, :] & ~own[part][:, None]) <= most)
                word, term = np.nonzero(near)
                word = part[word]
                whole, prefix = scanner.distances(np.array([spelled[w] for w in word.tolist()], np.int64), term, codes, sizes)
                typos = np.where(opened[word], prefix, whole)
                good = np.flatnonzero((typos > 0) & (typos <= budgets[word]))
                yield word[good], term[good], typos[good], ~opened[word[good]] | (whole[good] <= budgets[word[good]])
        for i, (word, k, is_open) in enumerate(asked):
            if k and len(word) > WIDE:
                near = np.flatnonzero((sizes >= len(word) - k) & (is_open | (sizes <= len(word) + k)))
                whole = osa_pairs([word] * len(near), [found[t] for t in near])
                typos = whole
                if is_open:
                    cuts = [osa_pairs([word] * len(near), [found[t][: len(word) + d] for t in near]) for d in range(-k, k + 1)]
                    typos = np.minimum.reduce(cuts)
                good = np.flatnonzero((typos > 0) & (typos <= k))
                yield np.full(len(good), i), near[good], typos[good], (whole[good] <= k) if is_open else np.ones(len(good), bool)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_ = pa.array([w for w, _, _ in asked], pa.string())
        for batch in batches:
            for word, term, typos, exact in matched(batch.column(0).to_pylist()):
                of, at = pa.array(word), pa.array(term)
                yield pa.RecordBatch.from_arrays(
                    [words_.take(of), pa.array(budgets[word].astype(np.int32)), pa.array(opened[word]), batch.column(0).take(at), pa.array(typos.astype(np.int32)), pa.array(exact), batch.column(1).take(at)],
                    names=[*WORD, "term", "typos", "exact", "df"],
                )

    kind = "word string, max_typos int, prefix boolean, term string, typos int, exact boolean, df bigint"
    return terms_.select("term", "df").mapInArrow(run, kind)


def cap_candidates(candidates: DataFrame, zero_typo: int = MAX_ZERO_TYPO, typo: int = MAX_TYPO) -> DataFrame:
    """The first of each tier: fewer typos, exact, frequent, then by term."""
    tier = Window.partitionBy(*WORD, F.col("typos") == 0).orderBy("typos", F.desc("exact"), F.desc("df"), "term")
    kept = candidates.withColumn("rank", F.row_number().over(tier))
    return kept.filter(F.col("rank") <= F.when(F.col("typos") == 0, zero_typo).otherwise(typo))


def plan_candidates(words: DataFrame, terms_: DataFrame) -> DataFrame:
    return cap_candidates(expand_words(words, terms_))


def describe_plan(words: DataFrame, candidates: DataFrame, key: str = "query_id") -> DataFrame:
    """``(key, word_idx, word, max_typos, prefix, candidates)``, also of words without any candidate."""
    counts = candidates.groupBy(*WORD).agg(F.count("*").alias("candidates"))
    return words.join(counts, WORD, "left").select(key, "word_idx", *WORD, F.coalesce("candidates", F.lit(0)).alias("candidates"))
