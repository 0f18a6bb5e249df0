"""Edit distance with transpositions of neighbours (optimal string alignment), and its neighbourhoods.

Pairs are computed batch-wise: one dynamic programme runs over all pairs of a
batch at once.  Joins by distance go through deletion neighbourhoods: two
strings within k edits share a string that either gives by at most k deletions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

_CHUNK = 20_000


def _codes(words: list[str], width: int, fill: int) -> np.ndarray:
    out = np.full((len(words), width), fill, np.int32)
    for i, w in enumerate(words):
        out[i, : len(w)] = [*map(ord, w)]
    return out


def osa_pairs(left: list[str], right: list[str]) -> np.ndarray:
    """The distance of each pair."""
    out = np.zeros(len(left), np.int32)
    for at in range(0, len(left), _CHUNK):
        out[at : at + _CHUNK] = _osa_chunk(left[at : at + _CHUNK], right[at : at + _CHUNK])
    return out


def _osa_chunk(left: list[str], right: list[str]) -> np.ndarray:
    if not left:
        return np.zeros(0, np.int32)
    rows, cols = np.array([len(w) for w in left]), np.array([len(w) for w in right])
    m, n = int(rows.max()), int(cols.max())
    a, b = _codes(left, m, -1), _codes(right, n, -2)
    every = np.arange(len(left))
    table = [np.tile(np.arange(n + 1, dtype=np.int32)[:, None], len(left))]
    out = np.where(rows == 0, cols, 0)
    for i in range(1, m + 1):
        row = np.empty_like(table[0])
        row[0] = i
        for j in range(1, n + 1):
            same = a[:, i - 1] == b[:, j - 1]
            best = np.minimum(np.minimum(table[-1][j], row[j - 1]) + 1, table[-1][j - 1] + ~same)
            if i > 1 and j > 1:
                swapped = (a[:, i - 1] == b[:, j - 2]) & (a[:, i - 2] == b[:, j - 1])
                best = np.where(swapped, np.minimum(best, table[-2][j - 2] + 1), best)
            row[j] = best
        done = rows == i
        out[done] = row[cols[done], every[done]]
        table = [table[-1], row]
    return out


#: Patterns up to this length go through the bit-parallel steps; and so many pairs take them at a time.
WIDE, PAIRS = 64, 1 << 18


class Scanner:
    """The distances of a few words to many strings and to all their prefixes, each pair in one pass over the string.

    The columns of a pair's table are kept as differences in two machine words
    (Hyyrö 2003), and after each character of the string the last cell is the
    distance of the word to what has been read.
    """

    def __init__(self, words: list[str]):
        letters = sorted({ch for w in words for ch in w})
        self.letters = {ch: i + 1 for i, ch in enumerate(letters)}  # 0 is any other
        self.lengths = np.array([len(w) for w in words], np.int64)
        self.table = np.zeros((len(words), len(letters) + 1), np.uint64)
        for i, w in enumerate(words):
            if len(w) > WIDE:
                raise ValueError("a word is too long")
            for at, ch in enumerate(w):
                self.table[i, self.letters[ch]] |= np.uint64(1 << at)

    def strings(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Codes and lengths of strings."""
        lengths = np.array([len(x) for x in strings], np.int64)
        codes = np.zeros((len(strings), int(lengths.max(initial=0))), np.int32)
        for i, x in enumerate(strings):
            codes[i, : len(x)] = [self.letters.get(ch, 0) for ch in x]
        return codes, lengths

    def distances(self, word: np.ndarray, of: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of pairs of a word and a string, given as their numbers, the distance, and the least one to a prefix."""
        whole, prefix = np.empty(len(word), np.int64), np.empty(len(word), np.int64)
        for at in range(0, len(word), PAIRS):
            part = slice(at, at + PAIRS)
            whole[part], prefix[part] = self._steps(word[part], of[part], codes, lengths)
        return whole, prefix

    def _steps(self, word: np.ndarray, of: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        one, size = np.uint64(1), lengths[of]
        high = np.maximum(self.lengths[word] - 1, 0).astype(np.uint64)
        up, down = np.full(len(word), np.uint64(0xFFFFFFFFFFFFFFFF)), np.zeros(len(word), np.uint64)
        diagonal, before = np.zeros(len(word), np.uint64), np.zeros(len(word), np.uint64)
        score = self.lengths[word].copy()
        whole, best = score.copy(), score.copy()
        for step in range(int(size.max(initial=0))):
            match = self.table[word, codes[of, step]]
            swapped = (~diagonal & match) << one & before
            diagonal = ((match & up) + up ^ up) | match | down | swapped
            more, less = down | ~(diagonal | up), diagonal & up
            score = score + (more >> high & one).astype(np.int64) - (less >> high & one).astype(np.int64)
            more, less = more << one | one, less << one
            up, down, before = less | ~(diagonal | more), more & diagonal, match
            inside = step < size
            best = np.where(inside, np.minimum(best, score), best)
            whole = np.where(inside, score, whole)
        empty = self.lengths[word] == 0
        return np.where(empty, size, whole), np.where(empty, 0, best)


def osa(a: str, b: str, most: float = float("inf")) -> int:
    """The distance of two strings, or ``most + 1`` if it is greater."""
    if abs(len(a) - len(b)) > most:
        return int(most) + 1
    return int(min(osa_pairs([a], [b])[0], most + 1))


def _osa_batch(a: pa.Array, b: pa.Array) -> pa.Array:
    left, right = a.to_pylist(), b.to_pylist()
    known = [i for i, (x, y) in enumerate(zip(left, right, strict=True)) if x is not None and y is not None]
    out: list[int | None] = [None] * len(left)
    for i, d in zip(known, osa_pairs([left[i] for i in known], [right[i] for i in known]).tolist(), strict=True):
        out[i] = d
    return pa.array(out, pa.int32())


osa_column = F.arrow_udf(_osa_batch, IntegerType())


def deletions(text: Column, times: int | Column) -> Column:
    """All strings that ``text`` gives by at most ``times`` (0, 1 or 2) deletions, as an array without repeats."""
    n = F.length(text)
    once = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, n)))
    twice = F.flatten(
        F.transform(
            once,
            lambda s: F.transform(
                F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, n))
            ),
        )
    )
    k = F.lit(times) if isinstance(times, int) else times
    none = F.array(text)
    return F.array_distinct(F.when(k >= 2, F.concat(none, once, twice)).when(k == 1, F.concat(none, once)).otherwise(none))
