"""Highlights and snippets, for the rows of a page."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from plumbline.functions.text import escape_html, tokens
from plumbline.operators.planner import SPACES

SNIPPET_WORDS, LEAD = 24, 3
Mark = tuple[int, int, int]


def find_marks(text: str, terms_by_word: list[set[str]]) -> list[Mark]:
    """``(start, end, word)`` of each token that is a matched term, credited to the first such word."""
    first: dict[str, int] = {}
    for word, found in enumerate(terms_by_word):
        for term in found:
            first.setdefault(term, word)
    return [(start, end, first[t]) for t, start, end in tokens(text) if t in first]


def wrap_marks(text: str, marks: list[Mark], begin: int = 0, stop: int | None = None) -> str:
    stop = len(text) if stop is None else stop
    out, at = [], begin
    for start, end, _ in marks:
        if end > begin and start < stop:
            start, end = max(start, begin), min(end, stop)
            out += [escape_html(text[at:start]), "<mark>", escape_html(text[start:end]), "</mark>"]
            at = end
    return "".join(out) + escape_html(text[at:stop])


def match_level(marks: list[Mark], n_words: int) -> str:
    found = {m[2] for m in marks}
    return "none" if not found or not n_words else "full" if len(found) >= n_words else "partial"


def highlight(text: str | None, terms_by_word: list[set[str]], words: list[str]) -> dict:
    text = text or ""
    marks = find_marks(text, terms_by_word)
    return {"value": wrap_marks(text, marks), "matchLevel": match_level(marks, len(words)), "matchedWords": list(dict.fromkeys(words[m[2]] for m in marks))}


def snippet(text: str | None, terms_by_word: list[set[str]], words: list[str], max_words: int = SNIPPET_WORDS) -> dict:
    """The window of ``max_words`` tokens with the most marks; of equal ones that with ``LEAD`` tokens before the first mark, then the earliest."""
    text = text or ""
    found = tokens(text)
    if not found:
        return {"value": escape_html(text), "matchLevel": "none"}
    marks = find_marks(text, terms_by_word)
    at = {m[0] for m in marks}
    marked = [i for i, t in enumerate(found) if t[1] in at]
    size = min(max_words, len(found))
    best = None
    low = high = 0
    for start in range(len(found) - size + 1):
        while low < len(marked) and marked[low] < start:
            low += 1
        while high < len(marked) and marked[high] < start + size:
            high += 1
        rank = (low - high, abs(marked[low] - start - LEAD) if high > low else start, start)
        best = rank if best is None else min(best, rank)
    start, end = best[2], best[2] + size
    begin = found[start][1]
    stop = found[end][1] if end < len(found) else len(text)
    while stop > begin and text[stop - 1] in SPACES:
        stop -= 1
    body = wrap_marks(text, marks, begin, stop)
    return {"value": "…" * (start > 0) + body + "…" * (end < len(found)), "matchLevel": match_level(marks, len(words))}


_HIGHLIGHT = StructType([StructField("value", StringType()), StructField("matchLevel", StringType()), StructField("matchedWords", ArrayType(StringType()))])
_SNIPPET = StructType([StructField("value", StringType()), StructField("matchLevel", StringType())])
_HIGHLIGHT_PA = pa.struct([("value", pa.string()), ("matchLevel", pa.string()), ("matchedWords", pa.list_(pa.string()))])
_SNIPPET_PA = pa.struct([("value", pa.string()), ("matchLevel", pa.string())])


def terms_by_word(matches: list[dict], n_words: int) -> list[set[str]]:
    """Matched terms, as ``scorer.matched_terms`` gives them, by word."""
    out: list[set[str]] = [set() for _ in range(n_words)]
    for m in matches or []:
        out[m["word_idx"]].add(m["term"])
    return out


def _highlight_batch(texts: pa.Array, matches: pa.Array, words: pa.Array) -> pa.Array:
    rows = zip(texts.to_pylist(), matches.to_pylist(), words.to_pylist(), strict=True)
    return pa.array([highlight(t, terms_by_word(m, len(w)), w) for t, m, w in rows], _HIGHLIGHT_PA)


def _highlight_list_batch(texts: pa.Array, matches: pa.Array, words: pa.Array) -> pa.Array:
    rows = zip(texts.to_pylist(), matches.to_pylist(), words.to_pylist(), strict=True)
    return pa.array([[highlight(t, terms_by_word(m, len(w)), w) for t in ts or []] for ts, m, w in rows], pa.list_(_HIGHLIGHT_PA))


def _snippet_batch(texts: pa.Array, matches: pa.Array, words: pa.Array, sizes: pa.Array) -> pa.Array:
    rows = zip(texts.to_pylist(), matches.to_pylist(), words.to_pylist(), sizes.to_pylist(), strict=True)
    return pa.array([snippet(t, terms_by_word(m, len(w)), w, s) for t, m, w, s in rows], _SNIPPET_PA)


#: Columns (text, matches, words[, size]); ``words`` are the query's words in order.
highlight_column = F.arrow_udf(_highlight_batch, _HIGHLIGHT)
highlight_list_column = F.arrow_udf(_highlight_list_batch, ArrayType(_HIGHLIGHT))
snippet_column = F.arrow_udf(_snippet_batch, _SNIPPET)
