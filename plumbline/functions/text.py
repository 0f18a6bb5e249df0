"""Text analysis: folding, tokenizing, escaping, number formatting.

``terms`` is the fast tokenizer used on whole columns, ``tokens`` the
character-exact one that also reports offsets into the original string (used on
page rows and query words).  Both follow the same rules and are tested against
each other:

* every code point is decomposed (NFKD), combining marks are dropped, the rest
  is lower-cased and passed through ``EXTRA_FOLDS``;
* a code point whose folded form is wholly letters/digits belongs to a token,
  any other ends it; one that folds to nothing (a bare mark) attaches;
* apostrophes join; a lower-case letter followed by an upper-case one splits.

A null text has no terms.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# Letters that have no decomposition but are expected to fold.
EXTRA_FOLDS = {
    "ł": "l", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "ß": "ss", "æ": "ae",
    "œ": "oe", "ı": "i", "ħ": "h", "ŧ": "t", "ŋ": "n", "ĸ": "k",
}
APOSTROPHES = "'’ʼ"

_EXTRA = str.maketrans(EXTRA_FOLDS)


@lru_cache(maxsize=1 << 16)
def fold_char(ch: str) -> str:
    kept = [c for c in unicodedata.normalize("NFKD", ch) if unicodedata.category(c)[0] != "M"]
    return "".join(c.lower() for c in kept).translate(_EXTRA)


def _is_alnum(s: str) -> bool:
    return all(unicodedata.category(c)[0] in "LN" for c in s)


def normalize_word(word: str) -> str:
    """Fold one word and keep only letters and digits (no camelCase split)."""
    return "".join(c for ch in word for c in fold_char(ch) if unicodedata.category(c)[0] in "LN")


def tokens(text: str | None) -> list[tuple[str, int, int]]:
    """``(token, start, end)`` with code point offsets into ``text``."""
    out: list[tuple[str, int, int]] = []
    parts: list[str] = []
    start = end = 0
    after_lower = False

    def close() -> None:
        nonlocal after_lower
        if parts:
            out.append(("".join(parts), start, end))
            parts.clear()
        after_lower = False

    for at, ch in enumerate(text or ""):
        if ch in APOSTROPHES:
            continue
        folded = fold_char(ch)
        if not folded:
            if parts:
                end = at + 1
            continue
        if not _is_alnum(folded):
            close()
            continue
        kind = unicodedata.category(ch)
        if after_lower and kind == "Lu":
            close()
        if not parts:
            start = at
        parts.append(folded)
        end = at + 1
        after_lower = kind == "Ll"
    close()
    return out


# ``terms`` works on whole strings: only non-ASCII characters are looked up one
# by one; the three marks carry what the camelCase rule needs past the folding.
_UP, _STOP, _LOW = "\x01", "\x02", "\x03"
_NON_ASCII = re.compile(r"[^\x00-\x7f]+")
_TOKEN = re.compile(r"[^\W_]+")
_TOKEN_ASCII = re.compile(r"[a-z0-9]+")
_HAS_CAMEL_ASCII = re.compile(r"[a-z][A-Z]")
_CAMEL_ASCII = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _lower_letters() -> str:
    kept, run = [], None
    for cp in [*range(0x80, 0x3000), *range(0xA640, 0xABFF)]:
        if unicodedata.category(chr(cp)) == "Ll":
            run = (run[0], cp) if run and run[1] == cp - 1 else (cp, cp)
            if kept and kept[-1][0] == run[0]:
                kept[-1] = run
            else:
                kept.append(run)
        else:
            run = None
    return "".join(f"{chr(a)}-{chr(b)}" if a != b else chr(a) for a, b in kept)


_CAMEL = re.compile(f"(?<=[a-z{_LOW}{_lower_letters()}])(?=[A-Z{_UP}])")
_MARKS = re.compile(f"[{_UP}{_STOP}{_LOW}]")


@lru_cache(maxsize=1 << 16)
def _mapped(ch: str) -> str:
    if ch in APOSTROPHES:
        return ""
    folded = fold_char(ch)
    if not folded:
        return ""
    if not _is_alnum(folded):
        return " "
    kind = unicodedata.category(ch)
    ends_lower = unicodedata.category(folded[-1]) == "Ll"
    after = "" if ends_lower == (kind == "Ll") else _STOP if ends_lower else _LOW
    return (_UP if kind == "Lu" else "") + folded + after


class _Mapping(dict):
    """``_mapped`` by code point, for ``str.translate``."""

    def __missing__(self, cp: int) -> str:
        self[cp] = found = _mapped(chr(cp))
        return found


_MAPPING = _Mapping()


def _mapped_run(m: re.Match[str]) -> str:
    run = m[0]
    return _mapped(run) if len(run) == 1 else run.translate(_MAPPING)


def terms(text: str | None) -> list[str]:
    """The tokens of ``text`` in order, without offsets."""
    if not text:
        return []
    if "'" in text:
        text = text.replace("'", "")
    plain = text.isascii()
    if not plain:
        if _MARKS.search(text):
            text = _MARKS.sub(" ", text)
        text = _NON_ASCII.sub(_mapped_run, text)
        plain = text.isascii() and not _MARKS.search(text)
    if plain:
        if _HAS_CAMEL_ASCII.search(text):
            text = _CAMEL_ASCII.sub(" ", text)
        return _TOKEN_ASCII.findall(text.lower())
    if _CAMEL.search(text):
        text = _CAMEL.sub(" ", text)
    text = _MARKS.sub("", text)
    return _TOKEN.findall(text.lower())


# The five characters that are escaped in marked-up output.
ESCAPES = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&#39;"}
_ESCAPE_TABLE = str.maketrans(ESCAPES)


def escape_html(text: str) -> str:
    return text.translate(_ESCAPE_TABLE)


def unescape_html(text: str) -> str:
    for ch, entity in reversed(ESCAPES.items()):
        text = text.replace(entity, ch)
    return text


def capitalize(text: str) -> str:
    return text[:1].upper() + text[1:]


def format_int(n: float) -> str:
    return f"{n:,.0f}"


def format_ms(ms: float) -> str:
    return f"{ms:.{0 if ms >= 100 else 1 if ms >= 10 else 2}f}"


def format_bytes(n: float) -> str:
    if n < 1024:
        return f"{n:.0f} B"
    return f"{n / 1024:.0f} KB" if n < 1024 * 1024 else f"{n / 1024 / 1024:.1f} MB"
