"""One consistent form for texts that look the same.

``canonical`` removes invisible characters, makes every single blank a plain
one, folds full and half width, composes accents (NFC) and replaces look-alike
Greek and Cyrillic letters by their Latin ones; letters of other scripts stay.  Letter case, the presence of
accents, punctuation and the number of blanks stay as they are.

The Unicode quick-check properties tell which characters can be part of an
unstable segment; everything else is copied unchanged.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from plumbline.operators.joins import join_by_heat
from plumbline.session import materialize

# Letters that look like a Latin one, by script.
LOOK_ALIKES = (
    # Cyrillic
    ("АВЕЅІЈКМНОРСТУҮХԌԚԜӀѴ", "ABESIJKMHOPCTYYXGQWIV"),
    ("аеѕіјорсухԁԛԝһүӏѵ", "aesijopcyxdqwhylv"),
    # Greek
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ", "ABEZHIKMNOPTYXCJ"),
    ("αιονρυϲϳ", "aiovpucj"),
    # Latin letters made for phonetics
    ("ɑɡɩ", "agi"),
)
# Characters that aren't seen (joiners, marks of direction, selectors of variants, tags, fillers), and blanks as wide as one.
INVISIBLE = (
    r"\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0"
    r"\U000e0000-\U000e0fff"
)
BLANKS = r"\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000"

#: A key of a join takes about so many rows of either side.
BLOCK = 1024
#: Variants of more than this share of the texts are hot; there can't be more than its inverse of them.
HOT_SHARE = 1 / 1000

_LATIN = str.maketrans({a: b for seen, latin in LOOK_ALIKES for a, b in zip(seen, latin, strict=True)})
_GONE = re.compile(f"[{INVISIBLE}]")
_BLANK = re.compile(f"[{BLANKS}]")


def _width(ch: str) -> str:
    """Full- and half-width forms by their ordinary character."""
    kind = unicodedata.decomposition(ch)
    return unicodedata.normalize("NFKC", ch) if kind.startswith(("<wide>", "<narrow>")) else ch


def _segment(text: str) -> str:
    """The canonical form of a piece that begins at a stable boundary."""
    text = _BLANK.sub(" ", _GONE.sub("", text))
    text = unicodedata.normalize("NFD", "".join(map(_width, text)))
    return unicodedata.normalize("NFC", text.translate(_LATIN))


@cache
def _unstable() -> re.Pattern[str]:
    """Matches maximal segments that may change.

    A character belongs in there if it fails the quick check for NFC (not
    normalized alone, a combining mark, or one that can compose with what
    stands before it) or if its own canonical form is another string.
    """
    runs: list[list[int]] = []
    for cp in [*range(0x80, 0xD800), *range(0xE000, 0x10000)]:
        ch = chr(cp)
        stable = unicodedata.is_normalized("NFC", ch) and not unicodedata.category(ch).startswith("M") and _segment(ch) == ch
        if stable and not 0x1160 <= cp <= 0x11FF:  # the second and third parts of Hangul syllables compose
            continue
        if runs and runs[-1][1] == cp - 1:
            runs[-1][1] = cp
        else:
            runs.append([cp, cp])
    runs.append([0x10000, 0x10FFFF])  # few texts have any of these, and one range is found quicker than many
    inside = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)
    return re.compile(f"[{inside}]+")


_short_segment = lru_cache(maxsize=1 << 16)(_segment)


def canonical(text: str | None) -> str | None:
    """The form that all texts looking like ``text`` share; null stays null."""
    if not text or text.isascii():
        return text
    parts, at = [], 0
    for m in _unstable().finditer(text):
        # The character before a segment is its context: a mark may compose with it.
        begin, end = max(m.start() - 1, at), m.end()
        parts += (text[at:begin], (_short_segment if end - begin < 16 else _segment)(text[begin:end]))
        at = end
    if not at:
        return text
    parts.append(text[at:])
    changed = "".join(parts)
    # Removing an invisible character can bring a mark next to a new base.
    return changed if unicodedata.is_normalized("NFC", changed) else canonical(unicodedata.normalize("NFC", changed))


def with_canonical(df: DataFrame, text: str, out: str = "canonical") -> DataFrame:
    """``df`` with the canonical form of column ``text`` in column ``out``."""
    return df.withColumn(out, canonical_column(F.col(text)))


def canonical_column(text: Column) -> Column:
    return _canonical(text)


def _canonical_batch(texts: pa.Array) -> pa.Array:
    return pa.array([canonical(t) for t in texts.to_pylist()], pa.string())


_canonical = F.arrow_udf(_canonical_batch, StringType())


def look_alike_pairs(df: DataFrame, key: str, text: str, expand: int = 16) -> DataFrame:
    """``(a, b)``, a < b: keys of different texts that look the same.

    Null and empty texts take no part.  Equal texts are copies of one variant,
    and all pairs of keys of different variants of a look come out.  Only
    copies are abbreviated: of a variant with more than ``expand`` of them all
    but the smallest key are paired with every key but such copies of other
    variants, so each link between different texts is there and copies of
    copies aren't multiplied.  A repeated key counts once; an empty table gives
    no rows.

    Only 128-bit hashes are shuffled, never texts.  The keys of a look are
    joined in blocks of about ``BLOCK`` by ``BLOCK``.
    """
    seen = df.filter(F.col(text).isNotNull() & (F.col(text) != "")).select(F.col(key).alias("k"), F.col(text).alias("t"))
    seen = seen.select("k", "t", canonical_column(F.col("t")).alias("c"))
    both = [F.xxhash64(*x).alias(n) for n, x in (("c1", ["c"]), ("c2", [F.lit("c"), "c"]), ("t1", ["t"]), ("t2", [F.lit("t"), "t"]))]
    seen = materialize(seen.select("k", *both), "look")
    look, variant = ["c1", "c2"], ["c1", "c2", "t1", "t2"]
    variants = seen.groupBy(*variant).agg(F.min("k").alias("rep"), F.count("*").alias("keys"))
    variants = materialize(variants.withColumn("few", F.col("keys") <= expand), "variants")
    counted = variants.agg(F.coalesce(F.sum("keys"), F.lit(0)).alias("n")).first()["n"]
    looks = variants.groupBy(*look).agg(F.count("*").alias("n"), F.sum("keys").alias("all"), F.sum(F.when(F.col("few"), F.col("keys")).otherwise(1)).alias("full")).filter("n > 1")
    parts = [F.ceil(F.col(n) / BLOCK).cast("int").alias(f"{n}_parts") for n in ("all", "full")]
    known = materialize(variants.join(looks.select(*look, *parts), look), "looks")
    placed = join_by_heat(seen, known, variant, F.col("keys") > counted * HOT_SHARE).withColumn("is_full", F.col("few") | (F.col("k") == F.col("rep")))
    placed = materialize(placed.select(*variant, "k", "is_full", "all_parts", "full_parts"), "placed")
    at, by = (F.pmod(F.xxhash64("k"), n).cast("int") for n in ("all_parts", "full_parts"))
    span = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    every = placed.select(*variant, "k", "is_full", at.alias("at"), span("full_parts").alias("by"))
    other = placed.filter("is_full").select(*look, F.col("t1").alias("o1"), F.col("t2").alias("o2"), F.col("k").alias("o"), by.alias("by"), span("all_parts").alias("at"))
    pairs = every.join(other, [*look, "at", "by"]).filter("(t1 <> o1 or t2 <> o2) and (k < o or (not is_full and k <> o))")
    return pairs.select(F.least("k", "o").alias("a"), F.greatest("k", "o").alias("b")).distinct()
