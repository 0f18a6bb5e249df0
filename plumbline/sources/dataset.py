"""A deterministic synthetic corpus of catalogue records, and a mix of queries over it.

The same seed and size always give the same rows.  Words are made of syllables;
how often each of them stands follows a power law, so that a few are in nearly
every record and most are in few, as in natural text.
"""

from __future__ import annotations

import math
import random
import string
from bisect import bisect
from dataclasses import dataclass
from itertools import accumulate

from plumbline.functions.text import terms

_MASK = (1 << 32) - 1


class Xoshiro(random.Random):
    """xoshiro128**, seeded by splitmix32, under the standard library's distributions."""

    def seed(self, a: int = 0, version: int = 2) -> None:
        # The constants of splitmix32 and the rotations of xoshiro128**.
        words, x = [], int(a)
        for _ in range(4):
            x += 0x9E3779B9
            z = x & _MASK
            for shift, factor in ((16, 0x21F0AAAD), (15, 0x735A2D97)):
                z = (z ^ z >> shift) * factor & _MASK
            words.append(z ^ z >> 15)
        self._words = words if any(words) else [1, 0, 0, 0]

    def _next(self) -> int:
        turned = lambda x, k: (x << k | x >> 32 - k) & _MASK
        w0, w1, w2, w3 = self._words
        out = turned(w1 * 5 & _MASK, 7) * 9 & _MASK
        w2, w3 = w2 ^ w0, w3 ^ w1
        self._words = [w0 ^ w3, w1 ^ w2, w2 ^ (w1 << 9 & _MASK), turned(w3, 11)]
        return out

    def random(self) -> float:
        return self._next() * 2.0**-32

    def getrandbits(self, k: int) -> int:
        out = 0
        for _ in range(-(-k // 32)):
            out = out << 32 | self._next()
        return out >> -k % 32


CLASSES = "Almanac Ballad Chronicle Diary Elegy Fable Guide Hymn Idyll Journal Lament Memoir Novella Ode Parable Riddle Saga Treatise".split()
_JOINING = "the of and with from that under"
_ONSETS, _NUCLEI, _CODAS = "b br c d f g gr h j l m n p r s st t tr v w".split(), "a e i o u ai ea ou é ø".split(), " n r l s t nd rk st".split(" ")
#: Different words, tokens of a record (title and description), and the power by which a word's frequency falls with its rank.
WORDS, LENGTH, FALL = 1_250, 38, 1.05


class Vocabulary:
    def __init__(self, rng: random.Random, size: int = WORDS):
        found = dict.fromkeys(_JOINING.split())
        while len(found) < size:
            found["".join(rng.choice(part) for _ in range(rng.choice((1, 2, 2, 3))) for part in (_ONSETS, _NUCLEI, _CODAS))] = None
        self.words = list(found)
        self.ends = list(accumulate((rank + 3) ** -FALL for rank in range(size)))

    def draw(self, rng: random.Random) -> str:
        return self.words[bisect(self.ends, rng.random() * self.ends[-1], hi=len(self.words) - 1)]

    def rare(self, rng: random.Random) -> str:
        return self.words[rng.randrange(len(_JOINING.split()), len(self.words))]


def _heading(rng: random.Random, known: Vocabulary) -> str:
    """Two to four words; now and then two of them are joined, with a capital inside."""
    words = [known.rare(rng).capitalize() for _ in range(rng.randint(2, 3))]
    if rng.random() < 0.08:
        words[:2] = ["".join(words[:2])]
    return " ".join([known.draw(rng), *words] if rng.random() < 0.4 else words)


def _text(rng: random.Random, known: Vocabulary) -> str:
    words = [known.draw(rng) for _ in range(round(rng.triangular(LENGTH / 2, LENGTH * 3 / 2)))]
    stops = sorted(rng.sample(range(3, len(words)), len(words) // 12))
    parts = [words[a:b] for a, b in zip([0, *stops], [*stops, len(words)], strict=True)]
    return " ".join(" ".join(p).capitalize() + "." for p in parts if p)


def generate_records(seed: int = 7, total: int = 10_000) -> list[dict]:
    """Unique ids and titles; years 1850 to 2029, ratings 0 to 10 in tenths, popularity from 1."""
    rng = Xoshiro(seed)
    known = Vocabulary(rng)
    records: list[dict] = []
    taken: dict[str, int] = {}
    while len(records) < total:
        title = _heading(rng, known)
        times = taken[title.lower()] = taken.get(title.lower(), 0) + 1
        if times > 1:
            title += f" vol {times}"
        quality = rng.betavariate(5, 3)
        records.append({
            "id": f"item-{len(records):06d}", "title": title, "description": _text(rng, known), "genres": rng.sample(CLASSES, rng.choices((1, 2, 3), (2, 5, 4))[0]),
            "year": int(rng.triangular(1850, 2030, 2005)), "rating": round(10 * quality, 1), "popularity": math.ceil(100 * (1 + quality) * rng.paretovariate(1.2)),
        })
    return records


def misspelt(rng: random.Random, word: str) -> str:
    """A word one edit away, any letter and any place alike; words under four letters stay."""
    if len(word) < 4:
        return word
    cut = rng.randrange(1, len(word))
    head, tail, letter = word[:cut], word[cut:], rng.choice(string.ascii_lowercase)
    return rng.choice([head[:-1] + tail, head + letter + tail, head[:-1] + letter + tail, head[:-1] + tail[0] + head[-1] + tail[1:]])


@dataclass(frozen=True)
class MixedQuery:
    kind: str
    query: str
    facet_filters: list[list[str]] | None = None


def _faceted(rng: random.Random, record: dict, words: list[str]) -> tuple[str, list[list[str]]]:
    decade = f"{record['year'] // 10}0s"
    return rng.choice(words)[:3], [[f"genre:{rng.choice(record['genres'])}"], [f"decade:{decade}"]]


#: Each kind of query, made of a record and its words of three letters or more.
_MADE = {
    "word": lambda rng, record, words: (rng.choice(words), None),
    "prefix": lambda rng, record, words: ((w := rng.choice(words))[: rng.randrange(1, len(w))], None),
    "typo": lambda rng, record, words: (misspelt(rng, rng.choice(words)), None),
    "two-words": lambda rng, record, words: (" ".join(rng.choices(words, k=2)), None),
    "three-words": lambda rng, record, words: (" ".join(rng.choices(words, k=3)), None),
    "faceted": _faceted,
}
KINDS = tuple(_MADE)


def query_mix(records: list[dict], n: int = 1000, seed: int = 11) -> list[MixedQuery]:
    """Queries of all kinds, made of words of random records; records without words, and for some kinds without genre or year, are passed over."""
    rng = Xoshiro(seed)
    out: list[MixedQuery] = []
    while len(out) < n:
        record, kind = rng.choice(records), rng.choice(KINDS)
        words = [w for w in terms(f"{record['title'] or ''} {record['description'] or ''}") if len(w) >= 3]
        if words and (kind != "faceted" or record["genres"] and record["year"] is not None):
            out.append(MixedQuery(kind, *_MADE[kind](rng, record, words)))
    return out


def percentile(ordered: list[float], p: float) -> float:
    """The element at floor(p / 100 * n), the last at most."""
    return ordered[min(len(ordered) - 1, math.floor(p / 100 * len(ordered)))] if ordered else 0.0
