import itertools
import random
import unicodedata

import numpy as np
import pytest

from plumbline.llm import leakage, lookalike, mixing, queries
from plumbline.llm.lookalike import canonical, look_alike_pairs, with_canonical

SAME = [
    ("Café", "Café"), ("ABC def", "ＡＢＣ　ｄｅｆ"), ("plain text", "pl​ain te­xt﻿"), ("a b", "a b"), ("a b", "a b"), ("sport", "ѕроrt"),
    ("KIT", "ΚΙΤ"), ("Noël", "Nо​ёl"), ("ｶﾞ", "ガ"), ("é", "e​́"), ("한", "한"), ("ό", "ó"), ("ǖ", "ǖ"),
]
APART = [("Cafe", "Café"), ("a b", "a  b"), ("abc", "ABC"), ("it's", "it’s"), ("...", "…"), ("1⁄2", "½"), ("x2", "x²"), ("fi", "ﬁ"), ("a\tb", "a b"), ("и", "й"), ("l", "I")]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same_look(a, b):
    assert canonical(a) == canonical(b)


@pytest.mark.parametrize(("a", "b"), APART)
def test_other_look(a, b):
    assert canonical(a) != canonical(b)


def test_canonical_is_stable_and_equals_whole_text_normalization():
    rng = random.Random(9)
    pool = "abcdé ņ̃́̈оеаＡｂ　​­Οοκガｶﾞ한한’.,\n" + "".join(map(chr, range(0x300, 0x330)))
    from plumbline.llm import lookalike

    for _ in range(3000):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))
        once = canonical(text)
        assert canonical(once) == once and unicodedata.is_normalized("NFC", once)
        assert once == lookalike._segment(text)


def test_look_alike_pairs(spark):
    rows = [(1, "Café noir"), (2, "Café noir"), (3, "Café noir"), (4, "Café noir"), (5, "cafe noir"), (6, None), (7, ""), (8, "​"), (9, "­"), (9, "­")]
    df = spark.createDataFrame([(*r, 0, "c") for r in rows], "doc_id long, text string, c1 int, k string")
    got = {tuple(r) for r in look_alike_pairs(df, "doc_id", "text").collect()}
    shown = {k: t for k, t in rows if t}
    pairs = {p for p in itertools.combinations(sorted(shown), 2) if shown[p[0]] != shown[p[1]] and canonical(shown[p[0]]) == canonical(shown[p[1]])}
    assert got == pairs and len(pairs) > 4
    few = {tuple(r) for r in look_alike_pairs(df, "doc_id", "text", expand=1).collect()}
    assert few == {p for p in pairs if not all(any(shown[o] == shown[k] and o < k for o in shown) for k in p)}
    assert look_alike_pairs(df.limit(0), "doc_id", "text").count() == 0
    assert [r.canonical for r in with_canonical(df, "text").orderBy("doc_id").limit(3).collect()] == ["Café noir"] * 3


@pytest.mark.parametrize("gone", ["\u200d", "\ufe0f", "\U000e0101", "\U000e0041", "\u3164", "\u2064"])
def test_invisible_characters(gone):
    assert canonical(f"a{gone}b") == "ab" and canonical(gone) == "" and canonical(f"e{gone}\u0301") == "\u00e9"


def test_copies_of_two_variants_are_paired_with_each_other(spark, monkeypatch):
    monkeypatch.setattr(lookalike, "HOT_SHARE", 0.1)
    rows = [(i, "noir") for i in range(5)] + [(i, "nоir") for i in range(5, 9)] + [(i, f"text {i}") for i in range(20, 60)]
    df = spark.createDataFrame([(*r, True) for r in rows], "doc_id long, text string, few boolean")
    assert sorted(map(tuple, look_alike_pairs(df, "doc_id", "text").collect())) == [(a, b) for a in range(5) for b in range(5, 9)]


@pytest.mark.parametrize("block", [3, 1024])
def test_all_variants_of_a_look_are_paired(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(lookalike, "BLOCK", block, raising=False)
    variants = ["".join(x) + " film" for x in itertools.product("oо", "aа", "cс", "eе", "pр")][:20]
    rows = [(i * 7 % 20, v) for i, v in enumerate(variants)] + [(100, variants[3]), (101, variants[3]), (102, "other")]
    spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, rep string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in queries.p9_found(spark, str(tmp_path)).collect()]
    copies = [(i, k) for i in range(20) for k in (100, 101) if rows[3][0] != i]
    assert sorted(got) == sorted([*itertools.combinations(range(20), 2), *copies])


def _distance(pattern, text):
    """The least edit distance of a pattern to any part of a text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


def test_bit_parallel_distances_equal_dynamic_programming():
    rng = np.random.default_rng(10)
    for m, n in ((1, 3), (3, 0), (10, 12), (33, 40), (64, 70)):
        patterns, texts, lengths = rng.integers(0, 4, (200, m)), rng.integers(0, 4, (200, n)), rng.integers(0, n + 1, 200)
        want = [_distance(p.tolist(), t[:k].tolist()) for p, t, k in zip(patterns, texts, lengths)]
        assert leakage.best_distances(patterns, texts, lengths).tolist() == want


def test_the_filter_misses_nothing():
    rng = np.random.default_rng(12)
    hashes = rng.integers(0, 2**63, 5000).astype(np.uint64)
    made = leakage.Filter(1 << 18)
    for k in range(leakage.FILTER_HASHES):
        bit = made.places(hashes, k)
        np.bitwise_or.at(made.words, bit >> np.uint64(6), np.uint64(1) << (bit & np.uint64(63)))
    assert len(made.passing(hashes)) == 5000 and len(made.passing(rng.integers(0, 2**63, 100_000).astype(np.uint64))) < 300


def _leaks(docs, items, window, budget):
    out = set()
    for d, text in docs:
        for i, item in items:
            a, b = leakage.looked_terms(text), leakage.looked_terms(item)
            w = min(window, len(b))
            if b and any(_distance(b[s : s + w], a) <= min(budget, w - 1) for s in range(len(b) - w + 1)):
                out.add((d, i))
    return out


@pytest.mark.parametrize(("block", "window", "budget"), [(3, 6, 1), (1024, 6, 1), (1024, 7, 2), (1024, 4, 0)])
def test_leaks_equal_brute_force(spark, monkeypatch, block, window, budget):
    monkeypatch.setattr(leakage, "BLOCK", block)
    monkeypatch.setattr(leakage, "HOT_SHARE", 0.05)
    rng = random.Random(11)
    words = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(0, 9)))) for i in range(12)] + [(98, None), (99, ""), (None, "w1 w2"), (3, "w1 w5 w7 w7 w2 w2 w1")]
    docs = [(d, " ".join(rng.choices(words, k=rng.randint(0, 40)))) for d in range(60)] + [(98, None), (99, ""), (None, "w1 w2"), (97, "w1 " * 300)]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, item string").repartition(3)
    it = spark.createDataFrame([(*i, "x") for i in items], "item_id int, text string, doc string")
    got = leakage.leaks(df, "doc_id", "text", it, "item_id", "text", window=window, budget=budget).collect()
    assert {(r.doc_id, r.item_id) for r in got} == _leaks([d for d in docs if d[1] and d[0] is not None], [i for i in items if i[1] and i[0] is not None], window, budget)
    assert len(got) == len({(r.doc_id, r.item_id) for r in got})
    assert leakage.leaks(df.limit(0), "doc_id", "text", it, "item_id", "text").count() == 0
    assert leakage.leaks(df, "doc_id", "text", it.limit(0), "item_id", "text").count() == 0


def test_runs_are_whole_and_seen_through_look_alikes(spark):
    item = " ".join(f"word{i}" for i in range(30))
    hidden = "noise " * 100_000 + " ".join(f"Wоrd{i}," for i in range(7, 19)) + " more"
    short = "noise " + " ".join(f"word{i}" for i in range(7, 16)) + " more"
    docs = spark.createDataFrame([(1, hidden), (2, short), (1, hidden)], "doc_id long, text string")
    items = spark.createDataFrame([(5, item)], "item_id long, text string")
    assert {tuple(r) for r in leakage.leaks(docs, "doc_id", "text", items, "item_id", "text").collect()} == {(1, 5, 0, 12), (2, 5, 1, 9)}
    renamed = leakage.leaks(docs.withColumnRenamed("text", "doc"), "doc_id", "doc", items.toDF("doc", "item"), "doc", "item")
    assert {tuple(r) for r in renamed.collect()} == {(1, 5, 0, 12), (2, 5, 1, 9)}


def test_mix(spark):
    rng = random.Random(12)
    rows = [(i, "word " * rng.randint(1, 60), rng.choice([" A", "a", "A\t", "b", "c", None, "unlisted"])) for i in range(600)]
    rows += [(1000, None, "a"), (1001, "", "b"), (None, "word word", "a")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, tokens int").repartition(3)
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.1, 5), ("none", 0.1, 9), (None, 0.5, 1), ("c", None, 1)], "source string, target_share double, max_repeats int")
    got = mixing.mix(docs, "doc_id", "text", "source", targets, block_tokens=64)
    report = {r.source: r for r in got.report.collect()}
    used = got.documents.collect()
    total = mixing.token_counts(docs.select("text"), "text").groupBy().sum("tokens").first()[0]
    assert report.keys() == {"a", "b", "c", "none"}
    for s, share, repeats in (("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.1, 5), ("none", 0.1, 9)):
        r, own = report[s], [u for u in used if u.source == s]
        assert r.target_tokens == pytest.approx(share * total) and r.capacity_tokens == r.tokens * repeats
        assert r.reachable == (r.capacity_tokens >= r.target_tokens)
        assert all(1 <= u.repeats <= repeats for u in own) and r.mixed_tokens == sum(u.tokens * u.repeats for u in own)
        assert (r.empty_slots > 0) == (not r.reachable)
        if r.reachable:
            assert abs(r.mixed_tokens - r.target_tokens) < 4 * 64
        slots: dict = {}
        for u in own:
            assert 0 <= u.first_token and u.tokens > 0
            slots.setdefault(u.first_slot, []).append(u.tokens)
        assert sum(sum(v) != 64 for v in slots.values()) <= 1  # only the last block is shorter
    held = {}
    for u in used:
        held.setdefault((u.doc_id, u.source), []).append((u.first_token, u.tokens))
    assert all(a + n <= b for v in held.values() for (a, n), (b, _) in itertools.pairwise(sorted(v)))
    assert sum(r.actual_share for r in report.values()) == pytest.approx(1)
    assert not report["none"].reachable and report["none"].documents == 0
    again = mixing.mix(docs.repartition(5), "doc_id", "text", "source", targets, block_tokens=64).documents.collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, used))


def test_empty_mixes(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    got = mixing.mix(docs, "doc_id", "text", "source", targets)
    assert got.documents.count() == 0 and [r.source for r in got.report.collect()] == ["a"]
    some = spark.createDataFrame([(1, "word", "a")], "doc_id long, text string, source string")
    assert mixing.mix(some, "doc_id", "text", "source", targets.limit(0)).report.count() == 0
