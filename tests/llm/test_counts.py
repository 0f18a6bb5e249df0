import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions.text import terms
from plumbline.functions.values import clean_values
from plumbline.llm import burst, distinctive, queries
from plumbline.llm.baskets import co_occurrences


def test_pairs_equal_brute_force(spark):
    rng = random.Random(2)
    rows = [[rng.choice(["Noir", " noir ", "Spy", "caper", "", None, "War", "x"]) for _ in range(rng.randint(0, 5))] for _ in range(300)] + [None, []]
    df = spark.createDataFrame([(r, 1, "b") for r in rows], "genres array<string>, n int, basket string")
    sets = [{v.strip().lower() for v in r or [] if v and v.strip()} for r in rows]
    single, pair = Counter(v for s in sets for v in s), Counter(p for s in sets for p in combinations(sorted(s), 2))
    got = {(r.item_a, r.item_b): r for r in co_occurrences(df, clean_values(F.col("genres"))).collect()}
    assert {k: r.n for k, r in got.items()} == pair
    for (a, b), r in got.items():
        assert (r.n_a, r.n_b, r.n_all) == (single[a], single[b], len(rows))
        assert r.lift == pytest.approx(r.n * len(rows) / (single[a] * single[b]))
        assert (r.conviction is None) == (r.n == r.n_a)
    few = co_occurrences(df, clean_values(F.col("genres")), min_count=20).collect()
    assert {(r.item_a, r.item_b) for r in few} == {k for k, n in pair.items() if n >= 20}


def test_pairs_of_an_empty_table(spark):
    assert co_occurrences(spark.createDataFrame([], "g array<string>"), clean_values(F.col("g"))).count() == 0


def test_rare_pairs_come_out(spark, tmp_path):
    rows = [("a", ["Noir", "spy "]), ("b", ["noir", "War"]), ("c", ["NOIR", "war"]), ("d", None)] + [(f"x{i}", ["Noir", "x"]) for i in range(5)]
    df = spark.createDataFrame([(*r, 1, 1) for r in rows], "id string, genres array<string>, updated_at int, doc_ord int")
    df.write.parquet(f"{tmp_path}/records.parquet")
    got = {(r.item_a, r.item_b, r.n, r.n_a, r.n_b, r.n_all) for r in queries.p2_pairs(spark, str(tmp_path)).collect()}
    assert got == {("noir", "spy", 1, 8, 1, 9), ("noir", "war", 2, 8, 2, 9), ("noir", "x", 5, 8, 5, 9)}


def test_burst_trie_keeps_its_counts():
    rng = random.Random(4)
    want: dict[str, list[int]] = {}
    trie = burst.BurstTrie(8)
    for _ in range(5000):
        term = "".join(rng.choice("abé") for _ in range(rng.randint(0, 7)))
        trie.add(term, 2, 1)
        held = want.setdefault(term, [0, 0])
        held[0] += 2
        held[1] += 1
    got: dict[str, list[int]] = {}
    for path, leaf in trie.containers():
        assert len(leaf) <= 8
        for suffix, counts in leaf.items():
            assert path + suffix not in got
            got[path + suffix] = counts
    assert got == want


@pytest.mark.parametrize("subtree", [3, 10**6])
def test_counts_equal_brute_force(spark, subtree):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["the", "theatre", "then", "thé", "other", f"x{rng.randrange(50)}"]) for _ in range(rng.randint(0, 12))) for _ in range(200)]
    texts += [None, "", "The " * 50_000]
    df = spark.createDataFrame([(t, t and t[::-1], 7) for t in texts], "a string, b string, field int").repartition(5)
    got = {(r.field, r.value): (r.occurrences, r.records) for r in burst.count_values(df, {"a": terms, "b": terms}, container=4, subtree=subtree).collect()}
    want = {}
    for field, column in (("a", texts), ("b", [t and t[::-1] for t in texts])):
        occurrences = Counter(w for t in column for w in terms(t))
        records = Counter(w for t in column for w in set(terms(t)))
        want |= {(field, w): (n, records[w]) for w, n in occurrences.items()}
    assert got == want
    assert burst.count_values(df.limit(0), {"a": terms}).count() == 0


def test_long_common_prefixes_are_split(spark):
    """A million values of one 30-character prefix: no task merges all of them."""
    from plumbline.session import materialize

    prefix = "https://example.org/a/b/c/d/e/"
    df = spark.range(1_000_000, numPartitions=8).select(F.concat(F.lit(prefix), F.col("id").cast("string")).alias("v"), (F.col("id") % 3).alias("part"))
    counts = materialize(burst.count_values(df, {"v": lambda v: [v]}).withColumn("task", F.spark_partition_id()), "test")
    assert counts.agg(F.count("*"), F.count_distinct("value"), F.min("records"), F.max("occurrences")).first()[:] == (1_000_000, 1_000_000, 1, 1)
    routed = burst._route({"v": {prefix[:i]: 5 if i == burst.DEPTH else 1 for i in range(burst.DEPTH + 1)}})
    import pyarrow as pa

    leaf = [("v", prefix, 100, burst._pack({str(i): [1, 1] for i in range(100)}))]
    got = [r for b in routed([pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*leaf), burst._LEAF.types)], schema=burst._LEAF)]) for r in b.to_pylist()]
    assert {r["part"] for r in got} == set(range(5)) and {r["path"] for r in got} == {prefix[: burst.DEPTH + 1]}
    assert {r["path"] + s for r in got for s, _, _ in burst._unpack(r["blob"])} == {f"{prefix}{i}" for i in range(100)}


def test_marks(spark):
    counts = spark.createDataFrame([("a", "x", 5, 1), ("a", "y", 9, 2), ("a", "z", 9, 20)], "field string, value string, occurrences long, records long")
    assert {r.value: r.mark for r in burst.marked_values(counts, 100).collect()} == {"x": "rare", "y": None, "z": "common"}


def _model(rows, total):
    """Plain expectation-maximisation, a record at a time, for very many rounds."""
    out = {}
    for key, words in rows.items():
        counts = Counter(words)
        names = list(counts)
        n, b = np.array([counts[w] for w in names], float), np.array([total[w] for w in names])
        p = n / n.sum()
        for _ in range(20_000):
            e = n * distinctive.OWN * p / (distinctive.OWN * p + (1 - distinctive.OWN) * b)
            p = e / e.sum()
        out |= {(key, w): x for w, x in zip(names, p)}
    return out


@pytest.mark.parametrize(("hot", "model"), [(0.05, 40), (1 / 100_000, 2_000_000), (1.0, 1)])
def test_distinctive_terms_equal_a_plain_model(spark, monkeypatch, hot, model):
    monkeypatch.setattr(distinctive, "HOT_SHARE", hot)
    monkeypatch.setattr(distinctive, "MODEL", model)
    rng = random.Random(6)
    rows = {f"r{i}": [rng.choice(["the", "of", "a", "sea", f"rare{rng.randrange(60)}"]) for _ in range(rng.randint(1, 30))] for i in range(60)}
    data = [(k, " ".join(w[:2]), " ".join(w[2:]), "x", 1) for k, w in rows.items()] + [("none", None, None, "x", 1), ("empty", "", "", "x", 1), (None, "the", "the", "x", 1)]
    df = spark.createDataFrame(data, "id string, title string, description string, term string, n int").repartition(3)
    got = {(r.id, r.term): r for r in distinctive.distinctive_terms(df, "id", ["title", "description"]).collect()}
    every = Counter(w for ws in rows.values() for w in ws)
    records = Counter(w for ws in rows.values() for w in set(ws))
    want = _model(rows, {w: n / sum(every.values()) for w, n in every.items()})
    assert got.keys() == want.keys()
    for (key, word), r in got.items():
        assert r.weight == pytest.approx(want[key, word], abs=1e-4) and (r.n, r.records) == (rows[key].count(word), records[word])
    top = distinctive.distinctive_terms(df, "id", ["title", "description"], top=2).collect()
    assert all(sum(1 for r in top if r.id == k) == min(2, len(set(w))) for k, w in rows.items())
    kept = distinctive.distinctive_terms(df, "id", ["title", "description"], min_count=3, max_records=5).collect()
    assert {(r.id, r.term) for r in kept} == {k for k, r in got.items() if r.n >= 3 and r.records <= 5}


def _random_records(seed, n):
    rng = np.random.default_rng(seed)
    of = np.repeat(np.arange(n), rng.integers(1, 40, n))
    return of, rng.integers(1, 6, len(of)).astype(float), 10.0 ** rng.uniform(-6, -1, len(of))


def test_weights_dont_depend_on_the_other_records():
    of, counts, background = _random_records(16, 60)
    together = distinctive.own_mass(of, counts, background)
    for r in range(60):
        own = np.flatnonzero(of == r)
        for order in (own, own[::-1]):
            assert distinctive.own_mass(np.zeros(len(own), int), counts[order], background[order]).tolist() == together[order].tolist()


def test_every_record_converges():
    """Another round changes nothing, and no other share is likelier; the first record takes thousands of plain rounds."""
    of, counts, background = (np.r_[x, y] for x, y in zip(([0, 0], [1.0, 1.0], [0.4, 0.5]), (_random_records(17, 500)[0] + 1, *_random_records(17, 500)[1:])))
    share = distinctive.own_mass(of, counts, background)
    starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    spread = np.diff(np.r_[starts, len(of)])
    mass = counts * distinctive.OWN * share / (distinctive.OWN * share + (1 - distinctive.OWN) * background)
    assert np.abs(mass / np.repeat(np.add.reduceat(mass, starts), spread) - share).max() < 1e-12
    slope = counts / (distinctive.OWN * share + (1 - distinctive.OWN) * background)
    most = np.repeat(np.maximum.reduceat(slope, starts), spread)
    assert (np.abs(slope - most)[share > 0] < 1e-9 * most[share > 0]).all() and (share == 0).any()


def test_every_term_has_a_weight(spark, tmp_path):
    rows = [("a", "The Sea", " ".join(f"w{i}" for i in range(40))), ("b", None, "the the sea"), ("c", "", None)]
    spark.createDataFrame([(*r, 1, 1) for r in rows], "id string, title string, description string, updated_at int, doc_ord int").write.parquet(f"{tmp_path}/records.parquet")
    got = queries.QUERIES["p6_weights"](spark, str(tmp_path)).collect()
    want = {(k, w): n for k, *texts in rows for w, n in Counter(w for t in texts for w in terms(t)).items()}
    assert len(got) == len(want) and {(r.id, r.term): r.n for r in got} == want
    assert all(sum(r.weight for r in got if r.id == k) == pytest.approx(1) for k in "ab")


def test_distinctive_terms_of_an_empty_table(spark):
    assert distinctive.distinctive_terms(spark.createDataFrame([], "id string, t string"), "id", ["t"]).count() == 0


def test_common_words_lose_their_mass():
    share = distinctive.own_mass(np.array([0, 0]), np.array([5.0, 5.0]), np.array([0.5, 0.00001]))
    assert share[0] < 0.01 < 0.9 < share[1]
