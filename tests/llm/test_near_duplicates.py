import random
import time

import numpy as np
import pytest

from plumbline.functions.text import terms
from plumbline.llm import near_duplicates as nd
from plumbline.llm import queries
from plumbline.llm.components import components, grouped
from plumbline.session import brief_shuffles, materialize

SCHEMA = "id string, title string, description string, rec long, terms string, h1 int"


def brute(rows, least, t):
    sets = {r[0]: set(terms(r[1])) | set(terms(r[2])) for r in rows if r[0] is not None and len(set(terms(r[2]))) >= max(least, 1)}
    ids = sorted(sets)
    return {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-9}


def found(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)
    got = [tuple(r) for r in nd.near_duplicates(df, "id", ["title", "description"], **options).collect()]
    assert len(got) == len(set(got))
    return set(got)


def corpus(seed, n, vocabulary=400, longest=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    weights = [1 / (i + 1) for i in range(vocabulary)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.5:
            base = rng.choice(rows)[2].split()
            for _ in range(rng.randint(0, len(base) // 3)):
                base[rng.randrange(len(base))] = rng.choice(words)
            rng.shuffle(base)
            text = " ".join(base)
        else:
            text = " ".join(rng.choices(words, weights, k=rng.randint(1, longest)))
        rows.append((f"r{i:04d}", rng.choice(["", None, "The Title"]), text))
    return rows


@pytest.mark.parametrize(("t", "least"), [(0.6, 12), (0.6, 1), (0.8, 1), (0.5, 3)])
def test_equals_brute_force(spark, monkeypatch, t, least):
    monkeypatch.setattr(nd, "POSTINGS", 2)  # as if the collection were large: pairs and triples are used
    rows = corpus(7, 300)
    assert found(spark, rows, least_terms=least, t=t, expand=1000) == brute(rows, least, t)


def test_long_runs_are_joined_in_parts(spark, monkeypatch):
    """A hot combination: a third of all rows share most of their words, but no two their set."""
    monkeypatch.setattr(nd, "PART", 5)
    runs, real = [], nd._candidates
    monkeypatch.setattr(nd, "_candidates", lambda raw, t: runs.append(raw.filter("run is not null").count()) or real(raw, t))
    rng = random.Random(19)
    shared = [f"s{i}" for i in range(15)]
    rows = corpus(18, 120) + [(f"h{i:03d}", None, " ".join(shared + [f"u{i}_{k}" for k in range(rng.randint(1, 8))])) for i in range(80)]
    assert found(spark, rows, least_terms=3, t=0.6, expand=1000) == brute(rows, 3, 0.6)
    assert found(spark, rows, least_terms=3, t=0.8, expand=1000) == brute(rows, 3, 0.8)
    assert min(runs) > 0


def test_many_buckets_are_shuffled_in_waves(spark, monkeypatch):
    """However many buckets a set's sketch goes to, no more than a bounded multiple of the sets is shuffled at once."""
    rows, sent, real = corpus(7, 300), [], nd._emit
    monkeypatch.setattr(nd, "POSTINGS", 2)
    monkeypatch.setattr(nd, "BUCKET", 200)
    monkeypatch.setattr(nd, "WEIGHED", 1, raising=False)

    def counted(*args):
        total, emit = spark.sparkContext.accumulator(0), real(*args)
        sent.append(total)

        def run(batches):
            for batch in emit(batches):
                total.add(sum(map(len, batch.column("blob").to_pylist())))
                yield batch

        return run

    monkeypatch.setattr(nd, "_emit", counted)
    assert found(spark, rows, least_terms=1, t=0.6, expand=1000) == brute(rows, 1, 0.6)
    places = sum(len(x) for x in {frozenset(terms(r[1])) | frozenset(terms(r[2])) for r in rows if terms(r[2])})
    assert len(sent) > 3
    assert max(x.value for x in sent) <= 1.2 * nd.WAVE * places
    assert sum(x.value for x in sent) > 3 * nd.WAVE * places


def test_shuffles_are_off_the_disk_when_a_wave_ends(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        return {f for f in (manager.getAllFiles().apply(i).getName() for i in range(manager.getAllFiles().size())) if f.startswith("shuffle_")}

    before = files()
    with brief_shuffles(spark):
        table = materialize(spark.range(5000).repartition(4), "waved")
    deadline = time.time() + 10
    while files() - before and time.time() < deadline:
        time.sleep(0.1)
    assert not files() - before
    assert table.count() == 5000


def test_nulls_empty_texts_ties_and_copies(spark):
    same = " ".join(f"a{i}" for i in range(20))
    rows = [("b", "t", same), ("a", "t", same), ("c", "t", same), ("d", None, same + " more"), ("e", "t", None), ("f", "t", ""), (None, "t", same), ("g", None, None)]
    assert found(spark, rows) == {("a", "b"), ("a", "c"), ("b", "c"), ("a", "d"), ("b", "d"), ("c", "d")}


def test_large_classes_come_out_as_stars_and_keep_their_links(spark):
    same = " ".join(f"a{i}" for i in range(20))
    rows = [(f"x{i:02d}", None, same) for i in range(30)] + [("y", None, same + " more")]
    got = found(spark, rows, expand=5)
    assert got == {("x00", f"x{i:02d}") for i in range(1, 30)} | {(f"x{i:02d}", "y") for i in range(30)}


@pytest.mark.parametrize("block", [3, 1024])
def test_different_texts_of_large_classes_come_out_in_full(spark, monkeypatch, block):
    monkeypatch.setattr(nd, "BLOCK", block, raising=False)
    rng = random.Random(15)
    same, other = [f"a{i}" for i in range(20)], [f"a{i}" for i in range(18)] + ["b0", "b1"]
    rows = [(f"x{i:02d}", None, " ".join(rng.sample(same, 20))) for i in range(20)]
    rows += [(f"w{i:02d}", rng.choice([None, "a1"]), " ".join(rng.sample(other, 20))) for i in range(18)]
    rows += [("c0", "", rows[0][2]), ("c1", None, rows[0][2]), ("y", None, " ".join(same) + " more"), ("z", None, "alone")]
    assert found(spark, rows) == brute(rows, 12, 0.6)
    copies = [(f"k{i:02d}", None, rows[1][2]) for i in range(20)]
    inside = {(a, b) for a, b in brute(rows + copies, 12, 0.6) if not (a > "k00" and b > "k00" and {a, b} <= {c[0] for c in copies} | {"x01"})}
    assert found(spark, rows + copies) == inside


def test_empty_table_and_long_text(spark):
    assert found(spark, []) == set()
    long = " ".join(f"w{i}" for i in range(70_000))
    assert found(spark, [("a", None, long), ("b", None, long + " and one more")]) == {("a", "b")}


def test_every_similar_pair_shares_a_combination():
    """The guarantee itself, on sets of all sizes and with terms of all classes."""
    rng = np.random.default_rng(3)
    for t in (0.5, 0.6, 0.8):
        pool = rng.integers(0, 2**63, 300).astype(np.uint64)
        pool.sort()
        frequency = rng.integers(1, 500, 300)
        order = nd.Order(pool, frequency, 2.0, 1000, t)
        for _ in range(300):
            n = int(rng.integers(1, 90))
            a = rng.choice(pool, n, replace=False)
            drop, add = int(rng.integers(0, n)), int(rng.integers(0, n))
            b = np.unique(np.r_[a[drop:], rng.choice(pool, add)])
            a = np.unique(a)
            common = len(np.intersect1d(a, b))
            if common >= t * (len(a) + len(b) - common):
                of, sig, flag = nd.combinations(order, np.array([len(a), len(b)]), np.r_[a, b])
                small, large = (0, 1) if len(a) <= len(b) else (1, 0)
                assert set(sig[(of == small) & flag]) & set(sig[of == large])


def test_sketches_never_exceed_the_difference():
    rng = np.random.default_rng(5)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 200, rng.integers(1, 80)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(2))
        s = nd.sketches(np.array([len(a), len(b)]), np.r_[a, b])
        assert np.bitwise_count(s[0] ^ s[1]).sum() <= len(np.setxor1d(a, b))


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(1000, 1200)] + [(5, 5), (None, 3)]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    label = {v: v for e in edges if None not in e for v in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a is not None and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    assert got == label
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_grouped_gives_every_row_a_class(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "id string")
    pairs = spark.createDataFrame([("a", "b")], "id_a string, id_b string")
    assert {tuple(r) for r in grouped(rows, "id", pairs, "id_a", "id_b").collect()} == {("a", "a", 1), ("b", "a", 1), ("c", "c", 0)}


def test_groups_count_the_links_of_large_classes(spark, tmp_path):
    rng = random.Random(13)
    same, other = [f"a{i}" for i in range(20)], [f"a{i}" for i in range(18)] + ["b0", "b1"]
    rows = [(f"x{i:02d}", None, " ".join(rng.sample(same, 20))) for i in range(20)] + [(f"w{i:02d}", "t", " ".join(other)) for i in range(18)]
    rows += [("y", None, " ".join(same) + " more"), ("z", None, "alone"), ("v", "t", None), (None, None, " ".join(same))] + corpus(14, 80)
    pairs = brute(rows, 12, 0.6)
    group = {r[0]: r[0] for r in rows if r[0] is not None}
    for _ in group:
        for a, b in pairs:
            group[a] = group[b] = min(group[a], group[b])
    want = {(k, g, sum(k in p for p in pairs)) for k, g in group.items()}
    df = spark.createDataFrame([(*r, 1, 1) for r in rows], "id string, title string, description string, updated_at int, doc_ord int")
    df.write.parquet(f"{tmp_path}/records.parquet")
    got = queries.p1_groups(spark, str(tmp_path)).collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want


def test_groups_of_an_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert nd.near_duplicate_groups(empty, "id", ["title", "description"]).count() == 0
