import random

import numpy as np
from pyspark.sql import functions as F

from plumbline.llm.ranking import combined_ranking, first_component
from plumbline.llm.topn import top_n


def test_ranking(spark):
    rng = random.Random(3)
    rows = [(f"r{i:03d}", rng.choice([1.0, 2.0, 5.5, rng.random() * 10]), rng.choice([0, 0, 0, 7, 10 ** rng.randint(1, 9)]), "x") for i in range(400)]
    dirty = [("n1", None, 5, "x"), ("n2", 3.0, None, "x"), ("n3", float("nan"), 4, "x"), (None, 1.0, 1, "x")]
    df = spark.createDataFrame(rows + dirty, "id string, rating double, popularity long, position string").repartition(4)
    got = {r.id: r for r in combined_ranking(df, "id", {"rating": 1, "popularity": 1}).collect()}
    assert got.keys() == {r[0] for r in rows}
    for name, at in (("rating", 1), ("popularity", 2)):
        for row in rows:
            above, ties = sum(o[at] > row[at] for o in rows), sum(o[at] == row[at] for o in rows)
            assert got[row[0]][f"above_{name}"] == above
            assert abs(got[row[0]][f"rank_{name}"] - (1 - (above + (ties - 1) / 2) / len(rows))) < 1e-12
    order = sorted(got.values(), key=lambda r: r.position)
    assert [r.position for r in order] == list(range(1, 401)) and {r.ranked for r in order} == {400}
    assert all((-a.projection, a.id) <= (-b.projection, b.id) for a, b in zip(order, order[1:]))
    # The projection is the first principal component of the standardized ranks, here a contrast as they disagree a little.
    ranks = np.array([[r.rank_rating, r.rank_popularity] for r in order])
    first = np.linalg.eigh(np.corrcoef(ranks.T))[1][:, -1]
    want = ((ranks - 0.5) / ranks.std(axis=0)) @ (first * np.sign(first[0]))
    assert np.allclose([r.projection for r in order], want, atol=1e-6)


def test_scores_that_disagree(spark):
    rng = random.Random(4)
    rows = [(f"r{i:03d}", float(i), -i + rng.randint(0, 20)) for i in range(200)]
    df = spark.createDataFrame(rows, "id string, a double, b long")
    got = combined_ranking(df, "id", {"a": 1, "b": 1}).collect()
    ranks = np.array([[r.rank_a, r.rank_b] for r in got])
    values, vectors = np.linalg.eigh(np.corrcoef(ranks.T))
    first = vectors[:, -1] * np.sign(vectors[0, -1])
    assert first[0] > 0 > first[1] and values[-1] > 1.9
    projection = np.array([r.projection for r in got])
    assert np.allclose(projection, ((ranks - ranks.mean(axis=0)) / ranks.std(axis=0)) @ first, atol=1e-6)
    assert abs(projection.var() - values[-1]) < 1e-6  # the variance of the first component, not of the last
    turned = combined_ranking(df, "id", {"a": 1, "b": -1}).collect()
    assert max(turned, key=lambda r: r.projection).a > 190


def test_orientation_of_the_first_component():
    half = np.sqrt(0.5)
    assert np.allclose(first_component(np.array([[1, 0.3], [0.3, 1]])), [half, half])
    assert np.allclose(first_component(np.array([[1, -0.3], [-0.3, 1]])), [half, -half])
    assert np.allclose(first_component(np.eye(2)), [half, half]) and np.allclose(first_component(np.eye(3)), np.full(3, 3**-0.5))
    mixed = first_component(np.array([[1, 0.9, -0.8], [0.9, 1, -0.7], [-0.8, -0.7, 1]]))
    assert mixed[0] > 0 and mixed[1] > 0 > mixed[2]


def test_directions_and_flat_scores(spark):
    df = spark.createDataFrame([("a", 1.0, 9, 4), ("b", 2.0, 8, 4), ("c", 3.0, 7, 4)], "id string, up double, down int, flat int")
    got = combined_ranking(df, "id", {"up": 1, "down": -1, "flat": 1}).orderBy("position").collect()
    assert [r.id for r in got] == ["c", "b", "a"]
    flat = combined_ranking(df, "id", {"flat": 1}).orderBy("position").collect()
    assert [r.id for r in flat] == ["a", "b", "c"]
    assert combined_ranking(df.limit(0), "id", {"up": 1}).count() == 0


def test_top_n_equals_sorting(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["hot"] * 30 + [f"g{i}" for i in range(20)]), rng.choice([rng.randrange(50), 2**62]), f"i{rng.randrange(300)}", "x", 3) for _ in range(4000)]
    dirty = [(None, 1, "a", "x", 1), ("g1", None, "a", "x", 1), ("g1", 1, None, "x", 1)]
    df = spark.createDataFrame(rows + dirty, "genre string, popularity long, id string, group string, bound int").repartition(7)
    want = {}
    for g, p, i, *_ in rows:
        want.setdefault(g, []).append((-p, i))
    want = sorted((g, i, -p, k + 1) for g, v in want.items() for k, (p, i) in enumerate(sorted(v)[:5]))
    assert sorted(map(tuple, top_n(df, "genre", "popularity", "id", 5).collect())) == want
    assert top_n(df.filter(F.lit(False)), "genre", "popularity", "id", 5).count() == 0


def test_top_n_of_other_types(spark):
    from datetime import date
    from decimal import Decimal

    df = spark.createDataFrame([("g", 4.2, "a"), ("g", 4.9, "b"), ("g", 4.5, "c"), ("g", float("nan"), "d"), ("h", -0.0, "b"), ("h", 0.0, "c"), ("h", 0.0, "a"), ("h", None, "e")], "g string, s double, i string")
    got = [tuple(r) for r in top_n(df, "g", "s", "i", 2).orderBy("g", "rank").collect()]
    assert got == [("g", "b", 4.9, 1), ("g", "c", 4.5, 2), ("h", "a", 0.0, 1), ("h", "b", 0.0, 2)]
    for kind, values in (("decimal(20,3)", [Decimal("1.001"), Decimal("1.002")]), ("date", [date(2000, 1, 1), date(2001, 1, 1)]), ("smallint", [1, 2])):
        df = spark.createDataFrame([("g", v, str(v)) for v in values], f"g string, s {kind}, i string")
        assert [tuple(r) for r in top_n(df, "g", "s", "i", 1).collect()] == [("g", str(values[1]), values[1], 1)]


def test_top_n_in_many_folds(spark, monkeypatch):
    from plumbline.llm import topn

    monkeypatch.setattr(topn, "HELD", 10)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        df = spark.range(500).select((F.col("id") % 3).cast("string").alias("g"), (F.col("id") * 7 % 500).alias("s"), F.col("id").cast("string").alias("i")).coalesce(1)
        got = top_n(df, "g", "s", "i", 4).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for g in "012":
        best = sorted((x * 7 % 500 for x in range(500) if x % 3 == int(g)), reverse=True)[:4]
        assert [r.s for r in sorted(got, key=lambda r: r["rank"]) if r.g == g] == best
