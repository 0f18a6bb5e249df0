import random

from pyspark.sql import functions as F

from plumbline.operators import docsets


def test_sets(spark):
    rng = random.Random(1)
    a, b = ({rng.randrange(100_000) for _ in range(500)} for _ in range(2))
    x, y = docsets.from_ordinals(spark, list(a)), docsets.from_ordinals(spark, list(b))
    ordinals = lambda df: {r.doc_ord for r in df.collect()}
    assert ordinals(docsets.intersect(x, y)) == a & b and ordinals(docsets.unite(x, y)) == a | b and ordinals(docsets.without(x, y)) == a - b
    p, q = docsets.pack(x.unionByName(x)), docsets.pack(y)
    assert docsets.size(p) == len(a)
    assert docsets.size(docsets.combine([p, q], True)) == len(a & b) and docsets.size(docsets.combine([p, q], False)) == len(a | b)
    assert docsets.size(docsets.pack(x.limit(0))) == 0
    left, right = x.withColumn("f", F.lit("a")).unionByName(x.withColumn("f", F.lit("a"))), y.withColumn("g", F.col("doc_ord") % 2)
    got = {r.g: r.n for r in docsets.common_counts(left, right, "f", "g").collect()}
    assert got == {k: n for k in (0, 1) if (n := len({o for o in a & b if o % 2 == k}))}
