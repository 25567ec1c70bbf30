import math

import numpy as np
from pyspark.sql import functions as F

from pvspark.llm import neighbours as N


def vectors(spark, x, more=()):
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)] + list(more)
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def brute(x, q, top):
    x = x.astype(np.float32).astype(np.float64)
    s = x @ x[q]
    order = sorted((k for k in range(len(x)) if k != q), key=lambda k: (-s[k], k))
    return order[:top], s


def test_recall_and_order(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 24))
    x *= rng.uniform(0.5, 1.5, size=(1500, 1))
    p = N.Params(block=100, top=10)
    df = vectors(spark, x).withColumns({c: F.lit("x") for c in ("node", "label", "v", "ids")})
    rows = N.nearest(df, F.col("vec_id") % 25 == 0, p).collect()
    assert len(rows) == 60 * 10
    hits = 0
    for q in range(0, 1500, 25):
        got = sorted((r.rank, r.vec_id, r.score) for r in rows if r.query_id == q)
        assert [r for r, _, _ in got] == list(range(1, 11))
        best, s = brute(x, q, 10)
        hits += len(set(best) & {v for _, v, _ in got})
        assert all(math.isclose(score, s[v], rel_tol=1e-9, abs_tol=1e-12) for _, v, score in got)
        assert [(-sc, v) for _, v, sc in got] == sorted((-sc, v) for _, v, sc in got)
    assert hits >= 0.9 * 600


def test_hot_vector_and_unusable_rows(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 8))
    x[20:80] = x[20]
    nan, inf = float("nan"), float("inf")
    more = [(200, None), (205, [0.0] * 8), (210, [nan] * 8), (215, [inf] + [1.0] * 7), (220, []), (225, [1.0, None] * 4), (None, [1.0] * 8)]
    rows = N.nearest(vectors(spark, x, more), F.col("vec_id") % 5 == 0, N.Params(top=6)).collect()
    assert {r.query_id for r in rows} == set(range(0, 120, 5))
    for q in range(0, 120, 5):
        got = [r.vec_id for r in sorted(rows, key=lambda r: r["rank"]) if r.query_id == q]
        assert got == brute(x, q, 6)[0], q


def test_few_and_none(spark):
    rows = N.nearest(vectors(spark, np.array([[1.0, 0], [0, 1], [1, 1]])), F.col("vec_id") == 0).collect()
    assert [(r["rank"], r.vec_id, r.score) for r in rows] == [(1, 2, 1.0), (2, 1, 0.0)]
    alone = vectors(spark, np.array([[1.0, 2.0]]))
    assert N.nearest(alone, F.col("vec_id") == 0).count() == 0
    assert N.nearest(alone.limit(0), F.lit(True)).count() == 0
    mixed = vectors(spark, np.ones((3, 2)), [(10, [1.0, 1.0, 1.0]), (11, [2.0, 1.0, 1.0])])
    found = {(r.query_id, r.vec_id) for r in N.nearest(mixed, F.col("vec_id") == 10).collect()}
    assert found == {(10, 11)}


def test_batches_are_bounded_by_bytes(spark):
    """Ten thousand lists of a beam were one batch of some 17 MB and many times that in a worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        N.nearest(vectors(spark, np.eye(4)), F.col("vec_id") == 0).collect()
        assert int(spark.conf.get(key)) == 4 << 20
    finally:
        spark.conf.set(key, before)
