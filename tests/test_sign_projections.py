import numpy as np
import pytest
from pyspark.sql import functions as F
from test_similarity import brute_self, cosines, frame, indexed

from pvspark.operators import duplicates, sign_projections
from pvspark.operators.sign_projections import approximate_duplicates, choose_bands, meeting_probability


def near_copies(centres, dims, each, noise, seed):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dims))
    rows = np.repeat(middle, each, axis=0) + rng.normal(size=(centres * each, dims)) * noise
    return rows[rng.permutation(len(rows))]


@pytest.mark.parametrize("centres", [60, 300])
def test_recall_at_two_sizes(spark, centres):
    """Pairs spread from the threshold upwards; what is found is exact."""
    m = near_copies(centres, 32, 4, 0.26, centres)
    want = brute_self(m, 0.9)
    found = approximate_duplicates(frame(spark, m), 0.9)
    rows = found.pairs().collect()
    got = indexed(rows)
    assert len(rows) == len(got) and got <= want
    assert len(want) > centres and len(got) >= 0.9 * len(want)
    s = cosines(m, m)
    assert all(abs(r.similarity - s[int(r.file_a[1:]), int(r.file_b[1:])]) < 1e-12 for r in rows)


def test_copies_zero_vectors_and_reports(spark):
    m = np.vstack([near_copies(20, 16, 3, 0.01, 1), np.ones((40, 16)), np.zeros((3, 16)), np.full((1, 16), np.nan)])
    exact = duplicates.near_duplicates(frame(spark, m), 0.99)
    found = approximate_duplicates(frame(spark, m), 0.99, recall=0.999999)
    assert indexed(found.pairs().collect()) == indexed(exact.pairs().collect())
    assert found.report().first() == exact.report().first()
    none = approximate_duplicates(frame(spark, m).limit(0), 0.99)
    assert none.pairs().count() == 0
    with pytest.raises(ValueError):
        approximate_duplicates(frame(spark, m), 0.0)


@pytest.mark.parametrize("cross", [False, True])
def test_hot_buckets_are_split_without_loss(spark, cross):
    """One sign a key: half of all vectors share one, and each two parts meet once."""
    m = near_copies(15, 8, 6, 0.2, 3)
    df = frame(spark, m)
    kw = {"rows": 1, "bands": 24, "seed": 5}
    if cross:
        kw |= {"ord": F.pmod(F.xxhash64("file_path"), F.lit(2)).cast("int"), "cross": True}
    found = approximate_duplicates(df, 0.9, **kw)
    found.bucket_rows = 16
    exact = duplicates.near_duplicates(df, 0.9, **{k: v for k, v in kw.items() if k in ("ord", "cross")})
    rows = found.pairs().collect()
    assert len(rows) == len(indexed(rows)) > 0
    assert indexed(rows) == indexed(exact.pairs().collect())


def test_bands_reach_the_recall():
    for threshold in (0.5, 0.8, 0.9, 0.99, 1.0):
        for vectors in (10, 10_000, 10**9):
            rows, bands = choose_bands(threshold, vectors)
            assert meeting_probability(threshold, rows, bands) >= 0.95 - 1e-9
            assert rows == 1 or bands <= 64
    assert choose_bands(0.99, 10**6)[0] > choose_bands(0.8, 10**6)[0]
    assert sign_projections.meeting_probability(1.0, 20, 1) == 1


def test_vectors_are_not_shuffled_to_their_buckets(spark, monkeypatch):
    plans = {}

    def materialize(df, name, *a, real=sign_projections.materialize, **kw):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return real(df, name, *a, **kw)

    monkeypatch.setattr(sign_projections, "materialize", materialize)
    m = near_copies(30, 8, 4, 0.2, 3)
    found = approximate_duplicates(frame(spark, m), 0.9, rows=2, bands=12)
    found.bucket_rows = 16
    assert indexed(found.pairs().collect()) <= brute_self(m, 0.9)
    lines = [x for plan in plans.values() for x in plan.splitlines() if "Relation" not in x]
    assert not any("unit#" in x for x in lines)
