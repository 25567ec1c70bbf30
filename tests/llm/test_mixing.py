from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pvspark.llm import mixing
from conftest_words import lower_words


def raked(cells, exponents, sweeps):
    """Classical raking on a dense table."""
    names = [sorted({c[d] for c in cells}) for d in range(3)]
    w = np.zeros([len(x) for x in names])
    for c, n in cells.items():
        w[tuple(names[d].index(c[d]) for d in range(3))] = n
    w /= w.sum()
    targets = []
    for d in range(3):
        share = w.sum(axis=tuple(k for k in range(3) if k != d)) ** exponents[d]
        targets.append(share / share.sum())
    first = w.copy()
    for _ in range(sweeps):
        for d in range(3):
            now = w.sum(axis=tuple(k for k in range(3) if k != d))
            w *= (targets[d] / now).reshape([-1 if k == d else 1 for k in range(3)])
    at = lambda c: tuple(names[d].index(c[d]) for d in range(3))
    return {c: w[at(c)] / first[at(c)] for c, n in cells.items() if n}


@pytest.mark.parametrize("local_cells,sweeps", [(20_000, 60), (0, 3)])
def test_equals_dense_raking(docs, local_cells, sweeps):
    p = mixing.Params(
        targets={"source": 0.3, "lang": 0.0, "topic": 1.0},
        keep=0.4,
        error=1e-12,
        sweeps=sweeps,
        local_cells=local_cells,
    )
    topic = F.when(F.length("text") > 150, "long").otherwise("short")
    rows = mixing.probabilities(docs, topic, p).collect()
    assert len(rows) == docs.count()
    cells = defaultdict(int)
    key = lambda r: (str(r.source), str(r.lang), "long" if r.text and len(r.text) > 150 else "short")
    for r in rows:
        cells[key(r)] += len(lower_words(r.text))
    expected = raked({k: n for k, n in cells.items() if n}, (0.3, 0.0, 1.0), sweeps)
    for r in rows:
        assert r["__weight"] == pytest.approx(expected.get(key(r), 1.0), rel=1e-6)
    total = sum(cells.values())
    asked = sum(r["__probability"] * len(lower_words(r.text)) for r in rows)
    assert asked == pytest.approx(0.4 * total, rel=1e-9)
    assert all(0 <= r["__probability"] <= 1 for r in rows)


def test_given_weights(docs):
    p = mixing.Params(targets={"lang": {"en": 6, "fr": 3, "de": 1}}, keep=0.3)
    rows = mixing.probabilities(docs.filter("lang is not null"), F.lit("all"), p).collect()
    got = defaultdict(float)
    for r in rows:
        got[r.lang] += r["__weight"] * len(lower_words(r.text))
    all_tokens = sum(got.values())
    assert {k: round(v / all_tokens, 3) for k, v in got.items()} == {"en": 0.6, "fr": 0.3, "de": 0.1}


def test_sample(docs, no_docs):
    p = mixing.Params(keep=0.5)
    kept = mixing.sample(docs, p=p)
    assert kept.columns == [*docs.columns, "__probability"]
    again = mixing.sample(docs.repartition(5), p=p)
    ids = lambda df: sorted(str(r.doc_id) for r in df.collect())
    assert ids(kept) == ids(again) and 0 < len(ids(kept)) < docs.count()
    assert mixing.sample(no_docs).count() == 0
    everything = mixing.sample(docs, p=mixing.Params(keep=1.0))
    assert everything.filter("length(trim(text)) > 3").count() == docs.filter("length(trim(text)) > 3").count()


def jobs_of(spark, group, run):
    spark.sparkContext.setJobGroup(group, group)
    try:
        run()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_few_plans(spark, docs):
    """Each plan costs the driver memory: few cells ask for few of them, and for no target is a plan repeated in the next."""
    for local_cells, most in ((20_000, 25), (0, 78)):
        p = mixing.Params(targets={"source": 0.3, "lang": {"en": 5}, "topic": 1.0}, sweeps=1, local_cells=local_cells)
        name = f"mixing-{local_cells}"
        assert jobs_of(spark, name, lambda: mixing.probabilities(docs, p=p).write.format("noop").mode("overwrite").save()) <= most


def test_one_place_equals_joins(docs):
    both = []
    for local_cells in (20_000, 0):
        p = mixing.Params(targets={"source": 0.3, "lang": {"en": 5, "xx": 2}}, keep=0.3, sweeps=2, local_cells=local_cells)
        rows = mixing.probabilities(docs, p=p).select("source", "lang", "__topic", "__weight", "__probability").distinct()
        both.append(sorted(map(tuple, rows.collect()), key=str))
    assert len(both[0]) == len(both[1])
    for x, y in zip(*both):
        assert x[:3] == y[:3] and x[3:] == pytest.approx(y[3:], rel=1e-9)


def test_calibrate(spark):
    rows = [(3, 0.5), (10, 2.0), (0, 1.0), (7, 0.25), (5, 1.0)]
    cells = spark.createDataFrame(rows, "tokens long, weight double")
    for keep in (0.0, 0.1, 0.5, 0.9, 1.0):
        here, joined = (mixing.calibrate(cells, keep, n) for n in (10, 0))
        assert here == pytest.approx(joined, rel=1e-10, abs=1e-10)
        assert sum(n * min(1, w * here) for n, w in rows) == pytest.approx(keep * 25, rel=1e-9, abs=1e-9)
    assert mixing.calibrate(cells.filter("tokens = 0"), 0.5) == mixing.calibrate(cells.limit(0), 1.0) == 1.0


def test_rows_without_python(spark, docs):
    """The fitted rows come back as a local relation, whatever the session says of Arrow: no task starts a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "false")
    try:
        cells = mixing.rake(docs, F.lit("all"))
        assert "LocalRelation" in cells._jdf.queryExecution().optimizedPlan().toString()
        assert "ExternalRDD" not in cells._jdf.queryExecution().logical().toString()
        assert cells.filter("weight is null").count() == 0 < cells.count()
    finally:
        spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
