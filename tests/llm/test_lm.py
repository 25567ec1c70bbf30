import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest_words import lower_words
from pvspark.llm import lm

END = object()


def base(rows, learned):
    count = Counter(t for i, text in rows if learned(i) for t in [*lower_words(text), END])
    n, v = sum(count.values()), len(count)
    out = []
    for i, text in rows:
        tokens = [*lower_words(text), END]
        score = sum(math.log10((count[t] + 1) / (n + v + 1)) for t in tokens)
        out.append((i, len(tokens), sum(count[t] > 0 for t in tokens), n, score))
    return out


@pytest.mark.parametrize("frequent", [1 << 18, 8])
def test_base_score(docs, frequent):
    p = lm.Params(frequent=frequent, min_bits=1 << 16)
    learn = F.coalesce(F.col("doc_id") % 3 != 0, F.lit(True))
    model, rare = lm.train(docs, learn, p)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    expected = base(rows, lambda i: i is None or i % 3 != 0)
    found = [
        (r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score)
        for r in lm.score(docs, model, rare, p).collect()
    ]
    key = lambda r: (str(r[0]), r[1], round(r[4], 6))
    for a, b in zip(sorted(found, key=key), sorted(expected, key=key), strict=True):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], rel=1e-9)


def test_filter_holds_every_gram(docs):
    p = lm.Params(min_bits=1 << 18)
    counts = lm.count_grams(docs, p).cache()
    bits, least = lm._choose_size(counts, p)
    flat = lm.build_filter(counts, bits, least, p)
    rows = counts.filter("kind = 1 or n > 1").collect()
    h = np.array([r.h for r in rows]).view(np.uint64)
    true = np.array([r.n.bit_length() for r in rows])
    got = lm.levels(h, flat, p.probes)
    assert (got >= true).all() and (got == true).mean() > 0.97
    unknown = np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64)
    assert (lm.levels(unknown, flat, p.probes) == 0).mean() > 0.97
    small = lm.Params(min_bits=1 << 12, max_bits=1 << 13)
    assert lm._choose_size(counts, small)[0] <= 1 << 13


def test_probabilities_and_fit(docs):
    p = lm.Params(min_bits=1 << 18)
    model, rare = lm.train(docs, F.lit(True), p)
    rows = lm.score(docs, model, rare, p).collect()
    assert all(r.score < 0 and math.isfinite(r.score) for r in rows)
    # bigrams know more than single words
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_without_training(docs, no_docs):
    model, rare = lm.train(no_docs, F.lit(True), lm.Params())
    rows = lm.score(docs, model, rare).collect()
    assert len(rows) == docs.count()
    assert {(r.n_known, r.train_tokens, r.base_score, r.score) for r in rows} == {(0, 0, 0.0, 0.0)}
    model, rare = lm.train(docs, F.lit(True), lm.Params())
    assert lm.score(no_docs, model, rare).count() == 0


def test_scores_do_not_depend_on_how_the_filter_is_cut(docs):
    """All bigrams count, those seen once too, however far the counts pass ``max_bits``."""
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    count, pairs = Counter(), Counter()
    for _, text in rows:
        tokens = [*lower_words(text), END]
        count.update(tokens)
        pairs.update(zip([None, *tokens], tokens))
    n, v = sum(count.values()), len(count)
    typical = lambda c: lm.TYPICAL[c.bit_length()]

    def expected(text, p):
        out, before = 0.0, None
        for t in [*lower_words(text), END]:
            seen = typical(count[END] if before is None else count[before])
            pair = min(typical(pairs[before, t]), seen)
            out += math.log10((pair + p.prior * min((typical(count[t]) + 1) / (n + v + 1), 1)) / (seen + p.prior))
            before = t
        return out

    # many bits an entry, so that false levels are next to none
    for most in (1 << 30, 1 << 18):
        p = lm.Params(min_bits=1 << 12, max_bits=most, bits_per_entry=64, probes=6, gather=2000)
        model, rare = lm.train(docs, F.lit(True), p)
        assert (model.parts > 1) == (most < 1 << 30)
        found = sorted((r.doc_id or -1, r.n_tokens, r.score) for r in lm.score(docs, model, rare, p).collect())
        wanted = sorted((i or -1, len(lower_words(t)) + 1, expected(t, p)) for i, t in rows)
        assert len(found) == len(wanted)
        for a, b in zip(found, wanted):
            assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=1e-3 * a[1])


def test_grams_are_moved_once(docs, monkeypatch):
    """Counts fill the filter where they lie, and what is looked up is not written as a table."""
    stored = {}

    def store(df, name, real=lm.store):
        stored[name] = df.columns, df._jdf.queryExecution().executedPlan().toString()
        return real(df, name)

    monkeypatch.setattr(lm, "store", store)
    model, rare = lm.train(docs, F.lit(True))
    assert lm.score(docs, model, rare).count() == docs.count()
    assert "Exchange" not in stored["gram-filter"][1]
    assert not [name for name, (columns, _) in stored.items() if "grams" in columns]


def test_scores_do_not_depend_on_the_number_of_buckets(docs):
    found = []
    for size in (1 << 24, 300):
        p = lm.Params(min_bits=1 << 12, bits_per_entry=64, probes=6, gather=2000, bucket_bytes=size)
        model, rare = lm.train(docs, F.lit(True), p)
        assert (model.parts > 1) == (size == 300)
        found.append(sorted((r.doc_id or -1, r.n_tokens, r.n_known, r.base_score, r.score) for r in lm.score(docs, model, rare, p).collect()))
    for a, b in zip(*found, strict=True):
        assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:], abs=1e-3 * a[1])


@pytest.mark.parametrize("step", ["train", "score"])
def test_batches_are_bounded_by_bytes(spark, docs, step):
    """All text blocks or filter segments of a task were one batch."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        model = lm.train(docs, F.lit(True))
        if step == "score":
            spark.conf.set(key, before)
            lm.score(docs, *model).count()
        assert int(spark.conf.get(key)) == 4 << 20
    finally:
        spark.conf.set(key, before)
