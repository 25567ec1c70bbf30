import numpy as np
from pyspark.sql import functions as F

from pvspark.llm import quality
from pvspark.llm.common import buffers

import pyarrow as pa


def test_features_of_small_texts():
    data, at = buffers(pa.array(["Ab ab!\nAb ab!", None, "é1| x x x"]))
    x = quality.features(data, at)
    get = lambda row, name: x[row][quality.FEATURES.index(name)]
    assert not x[1].any()
    assert get(0, "upper") == 2 / 13 and get(0, "shouts") == 2 / 13
    assert get(0, "distinct_words") == 2 / 4
    assert get(0, "repeated_lines") == 0.5
    assert get(2, "bars") == 1 / 9 and get(2, "non_ascii") == 1 / 9
    assert get(2, "repeats_last") == 2 / 4


def test_interaction_is_learned():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    p = quality.Params(rounds=20, pair_rounds=80, pairs=2)
    model = quality.fit(x[:2000], y[:2000], p)
    assert (0, 1) in model.pairs
    right = (quality.score(x[2000:], model) > 0.5) == y[2000:]
    assert right.mean() > 0.95


def test_held_out_documents(spark, docs, no_docs):
    shout = F.upper(F.concat_ws("!! ", F.split("text", " ")))
    bad = docs.filter("doc_id between 0 and 119").select((F.col("doc_id") + 500).alias("doc_id"), shout.alias("text"))
    both = docs.select("doc_id", "text").union(bad)
    labels = both.select("doc_id", (F.col("doc_id") < 500).cast("int").alias("quality")).union(
        spark.createDataFrame([(None, 1), (3, None)], "doc_id long, quality int")
    )
    model = quality.train(both, labels, F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0)
    rows = quality.predict(both, model).collect()
    assert len(rows) == both.count() and all(0 <= r.score <= 1 for r in rows)
    assert all((r.score > 0.3) == (r.doc_id < 500) for r in rows if r.doc_id is not None and (r.doc_id < 240 or r.doc_id > 499))
    assert quality.predict(no_docs, model).count() == 0
    assert {r.score for r in quality.predict(docs, quality.train(docs, labels.limit(0), F.lit(True))).collect()} == {0.5}
