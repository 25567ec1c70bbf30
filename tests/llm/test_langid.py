import dataclasses
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import sentence
from pvspark.llm import langid

SMALL = langid.Params(buckets=1 << 12, per_language=200)


def test_held_out_accuracy_and_odd_rows(docs):
    learn = F.pmod(F.xxhash64("doc_id"), F.lit(3)) != 0
    model = langid.train(docs, learn, SMALL)
    assert model.languages == ("de", "en", "fr")
    rows = langid.predict(docs, model).collect()
    assert len(rows) == docs.count()
    by_id = {r.doc_id: r for r in rows}
    for odd in (240, 241, 242, 243):
        assert (by_id[odd].lang_pred, by_id[odd].score, by_id[odd].rejected) == ("und", 0.0, True)
    assert by_id[245].lang_pred == "de"
    held = {r.doc_id: r.lang for r in docs.filter(~learn & F.col("doc_id").between(0, 239)).collect()}
    assert len(held) > 40
    right = [by_id[i].lang_pred == lang for i, lang in held.items()]
    assert sum(right) >= 0.95 * len(right)
    assert all(0 <= r.score <= 1 for r in rows)


def test_prediction_sees_the_text_only(docs):
    model = langid.train(docs, F.lit(True), SMALL)
    other = docs.withColumns({"lang": F.lit("xx"), "doc_id": F.col("doc_id") + 1000, "source": F.lit(None)})
    key = lambda df, k: sorted((r.doc_id - k, r.lang_pred, r.score) for r in langid.predict(df, model).collect() if r.doc_id is not None)
    assert key(docs, 0) == key(other, 1000)


def test_clean_documents_stay(docs, no_docs):
    model = langid.train(docs, F.lit(True), SMALL)
    kept = langid.keep_known(docs, model)
    assert kept.columns == docs.columns
    gone = {r.doc_id for r in docs.collect()} - {r.doc_id for r in kept.collect()}
    assert gone == {240, 241, 242, 243}
    assert langid.keep_known(no_docs, model).count() == 0


def test_without_labels(docs, no_docs):
    for source in (no_docs, docs.withColumn("lang", F.lit(None).cast("string"))):
        model = langid.train(source, F.lit(True), SMALL)
        assert {r.lang_pred for r in langid.predict(docs, model).collect()} == {"und"}
    one = langid.train(docs.withColumn("lang", F.lit("zz")), F.lit(True), dataclasses.replace(SMALL, per_language=20))
    assert {r.lang_pred for r in langid.predict(docs, one).collect()} == {"zz", "und"}


@pytest.mark.parametrize("words", [15, 30, 60])
def test_held_out_texts_stay_and_unlearned_ones_go(spark, docs, words):
    rng = random.Random(4)
    finnish = "että joka mutta kun niin hän myös ovat tämä vain sitten kaikki hyvin jälkeen yhtä työ".split()
    italian = "il di che non per una sono con come più anche della questo quando molto essere fatto tutti".split()
    other = [" ".join(rng.choice([finnish, italian][i % 2]) for _ in range(words)) for i in range(40)]
    noise = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz  ") for _ in range(7 * words)) for _ in range(40)]
    known = [sentence(rng, ["en", "fr", "de"][i % 3], words) for i in range(200)]
    model = langid.train(docs, F.lit(True), SMALL)
    rows = [(i, t) for i, t in enumerate(other + noise + known)]
    found = langid.predict(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    gone = {r.doc_id for r in found if r.rejected}
    assert len(gone & set(range(80))) >= 72
    assert len(gone & set(range(80, 280))) <= 1


def test_scores_equal_plain_sums(spark, docs):
    """The look-up of whole batches against one text at a time, gram by gram."""
    model = langid.train(docs, F.lit(True), SMALL)
    n = len(model.languages)
    found = {(r.doc_id, r.lang_pred, r.rejected): r.score for r in langid.predict(docs, model).collect()}
    for r in docs.select("doc_id", "text").collect():
        if r.text is None or not any(c.isalpha() for c in r.text) or len(r.text) > 2000:
            continue
        data = np.frombuffer(r.text.encode(), np.uint8)
        grams = np.concatenate(langid.subwords(data, np.array([0, len(data)]), SMALL.buckets))
        grams = grams[grams < SMALL.buckets]
        mean = model.table[grams].astype(float).mean(axis=0)
        z = np.exp(mean[:n] + model.bias)
        best = int(z.argmax())
        rejected = mean[n + best] < model.thresholds[langid._length_class(np.array([len(grams)]))][0]
        assert abs(found[r.doc_id, model.languages[best], bool(rejected)] - z[best] / z.sum()) < 1e-4
