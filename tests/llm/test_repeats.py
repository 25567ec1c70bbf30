import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pvspark.llm import repeats


def brute(rows, length):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[k : k + length] for _, t in data for k in range(len(t) - length + 1))
    out = []
    for i, t in data:
        gone = [False] * len(t)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        runs = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(t), runs, bytes(b for b, g in zip(t, gone) if not g)))
    return Counter(out)


def corpus():
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("ab é") for _ in range(n))
    parts = [word(90) for _ in range(5)]
    cut = lambda: rng.choice(parts)[rng.randrange(20) : rng.randrange(40, 90)]
    rows = [(i, cut() + word(rng.randrange(30)) + cut()) for i in range(120)]
    return rows + [(1000, None), (1001, ""), (None, parts[0]), (5, "aaaa" * 40), (5, "aaaa" * 40)]


@pytest.mark.parametrize(
    "params",
    [
        repeats.Params(length=24, block=8),
        repeats.Params(length=24, block=8, anchor_limit=2),
        repeats.Params(length=40, block=4, batch=2000, broadcast_rows=0),
    ],
)
def test_equals_brute_force(spark, params):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {c: F.lit("x") for c in ("hash", "spans", "first", "anchor", "ctx")}
    )
    found = Counter(
        (r.doc_id, r.n_bytes, len(r.removed), bytes(r.kept))
        for r in repeats.remove_repeats(df, params).collect()
    )
    assert found == brute(rows, params.length)


def test_long_text_in_sections(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SECTION", 100)
    rows = [(1, "".join(random.Random(9).choice("abc") for _ in range(900))), (2, None)]
    rows.append((3, rows[0][1][350:500] + "zz"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = Counter(
        (r.doc_id, r.n_bytes, len(r.removed), bytes(r.kept))
        for r in repeats.remove_repeats(df, repeats.Params(length=40, block=8)).collect()
    )
    assert found == brute(rows, 40)


def test_no_rows(no_docs):
    assert repeats.remove_repeats(no_docs).count() == 0


def test_texts_without_repeats_are_not_shuffled(spark):
    rng = random.Random(6)
    rows = [(i, "".join(rng.choice("abcd") for _ in range(60))) for i in range(2000)]
    rows += [(5000 + i, rows[i][1][:50] + "xy") for i in range(20)] + [(None, rows[7][1]), (7, rows[7][1])]
    texts = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, hash long")
    wanted = texts.filter("doc_id < 10 or doc_id is null").selectExpr("doc_id as w_id", "hash as w_hash")
    marked = repeats._marked(texts, wanted, "w_id", "w_hash", repeats.Params()).collect()
    assert len(marked) == len(rows)
    assert all(r.among for r in marked if r.doc_id is None or r.doc_id < 10)
    assert sum(r.among for r in marked) < 100
    tight = repeats.Params(length=40, block=8, broadcast_rows=0, filter_bits=64)
    for p in (repeats.Params(length=40, block=8, broadcast_rows=0), tight):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        out = repeats.remove_repeats(df, p)
        assert Counter((r.doc_id, r.n_bytes, len(r.removed), bytes(r.kept)) for r in out.collect()) == brute(rows, 40)
        assert "among" in out._jdf.queryExecution().analyzed().toString()
