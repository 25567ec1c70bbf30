import random

from itertools import combinations

import pytest
from pyspark.sql import functions as F

from pvspark.llm import jaccard
from pvspark.llm.components import components

from conftest_words import lower_words


def brute(rows, p):
    sets = []
    for _, text in rows:
        w = lower_words(text)
        n = p.words
        sets.append(
            {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
        )
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and p.den * both >= p.num * (len(sets[a]) + len(sets[b]) - both):
            root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(
        ((i, len(sets[k]), least.get(find(k))) for k, (i, _) in enumerate(rows)), key=str
    )


def corpus():
    rng = random.Random(6)
    vocab = [f"w{k}" for k in range(60)]
    rows, number = [], 0
    for size in (3, 12, 40, 80):
        for _ in range(5):
            base = [rng.choice(vocab) for _ in range(size)]
            for _ in range(rng.choice([1, 2, 12])):
                copy = list(base)
                for _ in range(rng.randrange(3)):
                    copy[rng.randrange(size)] = rng.choice(vocab)
                rows.append((number, " ".join(copy)))
                number += 1
    shared = " ".join(vocab[:20])
    rows += [(number + k, f"{shared} {' '.join(rng.choice(vocab) for _ in range(k))}") for k in range(12)]
    return rows + [(900, None), (901, ""), (902, "  "), (None, rows[0][1]), (903, "One"), (904, "one"), (5, rows[5][1])]


@pytest.mark.parametrize(
    "params",
    [
        jaccard.Params(words=3, num=90, den=100),
        jaccard.Params(words=2, num=4, den=5, pivot_rounds=0),
        jaccard.Params(words=2, num=1, den=2, universe=3.0, broadcast_rows=0),
    ],
)
def test_equals_brute_force(spark, params):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {c: F.lit("x") for c in ("hash", "row", "n", "prefix", "profile", "comp", "h")}
    )
    found = [tuple(r) for r in jaccard.join(df, params).collect()]
    assert sorted(found, key=str) == brute(rows, params)


@pytest.mark.parametrize("known", [1, 2])
def test_pairs_beyond_the_known_shingles(spark, monkeypatch, known):
    """What a document brings of its prefix decides how often a pair comes, not whether it comes."""
    monkeypatch.setattr(jaccard, "KNOWN", known)
    params = jaccard.Params(words=2, num=1, den=2, pivot_rounds=0)
    found = jaccard.join(spark.createDataFrame(corpus(), "doc_id long, text string"), params).collect()
    assert sorted(map(tuple, found), key=str) == brute(corpus(), params)


def test_one_of_each_group_stays(spark, docs, no_docs):
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids))
    # copies of 7 are gone; texts without words are all kept
    assert 7 in ids and 244 not in ids and {240, 241, 242} <= set(ids) and None in ids
    assert jaccard.keep_one(no_docs).count() == 0
    assert jaccard.join(no_docs).count() == 0


def test_components_of_paths_and_loops(spark):
    links = [(k, k + 1) for k in range(20)] + [(30, 31), (31, 30), (40, 40)]
    found = components(spark.createDataFrame(links, "a long, b long")).collect()
    label = {r.node: r.label for r in found}
    assert len({label[k] for k in range(21)}) == 1 and label[30] == label[31] and 40 not in label


def test_sets_of_a_pair_are_not_sent_to_python(spark, docs, monkeypatch):
    """Both whole sets of 10,000 pairs were one Arrow batch."""
    plans = []

    def store(df, name, real=jaccard.store):
        if name == "links":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return real(df, name)

    monkeypatch.setattr(jaccard, "store", store)
    assert jaccard.join(docs, jaccard.Params(words=2, num=1, den=2)).count() == docs.count()
    assert plans and not any("MapInArrow" in p for p in plans)


def test_what_was_compared_with_a_pivot_does_not_come_again(spark, monkeypatch):
    """A shingle of two documents that do not link stayed in all turns."""
    rng = random.Random(3)
    words = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    rows = []
    for k in range(40):
        both = words(11)
        rows += [(2 * k + s, " ".join(both + words(2))) for s in (0, 1)]
    rows += [(100, "x " + rows[0][1]), (101, "y " + rows[0][1])]  # links, so that there is a second turn
    left = []

    def store(df, name, real=jaccard.store):
        out = real(df, name)
        if name in ("grouped", "left"):
            left.append(out[0].count())
        return out

    monkeypatch.setattr(jaccard, "store", store)
    params = jaccard.Params(words=3, num=4, den=5, universe=10.0)
    found = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), params).collect()
    assert sorted(map(tuple, found), key=str) == brute(rows, params)
    assert left[0] >= 80 and left[1] <= 10


@pytest.mark.parametrize("rounds", [1, 2, 5])
def test_all_links_are_found_after_any_number_of_turns(spark, rounds):
    params = jaccard.Params(words=2, num=1, den=2, pivot_rounds=rounds)
    found = jaccard.join(spark.createDataFrame(corpus(), "doc_id long, text string"), params).collect()
    assert sorted(map(tuple, found), key=str) == brute(corpus(), params)
