import itertools
import math
import random
from collections import Counter

from pyspark.sql import functions as F

from conftest_words import lower_words
from pvspark.llm import decontaminate as D


def make(rng, n):
    return [rng.choice("abcdefgh") + str(rng.randrange(500)) for _ in range(n)]


def brute(rows, items, p=D.Params()):
    """All alignments, without seeds."""
    out = set()
    for i, text in rows:
        d = lower_words(text)
        for j, item in items:
            w = lower_words(item)
            size = min(p.window, len(w))
            if len(w) < p.sure:
                continue
            for shift in range(-len(w), len(d)):
                m = [0 <= shift + k < len(d) and d[shift + k] == w[k] for k in range(len(w))]
                if max(sum(m[s : s + size]) for s in range(len(w) - size + 1)) >= -(-size * 4 // 5):
                    out.add((i, j))
    return out


def corpus():
    rng = random.Random(8)
    items = [(j, " ".join(make(rng, n))) for j, n in enumerate([40, 30, 15, 12, 60])]
    items += [(90, None), (91, ""), (92, "too short"), (0, items[0][1])]
    rows = []
    for i in range(60):
        words = make(rng, rng.randrange(5, 60))
        if i % 3 == 0:
            item = items[i // 3 % 5][1].split()
            part = item[rng.randrange(3) :]
            if i % 2:
                part[len(part) // 2] = "swapped"
            at = rng.randrange(len(words))
            words[at:at] = [w.upper() if i % 4 else w for w in part]
        rows.append((i, " ".join(words)))
    return rows + [(100, None), (101, ""), (102, "  "), (None, items[1][1]), (0, rows[0][1])], items


def test_equals_all_alignments(spark):
    rows, items = corpus()
    clash = {c: F.lit("x") for c in ("hash", "place", "seed", "shift", "w", "item_id")}
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns(clash)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    expected = brute(rows, items)
    assert len(expected) > 15
    for p in (D.Params(), D.Params(broadcast_rows=0)):
        found = [(r.doc_id, r.item_id) for r in D.leaks(docs, benchmark, p).collect()]
        assert len(found) == len(set(found)) and set(found) == expected
    bad = {i for i, _ in expected}
    kept = D.keep_clean(docs, benchmark)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _ in rows if i not in bad)


def test_substitutions_anywhere(spark):
    rng = random.Random(3)
    item = make(rng, 40)
    rows = []
    for i in range(40):
        copy = list(item)
        for k in range(i % 7, 40, 7):
            copy[k] = "other"
        rows.append((i, " ".join(make(rng, i) + copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = D.leaks(docs, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"))
    assert found.count() == 40


def test_no_rows(spark, docs, no_docs):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert D.leaks(docs, empty).count() == 0 and D.keep_clean(docs, empty).count() == docs.count()
    some = spark.createDataFrame([(1, "a b c d e f g h i j k l m n")], "item_id long, text string")
    assert D.leaks(no_docs, some).count() == 0


def test_main_path_is_native(spark, docs):
    some = spark.createDataFrame([(1, "a b c d e f g h i j k l m n")], "item_id long, text string")
    plan = D.leaks(docs, some)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_masks_leave_no_pattern_out():
    for size in range(1, 16):
        wrong = size - -(-size * 4 // 5)
        used = [[o + k for o in offsets for k in range(b)] for b, offsets in D.masks(size, wrong)]
        for n in range(wrong + 1):
            for gone in itertools.combinations(range(size), n):
                assert any(
                    not set(gone) & {i + k for k in mask} for mask in used for i in range(size - mask[-1])
                ), (size, gone)


def test_few_words_and_any_substitutions(spark):
    rng = random.Random(5)
    items = [(n, make(rng, n)) for n in (15, 14, 11, 10, 9, 8, 5, 4, 3)]
    rows = []
    for n, item in items:
        for gone in itertools.combinations(range(n), n - -(-n * 4 // 5)):
            copy = ["other" if k in gone else w for k, w in enumerate(item)]
            rows.append((len(rows), n, " ".join(make(rng, len(rows) % 4) + copy + make(rng, len(rows) % 3))))
    docs = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string")
    benchmark = spark.createDataFrame([(n, " ".join(w)) for n, w in items], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in D.leaks(docs, benchmark).collect()}
    assert found >= {(i, n) for i, n, _ in rows}


def test_short_items_act_only_if_rare(spark):
    """All lengths, both ways: what is found is what all alignments give for the items that are long or rare."""
    rng = random.Random(11)
    common = ["yes", "of", "the", "and", "is", "to"]
    short = ["yes", "of the", "the end", "quetzal", "quetzal over zugspitze", "is it the end of yes", "and of the is to yes and"]
    short += [" ".join(make(rng, n)) for n in range(2, 15)]
    items = [(j, text) for j, text in enumerate(short)] + [(50, None), (51, " "), (52, "OF THE")]
    rows = []
    for i in range(400):
        w = [rng.choice(common) if rng.random() < 0.7 else make(rng, 1)[0] for _ in range(rng.randrange(3, 60))]
        if i % 3 == 0:
            at = rng.randrange(len(w))
            w[at:at] = short[i // 3 % len(short)].split()
        rows.append((i, " ".join(w)))
    rows += [(500, None), (501, "")]
    counts = Counter(w for _, text in rows for w in lower_words(text))
    total = sum(counts.values())
    acting, left = [], set()
    for j, text in items:
        w = lower_words(text)
        need = -(-len(w) * 4 // 5)
        shares = sorted(((counts[x] + 1) / (total + 1) for x in w), reverse=True)
        if w and len(w) < 10 and math.comb(len(w), need) * math.prod(shares[:need]) * (total + 1) > 0.01:
            left.add(j)
        else:
            acting.append((j, text))
    expected = {(i, j) for i, j in brute_all(rows, acting)}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert {r.item_id for r in D.unsearchable(docs, benchmark).collect()} == left
    assert {0, 1, 2, 3, 6, 52} <= left and 4 not in left
    assert {(r.doc_id, r.item_id) for r in D.leaks(docs, benchmark).collect()} == expected
    assert len({j for _, j in expected}) > 8


def brute_all(rows, items):
    return brute(rows, [x for x in items if lower_words(x[1])], D.Params(sure=1))


def test_one_common_word_removes_nothing(spark):
    docs = spark.createDataFrame([(i, f"yes this is text {i}") for i in range(50)], "doc_id long, text string")
    assert D.keep_clean(docs, spark.createDataFrame([(1, "yes")], "item_id long, text string")).count() == 50


def test_more_copies_of_the_documents_change_nothing(spark):
    """A short item acts or not by the rate of its words, not by how many documents there are."""
    rng = random.Random(4)
    rows = [(i, " ".join(make(rng, 40) + (["of", "quetzal", "kea"] if i == 0 else ["of"]))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = [(1, "quetzal kea"), (2, "of"), (3, rows[7][1].split()[0]), (4, "unheard")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    many = docs.crossJoin(spark.range(200).select(F.col("id").alias("copy")))
    many = many.select((F.col("doc_id") + F.col("copy") * 1000).alias("doc_id"), "text")
    of = lambda df: {(r.doc_id, r.item_id) for r in D.leaks(df, benchmark).select("doc_id", "item_id").collect()}
    left = lambda df: {r.item_id for r in D.unsearchable(df, benchmark).collect()}
    one = of(docs)
    assert one == {(0, 1)} and left(docs) == {2, 3}
    assert left(many) == left(docs)
    assert of(many) == {(i + c * 1000, j) for i, j in one for c in range(200)}


def test_seeds_are_made_in_generated_code(spark):
    """A lambda for each word, block and mask took most of the time; now only words are hashed in one."""
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, " \t"), (3, None), (4, "a b c d e")], "doc_id long, text string")
    used = [(2, (0, 2)), (2, (0, 4)), (1, (0,))]
    seeds = D._seeds(docs, used, 1, ["doc_id"])
    plan = seeds._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lambdafunction") == 1 and "struct" not in plan
    places = Counter((r.doc_id, r.place) for r in seeds.collect())
    # of seven words: four places of the first mask, two of the second, seven of the third
    assert places == Counter(
        [(i, k) for i, n in ((1, 7), (4, 5)) for span in (4, 6, 1) for k in range(n - span + 1)]
    )
    assert seeds.filter("doc_id = 4 and place < 2").exceptAll(seeds.filter("doc_id = 1").withColumn("doc_id", F.lit(4))).count() == 0
    assert {r.place for r in D._seeds(docs, used, 3, ["doc_id"]).filter("doc_id = 1").collect()} == {0, 3, 6}
