import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pvspark.operators import bag_similarity, duplicates, similarity
from pvspark.operators.bag_similarity import bag_duplicates
from pvspark.sources import blocks


def frame(spark, matrix, names=None):
    names = names or [f"f{i:04d}" for i in range(len(matrix))]
    rows = [(n, [float(x) for x in v]) for n, v in zip(names, matrix)]
    return spark.createDataFrame(rows, "file_path string, embedding array<double>")


def cosines(a, b):
    norm = lambda m: m / np.where(np.linalg.norm(m, axis=1) == 0, 1, np.linalg.norm(m, axis=1))[:, None]
    return norm(a) @ norm(b).T


def brute_self(matrix, t):
    s = cosines(matrix, matrix)
    n = len(matrix)
    return {(i, j) for i in range(n) for j in range(i + 1, n) if s[i, j] >= t}


def indexed(rows):
    return {(int(r.file_a[1:]), int(r.file_b[1:])) for r in rows}


@pytest.fixture(scope="module")
def clustered():
    """Near copies around centres, a hot group of exact copies, and a zero vector."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 24))
    rows = centres[rng.integers(0, 40, 300)] + rng.normal(size=(300, 24)) * 0.05
    hot = np.repeat(centres[:1], 100, axis=0)
    m = np.vstack([rows, hot, np.zeros((1, 24)), centres[:1] * 2.0])
    return m[rng.permutation(len(m))]


def test_pairs_equal_brute_force(spark, clustered):
    found = duplicates.near_duplicates(frame(spark, clustered), 0.99, block_rows=64)
    rows = found.pairs().collect()
    assert indexed(rows) == brute_self(clustered, 0.99)
    assert len(rows) == len(indexed(rows))
    s = cosines(clustered, clustered)
    for r in rows:
        assert abs(r.similarity - s[int(r.file_a[1:]), int(r.file_b[1:])]) < 1e-12


def test_grid_gives_the_same_pairs(spark, clustered, monkeypatch):
    monkeypatch.setattr(similarity, "GRID_PAYS_FROM", 0)
    monkeypatch.setattr(similarity, "MIN_BLOCK", 8)
    used = []
    choose = similarity._choose_grid
    monkeypatch.setattr(similarity, "_choose_grid", lambda *a: used.append(choose(*a)) or used[-1])
    found = duplicates.near_duplicates(frame(spark, clustered), 0.99, block_rows=32)
    want = brute_self(clustered, 0.99)
    assert indexed(found.pairs().collect()) == want
    assert found.report().first().duplicate_pairs == len(want)
    assert used and used[0][0] > 0, "the grid was not used"


def test_grid_cross(spark, clustered, monkeypatch):
    monkeypatch.setattr(similarity, "GRID_PAYS_FROM", 0)
    monkeypatch.setattr(similarity, "MIN_BLOCK", 8)
    a, b = clustered[:150], clustered[150:]
    found = duplicates.two_sets(frame(spark, a), frame(spark, b), 0.99, block_rows=32)
    s = cosines(a, b)
    want = {(i, j) for i in range(len(a)) for j in range(len(b)) if s[i, j] >= 0.99}
    assert indexed(found.pairs().collect()) == want


def test_chunked_expansion_of_a_hot_group(spark, clustered, monkeypatch):
    monkeypatch.setattr(duplicates, "CHUNK", 7)
    found = duplicates.near_duplicates(frame(spark, clustered), 0.99)
    rows = found.pairs().collect()
    assert indexed(rows) == brute_self(clustered, 0.99)
    assert len(rows) == len(indexed(rows))


def test_report_counts_without_expansion(spark, clustered):
    found = duplicates.near_duplicates(frame(spark, clustered), 0.99)
    want = brute_self(clustered, 0.99)
    s = cosines(clustered, clustered)
    row = found.report().first()
    files = {f for p in want for f in p}
    assert row.total_files == len(clustered)
    assert row.duplicate_pairs == len(want)
    assert row.exact_duplicate_pairs == sum(s[p] >= 0.9999 for p in want)
    assert row.files_with_duplicates == len(files)
    assert row.percentage_files_with_duplicates == round(len(files) / len(clustered) * 100, 2)


def test_report_of_a_near_copy_cluster_lists_no_pairs(spark):
    """200 distinct vectors, all similar: 19,900 pairs, few summary rows."""
    rng = np.random.default_rng(8)
    m = rng.normal(size=16) + rng.normal(size=(200, 16)) * 0.01
    found = duplicates.near_duplicates(frame(spark, m), 0.99, block_rows=64)
    row = found.report().first()
    assert (row.duplicate_pairs, row.files_with_duplicates) == (19900, 200)
    assert found.summary.count() < 200 * 8
    assert "links" not in found.__dict__, "the report must not build the pair list"


def test_input_order_does_not_matter(spark, clustered):
    names = [f"f{i:04d}" for i in range(len(clustered))]
    order = np.random.default_rng(1).permutation(len(clustered))
    shuffled = frame(spark, clustered[order], [names[i] for i in order])
    assert indexed(duplicates.duplicate_pairs(shuffled, 0.99).collect()) == brute_self(clustered, 0.99)


@pytest.mark.parametrize("k", [1, 4, 25])
def test_top_equals_sorted_prefix(spark, clustered, k):
    found = duplicates.near_duplicates(frame(spark, clustered), 0.99)
    want = [tuple(r) for r in found.sorted_pairs().limit(k).collect()]
    assert [tuple(r) for r in found.top(k).collect()] == want
    cross = duplicates.two_sets(frame(spark, clustered[:200]), frame(spark, clustered[200:]), 0.99)
    want = [tuple(r) for r in cross.sorted_pairs().limit(k).collect()]
    assert [tuple(r) for r in cross.top(k).collect()] == want


def test_zero_vector_has_no_pair(spark):
    df = frame(spark, np.array([[0.0, 0.0], [1.0, 0.0], [0.0, 0.0]]))
    assert duplicates.duplicate_pairs(df, 0.99).count() == 0


def test_threshold_is_inclusive(spark):
    df = frame(spark, np.array([[1.0, 0.0], [1.0, 0.0]]))
    assert [tuple(r) for r in duplicates.duplicate_pairs(df, 1.0).collect()] == [("f0000", "f0001", 1.0)]


def test_ties_keep_input_order(spark):
    df = frame(spark, np.array([[1.0, 2.0]] * 3))
    rows = duplicates.duplicate_pairs(df, 0.99).collect()
    assert [(r.file_a, r.file_b) for r in rows] == [
        ("f0000", "f0001"), ("f0000", "f0002"), ("f0001", "f0002")
    ]


def test_empty_set(spark):
    df = spark.createDataFrame([], "file_path string, embedding array<double>")
    found = duplicates.near_duplicates(df)
    assert found.pairs().count() == 0
    assert tuple(found.report().first()) == (0, 0, 0, 0, 0.0, 0.99)


def test_shared_path_counts_once(spark):
    a = frame(spark, np.array([[1.0, 0.0]]), ["same"])
    b = frame(spark, np.array([[1.0, 0.001]]), ["same"])
    row = duplicates.two_sets(a, b, 0.99).report().first()
    assert (row.total_files, row.files_with_duplicates) == (2, 1)
    assert row.percentage_files_with_duplicates == 50.0


def test_repeated_rows_are_pairs(spark):
    df = frame(spark, np.array([[1.0, 0.0], [1.0, 0.0]]), ["same", "same"])
    assert duplicates.duplicate_pairs(df).count() == 1


def test_low_threshold_keeps_all_pairs(spark):
    m = np.random.default_rng(2).normal(size=(30, 4))
    found = duplicates.duplicate_pairs(frame(spark, m), -0.5, block_rows=8)
    assert indexed(found.collect()) == brute_self(m, -0.5)


def bag_rows():
    rng = np.random.default_rng(3)
    vocab = [f"w{i}" for i in range(60)]
    docs = []
    for i in range(60):
        words = list(rng.choice(vocab[:20] if i % 2 else vocab, 40))
        docs.append(words)
        if i % 3 == 0:
            docs.append(list(rng.permutation(words)))
        if i % 5 == 0:
            docs.append(words + [words[0]])
    docs += [["w1"] * 6, ["w2"] * 6, ["w1"] * 12, ["only", "here"], ["w1"] * 30 + ["alone"]]
    base = list(rng.choice(vocab, 200))  # a hot cluster of near copies
    docs += [base + list(rng.choice(vocab, 3)) for _ in range(50)]
    vocab += ["only", "here", "alone"]
    rows = [(f"f{i:04d}", [str(w) for w in d]) for i, d in enumerate(docs)]
    return rows, np.array([[d.count(w) for w in vocab] for d in docs], dtype=float)


@pytest.mark.parametrize(
    "threshold,block_bytes,joined", [(0.2, 1 << 24, False), (0.9, 12_000, False), (0.99, 12_000, True), (1.0, 1 << 24, True)]
)
def test_bags_equal_brute_force(spark, monkeypatch, threshold, block_bytes, joined):
    """One block, many blocks, hot words in parts; ranks looked up and joined; one pass and two."""
    if joined:
        monkeypatch.setattr(bag_similarity, "SHARED_WORDS", 0)
    monkeypatch.setattr(bag_similarity, "_PAIRS", 64)
    rows, counts = bag_rows()
    df = spark.createDataFrame(rows, "tag string, words array<string>")
    found = bag_duplicates(df, threshold, block_bytes=block_bytes)
    want = brute_self(counts, threshold)
    direct = found.report().first()
    pairs = indexed(found.pairs().collect())
    if threshold < 1:
        assert pairs == want
    else:  # rounding of the brute force decides there
        assert {p[:2] for p in pairs} <= {p[:2] for p in brute_self(counts, 1 - 1e-9)}
    assert direct.duplicate_pairs == len(pairs)
    del found.summary  # a second time, from the links
    assert found.report().first() == direct


def test_bags_without_words_are_similar_to_nothing(spark):
    rows = [("a", []), ("b", []), ("c", None), ("d", ["x"] * 6), ("e", ["x"] * 6), ("f", ["x"] * 7)]
    df = spark.createDataFrame(rows, "tag string, words array<string>")
    found = bag_duplicates(df, 0.99)
    assert {(r.file_a, r.file_b) for r in found.pairs().collect()} == {("d", "e"), ("d", "f"), ("e", "f")}
    assert found.report().first().total_files == 6
    assert bag_duplicates(df.limit(0), 0.99).report().first().duplicate_pairs == 0
    with pytest.raises(ValueError):
        bag_duplicates(df, 0.0)


def test_bag_candidates_are_not_listed(spark):
    """Vectors are sent where they may have a partner; what is stored grows with bags, not with pairs."""
    rows = [(f"f{i}", ["common"] * 8 + [f"own{i}", f"mine{i // 2}"]) for i in range(300)]
    found = bag_duplicates(spark.createDataFrame(rows, "tag string, words array<string>"), 0.9, block_bytes=1 << 24)
    assert found.report().first().duplicate_pairs == 300 * 299 // 2
    assert found._sent[0].count() <= 300 * 2


def test_similarity_plan_broadcasts_no_vectors(spark, clustered):
    units = similarity.with_unit_vectors(
        frame(spark, clustered).withColumn("side", F.lit(0)).drop("file_path")
    )
    distinct = similarity.distinct_vectors(units.withColumn("ord", F.lit(0)), False)
    stored = similarity.block_pairs(distinct, 0.99)
    links = similarity.similar_groups(stored, 0.99, spark)
    plan = links._jdf.queryExecution().optimizedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def test_blocks_are_shuffled_once_and_read_by_tasks(spark, clustered):
    """Neither links nor summary shuffle vectors again: their plan holds block names only."""
    found = duplicates.near_duplicates(frame(spark, clustered), 0.99, block_rows=64)
    stored = found._blocks
    assert stored.blocks.agg(F.sum("rows")).first()[0] == found.groups.count()
    plan = similarity.similar_groups(stored, 0.99, spark)._jdf.queryExecution().executedPlan().toString()
    assert "unit" not in plan and "file_a" in plan
    assert found.pairs().count() > 0
    calls = []
    stored.meet = lambda *a: calls.append(a)
    assert found.report().first().duplicate_pairs == found.pairs().count()
    assert not calls, "the report of listed links must not run the join again"


def test_report_of_two_sets_from_links(spark, clustered):
    a, b = frame(spark, clustered[:150]), frame(spark, clustered[100:])
    direct, listed = duplicates.two_sets(a, b, 0.99), duplicates.two_sets(a, b, 0.99)
    listed.links
    assert listed.report().first() == direct.report().first()
    assert direct.report().first().duplicate_pairs > 0


def test_bag_vectors_are_stored_once(spark, monkeypatch):
    """What goes to the blocks are places; a place gives back its value, whatever its size and order."""
    monkeypatch.setattr(blocks, "PIECE_GAP", 3)
    rows = [(i, bytes([i]) * (i * 7 % 5)) for i in range(40)] + [(40, None)]
    stored = blocks.write_pieces(spark.createDataFrame(rows, "i int, v binary").repartition(3), "v", "pieces")
    places = stored.orderBy((stored.i * 17) % 41).toArrow()
    assert places.column_names == ["i", "file", "at", "bytes"]
    assert blocks.read_pieces(places) == [rows[i][1] or b"" for i in places.column("i").to_pylist()]
    assert blocks.write_pieces(spark.createDataFrame([], "i int, v binary"), "v", "pieces").count() == 0
    docs = [(f"d{i}", [f"w{i % 9}", "x", "y", "z", f"v{i % 4}"]) for i in range(90)]
    found = bag_duplicates(spark.createDataFrame(docs, "tag string, words array<string>"), 0.75)
    assert all(kind != "binary" or c in ("gid", "norms") for c, kind in found._sent[0].dtypes)
    assert found.pairs().count() > 0


def test_a_block_pair_copies_no_block(monkeypatch):
    """Besides the blocks themselves a task holds tiles only."""
    monkeypatch.setattr(similarity, "_TILE", 256)
    unit = np.random.default_rng(0).standard_normal((8192, 64))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    block = pa.table({"gid": pa.array([b"%d" % i for i in range(8192)]), "unit": pa.array([u.tobytes() for u in unit])})
    kernel = similarity._pair_kernel(0.99, 64)
    for other in (None, block):
        tracemalloc.start()
        found = sum(batch.num_rows for batch in kernel(block, other))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert found == (8192 if other else 0) and peak < unit.nbytes


def test_cells_of_a_pair_are_read_once(monkeypatch):
    """Near copies share most of their prefixes, and pairs of one vocabulary pass the coarse bound: neither is verified in vain."""
    rng, threshold = np.random.default_rng(5), 0.95
    bases = [rng.choice(4000, 300, replace=False) for _ in range(8)]
    bags = [np.sort(np.delete(b, i)) for b in bases for i in range(5)]
    n = [rng.integers(1, 3, 1000)[: len(b)] for b in bags]
    n = [n[k - k % 5] for k in range(len(bags))]
    at = np.concatenate([[0], np.cumsum([len(b) for b in bags])])
    len2 = np.array([int((x * x).sum()) for x in n])
    batch = pa.RecordBatch.from_arrays(
        [pa.array([bytes([k]) for k in range(len(bags))], pa.binary()), pa.array([1] * len(bags)), pa.array(len2)],
        names=["gid", "copies", "len2"],
    )
    (packed,) = bag_similarity._packed(batch, at, np.concatenate(bags), np.concatenate(n), threshold)
    table = pa.Table.from_batches([packed])
    held = table.column("vector").to_pylist()
    table = table.append_column("bytes", pa.array([len(v) for v in held], pa.int64()))
    monkeypatch.setattr(bag_similarity, "read_pieces", lambda _: held)
    block, read = bag_similarity._Block(table, threshold), []
    dots = block._dots
    monkeypatch.setattr(block, "_dots", lambda x, y: read.append(len(x)) or dots(x, y))
    mine = np.ones(len(block.rank), bool)
    found = sorted((min(x, y), max(x, y)) for xs, ys, _ in block.pairs(mine, None) for x, y in zip(xs, ys))
    dense = np.zeros((len(bags), 4000))
    for k, (b, x) in enumerate(zip(bags, n)):
        dense[k, b] = x
    dense /= np.linalg.norm(dense, axis=1)[:, None]
    expected = [(i, j) for i in range(len(bags)) for j in range(i + 1, len(bags)) if dense[i] @ dense[j] >= threshold]
    assert found == expected and len(expected) >= 20
    assert sum(read) <= 2 * len(expected)
