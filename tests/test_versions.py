import numpy as np
import pytest
from pyspark.sql import functions as F

from pvspark.operators import versions as V
from pvspark.operators.duplicates import near_duplicates


def test_version_order(spark):
    names = "1.10.0 1.9.0 1.0-rc1 1.0 1.0.1 1.0-incubating".split()
    df = spark.createDataFrame([(n,) for n in names], "version string")
    got = [r.version for r in V.select_versions(df, ".*").orderBy("ord").collect()]
    assert got == ["1.0", "1.0-incubating", "1.0-rc1", "1.0.1", "1.9.0", "1.10.0"]
    first = V.select_versions(df, ".*", max_versions=2).orderBy("ord").collect()
    assert [r.version for r in first] == ["1.0", "1.0-incubating"]
    with pytest.raises(ValueError):
        V.select_versions(df, ".*", max_versions=-1)


def test_regex_is_anchored_at_the_start(spark):
    df = spark.createDataFrame([("1.0-beta",), ("v1.0",)], "version string")
    assert [r.version for r in V.select_versions(df, r"[0-9]+\.[0-9]+").collect()] == ["1.0-beta"]
    assert V.select_versions(df, r"[0-9]+\.[0-9]+$").count() == 0
    assert V.select_versions(df, r"x|1").count() == 1


def test_long_numbers_in_versions(spark):
    names = ["b-99999999999999999999", "b-123456789012345678901", "b-0099", "b-100"]
    df = spark.createDataFrame([(n,) for n in names], "version string")
    got = [r.version for r in V.select_versions(df, ".*").orderBy("ord").collect()]
    assert got == ["b-0099", "b-100", "b-99999999999999999999", "b-123456789012345678901"]


def test_version_without_documents(spark):
    tags = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "version string, ord int")
    docs = spark.createDataFrame([("a",), ("c",), ("c",)], "version string")
    counted = V.files_per_version(tags, docs)
    assert {r.version: r.files for r in counted.collect()} == {"a": 1, "b": 0, "c": 2}
    present = V.versions_with_documents(counted)
    assert {r.version: r.ord for r in present.collect()} == {"a": 0, "c": 1}
    only = V.boundaries(present).collect()
    assert [(r.version_a, r.version_b) for r in only] == [("a", "c")]


@pytest.fixture(scope="module")
def history():
    """Five versions: most files carried over unchanged, some edited, one hot copy."""
    rng = np.random.default_rng(11)
    files = {f"p{i}": rng.normal(size=12) for i in range(12)}
    rows = []
    for v in range(5):
        if v != 3:
            for name in list(files)[v:]:
                rows.append((v, f"v{v}/{name}", files[name].copy()))
        else:  # nothing in common with its neighbours
            rows += [(v, f"v{v}/n{i}", rng.normal(size=12)) for i in range(4)]
        rows += [(v, f"v{v}/copy{i}", files["p0"].copy()) for i in range(6 if v < 2 else 0)]
        for name in files:
            files[name] = files[name] + rng.normal(size=12) * 0.04 * (rng.random() < 0.5)
    return rows


def brute(rows, t):
    m = np.array([r[2] for r in rows])
    m = m / np.linalg.norm(m, axis=1)[:, None]
    s = m @ m.T
    pairs = []
    for i in range(len(rows)):
        for j in range(len(rows)):
            if (rows[i][0], rows[i][1]) < (rows[j][0], rows[j][1]) and s[i, j] >= t:
                pairs.append((rows[i][0], rows[j][0], rows[i][1], rows[j][1], s[i, j]))
    return pairs


def test_leakage_equals_direct_recount(spark, history):
    t, n = 0.99, 5
    df = spark.createDataFrame(
        [(v, f, [float(x) for x in e]) for v, f, e in history],
        "ord int, file_path string, embedding array<double>",
    )
    found = near_duplicates(df, t, ord=F.col("ord"))
    pairs = brute(history, t)
    got = {(r.ord_a, r.ord_b, r.file_a, r.file_b) for r in found.pairs().collect()}
    assert got == {p[:4] for p in pairs}

    sizes = [sum(r[0] == v for r in history) for v in range(n)]
    table = spark.createDataFrame([(f"v{v}", v, sizes[v]) for v in range(n)], "version string, ord int, files bigint")
    report = V.leakage_report(found, table).collect()
    assert [(r.version_a, r.version_b) for r in report] == [(f"v{v}", f"v{v+1}") for v in range(n - 1)]
    for v, r in enumerate(report):
        step = [p for p in pairs if p[0] == v and p[1] == v + 1]
        leak = [p for p in pairs if p[1] == v + 1 and p[0] <= v]
        files = {f for p in step for f in p[2:4]}
        leaking = {p[3] for p in leak}
        total = sizes[v] + sizes[v + 1]
        assert r.total_files == total
        assert r.duplicate_pairs == len(step)
        assert r.exact_duplicate_pairs == sum(p[4] >= 0.9999 for p in step)
        assert r.files_with_duplicates == len(files)
        assert r.percentage_files_with_duplicates == round(len(files) / total * 100, 2)
        assert r.training_set_size == sum(sizes[: v + 1])
        assert r.training_duplicate_pairs == sum(p[1] <= v for p in pairs)
        assert r.test_set_size == sizes[v + 1]
        assert r.test_entries_with_leakage == len(leaking)
        assert r.test_leakage_percentage == round(len(leaking) / sizes[v + 1] * 100, 2)
        assert r.leakage_pairs == len(leak)

    # each pair once, with its interval of boundaries
    intervals = V.boundary_intervals(found, n)
    assert intervals.count() == len(pairs)
    spread = V.at_boundaries(intervals).select("pair", "file_a", "file_b").collect()
    assert sorted(map(tuple, spread)) == sorted((k, p[2], p[3]) for p in pairs for k in range(p[1] + 1, n))
    assert {(r.file_a, r.file_b, r.leaks_at) for r in intervals.filter("leaks_at IS NOT NULL").collect()} == {
        (p[2], p[3], p[1]) for p in pairs if p[0] < p[1]
    }
    for name, holds in (
        (V.version_pairs, lambda a, b: a < b),
        (V.consecutive_pairs, lambda a, b: b == a + 1),
        (V.within_version_pairs, lambda a, b: a == b),
    ):
        got = {(r.file_a, r.file_b) for r in name(found).collect()}
        assert got == {p[2:4] for p in pairs if holds(p[0], p[1])}

    # links and membership stand for the same pairs
    links, members = (x.collect() for x in found.compressed())
    assert len(members) == len(history) and len(links) < len(pairs)
    of = {}
    for m in members:
        of.setdefault(m.gid, []).append((m.ord, m.file))
    listed = set()
    for k in links:
        for side, versions in ((k.gid_a, k.versions_a), (k.gid_b, k.versions_b)):
            assert versions == [sum({1 << v for v, _ in of[side]})]
        listed |= {(*sorted((x, y)),) for x in of[k.gid_a] for y in of[k.gid_b] if x != y}
    assert {(a[0], b[0], a[1], b[1]) for a, b in listed} == {p[:4] for p in pairs}

    train = V.train_duplicate_pairs(found, n).groupBy("pair").count().collect()
    want = {v + 1: sum(p[1] <= v for p in pairs) for v in range(n - 1)}
    assert {r["pair"]: r["count"] for r in train} == {k: c for k, c in want.items() if c}
    leaks = V.leakage_pairs(found).groupBy("pair").count().collect()
    want = {v: sum(p[1] == v and p[0] < v for p in pairs) for v in range(1, n)}
    assert {r["pair"]: r["count"] for r in leaks} == {k: c for k, c in want.items() if c}
    totals = V.pair_totals(found).first()
    assert totals.within_pairs == sum(p[0] == p[1] for p in pairs)
    assert totals.cross_pairs == sum(p[0] < p[1] for p in pairs)
    assert totals.within_pairs + totals.cross_pairs == found.pairs().count()


def test_bitmaps_of_many_versions(spark):
    rows = [(v, f"f{v:03d}", [1.0, 0.0]) for v in (0, 5, 63, 64, 130)]
    df = spark.createDataFrame(rows, "ord int, file_path string, embedding array<double>")
    found = near_duplicates(df, 0.99, ord=F.col("ord"))
    link = found.compressed()[0].first()
    assert link.versions_a == link.versions_b == [1 | 1 << 5 | -(1 << 63), 1, 1 << 2]
    assert found.pairs().count() == 10
