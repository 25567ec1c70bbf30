import hashlib
import random

import numpy as np
import pytest

from pvspark.llm import centroids as C
from pvspark.llm import queries


def plain(rows, k, rounds):
    """Python integers, all distances."""
    kept = [
        (i, [int(np.floor(64 * float(np.float32(x)))) for x in v])
        for i, v in rows
        if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)
    ]
    digest = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    start = sorted(kept, key=lambda r: (digest(r[0]), np.array(r[1], "<i8").tobytes()))
    centres = [v for _, v in start[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((far(v, c), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        for n, members in groups.items():
            centres[n] = [sum(column) // len(members) for column in zip(*members)]
    return [(i, near(v)[1], near(v)[0]) for i, v in kept], centres


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    point = lambda s: [rng.gauss(0, s) for _ in range(64)]
    centre = [point(1.0) for _ in range(5)]
    out = [(i, [c + rng.gauss(0, 0.2) for c in centre[i % 5]]) for i in range(150)]
    hot = [0.5] * 64
    out += [(i, hot) for i in range(150, 230)] + [(7, out[7][1]), (7, out[7][1]), (7, hot)]
    out += [(300, None), (301, []), (302, point(1)[:63]), (303, point(1) + [0.0]), (304, [None] + point(1)[1:])]
    out += [(305, [float("nan")] * 64), (306, [float("inf")] + point(1)[1:]), (307, [0.0] * 64), (308, [-0.0] * 64)]
    out += [(None, point(1)), (None, hot)]
    return out


SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, distance string, point string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "y", "z") for i, v in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("k", [1, 2, 16, 400])
def test_against_plain_means(spark, rows, k):
    found = C.cluster(frame(spark, rows), C.Params(k=k))
    want, centres = plain(rows, k, 3)
    got = [tuple(r) for r in found.assigned.collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert sorted(got, key=key) == sorted(want, key=key)
    assert found.centroids.tolist() == centres
    assert sum(found.inertia) == sum(d for _, _, d in want)


def test_query(spark, rows, tmp_path):
    frame(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    want, centres = plain(rows, 16, 3)
    per = {}
    for _, c, d in want:
        per[c] = per.get(c, 0) + d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    full = [(i, c, d, per[c], sum(per.values()), digest[c]) for i, c, d in want]
    got = queries.op12_centroids(spark, str(tmp_path))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(full, key=key)


def test_empty_and_unusable_tables(spark, tmp_path):
    for name, rows in (("a", []), ("b", [(1, None), (2, [1.0])])):
        assert C.cluster(frame(spark, rows)).assigned.count() == 0
        frame(spark, rows).write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
        assert queries.op12_centroids(spark, f"{tmp_path}/{name}").count() == 0


def test_search_is_exact_with_ties_and_saves_distances():
    rng = np.random.default_rng(5)
    for spread in (2, 400):
        middle = rng.integers(-spread, spread, (40, 6))
        middle[7] = middle[30]  # equal centroids: the smaller number wins
        points = np.concatenate([middle[rng.integers(0, 40, 500)] + rng.integers(-2, 3, (500, 6)), middle])
        best, distance, measured = C.Search(middle).nearest(points)
        all_of = ((points[:, None, :] - middle[None]) ** 2).sum(axis=2)
        assert (best == all_of.argmin(axis=1)).all() and (distance == all_of.min(axis=1)).all()
        assert 30 not in best
    assert measured < 0.75 * all_of.size


def test_too_large_a_component(spark):
    with pytest.raises(Exception, match="too large"):
        C.cluster(frame(spark, [(1, [1e30] * 64)]))
