"""Centroid clustering of integer vectors by Orchard search, exact in all arithmetic.

A vector takes part if it has exactly ``dims`` components, none null or
non-finite; component x becomes the integer floor(scale * x). Each round
assigns every vector to its nearest centroid and replaces each centroid that
has vectors by the floor of their mean; then they are assigned once more.

Nearest centroids are found by Orchard's search: every centroid has the others
in a list by distance from it. A vector starts at a centroid and goes down its
list; where it meets a closer one it jumps to that one's list. Centroids
measured once are marked and not measured again. Once the list reaches a
centroid strictly beyond twice the vector's distance to the current one, no
later one can be as near: D(c, c') > 2 d gives d(x, c') > d. Ties go to the
smaller number, so equally near ones jump too.

Vectors stay in Spark: a round is one narrow pass that sums its vectors per
centroid in each task, and one small aggregation of (tasks x centroids) rows.
Only centroids pass through the driver, as many as the parameter says.

Rows without a usable vector are left out. Repeated rows count each time. A null
id is written as an empty one in the start order; rows of one id start in the
order of their components. With fewer vectors than centroids all of them start;
an empty table gives no rows. Other columns are not looked at. Components must
stay within 2^27 after scaling, or a squared distance might not fit a long:
an error names the first one that does not.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pvspark.llm.common import buffers, drop, store

LIMIT = 1 << 27
_ROWS = 1 << 14  # vectors searched together


@dataclass(frozen=True)
class Params:
    k: int = 16
    rounds: int = 3
    dims: int = 64
    scale: float = 64.0
    seed: int = 1


@dataclass
class Clusters:
    assigned: DataFrame  # vec_id, cluster, distance
    centroids: np.ndarray  # k x dims
    inertia: list[int]  # of each cluster
    paths: list[str]


def kept_vectors(vectors: DataFrame, params: Params, vec_id: str, embedding: str) -> DataFrame:
    """``vec_id, point``: usable vectors as packed integers."""
    dims, scale = params.dims, params.scale
    rows = vectors.select(
        F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("v")
    ).filter((F.size("v") == dims) & ~F.exists("v", lambda x: x.isNull()))
    kind = dict(vectors.dtypes)[vec_id]

    def floor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            usable = np.isfinite(x).all(axis=1)
            x = np.floor(scale * x[usable])
            if len(x) and np.abs(x).max() > LIMIT:
                raise ValueError(f"a component of {x.flat[np.abs(x).argmax()]:g} after scaling is too large")
            points = pa.array([p.tobytes() for p in x.astype("<i8")], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").filter(pa.array(usable)), points], names=["vec_id", "point"]
            )

    return rows.mapInArrow(floor, f"vec_id {kind}, point binary")


def points_of(column: pa.Array, dims: int) -> np.ndarray:
    return buffers(column)[0].view("<i8").reshape(-1, dims)


def start_centroids(kept: DataFrame, params: Params) -> np.ndarray:
    """The vectors with the smallest digests of seed and id, in that order."""
    text = F.concat(F.lit(f"{params.seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    signed = F.sha2(text.cast("binary"), 256).alias("digest")
    first = kept.select(signed, "point").orderBy("digest", "point").limit(params.k).toArrow()
    return points_of(first.column("point").combine_chunks(), params.dims) if len(first) else np.zeros((0, params.dims), np.int64)


class Search:
    """Orchard's lists of a set of centroids."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        difference = centroids[:, None, :] - centroids[None, :, :]
        self.between = (difference * difference).sum(axis=2)
        # ties of a list by number; the centroid itself is left out
        others = self.between.copy()
        np.fill_diagonal(others, -1)
        self.lists = np.argsort(others, axis=1, kind="stable")[:, 1:]

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Numbers and squared distances of the nearest centroids, and how many distances were taken.

        All vectors of a batch take one step down their lists at a time.
        """
        n, k = len(points), len(self.centroids)
        best = np.zeros(n, np.int64)
        distance = self._measure(points, best)
        place = np.zeros(n, np.int64)
        marked = np.zeros((n, k), bool)
        marked[:, 0] = True
        measured, active = n, np.arange(n if k > 1 else 0)
        while len(active):
            other = self.lists[best[active], place[active]]
            # strictly beyond twice the distance, on squares
            go = self.between[best[active], other] <= 4 * distance[active]
            active, other = active[go], other[go]
            place[active] += 1
            new = ~marked[active, other]
            seen, there = active[new], other[new]
            marked[seen, there] = True
            d = self._measure(points[seen], there)
            measured += len(seen)
            closer = (d < distance[seen]) | ((d == distance[seen]) & (there < best[seen]))
            jump = seen[closer]
            best[jump], distance[jump], place[jump] = there[closer], d[closer], 0
            active = active[place[active] < k - 1]
        return best, distance, measured

    def _measure(self, points: np.ndarray, at: np.ndarray) -> np.ndarray:
        difference = points - self.centroids[at]
        return (difference * difference).sum(axis=1)


def _sums(kept: DataFrame, centroids: np.ndarray, dims: int) -> DataFrame:
    """``cluster, n, sums``: one row per task and centroid that has vectors."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(centroids)
        n, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in batches:
            points = points_of(batch.column("point"), dims)
            for row in range(0, len(points), _ROWS):
                part = points[row : row + _ROWS]
                best, _, _ = search.nearest(part)
                order = np.argsort(best, kind="stable")
                some, first = np.unique(best[order], return_index=True)
                total[some] += np.add.reduceat(part[order], first)
                n += np.bincount(best, minlength=len(n))
        some = np.flatnonzero(n)
        sums = pa.array(total[some].tolist(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), sums], names=["cluster", "n", "sums"])

    return kept.select("point").mapInArrow(fold, "cluster long, n long, sums array<long>")


def moved(kept: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round; those without vectors stay."""
    dims = centroids.shape[1]
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    per_component = (
        _sums(kept, centroids, dims)
        .select("cluster", "n", F.posexplode("sums").alias("dim", "part"))
        .groupBy("cluster", "dim")
        .agg(wide("n").alias("n"), wide("part").alias("total"))
    )
    after = centroids.copy()
    for row in per_component.collect():  # k x dims numbers
        after[row["cluster"], row["dim"]] = int(row["total"]) // int(row["n"])
    return after


def assign(kept: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``vec_id, cluster, distance`` of every kept vector."""
    kind = dict(kept.dtypes)["vec_id"]
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(centroids)
        for batch in batches:
            points = points_of(batch.column("point"), dims)
            for row in range(0, len(points), _ROWS):
                best, distance, _ = search.nearest(points[row : row + _ROWS])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id").slice(row, len(best)), pc.cast(pa.array(best), pa.int32()), pa.array(distance)],
                    names=["vec_id", "cluster", "distance"],
                )

    return kept.mapInArrow(run, f"vec_id {kind}, cluster int, distance long")


def cluster(
    vectors: DataFrame, params: Params = Params(), vec_id: str = "vec_id", embedding: str = "embedding"
) -> Clusters:
    """Clusters of ``vectors``; ``assigned`` is a stored table."""
    spark = vectors.sparkSession
    kept, at = store(kept_vectors(vectors, params, vec_id, embedding), "points")
    centroids = start_centroids(kept, params)
    if not len(centroids):
        return Clusters(assign(kept, np.zeros((1, params.dims), np.int64)), centroids, [], [at])
    for _ in range(params.rounds):
        centroids = moved(kept, centroids)
    assigned, path = store(assign(kept, centroids), "assigned")
    drop(spark, at)
    inertia = [0] * len(centroids)
    for row in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect():
        inertia[row["cluster"]] = int(row["d"])
    return Clusters(assigned, centroids, inertia, [path])
