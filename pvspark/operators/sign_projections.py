"""Approximate cosine pairs by banded sign projections, every candidate checked exactly.

Opt-in: it may lose pairs, so the reports use the exact join. What it gives is
exact: no pair below the threshold, and the same similarity as the exact join.

A random hyperplane parts two vectors at angle a with probability a / pi. Each
vector gets ``bands`` keys of ``rows`` signs; two vectors meet where a key is
equal. ``choose_bands`` finds the fewest bands for which a pair exactly at the
threshold meets with the probability wanted; closer pairs meet more surely.

Vectors of equal key are a bucket. A bucket above ``bucket_rows`` is cut into
parts by hash and each two parts meet, so a hot bucket is many pieces of work and
nothing is capped. Vectors are written once and so are the lists of the parts; what
is dealt to tasks is where two lists are, so no vector is shuffled to its buckets. A pair counts in the first band where its keys
are equal, so it comes up once and candidates are neither listed nor made
distinct afterwards.
"""

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pvspark.operators.duplicates import NearDuplicates, near_duplicates, summary_of_links
from pvspark.operators.similarity import DEFAULT_THRESHOLD, _exact, _from_bytes, _margin, _small, _tiles
from pvspark.session import materialize
from pvspark.sources.blocks import read_pieces, write_pieces

BUCKET_ROWS = 2048
HELD = 16 << 20  # bytes of vectors that a task reads at once, or one pair of parts
PARTS_PER_TASK = 64
MOST_TASKS = 4096
_PLACE = 24  # bytes of a vector in the list of its part


def meeting_probability(cosine: float, rows: int, bands: int) -> float:
    """That two vectors of this cosine share a key in one of the bands."""
    same = 1 - math.acos(max(-1.0, min(1.0, cosine))) / math.pi
    return 1 - (1 - same**rows) ** bands


def choose_bands(threshold: float, vectors: int, recall: float = 0.95, most: int = 64) -> tuple[int, int]:
    """Signs a key and bands: the fewest bands that reach ``recall`` at the threshold.

    Keys are as long as ``most`` bands allow, up to two signs more than it takes to
    tell ``vectors`` random vectors apart.
    """
    longest = max(4, math.ceil(math.log2(max(vectors, 2))) + 2)
    for rows in range(min(longest, 62), 0, -1):
        same = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** rows
        bands = 1 if same >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-same))
        if bands <= most or rows == 1:
            return rows, bands
    return 1, 1


def with_keys(vectors: DataFrame, rows: int, bands: int, seed: int) -> DataFrame:
    """Add ``keys``: one packed integer per band, from signs of seeded random projections."""
    names = vectors.columns
    kinds = ", ".join(f"`{n}` {k}" for n, k in vectors.dtypes)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = None
        weights = np.int64(1) << np.arange(rows, dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _from_bytes(batch.column("unit"))
            if planes is None:
                planes = np.random.default_rng(seed).normal(size=(unit.shape[1], rows * bands))
            signs = (unit @ planes > 0).reshape(len(unit), bands, rows)
            keys = (signs * weights).sum(axis=2)
            offsets = pa.array(np.arange(len(unit) + 1) * bands, pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [lists], names=[*names, "keys"])

    return vectors.mapInArrow(project, f"{kinds}, keys array<long>")


def _packed(keyed: DataFrame) -> DataFrame:
    """``side, gid, keys`` and ``packed``: the digest, the vector and the keys as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("keys")
            flat, n = keys.flatten().to_numpy(), len(keys)
            rows = flat.reshape(n, -1) if n else flat
            packed = [g + u + k.tobytes() for g, u, k in zip(batch.column("gid").to_pylist(), batch.column("unit").to_pylist(), rows)]
            columns = [batch.column(c) for c in ("side", "gid", "keys")] + [pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["side", "gid", "keys", "packed"])

    rows = keyed.select("side", "gid", "unit", "keys")
    return rows.mapInArrow(run, "side int, gid binary, keys array<long>, packed binary")


def _parts(vectors: DataFrame, names: list[str], bucket_rows: int, cross: bool) -> DataFrame:
    """Stored ``band, key, part, file, at, bytes``: where the list of a part's vectors is.

    A list has file, place and side of each vector; buckets of one vector are left out.
    """
    spark = vectors.sparkSession
    numbered = spark.createDataFrame(list(enumerate(names)), "number int, file string")
    cells = vectors.join(_small(numbered), "file").select("side", "gid", "number", "at", F.posexplode("keys").alias("band", "key"))
    sizes = cells.groupBy("band", "key").agg(F.count("*").alias("n"), F.count_distinct("side").alias("sides"))
    met = F.col("sides") > 1 if cross else F.col("n") > 1
    parts = F.ceil(F.col("n") / F.lit(bucket_rows)).cast("int")
    buckets = materialize(sizes.filter(met).select("band", "key", parts.alias("parts")), "sign-buckets")
    part = F.pmod(F.xxhash64("gid"), F.col("parts")).cast("int")
    placed = cells.join(_small(buckets), ["band", "key"]).select("band", "key", part.alias("part"), "number", "at", "side")
    at = F.struct(F.col("number").cast("long").alias("number"), "at", F.col("side").cast("long").alias("side"))
    lists = placed.groupBy("band", "key", "part").agg(F.collect_list(at).alias("list"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("list")
            flat = lists.flatten()
            rows = np.stack([flat.field(c).to_numpy() for c in ("number", "at", "side")], axis=1).astype(np.int64)
            ends = np.cumsum(lists.value_lengths().to_numpy())
            packed = pa.array([x.tobytes() for x in np.split(rows, ends)[: len(ends)]], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], packed], names=["band", "key", "part", "list"])

    return write_pieces(lists.mapInArrow(pack, "band int, key long, part int, list binary"), "list", "sign-parts")


def _meet(unit, keys, side, gid, part, band: int, threshold: float, cross: bool):
    """Pairs of one bucket, or of two parts of it (``part`` 0 and 1), that meet in no earlier band."""
    two = bool(part.any())
    if cross:
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    elif two:
        left, right = np.flatnonzero(part == 0), np.flatnonzero(part == 1)
    else:
        left = right = np.arange(len(unit))
    floor = threshold - _margin(unit.shape[1])
    for i0, j0, rough in _tiles(unit[left], unit[right], left is right, floor):
        i, j = np.nonzero(rough >= floor)
        x, y = left[i + i0], right[j + j0]
        if cross and two:  # equal parts meet by themselves
            x, y = x[part[x] != part[y]], y[part[x] != part[y]]
        new = ~(keys[x, :band] == keys[y, :band]).any(axis=1)
        x, y = x[new], y[new]
        cosine = _exact(unit, unit, x, y)
        hit = cosine >= threshold
        columns = [gid.take(pa.array(x[hit])), gid.take(pa.array(y[hit])), pa.array(cosine[hit])]
        yield pa.RecordBatch.from_arrays(columns, names=["gid_a", "gid_b", "similarity"])


def _met(parts: DataFrame, names: list[str], bytes_each: int, threshold: float, bands: int, cross: bool) -> DataFrame:
    """``gid_a, gid_b, similarity`` of all pairs of parts; a task reads lists and vectors by itself."""
    refs = ["file", "at", "bytes"]
    end = lambda s: parts.select("band", "key", F.col("part").alias(f"part_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in refs])
    pairs = end("a").join(end("b"), ["band", "key"]).filter("part_a <= part_b")
    pairs = pairs.select("band", "part_a", "part_b", *[f"{c}_{s}" for s in "ab" for c in refs]).repartition(
        max(2 * parts.sparkSession.sparkContext.defaultParallelism, _tasks(parts)), "band", "file_a", "at_a", "part_b"
    )

    def few(table: pa.Table) -> Iterator[pa.Table]:
        """Rows whose vectors fit in ``HELD`` bytes, one at least."""
        size = (table.column("bytes_a").to_numpy() + table.column("bytes_b").to_numpy()) // _PLACE * bytes_each
        ends, first = np.cumsum(size), 0
        while first < len(size):
            last = max(first + 1, int(np.searchsorted(ends, ends[first] - size[first] + HELD, "right")))
            yield table.slice(first, last - first)
            first = last

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in few(pa.Table.from_batches([batch])):
                both = [rows.select([f"{c}_{s}" for c in refs]).rename_columns(refs) for s in "ab"]
                lists = [np.frombuffer(x, np.int64).reshape(-1, 3) for x in read_pieces(pa.concat_tables(both))]
                places, of = np.unique(np.concatenate(lists), axis=0, return_inverse=True)
                files = pa.DictionaryArray.from_arrays(pa.array(places[:, 0].astype(np.int32)), pa.array(names)).cast(pa.string())
                found = read_pieces(pa.table([files, pa.array(places[:, 1]), pa.array(np.full(len(places), bytes_each))], refs))
                data = np.frombuffer(b"".join(found), np.uint8).reshape(len(places), bytes_each)
                gids = pa.array([x[:16] for x in found], pa.binary())
                unit = np.ascontiguousarray(data[:, 16 : bytes_each - 8 * bands]).view(np.float64)
                keys = np.ascontiguousarray(data[:, bytes_each - 8 * bands :]).view(np.int64)
                ends = np.cumsum([0, *(len(x) for x in lists)])
                at = [of.ravel()[a:e] for a, e in zip(ends[:-1], ends[1:])]
                band, same = rows.column("band").to_pylist(), pa.compute.equal(rows.column("part_a"), rows.column("part_b")).to_pylist()
                for k in range(len(rows)):
                    own = at[k] if same[k] else np.concatenate([at[k], at[len(rows) + k]])
                    part = (np.arange(len(own)) >= len(at[k])).astype(np.int8)
                    yield from _meet(unit[own], keys[own], places[own, 2], gids.take(pa.array(own)), part, band[k], threshold, cross)

    return pairs.mapInArrow(run, "gid_a binary, gid_b binary, similarity double")


def _tasks(parts: DataFrame) -> int:
    """A task for ``PARTS_PER_TASK`` pairs of parts, up to ``MOST_TASKS``."""
    per = parts.groupBy("band", "key").agg(F.count("*").alias("n"))
    pairs = per.agg(F.sum(F.expr("n * (n + 1) div 2"))).first()[0] or 0
    return min(MOST_TASKS, -(-int(pairs) // PARTS_PER_TASK))


@dataclass
class ApproximateDuplicates(NearDuplicates):
    """Near-duplicates whose links between different vectors come from shared keys.

    Copies of one vector are found exactly, as always. ``rows`` and ``bands`` are chosen from
    the threshold and the number of vectors unless given.
    """

    recall: float = 0.95
    rows: int | None = None
    bands: int | None = None
    seed: int = 1
    bucket_rows: int = BUCKET_ROWS

    @cached_property
    def shape(self) -> tuple[int, int]:
        if self.rows and self.bands:
            return self.rows, self.bands
        return choose_bands(self.threshold, self.groups.count(), self.recall)

    @cached_property
    def links(self) -> DataFrame:
        rows, bands = self.shape
        # a zero vector is similar to nothing
        some = self.groups.filter(F.col("self_sim") > 0).select("side", "gid", "unit")
        vectors = write_pieces(_packed(with_keys(some, rows, bands, self.seed)), "packed", "sign-vectors")
        each = vectors.select("bytes").first()  # all vectors have as many components
        names = [r["file"] for r in vectors.select("file").distinct().collect()]  # one a task
        own = self._own().select(F.col("gid").alias("gid_a"), F.col("gid").alias("gid_b"), "self_sim")
        if each is None:
            return materialize(own.withColumnRenamed("self_sim", "similarity"), "links")
        parts = _parts(vectors, names, self.bucket_rows, self.cross)
        found = _met(parts, names, each["bytes"], self.threshold, bands, self.cross)
        return materialize(found.unionAll(own), "links")

    @cached_property
    def summary(self) -> DataFrame:
        return materialize(summary_of_links(self.links, self.groups, self.cross), "summary")


def approximate_duplicates(
    items: DataFrame,
    threshold: float = DEFAULT_THRESHOLD,
    recall: float = 0.95,
    rows: int | None = None,
    bands: int | None = None,
    seed: int = 1,
    **kw,
) -> ApproximateDuplicates:
    """``near_duplicates`` that compares only vectors sharing a key; ``threshold`` must be positive."""
    if threshold <= 0:
        raise ValueError("sign projections need a positive threshold")
    exact = near_duplicates(items, threshold, **kw)
    return ApproximateDuplicates(
        exact.members, exact.groups, threshold, exact.cross, recall=recall, rows=rows, bands=bands, seed=seed
    )
