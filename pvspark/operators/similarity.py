"""Exact all-pairs cosine join at or above a threshold.

The join runs on *distinct* vectors. Rows with the same unit vector form a
copy group, so a third of all rows being copies of one file costs one vector
here, and the statistics count its pairs from group sizes alone.

Distinct vectors are cut into blocks, and each block is written once as a file
in the shared folder: of n vectors n rows are shuffled, however many blocks
there are. What is dealt to tasks is a small table of the pairs of blocks that
can hold a match; a task opens the files of its pairs by itself. Blocks come from
grid cells over a few principal axes: two unit vectors with cosine >= t are at most
``sqrt(2 - 2t)`` apart along any axis, so only neighbouring cells need to
meet. Cells above the block size are split, so no task holds more than two blocks.
The cost stays quadratic for vectors without structure (then a single cell
remains and all block pairs are visited); nothing is ever missed.
"""

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pvspark.functions.stats import EXACT_SIMILARITY
from pvspark.session import materialize
from pvspark.sources.blocks import read_block, write_blocks

DEFAULT_THRESHOLD = 0.99
BLOCK_BYTES = 32 << 20  # unit vectors held per block
MIN_BLOCK = 256
MAX_AXES = 4
MAX_CELLS_PER_AXIS = 64
AXIS_SAMPLE = 2048
GRID_SAMPLE = 512
GRID_PAYS_FROM = 10**11  # multiply-adds of the full triangle
MAX_BROADCAST_ROWS = 500_000  # rows of a few integers each: some 20 MB
PAIRS_PER_TASK = 16  # block pairs, where there are many
_TILE = 1024
_EMIT_ROWS = 1 << 16


def _matrix(column) -> np.ndarray:
    """2-D float64 view of an Arrow list column whose rows have equal length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    rows = len(column)
    if rows and len(values) % rows:
        raise ValueError("vectors differ in length")
    return values.reshape(rows, -1)


def _from_bytes(column) -> np.ndarray:
    """2-D float64 view of an Arrow binary column holding packed unit vectors."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    if rows == 0:
        return np.zeros((0, 0))
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int32)[column.offset : column.offset + rows + 1]
    count = (bounds[-1] - bounds[0]) // 8
    return np.frombuffer(data, np.float64, count, int(bounds[0])).reshape(rows, -1)


def list_array(matrix: np.ndarray) -> pa.Array:
    rows, dims = matrix.shape
    offsets = np.arange(0, (rows + 1) * dims, max(dims, 1), dtype=np.int32)
    if not dims:
        offsets = np.zeros(rows + 1, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.ravel()))


def _unit(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; a zero row stays zero (similarity 0).

    A row with a NaN or an infinite component is similar to nothing: it counts as a zero row.
    """
    matrix = np.where(np.isfinite(matrix).all(axis=1)[:, None], matrix, 0.0)
    norm = np.sqrt((matrix * matrix).sum(axis=1))
    norm[norm == 0] = 1.0
    return matrix / norm[:, None] + 0.0  # + 0.0 turns -0.0 into 0.0


def with_unit_vectors(items: DataFrame, vector: str = "embedding") -> DataFrame:
    """Replace ``vector`` by ``gid`` (digest of the unit vector), ``unit``, ``self_sim``.

    Narrow, one Arrow pass. ``unit`` is packed doubles: from here on vectors
    are only moved, and a binary value is copied whole where an array would be
    converted element by element.
    """
    items = items.withColumn(vector, F.col(vector).cast("array<double>"))
    kept = [f for f in items.schema.fields if f.name != vector]
    schema = T.StructType(
        kept
        + [
            T.StructField("gid", T.BinaryType()),
            T.StructField("unit", T.BinaryType()),
            T.StructField("self_sim", T.DoubleType()),
        ]
    )
    names = [f.name for f in kept]

    def normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            unit = _unit(_matrix(batch.column(vector)))
            packed = [row.tobytes() for row in unit]
            digests = [hashlib.blake2b(row, digest_size=16).digest() for row in packed]
            columns = [batch.column(n) for n in names] + [
                pa.array(digests, pa.binary()),
                pa.array(packed, pa.binary()),
                pa.array((unit * unit).sum(axis=1)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names + ["gid", "unit", "self_sim"])

    return items.select(*names, vector).mapInArrow(normalise, schema)


def _axes(distinct: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Principal axes and coordinates of at most AXIS_SAMPLE vectors.

    A sample only steers which block pairs can be skipped; the bound holds for
    any orthonormal axes. Distinct vectors are laid out by digest, so the
    first rows are a random sample.
    """
    rows = distinct.select("unit").limit(AXIS_SAMPLE).toArrow()
    sample = _from_bytes(rows.column("unit"))
    centred = sample - sample.mean(axis=0)
    _, _, axes = np.linalg.svd(centred, full_matrices=False)
    axes = axes[:MAX_AXES]
    return axes, sample @ axes.T


def _choose_grid(coords: np.ndarray, reach: float, rows: int) -> tuple[int, float]:
    """Number of axes whose grid leaves the least work, and the cell width.

    Work is the share of vector pairs in neighbouring cells, plus a small
    block's worth for each of the neighbouring cells a vector is sent to.
    """
    width = max(reach, 2.0 / MAX_CELLS_PER_AXIS)
    coords = coords[:GRID_SAMPLE]
    best, best_cost = 0, 1.0
    for k in range(1, coords.shape[1] + 1):
        cells = np.floor(coords[:, :k] / width).astype(np.int64)
        near = (np.abs(cells[:, None, :] - cells[None, :, :]) <= 1).all(axis=2).mean()
        cost = near + 3.0**k * MIN_BLOCK / (2.0 * rows)
        if cost < 0.8 * best_cost:
            best, best_cost = k, cost
    return best, width


def _with_cells(distinct: DataFrame, axes: np.ndarray, width: float) -> DataFrame:
    """Add ``cell``: grid coordinates folded into one number (0 without axes)."""
    if not len(axes):
        return distinct.withColumn("cell", F.lit(0).cast("long"))
    base = _cell_base(width)
    names = distinct.columns
    schema = T.StructType(distinct.schema.fields + [T.StructField("cell", T.LongType())])

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            steps = np.floor(_from_bytes(batch.column("unit")) @ axes.T / width).astype(np.int64)
            code = np.zeros(len(steps), dtype=np.int64)
            for j in range(steps.shape[1]):
                code = code * base + steps[:, j] + base // 2
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in names] + [pa.array(code)], names=names + ["cell"]
            )

    return distinct.mapInArrow(locate, schema)


def _cell_base(width: float) -> int:
    return 2 * (math.ceil(1.0 / width) + 3)


def _neighbour_offsets(axes: int, width: float) -> list[int]:
    base = _cell_base(width)
    offsets = []
    for steps in product((-1, 0, 1), repeat=axes):
        code = 0
        for step in steps:
            code = code * base + step
        offsets.append(code)
    return offsets


def _load_pair(a: pa.Table, b: pa.Table | None):
    """Rows of both blocks in one table and where they stand; ``b`` is None for a block met with itself."""
    table = (a if b is None else pa.concat_tables([a, b])).combine_chunks()
    unit = _from_bytes(table.column("unit"))
    left = np.arange(len(a))
    right = left if b is None else np.arange(len(a), len(table))
    return table, unit, left, right


def _sides(rows: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both blocks' rows of a pair's array, not copied."""
    return rows[: len(left)], rows[len(rows) - len(right) :]


def _tiles(a: np.ndarray, b: np.ndarray, same: bool, floor: float):
    """Float32 products tile by tile, where any entry reaches ``floor``."""
    for i0 in range(0, len(a), _TILE):
        rows = a[i0 : i0 + _TILE].astype(np.float32)
        for j0 in range(i0 if same else 0, len(b), _TILE):
            rough = rows @ b[j0 : j0 + _TILE].astype(np.float32).T
            if same and i0 == j0:
                rough[np.tril_indices(len(rough))] = -2.0
            if rough.size and rough.max() >= floor:
                yield i0, j0, rough


def _margin(dims: int) -> float:
    """Above the rounding error of a float32 product of unit vectors."""
    return 1e-6 + dims * 1.2e-7


def _exact(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cosines in doubles, row by row: the same whatever the blocking."""
    parts = [
        (a[i[s : s + _EMIT_ROWS]] * b[j[s : s + _EMIT_ROWS]]).sum(axis=1)
        for s in range(0, len(i), _EMIT_ROWS)
    ]
    return np.concatenate(parts) if parts else np.zeros(0)


def _pair_kernel(threshold: float, dims: int):
    """Pairs with cosine >= threshold between the two sides of one block pair.

    The float32 product only finds candidates; doubles decide.
    """
    floor = threshold - _margin(dims)
    names = ["gid_a", "gid_b", "similarity"]

    def kernel(block_a: pa.Table, block_b: pa.Table | None) -> Iterator[pa.RecordBatch]:
        table, unit, left, right = _load_pair(block_a, block_b)
        gid = np.array(table.column("gid").to_pylist(), dtype=object)
        (a, b), (gid_a, gid_b) = _sides(unit, left, right), _sides(gid, left, right)
        for i0, j0, rough in _tiles(a, b, block_b is None, floor):
            i, j = np.nonzero(rough >= floor)
            i, j = i + i0, j + j0
            for s in range(0, len(i), _EMIT_ROWS):
                ii, jj = i[s : s + _EMIT_ROWS], j[s : s + _EMIT_ROWS]
                sim = _exact(a, b, ii, jj)
                hit = sim >= threshold
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(gid_a[ii[hit]].tolist(), pa.binary()),
                        pa.array(gid_b[jj[hit]].tolist(), pa.binary()),
                        pa.array(sim[hit]),
                    ],
                    names=names,
                )

    return kernel


def _summary_kernel(threshold: float, dims: int):
    """What the reports need of one block pair, without listing its pairs.

    With M the 0/1 matrix of similar groups and C the members of each group per
    version, ``M @ C`` holds for every group how many similar files each version
    has. Output: the versions seen by each group that has a partner, and per
    later version the number of file pairs (all, inside the version, with the
    version before; the last also for exact pairs).
    """
    margin = _margin(dims)
    floor = threshold - margin

    def kernel(block_a: pa.Table, block_b: pa.Table | None) -> Iterator[pa.RecordBatch]:
        table, unit, left, right = _load_pair(block_a, block_b)
        a, b = _sides(unit, left, right)
        ords = table.column("ords").combine_chunks()
        owner = np.repeat(np.arange(len(ords)), pc.list_value_length(ords).to_numpy())
        versions, column = np.unique(ords.flatten().to_numpy(), return_inverse=True)
        counts = np.zeros((len(unit), len(versions)))
        counts[owner, column] = table.column("ns").combine_chunks().flatten().to_numpy()
        count_a, count_b = _sides(counts, left, right)
        follows = np.concatenate([[False], np.diff(versions) == 1])
        seen_a, seen_b = np.zeros(count_a.shape, bool), np.zeros(count_b.shape, bool)
        sums = np.zeros((5, len(versions)))

        def tally(mask, ca, cb):
            """Pairs per later version: inside it, with all before, with the one before."""
            near = mask @ cb
            inside = (ca * near).sum(axis=0)
            before = lambda c: np.cumsum(c, axis=1) - c
            shifted = lambda c: np.concatenate([np.zeros((len(c), 1)), c[:, :-1]], axis=1) * follows
            earlier = (ca * (mask @ before(cb)) + before(ca) * near).sum(axis=0)
            previous = (ca * (mask @ shifted(cb)) + shifted(ca) * near).sum(axis=0)
            return near, inside, earlier, previous

        for i0, j0, rough in _tiles(a, b, block_b is None, floor):
            rows = np.flatnonzero((rough >= floor).any(axis=1))
            cols = np.flatnonzero((rough >= floor).any(axis=0))
            part = rough[np.ix_(rows, cols)]
            hit, exact = part >= threshold, part >= EXACT_SIMILARITY
            unsure = (np.abs(part - threshold) <= margin) | (
                np.abs(part - EXACT_SIMILARITY) <= margin
            )
            i, j = np.nonzero(unsure)
            sim = _exact(a, b, rows[i] + i0, cols[j] + j0)
            hit[i, j] = sim >= threshold
            exact[i, j] = sim >= EXACT_SIMILARITY
            exact &= hit
            ca, cb = count_a[rows + i0], count_b[cols + j0]
            mask = hit.astype(np.float64)
            near, inside, earlier, previous = tally(mask, ca, cb)
            seen_a[rows + i0] |= near > 0
            seen_b[cols + j0] |= (mask.T @ ca) > 0
            sums[0] += inside
            sums[1] += earlier
            sums[2] += previous
            if exact.any():
                _, inside, earlier, previous = tally(exact.astype(np.float64), ca, cb)
                sums[3] += inside + earlier
                sums[4] += previous

        gid, side = table.column("gid").combine_chunks(), table.column("side").combine_chunks()
        for at, seen in ((left, seen_a), (right, seen_b)):
            touched = np.flatnonzero(seen.any(axis=1))
            if len(touched):
                rows, cols = np.nonzero(seen[touched])
                take = pa.array(at[touched][rows])
                yield _summary_rows(len(rows), gid=gid.take(take), side=side.take(take), ord=versions[cols])
        some = np.flatnonzero(sums[0] + sums[1])
        if len(some):
            numbers = {n: sums[k, some].astype(np.int64) for k, n in enumerate(PAIR_NUMBERS)}
            yield _summary_rows(len(some), ord=versions[some], **numbers)

    return kernel


PAIR_NUMBERS = ["within", "earlier", "consecutive", "exact", "consecutive_exact"]
_SUMMARY = pa.schema(
    [("gid", pa.binary()), ("side", pa.int32()), ("ord", pa.int32())]
    + [(n, pa.int64()) for n in PAIR_NUMBERS]
)
SUMMARY = "gid binary, side int, ord int, " + ", ".join(f"{n} bigint" for n in PAIR_NUMBERS)


def _summary_rows(rows: int, **columns) -> pa.RecordBatch:
    arrays = []
    for f in _SUMMARY:
        value = columns.get(f.name)
        if value is None:
            value = pa.nulls(rows, f.type)
        elif not isinstance(value, (pa.Array, pa.ChunkedArray)):
            value = pa.array(value, f.type)
        arrays.append(value.cast(f.type))
    return pa.RecordBatch.from_arrays(arrays, schema=_SUMMARY)


def distinct_vectors(units: DataFrame, by_version: bool) -> DataFrame:
    """One row per copy group: ``side, gid, unit, self_sim, copies, ords, ns``.

    Copies merge before the shuffle. ``ords, ns`` give the members per version;
    with versions they are counted first, so no list grows with the copies.
    """
    first = [F.first(c).alias(c) for c in ("unit", "self_sim")]
    if not by_version:
        groups = units.groupBy("side", "gid").agg(
            *first, F.count("*").alias("copies"), F.first("ord").alias("ord")
        )
        return groups.select(
            "side", "gid", "unit", "self_sim", "copies",
            F.array("ord").alias("ords"), F.array("copies").alias("ns"),
        )
    per_version = units.groupBy("side", "gid", "ord").agg(*first, F.count("*").alias("n"))
    groups = per_version.groupBy("side", "gid").agg(
        *first, F.sum("n").alias("copies"), F.collect_list(F.struct("ord", "n")).alias("per")
    )
    return groups.select(
        "side", "gid", "unit", "self_sim", "copies",
        F.col("per.ord").alias("ords"), F.col("per.n").alias("ns"),
    )


def _small(table: DataFrame) -> DataFrame:
    """Broadcast a bookkeeping table after counting it; leave a large one to the planner."""
    return F.broadcast(table) if table.count() <= MAX_BROADCAST_ROWS else table


def _in_cells(vectors: DataFrame, axes: np.ndarray, width: float, block_rows: int) -> DataFrame:
    """Add ``cell, sub``: grid cells, those above ``block_rows`` split by hash."""
    vectors = materialize(_with_cells(vectors, axes, width), "cells")
    sizes = vectors.groupBy("side", "cell").agg(F.count("*").alias("n"))
    subs = F.ceil(F.col("n") / F.lit(block_rows)).cast("int")
    cells = materialize(sizes.select("side", "cell", subs.alias("subs")), "cell-sizes")
    sub = F.pmod(F.xxhash64("gid"), F.col("subs")).cast("int")
    return vectors.join(_small(cells), ["side", "cell"]).withColumn("sub", sub).drop("subs")


@dataclass
class BlockPairs:
    """Stored blocks of vectors and which of them meet."""

    blocks: DataFrame  # side, cell, sub, file, rows
    offsets: list[int]  # of the cells next to a cell
    cross: bool
    dims: int

    def pairs(self) -> DataFrame:
        """``file_a, file_b``: neighbouring cells, each unordered pair once unless ``cross``."""
        at = F.struct("cell", "sub")
        left = self.blocks.filter(F.col("side") == 0).select(
            F.col("file").alias("file_a"),
            at.alias("at_a"),
            F.explode(F.array(*[F.col("cell") + F.lit(o) for o in self.offsets])).alias("cell"),
        )
        right = self.blocks.filter(F.col("side") == (1 if self.cross else 0)).select(
            F.col("file").alias("file_b"), at.alias("at_b"), "cell"
        )
        pairs = left.join(_small(right), "cell")
        if not self.cross:
            pairs = pairs.filter(F.col("at_a") <= F.col("at_b"))
        return pairs.select("file_a", "file_b")

    def meet(self, kernel, schema: str) -> DataFrame:
        """Apply ``kernel`` to every pair of blocks; a task keeps its first block while pairs share it."""
        pairs = self.pairs()
        cores = pairs.sparkSession.sparkContext.defaultParallelism
        blocks = self.blocks.count()
        tasks = max(2 * cores, blocks * blocks // (2 * PAIRS_PER_TASK))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, first = None, None
            for batch in batches:
                for a, b in zip(batch.column("file_a").to_pylist(), batch.column("file_b").to_pylist()):
                    if a != held:
                        held, first = a, read_block(a)
                    yield from kernel(first, None if a == b else read_block(b))

        dealt = pairs.repartitionByRange(min(tasks, blocks * blocks), "file_a", "file_b")
        return dealt.sortWithinPartitions("file_a", "file_b").mapInArrow(run, schema)


def block_pairs(
    distinct: DataFrame, threshold: float, cross: bool = False, block_rows: int | None = None
) -> BlockPairs | None:
    """Write the blocks of ``distinct``; None if it has no rows."""
    spark = distinct.sparkSession
    n, unit_bytes = distinct.agg(F.count("*"), F.max(F.length("unit"))).first()
    if n == 0:
        return None
    dims = unit_bytes // 8
    if block_rows is None:
        wanted = math.ceil(math.sqrt(2 * spark.sparkContext.defaultParallelism))
        limit = max(MIN_BLOCK, BLOCK_BYTES // (8 * max(dims, 1)))
        block_rows = min(limit, max(MIN_BLOCK, math.ceil(n / wanted)))
    reach = math.sqrt(max(0.0, 2.0 - 2.0 * threshold)) + 1e-9
    used, offsets = 0, [0]
    if threshold > 0 and n * n * dims > GRID_PAYS_FROM:
        axes, coords = _axes(distinct)
        used, width = _choose_grid(coords, reach, n)
    vectors = distinct.select("side", "gid", "unit", *[c for c in ("ords", "ns") if c in distinct.columns])
    if used:
        placed = _in_cells(vectors, axes[:used], width, block_rows)
        offsets = _neighbour_offsets(used, width)
    else:
        sub = F.pmod(F.xxhash64("gid"), F.lit(math.ceil(n / block_rows))).cast("int")
        placed = vectors.withColumns({"cell": F.lit(0).cast("long"), "sub": sub})
    # the side stays in the rows, which the reports need
    placed = placed.withColumn("of_side", F.col("side"))
    blocks = write_blocks(placed, ["of_side", "cell", "sub"], "blocks").withColumnRenamed("of_side", "side")
    return BlockPairs(blocks, offsets, cross, dims)


def similar_groups(stored: BlockPairs | None, threshold: float, spark: SparkSession) -> DataFrame:
    """Pairs of distinct vectors with cosine >= threshold.

    Within one set each unordered pair of different groups appears once; across
    two only pairs (side 0, side 1), equal groups included.
    """
    schema = "gid_a binary, gid_b binary, similarity double"
    if stored is None:
        return spark.createDataFrame([], schema)
    return stored.meet(_pair_kernel(threshold, stored.dims), schema)


def similar_summary(stored: BlockPairs | None, threshold: float, spark: SparkSession) -> DataFrame:
    """Numbers for the reports, over the same pairs as ``similar_groups``.

    Rows with ``gid``: a version seen by the group's partners. Rows without:
    pair numbers of a version. At most two blocks of groups times the versions
    per block pair, however many pairs there are. The blocks also hold ``ords, ns``.
    """
    if stored is None:
        return spark.createDataFrame([], SUMMARY)
    return stored.meet(_summary_kernel(threshold, stored.dims), SUMMARY)
