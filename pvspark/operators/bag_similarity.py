"""Exact cosine pairs of term-frequency vectors, by an inverted index of prefixes.

Words have one order for all bags. Let w be the first word in that order that
two bags share: their dot product is at most the product of the norms of what
each holds from w on. So a pair at or above ``t`` meets at a word from where
both still have norm ``t`` times their whole, which is a bag's *prefix*, and it
is enough to index prefixes. Words of a single bag come first: they match
nothing and only use up norm. The others are ordered by how many bags hold
them for the share of a squared norm they stand for, so few words, and ones
with short lists, make up a prefix.

The index is dealt to blocks of words twice. First a posting carries only its
norm left, the norms of hashed word groups (Cauchy-Schwarz) and the first words
of its prefix; it is kept if any other posting of its word may be similar by
these bounds and they share none of those words before. Then the bags
with kept postings go once to those blocks, and a task reads their whole vectors
from the files where they stand, written once. There each pair that passes the bounds gets its integer dot product, and counts only
at its first common word. So a pair comes up once, and no list of candidate
pairs is ever stored or joined: what moves grows with postings, not with pairs.
A word that holds more than a block is a block of its own, cut into parts, and
each two parts meet in a task.
"""

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pvspark.functions.stats import EXACT_SIMILARITY
from pvspark.operators.duplicates import NearDuplicates, own_summary, summary_of_links
from pvspark.operators.ranking import global_rank
from pvspark.operators.similarity import DEFAULT_THRESHOLD, SUMMARY, _small, _summary_rows
from pvspark.session import discard, materialize, release
from pvspark.sources.blocks import read_pieces, write_pieces

BLOCK_BYTES = 16 << 20  # packed vectors of one block
SHARED_WORDS = 500_000  # words, and
SHARED_BYTES = 16 << 20  # their bytes, up to which tasks look ranks up by themselves
_SLACK = 1e-9  # rounding of norms
_GROUPS = 64  # hashed word groups of the second bound
_FINE_BITS = 10  # of the word groups of the third bound, and
_FINE_CELLS = 1 << 23  # the most numbers a block keeps for it
_FULL = 65535  # a norm of 1 in 16 bits, rounded up
_HEADS = 16  # first ranks of a prefix that go with its postings
_PAIRS = 1 << 17  # pairs looked at together
_MASS = 10**6
_PARTS = ["part_a", "part_b", "part"]
_KEY = ["block", "part_a", "part_b"]
_SPREAD = 2654435761  # odd, below 2^32: ranks below 2^31 stay within a long

# ---- vectors ------------------------------------------------------------


def _list(offsets: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def bags_of(docs: DataFrame, file: str) -> DataFrame:
    """``file, gid, len2, bag_words, ns``: each document's distinct words with counts; narrow.

    ``gid`` is a digest of words and counts, so equal multisets have equal ones.
    """
    kind = dict(docs.dtypes)[file]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("words")
            row = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
            coded = lists.flatten().dictionary_encode()
            # codes in word order, so that equal bags are laid out alike
            order = pc.array_sort_indices(coded.dictionary)
            words = coded.dictionary.take(order).cast(pa.string())
            place = np.empty(len(words), np.int64)
            place[order.to_numpy()] = np.arange(len(words))
            width = max(len(words), 1)
            key, n = np.unique(row * width + place[coded.indices.to_numpy()], return_counts=True)
            ends = np.searchsorted(key, np.arange(batch.num_rows + 1) * width)
            squares = np.concatenate([[0], np.cumsum(n * n)])
            held = words.take(pa.array(key % width))
            data = held.buffers()[2].to_pybytes() if len(held) else b""
            at = np.frombuffer(held.buffers()[1], np.int32, len(held) + 1) if len(held) else np.zeros(1, np.int32)
            gids = []
            for a, b in zip(ends, ends[1:]):
                digest = hashlib.blake2b(data[at[a] : at[b]], digest_size=16)
                digest.update(np.diff(at[a : b + 1]).tobytes() + n[a:b].tobytes())
                gids.append(digest.digest())
            columns = [
                batch.column("file"),
                pa.array(gids, pa.binary()),
                pa.array(np.diff(squares[ends])),
                _list(ends, held),
                _list(ends, pa.array(n, pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["file", "gid", "len2", "bag_words", "ns"])

    schema = f"file {kind}, gid binary, len2 long, bag_words array<string>, ns array<long>"
    return docs.select(F.col(file).alias("file"), "words").mapInArrow(count, schema)


def _cells(counted: DataFrame, *carried: str) -> DataFrame:
    pairs = F.arrays_zip(F.col("bag_words").alias("word"), F.col("ns").alias("n"))
    return counted.select(*carried, "len2", F.inline(pairs)).toDF(*carried, "len2", "word", "n")


def word_costs(counted: DataFrame) -> DataFrame:
    """``word, cost`` of words that several bags hold: bags per share of squared norm."""
    # whole numbers, so that sums do not depend on their order
    share = F.floor(F.lit(float(_MASS)) * F.col("n") * F.col("n") / F.col("len2")).cast("long")
    known = _cells(counted).groupBy("word").agg(F.count("*").alias("bags"), F.sum(share).alias("mass"))
    bags = F.col("bags").cast("double")
    cost = bags * bags / (F.col("mass") + F.lit(1))
    return known.filter(F.col("bags") > 1).select("word", cost.alias("cost"))


def packed_vectors(counted: DataFrame, threshold: float) -> DataFrame:
    """``gid, copies, len2, vector, prefix, lefts, norms, heads``.

    ``vector`` packs ranks and counts in rank order; ``prefix`` and ``lefts`` are the
    ranks of the prefix and the norm from each on; ``norms`` bounds the word groups;
    ``heads`` packs the first ranks of the prefix.
    Bags without a shared word are left out: they are similar to no other. Tasks
    look up ranks in a word list of bounded size, or the words are joined.
    """
    spark = counted.sparkSession
    costs = materialize(word_costs(counted), "word-costs")
    words, size = costs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("word")), F.lit(0))).first()
    schema = (
        "gid binary, copies long, len2 long, vector binary, prefix array<int>, lefts array<double>, norms binary, heads binary"
    )
    if words <= SHARED_WORDS and size <= SHARED_BYTES:
        ordered = costs.toArrow().sort_by([("cost", "ascending"), ("word", "ascending")]).column("word")
        shared = spark.sparkContext.broadcast(ordered.combine_chunks().cast(pa.string()))

        def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = batch.column("bag_words")
                row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy())
                rank = pc.index_in(lists.flatten(), value_set=shared.value).fill_null(-1).to_numpy()
                order = np.lexsort((rank, row))
                order = order[rank[order] >= 0]
                ns = batch.column("ns").flatten().to_numpy()[order]
                at = np.searchsorted(row[order], np.arange(batch.num_rows + 1))
                yield from _packed(batch, at, rank[order], ns, threshold)

        discard(costs)
        return counted.select("gid", "copies", "len2", "bag_words", "ns").mapInArrow(look_up, schema)

    order = global_rank(costs, [F.col("cost"), F.col("word")]).select("word", F.col("rank").cast("int").alias("rank"))
    cell = F.struct("rank", "n")
    found = (
        _cells(counted, "gid", "copies")
        .join(order, "word")
        .groupBy("gid", "copies", "len2")
        .agg(F.sort_array(F.collect_list(cell)).alias("cells"))
        .select("gid", "copies", "len2", F.col("cells.rank").alias("ranks"), F.col("cells.n").alias("ns"))
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.concatenate([[0], np.cumsum(pc.list_value_length(batch.column("ranks")).to_numpy())])
            cells = [batch.column(c).flatten().to_numpy() for c in ("ranks", "ns")]
            yield from _packed(batch, at, *cells, threshold)

    return found.mapInArrow(pack, schema)


def _packed(batch: pa.RecordBatch, at: np.ndarray, rank: np.ndarray, n: np.ndarray, threshold: float):
    """Rows of ``packed_vectors`` from cells in rank order; ``at`` has the offsets of the bags."""
    some = np.flatnonzero(np.diff(at))
    if not len(some):
        return
    batch, at = batch.take(pa.array(some)), at[np.append(some, some[-1] + 1)]
    len2 = batch.column("len2").to_numpy()
    both = np.stack([rank, n], axis=1).astype("<u4")
    row = np.repeat(np.arange(len(some)), np.diff(at))
    left = np.sqrt(suffixes(n, at) / len2[row])
    inside = left * left >= threshold * threshold - _SLACK
    ends = np.concatenate([[0], np.cumsum(inside)])[at]
    norms = np.minimum(np.ceil(group_norms(row, rank, n, len2) * _FULL), _FULL).astype("<u2")
    held = np.repeat(np.arange(len(some)), np.diff(ends))
    place = np.arange(len(held)) - ends[held]
    heads = np.full((len(some), _HEADS), 0xFFFFFFFF, "<u4")
    heads[held[place < _HEADS], place[place < _HEADS]] = rank[inside][place < _HEADS]
    binary = lambda rows: pa.array([r.tobytes() for r in rows], pa.binary())
    columns = [
        *(batch.column(c) for c in ("gid", "copies", "len2")),
        binary(both[a:b] for a, b in zip(at, at[1:])),
        _list(ends, pa.array(rank[inside].astype(np.int32))),
        _list(ends, pa.array(left[inside])),
        binary(norms),
        binary(heads),
    ]
    names = ["gid", "copies", "len2", "vector", "prefix", "lefts", "norms", "heads"]
    yield pa.RecordBatch.from_arrays(columns, names=names)


def suffixes(n: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each cell the squared norm of its bag from there on."""
    squares = np.concatenate([[0], np.cumsum(n.astype(np.int64) ** 2)])
    return np.repeat(squares[at[1:]], np.diff(at)) - squares[:-1]


def group_norms(row: np.ndarray, rank: np.ndarray, n: np.ndarray, len2: np.ndarray, bits: int = 6) -> np.ndarray:
    """Norms of ``2**bits`` hashed word groups, as shares of the whole norm."""
    group = (rank.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)
    squares = np.bincount((row << bits) + group, n.astype(np.float64) ** 2, len(len2) << bits)
    return np.sqrt(squares.reshape(-1, 1 << bits) / len2[:, None])


# ---- meeting ------------------------------------------------------------


def _block_of(rank, blocks: int):
    """Block of an ordinary word, for columns and numpy arrays."""
    if isinstance(rank, np.ndarray):
        return (rank.astype(np.int64) * _SPREAD >> 16) % blocks
    return F.pmod(F.shiftright(rank.cast("long") * F.lit(_SPREAD), 16), F.lit(blocks)).cast("int")


def _postings(vectors: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    """``block, part_a, part_b, part, rank, left, gid, norms, heads`` and the number of blocks of ordinary words.

    ``block`` is the number of a block, or -1 - rank for a hot word, whose parts
    meet two by two; ``part`` is the part a posting is in.
    """
    cells = F.arrays_zip(F.col("prefix").alias("rank"), F.col("lefts").alias("left"))
    postings = vectors.select("gid", "norms", "heads", "bytes", F.inline(cells))
    postings = postings.toDF("gid", "norms", "heads", "bytes", "rank", "left")
    lists = materialize(postings.groupBy("rank").agg(F.sum("bytes").alias("bytes")), "lists")
    total, heaviest = lists.agg(F.sum("bytes"), F.max("bytes")).first()
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    blocks = max(cores, math.ceil((total or 0) / block_bytes))
    zero = F.lit(0)
    own = [_block_of(F.col("rank"), blocks).alias("block"), *[zero.alias(c) for c in _PARTS]]
    rest = ["rank", "left", "gid", "norms", "heads"]
    if not total or heaviest <= block_bytes:
        return postings.select(*own, *rest), blocks
    parts = F.ceil(F.col("bytes") * 2 / F.lit(block_bytes)).cast("int")
    hot = lists.filter(F.col("bytes") > block_bytes).select("rank", parts.alias("parts"))
    placed = postings.drop("bytes").join(_small(hot), "rank", "left")
    plain = placed.filter(F.col("parts").isNull()).select(*own, *rest)
    crowded = (
        placed.filter(F.col("parts").isNotNull())
        .withColumn("part", F.pmod(F.xxhash64("gid"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(zero, F.col("parts") - 1)))
        .select(
            (-1 - F.col("rank")).alias("block"),
            F.least("part", "other").alias("part_a"),
            F.greatest("part", "other").alias("part_b"),
            "part",
            *rest,
        )
    )
    return plain.unionByName(crowded), blocks


def _met(
    word: np.ndarray, left: np.ndarray, norms: np.ndarray, owner: np.ndarray, part: np.ndarray | None, threshold: float
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of postings of one word that the bounds let through.

    ``norms`` and ``part`` are by owner. With ``part`` only pairs of two parts count:
    those inside one part belong to the task where it meets itself.
    """
    order = np.lexsort((-left, word))
    word, left = word[order], left[order]
    offsets = np.append(np.flatnonzero(np.diff(word, prepend=-1)), len(word))
    # partners stand behind, and end where the product of the norms left gets too small
    stop = np.empty(len(word), np.int64)
    for a, b in zip(offsets, offsets[1:]):
        stop[a:b] = a + np.searchsorted(-left[a:b], (_SLACK - threshold) / left[a:b], "right")
    number = np.maximum(stop - np.arange(len(word)) - 1, 0)
    sums = np.concatenate([[0], np.cumsum(number)])
    k = 0
    while k < len(word):
        to = max(k + 1, int(np.searchsorted(sums, sums[k] + _PAIRS, "right")) - 1)
        for low in range(0, max(1, int(number[k])) if to == k + 1 else 1, _PAIRS):
            # a posting with very many partners is taken in pieces
            count = np.minimum(number[k:to] - low, _PAIRS) if to == k + 1 else number[k:to]
            first = np.repeat(np.arange(k, to), count)
            begin = np.concatenate([[0], np.cumsum(count)[:-1]])
            second = first + 1 + low + np.arange(len(first)) - np.repeat(begin, count)
            i, j = order[first], order[second]
            x, y = owner[i], owner[j]
            if part is not None:
                keep = part[x] != part[y]
                i, j, x, y = i[keep], j[keep], x[keep], y[keep]
            bound = np.einsum("ij,ij->i", norms[x], norms[y])
            keep = bound >= threshold - 1e-5
            if keep.any():
                yield i[keep], j[keep]
        k = to


def _norms_of(table: pa.Table) -> np.ndarray:
    packed = np.frombuffer(b"".join(table.column("norms").to_pylist()), "<u2")
    return packed.reshape(-1, _GROUPS).astype(np.float32) / np.float32(_FULL)


def _task(batches: Iterator[pa.RecordBatch]) -> tuple[pa.Table, int, np.ndarray | None]:
    """The rows of a block, its number, and the parts if two of them meet."""
    table = pa.Table.from_batches(list(batches))
    number, part_a, part_b = (table.column(c)[0].as_py() for c in _KEY)
    return table, number, table.column("part").to_numpy() if part_a != part_b else None


def _met_before(a: np.ndarray, b: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Pairs that share one of their first prefix words before ``word``.

    Such a pair counts there and not here. A pair that meets before in a later
    word of its prefixes is not seen, and is only looked at once more.
    """
    before = (a[:, 0] == b[:, 0]) & (a[:, 0] < word)
    rest = np.flatnonzero(~before)
    for s in range(0, len(rest), 1 << 12):
        k = rest[s : s + (1 << 12)]
        equal = (a[k][:, :, None] == b[k][:, None, :]) & (a[k] < word[k][:, None])[:, :, None]
        before[k] = equal.any(axis=(1, 2))
    return before


def _kept(threshold: float):
    """Bags of a block that may have a partner there, met for the first time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, _, part = _task(batches)
        kept = np.zeros(len(table), bool)
        owner = np.arange(len(table))
        word, left = (table.column(c).to_numpy() for c in ("rank", "left"))
        heads = np.frombuffer(b"".join(table.column("heads").to_pylist()), "<u4").reshape(-1, _HEADS).astype(np.int64)
        for i, j in _met(word, left, _norms_of(table), owner, part, threshold):
            new = ~_met_before(heads[i], heads[j], word[i])
            kept[i[new]] = kept[j[new]] = True
        gid = table.column("gid").combine_chunks().dictionary_encode()
        _, first = np.unique(gid.indices.to_numpy()[kept], return_index=True)
        rows = pa.array(np.flatnonzero(kept)[first])
        names = ["gid", "block", *_PARTS]
        yield pa.RecordBatch.from_arrays([table.column(c).combine_chunks().take(rows) for c in names], names=names)

    return run


class _Block:
    """The vectors of one block, flat."""

    def __init__(self, table: pa.Table, threshold: float):
        self.threshold = threshold
        cells = np.frombuffer(b"".join(read_pieces(table)), "<u4").reshape(-1, 2)
        self.at = np.concatenate([[0], np.cumsum(table.column("bytes").to_numpy() // 8)]).astype(np.int64)
        self.rank, self.n = cells[:, 0].astype(np.int64), cells[:, 1].astype(np.int64)
        self.len2 = table.column("len2").to_numpy()
        self.row = np.repeat(np.arange(len(table)), np.diff(self.at))
        self.norms = _norms_of(table)
        # as many groups as the block has room for: nearly a word each, where rows are few
        room = _FINE_CELLS // max(len(table), 1)
        self.bits = min(_FINE_BITS, max(6, room.bit_length() - 1))
        # the first ranks of each row; behind its end stands more than any rank
        place = np.arange(len(self.rank)) - self.at[self.row]
        some = place < _HEADS
        self.heads = np.full((len(table), _HEADS), np.iinfo(np.int64).max)
        self.heads[self.row[some], place[some]] = self.rank[some]

    @cached_property
    def fine(self) -> np.ndarray:
        return group_norms(self.row, self.rank, self.n, self.len2, self.bits).astype(np.float32)

    def _may(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Pairs that the norms of the finer groups let through."""
        may = np.zeros(len(x), bool)
        step = max(1, (1 << 18) >> self.bits)
        for s in range(0, len(x), step):
            bound = np.einsum("ij,ij->i", self.fine[x[s : s + step]], self.fine[y[s : s + step]])
            may[s : s + step] = bound >= self.threshold - 1e-5
        return may

    def pairs(self, mine: np.ndarray, part: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows and cosines of the pairs whose first common word is one of the block's (``mine``).

        Near copies meet at nearly every word of their prefixes: only where they share none
        of their first words before, and finer groups of words leave it open whether they are
        similar, their cells are read.
        """
        left = np.sqrt(suffixes(self.n, self.at) / self.len2[self.row])
        cells = np.flatnonzero(mine & (left * left >= self.threshold * self.threshold - _SLACK))
        for i, j in _met(self.rank[cells], left[cells], self.norms, self.row[cells], part, self.threshold):
            a, b = cells[i], cells[j]
            new = ~_met_before(self.heads[self.row[a]], self.heads[self.row[b]], self.rank[a])
            a, b = a[new], b[new]
            may = self._may(self.row[a], self.row[b])
            a_new, b_new = a[may], b[may]
            for s in range(0, len(a_new), 1 << 9):
                a, b = a_new[s : s + (1 << 9)], b_new[s : s + (1 << 9)]
                x, y = self.row[a], self.row[b]
                dot, first = self._dots(x, y)
                cosine = dot / np.sqrt(self.len2[x].astype(np.float64) * self.len2[y])
                hit = (cosine >= self.threshold) & (first == self.rank[a])
                if hit.any():
                    yield x[hit], y[hit], cosine[hit]

    def _dots(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Integer dot products and first common words; the pairs' cells are laid side by side."""
        pair, sizes = np.arange(len(x)), np.diff(self.at)

        def cells(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            size = sizes[rows]
            of = np.repeat(pair, size)
            return of, np.arange(len(of)) + (self.at[rows] - np.cumsum(size) + size)[of]

        (of_x, cell_x), (of_y, cell_y) = cells(x), cells(y)
        width = int(self.rank.max()) + 1
        # both key lists ascend, so they are matched by one binary search
        key_x, key_y = of_x * width + self.rank[cell_x], of_y * width + self.rank[cell_y]
        found = np.minimum(np.searchsorted(key_x, key_y), len(key_x) - 1)
        same = key_x[found] == key_y
        product = self.n[cell_x[found]] * self.n[cell_y] * same
        dot = np.add.reduceat(product, np.searchsorted(of_y, pair))
        first = np.full(len(x), -1, np.int64)
        hits = np.flatnonzero(same)[::-1]
        first[of_y[hits]] = self.rank[cell_y[hits]]
        return dot, first


def _kernel(threshold: float, blocks: int, summary: bool):
    """Pairs of one block, or what a report needs of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, number, part = _task(batches)
        block = _Block(table, threshold)
        mine = _block_of(block.rank, blocks) == number if number >= 0 else block.rank == -1 - number
        gid, copies = table.column("gid").combine_chunks(), table.column("copies").to_numpy()
        seen, files, exact = np.zeros(len(table), bool), 0, 0
        for x, y, cosine in block.pairs(mine, part):
            if summary:
                seen[x] = seen[y] = True
                both = copies[x] * copies[y]
                files, exact = files + int(both.sum()), exact + int(both[cosine >= EXACT_SIMILARITY].sum())
            else:
                columns = [gid.take(pa.array(x)), gid.take(pa.array(y)), pa.array(cosine)]
                yield pa.RecordBatch.from_arrays(columns, names=["gid_a", "gid_b", "similarity"])
        if files:
            some = gid.filter(pa.array(seen))
            yield _summary_rows(len(some), gid=some, side=np.zeros(len(some), int), ord=np.zeros(len(some), int))
            numbers = {"within": files, "earlier": 0, "consecutive": 0, "exact": exact, "consecutive_exact": 0}
            yield _summary_rows(1, ord=[0], **{k: [v] for k, v in numbers.items()})

    return run


@dataclass
class BagDuplicates(NearDuplicates):
    """Near-duplicates whose vectors are bags; pairs come from the index, not from blocks of dense vectors."""

    vectors: DataFrame | None = None  # of packed_vectors, with the places of the vectors
    block_bytes: int = BLOCK_BYTES

    @cached_property
    def _sent(self) -> tuple[DataFrame, int]:
        """Places of the vectors at the blocks where they may have a partner, and the number of blocks."""
        postings, blocks = _postings(self.vectors, self.block_bytes)
        kept = postings.groupBy(*_KEY).applyInArrow(
            _kept(self.threshold), "gid binary, block int, part_a int, part_b int, part int"
        )
        # a bag's blocks are a short list: it is joined once, not word by word
        places = kept.groupBy("gid").agg(F.collect_list(F.struct("block", *_PARTS)).alias("places"))
        places = materialize(places, "places")
        release(places.sparkSession)
        carried = ["gid", "copies", "len2", "norms", "file", "at", "bytes"]
        sent = self.vectors.select(*carried).join(places, "gid")
        return sent.select(F.inline("places"), *carried), blocks

    def _similar(self, summary: bool) -> DataFrame:
        sent, blocks = self._sent
        schema = SUMMARY if summary else "gid_a binary, gid_b binary, similarity double"
        # small rows stand for much work: tasks are not to be merged by their bytes
        sent = sent.repartition(blocks, *_KEY)
        return sent.groupBy(*_KEY).applyInArrow(_kernel(self.threshold, blocks, summary), schema)

    def _inside(self) -> DataFrame:
        """Copy groups of several files: their members are pairs."""
        return self.groups.filter((F.col("copies") > 1) & F.lit(self.threshold <= 1.0))

    @cached_property
    def links(self) -> DataFrame:
        own = self._inside().select(F.col("gid").alias("gid_a"), F.col("gid").alias("gid_b"), F.lit(1.0))
        return materialize(self._similar(False).unionAll(own), "bag-links")

    @cached_property
    def summary(self) -> DataFrame:
        if "links" in self.__dict__:
            return materialize(summary_of_links(self.links, self.groups), "bag-summary")
        own = self._inside().select("gid", "side", "ords", "ns", F.lit(1.0).alias("similarity"))
        return materialize(self._similar(True).unionByName(own_summary(own)), "bag-summary")


def bag_duplicates(
    docs: DataFrame, threshold: float = DEFAULT_THRESHOLD, file: str = "tag", block_bytes: int = BLOCK_BYTES
) -> BagDuplicates:
    """Near-duplicates of ``docs`` (``tag, words``) by word counts.

    Documents with the same multiset of words form one copy group; one without
    words is similar to nothing.
    """
    if threshold <= 0:
        raise ValueError("bags without a common word have similarity 0: the threshold must be above it")
    wide = {"compression": "zstd"}
    bags = materialize(bags_of(docs, file).withColumn("uid", F.monotonically_increasing_id()), "bags", **wide)
    zero = F.lit(0)
    members = materialize(
        bags.select("file", F.col("file").alias("pos"), zero.alias("ord"), zero.alias("side"), "gid", "uid"), "bag-members"
    )
    first = [F.first(c).alias(c) for c in ("len2", "bag_words", "ns")]
    groups = bags.filter(F.col("len2") > 0).groupBy("gid").agg(F.count("*").alias("copies"), *first)
    counted = materialize(groups, "distinct-bags", **wide)
    release(counted.sparkSession)
    vectors = write_pieces(packed_vectors(counted, threshold), "vector", "bag-vectors")
    sizes = counted.select(
        zero.alias("side"), "gid", "copies", F.array(zero).alias("ords"), F.array("copies").alias("ns")
    )
    sizes = materialize(sizes, "bag-sizes")
    discard(bags, counted)  # what follows reads the narrow tables and the packed vectors
    release(docs.sparkSession)
    return BagDuplicates(
        members=members,
        groups=sizes,
        threshold=threshold,
        vectors=vectors,
        block_bytes=block_bytes,
    )
