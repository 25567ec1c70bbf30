"""Language-model scoring from a log-frequency Bloom filter.

Training tokens (words of ``words``, and one end per document) and bigrams are
counted by Spark over all training documents. A count ``n`` is quantised to the
level ``1 + floor(log2 n)``; the filter holds a gram once for every level up to
its own, so a reader probes level after level until one is missing. All words
and all bigrams are kept, from one occurrence on.

The filter is cut into segments by the gram's hash and is never in one place.
Counts come together by buckets of whole segments, packed as steps between sorted
hashes (48 bits go into the filter) and counts, so a task sets the bits of its segments without another shuffle. Its size
follows the number of insertions at ``bits_per_entry`` without a bound: beyond
``max_bits`` for ``SEGMENTS`` segments there are more segments, not larger ones. To
score, texts are written as blocks of some 4 MB; the distinct grams of a block are
dealt to the tasks that hold their segments and never written as a table, and the
levels found go back to the block. All sizes go this way.

A bigram's probability is its quantised count smoothed with the unigram
probability (Dirichlet prior ``prior``); a text's score is the sum of log10.

The base score needs exact counts: the ``frequent`` most frequent tokens (a
fixed bound) go out as a sorted array; all others are joined by Spark, row by
row of a document, so the counts of rare words are never in one place.

Results: one row per input row. Null and empty texts consist of the end alone.
Without training rows every count is 0 and both scores are 0. A null id counts
as not held out. Repeated rows train as often as they occur and each give their
own row; extra columns are ignored.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pvspark.llm.common import drop, pieces, store
from pvspark.llm.words import mix, word_hashes
from pvspark.session import bounded_batches, release

END = np.uint64(0x5BF0_3635_D1E6_A1F3)
START = np.uint64(0x27D4_EB2F_1656_67C5)
SEGMENTS = 256
KEY = ~np.uint64(0xFFFF)  # bits of a hash that the filter goes by
HELD = 16  # neighbouring segments that a task has at once to look levels up


@dataclass(frozen=True)
class Params:
    bits_per_entry: int = 10
    probes: int = 3
    min_bits: int = 1 << 20
    max_bits: int = 1 << 30  # of SEGMENTS segments: 512 KB each
    frequent: int = 1 << 18
    prior: float = 200.0
    gather: int = 1 << 20  # tokens counted at once by a task; a block has so many times 4 bytes of text
    bucket_bytes: int = 16 << 20  # of text whose counts come together in one place


def _tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each text closed by its end, and their offsets."""
    hashed, cut = word_hashes(data, at)
    n = np.diff(cut) + 1
    ends = np.concatenate([[0], np.cumsum(n)])
    out = np.empty(ends[-1], np.uint64)
    last = np.zeros(len(out), bool)
    last[ends[1:] - 1] = True
    out[last] = END
    out[~last] = hashed
    return out, ends


def _bigrams(tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The hash of each token with the one before it; the first follows the start."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[at[:-1]] = START
    return mix(before * np.uint64(3) + mix(tokens)) & KEY


def _as_long(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


_PACKED = "bucket int, wh binary, wn binary, ph binary, pn binary"


def _narrow(v: np.ndarray) -> bytes:
    """Unsigned numbers in as few bytes each as the largest needs, that number in front."""
    width = max(1, (int(v.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + v.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _wide(data) -> np.ndarray:
    data = np.frombuffer(data, np.uint8)
    width = int(data[0])
    out = np.zeros(((len(data) - 1) // width, 8), np.uint8)
    out[:, :width] = data[1:].reshape(-1, width)
    return out.view(np.uint64).ravel()


def _pack(keys: np.ndarray) -> bytes:
    """Ascending keys as the first and the steps to the next: about 4 bytes a key."""
    keys = keys >> np.uint64(16)
    return keys[:1].tobytes() + _narrow(np.diff(keys))


def _unpack(data) -> np.ndarray:
    first = np.frombuffer(data, np.uint64, min(1, len(data) // 8))
    if not len(first):
        return first
    return np.cumsum(np.concatenate([first, _wide(memoryview(data)[8:])]), dtype=np.uint64) << np.uint64(16)


def _summed(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes ascending and the sums of their counts."""
    order = np.argsort(h)
    h, n = h[order], n[order]
    new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])[: len(h)])
    return h[new], np.add.reduceat(n, new) if len(new) else n


def _words_and_pairs(wh, wn, ph, pn):
    return np.frombuffer(wh, np.uint64), _wide(wn), _unpack(ph), _wide(pn)


def _merged_buckets(packed: DataFrame) -> DataFrame:
    """One row a bucket from rows of packed hashes and counts, and ``inserted``, the sum of its grams' levels."""

    def merge(table: pa.Table) -> pa.Table:
        rows = zip(*(table.column(c).to_pylist() for c in ("wh", "wn", "ph", "pn")))
        wh, wn, ph, pn = (np.concatenate(v) for v in zip(*(_words_and_pairs(*row) for row in rows)))
        (wh, wn), (ph, pn) = _summed(wh, wn), _summed(ph, pn)
        made = [wh.tobytes(), _narrow(wn), _pack(ph), _narrow(pn)]
        inserted = int(_levels_of(wn).sum() + _levels_of(pn).sum())
        columns = [table.column("bucket")[:1], *(pa.array([x], pa.binary()) for x in made), pa.array([inserted], pa.int64())]
        return pa.table(columns, ["bucket", "wh", "wn", "ph", "pn", "inserted"])

    return packed.groupBy("bucket").applyInArrow(merge, f"{_PACKED}, inserted long")


def _cut(h: np.ndarray, segments: int) -> np.ndarray:
    """Where the segments of ascending hashes begin and end."""
    return np.searchsorted(_segment(h, segments), np.arange(segments + 1))


def packed_counts(train: DataFrame, p: Params, buckets: int) -> DataFrame:
    """Counts of all words (``wh, wn``) and bigrams (``ph, pn``), one row a bucket of the hash space.

    A bucket is ``_segment(h, buckets)``, so it holds whole segments of any filter of so many or more.
    """
    most = p.gather

    def counted(words: list[np.ndarray], pairs: list[np.ndarray]):
        w, p = (np.unique(np.concatenate(x), return_counts=True) for x in (words, pairs))
        at, to = _cut(w[0], buckets), _cut(p[0], buckets)
        rows = []
        for k in range(buckets):
            a, b = slice(at[k], at[k + 1]), slice(to[k], to[k + 1])
            if a.start < a.stop or b.start < b.stop:
                rows.append((k, w[0][a].tobytes(), _narrow(w[1][a]), _pack(p[0][b]), _narrow(p[1][b])))
        kinds = [pa.int32(), *[pa.binary()] * 4]
        columns = [pa.array(list(c), kind) for c, kind in zip(zip(*rows), kinds)]
        return pa.RecordBatch.from_arrays(columns, ["bucket", "wh", "wn", "ph", "pn"])

    def local(batches):
        words, pairs, size = [], [], 0
        for batch in batches:
            for _, data, at in pieces(batch.column(0)):
                tokens, ends = _tokens(data, at)
                words.append(tokens)
                pairs.append(_bigrams(tokens, ends))
                size += len(tokens)
                if size >= most:
                    yield counted(words, pairs)
                    words, pairs, size = [], [], 0
        if size:
            yield counted(words, pairs)

    return _merged_buckets(train.select("text").mapInArrow(local, _PACKED))


def _unpacked(packed: DataFrame, kinds: tuple[str, ...] = ("w", "p")) -> DataFrame:
    """``kind`` (1 word, 2 bigram), ``h``, ``n``."""
    numbers = {"w": 1, "p": 2}

    def run(batches):
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(4))):
                wh, wn, ph, pn = _words_and_pairs(*row)
                for kind in kinds:
                    h, n = (wh, wn) if kind == "w" else (ph, pn)
                    for k in range(0, len(h), 200_000):
                        part = h[k : k + 200_000]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(part), numbers[kind], np.int8)), _as_long(part), _as_long(n[k : k + 200_000])],
                            ["kind", "h", "n"],
                        )

    return packed.select("wh", "wn", "ph", "pn").mapInArrow(run, "kind byte, h long, n long")


def count_grams(train: DataFrame, p: Params) -> DataFrame:
    """``kind`` (1 word, 2 bigram), ``h``, ``n`` over all rows."""
    return _unpacked(packed_counts(train, p, SEGMENTS))


def _buckets(train: DataFrame, p: Params) -> int:
    """So many buckets that each has the grams of about ``bucket_bytes`` of text."""
    size, buckets = train.agg(F.sum(F.octet_length("text"))).first()[0] or 0, SEGMENTS
    while size > buckets * p.bucket_bytes:
        buckets *= 2
    return buckets


def _level(n: Column) -> Column:
    """1 + floor(log2 n), from the number of binary digits: exact for every long."""
    return F.length(F.bin(n)).cast("long")


def _levels_of(n: np.ndarray) -> np.ndarray:
    return np.frexp(n.astype(np.float64))[1]


def _size(inserted: int, p: Params, least: int = 1) -> tuple[int, int]:
    """Bits of ``SEGMENTS`` segments, at most ``max_bits``, and how many times so many segments there are."""
    bits, parts = p.min_bits, least
    while bits * parts < inserted * p.bits_per_entry:
        if bits * 2 <= p.max_bits:
            bits *= 2
        else:
            parts *= 2
    return bits, parts


def _choose_size(counts: DataFrame, p: Params) -> tuple[int, int]:
    rows = counts.groupBy(_level(F.col("n")).alias("level")).count().collect()
    return _size(sum(r["level"] * r["count"] for r in rows), p)


def _places(h: np.ndarray, level: int, bits: int, probes: int):
    """Per probe, the bit of each gram's level in its segment."""
    inside = np.uint64(bits // SEGMENTS - 1)
    mixed = mix(h + np.uint64(level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    step = (mixed >> np.uint64(32)) | np.uint64(1)
    for k in range(probes):
        yield (mixed + step * np.uint64(k)) & inside


def _segment(h: np.ndarray, segments: int = SEGMENTS) -> np.ndarray:
    """The first bits of a hash, so a segment is a range of hashes."""
    return (h >> np.uint64(65 - segments.bit_length())).astype(np.int64)


def filter_segments(packed: DataFrame, bits: int, parts: int, p: Params) -> DataFrame:
    """The filter as rows ``segment, bits``; segments that hold nothing are left out.

    A bucket has all grams of its segments, so nothing is shuffled.
    """
    probes, size, segments = p.probes, bits // SEGMENTS, SEGMENTS * parts

    def fill(batches):
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(4))):
                wh, wn, ph, pn = _words_and_pairs(*row)
                h, level = np.concatenate([wh & KEY, ph]), _levels_of(np.concatenate([wn, pn]))
                order = np.argsort(h)
                h, level = h[order], level[order]
                seg = _segment(h, segments)
                cuts = [0, *(np.flatnonzero(np.diff(seg)) + 1), len(seg)]
                for a, e in zip(cuts[:-1], cuts[1:]):
                    flat = np.zeros(size, bool)
                    for j in range(1, int(level[a:e].max(initial=0)) + 1):
                        for bit in _places(h[a:e][level[a:e] >= j], j, bits, probes):
                            flat[bit.astype(np.int64)] = True
                    if a < e:
                        made = np.packbits(flat, bitorder="little").tobytes()
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([int(seg[a])], pa.int32()), pa.array([made], pa.binary())], ["segment", "bits"]
                        )

    return packed.select("wh", "wn", "ph", "pn").mapInArrow(fill, "segment int, bits binary")


def _packed(counts: DataFrame) -> DataFrame:
    """Rows ``kind, h, n`` as ``packed_counts`` has them."""

    def run(batches):
        for batch in batches:
            kind, h, n = (batch.column(batch.schema.names.index(c)).to_numpy() for c in ("kind", "h", "n"))
            h, bucket = h.view(np.uint64), _segment(h.view(np.uint64))
            for b in np.unique(bucket):
                w, p = (np.flatnonzero((kind == k) & (bucket == b)) for k in (1, 2))
                p = p[np.argsort(h[p])]
                made = [h[w].tobytes(), _narrow(n[w]), _pack(h[p]), _narrow(n[p])]
                columns = [pa.array([b], pa.int32()), *(pa.array([x], pa.binary()) for x in made)]
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "wh", "wn", "ph", "pn"])

    return _merged_buckets(counts.mapInArrow(run, _PACKED))


def build_filter(counts: DataFrame, bits: int, parts: int, p: Params) -> np.ndarray:
    """The whole filter as bytes in one place; only for small ones."""
    size = bits // SEGMENTS // 8
    out = np.zeros(bits // 8 * parts, np.uint8)
    for r in filter_segments(_packed(counts), bits, parts, p).toLocalIterator():
        out[r["segment"] * size : (r["segment"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return out


def levels(h: np.ndarray, flat: np.ndarray, probes: int, held: int = SEGMENTS, segments: int = SEGMENTS) -> np.ndarray:
    """The level each gram has in the ``held`` segments of ``flat``, of ``segments`` in all; 0 if it is missing."""
    size = len(flat) * 8 // held
    base = _segment(h, segments) % held * size
    h = h & KEY
    out = np.zeros(len(h), np.int64)
    alive = np.arange(len(h))
    for j in range(1, 65):
        there = np.ones(len(alive), bool)
        for bit in _places(h[alive], j, size * SEGMENTS, probes):
            at = base[alive] + bit.astype(np.int64)
            there &= (flat[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
        alive = alive[there]
        if not len(alive):
            break
        out[alive] = j
    return out


def _distinct(tokens: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of words and bigrams ascending, and the place of each occurrence among them."""
    keys = np.concatenate([tokens & KEY, pairs])
    order = np.argsort(keys)
    keys = keys[order]
    new = np.concatenate([[True], keys[1:] != keys[:-1]])
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new) - 1
    return keys[new], place


def _text_blocks(docs: DataFrame, p: Params) -> DataFrame:
    """``block, rows``: the rows of ``docs`` packed (Arrow, zstd) by some 4 MB, which no reader splits."""
    most = 4 * p.gather

    def run(batches):
        block, parts, size = TaskContext.get().partitionId() << 33, [], 0

        def made():
            out = pa.BufferOutputStream()
            table = pa.Table.from_batches(parts).combine_chunks()
            with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_table(table)
            rows = pa.array([out.getvalue().to_pybytes()], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([block]), rows], ["block", "rows"])

        for batch in batches:
            for row, data, at in pieces(batch.column(1)):
                parts.append(batch.slice(row, len(at) - 1))
                size += len(data) + 4 * (len(at) - 1)
                if size >= most:
                    yield made()
                    block, parts, size = block + 1, [], 0
        if parts:
            yield made()

    return docs.mapInArrow(run, "block long, rows binary")


def _rows(packed) -> tuple[pa.Array, pa.Array]:
    """Ids and texts of a block."""
    table = pa.ipc.open_stream(packed).read_all().combine_chunks()
    whole = lambda c: c.chunk(0) if isinstance(c, pa.ChunkedArray) else c
    return whole(table.column(0)), whole(table.column(1))


def _split(texts: pa.Array):
    """Of one block: per piece of its texts the first row, tokens, their offsets and bigrams."""
    for row, data, at in pieces(texts):
        tokens, ends = _tokens(data, at)
        yield row, tokens, ends, _bigrams(tokens, ends)


def _ask(blocks: DataFrame, segments: int) -> DataFrame:
    """``block, bucket, grams``: of each block the distinct grams, by the bucket of the filter."""

    def run(batches):
        for batch in batches:
            for block, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                split = list(_split(_rows(packed.as_buffer())[1]))
                grams = np.sort(np.concatenate([t[1] & KEY for t in split] + [t[3] for t in split]))
                grams = grams[np.concatenate([[True], grams[1:] != grams[:-1]])]
                cut = _cut(grams, segments // HELD)
                some = np.flatnonzero(np.diff(cut)).tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(some), block)),
                        pa.array(np.array(some, np.int32)),
                        pa.array([_pack(grams[cut[k] : cut[k + 1]]) for k in some], pa.binary()),
                    ],
                    ["block", "bucket", "grams"],
                )

    return blocks.mapInArrow(run, "block long, bucket int, grams binary")


def _answer(asked: DataFrame, segments: DataFrame, bits: int, parts: int, p: Params) -> DataFrame:
    """``block, bucket, levels``, a byte for each gram asked; a task has one bucket of the filter at a time."""
    probes, size = p.probes, bits // SEGMENTS // 8

    def run(batches):
        here, flat = -1, None
        for batch in batches:
            block, bucket, segment = (batch.column(k).to_pylist() for k in range(3))
            out = []
            for k, data in enumerate(batch.column(3)):
                if bucket[k] != here:
                    here, flat = bucket[k], np.zeros(size * HELD, np.uint8)
                if segment[k] is not None:
                    at = segment[k] % HELD * size
                    flat[at : at + size] = np.frombuffer(data.as_buffer(), np.uint8)
                else:
                    found = levels(_unpack(data.as_buffer()), flat, probes, HELD, SEGMENTS * parts)
                    out.append((block[k], here, found.astype(np.uint8).tobytes()))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in out], pa.int64()),
                    pa.array([r[1] for r in out], pa.int32()),
                    pa.array([r[2] for r in out], pa.binary()),
                ],
                ["block", "bucket", "levels"],
            )

    held = segments.select(
        F.lit(-1).cast("long").alias("block"),
        F.floor(F.col("segment") / HELD).cast("int").alias("bucket"),
        "segment",
        F.col("bits").alias("data"),
    )
    grams = asked.select("block", "bucket", F.lit(None).cast("int").alias("segment"), F.col("grams").alias("data"))
    return (
        held.unionByName(grams)
        .repartition(SEGMENTS // HELD * parts, "bucket")
        .sortWithinPartitions("bucket", "block")
        .mapInArrow(run, "block long, bucket int, levels binary")
    )


def _blocks(batches):
    """Per block, from rows sorted by block: its packed rows and the levels in order of buckets."""
    here, rows, found = None, None, []
    for batch in batches:
        for block, packed, levels in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
            if block != here:
                if here is not None:
                    yield rows, np.concatenate(found)
                here, found = block, []
            # copies, so that the batch is not kept
            if packed.is_valid:
                rows = packed.as_py()
            else:
                found.append(np.frombuffer(levels.as_buffer(), np.uint8).copy())
    if here is not None:
        yield rows, np.concatenate(found)


#: A count known by its level only: the middle of the level on a log scale.
TYPICAL = np.concatenate([[0.0], np.sqrt(2.0 ** np.arange(64) * np.maximum(2.0 ** np.arange(1, 65) - 1, 1))])


def _log_prob(tokens, at, level, start: int, pair, n: float, v: float, p: Params) -> np.ndarray:
    """log10 P(token | token before) of every token, from the levels of tokens, of the end and of bigrams."""
    word = TYPICAL[level]
    before = np.empty_like(word)
    before[1:] = word[:-1]
    before[at[:-1]] = TYPICAL[start]  # a start for every end
    pair = np.minimum(TYPICAL[pair], before)
    unigram = (word + 1) / (n + v + 1)
    return np.log10((pair + p.prior * np.minimum(unigram, 1)) / (before + p.prior))


@dataclass(frozen=True)
class Model:
    segments: DataFrame  # the filter: ``segment, bits``
    bits: int
    parts: int
    words: np.ndarray
    counts: np.ndarray
    total: int
    types: int


def train(docs: DataFrame, learn: Column, p: Params = Params()) -> tuple[Model, DataFrame]:
    """The model, and the table ``h, n`` of the words that are not in it exactly."""
    spark: SparkSession = docs.sparkSession
    bounded_batches(spark)
    rows = docs.filter(learn)
    buckets = _buckets(rows, p)
    packed, packed_at = store(packed_counts(rows, p, buckets), "gram-counts")
    release(spark)  # a gram's counts are on disk once
    words, _ = store(_unpacked(packed, ("w",)).select("h", "n"), "word-counts")
    total, types = words.agg(F.sum("n"), F.count("*")).first()
    bits, parts = _size(packed.agg(F.sum("inserted")).first()[0] or 0, p, buckets // SEGMENTS)
    segments, _ = store(filter_segments(packed, bits, parts, p), "gram-filter")
    drop(spark, packed_at)
    by_level = {r["level"]: r["count"] for r in words.groupBy(_level(F.col("n")).alias("level")).count().collect()}
    cut, some = 64, 0
    while cut > 0 and some + by_level.get(cut, 0) <= p.frequent:
        some += by_level.get(cut, 0)
        cut -= 1
    often = words.filter(_level(F.col("n")) > cut).select("h", "n").toArrow()
    h = often.column("h").to_numpy().view(np.uint64)
    order = np.argsort(h)
    model = Model(segments, bits, parts, h[order], often.column("n").to_numpy()[order], int(total or 0), int(types or 0))
    return model, words.filter(_level(F.col("n")) <= cut).select("h", "n")


def score(docs: DataFrame, model: Model, rare: DataFrame, p: Params = Params()) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score``."""
    spark = docs.sparkSession
    bounded_batches(spark)
    total, types, segments = model.total, model.types, SEGMENTS * model.parts
    sent = spark.sparkContext.broadcast((model.words, model.counts))
    chosen = docs.select("doc_id", "text")
    kind = dict(chosen.dtypes)["doc_id"]
    # the numbers of blocks are fixed once written
    blocks, blocks_at = store(_text_blocks(chosen, p), "text-blocks")
    found, found_at = store(_answer(_ask(blocks, segments), model.segments, model.bits, model.parts, p), "gram-levels")
    release(spark)  # the questions
    both = (
        blocks.withColumn("bucket", F.lit(None).cast("int"))
        .unionByName(found, allowMissingColumns=True)
        .select("block", "bucket", "rows", "levels")
        .repartition("block")
        .sortWithinPartitions("block", "bucket")
    )

    def run(batches):
        words, counts = sent.value
        for packed, level in _blocks(batches):
            ids, texts = _rows(packed)
            split = list(_split(texts))
            grams, place = _distinct(np.concatenate([t[1] for t in split]), np.concatenate([t[3] for t in split]))
            start, done = int(level[np.searchsorted(grams, END & KEY)]), 0
            for row, tokens, ends, pairs in split:
                first, half = ends[:-1], len(place) // 2
                of, pair = (level[place[k : k + len(tokens)]] for k in (done, half + done))
                done += len(tokens)
                if not total:
                    zero = np.zeros(len(first))
                    known, base, lm = zero.astype(np.int64), zero, zero
                    rare_at, left = np.zeros(len(ends), np.int64), tokens[:0]
                else:
                    distinct, which = np.unique(tokens, return_inverse=True)
                    k = np.minimum(np.searchsorted(words, distinct), len(words) - 1)
                    exact = words[k] == distinct if len(words) else np.zeros(len(distinct), bool)
                    logs = np.log10(np.where(exact, counts[k] if len(words) else 0, 0) + 1.0)[which]
                    exact = exact[which]
                    known = np.add.reduceat(exact.astype(np.int64), first)
                    base = np.add.reduceat(logs, first)
                    lm = np.add.reduceat(_log_prob(tokens, ends, of, start, pair, total, types, p), first)
                    left = tokens[~exact]
                    rare_at = np.concatenate([[0], np.cumsum(np.add.reduceat((~exact).astype(np.int64), first))])
                lists = pa.ListArray.from_arrays(pa.array(rare_at.astype(np.int32)), _as_long(left))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(row, len(first)),
                        pa.array(np.diff(ends)),
                        pa.array(known),
                        pa.array(base),
                        pa.array(lm),
                        lists,
                    ],
                    ["doc_id", "n_tokens", "known", "base", "score", "rare"],
                )

    part = both.mapInArrow(
        run, f"doc_id {kind}, n_tokens long, known long, base double, score double, rare array<long>"
    )
    # the row number is fixed once written, so the join below can be repeated after a loss
    part, _ = store(part.withColumn("row", F.monotonically_increasing_id()), "scored")
    drop(spark, blocks_at, found_at)
    release(spark)
    more = (
        part.select("row", F.explode("rare").alias("h"))
        .groupBy("row", "h")
        .count()
        .join(rare, "h")
        .groupBy("row")
        .agg(
            F.sum("count").alias("more"),
            F.sum(F.col("count") * F.log10(F.col("n") + F.lit(1.0))).alias("logs"),
        )
    )
    per_token = F.lit(float(np.log10(model.total + model.types + 1.0)))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return part.drop("rare").join(more, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("known") + zero("more")).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") + zero("logs") - F.col("n_tokens") * per_token).alias("base_score"),
        "score",
    )
