"""Suffix-array dedup: remove every byte that a repeated string of fixed length covers.

A string of ``length`` bytes that starts at two places or more of the corpus is
removed wherever it stands. Repeats are found in two steps.

Candidates. Each window of ``length`` bytes has an anchor: its ``GRAM``-byte
gram of least hash, the first of equals. Equal windows have the same anchor at
the same place, so runs of windows with one anchor make a record, and only
records whose anchor occurs again can hold repeats. Equal records are one
context with a multiplicity (counted by Spark, combined before the shuffle).

Suffix arrays. Contexts are dealt out by anchor in bounded batches. A batch is
cut into blocks aligned at the anchors, equal blocks get equal symbols, and the
suffix array of the symbol string (see ``suffixes``) tells which suffixes share
all the whole blocks of a window; the window's partial first and last block are
compared through the sorted blocks themselves. All comparisons there are exact.
An anchor with more than ``anchor_limit`` different contexts would not fit a
batch; its windows are dealt out singly by their digest instead.

Results: one row per input row. Null and empty texts have 0 bytes and nothing
removed, nor has a text shorter than ``length``. Repeated rows repeat all their
windows. Null ids match themselves; rows equal in id and text share a result.
Empty tables give empty results; extra columns are ignored. Very long texts are
read in sections of ``SECTION`` windows. Texts are shuffled only if bitmaps of the
rows looked for (at most ``filter_bits``) leave them in.
"""

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pvspark.llm.common import buffers, drop, store, text_hash
from pvspark.llm.suffixes import ranks, suffix_array
from pvspark.llm.words import mix
from pvspark.session import release

GRAM = 32
SECTION = 1 << 20
_PLACE = np.uint64((1 << 28) - 1)
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


@dataclass(frozen=True)
class Params:
    length: int = 400
    block: int = 40  # divides length, and at most half of it
    batch: int = 8 << 20  # bytes of contexts in one suffix array
    anchor_limit: int = 5_000
    broadcast_rows: int = 10_000  # of about 100 bytes
    filter_bits: int = 1 << 26  # in the bitmaps of rows looked for, at most


def _hash_grams(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes from each position on; ``gram`` is a power of two."""
    h = mix(data.astype(np.uint64) + np.uint64(1))
    width = 1
    while width < gram:
        left, right = h[: len(h) - width], h[width:]
        h = left * np.uint64(0x9E3779B97F4A7C15) + (right ^ (right >> np.uint64(29))) * np.uint64(0xD1B54A32D192ED03)
        width *= 2
    return mix(h)


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values."""
    n, span = len(v) - width + 1, 1
    while span * 2 <= width:
        v = np.minimum(v[: len(v) - span], v[span:])
        span *= 2
    return np.minimum(v[:n], v[width - span : width - span + n])


def _records(data: np.ndarray, at: np.ndarray, length: int, gram: int):
    """Runs of windows with one anchor: text, first window, number, bytes before the anchor, anchor's hash."""
    none = [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)]
    if len(data) < length:
        return none
    h = _hash_grams(data, gram)
    keyed = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    anchor = (_sliding_min(keyed, length - gram + 1) & _PLACE).astype(np.int64)
    starts = np.arange(len(anchor))
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(anchor)]
    valid = at[text + 1] - starts >= length
    new = valid.copy()
    new[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1] | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    if not len(first):
        return none
    number = np.add.reduceat(valid.astype(np.int64), first)
    # windows that are not valid follow the last valid one of a run, so the sum counts the run alone
    return [text[first], first, number, anchor[first] - first, h[anchor[first]]]


def _sections(column: pa.Array, length: int):
    """Bytes, offsets, row of each part and where it starts in its text; texts longer than a section overlap."""
    data, at = buffers(column)
    parts, rows, begins, size = [], [], [], 0
    for row in range(len(at) - 1):
        n = int(at[row + 1] - at[row])
        for begin in range(0, max(n - length + 1, 0), SECTION):
            end = min(n, begin + SECTION + length - 1)
            parts.append(data[at[row] + begin : at[row] + end])
            rows.append(row)
            begins.append(begin)
            size += end - begin
            if size >= SECTION:
                yield _joined(parts, rows, begins)
                parts, rows, begins, size = [], [], [], 0
    if parts:
        yield _joined(parts, rows, begins)


def _joined(parts, rows, begins):
    at = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
    return np.concatenate(parts), at, np.array(rows), np.array(begins)


def _find_records(docs: DataFrame, p: Params, gram: int) -> DataFrame:
    """``doc_id, hash, first, number, before, anchor, content`` (a digest of the windows' bytes)."""
    kind = dict(docs.dtypes)["doc_id"]
    length = p.length

    def run(batches):
        for batch in batches:
            for data, at, rows, begins in _sections(batch.column(2), length):
                text, first, number, before, anchor = _records(data, at, length, gram)
                if not len(text):
                    continue
                raw = data.tobytes()
                content = [
                    hashlib.blake2b(raw[s : s + k - 1 + length], digest_size=16).digest()
                    for s, k in zip(first.tolist(), number.tolist())
                ]
                row = pa.array(rows[text])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(row),
                        batch.column(1).take(row),
                        pa.array(first - at[text] + begins[text]),
                        pa.array(number.astype(np.int32)),
                        pa.array(before.astype(np.int32)),
                        pa.array(anchor.view(np.int64)),
                        pa.array(content, pa.binary()),
                    ],
                    ["doc_id", "hash", "first", "number", "before", "anchor", "content"],
                )

    chosen = docs.select("doc_id", text_hash(F.col("text")).alias("hash"), "text")
    return chosen.mapInArrow(
        run, f"doc_id {kind}, hash long, first long, number int, before int, anchor long, content binary"
    )


def _runs(mask: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Byte ranges covered by the marked windows, one for each run of them."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return [(int(a), int(b) - 1 + length) for a, b in zip(edge[::2], edge[1::2])]


def repeated_windows(contents: list[bytes], before, number, times, length: int, block: int) -> list[np.ndarray]:
    """For each context, which of its windows occur again in this batch or by its multiplicity.

    ``before``: bytes ahead of the anchor, at which blocks are aligned.
    """
    inner = length // block - 1
    pad = (-np.asarray(before)) % block
    sizes = pad + np.array([len(c) for c in contents])
    blocks = -(-sizes // block)
    first = np.cumsum(blocks) - blocks
    flat = np.zeros(int(blocks.sum()) * block, np.uint8)
    for c, b, q in zip(contents, first.tolist(), pad.tolist()):
        flat[b * block + q : b * block + q + len(c)] = np.frombuffer(c, np.uint8)
    rows = flat.reshape(-1, block)
    order, common = ranks(rows)
    symbol = np.zeros(len(rows), np.int64)
    symbol[order] = np.cumsum(common < block) - 1
    kinds = rows[order[common < block]]
    _, same_ahead = ranks(kinds)  # they are in order already
    back, same_back = ranks(kinds[:, ::-1])

    # one terminator behind each context keeps positions of the string apart
    owner = np.repeat(np.arange(len(contents)), blocks)
    at = np.arange(len(rows)) + owner
    string = np.ones(len(rows) + len(contents), np.int64)
    string[at] = symbol + 2
    sa = suffix_array(string)
    padded = np.concatenate([string, np.zeros(inner, np.int64)])
    equal = np.ones(len(sa) - 1, bool)
    for k in range(inner):
        equal &= padded[sa[1:] + k] == padded[sa[:-1] + k]
    shared = np.zeros(len(padded) + 1, np.int64)
    shared[sa] = np.concatenate([[0], np.cumsum(~equal)])

    marks = [np.full(int(k), bool(t > 1)) for k, t in zip(number, times)]
    number, times = np.asarray(number), np.asarray(times)
    offset = (np.arange(len(rows)) - first[owner]) * block - pad[owner]
    head = np.zeros(len(kinds), np.int64)
    for r in range(1, block + 1):
        window = offset + block - r
        ok = np.flatnonzero((window >= 0) & (window < number[owner]))
        if not len(ok):
            continue
        head[back] = np.cumsum(same_back < r) - 1
        tail = np.cumsum(same_ahead < block - r) - 1 if r < block else np.zeros(len(kinds), np.int64)
        last = symbol[np.minimum(ok + inner + 1, len(rows) - 1)] if r < block else np.zeros(len(ok), np.int64)
        key = (shared[at[ok] + 1] * (len(kinds) + 1) + head[symbol[ok]]) * (len(kinds) + 1) + tail[last]
        _, which = np.unique(key, return_inverse=True)
        again = np.bincount(which, weights=times[owner[ok]])[which] > 1
        for o, w in zip(owner[ok[again]].tolist(), window[ok[again]].tolist()):
            marks[o][w] = True
    return marks


def _batches_of(contexts: DataFrame, p: Params) -> DataFrame:
    """``ctx, start, end``: repeated bytes of each context, batch by batch."""
    length, block = p.length, p.block

    def run(table: pa.Table) -> pa.Table:
        col = lambda c: table.column(c).to_pylist()
        marks = repeated_windows(col("bytes"), col("before"), col("number"), col("times"), length, block)
        out = [(c, a, b) for c, m in zip(col("ctx"), marks) for a, b in _runs(m, length)]
        return pa.table(
            {
                "ctx": pa.array([x[0] for x in out], pa.int64()),
                "start": pa.array([x[1] for x in out], pa.int64()),
                "end": pa.array([x[2] for x in out], pa.int64()),
            }
        )

    return contexts.groupBy("batch").applyInArrow(run, "ctx long, start long, end long")


def _single_windows(contexts: DataFrame, p: Params) -> DataFrame:
    """The same for contexts of crowded anchors: each window is counted by its digest."""
    length = p.length

    def run(batches):
        for batch in batches:
            for ctx, times, number, content in zip(*(batch.column(i).to_pylist() for i in range(4))):
                digests = [
                    hashlib.blake2b(content[w : w + length], digest_size=16).digest() for w in range(number)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ctx] * number, pa.int64()),
                        pa.array([times] * number, pa.int64()),
                        pa.array(np.arange(number)),
                        pa.array(digests, pa.binary()),
                    ],
                    ["ctx", "times", "window", "digest"],
                )

    windows, _ = store(
        contexts.select("ctx", "times", "number", "bytes").mapInArrow(
            run, "ctx long, times long, window long, digest binary"
        ),
        "windows",
    )
    again = windows.groupBy("digest").agg(F.sum("times").alias("all")).filter("all > 1").select("digest")
    found = windows.join(again, "digest")
    return found.select("ctx", F.col("window").alias("start"), (F.col("window") + length).alias("end"))


def _marked(texts: DataFrame, wanted: DataFrame, ident: str, digest: str, p: Params) -> DataFrame:
    """``texts`` with ``among``: false if a row is surely none of ``wanted``, by bitmaps of their keys.

    16 bits a row of ``wanted``, up to ``filter_bits`` in all, broadcast as rows of 4 KB. None of ``wanted`` is missed.
    """
    bits, most = 1 << 15, min(16 * wanted.count(), p.filter_bits)
    while bits < most:
        bits *= 2
    place = lambda i, d: F.pmod(F.xxhash64(i, d), F.lit(bits)) + 1
    maps = (
        wanted.select(place(ident, digest).alias("place"))
        .groupBy(F.bitmap_bucket_number("place").alias("slot"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("map"))
    )
    maps, _ = store(maps, "wanted-bits")
    placed = texts.withColumn("place", place("doc_id", "hash")).withColumn("slot", F.bitmap_bucket_number("place"))
    at = F.bitmap_bit_position("place").cast("int")
    byte = F.conv(F.hex(F.substring("map", F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    there = F.coalesce(F.getbit(byte, F.pmod(at, F.lit(8))) == 1, F.lit(False))
    return placed.join(F.broadcast(maps), "slot", "left").withColumn("among", there).drop("place", "slot", "map")


def _contents(docs: DataFrame, contexts: DataFrame, p: Params) -> DataFrame:
    """``ctx, batch, hot, times, before, number, bytes`` of contexts, cut from one text that has each."""
    length = p.length
    fields = ["ctx", "batch", "hot", "times", "before", "number", "first"]
    wanted, _ = store(
        contexts.groupBy("in_id", "in_hash").agg(F.collect_list(F.struct(*fields)).alias("wanted")), "wanted"
    )
    texts = docs.select("doc_id", "text", text_hash(F.col("text")).alias("hash"))
    same = F.col("doc_id").eqNullSafe(F.col("in_id")) & (F.col("hash") == F.col("in_hash"))
    if contexts.count() <= p.broadcast_rows:
        texts = texts.join(F.broadcast(wanted), same)
    else:
        texts = _marked(texts, wanted, "in_id", "in_hash", p).filter("among").join(wanted.hint("merge"), same)

    def run(batches):
        for batch in batches:
            data, at = buffers(batch.column(0))
            for row, wants in enumerate(batch.column(1).to_pylist()):
                for k in range(0, len(wants), 5000):
                    part = wants[k : k + 5000]
                    cut = [
                        data[at[row] + w["first"] : at[row] + w["first"] + w["number"] - 1 + length].tobytes()
                        for w in part
                    ]
                    get = lambda name, kind: pa.array([w[name] for w in part], kind)
                    yield pa.RecordBatch.from_arrays(
                        [
                            get("ctx", pa.int64()),
                            get("batch", pa.int64()),
                            get("hot", pa.bool_()),
                            get("times", pa.int64()),
                            get("before", pa.int32()),
                            get("number", pa.int32()),
                            pa.array(cut, pa.binary()),
                        ],
                        ["ctx", "batch", "hot", "times", "before", "number", "bytes"],
                    )

    return texts.select("text", "wanted").mapInArrow(
        run, "ctx long, batch long, hot boolean, times long, before int, number int, bytes binary"
    )


def find_repeats(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """``doc_id, hash, spans``: the maximal byte ranges to remove, of the rows that have any."""
    spark = docs.sparkSession
    gram = GRAM
    while gram * 2 > p.length:
        gram //= 2
    records, records_at = store(_find_records(docs.select("doc_id", "text"), p, gram), "records")
    grouped = records.groupBy("anchor", "content").agg(
        F.count("*").alias("times"), F.min(F.struct("doc_id", "hash", "first", "number", "before")).alias("at")
    )
    grouped, grouped_at = store(grouped, "contexts")
    anchors = grouped.groupBy("anchor").agg(F.count("*").alias("contexts"), F.sum("times").alias("all"))
    again, again_at = store(anchors.filter("all > 1"), "anchors")
    size = again.agg(F.sum("contexts")).first()[0] or 0
    per_batch = max(1, p.batch // (2 * p.length))
    batches = -(-size // per_batch)
    contexts, contexts_at = store(
        grouped.join(again.select("anchor", "contexts"), "anchor").select(
            F.monotonically_increasing_id().alias("ctx"),
            "anchor",
            "content",
            "times",
            "contexts",
            F.col("at.doc_id").alias("in_id"),
            F.col("at.hash").alias("in_hash"),
            *[F.col(f"at.{c}").alias(c) for c in ("first", "number", "before")],
            F.pmod(F.xxhash64("anchor"), F.lit(max(batches, 1))).alias("batch"),
            (F.col("contexts") > p.anchor_limit).alias("hot"),
        ),
        "contexts",
    )
    drop(spark, grouped_at, again_at)
    release(spark)  # shuffled records
    # an anchor's only context is repeated as a whole; others are compared
    alone = contexts.filter("contexts = 1").select(
        "ctx", F.lit(0).cast("long").alias("start"), (F.col("number") - 1 + p.length).cast("long").alias("end")
    )
    contents, contents_at = store(_contents(docs, contexts.filter("contexts > 1"), p), "contents")
    release(spark)  # shuffled texts
    compared = _batches_of(contents.filter("not hot"), p)
    hot = contents.filter("hot")
    if not hot.isEmpty():
        compared = compared.union(_single_windows(hot, p))
    spans, spans_at = store(
        alone.union(compared).groupBy("ctx").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "spans"
    )
    drop(spark, contents_at)
    known = contexts.select("ctx", "anchor", "content").join(spans, "ctx").drop("ctx")
    moved = F.transform("spans", lambda s: F.struct((s["start"] + F.col("first")).alias("start"), (s["end"] + F.col("first")).alias("end")))
    per_record = records.join(known, ["anchor", "content"]).select("doc_id", "hash", moved.alias("spans"))
    whole = per_record.groupBy("doc_id", "hash").agg(F.flatten(F.collect_list("spans")).alias("spans"))

    def merge(batches):
        for batch in batches:
            merged = [
                [{"start": a, "end": b} for a, b in _merge([(s["start"], s["end"]) for s in spans])]
                for spans in batch.column(2).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(merged, _SPANS)], ["doc_id", "hash", "spans"]
            )

    out, _ = store(whole.mapInArrow(merge, whole.schema), "repeats")
    drop(spark, records_at, contexts_at, spans_at)
    release(spark)
    return out


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """``doc_id, n_bytes, removed`` (maximal byte ranges) and ``kept`` (the bytes left)."""
    found = find_repeats(docs, p).withColumnsRenamed({"doc_id": "f_id", "hash": "f_hash"})
    texts = docs.select("doc_id", "text", text_hash(F.col("text")).alias("hash"))
    same = F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("hash") == F.col("f_hash"))
    if found.count() <= p.broadcast_rows:
        rows = texts.join(F.broadcast(found), same, "left").select("doc_id", "text", "spans")
    else:
        # texts without repeats stay where they are
        marked = _marked(texts, found, "f_id", "f_hash", p)
        rest = marked.filter("not among").select("doc_id", "text", F.lit(None).cast(found.schema["spans"].dataType).alias("spans"))
        some = marked.filter("among").join(found.hint("merge"), same, "left")
        rows = some.select("doc_id", "text", "spans").union(rest)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        for batch in batches:
            data, at = buffers(batch.column(1))
            sizes, removed, kept = [], [], []
            for row, spans in enumerate(batch.column(2).to_pylist()):
                whole = data[at[row] : at[row + 1]]
                gone = [(s["start"], s["end"]) for s in spans or []]
                stay = np.ones(len(whole), bool)
                for a, b in gone:
                    stay[a:b] = False
                sizes.append(len(whole))
                removed.append([{"start": a, "end": b} for a, b in gone])
                kept.append(whole[stay].tobytes() if gone else whole.tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, _SPANS), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "removed", "kept"],
            )

    return rows.mapInArrow(
        run, f"doc_id {kind}, n_bytes long, removed array<struct<start:long,end:long>>, kept binary"
    )
