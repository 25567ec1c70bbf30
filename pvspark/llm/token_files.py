"""Token ids of a corpus in binary files.

Ids are replaced by their rank in the corpus' own frequencies (0 for the most
frequent one, ties by smaller id) and a rank is written little-endian in as
many bytes as it needs, one to four. The byte numbers, less one, stand apart
in control bytes of four two-bit codes, lowest bits first, so a reader finds
all values of a block by looking up tables instead of by branching.

A folder holds ``shards/*.ids``, the table ``vocabulary`` (``rank, id, n``)
and the table ``manifest`` (``part, seq, file, n_docs, n_ids``). Tasks write shards
under names of their own attempt and hand in a manifest row; only listed files
count, so a lost executor or a second attempt leaves at most unlisted files.

A shard, all integers little-endian::

    magic 8 | n_docs u64 | n_ids u64 | n_data u64
    doc_id i64 x n_docs | null flag u8 x n_docs | ids of the document u64 x n_docs
    data offset of each block of 65,536 ids u64 x blocks
    control bytes, ceil(n_ids / 4) | data bytes, n_data | crc32 of all before, u32

Documents stand in ascending ``doc_id``, null ids first, repeated ids by text
digest; rows equal in both are interchangeable. A null text is an empty one and
has the end id alone; an empty table gives no shard and reads back empty. A
document is never cut, however long. Other columns are not looked at.
"""

import hashlib
import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pvspark.llm.common import buffers, drop, pieces, text_hash
from pvspark.session import scratch_path

MAGIC = b"RANKIDS1"
BLOCK = 1 << 16  # ids; a multiple of four, so that blocks begin with a control byte
SHARD_IDS = 1 << 22
KEPT_WORDS = 600_000
KEPT_BYTES = 256  # of a word that is kept
_HEAD = "<8sQQQ"
_CODES = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3
_LENGTHS = (_CODES + 1).astype(np.uint8)
_KEEP = np.array([0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)

# ---- coding -------------------------------------------------------------


def pack(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Control bytes, data bytes, and the data offset of each block."""
    ranks = ranks.astype("<u4")
    code = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) <= code[:, None]]
    padded = np.zeros(-(-len(code) // 4) * 4, np.uint8)
    padded[: len(code)] = code
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    ends = np.concatenate([[0], np.cumsum(code.astype(np.int64) + 1)])
    return control, data, ends[:-1:BLOCK].astype("<u8")


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` ranks: lengths come from a table by control byte, values from masked words."""
    if not n:
        return np.zeros(0, np.uint32)
    lengths = _LENGTHS[control].ravel()[:n]
    ends = np.cumsum(lengths, dtype=np.int64)
    starts = ends - lengths
    wide = np.zeros(int(ends[-1]) + 3, np.uint32)
    wide[:-3] = data[: ends[-1]]
    words = wide[:-3] | wide[1:-2] << np.uint32(8) | wide[2:-1] << np.uint32(16) | wide[3:] << np.uint32(24)
    return words[starts] & _KEEP[lengths - 1]


def to_file(doc_ids: list, counts: np.ndarray, ranks: np.ndarray) -> bytes:
    control, data, blocks = pack(ranks)
    body = b"".join(
        [
            struct.pack(_HEAD, MAGIC, len(doc_ids), len(ranks), len(data)),
            np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(),
            np.array([d is None for d in doc_ids], np.uint8).tobytes(),
            counts.astype("<u8").tobytes(),
            blocks.tobytes(),
            control.tobytes(),
            data.tobytes(),
        ]
    )
    return body + struct.pack("<I", zlib.crc32(body))


class Shard:
    """One file in memory; blocks are decoded when asked for."""

    def __init__(self, content: bytes):
        if zlib.crc32(memoryview(content)[:-4]) != struct.unpack("<I", content[-4:])[0]:
            raise ValueError("the shard is damaged")
        magic, docs, self.n_ids, n_data = struct.unpack_from(_HEAD, content)
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        at = struct.calcsize(_HEAD)

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(content, kind, n, at)
            at += found.nbytes
            return found

        ids, null = take("<i8", docs), take("u1", docs)
        self.doc_ids = pa.array(ids, pa.int64(), mask=null.astype(bool))
        self.ends = np.concatenate([[0], np.cumsum(take("<u8", docs).astype(np.int64))])
        self.blocks = take("<u8", -(-self.n_ids // BLOCK)).astype(np.int64)
        self.control = take("u1", -(-self.n_ids // 4))
        self.data = take("u1", n_data)

    def ranks(self, start: int, end: int) -> np.ndarray:
        """Ranks of the ids from ``start`` to ``end``; reads only the blocks they lie in."""
        if start >= end:
            return np.zeros(0, np.uint32)
        first, last = start // BLOCK, -(-end // BLOCK)
        base = first * BLOCK
        n = min(last * BLOCK, self.n_ids) - base
        data = self.data[self.blocks[first] : self.blocks[last] if last < len(self.blocks) else None]
        return unpack(self.control[base // 4 : -(-(base + n) // 4)], data, n)[start - base : end - base]


# ---- encoding -----------------------------------------------------------

# fixed value: a pre-tokenizer that ends a piece after a run of letters, whatever ASCII sign follows
LETTER_RUNS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_BLANK = np.zeros(256, bool)
_BLANK[[0x09, 0x0A, 0x0D, 0x20]] = True
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_SIGN = np.zeros(256, bool)
_SIGN[0x21:0x7F] = True
_SIGN &= ~_LETTER


def id_type(tokenizer_json: str, end_id: int) -> str:
    """Two bytes an id if all ids of the vocabulary fit, else four."""
    from tokenizers import Tokenizer

    known = Tokenizer.from_str(tokenizer_json).get_vocab(with_added_tokens=True).values()
    return "<u2" if max(end_id, *known) < 1 << 16 else "<u4"


def cut(data: np.ndarray, at: np.ndarray, letters: bool) -> tuple[pa.Array, np.ndarray]:
    """Words between blanks, tabs and line ends, and per text the offsets of its words.

    With ``letters`` words also end after an ASCII letter before another ASCII sign.
    """
    inside = ~_BLANK[data]
    new = inside.copy()
    new[1:] &= ~inside[:-1]
    if letters:
        new[1:] |= _LETTER[data[:-1]] & _SIGN[data[1:]]
    first = at[:-1][at[:-1] < at[1:]]
    new[first] = inside[first]
    starts = np.flatnonzero(new)
    kept = data[inside]
    offsets = np.append(np.flatnonzero(new[inside]), len(kept))
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(kept))
    return words, np.searchsorted(starts, at)


class Encoder:
    """Ids of many texts at once.

    Where the tokenizer drops white space, a text's ids are those of its words one
    after another, and a distinct word is encoded once while it is kept. Texts
    that hold one of the tokenizer's special strings are not cut inside words,
    and those of other tokenizers not at all.
    """

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        spec = json.loads(tokenizer_json)
        plain = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        special = [t["content"] for t in spec.get("added_tokens") or []]
        self.apart = (
            not plain(" \t\r\n")
            and plain("ab \tcd\r\nef") == plain("ab") + plain("cd") + plain("ef")
            and not any(c.isspace() for t in special for c in t)
        )
        self.special = [t.encode() for t in special]
        stages = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.letters = stages[0].get("pattern") == {"Regex": LETTER_RUNS} and stages[0].get("invert")
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.flat = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(1, np.int64)  # of the known words' ids in flat, and their end

    def _slots(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per word the start and number of its ids in the array that comes third."""
        if len(self.known) > KEPT_WORDS:
            self._forget()
        at = pc.index_in(words, value_set=self.known).fill_null(-1).to_numpy().astype(np.int64)
        new = np.flatnonzero(at < 0)
        size = pc.binary_length(words).to_numpy()[new]
        new = new[np.argsort(size > KEPT_BYTES, kind="stable")]
        stay, n = len(self.known) + int((size <= KEPT_BYTES).sum()), len(self.known)
        fresh = words.take(pa.array(new))
        found = [e.ids for e in self.tokenizer.encode_batch_fast(fresh.to_pylist(), add_special_tokens=False)]
        ends = self.starts[-1] + np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
        starts = np.concatenate([self.starts, ends])
        if starts[-1] > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.starts[-1]], np.zeros(int(starts[-1]), np.uint32)])
        self.flat[self.starts[-1] : starts[-1]] = np.fromiter(chain.from_iterable(found), np.uint32)
        at[new] = n + np.arange(len(new))
        # long words are encoded anew each time
        self.known, self.starts = pa.concat_arrays([self.known, fresh.slice(0, stay - n)]), starts[: stay + 1]
        return starts[at], np.diff(starts)[at], self.flat

    def encode(self, column: pa.Array, end_id: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``(ids, offsets)``, pieces of about 8 MB of whole texts at a time."""
        for _, data, at in pieces(column, 8 << 20):
            if self.apart:
                raw = data.tobytes()
                words, texts = cut(data, at, self.letters and not any(t in raw for t in self.special))
            else:
                words = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(data))
                texts = np.arange(len(at))
            coded = words.dictionary_encode()
            starts, size, flat = self._slots(coded.dictionary)
            word = coded.indices.to_numpy()
            size = size[word]
            ends = np.concatenate([[0], np.cumsum(size)])
            # a text's ids are followed by the end id
            offsets = ends[texts] + np.arange(len(texts))
            ids = np.full(offsets[-1], end_id, np.uint32)
            inside = np.ones(len(ids), bool)
            inside[offsets[1:] - 1] = False
            ids[inside] = flat[np.repeat(starts[word] - ends[:-1], size) + np.arange(ends[-1])]
            yield ids, offsets


def shared_encoder(tokenizer_json: str) -> Encoder:
    """One encoder a Python worker, so that words stay known from task to task."""
    import tokenizers

    held = vars(tokenizers).setdefault("_encoder_of_worker", {})
    key = hashlib.sha256(tokenizer_json.encode()).digest()
    if key not in held:
        held.clear()
        held[key] = Encoder(tokenizer_json)
    return held[key]


def encode(docs: DataFrame, tokenizer_json: str, end_id: int, kind: str) -> DataFrame:
    """``doc_id, digest, n, ids``: packed ids (``kind``) of each whole text with the end id."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)  # the vocabulary file
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_hash(F.col("text")).alias("digest"), "text"
    )
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(shared.value)
        for batch in batches:
            row = 0
            for ids, at in encoder.encode(batch.column("text"), end_id):
                part = batch.slice(row, len(at) - 1)
                row += len(at) - 1
                ids = ids.astype(kind)
                packed = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(),
                    len(at) - 1,
                    [None, pa.py_buffer(at * ids.itemsize), pa.py_buffer(ids)],
                )
                columns = [part.column("doc_id"), part.column("digest"), pa.array(np.diff(at)), packed.cast(pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return rows.mapInArrow(run, "doc_id long, digest long, n long, ids binary")


def frequencies(encoded: DataFrame, kind: str) -> DataFrame:
    """``rank, id, n`` of all ids that occur; at most the vocabulary's rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            data, _ = buffers(batch.column("ids"))
            found = np.bincount(data.view(kind)) if len(data) else np.zeros(0, np.int64)
            if len(found) > len(total):
                found, total = total, found
            total[: len(found)] += found
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["id", "n"])

    counts = encoded.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    order = W.orderBy(F.desc("n"), "id")
    return counts.select((F.row_number().over(order) - 1).alias("rank"), "id", "n")


# ---- files --------------------------------------------------------------


def _store(folder: str):
    """The file system of a folder named by path or URI, and the path in it."""
    from pyarrow import fs

    if folder.startswith("file:"):
        folder = "/" + folder[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), os.path.abspath(folder))


def write(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int, shard_ids: int = SHARD_IDS
) -> None:
    """Write all documents of ``docs`` (``doc_id, text``) as shards of about ``shard_ids`` ids.

    ``tokenizer`` is the path of a tokenizer file on the driver; ``folder`` is on a
    store that all executors reach.
    """
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        tokenizer_json = f.read()
    kind = id_type(tokenizer_json, end_id)
    scratch = scratch_path(spark, "encoded")
    encode(docs, tokenizer_json, end_id, kind).write.option("compression", "zstd").parquet(scratch)
    encoded = spark.read.schema("doc_id long, digest long, n long, ids binary").parquet(scratch)
    frequencies(encoded, kind).write.parquet(f"{folder}/vocabulary")
    vocabulary = spark.read.parquet(f"{folder}/vocabulary").select("rank", "id").toArrow()
    rank_of = np.zeros(1 << 16 if kind == "<u2" else 1 + max(vocabulary.column("id").to_pylist(), default=0), "<u4")
    rank_of[vocabulary.column("id").to_numpy()] = vocabulary.column("rank").to_numpy()
    ranks = spark.sparkContext.broadcast(rank_of)  # as long as the vocabulary
    total = encoded.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    order = [F.asc_nulls_first("doc_id"), F.asc("digest")]
    parts = max(1, -(-total // shard_ids))
    dealt = encoded.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(f"{folder}/shards")
        store.create_dir(root, recursive=True)
        part, seq = TaskContext.get().partitionId(), 0
        doc_ids, counts, held, n = [], [], [], 0

        def shard() -> pa.RecordBatch:
            nonlocal seq, n
            name = f"{part:08d}-{seq:06d}-{uuid.uuid4().hex}.ids"
            content = to_file(doc_ids, np.concatenate(counts), np.concatenate(held))
            with store.open_output_stream(f"{root}/{name}") as out:
                out.write(content)
            row = [[part], [seq], [name], [len(doc_ids)], [n]]
            seq, n = seq + 1, 0
            for kept in (doc_ids, counts, held):
                kept.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in row], names=["part", "seq", "file", "n_docs", "n_ids"])

        for batch in batches:
            ends = np.cumsum(batch.column("n").to_numpy())
            row = 0
            while row < batch.num_rows:
                # as many rows as fill the shard, at least one
                before = ends[row - 1] if row else 0
                stop = max(row + 1, int(np.searchsorted(ends, before + shard_ids - n, "right")))
                some = batch.slice(row, stop - row)
                doc_ids.extend(some.column("doc_id").to_pylist())
                counts.append(some.column("n").to_numpy())
                held.append(ranks.value[buffers(some.column("ids"))[0].view(kind)])
                n += int(ends[stop - 1] - before)
                row = stop
                if n >= shard_ids:
                    yield shard()
        if doc_ids:
            yield shard()

    listed = dealt.mapInArrow(save, "part long, seq long, file string, n_docs long, n_ids long")
    listed.write.parquet(f"{folder}/manifest")
    drop(spark, scratch)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids``: ids as packed little-endian 32-bit integers.

    ``start`` counts the ids of all documents before. A task reads the files it is
    dealt; of the manifest one small row a file passes through a window.
    """
    manifest = spark.read.schema("part long, seq long, file string, n_docs long, n_ids long").parquet(
        f"{folder}/manifest"
    )
    vocabulary = spark.read.parquet(f"{folder}/vocabulary").orderBy("rank").select("id").toArrow()
    id_of = spark.sparkContext.broadcast(vocabulary.column("id").to_numpy().astype("<u4"))
    before = W.orderBy("part", "seq").rowsBetween(W.unboundedPreceding, -1)
    placed = manifest.select(
        "file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("first")
    )
    names = ["doc_id", "start", "n_tokens", "ids"]

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(f"{folder}/shards")
        for batch in batches:
            for name, first in zip(batch.column("file").to_pylist(), batch.column("first").to_pylist()):
                with store.open_input_stream(f"{root}/{name}") as source:
                    shard = Shard(source.read())
                row, docs = 0, len(shard.doc_ids)
                while row < docs:
                    # documents of about one block together
                    ends = shard.ends
                    stop = max(row + 1, int(np.searchsorted(ends, ends[row] + 16 * BLOCK, "right")) - 1)
                    ids = id_of.value[shard.ranks(int(ends[row]), int(ends[stop]))]
                    at = ends[row : stop + 1]
                    packed = pa.LargeBinaryArray.from_buffers(
                        pa.large_binary(), stop - row, [None, pa.py_buffer((at - at[0]) * 4), pa.py_buffer(ids)]
                    )
                    columns = [
                        shard.doc_ids.slice(row, stop - row),
                        pa.array(first + at[:-1]),
                        pa.array(np.diff(at)),
                        packed.cast(pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=names)
                    row = stop

    files = max(1, manifest.count())
    tasks = min(files, 4 * spark.sparkContext.defaultParallelism)
    return placed.repartition(tasks).mapInArrow(load, "doc_id long, start long, n_tokens long, ids binary")
