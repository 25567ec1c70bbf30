"""Blocks of rows as single files in the shared folder, read again by the tasks that need them.

Spark shuffles a row to one place. Work on pairs of blocks wants each block in
many places: it is written once, as an Arrow file, and a task opens the two
blocks of its pair by itself. A file carries the name of its attempt and counts
only if the table of blocks lists it, so a repeated task leaves nothing wrong.
The shared folder may be any store that pyarrow reaches (local, HDFS, S3, GCS).
"""

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pvspark.session import materialize, scratch_path

PIECE_GAP = 1 << 16  # bytes between two pieces that are rather read than skipped


def open_store(folder: str):
    """The file system of a folder named by path or URI, and the path in it."""
    from pyarrow import fs

    if folder.startswith("file:"):
        folder = "/" + folder[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), os.path.abspath(folder))


def write_blocks(rows: DataFrame, key: list[str], name: str) -> DataFrame:
    """One Arrow file per value of ``key``; returns the stored table ``key..., file, rows``.

    A block must fit a task. The rows are shuffled once.
    """
    folder = scratch_path(rows.sparkSession, name)
    kinds = dict(rows.dtypes)

    def write(table: pa.Table) -> pa.Table:
        store, root = open_store(folder)
        store.create_dir(root, recursive=True)
        file = f"{folder}/{uuid.uuid4().hex}.arrow"
        kept = table.drop_columns(key).combine_chunks()
        with store.open_output_stream(f"{root}/{file.rsplit('/', 1)[1]}") as out:
            with pa.ipc.new_file(out, kept.schema) as writer:
                writer.write_table(kept)
        return table.slice(0, 1).select(key).append_column("file", pa.array([file])).append_column(
            "rows", pa.array([len(kept)], pa.int64())
        )

    schema = ", ".join(f"{k} {kinds[k]}" for k in key) + ", file string, rows long"
    return materialize(rows.groupBy(*key).applyInArrow(write, schema), f"{name}-list")


def read_block(file: str) -> pa.Table:
    folder, name = file.rsplit("/", 1)
    store, root = open_store(folder)
    with store.open_input_file(f"{root}/{name}") as source:
        return pa.ipc.open_file(source).read_all()


def write_pieces(rows: DataFrame, column: str, name: str) -> DataFrame:
    """``rows`` as a stored table with the places ``file, at, bytes`` of a binary column instead of its values.

    Each task writes its values one after the other to a file of its own; no row moves.
    """
    folder = scratch_path(rows.sparkSession, f"{name}-pieces")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        file, out, at = f"{folder}/{uuid.uuid4().hex}.bin", None, 0
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                if out is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(f"{root}/{file.rsplit('/', 1)[1]}")
                values = [v or b"" for v in batch.column(column).to_pylist()]
                sizes = np.array([len(v) for v in values], np.int64)
                out.write(b"".join(values))
                kept = batch.drop_columns([column])
                places = [pa.array([file] * len(sizes)), pa.array(at + np.cumsum(sizes) - sizes), pa.array(sizes)]
                yield pa.RecordBatch.from_arrays([*kept.columns, *places], names=[*kept.schema.names, "file", "at", "bytes"])
                at += int(sizes.sum())
        finally:
            if out is not None:
                out.close()

    kinds = ", ".join(f"{c} {k}" for c, k in rows.dtypes if c != column)
    return materialize(rows.mapInArrow(write, f"{kinds}, file string, at long, bytes long"), name, compression="zstd")


def read_pieces(places: pa.Table) -> list[bytes]:
    """The values at ``file, at, bytes``, in row order. Each file is opened once and read forwards."""
    found = [b""] * len(places)
    files = places.column("file").combine_chunks().dictionary_encode()
    code, names = files.indices.to_numpy(), files.dictionary.to_pylist()
    at, size = (places.column(c).to_numpy() for c in ("at", "bytes"))
    order = np.lexsort((at, code))
    first = 0
    while first < len(order):
        of = code[order[first]]
        last = int(np.searchsorted(code[order], of, "right"))
        folder, name = names[of].rsplit("/", 1)
        store, root = open_store(folder)
        with store.open_input_file(f"{root}/{name}") as source:
            rows = order[first:last]
            begin, end = at[rows], at[rows] + size[rows]
            runs = np.concatenate([[0], np.flatnonzero(begin[1:] > end[:-1] + PIECE_GAP) + 1, [len(rows)]])
            for a, b in zip(runs, runs[1:]):
                read = source.read_at(int(end[a:b].max() - begin[a]), int(begin[a]))
                for k in range(a, b):
                    found[rows[k]] = read[begin[k] - begin[a] : end[k] - begin[a]]
        first = last
    return found
