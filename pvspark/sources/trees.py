"""Source trees as DataFrames.

Spark's own file sources leave out names that start with ``_`` or ``.``, which
a source tree is full of. Directories are therefore listed by tasks, level by
level, and files are read by tasks; the driver only sees whether another level
remains. Storage must be reachable from the executors.
"""

import math
import os
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pvspark.functions.text import filter_extensions
from pvspark.session import materialize

READ_BYTES = 128 << 20  # file bytes per read task
BATCH_BYTES = 32 << 20
_LISTED = "version string, root string, path string, is_dir boolean, size bigint"


def _list_directories(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [("version", pa.string()), ("root", pa.string()), ("path", pa.string()),
         ("is_dir", pa.bool_()), ("size", pa.int64())]
    )
    for batch in batches:
        for row in batch.to_pylist():
            filesystem, base = fs.FileSystem.from_uri(row["root"])
            where = f"{base}/{row['path']}" if row["path"] else base
            entries = filesystem.get_file_info(fs.FileSelector(where, allow_not_found=row["optional"]))
            found = []
            for entry in entries:
                is_dir = entry.type == fs.FileType.Directory
                local_link = isinstance(filesystem, fs.LocalFileSystem) and os.path.islink(entry.path)
                if is_dir and local_link:
                    continue  # a linked directory could lead back up
                found.append(
                    {
                        "version": row["version"],
                        "root": row["root"],
                        "path": entry.path[len(base.rstrip("/")) + 1 :],
                        "is_dir": is_dir,
                        "size": 0 if is_dir else entry.size or 0,
                    }
                )
            if found:
                yield pa.RecordBatch.from_pylist(found, schema=schema)


def _read_files(batches: Iterator[pa.RecordBatch], skip: bool) -> Iterator[pa.RecordBatch]:
    """Contents of listed files; an unreadable file ends the job, or gets a null content with ``skip``."""
    names = ["version", "path", "content"]

    def emit(rows):
        columns = list(zip(*rows))
        types = [pa.string(), pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types)], names=names
        )

    rows, held = [], 0
    for batch in batches:
        for row in batch.to_pylist():
            try:
                filesystem, base = fs.FileSystem.from_uri(row["root"])
                with filesystem.open_input_stream(f"{base}/{row['path']}") as stream:
                    content = stream.read()
            except (OSError, pa.ArrowException):
                if not skip:
                    raise
                content = None
            rows.append((row["version"], row["path"], content))
            held += len(content or b"")
            if held >= BATCH_BYTES or len(rows) >= 1000:
                yield emit(rows)
                rows, held = [], 0
    if rows:
        yield emit(rows)


def _as_uri(root: str) -> str:
    return root if "://" in root else "file://" + os.path.abspath(root)


def list_snapshots(
    spark: SparkSession,
    roots: dict[str, str],
    source_dir: str | None = None,
    skip_missing: bool = False,
) -> DataFrame:
    """``version, root, path, size`` of every file below each root.

    Paths are relative to the root even when ``source_dir`` limits the walk. A
    missing root is an error, or has no files with ``skip_missing``. A version
    may lack ``source_dir``: it then has no files.
    """
    start = (source_dir or "").strip("/")
    rows = [(version, _as_uri(root), start, skip_missing or bool(start)) for version, root in roots.items()]
    if not skip_missing:
        for _, root, *_ in rows:
            filesystem, base = fs.FileSystem.from_uri(root)
            if filesystem.get_file_info(base).type == fs.FileType.NotFound:
                raise FileNotFoundError(root)
    frontier = spark.createDataFrame(rows, "version string, root string, path string, optional boolean")
    files = None
    while True:
        spread = frontier.repartition(spark.sparkContext.defaultParallelism)
        level = materialize(spread.mapInArrow(_list_directories, _LISTED), "listing")
        found = level.filter(~F.col("is_dir")).drop("is_dir")
        files = found if files is None else files.unionByName(found)
        frontier = level.filter("is_dir").select("version", "root", "path", F.lit(skip_missing).alias("optional"))
        if frontier.isEmpty():
            return files


def read_snapshots(
    spark: SparkSession,
    roots: dict[str, str],
    extensions: list[str],
    source_dir: str | None = None,
    skip_missing: bool = False,
) -> DataFrame:
    """``version, path, content`` of the files matching an extension, per version.

    Hidden files and ``_x`` files are included. A file that cannot be read is an
    error; with ``skip_missing`` its ``content`` is null, and ``corpus_stats``
    counts it.
    """
    listed = filter_extensions(list_snapshots(spark, roots, source_dir, skip_missing), extensions)
    total = listed.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(total / READ_BYTES))
    return listed.repartition(tasks).mapInArrow(
        lambda batches: _read_files(batches, skip_missing), "version string, path string, content binary"
    )


def read_source_tree(
    spark: SparkSession,
    root: str,
    extensions: list[str],
    source_dir: str | None = None,
    skip_missing: bool = False,
) -> DataFrame:
    """``path, content`` of one tree."""
    return read_snapshots(spark, {"": root}, extensions, source_dir, skip_missing).drop("version")
