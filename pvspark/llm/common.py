"""Helpers shared by the operators: tables, row keys, scratch tables, Arrow text as numpy bytes."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pvspark.session import scratch_path

PIECE = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(ident: Column, m: int) -> Column:
    """crc32 of the id as text, modulo ``m``; -1 for a null id."""
    return F.coalesce(F.pmod(F.crc32(ident.cast("string").cast("binary")), F.lit(m)), F.lit(-1))


def text_hash(text: Column) -> Column:
    """With the id it names a row: rows equal in both are interchangeable. Null counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def store(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write to the shared scratch folder; returns the table read back and its path."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that this run wrote and no longer needs."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary array and its n + 1 offsets; nulls are empty. No copy if none is null."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if "binary" in str(column.type) else "")
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def pieces(column: pa.Array, size: int = PIECE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, bytes, offsets)`` over whole rows, about ``size`` bytes at a time."""
    data, at = buffers(column)
    row, n = 0, len(at) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + size, "right")) - 1)
        yield row, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def per_row(sums_of: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs given by offsets; empty runs give 0."""
    total = np.zeros((len(sums_of) + 1, *sums_of.shape[1:]), np.result_type(sums_of.dtype, np.int64))
    np.cumsum(sums_of, axis=0, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def whole_groups(batches):
    """Batches of rows sorted by their first column, regrouped so that no key is split."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch])
        key = table.column(0).to_numpy()
        if not len(key):
            continue
        cut = int(np.searchsorted(key, key[-1]))
        if cut:
            yield table.slice(0, cut)
        rest = table.slice(cut)
    if rest is not None and len(rest):
        yield rest
