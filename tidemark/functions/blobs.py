"""Columns packed into self-describing binary blobs and back, as SQL functions and DataFrame helpers."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def pack(values: pa.Array) -> bytes:
    """An Arrow IPC stream with zstd buffers: it carries its own type, and NULLs."""
    sink, batch = pa.BufferOutputStream(), pa.record_batch([values], names=["v"])
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(blob: bytes) -> pa.Array:
    return pa.ipc.open_stream(blob).read_all().column(0).combine_chunks()


#: Lists of up to so many longs get buffers without compression, which would hardly make such a blob smaller.
SHORT = 64


@cache
def _short_blob(n: int) -> tuple[np.ndarray, int]:
    """The blob of n longs that are 0, and where in it the first of them lies; blobs of other longs differ only there."""
    def write(value: int) -> np.ndarray:
        sink, batch = pa.BufferOutputStream(), pa.record_batch([pa.array([value] * n, pa.int64())], names=["v"])
        with pa.ipc.new_stream(sink, batch.schema) as w:
            w.write_batch(batch)
        return np.frombuffer(sink.getvalue(), np.uint8)

    zeros = write(0)
    places = np.flatnonzero(zeros != write(-1))
    if len(places) != 8 * n or n and places[-1] - places[0] != 8 * n - 1:
        raise ValueError("the longs of a blob are not side by side")
    return zeros, int(places[0]) if n else len(zeros)


def _starts(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)])


def pack_lists(lists: pa.Array) -> pa.Array:
    """A blob for each list of longs, as pack() makes them; all short lists of one length are written at once."""
    lengths, null = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), pc.is_null(lists).to_numpy(zero_copy_only=False)
    values = lists.flatten().cast(pa.int64())
    starts = _starts(lengths)
    longs, gaps = values.fill_null(0).to_numpy(), _starts(values.is_null().to_numpy(zero_copy_only=False))
    short = ~null & (lengths <= SHORT) & (gaps[starts[1:]] == gaps[starts[:-1]])
    single = {int(i): np.frombuffer(pack(values.slice(starts[i], lengths[i])), np.uint8) for i in np.flatnonzero(~null & ~short)}
    sizes, groups = np.zeros(len(lists), np.int64), [(int(n), np.flatnonzero(short & (lengths == n))) for n in np.unique(lengths[short])]
    for n, rows in groups:
        sizes[rows] = len(_short_blob(n)[0])
    for i, blob in single.items():
        sizes[i] = len(blob)
    ends = _starts(sizes)
    out = np.empty(ends[-1], np.uint8)
    for n, rows in groups:
        zeros, at = _short_blob(n)
        blobs = np.tile(zeros, (len(rows), 1))
        blobs[:, at : at + 8 * n] = longs[starts[rows, None] + np.arange(n)].astype("<i8").view(np.uint8).reshape(len(rows), 8 * n)
        out[ends[rows, None] + np.arange(len(zeros))] = blobs
    for i, blob in single.items():
        out[ends[i] : ends[i + 1]] = blob
    valid = pa.array(~null).buffers()[1]
    return pa.Array.from_buffers(pa.large_binary(), len(lists), [valid, pa.py_buffer(ends), pa.py_buffer(out)])


def unpack_lists(blobs: pa.Array) -> pa.Array:
    """The lists of longs in blobs; all blobs of short lists of one length are read at once, others one by one."""
    blobs = blobs.cast(pa.large_binary())
    sizes, null = pc.binary_length(blobs).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), pc.is_null(blobs).to_numpy(zero_copy_only=False)
    at = np.frombuffer(blobs.buffers()[1], np.int64)[blobs.offset : blobs.offset + len(blobs)] if len(blobs) else np.zeros(0, np.int64)
    data = np.frombuffer(blobs.buffers()[2] or b"", np.uint8)
    lengths, left, groups = np.zeros(len(blobs), np.int64), ~null, []
    for n in range(SHORT + 1):
        zeros, first = _short_blob(n)
        rows = np.flatnonzero(left & (sizes == len(zeros)))
        if len(rows):
            parts = data[at[rows, None] + np.arange(len(zeros))]
            frame = np.r_[0:first, first + 8 * n : len(zeros)]
            like = (parts[:, frame] == zeros[frame]).all(1)
            rows, parts = rows[like], parts[like]
            groups.append((n, rows, np.ascontiguousarray(parts[:, first : first + 8 * n]).view("<i8")))
            lengths[rows], left[rows] = n, False
    single = {int(i): unpack(blobs[int(i)].as_py()).cast(pa.int64()) for i in np.flatnonzero(left)}
    for i, x in single.items():
        lengths[i] = len(x)
    starts = _starts(lengths)
    longs, gap = np.zeros(starts[-1], np.int64), np.zeros(starts[-1], bool)
    for n, rows, values in groups:
        longs[starts[rows, None] + np.arange(n)] = values
    for i, x in single.items():
        longs[starts[i] : starts[i + 1]], gap[starts[i] : starts[i + 1]] = x.fill_null(0).to_numpy(), x.is_null().to_numpy(zero_copy_only=False)
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(longs, mask=gap), mask=pa.array(null))


def register(spark: SparkSession) -> None:
    """SQL functions pack_longs(array<long>) -> binary and unpack_longs(binary) -> array<long>."""

    @F.arrow_udf("binary")
    def pack_longs(lists: pa.Array) -> pa.Array:
        return pack_lists(lists).cast(pa.binary())

    @F.arrow_udf("array<long>")
    def unpack_longs(blobs: pa.Array) -> pa.Array:
        return unpack_lists(blobs)

    spark.udf.register("pack_longs", pack_longs)
    spark.udf.register("unpack_longs", unpack_longs)


def pack_column(df: DataFrame, value: str, rows: int = 65_536) -> DataFrame:
    """chunk, n and blob: at most `rows` values of a partition in each blob."""
    schema = "chunk long, n long, blob binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = 0
        for batch in batches:
            for at in range(0, len(batch), rows):
                part = batch.column(0).slice(at, rows)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([len(part)], pa.int64()), pa.array([pack(part)], pa.binary())], names=["chunk", "n", "blob"])
                k += 1

    return df.select(value).mapInArrow(run, schema)


def unpack_column(df: DataFrame, kind: T.DataType, blob: str = "blob", out: str = "value") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                yield pa.RecordBatch.from_arrays([unpack(x.as_py())], names=[out])

    return df.select(blob).mapInArrow(run, T.StructType([T.StructField(out, kind)]))


def pack_frame(pdf: pd.DataFrame) -> dict[str, bytes]:
    """Each column of a pandas frame as a blob; unknown dtypes are errors."""
    return {str(c): pack(pa.array(pdf[c], from_pandas=True)) for c in pdf.columns}


def unpack_frame(blobs: dict[str, bytes]) -> pd.DataFrame:
    return pd.DataFrame({c: unpack(b).to_pandas() for c, b in blobs.items()})
