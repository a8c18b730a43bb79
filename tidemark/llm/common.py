"""Shared plumbing of the training-data operators: sessions, staging, text buffers."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one vectorised kernel call works on (single longer texts are taken whole).
CHUNK_BYTES = 1 << 20


#: Folders of local sessions that have no spark.checkpoint.dir, by application.
_OWN: dict[str, str] = {}
#: Deletes the shuffle files of a statement as soon as it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share; a folder of its own only for a session on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _OWN.setdefault(context.applicationId, tempfile.mkdtemp(prefix="tidemark-"))


def staged(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write a table in the shared folder and read it back.

    The files outlive lost executors, so nothing before this point is ever computed twice; the shuffle files
    that led to it go at once.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession, rows: int = 2000, megabytes: int = 8) -> None:
    """Bound what one Arrow batch holds, so that very long texts can't fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{megabytes}m")


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string column and the n + 1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(data: np.ndarray, offsets: np.ndarray, size: int = CHUNK_BYTES):
    """(first row, last row, bytes, offsets) of row runs of about size bytes; rows are never cut."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


#: Two primes and a base for each of a polynomial hash; its slices have no structure that makes them collide.
PRIMES = ((2147483647, 1299709 * 797), (2147483629, 1000003 * 1361))
#: Values that are summed at once; their sum stays below 2**63.
_SUMMED = 1 << 18


class _Powers:
    """Powers of each base and of its inverse modulo its prime, as long as the longest text so far."""

    forward = [np.ones(1, np.int32) for _ in PRIMES]
    inverse = [np.ones(1, np.int32) for _ in PRIMES]

    @classmethod
    def upto(cls, n: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        if len(cls.forward[0]) <= n:
            size = max(n + 1, CHUNK_BYTES + 4096)
            for i, (p, base) in enumerate(PRIMES):
                for table, b in ((cls.forward, base), (cls.inverse, pow(base, -1, p))):
                    out, done = np.empty(size, np.int64), 1
                    out[0] = 1
                    while done < size:
                        more = min(done, size - done)
                        out[done : done + more] = out[:more] * pow(b, done, p) % p
                        done += more
                    table[i] = out.astype(np.int32)
        return cls.forward, cls.inverse


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(32))


def prefix_sums(data: np.ndarray) -> list[np.ndarray]:
    """Prefix values from which slice_hash gives the hash of any slice in constant time."""
    forward, _ = _Powers.upto(len(data))
    out = []
    for (p, _), powers in zip(PRIMES, forward, strict=True):
        total = np.zeros(len(data) + 1, np.int64)
        for a in range(0, len(data), _SUMMED):
            part = (data[a : a + _SUMMED].astype(np.int64) + 1) * powers[a : a + min(_SUMMED, len(data) - a)]
            np.cumsum(part, out=total[a + 1 : a + 1 + len(part)])
            if a:
                total[a + 1 : a + 1 + len(part)] += total[a] % p
        out.append(total)
    return out


def slice_hash(prefix: list[np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the slices [start, end); equal slices have equal hashes anywhere."""
    _, inverse = _Powers.upto(len(prefix[0]))
    x, y = ((t[end] - t[start]) % p * inv[start].astype(np.int64) % p for (p, _), t, inv in zip(PRIMES, prefix, inverse, strict=True))
    return mix((x.astype(np.uint64) << np.uint64(32) | y.astype(np.uint64)) + mix((end - start).astype(np.uint64)))


def gram_hashes(prefix: list[np.ndarray], width: int) -> np.ndarray:
    """slice_hash of all slices of one width, by start."""
    _, inverse = _Powers.upto(len(prefix[0]))
    n = len(prefix[0]) - width
    x, y = ((t[width:] - t[:n]) % p * inv[:n] % p for (p, _), t, inv in zip(PRIMES, prefix, inverse, strict=True))
    out = x.view(np.uint64)
    out <<= np.uint64(32)
    out |= y.view(np.uint64)
    out += mix(np.array([width], np.uint64))
    return mix(out)


def spans_of(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of true bytes as [start, end); a run never crosses a row's edge."""
    n = len(member)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], after[-1] = False, False
    before[1:], after[:-1] = member[:-1], member[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    before[edges] = False
    after[edges - 1] = False
    return np.flatnonzero(member & ~before), np.flatnonzero(member & ~after) + 1


def slices(size: np.ndarray, most: int = 1 << 20):
    """Runs of about `most` in sum."""
    upto, lo = np.cumsum(size), 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + most, "right")))
        yield lo, hi
        lo = hi


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Minima of all stretches of this width, in two passes over blocks of it."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    rows = padded.reshape(-1, width)
    forward = np.minimum.accumulate(rows, axis=1).ravel()
    backward = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[: n - width + 1], forward[width - 1 : n])


def per_row(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many positions of each row are true."""
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def byte_table(predicate) -> np.ndarray:
    return np.array([bool(predicate(b)) for b in range(256)])


#: A-Z to a-z, everything else as it is.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: Bytes of words [^\x20\x09-\x0D]+.
NOT_SPACE = byte_table(lambda b: not (b == 0x20 or 9 <= b <= 13))
#: Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing.
ALNUM = byte_table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
