"""Exact substring removal: bytes that a repeated string of LENGTH bytes covers.

The full suffix array of a corpus costs many times its bytes in shuffles, so only sampled suffixes are
sorted, and recursion names longer strings for those that remain:

1. In every string of LENGTH bytes the least-hashed 32-gram is its sample, so equal strings have equal
   samples at equal offsets. Samples are named, and names that occur once drop out with all strings that
   they stand for. The union of a sample's strings is named too: if that occurs again, the sample is
   settled, and all its strings are repeated.
2. Samples that aren't settled, and settled ones whose name one of the former has, are cut into blocks of
   32 starts by their distance from the sample. A block's union and the part that all its strings share
   are named: if the union occurs again the block is settled; if the shared part doesn't, no string does.
3. The strings of open blocks, and of settled ones whose shared part an open block has, are named one by
   one.

A name is a 64-bit hash, and names are compared by aggregating them. Rounds are linear in the text; no
step needs the rows of a name together. Null texts count as empty: no bytes, nothing removed. Matches
never cross texts; rows with the same doc_id are judged apart, and copies of each other go whole.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common as c

LENGTH = 200
GRAM = 32
BLOCK = 32
_PLACE = np.uint64((1 << 30) - 1)


class Samples:
    """The samples of one text and the starts that each stands for; what is not asked for is not computed."""

    def __init__(self, raw: np.ndarray, length: int):
        self.raw, self.length, self.size, self.block = raw, length, len(raw), max(1, min(BLOCK, length // 4))

    @cached_property
    def prefix(self) -> list[np.ndarray]:
        return c.prefix_sums(self.raw)

    @cached_property
    def sample_of(self) -> np.ndarray:
        """By start."""
        gram = min(GRAM, self.length)
        hashes = c.gram_hashes(self.prefix, gram)
        least = c.sliding_least((hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64), self.length - gram + 1)[: self.size - self.length + 1]
        return (least & _PLACE).astype(np.int64)

    @cached_property
    def first(self) -> np.ndarray:
        """The first start of each sample; samples rise with the starts."""
        return np.flatnonzero(np.concatenate([[True], self.sample_of[1:] != self.sample_of[:-1]]))

    @cached_property
    def last(self) -> np.ndarray:
        return np.append(self.first[1:], len(self.sample_of)) - 1

    @cached_property
    def samples(self) -> np.ndarray:
        return self.sample_of[self.first]

    @property
    def names(self) -> np.ndarray:
        return c.slice_hash(self.prefix, self.samples, self.samples + min(GRAM, self.length))

    def wide_names(self) -> np.ndarray:
        """Of the unions of all strings that each sample stands for."""
        return c.mix(c.slice_hash(self.prefix, self.first, self.last + self.length) + (self.samples - self.first).astype(np.uint64))

    def settled(self, places: np.ndarray) -> np.ndarray:
        """Ranges (first and last start) of the given samples, neighbours joined."""
        return _joined(np.stack([self.first[places], self.last[places]], 1))

    def blocks(self, chosen: np.ndarray) -> np.ndarray:
        """(sample, block) pairs with a start whose sample is chosen."""
        chosen = np.sort(chosen)
        sample = self.samples[chosen]
        low, high = (sample - self.last[chosen]) // self.block, (sample - self.first[chosen]) // self.block
        size = high - low + 1
        return np.stack([np.repeat(sample, size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - low, size)], 1)

    def block_names(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Names of unions and of shared parts, and which blocks are whole (others lie over a text's end)."""
        first = blocks[:, 0] - blocks[:, 1] * self.block - (self.block - 1)
        last = first + self.block - 1
        whole = (first >= 0) & (last + self.length <= self.size)
        f, l = np.where(whole, first, 0), np.where(whole, last, 0)  # noqa: E741
        block = blocks[:, 1].astype(np.uint64)
        union = c.mix(c.slice_hash(self.prefix, f, np.where(whole, l + self.length, 0)) + block)
        shared = c.mix(c.slice_hash(self.prefix, last, first + self.length) - block)  # a start of each is in the text
        return union, shared, whole

    def block_ranges(self, blocks: np.ndarray) -> np.ndarray:
        first = blocks[:, 0] - blocks[:, 1] * self.block - (self.block - 1)
        return np.stack([np.maximum(first, 0), np.minimum(first + self.block - 1, self.size - self.length)], 1)

    def starts(self, blocks: np.ndarray) -> np.ndarray:
        """The starts of the given blocks that lie in the text."""
        first = blocks[:, 0] - blocks[:, 1] * self.block - (self.block - 1)
        every = (first[:, None] + np.arange(self.block)[None, :]).ravel()
        return np.unique(every[(every >= 0) & (every <= self.size - self.length)])

    def start_names(self, starts: np.ndarray) -> np.ndarray:
        return c.slice_hash(self.prefix, starts, starts + self.length)


def _joined(ranges: np.ndarray) -> np.ndarray:
    """Ranges (first, last) with those that overlap or touch made one."""
    if not len(ranges):
        return ranges
    ranges = ranges[np.argsort(ranges[:, 0], kind="stable")]
    upto = np.maximum.accumulate(ranges[:, 1])
    new = np.flatnonzero(np.concatenate([[True], ranges[1:, 0] > upto[:-1] + 1]))
    return np.stack([ranges[new, 0], np.append(upto[new[1:] - 1], upto[-1])], 1)


def _repeated(names: DataFrame) -> DataFrame:
    """rid and the places (array) whose name occurs at least twice. names: rid, place, name."""
    twice = names.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name")
    return names.join(twice, "name").groupBy("rid").agg(F.collect_list("place").alias("places"))


def _release(df: DataFrame) -> None:
    """Let Spark delete the shuffle files of steps that are written and done with."""
    gc.collect()
    df.sparkSession._jvm.System.gc()


def _list(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    return pa.array(values, pa.list_(kind))


def _verdicts(each: DataFrame, union: str, shared: str) -> DataFrame:
    """rid, settled and asked (arrays of places). each: rid, place, whole (has a union), union, shared.

    What is settled by one union is the same everywhere, so one text asks on behalf of all.
    """
    again = each.where("whole").groupBy(union).agg(F.count("*").alias("n"), F.min("rid").alias("asks")).where("n > 1").drop("n")
    settled = F.col("whole") & F.col("asks").isNotNull()
    each = each.join(again, union, "left").select("rid", "place", shared, settled.alias("settled"), (~settled | (F.col("rid") == F.col("asks"))).alias("asks"))
    open_ = each.groupBy(shared).agg(F.count("*").alias("n"), F.max(~F.col("settled")).alias("open")).where("n > 1 and open").select(shared, F.lit(True).alias("open"))
    each = each.join(open_, shared, "left").withColumn("asked", F.col("open").isNotNull() & F.col("asks")).where("settled or asked")
    return each.groupBy("rid").agg(F.collect_list(F.when(F.col("settled"), F.col("place"))).alias("settled"), F.collect_list(F.when(F.col("asked"), F.col("place"))).alias("asked"))


def _raw(x) -> np.ndarray:
    return np.frombuffer(x.as_py().encode(), np.uint8)


def _places(column: pa.Array) -> list[np.ndarray]:
    """The lists of a column, empty where there is none."""
    return np.split(column.flatten().to_numpy().astype(np.int64), np.cumsum(column.value_lengths().fill_null(0).to_numpy())[:-1])


def repeated_starts(docs: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """All texts (rid, doc_id, n_bytes, digest), and for some of them text and starts of repeated strings."""
    c.small_batches(docs.sparkSession)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, wide = [], []
            for x in batch.column(1):
                raw = _raw(x)
                one = Samples(raw, length) if len(raw) >= length else None
                names.append(one.names.view(np.int64) if one else np.zeros(0, np.int64))
                wide.append(one.wide_names().view(np.int64) if one else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, _list(names, pa.int64()), _list(wide, pa.int64())], names=["doc_id", "text", "names", "wide"])

    key = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(sample, f"doc_id {key}, text string, names array<long>, wide array<long>")
    texts = texts.select("doc_id", "text", "names", "wide", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    full = texts = c.staged(texts.withColumn("rid", F.monotonically_increasing_id()), "texts")
    each = texts.select("rid", F.posexplode(F.arrays_zip("names", "wide")).alias("place", "s")).select("rid", "place", "s.*")
    twice = each.groupBy("names").agg(F.count("*").alias("n")).where("n > 1").select("names")
    samples = c.staged(each.join(twice, "names").withColumn("whole", F.lit(True)), "samples")
    _release(texts)
    chosen = c.staged(_verdicts(samples, "wide", "names"), "samples-judged")
    c.unstage(samples)
    _release(texts)

    def name_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_())
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for x, settled, asked in zip(batch.column(1), _places(batch.column(2)), _places(batch.column(3)), strict=True):
                samples = Samples(_raw(x), length)
                blocks = samples.blocks(asked)
                union, shared, whole = samples.block_names(blocks)
                values = (samples.settled(settled).ravel().astype(np.int32), blocks.ravel().astype(np.int32), union.view(np.int64), shared.view(np.int64), whole)
                for held, v in zip(out, values, strict=True):
                    held.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(_list, out, kinds)], names=["rid", "text", "known", "blocks", "unions", "shared", "whole"])

    blocks = texts.select("rid", "text").join(chosen, "rid").mapInArrow(name_blocks, "rid long, text string, known array<int>, blocks array<int>, unions array<long>, shared array<long>, whole array<boolean>")
    blocks = c.staged(blocks, "blocks")
    texts = c.staged(full.select("rid", "doc_id", "n_bytes", "digest"), "digests")
    for done in (full, chosen):
        c.unstage(done)
    _release(texts)
    each = blocks.select("rid", F.posexplode(F.arrays_zip("unions", "shared", "whole")).alias("place", "b")).select("rid", "place", "b.*")
    judged = c.staged(_verdicts(each, "unions", "shared"), "blocks-judged")
    _release(texts)

    def name_starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int32(), pa.int32(), pa.int64())
        for batch in batches:
            out: list[list] = [[], [], []]
            for x, known, flat, settled, open_ in zip(batch.column(1), *map(_places, batch.columns[2:]), strict=True):
                every = flat.reshape(-1, 2)
                samples = Samples(_raw(x), length)
                asked = samples.starts(every[open_])
                ranges = np.concatenate([known.reshape(-1, 2), samples.block_ranges(every[settled])])
                out[0].append(_joined(ranges).ravel().astype(np.int32))
                out[1].append(asked.astype(np.int32))
                out[2].append(samples.start_names(asked).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(_list, out, kinds)], names=["rid", "text", "known", "asked", "names"])

    left = blocks.select("rid", "text", "known", "blocks").join(judged, "rid", "left")
    starts = c.staged(left.mapInArrow(name_starts, "rid long, text string, known array<int>, asked array<int>, names array<long>"), "starts")
    _release(texts)
    c.unstage(blocks)
    # written before the texts are shuffled once more, so that the names' shuffle files are gone by then
    found = c.staged(_repeated(starts.select("rid", F.posexplode("names").alias("place", "name"))), "starts-judged")
    _release(texts)
    return texts, starts.select("rid", "text", "known", "asked").join(found, "rid", "left")


def remove(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    texts, starts = repeated_starts(docs, length)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, runs, digests = [], [], []
            for x, known, asked, places in zip(batch.column(1), *map(_places, batch.columns[2:]), strict=True):
                raw = _raw(x)
                edge = np.zeros(len(raw) + 1, np.int32)
                first, last = np.concatenate([known.reshape(-1, 2), np.stack([asked[places]] * 2, 1)]).T
                np.add.at(edge, first, 1)
                np.add.at(edge, last + length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                removed.append(int(gone.sum()))
                runs.append(len(c.spans_of(gone, np.zeros(0, np.int64))[0]))
                digests.append(hashlib.sha256(raw[~gone].tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests, pa.string())], names=["rid", "n_removed", "n_spans", "kept_sha256"])

    edited = c.staged(starts.mapInArrow(cut, "rid long, n_removed long, n_spans long, kept_sha256 string"), "removed")
    _release(texts)
    zero = F.lit(0).cast("long")
    return texts.join(edited, "rid", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "digest").alias("kept_sha256")
    )
