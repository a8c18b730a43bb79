"""Quality rules and a hashed n-gram log-likelihood ratio.

A document is scored by how much likelier its word 1- and 2-grams are under a multinomial fitted to
trusted documents than under one fitted to the whole raw corpus, per n-gram; a document under a fixed
threshold is rejected, as is one that fails the base rules.

Raw counts cover every document. The trusted side is a bounded sample of labelled rows
(max_labelled, taken by hash order). Null or empty texts have no words: all counts 0, score 0, not kept.
Repeated doc_ids are judged row by row. Ties can't matter: no decision depends on an order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common as c

BUCKETS = 1 << 16
#: At most so many labelled rows teach the trusted side and the threshold.
MAX_LABELLED = 20_000
#: The share of trusted labelled documents that may fall under the threshold.
TRUSTED_LOSS = 0.002
SMOOTHING = 0.5

SYMBOLS = c.byte_table(lambda b: chr(b) in "#*$%&|<>")
CONTINUATION = c.byte_table(lambda b: 0x80 <= b <= 0xBF)


def _words(data: np.ndarray, offsets: np.ndarray):
    start, end = c.spans_of(c.NOT_SPACE[data], offsets)
    return start, end, np.searchsorted(start, offsets)


def ngram_buckets(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all 1- and 2-grams of words, and the row of each. at: first word of each row, and the end."""
    h = c.slice_hash(prefix, start, end)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    pair = np.flatnonzero(row[1:] == row[:-1]) if len(row) else row
    two = c.mix(h[pair] * np.uint64(0x9E3779B97F4A7C15) + h[pair + 1])
    shift = np.uint64(64 - (BUCKETS.bit_length() - 1))
    return np.concatenate([h >> shift, two >> shift]).astype(np.int64), np.concatenate([row, row[pair]])


def base_counts(data: np.ndarray, offsets: np.ndarray):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each row, and its words."""
    start, end, at = _words(data, offsets)
    prefix = c.prefix_sums(data)
    n_words = np.diff(at)
    word_chars = c.per_row(c.NOT_SPACE[data] & ~CONTINUATION[data], offsets)
    symbols = c.per_row(SYMBOLS[data], offsets)

    line_start, line_end = c.spans_of(data != 10, offsets)
    filled = np.searchsorted(start, line_end) > np.searchsorted(start, line_start)  # a word starts in it
    line_start, line_end = line_start[filled], line_end[filled]
    row = np.searchsorted(offsets, line_start, "right") - 1
    own = c.mix(c.slice_hash(prefix, line_start, line_end) ^ c.mix(row.astype(np.uint64)))
    key = np.sort(own)
    dup_lines = np.zeros(len(n_words), np.int64)
    if len(key):
        equal = key[1:][key[1:] == key[:-1]]
        for r in np.unique(row[np.isin(own, equal)]).tolist():  # what the hashes suggest, the bytes decide
            lines = [data[a:b].tobytes() for a, b in zip(line_start[row == r].tolist(), line_end[row == r].tolist(), strict=True)]
            dup_lines[r] = len(lines) - len(set(lines))

    repeat = np.zeros(len(n_words), np.int64)
    if len(start) >= 3:
        h = c.slice_hash(prefix, start, end)
        row = np.repeat(np.arange(len(n_words), dtype=np.uint64), n_words)
        whole = np.flatnonzero(row[2:] == row[:-2])
        k = np.uint64(0x9E3779B97F4A7C15)
        three = c.mix((h[whole] * k + h[whole + 1]) * k + h[whole + 2] + c.mix(row[whole]))
        key = np.sort(three)
        twice = np.unique(key[1:][key[1:] == key[:-1]])
        if len(twice):
            place = np.minimum(np.searchsorted(twice, three), len(twice) - 1)
            hit = whole[twice[place] == three]
            marked = np.zeros(len(start), bool)
            for i in range(3):
                marked[hit + i] = True
            repeat = c.per_row(marked, at)
    return n_words, word_chars, symbols, dup_lines, repeat, (prefix, start, end, at)


@dataclass(frozen=True)
class Judge:
    """Bucket weights (log ratio, 512 KB) and the threshold; both fixed before any document is judged."""

    weights: np.ndarray
    threshold: float


def _scores(weights: np.ndarray, words, n: int) -> np.ndarray:
    buckets, row = ngram_buckets(*words)
    total = np.bincount(row, weights[buckets], minlength=n)
    return total / np.maximum(np.bincount(row, minlength=n), 1)


def labelled_ids(labels: DataFrame, limit: int = MAX_LABELLED) -> np.ndarray:
    """doc_ids of trusted rows among the first labelled ones by hash; at most limit."""
    first = labels.where(F.col("doc_id").isNotNull()).select("doc_id", "quality").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(limit)
    return np.sort(np.array([r.doc_id for r in first.collect() if r.quality == 1], np.int64))


def _trusted(ids: pa.Array, good: np.ndarray) -> np.ndarray:
    """Which doc_ids are among the good ones; null is none of them."""
    return np.isin(ids.fill_null(0).to_numpy(zero_copy_only=False), good) & ids.is_valid().to_numpy(zero_copy_only=False)


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Judge:
    """Count n-grams of all documents (raw) and of the labelled trusted ones (target) in one scan."""
    c.small_batches(docs.sparkSession)
    good = labelled_ids(labels, max_labelled)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            trusted = _trusted(batch.column(0), good)
            for a, b, data, offsets in c.chunks(*c.text_buffer(batch.column(1))):
                start, end, at = _words(data, offsets)
                buckets, row = ngram_buckets(c.prefix_sums(data), start, end, at)
                counts[0] += np.bincount(buckets, minlength=BUCKETS)
                counts[1] += np.bincount(buckets[trusted[a:b][row]], minlength=BUCKETS)
        which, bucket = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(counts[which, bucket])], names=["side", "bucket", "n"])

    raw = docs.select("doc_id", "text").mapInArrow(count, "side int, bucket int, n long")
    total = np.zeros((2, BUCKETS), np.int64)
    for r in raw.groupBy("side", "bucket").agg(F.sum("n").alias("n")).collect():  # 2 * BUCKETS rows at most
        total[r.side, r.bucket] = r.n
    share = (total + SMOOTHING) / (total.sum(axis=1, keepdims=True) + SMOOTHING * BUCKETS)
    weights = np.log(share[1]) - np.log(share[0]) if total[1].any() else np.zeros(BUCKETS)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trusted = _trusted(batch.column(0), good)
            column, ids = (batch.column(i).filter(pa.array(trusted)) for i in (1, 0))
            for a, b, data, offsets in c.chunks(*c.text_buffer(column)):
                start, end, at = _words(data, offsets)
                if len(start):
                    s = _scores(weights, (c.prefix_sums(data), start, end, at), len(offsets) - 1)
                    some = np.diff(at) > 0
                    yield pa.RecordBatch.from_arrays([ids.slice(a, b - a).filter(pa.array(some)), pa.array(s[some])], names=["doc_id", "score"])

    # rows with one doc_id count as one labelled document, by the lowest score: max_labelled rows at most
    scored = docs.select("doc_id", "text").mapInArrow(score, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    values = sorted(r.score for r in scored.groupBy("doc_id").agg(F.min("score").alias("score")).collect())
    return Judge(weights, values[int(TRUSTED_LOSS * len(values))] if values else -np.inf)


def judge(docs: DataFrame, model: Judge, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: its counts, score and verdict, and extra columns (not named like these) as they are."""
    c.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in c.chunks(*c.text_buffer(batch.column(1))):
                n_words, word_chars, symbols, dup_lines, repeat, words = base_counts(data, offsets)
                score = _scores(model.weights, words, b - a)
                failed = (n_words < 50) | (100 * repeat > 50 * n_words)
                columns = [n_words, word_chars, symbols, dup_lines, repeat, failed, score, ~failed & (score >= model.threshold)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *map(pa.array, columns), *(batch.column(2 + i).slice(a, b - a) for i in range(len(extra)))], names=names)

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"
    names = [*(x.split()[0] for x in schema.split(", ")), *extra]
    schema += "".join(f", `{x}` {docs.schema[x].dataType.simpleString()}" for x in extra)
    return docs.select("doc_id", "text", *extra).mapInArrow(run, schema)
