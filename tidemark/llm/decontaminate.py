"""Benchmark decontamination with an FM-index per training shard.

Words of a document that occur in no benchmark window can't be part of an occurrence, so each shard's
index holds only its maximal runs of benchmark words that are as long as the shortest window; between
runs stands an end mark. All windows are searched backwards at once through wavelet-tree ranks, the
occurrences are located through sampled suffix positions, and their word spans are merged.

Null or empty texts have no words. An item of fewer than n words, but not none, is one window. Items go
out in blocks of bounded size, however many there are. Rows with the same doc_id are judged apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common as c

WINDOW = 13
#: Text bytes of a shard with an index of its own.
SHARD_BYTES = 16 << 20
#: Text bytes of benchmark items that are sent out at once.
BLOCK_BYTES = 16 << 20
SAMPLE = 8


def suffix_array(rank: np.ndarray, longest: int) -> np.ndarray:
    """By doubling; equal ranks must differ within longest positions."""
    n = len(rank)
    _, rank = np.unique(rank, return_inverse=True)
    rank, step = rank.astype(np.int64) + 1, 1
    while True:
        key = rank * (n + 2)
        key[:-step or None] += rank[step:] if step < n else 0
        order = np.argsort(key, kind="stable")
        if step > longest:
            return order
        ordered = key[order]
        fresh = np.empty(n, np.int64)
        fresh[order] = np.cumsum(np.concatenate([[1], (ordered[1:] != ordered[:-1]).astype(np.int64)]))
        rank = fresh
        if rank.max() == n:
            return np.argsort(rank, kind="stable")
        step *= 2


class WaveletTree:
    """Ranks of symbols in a sequence, one bit vector for each bit of a symbol."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        for b in reversed(range(bits)):
            bit = (symbols >> b) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(len(symbols) - int(self.ones[-1][-1]))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        low, high = np.zeros_like(upto), upto.copy()
        for level, b in enumerate(reversed(range(self.bits))):
            ones, zeros = self.ones[level], self.zeros[level]
            bit = ((symbol >> b) & 1).astype(bool)
            low = np.where(bit, zeros + ones[low], low - ones[low])
            high = np.where(bit, zeros + ones[high], high - ones[high])
        return high - low

    def at(self, place: np.ndarray) -> np.ndarray:
        out = np.zeros(len(place), np.int64)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            bit = ones[place + 1] - ones[place]
            out = out * 2 + bit
            place = np.where(bit == 1, zeros + ones[place], place - ones[place])
        return out


class FMIndex:
    """Over sequences of symbols from 1; 0 ends each sequence."""

    def __init__(self, symbols: np.ndarray, sample: int = SAMPLE):
        ends = np.flatnonzero(symbols == 0)
        starts = np.concatenate([[0], ends[:-1] + 1])
        rank = symbols.astype(np.int64) + len(ends)
        rank[ends] = np.arange(len(ends))  # each end is its own symbol in the order
        longest = int((ends - starts).max()) + 1
        order = suffix_array(rank, longest)
        last = symbols[order - 1]
        self.tree = WaveletTree(last.astype(np.int64), max(1, int(symbols.max()).bit_length()))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols))])
        inside = np.arange(len(symbols)) - np.repeat(starts, ends - starts + 1)
        kept = inside[order] % sample == 0  # every sequence's first place is one of them
        self.kept, self.kept_before = kept, np.concatenate([[0], np.cumsum(kept)])
        self.position = order[kept]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all rows at once; symbols are right-aligned in patterns."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), len(self.kept), np.int64)
        for k in range(patterns.shape[1]):
            live = np.flatnonzero((k < lengths) & (low < high))
            s = patterns[live, patterns.shape[1] - 1 - k]
            known = s < len(self.first) - 1
            high[live[~known]] = low[live[~known]]
            live, s = live[known], s[known]
            low[live] = self.first[s] + self.tree.rank(s, low[live])
            high[live] = self.first[s] + self.tree.rank(s, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffixes: step back to a sampled one."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        while len(todo := np.flatnonzero(~self.kept[rows])):
            s = self.tree.at(rows[todo])
            rows[todo] = self.first[s] + self.tree.rank(s, rows[todo])
            steps[todo] += 1
        return self.position[self.kept_before[rows]] + steps


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all rows, and where each row's words start."""
    low = c.LOWER[data]
    start, end = c.spans_of(c.ALNUM[low], offsets)
    return c.slice_hash(c.prefix_sums(low), start, end), np.searchsorted(start, offsets)


class Phrases:
    """A block of benchmark items as windows over a vocabulary."""

    def __init__(self, items: list[tuple[str, str]], n: int = WINDOW):
        column = pa.array([t for _, t in items], pa.string())
        data, offsets = c.text_buffer(column)
        hashes, at = word_hashes(data, offsets)
        self.vocabulary = np.unique(hashes)
        symbols = np.searchsorted(self.vocabulary, hashes) + 1
        windows: dict[bytes, set[int]] = {}
        for i in range(len(items)):
            words = symbols[at[i] : at[i + 1]]
            for j in range(max(1, len(words) - n + 1)) if len(words) else ():
                windows.setdefault(words[j : j + n].tobytes(), set()).add(i)
        self.names = [str(k) for k, _ in items]
        self.items = [sorted(x) for x in windows.values()]
        rows = [np.frombuffer(k, symbols.dtype) for k in windows]
        self.lengths = np.array([len(r) for r in rows], np.int64)
        self.patterns = np.zeros((len(rows), n), np.int64)
        for i, r in enumerate(rows):
            self.patterns[i, n - len(r) :] = r
        self.shortest = int(self.lengths.min()) if rows else 0
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.vocabulary >> np.uint64(44)).astype(np.int64)] = True

    def symbols_of(self, hashes: np.ndarray) -> np.ndarray:
        """1 + the place in the vocabulary; 0 for other words."""
        out = np.zeros(len(hashes), np.int64)
        maybe = np.flatnonzero(self.seen[(hashes >> np.uint64(44)).astype(np.int64)])
        if len(maybe):
            place = np.minimum(np.searchsorted(self.vocabulary, hashes[maybe]), len(self.vocabulary) - 1)
            out[maybe] = np.where(self.vocabulary[place] == hashes[maybe], place + 1, 0)
        return out


class Shard:
    """Collects the benchmark-word runs of some documents, then finds all windows in them."""

    def __init__(self, phrases: Phrases):
        self.phrases, self.bytes = phrases, 0
        self.words: list[np.ndarray] = []
        self.symbols: list[np.ndarray] = []
        self.doc: list[np.ndarray] = []
        self.place: list[np.ndarray] = []
        self.docs = 0

    def add(self, data: np.ndarray, offsets: np.ndarray) -> None:
        hashes, at = word_hashes(data, offsets)
        symbols = self.phrases.symbols_of(hashes)
        start, end = c.spans_of(symbols > 0, at)
        enough = end - start >= max(1, self.phrases.shortest)
        start, end = start[enough], end[enough]
        if len(start):
            size = end - start + 1
            first = np.concatenate([[0], np.cumsum(size)[:-1]])
            word = np.repeat(start - first, size) + np.arange(size.sum())
            ends = first + size - 1
            word[ends] = end - 1
            run = symbols[word]
            run[ends] = 0
            doc = np.searchsorted(at, word, "right") - 1
            self.symbols.append(run)
            self.doc.append(doc + self.docs)
            self.place.append(word - at[doc])
        self.words.append(np.diff(at))
        self.docs += len(at) - 1
        self.bytes += len(data)

    def result(self) -> tuple[np.ndarray, np.ndarray, dict[int, set[int]], dict[int, list[tuple[int, int]]]]:
        """Per document: words, hit words; for those with hits: items and merged word spans."""
        n_words = np.concatenate(self.words) if self.words else np.zeros(0, np.int64)
        n_hit = np.zeros(self.docs, np.int64)
        items: dict[int, set[int]] = {}
        spans: dict[int, list[tuple[int, int]]] = {}
        if not self.symbols or not len(self.phrases.patterns):
            return n_words, n_hit, items, spans
        symbols, doc, place = map(np.concatenate, (self.symbols, self.doc, self.place))
        index = FMIndex(symbols)
        low, high = index.search(self.phrases.patterns, self.phrases.lengths)
        count = np.maximum(high - low, 0)
        if not count.any():
            return n_words, n_hit, items, spans
        which = np.repeat(np.arange(len(count)), count)
        rows = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        at = index.locate(rows)
        edge = np.zeros(len(symbols) + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + self.phrases.lengths[which], -1)
        hit = np.cumsum(edge[:-1]) > 0
        n_hit = np.bincount(doc[hit], minlength=self.docs)
        for a, b in zip(*c.spans_of(hit, np.zeros(0, np.int64)), strict=True):
            spans.setdefault(int(doc[a]), []).append((int(place[a]), int(place[b - 1]) + 1))
        for d, w in np.unique(np.stack([doc[at], which], 1), axis=0):
            items.setdefault(int(d), set()).update(self.phrases.items[w])
        return n_words, n_hit, items, spans


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[str, str]]]:
    block, held = [], 0
    for r in benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), "text").toLocalIterator():
        block.append((r.item_id or "", r.text))
        held += len(r.text.encode())
        if held >= BLOCK_BYTES:
            yield block
            block, held = [], 0
    if block:
        yield block


_SPANS = "array<struct<start:int,end:int>>"


def find_windows(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, extra: tuple[str, ...] = ()) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, items (distinct ids, sorted) and spans (merged word ranges), and extra columns.

    Blocks of items follow each other: each one's findings are staged with its input rows and merged with those so far, so
    the driver holds one block at a time, and any number of blocks gives what one block would.
    """
    c.small_batches(docs.sparkSession)
    blocks = _blocks(benchmark)
    block, after = next(blocks, []), next(blocks, None)
    out = _find(docs, Phrases(block, n), extra)
    if after is None:
        return out
    # names that no extra column can have
    keyed = docs.select("doc_id", "text", *(F.col(x).alias(f"_{i}_") for i, x in enumerate(extra))).withColumn("_row", F.monotonically_increasing_id())
    keyed = c.staged(keyed, "documents")
    found = _find(keyed, Phrases(block, n), ("_row",))
    while after is not None:
        more = _find(keyed, Phrases(after, n), ("_row",)).where("n_hit > 0").select("_row", F.col("items").alias("i"), F.col("spans").alias("s"))
        both = c.staged(found.join(more, "_row", "left"), "windows")
        joined = F.aggregate(
            F.array_sort(F.concat("spans", F.coalesce("s", F.array().cast(_SPANS)))), F.array().cast(_SPANS),
            lambda a, s: F.when((F.size(a) > 0) & (s.start <= F.element_at(a, -1).end), F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.struct(F.element_at(a, -1).start.alias("start"), F.greatest(F.element_at(a, -1).end, s.end).alias("end"))))).otherwise(F.concat(a, F.array(s))),
        )
        found = both.select("doc_id", "n_words", F.array_sort(F.array_union("items", F.coalesce("i", F.array().cast("array<string>")))).alias("items"), F.when(F.col("s").isNull(), F.col("spans")).otherwise(joined).alias("spans"), "_row")
        after = next(blocks, None)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s.end - s.start).alias("n_hit")
    found = found.select("_row", "n_words", hit, "items", "spans")
    return keyed.drop("text").join(found, "_row").select("doc_id", "n_words", "n_hit", "items", "spans", *(F.col(f"_{i}_").alias(x) for i, x in enumerate(extra)))


def _find(docs: DataFrame, phrases: Phrases, extra: tuple[str, ...]) -> DataFrame:
    fields = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = f"doc_id {fields['doc_id']}, n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>" + "".join(f", `{x}` {fields[x]}" for x in extra)
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    names = ["doc_id", "n_words", "n_hit", "items", "spans", *extra]
    columns = ["doc_id", "text", *extra]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = Shard(phrases), []

        def finish():
            n_words, n_hit, items, spans = shard.result()
            found = pa.array([sorted({phrases.names[i] for i in items.get(d, ())}) for d in range(shard.docs)], pa.list_(pa.string()))
            ranges = pa.array([[{"start": a, "end": b} for a, b in spans.get(d, ())] for d in range(shard.docs)], span_type)
            at = 0
            for kept in held:
                n = len(kept[0])
                yield pa.RecordBatch.from_arrays([kept[0], pa.array(n_words[at : at + n]), pa.array(n_hit[at : at + n]), found.slice(at, n), ranges.slice(at, n), *kept[1:]], names=names)
                at += n

        for batch in batches:
            for a, b, data, offsets in c.chunks(*c.text_buffer(batch.column(1))):
                shard.add(data, offsets)
                held.append([batch.column(0).slice(a, b - a), *(batch.column(2 + i).slice(a, b - a) for i in range(len(extra)))])
                if shard.bytes >= SHARD_BYTES:
                    yield from finish()
                    shard, held = Shard(phrases), []
        if held:
            yield from finish()

    return docs.select(*columns).mapInArrow(run, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """The verdict on every document, with a digest of its items; extra columns as they are."""
    found = find_windows(docs, benchmark, extra=extra)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "spans", *extra,
    )


def cut_spans(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without its words of the given ranges, nor what stands between words of one range."""
    if not text or not spans:
        return text
    raw = np.frombuffer(text.encode(), np.uint8)
    start, end = c.spans_of(c.ALNUM[c.LOWER[raw]], np.zeros(0, np.int64))
    keep = np.ones(len(raw), bool)
    for a, b in spans:
        keep[start[a] : end[b - 1]] = False
    return raw[keep].tobytes().decode()


__all__ = ["FMIndex", "Phrases", "Shard", "WaveletTree", "contamination", "cut_spans", "find_windows"]
