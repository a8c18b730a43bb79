"""Byte-level BPE encoding and decoding.

Two tiers: a minimal perfect hash over the vocabulary resolves pre-tokens that are whole vocabulary
entries; the rest is merged by rank, the new short words of some texts at once as rows of a matrix, anything
else with a heap over a doubly linked list of bytes.

A null or empty text gives no ids; text of any length is handled piecewise, so memory follows one text
and not the table. Extra columns are left alone: output columns are appended under the names asked for.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.common import small_batches

#: Remembered units and pre-tokens per Python worker; they only save time, results don't depend on them.
CACHE_UNITS = 150_000
CACHE_PIECES = 200_000
#: Characters of text whose new words are merged at once, and bytes of the longest of these.
TOGETHER = 1 << 20
SHORT = 32


#: The rank of a pair that is not in the vocabulary, in matrices.
NONE = np.int32(np.iinfo(np.int32).max)


class PerfectHash:
    """Hash, displace and compare: one slot per key, no empty slots."""

    def __init__(self, keys: list[bytes], load: int = 2):
        self.n = n = len(keys)
        self.buckets = max(1, n // load)
        hashed = [xxhash.xxh3_128_intdigest(k) for k in keys]
        members: list[list[int]] = [[] for _ in range(self.buckets)]
        for i, h in enumerate(hashed):
            members[h % self.buckets].append(i)
        self.shift = [0] * self.buckets
        self.slot: list[int] = [-1] * n
        self.keys: list[bytes] = [b""] * n
        free = bytearray(b"\1") * n
        order = sorted((b for b in range(self.buckets) if members[b]), key=lambda b: -len(members[b]))
        vacant = 0
        for b in order:
            if len(members[b]) == 1:  # the last ones take what is left, by name
                vacant = free.index(1, vacant)
                at, self.shift[b] = [vacant], -1 - vacant
            else:
                d = 0
                while True:
                    at = [self._place(hashed[i], d) for i in members[b]]
                    if len(set(at)) == len(at) and all(free[x] for x in at):
                        break
                    d += 1
                self.shift[b] = d
            for i, x in zip(members[b], at, strict=True):
                free[x], self.slot[x], self.keys[x] = 0, i, keys[i]

    def _place(self, h: int, d: int) -> int:
        if d < 0:
            return -1 - d
        return (((h >> 64) ^ (d * 0x9E3779B97F4A7C15)) * 0xD6E8FEB86659FD93 >> 24 & 0xFFFFFFFFFF) % self.n

    def find(self, key: bytes) -> int:
        """The key's index, or -1."""
        if not self.n:
            return -1
        h = xxhash.xxh3_128_intdigest(key)
        x = self._place(h, self.shift[h % self.buckets])
        return self.slot[x] if self.keys[x] == key else -1


class Codec:
    """Encodes and decodes with the ranks of one vocabulary file."""

    _open: dict[tuple[str, str], Codec] = {}

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.ranks = ranks
        keys = list(ranks)
        self.whole = PerfectHash(keys)
        self.id_of = [ranks[k] for k in keys]
        self.bytes_of = [b""] * (max(self.id_of, default=-1) + 1)
        for k, i in ranks.items():
            self.bytes_of[i] = k
        self.decimal = [str(i) for i in range(len(self.bytes_of))]
        self.byte_id = [ranks.get(bytes([b]), -1) for b in range(256)]
        #: For two ids (shifted together), the id of both joined.
        self.joined = {ranks[a] << 20 | ranks[b]: r for k, r in ranks.items() for i in range(1, len(k)) if (a := k[:i]) in ranks and (b := k[i:]) in ranks}
        #: The same for two bytes, by their values.
        self.pair = [self.joined.get(a << 20 | b, -1) for a in self.byte_id for b in self.byte_id]
        self.pairs = np.array(self.pair, np.int32)
        self.pairs[self.pairs < 0] = NONE
        keys = np.array(list(self.joined), np.int64)
        order = np.argsort(keys)
        self.keys, self.ranked = np.append(keys[order], np.iinfo(np.int64).max), np.append(np.array(list(self.joined.values()), np.int32)[order], NONE)
        self.pattern = regex.compile(pattern)
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.units: dict[str, tuple[int, ...]] = {}

    @classmethod
    def open(cls, path: str, pattern: str) -> Codec:
        if (path, pattern) not in cls._open:
            cls._open[path, pattern] = cls(path, pattern)
        return cls._open[path, pattern]

    def merge(self, token: bytes) -> list[int]:
        """Ids of a pre-token that is not in the vocabulary: always the lowest-ranked, leftmost pair.

        The heap holds rank and place of each pair; the bytes are linked both ways, and a pair that has
        changed since it was pushed is known by its place's present rank.
        """
        joined, n, pair = self.joined, len(token), self.pair
        ids = list(map(self.byte_id.__getitem__, token))
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        now = [pair[a << 8 | b] for a, b in zip(token, token[1:])]
        now.append(-1)
        heap = [r << 32 | i for i, r in enumerate(now) if r >= 0]
        heapify(heap)
        while heap:
            top = heappop(heap)
            i = top & 0xFFFFFFFF
            r = top >> 32
            if now[i] != r:
                continue
            j = after[i]
            k = after[i] = after[j]
            ids[i] = r
            now[j] = now[i] = -1
            if k < n:
                before[k] = i
                if (x := r << 20 | ids[k]) in joined:
                    now[i] = x = joined[x]
                    heappush(heap, x << 32 | i)
            h = before[i]
            if h >= 0:
                if (x := ids[h] << 20 | r) in joined:
                    now[h] = x = joined[x]
                    heappush(heap, x << 32 | h)
                else:
                    now[h] = -1
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Of pairs of ids (-1: none), the rank of both joined."""
        key = left.astype(np.int64) << 20 | right
        at = np.searchsorted(self.keys, key)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranked[at], NONE)

    def merge_all(self, tokens: list[bytes]) -> list[tuple[int, ...]]:
        """What merge gives for each of some tokens of one length: all take their lowest-ranked, leftmost pair, again and again."""
        n, width = len(tokens), len(tokens[0])
        data = np.frombuffer(b"".join(tokens), np.uint8).reshape(n, width)
        ids = np.array(self.byte_id, np.int32)[data]
        now = np.full((n, width), NONE, np.int32)
        now[:, :-1] = self.pairs[data[:, :-1].astype(np.int64) << 8 | data[:, 1:]]
        out: list[tuple[int, ...]] = [()] * n
        own, size = np.arange(n), width
        while len(own):
            at = now.argmin(axis=1)
            rows = np.arange(len(own))
            rank = now[rows, at]
            if (done := rank == NONE).any():
                for i, x in zip(own[done].tolist(), ids[done, :size].tolist(), strict=True):
                    out[i] = tuple(x)
                own, ids, now, at, rank = own[~done], ids[~done], now[~done], at[~done], rank[~done]
                rows = np.arange(len(own))
                if not len(own):
                    break
            size -= 1  # each row that is left has lost as many
            ids[rows, at] = rank
            later = np.arange(size) > at[:, None]
            ids = np.where(later, ids[:, 1:], ids[:, :-1])
            now = np.where(later, now[:, 1:], now[:, :-1])
            before, after = np.maximum(at - 1, 0), np.minimum(at + 1, size - 1)
            now[rows, at] = np.where(at + 1 < size, self._ranks(rank, ids[rows, after]), NONE)
            some = rows[at > 0]
            now[some, before[some]] = self._ranks(ids[some, before[some]], rank[some])
        return out

    def learn(self, texts: list[str | None]) -> None:
        """Remember the units of words of letters that are new in some texts, as unit gives them."""
        words: set[str] = set()
        for x in texts:
            if x:
                words.update(x.split(" "))
        new, by_size = words.difference(self.units), {}
        if len(self.units) + len(new) > CACHE_UNITS:
            self.units.clear()
            new = words
        if len(self.pieces) + len(new) > CACHE_PIECES:
            self.pieces.clear()
        if len(new) > min(CACHE_UNITS, CACHE_PIECES):
            return
        cores = [(x, " " + core) for x in new if (core := x.rstrip(".,;:!?")).isalpha()]
        for x in {core for _, core in cores}.difference(self.pieces):
            raw = x.encode()
            if (at := self.whole.find(raw)) >= 0:
                self.pieces[x] = (self.id_of[at],)
            elif len(raw) <= SHORT:
                by_size.setdefault(len(raw), []).append((x, raw))
        for pairs in by_size.values():
            names, raws = zip(*pairs, strict=True)
            self.pieces.update(zip(names, self.merge_all(raws), strict=True))
        get, piece, units = self.pieces.get, self.piece, self.units
        for x, core in cores:
            out = get(core) or piece(core)
            if len(x) >= len(core):
                tail = x[len(core) - 1 :]
                out += get(tail) or piece(tail)
            units[x] = out

    def encoded(self, column: pa.Array) -> Iterator[list[int]]:
        """The ids of each text of a column."""
        held: list[str | None] = []
        size = 0
        for i, x in enumerate(column, 1):
            held.append(x.as_py())
            size += len(held[-1] or "")
            if size >= TOGETHER or i == len(column):
                self.learn(held)
                yield from map(self.encode, held)
                held, size = [], 0

    def piece(self, piece: str) -> tuple[int, ...]:
        """Ids of one pre-token."""
        raw = piece.encode()
        at = self.whole.find(raw)
        out = (self.id_of[at],) if at >= 0 else tuple(self.merge(raw))
        if len(self.pieces) >= CACHE_PIECES:
            self.pieces.clear()
        self.pieces[piece] = out
        return out

    def stretch(self, text: str) -> tuple[int, ...]:
        """Ids of a stretch whose ends are pre-token ends."""
        get, piece = self.pieces.get, self.piece
        out: tuple[int, ...] = ()
        for x in self.pattern.findall(text):
            out += get(x) or piece(x)
        return out

    def unit(self, word: str) -> tuple[int, ...] | None:
        """Ids of a blank and a word; None if another blank may belong to the same pre-token."""
        if not word or word[-1].isspace():
            return None
        core = word.rstrip(".,;:!?")
        if core.isalpha():  # letters are one pre-token, and what is cut off is another
            core = " " + core
            out = self.pieces.get(core) or self.piece(core)
            if tail := word[len(core) - 1 :]:
                out += self.pieces.get(tail) or self.piece(tail)
        else:
            out = self.stretch(" " + word)
        if len(self.units) >= CACHE_UNITS:
            self.units.clear()
        self.units[word] = out
        return out

    def encode(self, text: str | None) -> list[int]:
        """Ids without special tokens.

        No pre-token spans the place where a blank follows something else than white space. So the
        text is cut there, each stretch is encoded by itself, and frequent ones are remembered.
        """
        if not text:
            return []
        first, *words = text.split(" ")
        get, unit = self.units.get, self.unit
        if not first or not first[-1].isspace():
            ids = list(self.stretch(first))
            try:
                for x in words:
                    ids += get(x) or unit(x)
                return ids
            except TypeError:  # a unit that is None: runs of white space, or at the end
                pass
        return [i for x in regex.split(r"(?<=\S)(?= )", text, flags=regex.V1) for i in self.stretch(x)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decimal_ids(self, ids: list[int]) -> str:
        return ",".join(map(self.decimal.__getitem__, ids))


def encode_column(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """df with the ids of every whole text as an array<int> column in place of the text."""
    small_batches(df.sparkSession)
    schema = T.StructType([f for f in df.schema if f.name not in (text, out)] + [T.StructField(out, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.open(path, pattern)
        for batch in batches:
            ids = pa.array([np.array(x, np.int32) for x in codec.encoded(batch.column(text))], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in schema if f.name != out), ids], names=schema.names)

    return df.mapInArrow(run, schema)


def token_digests(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Per row: key, n_tokens, digests of the ids and of the bytes that decoding the ids gives back."""
    small_batches(df.sparkSession)
    key_type = df.schema[key].dataType
    fields = [T.StructField(key, key_type), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    schema = T.StructType(fields + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, sha = Codec.open(path, pattern), hashlib.sha256
        for batch in batches:
            counts, digests, decoded, kept = [], [], [], []
            for ids in codec.encoded(batch.column(text)):
                counts.append(len(ids))
                digests.append(sha(codec.decimal_ids(ids).encode()).hexdigest())
                decoded.append(sha(codec.decode(ids)).hexdigest())
                if with_ids:
                    kept.append(np.array(ids, np.int32))
            columns = [batch.column(key), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
            if with_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.select(key, text).mapInArrow(run, schema)
