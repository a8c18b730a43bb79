"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint is mapped to the bit counts of its 32 two-bit segments. The Manhattan distance of two such
vectors is a lower bound of the Hamming distance. The coordinates form six groups; vectors at distance
three or less agree in three whole groups at least, so the grid cells are the values of each three of six
groups, and vectors meet in a cell if at all. In a cell the Manhattan bound is tested first, then the
exact Hamming distance.

Only one of equal fingerprints takes part. Cells emit links that connect what is linked in them (all
links of small cells, else a spanning forest), which leaves components as they are; cells with more than
CELL_ROWS fingerprints are dealt in blocks, each pair of blocks to a task. Null or empty texts have the
fingerprint zero and are linked like any other; rows with the same doc_id are separate rows.

similar() asks for a Jaccard similarity of word shingles instead of a number of bits. Whole texts at 0.8 differ in about
ten of 64 bits, which no grid reaches, so beside its whole set each text has SAMPLES fingerprints of SAMPLE min-wise
samples: these are equal with the similarity's power, 0.996 for at least one at 0.8. Texts meet in the groups that the
join above makes of their fingerprints; there the shingles' counts in SEGMENTS segments bound the sets' difference from below by
the Manhattan distance, and all that pass are verified on the sets themselves before they are linked.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common as c
from tidemark.llm.graph import block_pairs, components, starred

SHINGLE = 3
SEED = 42
RADIUS = 3
GROUPS = 6
CELL_ROWS = 20_000
#: Cells up to this size emit all links, larger ones a forest.
SMALL_CELL = 8

#: For similar(): words of a shingle, least similarity, fingerprints of samples, shingles of a sample.
WORDS, SIMILARITY, SAMPLES, SAMPLE = 5, 0.8, 8, 3
#: Segments of a set's counts.
SEGMENTS = 128
#: Texts that are verified against one in one go; texts of a group that meet in a block.
STAR, BLOCK = 64, 256

_LOWER = bytes(c.LOWER.tolist())


def _masks() -> list[int]:
    """For each three of the six groups, the bits of their segments."""
    segments = np.array_split(np.arange(32), GROUPS)
    bits = [sum(3 << (2 * int(s)) for s in g) for g in segments]
    return [sum(bits[g] for g in three) for three in combinations(range(GROUPS), GROUPS - RADIUS)]


def fingerprint(raw: bytes) -> int:
    """Of the UTF-8 bytes of a text; unsigned."""
    words = raw.translate(_LOWER).split()
    if not words:
        return 0
    text = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(text, SEED)  # one shingle: more than half of it is itself
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[: -SHINGLE] + 1])
    digest, m = xxhash.xxh64_intdigest, len(starts)
    h = np.fromiter((digest(text[a:b], SEED) for a, b in zip(starts.tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)), np.uint64, m)
    counts = np.zeros(64, np.int64)
    for i in range(0, m, 16384):
        block = h[i : i + 16384]
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > m, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, for every row."""
    c.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = c.text_buffer(batch.column(1))
            raw = data.tobytes()
            fps = np.fromiter((fingerprint(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)), np.uint64, len(offsets) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def embed(fp: np.ndarray) -> np.ndarray:
    """Bit counts of the two-bit segments, each in its segment's place."""
    return fp - ((fp >> np.uint64(1)) & np.uint64(0x5555555555555555))


def ladder(counts: np.ndarray) -> np.ndarray:
    """Counts 0, 1, 2 as 00, 01, 11: the Manhattan distance is then the number of differing bits."""
    return counts | ((counts >> np.uint64(1)) & np.uint64(0x5555555555555555))


def _cells(fps: DataFrame) -> DataFrame:
    masks = np.array(_masks(), np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            counts = embed(fp)
            for i, m in enumerate(masks):
                cell = c.mix((counts & m) + np.uint64(i * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
                yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), batch.column(0), batch.column(1)], names=["cell", "fp", "id"])

    return fps.mapInArrow(run, "cell long, fp long, id long")


def near(fp: np.ndarray, rungs: np.ndarray, x: np.uint64, x_rungs: np.uint64) -> np.ndarray:
    """Places within RADIUS: first by the Manhattan lower bound, then exactly."""
    place = np.flatnonzero(np.bitwise_count(rungs ^ x_rungs) <= RADIUS)
    return place[np.bitwise_count(fp[place] ^ x) <= RADIUS]


def forest(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all that is linked: breadth first, each step only against what is not reached yet."""
    rungs, left = ladder(embed(fp)), np.arange(len(fp))
    a, b = [], []
    while len(left):
        stack, left = [left[0]], left[1:]
        while stack and len(left):
            x = stack.pop()
            hit = near(fp[left], rungs[left], fp[x], rungs[x])
            if len(hit):
                found = left[hit]
                left = np.delete(left, hit)
                a.append(np.full(len(found), x))
                b.append(found)
                stack += found.tolist()
    empty = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (empty, empty)


def _links_of_sorted(cell: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    sizes = np.diff(np.append(edges, len(cell)))
    size_of = np.repeat(sizes, sizes)
    rungs = ladder(embed(fp))
    a, b = [], []
    for s in range(1, SMALL_CELL):
        i = np.flatnonzero((cell[s:] == cell[:-s]) & (size_of[:-s] <= SMALL_CELL))
        i = i[np.bitwise_count(rungs[i] ^ rungs[i + s]) <= RADIUS]
        i = i[np.bitwise_count(fp[i] ^ fp[i + s]) <= RADIUS]
        a.append(i)
        b.append(i + s)
    for first, size in zip(edges[sizes > SMALL_CELL].tolist(), sizes[sizes > SMALL_CELL].tolist(), strict=True):
        x, y = forest(fp[first : first + size])
        a.append(x + first)
        b.append(y + first)
    return np.concatenate(a), np.concatenate(b)


def _cell_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows that come sorted by cell; a cell that goes on in the next batch waits for it."""
    held = [np.zeros(0, np.int64)] * 3

    def out(cell, fp, ids):
        a, b = _links_of_sorted(cell, fp.view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], names=["a", "b"])

    for batch in batches:
        held = [np.concatenate([x, batch.column(i).to_numpy()]) for i, x in enumerate(held)]
        if len(held[0]):
            whole = int(np.flatnonzero(np.concatenate([[True], held[0][1:] != held[0][:-1]]))[-1])
            if whole:
                yield out(*(x[:whole] for x in held))
                held = [x[whole:] for x in held]
    if len(held[0]):
        yield out(*held)


def links(reps: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Links (a, b) between ids of distinct fingerprints (fp, id) that leave the components as all links do."""
    cells = _cells(reps)
    hot = c.staged(cells.groupBy("cell").count().where(F.col("count") > cell_rows), "hot-cells")
    if hot.take(1):
        blocks = F.ceil(F.col("count") / cell_rows).cast("long")
        joined = cells.join(hot, "cell", "left").withColumn("blocks", F.coalesce(blocks, F.lit(1))).withColumn("own", F.pmod(F.xxhash64("fp"), "blocks"))
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
        dealt = joined.select("cell", "fp", "id", "own", "blocks", other)
        cells = dealt.select(F.when(F.col("blocks") == 1, F.col("cell")).otherwise(F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other"))).alias("cell"), "fp", "id")
    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(_cell_links, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable over links."""
    fps = c.staged(fingerprints(docs), "fingerprints")
    reps = fps.groupBy("fp").agg(F.min("doc_id").alias("id"))
    with_id = reps.where(F.col("id").isNotNull()).select("fp", F.col("id").cast("long").alias("id"))
    parts = components(links(with_id))
    classes = reps.join(parts, F.col("id") == F.col("node"), "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    return fps.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def shingles(raw: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text; fewer words are one shingle, none are none."""
    low = c.LOWER[np.frombuffer(raw, np.uint8)]
    start, end = c.spans_of(c.NOT_SPACE[low], np.zeros(0, np.int64))
    if not len(start):
        return np.zeros(0, np.uint64)
    h = c.slice_hash(c.prefix_sums(low), start, end)
    m = max(1, len(h) - words + 1)
    out = np.zeros(m, np.uint64)
    for k in range(min(words, len(h))):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + m]
    return np.unique(c.mix(out))


def majority(h: np.ndarray) -> int:
    """The SimHash of some hashes."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 16384):
        counts += np.unpackbits(h[i : i + 16384].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view(np.uint64)[0])


def samples(h: np.ndarray) -> np.ndarray:
    """SimHashes of SAMPLES samples, each of the least of h by SAMPLE orders of its own."""
    least = np.array([c.mix(h ^ np.uint64((k + 1) * 0xC2B2AE3D27D4EB4F & (1 << 64) - 1)).min() for k in range(SAMPLES * SAMPLE)], np.uint64).reshape(SAMPLES, SAMPLE)
    return np.array([majority(x) for x in least], np.uint64)


def _profiles(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, sizes, fps, parts, segments = [], [], [], [], []
            for x in batch.column(1):
                t = shingles((x.as_py() or "").encode(), words)
                digests.append(hashlib.blake2b(t.tobytes(), digest_size=16).digest())
                sizes.append(len(t))
                fps.append(majority(t) - (1 << 64) * (majority(t) >> 63) if len(t) else None)
                parts.append(samples(t).view(np.int64) if len(t) else np.zeros(0, np.int64))
                segments.append(np.bincount((t >> np.uint64(57)).astype(np.int64), minlength=SEGMENTS).clip(max=32767).astype(np.int16).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(fps, pa.int64()), pa.array(parts, pa.list_(pa.int64())), pa.array(segments, pa.binary())], names=["rid", "digest", "size", "fp", "samples", "segments"])

    return run


def _verify(words: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of (x, block, y, text) from starred()."""
        own = np.zeros(0, np.uint64)
        for batch in batches:
            out: list[tuple] = []
            for x, y, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                t = shingles((text.as_py() or "").encode(), words)
                if y is None:
                    own = t
                    continue
                same = len(np.intersect1d(own, t, True))
                if same >= similarity * (len(own) + len(t) - same) - 1e-9:
                    out.append((x, y))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*out, strict=True)], names=["a", "b"])

    return run


def _near(similarity: float, all_pairs: bool):
    """Rows of (name, left, right, same): pairs of different components whose sets may be similar enough: all, or the nearest of each text."""
    share = (1 - similarity) / (1 + similarity)  # of both sizes, that the difference of similar sets has at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys, sides, counts, offsets = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [], [], []
            for column in batch.columns[1:3]:
                rows = column.flatten()
                sides.append({k: rows.field(k).to_numpy() for k in ("rid", "size", "component")})
                counts.append(np.frombuffer(b"".join(rows.field("segments").to_pylist()), np.int16).reshape(-1, SEGMENTS))
                offsets.append(np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())]))
            same, wide = batch.column(3).to_numpy(zero_copy_only=False), np.diff(offsets[1])
            of = np.repeat(np.arange(len(batch)), np.diff(offsets[0]))
            for lo, hi in c.slices(wide[of], 1 << 14):
                size = wide[of[lo:hi]]
                i = np.repeat(np.arange(lo, hi), size)
                j = np.arange(len(i)) + np.repeat(offsets[1][of[lo:hi]] - np.cumsum(size) + size, size)
                worth = sides[0]["component"][i] != sides[1]["component"][j]
                if all_pairs:
                    worth &= ~same[of[i]] | (i - offsets[0][of[i]] < j - offsets[1][of[i]])
                most = share * (sides[0]["size"][i] + sides[1]["size"][j]) + 1e-9
                worth &= np.abs(sides[0]["size"][i] - sides[1]["size"][j]) <= most
                i, j, most = i[worth], j[worth], most[worth]
                far = np.abs(counts[0][i] - counts[1][j]).sum(axis=1, dtype=np.int64)
                i, j, far = i[far <= most], j[far <= most], (far / most)[far <= most]
                if not all_pairs and len(i):
                    best = []
                    for one, other in ((i, j), (j, i)):
                        order = np.lexsort((other, far, one))
                        best.append(order[np.concatenate([[True], one[order][1:] != one[order][:-1]])])
                    k = np.unique(np.concatenate(best))
                    i, j = i[k], j[k]
                xs.append(sides[0]["rid"][i])
                ys.append(sides[1]["rid"][j])
            x, y = np.concatenate(xs), np.concatenate(ys)
            pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["x", "y"])

    return run


def similar(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(rid, component): the smallest rid reachable, for all rows of staged docs (rid, text) that have a partner.

    Texts without words have equal (empty) sets, and so are each other's copies. Extra columns don't matter.
    """
    c.small_batches(docs.sparkSession, 500, 4)
    sets = docs.select("rid", "text").mapInArrow(_profiles(words), "rid long, digest binary, size long, fp long, samples array<long>, segments binary")
    sets = c.staged(sets, "profiles")
    copies = c.staged(sets.groupBy("digest").agg(F.min("rid").alias("rep")), "sets")
    equal = sets.select("rid", "digest").join(copies, "digest").where("rid <> rep").select(F.col("rid").alias("a"), F.col("rep").alias("b"))
    # of the whole sets' fingerprints, the groups that the grid join makes; of the samples', those that are equal
    fps = sets.where("fp is not null").groupBy("fp").agg(F.min("rid").alias("id"))
    parts = components(links(fps)).withColumnRenamed("node", "id")
    groups = fps.join(parts, "id", "left").select("fp", F.xxhash64(F.lit(-1), F.coalesce("component", "id")).alias("name"))
    reps = sets.join(copies.select(F.col("rep").alias("rid")), "rid", "left_semi")
    named = reps.join(groups, "fp").select("rid", "name").unionByName(reps.select("rid", F.posexplode("samples").alias("k", "s")).select("rid", F.xxhash64("k", "s").alias("name")))
    named = c.staged(named, "names")
    shared = c.staged(named.join(named.groupBy("name").agg(F.count("*").alias("n"), F.min("rid").alias("head")).where("n > 1"), "name"), "groups")
    texts = c.staged(docs.select("rid", "text").join(shared.select("rid").distinct().hint("merge"), "rid", "left_semi"), "texts")
    size = sets.select("rid", "size", "segments")

    def verified(pairs: DataFrame) -> DataFrame:
        return c.staged(starred(pairs, texts, STAR).mapInArrow(_verify(words, similarity), "a long, b long"), "similar")

    tried = c.staged(shared.where("rid <> head").select(F.col("head").alias("x"), F.col("rid").alias("y")).distinct(), "pairs")
    linked = c.staged(verified(tried).unionByName(equal), "links")
    for all_pairs in (False, True):
        parts = c.staged(components(linked), "components")
        now = shared.select("name", "rid").join(parts.withColumnRenamed("node", "rid"), "rid", "left").withColumn("component", F.coalesce("component", "rid"))
        apart = now.groupBy("name").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("name")
        rows = c.staged(now.join(apart, "name", "left_semi").join(size, "rid"), "apart")
        held = ["rid", "size", "component", "segments"]
        pairs = block_pairs(rows, "name", BLOCK, held).mapInArrow(_near(similarity, all_pairs), "x long, y long").distinct().join(tried, ["x", "y"], "left_anti")
        pairs = c.staged(pairs, "pairs")
        if pairs.take(1):
            tried = tried.unionByName(pairs)
            linked = c.staged(linked.unionByName(verified(pairs)), "links")
        c.unstage(rows)
    out = c.staged(components(linked).withColumnRenamed("node", "rid"), "similar")
    for done in (sets, copies, named, shared, texts, linked):
        c.unstage(done)
    return out
