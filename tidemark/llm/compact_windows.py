"""Near-duplicate passages by compact windows.

Tokens are hashes of five-word shingles (words as in `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased). For each of
HASHES min-hash functions the Cartesian tree over a text's token hashes is walked from its root: a node
is the smallest token of the stretch [a, b] below it, so all subsequences of [a, b] that hold it have it
as their signature. Nodes with stretches of at least TOKENS tokens are the text's compact windows.

A window whose signature only one text has drops out first: windows are dealt to buckets by signature, as lists, and a
bucket is judged whole, so its size (BUCKET on average, and never less than all windows of one signature) must fit a worker. Where windows of two functions intersect in TOKENS tokens
with both signatures inside, the subsequences there share both: such pairs of signatures (NEEDED of HASHES) are what
texts meet by, so strangers that share a phrase seldom meet. All windows of a pair of signatures are compared with
that of its first text, in blocks, and verified: shared tokens are chained in order, and the longest parts of
the chain are taken that have a Jaccard similarity of SIMILARITY, with stretches under TOKENS filled up to it;
shingle sets decide. Where order is lost, the longest stretches with a share of ENOUGH are judged. Windows that no
passage covers yet, or whose text is in another component, are then compared with the others of their pair, in blocks
of BLOCK, by the tokens around the signatures: the nearest of each is verified, and after that all
of texts that still are in different components, so that no link between classes is left out.

Links are kept between class representatives: documents are grouped by single linkage, and n_links is how many other
texts a document's class holds, each of them reachable over verified passages.

Equal texts are one text with a class of rows. Null, empty and short texts have no windows: n_links 0.
Rows with the same doc_id are separate rows, and so are rows without one; class_id is the smallest doc_id
of a class, null if it has none. Extra columns are left out, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import combinations, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import common as c
from tidemark.llm.graph import block_pairs, components, starred

SHINGLE = 5
#: Shingles of the shortest passage: 50 words.
TOKENS = 46
HASHES = 4
NEEDED = 2
SIMILARITY = 0.8
#: The share of tokens in common at which two sets of one size are similar enough.
ENOUGH = 2 * SIMILARITY / (1 + SIMILARITY)
#: Texts that are verified against one in one go.
STAR = 64
#: Windows of one block.
BLOCK = 4096
#: What insertions may move a token by in the shortest passages.
MOVED = 2
#: Tokens around a signature that are compared: all stretches of TOKENS with it.
AROUND = 2 * TOKENS - 1
#: How many of such a stretch must be shared: one less than similar sets of this size share.
SHARED = 40
#: Segments for a quick upper bound of that: a stretch holds WHOLE of them wholly.
SEGMENT = 5
WHOLE = (TOKENS - SEGMENT + 1) // SEGMENT
LEAST = SHARED - (TOKENS - SEGMENT * WHOLE) - 1
#: Some TOKENS places on end of a passage hold so many shared tokens: a stretch with a share of SIMILARITY has at
#: least that many in one of its runs of TOKENS, whatever is left over at its end (30 a run make less at any length).
DENSE = 31
#: Windows of one bucket, on average, and what a task deals in one go.
BUCKET = 500_000
DEALT = 1 << 18
#: Bytes of text whose shingles are hashed in one go.
HASHED = 1 << 16


def token_rows(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Hashes of all shingles of each text."""
    rows = []
    for _, _, raw, edges in c.chunks(data, offsets, HASHED):
        low = c.LOWER[raw]
        start, end = c.spans_of(c.NOT_SPACE[low], edges)
        h = c.slice_hash(c.prefix_sums(low), start, end)
        out = np.zeros(max(0, len(h) - SHINGLE + 1), np.uint64)
        for k in range(SHINGLE):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(out) + k]
        out = c.mix(out)
        rows += [out[a : max(a, b - SHINGLE + 1)] for a, b in pairwise(np.searchsorted(start, edges).tolist())]
    return rows


def tokens_of(raw: np.ndarray) -> np.ndarray:
    """Hashes of all shingles of a text."""
    return token_rows(raw, np.array([0, len(raw)]))[0]


def signature(tokens: np.ndarray, k: int) -> np.ndarray:
    """The k-th min-hash function."""
    return c.mix(tokens ^ np.uint64((k + 1) * 0xC2B2AE3D27D4EB4F & (1 << 64) - 1))


def nearest_smaller(values: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value the nearest place before it with none greater, and after it with a smaller one, in its text; n if none.

    A place that is too great is left for the one that it has itself reached, as all between are greater still.
    """
    n, sides = len(values), []
    inner = text[1:] == text[:-1]
    for to, greater in ((np.append(n, np.where(inner, np.arange(n - 1), n)), np.greater), (np.append(np.where(inner, np.arange(1, n), n), n), np.greater_equal)):
        on = np.flatnonzero(to < n)
        while len(on := on[greater(values[to[on]], values[on])]):
            to[on] = to[to[on]]
            on = on[to[on] < n]
        sides.append(to)
    return sides[0], sides[1]


def window_rows(h: np.ndarray, edges: np.ndarray, shortest: int) -> np.ndarray:
    """(a, c, b) of the Cartesian trees' nodes over at least `shortest` values, by c; ties to the left.

    h: the values of all texts, text i those of edges[i] to edges[i + 1]. A node is the least value of a stretch of
    `shortest`, and the nearest smaller values on both sides of it are nodes too.
    """
    size = np.diff(edges)
    first = edges[:-1][size >= shortest]
    if not len(first):
        return np.zeros((0, 3), np.int64)
    beyond = first + size[size >= shortest] - shortest + 1  # starts of stretches end here
    least = c.sliding_least(h, shortest)
    new = np.ones(len(least), bool)
    new[1:] = least[1:] != least[:-1]
    new[first] = True
    s = first[0] + np.flatnonzero(new[first[0] :])
    until = np.minimum(beyond[np.searchsorted(first, s, "right") - 1], np.append(s[1:], len(least)))
    found, reach = [], np.arange(shortest)
    while (on := s < until).any():  # again for equal values
        s, until = s[on], until[on]
        s = s + h[s[:, None] + reach].argmin(axis=1)
        found.append(s)
        s = s + 1
    m = np.sort(np.concatenate(found))
    text = np.searchsorted(first, m, "right") - 1
    before, after = nearest_smaller(h[m], text)
    places = np.append(m, 0)
    left = np.where(before < len(m), places[before] + 1, first[text])
    right = np.where(after < len(m), places[after] - 1, beyond[text] + shortest - 2)
    return np.stack([left, m, right], 1)


def compact_windows(h: np.ndarray, shortest: int) -> list[tuple[int, int, int]]:
    """(a, c, b) of the Cartesian tree's nodes over at least `shortest` values of one text."""
    return list(map(tuple, window_rows(h, np.array([0, len(h)]), shortest).tolist()))


def outermost(names: np.ndarray, text: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Which nodes (a, c, b), by text and c, don't lie in another one of the same signature.

    Two nodes are apart or one holds the other; of equal values that is the left one, which comes first and ends last.
    """
    keep, key = np.ones(len(names), bool), c.mix(text.astype(np.uint64)) + names
    order = np.argsort(key, kind="stable")
    same = (key[order[1:]] == key[order[:-1]]) & (names[order[1:]] == names[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
    end = np.cumsum(np.append(np.zeros(min(1, len(names)), np.int64), ~same)) << 40 | places[order, 2]
    keep[order[1:][same & (end[1:] <= np.maximum.accumulate(end)[:-1])]] = False
    return keep


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (doc_id, text, t1, t2); the low bits of a name say which function it is of."""
    for batch in batches:
        tokens = token_rows(*c.text_buffer(batch.column(1)))
        edges = np.cumsum([0, *map(len, tokens)])
        every, texts, names, places = np.concatenate([np.zeros(0, np.uint64), *tokens]), [], [], []
        for k in range(HASHES):
            h = signature(every, k)
            found = window_rows(h, edges, TOKENS)
            text = np.searchsorted(edges, found[:, 1], "right") - 1
            kept = outermost(h[found[:, 1]], text, found)
            found, text = found[kept], text[kept]
            texts.append(text)
            names.append(h[found[:, 1]] // np.uint64(HASHES) * np.uint64(HASHES) + np.uint64(k))
            places.append(found - edges[text][:, None])
        text = np.concatenate(texts)
        order = np.argsort(text, kind="stable")
        upto = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(tokens)))])
        named = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(np.concatenate(names)[order].view(np.int64)))
        placed = pa.ListArray.from_arrays(pa.array(3 * upto, pa.int32()), pa.array(np.concatenate(places)[order].ravel().astype(np.int32)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), named, placed], names=["doc_id", "t1", "t2", "names", "places"])


def joint(names: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of signatures of one text that TOKENS tokens have in common: their names, and (a, c, b) of each.

    c is the place of the signature of the first function. Of places with one name those inside another one go.
    The high half of a place is its text, and windows of different texts have nothing in common.
    """
    kind = (names.view(np.uint64) % np.uint64(HASHES)).astype(np.int64)
    out, at = [np.zeros(0, np.uint64)], [np.zeros((0, 3), np.int64)]
    for k, m in combinations(range(HASHES), 2):
        left, right = np.flatnonzero(kind == k), np.flatnonzero(kind == m)
        right = right[np.argsort(places[right, 1], kind="stable")]
        # of the second function's windows, those with a signature in the first one's window
        first = np.searchsorted(places[right, 1], places[left, 0])
        size = np.searchsorted(places[right, 1], places[left, 2], "right") - first
        for lo, hi in c.slices(size):
            i = np.repeat(left[lo:hi], size[lo:hi])
            j = right[np.repeat(first[lo:hi] - np.cumsum(size[lo:hi]) + size[lo:hi], size[lo:hi]) + np.arange(len(i))]
            a, b = np.maximum(places[i, 0], places[j, 0]), np.minimum(places[i, 2], places[j, 2])
            good = (places[j, 0] <= places[i, 1]) & (places[i, 1] <= places[j, 2]) & (b - a + 1 >= TOKENS)
            i, j = i[good], j[good]
            out.append(c.mix(names[i].view(np.uint64) + c.mix(names[j].view(np.uint64))))
            at.append(np.stack([a[good], places[i, 1], b[good]], 1))
    name, place = np.concatenate(out), np.concatenate(at)
    order = np.lexsort((place[:, 0] - place[:, 2], name, place[:, 0] >> 32))  # the widest first
    name, place = name[order], place[order]
    text = place[:, 0] >> 32
    again = np.flatnonzero((name[1:] == name[:-1]) & (text[1:] == text[:-1])) + 1
    if not len(again):
        return name, place
    keep, held = np.ones(len(name), bool), {}
    for n in again.tolist():
        own = held.setdefault((int(text[n]), int(name[n])), [n - 1])
        keep[n] = not any(place[p, 0] <= place[n, 0] and place[n, 2] <= place[p, 2] for p in own)
        if keep[n]:
            own.append(n)
    return name[keep], place[keep]


def _dealt(parts: Iterator[list[np.ndarray]], names: list[str], buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows of (bucket, lists of the columns) by the bucket of the first column, which is sent if it has a name: a few rows in place of one for each value."""

    def deal(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        columns = [np.concatenate(x) for x in zip(*held, strict=True)]
        bucket = ((columns[0].view(np.uint64) >> np.uint64(24)) % np.uint64(buckets)).astype(np.int32)
        order, size = np.argsort(bucket, kind="stable"), np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(size)
        upto, columns = pa.array(np.concatenate([[0], np.cumsum(size[some])]), pa.int32()), columns[-len(names) :]
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *(pa.ListArray.from_arrays(upto, pa.array(x[order])) for x in columns)], names=["bucket", *names])

    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part[0])
        if size >= DEALT:
            yield deal(held)
            held, size = [], 0
    if size:
        yield deal(held)


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of each bucket, whole, from rows sorted by bucket."""
    last, held = None, []
    for batch in batches:
        for i, bucket in enumerate(batch.column(0).to_pylist()):
            if bucket != last and held:
                yield [np.concatenate(x) for x in zip(*held, strict=True)]
                held = []
            last = bucket
            held.append([x[i].values.to_numpy() for x in batch.columns[1:]])
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _flat(columns: list[np.ndarray], names: list[str]) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(columns[0]), DEALT):
        yield pa.RecordBatch.from_arrays([pa.array(x[a : a + DEALT]) for x in columns], names=names)


_NAMED = ["name", "tag", "rid", "a", "c", "b"]
_JOINED = ["joint", "rid", "a", "c", "b"]


def _deal_names(buckets: int):
    """Rows of (rid, tag, names, places) to windows by the bucket of their name."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        for batch in batches:
            size, places = batch.column(2).value_lengths().to_numpy(), batch.column(3).flatten().to_numpy().reshape(-1, 3)
            yield [batch.column(2).flatten().to_numpy(), np.repeat(batch.column(1).to_numpy(), size), np.repeat(batch.column(0).to_numpy(), size), *places.T]

    return lambda batches: _dealt(parts(batches), _NAMED, buckets)


def _shared_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, name, a, c, b) of the windows whose name rows of different tags have."""
    for name, tag, *rest in _buckets(batches):
        order = np.argsort(name)
        name, tag = name[order], tag[order]
        first = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
        shared = np.minimum.reduceat(tag, first) != np.maximum.reduceat(tag, first)
        kept = np.repeat(shared, np.diff(np.append(first, len(name))))
        rid, *places = (x[order[kept]] for x in rest)
        yield from _flat([rid, name[kept], *places], ["rid", "name", "a", "c", "b"])


def _deal_joints(buckets: int):
    """Rows of (rid, windows) to pairs of signatures by the bucket of their joint."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        for batch in batches:
            windows, text = batch.column(1).flatten(), np.repeat(np.arange(len(batch)), batch.column(1).value_lengths().to_numpy())
            name, place = joint(windows.field("name").to_numpy(), np.stack([windows.field(n).to_numpy() for n in "acb"], 1) + (text[:, None] << 32))
            yield [name.view(np.int64), batch.column(0).to_numpy()[place[:, 0] >> 32], *(place & (1 << 32) - 1).astype(np.int32).T]

    return lambda batches: _dealt(parts(batches), _JOINED, buckets)


def _shared_joints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(joint, rid, a, c, b, lo, cx, ax, bx) of the joints that two texts have: lo is the least rid, followed by its first window."""
    for name, rid, a, *rest in _buckets(batches):
        order = np.lexsort((a, rid, name))
        name, rid, a, c_, b = (x[order] for x in (name, rid, a, *rest))
        first = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
        size = np.diff(np.append(first, len(name)))
        shared = rid[first] != rid[first + size - 1]
        kept, head = np.repeat(shared, size), np.repeat(first[shared], size[shared])
        yield from _flat([*(x[kept] for x in (name, rid, a, c_, b)), *(x[head] for x in (rid, c_, a, b))], [*_JOINED, "lo", "cx", "ax", "bx"])


def _longest(shared: np.ndarray) -> tuple[int, int]:
    """First and last place of the longest stretch with a share of ENOUGH; (0, -1) if there is none."""
    score = np.concatenate([[0.0], np.cumsum(shared - ENOUGH)])
    last = np.searchsorted(-np.maximum.accumulate(score[::-1])[::-1], 1e-9 - score, "right") - 1
    first = int((last - np.arange(len(score))).argmax())
    return first, int(last[first]) - 1


def _chain(left: np.ndarray, right: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of shared tokens, rising on both sides; of a token's places on the right, that nearest to the shift."""
    place, size = np.full(max(left.max(), right.max()) + 1, -1), len(left) + len(right)
    place[right] = np.arange(len(right))
    if (place[right] == np.arange(len(right))).all():  # each has one place on the right
        j = place[left]
        i = np.flatnonzero(j >= 0)
        return _rising(i, j[i])
    at = np.arange(len(left))
    keys = np.sort(right * size + np.arange(len(right)))
    goal = left * size + np.clip(at - shift, 0, len(right) - 1)
    k = np.searchsorted(keys, goal)
    after, before = keys[np.minimum(k, len(keys) - 1)], keys[np.maximum(k - 1, 0)]
    far = 4 * size
    d_after = np.where(after // size == left, np.abs(after - goal), far)
    d_before = np.where(before // size == left, np.abs(before - goal), far)
    i = np.flatnonzero(np.minimum(d_after, d_before) < far)
    return _rising(i, np.where(d_after <= d_before, after, before)[i] % size)


def _rising(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The longest part in which j rises as i does."""
    if (np.diff(j) > 0).all():
        return i, j
    ends, places, back = [], [], np.full(len(j), -1)
    for n, x in enumerate(j.tolist()):
        k = bisect_left(ends, x)
        back[n] = places[k - 1] if k else -1
        ends[k : k + 1], places[k : k + 1] = [x], [n]
    kept, n = [], places[-1]
    while n >= 0:
        kept.append(n)
        n = back[n]
    return i[kept[::-1]], j[kept[::-1]]


def _filled(first: int, last: int, n: int) -> tuple[int, int]:
    """The stretch with what follows, then what precedes, up to TOKENS."""
    last = max(last, min(n - 1, first + TOKENS - 1))
    return max(0, min(first, last - TOKENS + 1)), last


def _similar(left: np.ndarray, right: np.ndarray) -> bool:
    """Whether two stretches of numbered tokens are."""
    if min(len(left), len(right)) < TOKENS:
        return False
    a, b = np.zeros((2, max(left.max(), right.max()) + 1), bool)
    a[left], b[right] = True, True
    same = np.count_nonzero(a & b)
    return same >= SIMILARITY * (np.count_nonzero(a) + np.count_nonzero(b) - same)


def passages(left: np.ndarray, right: np.ndarray, shift: int) -> list[tuple[int, int, int, int]]:
    """Similar stretches (first and last on the left, then on the right) of two windows of numbered tokens."""
    i, j = _chain(left, right, shift)
    out, todo = [], [(0, len(i))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < ENOUGH * TOKENS:
            continue
        x, y, n = i[lo:hi], j[lo:hi], np.arange(hi - lo)
        score = (1 + SIMILARITY) * n - SIMILARITY * (x + y)
        # per start, the last end at which the part is similar enough
        end = np.searchsorted(-np.maximum.accumulate(score[::-1])[::-1], 1 - SIMILARITY + 1e-9 - score, "right") - 1
        a, b = np.maximum(x[end] - x + 1, TOKENS), np.maximum(y[end] - y + 1, TOKENS)
        good = (1 + SIMILARITY) * (end - n + 1) >= SIMILARITY * (a + b) - 1e-9
        if not good.any():
            continue
        s = int(np.where(good, end - n, -1).argmax())
        t = int(end[s])
        fx, lx = _filled(int(x[s]), int(x[t]), len(left))
        fy, ly = _filled(int(y[s]), int(y[t]), len(right))
        if _similar(left[fx : lx + 1], right[fy : ly + 1]):
            out.append((fx, lx, fy, ly))
        todo += [(lo, lo + s), (lo + t + 1, hi)]
    if not out:
        member = np.zeros(max(left.max(), right.max()) + 1, bool)
        (fx, lx), (fy, ly) = _longest(_common(member, left, right)), _longest(_common(member, right, left))
        if _similar(left[fx : lx + 1], right[fy : ly + 1]):
            out.append((fx, lx, fy, ly))
    return out


def _common(member: np.ndarray, tokens: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which tokens are among the others; member is scratch space, false before and after."""
    member[others] = True
    out = member[tokens]
    member[others] = False
    return out


def _dense(shared: np.ndarray) -> np.ndarray:
    """At which places DENSE of the TOKENS from there on are shared."""
    upto = np.zeros(len(shared) + 1, np.int32)
    np.cumsum(shared, out=upto[1:])
    return upto[TOKENS:] - upto[:-TOKENS] >= DENSE


def _possible(left: np.ndarray, right: np.ndarray) -> bool:
    """Whether stretches of two windows can be similar: both have a share of SIMILARITY, the shorter one of ENOUGH."""
    one, two = sorted((_best(left), _best(right)))
    return one >= SIMILARITY and two >= ENOUGH


def _best(shared: np.ndarray) -> float:
    """The greater of SIMILARITY and ENOUGH that a stretch of at least TOKENS has as its share; 0 if none."""
    if len(shared) >= TOKENS and np.count_nonzero(shared) >= ENOUGH * len(shared):
        return ENOUGH  # the whole has it
    upto = np.zeros(len(shared) + 1)
    np.cumsum(shared, out=upto[1:])
    for share in (ENOUGH, SIMILARITY):
        score = upto - share * np.arange(len(upto))
        if (score[TOKENS:] - np.minimum.accumulate(score[:-TOKENS])).max() >= -1e-6:
            return share
    return 0.0


def _numbered(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of a text once, sorted, and the number of each place's token."""
    return np.unique(tokens, return_inverse=True)


def verified(own: tuple[np.ndarray, np.ndarray], right: np.ndarray, spans: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Passages of a numbered text and another one by their windows (c_x, a_x, b_x, c_y, a_y, b_y), the widest windows first."""
    known, left = own
    if min(len(left), len(right)) < TOKENS:
        return []
    numbers = np.minimum(np.searchsorted(known, right), len(known) - 1)
    among = known[numbers] == right
    on_right = _dense(among)
    if not on_right.any():
        return []
    member = np.zeros(len(known) + len(right), bool)
    on_left = _dense(_common(member, left, numbers[among]))
    # windows without such places on both sides hold no passage
    upto_left, upto_right = (np.concatenate([[0], np.cumsum(x)]) for x in (on_left, on_right))
    spans = spans[(upto_left[spans[:, 2] - TOKENS + 2] > upto_left[spans[:, 1]]) & (upto_right[spans[:, 5] - TOKENS + 2] > upto_right[spans[:, 4]])]
    if not len(spans):
        return []
    numbers[~among] = len(known) + np.unique(right[~among], return_inverse=True)[1]
    right = numbers
    found: list[tuple[int, int, int, int]] = []
    seen: set[tuple] = set()  # one stretch holds many signatures
    todo = spans[np.lexsort((spans[:, 5], spans[:, 4], spans[:, 3], spans[:, 0], spans[:, 1], spans[:, 1] - spans[:, 2]))]  # never by the order of arrival
    px, py, done = todo[:, 0], todo[:, 3], np.zeros(len(todo), bool)
    for i, (cx, ax, bx, cy, ay, by) in enumerate(todo.tolist()):
        key = (ax, bx, ay, by, cx - cy)
        if done[i] or key in seen:
            continue  # it lies in a passage that is verified already, or its windows are
        seen.add(key)
        whole, other = left[ax : bx + 1], right[ay : by + 1]
        shared = _common(member, whole, other), _common(member, other, whole)
        if min(map(np.count_nonzero, shared)) < ENOUGH * TOKENS or not _possible(*shared):
            continue  # too few for any stretch
        for fx, lx, fy, ly in passages(whole, other, cx - ax - cy + ay):
            found.append((ax + fx, ax + lx, ay + fy, ay + ly))
            done |= (px >= ax + fx) & (px <= ax + lx) & (py >= ay + fy) & (py <= ay + ly)
    return list(dict.fromkeys(found))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (x, block, y, text, joint and places of the spans), sorted; before the rows of a block stands x itself, without y.

    Passages are (x, y, ax, bx, ay, by) without a joint; the spans of which a signature is in none of them are (x, y, cx, cx, cy, cy, joint).
    """
    own, left = None, _numbered(np.zeros(0, np.uint64))
    for batch in batches:
        out: list[tuple] = []
        tokens, spans = token_rows(*c.text_buffer(batch.column(3))), np.stack([x.flatten().to_numpy() for x in batch.columns[5:]], 1).astype(np.int64)
        joint, size = batch.column(4).flatten().to_numpy(), batch.column(4).value_lengths().fill_null(0).to_numpy()
        upto, still = np.cumsum([0, *size]).tolist(), np.ones(len(spans), bool)
        for x, y, own_tokens, (lo, hi) in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), tokens, pairwise(upto), strict=True):
            if y is None:
                own, left = x, _numbered(own_tokens)
                continue
            assert own == x
            if found := verified(left, own_tokens, spans[lo:hi]):
                out += ((x, y, *f) for f in found)
                ranges = np.array(found)
                still[lo:hi] = ~(_within(ranges[:, :2], spans[lo:hi, 0]) & _within(ranges[:, 2:], spans[lo:hi, 3]))
        x, y = (np.repeat(batch.column(i).fill_null(0).to_numpy(), size)[still] for i in (0, 2))
        cx, cy = spans[still, 0], spans[still, 3]
        rows = np.concatenate([np.array(out, np.int64).reshape(-1, 6), np.stack([x, y, cx, cx, cy, cy], 1)])
        if len(rows):
            joints = np.concatenate([np.zeros(len(out), np.int64), joint[still]])
            yield pa.RecordBatch.from_arrays([*map(pa.array, np.ascontiguousarray(rows.T)), pa.array(joints, mask=np.arange(len(rows)) < len(out))], names=["x", "y", "ax", "bx", "ay", "by", "joint"])


def _within(ranges: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Which places are in one of the ranges."""
    return ((ranges[:, :1] <= places) & (places <= ranges[:, 1:])).any(axis=0)


#: So many pairs of texts may be sent to all workers, to read only their texts.
FEW = 10_000


def _passages(edges: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Staged edges (x, y, lists of spans), verified: passages (x, y, ax, bx, ay, by), and (x, y, cx, cy, joint) of the spans that none of their pair covers; each x is sent once for STAR others."""
    if edges.count() <= FEW:
        ends = edges.select(F.col("x").alias("rid")).unionByName(edges.select(F.col("y").alias("rid"))).distinct()
        texts = texts.join(F.broadcast(ends), "rid", "left_semi")
    both = c.staged(starred(edges, texts, STAR).mapInArrow(_verify, "x long, y long, ax long, bx long, ay long, by long, joint long"), "passages")
    return both.where("joint is null").drop("joint"), both.where("joint is not null").select("x", "y", F.col("ax").alias("cx"), F.col("ay").alias("cy"), "joint")


_PLACES = ("cx", "ax", "bx", "cy", "ay", "by")
_SPAN = ("joint", *_PLACES)


def _deal_spans(buckets: int):
    """Rows of (lo, rid, joint, places) to spans by the bucket of their pair of texts."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        for batch in batches:
            x, y, *rest = (v.to_numpy() for v in batch.columns)
            yield [c.mix(x.view(np.uint64) + c.mix(y.view(np.uint64))).view(np.int64), x, y, *rest]

    return lambda batches: _dealt(parts(batches), ["x", "y", *_SPAN], buckets)


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(x, y, lists of the joints and places) of each pair of texts."""
    for x, y, *rest in _buckets(batches):
        order = np.lexsort((y, x))
        x, y, *rest = (v[order] for v in (x, y, *rest))
        first = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])]))
        upto = np.append(first, len(x))
        for lo, hi in c.slices(np.diff(upto), DEALT):
            own, at = slice(upto[lo], upto[hi]), pa.array(upto[lo : hi + 1] - upto[lo], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(x[first[lo:hi]]), pa.array(y[first[lo:hi]]), *(pa.ListArray.from_arrays(at, pa.array(v[own])) for v in rest)], names=["x", "y", *_SPAN])


def _edges(rows: DataFrame) -> DataFrame:
    """Staged (x, y, lists of the joints and places) of rows (joint, rid, a, c, b, lo, cx, ax, bx) with the first row of their joint."""
    lists, spark = ", ".join(f"{n} array<{'long' if n == 'joint' else 'int'}>" for n in _SPAN), rows.sparkSession
    buckets = max(96, rows.count() // BUCKET)
    flat = rows.where("rid <> lo").select("lo", "rid", "joint", "cx", "ax", "bx", "c", "a", "b")
    c.small_batches(spark, 1 << 16, 4)
    dealt = flat.mapInArrow(_deal_spans(buckets), f"bucket int, x array<long>, y array<long>, {lists}")
    out = c.staged(dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_paired, f"x long, y long, {lists}"), "edges")
    c.small_batches(spark, 500, 4)
    return out


def _ranges(found: DataFrame) -> DataFrame:
    """rid and the places that its passages cover."""
    ranges = found.select(F.col("x").alias("rid"), F.col("ax").alias("first"), F.col("bx").alias("last")).unionByName(found.select("y", "ay", "by").toDF("rid", "first", "last"))
    return ranges.groupBy("rid").agg(F.collect_set(F.struct("first", "last")).alias("ranges"))


def _inside(ranges: str, place) -> F.Column:
    return F.coalesce(F.exists(ranges, lambda r: (r.first <= place) & (place <= r.last)), F.lit(False))


def _uncovered(spans: DataFrame, found: DataFrame) -> DataFrame:
    """The joints in which a window of a text or of the first text is in no passage, of the spans (x, y, cx, cy, joint) that those of their own pair leave."""
    ranges = c.staged(_ranges(found), "ranges")
    both = spans.join(ranges.toDF("x", "rx"), "x", "left").join(ranges.toDF("y", "ry"), "y", "left")
    return both.where(~(_inside("rx", F.col("cx")) & _inside("ry", F.col("cy")))).select("joint").distinct()


def _apart(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """The joints in which a text is of another component than the first text."""
    both = edges.join(parts.toDF("x", "px"), "x", "left").join(parts.toDF("y", "py"), "y", "left").where(F.coalesce("px", "x") != F.coalesce("py", "y"))
    return both.select(F.explode("joint").alias("joint")).distinct()


def _open(shared: DataFrame, joints: DataFrame, found: DataFrame, parts: DataFrame | None) -> DataFrame:
    """The rows of some joints with whether a passage of their text covers their place, and their text's component."""
    rows = shared.join(joints, "joint", "left_semi").join(_ranges(found), "rid", "left")
    rows = rows.withColumn("component", F.col("rid")) if parts is None else rows.join(parts.withColumnRenamed("node", "rid"), "rid", "left").withColumn("component", F.coalesce("component", "rid"))
    return c.staged(rows.select("joint", "rid", "a", "c", "b", _inside("ranges", F.col("c")).alias("covered"), "component"), "open")


def _surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (rid, text, rows of joint, a, c, b, covered, component): 16 bits of each token around each place, 0 where none is."""
    reach = np.arange(AROUND) - TOKENS + 1
    for batch in batches:
        tokens = token_rows(*c.text_buffer(batch.column(1)))
        size, count, rows = np.array([len(x) for x in tokens], np.int64), batch.column(2).value_lengths().to_numpy(), batch.column(2).flatten()
        start = np.cumsum(size + TOKENS) - size  # of each text, after TOKENS zeros
        short = np.zeros(int(size.sum()) + TOKENS * (len(tokens) + 1), np.uint16)
        every = np.concatenate([np.zeros(0, np.uint64), *tokens])
        short[np.arange(len(every)) + np.repeat(start - np.cumsum(size) + size, size)] = np.maximum(c.mix(every) >> np.uint64(48), 1)
        place, rid = np.repeat(start, count) + rows.field("c").to_numpy(), np.repeat(batch.column(0).to_numpy(), count)
        for lo in range(0, len(place), BLOCK):
            around, own = short[place[lo : lo + BLOCK, None] + reach], rows.slice(lo, BLOCK)
            flat = pa.Array.from_buffers(pa.binary(2 * AROUND), len(around), [None, pa.py_buffer(around.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(rid[lo : lo + BLOCK]), *(own.field(n) for n in ("joint", "a", "c", "b", "covered", "component")), flat], names=["rid", "joint", "a", "c", "b", "covered", "component", "around"])


def segments(around: np.ndarray, beside: int) -> np.ndarray:
    """64 bits of the tokens of each segment, and of those beside it."""
    bit = np.where(around > 0, np.uint64(1) << (around & 63).astype(np.uint64), np.uint64(0))
    bit = np.pad(bit, ((0, 0), (beside, beside + SEGMENT)))
    out = np.zeros((len(around), -(-AROUND // SEGMENT)), np.uint64)
    for d in range(SEGMENT + 2 * beside):
        out |= bit[:, d : d + SEGMENT * out.shape[1] : SEGMENT]
    return out


def shared_around(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Row by row, the most tokens that a stretch of TOKENS with the signature shares with the other side, moved by MOVED at most."""
    wide, same = np.pad(right, ((0, 0), (MOVED, MOVED))), np.zeros(left.shape, bool)
    for d in range(2 * MOVED + 1):
        same |= left == wide[:, d : d + AROUND]
    upto = np.pad(np.cumsum(same & (left > 0), axis=1, dtype=np.int16), ((0, 0), (1, 0)))
    return (upto[:, TOKENS:] - upto[:, : -TOKENS]).max(axis=1)


def _alike(links_only: bool):
    """Rows of (joint, left, right, same), two blocks of windows: pairs of different components that share SHARED
    of TOKENS; unless links_only, each text is a component, and only the nearest y of each window of x without a passage is taken.
    """
    keys = ("rid", "c", "a", "b")

    def near(ids, sides, bounds, i, j):
        """The places among the pairs (i, j) that are near, and what they share."""
        (left, wl), (right, wr) = bounds
        worth = sides[0]["component"][i] != sides[1]["component"][j]
        if not links_only:
            worth &= ~(sides[0]["covered"][i] & sides[1]["covered"][j])
        k = np.flatnonzero(worth)
        bits = np.cumsum(np.bitwise_count(wl[0][i[k]] & wr[1][j[k]]), axis=1, dtype=np.uint8)
        k = k[np.maximum(bits[:, WHOLE - 1], (bits[:, WHOLE:] - bits[:, :-WHOLE]).max(axis=1)) >= LEAST]
        n = shared_around(left[i[k]], right[j[k]]) if len(k) else np.zeros(0, np.int16)
        return k[n >= SHARED], n[n >= SHARED].astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[np.zeros(0, np.int64)] for _ in range(10)]
            name, sides, bounds, offsets = batch.column(0).to_numpy(), [], [], []
            for column in batch.columns[1:3]:
                rows = column.flatten()
                sides.append({k: rows.field(k).to_numpy(zero_copy_only=False) for k in (*keys, "covered", "component")})
                around = np.frombuffer(b"".join(rows.field("around").to_pylist()), np.uint16).reshape(-1, AROUND)
                bounds.append((around, (segments(around, 0), segments(around, MOVED))))
                offsets.append(np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())]))
            same = batch.column(3).to_numpy(zero_copy_only=False)
            wide = np.diff(offsets[1])
            of = np.repeat(np.arange(len(name)), np.diff(offsets[0]))  # the block pair of each row on the left
            for lo, hi in c.slices(wide[of], 1 << 16):
                size = wide[of[lo:hi]]
                i = np.repeat(np.arange(lo, hi), size)
                j = np.arange(len(i)) + np.repeat(offsets[1][of[lo:hi]] - np.cumsum(size) + size, size)
                if links_only:  # a block with itself: each pair once
                    once = ~same[of[i]] | (i - offsets[0][of[i]] < j - offsets[1][of[i]])
                    i, j = i[once], j[once]
                k, n = near(name, sides, bounds, i, j)
                i, j = i[k], j[k]
                for own, other in ((0, 1),) if links_only else ((0, 1), (1, 0)):
                    at, m = [i, j], n
                    if not links_only:  # of a block with itself one direction holds both
                        k = np.flatnonzero(~sides[own]["covered"][at[own]] & ((own == 0) | ~same[of[i]]))
                        k = k[np.lexsort((sides[other]["rid"][at[other][k]], -n[k], at[own][k]))]
                        k = k[np.concatenate([[True] * bool(len(k)), at[own][k][1:] != at[own][k][:-1]]).astype(bool)]
                        at, m = [i[k], j[k]], n[k]
                    one, two = ([sides[e][x][at[e]].astype(np.int64) for x in keys] for e in (own, other))
                    for held, v in zip(out, (name[of[at[0]]], one[0], two[0], m, *one[1:], *two[1:]), strict=True):
                        held.append(v)
            out = [np.concatenate(v) for v in out]
            if links_only:  # one pair of windows of each pair of texts
                order = np.lexsort((-out[3], out[2], out[1]))
                x, y = out[1][order], out[2][order]
                kept = order[np.concatenate([[True] * bool(len(x)), (x[1:] != x[:-1]) | (y[1:] != y[:-1])]).astype(bool)]
                out = [v[kept] for v in out]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, out)), names=["joint", "x", "y", "n", "cx", "ax", "bx", "cy", "ay", "by"])

    return run


def _near(rows: DataFrame, texts: DataFrame, links_only: bool, tried: DataFrame) -> DataFrame:
    """Staged (x, y, spans), but for those tried, of pairs of a joint's rows that are near around their signatures: all of different components, or the nearest of each row without a passage."""
    lists = rows.groupBy("rid").agg(F.collect_list(F.struct("joint", "a", "c", "b", "covered", "component")).alias("rows"))
    placed = lists.join(texts, "rid").select("rid", "text", "rows").mapInArrow(_surroundings, "rid long, joint long, a int, c int, b int, covered boolean, component long, around binary")
    placed = c.staged(placed, "surroundings")
    c.unstage(rows)
    pairs = block_pairs(placed, "joint", BLOCK, ["rid", "a", "c", "b", "covered", "component", "around"])
    c.unstage(placed)
    pairs = pairs.mapInArrow(_alike(links_only), "joint long, x long, y long, n long, cx long, ax long, bx long, cy long, ay long, by long")
    def span(names):
        return F.struct("joint", *(F.col(f).cast("int").alias(n) for f, n in zip(names, _PLACES, strict=True))).alias("span")

    there, back = span(_PLACES), span(("cy", "ay", "by", "cx", "ax", "bx"))
    if not links_only:  # of each row, over all blocks; ties go to the smaller rid
        best = pairs.select("joint", "x", "y", "n", there).groupBy("joint", "x").agg(F.max(F.struct("n", (-F.col("y")).alias("y"), "span")).alias("best"))
        pairs = best.select("joint", "x", (-F.col("best.y")).alias("y"), *(F.col(f"best.span.{n}").alias(n) for n in _PLACES))
    ordered = pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), F.when(F.col("x") < F.col("y"), there).otherwise(back).alias("span"))
    edges = ordered.groupBy("x", "y").agg(F.collect_set("span").alias("spans")).join(tried, ["x", "y"], "left_anti")
    return c.staged(edges.select("x", "y", *(F.col(f"spans.{n}").alias(n) for n in _SPAN)), "edges")


def windows(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Staged rows (rid, doc_id, t1, t2, names, places), and classes of equal texts: t1, t2, rep, doc, copies."""
    text = F.coalesce("text", F.lit(""))
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"))
    rows = keyed.mapInArrow(_windows, f"doc_id {kind}, t1 long, t2 long, names array<long>, places array<int>").withColumn("rid", F.monotonically_increasing_id())
    rows = c.staged(rows, "windows")
    return rows, c.staged(rows.groupBy("t1", "t2").agg(F.min("rid").alias("rep"), F.min("doc_id").alias("doc"), F.count("*").alias("copies")), "classes")


def joints(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(joint, rid, a, c, b, lo, cx, ax, bx) of the representatives' pairs of signatures that two texts have.

    Windows go by buckets of their names, as lists, so that most of them, which one text has alone, never are rows.
    """
    buckets = max(96, (rows.agg(F.sum(F.size("names"))).first()[0] or 0) // BUCKET)
    lists = lambda names, key: ", ".join(["bucket int", *(f"{n} array<{'long' if n in key else 'int'}>" for n in names)])
    dealt = rows.select("rid", F.hash("t1").alias("tag"), "names", "places").mapInArrow(_deal_names(buckets), lists(_NAMED, ("name", "rid")))
    kept = dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_shared_names, "rid long, name long, a int, c int, b int")
    kept = c.staged(kept.join(classes.select(F.col("rep").alias("rid")), "rid", "left_semi").groupBy("rid").agg(F.collect_list(F.struct("name", "a", "c", "b")).alias("windows")), "names")
    every = kept.mapInArrow(_deal_joints(buckets), lists(_JOINED, ("joint", "rid"))).repartition("bucket").sortWithinPartitions("bucket")
    out = c.staged(every.mapInArrow(_shared_joints, "joint long, rid long, a int, c int, b int, lo long, cx int, ax int, bx int"), "shared-joints")
    c.unstage(kept)
    return out


def _texts(docs: DataFrame, rows: DataFrame, classes: DataFrame, shared: DataFrame) -> DataFrame:
    """rid and text of the representatives that take part."""
    text = F.coalesce("text", F.lit(""))
    who = classes.join(shared.select(F.col("rid").alias("rep")).distinct(), "rep", "left_semi").select("t1", "t2", "rep")
    one = rows.select(F.col("rid").alias("rep"), "doc_id").join(who, "rep")  # one row of each class is read; rows that agree in all are one
    keyed = docs.select(F.col("doc_id").alias("id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), text.alias("text"))
    found = keyed.join(one, ["t1", "t2"]).where(F.col("id").eqNullSafe(F.col("doc_id"))).select(F.col("rep").alias("rid"), "text")
    return c.staged(found.dropDuplicates(["rid"]), "texts")


def found_passages(docs: DataFrame, rows: DataFrame, classes: DataFrame, shared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Staged (x, y, ax, bx, ay, by), verified passages of representatives; and (node, component) over their links."""
    texts = _texts(docs, rows, classes, shared)
    first = _edges(shared)
    found, left = _passages(first, texts)
    near = _near(_open(shared, _uncovered(left, found), found, None), texts, False, first)
    if near.take(1):
        found = c.staged(found.unionByName(_passages(near, texts)[0]), "passages")
    parts = c.staged(components(found.select(F.col("x").alias("a"), F.col("y").alias("b"))), "components")
    tried = first.select("x", "y").unionByName(near.select("x", "y"))
    rest = _near(_open(shared, _apart(first, parts), found, parts), texts, True, tried)
    more = _passages(rest, texts)[0] if rest.take(1) else rest.limit(0)
    if not more.take(1):
        return found, parts
    # links between components make components of them
    ends = more.select("x", "y").distinct()
    for n in ("x", "y"):
        ends = ends.join(parts.select(F.col("node").alias(n), F.col("component").alias(f"p{n}")), n, "left").withColumn(f"p{n}", F.coalesce(f"p{n}", n))
    whole = components(ends.select(F.col("px").alias("a"), F.col("py").alias("b"))).select(F.col("node").alias("component"), F.col("component").alias("whole"))
    every = parts.unionByName(ends.select(F.col("px").alias("node"), F.col("px").alias("component"))).unionByName(ends.select(F.col("py").alias("node"), F.col("py").alias("component"))).distinct()
    parts = every.join(whole, "component", "left").select("node", F.coalesce("whole", "component").alias("component"))
    return c.staged(found.unionByName(more), "passages"), c.staged(parts, "components")


def near_passages(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (smallest doc_id reachable), n_links, n_passages, n_dup_words, copied, passages (word ranges) of every row."""
    c.small_batches(docs.sparkSession, 500, 4)
    every, classes = windows(docs)
    shared = joints(every, classes)
    rows = c.staged(every.select("rid", "doc_id", "t1", "t2"), "rows")
    c.unstage(every)
    found, parts = found_passages(docs, rows, classes, shared)
    sides = found.select(F.col("x").alias("rep"), F.col("ax").alias("first"), F.col("bx").alias("last"))
    sides = sides.unionByName(found.select(F.col("y").alias("rep"), F.col("ay").alias("first"), F.col("by").alias("last")))
    # ranges made disjoint: a new one starts where it lies beyond all before
    w = Window.partitionBy("rep").orderBy("first", "last")
    new = sides.distinct().withColumn("upto", F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    island = new.withColumn("island", F.sum(F.when(F.col("first") <= F.col("upto") + 1, 0).otherwise(1)).over(w))
    merged = island.groupBy("rep", "island").agg(F.min("first").alias("start"), (F.max("last") + SHINGLE).alias("end"))
    merged = merged.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("passages"))
    member = parts.select(F.col("node").alias("rep"), "component")
    whole = classes.select("rep", "doc").join(member, "rep").groupBy("component").agg((F.count("*") - 1).alias("n_links"), F.min("doc").alias("class_id"))
    per_class = classes.join(member.join(whole, "component").drop("component").join(merged, "rep"), "rep", "left")
    zero = F.lit(0).cast("long")
    copied = (F.col("copies") > 1).alias("copied")
    return rows.select("doc_id", "t1", "t2").join(per_class, ["t1", "t2"]).select(
        "doc_id", F.when(F.col("n_links").isNull(), F.col("doc")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", zero).alias("n_links"), F.greatest(F.size("passages"), F.lit(0)).cast("long").alias("n_passages"),
        F.coalesce(F.aggregate("passages", zero, lambda a, p: a + p.end - p.start), zero).alias("n_dup_words"), copied, "passages",
    )
