"""Plain versions of the contracts, one document at a time; for small tables only."""

import hashlib
import re
import zlib
from collections import Counter

import xxhash

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def license_base(text):
    words = ALNUM.findall(lower(text))
    places, labels = [], set()
    for phrase, label in (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")):
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def fingerprint(text):
    words = SPACED.findall(lower(text))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def components(ids, fps):
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                parent[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        least[root(i)] = min(d, least.get(root(i), d))
    return [least[root(i)] for i in range(len(ids))]


def base_secrets(text):
    text = text or ""
    out = []
    for m in re.finditer(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[1]) >= 6:
            out.append((m.start(), 0, m.end(), "assign"))
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    n = Counter(x[3] for x in out)
    spans = [f"{k}:{a}:{b}" for a, _, b, k in sorted(out)]
    return n["assign"], n["access"], n["hex"], spans


def crc(text):
    return zlib.crc32((text or "").encode())


def quality(text):
    text = text or ""
    words = SPACED.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if SPACED.search(line):
            dup += line in seen
            seen.add(line)
    three = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(three)
    repeat = {i + k for i, t in enumerate(three) if count[t] > 1 for k in range(3)}
    symbols = sum(ch in "#*$%&|<>" for ch in text)
    return len(words), sum(map(len, words)), symbols, dup, len(repeat), len(words) < 50 or 100 * len(repeat) > 50 * len(words)


def contamination(text, items):
    words = ALNUM.findall(lower(text))
    hit, found = set(), set()
    for name, item in items:
        w = ALNUM.findall(lower(item))
        for j in range(max(1, len(w) - 12)) if w else ():
            p = w[j : j + 13]
            for i in range(len(words) - len(p) + 1):
                if words[i] == p[0] and words[i : i + len(p)] == p:
                    found.add(str(name))
                    hit.update(range(i, i + len(p)))
    return len(words), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(words)


def removed(texts, length):
    """Per text: flags of bytes covered by a string of this length that also starts elsewhere."""
    raws = [(t or "").encode() for t in texts]
    starts = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        flags = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if starts[r[i : i + length]] > 1:
                flags[i : i + length] = b"\1" * length
        out.append(bytes(flags))
    return out
