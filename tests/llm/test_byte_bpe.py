"""Merging of single pre-tokens against its definition."""

import base64
import random

import public_tokenizers
import pyarrow as pa

from tidemark.llm import byte_bpe


class Counted(dict):
    asked = 0

    def get(self, *key):
        self.asked += 1
        return super().get(*key)

    def __contains__(self, key):
        self.asked += 1
        return super().__contains__(key)


def plain(ranks, token):
    """The lowest-ranked, leftmost pair first, by looking at all of them each time."""
    parts = [bytes([b]) for b in token]
    while pairs := [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]:
        i = min(pairs)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks.get(p, -1) for p in parts]


def test_merge_by_definition(tmp_path):
    r = random.Random(21)
    keys = [bytes([b]) for b in b"abcd"]  # other bytes are missing
    while len(keys) < 60:
        joined = r.choice(keys) + r.choice(keys)
        if joined not in keys:
            keys.append(joined)
    ranks = {k: i for i, k in enumerate(keys)}
    path = tmp_path / "small.tiktoken"
    path.write_text("".join(f"{base64.b64encode(k).decode()} {i}\n" for k, i in ranks.items()))
    codec = byte_bpe.Codec(str(path), r"\S+|\s+")
    for _ in range(3000):
        token = bytes(r.choices(b"abcdx", (8, 8, 8, 8, 1), k=r.randint(1, 30)))
        assert codec.merge(token) == plain(ranks, token)
    codec.joined = Counted(codec.joined)
    assert codec.merge(b"xaxbxcx" * 9) == plain(ranks, b"xaxbxcx" * 9)
    assert codec.joined.asked == 0  # pairs of bytes are known by their values


def test_words_merged_at_once():
    """Rows of a matrix get the ids that each gets alone, and what is learned is what a unit gives."""
    r = random.Random(19)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    codec = byte_bpe.Codec(path, public_tokenizers.PATTERN)
    word = lambda: "".join(r.choice(("th", "in", "er", "é", "a", "q", "ü", "on", "字", "s", "zz")) for _ in range(r.randint(1, 14)))
    words = {word() for _ in range(3000)}
    by_size = {}
    for x in words:
        by_size.setdefault(len(raw := (" " + x).encode()), []).append(raw)
    for tokens in by_size.values():
        assert codec.merge_all(tokens) == [tuple(codec.merge(x)) for x in tokens]
    texts = [None, "", " ", *(" ".join(x + r.choice(("", "", ",", "...", "?!", "\n", " ", "3")) for x in r.sample(sorted(words), 40)) for _ in range(30))]
    plain = byte_bpe.Codec(path, public_tokenizers.PATTERN)
    assert list(codec.encoded(pa.array(texts))) == [plain.encode(x) for x in texts] and codec.units
    for x, ids in list(codec.units.items()):
        assert plain.unit(x) == ids
