"""Exact substring removal against a table of all strings."""

import random

import numpy as np
import pytest
from brute import removed, sha

from tidemark.llm import common as c
from tidemark.llm import suffix_dedup


def check(spark, texts, length):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, names string").repartition(3)
    want = []
    for i, (t, gone) in enumerate(zip(texts, removed(texts, length), strict=True)):
        raw = (t or "").encode()
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        want.append((i, len(raw), sum(gone), sum(1 for j, g in enumerate(gone) if g and not (j and gone[j - 1])), sha(kept)))
    got = sorted(tuple(r) for r in suffix_dedup.remove(docs, length).collect())
    assert got == want


@pytest.mark.parametrize("seed", range(3))
def test_random_texts(spark, seed):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeé ") for _ in range(r.randint(2, 9))) for _ in range(400)]

    def prose(n):
        return " ".join(r.choice(words) for _ in range(n))

    passages = [prose(r.randint(20, 90)) for _ in range(6)]
    texts = [None, "", "short", "x" * 900, "x" * 200, "x" * 199, "ab" * 150, passages[0], passages[0]]
    for _ in range(60):
        t = prose(r.randint(0, 60)) + r.choice([*passages, ""]) + prose(r.randint(0, 60)) + r.choice([*passages, ""])
        a = r.randint(0, len(t))
        texts.append(t if r.random() < 0.7 else t[a : a + r.randint(100, 500)])
        if r.random() < 0.3:
            near = list(r.choice([x for x in texts if x]))
            near[r.randrange(len(near))] = "#"
            texts.append("".join(near))
    r.shuffle(texts)
    check(spark, texts, 200)


def test_other_lengths_and_empty(spark):
    check(spark, ["abcabcabcabc", "xxabcabcyy", None, "zz" * 20], 5)
    check(spark, ["one line of forty characters, more or less", "one line of forty characters, more or fewer"], 40)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.remove(empty).collect() == []


def test_real_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    check(spark, [r.text for r in rows], 200)


def test_samples_by_definition():
    """Each start's sample is the least-hashed gram of its string; only what is asked for is computed."""
    raw = np.frombuffer(bytes(random.Random(6).choices(b"abc ", k=700)) + b"ab" * 200, np.uint8)
    one = suffix_dedup.Samples(raw, 200)
    one.start_names(one.starts(np.array([[300, 2]])))
    assert "sample_of" not in vars(one)
    at = np.arange(len(raw) - 31)
    hashes = c.slice_hash(one.prefix, at, at + 32)
    assert (c.gram_hashes(one.prefix, 32) == hashes).all()
    low = (hashes & ~suffix_dedup._PLACE) | at.astype(np.uint64)
    want = [i + int(low[i : i + 169].argmin()) for i in range(len(raw) - 199)]
    assert one.sample_of.tolist() == want and (one.names == hashes[one.samples]).all()
    chosen = np.arange(0, len(one.samples), 2)
    blocks = {(s, (s - i) // 32) for i, s in enumerate(want) if s in set(one.samples[chosen].tolist())}
    assert sorted(map(tuple, one.blocks(chosen[::-1]).tolist())) == sorted(blocks)
