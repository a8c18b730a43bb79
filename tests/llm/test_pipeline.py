"""Stages of the corpus pipeline against plain versions."""

import random

import corpus_pipeline as pipeline
import pytest
from brute import SPACED, contamination, lower, quality

from tidemark.llm import secrets, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], SCHEMA).repartition(3)


def shingled(text):
    words = SPACED.findall(lower(text))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def near_copies(r):
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    out = []
    for _ in range(25):
        base = [word() for _ in range(r.randint(60, 200))]
        out.append(" ".join(base))
        for _ in range(r.randint(0, 4)):
            copy = list(base)
            for _ in range(r.randint(0, 6)):
                copy[r.randrange(len(copy))] = word()
            out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("block", [256, 2])
def test_near_duplicates_by_jaccard(spark, block, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", block)
    r = random.Random(3)
    texts = near_copies(r)
    ids = [r.choice([None, *range(40)]) for _ in texts]
    sets = [shingled(t) for t in texts]
    part = list(range(len(texts)))
    pairs = 0
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                pairs += 1
                old, new = part[i], part[j]
                part = [new if x == old else x for x in part]
    assert pairs > 10
    best = {}
    for i, p in enumerate(part):
        best.setdefault(p, []).append((ids[i] is None, ids[i] or 0))
    got = pipeline.near_duplicates(spark, table(spark, [(i, t, "s") for i, t in zip(ids, texts, strict=True)]), "").collect()
    assert len(got) == len(best) and {x.text for x in got} <= set(texts)
    assert sorted((x.doc_id is None, x.doc_id or 0) for x in got) == sorted(min(v) for v in best.values())


def test_stages_decide_by_row(spark, tmp_path):
    r = random.Random(5)
    prose = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    item = prose(20)
    benchmark = [(0, item)]
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    key = lambda rows: sorted(((x.doc_id is None, x.doc_id or 0, x.text, x.n_chars) for x in rows))
    expect = lambda rows: sorted((i is None, i or 0, t, len(t)) for i, t in rows)
    ids = (1, 1, None, None, 2)

    texts = [prose(70), "too short", prose(80), "short too", prose(60)]
    got = pipeline.quality_rules(spark, table(spark, [(i, t, "s") for i, t in zip(ids, texts, strict=True)]), str(tmp_path)).collect()
    assert key(got) == expect([(i, t) for i, t in zip(ids, texts, strict=True) if not quality(t)[5]])

    head, tail = prose(300), prose(300)
    texts = [f"{head} {item} {tail}", "a clean twin", item, f"{tail} {item} {head}", prose(10)]
    got = pipeline.decontamination(spark, table(spark, [(i, t, "s") for i, t in zip(ids, texts, strict=True)]), str(tmp_path)).collect()
    want = [(i, t.replace(item, "")) for i, t in zip(ids, texts, strict=True) if not contamination(t, benchmark)[4]]
    assert len(want) == 4 and key(got) == expect(want)

    texts = ["x password=mine5678 y", "password=other999", "nothing", "see token=abcdef77 here", "password=last0000"]
    got = pipeline.secret_scan(spark, table(spark, [(i, t, "s") for i, t in zip(ids, texts, strict=True)]), str(tmp_path)).collect()
    want = ["x [secret] y", "[secret]", "nothing", "see [secret] here", "[secret]"]
    assert key(got) == expect(zip(ids, want, strict=True))

    texts = [prose(70)] * 3 + [prose(70), prose(70)]
    got = pipeline.near_duplicates(spark, table(spark, [(i, t, "s") for i, t in zip(ids, texts, strict=True)]), str(tmp_path)).collect()
    assert key(got) == expect([(1, texts[0]), (None, texts[3]), (2, texts[4])])


def test_only_widely_spread_secrets_stay(spark, monkeypatch):
    monkeypatch.setattr(secrets, "COPIED_TEXTS", 30)
    rows = [(i, f"text {i} password=two45678", f"s{i % 2}") for i in range(9)]  # few owners: live
    rows += [(20 + i, "token=equal999 in equal texts", f"s{i}") for i in range(12)]  # one text: live
    rows += [(40 + i, f"text {i} secret=Zx9Kq2Lm4Np6Rs8Tv0Wy1", f"s{i % 3}") for i in range(3)]
    rows += [(50 + i, f"text {i} password=everywhere", f"s{i % 6}") for i in range(12)]  # an example
    rows += [(70 + i, f"text {i} password=hotsource", "s0") for i in range(30)]  # copied very often in one source
    got = {x.doc_id: x.text for x in pipeline.secret_scan(spark, table(spark, rows), "").collect()}
    assert len(got) == len(rows)
    for i, text, _ in rows:
        assert (got[i] == text) == (i >= 50)
        assert i >= 50 or "[secret]" in got[i]
    spread = secrets.secrets(table(spark, [(0, "see Zx9Kq2Lm4Np6Rs8Tv0Wy1", "a"), (1, "or Zx9Kq2Lm4Np6Rs8Tv0Wy1", "b")]), widely=True)
    assert [x.n_live for x in spread.collect()] == [1, 1]  # kind `owned`
