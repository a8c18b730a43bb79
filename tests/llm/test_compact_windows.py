"""Near-duplicate passages: planted ones, compact windows by definition, and exact repeats of the real table."""

import random

import numpy as np

from tidemark.llm import compact_windows as w


def test_windows_by_definition():
    h = np.array(np.random.default_rng(2).permutation(120), np.uint64)
    found = w.compact_windows(h, 20)
    for i in range(120):
        for j in range(i + 19, 120):  # every subsequence has its signature in exactly one window
            m = i + int(h[i : j + 1].argmin())
            assert [x for x in found if x[0] <= i <= x[1] <= j <= x[2]] == [x for x in found if x[1] == m and x[0] <= i and j <= x[2]]
            assert sum(x[1] == m and x[0] <= i and j <= x[2] for x in found) == 1


def test_planted_passages(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    prose = lambda n: [word() for _ in range(n)]
    passages = [prose(n) for n in (55, 80, 150)]
    docs, want = [(0, None), (1, ""), (2, "too short")], {}
    for i in range(3, 60):
        t = prose(r.randint(0, 200))
        if i % 2:
            k = i % 3
            p = list(passages[k])
            if k == 2 and i % 4 == 1:
                p[70] = "edited"
            t = t + p + prose(r.randint(0, 100))
            want[i] = k
        docs.append((i, " ".join(t)))
    docs += [(100, docs[5][1]), (101, docs[4][1])]
    got = {x.doc_id: x for x in w.near_passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    assert len(got) == len(docs)
    for i, k in want.items():
        assert got[i].n_passages >= 1 and got[i].class_id == min(j for j in want if want[j] == k)
        assert len(passages[k]) - 5 <= got[i].n_dup_words <= len(passages[k]) + 5
    clean = [i for i in got if i not in want and i not in (100, 101)]
    assert all(got[i].n_passages == 0 and got[i].n_links == 0 for i in clean)
    assert got[101].class_id == docs[4][0] and got[101].copied and got[100].class_id == got[5].class_id
    assert w.near_passages(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_exact_repeats_of_the_real_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text.lower().split() for r in docs.collect()}
    held: dict = {}
    for i, t in texts.items():
        for k in range(len(t) - 54):
            held.setdefault(tuple(t[k : k + 55]), set()).add(tuple(t) if len(t) < 400 else i)
    shared = {key for key, owners in held.items() if len(owners) > 1}
    want = {i for i, t in texts.items() if any(tuple(t[k : k + 55]) in shared for k in range(len(t) - 54))}
    got = {r.doc_id for r in w.near_passages(docs).where("n_passages > 0 or copied").collect()}
    assert want <= got


def test_every_pair_of_a_passage_is_linked(spark, monkeypatch):
    r = random.Random(7)
    prose = lambda n: ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    passage = prose(60)
    docs = [(i, " ".join(prose(40) + passage + prose(40))) for i in range(12)]
    for block in (256, 4):
        monkeypatch.setattr(w, "BLOCK", block)
        got = w.near_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
        assert [(x.n_links, x.class_id) for x in got] == [(11, 0)] * 12


def edited(words, places):
    return [f"changed{i}" if i in places else x for i, x in enumerate(words)]


def test_edits_in_the_middle_of_short_passages():
    r = random.Random(8)
    prose = lambda n: ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    number = lambda *texts: np.split(np.unique(np.concatenate(t := [w.tokens_of(np.frombuffer(" ".join(x).encode(), np.uint8)) for x in texts]), return_inverse=True)[1], [len(t[0])])
    for n, places in ((50, [25]), (80, [40]), (85, [42]), (100, [33, 66]), (200, [40, 80, 120, 160])):
        p = prose(n)
        q = edited(p, places)
        for x, y in ((p, q), (prose(30) + p + prose(20), prose(10) + q + prose(50))):
            (found,) = w.passages(*number(x, y), 0 if x is p else 20)
            assert min(found[1] - found[0], found[3] - found[2]) + 1 >= n - 5
    p = prose(200)
    left, right = number(p, p[100:] + p[:100])  # the two halves in the other order
    assert w.passages(left, right, 0)
    left, right = number(prose(30) + p + prose(30), p[:100] + prose(12) + p[100:])  # an insertion
    (found,) = w.passages(left, right, 30)
    assert found[1] - found[0] >= 190
    p = prose(50)
    assert not w.passages(*number(p, edited(p, [15, 32])), 0)


def test_edited_passages_are_linked(spark):
    r = random.Random(9)
    prose = lambda n: ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    docs = []
    for n, places in ((80, [40]), (85, [42]), (100, [33, 66]), (200, [40, 80, 120, 160])):
        for _ in range(3):
            p, i = prose(n), len(docs)
            docs += [(i, " ".join(prose(20) + p + prose(20))), (i + 1, " ".join(prose(20) + edited(p, places) + prose(20)))]
    got = {x.doc_id: x for x in w.near_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    linked = sum(got[i].n_links == 1 == got[i + 1].n_links and got[i].class_id == got[i + 1].class_id == i for i in range(0, len(docs), 2))
    assert linked >= len(docs) // 2 - 1  # signatures meet a pair at 0.8 with probability 0.97


def words(r, n):
    return ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n)]


def test_strangers_with_one_phrase_part_nothing(spark):
    r = random.Random(10)
    passage = words(r, 50)
    docs = [(10, " ".join(words(r, 30) + passage + words(r, 30))), (30, " ".join(words(r, 30) + passage + words(r, 30)))]
    docs += [(i, " ".join(words(r, 40) + passage[k : k + 5] + words(r, 40))) for k, i in enumerate((5, 12, 14, 16, 18, 20, 22, 40), 3)]
    got = {x.doc_id: x for x in w.near_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [(got[i].n_links, got[i].class_id, got[i].n_passages) for i in (10, 30)] == [(1, 10, 1)] * 2
    assert all(x.n_links == x.n_passages == 0 for i, x in got.items() if i not in (10, 30))


def test_repeated_and_missing_doc_ids_and_clashing_columns(spark):
    r = random.Random(11)
    long, other = words(r, 300), words(r, 120)
    rows = [(7, long), (7, long[:60]), (7, long), (None, long), (None, other), (9, other), (8, words(r, 100)), (None, words(r, 100))]
    docs = [(i, " ".join(t), "x", 1, 2) for i, t in rows]
    got = w.near_passages(spark.createDataFrame(docs, "doc_id long, text string, rid string, t1 int, name int").repartition(3)).collect()
    key = sorted((x.doc_id is None, x.doc_id or 0, x.class_id is None, x.class_id or 0, x.n_links, x.n_passages, x.copied) for x in got)
    assert key == sorted([
        (False, 7, False, 7, 1, 1, True), (False, 7, False, 7, 1, 1, True), (True, 0, False, 7, 1, 1, True), (False, 7, False, 7, 1, 1, False),
        (True, 0, False, 9, 0, 0, True), (False, 9, False, 9, 0, 0, True), (False, 8, False, 8, 0, 0, False), (True, 0, True, 0, 0, 0, False),
    ])


def test_classes_against_all_pairs(spark, monkeypatch):
    """Recall of planted pairs, similar by brute force over whole planted passages, among strangers; and no false link."""
    monkeypatch.setattr(w, "STAR", 3)
    monkeypatch.setattr(w, "BLOCK", 4)
    r = random.Random(12)
    docs, planted, phrase = [], [], words(r, 12)
    for _ in range(12):
        base = words(r, r.choice((90, 140, 200)))
        for _ in range(r.randint(2, 5)):
            own = edited(base, set(r.sample(range(len(base)), r.randint(0, 2))))
            planted.append((len(docs), base[0], [f"{x}-{len(docs)}" if x.startswith("changed") else x for x in own]))
            docs.append((len(docs), " ".join(words(r, 20) + phrase[: r.randint(0, 12)] + words(r, 20) + planted[-1][2] + words(r, 20))))
    docs += [(1000 + i, " ".join(words(r, 40) + phrase + words(r, 40))) for i in range(40)]
    sets = {i: set(zip(*(p[k:] for k in range(5)), strict=False)) for i, _, p in planted}
    pairs = [(i, j) for i in sets for j in sets if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    got = {x.doc_id: x for x in w.near_passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    met = sum(got[i].class_id == got[j].class_id for i, j in pairs)
    assert len(pairs) > 40 and met >= 0.9 * len(pairs)
    family = {i: b for i, b, _ in planted}
    assert all(family.get(i) == family.get(x.class_id) for i, x in got.items() if i in family)
    assert all(x.n_links == 0 for i, x in got.items() if i >= 1000)
    size = {}
    for x in got.values():
        size[x.class_id] = size.get(x.class_id, 0) + 1
    assert all(x.n_links == size[x.class_id] - 1 for x in got.values())


def test_windows_of_many_texts_at_once():
    def plain(h, a, b):
        if b - a < 20:
            return []
        m = a + int(h[a:b].argmin())
        return [(a, m, b - 1), *plain(h, a, m), *plain(h, m + 1, b)]

    r = np.random.default_rng(3)
    sizes = [0, 5, 20, 21, 300, 0, 80, 19, 150]
    edges = np.cumsum([0, *sizes])
    for values in (10, 1 << 40):  # with and without ties
        h = r.integers(0, values, edges[-1]).astype(np.uint64)
        want = [x for a, b in zip(edges, edges[1:], strict=False) for x in plain(h, a, b)]
        assert sorted(map(tuple, w.window_rows(h, edges, 20).tolist())) == sorted(want)


def test_passages_do_not_depend_on_the_order_of_windows():
    r, rng = random.Random(14), np.random.default_rng(14)
    for _ in range(20):
        base = words(r, 200)
        one, two = (w.tokens_of(np.frombuffer(" ".join(t).encode(), np.uint8)) for t in (base, edited(base, set(r.sample(range(200), 9)))))
        spans = np.array([(c, c - k, c - k + 60, c, c - k, c - k + 60) for c in range(60, 130, 3) for k in (20, 25)])
        want = w.verified(w._numbered(one), two, spans)
        assert all(w.verified(w._numbered(one), two, rng.permutation(spans)) == want for _ in range(5))


def test_what_no_passage_can_hold():
    """The bound before the search never drops a pair of windows that has a passage."""
    r, some = random.Random(15), 0
    for _ in range(300):
        base = words(r, r.choice((50, 60, 100)))
        one, two = (w.tokens_of(np.frombuffer(" ".join(t).encode(), np.uint8)) for t in (base, edited(base, set(r.sample(range(len(base)), r.randint(0, 5))))))
        left, right = np.split(np.unique(np.concatenate([one, two]), return_inverse=True)[1], [len(one)])
        if w.passages(left, right, 0):
            some += 1
            assert w._possible(np.isin(left, right), np.isin(right, left)) and w._dense(np.isin(left, right)).any()
    assert 50 < some < 250


def test_files_of_done_steps_are_deleted(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(w.c, "shared_folder", lambda _: str(tmp_path))
    r = random.Random(16)
    passage = words(r, 60)
    docs = [(i, " ".join(words(r, 40) + passage + words(r, 40))) for i in range(6)]
    assert {x.n_links for x in w.near_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()} == {5}
    kinds = {p.name.rpartition("-")[0] for p in (tmp_path / "tidemark").iterdir()}
    assert "shared-joints" in kinds and not kinds & {"windows", "names", "joints", "open", "surroundings"}


def test_nodes_of_repeated_values():
    """Nearest smaller values by definition, and of nodes with one name only those in no other one."""
    rng = np.random.default_rng(17)
    sizes = [0, 7, 90, 1, 400]
    edges, text = np.cumsum([0, *sizes]), np.repeat(np.arange(len(sizes)), sizes)
    h = rng.integers(0, 9, edges[-1]).astype(np.uint64)
    before, after = w.nearest_smaller(h, text)
    n = len(h)
    for i in range(n):
        assert before[i] == max((j for j in range(i) if text[j] == text[i] and h[j] <= h[i]), default=n)
        assert after[i] == min((j for j in range(i + 1, n) if text[j] == text[i] and h[j] < h[i]), default=n)
    rows = w.window_rows(h, edges, 5)
    of = np.searchsorted(edges, rows[:, 1], "right") - 1
    name = h[rows[:, 1]]
    held = [any(of[i] == of[j] and name[i] == name[j] and rows[j, 0] <= rows[i, 0] and rows[i, 2] <= rows[j, 2] for j in range(len(rows)) if i != j) for i in range(len(rows))]
    assert any(held) and (~w.outermost(name, of, rows)).tolist() == held


def test_spans_of_a_pair_meet_and_those_left_are_told(spark, monkeypatch):
    """Spans are dealt to their pair as lists; after verification those that a passage covers on both sides are gone."""
    monkeypatch.setattr(w, "DEALT", 3)
    r = random.Random(18)
    passage = words(r, 80)
    docs = [(0, passage + words(r, 80)), (1, words(r, 10) + passage), (2, words(r, 200))]
    texts = spark.createDataFrame([(i, " ".join(t)) for i, t in docs], "rid long, text string")
    at = lambda x, y, joint, cx, cy: (joint, y, max(0, cy - 25), cy, cy + 25, x, cx, max(0, cx - 25), cx + 25)
    rows = [at(0, 1, 5, 30, 40), at(0, 1, 6, 35, 45), at(0, 1, 7, 120, 45), at(0, 2, 8, 40, 50), (9, 0, 0, 3, 60, 0, 3, 0, 60)]
    shared = spark.createDataFrame(rows, "joint long, rid long, a int, c int, b int, lo long, cx int, ax int, bx int").repartition(3)
    edges = w._edges(shared)
    assert sorted((x.x, x.y, sorted(zip(x.joint, x.cx, x.cy, strict=True))) for x in edges.collect()) == [(0, 1, [(5, 30, 40), (6, 35, 45), (7, 120, 45)]), (0, 2, [(8, 40, 50)])]
    found, left = w._passages(edges, texts)
    assert {(x.x, x.y, x.ay - x.ax) for x in found.collect()} == {(0, 1, 10)}
    assert sorted((x.x, x.y, x.cx, x.cy, x.joint) for x in left.collect()) == [(0, 1, 120, 45, 7), (0, 2, 40, 50, 8)]
    assert sorted(x.joint for x in w._uncovered(left, found).collect()) == [7, 8]
