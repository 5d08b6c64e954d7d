from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from sluice.llm import copies, simhash
from sluice.llm.components import components


def brute_fingerprint(text, k=3):  # noqa: ANN001, ANN201
    low = "".join(chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch for ch in text or "")
    w = [x for x in re.split("[\x20\x09-\x0d]+", low) if x]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def classes(pairs, nodes):  # noqa: ANN001, ANN201
    parent = {n: n for n in nodes}

    def find(x):  # noqa: ANN001, ANN202
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aAbB \t\n\x0bÉ漢", max_size=60))
def test_fingerprint(text):  # noqa: ANN001
    assert simhash.fingerprint(text) == brute_fingerprint(text)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), unique=True, max_size=60), st.integers(0, 9))
def test_tree_finds_all_within_the_radius(xs, r):  # noqa: ANN001
    xs = xs + [x ^ 5 for x in xs if x ^ 5 not in xs]
    tree = simhash.BKTree()
    for x in dict.fromkeys(xs):
        tree.add(x)
    for q in xs[:5]:
        assert {tree.nodes[i] for i in tree.within(q, r)} == {x for x in xs if (x ^ q).bit_count() <= r}


@pytest.mark.parametrize("agree", [None, 2, 3])
def test_links_and_components_equal_brute_force(spark, agree):  # noqa: ANN001
    rng = random.Random(4)
    fps = {0}
    for _ in range(60):
        c = rng.getrandbits(64)
        fps |= {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(rng.randint(1, 12))}
    hot = rng.getrandbits(64)  # one shard far beyond the chunk
    fps |= {hot ^ (1 << a) ^ (1 << b) for a in range(16, 40) for b in range(16, 40)}
    fps = sorted(fps)
    want = classes([(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 3], fps)
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    found = {r["node"] % 2**64: r["root"] % 2**64 for r in components(simhash.links(df, chunk=32, agree=agree)).collect()}
    got = defaultdict(set)
    for x in fps:
        got[found.get(x, x)].add(x)
    expect = defaultdict(set)
    for x in fps:
        expect[want[x]].add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, expect.values()))


def test_shards_grow_narrow_with_the_count():
    assert [simhash.agreeing(n, 3, 512) for n in (0, 10**6, 10**8, 10**9, 10**11)] == [1, 1, 2, 2, 3]
    assert [len(simhash.shard_masks(3, k)) for k in (1, 2, 3)] == [4, 10, 20]


def test_components_of_paths_cycles_and_loops(spark):  # noqa: ANN001
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 102), (102, 100), (7, 7), (100, 101), (None, 3), (200, 0)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 51)} | {200: 0, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates(docs, rows, none):  # noqa: ANN001
    out = simhash.near_duplicates(docs)
    assert out.columns == ["doc_id", "fingerprint", "component_id"]
    fps = {i: brute_fingerprint(t) for i, (_, t) in enumerate(rows)}
    want = classes([(i, j) for i in fps for j in fps if j < i and (fps[i] ^ fps[j]).bit_count() <= 3], fps)
    least = defaultdict(list)
    for i in fps:
        if rows[i][0] is not None:
            least[want[i]].append(rows[i][0])
    expect = Counter((rows[i][0], f"{fps[i]:016x}", min(least[want[i]], default=None)) for i in fps)
    assert Counter(map(tuple, out.collect())) == expect
    assert simhash.near_duplicates(none).count() == 0


def shingles(text, k=5):  # noqa: ANN001, ANN201
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_near_copies(spark, docs, none):  # noqa: ANN001
    rng = random.Random(9)
    texts = {}
    for i in range(0, 400, 2):
        w = [rng.choice("abcdefgh") + str(rng.randint(0, 400)) for _ in range(rng.randint(30, 400))]
        texts[i] = " ".join(w)
        if i % 4 == 0:
            for j in rng.sample(range(len(w)), max(1, len(w) // 90)):
                w[j] = "other"
            texts[i + 1] = " ".join(w)
    got = {r["doc_id"]: r["component_id"] for r in copies.near_copies(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    s = {i: shingles(t) for i, t in texts.items()}
    sim = {i: len(s[i] & s[i + 1]) / len(s[i] | s[i + 1]) for i in texts if i % 4 == 0}
    close = [i for i, j in sim.items() if j >= 0.8]
    far = [i for i, j in sim.items() if j < 0.8]
    assert len(close) > 50 and all(got[i + 1] == i for i in close)
    assert all(got[i + 1] == i + 1 for i in far) and all(got[i] == i for i in texts if i % 2 == 0)
    kept = copies.keep_one(docs)
    assert kept.columns == docs.columns and copies.keep_one(none).count() == 0
    ids = [r[0] for r in kept.select("doc_id").collect()]
    assert ids.count(None) == 2 and not {1001, 1002, 1003} & set(ids) and 1000 in ids


def test_borderline_copies_of_long_texts(spark):  # noqa: ANN001
    """Families of edited copies on both sides of the bound: every link holds, and nothing else."""
    rng = random.Random(5)
    texts = {}
    for _ in range(40):
        w = [f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(15, 900))]
        for edits in (0, 5, 10, 15, 20, 24, 30):
            copy = list(w)
            for j in rng.sample(range(len(w)), len(w) * edits // 1000):
                copy[j] = f"x{rng.randint(0, 5000)}"
            texts[len(texts)] = " ".join(copy)
    s = {i: shingles(t) for i, t in texts.items()}
    family = lambda i: range(i - i % 7, i)
    linked = [(i, j) for i in texts for j in family(i) if len(s[i] & s[j]) / len(s[i] | s[j]) >= 0.8]
    assert sum(len(s[i] & s[j]) / len(s[i] | s[j]) < 0.8 for i in texts for j in family(i)) > 100 and len(linked) > 100
    got = {r["doc_id"]: r["component_id"] for r in copies.near_copies(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == classes(linked, texts)


def exact_classes(texts):  # noqa: ANN001, ANN201
    """Components of all pairs from 0.8 on, by brute force."""
    s = {i: shingles(t) for i, t in texts.items()}
    ids = sorted(texts)
    near = lambda a, b: (not s[a] and not s[b]) or (min(len(s[a]), len(s[b])) >= 0.8 * max(len(s[a]), len(s[b])) and len(s[a] & s[b]) / len(s[a] | s[b]) >= 0.8)
    return classes([(a, b) for k, a in enumerate(ids) for b in ids[:k] if near(a, b)], texts)


def test_large_group_of_variants_equals_brute_force(spark, monkeypatch):  # noqa: ANN001
    """Variants of one text, many of them similar to few others only; all are judged, in one tile and in many."""
    rng = random.Random(12)
    for words, rate, n in ((200, 0.027, 1000), (100, 0.03, 300)):
        base = [f"w{rng.randint(0, 999)}" for _ in range(words)]
        texts = {i: " ".join(f"x{rng.randint(0, 9999)}" if rng.random() < rate else w for w in base) for i in range(n)}
        want = exact_classes(texts)
        assert 0.2 * n < len(set(want.values())) < 0.95 * n
        df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
        assert {r["doc_id"]: r["component_id"] for r in copies.near_copies(df).collect()} == want
        monkeypatch.setattr(copies, "CHUNK", 64)
        monkeypatch.setattr(copies, "CHUNK_SHINGLES", 5000)
        monkeypatch.setattr(copies, "BROADCAST_TEXTS", 0)


def test_short_texts_lose_no_link(spark):  # noqa: ANN001
    rng = random.Random(2)
    texts = {0: "", 1: " ", 2: "one", 3: "ONE", 4: "one two"}
    for _ in range(150):
        w = [f"w{rng.randint(0, 9999)}" for _ in range(rng.randint(5, 40))]
        texts[len(texts)] = " ".join(w)
        for _ in range(3):  # words added or taken at the ends change few shingles
            a, b = rng.randint(0, 3), rng.randint(0, 3)
            texts[len(texts)] = " ".join([f"y{rng.randint(0, 99)}"] * (a % 2) + w[a // 2 : len(w) - b // 2] + [f"z{rng.randint(0, 99)}"] * (b % 2))
    want = exact_classes(texts)
    assert len(set(want.values())) < len(texts) - 100
    got = {r["doc_id"]: r["component_id"] for r in copies.near_copies(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == want


def test_hot_part_of_different_texts(spark):  # noqa: ANN001
    """A passage that all texts share makes them candidates of each other, and no more."""
    rng = random.Random(6)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = {i: " ".join([*(f"w{rng.randint(0, 9**6)}" for _ in range(rng.choice((0, 2, 8, 100, 300)))), passage, f"end{i}"]) for i in range(300)}
    got = {r["doc_id"]: r["component_id"] for r in copies.near_copies(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == exact_classes(texts)


def test_rows_of_one_id_with_other_texts_stay(spark):  # noqa: ANN001
    rows = [(1, "the first text of this id"), (1, "another text that has the same id"), (2, "some third text"), (2, "some third text"), (3, "Some third  text"), (None, "some third text"), (4, None), (4, ""), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as print", "1 as root", "2 as whole")
    out = copies.keep_one(df)
    assert out.columns == df.columns
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in out.collect()) == [("1", rows[1][1]), ("1", rows[0][1]), ("2", "some third text"), ("4", ""), ("None", "some third text")]


def test_parts_meet_at_the_bound():
    """Sets of exactly 0.8 share a key: always where parts are not limited in number, and all but always beyond."""
    rng = np.random.default_rng(1)
    for n, tries in ((5, 300), (10, 300), (15, 300), (16, 300), (19, 300), (24, 300), (33, 300), (64, 300), (90, 300), (400, 200), (2000, 50)):
        for one_sided in (True, False):
            for _ in range(tries):
                h = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
                lost = len(h) // 5 if one_sided else len(h) // 10 * 2
                a = h if one_sided else np.delete(h, rng.choice(len(h), lost // 2, replace=False))
                b = np.delete(h, rng.choice(len(h), lost, replace=False)) if one_sided else np.delete(h, np.flatnonzero(np.isin(h, a))[rng.choice(len(a), lost // 2, replace=False)])
                common = len(np.intersect1d(a, b))
                assert common < 0.8 * (len(a) + len(b) - common) or set(copies.part_keys(a, 0.8)) & set(copies.part_keys(b, 0.8)), n


def test_describe_nothing():
    assert copies.describe(None, 5, 0.8) == copies.describe(" \n", 5, 0.8) == (0, 0, 0, [], bytes(copies.SLOTS))
