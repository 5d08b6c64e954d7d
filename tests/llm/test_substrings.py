from __future__ import annotations

import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sluice.llm import substrings as S


def brute(rows):  # noqa: ANN001, ANN201
    """Per row: (id, bytes, runs, kept)."""
    first: dict[bytes, int] = {}
    for i, t in rows:
        raw = (t or "").encode()
        for k in range(len(raw) - 49 if i is not None else 0):
            w = raw[k : k + 50]
            first[w] = min(i, first.get(w, i))
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 49 if i is not None else 0):
            if first[raw[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        runs, k = [], 0
        while k < len(raw):
            if gone[k]:
                e = k
                while e < len(raw) and gone[e]:
                    e += 1
                runs.append((k, e))
                k = e
            else:
                k += 1
        out.append((i, len(raw), tuple(runs), bytes(b for b, g in zip(raw, gone, strict=True) if not g)))
    return Counter(out)


def result(df):  # noqa: ANN001, ANN201
    return Counter((r["doc_id"], r["n_bytes"], tuple((x["start"], x["end"]) for x in r["runs"]), bytes(r["kept"])) for r in S.remove_repeats(df).collect())


def test_equals_brute_force(docs, rows, none):  # noqa: ANN001
    assert result(docs) == brute(rows)
    assert S.remove_repeats(none).count() == 0


def test_periodic_texts_and_chunk_borders(spark, monkeypatch):  # noqa: ANN001
    monkeypatch.setattr(S, "CHUNK", 1 << 10)
    rng = random.Random(2)
    base = "".join(rng.choices("ab", k=4000))
    rows = [(9, base), (4, "xyz" + base[700:2900] + "q"), (7, "ab" * 700), (5, "ab" * 30), (6, "a" * 300), (8, "a" * 50), (3, "b" * 49), (10, base[:50]), (11, base[1:50]), (12, base[::-1])]
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_hot_anchors_are_dealt_to_several_shards(spark, docs, rows, monkeypatch):  # noqa: ANN001
    rng = random.Random(8)
    passage = "".join(rng.choices("abcdefgh ", k=300))
    made = [(i, "".join(rng.choices("ijklmnop ", k=rng.randint(0, 90))) + passage[: rng.choice((40, 120, 300))] + passage[rng.choice((0, 60, 250)) :] * rng.randint(0, 1) + str(i)) for i in range(400)]
    df = spark.createDataFrame(made, "doc_id long, text string").repartition(12)
    seen = []
    shared = S._shared_map
    monkeypatch.setattr(S, "_shared_map", lambda *a: seen.append(shared(*a)) or seen[-1])
    assert result(df) == brute(made) and not len(seen[0][1])
    for hot, salts, dense in ((4, 8, 64), (30, 3, 5)):
        monkeypatch.setattr(S, "DENSE", dense)
        monkeypatch.setattr(S, "HOT", hot)
        monkeypatch.setattr(S, "SALTS", salts)
        assert result(df) == brute(made) and len(seen[-1][1]) > 10
    assert result(docs) == brute(rows)


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10**6), st.integers(2, 4))
def test_equal_windows_have_equal_anchors(seed, letters):  # noqa: ANN001
    rng = random.Random(seed)
    piece = bytes(rng.choices(b"abcd"[:letters], k=200))
    buf = np.frombuffer(bytes(rng.choices(b"abcd"[:letters], k=77)) + piece + bytes(rng.choices(b"abcd"[:letters], k=91)) + piece, dtype=np.uint8)
    p, first, last, h = S.anchors(buf, np.zeros(len(buf), dtype=int))
    of = {w: (a - w, int(x)) for a, lo, hi, x in zip(p.tolist(), first.tolist(), last.tolist(), h.tolist(), strict=True) for w in range(lo, hi + 1)}
    assert sorted(of) == list(range(len(buf) - 49))
    seen: dict[bytes, tuple[int, int]] = {}
    for w, v in of.items():
        assert seen.setdefault(buf[w : w + 50].tobytes(), v) == v


def test_packing_round_trip():
    a, b, c = np.array([-1, 2**60, 5]), np.array([7], dtype="<i4"), np.array([1, 2, 255], dtype=np.uint8)
    x, y, z = S._unpack(S._pack(a, b, c), ("<i8", 3), ("<i4", 1), ("u1", 3))
    assert x.tolist() == a.tolist() and y.tolist() == b.tolist() and z.tolist() == c.tolist()
