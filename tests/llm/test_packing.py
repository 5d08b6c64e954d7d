from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sluice.llm import packing
from sluice.llm.queries import vocabulary


@pytest.fixture(scope="module")
def full():  # noqa: ANN201
    return Tokenizer.from_file(vocabulary())


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abAZéÀß'!. \n\t019<|>stvmrld"), st.characters()), max_size=40))
def test_word_tokenizer_equals_the_library(text):  # noqa: ANN001
    try:
        text.encode()
    except UnicodeEncodeError:
        return
    t = test_word_tokenizer_equals_the_library.__dict__.setdefault("t", packing.WordTokenizer(vocabulary()))
    assert np.frombuffer(t(text), "<u4").tolist() == t.full.encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 5000), max_size=60), st.sampled_from([64, 100, 2048]))
def test_every_token_lies_in_one_window(sizes, capacity):  # noqa: ANN001
    seen = defaultdict(list)
    for w in packing.pack_batch(sizes, capacity):
        n = sum(p[2] for p in w)
        assert 0 < n <= capacity and (n == capacity or n & (n - 1) == 0)
        for i, s, k in w:
            assert k > 0
            seen[i].append((s, k))
    for i, n in enumerate(sizes):
        at = 0
        for s, k in sorted(seen[i]):
            assert s == at
            at += k
        assert at == n


def test_differencing_is_near_equal():
    rng = random.Random(1)
    sizes = [rng.randint(1, 2000) for _ in range(3000)]
    parts = packing.differencing(sizes, 150)
    sums = [sum(sizes[i] for i in p) for p in parts]
    assert sorted(i for p in parts for i in p) == list(range(3000)) and max(sums) - min(sums) < 40
    assert packing.differencing([], 3) == [[], [], []] and packing.differencing([5], 1) == [[0]]


def test_pack(docs, rows, none, full):  # noqa: ANN001
    out = [r.asDict() for r in packing.pack(docs, vocabulary(), batch_tokens=3000).collect()]
    windows = defaultdict(list)
    for r in out:
        windows[r["sequence_id"]].append(r)
        assert len(r["ids"]) == 4 * r["length"]
    for w in windows.values():
        at = 0
        for r in sorted(w, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == 2048 or at & (at - 1) == 0
    want = defaultdict(list)
    for i, t in rows:
        want[i].append(full.encode(t or "", add_special_tokens=False).ids + [1])
    got = defaultdict(int)
    for r in out:
        got[r["doc_id"]] += r["length"]
    assert got == {i: sum(map(len, x)) for i, x in want.items()}
    for i, x in want.items():
        if len(x) == 1:
            mine = sorted((r for r in out if r["doc_id"] == i), key=lambda r: r["start"])
            assert np.frombuffer(b"".join(r["ids"] for r in mine), "<u4").tolist() == x[0]
    assert packing.pack(none, vocabulary()).count() == 0
