from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest

from sluice.llm import ann


def brute(rows, k=20, modulus=20):  # noqa: ANN001, ANN201
    ok = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            ok[i] = np.float32(v).astype(float)
    dims = Counter(map(len, ok.values())).most_common(1)[0][0]
    ok = {i: v for i, v in ok.items() if len(v) == dims}
    out = {}
    for q, x in ok.items():
        if q % modulus == 0:
            scored = sorted((-sum(float(a) * float(b) for a, b in zip(x, v, strict=True)), i) for i, v in ok.items() if i != q)
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def data(n=900, dims=8, seed=1):  # noqa: ANN001, ANN201
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=dims).astype("f4").tolist()) for i in range(n)]
    same = rng.normal(size=dims).astype("f4").tolist()
    rows += [(5000 + i, same) for i in range(60)]
    return rows + [(7000, None), (7020, [0.0] * dims), (7040, [float("nan")] * dims), (7060, [float("inf")] + [1.0] * (dims - 1)), (7080, [None] + [1.0] * (dims - 1)), (7100, [1.0, 2.0]), (None, rows[3][1]), rows[20], rows[40], (7120, [])]


@pytest.fixture(scope="module")
def frame(spark):  # noqa: ANN001, ANN201
    return spark.createDataFrame(data(), "vec_id long, embedding array<float>").selectExpr("*", "1 as id", "2 as leaf", "'x' as vec", "0 as score", "5 as label").repartition(3)


def test_exact_with_all_leaves(frame):  # noqa: ANN001
    got = {}
    for r in ann.search(frame, target=1.0).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    want = brute(data())
    assert got.keys() == want.keys()
    hits = 0
    for q, best in want.items():
        mine = [got[q][i] for i in range(1, len(got[q]) + 1)]
        assert len(mine) == len(best)
        hits += len({i for i, _ in mine} & {i for i, _ in best})
        scores = [(-s, i) for i, s in mine]
        assert scores == sorted(scores)
    assert hits >= 0.995 * sum(map(len, want.values()))
    # Ties of equal vectors go to the smaller id.
    assert [v[0] for _, v in sorted(got[5000].items())] == [i for i, _ in want[5000]]
    for q in (5020, 0):
        assert all(abs(got[q][k + 1][1] - s) < 1e-9 for k, (_, s) in enumerate(want[q]))


def test_calibrated_recall(spark):  # noqa: ANN001
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(10, 16))
    rows = [(i, (centres[i % 10] + rng.normal(size=16)).astype("f4").tolist()) for i in range(3000)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).groupBy("query_id").agg({"vec_id": "collect_set"}).collect()
    want = brute(rows)
    recall = sum(len(set(r[1]) & {i for i, _ in want[r[0]]}) for r in got) / sum(map(len, want.values()))
    assert recall >= 0.93


def test_small_cells_change_nothing(frame, monkeypatch):  # noqa: ANN001
    want = sorted(map(tuple, ann.search(frame, target=1.0).collect()))
    monkeypatch.setattr(ann, "CELL_ROWS", 32)
    assert sorted(map(tuple, ann.search(frame, target=1.0).collect())) == want


def test_few_and_no_rows(spark, frame):  # noqa: ANN001
    three = spark.createDataFrame([(20, [1.0, 0.0]), (21, [2.0, 0.0]), (40, [-1.0, 1.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, ann.search(three).collect())) == [(20, 1, 21, 2.0), (20, 2, 40, -1.0), (40, 1, 20, -1.0), (40, 2, 21, -2.0)]
    assert ann.search(frame.limit(0)).count() == 0
    assert ann.search(three.limit(1)).count() == 0


def test_visits_are_best_first():
    tree = ann.fit(np.random.default_rng(0).normal(size=(2000, 4)))
    assert tree.leaves > 20
    q = np.array([1.0, 0.5, -0.2, 0.1])
    order = tree.visits(tree.scores(q[None])[0], tree.leaves)
    assert sorted(order) == list(range(tree.leaves))
    assert set(tree.file(np.random.default_rng(1).normal(size=(100, 4))).tolist()) <= set(order)


def clustered(n, groups, dims=16, seed=4):  # noqa: ANN001, ANN201
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dims)) * 3
    x = (centres[np.arange(n) % groups] + rng.normal(size=(n, dims))).astype("f4")
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def found(spark, x, monkeypatch):  # noqa: ANN001, ANN201
    """Recall against exact search, visits and leaves."""
    seen = []
    calibrate = ann._calibrate
    monkeypatch.setattr(ann, "_calibrate", lambda filed, queries, tree, *more: seen.append((calibrate(filed, queries, tree, *more), tree.leaves)) or seen[-1][0])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    got = {r[0]: set(r[1]) for r in ann.search(df).groupBy("query_id").agg({"vec_id": "collect_set"}).collect()}
    monkeypatch.setattr(ann, "_calibrate", calibrate)
    x = x.astype(float)
    asked = np.arange(0, len(x), 20)
    s = x[asked] @ x.T
    s[np.arange(len(asked)), asked] = -np.inf
    best = np.argsort(-s, axis=1)[:, :20]
    assert all(len(got[int(q)]) == 20 for q in asked)
    return sum(len(got[int(q)] & set(b.tolist())) for q, b in zip(asked, best, strict=True)) / best.size, *seen[0]


def test_leaves_grow_with_rows_and_visits_do_not(spark, monkeypatch):  # noqa: ANN001
    small, large = (found(spark, clustered(n, n // 60), monkeypatch) for n in (1500, 12_000))
    assert small[0] >= 0.93 and large[0] >= 0.93
    assert large[2] > 4 * small[2] and large[1] / large[2] < 0.6 * small[1] / small[2]


def test_large_leaves_get_trees_of_their_own(spark, monkeypatch):  # noqa: ANN001
    x = clustered(6000, 100)
    monkeypatch.setattr(ann, "FIT_ROWS", 400)
    _, _, before = found(spark, x, monkeypatch)
    monkeypatch.setattr(ann, "SPLIT_ROWS", 100)
    monkeypatch.setattr(ann, "SUB_FIT", 300)
    recall, visits, leaves = found(spark, x, monkeypatch)
    assert recall >= 0.93 and leaves > 3 * before and visits < 0.5 * leaves


def test_grafted_trees_file_every_row():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 6))
    top = ann.fit(x[:200])
    subs = {n: ann.fit(x[top.file(x) == n]) for n in range(0, top.leaves, 2)}
    tree = top.graft(subs)
    assert sorted(n for n in tree.leaf if n >= 0) == list(range(tree.leaves)) and tree.leaves == top.leaves - len(subs) + sum(s.leaves for s in subs.values())
    assert len(tree.centres) == len(tree.kids) == len(tree.leaf) and sorted(k for ks in tree.kids for k in ks) == list(range(1, len(tree.kids)))
    coarse = {}
    for a, b in zip(tree.file(x).tolist(), top.file(x).tolist(), strict=True):
        assert coarse.setdefault(a, b) == b
    assert sorted(tree.visits(tree.scores(x[:1])[0], tree.leaves)) == list(range(tree.leaves))


def test_visits_go_on_until_there_are_rows():
    tree = ann.fit(np.random.default_rng(0).normal(size=(2000, 4)))
    scores = tree.scores(np.array([[1.0, 0.5, -0.2, 0.1]]))[0]
    counts = np.zeros(tree.leaves, dtype=int)
    counts[tree.visits(scores, tree.leaves)[7]] = 50
    assert len(tree.visits(scores, 2, counts, 21)) == 8 and len(tree.visits(scores, 2)) == 2 and len(tree.visits(scores, 2, counts, 1000)) == tree.leaves


def test_products_are_of_visited_leaves_alone():
    rng = np.random.default_rng(7)
    q, v, leaf = rng.normal(size=(5, 3)), rng.normal(size=(40, 3)), np.sort(rng.integers(0, 6, 40))
    leaves = [[0, 3], [], [5], [1, 2, 3], [9]]
    got = ann.products(q, v, leaf, leaves)
    want = np.where(np.array([[n in ns for n in leaf] for ns in leaves]), q @ v.T, -np.inf)
    assert np.array_equal(np.isfinite(got), np.isfinite(want)) and np.allclose(got[np.isfinite(got)], want[np.isfinite(want)])
