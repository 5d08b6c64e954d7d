from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sluice.llm import lm


def tokens(text):  # noqa: ANN001, ANN201
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [x for x in re.split("[\x20\x09-\x0d]+", low) if x] + ["\n"]


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    classes = 2
    w = lm.Weights.fresh(classes, np.ones(classes * lm.CLASS_SIZE + lm.SHAPES))
    net = lm.Net(w, classes)
    net.w = [a.astype(np.float64) for a in net.w]
    x = rng.integers(0, net.start, size=(5, 3))
    y = rng.integers(0, net.start, size=15)

    def loss() -> float:
        s, _ = net.steps(x, np.zeros((3, lm.HIDDEN)), False)
        return -net.loss(s.reshape(-1, lm.HIDDEN).astype(np.float64), y, None)[0].sum()

    s, trace = net.steps(x, np.zeros((3, lm.HIDDEN)), True)
    grads = [np.zeros_like(a) for a in net.w]
    _, ds = net.loss(s.reshape(-1, lm.HIDDEN).astype(np.float64), y, grads)
    net.back(x, trace, ds.reshape(s.shape), grads)
    for a, g in zip(net.w, grads, strict=True):
        for k in np.argsort(-np.abs(g.ravel()))[:4]:
            old = a.ravel()[k]
            a.ravel()[k] = old + 1e-3
            up = loss()
            a.ravel()[k] = old - 1e-3
            down = loss()
            a.ravel()[k] = old
            assert abs((up - down) / 2e-3 - g.ravel()[k]) < 2e-2 * max(1, abs(g.ravel()[k]))


def test_probabilities_of_a_step_sum_to_one():
    classes = 2
    net = lm.Net(lm.Weights.fresh(classes, np.arange(1.0, classes * lm.CLASS_SIZE + lm.SHAPES + 1)), classes)
    s = np.tile(np.random.default_rng(1).normal(size=(1, lm.HIDDEN)).astype("f4"), (net.start, 1))
    lp, _ = net.loss(s, np.arange(net.start), None)
    assert abs(np.exp(lp).sum() - 1) < 1e-4


def test_windows_carry_the_state():
    classes = 2
    net = lm.Net(lm.Weights.fresh(classes, np.ones(classes * lm.CLASS_SIZE + lm.SHAPES)), classes)
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, net.start, size=n) for n in (1, 23, 24, 25, 100, 500, 3)]
    whole = net.run(texts)
    for t, got in zip(texts, whole, strict=True):
        x = np.r_[net.start, t[:-1]][:, None]
        s, _ = net.steps(x, np.zeros((1, lm.HIDDEN), dtype="f4"), False)
        want = net.loss(s.reshape(-1, lm.HIDDEN), t, None)[0].sum() / math.log(10)
        assert abs(got - want) < 1e-3 * abs(want)


def test_scores(spark, docs, rows, none, monkeypatch):  # noqa: ANN001
    monkeypatch.setattr(lm, "TABLE_WORDS", 150)  # most words go through the join
    c: Counter[str] = Counter()
    for i, t in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 7 != 2:
            c.update(tokens(t))
    n, v = sum(c.values()), len(c)
    out = lm.score(docs).collect()
    want = Counter()
    for i, t in rows:
        w = tokens(t)
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)
        want[i, i is not None and zlib.crc32(str(i).encode()) % 7 == 2, len(w), sum(x in c for x in w), n, round(base, 6)] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out) == want
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in out)
    assert lm.score(none).count() == 0


def test_beats_the_base_on_held_out_texts(spark):  # noqa: ANN001
    rng = random.Random(6)
    langs = [[f"{p}{i}" for i in range(60)] for p in "xyz"]
    rows = [(i, " ".join(rng.choices(langs[i % 3], k=rng.randint(20, 120)))) for i in range(700)]
    out = [r for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["held_out"]]
    assert len(out) > 60 and sum(r["score"] for r in out) > sum(r["base_score"] for r in out) + 0.1 * sum(r["n_tokens"] for r in out)


def plain_score(text, model, counts):  # noqa: ANN001, ANN201
    """log10 probability of a text, step by step in double precision, without lanes, windows or tables."""
    a = [x.astype(np.float64) for x in lm.Weights.unpack(model.weights, model.classes).arrays]
    inputs, u, wc, bc, wo, bo = a
    k, base, h, last, total = lm.HIDDEN, model.classes * lm.CLASS_SIZE, np.zeros(lm.HIDDEN), model.classes * lm.CLASS_SIZE + lm.SHAPES, 0.0
    softmax = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    for w in tokens(text):
        g = inputs[last]
        z, r = (1 / (1 + np.exp(-(g[i * k : i * k + k] + h @ u[:, i * k : i * k + k]))) for i in (0, 1))
        c = np.tanh(g[2 * k :] + (r * h) @ u[:, 2 * k :])
        h = c + z * (h - c)
        outer = softmax(h @ wc + bc)
        at = model.index.get(w.encode(), None)
        last = base + lm.shape(w.encode()) if at is None else int(model.numbers[at])
        if last < base:
            group = last // lm.CLASS_SIZE
            total += math.log10(outer[group] * softmax(h @ wo[group] + bo[group])[last % lm.CLASS_SIZE])
        else:
            total += math.log10(outer[model.classes + last - base] * (counts[w] + 1) / model.shape_total[last - base])
    return total


def test_scores_equal_a_plain_pass_whatever_the_partitioning(spark, docs, rows, monkeypatch):  # noqa: ANN001
    monkeypatch.setattr(lm, "TABLE_WORDS", 150)
    monkeypatch.setattr(lm, "SHARD_TOKENS", 3000)
    models = []
    train = lm.train
    monkeypatch.setattr(lm, "train", lambda coded, model: models.append((model, train(coded, model))) or models[-1][1])
    c: Counter[str] = Counter()
    for i, t in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 7 != 2:
            c.update(tokens(t))
    got = [sorted((str(r["doc_id"]), r["n_tokens"], r["score"]) for r in lm.score(d).collect()) for d in (docs.coalesce(1), docs.repartition(7))]
    assert models[0][1] == models[1][1] != models[0][0].weights and lm.shards_of(models[0][0].total // lm.ROUNDS) > 3
    assert all(a[:2] == b[:2] and abs(a[2] - b[2]) <= 1e-5 * abs(a[2]) for a, b in zip(*got, strict=True))
    model = models[0][0]
    model.weights = models[0][1]
    want = sorted((str(i), len(tokens(t)), plain_score(t, model, c)) for i, t in rows)
    assert all(a[:2] == b[:2] and abs(a[2] - b[2]) <= 1e-4 * abs(a[2]) for a, b in zip(got[0], want, strict=True))


def test_shapes():
    assert {lm.shape(w.encode()) for w in ("a", "abcdef", "abcdefghi", "x" * 20, "é", "a.", "é.", "…")} <= set(range(lm.SHAPES))
    assert lm.words(None) == [lm.END] == lm.words("") and lm.words("A É\tb") == [b"a", "É".encode(), b"b", lm.END]


ODD = ["".join(map(chr, range(1, 300))), "", " ", " a  b ", None, "a\x00b c", "É x\x85y\xa0z", "\x1c\x1d\x1e\x1fq A\x0bB\x0cC\rD\n", "x" * 900, " " * 900, "K k İ"]


def test_texts_cut_together_give_the_words_of_each(monkeypatch, rows):  # noqa: ANN001
    texts = [*ODD, *(t for _, t in rows)]
    column = pa.array(["left out", *texts], pa.string()).slice(1)
    for most in (1, 64, 1 << 20):
        monkeypatch.setattr(lm, "SPLIT_BYTES", most)
        done = 0
        for lo, hi, found, sizes in lm.split(column):
            want = [lm.words(t) for t in texts[lo:hi]]
            assert lo == done < hi and sizes.tolist() == [len(w) for w in want] and found.to_pylist() == [x for w in want for x in w[:-1]]
            done = hi
        assert done == len(texts)


def test_counting_cuts_no_text_one_by_one(monkeypatch, rows):  # noqa: ANN001
    class Frame:
        def mapInArrow(self, run, _):  # noqa: ANN001, ANN202, N802
            self.run = run
            return self

        groupBy = agg = lambda self, *_: self  # noqa: E731, N815

    texts = [*ODD, *(t for _, t in rows)]
    want = Counter(x for t in texts for x in lm.words(t))
    monkeypatch.setattr(lm, "words", None)
    got: Counter[bytes] = Counter()
    for b in lm.word_counts(Frame()).run([pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])]):
        for w, c in zip(*(x.to_pylist() for x in b.columns), strict=True):
            got[w] += c
    assert got == want


def test_scoring_takes_long_windows_where_few_texts_are_left(monkeypatch):  # noqa: ANN001
    classes, calls = 2, []
    net = lm.Net(lm.Weights.fresh(classes, np.ones(classes * lm.CLASS_SIZE + lm.SHAPES)), classes)
    loss = net.loss
    monkeypatch.setattr(net, "loss", lambda *a: calls.append(len(a[1])) or loss(*a))
    texts = [np.random.default_rng(7).integers(0, net.start, size=n) for n in (40_000, 9_000, 30)]
    got = net.run(texts)
    assert sum(calls) == sum(map(len, texts)) and len(calls) <= 4 and max(calls) <= lm.WINDOW * lm.LANES
    monkeypatch.setattr(lm, "LANES", 1)
    assert np.allclose(got, net.run(texts), rtol=1e-5)


def test_encoded_rows_equal_those_of_single_words(spark, rows):  # noqa: ANN001
    texts = [*ODD, *(t for _, t in rows)]
    counts = Counter(x for t in texts for x in lm.words(t))
    for end in (True, False):
        top = [w for w, _ in counts.most_common(150) if w != lm.END] + [lm.END] * end
        numbers = np.array([*(i if i < 64 else 64 + lm.shape(w) for i, w in enumerate(top)), 64], dtype=np.int64)
        logs = np.log10(np.array([*(counts[w] for w in top), 0]) + 1.0)
        m = lm.Model({w: i for i, w in enumerate(top)}, numbers, logs, 1, b"", 0, 0, list(range(5, 5 + lm.SHAPES)))
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("teach", F.col("doc_id") % 2 == 0)
        got = {r["doc_id"]: r for r in lm.encode(df.coalesce(2), m).collect()}
        assert len(got) == len(texts) == len({r["row"] for r in got.values()})
        for i, t in enumerate(texts):
            w, r = lm.words(t), got[i]
            ids, known, places = m.ids(w)
            rare = sum(known[k] - math.log10(m.shape_total[ids[k] - 64]) for k in range(len(w)) if ids[k] >= 64)
            assert (r["teach"], r["n_tokens"], r["n_known"]) == (i % 2 == 0, len(w), len(w) - len(places))
            assert np.frombuffer(r["ids"], "<u2").tolist() == ids.tolist()
            assert dict(zip(map(bytes, r["rest"]), r["times"], strict=True)) == Counter(w[k] for k in places.tolist())
            assert math.isclose(r["base"], known.sum(), abs_tol=1e-7) and math.isclose(r["rare"], rare, abs_tol=1e-7)


def test_shapes_of_an_array_are_those_of_its_words(rows):  # noqa: ANN001
    found = sorted({x for t in [*ODD, *(t for _, t in rows)] for x in lm.words(t)})
    column = pa.array(found, pa.binary())
    for part in (column, column.slice(5, 40), column.slice(len(found))):
        assert lm.shapes(part).tolist() == [lm.shape(w) for w in part.to_pylist()]


def test_a_table_that_teaches_nothing(spark):  # noqa: ANN001
    out = lm.score(spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")).collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) for r in sorted(out, key=lambda r: -r["n_tokens"])] == [(3, 0, 0, False), (1, 0, 0, False)]
    assert all(r["base_score"] == 0 and math.isfinite(r["score"]) for r in out)
