from __future__ import annotations

import random

from sluice.llm import quality


def test_separates_held_out_texts(spark, docs, none):  # noqa: ANN001
    rng = random.Random(3)
    good = lambda: " ".join(rng.choice(["the", "river", "was", "calm", "and", "people", "walked", "home", "slowly"]) for _ in range(rng.randint(5, 80)))
    bad = lambda: " ".join(rng.choice(["BUY!!", "NOW!!", "CLICK$$$", "FREE***", "WIN%%%"]) for _ in range(rng.randint(5, 80)))
    rows = [(i, good() if i % 4 else bad(), int(i % 4 > 0)) for i in range(400)]
    texts = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows] + [(None, 1, 0), (5, None, 0), (99999, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality.train(texts, labels)
    got = {r["doc_id"]: r["score"] for r in quality.score(texts, model).collect()}
    held = [(i, y) for i, _, y in rows if quality_fold(i) == 0]
    assert len(held) > 40 and sum((got[i] >= 0.3) == bool(y) for i, y in held) >= 0.97 * len(held)
    out = quality.score(docs, model)
    assert set(out.columns) == set(docs.columns) and dict(out.dtypes)["score"] == "double"
    assert all(0 <= r["score"] <= 1 for r in out.collect()) and out.count() == docs.count()
    assert quality.score(none, model).count() == 0


def quality_fold(i: int) -> int:
    import zlib

    return zlib.crc32(str(i).encode()) % 5


def test_no_labels_gives_the_prior(spark, docs):  # noqa: ANN001
    model = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert all(abs(r["score"] - 0.5) < 1e-9 for r in quality.score(docs, model).select("score").collect())


def test_whole_text_counts():
    m = quality.fit([("aaa bbb ccc " * 40, 1), ("ZZZ!! YYY?? " * 40, 0)] * 20)
    s = quality._Sizer(m.good, m.bad)
    assert s.difference("aaa bbb ccc " * 400) > s.difference("aaa bbb ccc " * 200 + "ZZZ!! YYY?? " * 200) > s.difference("ZZZ!! YYY?? " * 400)
    assert s.difference(None) == s.difference("") == 0.0


def test_rows_of_one_id_come_bounded(spark, monkeypatch):  # noqa: ANN001
    """An id that many rows hold sends one text to the driver."""
    seen = []
    monkeypatch.setattr(quality, "fit", seen.append)
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(2, "other"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (3, 0)], "doc_id long, quality int")
    quality.train(docs, labels, fit_rows=10, folds=1, held_out=1)
    assert sorted((t or "")[:5] + str(y) for t, y in seen[0]) == ["0", "other0", "other0", "text 1"]


def test_query_holds_out_no_null_id(spark, tmp_path):  # noqa: ANN001
    from sluice.llm import queries

    for name, rows, schema in (("documents", [(1, "one"), (None, "two"), (5, None)], "doc_id long, text string"), ("labels", [(1, 1)], "doc_id long, quality int")):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    got = {r["doc_id"]: r["held_out"] for r in queries.op6_quality(spark, str(tmp_path)).collect()}
    assert got == {1: quality_fold(1) == 0, 5: quality_fold(5) == 0, None: False}
