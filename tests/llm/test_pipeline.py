from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import compare  # noqa: E402
import corpus_pipeline  # noqa: E402

from sluice.llm import queries  # noqa: E402


def test_stages(spark, sf, tmp_path):  # noqa: ANN001
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == columns and 0.5 * n < docs.count() <= n
            n = docs.count()
            assert docs.select("doc_id").distinct().count() == n
    assert docs.select("doc_id").distinct().count() == n
    assert docs.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).groupBy("doc_id").sum("length").collect())) == sorted(map(tuple, docs.groupBy("doc_id").sum("length").collect()))


def test_stages_bear_messy_rows(spark, sf, docs, none):  # noqa: ANN001
    for frame in (docs, none):
        for name, f in corpus_pipeline.STAGES:
            out = f(spark, frame, sf)
            rows = out.collect()
            assert name == "packing" or out.columns == docs.columns
            assert len(rows) <= 4 * docs.count()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(name, spark, sf):  # noqa: ANN001
    assert compare.differences(queries.QUERIES[name](spark, sf), compare.connect(sf), queries.ORACLE_SQL[name]) == ""


def test_all_ten_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
