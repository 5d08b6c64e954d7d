from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sluice.operators import joins
from sluice.plans import suite
from sluice.plans.explain import plan_text, profile
from sluice.plans.lower import run
from sluice.sources.catalog import analyze, write_bucketed


def test_no_query_runs_python(spark, sf):  # noqa: ANN001
    for name, f in suite.QUERIES.items():
        text = plan_text(f(spark, sf), "simple")
        assert "Python" not in text and "Arrow" not in text and "CartesianProduct" not in text, name


def test_filters_and_columns_reach_the_scan(spark, sf):  # noqa: ANN001
    text = plan_text(run(suite.catalog(spark, sf), "source=orders | where o_orderstatus = 'F' and o_totalprice > 10 | fields o_orderkey"))
    assert "EqualTo(o_orderstatus,F)" in text and "GreaterThan(o_totalprice" in text and "o_orderdate" not in text


def test_top_n_and_group_limit(spark, sf):  # noqa: ANN001
    c = suite.catalog(spark, sf)
    assert "TakeOrderedAndProject" in plan_text(run(c, "source=orders | sort - o_totalprice | head 3 from 2"))
    assert "WindowGroupLimit" in plan_text(run(c, "source=orders | sort o_orderkey | dedup o_custkey"))


def test_eventstats_shares_no_window(spark, sf):  # noqa: ANN001
    assert "Window" not in plan_text(run(suite.catalog(spark, sf), "source=events | eventstats avg(value) as m by event_type"))


def test_bucketed_join_has_no_exchange(spark, sf):  # noqa: ANN001
    c = suite.catalog(spark, sf)
    write_bucketed(c.load("orders"), "orders_b", 4, "o_orderkey")
    write_bucketed(c.load("lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), "lineitem_b", 4, "o_orderkey")
    analyze(spark, "orders_b", "o_orderkey")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = joins.colocated(spark, "orders_b", "lineitem_b", ["o_orderkey"])
        assert "Exchange" not in plan_text(df) and df.count() == c.load("lineitem").count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for t in ("orders_b", "lineitem_b"):
            spark.sql(f"DROP TABLE {t}")


def test_broadcast_hint_minds_the_size(spark, sf):  # noqa: ANN001
    c = suite.catalog(spark, sf)
    left, right = c.load("lineitem"), c.load("orders")
    on = F.col("l_orderkey") == F.col("o_orderkey")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10")
    try:
        assert "BroadcastHashJoin" not in plan_text(joins.join(left, right, on, "inner", "broadcast"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan_text(joins.join(left, right, on, "inner", "broadcast"))
    with pytest.raises(ValueError):
        joins.join(left, right, on, "inner", "magic")
    with pytest.raises(ValueError):
        joins.join(left, right, on, "sideways")


@pytest.mark.parametrize("conf", [{"spark.sql.adaptive.enabled": "false"}, {"spark.sql.autoBroadcastJoinThreshold": "-1"}, {"spark.sql.optimizer.runtime.bloomFilter.enabled": "false"}, {"spark.sql.codegen.wholeStage": "false"}])
def test_switches_change_no_answer(spark, sf, conf):  # noqa: ANN001
    names = ["join_three", "join_residual", "eventstats_by", "stats_distinct", "window_ranks", "join_semi", "set_intersect"]
    answer = lambda: {n: sorted(map(str, suite.QUERIES[n](spark, sf).collect())) for n in names}
    want = answer()
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        assert answer() == want
    finally:
        for k in conf:
            spark.conf.unset(k)


def test_profile_counts(spark, sf):  # noqa: ANN001
    df = run(suite.catalog(spark, sf), "source=orders | where o_orderstatus = 'F' | stats count() by o_orderpriority")
    node, seconds = profile(df)
    assert seconds > 0 and node.total("numFiles") >= 1 and node.find("Scan")


def test_profile_and_limit_of_a_query(spark, sf):  # noqa: ANN001
    cat = suite.catalog(spark, sf)
    got = run(cat, "profile source=orders | where o_orderstatus = 'F' | stats count() by o_orderpriority").collect()
    assert got[0]["metric"] == "milliseconds" and [r["position"] for r in got] == list(range(len(got)))
    assert any(r["node"].startswith("Scan") and r["metric"] == "numOutputRows" and r["value"] > 0 for r in got)
    assert run(cat, "source=orders", max_rows=7).count() == 7 and run(cat, "source=nation", max_rows=700).count() == 25


def test_runtime_filter_fires(spark, sf):  # noqa: ANN001
    """A selective small side filters the scan of the large one before the shuffle."""
    confs = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0"}
    query = "source=lineitem | inner join left=l right=p ON l.l_partkey = p.p_partkey [ source=part | where p_size = 7 ] | stats count() as n"
    want = run(suite.catalog(spark, sf), query).collect()
    for k, v in confs.items():
        spark.conf.set(k, v)
    try:
        df = run(suite.catalog(spark, sf), query)
        assert "might_contain" in plan_text(df) and df.collect() == want
    finally:
        for k in confs:
            spark.conf.unset(k)
