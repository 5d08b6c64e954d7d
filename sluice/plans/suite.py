"""Named queries of the engine, each with SQL that another database runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators import joins, ops
from sluice.plans.lower import run
from sluice.sources.catalog import Catalog

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "conversations")
KINDS = {"documents.text": "text", "pages.html": "text", "conversations.text": "text", "part.p_name": "text"}

#: name: (query in the pipe language, SQL)
PIPES: dict[str, tuple[str, str]] = {
    # filters
    "where_compare": (
        "source=orders | where o_totalprice >= 100000 and o_totalprice < 120000 and o_orderstatus != 'F' | fields o_orderkey, o_totalprice",
        "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 100000 AND o_totalprice < 120000 AND o_orderstatus <> 'F'",
    ),
    "where_in": ("source=orders | where o_orderpriority in ('1-URGENT', '2-HIGH') and o_custkey not in (1, 2, 3) | stats count() as n by o_orderpriority", "SELECT count(*) AS n, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT','2-HIGH') AND o_custkey NOT IN (1,2,3) GROUP BY 2"),
    "where_between": ("source=lineitem | where l_quantity between 10 and 12 and l_discount not between 0.02 and 0.05 | stats count() as n, min(l_quantity) as lo, max(l_quantity) as hi", "SELECT count(*) AS n, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem WHERE l_quantity BETWEEN 10 AND 12 AND l_discount NOT BETWEEN 0.02 AND 0.05"),
    "where_like": ("source=customer | where c_name like '%00_7' or like(c_mktsegment, 'auto%', false) | stats count() as n by c_mktsegment", "SELECT count(*) AS n, c_mktsegment FROM customer WHERE c_name LIKE '%00_7' OR c_mktsegment ILIKE 'auto%' GROUP BY 2"),
    "where_ilike": ("source=supplier | where s_name ilike 'supplier#%1' | fields s_suppkey", "SELECT s_suppkey FROM supplier WHERE s_name ILIKE 'supplier#%1'"),
    "where_regexp": ("source=customer | where regexp_like(c_name, '#0+[1-3]5$') | fields c_custkey, c_name", "SELECT c_custkey, c_name FROM customer WHERE regexp_matches(c_name, '#0+[1-3]5$')"),
    "where_logic": ("source=orders | where not (o_orderstatus = 'O' or o_totalprice > 50000) xor o_custkey % 2 = 0 | stats count() as n", "SELECT count(*) AS n FROM orders WHERE (NOT (o_orderstatus = 'O' OR o_totalprice > 50000)) <> (o_custkey % 2 = 0)"),
    "where_timestamp": ("source=orders | where o_orderdate >= timestamp('1997-03-01 00:00:00') and o_orderdate < '1997-04-01 00:00:00' | stats count() as n", "SELECT count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1997-03-01' AND o_orderdate < TIMESTAMP '1997-04-01'"),
    "where_nulls": ("source=orders | left join left=o right=c ON o.o_custkey = c.c_custkey and c.c_acctbal > 5000 customer | where c_name is null | stats count() as n", "SELECT count(*) AS n FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey AND c.c_acctbal > 5000 WHERE c.c_name IS NULL"),
    "search_shorthand": ("source=orders o_orderstatus=F OR o_orderpriority='1-URGENT' | stats count() as n", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F' OR o_orderpriority = '1-URGENT'"),
    "search_wildcard": ("source=customer c_mktsegment='A*' c_nationkey<5 | stats count() as n", "SELECT count(*) AS n FROM customer WHERE c_mktsegment LIKE 'A%' AND c_nationkey < 5"),
    "search_phrase": ('source=documents text="Released under" | stats count() as n', r"SELECT count(*) AS n FROM documents WHERE regexp_matches(lower(text), '(^|[^\p{L}\p{N}])released[^\p{L}\p{N}]+under([^\p{L}\p{N}]|$)')"),
    # projections
    "eval_chain": ("source=lineitem | eval net = l_extendedprice * (1 - l_discount), gross = net * (1 + l_tax) | eval gross = round(gross, 2), net = round(net, 2) | fields l_orderkey, l_linenumber, net, gross", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 2) AS net, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 2) AS gross FROM lineitem"),
    "fields_wildcard": ("source=supplier | fields s_s* *key", "SELECT s_suppkey, s_nationkey FROM supplier"),
    "fields_exclude": ("source=nation | fields - n_name", "SELECT n_nationkey, n_regionkey FROM nation"),
    "table_mixed": ("source=region | table r_name r_regionkey", "SELECT r_name, r_regionkey FROM region"),
    "rename_columns": ("source=region | rename r_name as title, r_regionkey as `the key`", 'SELECT r_name AS title, r_regionkey AS "the key" FROM region'),
    # aggregates
    "stats_global": ("source=lineitem | stats count() as n, sum(l_quantity) as q, avg(l_quantity) as a, min(l_shipdate) as lo, max(l_shipdate) as hi | eval a = round(a, 4)", "SELECT count(*) AS n, sum(l_quantity) AS q, round(avg(l_quantity), 4) AS a, min(l_shipdate) AS lo, max(l_shipdate) AS hi FROM lineitem"),
    "stats_by": ("source=lineitem | stats count() as n, sum(l_quantity) as q, avg(l_discount) as d by l_returnflag, l_linestatus | eval d = round(d, 4)", "SELECT count(*) AS n, sum(l_quantity) AS q, round(avg(l_discount), 4) AS d, l_returnflag, l_linestatus FROM lineitem GROUP BY ALL"),
    "stats_distinct": ("source=orders | stats dc(o_custkey) as customers, count(distinct o_orderpriority) as priorities by o_orderstatus", "SELECT count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderpriority) AS priorities, o_orderstatus FROM orders GROUP BY ALL"),
    "stats_expression": ("source=lineitem | stats sum(l_extendedprice * (1 - l_discount)) as revenue, avg(length(l_returnflag) + 1) as x by l_linenumber % 3 as g | eval revenue = round(revenue, 0)", "SELECT round(sum(l_extendedprice * (1 - l_discount)), 0) AS revenue, avg(length(l_returnflag) + 1) AS x, l_linenumber % 3 AS g FROM lineitem GROUP BY 3"),
    "stats_having": ("source=orders | stats count() as n by o_custkey | where n > 12 | sort - n, o_custkey", "SELECT count(*) AS n, o_custkey FROM orders GROUP BY 2 HAVING count(*) > 12"),
    "stats_default_names": ("source=orders | stats count(), max(o_totalprice) by o_orderstatus | sort - `count()`, o_orderstatus | head 2", 'SELECT count(*) AS "count()", max(o_totalprice) AS "max(o_totalprice)", o_orderstatus FROM orders GROUP BY 3 ORDER BY 1 DESC, 3 LIMIT 2'),
    "stats_bucket_nullable": ("source=orders | left join left=o right=c ON o.o_custkey = c.c_custkey and c.c_acctbal > 0 customer | stats bucket_nullable=false count() as n by c_mktsegment", "SELECT count(*) AS n, c_mktsegment FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey AND c.c_acctbal > 0 GROUP BY 2"),
    "stats_null_group": ("source=orders | left join left=o right=c ON o.o_custkey = c.c_custkey and c.c_acctbal > 0 customer | stats count() as n, count(c_name) as m, sum(c_nationkey) as s by c_mktsegment", "SELECT count(*) AS n, count(c_name) AS m, sum(c_nationkey)::BIGINT AS s, c_mktsegment FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey AND c.c_acctbal > 0 GROUP BY ALL"),
    "stats_statistics": ("source=part | stats stddev_samp(p_retailprice) as a, stddev_pop(p_retailprice) as b, var_samp(p_size) as c, var_pop(p_size) as d by p_brand | eval a = round(a, 4), b = round(b, 4), c = round(c, 4), d = round(d, 4)", "SELECT round(stddev_samp(p_retailprice), 4) AS a, round(stddev_pop(p_retailprice), 4) AS b, round(var_samp(p_size), 4) AS c, round(var_pop(p_size), 4) AS d, p_brand FROM part GROUP BY ALL"),
    "stats_percentiles": ("source=part | stats percentile(p_retailprice, 90) as p, median(p_retailprice) as m by p_brand | eval p = round(p, 4), m = round(m, 4)", "SELECT round(quantile_cont(p_retailprice, 0.9), 4) AS p, round(median(p_retailprice), 4) AS m, p_brand FROM part GROUP BY ALL"),
    "stats_earliest": ("source=events | stats earliest(event_id, event_id) as a, latest(value, event_id) as b by event_type", "SELECT arg_min(event_id, event_id) AS a, arg_max(value, event_id) AS b, event_type FROM events GROUP BY ALL"),
    "stats_values": ("source=nation | stats values(n_name) as v by n_regionkey | eval v = mvjoin(v, ';')", "SELECT string_agg(DISTINCT n_name, ';' ORDER BY n_name) AS v, n_regionkey FROM nation GROUP BY ALL"),
    "stats_sum0": ("source=customer | where c_acctbal > 1000000 | stats sum0(c_acctbal) as s, sum(c_acctbal) as t, count() as n", "SELECT coalesce(sum(c_acctbal), 0) AS s, sum(c_acctbal) AS t, count(*) AS n FROM customer WHERE c_acctbal > 1000000"),
    "stats_cube": ("source=lineitem | stats count() as n by cube(l_returnflag, l_linestatus)", "SELECT count(*) AS n, l_returnflag, l_linestatus FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)"),
    "stats_rollup": ("source=lineitem | stats sum(l_quantity) as q by rollup(l_returnflag, l_linestatus)", "SELECT sum(l_quantity) AS q, l_returnflag, l_linestatus FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)"),
    # order and limits
    "sort_head": ("source=orders | sort - o_totalprice, o_orderkey | head 10 | fields o_orderkey, o_totalprice", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10"),
    "sort_offset": ("source=orders | sort o_orderdate, - o_orderkey | head 7 from 5 | fields o_orderkey", "SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey DESC LIMIT 7 OFFSET 5"),
    "sort_nulls": ("source=nation | left join left=n right=s ON n.n_nationkey = s.s_suppkey supplier | sort s_acctbal nulls last, n_nationkey | head 12 | fields n_nationkey, s_acctbal", "SELECT n_nationkey, s_acctbal FROM nation LEFT JOIN supplier ON n_nationkey = s_suppkey ORDER BY s_acctbal NULLS LAST, n_nationkey LIMIT 12"),
    "top_groups": ("source=lineitem | stats sum(l_quantity) as q by l_partkey | sort - q, l_partkey | head 5", "SELECT sum(l_quantity) AS q, l_partkey FROM lineitem GROUP BY 2 ORDER BY 1 DESC, 2 LIMIT 5"),
    # joins
    "join_inner": ("source=customer | inner join left=c right=n ON c.c_nationkey = n.n_nationkey nation | stats count() as n, sum(c_acctbal) as s by n_name | eval s = round(s, 2)", "SELECT count(*) AS n, round(sum(c_acctbal), 2) AS s, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL"),
    "join_left": ("source=customer | left join left=c right=o ON c.c_custkey = o.o_custkey [ source=orders | where o_totalprice > 150000 ] | stats count(o_orderkey) as n by c_mktsegment", "SELECT count(o_orderkey) AS n, c_mktsegment FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 150000) ON c_custkey = o_custkey GROUP BY ALL"),
    "join_right": ("source=supplier | where s_acctbal > 7000 | right join left=s right=n ON s.s_nationkey = n.n_nationkey nation | fields s_suppkey, n_nationkey", "SELECT s_suppkey, n_nationkey FROM (SELECT * FROM supplier WHERE s_acctbal > 7000) RIGHT JOIN nation ON s_nationkey = n_nationkey"),
    "join_full": ("source=region | full join left=r right=n ON r.r_regionkey = n.n_nationkey nation | fields r_name, n_name", "SELECT r_name, n_name FROM region FULL JOIN nation ON r_regionkey = n_nationkey"),
    "join_semi": ("source=customer | semi join left=c right=o ON c.c_custkey = o.o_custkey orders | stats count() as n", "SELECT count(*) AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)"),
    "join_anti": ("source=customer | anti join left=c right=o ON c.c_custkey = o.o_custkey orders | stats count() as n, min(c_custkey) as k", "SELECT count(*) AS n, min(c_custkey) AS k FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)"),
    "join_residual": ("source=orders | inner join left=o right=l ON o.o_orderkey = l.l_orderkey and l.l_shipdate > o.o_orderdate and l.l_quantity < 20 lineitem | stats count() as n by o_orderstatus", "SELECT count(*) AS n, o_orderstatus FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_shipdate > o_orderdate AND l_quantity < 20 GROUP BY ALL"),
    "join_theta": ("source=region | inner join left=r right=n ON r.r_regionkey < n.n_regionkey nation | stats count() as n by r_name", "SELECT count(*) AS n, r_name FROM region JOIN nation ON r_regionkey < n_regionkey GROUP BY ALL"),
    "join_three": ("source=orders | inner join left=o right=c ON o.o_custkey = c.c_custkey customer | inner join left=x right=n ON x.c_nationkey = n.n_nationkey nation | stats count() as n, sum(o_totalprice) as s by n_name | eval s = round(s, 0)", "SELECT count(*) AS n, round(sum(o_totalprice), 0) AS s, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL"),
    "join_self_names": ("source=nation | inner join left=a right=b ON a.n_regionkey = b.n_regionkey nation | where a.n_nationkey < b.n_nationkey | fields a.n_name, b.n_name", 'SELECT a.n_name AS "a.n_name", b.n_name AS "b.n_name" FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey'),
    "join_broadcast": ("source=lineitem | inner join left=l right=s hint=broadcast ON l.l_suppkey = s.s_suppkey supplier | stats sum(l_quantity) as q by s_nationkey", "SELECT sum(l_quantity) AS q, s_nationkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL"),
    "join_shuffle_hash": ("source=lineitem | inner join left=l right=o hint=shuffle_hash ON l.l_orderkey = o.o_orderkey orders | stats count() as n by o_orderpriority", "SELECT count(*) AS n, o_orderpriority FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL"),
    # windows
    "eventstats_by": ("source=events | eventstats avg(value) as m, count() as n by event_type | eval m = round(m, 4) | fields event_id, m, n", "SELECT event_id, round(avg(value) OVER (PARTITION BY event_type), 4) AS m, count(*) OVER (PARTITION BY event_type) AS n FROM events"),
    "eventstats_global": ("source=supplier | eventstats max(s_acctbal) as top, dc(s_nationkey) as d | where s_acctbal = top | fields s_suppkey, top, d", "SELECT s_suppkey, s_acctbal AS top, (SELECT count(DISTINCT s_nationkey) FROM supplier) AS d FROM supplier WHERE s_acctbal = (SELECT max(s_acctbal) FROM supplier)"),
    "dedup_first": ("source=orders | sort o_custkey, - o_totalprice, o_orderkey | dedup o_custkey | fields o_custkey, o_orderkey", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1"),
    "dedup_two": ("source=orders | sort - o_totalprice, o_orderkey | dedup 2 o_orderstatus, o_orderpriority | fields o_orderkey", "SELECT o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) <= 2"),
    "window_ranks": (
        "source=orders | eval rn = row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey), rk = rank() over (partition by o_custkey order by o_orderpriority), dr = dense_rank() over (partition by o_custkey order by o_orderpriority) | fields o_orderkey, rn, rk, dr",
        "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS rk, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS dr FROM orders",
    ),
    "window_frames": (
        "source=events | eval run = sum(value) over (partition by user_id order by event_id rows between 2 preceding and current row), ahead = max(value) over (partition by user_id order by event_id rows between current row and 1 following), all = count() over (partition by user_id) | eval run = round(run, 4) | fields event_id, run, ahead, all",
        'SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS run, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS ahead, count(*) OVER (PARTITION BY user_id) AS "all" FROM events',
    ),
    "window_range": ("source=lineitem | eval s = sum(l_quantity) over (partition by l_orderkey order by l_linenumber range between 1 preceding and 1 following) | fields l_orderkey, l_linenumber, s", "SELECT l_orderkey, l_linenumber, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS s FROM lineitem"),
    "window_values": (
        "source=events | eval prev = lag(event_id) over (partition by user_id order by event_id), next2 = lead(event_id, 2) over (partition by user_id order by event_id), f = first_value(event_id) over (partition by user_id order by event_id), q = ntile(4) over (partition by user_id order by event_id), cd = round(cume_dist() over (partition by user_id order by event_id), 6), pr = round(percent_rank() over (partition by user_id order by event_id), 6) | fields event_id, prev, next2, f, q, cd, pr",
        "SELECT event_id, lag(event_id) OVER w AS prev, lead(event_id, 2) OVER w AS next2, first_value(event_id) OVER w AS f, ntile(4) OVER w AS q, round(cume_dist() OVER w, 6) AS cd, round(percent_rank() OVER w, 6) AS pr FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)",
    ),
    # buckets
    "span_day": ("source=events | stats count() as n by span(ts, 1d) as d", "SELECT count(*) AS n, date_trunc('day', ts)::TIMESTAMP AS d FROM events GROUP BY 2"),
    "span_minutes": ("source=events | stats count() as n by span(ts, 15m) as b, event_type", "SELECT count(*) AS n, time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '1970-01-01') AS b, event_type FROM events GROUP BY ALL"),
    "span_hours": ("source=events | stats avg(value) as a by span(ts, 6h) as b | eval a = round(a, 4)", "SELECT round(avg(value), 4) AS a, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS b FROM events GROUP BY 2"),
    "span_week": ("source=orders | stats count() as n by span(o_orderdate, 1w) as b", "SELECT count(*) AS n, date_trunc('week', o_orderdate)::TIMESTAMP AS b FROM orders GROUP BY 2"),
    "span_two_weeks": ("source=orders | stats count() as n by span(o_orderdate, 2w) as b", "SELECT count(*) AS n, time_bucket(INTERVAL 14 DAY, o_orderdate, TIMESTAMP '1969-12-29') AS b FROM orders GROUP BY 2"),
    "span_months": ("source=orders | stats sum(o_totalprice) as s by span(o_orderdate, 3M) as b | eval s = round(s, 0)", "SELECT round(sum(o_totalprice), 0) AS s, date_trunc('quarter', o_orderdate)::TIMESTAMP AS b FROM orders GROUP BY 2"),
    "span_year": ("source=orders | stats count() as n by span(o_orderdate, 1y) as b, span(o_orderdate, 1q) as q", "SELECT count(*) AS n, date_trunc('year', o_orderdate)::TIMESTAMP AS b, date_trunc('quarter', o_orderdate)::TIMESTAMP AS q FROM orders GROUP BY 2, 3"),
    "span_number": ("source=orders | stats count() as n by span(o_custkey, 25) as k, span(o_totalprice, 50000.5) as p", "SELECT count(*) AS n, o_custkey // 25 * 25 AS k, floor(o_totalprice / 50000.5::DOUBLE) * 50000.5::DOUBLE AS p FROM orders GROUP BY 2, 3"),
    "span_millis": ("source=events | stats count() as n by span(ts, 500ms) as b", "SELECT count(*) AS n, time_bucket(INTERVAL 500 MILLISECOND, ts, TIMESTAMP '1970-01-01') AS b FROM events GROUP BY 2"),
    "bin_span": ("source=customer | bin c_acctbal span=1000 as b | stats count() as n by b", "SELECT count(*) AS n, floor(c_acctbal / 1000) * 1000 AS b FROM customer GROUP BY 2"),
    "bin_log": ("source=part | bin p_retailprice span=log10 as b | stats count() as n by b", "SELECT count(*) AS n, 10.0::DOUBLE ** floor(log10(p_retailprice)) AS b FROM part GROUP BY 2"),
    "bin_bins": ("source=part | bin p_size bins=7 as b | eval b = round(b, 6) | stats count() as n by b", "WITH e AS (SELECT min(p_size)::DOUBLE AS lo, max(p_size)::DOUBLE AS hi FROM part) SELECT count(*) AS n, round(lo + least(floor((p_size - lo) / ((hi - lo) / 7)), 6) * ((hi - lo) / 7), 6) AS b FROM part, e GROUP BY 2"),
    # scalar functions
    "math_functions": (
        "source=customer | eval a = abs(c_acctbal), b = ceil(c_acctbal), c = floor(c_acctbal), d = round(c_acctbal, 1), e = truncate(c_acctbal, 1), f = sign(c_acctbal), g = round(pow(c_nationkey, 2), 4), h = round(sqrt(c_custkey), 6), i = round(cbrt(c_custkey), 6), j = c_custkey % 7, k = c_custkey / 7, l = round(c_acctbal / 3, 6) | fields c_custkey, a, b, c, d, e, f, g, h, i, j, k, l",
        "SELECT c_custkey, abs(c_acctbal) AS a, ceil(c_acctbal) AS b, floor(c_acctbal) AS c, round(c_acctbal, 1) AS d, sign(c_acctbal) * floor(abs(c_acctbal) * 10) / 10 AS e, sign(c_acctbal)::DOUBLE AS f, c_nationkey::DOUBLE ** 2 AS g, round(sqrt(c_custkey), 6) AS h, round(cbrt(c_custkey), 6) AS i, c_custkey % 7 AS j, c_custkey // 7 AS k, round(c_acctbal / 3, 6) AS l FROM customer",
    ),
    "math_logs": (
        "source=part | eval a = round(exp(p_size / 10.0), 4), b = round(ln(p_retailprice), 6), c = round(log10(p_retailprice), 6), d = round(log2(p_retailprice), 6), e = round(log(p_retailprice), 6), f = round(pi(), 6), g = round(e(), 6), h = round(expm1(0.001 * p_size), 8), i = rint(p_retailprice) | fields p_partkey, a, b, c, d, e, f, g, h, i",
        "SELECT p_partkey, round(exp(p_size / 10.0::DOUBLE), 4) AS a, round(ln(p_retailprice), 6) AS b, round(log10(p_retailprice), 6) AS c, round(log2(p_retailprice), 6) AS d, round(ln(p_retailprice), 6) AS e, round(pi(), 6) AS f, round(exp(1.0::DOUBLE), 6) AS g, round(exp(0.001::DOUBLE * p_size) - 1, 8) AS h, round_even(p_retailprice, 0) AS i FROM part",
    ),
    "trig_functions": (
        "source=part | eval x = p_size / 100.0, a = round(cos(x), 6), b = round(sin(x), 6), c = round(tan(x), 6), d = round(acos(x), 6), e = round(asin(x), 6), f = round(atan(x), 6), g = round(atan2(x, 2), 6), h = round(cosh(x), 6), i = round(cot(x), 4), j = round(radians(p_size), 6), k = round(degrees(x), 6), l = round(sinh(x), 6) | fields p_partkey, a, b, c, d, e, f, g, h, i, j, k, l",
        "SELECT p_partkey, round(cos(x), 6) AS a, round(sin(x), 6) AS b, round(tan(x), 6) AS c, round(acos(x), 6) AS d, round(asin(x), 6) AS e, round(atan(x), 6) AS f, round(atan2(x, 2), 6) AS g, round(cosh(x), 6) AS h, round(cot(x), 4) AS i, round(radians(p_size), 6) AS j, round(degrees(x), 6) AS k, round(sinh(x), 6) AS l FROM (SELECT p_partkey, p_size, p_size / 100.0::DOUBLE AS x FROM part)",
    ),
    "string_functions": (
        "source=customer | eval a = upper(c_mktsegment), b = lower(c_mktsegment), c = length(c_name), d = concat(c_mktsegment, '-', c_custkey), e = substring(c_name, 3, 5), f = reverse(c_mktsegment), g = replace(c_name, '0', 'o'), h = ascii(c_mktsegment), i = position('u' in c_name), j = lpad(c_mktsegment, 12, '*'), k = rpad(c_mktsegment, 4, '*'), l = trim(concat('  ', c_mktsegment, ' ')), m = left(c_name, 4), n = right(c_name, 3), o = concat_ws('/', c_mktsegment, c_name), p = strcmp(c_mktsegment, 'F') | fields c_custkey, a, b, c, d, e, f, g, h, i, j, k, l, m, n, o, p",
        "SELECT c_custkey, upper(c_mktsegment) AS a, lower(c_mktsegment) AS b, length(c_name)::INT AS c, c_mktsegment || '-' || c_custkey AS d, substring(c_name, 3, 5) AS e, reverse(c_mktsegment) AS f, replace(c_name, '0', 'o') AS g, ascii(c_mktsegment) AS h, instr(c_name, 'u')::INT AS i, lpad(c_mktsegment, 12, '*') AS j, rpad(c_mktsegment, 4, '*') AS k, c_mktsegment AS l, left(c_name, 4) AS m, right(c_name, 3) AS n, c_mktsegment || '/' || c_name AS o, CASE WHEN c_mktsegment < 'F' THEN -1 WHEN c_mktsegment > 'F' THEN 1 ELSE 0 END AS p FROM customer",
    ),
    "regex_functions": ("source=customer | eval a = regexp_replace(c_name, '^([A-Za-z]+)#0*', '\\1-'), b = regexp_extract(c_name, '#(0+)', 1) | fields c_custkey, a, b", r"SELECT c_custkey, regexp_replace(c_name, '^([A-Za-z]+)#0*', '\1-') AS a, regexp_extract(c_name, '#(0+)', 1) AS b FROM customer"),
    "conditionals": (
        "source=orders | eval a = if(o_totalprice > 100000, 'big', 'small'), b = case(o_orderstatus = 'F', 1, o_orderstatus = 'O', 2 else 3), c = coalesce(nullif(o_orderstatus, 'F'), 'none'), d = ifnull(nullif(o_custkey, 5), -1), e = isnull(nullif(o_orderstatus, 'O')), f = ispresent(o_orderstatus) | fields o_orderkey, a, b, c, d, e, f",
        "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'big' ELSE 'small' END AS a, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS b, coalesce(nullif(o_orderstatus, 'F'), 'none') AS c, coalesce(nullif(o_custkey, 5), -1) AS d, nullif(o_orderstatus, 'O') IS NULL AS e, o_orderstatus IS NOT NULL AS f FROM orders",
    ),
    "casts": ("source=orders | eval a = cast(o_orderkey as string), b = cast(o_totalprice as int), c = cast(o_orderdate as date), d = cast('12' as long), e = tonumber('x1'), f = tostring(o_custkey) | fields a, b, c, d, e, f", "SELECT o_orderkey::VARCHAR AS a, trunc(o_totalprice)::INT AS b, o_orderdate::DATE AS c, 12::BIGINT AS d, NULL::DOUBLE AS e, o_custkey::VARCHAR AS f FROM orders"),
    "hash_functions": ("source=region | eval a = md5(r_name), b = sha1(r_name), c = sha256(r_name), d = sha2(r_name, 256) | fields r_regionkey, a, b, c, d", "SELECT r_regionkey, md5(r_name) AS a, sha1(r_name) AS b, sha256(r_name) AS c, sha256(r_name) AS d FROM region"),
    "date_parts": (
        "source=events | eval a = year(ts), b = month(ts), c = day(ts), d = hour(ts), e = minute(ts), f = second(ts), g = quarter(ts), h = week(ts), i = day_of_week(ts), j = day_of_year(ts), k = dayname(ts), l = monthname(ts), m = weekday(ts) | fields event_id, a, b, c, d, e, f, g, h, i, j, k, l, m",
        "SELECT event_id, year(ts) AS a, month(ts) AS b, day(ts) AS c, hour(ts) AS d, minute(ts) AS e, second(ts) AS f, quarter(ts) AS g, weekofyear(ts) AS h, dayofweek(ts) + 1 AS i, dayofyear(ts) AS j, dayname(ts) AS k, monthname(ts) AS l, isodow(ts) - 1 AS m FROM events",
    ),
    "date_extract": ("source=orders | eval a = extract(year from o_orderdate), b = extract(quarter from o_orderdate), c = extract(month from o_orderdate), d = extract(week from o_orderdate), e = extract(doy from o_orderdate), f = extract(dow from o_orderdate) | fields o_orderkey, a, b, c, d, e, f", "SELECT o_orderkey, year(o_orderdate) AS a, quarter(o_orderdate) AS b, month(o_orderdate) AS c, weekofyear(o_orderdate) AS d, dayofyear(o_orderdate) AS e, dayofweek(o_orderdate) + 1 AS f FROM orders"),
    "date_arithmetic": (
        "source=orders | eval a = date_add(date(o_orderdate), 10), b = date_sub(date(o_orderdate), 3), c = datediff(o_orderdate, '1995-01-01'), d = last_day(o_orderdate), e = timestampadd(month, 2, o_orderdate), f = timestampdiff(day, o_orderdate, timestamp('2000-01-01 00:00:00')), g = date_trunc('month', o_orderdate), h = date_format(o_orderdate, '%Y/%m/%d %H:%i'), i = to_days(date(o_orderdate)), j = makedate(1999, 40), k = unix_timestamp(o_orderdate), l = from_unixtime(86400) | fields o_orderkey, a, b, c, d, e, f, g, h, i, j, k, l",
        "SELECT o_orderkey, (o_orderdate::DATE + 10)::DATE AS a, (o_orderdate::DATE - 3)::DATE AS b, date_diff('day', DATE '1995-01-01', o_orderdate::DATE)::INT AS c, last_day(o_orderdate) AS d, o_orderdate + INTERVAL 2 MONTH AS e, date_sub('day', o_orderdate, TIMESTAMP '2000-01-01') AS f, date_trunc('month', o_orderdate)::TIMESTAMP AS g, strftime(o_orderdate, '%Y/%m/%d %H:%M') AS h, date_diff('day', DATE '0000-01-01', o_orderdate::DATE)::INT AS i, DATE '1999-02-09' AS j, epoch(o_orderdate)::BIGINT AS k, TIMESTAMP '1970-01-02' AS l FROM orders",
    ),
    "date_periods": ("source=region | eval a = period_add(202311, 3), b = period_diff(202402, 202311), c = time('10:05:30'), d = time_to_sec('01:00:10'), e = maketime(1, 2, 3), f = sec_to_time(3661), g = yearweek('2024-06-15') | fields r_regionkey, a, b, c, d, e, f, g", "SELECT r_regionkey, 202402 AS a, 3 AS b, 36330000::BIGINT AS c, 3610::BIGINT AS d, 3723000::BIGINT AS e, '01:01:01' AS f, 202424 AS g FROM region"),
    "json_functions": ("source=events | eval k = json_extract(props, 'k'), v = json_valid(props), n = cast(json_extract(props, '$.k') as int), keys = json_keys(props), o = json_object('id', event_id), a = json_array_length('[1,2,3]'), s = json_set(props, 'k', 5), d = json_delete(props, 'k'), x = json_append('{\"a\":[1]}', 'a', 2) | fields event_id, k, v, n, keys, o, a, s, d, x", """SELECT event_id, json_extract_string(props, '$.k') AS k, json_valid(props) AS v, json_extract(props, '$.k')::INT AS n, '["k"]' AS keys, '{"id":' || event_id || '}' AS o, 3 AS a, '{"k":5}' AS s, '{}' AS d, '{"a":[1,2]}' AS x FROM events"""),
    "array_functions": (
        "source=embeddings | eval n = array_length(embedding), s = round(reduce(embedding, cast(0 as double), (a, x) -> a + x), 4), p = array_length(filter(embedding, x -> x > 0)), any = exists(embedding, x -> x > 0.3), all = forall(embedding, x -> x < 2), f = round(cast(mvindex(embedding, 0) as double), 6), l = round(cast(mvindex(embedding, -1) as double), 6), j = mvjoin(mvdedup(split('a,b,a', ',')), '+'), z = mvjoin(mvzip(array('a', 'b'), array(1, 2), '='), ';'), m = mvfind(array('x', 'yy'), 'y+') | fields vec_id, n, s, p, any, all, f, l, j, z, m",
        'SELECT vec_id, len(embedding)::INT AS n, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS s, len(list_filter(embedding, lambda x: x > 0))::INT AS p, list_max(embedding) > 0.3 AS "any", list_max(embedding) < 2 AS "all", round(embedding[1]::DOUBLE, 6) AS f, round(embedding[-1]::DOUBLE, 6) AS l, \'a+b\' AS j, \'a=1;b=2\' AS z, 1 AS m FROM embeddings',
    ),
    "ip_functions": ("source=customer | eval ip = concat('10.0.', c_nationkey, '.7'), inside = cidrmatch(ip, '10.0.8.0/21') | stats count() as n by inside", "SELECT count(*) AS n, c_nationkey BETWEEN 8 AND 15 AS inside FROM customer GROUP BY 2"),
    "rex_groups": ("source=customer | rex field=c_name '(?<word>[A-Za-z]+)#0*(?<num>[0-9]+)' | eval num = cast(num as long) | fields c_custkey, word, num", "SELECT c_custkey, 'Customer' AS word, CASE WHEN c_custkey = 0 THEN 0 ELSE c_custkey END AS num FROM customer"),
    # full text
    "match_any": ("source=documents | where match(text, 'license rights') | stats count() as n", r"SELECT count(*) AS n FROM documents WHERE regexp_matches(lower(text), '(^|[^\p{L}\p{N}])(license|rights)([^\p{L}\p{N}]|$)')"),
    "match_all": ("source=documents | where match(text, 'rights reserved', operator='AND') | fields doc_id", r"SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^\p{L}\p{N}])rights([^\p{L}\p{N}]|$)') AND regexp_matches(lower(text), '(^|[^\p{L}\p{N}])reserved([^\p{L}\p{N}]|$)')"),
    "match_phrase": ("source=documents | where match_phrase(text, 'all rights reserved') | fields doc_id", r"SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^\p{L}\p{N}])all[^\p{L}\p{N}]+rights[^\p{L}\p{N}]+reserved([^\p{L}\p{N}]|$)')"),
    "match_phrase_prefix": ("source=documents | where match_phrase_prefix(text, 'under the mi') | stats count() as n", r"SELECT count(*) AS n FROM documents WHERE regexp_matches(lower(text), '(^|[^\p{L}\p{N}])under[^\p{L}\p{N}]+the[^\p{L}\p{N}]+mi')"),
    "match_bool_prefix": ("source=documents | where match_bool_prefix(text, 'apache licen') | stats count() as n", r"SELECT count(*) AS n FROM documents WHERE regexp_matches(lower(text), '(^|[^\p{L}\p{N}])(apache([^\p{L}\p{N}]|$)|licen)')"),
    "multi_match": ("source=conversations | where multi_match(['role', 'text'], 'user') | stats count() as n", r"SELECT count(*) AS n FROM conversations WHERE role = 'user' OR regexp_matches(lower(text), '(^|[^\p{L}\p{N}])user([^\p{L}\p{N}]|$)')"),
    "query_string": ("source=documents | where query_string(['text'], 'apache OR \"all rights reserved\"') | stats count() as n", r"SELECT count(*) AS n FROM documents WHERE regexp_matches(lower(text), '(^|[^\p{L}\p{N}])(apache|all[^\p{L}\p{N}]+rights[^\p{L}\p{N}]+reserved)([^\p{L}\p{N}]|$)')"),
    "query_string_and": ("source=documents | where query_string(['text'], 'license AND NOT apache') | stats count() as n", r"SELECT count(*) AS n FROM documents WHERE regexp_matches(lower(text), '(^|[^\p{L}\p{N}])license([^\p{L}\p{N}]|$)') AND NOT regexp_matches(lower(text), '(^|[^\p{L}\p{N}])apache([^\p{L}\p{N}]|$)')"),
    "simple_query_string": ("source=documents | where simple_query_string(['text'], 'license -mit', default_operator='and') | stats count() as n", r"SELECT count(*) AS n FROM documents WHERE regexp_matches(lower(text), '(^|[^\p{L}\p{N}])license([^\p{L}\p{N}]|$)') AND NOT regexp_matches(lower(text), '(^|[^\p{L}\p{N}])mit([^\p{L}\p{N}]|$)')"),
    "match_not": ("source=documents | where not match(text, 'the') | stats count() as n", r"SELECT count(*) AS n FROM documents WHERE NOT regexp_matches(lower(text), '(^|[^\p{L}\p{N}])the([^\p{L}\p{N}]|$)')"),
    # sets
    "set_append": ("source=customer | fields c_nationkey | rename c_nationkey as k | append [ source=supplier | fields s_nationkey | rename s_nationkey as k ] | stats count() as n by k", "SELECT count(*) AS n, k FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY 2"),
    "set_union": ("source=customer | fields c_nationkey | rename c_nationkey as k | union [ source=region | fields r_regionkey | rename r_regionkey as k ]", "SELECT c_nationkey AS k FROM customer UNION SELECT r_regionkey FROM region"),
    "set_intersect": ("source=customer | where c_acctbal > 9000 | fields c_nationkey | rename c_nationkey as k | intersect [ source=supplier | where s_acctbal > 5000 | fields s_nationkey | rename s_nationkey as k ]", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000"),
    "set_except": ("source=nation | fields n_nationkey | rename n_nationkey as k | except [ source=supplier | where s_acctbal > 7000 | fields s_nationkey | rename s_nationkey as k ]", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 7000"),
    "expand_array": ("source=embeddings | fields vec_id, embedding | expand embedding as x | stats count() as n, sum(x) as s by vec_id | eval s = round(s, 4)", "SELECT count(*) AS n, round(sum(x::DOUBLE), 4) AS s, vec_id FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings) GROUP BY 3"),
    "stats_filter": (
        "source=orders | stats count() filter(where o_totalprice > 100000) as big, sum(o_totalprice) filter(where o_custkey % 2 = 0) as even, dc(o_custkey) filter(where o_orderpriority = '1-URGENT') as urgent, count(1) filter(where o_orderkey < 0) as none by o_orderstatus | eval even = round(even, 0)",
        "SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 100000) AS big, round(sum(o_totalprice) FILTER (WHERE o_custkey % 2 = 0), 0) AS even, count(DISTINCT o_custkey) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent, 0 AS none FROM orders GROUP BY 1",
    ),
    "stats_grouping_sets": ("source=orders | stats count() as n, max(o_totalprice) as top by grouping sets((o_orderstatus, o_orderpriority), (o_orderpriority), ())", "SELECT count(*) AS n, max(o_totalprice) AS top, o_orderstatus, o_orderpriority FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderpriority), ())"),
    "stats_lists": ("source=nation | stats list(n_name) as l, take(n_name, 2) as t, first(n_name) as f, last(n_name) as z, percentile_approx(n_regionkey, 50) as p by n_nationkey | eval l = mvjoin(l, ';'), t = mvjoin(t, ';')", "SELECT n_name AS l, n_name AS t, n_name AS f, n_name AS z, n_regionkey AS p, n_nationkey FROM nation"),
    "where_times": ("source=events | where earliest('2024-01-05 00:00:00', ts) and latest('now', ts) | stats count() as n, min(ts) as lo", "SELECT count(*) AS n, min(ts) AS lo FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= now()::TIMESTAMP"),
    "where_escaped_quotes": (r'source=orders o_orderpriority=\"1-URGENT\" | stats count() as n', "SELECT count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT'"),
    "window_ends": (
        "source=orders | eval z = last_value(o_orderkey) over (partition by o_custkey order by o_orderkey rows between current row and 1 following), s = nth_value(o_orderkey, 2) over (partition by o_custkey order by o_orderkey rows between unbounded preceding and unbounded following) | fields o_orderkey, z, s",
        "SELECT o_orderkey, last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS z, nth_value(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS s FROM orders",
    ),
    "math_names": (
        "source=part | eval a = add(p_size, 1), b = subtract(p_size, 7), c = multiply(p_size, 3), d = divide(p_size, 4), e = mod(p_size, 5), f = power(p_size, 2), g = crc32('abc'), h = conv(cast(p_size as string), 10, 2), i = rand(3) >= 0 | fields p_partkey, a, b, c, d, e, f, g, h, i",
        "SELECT p_partkey, p_size + 1 AS a, p_size - 7 AS b, p_size * 3 AS c, p_size // 4 AS d, p_size % 5 AS e, p_size::DOUBLE ** 2 AS f, 891568578 AS g, bin(p_size) AS h, true AS i FROM part",
    ),
    "string_names": (
        "source=customer | eval a = substr(c_name, 2, 3), b = char_length(c_name), c = locate('u', c_name), d = ltrim(concat('  ', c_mktsegment, ' ')), e = rtrim(concat('  ', c_mktsegment, ' ')), f = regexp_match(c_mktsegment, '^A'), g = contains(c_mktsegment, 'build'), h = isblank(concat(' ', '')), i = isempty(nullif(c_mktsegment, 'BUILDING')), j = isnotnull(nullif(c_mktsegment, 'BUILDING')), k = typeof(c_name), l = typeof(c_custkey) | fields c_custkey, a, b, c, d, e, f, g, h, i, j, k, l",
        "SELECT c_custkey, substr(c_name, 2, 3) AS a, length(c_name)::INT AS b, instr(c_name, 'u')::INT AS c, c_mktsegment || ' ' AS d, '  ' || c_mktsegment AS e, c_mktsegment LIKE 'A%' AS f, contains(lower(c_mktsegment), 'build') AS g, true AS h, c_mktsegment = 'BUILDING' AS i, c_mktsegment <> 'BUILDING' AS j, 'STRING' AS k, 'BIGINT' AS l FROM customer",
    ),
    "date_names": (
        "source=orders | eval a = adddate(date(o_orderdate), 3), b = subdate(date(o_orderdate), 1), c = addtime(o_orderdate, '01:30:00'), d = subtime(o_orderdate, '00:00:10'), e = timediff('10:00:00', '08:30:00'), f = convert_tz(o_orderdate, '+00:00', '+05:30'), g = from_days(to_days(date(o_orderdate))), h = to_seconds(o_orderdate), i = str_to_date('1,5,2013', '%d,%m,%Y'), j = time_format('10:05:30', '%H-%i'), k = get_format(date, 'USA') | fields o_orderkey, a, b, c, d, e, f, g, h, i, j, k",
        "SELECT o_orderkey, (o_orderdate::DATE + 3)::DATE AS a, (o_orderdate::DATE - 1)::DATE AS b, o_orderdate + INTERVAL '90 minutes' AS c, o_orderdate - INTERVAL '10 seconds' AS d, 5400000::BIGINT AS e, o_orderdate + INTERVAL '330 minutes' AS f, o_orderdate::DATE AS g, date_diff('day', DATE '0000-01-01', o_orderdate::DATE) * 86400 + (epoch(o_orderdate) % 86400)::BIGINT AS h, TIMESTAMP '2013-05-01' AS i, '10-05' AS j, '%m.%d.%Y' AS k FROM orders",
    ),
    "json_names": ("source=region | eval a = json('{\"k\":1}'), b = json_array(r_regionkey, 2), c = json_extend('{\"a\":[1]}', 'a', array(2, 3)), d = mvjoin(mvappend(r_name, 'x'), '+') | fields r_regionkey, a, b, c, d", """SELECT r_regionkey, '{"k":1}' AS a, '[' || r_regionkey || ',2]' AS b, '{"a":[1,2,3]}' AS c, r_name || '+x' AS d FROM region"""),
    "top_per_group": (
        "source=orders | eval r = row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) | where r <= 3 | fields o_custkey, o_orderkey, r",
        "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders QUALIFY r <= 3",
    ),
    # shapes of web analytics
    "hits_per_host": ("source=pages | eval host = regexp_extract(url, '^https?://([^/]+)', 1) | stats count() as n, avg(length(html)) as bytes by host | where n > 1 | sort - n, host | head 20 | eval bytes = round(bytes, 2)", "SELECT count(*) AS n, round(avg(length(html)), 2) AS bytes, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages GROUP BY 3 HAVING count(*) > 1 ORDER BY 1 DESC, 3 LIMIT 20"),
    "flagship": ("source=lineitem | where l_shipdate >= '1997-01-01 00:00:00' and l_quantity < 24 | stats count() as n, avg(l_extendedprice) as ap, sum(l_quantity) as sq by l_returnflag | sort - n | head 10 | eval ap = round(ap, 2)", "SELECT count(*) AS n, round(avg(l_extendedprice), 2) AS ap, sum(l_quantity) AS sq, l_returnflag FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_quantity < 24 GROUP BY 4 ORDER BY 1 DESC LIMIT 10"),
}


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    return Catalog.of_directory(spark, sf_dir, TABLES, KINDS)


def _piped(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run(catalog(spark, sf_dir), text)


def grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = catalog(spark, sf_dir).load("orders")
    return ops.grouping_sets(orders, [("o_orderstatus", "o_orderpriority"), ("o_orderpriority",), ()], [F.count("*").alias("n")])


def struct_renest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.sources.catalog import flatten, renest

    nation = catalog(spark, sf_dir).load("nation").select(F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")).alias("nation"), "n_regionkey")
    return renest(flatten(nation)).select(F.col("nation.key").alias("k"), F.col("nation.name").alias("name"), "n_regionkey")


def join_semi_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    part = c.load("part").where("p_size = 7")
    return joins.join(c.load("lineitem"), part, F.col("l_partkey") == F.col("p_partkey"), "left_semi").groupBy("l_returnflag").agg(F.count("*").alias("n"))


FRAMES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "grouping_sets": (grouping_sets, "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderpriority), ())"),
    "struct_renest": (struct_renest, "SELECT n_nationkey AS k, n_name AS name, n_regionkey FROM nation"),
    "join_semi_filtered": (join_semi_filtered, "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 7) GROUP BY 1"),
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: _piped(q) for n, (q, _) in PIPES.items()} | {n: f for n, (f, _) in FRAMES.items()}
ORACLE_SQL: dict[str, str] = {n: s for n, (_, s) in PIPES.items()} | {n: s for n, (_, s) in FRAMES.items()}
