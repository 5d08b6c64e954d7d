from __future__ import annotations

from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sluice.llm import url_filter
from sluice.llm.queries import URL_RULES
from sluice.plans.explain import plan_text


def brute(url, rules, default="allow"):  # noqa: ANN001, ANN201
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        tail = rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if not fit:
        return host, path, None, default
    best = max(fit, key=lambda r: (len(r.text), len(r.host), r.verdict == "block"))
    return host, path, best.text, best.verdict


HOSTS = ["com", "example.com", "www.example.com", "WWW.Example.COM", "notexample.com", "a.b.c.net", "net", "example.com:80", "", ".com", "com.", "x..com", "Ünï.com"]
PATHS = ["", "/", "/en/", "/en", "/en/x", "/EN/", "/es/1", "/fr/a/b?x=/en/", "?q=://", "#f", "/a#b?c", "//en/"]
urls = st.builds(lambda s, h, p: s + h + p, st.sampled_from(["http://", "://", "", "ftp:/", "http://a://"]), st.sampled_from(HOSTS), st.sampled_from(PATHS))
ODD = [url_filter.Rule("net", "/f", "block"), url_filter.Rule("c.net", "", "allow"), url_filter.Rule("com", "/", "block"), url_filter.Rule("com", "/", "allow")]


@pytest.mark.parametrize("rules", [list(URL_RULES), ODD, [*URL_RULES, *ODD], []])
def test_equals_brute_force(spark, rules):  # noqa: ANN001
    some = [s + h + p for s in ("http://", "://", "", "http://a://") for h in HOSTS for p in PATHS] + [None, None, "x" * 9000, "http://" + "a." * 3000 + "com/en/" + "y" * 9000]
    rows = [(i if i % 7 else None, u, "clash") for i, u in enumerate(some)] + [(1, some[1], "repeated")]
    df = spark.createDataFrame(rows, "page_id long, url string, rule string").selectExpr("*", "url as host", "1 as row", "2 as rank", "'x' as digest")
    got = Counter(map(tuple, url_filter.filter_urls(df, rules).collect()))
    unique = {(r.host, r.path): r for r in sorted(rules, key=lambda r: r.verdict == "block")}
    assert got == Counter((i, *brute(u, list(unique.values()))) for i, u, _ in rows)
    assert url_filter.filter_urls(df.limit(0), rules).count() == 0


@settings(max_examples=100, deadline=None)
@given(urls)
def test_longest_rule_wins_in_the_ranking(url):  # noqa: ANN001
    order = url_filter.ranked(URL_RULES)
    assert [i for i, _ in order] == list(range(1, 6)) and [len(r.text) for _, r in order] == sorted(len(r.text) for _, r in order)
    brute(url, URL_RULES)


def test_plan_is_native(spark, sf):  # noqa: ANN001
    text = plan_text(url_filter.filter_urls(spark.read.parquet(f"{sf}/pages.parquet"), URL_RULES))
    assert "Python" not in text and "Arrow" not in text and "Cartesian" not in text and "html" not in text
