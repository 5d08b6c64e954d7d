from __future__ import annotations

import pytest

from sluice.plans.lower import run
from sluice.sources.catalog import Catalog

BODIES = ["Late hops, low-alpha hops and more", "Bottles", "two row malt", "A beer with hops!", "Clean the kettle"]
TAGS = ["brewing", "taste", "brewing", "recipes", "equipment"]


@pytest.fixture(scope="module")
def cat(spark):  # noqa: ANN001, ANN201
    c = Catalog(spark)
    c.register("beer", spark.createDataFrame([(i + 1, b, t) for i, (b, t) in enumerate(zip(BODIES, TAGS, strict=True))] + [(6, None, None)], "id int, body string, tag string"), body="text")
    return c


@pytest.mark.parametrize(
    ("condition", "ids"),
    [
        ("match(tag, 'brewing')", [1, 3]),
        ("match(tag, 'brew')", []),
        ("match_bool_prefix(tag, 'brew')", [1, 3]),
        ("match(body, 'hops')", [1, 4]),
        ("match(body, 'HOPS kettle')", [1, 4, 5]),
        ("match(body, 'beer hops', operator='AND')", [4]),
        ("match(body, 'hops beer more', minimum_should_match=2)", [1, 4]),
        ("match(body, 'hopz', fuzziness=1)", [1, 4]),
        ("match(body, 'kettel', fuzziness='AUTO')", [5]),
        ("match_phrase(body, 'two-row malt')", [3]),
        ("match_phrase(body, 'low alpha')", [1]),
        ("match_phrase(body, 'alpha low')", []),
        ("match_phrase(body, 'late low', slop=1)", [1]),
        ("match_phrase_prefix(body, 'with ho')", [4]),
        ("match_bool_prefix(body, 'clean ho')", [1, 4, 5]),
        ("multi_match(['tag', 'body'], 'equipment')", [5]),
        ("multi_match(['*'], 'hops')", [1, 4]),
        ("query_string(['tag'], 'brewing OR taste')", [1, 2, 3]),
        ("query_string(['body'], 'hops AND NOT beer')", [1]),
        ("query_string(['body'], 'hops beer', default_operator='AND')", [4]),
        ("query_string(['body'], '+hops -beer')", [1]),
        ("query_string(['body'], '\"alpha hops\" OR (clean AND kettle)')", [1, 5]),
        ("query_string(['*'], 'tag:taste')", [2]),
        ("query_string(['body'], 'ket*')", [5]),
        ("query_string('hops')", [1, 4]),
        ("simple_query_string(['body'], 'hops | kettle')", [1, 4, 5]),
        ("simple_query_string(['body'], 'hops + beer')", [4]),
        ("simple_query_string(['body'], '\"alpha hops\"')", [1]),
        ("not match(tag, 'brewing')", [2, 4, 5, 6]),
        ("match(tag, 'recipes') or tag = 'equipment'", [4, 5]),
        ("match(body, 'hops') and id > 1", [4]),
        ("match(field=body, query='malt')", [3]),
        ("match(body, '')", []),
    ],
)
def test_matches(cat, condition, ids):  # noqa: ANN001
    assert sorted(r[0] for r in run(cat, f"source=beer | where {condition} | fields id").collect()) == ids


@pytest.mark.parametrize("condition", ["match(body, 'x', nonsense=1)", "match(body)", "match(nope, 'x')", "match(body, 'a', 'b')"])
def test_rejects(cat, condition):  # noqa: ANN001
    with pytest.raises((ValueError, LookupError)):
        run(cat, f"source=beer | where {condition}")
