"""The verdicts of op7's explicit rules, word by word as its contract lists them."""

import pytest

from lumenfold.llm import url_filter

CONTRACT = [
    ("http://example.com/en/1", "com/en/", "block"), ("http://example.com/en/7", "example.com/en/7", "allow"),
    ("http://example.net/de/1", "net/de/", "allow"), ("http://a.net/de/8", "net/de/", "allow"),
    ("http://example.net/de/8", "example.net/de/8", "block"), ("http://A.example.NET/de/81?x", "example.net/de/8", "block"),
    ("http://example.org/es/1", "org/es/", "block"),
]


def test_each_rule_says_what_the_contract_says(spark):
    rows = spark.createDataFrame([(k, url) for k, (url, _, _) in enumerate(CONTRACT)], "page_id long, url string")
    told = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(rows).collect()}
    assert [told[k] for k in range(len(CONTRACT))] == [(rule, verdict) for _, rule, verdict in CONTRACT]


@pytest.mark.parametrize("own", [
    {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"},
])
def test_rules_are_the_contracts(own):
    assert {host + path: verdict for verdict, host, path in url_filter.RULES} == own
