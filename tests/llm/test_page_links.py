"""Links as a browser would see them."""

import pytest

from cohortwise.llm import url_filter

PAGES = [
    ('<!-- <link rel="canonical" href="http://b.net/es/1"> -->', None),
    ('<script>var s = \'<link rel="canonical" href="http://b.net/es/1">\';</script>', None),
    ('<style>/* <link rel=canonical href=http://b.net/es/1> */</style>', None),
    ('<!-- open <link rel="canonical" href="http://b.net/es/1">', None),
    ('<link title="x rel=canonical y" href="http://b.net/es/1">', None),
    ('<link rel="canonical" href="http:&#x2F;&#47;b.net/es/1?a=1&amp;b=2">', "http://b.net/es/1?a=1&b=2"),
    ('<link rel="canonical" href="http://b.net/&#233;&#x1F600;&#xD800;&amp;#47;">', "http://b.net/é😀�&"),  # decoded once: what follows the # is a fragment
    ('<link title="a > b" REL=\'alternate Canonical\' href=http://b.net/es/1>', "http://b.net/es/1"),
    ('<!-- a --><meta content="0; URL=/es/2" HTTP-EQUIV="Refresh"><!-- b -->', "http://a.org/es/2"),
    ('<base title="a>b" href="http://c.net/x/"><link rel=canonical href="es/3">', "http://c.net/x/es/3"),
    ("<link rel=canonical" + " x" * 50_000 + ' href="http://b.net/es/1">', "http://b.net/es/1"),
    (None, None),
]


def test_link_edges(spark):
    table = spark.createDataFrame([(f"http://a.org/{n}", html) for n, (html, _) in enumerate(PAGES)], "url string, html string")
    got = {r.source: r.target for r in url_filter.link_edges(table).collect()}
    assert got == {f"http://a.org/{n}": target for n, (_, target) in enumerate(PAGES) if target}


@pytest.mark.parametrize("html, verdict", [(PAGES[0][0], "allow"), (PAGES[5][0], "block")])
def test_judged_by_visible_links(spark, html, verdict):
    rules = [url_filter.Rule("block", "net", "/es/")]
    table = spark.createDataFrame([(1, "http://a.org/1", html, "n"), (2, None, html, "n"), (2, None, html, "n"), (3, "no url", None, "n")], "page_id long, url string, html string, node string")
    rows = url_filter.judge(table, rules).collect()
    assert sorted((r.page_id, r.verdict) for r in rows) == [(1, verdict), (2, "allow"), (2, "allow"), (3, "allow")]
