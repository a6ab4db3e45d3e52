"""Embeddings, URL rules, quality, components, pipeline and the SQL comparison."""

import collections
import zlib

import numpy as np
import pytest
from check import compare, duck

import __spark_entry__ as entry
import corpus_pipeline
from cohortwise.llm import components, embedding_dedup, quality, queries, url_filter
from cohortwise.llm.oracles import ORACLES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_sql(spark, folder, name):
    assert compare(entry.queries()[name](spark, folder), duck(folder), ORACLES[name]) is None


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, 2000)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges + [(None, 3)], "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {x: r for x, r in root.items() if any(x in e and e[0] != e[1] for e in edges)}


@pytest.mark.parametrize("cell_rows", [4096, 40])
def test_near_vectors(spark, cell_rows):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 8))
    rows = [(int(i), [float(x) for x in (centres[i % 6] + rng.normal(size=8) * rng.choice([0.01, 0.1, 0.5])).astype("f4")], int(i % 2)) for i in range(300)]
    rows += [(300 + k, rows[0][1], 0) for k in range(5)] + [(310, [2 * x for x in rows[0][1]], 0)]
    rows += [(400, None, 0), (401, [0.0] * 8, 0), (402, [float("nan")] * 8, 0), (403, [1.0, None], 0), (404, rows[0][1], None), (405, [1.0, 2.0], 0), (406, [float("inf")] * 8, 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(table, 0.98, cell_rows).collect()}
    usable = {i: np.array(v, float) for i, v, label in rows if label is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    labels = {i: label for i, _, label in rows}
    links = collections.defaultdict(set)
    for i, x in usable.items():
        for j, y in usable.items():
            if i != j and labels[i] == labels[j] and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.98:
                links[i].add(j)
    for i, _, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        assert got[i] == (len(links[i]), min(seen), i == min(seen)), i
    assert embedding_dedup.near_vectors(table.limit(0)).count() == 0


def test_url_rules_and_aliases(spark):
    link = '<link href="{}" rel="canonical">'
    pages = [
        (1, "http://a.org/x#top", link.format("https://b.net/es/1")),
        (2, "HTTP://A.org/x", None),
        (3, "https://b.net/es/1", "<p>"),
        (4, "http://c.org/", '<meta http-equiv="refresh" content="0; url=http://a.org/x">'),
        (5, "http://d.org/", link.format("http://www.example.com/en/")),
        (6, "https://x.example.com/en/1", link.format("http://d.org/")),
        (7, None, link.format("http://d.org/")),
        (8, "no scheme", ""),
        (9, "http://example.com", ""),
        (10, "http://lonely.org/p?q#f", None),
    ]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), queries.PAGE_RULES).collect()}
    assert [got[i][3] for i in range(1, 11)] == ["block", "block", "block", "block", "allow", "block", "allow", "allow", "allow", "allow"]
    assert got[6][2] == "example.com/en/" and got[9] == ("example.com", "", None, "allow") and got[7][:2] == got[8][:2] == ("", "")
    assert got[2][:2] == ("a.org", "/x") and got[10][1] == "/p"


def test_link_targets(spark):
    cases = [
        ("http://a.net/p", '<link rel=canonical href="/es/p">', "http://a.net/es/p"),
        ("HTTP://A.net/x/y?q=1#f", '<link rel="canonical" href="z.html">', "http://a.net/x/z.html"),
        ("http://a.net", '<link rel="canonical" href="z.html">', "http://a.net/z.html"),
        ("https://a.net/x", '<link rel="canonical" href="//B.net/x">', "https://b.net/x"),
        ("http://a.net/x/y?q=1", '<link rel="canonical" href="?r=2&amp;s=3">', "http://a.net/x/y?r=2&s=3"),
        ("http://a.net/x/y/z", '<link rel="canonical" href="../w/./v/..">', "http://a.net/x/w/"),
        ("http://a.net/x", '<link rel="canonical" href="../../w?u=/../k">', "http://a.net/w?u=/../k"),
        ("http://a.net/x", '<link rel="canonical" href="/to?next=http://c.org/">', "http://a.net/to?next=http://c.org/"),
        ("http://a.net/x", '<link rel="shortlink canonical" href="http://b.net/s">', "http://b.net/s"),
        ("http://a.net/x", "<link rel='canonical nofollow' href='/s'>", "http://a.net/s"),
        ("http://a.net/x", '<meta http-equiv="refresh" content="0; url=/r?a=1&amp;b=2">', "http://a.net/r?a=1&b=2"),
        ("http://a.net/x", '<base target="_top" href="http://b.net/d/e"><link rel="canonical" href="f">', "http://b.net/d/f"),
        ("http://a.net/x?q#f", '<link rel="canonical" href="#top">', "http://a.net/x?q"),
        ("http://a.net/x", '<link rel="canonical" href="mailto:a@b.net">', None),
        ("http://a.net/x", '<link rel="noncanonical" href="/s">', None),
        ("http://a.net/x", '<link rel="canonical">', None),
    ]
    pages = spark.createDataFrame([(f"{page}#{k}" if "#" not in page else page, f"<html>{tag}</html>") for k, (page, tag, _) in enumerate(cases)], "url string, html string")
    got = collections.Counter((e.source, e.target) for e in url_filter.link_edges(pages).collect())
    assert got == collections.Counter((page.split("#")[0].replace("HTTP://A", "http://a"), target) for page, _, target in cases if target is not None)


def test_relative_links_are_aliases(spark):
    pages = [
        (1, "http://a.net/p", '<link rel=canonical href="/es/p">'),
        (2, "http://b.net/q", '<meta http-equiv="refresh" content="0;url=//a.net/p">'),
        (3, "http://b.net/d/r", '<link rel="shortlink canonical" href="../q">'),
        (4, "http://b.net/other", '<link rel="canonical" href="other">'),
    ]
    got = {r.page_id: r.verdict for r in url_filter.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), queries.PAGE_RULES).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow"}


def test_url_filter_empty(spark):
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string, html string"), []).count() == 0


def test_quality_held_out(spark):
    """No label is used in training; rejected documents are the bad ones and nearly all of them."""
    folder = "/root/testdata/sf0.01"
    judged = queries.op3_quality(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").toPandas()
    good, bad = judged[judged.quality == 1], judged[judged.quality == 0]
    assert good.kept.mean() > 0.98 and bad.kept.mean() < 0.2


def test_quality_odd(odd):
    model = quality.fit(odd)
    scored = quality.score(odd, model).collect()
    assert len(scored) == odd.count() and not any(r.kept for r in scored if r.doc_id in (4, 5, 6))
    assert quality.keep_good(odd, model).columns == odd.columns
    assert quality.keep_good(odd, quality.fit(odd.limit(0))).count() > 0


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(7)
    truth = rng.random(20_000) < 0.8
    rates = [0.95, 0.85, 0.9, 0.8]
    votes = np.stack([np.where(rng.random(20_000) < 0.3, quality.NONE, np.where(rng.random(20_000) < p, truth, ~truth)) for p in rates], 1).astype(int)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality.LabelModel.fit(patterns, counts.astype(float))
    assert np.abs(model.accuracies() - rates).max() < 0.05


def test_pipeline_gives_token_ids(spark, odd, folder):
    """The packed sequences can be rebuilt from the pipeline's result alone."""
    pieces = corpus_pipeline.STAGES[-1][1](spark, odd, folder).collect()
    assert pieces and all(len(p.ids) == p.length and zlib.crc32(np.array(p.ids, "<u4").tobytes()) == p.ids_crc32 for p in pieces)


def test_pipeline(spark, folder, odd):
    columns = odd.columns
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns, name
        rows = docs.collect()
        docs = spark.createDataFrame(rows, odd.schema)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder).toPandas()
    assert len(set(pieces.doc_id.dropna())) == len({r.doc_id for r in rows if r.doc_id is not None})
    assert entry.queries()["pipeline"](spark, folder).count() > 0
