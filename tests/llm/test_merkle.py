"""Merkle manifest against a plain tree in Python."""

import collections
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from cohortwise.llm import merkle, queries

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels_of(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def path_of(levels, at):
    steps = []
    for level in levels[:-1]:
        first = at // 16 * 16
        run = level[first : first + 16]
        steps.append((at - first, run[: at - first] + run[at - first + 1 :]))
        at //= 16
    return steps


def plain(rows):
    """Expected rows of the query from ``(doc_id, source, lang, n_chars, text)``."""
    trees = collections.defaultdict(list)
    for r in rows:
        trees[r[1]].append((r[0] is not None, r[0] or 0, leaf_of(r), r))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {s: levels_of([x[2] for x in sorted(trees[s], key=lambda x: x[:3])]) for s in trees}
    top = levels_of([built[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for at, (_, _, leaf, r) in enumerate(sorted(trees[s], key=lambda x: x[:3])):
            steps = path_of(built[s], at) + path_of(top, k)
            cur = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                cur = leaf_of((*r[:4], r[4].encode().lower().decode()))
            for position, siblings in steps:
                cur = h(*siblings[:position], cur, *siblings[position:])
            out.append((r[0], leaf, built[s][-1][0], top[-1][0], h(*(x for _, b in steps for x in b)), cur, cur == top[-1][0]))
    return out


def query(documents, monkeypatch):
    monkeypatch.setattr(queries, "_table", lambda *_: documents)
    columns = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return collections.Counter(tuple(r[c] for c in columns) for r in queries.op11_merkle(documents.sparkSession, "").collect())


def test_odd_rows(spark, odd, monkeypatch):
    rows = [tuple(r) for r in odd.select(*FIELDS).collect()]
    assert query(odd, monkeypatch) == collections.Counter(plain(rows))
    assert not query(odd.limit(0), monkeypatch)
    assert query(odd.where("doc_id = 7"), monkeypatch) == collections.Counter(plain([r for r in rows if r[0] == 7]))


@pytest.mark.parametrize("partitions", ["3", "13"])
def test_many_levels_sources_and_repeated_rows(spark, monkeypatch, partitions):
    """One source with five tiers' worth of blocks would be large; one digit a tier makes as many tiers of a small one."""
    rows = [(i % 4700, "hot", "en", i % 7, f"Text {i % 4700}") for i in range(5000)] + [(None, "nulls", None, None, None)] * 40
    rows += [(10_000 + i, None if i % 3 == 0 else f"s{i % 37}é" if i % 2 else "", "x", 1, "A") for i in range(300)]
    documents = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars int, text string").withColumns({c: F.lit(1) for c in ("tree", "rank", "load", "digest", "levels", "path", "tie")})
    monkeypatch.setattr(merkle.manifest, "__defaults__", (*merkle.manifest.__defaults__[:-1], 1))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert query(documents, monkeypatch) == collections.Counter(plain(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_proofs_hold_and_need_no_join(spark, folder):
    proven = merkle.manifest(spark.read.parquet(f"{folder}/documents.parquet"), key="doc_id", digits=2)
    assert "Join" not in proven._jdf.queryExecution().optimizedPlan().toString()
    assert proven.where(merkle.fold(F.col("leaf"), F.col("proof")) != F.col("root")).count() == 0
    assert proven.where(merkle.fold(F.sha2(F.col("leaf"), 256), F.col("proof")) == F.col("root")).count() == 0
