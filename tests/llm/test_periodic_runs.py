"""Periodic runs against a search over all periods."""

import collections
import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from cohortwise.llm import periodic_runs, queries

WORD = re.compile("[^\x20\x09-\x0d]+")


def all_runs(words, least=24, periods=3):
    """``(start, length, period)``: every longest stretch of every period; of one stretch the least period."""
    found = {}
    for q in range(1, len(words) // periods + 1):
        at = 0
        while at < len(words) - q:
            stop = at
            while stop < len(words) - q and words[stop] == words[stop + q]:
                stop += 1
            if stop > at and stop + q - at >= max(least, periods * q):
                found.setdefault((at, stop + q - at), q)
            at = stop + 1
    return sorted((start, length, q) for (start, length), q in found.items())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected_row(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = sorted(all_runs(words), key=lambda r: (r[0], r[2]))
    dropped = {i for start, length, q in runs for i in range(start + q, start + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(runs), *shown, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(kept))


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def rows_of(documents, monkeypatch):
    monkeypatch.setattr(queries, "_table", lambda *_: documents)
    return collections.Counter(tuple(r[c] for c in COLUMNS) for r in queries.op12_periodic_runs(documents.sparkSession, "").collect())


def test_transforms_are_exact():
    rng = np.random.default_rng(1)
    values = rng.integers(0, periodic_runs._P, (64, 3)).astype(np.uint64)
    assert (periodic_runs._backward(periodic_runs._forward(values.copy())) == values).all()
    numbers = rng.integers(0, 5, 400).astype(np.uint64)
    text = np.concatenate([numbers, np.zeros(100, np.uint64)])
    squares = np.concatenate([np.zeros(1, np.uint64), np.cumsum(text * text)])
    found = periodic_runs.mismatches(text, squares, np.array([0, 32, 336]), 16, 16, 31)
    for k, p in enumerate((0, 32, 336)):
        assert found[:, k].tolist() == [int(((text[p : p + 16].astype(int) - text[p + d : p + d + 16].astype(int)) ** 2).sum()) for d in range(16, 32)]


@pytest.mark.parametrize("least, periods", [(24, 3), (30, 4)])
def test_runs_equal_a_search_over_all_periods(least, periods):
    rng = np.random.default_rng(2)
    checked = 0
    for _ in range(250):
        documents = []
        for _ in range(rng.integers(1, 6)):
            words = []
            for _ in range(rng.integers(0, 6)):
                if rng.integers(0, 4) == 0:
                    words += rng.integers(0, rng.integers(1, 30), rng.integers(0, 80)).tolist()
                else:
                    p = int(rng.integers(1, rng.choice([4, 20, 70, 130])))
                    base = rng.integers(0, rng.integers(1, 40), p).tolist()
                    words += [base[i % p] for i in range(rng.integers(1, 6 * p + 40))]
                if rng.random() < 0.2:
                    words += words[-int(rng.integers(1, 60)) :] * int(rng.integers(1, 5))
            documents.append(words)
        edges = np.concatenate([[0], np.cumsum([len(d) for d in documents])]).astype(np.int64)
        start, end, period = periodic_runs.find_runs(np.array(sum(documents, []), np.uint64), edges, periodic_runs.PeriodicRuns(least, periods))
        expected = sorted((s + int(edges[k]), n, q) for k, d in enumerate(documents) for s, n, q in all_runs(d, least, periods))
        assert sorted(zip(start.tolist(), (end - start).tolist(), period.tolist())) == expected
        checked += len(expected)
    assert checked > 200


def test_multiples_of_the_prime_are_no_match(monkeypatch):
    """With a tiny set of residues nearly every sum vanishes somewhere; the words decide."""
    monkeypatch.setattr(periodic_runs, "mismatches", lambda text, squares, blocks, block, first, last: np.zeros((last - first + 1, len(blocks)), np.uint64))
    words = [i % 9 if 50 <= i < 110 else i % 31 * (i % 7 + 1) for i in range(300)]
    start, end, period = periodic_runs.find_runs(np.array(words, np.uint64), np.array([0, 300]))
    assert list(zip(start, end - start, period)) == all_runs(words)


def test_odd_rows(spark, odd, monkeypatch):
    texts = ["a b " * 30, "é\x1c\x85 é\x1c\x85 " * 20 + "ß", "x\n" * 23, "x\n" * 24, "l m n " * 8 + "l m n o " * 9, "word " * 60_000, " ".join(f"{i % 700}" for i in range(3000))]
    rows = [(r.doc_id, r.text) for r in odd.collect()] + [(100 + 7 * i, t) for i, t in enumerate(texts * 2)]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, runs int, start int")
    expected = collections.Counter(expected_row(*r) for r in rows if len(r[1] or "") < 100_000)
    got = rows_of(table.where("coalesce(length(text), 0) < 100000"), monkeypatch)
    assert got == expected
    whole = rows_of(table.where("length(text) >= 100000"), monkeypatch)
    assert {r[1:6] for r in whole if zlib.crc32(str(r[0]).encode()) % 10} == {(1, 0, 60_000, 1, 60_000_000)}
    assert not rows_of(odd.limit(0), monkeypatch)


def test_benchmark_documents(spark, folder, monkeypatch):
    documents = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in documents.collect() if len((r.text or "").split()) < 700]
    got = rows_of(documents, monkeypatch)
    expected = collections.Counter(expected_row(*r) for r in rows)
    assert not expected - got and sum(got.values()) == documents.count() and sum(expected.values()) > 100
    monkeypatch.setattr("cohortwise.llm.repetition._BATCH_BYTES", 3000)
    assert rows_of(documents, monkeypatch) == got
