"""Repetition coverage against a plain count over strings."""

import collections
import re

from hypothesis import given, settings
from hypothesis import strategies as st
import numpy as np

from cohortwise.llm import queries, repetition

RULES = repetition.RepetitionRules()
SPACE = re.compile("[^\x20\x09-\x0d]+")


def plain(text):
    text = text or ""
    words = SPACE.findall(text)
    starts = lambda n: [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
    out = {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text)}
    seen, count, chars = set(), 0, 0
    for line in text.split("\n"):
        if SPACE.search(line):
            if line in seen:
                count, chars = count + 1, chars + sum(map(len, SPACE.findall(line)))
            seen.add(line)
    out |= {"n_dup_lines": count, "line_chars": chars}
    grams = starts(RULES.base_window)
    times = collections.Counter(grams)
    out["n_repeat_words"] = len({i + j for i, g in enumerate(grams) if times[g] > 1 for j in range(RULES.base_window)})
    for n, _ in RULES.coverage:
        known, inside = set(), set()
        for i, g in enumerate(starts(n)):
            if g in known:
                inside |= set(range(i, i + n))
            known.add(g)
        out[f"covered_{n}"] = sum(len(words[i]) for i in inside)
    failed = out["n_words"] < 20 or 100 * out["n_repeat_words"] > 30 * out["n_words"]
    rest = 100 * out["line_chars"] <= RULES.line_percent * out["word_chars"] and 100 * out["n_symbols"] <= RULES.symbol_percent * out["n_words"]
    return out | {"base_failed": failed, "kept": not failed and rest and all(100 * out[f"covered_{n}"] <= p * out["word_chars"] for n, p in RULES.coverage)}


ODD = ["", None, " \n\t", "é", "a b\n\na b\n a b\n\x0ba b", "x " * 40, "\n" * 5, "１２ ½\x0c#&é\x1c\x85  y", ("one two three four five six seven eight nine ten " * 3 + "\n") * 4, "w" * 100_000, " ".join(map(str, range(30_000)))]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "ab", "é#", " ", "  ", "\n", "\r\n", "long" * 12, "\x1c"]), max_size=80).map("".join), max_size=6))
def test_measures_equal_a_plain_count(texts):
    data = [t.encode() for t in texts]
    edges = np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)
    found = repetition.measure(np.frombuffer(b"".join(data), np.uint8), edges, RULES)
    for i, text in enumerate(texts):
        expected = plain(text)
        assert {k: int(v[i]) for k, v in found.items()} == {k: expected[k] for k in found}


def test_odd_rows(spark, odd):
    rows = odd.select("doc_id", "text").collect() + [(100 + i, t) for i, t in enumerate(ODD)]
    table = spark.createDataFrame([(r[0], r[1], 1, 2) for r in rows], "doc_id long, text string, n_words int, kept int")
    got = sorted(repr(sorted(r.asDict().items(), key=str)) for r in repetition.judge(table).collect())
    assert got == sorted(repr(sorted(({"doc_id": r[0]} | plain(r[1])).items(), key=str)) for r in rows)
    assert repetition.judge(odd.limit(0)).count() == 0
    kept = repetition.drop_repetitive(table)
    assert kept.columns == table.columns
    assert sorted(map(repr, kept.select("doc_id", "text").collect())) == sorted(f"Row(doc_id={r[0]!r}, text={r[1]!r})" for r in rows if plain(r[1])["kept"])


def test_long_texts_are_cut_into_stretches_at_documents_only(spark, folder, monkeypatch):
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    monkeypatch.setattr(repetition, "_BATCH_BYTES", 5000)
    got = {r.doc_id: r.asDict() for r in repetition.judge(documents).collect()}
    assert got == {r.doc_id: {"doc_id": r.doc_id} | plain(r.text) for r in documents.collect()}


def test_labels(spark):
    folder = "/root/testdata/sf0.01"
    judged = queries.op13_repetition(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("n_words >= 40").collect()
    good, bad = ([r.kept for r in judged if r.quality == q] for q in (1, 0))
    assert sum(good) == len(good) and sum(bad) <= 0.02 * len(bad)
