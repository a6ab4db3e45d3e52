"""Trigram queries derived from patterns, and the scan that rests on them."""

import random
import re

import pytest
from pyspark.sql import functions as F

from cohortwise.llm import secrets
from cohortwise.llm.common import ascii_lowered
from cohortwise.llm.trigrams import Query, trigram_query


def admits(query, text):
    return all(t in text for t in query.trigrams) and all(any(admits(q, text) for q in group) for group in query.choices)


def grown(rng, depth=0):
    """A random pattern and a function that gives a random match of it."""
    kind = rng.choice(["word", "word", "class"] if depth > 3 else ["word", "word", "class", "row", "row", "either", "repeat", "ignore", "ahead"])
    if kind == "word":
        word = "".join(rng.choice("abcXYZ_-é") for _ in range(rng.randint(1, 5)))
        return re.escape(word), lambda: word
    if kind == "class":
        chars, pattern = rng.choice([("ab", "[ab]"), ("abcdefghijklmnopqrstuvwxyz", "[a-z]"), ("QZ9", "[9QZ]"), ("x7 ", "[^A-Z]"), ("07", r"\d"), ("q\té", ".")])
        return pattern, lambda: rng.choice(chars)
    if kind == "row":
        parts = [grown(rng, depth + 1) for _ in range(rng.randint(2, 4))]
        return "".join(p for p, _ in parts), lambda: "".join(m() for _, m in parts)
    if kind == "either":
        parts = [grown(rng, depth + 1) for _ in range(rng.randint(2, 3))]
        return "(" + "|".join(p for p, _ in parts) + ")", lambda: rng.choice(parts)[1]()
    pattern, match = grown(rng, depth + 1)
    if kind == "ignore":
        return f"(?i:{pattern})", lambda: "".join(rng.choice([c, c.swapcase()]) if c.isascii() else c for c in match())
    if kind == "ahead":
        return f"(?=.|)(?:{pattern})", match
    least, most, written = rng.choice([(0, 1, "?"), (0, 3, "*"), (1, 3, "+"), (2, 2, "{2}"), (5, 6, "{5,}"), (1, 2, "{1,2}?")])
    return f"(?:{pattern}){written}", lambda: "".join(match() for _ in range(rng.randint(least, most)))


def test_derived_queries_lose_no_match():
    rng, asking = random.Random(5), 0
    for _ in range(1500):
        pattern, match = grown(rng)
        query = trigram_query(pattern)
        asking += bool(query)
        for _ in range(4):
            text = match()
            if re.search(pattern, text):  # a negated class may meet a letter in the other case
                assert admits(query, ascii_lowered("<" + text + ">")), (pattern, text)
    assert asking > 500


def test_derived_queries():
    assert trigram_query("AKIA[A-Z0-9]+") == Query(frozenset(["aki", "kia"]))
    assert trigram_query("(?i:token|TOK)en") == Query(frozenset(["tok", "oke", "ken"]))  # the longer alternative adds nothing
    assert trigram_query(r"gh[op]_\w+").all_trigrams() == {"gho", "ho_", "ghp", "hp_"}
    assert {frozenset(q.trigrams) for q in next(iter(secrets.BASE_RULES[0].query.choices))} == {
        frozenset(w[i : i + 3] for i in range(len(w) - 2)) for w in ("password", "passwd", "secret", "token", "apikey", "api_key")
    }
    for open_pattern in ("[0-9a-f]{24,}", "abc|x", "(abc)?", "a[b[c]]def", "[abc&&[b]]def", r"\vabc", r"\p{Lu}abc", "(?x) abc", "(?iu:kelvin)", "(abc"):
        assert not trigram_query(open_pattern)


RULES = (
    secrets.SecretRule("key", r"(?i:key|clef)-\d{3,}", 0, 7),
    secrets.SecretRule("pem", r"-----BEGIN (?:RSA |EC )?PRIVATE KEY-----", 0, 1),
    secrets.SecretRule("short", r"x=\d+", 0, 1),
)


@pytest.mark.parametrize("bitmap", [secrets.BITMAP, 64])
def test_scan_with_other_rules(spark, monkeypatch, bitmap):
    """Equal to a scan of every text, also where nearly all places of the bitmap are shared."""
    monkeypatch.setattr(secrets, "BITMAP", bitmap)
    rng = random.Random(1)
    pieces = ["KEY-1234 ", "clef-12 ", "key-", "Clef-777 ", "-----BEGIN PRIVATE KEY-----", "-----BEGIN EC PRIVATE KEY----", "x=5 ", "é😀 ", "word "]
    texts = [None, ""] + ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 6))) for _ in range(300)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in secrets.scan(table, RULES).collect():
        for rule in RULES:
            found = [(m.start(), m.end()) for m in re.finditer(rule.pattern, texts[r.doc_id] or "") if len(m[0]) >= rule.least]
            assert [(s.start, s.end) for s in r[rule.kind]] == found
    indexed = table.select(F.col("doc_id").alias("document"), F.coalesce("text", F.lit("")).alias("text"))
    admitted = {r.document: set(r.kinds) for r in secrets.candidates(secrets.postings(indexed, RULES), RULES).collect()}
    for n, text in enumerate(texts):
        assert {k for k in ("key", "pem") if admits(next(r for r in RULES if r.kind == k).query, ascii_lowered(text or ""))} == admitted.get(n, set())


def test_masked_keeps_odd_columns(spark, odd):
    names = ["__key", "__hash", "__kinds", "row", "document", "word", "bits0", "where0", "place"]
    table = odd.select("*", *[F.lit(n).alias(n) for n in names])
    masked = secrets.masked(table)
    assert masked.columns == table.columns and masked.count() == table.count()
    assert masked.where("text is null").count() == 1
    assert "[access]" in masked.where("doc_id = 8").first().text
    assert secrets.masked(table.limit(0)).count() == 0
    assert secrets.scan(table, carry=names).columns == ["doc_id", *names, "assign", "access", "hex"]


def test_texts_are_not_shuffled(spark, folder):
    plan = secrets.scan(spark.read.parquet(f"{folder}/documents.parquet"))._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    )
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "text" in line]
    assert "Python" not in plan and "SortMergeJoin" not in plan
