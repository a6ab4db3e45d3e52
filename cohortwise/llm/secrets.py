"""Secret scans through a trigram inverted index.

For each rule a Boolean trigram query is derived from its regular expression
(``trigrams.trigram_query``): trigrams of the lowered text that any text with a
match holds. The index lists postings (trigram, document) of the trigrams that
some rule asks for; the postings are intersected and united as the queries say,
and the documents found for each rule become a bitmap of ``BITMAP`` places, a
document's place a hash of its id and text. The bitmap (bounded: one row of a few
numbers for 64 places) is sent to the rows, and a rule's expression verifies the
texts whose place is set, so texts are never shuffled. Two documents in one place
cost a needless verification and change nothing. A rule without mandatory
trigrams is verified on every document.

All work is DataFrame expressions and joins. Spans count code points, end
exclusive; they come from the lengths of matches and of the text between them, so
a text is scanned once per rule.

Defined results: a null text counts as empty and has no spans; repeated rows get
the same spans each; repeated or null ids are no trouble, since rows are never
looked up by them; an empty table gives an empty result; other columns may have
any names.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortwise.llm.common import whole_text
from cohortwise.llm.trigrams import Query, trigram_query
from cohortwise.llm.url_filter import lower_ascii

#: Places of the bitmap of candidates: 262,144 rows of 64, at every size of the input.
BITMAP = 1 << 24


@dataclass(frozen=True)
class SecretRule:
    """A kind of secret: what to match, and which matches count (``least`` is the least length of ``group``)."""

    kind: str
    pattern: str
    group: int
    least: int

    @cached_property
    def query(self) -> Query:
        return trigram_query(self.pattern)


# The kinds every scan returns.
BASE_RULES = (
    SecretRule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    SecretRule("access", r"AKIA[A-Z0-9]+", 0, 20),
    SecretRule("hex", r"[0-9a-f]{24,}", 0, 24),
)


def _matches(text: Column, rule: SecretRule) -> Column:
    """For each match what stands before it, the match and its group; last the rest of the text with null matches."""
    gaps = F.split(text, rule.pattern, -1)
    hits, parts = (F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(group)) for group in (0, rule.group))
    return F.transform(F.arrays_zip(gaps, hits, parts), lambda x: F.struct(x["0"].alias("gap"), x["1"].alias("hit"), x["2"].alias("part")))


def _kept_spans(text: Column, rule: SecretRule) -> Column:
    """``array<struct<start, end>>`` of the matches that count, in one run over the matches."""
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        counts = F.coalesce(F.length(x["part"]) >= rule.least, F.lit(False))
        spans = F.when(counts, F.concat(state["spans"], F.array(F.struct(start.alias("start"), end.alias("end"))))).otherwise(state["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    return F.aggregate(_matches(text, rule), F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans")), step, lambda state: state["spans"])


def _without(text: Column, rule: SecretRule) -> Column:
    """The text with the matches that count replaced."""
    def shown(x: Column) -> Column:
        hit = F.when(F.length(x["part"]) >= rule.least, F.lit(f"[{rule.kind}]")).otherwise(F.coalesce(x["hit"], F.lit("")))
        return F.concat(x["gap"], hit)

    return F.array_join(F.transform(_matches(text, rule), shown), "")


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def _bit(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), at.cast("int"))


def _asked(rules: Sequence[SecretRule]) -> list[str]:
    return sorted(set().union(*(rule.query.all_trigrams() for rule in rules)))


def postings(documents: DataFrame, rules: Sequence[SecretRule]) -> DataFrame:
    """The inverted index over ``(document, text)``: one row per document and trigram that some rule asks for."""
    lowered = documents.select("document", lower_ascii(F.col("text")).alias("lowered"))
    found = F.array_compact(F.array(*[F.when(F.contains("lowered", F.lit(t)), F.lit(t)) for t in _asked(rules)]).cast("array<string>"))
    return lowered.select("document", F.explode(found).alias("trigram"))


def candidates(index: DataFrame, rules: Sequence[SecretRule]) -> DataFrame:
    """``(document, kinds)``: the postings put together as each rule's query says. Counting folds on the map side."""
    numbers = {t: n for n, t in enumerate(_asked(rules))}
    words = range(-(-len(numbers) // 64) or 1)
    number = F.array_position(F.array(*[F.lit(t) for t in numbers]).cast("array<string>"), F.col("trigram")) - 1
    numbered = index.select("document", number.alias("number"))
    mine = F.floor(F.col("number") / 64)
    present = numbered.groupBy("document").agg(*[F.bit_or(F.when(mine == w, _bit(F.col("number") % 64)).otherwise(F.lit(0).cast("long"))).alias(f"word{w}") for w in words])

    def holds(query: Query) -> Column:
        needed = [_signed(sum(1 << numbers[t] % 64 for t in query.trigrams if numbers[t] // 64 == w)) for w in words]
        parts = [F.col(f"word{w}").bitwiseAND(F.lit(mask)) == mask for w, mask in enumerate(needed) if mask]
        parts += [reduce(Column.__or__, [holds(q) for q in sorted(group, key=repr)]) for group in sorted(query.choices, key=repr)]
        return reduce(Column.__and__, parts)

    kinds = [F.when(holds(rule.query), F.lit(rule.kind)) for rule in rules if rule.query]
    return present.select("document", F.array_compact(F.array(*kinds).cast("array<string>")).alias("kinds")).where(F.size("kinds") > 0)


def _verified_where(documents: DataFrame, rules: Sequence[SecretRule]) -> tuple[DataFrame, list[Column]]:
    """``documents`` (with ``document`` and ``text``) and for each rule whether a row's text is to be verified."""
    indexed = [rule for rule in rules if rule.query]
    if not indexed:
        return documents, [F.lit(True)] * len(rules)
    place = F.pmod("document", F.lit(BITMAP).cast("long"))
    found = candidates(postings(documents, indexed), indexed).select(place.alias("place"), "kinds")
    bits = [F.bit_or(F.when(F.array_contains("kinds", rule.kind), _bit(F.col("place") % 64)).otherwise(F.lit(0).cast("long"))).alias(f"bits{n}") for n, rule in enumerate(indexed)]
    bitmap = found.groupBy(F.floor(F.col("place") / 64).alias("word")).agg(*bits)  # at most BITMAP / 64 rows
    marked = documents.withColumn("word", F.floor(place / 64)).join(F.broadcast(bitmap), "word", "left")
    numbers = {rule.kind: n for n, rule in enumerate(indexed)}
    where = [
        F.coalesce(F.col(f"bits{numbers[rule.kind]}").bitwiseAND(_bit(place % 64)) != 0, F.lit(False)) if rule.query else F.lit(True) for rule in rules
    ]
    return marked, where


def _named(documents: DataFrame, id_column: str, text_column: str, row: Column) -> DataFrame:
    """``(row, document, text)``: columns of the table stay inside ``row``, so their names meet no others."""
    text = whole_text(text_column)
    identifier = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    return documents.select(row.alias("row"), F.xxhash64(identifier, text).alias("document"), text.alias("text"))


def scan(documents: DataFrame, rules: Sequence[SecretRule] = BASE_RULES, id_column: str = "doc_id", text_column: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """One row per document: its id, ``carry`` columns, and for each kind an array of ``(start, end)``."""
    marked, where = _verified_where(_named(documents, id_column, text_column, F.struct(id_column, *carry)), rules)
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    spans = [F.when(concerned, _kept_spans(F.col("text"), rule)).otherwise(none).alias(rule.kind) for rule, concerned in zip(rules, where)]
    return marked.select("row.*", *spans)


def report(scanned: DataFrame, rules: Sequence[SecretRule] = BASE_RULES) -> DataFrame:
    """Counts per kind and all spans as ``kind:start:end``, by start and then kind as listed."""

    def named(k: int, kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("k"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    tagged = F.concat(*[named(k, rule.kind) for k, rule in enumerate(rules)])
    joined = F.array_join(F.transform(F.array_sort(tagged), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.size(rule.kind).cast("long").alias(f"n_{rule.kind}") for rule in rules]
    names = [c for c in scanned.columns if c not in {rule.kind for rule in rules}]
    return scanned.select(*names, *counts, joined.alias("spans")).withColumn("base_sha256", F.sha2(F.col("spans"), 256))


def masked(documents: DataFrame, rules: Sequence[SecretRule] = BASE_RULES) -> DataFrame:
    """The documents with each secret replaced by its kind in brackets; columns unchanged, ``n_chars`` follows the text.

    Rules are applied one after the other to what the earlier ones left. A rule is asked about texts whose trigrams in the
    table admit it: what is in brackets holds no secret of its own. A null text stays null.
    """
    marked, where = _verified_where(_named(documents, "doc_id", "text", F.struct("*")), rules)
    text = F.col("text")
    flagged = marked.select("row", "text", *[concerned.alias(f"where{n}") for n, concerned in enumerate(where)])
    for n, rule in enumerate(rules):
        flagged = flagged.withColumn("text", F.when(F.col(f"where{n}") & text.rlike(rule.pattern), _without(text, rule)).otherwise(text))
    shown = {name: F.col("row").getField(name) for name in documents.columns}
    shown["text"] = F.when(shown["text"].isNotNull(), text)
    if "n_chars" in shown:
        shown["n_chars"] = F.coalesce(F.length(shown["text"]).cast(documents.schema["n_chars"].dataType), shown["n_chars"])
    return flagged.select(*[column.alias(name) for name, column in shown.items()])
