"""Quality rules from repetition coverage.

How much of a text lies in n-grams and lines that stood in it before: for each
n-gram length the hashes of all windows are rolled on from those of one word less,
in numpy, over the words of many documents at once, and a sort finds the windows that come
again. Counted are the characters (code points) of words, each once a length,
however many repeated windows overlap. A document is kept when

* it has ``least_words`` words and at most ``base_percent`` per cent of them lie in
  windows of ``base_window`` words found twice or more (the first one included),
* for each length in ``coverage`` at most that share of its characters lies in
  windows that stood in the text before (the first one not included),
* at most ``line_percent`` per cent of its characters lie in lines that stood
  before, and
* it has at most ``symbol_percent`` symbols to a hundred words.

All measures are integers, and shares are compared without division.

Words are [^\\x20\\x09-\\x0D]+; lines are parted by \\n and count when they hold a
word. Windows are told apart by 64-bit hashes of the document and its words.

Defined results: a null text has no words, like an empty or blank one, and is
not kept; null ids and repeated rows are judged like any other row; a text is
worked on whole, however long; an empty table gives an empty result. Columns
besides id and text are not read, except by ``drop_repetitive``, which returns all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortwise.llm.common import whole_text
from cohortwise.llm.language_model import _mix

_BATCH_BYTES = 4_000_000
_STEP = np.uint64(0x9E3779B97F4A7C15)
_NEWLINE = 10
_IS_SPACE = np.isin(np.arange(256), [*range(9, 14), 32])


@dataclass(frozen=True)
class RepetitionRules:
    """Bounds of the rules; ``coverage`` has pairs of n-gram length and per cent of characters."""

    least_words: int = 20
    base_window: int = 8
    base_percent: int = 30
    coverage: tuple[tuple[int, int], ...] = ((5, 25), (6, 24), (7, 23), (8, 22), (9, 21), (10, 20))
    line_percent: int = 20
    symbol_percent: int = 10
    symbols: str = "#*$%&|<>"

    @property
    def columns(self) -> list[str]:
        return [f"covered_{n}" for n, _ in self.coverage]


def repeats(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window whether it is found twice or more, and whether it stood before."""
    order = np.argsort(windows, kind="stable")
    ordered = windows[order]
    same = ordered[1:] == ordered[:-1]
    twice, before = np.zeros(len(windows), bool), np.zeros(len(windows), bool)
    before[order[1:]] = same
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    return twice, before


def covered(starts: np.ndarray, n: int) -> np.ndarray:
    """Which words lie in a window of ``n`` words that starts at a marked place."""
    total = np.concatenate([[0], np.cumsum(starts)])
    places = np.arange(1, len(total))
    return total[places] > total[np.maximum(places - n, 0)]


def sum_between(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of ``values`` from each edge to the next; wraps for hashes."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)])
    return total[edges[1:]] - total[edges[:-1]]


def hash_between(mixed: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the bytes from each start to its end: sums of a random value for each byte and its place there."""
    total = np.zeros(len(starts), np.uint64)
    lengths = ends - starts
    order = np.argsort(lengths, kind="stable")
    first = np.searchsorted(lengths[order], 32, side="right")
    steps = np.arange(32, dtype=np.uint64) * _STEP
    for place in range(int(lengths[order[:first]].max(initial=0))):  # short stretches: place by place
        longer = order[np.searchsorted(lengths[order], place, side="right") : first]
        total[longer] += _mix(mixed[starts[longer] + place] + steps[place])
    long = order[first:]
    if len(long):
        where = np.concatenate([[0], np.cumsum(lengths[long])])
        place = np.arange(where[-1]) - np.repeat(where[:-1], lengths[long])
        inside = place + np.repeat(starts[long], lengths[long])
        total[long] = sum_between(_mix(mixed[inside] + place.astype(np.uint64) * _STEP), where)
    return total


def word_places(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and each word's document."""
    begins = np.zeros(len(data) + 1, bool)
    begins[edges] = True
    space = np.append(_IS_SPACE[data], True)
    starts = (~space & (np.append(True, space[:-1]) | begins)).nonzero()[0]
    ends = ((space | begins)[1:] & ~space[:-1]).nonzero()[0] + 1
    return starts, ends, np.searchsorted(edges, starts, side="right") - 1


def measure(data: np.ndarray, edges: np.ndarray, rules: RepetitionRules) -> dict[str, np.ndarray]:
    """The measures of the documents whose UTF-8 bytes lie in ``data`` from each of the ``edges`` to the next."""
    documents = len(edges) - 1
    starts, ends, document = word_places(data, edges)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points up to here
    lengths = points[ends] - points[starts]
    sizes = np.bincount(document, minlength=documents)
    per_document = lambda values: np.bincount(document, weights=values, minlength=documents).astype(np.int64)
    mixed = _mix(np.arange(1, 257, dtype=np.uint64) * _STEP)[data]
    symbol = np.zeros(256, np.int64)
    symbol[list(rules.symbols.encode())] = 1
    found = {"n_words": sizes.astype(np.int64), "word_chars": per_document(lengths), "n_symbols": sum_between(symbol[data], edges)}
    found |= _line_measures(data, edges, mixed, starts, lengths)

    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(starts))  # words from here to the document's end
    wanted = dict(rules.coverage)
    hashes = hash_between(mixed, starts, ends)
    places = np.arange(len(starts))
    rolled = _mix(document.astype(np.uint64) + _STEP)
    for n in range(1, max([rules.base_window, *wanted]) + 1):
        inside = max(len(hashes) - n + 1, 0)
        rolled[:inside] = _mix(rolled[:inside] * _STEP + hashes[n - 1 :])
        if n != rules.base_window and n not in wanted:
            continue
        places = places[left[places] >= n]
        twice, earlier = repeats(rolled[places])
        for name, marked, weights in (("n_repeat_words", twice, 1), (f"covered_{n}", earlier, lengths)):
            if n in wanted if name.startswith("covered") else n == rules.base_window:
                at = np.zeros(len(starts), bool)
                at[places] = marked
                found[name] = per_document(covered(at, n) * weights)
        places = places[twice]  # a window found once begins no longer one found twice
    return found


def _line_measures(data: np.ndarray, edges: np.ndarray, mixed: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> dict[str, np.ndarray]:
    """How many lines with a word stood in the document before, and the code points of their words."""
    first = np.zeros(len(data) + 1, bool)
    first[edges] = True
    first[1:] |= data == _NEWLINE
    first[-1] = False
    line_start = first.nonzero()[0]
    line_end = np.append(line_start[1:], len(data))[: len(line_start)]
    line_end = line_end - (data[line_end - 1] == _NEWLINE)
    owner = np.searchsorted(edges, line_start, side="right") - 1
    line = np.searchsorted(line_start, starts, side="right") - 1
    characters = np.bincount(line, weights=lengths, minlength=len(line_start)).astype(np.int64)
    worded = characters > 0
    owner, characters = owner[worded], characters[worded]
    hashes = hash_between(mixed, line_start[worded], line_end[worded])
    _, earlier = repeats(_mix(_mix(owner.astype(np.uint64) + _STEP) + hashes))
    count = lambda values: np.bincount(owner, weights=values, minlength=len(edges) - 1).astype(np.int64)
    return {"n_dup_lines": count(earlier), "line_chars": count(earlier * characters)}


_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "line_chars", "n_repeat_words")


def _slices(texts: pa.StringArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first, last, bytes, edges)`` of stretches of rows of about four megabytes; a longer text is a stretch of its own."""
    edges = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(edges, edges[first] + _BATCH_BYTES)))
        last = min(last, len(texts))
        yield first, last, data[edges[first] : edges[last]], edges[first : last + 1] - edges[first]
        first = last


def repetition(documents: DataFrame, rules: RepetitionRules = RepetitionRules(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: id, words, characters, symbols, repeated lines and words, and characters covered a length."""
    fields = [*_MEASURES, *rules.columns]

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, edges in _slices(batch.column("text").cast(pa.string())):
                found = measure(data, edges, rules)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(first, last - first), *(pa.array(found[f], pa.int64()) for f in fields)], names=["id", *fields])

    narrow = documents.select(F.col(id_column).alias("id"), whole_text(text_column).alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(measured, f"id {kind}, " + ", ".join(f"{f} long" for f in fields)).withColumnRenamed("id", id_column)


def base_failed(rules: RepetitionRules) -> Column:
    return (F.col("n_words") < rules.least_words) | (100 * F.col("n_repeat_words") > rules.base_percent * F.col("n_words"))


def verdict(rules: RepetitionRules) -> Column:
    """Whether a measured document passes all rules."""
    passes = ~base_failed(rules) & (100 * F.col("line_chars") <= rules.line_percent * F.col("word_chars")) & (100 * F.col("n_symbols") <= rules.symbol_percent * F.col("n_words"))
    for n, percent in rules.coverage:
        passes &= 100 * F.col(f"covered_{n}") <= percent * F.col("word_chars")
    return passes


def judge(documents: DataFrame, rules: RepetitionRules = RepetitionRules(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The measures of every document with ``base_failed`` and ``kept``."""
    return repetition(documents, rules, id_column, text_column).withColumns({"base_failed": base_failed(rules), "kept": verdict(rules)})


def drop_repetitive(documents: DataFrame, rules: RepetitionRules = RepetitionRules()) -> DataFrame:
    """The documents that pass, with all their columns; a document stays when its id and text have a passing row.

    Rows are judged by a hash of (id, text), so repeated or null ids are no trouble.
    """
    key = F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), whole_text()), 256)
    passing = judge(documents.select(key.alias("key"), "text"), rules, "key").where("kept").select(F.col("key").alias("passing_key")).distinct()
    return documents.join(passing, key == F.col("passing_key"), "left_semi")
