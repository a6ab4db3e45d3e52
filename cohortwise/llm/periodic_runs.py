"""Periodic runs of words by block convolution.

A run is a longest stretch of words that repeat with some smallest period, at
least ``least_periods`` (three or more) times over and ``least_words`` long. At each dyadic scale
the text is cut into blocks of B words. A run with a period of B to 2 B - 1
contains a whole block together with its next occurrence one period on, so it is
enough to look for each block at these distances: the sum of squared differences between the
block and every place of the window that follows is computed by number-theoretic
transforms, and is zero where all words are equal. These sums are exact integers
modulo a prime; places where they vanish are then compared word by word, so that
a multiple of the prime passes for no match. The first scale (8 words) serves all
periods up to 15.

Each distance found seeds an extension: neighbouring blocks with the same distance
are put together, and the stretch grows to both sides while words one distance
apart are equal. Stretches that are long enough are runs; of several periods for
the same stretch the least is its own. A block that holds a word not found again within
the window has no occurrence there and is not transformed. Blocks inside a known run
whose period divides the distance show nothing new and are left out.

The words of many documents stand one after the other in an array, and blocks and
windows never reach beyond a document. Texts are worked on whole, in memory that follows
the longest one; all others together take a bounded share.

Words are [^\\x20\\x09-\\x0D]+, told apart by 64-bit hashes. Collapsing a text
keeps the first period of every run, and the words outside of runs, joined by single spaces.

Defined results: a null text has no words, like an empty or blank one: no
runs and an empty collapsed text; null ids and repeated rows are treated like any other row; an
empty table gives an empty result. Columns besides id and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortwise.llm.common import whole_text
from cohortwise.llm.language_model import _mix
from cohortwise.llm.repetition import _STEP, _slices, hash_between, word_places

_P, _GENERATOR = 15 * 2**27 + 1, 31  # a prime with roots of unity for transforms of up to 2 ** 27 places
_PRIME = np.uint64(_P)
_LEAST_BLOCK = 8
_HELD = 1 << 18  # places transformed at a time


@dataclass(frozen=True)
class PeriodicRuns:
    """How long a run has to be: in words, and in periods (three at least: blocks are not sure to meet shorter ones)."""

    least_words: int = 24
    least_periods: int = 3

    def __post_init__(self) -> None:
        if self.least_periods < 3 or self.least_words < 3 * _LEAST_BLOCK:
            raise ValueError("runs have three periods and 24 words at least")


@cache
def _roots(size: int, inverse: bool) -> list[np.ndarray]:
    """Powers of the root of unity for each stage, widest first."""
    root = pow(_GENERATOR, (_P - 1) // size, _P)
    if inverse:
        root = pow(root, _P - 2, _P)
    stages = []
    half = size // 2
    while half:
        powers = np.ones(half, np.uint64)
        known, step = 1, root
        while known < half:  # powers[known:2 known] = powers[:known] * root ** known
            powers[known : 2 * known] = powers[:known] * np.uint64(step) % _PRIME
            known, step = 2 * known, step * step % _P
        stages.append(powers[:, None])
        root = root * root % _P
        half //= 2
    return stages


def _reduced(sums: np.ndarray) -> np.ndarray:
    """Sums of two residues as residues: below the prime the difference wraps to a larger number."""
    return np.minimum(sums, sums - _PRIME)


def _forward(values: np.ndarray, inverse_roots: bool = False) -> np.ndarray:
    """Transform along the first axis in place; the result is in bit-reversed order."""
    size, width = values.shape
    half = size // 2
    for powers in _roots(size, inverse_roots):
        parts = values.reshape(size // (2 * half), 2, half, width)
        low, high = parts[:, 0], parts[:, 1]
        difference = (low + (_PRIME - high)) * powers % _PRIME
        parts[:, 0] = _reduced(low + high)
        parts[:, 1] = difference
        half //= 2
    return values


def _backward(values: np.ndarray) -> np.ndarray:
    """The inverse of ``_forward``."""
    size, width = values.shape
    half = 1
    for powers in reversed(_roots(size, True)):
        parts = values.reshape(size // (2 * half), 2, half, width)
        low, high = parts[:, 0].copy(), parts[:, 1] * powers % _PRIME
        parts[:, 0] = _reduced(low + high)
        parts[:, 1] = _reduced(low + (_PRIME - high))
        half *= 2
    return values * np.uint64(pow(size, _P - 2, _P)) % _PRIME


def mismatches(text: np.ndarray, squares: np.ndarray, blocks: np.ndarray, block: int, first: int, last: int) -> np.ndarray:
    """Sums of squared differences, modulo the prime, of each block of words and its text ``first`` to ``last`` places on.

    ``text`` and the running sums ``squares`` are padded so that every window exists. The result has a row a distance.
    """
    size = 1 << (last - first + block - 1).bit_length()
    inside = np.arange(block)[:, None] + blocks
    window = np.arange(size)[:, None] + (blocks + first)
    own = np.zeros((size, len(blocks)), np.uint64)
    own[:block] = text[inside]
    product = _backward(_forward(text[np.minimum(window, len(text) - 1)]) * _forward(own, inverse_roots=True) % _PRIME)
    distances = np.arange(first, last + 1)
    ends = blocks + distances[:, None]
    around = (squares[ends + block] - squares[ends] + squares[blocks + block] - squares[blocks]) % _PRIME
    return (around + np.uint64(2) * (_PRIME - product[: len(distances)])) % _PRIME


def _stretch(alive: np.ndarray, compare: Callable[[np.ndarray, np.ndarray], np.ndarray], step: int = 32) -> np.ndarray:
    """How many places in a row agree for each of ``alive``, seen ``step`` at a time."""
    reach = np.zeros(len(alive), np.int64)
    active = np.arange(len(alive))
    while len(active):
        found = np.zeros(len(active), bool)
        for part in range(0, len(active), 1 << 14):
            here = active[part : part + (1 << 14)]
            equal = compare(alive[here], reach[here][:, None] + np.arange(step))
            whole = equal.all(1)
            reach[here] += np.where(whole, step, np.argmin(equal, 1))
            found[part : part + (1 << 14)] = whole
        active = active[found]
    return reach


class _Known:
    """Runs found so far, and for each word the one that reaches farthest."""

    def __init__(self, words: int):
        self.start, self.end, self.period = (np.zeros(0, np.int64) for _ in range(3))
        self._at = np.full(words, -1, np.int64)

    def add(self, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> None:
        start, end, period = (np.concatenate(x) for x in ((self.start, start), (self.end, end), (self.period, period)))
        order = np.lexsort((period, start, end))
        start, end, period = start[order], end[order], period[order]
        least = np.ones(len(start), bool)
        least[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
        self.start, self.end, self.period = start[least], end[least], period[least]
        for k, (a, b) in enumerate(zip(self.start.tolist(), self.end.tolist())):  # by end, so the farthest is painted last
            self._at[a:b] = k

    def covers(self, place: np.ndarray, end: np.ndarray, distance: np.ndarray) -> np.ndarray:
        if not len(self.start):
            return np.zeros(len(place), bool)
        run = self._at[place]
        return (run >= 0) & (self.end[run] >= end) & (distance % self.period[run] == 0)


def find_runs(hashes: np.ndarray, edges: np.ndarray, spec: PeriodicRuns = PeriodicRuns()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(start, end, period)`` of all runs in documents whose words lie from each of the ``edges`` to the next; ordered by start, then period."""
    words = len(hashes)
    sizes = np.diff(edges)
    longest = int(sizes.max(initial=0))
    if longest < spec.least_words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    document = np.repeat(np.arange(len(sizes)), sizes)
    keys = _mix(_mix(document.astype(np.uint64) + _STEP) + hashes)
    order = np.argsort(keys, kind="stable")
    again = keys[order[1:]] == keys[order[:-1]]
    number = np.zeros(words, np.int64)
    number[order[1:]] = np.cumsum(~again)
    far = np.iinfo(np.int64).max
    ahead = np.full(-(-words // _LEAST_BLOCK) * _LEAST_BLOCK, far)  # words to the next equal one in the document
    ahead[order[:-1][again]] = order[1:][again] - order[:-1][again]
    farthest = ahead.reshape(-1, _LEAST_BLOCK).max(1)

    block, known = _LEAST_BLOCK, _Known(words)
    text = squares = np.zeros(0, np.uint64)
    while spec.least_periods * (block if block > _LEAST_BLOCK else 1) <= longest:
        first, last = (1 if block == _LEAST_BLOCK else block), 2 * block - 1
        blocks = (farthest <= last).nonzero()[0] * block
        blocks = blocks[blocks + block <= words]
        end = edges[document[blocks] + 1] if len(blocks) else blocks
        blocks = blocks[blocks + block + first <= end]
        if len(blocks) and len(text) < words + 4 * block:
            text = np.zeros(words + 4 * block, np.uint64)
            text[:words] = number.astype(np.uint64) % _PRIME
            squares = np.concatenate([np.zeros(1, np.uint64), np.cumsum(text * text % _PRIME)])
        places, distances = [], []
        at_once = max(1, _HELD // (4 * block))
        for part in range(0, len(blocks), at_once):
            here = blocks[part : part + at_once]
            distance, which = (mismatches(text, squares, here, block, first, last) == 0).nonzero()
            place, distance = here[which], distance + first
            inside = place + distance + block <= edges[document[place] + 1]
            place, distance = place[inside], distance[inside]
            fresh = ~known.covers(place, place + distance + block, distance)
            place, distance = place[fresh], distance[fresh]
            equal = _compared(number, place, distance, block)
            places.append(place[equal])
            distances.append(distance[equal])
        if places:
            start, stop, period = _extended(number, edges, document, np.concatenate(places), np.concatenate(distances), block)
            enough = stop - start >= np.maximum(spec.least_words, spec.least_periods * period)
            if enough.any():
                known.add(start[enough], stop[enough], period[enough])
        block *= 2
        farthest = np.append(farthest, np.full(len(farthest) % 2, far)).reshape(-1, 2).max(1)
    order = np.lexsort((known.period, known.start))
    return known.start[order], known.end[order], known.period[order]


def _compared(number: np.ndarray, place: np.ndarray, distance: np.ndarray, block: int) -> np.ndarray:
    """Whether all words of each block and its occurrence are equal."""
    equal = np.ones(len(place), bool)
    width = min(block, 256)
    for part in range(0, len(place), max(1, (1 << 20) // width)):
        here = slice(part, part + max(1, (1 << 20) // width))
        for offset in range(0, block, width):
            at = place[here][:, None] + np.arange(offset, offset + width)
            equal[here] &= (number[at] == number[at + distance[here][:, None]]).all(1)
    return equal


def _extended(number: np.ndarray, edges: np.ndarray, document: np.ndarray, place: np.ndarray, distance: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The longest stretches around the matches that repeat with their distance."""
    order = np.lexsort((place, distance))
    place, distance = place[order], distance[order]
    joined = np.zeros(len(place), bool)
    joined[1:] = (distance[1:] == distance[:-1]) & (place[1:] == place[:-1] + block) & (document[place[1:]] == document[place[:-1]])
    starts = (~joined).nonzero()[0]
    ends = np.append(starts[1:], len(place))[: len(starts)]
    low, high, period = place[starts], place[ends - 1] + block, distance[starts]
    begin, end = edges[document[low]], edges[document[low] + 1]

    def before(seed: np.ndarray, steps: np.ndarray) -> np.ndarray:
        at = low[seed][:, None] - 1 - steps
        known = np.maximum(at, 0)
        return (at >= begin[seed][:, None]) & (number[known] == number[np.minimum(known + period[seed][:, None], len(number) - 1)])

    def after(seed: np.ndarray, steps: np.ndarray) -> np.ndarray:
        at = high[seed][:, None] + steps + period[seed][:, None]
        known = np.minimum(at, len(number) - 1)
        return (at < end[seed][:, None]) & (number[known] == number[np.maximum(known - period[seed][:, None], 0)])

    seeds = np.arange(len(low))
    return low - _stretch(seeds, before), high + _stretch(seeds, after) + period, period


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray) -> pa.Array:
    """The given words of each document, joined by single spaces."""
    lengths = ends - starts + 1
    stops = np.cumsum(lengths)
    out = np.full(int(stops[-1]) if len(stops) else 0, 32, np.uint8)
    inside = np.ones(len(out), bool)
    inside[stops - 1] = False  # the space after each word
    shift = np.repeat(starts - (stops - lengths), lengths)
    out[inside] = data[(np.arange(len(out)) + shift)[inside]]
    edges = np.concatenate([[0], stops])[np.concatenate([[0], np.cumsum(counts)])]
    tails = edges[1:] - (counts > 0)  # without the space after the last word
    offsets = np.concatenate([[0], np.cumsum(tails - edges[:-1])])
    if counts.any():
        out = np.delete(out, (edges[1:] - 1)[counts > 0])
    return pa.LargeStringArray.from_buffers(len(counts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out))


Change = Callable[[object, int], np.ndarray | None]


def analyse(ids: list, data: np.ndarray, edges: np.ndarray, spec: PeriodicRuns, change: Change | None = None) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Words, runs and collapsed text of each document whose UTF-8 bytes lie from each of the ``edges`` to the next."""
    starts, ends, document = word_places(data, edges)
    sizes = np.bincount(document, minlength=len(edges) - 1)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    if change is not None:
        taken = np.arange(len(starts))
        for k, (name, size) in enumerate(zip(ids, sizes.tolist())):
            places = change(name, size)
            if places is not None:
                taken[bounds[k] : bounds[k + 1]] = bounds[k] + places
        starts, ends = starts[taken], ends[taken]
    mixed = _mix(np.arange(1, 257, dtype=np.uint64) * _STEP)[data]
    start, end, period = find_runs(hash_between(mixed, starts, ends), bounds, spec)
    owner = np.searchsorted(bounds, start, side="right") - 1
    change_of_depth = np.zeros(len(starts) + 1, np.int64)
    np.add.at(change_of_depth, start + period, 1)
    np.add.at(change_of_depth, end, -1)
    kept = np.cumsum(change_of_depth[:-1]) == 0
    collapsed = _joined(data, starts[kept], ends[kept], np.bincount(document[kept], minlength=len(sizes)))
    runs = pa.StructArray.from_arrays([pa.array(start - bounds[owner]), pa.array(end - start), pa.array(period)], names=["start", "length", "period"])
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(sizes)))])
    return pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), runs), collapsed


def periodic_runs(documents: DataFrame, spec: PeriodicRuns = PeriodicRuns(), id_column: str = "doc_id", text_column: str = "text", change: Change | None = None) -> DataFrame:
    """``(id, n_words, runs, collapsed)`` of every document; runs are ``(start, length, period)`` in words, by start, then period.

    ``change`` may set other words in place: it gets id and number of words, and gives the numbers of the words to take (or None).
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, edges in _slices(batch.column("text").cast(pa.string())):
                ids = batch.column("id").slice(first, last - first)
                n_words, runs, collapsed = analyse(ids.to_pylist() if change else [], data, edges, spec, change)
                yield pa.RecordBatch.from_arrays([ids, n_words, runs, collapsed.cast(pa.string())], names=["id", "n_words", "runs", "collapsed"])

    narrow = documents.select(F.col(id_column).alias("id"), whole_text(text_column).alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return narrow.mapInArrow(found, schema).withColumnRenamed("id", id_column)


def strongest(runs: Column) -> Column:
    """The run with the greatest length by period, of equal ones the first, then the one with the least period; null without runs."""

    def better(held: Column, run: Column) -> Column:
        return F.when(held.isNull() | (run["length"] * held["period"] > held["length"] * run["period"]), run).otherwise(held)

    return F.aggregate(runs, F.lit(None).cast("struct<start:long,length:long,period:long>"), better)


def listed(runs: Column) -> Column:
    """``start,length,period`` of every run, a line each."""
    return F.array_join(F.transform(runs, lambda x: F.concat_ws("", x["start"], F.lit(","), x["length"], F.lit(","), x["period"], F.lit("\n"))), "")
