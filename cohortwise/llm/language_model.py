"""Bigram scoring from a log-frequency Bloom filter.

Counts of words and word pairs are quantised by powers of two and held as
membership only: a gram with count c is entered once for each level 1 to
1 + floor(log2 c). Looking a gram up means probing level after level until one is
missing; the last level found gives back a count. The filter is built in regions
by the tasks that gather the counts; its size follows the training tokens
(``bits_per_token``) without a cap. Up to ``max_filter_bytes`` the regions are put
together once and broadcast. A larger filter stays a table of regions: documents
are held in runs of about a million tokens, each run sends its distinct grams to
their regions once, and the levels found come back to the run. Both ways read the
same bits and give the same scores.

The probability of a word w after v is (c(v,w) + mu * P(w)) / (c(v) + mu) with
P(w) = (c(w) + 1) / (N + V + 1), all counts from the filter, c(v,w) at most c(v).

The base score needs exact counts. Words with the highest counts (at most
``frequent_words``) are broadcast with them; the occurrences of all other words
are joined with the table of counts, so no vocabulary is ever held whole.

Words are [^\\x20\\x09-\\x0D]+ after A-Z is lowered; an end token closes each
document. Words are told apart by 64-bit hashes.

Defined results: a null text counts as empty and has the end token alone; a null
id is trained on (its checksum is that of the empty text); repeated rows count
and score as often as they stand; without training documents N is 0 and every
probability that of one unknown word; an empty table gives an empty result.
Columns besides id and text are not read.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortwise.llm.common import cut_lineage, whole_text

_END, _START = np.uint64(xxhash.xxh64_intdigest(b"", 1)), np.uint64(xxhash.xxh64_intdigest(b"", 2))
_PROBES = 3
_FLUSH_TOKENS, _RUN_TOKENS, _SENT_TOKENS, _BATCH_GRAMS = 2_000_000, 300_000, 1_000_000, 300_000


def words(text: str) -> list[bytes]:
    """bytes.lower and bytes.split know A-Z and the six ASCII white-space characters only."""
    return text.encode().lower().split()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unigrams(tokens: np.ndarray) -> np.ndarray:
    return _mix(tokens ^ np.uint64(0x9E3779B97F4A7C15))


def bigrams(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return _mix(before * np.uint64(0xD6E8FEB86659FD93) + tokens)


class WordTable:
    """Words numbered as they come, with per-word values in arrays; starts anew beyond ``bound`` words."""

    def __init__(self, values: Callable[[np.ndarray], dict[str, np.ndarray]] | None = None, bound: int = 600_000):
        self._values, self._bound = values, bound
        self._start()

    def _start(self) -> None:
        self._number: dict[bytes, int] = {}
        self._arrays: dict[str, np.ndarray] = {}

    def look_up(self, tokens: list[bytes]) -> np.ndarray:
        """Numbers of the words; arrays of ``column`` follow these numbers until the next call."""
        if len(self._number) >= self._bound:
            self._start()
        number = self._number
        new = [w for w in set(tokens) if w not in number]
        if new:
            first = len(number)
            number.update(zip(new, range(first, first + len(new))))
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, new), np.uint64, len(new))
            for name, fresh in ({"hash": hashes} | (self._values(hashes) if self._values else {})).items():
                held = self._arrays.get(name, np.zeros(0, fresh.dtype))
                if len(held) < first + len(new):
                    held = np.concatenate([held, np.zeros(max(len(held), len(new), 4096), fresh.dtype)])
                    self._arrays[name] = held
                held[first : first + len(new)] = fresh
        return np.fromiter(map(number.__getitem__, tokens), np.int64, len(tokens))

    def column(self, name: str, at: np.ndarray) -> np.ndarray:
        return self._arrays[name][at] if len(at) else np.zeros(0, np.uint64 if name == "hash" else np.float64)


@dataclass(frozen=True)
class Filter:
    """Regions of ``region_bits`` bits each; a gram lies in the region of its hash."""

    regions: int
    region_bits: int
    bits: np.ndarray

    @property
    def filled(self) -> float:
        return float(np.unpackbits(self.bits[: 1 << 20]).mean()) if len(self.bits) else 0.0


@dataclass(frozen=True)
class SpreadFilter:
    """A filter too large to broadcast: ``table`` holds ``(region, bits)``; regions without entries have no row."""

    regions: int
    region_bits: int
    table: DataFrame


def _region(grams: np.ndarray, regions: int) -> np.ndarray:
    return ((grams >> np.uint64(32)) * np.uint64(regions)) >> np.uint64(32)


def _positions(grams: np.ndarray, level: int, probe: int, region_bits: int) -> np.ndarray:
    mixed = _mix(grams + np.uint64((0x632BE59BD9B4E019 * level + 0xE7037ED1A0B428DB * probe) % 2**64))
    return ((mixed >> np.uint64(32)) * np.uint64(region_bits)) >> np.uint64(32)


def fill_region(grams: np.ndarray, counts: np.ndarray, region_bits: int) -> tuple[np.ndarray, int]:
    """The bytes of one region and the number of its entries."""
    flags = np.zeros(region_bits, np.uint8)
    levels = 1 + np.floor(np.log2(counts)).astype(np.int64) if len(counts) else counts
    entries = 0
    for level in range(1, int(levels.max(initial=0)) + 1):
        entered = grams[levels >= level]
        entries += len(entered)
        for probe in range(_PROBES):
            flags[_positions(entered, level, probe, region_bits).astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little"), entries


def found_levels(held: Filter, grams: np.ndarray) -> np.ndarray:
    """The last level found by repeated probing, 0 where the first is missing."""
    found = np.zeros(len(grams), np.int64)
    alive = np.arange(len(grams))
    level = 0
    while len(alive):
        level += 1
        for probe in range(_PROBES):
            if not len(alive):
                break
            asked = grams[alive]
            place = _region(asked, held.regions) * np.uint64(held.region_bits) + _positions(asked, level, probe, held.region_bits)
            place = place.astype(np.int64)
            alive = alive[(held.bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1]
        found[alive] = level
        if level == 64:
            break
    return found


def counts_of(levels: np.ndarray) -> np.ndarray:
    """The middle of each level, 0 for level 0."""
    return np.where(levels == 0, 0.0, np.where(levels == 1, 1.0, 0.75 * 2.0**levels - 0.5))


def quantised_counts(held: Filter, grams: np.ndarray) -> np.ndarray:
    return counts_of(found_levels(held, grams))


@dataclass
class Model:
    """Token total N, vocabulary V, table of exact word counts, the most frequent of them, and the filter."""

    tokens: int
    vocabulary: int
    counts: DataFrame
    frequent_hashes: np.ndarray
    frequent_counts: np.ndarray
    filter: Filter | SpreadFilter


def _token_hashes(table: WordTable, text: str) -> np.ndarray:
    return np.append(table.column("hash", table.look_up(words(text))), _END)


def _summed(grams: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if weights is None:
        return np.unique(grams, return_counts=True)
    different, at = np.unique(grams, return_inverse=True)
    return different, np.bincount(at, weights, len(different)).astype(np.int64)


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)[:-1]])


def _behind(start: float | np.uint64, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each token the value of the one before it in its document."""
    before = np.roll(values, 1)
    before[starts] = start
    return before


def _gram_counts(documents: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Ascending grams of the documents with their counts; a word and a pair of equal hash stand apart."""
    token = np.concatenate(documents)
    before = _behind(_START, token, _starts(np.array([len(t) for t in documents])))
    (different, n), (pairs, n_pairs) = _summed(token), _summed(bigrams(before, token))
    grams, counts = np.concatenate([unigrams(np.append(different, _START)), pairs]), np.concatenate([n, [len(documents)], n_pairs])
    order = np.argsort(grams)
    return grams[order], counts[order]


def _in_flushes(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Token hashes of the documents, in lists of some millions of tokens."""
    table, held, size = WordTable(), [], 0
    for batch in batches:
        for text in batch.column("text"):
            held.append(_token_hashes(table, text.as_py()))
            size += len(held[-1])
            if size >= _FLUSH_TOKENS:
                yield held
                held, size = [], 0
    if held:
        yield held


def _runs(documents: Iterable[list[bytes]]) -> Iterator[list[list[bytes]]]:
    """Documents in lists of some hundred thousand words, so that they are probed together."""
    held, size = [], 0
    for document in documents:
        held.append(document)
        size += len(document)
        if size >= _RUN_TOKENS:
            yield held
            held, size = [], 0
    if held:
        yield held


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for documents in _in_flushes(batches):
        different, n = _summed(np.concatenate(documents))
        for a in range(0, len(different), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(different[a : a + 100_000].view(np.int64)), pa.array(n[a : a + 100_000].astype(np.int64))], names=["word", "n"])


def _by_region(grams: np.ndarray, regions: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Regions that hold some of the ascending ``grams``, and where the grams of each begin and end."""
    region = _region(grams, regions).astype(np.int64)  # ascends with the grams
    names, at = np.unique(region, return_index=True)
    return names, at, np.append(at[1:], len(region))


def _build_filter(texts: DataFrame, tokens: int, bits_per_token: int, max_filter_bytes: int) -> Filter | SpreadFilter:
    regions = max(8, math.ceil(tokens / 1_000_000))
    region_bits = max(64, bits_per_token * tokens // regions // 64 * 64)

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for documents in _in_flushes(batches):
            different, n = _gram_counts(documents)
            names, at, ends = _by_region(different, regions)
            step = 1 + len(names) * _BATCH_GRAMS // len(different)
            for k in range(0, len(names), step):
                part = range(k, min(k + step, len(names)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(names[k : k + step]),
                        pa.array([different[at[i] : ends[i]].tobytes() for i in part], pa.binary()),
                        pa.array([n[at[i] : ends[i]].astype("<u4").tobytes() for i in part], pa.binary()),
                    ],
                    names=["region", "grams", "counts"],
                )

    def gather(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        grams = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in rows["grams"]])
        counts = np.concatenate([np.frombuffer(x.as_py(), "<u4") for x in rows["counts"]])
        bits, _ = fill_region(*_summed(grams, counts), region_bits)
        pa.default_memory_pool().release_unused()  # workers are used again by the tasks that score
        return pa.table({"region": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([bits.tobytes()], pa.binary())})

    scattered = texts.mapInArrow(scatter, "region long, grams binary, counts binary")
    gathered = scattered.groupBy("region").applyInArrow(gather, "region long, bits binary")
    if regions * region_bits > 8 * max_filter_bytes:
        return SpreadFilter(regions, region_bits, cut_lineage(gathered))
    filled = gathered.toArrow()  # at most max_filter_bytes
    bits = np.zeros((regions, region_bits // 8), np.uint8)
    for region, part in zip(filled["region"].to_pylist(), filled["bits"]):
        bits[region] = np.frombuffer(part.as_buffer(), np.uint8)
    return Filter(regions, region_bits, bits.reshape(-1))


def train(documents: DataFrame, text_column: str = "text", bits_per_token: int = 8, max_filter_bytes: int = 128 << 20, frequent_words: int = 1 << 20) -> Model:
    """Count the words and pairs of all given documents."""
    texts = documents.select(whole_text(text_column).alias("text"))
    counts = cut_lineage(texts.mapInArrow(_count_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    total = counts.agg(F.sum("n"), F.count("*")).first()
    tokens, vocabulary = total[0] or 0, total[1]
    # steps of an eighth of a power of two: a few hundred rows however large the corpus is
    step = F.floor(8 * F.log2("n"))
    steps = sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True)
    least, taken = float("inf"), 0
    for name, n in steps:
        if taken + n > frequent_words:
            break
        least, taken = name, taken + n
    frequent = counts.where(step >= F.lit(least)).toArrow() if taken else None
    hashes = np.array(frequent["word"]).view(np.uint64) if taken else np.zeros(0, np.uint64)
    order = np.argsort(hashes)
    numbers = np.array(frequent["n"])[order] if taken else np.zeros(0, np.int64)
    rest = counts.where(step < F.lit(least)) if taken else counts
    return Model(tokens, vocabulary, rest, hashes[order], numbers, _build_filter(texts, tokens, bits_per_token, max_filter_bytes))


_SCORED = "doc_id long, n_tokens long, known long, base double, score double, rest array<long>"


def _exact_counts(asked: np.ndarray, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Counts of the words among the frequent ones, else -1."""
    if not len(hashes):
        return np.full(len(asked), -1.0)
    at = np.searchsorted(hashes, asked).clip(max=len(hashes) - 1)
    return np.where(hashes[at] == asked, counts[at], -1).astype(np.float64)


def _run_scores(
    names: pa.Array, sizes: np.ndarray, token: np.ndarray, exact: np.ndarray, near: np.ndarray, near_start: float, counted: Callable[[np.ndarray], np.ndarray], mass: float, smoothing: float
) -> dict[str, pa.Array]:
    """Scores of documents with ``sizes`` tokens each, ends included; ``counted`` gives the filter's counts of distinct grams."""
    starts = _starts(sizes)
    common = exact >= 0
    base = np.where(common, np.log10(np.where(common, exact + 1, 1.0) / mass), 0.0)
    near_before = _behind(near_start, near, starts)
    different, place = np.unique(bigrams(_behind(_START, token, starts), token), return_inverse=True)
    pairs = np.minimum(counted(different)[place], near_before)
    logs = np.log10((pairs + smoothing * (near + 1) / mass) / (near_before + smoothing))
    known = np.add.reduceat(common.astype(np.int64), starts)
    rest = np.concatenate([[0], np.cumsum(sizes - known)]).astype(np.int32)
    return {
        "doc_id": names,
        "n_tokens": pa.array(sizes),
        "known": pa.array(known),
        "base": pa.array(np.add.reduceat(base, starts)),
        "score": pa.array(np.add.reduceat(logs, starts)),
        "rest": pa.ListArray.from_arrays(pa.array(rest), pa.array(token[~common].view(np.int64))),
    }


def _score_by_broadcast(narrow: DataFrame, model: Model, mass: float, smoothing: float) -> DataFrame:
    """Every task probes the whole filter."""
    shared = narrow.sparkSession.sparkContext.broadcast((model.filter, model.frequent_hashes, model.frequent_counts))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, hashes, counts = shared.value

        def values(asked: np.ndarray) -> dict[str, np.ndarray]:
            return {"exact": _exact_counts(asked, hashes, counts), "near": quantised_counts(held, unigrams(asked))}

        table = WordTable(values)
        of_end = {name: array[0] for name, array in values(_END[None]).items()}
        near_start = quantised_counts(held, unigrams(_START[None]))[0]

        def together(names: pa.Array, run: list[list[bytes]]) -> pa.RecordBatch:
            sizes = np.array([len(document) for document in run], np.int64)
            at, ends = table.look_up(list(chain.from_iterable(run))), np.cumsum(sizes)
            token = np.insert(table.column("hash", at), ends, _END)
            exact, near = (np.insert(table.column(name, at), ends, of_end[name]) for name in ("exact", "near"))
            columns = _run_scores(names, sizes + 1, token, exact, near, near_start, lambda grams: quantised_counts(held, grams), mass, smoothing)
            return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

        for batch in batches:
            names, first = batch.column("doc_id"), 0
            for run in _runs(words(text.as_py()) for text in batch.column("text")):
                yield together(names.slice(first, len(run)), run)
                first += len(run)

    done = cut_lineage(narrow.mapInArrow(scored, _SCORED))
    shared.unpersist()
    return done


def _asked(sizes: np.ndarray, token: np.ndarray) -> np.ndarray:
    """All distinct grams that the scores of a run need, ascending."""
    return np.unique(np.concatenate([unigrams(np.unique(np.append(token, _START))), np.unique(bigrams(_behind(_START, token, _starts(sizes)), token))]))


def _score_by_region(narrow: DataFrame, model: Model, mass: float, smoothing: float) -> DataFrame:
    """Runs of documents send their distinct grams to the filter's regions and get the levels back."""
    held = model.filter
    regions, region_bits = held.regions, held.region_bits
    shared = narrow.sparkSession.sparkContext.broadcast((model.frequent_hashes, model.frequent_counts))
    sent = pa.schema([("run", pa.string()), ("region", pa.int64()), ("names", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("data", pa.binary())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row with the tokens of each run, without a region, and one for each region with the grams asked of it."""

        def rows(names: list[int | None], documents: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            run, sizes, token = uuid.uuid4().hex, np.array([len(x) for x in documents], np.int64), np.concatenate(documents)
            yield pa.RecordBatch.from_pydict({"run": [run], "region": [None], "names": [names], "sizes": [sizes.tolist()], "data": [token.tobytes()]}, sent)
            grams = _asked(sizes, token)
            places, begins, ends = _by_region(grams, regions)
            for k in range(0, len(places), 1024):
                part = range(k, min(k + 1024, len(places)))
                data = [grams[begins[i] : ends[i]].tobytes() for i in part]
                nothing = [None] * len(part)
                yield pa.RecordBatch.from_pydict({"run": [run] * len(part), "region": places[k : k + 1024].tolist(), "names": nothing, "sizes": nothing, "data": data}, sent)

        table, names, documents, size = WordTable(), [], [], 0
        for batch in batches:
            for name, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                names.append(name)
                documents.append(_token_hashes(table, text.as_py()))
                size += len(documents[-1])
                if size >= _SENT_TOKENS:
                    yield from rows(names, documents)
                    names, documents, size = [], [], 0
        if documents:
            yield from rows(names, documents)

    def probe(key: tuple[pa.Scalar, ...], asked: pa.Table, filled: pa.Table) -> pa.Table:
        bits = np.frombuffer(filled["bits"][0].as_buffer(), np.uint8) if len(filled) else np.zeros(region_bits // 8, np.uint8)
        region = Filter(1, region_bits, bits)
        levels = [found_levels(region, np.frombuffer(x.as_buffer(), np.uint64)).astype(np.uint8).tobytes() for x in asked["data"]]
        return pa.table({"run": asked["run"], "region": asked["region"], "levels": pa.array(levels, pa.binary())})

    def scored(key: tuple[pa.Scalar, ...], run: pa.Table, answers: pa.Table) -> pa.Table:
        hashes, counts = shared.value
        sizes, token = np.array(run["sizes"][0].as_py(), np.int64), np.frombuffer(run["data"][0].as_buffer(), np.uint64)
        grams = _asked(sizes, token)
        levels = b"".join(x.as_py() for x in answers.sort_by("region")["levels"])  # the grams ascend with their regions
        found = counts_of(np.frombuffer(levels, np.uint8).astype(np.int64))

        def counted(asked: np.ndarray) -> np.ndarray:
            return found[np.searchsorted(grams, asked)]

        different, place = np.unique(token, return_inverse=True)
        exact, near = _exact_counts(different, hashes, counts)[place], counted(unigrams(different))[place]
        return pa.table(_run_scores(run["names"][0].values, sizes, token, exact, near, counted(unigrams(_START[None]))[0], counted, mass, smoothing))

    held_runs = cut_lineage(narrow.mapInArrow(send, "run string, region long, names array<long>, sizes array<long>, data binary"))
    asked = held_runs.where("region is not null").select("run", "region", "data")
    answers = asked.groupBy("region").cogroup(held.table.groupBy("region")).applyInArrow(probe, "run string, region long, levels binary")
    runs = held_runs.where("region is null").select("run", "names", "sizes", "data")
    done = cut_lineage(runs.groupBy("run").cogroup(answers.groupBy("run")).applyInArrow(scored, _SCORED))
    shared.unpersist()
    return done


def score(documents: DataFrame, model: Model, smoothing: float = 200.0, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, n_known, train_tokens, base_score, score)`` for every document."""
    tokens, mass = model.tokens, float(model.tokens + model.vocabulary + 1)
    narrow = documents.select(F.col(id_column).cast("long").alias("doc_id"), whole_text(text_column).alias("text"))
    by = _score_by_region if isinstance(model.filter, SpreadFilter) else _score_by_broadcast
    done = by(narrow, model, mass, smoothing)
    done = done.withColumn("row", F.monotonically_increasing_id())  # stable: the rows lie in files now
    log = F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(mass))
    rare = (
        done.select("row", F.explode("rest").alias("word"))
        .groupBy("row", "word")
        .agg(F.count("*").alias("times"))
        .join(model.counts, "word", "left")
        .groupBy("row")
        .agg(F.sum(F.col("times") * log).alias("rare_base"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("rare_known"))
    )
    return done.join(rare, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"),
        "score",
    )


def held_out(identifier: Column) -> Column:
    """Whether a document is kept from training: checksum of its id as text, modulo 7, is 2."""
    return F.crc32(F.encode(F.coalesce(identifier.cast("string"), F.lit("")), "UTF-8")) % 7 == 2
