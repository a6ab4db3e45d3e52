"""Clusters around medoids: greedy build, then best swaps, over weighted activity patterns.

The distance of two patterns is the Euclidean one of their 0/1 vectors, the square
root of the number of bins that differ: a count of bits in the exclusive or of
their words. Every pattern is a candidate in each step. One pass over the patterns sums, by
candidate size, what sharing a bin and sharing a pair of bins can save at most; these
sums bound the value of every candidate from below. The candidates with the lowest bounds are weighed
against all patterns, then all others that the best of them does not rule out, so the result is that of weighing all.
Tasks hold blocks of bounded size and send on one sum per candidate and
medoid it could replace; no distance leaves a task. The steps of all streams
and numbers of clusters share their jobs. The driver sees the sums, a few candidates and the best one of each fit.

With few active bins a pattern, few candidates are left and the work grows with the number of different patterns; where
the bounds rule out nothing, it grows with its square, as the method does. Swaps go
on until none lowers the cost, without a cap; equal ones are decided by medoid, then by the patterns' order.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwise.functions.ordinal import with_positions
from cohortwise.operators.patterns import bits, word_matrix
from cohortwise.sources.durable import durable

BLOCK = 2048
_TILE = 256
_LEAST_GAIN = 1e-7
_SEEDS = 16
_PIECE = 16384
_PAIR_CELLS = 8_000_000  # cells of the tables of pairs of bins a stream, 8 bytes each; with more the bounds go by single bins
_PAIRS_A_PATTERN = 64


@dataclass
class Medoids:
    """Medoids of one stream and number of clusters; ``ids`` are places in the order of the stream's patterns."""

    stream: str
    k: int
    ids: list[int]
    words: np.ndarray
    cost: float = 0.0
    wss: float = 0.0
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    swaps: int = 0


def distances(some: np.ndarray, others: np.ndarray) -> np.ndarray:
    apart = np.zeros((len(some), len(others)), np.int64)
    for w in range(some.shape[1]):
        apart += np.bitwise_count(some[:, w].astype(np.uint64)[:, None] ^ others[:, w].astype(np.uint64)[None, :])
    return np.sqrt(apart)


def _blocks(patterns: DataFrame, block: int) -> DataFrame:
    """``(stream, block, ids, words, weights)``: patterns numbered in order, ``block`` of them to a row."""
    numbered = with_positions(patterns, [F.col("words")], ["stream"], "id").withColumn("block", F.expr(f"cast((id - 1) div {block} as int)"))

    def pack(part: pa.Table) -> pa.Table:
        part = part.sort_by("id")
        words = word_matrix(part["words"].combine_chunks())
        return pa.table({
            "stream": [part["stream"][0].as_py()], "block": pa.array([part["block"][0].as_py()], pa.int32()), "width": pa.array([words.shape[1]], pa.int32()),
            "ids": [part["id"].to_numpy().astype("<i8").tobytes()], "words": [words.astype("<i8").tobytes()], "weights": [part["weight"].to_numpy().astype("<f8").tobytes()],
        })

    packed = numbered.groupBy("stream", "block").applyInArrow(pack, "stream string, block int, width int, ids binary, words binary, weights binary")
    return durable(packed.repartition(2 * patterns.sparkSession.sparkContext.defaultParallelism, "stream", "block"))


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["words"], "<i8").reshape(-1, row["width"]), np.frombuffer(row["weights"], "<f8")


def _known(words: np.ndarray, medoids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distances of the nearest and second-nearest medoid and the place of the nearest."""
    beyond = np.full(len(words), np.inf)
    if not len(medoids):
        return beyond, beyond, np.zeros(len(words), np.int64)
    apart = distances(words, medoids)
    ordered = np.sort(apart, axis=1)
    return ordered[:, 0], ordered[:, 1] if len(medoids) > 1 else beyond, np.argmin(apart, axis=1)


def _members(x: np.ndarray, paired: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row and bin of each bit, and row and number of each pair of bits of a row."""
    row, at = np.nonzero(x)
    rows, pairs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for gap in range(1, int(x.sum(1).max(initial=0)) if paired else 0):
        same = np.flatnonzero(row[:-gap] == row[gap:])
        low, high = at[same], at[same + gap]
        rows.append(row[same])
        pairs.append(low * x.shape[1] - low * (low + 1) // 2 + high - low - 1)
    return row, at, np.concatenate(rows), np.concatenate(pairs)


def _bent(reach: np.ndarray, second: np.ndarray, size: np.ndarray, u: int, paired: bool) -> tuple[np.ndarray, ...]:
    """What a candidate of ``u`` bins costs patterns of ``size`` bins, at least, by the number ``o`` of bins they share.

    The cost ``min(distance, reach)`` is ``base`` at ``o`` = 0 and never below ``base + o * slope + o * (o - 1) / 2 * curve``. With
    ``reach`` taken away, the cost is higher by ``loss`` at ``o`` = 0 and never by less than ``loss - o * relief``.
    """
    most = np.minimum(size, u)

    def apart(o: int) -> np.ndarray:
        return np.sqrt(np.maximum(u + size - 2 * o, 0))

    def lost(o: int) -> np.ndarray:
        return np.clip(apart(o), reach, second) - reach if np.isfinite(reach).all() else np.zeros(len(size))

    base, loss = np.minimum(apart(0), reach), lost(0)
    slope, curve, relief = np.zeros(len(size)), np.zeros(len(size)), np.zeros(len(size))
    for o in range(1, int(most.max(initial=0)) + 1):
        fits = o <= most
        gone = np.where(fits, np.minimum(apart(o), reach) - base, 0.0)
        relief = np.maximum(relief, np.where(fits, (loss - lost(o)) / o, 0.0))
        if o == 1:
            slope = gone
        elif paired:
            curve = np.minimum(curve, np.where(fits, (gone - o * slope) / (o * (o - 1) / 2), 0.0))
        else:
            slope = np.minimum(slope, gone / o)
    return base, slope, curve, loss, relief


@dataclass
class _Shape:
    """Layout of the tables of one fit: by candidate size; size and bin; size and pair of bins; medoid and size; medoid, size and bin."""

    sizes: list[int]
    bins: int
    k: int
    paired: bool

    def views(self, flat: np.ndarray) -> list[np.ndarray]:
        n, pairs = len(self.sizes), self.bins * (self.bins - 1) // 2 if self.paired else 0
        shapes = [(1,), (n,), (n, self.bins), (n, pairs), (self.k, n), (self.k, n, self.bins)]
        ends = np.cumsum([int(np.prod(s)) for s in shapes])
        return [flat[e - int(np.prod(s)) : e].reshape(s) for s, e in zip(shapes, ends)]

    def length(self) -> int:
        n = len(self.sizes)
        return 1 + n * (1 + self.bins) * (1 + self.k) + (n * (self.bins * (self.bins - 1) // 2) if self.paired else 0)


def _fold(tables: dict, tasks: Mapping[str, list], shapes: Mapping[tuple, _Shape], row: dict, bins: Mapping[str, int]) -> None:
    """Add one block of patterns to the tables of its stream's fits."""
    stream = row["stream"]
    _, words, weight = _unpacked(row)
    x = bits(words, bins[stream])
    size = x.sum(1).astype(np.int64)
    held = _members(x, any(shapes[stream, n].paired for n, _, _ in tasks[stream]))
    for number, medoids, adding in tasks[stream]:
        shape = shapes[stream, number]
        if (stream, number) not in tables:
            tables[stream, number] = np.zeros(shape.length())
        total, h0, h1, h2, l0, lb = shape.views(tables[stream, number])
        near, second, owner = _known(words, medoids)
        if not adding:
            total += near @ weight
        kinds, kind = np.unique(np.stack([near, second if not adding else near, size], axis=1), axis=0, return_inverse=True)
        kind = kind.reshape(-1)
        at, bin_, pair_at, pair = held
        for i, u in enumerate(shape.sizes):
            base, slope, curve, loss, relief = (part[kind] * weight for part in _bent(kinds[:, 0], kinds[:, 1], kinds[:, 2].astype(np.int64), u, shape.paired))
            h0[i] += base.sum()
            h1[i] += np.bincount(bin_, slope[at], shape.bins)
            if shape.paired:
                h2[i] += np.bincount(pair, curve[pair_at], h2.shape[1])
            if shape.k:
                l0[:, i] += np.bincount(owner, loss, shape.k)
                lb[:, i] += np.bincount(owner[at] * shape.bins + bin_, relief[at], shape.k * shape.bins).reshape(shape.k, shape.bins)


def _tables(blocks: DataFrame, tasks: Mapping[str, list], shapes: Mapping[tuple, _Shape], bins: Mapping[str, int]) -> dict[tuple, np.ndarray]:
    """The tables of every fit, folded in the tasks, added up in pieces by Spark."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict = {}
        for batch in batches:
            for row in batch.to_pylist():
                _fold(tables, tasks, shapes, row, bins)
        for (stream, number), flat in tables.items():
            for piece in range(0, len(flat), _PIECE):
                if flat[piece : piece + _PIECE].any():
                    yield pa.RecordBatch.from_pylist([{"stream": stream, "fit": number, "piece": piece, "data": flat[piece : piece + _PIECE].tobytes()}], pa.schema([("stream", pa.string()), ("fit", pa.int32()), ("piece", pa.int32()), ("data", pa.binary())]))

    def add(part: pa.Table) -> pa.Table:
        data = sum(np.frombuffer(d, "<f8") for d in part["data"].to_pylist())
        return pa.table({"stream": [part["stream"][0].as_py()], "fit": pa.array([part["fit"][0].as_py()], pa.int32()), "piece": pa.array([part["piece"][0].as_py()], pa.int32()), "data": [data.tobytes()]})

    schema = "stream string, fit int, piece int, data binary"
    parts = blocks.where(F.col("stream").isin(*tasks)).mapInArrow(fold, schema).groupBy("stream", "fit", "piece").applyInArrow(add, schema)
    tables = {key: np.zeros(shape.length()) for key, shape in shapes.items()}
    for r in parts.toLocalIterator():
        data = np.frombuffer(r.data, "<f8")
        tables[r.stream, r.fit][r.piece : r.piece + len(data)] = data
    return tables


def _least(row: dict, tasks: Mapping[str, list], shapes: Mapping[tuple, _Shape], tables: Mapping[tuple, np.ndarray], bins: Mapping[str, int]):
    """Of each fit: number, and for each candidate of the block the least value that the tables allow, over all medoids."""
    stream = row["stream"]
    ids, words, _ = _unpacked(row)
    x = bits(words, bins[stream])
    size = x.sum(1).astype(np.int64)
    at, bin_, pair_at, pair = _members(x, any(shapes[stream, n].paired for n, _, _ in tasks[stream]))
    for number, _, adding in tasks[stream]:
        shape = shapes[stream, number]
        total, h0, h1, h2, l0, lb = shape.views(tables[stream, number])
        i = np.searchsorted(shape.sizes, size)
        least = h0[i] + np.bincount(at, h1[i[at], bin_], len(ids))
        if shape.paired:
            least += np.bincount(pair_at, h2[i[pair_at], pair], len(ids))
        if not adding:
            kept = np.array([np.maximum(l0[m, i] - np.bincount(at, lb[m, i[at], bin_], len(ids)), 0) for m in range(shape.k)])
            least += kept.min(0) - total[0]
        yield number, ids, words, least


def _values(words: np.ndarray, weight: np.ndarray, candidates: np.ndarray, medoids: np.ndarray, adding: bool) -> np.ndarray:
    """Exact part of a block in the value of each candidate, for each medoid it could replace (adding: one column)."""
    near, second, owner = _known(words, medoids)
    parts = []
    member = None if adding else (owner[:, None] == np.arange(len(medoids))[None, :]).astype(float)
    for first in range(0, len(candidates), _TILE):
        apart = distances(candidates[first : first + _TILE], words)
        shorter = np.minimum(apart, near)
        if adding:
            parts.append((shorter @ weight)[:, None])
        else:
            left = (np.minimum(apart, second) - shorter) * weight  # if the own medoid goes
            parts.append(((shorter - near) @ weight)[:, None] + left @ member)
    return np.concatenate(parts)


_SUMS = "stream string, fit int, medoid int, id long, value double"


def _sums(found: Mapping[tuple, tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for (stream, number, *_), (ids, values) in found.items():
        k = values.shape[1]
        yield pa.RecordBatch.from_arrays(
            [pa.array([stream] * values.size), pa.array(np.full(values.size, number, np.int32)), pa.array(np.tile(np.arange(k, dtype=np.int32), len(ids))), pa.array(np.repeat(ids, k)), pa.array(values.ravel())],
            names=["stream", "fit", "medoid", "id", "value"],
        )


def _winners(partial: DataFrame) -> dict[tuple, tuple[float, int, int]]:
    """Least (value, medoid, candidate) of each fit from partial sums."""
    summed = partial.groupBy("stream", "fit", "medoid", "id").agg(F.round(F.sum("value"), 7).alias("value"))
    least = summed.groupBy("stream", "fit").agg(F.min(F.struct("value", "medoid", "id")).alias("best")).collect()
    return {(r.stream, r.fit): tuple(r.best) for r in least}


def _weigh_few(blocks: DataFrame, tasks: Mapping[str, list], chosen: Mapping[tuple, tuple[np.ndarray, np.ndarray]]) -> dict[tuple, tuple[float, int, int]]:
    """Exact values of a few candidates ``(ids, words)`` of each fit against all patterns."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = {}
        for batch in batches:
            for row in batch.to_pylist():
                _, words, weight = _unpacked(row)
                for number, medoids, adding in tasks[row["stream"]]:
                    key = (row["stream"], number)
                    if key in chosen:
                        ids, candidates = chosen[key]
                        values = _values(words, weight, candidates, medoids, adding)
                        found[key] = (ids, found[key][1] + values if key in found else values)
        yield from _sums(found)

    return _winners(blocks.where(F.col("stream").isin(*{s for s, _ in chosen})).mapInArrow(weigh, _SUMS))


def _weigh_many(blocks: DataFrame, tasks: Mapping[str, list], chosen: DataFrame) -> dict[tuple, tuple[float, int, int]]:
    """Exact values of any number of candidates, in pairs of a block of patterns and a block of candidates."""
    names: dict[tuple, list[str]] = {}
    for r in chosen.select("stream", "fit", "part").collect():
        names.setdefault((r.stream, r.fit), []).append(r.part)
    lists = F.create_map(*[v for s in tasks for v in (F.lit(s), F.array(*[F.lit(f"{n}/{p}") for (t, n), parts in names.items() if t == s for p in parts]).cast("array<string>"))])
    total = sum(map(len, names.values()))
    points = blocks.where(F.col("stream").isin(*tasks)).withColumn("other", F.explode(F.try_element_at(lists, F.col("stream"))))
    points = points.repartition(max(blocks.rdd.getNumPartitions(), total), "stream", "block", "other")
    theirs = chosen.select(F.col("stream").alias("c_stream"), F.concat_ws("/", "fit", "part").alias("c_part"), F.col("fit"), F.col("ids").alias("c_ids"), F.col("words").alias("c_words"))
    pairs = points.join(theirs, (F.col("stream") == F.col("c_stream")) & (F.col("other") == F.col("c_part"))).drop("c_stream", "c_part")

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, words, weight = _unpacked(row)
                ids, candidates = np.frombuffer(row["c_ids"], "<i8"), np.frombuffer(row["c_words"], "<i8").reshape(-1, row["width"])
                medoids, adding = next((m, a) for n, m, a in tasks[row["stream"]] if n == row["fit"])
                yield from _sums({(row["stream"], row["fit"]): (ids, _values(words, weight, candidates, medoids, adding))})

    return _winners(pairs.mapInArrow(weigh, _SUMS))


def _seeds(blocks: DataFrame, tasks: Mapping[str, list], shapes: Mapping, tables: Mapping, bins: Mapping[str, int]) -> dict[tuple, tuple[np.ndarray, np.ndarray]]:
    """For each fit some candidates whose values may be lowest, a few of every task and of these a few."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict = {}
        for batch in batches:
            for row in batch.to_pylist():
                for number, ids, words, least in _least(row, tasks, shapes, tables, bins):
                    first = np.argsort(least, kind="stable")[:_SEEDS]
                    held = best.setdefault((row["stream"], number), [])
                    held += [(float(least[i]), int(ids[i]), words[i].tolist()) for i in first]
                    best[row["stream"], number] = sorted(held)[:_SEEDS]
        for (stream, number), held in best.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([stream] * len(held)), pa.array([number] * len(held), pa.int32()), *(pa.array(part, kind) for part, kind in zip(zip(*held), (pa.float64(), pa.int64(), pa.list_(pa.int64()))))],
                names=["stream", "fit", "least", "id", "words"],
            )

    rows: dict[tuple, list] = {}
    for r in blocks.where(F.col("stream").isin(*tasks)).mapInArrow(pick, "stream string, fit int, least double, id long, words array<long>").collect():
        rows.setdefault((r.stream, r.fit), []).append((r.least, r.id, r.words))
    firsts = {key: sorted(held)[:_SEEDS] for key, held in rows.items()}
    return {key: (np.array([i for _, i, _ in held]), np.array([w for _, _, w in held], np.int64)) for key, held in firsts.items()}


def _rest(blocks: DataFrame, tasks: Mapping[str, list], shapes: Mapping, tables: Mapping, bins: Mapping[str, int], limits: Mapping[tuple, float], seen: Mapping[tuple, tuple]) -> DataFrame:
    """``(stream, fit, part, n, ids, words)``: all other candidates that the tables do not rule out, in packs of bounded size, written down."""
    known = {key: ids for key, (ids, _) in seen.items()}
    block = BLOCK

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        done: dict = {}

        def packed(key: tuple, least: int) -> Iterator[pa.RecordBatch]:
            ids, words = (np.concatenate([part[i] for part in held[key]]) for i in (0, 1))
            while len(ids) >= least and len(ids):
                done[key] = done.get(key, 0) + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key[0]]), pa.array([key[1]], pa.int32()), pa.array([f"{TaskContext.get().partitionId()}-{done[key]}"]), pa.array([len(ids[:block])]), pa.array([ids[:block].tobytes()]), pa.array([words[:block].tobytes()])],
                    names=["stream", "fit", "part", "n", "ids", "words"],
                )
                ids, words = ids[block:], words[block:]
            held[key] = [(ids, words)]

        for batch in batches:
            for row in batch.to_pylist():
                for number, ids, words, least in _least(row, tasks, shapes, tables, bins):
                    key = (row["stream"], number)
                    keep = np.flatnonzero((least <= limits[key]) & ~np.isin(ids, known[key]))
                    if len(keep):
                        held.setdefault(key, []).append((ids[keep], words[keep]))
                        yield from packed(key, block)
        for key in list(held):
            yield from packed(key, 1)

    return durable(blocks.where(F.col("stream").isin(*tasks)).mapInArrow(sift, "stream string, fit int, part string, n long, ids binary, words binary"))


def _best(blocks: DataFrame, tasks: Mapping[str, list], sizes: Mapping[str, list[int]], pairs: Mapping[str, float], bins: Mapping[str, int], few: int) -> dict[tuple, tuple[float, int, int]]:
    """For each (stream, fit) the least value with the medoid replaced and the candidate.

    ``tasks`` has fit, medoids and whether one is added. Sums over bins and pairs of bins, taken in one pass, bound the value of every
    candidate from below; only candidates that the bound cannot rule out are weighed against all patterns.
    """
    shapes = {}
    for s, fits in tasks.items():
        cells = len(fits) * len(sizes[s]) * bins[s] * (bins[s] - 1) // 2
        for number, medoids, adding in fits:
            shapes[s, number] = _Shape(sizes[s], bins[s], 0 if adding else len(medoids), cells <= _PAIR_CELLS and pairs[s] <= _PAIRS_A_PATTERN)
    tables = _tables(blocks, tasks, shapes, bins)
    seen = _seeds(blocks, tasks, shapes, tables, bins)
    best = _weigh_few(blocks, tasks, seen)
    limits = {}
    for s, fits in tasks.items():
        for number, _, adding in fits:
            total, h0, *_ = shapes[s, number].views(tables[s, number])
            value = best[s, number][0] if adding else min(best[s, number][0], -_LEAST_GAIN)
            limits[s, number] = value + 1e-6 + 1e-11 * (abs(total[0]) + h0.max())  # the tables are sums of doubles
    rest = _rest(blocks, tasks, shapes, tables, bins, limits, seen)
    left = {(r.stream, r.fit): r.n for r in rest.groupBy("stream", "fit").agg(F.sum("n").alias("n")).collect()}
    more: list[dict] = []
    small = [key for key, n in left.items() if n <= few]
    if small:
        listed: dict[tuple, list] = {}
        for r in rest.collect() if len(small) == len(left) else rest.where(F.concat_ws("/", "stream", "fit").isin(*[f"{s}/{n}" for s, n in small])).collect():
            ids = np.frombuffer(r.ids, "<i8")
            listed.setdefault((r.stream, r.fit), []).append((ids, np.frombuffer(r.words, "<i8").reshape(len(ids), -1)))
        more.append(_weigh_few(blocks, tasks, {key: tuple(np.concatenate(part) for part in zip(*packs)) for key, packs in listed.items()}))
    large = [f"{s}/{n}" for s, n in left if (s, n) not in small]
    if large:
        more.append(_weigh_many(blocks, tasks, rest.where(F.concat_ws("/", "stream", "fit").isin(*large))))
    for found in more:
        best |= {key: min(best[key], value) for key, value in found.items()}
    return best


def _words_of(blocks: DataFrame, wanted: Mapping[str, set[int]], block: int) -> dict[tuple[str, int], np.ndarray]:
    """The words of a few patterns, from their blocks."""
    test = F.lit(False)
    for stream, ids in wanted.items():
        test |= (F.col("stream") == stream) & F.col("block").isin(*sorted({(i - 1) // block for i in ids}))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, words, _ = _unpacked(row)
                at = np.flatnonzero(np.isin(ids, sorted(wanted[row["stream"]])))
                yield pa.RecordBatch.from_arrays([pa.array([row["stream"]] * len(at), pa.string()), pa.array(ids[at]), pa.array([words[i] for i in at], pa.list_(pa.int64()))], names=["stream", "id", "words"])

    found = blocks.where(test).mapInArrow(fetch, "stream string, id long, words array<long>").collect()
    return {(r.stream, r.id): np.array(r.words, np.int64) for r in found}


def _measured(blocks: DataFrame, fits: list[Medoids], bins: Mapping[str, int]) -> None:
    """Weights, cost and within sum of squares of all fits, in one pass."""
    constants = [(n, f.stream, f.words) for n, f in enumerate(fits)]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, words, weight = _unpacked(row)
                x = bits(words, bins[row["stream"]])
                for number, stream, medoids in constants:
                    if stream != row["stream"]:
                        continue
                    apart = distances(words, medoids)
                    label = np.argmin(apart, axis=1)
                    member = (label[None, :] == np.arange(len(medoids))[:, None]) * weight
                    cost = member @ apart.min(1)
                    ones = member @ x
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([number] * len(medoids), pa.int32()), pa.array(range(len(medoids)), pa.int32()), pa.array(member.sum(1)), pa.array(cost), pa.array(list(ones), pa.list_(pa.float64()))],
                        names=["fit", "cluster", "weight", "cost", "ones"],
                    )

    rows = blocks.mapInArrow(fold, "fit int, cluster int, weight double, cost double, ones array<double>")
    cells = rows.select("fit", "cluster", F.posexplode(F.concat(F.array("weight", "cost"), "ones")).alias("at", "value"))
    summed = cells.groupBy("fit", "cluster", "at").agg(F.sum("value").alias("value")).collect()  # fits x clusters x bins
    for number, fit in enumerate(fits):
        table = np.zeros((len(fit.ids), 2 + bins[fit.stream]))
        for r in summed:
            if r.fit == number:
                table[r.cluster, r["at"]] = r.value
        weights, ones = np.rint(table[:, 0]), np.rint(table[:, 2:])
        used = weights > 0
        fit.weights, fit.cost = weights, float(table[:, 1].sum())
        fit.wss = float((ones[used].sum(1) - (ones[used] ** 2).sum(1) / weights[used]).sum())


def fit_medoids(patterns: DataFrame, bins: Mapping[str, int], k_max: int = 10, block: int = BLOCK, few: int = 1024) -> list[Medoids]:
    """Medoids for k = 1 .. ``k_max`` of each stream of ``(stream, words, weight)``; no more than there are patterns.

    Up to ``few`` candidates of a fit are weighed from a list that every task gets, more of them in pairs of blocks.
    """
    blocks = _blocks(patterns, block)
    size = F.aggregate("words", F.lit(0), lambda total, word: total + F.bit_count(word))
    sizes, pairs = {}, {}
    for r in patterns.groupBy("stream").agg(F.sort_array(F.collect_set(size)).alias("sizes"), F.avg(size * (size - 1) / 2).alias("pairs")).collect():
        sizes[r.stream], pairs[r.stream] = list(r.sizes), r.pairs
    if not sizes:
        return []
    built: dict[str, list[int]] = {s: [] for s in sizes}
    words: dict[tuple[str, int], np.ndarray] = {}
    table = lambda s, ids: np.stack([words[s, i] for i in ids]) if ids else np.zeros((0, 1), np.int64)
    growing = set(sizes)
    for _ in range(k_max):
        best = _best(blocks, {s: [(0, table(s, built[s]), True)] for s in growing}, sizes, pairs, bins, few)
        new = {s: {best[s, 0][2]} for s in growing if best[s, 0][2] not in built[s]}  # a known one again: nothing is left to gain
        growing &= set(new)
        if not growing:
            break
        words |= _words_of(blocks, new, block)
        for s in growing:
            built[s] += new[s]
    fits = [Medoids(s, k, ids[:k], table(s, ids[:k])) for s, ids in built.items() for k in range(1, len(ids) + 1)]
    moving = [f for f in fits if f.k > 1]
    while moving:
        tasks: dict[str, list] = {}
        for f in moving:
            tasks.setdefault(f.stream, []).append((f.k, f.words, False))
        best = _best(blocks, tasks, sizes, pairs, bins, few)
        chosen = {}
        for f in moving:
            gain, medoid, candidate = best[f.stream, f.k]
            if gain < -_LEAST_GAIN:
                chosen[f.stream, f.k] = (medoid, candidate)
        wanted: dict[str, set[int]] = {}
        for (s, _), (_, candidate) in chosen.items():
            wanted.setdefault(s, set()).add(candidate)
        if wanted:
            words |= _words_of(blocks, wanted, block)
        moving = [f for f in moving if (f.stream, f.k) in chosen]
        for f in moving:
            medoid, candidate = chosen[f.stream, f.k]
            f.ids[medoid], f.swaps = candidate, f.swaps + 1
            f.words = table(f.stream, f.ids)
    for f in fits:
        f.ids = sorted(f.ids)
        f.words = table(f.stream, f.ids)
    _measured(blocks, fits, bins)
    return fits


def curve(patterns: DataFrame, fits: list[Medoids]) -> DataFrame:
    """``(stream, k, cost, wss, swaps)``: the elbow curve."""
    return patterns.sparkSession.createDataFrame([(f.stream, f.k, f.cost, f.wss, f.swaps) for f in fits], "stream string, k int, cost double, wss double, swaps int")


def medoid_table(patterns: DataFrame, fits: list[Medoids], bins: Mapping[str, int]) -> DataFrame:
    """``(stream, k, medoid, size)``: the patterns of the medoids as texts of 0 and 1, with the participants around them."""
    rows = [(f.stream, f.k, "".join(str(int(b)) for b in bits(w[None, :], bins[f.stream])[0]), int(n)) for f in fits for w, n in zip(f.words, f.weights)]
    return patterns.sparkSession.createDataFrame(rows, "stream string, k int, medoid string, size long")
