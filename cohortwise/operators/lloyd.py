"""k-means for many streams, numbers of clusters and starts at once.

Every Lloyd step is one scan over the weighted activity patterns: tasks unfold bit
words to 0/1 rows in blocks, find the nearest centre of each fit that is still moving and
fold weights and sums per (fit, centre); Spark adds these up, and the driver sees
one packed row per fit (clusters x bins numbers, whatever the number of participants). Weights are whole
numbers, so the sums are exact and a fit ends when its sums repeat: every result
has converged, and does not depend on how the rows are dealt.

Starts are drawn by distance-weighted sampling from a bounded, hash-chosen sample of patterns per
stream (``sample_patterns``); all steps after that use all patterns. Given centres can be used instead.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwise.operators.patterns import bits, word_matrix

_BLOCK = 4096
#: Distances are compared to this many digits; the first of equally near centres wins.
DIGITS = 9
MAX_STEPS = 1000


@dataclass
class Fit:
    """One k-means model: centres, their weights, within sum of squares, and the steps it took."""

    stream: str
    k: int
    start: int
    centers: np.ndarray
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    wss: float = float("inf")
    steps: int = 0

    def names(self) -> list[str]:
        """C1 .. Ck by falling mean number of active bins, ties by centre."""
        order = sorted(range(len(self.centers)), key=lambda i: (-round(float(self.centers[i].sum()), 9), self.centers[i].tolist()))
        names = [""] * len(order)
        for place, i in enumerate(order):
            names[i] = f"C{place + 1}"
        return names


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    distance = (x * x).sum(1)[:, None] + (centers * centers).sum(1)[None, :] - 2.0 * x @ centers.T
    return np.argmin(np.round(distance, DIGITS), axis=1)


def _fold(moving: list[tuple[int, str, np.ndarray]], bins: Mapping[str, int]):
    """Partition function: packed weights and sums per fit and centre."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {number: np.zeros((len(centers), 1 + centers.shape[1])) for number, _, centers in moving}
        for batch in batches:
            streams = np.array(batch.column("stream").to_pylist(), object)
            for stream in dict.fromkeys(streams):
                fits = [(number, centers) for number, s, centers in moving if s == stream]
                chosen = np.flatnonzero(streams == stream)
                for first in range(0, len(chosen) if fits else 0, _BLOCK):
                    part = batch.take(pa.array(chosen[first : first + _BLOCK]))
                    x = bits(word_matrix(part.column("words")), bins[stream])
                    weight = part.column("weight").to_numpy()
                    rows = np.column_stack([np.ones(len(x)), x]) * weight[:, None]
                    for number, centers in fits:
                        label = nearest(x, centers)
                        member = label[None, :] == np.arange(len(centers))[:, None]
                        sums[number] += member.astype(float) @ rows
        used = [number for number in sums if sums[number].any()]
        if used:
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([sums[n].ravel() for n in used], pa.list_(pa.float64()))], names=["fit", "packed"])

    return fold


def _starts(patterns: DataFrame, bins: Mapping[str, int], ks: Sequence[int], starts: int, seed: int, sample_patterns: int) -> list[Fit]:
    fits = []
    key = F.xxhash64(F.lit(seed), "words")
    for stream, width in bins.items():
        sample = patterns.where(F.col("stream") == stream).orderBy(key, "words").limit(sample_patterns).toArrow()
        if not sample.num_rows:
            continue
        x = bits(word_matrix(sample["words"].combine_chunks()), width)
        weight = sample["weight"].to_numpy()
        for start in range(starts):
            rng = np.random.default_rng([seed, start, len(stream)])
            chosen, apart = [], None
            for _ in range(max(ks)):
                share = weight if apart is None else weight * apart
                if not share.any():
                    break
                chosen.append(int(rng.choice(len(x), p=share / share.sum())))
                gap = ((x - x[chosen[-1]]) ** 2).sum(1)
                apart = gap if apart is None else np.minimum(apart, gap)
            fits += [Fit(stream, k, start, x[chosen[:k]].copy()) for k in ks]
    return fits


def fit_all(
    patterns: DataFrame, bins: Mapping[str, int], ks: Sequence[int], starts: int = 1, seed: int = 1,
    centers: Mapping[str, np.ndarray] | None = None, sample_patterns: int = 4096,
) -> list[Fit]:
    """All models of ``(stream, words, weight)``, one scan a step for all of them together.

    Fewer centres than ``k`` where a stream has fewer patterns. ``centers`` gives the first centres of each stream.
    """
    if centers is None:
        fits = _starts(patterns, bins, ks, starts, seed, sample_patterns)
    else:
        fits = [Fit(stream, len(c), 0, np.asarray(c, float)) for stream, c in centers.items()]
    moving = dict(enumerate(fits))
    seen: dict[int, np.ndarray] = {}
    for step in range(MAX_STEPS):
        if not moving:
            return fits
        fold = _fold([(n, f.stream, f.centers) for n, f in moving.items()], bins)
        partial = patterns.select("stream", "words", "weight").mapInArrow(fold, "fit int, packed array<double>")
        merged = partial.groupBy("fit").agg(vector_to_array(Summarizer.sum(array_to_vector("packed"))).alias("packed")).collect()
        found = {row.fit: np.rint(np.array(row.packed)) for row in merged}
        for number in list(moving):
            fit = moving[number]
            sums = found.get(number, np.zeros(fit.centers.size + len(fit.centers))).reshape(len(fit.centers), -1)
            weights, ones = sums[:, 0], sums[:, 1:]
            used = weights > 0
            fit.weights, fit.steps = weights, step + 1
            fit.wss = float((ones[used].sum(1) - (ones[used] ** 2).sum(1) / weights[used]).sum())
            if number in seen and np.array_equal(seen[number], sums):
                del moving[number]
                continue
            seen[number] = sums
            fit.centers = fit.centers.copy()
            fit.centers[used] = ones[used] / weights[used][:, None]
    raise RuntimeError(f"no convergence in {MAX_STEPS} steps")


def best(fits: Sequence[Fit]) -> dict[tuple[str, int], Fit]:
    """For each stream and k the start with the least within sum of squares."""
    found: dict[tuple[str, int], Fit] = {}
    for fit in fits:
        held = found.get((fit.stream, fit.k))
        if held is None or fit.wss < held.wss - 1e-9:
            found[fit.stream, fit.k] = fit
    return found


def curve(patterns: DataFrame, fits: Sequence[Fit]) -> DataFrame:
    """``(stream, k, wss, steps)`` of the best start, one row a stream and number of clusters."""
    rows = [(f.stream, f.k, f.wss, f.steps) for f in best(fits).values()]
    return patterns.sparkSession.createDataFrame(rows, "stream string, k int, wss double, steps int")


def assign(rows: DataFrame, models: Mapping[str, Fit], bins: Mapping[str, int], keep: Sequence[str] = ("p_id",)) -> DataFrame:
    """``(keep, stream, raw_cluster, cluster)`` for rows with ``stream`` and ``words``; streams without a model are left out."""
    constants = {stream: (fit.centers, fit.names()) for stream, fit in models.items()}

    def labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            streams = np.array(batch.column("stream").to_pylist(), object)
            for stream in dict.fromkeys(streams):
                if stream not in constants:
                    continue
                centers, names = constants[stream]
                chosen = np.flatnonzero(streams == stream)
                for first in range(0, len(chosen), _BLOCK):
                    part = batch.take(pa.array(chosen[first : first + _BLOCK]))
                    label = nearest(bits(word_matrix(part.column("words")), bins[stream]), centers)
                    arrays = [part.column(c) for c in (*keep, "stream")]
                    yield pa.RecordBatch.from_arrays([*arrays, pa.array(label, pa.int32()), pa.array([names[i] for i in label])], names=[*keep, "stream", "raw_cluster", "cluster"])

    kept = rows.select(*keep, "stream", "words")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(labels, f"{schema}, raw_cluster int, cluster string")
