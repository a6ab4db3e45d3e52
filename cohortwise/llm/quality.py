"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document. All
votes of the corpus are counted by pattern (at most 3 to the number of
labellers), and expectation-maximisation over these counts estimates the share of
good documents and, for each labeller, how its votes fall on either class. The
posterior of a document's votes is its training label; a logistic scorer over
hashed features (character shapes, words, repetition) learns from a sample of
documents and judges every whole text.

The vote counts cover all documents. Only the scorer's training set is a sample:
about ``sample_rows`` documents, chosen by a hash of identifier and text.

Defined results: a null text counts as empty; empty texts are rejected; null ids
and repeated rows are judged like any other row (equal texts alike); an empty
table gives an empty result and a model that keeps everything. Columns besides id
and text are not read.
"""

from __future__ import annotations

import operator
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwise.llm.common import Memo, memory_returned, whole_text

GOOD, BAD, NONE = 1, 0, 2

_SHAPES, _WORDS, _BINS = 4096, 8192, 48
FEATURES = _SHAPES + _WORDS + _BINS


def _byte_classes() -> np.ndarray:
    """Sixteen kinds of bytes: letters by case, digits, white space, single punctuation marks, other ASCII, beyond ASCII."""
    kinds = np.full(256, 14, dtype=np.uint8)
    kinds[128:] = 0  # parts of letters beyond ASCII, nearly always lower case
    kinds[ord("a") : ord("z") + 1] = 0
    kinds[ord("A") : ord("Z") + 1] = 1
    kinds[ord("0") : ord("9") + 1] = 2
    kinds[[9, 11, 12, 13, 32]] = 3
    kinds[10] = 4
    for i, mark in enumerate((".", ",", "!", "?", "|", "'\"", "-", ":;", "()")):
        kinds[[ord(c) for c in mark]] = 5 + i
    kinds[:9] = kinds[14:32] = 15
    return kinds


_KINDS = _byte_classes()
#: Frequent function words of the corpus' languages.
_COMMON = frozenset("the of and to in a is that for it on with as be this are was de la le et les des en un une que el los y del die der und das ein den von zu mit".split())


@dataclass
class Statistics:
    """What the labellers and the scorer look at."""

    size: int
    kinds: np.ndarray
    words: list[bytes]
    distinct_words: int
    lines: int
    distinct_lines: int
    echoes: int
    raw: np.ndarray

    @classmethod
    def of(cls, text: str) -> Statistics:
        data = text.encode()
        raw = _KINDS[np.frombuffer(data, np.uint8)]
        words = data.split()
        lines = [line for line in data.split(b"\n") if line.strip()]
        return cls(len(data), np.bincount(raw, minlength=16), words, len(set(words)), len(lines), len(set(lines)), sum(map(operator.eq, words, islice(words, 1, None))), raw)


def _between(value: float, good: float, bad: float) -> int:
    """Good up to ``good``, bad from ``bad`` on (the other way round where good is larger), no vote between."""
    if good <= bad:
        return GOOD if value <= good else BAD if value >= bad else NONE
    return GOOD if value >= good else BAD if value <= bad else NONE


def symbols(s: Statistics) -> int:
    return _between((s.kinds[14] + s.kinds[15]) / max(s.size, 1), 0.02, 0.06)


def capitals(s: Statistics) -> int:
    return _between(s.kinds[1] / max(s.kinds[0] + s.kinds[1], 1), 0.12, 0.35)


def shouting(s: Statistics) -> int:
    return _between(s.kinds[7] / max(len(s.words), 1), 0.05, 0.3)


def separators(s: Statistics) -> int:
    alone = sum(1 for w in s.words if len(w) == 1 and not w.isalnum())
    return _between(alone / max(len(s.words), 1), 0.03, 0.15)


def repetition(s: Statistics) -> int:
    """Few different words for the length, by the square root that natural text stays above."""
    n = len(s.words)
    return NONE if n < 20 else _between(s.distinct_words / n**0.5, 2.5, 1.5)


def repeated_lines(s: Statistics) -> int:
    return NONE if s.lines < 4 else _between(s.distinct_lines / s.lines, 0.8, 0.5)


def echoes(s: Statistics) -> int:
    """Words that repeat the word before them."""
    return NONE if len(s.words) < 10 else _between(s.echoes / len(s.words), 0.08, 0.25)


def sentences(s: Statistics) -> int:
    """Marks that end a sentence for each twenty words or so."""
    n = len(s.words)
    return NONE if n < 20 else _between((s.kinds[5] + s.kinds[8]) / n, 0.03, 0.005)


def common_words(s: Statistics) -> int:
    n = len(s.words)
    if n < 20:
        return NONE
    found = sum(1 for w in s.words if w in _COMMON_BYTES)
    return _between(found / n, 0.06, 0.01)


_COMMON_BYTES = frozenset(w.encode() for w in _COMMON)
LABELLERS = (symbols, capitals, shouting, separators, repetition, repeated_lines, echoes, sentences, common_words)


@dataclass
class LabelModel:
    """Prior of good documents and shares ``tables[labeller, class, vote]`` among the votes given."""

    prior: float
    tables: np.ndarray
    rounds: int = 0

    @classmethod
    def fit(cls, patterns: np.ndarray, counts: np.ndarray, tolerance: float = 1e-8, most_rounds: int = 10_000) -> LabelModel:
        """EM over distinct vote patterns with their counts, from the majority vote on."""
        m = patterns.shape[1]
        good, bad = (patterns == GOOD).sum(1), (patterns == BAD).sum(1)
        # one bad vote weighs as much as several good ones: most labellers look for one fault each
        posterior = np.where(bad > 0, 0.25 / bad.clip(1), np.where(good > 0, 0.95, 0.5))
        one_hot = np.eye(3)[patterns][:, :, :2]  # labellers without a vote tell nothing
        tables, prior = np.zeros((m, 2, 2)), 0.5
        for rounds in range(1, most_rounds + 1):
            weight = np.stack([counts * (1 - posterior), counts * posterior])
            prior = float((weight[1].sum() + 1) / (counts.sum() + 2))
            tables = np.einsum("cp,pjv->jcv", weight, one_hot) + 1.0
            tables /= tables.sum(2, keepdims=True)
            before, posterior = posterior, cls(prior, tables).posterior(patterns)
            if np.abs(before - posterior).max(initial=0) < tolerance:
                return cls(prior, tables, rounds)
        raise RuntimeError(f"the label model did not settle within {most_rounds} rounds")

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of good for each row of votes."""
        logs = np.concatenate([np.log(self.tables), np.zeros((*self.tables.shape[:2], 1))], axis=2)
        per_class = logs[np.arange(patterns.shape[1])[None, :], :, patterns].sum(1)
        odds = per_class[:, 1] - per_class[:, 0] + np.log(self.prior) - np.log1p(-self.prior)
        return 1 / (1 + np.exp(-odds.clip(-500, 500)))

    def accuracies(self) -> np.ndarray:
        """Of each labeller: the share of right votes among its votes."""
        share = np.array([1 - self.prior, self.prior])
        right = share[0] * self.tables[:, 0, BAD] + share[1] * self.tables[:, 1, GOOD]
        wrong = share[0] * self.tables[:, 0, GOOD] + share[1] * self.tables[:, 1, BAD]
        return right / (right + wrong)


def features(s: Statistics, word_slot: Memo) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values: square roots of shares among hashed shapes (four kinds of bytes), hashed words, and repetition."""
    slots, values = [], []
    if len(s.raw) >= 4:
        r = s.raw.astype(np.uint32)
        code = (r[:-3] << 12) | (r[1:-2] << 8) | (r[2:-1] << 4) | r[3:]
        counts = np.bincount((code * np.uint32(40503) >> np.uint32(4)) & np.uint32(_SHAPES - 1), minlength=_SHAPES)
        at = counts.nonzero()[0]
        slots.append(at)
        values.append(np.sqrt(counts[at] / len(code)))
    n = len(s.words)
    if n:
        word_slot.ensure(set(s.words))
        counts = np.bincount(np.fromiter(map(word_slot.__getitem__, s.words), np.int64, n), minlength=_WORDS)
        at = counts.nonzero()[0]
        slots.append(at + _SHAPES)
        values.append(np.sqrt(counts[at] / n) * 0.5)
    repeated = int(min(15, 4 * s.distinct_words / max(n, 1) ** 0.5)) if n >= 20 else 15
    lines = 16 + (int(15 * s.distinct_lines / s.lines) if s.lines >= 4 else 15)
    echoed = 32 + (int(15 * s.echoes / n) if n >= 10 else 0)
    slots.append(np.array([repeated, lines, echoed]) + _SHAPES + _WORDS)
    values.append(np.ones(3))
    return np.concatenate(slots).astype(np.int32), np.concatenate(values).astype(np.float32)


def _word_slots() -> Memo:
    return Memo(lambda words: [zlib.crc32(w) % _WORDS for w in words])


def train_scorer(rows: np.ndarray, slots: np.ndarray, values: np.ndarray, target: np.ndarray, steps: int = 150, rate: float = 0.3, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model for soft targets, by Adam on the full batch."""
    n = max(len(target), 1)
    w, m, v = np.zeros(FEATURES + 1), np.zeros(FEATURES + 1), np.zeros(FEATURES + 1)
    for step in range(1, steps + 1):
        z = np.bincount(rows, w[slots] * values, minlength=len(target)) + w[-1]
        error = 1 / (1 + np.exp(-z.clip(-500, 500))) - target
        gradient = np.append(np.bincount(slots, error[rows] * values, minlength=FEATURES), error.sum()) / n + ridge * w
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


@dataclass
class QualityModel:
    label_model: LabelModel
    weights: np.ndarray
    bias: float


def _vote(s: Statistics) -> str:
    return "".join(str(labeller(s)) for labeller in LABELLERS)


def fit(documents: DataFrame, sample_rows: int = 3000, id_column: str = "doc_id", text_column: str = "text") -> QualityModel:
    """Label model from the votes on all documents, scorer from a hashed sample of about ``sample_rows`` of them."""
    narrow = documents.select(whole_text(text_column).alias("text"), F.xxhash64(F.col(id_column), whole_text(text_column)).alias("h"))

    @memory_returned
    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_vote(Statistics.of(t.as_py())) for t in batch.column("text")], pa.string())], names=["votes"])

    counted = narrow.select("text").mapInArrow(votes, "votes string").groupBy("votes").count().collect()  # at most 3 ** labellers rows
    if not counted:
        return QualityModel(LabelModel(0.5, np.full((len(LABELLERS), 2, 2), 0.5)), np.zeros(FEATURES), 1.0)
    patterns = np.array([[int(c) for c in row["votes"]] for row in counted])
    counts = np.array([row["count"] for row in counted], dtype=float)
    label_model = LabelModel.fit(patterns, counts)

    @memory_returned
    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _word_slots()
        for batch in batches:
            out = [[], [], []]
            for text in batch.column("text"):
                s = Statistics.of(text.as_py())
                at, value = features(s, memo)
                out[0].append(float(label_model.posterior(np.array([[int(c) for c in _vote(s)]]))[0]))
                out[1].append(at)
                out[2].append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.float64()), pa.array(out[1], pa.list_(pa.int32())), pa.array(out[2], pa.list_(pa.float32()))], names=["target", "slots", "values"])

    parts = max(1, round(counts.sum() / sample_rows))
    sample = narrow.where(F.pmod("h", F.lit(parts)) == 0).select("text").mapInArrow(examples, "target double, slots array<int>, values array<float>").collect()
    rows = np.repeat(np.arange(len(sample)), [len(x["slots"]) for x in sample])
    slots = np.concatenate([np.array(x["slots"], np.int64) for x in sample]) if sample else np.zeros(0, np.int64)
    values = np.concatenate([np.array(x["values"]) for x in sample]) if sample else np.zeros(0)
    weights, bias = train_scorer(rows, slots, values, np.array([x["target"] for x in sample]))
    return QualityModel(label_model, weights, bias)


def score(documents: DataFrame, model: QualityModel, threshold: float = 0.5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, votes, quality_score, kept)`` for every document."""
    weights, bias = model.weights, model.bias

    @memory_returned
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _word_slots()
        for batch in batches:
            votes, scores = [], []
            for text in batch.column("text"):
                s = Statistics.of(text.as_py())
                at, value = features(s, memo)
                votes.append(_vote(s))
                scores.append(float(1 / (1 + np.exp(-np.clip(weights[at] @ value + bias, -500, 500)))) if s.words else 0.0)
            kept = [x >= threshold for x in scores]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(votes, pa.string()), pa.array(scores, pa.float64()), pa.array(kept, pa.bool_())], names=["doc_id", "votes", "quality_score", "kept"])

    narrow = documents.select(F.col(id_column).cast("long").alias("doc_id"), whole_text(text_column).alias("text"))
    return narrow.mapInArrow(scored, "doc_id long, votes string, quality_score double, kept boolean")


def keep_good(documents: DataFrame, model: QualityModel, threshold: float = 0.5) -> DataFrame:
    """The documents that the scorer accepts, columns unchanged."""
    weights, bias = model.weights, model.bias

    @memory_returned
    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _word_slots()
        for batch in batches:
            keep = []
            for text in batch.column("text"):
                s = Statistics.of(text.as_py() or "")
                at, value = features(s, memo)
                keep.append(bool(s.words) and 1 / (1 + np.exp(-np.clip(weights[at] @ value + bias, -500, 500))) >= threshold)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return documents.mapInArrow(kept, documents.schema)
