"""Different activity patterns of the data streams with the number of participants that share them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwise.operators.grid import WORD, word_names
from cohortwise.sources.durable import durable


def stream_rows(wide: DataFrame, bins: Mapping[str, int], keep: Sequence[str] = ("p_id",)) -> DataFrame:
    """``(keep, stream, words)`` from words side by side (``<stream>_w0``, ...), unfolded in place."""
    cells = [F.struct(F.lit(s).alias("stream"), F.array(*[F.col(w) for w in word_names(n, f"{s}_w")]).alias("words")) for s, n in bins.items()]
    return wide.select(*keep, F.inline(F.array(*cells)))


def weighted_patterns(rows: DataFrame) -> DataFrame:
    """``(stream, words, weight)``, written down: all iterations run over patterns, not participants."""
    return durable(rows.groupBy("stream", "words").agg(F.count(F.lit(1)).cast("double").alias("weight")))


def word_matrix(words: pa.Array) -> np.ndarray:
    """One row of words for each pattern."""
    flat = words.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(words), -1)


def bits(words: np.ndarray, bins: int) -> np.ndarray:
    """0/1 matrix of patterns and bins."""
    assert words.shape[1] * WORD >= bins
    return np.unpackbits(np.ascontiguousarray(words.astype("<i8")).view(np.uint8).reshape(len(words), -1), axis=1, bitorder="little")[:, :bins].astype(float)
