"""Covariance of all pairs of columns in one pass.

Every task folds its rows into one packed Gram matrix per model (count, sums, and
the upper triangle of the products, block by block with NumPy on Arrow batches);
Spark adds these up, so the shuffle holds one packed row per task and model, and only one per
model is unfolded into pairs. Values are taken about a shift near their mean,
which keeps the one-pass formula exact.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _fold(width: int, shift: Mapping[str, Sequence[float]] | None):
    upper = np.triu_indices(width)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            model = np.array(batch.column("model").to_pylist(), object)
            z = batch.column("z").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
            for name in dict.fromkeys(model):
                block = z[model == name]
                if shift is not None:
                    block = block - np.asarray(shift[name])
                packed = np.concatenate([[len(block)], block.sum(axis=0), (block.T @ block)[upper]])
                sums[name] = sums[name] + packed if name in sums else packed
        if sums:
            values = np.stack(list(sums.values()))
            offsets = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.ListArray.from_arrays(offsets, values.ravel())], names=["model", "packed"])

    return fold


def covariance(rows: DataFrame, names: Sequence[str], shift: Mapping[str, Sequence[float]] | None = None, missing: Mapping[str, set[int]] | None = None) -> DataFrame:
    """``(model, row_term, column_term, n, covariance)`` for all pairs of the columns in the array ``z``, each pair once.

    ``missing`` names columns without values of their own; their pairs are null, as is everything of a model with one row.
    """
    width = len(names)
    partial = rows.select("model", "z").mapInArrow(_fold(width, shift), "model string, packed array<double>")
    merged = partial.groupBy("model").agg(vector_to_array(Summarizer.sum(array_to_vector("packed"))).alias("packed"))
    rows_, columns = np.triu_indices(width)
    pairs = F.array(*[F.struct(F.lit(int(i)).alias("i"), F.lit(int(j)).alias("j"), F.lit(1 + width + k).alias("at")) for k, (i, j) in enumerate(zip(rows_, columns))])
    cells = merged.select("model", "packed", F.inline(pairs))
    n, at = F.round(F.col("packed")[0]), lambda place: F.get("packed", place)
    value = (at(F.col("at")) - at(F.col("i") + 1) * at(F.col("j") + 1) / n) / (n - 1)
    labels = F.array(*map(F.lit, names))
    dropped = F.lit(False)
    for model, places in (missing or {}).items():
        if places:
            dropped |= (F.col("model") == model) & (F.col("i").isin(*places) | F.col("j").isin(*places))
    return cells.select(
        "model",
        F.get(labels, F.col("i")).alias("row_term"),
        F.get(labels, F.col("j")).alias("column_term"),
        n.cast("bigint").alias("n"),
        F.when(~dropped & (n > 1), value).alias("covariance"),
    )
