"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import string
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session without that setting (tests, one machine) gets a folder of its own;
    on a cluster the missing setting is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="shared-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there; survives the loss of any executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it from there: short lineage, columns can still be pruned."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def whole_text(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def memory_returned(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``task`` for ``mapInArrow``; what it has freed goes back to the system at its end.

    Spark keeps a Python worker for the tasks of later stages. Freed memory would stay with it, beside all that the
    next stage takes.
    """

    @wraps(task)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim:
                trim(0)

    return run


_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def ascii_lowered(text: str) -> str:
    """A-Z in lower case, all else as it stands."""
    return text.translate(_LOWER)


class Memo(dict):
    """A bounded memo in two generations: entries not used for a whole generation go.

    ``compute`` takes a list of keys and gives their values; at most ``2 * bound``
    entries are kept, and a few more while one document is worked on.
    """

    def __init__(self, compute: Callable[[list], Iterable], bound: int = 300_000):
        super().__init__()
        self._compute, self._bound, self._old = compute, bound, {}

    def __missing__(self, key):
        self._turn()
        value = self._old.get(key)
        if value is None:
            (value,) = self._compute([key])
        self[key] = value
        return value

    def _turn(self) -> None:
        if len(self) >= self._bound:
            self._old = dict(self)
            self.clear()

    def ensure(self, keys: Iterable) -> None:
        """Make ``self[key]`` a plain look-up for all ``keys`` until the next call."""
        self._turn()
        missing = []
        for key in keys:
            if key not in self:
                value = self._old.get(key)
                if value is None:
                    missing.append(key)
                else:
                    self[key] = value
        if missing:
            self.update(zip(missing, self._compute(missing)))
