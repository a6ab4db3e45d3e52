"""Two-pass external shuffle of records into numbered shards.

First pass: a seeded hash scatters the records uniformly over buckets whose mean
size fits in memory. Second pass: each bucket is put in a fixed order and
shuffled by Fisher-Yates with a generator seeded by (seed, bucket). The buckets
one after the other are the shuffled order of all records; shards are equal runs
of that order, so their row counts differ by one at most (law ``rows``). The same
input, seed and bucket count give the same shards wherever and however often the
tasks run.

Where a bucket begins in the whole order is a running sum of bucket counts, taken
in two levels so that no task sees more than about the square root of the buckets.

Defined results: records with a null key are scattered by their other scatter
columns; identical records may land anywhere, each once; an empty table gives
empty shards; with more shards than records some shards stay empty. Columns named
like the result's (``shard``, ``slot``) are replaced by it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortwise.llm.common import cut_lineage, whole_text

_BUCKET, _PLACE = "__bucket", "__place"


def shuffle_into_shards(records: DataFrame, shards: int, scatter_by: Sequence[str], size: str, seed: int = 17, bucket_bytes: int = 32 << 20) -> DataFrame:
    """All columns of ``records`` and ``shard`` (from 0), ``slot`` (gapless from 0 within the shard).

    ``scatter_by`` are columns with scalar values that tell records apart; ``size``
    is a column with the bytes of a record, for buckets of ``bucket_bytes`` on average.
    """
    records = records.drop("shard", "slot", _BUCKET, _PLACE)
    spark = records.sparkSession
    total = records.agg(F.sum(size)).first()[0] or 0
    buckets = max(math.ceil(total / bucket_bytes), int(spark.conf.get("spark.sql.shuffle.partitions")))
    scattered = records.withColumn(_BUCKET, F.pmod(F.xxhash64(F.lit(seed), *scatter_by), F.lit(buckets)).cast("int"))
    schema = T.StructType([*scattered.schema.fields, T.StructField(_PLACE, T.LongType())])
    order = list(scatter_by)

    def fisher_yates(key: tuple[pa.Scalar, ...], bucket: pa.Table) -> pa.Table:
        at = pc.sort_indices(bucket.select(order), [(name, "ascending") for name in order])
        places = np.arange(len(bucket))
        np.random.default_rng([seed, key[0].as_py()]).shuffle(places)  # NumPy's shuffle is Fisher-Yates
        placed = np.empty_like(places)
        placed[at.to_numpy()] = places
        return bucket.append_column(_PLACE, pa.array(placed, pa.int64()))

    shuffled = scattered.groupBy(_BUCKET).applyInArrow(fisher_yates, schema)
    counts = cut_lineage(scattered.groupBy(_BUCKET).agg(F.count("*").alias("n")))
    rows = counts.agg(F.sum("n")).first()[0] or 0
    block = F.floor(F.col(_BUCKET) / F.lit(max(1, math.isqrt(buckets))))
    blocks = counts.groupBy(block.alias("block")).agg(F.sum("n").alias("n"))
    before_block = blocks.select("block", (F.sum("n").over(Window.orderBy("block")) - F.col("n")).alias("before_block"))
    inside = Window.partitionBy("block").orderBy(_BUCKET)
    begins = (
        counts.withColumn("block", block)
        .withColumn("inside", F.sum("n").over(inside) - F.col("n"))
        .join(before_block, "block")
        .select(_BUCKET, (F.col("before_block") + F.col("inside")).alias("__begin"))
    )
    # shard s holds the positions from floor(s * rows / shards) on
    shard = F.expr(f"((__begin + {_PLACE} + 1) * {shards} - 1) div {max(rows, 1)}").cast("int")
    first = F.expr(f"(shard * {rows}L) div {shards}")
    return (
        shuffled.join(F.broadcast(begins), _BUCKET)  # a row per bucket; the records stay where they are
        .withColumn("shard", shard)
        .withColumn("slot", F.col("__begin") + F.col(_PLACE) - first)
        .drop(_BUCKET, _PLACE, "__begin")
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, rows in slot order within each file; the order is kept in ``slot``.

    Buckets are written where they were shuffled: a shard has a file for each task with buckets of it.
    """
    sharded.sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)


def shard_documents(documents: DataFrame, shards: int, path: str) -> DataFrame:
    """Shuffle whole documents, write them to ``path``, and give the written table: all columns, ``shard`` and ``slot``."""
    names = [name for name in documents.columns if name not in ("shard", "slot")]
    keys = document_records(documents.withColumn("__at", F.struct(*names)), "__at")
    keys = keys.select("__at", *(F.col(name).alias(f"__{name}") for name in ("doc_id", "text_crc32", "size")))
    # records alike in these may differ in others; maps cannot be hashed
    others = [f"__at.`{f.name}`" for f in documents.schema if f.name in names and "map<" not in f.dataType.simpleString()]
    keys = keys.withColumn("__rest", F.xxhash64(*others))
    placed = shuffle_into_shards(keys, shards, ["__doc_id", "__text_crc32", "__size", "__rest"], "__size")
    sharded = placed.select("__at.*", "shard", "slot")
    write_shards(sharded, path)
    return documents.sparkSession.read.schema(sharded.schema).parquet(path)


def document_records(documents: DataFrame, *others: str) -> DataFrame:
    """``(doc_id, size, text_crc32)`` of whole texts, and the columns ``others``; the size counts UTF-8 bytes and 16 for the record."""
    text = whole_text()
    return documents.select(
        *others,
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + F.lit(16)).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
