"""Exact deduplication with keyed streaming state.

A stream of (digest, identifier, locator) rows is grouped by digest. The state
never expires and lives on disk (RocksDB, snapshots in the shared folder): for
each digest it keeps the largest identifier, the content locator that belongs to
it, and the number of rows. A digest alone proves nothing: wherever a row hits a
digest that is already there, ``deduplicate`` compares the full bytes. Texts that share a
digest and differ (none with SHA-256, many with a short digest) are then told
apart by their whole text.

``deduplicate`` runs the stream over a table in one go: it lands the narrow rows
in the shared folder, streams them with ``availableNow`` and reads the state.
``follow`` starts the same state on a stream that goes on; it never sees the texts
and verifies nothing, so unlike texts with one digest are merged there. Its locator
is the name of an input file and is not read back.

Copies are folded before each shuffle (the stream aggregates within its tasks
first; the byte check spreads a digest over ``spread`` parts), so a text that
makes up a third of all rows is no hot spot.

Defined results: a null text counts as empty; a row without identifier is a copy
like any other but never kept while its text has an identifier elsewhere;
repeated rows are copies of each other; an empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cohortwise.llm.common import cut_lineage, shared_folder, whole_text

#: The state lies in RocksDB; each of its many small files takes the room it needs and no more.
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def follow(arrivals: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep the state of a stream with ``digest``, ``id`` and ``locator`` under ``checkpoint``."""
    spark = arrivals.sparkSession
    before = {name: spark.conf.get(name, None) for name in _STATE}
    for name, value in _STATE.items():
        spark.conf.set(name, value)
    try:
        state = arrivals.groupBy("digest").agg(F.max(F.struct("id", "locator")).alias("keeper"), F.count("*").alias("rows"))
        writer = state.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint)
        return writer.trigger(**trigger).start()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value is not None else spark.conf.unset(name)


def read_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """``(digest, keep_id, locator, rows)`` as of the last batch."""
    value = spark.read.format("statestore").load(checkpoint)
    keeper, rows = value.schema["value"].dataType.names
    return value.select("key.digest", F.col(f"value.{keeper}.id").alias("keep_id"), F.col(f"value.{keeper}.locator").alias("locator"), F.col(f"value.{rows}").alias("rows"))


def deduplicate(documents: DataFrame, digest: Callable[[Column], Column] = sha256, id_column: str = "doc_id", text_column: str = "text", spread: int = 32) -> DataFrame:
    """``(doc_id, digest, keep_id, group_size, kept)`` for every row; of equal texts the largest id stays."""
    spark = documents.sparkSession
    folder = f"{shared_folder(spark)}/exact-dedup-{uuid.uuid4().hex}"
    text = whole_text(text_column)
    rows = documents.select(F.col(id_column).cast("long").alias("id"), digest(text).alias("digest"), text.alias("text"))
    landing = f"{folder}/landing"
    rows.select("id", "digest", F.input_file_name().alias("locator")).write.parquet(landing)
    landed = spark.read.parquet(landing)
    if landed.isEmpty():
        return spark.createDataFrame([], "doc_id long, digest string, keep_id long, group_size long, kept boolean")
    follow(spark.readStream.schema(landed.schema).parquet(landing), f"{folder}/state", availableNow=True).awaitTermination()
    state = cut_lineage(read_state(spark, f"{folder}/state"))

    # the byte check: all rows that hit a digest, folded to the least and greatest text of each digest
    part = F.pmod(F.xxhash64("id"), F.lit(spread))
    hits = state.where("rows > 1").select("digest", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(spread - 1).cast("long"))).alias("part"))
    hit_rows = rows.withColumn("part", part).join(hits, ["digest", "part"], "left_semi")
    bytes_differ = cut_lineage(
        hit_rows.groupBy("digest").agg(F.min("text").alias("least"), F.max("text").alias("greatest")).where("least <> greatest").select("digest")
    )
    if bytes_differ.isEmpty():
        classes = state.select("digest", "keep_id", F.col("rows").alias("group_size"))
        return _decide(landed.select("id", "digest").join(classes, "digest"))
    # unlike texts under one digest: their classes are the whole texts themselves
    alone = state.join(bytes_differ, "digest", "left_anti").select("digest", "keep_id", F.col("rows").alias("group_size"))
    clear = landed.select("id", "digest").join(alone, "digest")
    mixed = rows.join(bytes_differ, "digest", "left_semi")
    by_text = mixed.groupBy("digest", "text").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    return _decide(clear.unionByName(mixed.join(by_text, ["digest", "text"]).drop("text")))


def _decide(rows: DataFrame) -> DataFrame:
    kept = F.coalesce(F.col("id") == F.col("keep_id"), F.col("keep_id").isNull())
    return rows.select(F.col("id").alias("doc_id"), "digest", "keep_id", "group_size", kept.alias("kept"))


def drop_copies(documents: DataFrame) -> DataFrame:
    """The documents without their copies, columns unchanged; a row that is repeated as a whole stays once."""
    names = documents.columns
    identifier = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("__id")
    stays = deduplicate(documents).where("kept").select(identifier, F.col("digest").alias("__digest")).distinct()
    marked = documents.select("*", identifier, sha256(whole_text()).alias("__digest"))
    return marked.join(stays, ["__id", "__digest"], "left_semi").dropDuplicates(["__id", "__digest"]).select(*names)
