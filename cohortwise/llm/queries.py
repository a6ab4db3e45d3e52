"""One query per operator over the whole benchmark tables, and the pipeline.

Each takes (spark, folder of the tables) and returns the operator's full result
in the columns of its contract.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortwise.llm import bpe, embedding_dedup, exact_dedup, language_model, merkle, minhash, packing, periodic_runs, quality, repetition, secrets, sharding, url_filter
from cohortwise.llm.common import shared_folder


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return packing.pack(_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_cover_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Links of all vectors with a cosine of at least 0.98 within their label."""
    return embedding_dedup.near_vectors(_table(spark, folder, "embeddings"), 0.98)


def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Votes, score and decision of the weakly supervised quality scorer on every document."""
    documents = _table(spark, folder, "documents")
    return quality.score(documents, quality.fit(documents))


def op4_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """All documents written to shards 0 to 39 by the law ``rows``; the rows come from the files read back."""
    written = sharding.shard_documents(_table(spark, folder, "documents"), 40, f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}")
    placed = sharding.document_records(written, "shard", "slot").select("doc_id", "size", "text_crc32", "shard", "slot")
    return placed.withColumn("law", F.lit("rows")).withColumn("grown_shard", F.lit(None).cast("int"))


def op5_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Of equal texts the row with the largest id stays; one row per document."""
    return exact_dedup.deduplicate(_table(spark, folder, "documents")).withColumnRenamed("digest", "text_sha256")


# The rules of the benchmark query.
PAGE_RULES = (
    url_filter.Rule("allow", "com", "/"),
    url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"),
    url_filter.Rule("block", "net", "/fr/"),
)


def op6_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Host, path, longest fitting rule and verdict of every page."""
    return url_filter.judge(_table(spark, folder, "pages"), PAGE_RULES)


def op7_language_model(spark: SparkSession, folder: str) -> DataFrame:
    """Base and model score of every whole text; six of seven documents train."""
    documents = _table(spark, folder, "documents")
    model = language_model.train(documents.where(~language_model.held_out(F.col("doc_id"))))
    return language_model.score(documents, model).withColumn("held_out", language_model.held_out(F.col("doc_id")))


def op8_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of every whole text."""
    return secrets.report(secrets.scan(_table(spark, folder, "documents")))


def op9_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Encoding and decoding of every whole text, as digests."""
    return bpe.encode_digests(_table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate components of all whole texts on shingles of two words."""
    return minhash.near_duplicates(_table(spark, folder, "documents"), minhash.NearDuplicates(shingle=2, percent=80))


def op11_merkle(spark: SparkSession, folder: str) -> DataFrame:
    """Merkle proofs of all documents; where 5 divides the checksum of the id, the root is recomputed from a text with its A-Z lowered."""
    documents = _table(spark, folder, "documents")
    lowered = merkle.leaf([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), url_filter.lower_ascii(F.col("text"))])
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, lowered)
    proven = merkle.manifest(documents, carry={"tampered": tampered})
    folded = merkle.fold(F.coalesce("tampered", "leaf"), F.col("proof")).alias("folded_root")
    checked = proven.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), folded)
    return checked.withColumn("verified", F.col("folded_root") == F.col("root"))


def _planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """Words of a tenth of the documents repeat from a place on that follows from the id."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    first = g % n
    period = 1 + (n - first) // (3 + g % 8)
    places = np.arange(n)
    places[first:] = first + (places[first:] - first) % period
    return places


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Periodic runs of every whole text, the strongest of them, and the collapsed text as a digest."""
    found = periodic_runs.periodic_runs(_table(spark, folder, "documents"), change=_planted)
    listed = F.sha2(periodic_runs.listed(F.col("runs")), 256).alias("runs_sha256")
    digests = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), periodic_runs.strongest(F.col("runs")).alias("best"), listed, F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return digests.select("doc_id", "n_runs", "best.*", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_repetition(spark: SparkSession, folder: str) -> DataFrame:
    """Repetition coverage and verdict of every whole text."""
    return repetition.judge(_table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_cover_tree": op2_cover_tree,
    "op3_quality": op3_quality,
    "op4_sharding": op4_sharding,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_url_filter": op6_url_filter,
    "op7_language_model": op7_language_model,
    "op8_secret_scan": op8_secret_scan,
    "op9_bpe": op9_bpe,
    "op10_minhash": op10_minhash,
    "op11_merkle": op11_merkle,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_repetition": op13_repetition,
}
