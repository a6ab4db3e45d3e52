"""Workers serve many stages: what a stage has used goes back to the system with its tasks."""

import os
import re
from pathlib import Path

import corpus_pipeline
import pyarrow as pa

from cohortwise.llm import packing
from cohortwise.llm.common import memory_returned


def own_mb():
    return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024


def test_freed_memory_goes_back_at_the_end_of_a_task():
    last = []

    def task(batches):
        blocks = [bytes(1000) for _ in range(150_000)]
        last.append(bytes(1000))  # on top of the heap, so that nothing below goes back by itself
        for batch in batches:
            assert blocks
            yield batch

    before = own_mb()
    batch = pa.RecordBatch.from_arrays([pa.array([1])], names=["x"])
    assert list(task(iter([batch]))) == [batch] and own_mb() - before > 100
    assert list(memory_returned(task)(iter([batch]))) == [batch] and own_mb() - before < 40


def test_no_worker_keeps_the_encoder_of_the_pipeline(spark):
    def encoders(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([os.getpid()]), pa.array([packing.unit_encoder.cache_info().misses])], names=["pid", "made"])

    def made():
        return max(row["made"] for row in spark.range(0, 64, 1, 16).mapInArrow(encoders, "pid long, made long").collect())

    before = made()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(20)
    assert corpus_pipeline.packing_stage(spark, docs, "").count() >= 20
    assert made() == before
