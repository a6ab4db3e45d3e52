"""The fold of a Cox step holds its sums and one batch, whatever the number of columns."""

import tracemalloc

import numpy as np
import pyarrow as pa

from cohortwise.operators.cox import _fold_partition, _Layout


def test_a_full_batch_takes_bounded_memory_and_gives_the_sums():
    rng = np.random.default_rng(2)
    rows, width = 10_000, 48
    x, beta = rng.integers(0, 2, (rows, width)).astype(float), rng.normal(0, 0.1, width)
    time, event = rng.integers(1, 31, rows), rng.integers(0, 2, rows)
    batch = pa.RecordBatch.from_arrays(
        [pa.array(["m"] * rows), pa.array([""] * rows), pa.array(time, pa.int32()), pa.array(event, pa.int32()), pa.ListArray.from_arrays(np.arange(0, rows * width + 1, width, dtype=np.int32), x.ravel())],
        names=["model", "stratum", "time", "event", "x"],
    )
    fold = _fold_partition({"m": (np.zeros(width), np.ones(width), beta)}, width)
    tracemalloc.start()
    found = pa.Table.from_batches(list(fold(iter([batch])))).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    print(f"peak {peak / 1e6:.0f} MB")
    assert peak < 40e6 and len(found) == 30
    at = time == found[3]["time"]
    parts = _Layout(width).unpack(np.array([found[3]["packed"]]))
    weight = np.exp(x[at] @ beta)
    np.testing.assert_allclose(parts["r2"][0], (x[at] * weight[:, None]).T @ x[at])
    np.testing.assert_allclose(parts["t1"][0], (weight * event[at]) @ x[at])
    np.testing.assert_allclose([parts["n"][0], parts["d"][0], *parts["sum_x"][0]], [at.sum(), event[at].sum(), *(event[at] @ x[at])])
