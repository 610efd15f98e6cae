"""Prefixes of shingle sets are worked out a few sets at a time, whatever a batch holds."""

from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from memlake.llm import near_dedup


def test_a_large_batch_is_cut_and_nothing_is_lost():
    n, size = 3 * near_dedup.ROWS + 5, 10
    values = np.arange(n * size, dtype=np.int64)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * size), pa.array(values))], ["id", "shingles"])
    broadcast = lambda x: SimpleNamespace(value=x)
    sets = SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=SimpleNamespace(broadcast=broadcast)))
    sets.select = lambda *_: SimpleNamespace(mapInArrow=lambda run, _: list(run(iter([batch]))))
    got = near_dedup.prefixes(sets, np.zeros(near_dedup.COUNTERS, dtype=np.int32), 0.8)
    assert len(got) == 4 and max(len(set(b.column("id").to_pylist())) for b in got) == near_dedup.ROWS
    rows = pa.Table.from_batches(got)
    assert rows["shingle"].to_pylist() == [k * size + j for k in range(n) for j in range(3)]
    assert rows["pos"].to_pylist() == [0, 1, 2] * n and set(rows["n"].to_pylist()) == {size}
