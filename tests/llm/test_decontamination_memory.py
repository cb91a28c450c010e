"""What a task of the decontamination holds does not grow with its batch."""

import tracemalloc

import numpy as np
import pyarrow as pa

from cuewise.llm import decontamination


class _Shared:
    def __init__(self, value):
        self.value = value


def test_a_large_batch_is_searched_in_bounded_memory():
    rng = np.random.default_rng(3)
    words = np.array([f"w{i}" for i in range(5_000)])
    texts = [" ".join(words[rng.integers(0, len(words), 100)]) for _ in range(3_000)]
    item = texts[1_234].encode().split()[20:60]
    directions = rng.standard_normal((decontamination.FEATURES, decontamination.RANK)).astype(np.float32)
    index = decontamination.Index([(7, item)], directions)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    tracemalloc.start()
    found = [r for b in decontamination._find(_Shared(index))(iter([batch])) for r in b.to_pylist()]
    kept = [i for b in decontamination._clean(_Shared(index))(iter([batch])) for i in b.column("doc_id").to_pylist()]
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(1_234, 7)}
    assert kept == [i for i in range(len(texts)) if i != 1_234]
    assert peak < 40, peak
