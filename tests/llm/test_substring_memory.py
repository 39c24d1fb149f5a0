"""What one task of the substring dedup holds at once while it hashes texts of ordinary length."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

substrings = pytest.importorskip("trellis.llm.substrings")


def test_hashing_holds_little():
    rng = np.random.default_rng(8)
    words = [f"word{k}" for k in range(5000)]
    texts = pa.array([" ".join(words[k] for k in rng.integers(0, 5000, 300)) for _ in range(2500)])  # 6 MB
    tracemalloc.start()
    try:
        h, n = substrings.Hashes(), 0
        for _, data, offsets in substrings.slices(texts):
            counts, *_ = substrings.leaves(h, data, offsets, 35, 8)
            n += int(counts.sum())
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n == 750_000
    print(f"{most / 1e6:.0f} MB")
    assert most < 100_000_000
