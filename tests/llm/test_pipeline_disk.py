"""What the near-dedup and mixing stages write: rows of keys, staged tables, exchanges of texts."""

import os
import re

import numpy as np
import pytest

wide = pytest.importorskip("trellis.llm.simhash_wide")
pipeline = pytest.importorskip("corpus_pipeline")

from trellis.llm import mixing, simhash  # noqa: E402
from trellis.llm.common import scratch_dir, staged  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_rows_that_share_a_key_by_chance_go(spark):
    rng = np.random.default_rng(4)
    rows = []
    for key, n in enumerate([1, 2, 3, 40, 200] * 60):
        bits = rng.integers(-(1 << 63), 1 << 63, (n, 2))
        for k in range(1, n, 3):  # near the one before
            bits[k] = [bits[k - 1, c] ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 36), replace=False)) for c in range(2)]
        rows += [(key, len(rows) + k, int(rng.choice([5, 90, 100, 140])), int(b), int(c)) for k, (b, c) in enumerate(bits)]
    want = set()
    for key in range(300):
        own = [r for r in rows if r[0] == key]
        alike = lambda a, b: min(a[2], b[2]) >= 0.8 * max(a[2], b[2]) - 0.5 and (min(a[2], b[2]) < wide.FEW or sum(bin((a[c] ^ b[c]) & (1 << 64) - 1).count("1") for c in (3, 4)) <= wide.OWN)
        want |= {(key, a[1]) for a in own if len(own) > 64 or any(a is not b and alike(a, b) for b in own)}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = [tuple(r) for r in wide._partnered(spark.createDataFrame(rows, "key long, node long, size int, one long, two long"), 0.8, 64).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(set(got)) and set(got) == want
    few = [r for r in rows if r[2] >= wide.FEW and r[0] % 5 == 1]
    assert len([r for r in few if (r[0], r[1]) in want]) < len(few)


def test_near_dedup_leaves_no_large_tables(spark):
    rng = np.random.default_rng(6)
    base = [f"w{k}" for k in range(200)]
    rows = [(i, " ".join([*base[: 180 - i % 40], *(f"x{k}" for k in rng.integers(0, 1 << 30, i % 40))]), "en", "a", 0) for i in range(120)]
    docs = spark.createDataFrame(rows, DOCS)
    names = lambda: {x for x in os.listdir(scratch_dir(spark).removeprefix("file://")) if x.split("-")[0] in ("pivots", "reps", "keys", "shared", "wanted", "sets", "counts", "hubs")}
    staged(docs, "there")
    before = names()
    out = simhash.cleaned(docs)
    assert names() == before
    assert 0 < out.count() < 120


def test_mixing_sends_texts_twice(spark, tmp_path):
    spark.createDataFrame([(i if i % 7 else None, f"a b c {i}", "en", "s" if i % 2 else None, 0) for i in range(50)], DOCS).write.parquet(f"{tmp_path}/d")
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = mixing.mixed(spark.read.parquet(f"{tmp_path}/d"))._jdf.queryExecution().explainString(mode)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(re.findall(r"\) Exchange\nInput \[\d+\]: \[[^\n]*\btext#", plan)) == 2  # to its laps, and into order
