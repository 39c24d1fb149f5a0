"""The pipeline's line dedup takes later copies of every line that has a word, however short."""

from collections import Counter

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_short_lines(spark):
    rows = [(i, f"own text {i}\n\nAll rights reserved.\nLes.\n\nmore of {i}\nLes.", "en", "a", 0) for i in range(20)]
    stage = dict(pipeline.STAGES)["line_dedup"]
    out = {r.doc_id: r.text for r in stage(spark, spark.createDataFrame(rows, DOCS), "").collect()}
    assert out == {i: f"own text {i}\nmore of {i}" for i in range(1, 20)} | {0: "own text 0\n\nAll rights reserved.\nLes.\n\nmore of 0"}
    left = Counter(line for t in out.values() for line in t.split("\n") if line.split())
    assert max(left.values()) == 1
