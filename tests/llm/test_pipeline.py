"""The stages on a small corpus: columns, what goes and what stays."""

import numpy as np
import pytest

pipeline = pytest.importorskip("corpus_pipeline")

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = np.random.default_rng(1)
    make = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 900, n))
    rows = [(i, make(80) + ("\n" + make(20)), "en", "a" if i % 3 else "b", 0) for i in range(150)]
    rows = [(i, t + " vilezz grumff vilezz" * (i % 5 == 0), *r) for i, t, *r in rows]
    rows += [(500 + k, rows[1][1], "en", "c", 0) for k in range(5)] + [(600, None, None, None, None), (601, "", "en", "a", 0)]
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(150)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages(spark, corpus, tmp_path):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    seen = {}
    for name, stage in pipeline.STAGES:
        stage(spark, docs, corpus).write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        if name != pipeline.STAGES[-1][0]:
            assert out.dtypes == docs.dtypes, name
        seen[name], docs = out.collect(), out
    ids = {r.doc_id for r in seen["toxicity"]}
    assert sum(i % 5 == 0 for i in range(150) if i in ids) <= 3 and sum(i % 5 != 0 for i in range(150) if i in ids) >= 117
    kept = {r.doc_id for r in seen["simhash_near_dedup"]}
    assert 1 in kept and not kept & set(range(500, 505))
    assert {r.doc_id for r in seen["packing"]} == {r.doc_id for r in seen["mixing"]}
    assert len(pipeline.STAGES) == 5 and pipeline.ORACLE_SQL is None


def test_run(spark, corpus):
    out = pipeline.run(spark, corpus)
    assert set(out.columns) >= {"doc_id", "piece", "sequence_id", "offset"} and out.count() > 0
