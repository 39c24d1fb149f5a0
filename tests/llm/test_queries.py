"""Each query as it is registered, on the smallest tables: DuckDB's rows where there is SQL, else the contract's columns and invariants."""

import os
import re
import zlib
from collections import Counter

import pytest

from trellis.llm import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", list(registry.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    d, e = registry.QUERIES[name](spark, SF), duck.sql(registry.ORACLE_SQL[name])
    cols = sorted(d.columns)
    assert cols == sorted(e.columns)
    plain = lambda rows, names: Counter(tuple(None if v is None else str(v) for _, v in sorted(zip(names, r))) for r in rows)
    assert plain(d.collect(), d.columns) == plain(e.fetchall(), e.columns)


def rows(spark, name, columns):
    d = registry.QUERIES[name](spark, SF)
    assert set(columns.split()) <= set(d.columns)
    return d.collect()


def test_documents_queries(spark, duck):
    text = dict(duck.sql("select doc_id, coalesce(text, '') from documents").fetchall())
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t) for i, t in text.items()}
    got = {r.doc_id: r for r in rows(spark, "op2_substring_dedup", "doc_id n_words n_removed kept_sha256")}
    seen = Counter(tuple(w[k : k + 35]) for w in words.values() for k in range(len(w) - 34))
    for i, w in words.items():
        gone = {p for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for p in range(k, k + 35)}
        assert (got[i].n_words, got[i].n_removed) == (len(w), len(gone))
    got = {r.doc_id: r for r in rows(spark, "op5_mix_sources", "doc_id size source_size target taken")}
    assert {i: r.size for i, r in got.items()} == {i: len(w) for i, w in words.items()} and all(0 <= r.taken <= 2 * r.size for r in got.values())
    got = rows(spark, "op7_simhash_near_dedup", "doc_id fingerprint component_id")
    assert {r.doc_id for r in got} == set(text) and all(re.fullmatch("[0-9a-f]{16}", r.fingerprint) and r.component_id <= r.doc_id for r in got)
    same = {}
    assert all(same.setdefault(r.fingerprint, r.component_id) == r.component_id for r in got)
    got = rows(spark, "op8_best_fit_packing", "doc_id piece start length ids_crc32 sequence_id offset")
    used = Counter()
    for r in got:
        used[r.sequence_id] += r.length
    assert {r.doc_id for r in got} == set(text) and max(used.values()) <= 1024 and len(used) <= -(-sum(used.values()) // 1024) * 1.05 + 1
    got = {r.doc_id: r for r in rows(spark, "op9_shards", "doc_id size text_crc32 law shard slot grown_shard")}
    assert {i: (r.size, r.text_crc32) for i, r in got.items()} == {i: (len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in text.items()}
    got = {r.doc_id: r for r in rows(spark, "op10_toxicity", "doc_id held_out score predicted")}
    assert set(got) == set(text) and all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for i, r in got.items())


def test_embeddings_query(spark, duck):
    np = pytest.importorskip("numpy")
    ids, vectors = zip(*duck.sql("select vec_id, embedding from embeddings order by vec_id").fetchall())
    u = np.array(vectors, float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    got = {r.vec_id: r for r in rows(spark, "op6_embedding_near_dedup", "vec_id n_links component_id kept")}
    n = np.array([got[i].n_links for i in ids])
    assert (n <= near.sum(1)).all() and n.sum() >= 0.9 * near.sum() and all(r.kept == (r.vec_id == r.component_id) for r in got.values())
