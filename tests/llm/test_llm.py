"""Each operator against a brute-force version, and the defined results of odd input."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from trellis.llm import embeddings, exact_dedup, lines, mixing, packing, sharding, simhash, substrings, toxicity, warc
from trellis.llm.common import components, numbered, running_total, shared_dir, unit_hash

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _key string, kept string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(t):
    return WORD.findall(t or "")


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{k}" for k in rng.integers(0, vocabulary, n))


@pytest.fixture(scope="module")
def rows():
    """Copies, near copies, shared passages and lines, a hot source, odd texts, nulls and repeated rows."""
    rng = np.random.default_rng(4)
    passage = sentence(rng, 60)
    out = []
    for i in range(120):
        t = sentence(rng, int(rng.integers(1, 160)))
        if i % 5 == 0:
            t += " " + passage + " " + sentence(rng, 9)
        if i % 4 == 0:
            t += "\nthe same long line stands in many of these texts of ours\nshort\none\ntwo\nthree"
        out.append((i, t))
    out += [(200 + k, out[7][1]) for k in range(15)]
    out += [(300 + k, out[11][1].replace("w1", "w2", 1)) for k in range(4)]
    out += [(400, None), (401, ""), (402, " \t \n"), (403, "a " * 5000), (404, "x\x0by z  w v"), (405, out[3][1]), (405, out[3][1]), (406, "\n\n\n"), (407, "lone")]
    return [(i, t, "en", None if i % 17 == 3 else "hot" if i % 3 == 0 else f"s{i % 5}", len(t or ""), "clash", "clash") for i, t in out] + [(None, "no id here", None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5).persist()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_running_total_and_components(spark):
    d = spark.range(500).select((F.col("id") % 3).alias("g"), "id", unit_hash("id").alias("u"), (F.col("id") % 7).alias("v"))
    got = running_total(d, ["g"], "u", ["id"], "v", "t", 16).collect()
    for g in range(3):
        part = sorted((r for r in got if r.g == g), key=lambda r: r.u)
        assert [r.t for r in part] == [sum(x.v for x in part[:k]) for k in range(len(part))]
    edges = [(5, 3), (3, 9), (9, 5), (20, 21), (22, 21), (22, 23), (7, 7), (40, 41)] + [(100, k) for k in range(101, 160)]
    assert dict(components(spark.createDataFrame(edges, "a long, b long")).collect()) == {3: 3, 5: 3, 9: 3, 20: 20, 21: 20, 22: 20, 23: 20, 40: 40, 41: 40} | {k: 100 for k in range(100, 160)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 1


def test_warc_round_trip(spark):
    big, same = "<p>é" * 900, "y" * 1500
    pages = [(1, "http://a", big), (2, None, same), (3, "http://c d", same), (4, "u", None), (5, "u", ""), (6, "u", "tiny"), (7, "u", "tiny"), (8, "u", same), (None, "u", "z" * 1200), (9, "u", "z" * 1200)]
    d = spark.createDataFrame(pages, "page_id long, url string, html string")
    folder = f"{shared_dir(spark)}/warc-test"
    p = warc.revisits(d)
    files = warc.write(p, folder, warc.train(d, "html"), roll=4000)
    got = {r.record_id: r for r in warc.read(files, with_payload=True).collect()}
    assert len(got) == len(pages) and files.count() > 1
    for page, _, html in pages:
        r = got[f"<urn:page:{page}>"] if page is not None else next(x for x in got.values() if x.record_id.startswith("<urn:uuid"))
        raw = (html or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        to = {2: 8, 3: 8}.get(page)
        assert (r.record_type, r.refers_to) == (("revisit", f"<urn:page:{to}>") if to else ("response", None))
        assert bytes(r.payload) == (b"" if to else raw)
    assert warc.read(warc.write(warc.revisits(d.limit(0)), folder)).count() == 0


def test_warc_reader_checks_frames():
    import io

    import zstandard

    raw = warc.record("response", 1, "http://a", b"hello", hashlib.sha1(b"hello").hexdigest())
    assert warc.parse(raw)["payload"] == b"hello"
    dictionary = zstandard.train_dictionary(2000, [f"record {k} hello hello {k * k}".encode() * 9 for k in range(400)])
    z = zstandard.ZstdCompressor(dict_data=dictionary)
    for body in (dictionary.as_bytes(), zstandard.compress(dictionary.as_bytes())):
        data = warc.DICTIONARY_MAGIC.to_bytes(4, "little") + len(body).to_bytes(4, "little") + body + z.compress(raw) * 3
        assert [x for _, x in warc.frames(io.BytesIO(data))] == [raw] * 3
        for cut in (data[:-3], data + b"rubbish!", data[:6]):
            with pytest.raises(ValueError):
                list(warc.frames(io.BytesIO(cut)))
    for bad in (raw.replace(b"WARC/1.1", b"WART/1.1"), raw[:-1], raw.replace(b"hello", b"hullo"), raw.replace(b"WARC-Date", b"X-Date"), raw.replace(b"Content-Length: 5\r", b"Content-Length: 6\r")):
        with pytest.raises(ValueError):
            warc.parse(bad)


# --- 2


def removed(texts, window):
    seen = Counter(tuple(w[k : k + window]) for w in texts for k in range(len(w) - window + 1))
    for w in texts:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        yield gone


@pytest.mark.parametrize("window", [35, 6])
def test_substrings(docs, rows, window):
    got = defaultdict(list)
    for r in substrings.cut(docs, window, with_text=True).collect():
        got[r.doc_id].append(r)
    texts = [words(r[1]) for r in rows]
    for r, w, gone in zip(rows, texts, removed(texts, window)):
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        for x in got[r[0]]:
            assert (x.n_words, x.n_removed, x.kept_text, x.kept_sha256) == (len(w), sum(gone), kept, hashlib.sha256(kept.encode()).hexdigest())
    assert sum(map(len, got.values())) == len(rows)


def test_substrings_periodic_and_empty(spark, none):
    d = spark.createDataFrame([(1, "a b " * 50), (2, "z " * 36), (3, " ".join(map(str, range(80))))], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substrings.cut(d).collect()} == {1: 100, 2: 36, 3: 0}
    assert substrings.cut(none).count() == 0


# --- 3


@pytest.mark.parametrize("least", [1, 2, 3, 5])
def test_lines(docs, rows, least):
    one = {(r[0], r[1]) for r in rows if r[1] is not None}
    order = sorted(one, key=lambda r: (r[0] is None, r[0] or 0))
    first, gone = {}, defaultdict(set)
    for i, t in order:
        x = t.split("\n")
        for depth in {1, least}:
            for p in range(len(x) - depth + 1):
                run = (depth, *x[p : p + depth])
                if depth == least or len(words(x[p])) >= 10:
                    if run in first:
                        gone[i, t] |= set(range(p, p + depth))
                    first.setdefault(run, (i, p))
    for r in lines.dedup(docs, least).collect():
        want = None if r.text is None else "\n".join(s for k, s in enumerate(r.text.split("\n")) if k not in gone[r.doc_id, r.text])
        assert r["__line_kept"] == want, r
        assert r["__line_count"] == (0 if r.text is None else r.text.count("\n") + 1)
    assert lines.dedup(docs).count() == len(rows)


def test_lines_keeps_columns(docs, none):
    out = lines.cleaned(docs)
    assert out.columns == docs.columns and {r["_key"] for r in out.collect()} == {"clash", None}
    assert lines.cleaned(none).count() == 0


# --- 4


def test_exact_dedup(spark, docs, rows, none):
    index = exact_dedup.DigestIndex(spark, "digests_test")
    index.drop()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    got = exact_dedup.dedup(docs, index).collect()
    least, size = {}, Counter(norm(r[1]) for r in rows)
    for r in rows:
        if r[0] is not None:
            least[norm(r[1])] = min(r[0], least.get(norm(r[1]), 10**9))
    want = Counter((r[0], least.get(norm(r[1])), size[norm(r[1])], r[0] == least.get(norm(r[1])), hashlib.sha256(norm(r[1]).encode()).hexdigest()) for r in rows)
    assert Counter(map(tuple, got)) == want
    later = spark.createDataFrame([(-5, rows[0][1]), (-6, "quite new"), (-7, "quite  new")], "doc_id long, text string")
    assert {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.dedup(later, index).collect()} == {-5: (0, False), -6: (-7, False), -7: (-7, True)}
    assert exact_dedup.dedup(none, index).count() == 0
    assert index.read().count() == len(size) + 1
    again = exact_dedup.DigestIndex(spark, "digests_test", bucket_digests=2)  # it grows with the next batch
    spark.sql(f"DROP TABLE digests_test_b{again.buckets}")  # as in another session, whose catalogue doesn't know it
    before = again.buckets
    assert {r.doc_id: r.keep_id for r in exact_dedup.dedup(later, again).collect()} == {-5: 0, -6: -7, -7: -7}
    assert again.buckets > before and again.read().count() == len(size) + 1
    again.drop()
    assert not again.exists() and exact_dedup.dedup(none, again).count() == 0
    again.drop()


def test_exact_dedup_hot_text(spark):
    d = spark.range(4000).select("id", F.when(F.col("id") % 2 == 0, "").otherwise(F.col("id").cast("string")).alias("text")).withColumnRenamed("id", "doc_id")
    index = exact_dedup.DigestIndex(spark, "digests_hot")
    found = exact_dedup.dedup(d, index)
    index.drop()
    assert found.where("kept").count() == 2001 and found.where("group_size = 2000 AND keep_id = 0").count() == 2000


# --- 5


def test_mixing(docs, rows, none):
    got = mixing.mix(docs, buckets=8).collect()
    size = defaultdict(int)
    for r in rows:
        size[r[3]] += len(words(r[1]))
    names = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5.0, 2.0, 1.0)[k % 3] for k, s in enumerate(names)}
    total, target, free = 1.5 * sum(size.values()), {}, set(names)
    while True:
        level = (total - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 2 * size[s]}
        if not over:
            break
        target |= {s: 2.0 * size[s] for s in over}
        free -= over
    target |= {s: weight[s] * level for s in free}
    taken = Counter()
    where = {(r[0], len(words(r[1]))): r[3] for r in rows}
    for r in got:
        s = where[r.doc_id, r.size]
        assert r.source_size == size[s] and r.target == pytest.approx(target[s])
        assert 0 <= r.taken <= 2 * r.size and r.taken == sum(x.words for x in r.laps)
        assert all(0 <= x.position <= 1 for x in r.laps)
        taken[s] += r.taken
    assert all(0 <= target[s] - taken[s] < 1 + 1e-6 for s in names)
    at = [r.position for r in got if r.position is not None]
    assert at == sorted(at) and len(got) == len(rows)
    key = lambda r: (str(r.doc_id), r.size, r.taken)
    again = mixing.mix(docs.repartition(3), buckets=8).collect()
    assert sorted(map(key, again)) == sorted(map(key, got))
    assert mixing.mix(none).count() == 0 and mixing.mixed(none).count() == 0


def test_mixing_schedules(spark):
    d = spark.createDataFrame([(i, "a b c d", "x" if i % 2 else None) for i in range(400)], "doc_id long, text string, source string")
    line = {"x": (0.0, 0.0, 3.0, 1.0), None: (2.0, 1.0, 0.0, 0.0)}
    got = mixing.mix(d, schedules=line, weights=(1.0,), budget=1.0).collect()
    for source, w in line.items():
        mine = sorted(r.position for r in got if (r.doc_id % 2 == 1) == (source == "x"))
        at = np.linspace(0, 1, len(w))
        t = np.linspace(0, 1, 3001)
        demand = np.concatenate(([0], np.cumsum(np.interp((t[1:] + t[:-1]) / 2, at, w))))
        assert np.allclose(np.interp(mine, t, demand / demand[-1]), np.arange(200) / 200, atol=2e-3)
        assert 0 <= mine[0] and mine[-1] <= 1
    with pytest.raises(ValueError):
        mixing.mix(d, schedules={"x": (0.0, 0.0)})


def test_rows_all_alike(spark):
    """Windows of rows that are all alike are cut up, in mixing and sharding."""
    d = spark.range(3000, numPartitions=6).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a b").alias("text"), F.lit("s").alias("source"))
    got = mixing.mix(d, budget=0.5, buckets=64).collect()
    assert sum(r.taken for r in got) == 3000 and {r.taken for r in got} == {0, 2}
    got = sharding.shards(d, 4, buckets=64).collect()
    assert sorted((r.shard, r.slot) for r in got) == [(s, k) for s in range(4) for k in range(750)]
    n = numbered(d, ["doc_id", "text"], "n").select("n").collect()
    assert sorted(r.n for r in n) == list(range(3000))


def test_mixed_documents(docs, rows):
    out = mixing.mixed(docs).collect()
    assert docs.columns == list(out[0].asDict()) and {r["_key"] for r in out} <= {"clash", None}
    whole = {r[1] for r in rows}
    cut = [r for r in out if r.text not in whole]
    assert len(cut) <= 2 * len({r[3] for r in rows})
    total = sum(len(words(r.text)) for r in out)
    assert total <= 1.5 * sum(len(words(r[1])) for r in rows) + 1


# --- 6


def test_embeddings(spark):
    rng = np.random.default_rng(8)
    v = rng.standard_normal((300, 16))
    v[100:140] = v[100] + 0.05 * rng.standard_normal((40, 16))
    v[200:230] = v[200] + np.linspace(0, 1.2, 30)[:, None] * rng.standard_normal(16)
    v[250:260] = v[5]
    vectors = [(i, [float(x) for x in a]) for i, a in enumerate(v)] + [(900, None), (901, [0.0] * 16), (902, [1.0, None] * 8), (903, [float("nan")] * 16), (904, [float("inf")] * 16), (905, []), (906, [1.0, 2.0])]
    d = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    u = np.array([np.array(x[1], np.float32) for x in vectors[:300]]).astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    for most in (2048, 16):
        got = {r.vec_id: r for r in embeddings.near_dedup(d, recall=0.999, most=most).collect()}
        n = np.array([got[i].n_links for i in range(300)])
        assert (n <= near.sum(1)).all() and n.sum() >= 0.98 * near.sum()
        assert [got[k].n_links for k in range(900, 907)] == [0] * 7 and all(got[k].kept for k in range(900, 907))
        assert {got[i].component_id for i in range(100, 140)} == {got[100].component_id}
        assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
        assert got[5].n_links >= 10
    assert embeddings.near_dedup(d.limit(0)).count() == 0


def test_embeddings_near_the_threshold(spark):
    """10,000 vectors, 1,500 pairs of cosines between 0.90 and 0.93, where hashing finds it hardest, and 300 just below."""
    rng = np.random.default_rng(21)
    n, d, pairs = 10_000, 32, 1800
    v = rng.standard_normal((n, d))
    v /= np.linalg.norm(v, axis=1)[:, None]
    for k in range(pairs):
        c = rng.uniform(0.9005, 0.93) if k < 1500 else rng.uniform(0.87, 0.899)
        o = v[5000 + k] - (v[5000 + k] @ v[k]) * v[k]
        v[5000 + k] = c * v[k] + np.sqrt(1 - c * c) * o / np.linalg.norm(o)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_dedup(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")).collect()}
    found = sum(got[5000 + k] == (1, k) for k in range(1500))
    assert found >= 0.9 * 1500 and sum(x[0] for x in got.values()) == 2 * found, found


# --- 7


def plain_fingerprint(t):
    import xxhash

    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    sh = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


@pytest.mark.parametrize("most", [64, 1])
def test_simhash(spark, most, docs, rows):
    rng = np.random.default_rng(2)
    base = [int(x) for x in rng.integers(0, 1 << 63, 40)]
    fps = base + [b ^ (1 << int(k)) ^ (1 << int(j)) for b, k, j in zip(base, rng.integers(0, 63, 40), rng.integers(0, 63, 40))]
    fps += [base[0] ^ (1 << k) for k in range(63)] + [base[1] ^ 7, base[1] ^ 31]
    got = {r.doc_id: r.component_id for r in simhash.groups(spark.createDataFrame(list(enumerate(fps)), "doc_id long, fp long"), most=most).collect()}
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert got == {i: find(i) for i in range(len(fps))}


def test_simhash_fingerprints(docs, rows, none):
    got = Counter((r.doc_id, r.fp % (1 << 64)) for r in simhash.fingerprints(docs).collect())
    assert got == Counter((r[0], plain_fingerprint(r[1])) for r in rows)
    kept = simhash.cleaned(docs)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns and 7 in ids and not set(range(200, 215)) & set(ids) and len(ids) == len(set(ids)) and 3 in ids and 405 not in ids
    assert simhash.cleaned(none).count() == 0 and simhash.groups(simhash.fingerprints(none)).count() == 0


def test_pivot_rows(spark):
    """Rows of fingerprints at most 2 bits apart differ by 2 at most in every coordinate, and agree in two groups."""
    rng = np.random.default_rng(12)
    a = [int(x) for x in rng.integers(-(1 << 62), 1 << 62, 200)]
    b = [x ^ (1 << int(i)) ^ (1 << int(j)) for x, i, j in zip(a, rng.integers(0, 62, 200), rng.integers(0, 62, 200))]
    d = spark.createDataFrame([(k, x) for k, x in enumerate(a + b)], "k long, fp long").select("k", simhash.pivot_row().alias("row")).select("k", "row", simhash.candidate_keys().alias("keys"))
    got = {r.k: r for r in d.collect()}
    assert len(got[0].row) == len(simhash.references()) == 45 and len(got[0]["keys"]) == 6
    for k in range(200):
        p, q = got[k], got[k + 200]
        assert max(abs(x - y) for x, y in zip(p.row, q.row)) <= 2 and any(x == y for x, y in zip(p["keys"], q["keys"]))
        assert p.row == [(x ^ a[k]).bit_count() if x ^ a[k] >= 0 else 64 - (~(x ^ a[k])).bit_count() for x in simhash.references()]


# --- 8


def test_packing(docs, rows, none):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(packing.vocabulary())
    marked = [(9000, "hello <|endoftext|> world", *rows[0][2:]), (9001, "<|endoftext|>", *rows[0][2:]), (9002, "a<|endoftext|><|endoftext|>b c", *rows[0][2:])]
    docs, rows = docs.unionByName(docs.sparkSession.createDataFrame(marked, DOCS)), rows + marked
    want = Counter()
    for r in rows:
        ids = np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % 64 or 64
        cuts = [0, *range(first, len(ids) + 1, 64)]
        want.update((r[0], k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:])))
    got = packing.pack(packing.pieces(docs, length=64), 64, slack=2, group=40, fan=2).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 64
    assert len(bins) <= -(-sum(r.length for r in got) // 64) * 1.1 + 2
    assert packing.pack(packing.pieces(none)).count() == 0


def test_packing_chunks_are_exact():
    tokenizers = pytest.importorskip("tokenizers")
    hypothesis = pytest.importorskip("hypothesis")
    from hypothesis import strategies as st

    chunks = packing.Chunks(packing.vocabulary())

    @hypothesis.settings(max_examples=300, deadline=None)
    @hypothesis.given(st.text(st.sampled_from("ab AZ09.,!'\n\t é¿ñ  中😀<|endoftext|>s"), max_size=40))
    def same(text):
        assert list(np.frombuffer(chunks.ids(text), "<u4")) == chunks.slow.encode(text, add_special_tokens=False).ids

    same()


# --- 9


def test_shards(docs, rows, none):
    got = sharding.shards(docs, 7, buckets=16).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and len(by) == 7
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    source = {(r[0], r[1]): r[3] for r in rows}
    hot = Counter(r.shard for r in got if any(k[0] == r.doc_id and v == "hot" for k, v in source.items()))
    assert max(hot.values()) - min(hot.get(s, 0) for s in range(7)) <= 3
    assert sharding.shards(none).count() == 0


# --- 10


def brute_marginals(e, moves):
    import itertools

    n = len(e)
    w = {s: sum(e[k] for k in range(n) if s[k]) + sum(moves[a][b] for a, b in zip(s, s[1:])) for s in itertools.product((0, 1), repeat=n)}
    z = sum(np.exp(v) for v in w.values())
    return np.array([sum(np.exp(v) for s, v in w.items() if s[k]) / z for k in range(n)])


def test_forward_backward():
    rng = np.random.default_rng(3)
    lengths = np.array([4, 0, 7, 1, 5])
    e, moves = rng.normal(size=lengths.sum()), rng.normal(size=(2, 2))
    a, b = toxicity.chains(e, lengths, moves)
    p = toxicity.sigmoid(a + b)
    at = 0
    for n in lengths:
        if n:
            assert np.allclose(p[at : at + n], brute_marginals(e[at : at + n], moves))
        at += n


def test_toxicity(spark, none):
    rng = np.random.default_rng(6)
    texts = []
    for i in range(400):
        w = sentence(rng, 60).split()
        if i % 4 == 0:
            for k in rng.integers(0, 60, 3):
                w[k] = ("Vilezz" + "abcdefgh"[int(rng.integers(0, 8))], "grumff!!")[int(rng.integers(0, 2))]
        texts.append((i, " ".join(w), "en", "s", 0, "clash", "clash"))
    odd = [(1000, None), (1001, ""), (1002, " \n"), (1003, "w1 " * 4000 + "grumff"), (None, "w3 w4")]
    d = spark.createDataFrame(texts + [(*x, None, None, None, None, None) for x in odd], DOCS)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(5, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.learn(d, labels)
    got = {r.doc_id: r for r in toxicity.score(d, model).collect()}
    assert len(got) == 405 and all(0 <= r.score <= 1 for r in got.values())
    wrong = sum((got[i].score >= 0.3) != (i % 4 == 0) for i in range(400))
    assert wrong <= 12
    assert got[1000].score == got[1001].score == got[1002].score < 0.3
    text = dict((x[0], x[1]) for x in texts)
    hits = [text[i][s.begin : s.end] for i in range(0, 400, 4) for s in got[i].spans]
    assert sum("vilezz" in h.lower() or "grumff" in h for h in hits) >= 0.95 * len(hits) > 100
    clean = toxicity.clean(d, model)
    assert clean.columns == d.columns and clean.count() == sum(r.score < 0.3 for r in got.values())
    flat = toxicity.learn(d, labels.where("toxic = 0"))
    assert {r.score < 0.3 for r in toxicity.score(d, flat).collect()} == {True}
    assert toxicity.score(none, model).count() == 0 and toxicity.learn(none, labels.limit(0)).score[3] < -5
