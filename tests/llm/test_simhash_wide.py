"""Near copies at similarity 0.8 to 0.95, which differ in more than 2 bits of their fingerprints, against brute force."""

import numpy as np
import pytest

pipeline = pytest.importorskip("corpus_pipeline")

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(t):
    w = (t or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())


def alike(a, b):
    return a == b or len(a & b) / len(a | b) >= 0.8


def planted():
    rng = np.random.default_rng(5)
    texts = {}
    for g in range(40):
        base = [f"w{k}" for k in rng.integers(0, 5000, 300)]
        texts[10 * g] = " ".join(base)
        for c, changes in enumerate((1, 3, 5, 6, 7, 9), 1):
            t = list(base)
            for at in rng.choice(300, changes, replace=False):
                t[at] = f"x{rng.integers(1 << 40)}"
            texts[10 * g + c] = " ".join(t)
    texts |= {900: None, 901: "", 902: "One two", 903: "one  two", 904: "one two three"}
    return texts


def components(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sorted(texts):
        for j in texts:
            if j < i and alike(sets[i], sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in texts}


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "a", 0) for i, t in texts.items()], DOCS)


def test_stage(spark):
    texts = planted()
    want = components(texts)
    stage = dict(pipeline.STAGES)["simhash_near_dedup"]
    kept = sorted(r.doc_id for r in stage(spark, frame(spark, texts), "").collect())
    assert kept == sorted(set(want.values()))
    assert 40 < len(kept) < len(texts) - 100


def test_crowded_keys(spark):
    wide = pytest.importorskip("trellis.llm.simhash_wide")
    texts = planted()
    sets = {i: shingles(t) for i, t in texts.items()}
    want = components(texts)
    got = {r.doc_id: r.component_id for r in wide.groups(frame(spark, texts), most=2).collect()}
    kept = sorted(set(got.values()))
    assert all(want[i] == want[c] for i, c in got.items())
    assert not any(alike(sets[a], sets[b]) for a in kept for b in kept if a < b)
    assert wide.groups(frame(spark, texts).where("false")).count() == 0
