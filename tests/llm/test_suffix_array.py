"""Intervals of the distributed suffix array against brute force: members, first places and depths."""

import random
from collections import defaultdict

import pytest

suffix_array = pytest.importorskip("trellis.llm.suffix_array")

ITEMS = "doc long, key long, pos int, left int, rank long"


def test_intervals(spark):
    pick = random.Random(5)
    docs = [[pick.choice("aab") for _ in range(n)] for n in (1, 2, 3, 9, 17)] + [list("abcab"), list("xabcab"), list("zz"), ["a"] * 13, list("abcab")]
    size = defaultdict(int)
    for d in docs:
        for x in d:
            size[x] += 1
    rank, before = {}, 0
    for x in sorted(size):
        rank[x], before = before, before + size[x]
    rows = [(i, 0, p, len(d) - p, rank[x]) for i, d in enumerate(docs) for p, x in enumerate(d) if size[x] > 1]
    for least in (2, 3):
        groups = defaultdict(list)
        for i, d in enumerate(docs):
            for p in range(len(d) - least + 1):
                groups[tuple(d[p : p + least])].append((i, p))
        want = set()
        for members in groups.values():
            if len(members) > 1:
                depth = least
                while len({tuple(docs[i][p : p + depth + 1]) for i, p in members}) == 1 and all(p + depth < len(docs[i]) for i, p in members):
                    depth += 1
                want |= {(i, p, depth, *min(members)) for i, p in members}
        got = suffix_array.repeats(spark.createDataFrame(rows, ITEMS), least).select("doc", "pos", "depth", "first.doc", "first.pos").collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want
