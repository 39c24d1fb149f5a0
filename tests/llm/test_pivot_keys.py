"""The pivot distance table of the near-dedup at a similarity: nearest references against distances counted bit by bit, and candidates at 0.8."""

import numpy as np
import pytest

wide = pytest.importorskip("trellis.llm.simhash_wide")


def drawn(rng, n):
    return rng.integers(0, 1 << 64, n, dtype=np.uint64, endpoint=False)


def bits(h):
    """The 512 bits of each hash."""
    every = np.concatenate([h[None], wide._mixed(h[None] * wide._WIDER)])
    return np.unpackbits(every.view(np.uint8).reshape(wide.LONGS, len(h), 8), axis=2, bitorder="little").transpose(1, 0, 2).reshape(len(h), wide.BITS)


def test_nearest_references():
    rng = np.random.default_rng(2)
    sets = [drawn(rng, n) for n in (1, 4, 50, 333)]
    whole, some = wide.nearest(np.array([wide.bit_sums(h) for h in sets]), 7, 4)
    for g in (0, 6):
        refs = wide.references(g)
        assert refs.shape == (2 * wide.BITS, wide.BITS) and len({r.tobytes() for r in refs}) == 2 * wide.BITS
        for k, h in enumerate(sets):
            apart = np.array([(bits(h) != r).sum() for r in refs])
            assert apart[whole[k, g]] == apart.min()
            part = [*range(4), *range(wide.BITS, wide.BITS + 4)]
            assert apart[part[some[k, g]]] == apart[part].min()


def test_candidates_at_the_threshold():
    rng = np.random.default_rng(3)
    one, other = [], []
    for n in [9, 45, 180] * 300:
        both = drawn(rng, n * 8 // 9)
        one.append(wide.bit_sums(np.concatenate([both, drawn(rng, n - len(both))])))
        other.append(wide.bit_sums(np.concatenate([both, drawn(rng, n - len(both))])))
    for groups, part in (wide.plan(1000), wide.plan(10**7)):
        a, b = (wide.pivot_keys(np.array(x), groups, part) for x in (one, other))
        assert (a == b).any(axis=1).all()  # 900 pairs, each missed with a probability of 0.00002
        assert (a == np.roll(b, 1, axis=0)).any(axis=1).mean() < 0.01  # unrelated
