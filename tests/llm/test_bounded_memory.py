"""Large groups of near copies take a bounded number of pairs at once, and give the links that all pairs give."""

import tracemalloc

import numpy as np

from wavetable.llm import simhash


def peak_mb(f):
    tracemalloc.start()
    try:
        out = f()
        return out, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def components(n, links):
    return simhash.forest(n, *np.array(links or np.empty((0, 2)), np.int64).reshape(-1, 2).T)


def test_blocks_of_near_copies():
    n, rng = 2400, np.random.default_rng(0)
    base = rng.integers(0, 1 << 62, (3, 40), dtype=np.uint64)
    want = np.array([i % 240 if i % 240 < 2 else 2 for i in range(n)])  # a large group and two small ones, told apart by their shingles alone
    grams = [np.unique(np.append(base[k], np.uint64(i))) for i, k in enumerate(want)]
    prints, own, reps = np.zeros((10, n), np.int64), np.arange(n) // (n // 2), np.arange(n)
    grams[7] = grams[8] = np.array([1, 2, 3], np.uint64)
    for i, j in ((0, 1), (0, 0)):
        in_play = np.flatnonzero(np.isin(own, (i, j)))
        links, mb = peak_mb(lambda: simhash._block_links(reps, own, prints, grams, i, j, 0.8))
        got = components(n, links)
        apart = np.array([x for x in in_play if x not in (7, 8)])
        assert all(len(np.unique(got[apart[want[apart] == k]])) == 1 for k in range(3)) and len(np.unique(got[apart])) == 3
        assert (got[7] == got[8]) == (i == j)  # both are in block 0, which meets itself in (0, 0)
        assert mb < 60


def test_pairs_of_close_fingerprints():
    codes = np.arange(1 << 12, dtype=np.uint64)
    codes = codes[np.argsort(simhash.gray_rank(codes))]
    bounds = np.array([0, len(codes)])

    def count():
        return sum(len(a) for a, _ in simhash.pair_parts(codes, bounds, 7))

    found, mb = peak_mb(count)
    near = np.bitwise_count(np.arange(1 << 12)) <= 7
    assert found == (int(near.sum()) - 1) * len(codes) // 2
    assert mb < 30
