"""Filters over blocks against the same filters over whole channels."""

import numpy as np
import pytest

from wavetable.functions import dsp
from wavetable.operators import filtering as G
from wavetable.plans import build

KEYS = ["grp", "channel"]


@pytest.fixture
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def blocks_of(spark, signals, size, seed=0):
    rng, rows = np.random.default_rng(seed), []
    for (g, c), x in signals.items():
        at = 0
        while at < len(x):
            n = size if seed == 0 else int(rng.integers(1, 2 * size))
            rows.append((g, c, at, x[at : at + n].tolist()))
            at += n
        rows += [(g, c, len(x) + 5, []), (g, c, len(x) + 6, None)]
    return spark.createDataFrame(rows, "grp string, channel int, block_start long, samples array<double>").repartition(5)


def joined(df):
    out = {}
    for r in df.collect():
        out.setdefault((r["grp"], r["channel"]), []).append((r["pos"], r["samples"]))
    return {k: np.concatenate([s for _, s in sorted(v)]) for k, v in out.items()}


def walk(n, seed):
    return np.cumsum(np.random.default_rng(seed).normal(size=n)) * 1e-4


@pytest.mark.parametrize(("size", "n", "seed"), [(7, 900, 0), (5, 400, 1), (10_000, 30_000, 0)])
def test_blocks_give_what_whole_channels_give(many_ranges, size, n, seed):
    signals = {("g", 0): walk(n, 1), ("g", 1): walk(n // 2 + 1, 2), ("h", 0): walk(100, 3)}
    placed = G.placed_blocks(blocks_of(many_ranges, signals, size, seed), KEYS)
    got = joined(G.preprocess_blocks(placed, KEYS, 2500.0, 1250.0))
    assert got.keys() == signals.keys()
    for k, x in signals.items():
        want = dsp.preprocess(x[None], 2500.0, 1250.0)[0]
        assert len(got[k]) == len(want) and np.abs(got[k] - want).max() < 1e-9 * np.abs(want).max()


def test_a_stop_filter_over_blocks(many_ranges):
    signals = {("g", 0): walk(500, 1)}
    sos = dsp.butterworth(4, (8.0, 12.0), 250.0, "stop")
    got = joined(G.zero_phase_blocks(G.placed_blocks(blocks_of(many_ranges, signals, 11), KEYS), KEYS, sos))
    want = dsp.zero_phase(sos, signals["g", 0][None])[0]
    assert np.abs(got["g", 0] - want).max() < 1e-9 * np.abs(want).max()


def test_short_channels_raise_or_are_told_before(spark):
    sos = dsp.butterworth(2, 0.1, 50.0, "high")
    placed = G.placed_blocks(blocks_of(spark, {("g", 0): walk(9, 1), ("g", 1): walk(10, 1)}, 4), KEYS)
    assert [r["channel"] for r in G.long_enough(placed, KEYS, [sos], [1]).collect()] == [1]
    with pytest.raises(Exception, match="too few"):
        G.zero_phase_blocks(placed, KEYS, sos)
    assert G.zero_phase_blocks(placed.filter("channel = 7"), KEYS, sos).count() == 0


def test_a_store_is_built_from_filtered_blocks(spark):
    signals = {("g", c): walk(700 + 10 * c, c + 1) for c in range(3)} | {("g", 3): np.zeros(600), ("g", 4): walk(12, 9)}
    blocks = blocks_of(spark, signals, 50)
    channels = spark.createDataFrame([("g", c, "CA1", True) for c in range(5)], "grp string, channel int, acronym string, valid_data boolean")
    chunks, ledger = build.build_chunks(blocks, channels, 100.0, 1.0, 1.0, None, target_fs=50.0)
    got = {(r["channel"], r["k"]): np.array(r["wave"]) for r in chunks.collect()}
    for c in range(3):
        y = dsp.preprocess(signals["g", c][None], 100.0, 50.0)[0]
        want = [y[50 + i : 100 + i] for i in range(0, len(y) - 99, 50)]
        assert sum(k[0] == c for k in got) == len(want)
        for k, w in enumerate(want):
            assert np.allclose(got[c, k], (w - w.mean()) / w.std(), atol=1e-9)
    assert {r["channel"]: r["reason"] for r in ledger.collect()} == {3: "all zeros", 4: "no complete live window"}
    plan = chunks._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(signal" not in plan


def loop(sos, x):
    """Forward and backward over a whole channel in doubles, sample by sample."""
    edge = dsp.edge_of(sos)
    wide = [2 * x[0] - x[i] for i in range(edge, 0, -1)] + list(x) + [2 * x[-1] - x[-1 - i] for i in range(1, edge + 1)]
    for _ in range(2):
        state = [float(v) for v in (dsp.settled(sos) * wide[0]).ravel()]
        out = []
        for u in wide:
            for i, (b0, b1, b2, _, a1, a2) in enumerate(sos.tolist()):
                y = b0 * u + state[2 * i]
                state[2 * i], state[2 * i + 1] = b1 * u - a1 * y + state[2 * i + 1], b2 * u - a2 * y
                u = y
            out.append(u)
        wide = out[::-1]
    return wide[edge:-edge]


def test_plain_blocks_have_the_bits_of_a_loop_over_the_channel(many_ranges):
    rng = np.random.default_rng(5)
    signals = {("g", 0): rng.gamma(2.0, 30.0, 6000).round(2), ("h", 0): rng.gamma(2.0, 30.0, 400).round(2), ("h", 1): rng.gamma(2.0, 30.0, 30).round(2)}
    placed = G.placed_blocks(blocks_of(many_ranges, signals, 16), KEYS)
    low, high = G.chain(64.0, 32.0)[0]
    got = joined(G.preprocess_blocks(placed, KEYS, 64.0, 32.0, plain=True))
    assert got.keys() == signals.keys()
    for k, x in signals.items():
        assert got[k].tolist() == [v * 1e6 for v in loop(high, loop(low, x.tolist())[::2])]
