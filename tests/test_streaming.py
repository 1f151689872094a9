"""Windows over a stream of blocks equal those of the whole recording."""

import numpy as np
import pytest

from wavetable.plans.build import cut_windows
from wavetable.streaming.windows import advance, stream_windows

SCHEMA = "grp string, channel int, block_start long, samples array<double>"


@pytest.mark.parametrize(("width", "first"), [(8, 0), (8, 3), (5, 30), (40, 1)])
def test_any_cut_gives_the_same_windows(width, first):
    rng = np.random.default_rng(width + first)
    for _ in range(30):
        sizes = rng.integers(0, 12, 14)
        starts = np.concatenate([[0], np.cumsum(np.maximum(sizes, 1))])[:-1]
        x = [rng.normal(size=n) for n in sizes]
        whole = np.concatenate(x)
        last, n, carry, got = -1, 0, np.zeros(0), {}
        for own in np.split(np.arange(14), np.sort(rng.integers(0, 15, 4))):
            last, n, carry, k, waves, late = advance(last, n, carry, [(int(starts[i]), x[i]) for i in rng.permutation(own)], width, first)
            assert late == 0 and len(carry) < width and not set(got) & set(range(k, k + len(waves)))
            got |= {k + i: w.tolist() for i, w in enumerate(waves)}
        assert got == {k: whole[k * width + first : (k + 1) * width + first].tolist() for k in range(max(0, (len(whole) - first) // width))}


def test_late_blocks_are_counted():
    last, n, carry, k, waves, late = advance(7, 8, np.zeros(0), [(8, np.ones(4)), (3, np.ones(9)), (8, np.ones(2)), (-1, np.ones(1))], 4)
    assert (last, n, len(carry), k, waves.tolist(), late) == (8, 12, 0, 2, [[1.0] * 4], 3)


def test_a_stream_gives_the_windows_of_the_table(spark, tmp_path):
    sizes = {("g", 0): [7, 7, 7, 3, 20, 5], ("g", 1): [4] * 6, ("h", None): [9, 0, 1, 30, 2, 2]}
    blocks = {key: [(*key, sum(ns[:b]) + b, [float(i * i % 13) for i in range(sum(ns[:b]), sum(ns[: b + 1]))]) for b in range(len(ns))] for key, ns in sizes.items()}
    batches = [[r for own in blocks.values() for r in own[i : i + 2]][::-1] for i in (0, 2, 4)]
    batches.append([("g", 0, 3, [1.0] * 50), ("h", None, None, [1.0]), ("new", 5, 0, None)])
    out = []
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        q = stream_windows(stream, ["grp", "channel"], 8, 3).writeStream.foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = {(r["grp"], r["channel"], r["k"]): r["wave"] for r in out if r["k"] is not None}
    whole = [r for own in blocks.values() for r in own if r[1] is not None]
    want = {(r["grp"], r["channel"], r["k"]): r["wave"] for r in cut_windows(spark.createDataFrame(whole, SCHEMA), 8, 3).collect()}
    assert {k: v for k, v in got.items() if k[1] is not None} == want and len([1 for k in got if k[0] == "h"]) == 5
    assert {(r["grp"], r["n_late"]) for r in out if r["n_late"] is not None} == {("g", 1), ("h", 1)}
