"""Invariants of the signal kernels, features and ablations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavetable.functions import dsp
from wavetable.functions import labels as L
from wavetable.operators import ablate as J
from wavetable.operators import features as D
from wavetable.operators import prep as B

FS = 1250.0


def tone(hz, n=3750, fs=FS):
    return np.sin(2 * np.pi * hz * np.arange(n) / fs)[None]


def gain(f, hz):
    x = tone(hz)
    return f(x)[0, 1000:-1000].std() / x[0, 1000:-1000].std()


def test_gain_at_the_corner_is_a_half_after_both_ways():
    for f in (lambda x: dsp.lowpass(x, FS, 50.0), lambda x: dsp.highpass(x, FS, 50.0)):
        assert gain(f, 50.0) == pytest.approx(0.5, abs=0.02)
    assert gain(lambda x: dsp.lowpass(x, FS, 50.0), 10.0) == pytest.approx(1, abs=0.01)
    assert gain(lambda x: dsp.highpass(x, FS, 50.0), 200.0) == pytest.approx(1, abs=0.02)


def test_lowpass_keeps_a_constant():
    assert np.allclose(dsp.lowpass(np.full((2, 500), 7.0), FS, 100.0), 7.0)


def test_no_phase_shift():
    x = tone(8)
    assert np.abs(dsp.lowpass(x, FS, 100.0) - x)[0, 500:-500].max() < 1e-3


def test_bandstop_takes_out_its_band_only():
    stop = lambda x: dsp.bandstop(x, FS, (30.0, 100.0))
    assert gain(stop, 55.0) < 0.01 and gain(stop, 6.0) == pytest.approx(1, abs=0.01) and gain(stop, 300.0) == pytest.approx(1, abs=0.01)


def test_filter_limits():
    with pytest.raises(ValueError):
        dsp.lowpass(tone(5), FS, FS)
    with pytest.raises(ValueError, match="too few"):
        dsp.lowpass(np.ones((1, 10)), FS, 50.0)


def test_welch_sums_to_the_variance():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(20, 12500))
    f, p = dsp.welch(x, FS)
    assert len(f) == 626 and p.sum(axis=1).mean() * (f[1] - f[0]) == pytest.approx(1, rel=0.02)


def test_resample_keeps_a_tone():
    y = dsp.resample(tone(10, 1250), 2500)
    assert np.abs(y - tone(10, 2500, 2 * FS)).max() < 1e-9
    assert np.array_equal(dsp.resample(tone(10), 3750), tone(10))


def test_phases_change_and_spectrum_stays():
    x = np.random.default_rng(0).normal(size=(3, 256))
    y = dsp.randomise_phase(x, np.arange(3))
    assert np.allclose(np.abs(np.fft.rfft(x))[:, :-1], np.abs(np.fft.rfft(y))[:, :-1]) and not np.allclose(x, y)
    assert np.array_equal(y[1:], dsp.randomise_phase(x[1:], np.arange(1, 3)))


def test_whitening_flattens_and_keeps_the_power():
    rng = np.random.default_rng(0)
    spectrum = np.fft.rfft(rng.normal(size=(40, 3750)))
    x = np.fft.irfft(spectrum / np.maximum(np.fft.rfftfreq(3750, 1 / FS), 1.0), 3750)
    f, p = dsp.welch(x, FS, 512)
    y = dsp.whiten(x, p.mean(axis=0), FS)
    f, q = dsp.welch(y, FS, 512)
    inside = q.mean(axis=0)[(f > 10) & (f < 500)]
    assert inside.max() / inside.min() < 2.5
    assert np.allclose((x * x).mean(axis=1), (y * y).mean(axis=1))
    with pytest.raises(ValueError, match="no power"):
        dsp.whiten(x, np.zeros(9), FS)


@pytest.mark.parametrize(("hz", "band"), [(2.0, "delta"), (6.0, "theta"), (10.0, "alpha"), (20.0, "beta"), (60.0, "gamma"), (180.0, "ripple")])
def test_tone_lands_in_its_band(spark, hz, band):
    df = spark.createDataFrame([(tone(hz)[0].tolist(),)], "wave array<double>")
    v = df.select(D.band_power(F.col("wave"), FS, log=False).alias("v")).first()["v"]
    assert v[list(D.BANDS).index(band)] > 0.95


def test_features_of_the_six_rows(spark):
    rows = [(0, "a", 0, 20.0, 11.0, 100.0, 0.5), (1, "a", 5, 120.0, 27.0, 200.0, -0.5), (2, "a", 10, 220.0, 43.0, 50.0, 0.0), (3, "b", 2, 40.0, None, 10.0, 1.0)]
    df = spark.createDataFrame(rows, "chunk_id long, grp string, channel int, depth_um double, lateral_um double, scale_std_uv double, scale_mean_uv double")
    span = {r["chunk_id"]: r["v"][0] for r in D.span_fraction(df).collect()}
    assert span == {0: 0.0, 1: 0.5, 2: 1.0, 3: 0.0}
    assert {r["chunk_id"]: r["v"][0] for r in D.span_fraction(df.filter("chunk_id <> 0")).collect()}[1] == 0.0
    assert {r["chunk_id"]: r["v"] for r in D.position(df).collect()}[3] == [40.0, 0.0]
    assert {r["chunk_id"]: r["v"][0] for r in D.amplitude(df).collect()}[0] == pytest.approx(2.0)


def test_cache(spark, tmp_path):
    cache, made = D.FeatureCache(spark, str(tmp_path)), []
    build = lambda: made.append(1) or spark.range(5)
    assert cache.get("x", 1, 5) is None
    assert cache.get_or_build("x", 1, 5, build).count() == 5 and cache.get_or_build("x", 1, 5, build).count() == 5 and len(made) == 1
    assert cache.get("x", 1, 6) is None and cache.get("x", 2, 5) is None
    cache.get_or_build("x", 1, 5, build, rebuild=True)
    assert len(made) == 2


def test_windows_are_complete(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(29)], "channel string, sample_ix long, value double")
    got = B.windows(df, ["channel"], 8, first=4, most=2).orderBy("k").collect()
    assert [(r["k"], r["start"], r["wave"][0], r["wave"][-1]) for r in got] == [(0, 4, 4.0, 11.0), (1, 12, 12.0, 19.0)]
    assert B.windows(df, ["channel"], 8).count() == 3


def test_flat_chunks_go_and_scale_comes_back(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0, 3.0]), (1, [5.0, 5.0, 5.0])], "chunk_id long, wave array<double>")
    out = B.scaled(df)
    assert out.count() == 1 and B.restored(out).first()["wave"] == pytest.approx([1.0, 2.0, 3.0])
    with pytest.raises(Exception, match="not finite"):
        B.scaled(spark.createDataFrame([(0, [1.0, float("nan")])], "chunk_id long, wave array<double>")).collect()


def test_rates_and_slabs(spark):
    df = spark.createDataFrame([("a", i, i / 500.0, 1.0) for i in range(100)], "channel string, sample_ix long, s double, value double")
    assert B.sampling_rate(df, ["channel"], F.col("s")).first()["fs"] == pytest.approx(500)
    assert B.slab(df, 0.01, 0.03, 500.0).count() == 10
    with pytest.raises(ValueError):
        B.slab(df, 0.03, 0.03, 500.0)
    with pytest.raises(Exception, match="positive sampling rate"):
        B.sampling_rate(df.withColumn("s", F.lit(1.0)), ["channel"], F.col("s")).collect()


@pytest.mark.parametrize(("acronym", "region"), [("CA1slm", "CA1"), ("DG-mo", "DG"), ("VISp2/3", "VIS"), ("VISpm6a", "VIS"), ("VISC", "UNK"), ("root", "UNK"), (" ", "UNK"), (None, "UNK"), ("CA", "UNK")])
def test_regions(spark, acronym, region):
    assert spark.createDataFrame([(acronym,)], "a string").select(L.region(F.col("a")).alias("r")).first()["r"] == region


def test_probe_geometry(spark):
    good = [("a", i, (i // 2) * 20.0 + 20, [43.0, 11.0, 59.0, 27.0][i % 4]) for i in range(40)]
    kind = "grp string, channel int, depth_um double, lateral_um double"
    got = B.geometry_violations(spark.createDataFrame(good, kind), ["grp"]).first()
    assert (got["n_unordered"], got["n_bad_pitch"], got["n_unpaired"], got["n_columns"]) == (0, 0, 0, 4)
    bad = [(g, c, d * 2, 43.0) for g, c, d, _ in good[:-1]]
    got = B.geometry_violations(spark.createDataFrame(bad, kind), ["grp"]).first()
    assert got["n_bad_pitch"] == 19 and got["n_unpaired"] == 1 and got["n_columns"] == 1


def test_ablation_limits_and_mask(spark):
    with pytest.raises(ValueError):
        J.band_stop(F.col("wave"), FS, "none")
    with pytest.raises(ValueError):
        J.band_stop(F.col("wave"), 100.0, "gamma")
    with pytest.raises(ValueError):
        J.amplitude_scale(F.col("wave"), 0)
    df = spark.createDataFrame([(i, [1.0] * 40) for i in range(20)], "chunk_id long, wave array<double>")
    got = [r["w"] for r in df.select(J.temporal_mask(F.col("wave"), 0.25, F.col("chunk_id")).alias("w")).collect()]
    assert all(sum(w) == 30.0 for w in got) and len({tuple(w) for w in got}) > 3
    for w in got:
        at = [i for i, x in enumerate(w) if x == 0]
        assert at[-1] - at[0] == 9


def test_stream_gives_the_batch_chunks(spark, tmp_path):
    from wavetable.streaming.chunks import stream_chunks

    df = spark.createDataFrame([("a", i, float(i * i % 7)) for i in range(40)], "channel string, i long, value double").select("channel", F.timestamp_seconds(F.col("i") + 1_600_000_000).alias("ts"), "value")
    df.write.parquet(str(tmp_path / "in"))
    stream = stream_chunks(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), ["channel"], 8, 8, "0 seconds")
    q = stream.writeStream.format("memory").queryName("chunks_out").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.sql("select * from chunks_out").count()
    batch = stream_chunks(df, ["channel"], 8, 8).count()
    assert batch >= 4 and batch - 1 <= got <= batch


def test_windows_are_cut_without_gathering_a_channel(spark):
    from wavetable.plans import build

    sizes = {("g", 0): [7, 7, 7, 3, 20], ("g", 1): [1] * 9, ("h", 0): [50], ("h", 1): [4]}
    rows, signals = [], {}
    for i, (key, ns) in enumerate(sizes.items()):
        x = [float((j * 37 + i) % 101) for j in range(sum(ns))]
        signals[key] = x
        rows += [(*key, sum(ns[:b]), x[sum(ns[:b]) : sum(ns[: b + 1])]) for b in range(len(ns))]
    blocks = spark.createDataFrame(rows[::-1], "grp string, channel int, block_start long, samples array<double>").repartition(3)
    for width, first, most in ((8, 0, None), (8, 3, 2), (3, 1, None), (40, 0, None)):
        want = {(*key, k): x[k * width + first : (k + 1) * width + first] for key, x in signals.items() for k in range(max(0, (len(x) - first) // width)) if most is None or k < most}
        assert {(r["grp"], r["channel"], r["k"]): r["wave"] for r in build.cut_windows(blocks, width, first, most).collect()} == want
    channels = spark.createDataFrame([(*key, "CA1", True) for key in sizes], "grp string, channel int, acronym string, valid_data boolean")
    chunks, ledger = build.build_chunks(blocks, channels, 1.0, 8, 0.0, None)
    plan = chunks._jdf.queryExecution().optimizedPlan().toString()
    assert all(", k#" in line.split("]")[0] for line in plan.splitlines() if "Aggregate" in line and "collect_list" in line)
    assert {(r["grp"], r["channel"]): r["count"] for r in chunks.groupBy("grp", "channel").count().collect()} == {("g", 0): 5, ("g", 1): 1, ("h", 0): 6}
    assert [(r["grp"], r["channel"], r["reason"]) for r in ledger.collect()] == [("h", 1, "no complete live window")]
