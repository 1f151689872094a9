"""Input ablations: named transforms of waveforms, and what they do to scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavetable.functions import dsp
from wavetable.functions.hashing import uniform
from wavetable.operators.features import BANDS

GATE = 0.005


def band_stop(wave: Column, fs: float, band: str, order: int = 4) -> Column:
    if band not in BANDS:
        raise ValueError(f"no band {band!r}; there are {', '.join(BANDS)}")
    if BANDS[band][1] >= fs / 2:
        raise ValueError(f"{band} reaches beyond {fs / 2} Hz")
    return dsp.vector_function(lambda x: dsp.bandstop(x, fs, BANDS[band], order))(wave)


def random_phase(wave: Column, key: Column, seed: int = 0) -> Column:
    """Seeded for each chunk, so that a chunk gives the same on every partitioning."""
    return dsp.seeded_function(dsp.randomise_phase)(wave, F.xxhash64(F.lit(seed), key).bitwiseAND(F.lit((1 << 62) - 1)))


def amplitude_scale(wave: Column, factor: float) -> Column:
    if factor <= 0:
        raise ValueError("a factor has to be positive")
    return F.transform(wave, lambda x: x * factor)


def temporal_mask(wave: Column, fraction: float, key: Column, seed: int = 0) -> Column:
    """One span of round(fraction * n) samples set to zero, from a start that the key draws."""
    if not 0 < fraction < 1:
        raise ValueError("a fraction lies between 0 and 1")
    n = F.size(wave)
    width = F.bround(n * F.lit(fraction)).cast("int")
    start = F.floor(uniform(seed, key) * (n - width + 1)).cast("int")
    return F.transform(wave, lambda x, i: F.when((i >= start) & (i < start + width), 0.0).otherwise(x))


#: name: (question, is a control, function of wave, key and rate)
ABLATIONS: dict[str, tuple[str, bool, Callable[[Column, Column, float], Column]]] = {
    "none": ("nothing", True, lambda w, k, fs: w),
    **{f"stop_{b}": (f"does it need {b}?", False, lambda w, k, fs, b=b: band_stop(w, fs, b)) for b in BANDS},
    "phase": ("does it need phase?", False, lambda w, k, fs: random_phase(w, k)),
    "mask_25": ("does it need the whole chunk?", False, lambda w, k, fs: temporal_mask(w, 0.25, k)),
    "scale_half": ("is amplitude cancelled?", True, lambda w, k, fs: amplitude_scale(w, 0.5)),
    "scale_double": ("is amplitude cancelled?", True, lambda w, k, fs: amplitude_scale(w, 2.0)),
}


def ablated(chunks: DataFrame, names: list[str], fs: float, key: str = "chunk_id", wave: str = "wave") -> DataFrame:
    """chunks once for each ablation, with its name."""
    out = None
    for name in names:
        part = chunks.withColumn(wave, ABLATIONS[name][2](F.col(wave).cast("array<double>"), F.col(key), fs)).withColumn("ablation", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def deltas(scores: DataFrame, keys: list[str], score: str = "balanced_accuracy") -> DataFrame:
    """scores (keys, ablation, is_control, score) with delta to `none`, and whether all controls of the key stay within the gate."""
    none = scores.filter("ablation = 'none'").select(*keys, F.col(score).alias("_none"))
    out = scores.join(none, keys).withColumn("delta", F.col(score) - F.col("_none")).drop("_none")
    gate = out.groupBy(*keys).agg((F.max(F.when(F.col("is_control"), F.abs("delta"))) <= GATE).alias("gate"))
    return out.join(gate, keys)
