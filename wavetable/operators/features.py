"""Features of chunks: amplitude, position, spectra, whitening, embeddings by a user's model, and their cache."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavetable.functions import dsp
from wavetable.operators.splits import keyed_sample
from wavetable.schema import require_columns

#: Frequency bands in Hz, from the first number to before the second.
BANDS = {"delta": (1.0, 4.0), "theta": (4.0, 8.0), "alpha": (8.0, 12.0), "beta": (12.0, 30.0), "gamma": (30.0, 100.0), "ripple": (100.0, 250.0)}
FLOOR = 1e-12
TOTAL_FLOOR = 1e-20


def amplitude(index: DataFrame) -> DataFrame:
    require_columns(index, "scale_std_uv", "scale_mean_uv")
    return index.select("chunk_id", F.array(F.log10(F.greatest("scale_std_uv", F.lit(FLOOR))), F.col("scale_mean_uv")).alias("v"))


def position(index: DataFrame) -> DataFrame:
    require_columns(index, "depth_um")
    lateral = F.coalesce(F.nanvl(F.col("lateral_um"), F.lit(0.0)), F.lit(0.0)) if "lateral_um" in index.columns else F.lit(0.0)
    return index.select("chunk_id", F.array(F.col("depth_um"), lateral).alias("v"))


def span_fraction(index: DataFrame) -> DataFrame:
    """Place in the labelled span of the group: a leaky diagnostic."""
    require_columns(index, "grp", "depth_um")
    span = index.groupBy("grp").agg(F.min("depth_um").alias("_low"), (F.max("depth_um") - F.min("depth_um")).alias("_span"))
    place = (F.col("depth_um") - F.col("_low")) / F.when(F.col("_span") == 0, 1.0).otherwise(F.col("_span"))
    return index.join(span, "grp").select("chunk_id", F.array(place).alias("v"))


def psd(wave: Column, fs: float, width: int | None = None, window: str = "hann") -> Column:
    return dsp.vector_function(lambda x: dsp.welch(x, fs, width, window)[1])(wave)


def band_power(wave: Column, fs: float, bands: dict[str, tuple[float, float]] = BANDS, relative: bool = True, log: bool = True, width: int | None = None, window: str = "hann") -> Column:
    """Power of each band, as a share of their sum, in decades; a band without a bin is 0."""

    def run(x: np.ndarray) -> np.ndarray:
        f, p = dsp.welch(x, fs, width, window)
        out = np.stack([p[:, (f >= a) & (f < b)].sum(axis=1) * (f[1] - f[0]) for a, b in bands.values()], axis=1)
        if relative:
            out = out / np.maximum(out.sum(axis=1, keepdims=True), TOTAL_FLOOR)
        return np.log10(out + FLOOR) if log else out

    return dsp.vector_function(run)(wave)


def without(band: str) -> dict[str, tuple[float, float]]:
    return {k: v for k, v in BANDS.items() if k != band}


def log_spectrum(wave: Column, fs: float, low: float = 1.0, high: float = 100.0, width: int | None = None, window: str = "hann", kind: type = np.float32) -> Column:
    """Densities from low to high, both included, as shares of their sum, in decades."""

    def run(x: np.ndarray) -> np.ndarray:
        f, p = dsp.welch(x, fs, width, window)
        p = p[:, (f >= low) & (f <= high)]
        return np.log10(p / np.maximum(p.sum(axis=1, keepdims=True), TOTAL_FLOOR) + FLOOR).astype(kind)

    return dsp.vector_function(run)(wave)


def mean_spectrum(spectra: DataFrame, keys: list[str], vector: str = "psd") -> DataFrame:
    """(keys, bin, power): mean over the rows of each key."""
    return spectra.select(*keys, F.posexplode(vector).alias("bin", "p")).groupBy(*keys, "bin").agg(F.avg("p").alias("power"))


def as_vector(spectrum: DataFrame, keys: list[str]) -> DataFrame:
    return spectrum.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "power"))), lambda x: x["power"]).alias("reference"))


def at_frequency(spectrum: DataFrame, keys: list[str], hz: list[float], step: float) -> DataFrame:
    """(keys, hz, power): linear interpolation between the two bins around each frequency."""
    wanted = spectrum.sparkSession.createDataFrame([(float(h),) for h in hz], "hz double")
    f = F.col("bin") * step
    near = spectrum.crossJoin(F.broadcast(wanted)).groupBy(*keys, "hz").agg(  # a row for each asked frequency
        F.max(F.when(f <= F.col("hz"), f)).alias("a"), F.max_by("power", F.when(f <= F.col("hz"), f)).alias("pa"),
        F.min(F.when(f >= F.col("hz"), f)).alias("b"), F.min_by("power", F.when(f >= F.col("hz"), f)).alias("pb"),
    )
    return near.select(*keys, "hz", F.when(F.col("a") == F.col("b"), F.col("pa")).otherwise(F.col("pa") + (F.col("pb") - F.col("pa")) * (F.col("hz") - F.col("a")) / (F.col("b") - F.col("a"))).alias("power"))


def spectrum_ratio(spectrum: DataFrame, source: str, first: str, second: str, hz: list[float], step: float, norm_hz: float = 10.0) -> DataFrame:
    """(hz, ratio): power of first over that of second, each relative to its own at norm_hz."""
    by = at_frequency(spectrum, [source], sorted({*hz, norm_hz}), step)
    norm = by.filter(F.col("hz") == norm_hz).select(source, F.col("power").alias("_n"))
    rel = by.join(norm, source).select(source, "hz", (F.col("power") / F.col("_n")).alias("rel"))
    wide = rel.groupBy("hz").agg(F.max(F.when(F.col(source) == first, F.col("rel"))).alias("_a"), F.max(F.when(F.col(source) == second, F.col("rel"))).alias("_b"))
    return wide.filter(F.col("hz").isin([float(h) for h in hz])).select("hz", (F.col("_a") / F.col("_b")).alias("ratio"))


def whitened(chunks: DataFrame, references: DataFrame, fs: float, group: str = "grp", wave: str = "wave") -> DataFrame:
    """Each chunk whitened by its group's reference; a group without one raises. references: a row for each group."""
    joined = chunks.join(references.select(group, "reference"), group, "left")
    joined = joined.filter(F.when(F.col("reference").isNotNull(), True).otherwise(F.raise_error(F.concat(F.lit("no reference for "), F.col(group))).cast("boolean")))
    return joined.withColumn(wave, dsp.referenced_function(lambda x, ref: dsp.whiten(x, ref, fs))(F.col(wave), F.col("reference"))).drop("reference")


def fit_references(chunks: DataFrame, fs: float, sample: int | None = 400, width: int = 512, group: str = "grp", key: str = "chunk_id", wave: str = "wave") -> DataFrame:
    """(group, reference): mean spectrum of a sample of each group's chunks; with None of all of them."""
    some = chunks.select(group, key, wave)
    some = some if sample is None else keyed_sample(some, sample, [group], [key])
    return as_vector(mean_spectrum(some.withColumn("psd", psd(F.col(wave), fs, width)), [group]), [group])


def embedded(chunks: DataFrame, make_predict: Callable, size: int, batch: int = 32, wave: str = "wave", columns: dict[str, int] | None = None) -> DataFrame:
    """Vectors of a user's model for each chunk, in batches. make_predict() returns a function of a (rows, samples) array.

    columns: names and widths of several outputs (such as logits and embedding) that the model returns as a dict.
    """
    if columns:
        kind = T.StructType([T.StructField(c, T.ArrayType(T.FloatType())) for c in columns])
        udf = predict_batch_udf(make_predict, return_type=kind, batch_size=batch, input_tensor_shapes=[[size]])
        return chunks.withColumn("_out", udf(F.col(wave))).select(*chunks.columns, "_out.*")
    udf = predict_batch_udf(make_predict, return_type=T.ArrayType(T.FloatType()), batch_size=batch, input_tensor_shapes=[[size]])
    return chunks.withColumn("embedding", udf(F.col(wave)))


class FeatureCache:
    """Feature tables under path/<set>/<fingerprint>; a table that is absent, of another index or short of rows is made anew."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def get(self, name: str, fingerprint: int | str, rows: int) -> DataFrame | None:
        where = f"{self.path}/{name}/{fingerprint}"
        try:
            found = self.spark.read.parquet(where)
        except Exception as e:  # Spark names a missing path in the error's class
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return None
            raise
        return found if found.count() == rows else None

    def get_or_build(self, name: str, fingerprint: int | str, rows: int, build: Callable[[], DataFrame], rebuild: bool = False) -> DataFrame:
        found = None if rebuild else self.get(name, fingerprint, rows)
        if found is None:
            build().write.mode("overwrite").parquet(f"{self.path}/{name}/{fingerprint}")
            found = self.spark.read.parquet(f"{self.path}/{name}/{fingerprint}")
        return found


#: Feature sets of a chunk index with wave and fs, by name.
FEATURE_SETS: dict[str, Callable[[DataFrame, float], DataFrame]] = {
    "amplitude": lambda df, fs: amplitude(df),
    "position": lambda df, fs: position(df),
    "bandpower": lambda df, fs: df.select("chunk_id", band_power(F.col("wave"), fs).alias("v")),
    "bandpower_clean": lambda df, fs: df.select("chunk_id", band_power(F.col("wave"), fs, without("ripple")).alias("v")),
    "log_spectrum": lambda df, fs: df.select("chunk_id", log_spectrum(F.col("wave"), fs).alias("v")),
}


def build_features(df: DataFrame, names: list[str], fs: float) -> DataFrame:
    """(chunk_id, feature_set, v) for the named sets; uneven_sets checks their widths."""
    out = None
    for name in names:
        part = FEATURE_SETS[name](df, fs)
        part = part.select("chunk_id", F.lit(name).alias("feature_set"), "v")
        out = part if out is None else out.unionByName(part)
    return out


def uneven_sets(features: DataFrame) -> DataFrame:
    """Feature sets whose vectors have several widths."""
    return features.groupBy("feature_set").agg(F.min(F.size("v")).alias("narrowest"), F.max(F.size("v")).alias("widest")).filter("narrowest <> widest")
