"""From recordings to chunks: rates, slabs, screens, windows, normalisation, and the tables about a store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wavetable.schema import CLASSES, UNKNOWN

FIRST_SAMPLES = 10_000
PITCH_UM = 20.0
#: Fixed value: sources of fewer bytes may hold nothing but zeros, and are looked into.
DEAD_BYTES = 200 * 1024 * 1024
EPS = 1e-8


def sampling_rate(samples: DataFrame, keys: list[str], seconds: Column, order: str = "sample_ix", first: int = FIRST_SAMPLES) -> DataFrame:
    """(keys, fs): one over the median step of the first samples; no finite positive rate raises. The filter bounds the window."""
    head = samples.filter(F.col(order) < first).withColumn("_s", seconds)
    steps = head.withColumn("_d", F.col("_s") - F.lag("_s").over(W.partitionBy(*keys).orderBy(order)))
    rate = steps.groupBy(*keys).agg((1 / F.nullif(F.median("_d"), F.lit(0.0))).alias("fs"))
    return rate.withColumn("fs", F.when(F.col("fs") > 0, F.col("fs")).otherwise(F.raise_error(F.lit("no positive sampling rate")).cast("double")))


def slab(samples: DataFrame, t0: float, t1: float, fs: float, scale: float = 1e6, order: str = "sample_ix") -> DataFrame:
    """Samples from round(t0 * fs) to before round(t1 * fs), in µV. Python's round is half-even."""
    if round(t1 * fs) <= round(t0 * fs):
        raise ValueError(f"no samples from {t0} to {t1} s")
    return samples.filter((F.col(order) >= round(t0 * fs)) & (F.col(order) < round(t1 * fs))).withColumn("value", F.col("value") * scale)


def dead_by_size(samples: DataFrame, sizes: DataFrame, keys: list[str], block: int, most_bytes: int = DEAD_BYTES, order: str = "sample_ix") -> DataFrame:
    """(keys, size_bytes, looks_dead, is_dead): the samples of sources below most_bytes, or of unknown size, decide; others are live and none of theirs is read further.

    sizes: keys, size_bytes; a row for each source. A small source without samples is dead.
    """
    screened = sizes.select(*keys, "size_bytes", (F.coalesce("size_bytes", F.lit(0)) < most_bytes).alias("looks_dead"))
    looked = dead(samples.join(screened.filter("looks_dead").select(*keys), keys, "left_semi"), keys, block, order)
    return screened.join(looked, keys, "left").withColumn("is_dead", F.col("looks_dead") & F.coalesce("is_dead", F.lit(True)))


def dead(samples: DataFrame, keys: list[str], block: int, order: str = "sample_ix") -> DataFrame:
    """(keys, is_dead): all zeros in a block at the beginning, in the middle and at the end."""
    n = samples.groupBy(*keys).agg(F.max(order).alias("_last"))
    starts = [F.lit(0), F.floor(F.col("_last") / 2), F.greatest(F.lit(0), F.col("_last") + 1 - block)]
    inside = [(F.col(order) >= s) & (F.col(order) < s + block) for s in starts]
    return samples.join(n, keys).filter(inside[0] | inside[1] | inside[2]).groupBy(*keys).agg(F.bool_and(F.col("value") == 0).alias("is_dead"))


def geometry_violations(channels: DataFrame, keys: list[str]) -> DataFrame:
    """Per group: rows out of depth order, depths without two channels, depth steps that are not the pitch, number of lateral columns."""
    by = W.partitionBy(*keys).orderBy("channel")
    stepped = channels.withColumn("_d", F.col("depth_um") - F.lag("depth_um").over(by))
    order = stepped.groupBy(*keys).agg(F.count_if(F.col("_d") < 0).alias("n_unordered"), F.count_if((F.col("_d") > 0) & (F.abs(F.col("_d") - PITCH_UM) > 1e-6)).alias("n_bad_pitch"), F.count_distinct("lateral_um").alias("n_columns"))
    rows = channels.groupBy(*keys, "depth_um").count().groupBy(*keys).agg(F.count_if(F.col("count") != 2).alias("n_unpaired"))
    return order.join(rows, keys)


def windows(samples: DataFrame, keys: list[str], width: int, first: int = 0, most: int | None = None, order: str = "sample_ix") -> DataFrame:
    """(keys, k, start, wave): consecutive windows of width samples from first on; complete ones only, most at most."""
    if width <= 0:
        raise ValueError("a window needs samples")
    k = F.floor((F.col(order) - first) / width)
    rows = samples.filter(F.col(order) >= first) if most is None else samples.filter((F.col(order) >= first) & (F.col(order) < first + most * width))
    whole = rows.groupBy(*keys, k.alias("k")).agg(F.count("*").alias("_n"), F.sort_array(F.collect_list(F.struct(F.col(order).alias("i"), F.col("value").alias("v")))).alias("_s"))
    return whole.filter(F.col("_n") == width).select(*keys, "k", (F.col("k") * width + first).alias("start"), F.transform("_s", lambda x: x["v"].cast("double")).alias("wave"))


def mean_of(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v)


def std_of(v: Column, mean: Column) -> Column:
    """Population standard deviation."""
    return F.sqrt(F.aggregate(F.transform(v, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda a, x: a + x) / F.size(v))


def scaled(chunks: DataFrame, drop_flat: bool = True, eps: float = 0.0, wave: str = "wave") -> DataFrame:
    """wave as z-scores, with the removed scale_mean_uv and scale_std_uv; flat chunks go, values that are not finite raise."""
    v = F.col(wave)
    ok = chunks.filter(F.when(F.forall(v, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))), True).otherwise(F.raise_error(F.lit("a value is not finite")).cast("boolean")))
    out = ok.withColumn("scale_mean_uv", mean_of(v)).withColumn("scale_std_uv", std_of(v, F.col("scale_mean_uv")))
    if drop_flat:
        out = out.filter("scale_std_uv > 0")
    divisor = F.nullif(F.col("scale_std_uv") + eps, F.lit(0.0))  # what stands above may look at a flat chunk before the filter does
    return out.withColumn(wave, F.transform(v, lambda x: (x - F.col("scale_mean_uv")) / divisor))


def zscore(v: Column, eps: float = EPS) -> Column:
    mean = mean_of(v)
    return F.transform(v, lambda x: (x - mean) / (std_of(v, mean) + eps))


def flat_counts(chunks: DataFrame, keys: list[str], wave: str = "wave") -> DataFrame:
    v = F.col(wave)
    return chunks.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.array_max(v) == F.array_min(v)).alias("n_flat"))


def restored(chunks: DataFrame, wave: str = "wave") -> DataFrame:
    """wave in µV again."""
    return chunks.withColumn(wave, F.transform(wave, lambda x: x * F.col("scale_std_uv") + F.col("scale_mean_uv")))


def usable(channels: DataFrame) -> DataFrame:
    """Channels with a known region and valid data, or good quality where that is what the source has."""
    good = F.col("quality") == 0 if "quality" in channels.columns else F.col("valid_data")
    return channels.filter((F.col("region") != UNKNOWN) & good)


def region_counts(labelled: DataFrame, keys: list[str]) -> DataFrame:
    """Every region, UNK included, with its rows for each key."""
    spark = labelled.sparkSession
    frame = spark.createDataFrame([(c,) for c in [*CLASSES, UNKNOWN]], "region string")
    frame = labelled.select(*keys).distinct().crossJoin(F.broadcast(frame)) if keys else frame  # six rows for each key
    return frame.join(labelled.groupBy(*keys, "region").agg(F.count("*").alias("n")), [*keys, "region"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def dataset_card(channels: DataFrame, chunks: DataFrame, regions: list, region: str = "region") -> DataFrame:
    """Per group: channels, kept, unlabelled, chunks, and chunks of each region."""
    c = channels.groupBy("grp").agg(F.count("*").alias("n_channels"), F.count_if("usable").alias("n_kept"), F.count_if(F.col(region).isNull()).alias("n_unlabelled"))
    counts = chunks.groupBy("grp").pivot(region, regions).agg(F.count("grp"))
    counts = counts.select("grp", *[F.coalesce(F.col(str(x)), F.lit(0)).alias(f"region_{x}") for x in regions])
    return c.join(chunks.groupBy("grp").agg(F.count("*").alias("n_chunks")), "grp", "left").join(counts, "grp", "left")


def skip_ledger(sources: DataFrame, kept: DataFrame, key: str, reason: Column) -> DataFrame:
    """Sources that gave no chunk, each with its reason."""
    return sources.join(kept.select(key).distinct(), key, "left_anti").select(key, reason.alias("reason"))


def fingerprint(index: DataFrame, columns: list[str]) -> DataFrame:
    """(n, fingerprint): order-free digest of the named columns; other columns do not change it."""
    row = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).cast("binary"))
    head = F.conv(F.substring(row, 1, 12), 16, 10).cast("long")
    return index.agg(F.count("*").alias("n"), F.bit_xor(head).alias("fingerprint"))


def region_profile(chunks: DataFrame, region: str, value: Column) -> DataFrame:
    return chunks.groupBy(region).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.median(value).alias("median"))


def quality_checks(chunks: DataFrame, width: int, label: str, classes: int, wave: str = "wave") -> DataFrame:
    """One row of counts that are 0 in a good store, and the spread of chunks for each channel."""
    v = F.col(wave)
    bad = chunks.agg(
        F.count("*").alias("n"), F.count_if(F.size(v) != width).alias("n_bad_width"), F.count_if(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).alias("n_nonfinite"),
        F.count_if(F.array_max(v) == F.array_min(v)).alias("n_flat"), F.count_if(~F.col(label).between(0, classes - 1)).alias("n_bad_label"),
    )
    spread = chunks.groupBy("grp", "channel").count().agg(F.min("count").alias("min_per_channel"), F.max("count").alias("max_per_channel"))
    return bad.crossJoin(spread)  # one row each
