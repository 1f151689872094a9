"""Depth, boundaries, fusion of experts and depth uncertainty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wavetable.functions import arrays as A
from wavetable.functions.hashing import uniform
from wavetable.schema import require_columns

#: Lower edges of the distance bins in µm.
BOUNDARY_BINS = [0.0, 50.0, 100.0, 200.0, 400.0]
SPACING = 20.0


def boundaries(channels: DataFrame, region: str = "region", order: str = "channel") -> DataFrame:
    """(grp, at): label changes between depth neighbours, both edges of gaps, and both ends of the span of each group."""
    depth = channels.groupBy("grp", "depth_um").agg(F.min_by(region, order).alias("r"))
    w = W.partitionBy("grp").orderBy("depth_um")  # the depths of one probe
    steps = depth.select("grp", "depth_um", "r", F.lead("depth_um").over(w).alias("next"), F.lead("r").over(w).alias("next_r"))
    spacing = steps.groupBy("grp").agg(F.coalesce(F.median(F.col("next") - F.col("depth_um")), F.lit(SPACING)).alias("s"), F.min("depth_um").alias("low"), F.max("depth_um").alias("high"))
    both = steps.join(spacing, "grp")
    step, wide = F.col("next") - F.col("depth_um"), F.col("next") - F.col("depth_um") > 1.5 * F.col("s")
    change = both.filter(~wide & (F.col("r") != F.col("next_r"))).select("grp", (F.col("depth_um") + step / 2).alias("at"))
    gaps = both.filter(wide).select("grp", F.explode(F.array(F.col("depth_um") + F.col("s") / 2, F.col("next") - F.col("s") / 2)).alias("at"))
    ends = spacing.select("grp", F.explode(F.array(F.col("low") - F.col("s") / 2, F.col("high") + F.col("s") / 2)).alias("at"))
    return change.unionByName(gaps).unionByName(ends)


def boundary_distance(rows: DataFrame, region: str = "region", order: str = "channel") -> DataFrame:
    """rows with distance_um, to the nearest boundary of their group; distances are made once for each depth."""
    require_columns(rows, "grp", "channel", "depth_um", region)
    channels = rows.select("grp", "channel", "depth_um", region, *([order] if order != "channel" else [])).distinct()
    near = channels.select("grp", "depth_um").distinct().join(boundaries(channels, region, order), "grp").groupBy("grp", "depth_um").agg(F.min(F.abs(F.col("depth_um") - F.col("at"))).alias("distance_um"))
    return rows.join(near, ["grp", "depth_um"])


def distance_bin(distance: Column) -> Column:
    """Lower edge of the bin; bins hold their lower edge."""
    out = F.when(distance >= BOUNDARY_BINS[-1], BOUNDARY_BINS[-1])
    for edge in BOUNDARY_BINS[-2::-1]:
        out = out.when(distance >= edge, edge)
    return out


def boundary_table(rows: DataFrame, keys: list[str], sources: list[str]) -> DataFrame:
    """(keys, bin, n, accuracy of each source); rows have distance_um and a 0/1 column for each source."""
    return rows.groupBy(*keys, distance_bin(F.col("distance_um")).alias("bin")).agg(F.count("*").alias("n"), *[F.avg(F.col(s).cast("double")).alias(s) for s in sources])


def product_of_experts(probabilities: list[Column], prior: Column) -> Column:
    """Normalised product of the experts' probabilities over the prior as often as they share it."""
    if not probabilities:
        raise ValueError("no expert")
    logs = A.log_probabilities(probabilities[0])
    for p in probabilities[1:]:
        logs = F.zip_with(logs, A.log_probabilities(p), lambda a, b: a + b)
    shared = F.zip_with(logs, A.log_probabilities(prior), lambda a, b: a - (len(probabilities) - 1) * b)
    return A.softmax_array(shared)


def jittered_depth(depth: Column, group: Column, half_width: Column | float, seed: Column | int = 0) -> Column:
    """depth with one shift for each group (and seed), uniform within the half width."""
    u = uniform("jitter", seed if isinstance(seed, Column) else F.lit(seed), group)
    return depth + (2 * u - 1) * half_width


def crossing(curve: DataFrame, keys: list[str], x: str, y: str, level: str) -> DataFrame:
    """(keys, crossing): first x where y falls through level, linear between points; null if it never does."""
    w = W.partitionBy(*keys).orderBy(x)  # the points of one curve
    gap = F.col(y) - F.col(level)
    pairs = curve.withColumn("_g", gap).withColumn("_x2", F.lead(x).over(w)).withColumn("_g2", F.lead("_g").over(w))
    at = F.when((F.col("_g") >= 0) & (F.col("_g2") < 0), F.col(x) + (F.col("_x2") - F.col(x)) * F.col("_g") / (F.col("_g") - F.col("_g2")))
    return pairs.groupBy(*keys).agg(F.min(at).alias("crossing"))
