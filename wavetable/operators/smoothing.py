"""Label smoothing over time and over depth, and the scores of each stage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wavetable.functions import arrays as A
from wavetable.operators.metrics import class_report
from wavetable.schema import require_columns

WINDOW = 2


def temporal_labels(df: DataFrame, k: int, keys: list[str], prior: list[float] | None = None) -> DataFrame:
    """(keys, temporal): class of the largest mean logit, times a prior, over all rows of a channel."""
    if prior is not None and len(prior) != k:
        raise ValueError(f"a prior of {len(prior)} for {k} classes")
    means = df.groupBy(*keys).agg(*[F.avg(x).alias(f"_{i}") for i, x in enumerate(A.items(F.col("logits"), k))])
    scaled = F.array(*[F.col(f"_{i}") * F.lit(float(prior[i]) if prior else 1.0) for i in range(k)])
    return means.select(*keys, A.argmax(scaled).alias("temporal"))


def spatial_vote(channels: DataFrame, label: str, group: str = "grp", window: int = WINDOW) -> DataFrame:
    """channels with spatial: the commonest label of itself and its neighbours in depth, the smallest of equals. A group is one probe."""
    near = W.partitionBy(group).orderBy("depth_um", "channel").rowsBetween(-window, window)
    return channels.withColumn("spatial", F.mode(F.col(label), True).over(near))


def smooth(df: DataFrame, k: int, prior: list[float] | None = None, window: int = WINDOW, order: str = "chunk_id") -> tuple[DataFrame, DataFrame]:
    """Rows with raw, temporal and spatial labels, and the channel table (label: that of the channel's first row)."""
    require_columns(df, "grp", "channel", "depth_um", "label", "logits", order)
    keys = ["grp", "channel"]
    first = df.groupBy(*keys).agg(F.min("depth_um").alias("depth_um"), F.min_by("label", order).alias("label"))
    channels = spatial_vote(temporal_labels(df, k, keys, prior).join(first, keys), "temporal", window=window)
    rows = df.withColumn("raw", A.argmax(F.col("logits"))).join(channels.select(*keys, "temporal", "spatial"), keys)
    return rows, channels


def stage_scores(rows: DataFrame, channels: DataFrame, keys: list[str]) -> DataFrame:
    """class_report of each stage at chunk level (raw, temporal, spatial) and at channel level (temporal, spatial)."""
    long = None
    for level, table, stages in (("chunk", rows, ["raw", "temporal", "spatial"]), ("channel", channels, ["temporal", "spatial"])):
        part = table.select(*keys, "label", F.lit(level).alias("level"), F.inline(F.array(*[F.struct(F.lit(s).alias("stage"), F.col(s).alias("pred")) for s in stages])))
        long = part if long is None else long.unionByName(part)
    return class_report(long, [*keys, "stage", "level"])


def probabilities_as_logits(df: DataFrame, p: str = "p") -> DataFrame:
    return df.withColumn("logits", A.log_probabilities(F.col(p)))


def with_index(predictions: DataFrame, index: DataFrame) -> DataFrame:
    """Predictions with group, channel and depth of their chunk."""
    return predictions.join(index.select("chunk_id", "grp", "channel", "depth_um"), "chunk_id", "left")
