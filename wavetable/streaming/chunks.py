"""Chunking of a sample stream: the windows and normalisation of operators.prep over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavetable.operators.prep import scaled


def stream_chunks(samples: DataFrame, keys: list[str], seconds: float, width: int, lateness: str = "10 seconds", ts: str = "ts") -> DataFrame:
    """(keys, start, wave, scale_mean_uv, scale_std_uv) of each tumbling window with all of its width samples.

    samples: a streaming (or batch) table with ts and value. Samples later than `lateness` are dropped; a window is
    given once its watermark has passed, flat and incomplete ones never.
    """
    span = F.window(ts, f"{int(seconds * 1000)} milliseconds")
    held = samples.withWatermark(ts, lateness).groupBy(*keys, span).agg(F.sort_array(F.collect_list(F.struct(ts, "value"))).alias("_s"))
    whole = held.filter(F.size("_s") == width).select(*keys, F.col("window.start").alias("start"), F.transform("_s", lambda x: x["value"].cast("double")).alias("wave"))
    return scaled(whole)
