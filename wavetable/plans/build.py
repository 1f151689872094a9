"""Building a chunk store from recordings in one job, with a ledger of what was left out, and the named splits of a store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavetable.functions.labels import region
from wavetable.operators import filtering
from wavetable.operators import prep as B
from wavetable.operators import splits as C
from wavetable.operators.ranks import running_totals
from wavetable.schema import UNKNOWN


def cut_windows(recordings: DataFrame, width: int, first: int = 0, most: int | None = None) -> DataFrame:
    """(grp, channel, k, wave): complete windows of a channel's blocks end to end, most at most, without a row or task that holds a channel."""
    blocks = recordings.select("grp", "channel", "block_start", F.col("samples").cast("array<double>").alias("samples"), F.coalesce(F.size("samples"), F.lit(0)).alias("_size"))
    placed = running_totals(blocks, ["block_start"], {"_end": "_size"}, ["grp", "channel"]).withColumn("_start", F.col("_end") - F.col("_size"))
    low = F.greatest(F.lit(0), F.floor((F.col("_start") - first) / width))
    high = F.floor((F.col("_end") - 1 - first) / width)
    if most is not None:
        high = F.least(high, F.lit(most - 1))
    met = placed.filter((F.col("_size") > 0) & (high >= low)).withColumn("k", F.explode(F.sequence(low, high)))
    begin = F.greatest(F.col("_start"), F.col("k") * width + first)
    end = F.least(F.col("_end"), (F.col("k") + 1) * width + first)
    pieces = met.select("grp", "channel", F.col("k").cast("int").alias("k"), F.struct(begin.alias("at"), F.slice("samples", (begin - F.col("_start") + 1).cast("int"), (end - begin).cast("int")).alias("v")).alias("_p"))
    whole = pieces.groupBy("grp", "channel", "k").agg(F.array_sort(F.collect_list("_p")).alias("_p"))
    return whole.select("grp", "channel", "k", F.flatten(F.transform("_p", lambda p: p["v"])).alias("wave")).filter(F.size("wave") == width)


def build_chunks(
    recordings: DataFrame, channels: DataFrame, fs: float, window_s: float = 3.0, start_s: float = 200.0, n_chunks: int | None = 100, target_fs: float | None = None, most_s: float | None = None
) -> tuple[DataFrame, DataFrame]:
    """(chunks, ledger). Windows are put together from the blocks that they meet; to filter and resample (target_fs) blocks
    pass on the states of the filters, so that no row or task holds a channel here either.

    recordings: grp, channel, block_start, samples (volts if target_fs is given, else microvolts); channels: grp, channel,
    acronym, depth_um, valid_data or quality, and whatever else the index is to carry. n_chunks None takes all windows. With
    most_s only blocks that begin within so many seconds are read; without it, all. The ledger has every channel that gave
    no chunk, with the reason, and every channel that most_s cut, which may have chunks.
    """
    labelled = channels.withColumn("region", region(F.col("acronym")))
    good = B.usable(labelled)
    asked = (recordings if most_s is None else recordings.filter(F.col("block_start") < most_s * fs)).join(good.select("grp", "channel"), ["grp", "channel"], "left_semi")
    rate = target_fs or fs
    width, first = round(window_s * rate), round(start_s * rate)
    zeros = asked.filter("size(samples) > 0").select("grp", "channel", F.forall("samples", lambda x: x == 0).alias("_z"))
    signals = zeros.groupBy("grp", "channel").agg(F.when(F.count_if(~F.col("_z")) > 0, False).when(F.count_if(F.col("_z").isNull()) == 0, True).alias("dead"))
    alive = signals.filter(~F.col("dead")).select("grp", "channel")  # a flat signal is told before it is filtered
    keys, cut = ["grp", "channel"], asked.join(alive, ["grp", "channel"], "left_semi")
    if target_fs:
        placed = filtering.placed_blocks(cut, keys)
        placed = placed.join(filtering.long_enough(placed, keys, *filtering.chain(fs, target_fs)), keys, "left_semi")
        cut = filtering.preprocess_blocks(placed, keys, fs, target_fs).withColumnRenamed("pos", "block_start")
    cut = cut_windows(cut, width, first, n_chunks)
    chunks = B.scaled(cut).withColumn("t0_s", (F.col("k") * width + first) / rate).withColumn("fs", F.lit(float(rate))).join(good, ["grp", "channel"])
    why = F.when(F.col("region") == UNKNOWN, "no region").when(~F.col("good"), "bad channel").when(F.col("dead").isNull(), "no recording").when(F.col("dead"), "all zeros").otherwise("no complete live window")
    listed = labelled.join(good.select("grp", "channel", F.lit(True).alias("good")), ["grp", "channel"], "left").withColumn("good", F.coalesce("good", F.lit(False)))
    lost = listed.join(chunks.select("grp", "channel").distinct(), ["grp", "channel"], "left_anti").join(signals.select("grp", "channel", "dead"), ["grp", "channel"], "left")
    ledger = lost.select("grp", "channel", why.alias("reason"))
    if most_s is not None:
        beyond = recordings.filter(F.col("block_start") >= most_s * fs).join(good.select("grp", "channel"), ["grp", "channel"], "left_semi")
        ledger = ledger.unionByName(beyond.select("grp", "channel", F.lit(f"cut at {most_s:g} s").alias("reason")).distinct())
    return chunks, ledger


def named_splits(index: DataFrame, seed: int = 0) -> DataFrame:
    """(scheme, fold, part, grp) of the splits of a store with two datasets: pooled, within each, and across both ways."""
    names = sorted(x["dataset"] for x in index.select("dataset").distinct().collect())  # a row for each dataset
    parts = [("cross_session_all", C.cross_session(index, seed))]
    parts += [(f"cross_session_{d}", C.cross_session(index.filter(F.col("dataset") == d), seed)) for d in names]
    if len(names) == 2:
        parts += [(f"cross_lab_{a}_to_{b}", C.cross_lab(index, [a], [b], seed)) for a, b in (names, names[::-1])]
    out = None
    for name, split in parts:
        part = split.select(F.lit(name).alias("scheme"), F.lit(name).alias("fold"), "part", "grp")
        out = part if out is None else out.unionByName(part)
    return out
