"""Zero-phase filters over recordings in blocks, without a row or task that holds a channel.

A filter's state after a block is a linear map of its state before it: A ** length, plus the state that the block leaves
when it begins at rest. Each block gives that state; the maps, a few numbers for each block, are put together like running
totals: ranges of (keys, order), one map for each range, the states at the beginning of the ranges, then those of the
blocks inside. Each block then runs from its own state. The way back does the same from the other end.

plain gives the bits of one loop in doubles over a whole channel: states found by maps are only guesses of where ranges of
blocks begin. A range that begins elsewhere than the one before it ended runs again from there, until none does. The first
range begins right, so there are as many rounds as ranges of a channel at most; two runs from nearly the same state soon meet
unless the cut is very low for the rate, so that few rounds are usual.

Defined cases: blocks may have any sizes, and null and empty ones count as nothing; the odd extension at both ends is a
block of its own, put together from the few samples that it mirrors; a channel that is no longer than that extension raises,
as it does in dsp.zero_phase (long_enough tells such channels); values that are not finite spread to the whole channel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wavetable.functions import dsp
from wavetable.operators.ranks import running_totals
from wavetable.sources.scratch import materialize


def placed_blocks(blocks: DataFrame, keys: list[str], order: str = "block_start", samples: str = "samples") -> DataFrame:
    """(keys, pos, size, samples): blocks end to end, pos being the samples before a block."""
    sized = blocks.select(*keys, F.col(order).alias("_order"), F.col(samples).cast("array<double>").alias("samples")).withColumn("size", F.size("samples")).filter("size > 0")
    return running_totals(sized, ["_order"], {"_end": "size"}, keys).select(*keys, (F.col("_end") - F.col("size")).alias("pos"), "size", "samples")


def long_enough(placed: DataFrame, keys: list[str], sections: list[np.ndarray], steps: list[int]) -> DataFrame:
    """keys of channels that every one of the filters can take, each of which gets every so many'th sample of the recording."""
    n = placed.groupBy(*keys).agg(F.sum("size").alias("_n"))
    for sos, step in zip(sections, steps):
        n = n.filter(F.ceil(F.col("_n") / step) > dsp.edge_of(sos))
    return n.select(*keys)


def extended(placed: DataFrame, keys: list[str], edge: int) -> DataFrame:
    """placed with a block before and one after each channel: its samples turned about its end points."""
    n = placed.groupBy(*keys).agg(F.sum("size").alias("_n"))
    checked = n.withColumn("_n", F.when(F.col("_n") > edge, F.col("_n")).otherwise(F.raise_error(F.concat(F.col("_n").cast("string"), F.lit(f" samples are too few to filter; more than {edge} are needed"))).cast("long")))
    near = placed.join(checked, keys).filter((F.col("pos") <= edge) | (F.col("pos") + F.col("size") >= F.col("_n") - edge))

    def joined(at: Column, rows: DataFrame) -> DataFrame:
        pieces = rows.select(*keys, "_n", F.struct("pos", at.alias("v")).alias("_p")).groupBy(*keys, "_n").agg(F.array_sort(F.collect_list("_p")).alias("_p"))
        return pieces.withColumn("v", F.flatten(F.transform("_p", lambda p: p["v"])))

    head = joined(F.slice("samples", 1, (edge + 1 - F.col("pos")).cast("int")), near.filter(F.col("pos") <= edge))
    skip = F.greatest(F.lit(0), F.col("_n") - edge - 1 - F.col("pos")).cast("int")
    tail = joined(F.slice("samples", skip + 1, F.col("size")), near.filter(F.col("pos") + F.col("size") >= F.col("_n") - edge))
    before = head.select(*keys, F.lit(-edge).cast("long").alias("pos"), F.lit(edge).alias("size"), F.transform(F.sequence(F.lit(edge), F.lit(1), F.lit(-1)), lambda i: 2 * F.get("v", F.lit(0)) - F.get("v", i)).alias("samples"))
    after = tail.select(*keys, F.col("_n").alias("pos"), F.lit(edge).alias("size"), F.transform(F.sequence(F.lit(1), F.lit(edge)), lambda i: 2 * F.get("v", F.lit(edge)) - F.get("v", F.lit(edge) - i)).alias("samples"))
    return placed.unionByName(before).unionByName(after)


class _Maps:
    """Powers of a filter's step, and states carried over blocks of given lengths."""

    def __init__(self, sos: np.ndarray) -> None:
        self.step, self.powers = dsp.step_matrix(sos), {}

    def after(self, state: np.ndarray, length: int, left: np.ndarray) -> np.ndarray:
        if length not in self.powers:
            self.powers[length] = np.linalg.matrix_power(self.step, length)
        return self.powers[length] @ state + left


def block_states(ends: DataFrame, keys: list[str], sos: np.ndarray) -> DataFrame:
    """(keys, at, state) for blocks (keys, at, size, left, u): the state in which each begins. left: what it leaves from rest; u: its first sample.

    Tasks go through sorted rows and carry a state along; none holds more than a batch of them.
    """
    kinds = [f"`{c}` {t}" for c, t in ends.select(*keys).dtypes]
    parts = materialize(ends.repartitionByRange(*keys, "at").withColumn("part", F.spark_partition_id()), "states")
    first = parts.groupBy(*keys).agg(F.min_by("u", "at").alias("u"))

    def of_ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The map of each (keys, part): its samples, and what it leaves from rest."""
        maps, now, state, total = _Maps(sos), None, None, 0
        names = [*keys, "part", "size", "left"]
        for frame in batches:
            done = []
            for *key, size, left in zip(*(frame[[*keys, "part", "size"]].astype(object)[c] for c in names[:-1]), frame["left"]):
                if key != now:
                    if now is not None:
                        done.append((*now, total, state.astype(float).tolist()))
                    now, state, total = key, np.zeros(2 * len(sos)), 0
                state, total = maps.after(state, size, left), total + size
            yield pd.DataFrame(done, columns=names)
        if now is not None:
            yield pd.DataFrame([(*now, total, state.astype(float).tolist())], columns=names)

    def carried(by: list[str], at: str, begin) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        """(keys, at, state) of rows sorted by (by, at): the state before each; begin gives that of the first row of `by`."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            maps, now, state = _Maps(sos), None, None
            for frame in batches:
                out, ids = [], list(zip(*(frame[c].astype(object) for c in by)))
                for i, (key, size, left) in enumerate(zip(ids, frame["size"].tolist(), frame["left"])):
                    if key != now:
                        now, state = key, begin(frame, i)
                    out.append(state.astype(float).tolist())
                    state = maps.after(state, size, left)
                yield frame[[*keys, at]].assign(state=pd.Series(out, index=frame.index, dtype=object))

        return run

    ranges = parts.repartition("part").sortWithinPartitions("part", *keys, "at").mapInPandas(of_ranges, ", ".join([*kinds, "part int", "size long", "left array<double>"]))
    of_keys = carried(keys, "part", lambda frame, i: dsp.settled(sos).ravel() * frame["u"].iloc[i])
    # a row for each range of a channel
    starts = ranges.join(first, keys).repartition(*keys).sortWithinPartitions(*keys, "part").mapInPandas(of_keys, ", ".join([*kinds, "part int", "state array<double>"]))
    of_blocks = carried(["part", *keys], "at", lambda frame, i: np.array(frame["begin"].iloc[i]))
    inside = parts.join(starts.withColumnRenamed("state", "begin"), [*keys, "part"])
    return inside.repartition("part").sortWithinPartitions("part", *keys, "at").mapInPandas(of_blocks, ", ".join([*kinds, "at long", "state array<double>"]))


def _one_way(blocks: DataFrame, keys: list[str], sos: np.ndarray, back: bool) -> DataFrame:
    """blocks (keys, pos, size, samples) filtered from one end to the other."""
    at = -(F.col("pos") + F.col("size")) if back else F.col("pos")
    turned = blocks.withColumn("at", at.cast("long")).withColumn("samples", F.reverse("samples") if back else F.col("samples"))
    shape = (len(sos), 2)

    @F.pandas_udf("array<double>")
    def leaves(values: pd.Series) -> pd.Series:
        return dsp.by_length(values, lambda x, _: dsp.run_from(sos, x, np.zeros((len(x), *shape)))[1].reshape(len(x), -1).astype(float))

    @F.pandas_udf("array<double>")
    def runs(values: pd.Series, states: pd.Series) -> pd.Series:
        return dsp.by_length(values, lambda x, places: dsp.run_from(sos, x, np.stack(states.iloc[places]).reshape(len(x), *shape))[0].astype(float))

    states = block_states(turned.select(*keys, "at", "size", leaves("samples").alias("left"), F.get("samples", F.lit(0)).alias("u")), keys, sos)
    out = turned.join(states, [*keys, "at"]).withColumn("samples", runs("samples", "state"))
    return out.select(*keys, "pos", "size", (F.reverse("samples") if back else F.col("samples")).alias("samples"))


def _one_way_plain(blocks: DataFrame, keys: list[str], sos: np.ndarray, back: bool) -> DataFrame:
    """_one_way with the bits of a loop in doubles; tasks go through sorted rows and hold no more than a batch of them."""
    at = -(F.col("pos") + F.col("size")) if back else F.col("pos")
    turned = blocks.select(*keys, at.cast("long").alias("at"), "pos", "size", (F.reverse("samples") if back else F.col("samples")).alias("samples"))
    kinds = [f"`{c}` {t}" for c, t in blocks.select(*keys).dtypes]
    parts = materialize(turned.repartitionByRange(*keys, "at").withColumn("part", F.spark_partition_id()), "parts")
    by = [*keys, "part"]

    def from_starts(starts: DataFrame, run, schema: list[str]) -> DataFrame:
        return parts.join(starts, by).repartition("part").sortWithinPartitions("part", *keys, "at").mapInPandas(run, ", ".join([*kinds, *schema]))

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, list]]:
        """Frames with the filtered samples in place of samples, and (keys and part, samples so far, first sample, begin, state) after each row."""
        now = None
        for frame in batches:
            out, after = [], []
            for *key, x, begin in zip(*(frame[c].astype(object) for c in by), frame["samples"], frame["state"]):
                x = np.asarray(x, float).tolist()
                if key != now:
                    now, n, u, state = key, 0, x[0], [float(v) for v in begin]
                out.append(dsp.run_plain(sos, x, state))
                n += len(x)
                after.append((*key, n, u, list(begin), list(state)))
            yield frame.assign(samples=pd.Series(out, index=frame.index, dtype=object)), after

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, last = [*by, "size", "u", "state", "end"], None
        for _, after in runs(batches):
            rows = ([last] if last else []) + after
            done = [a for a, b in zip(rows, rows[1:]) if a[: len(by)] != b[: len(by)]]
            last = rows[-1] if rows else None
            yield pd.DataFrame(done, columns=names)
        if last:
            yield pd.DataFrame([last], columns=names)

    def filtered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, _ in runs(batches):
            yield frame[[*keys, "pos", "size", "samples"]]

    end_kinds = ["part int", "size long", "u double", "state array<double>", "end array<double>"]
    rest = from_starts(parts.select(*by).distinct().withColumn("state", F.array(*[F.lit(0.0)] * (2 * len(sos)))), ends, end_kinds)
    guess = block_states(rest.select(*keys, F.col("part").cast("long").alias("at"), "size", F.col("end").alias("left"), "u"), keys, sos)
    known = materialize(from_starts(guess.select(*keys, F.col("at").cast("int").alias("part"), "state"), ends, end_kinds).select(*by, "state", "end"), "runs")
    while True:
        before = F.lag("end").over(W.partitionBy(*keys).orderBy("part"))  # a row for each range of a channel
        moved = known.select(*by, "state", F.coalesce(before, "state").alias("begin")).filter(~F.col("begin").eqNullSafe(F.col("state")))
        moved = materialize(moved.select(*by, F.col("begin").alias("state")), "moved")
        if not moved.take(1):
            break
        known = materialize(known.join(moved, by, "left_anti").unionByName(from_starts(moved, ends, end_kinds).select(*by, "state", "end")), "runs")
    out = from_starts(known.select(*by, "state"), filtered, ["pos long", "size int", "samples array<double>"])
    return out.withColumn("samples", F.reverse("samples")) if back else out


def zero_phase_blocks(placed: DataFrame, keys: list[str], sos: np.ndarray, plain: bool = False) -> DataFrame:
    """placed (keys, pos, size, samples) filtered forward and backward; the same as dsp.zero_phase of each whole channel, or with plain as a loop in doubles."""
    one_way = _one_way_plain if plain else _one_way
    wide = materialize(extended(placed, keys, dsp.edge_of(sos)), "extended")
    there = materialize(one_way(wide, keys, sos, back=False), "forward")
    back = one_way(there, keys, sos, back=True)
    end = back.join(placed.groupBy(*keys).agg(F.sum("size").alias("_n")), keys)
    return end.filter((F.col("pos") >= 0) & (F.col("pos") < F.col("_n"))).select(*keys, "pos", "size", "samples")


def decimated(placed: DataFrame, keys: list[str], step: int) -> DataFrame:
    """Every step'th sample of each channel."""
    begin = placed.withColumnRenamed("pos", "_at")  # in a lambda, `pos` would be the new column
    kept = F.filter("samples", lambda x, i: (F.col("_at") + i) % step == 0)
    return begin.select(*keys, F.ceil(F.col("_at") / step).cast("long").alias("pos"), kept.alias("samples")).withColumn("size", F.size("samples")).filter("size > 0").select(*keys, "pos", "size", "samples")


def chain(fs: float, target: float, cut: float = 0.1) -> tuple[list[np.ndarray], list[int]]:
    """The filters of preprocess_blocks, and of how many samples of the recording each gets one."""
    step = round(fs / target)
    low = [dsp.butterworth(4, target / 2, fs, "low")] if step > 1 else []
    return [*low, dsp.butterworth(2, cut, fs / step, "high")], [1] * len(low) + [step]


def preprocess_blocks(placed: DataFrame, keys: list[str], fs: float, target: float, cut: float = 0.1, plain: bool = False) -> DataFrame:
    """dsp.preprocess of each whole channel: low-pass, decimation by a whole factor, high-pass; volts to microvolts."""
    sections, steps = chain(fs, target, cut)
    if len(sections) > 1:
        placed = materialize(decimated(zero_phase_blocks(placed, keys, sections[0], plain), keys, steps[-1]), "decimated")
    out = zero_phase_blocks(placed, keys, sections[-1], plain)
    return out.withColumn("samples", F.transform("samples", lambda x: x * 1e6))
