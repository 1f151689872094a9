"""Windows by sample count over a stream of blocks: the unfinished window of a channel is carried from one micro-batch to the next."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: What is kept of a channel: where its last block began, its samples so far, and those of the unfinished window.
STATE = T.StructType([T.StructField("last", T.LongType()), T.StructField("n", T.LongType()), T.StructField("carry", T.ArrayType(T.DoubleType()))])


def advance(last: int, n: int, carry: np.ndarray, blocks: list[tuple[int, np.ndarray]], width: int, first: int = 0) -> tuple[int, int, np.ndarray, int, np.ndarray, int]:
    """(last, n, carry, number of the first new window, new windows, late blocks) after more blocks, which may come in any order."""
    late, parts = 0, [carry]
    for start, samples in sorted(blocks, key=lambda b: b[0]):
        if start <= last:
            late += 1
            continue
        last, n = start, n + len(samples)
        parts.append(samples)
    x = np.concatenate(parts)
    begin = n - len(x)
    skip = min(len(x), max(0, first - begin))
    x, begin = x[skip:], begin + skip
    whole = len(x) // width
    return last, n, x[whole * width :], (begin - first) // width, x[: whole * width].reshape(whole, width), late


def stream_windows(blocks: DataFrame, keys: list[str], width: int, first: int = 0) -> DataFrame:
    """(keys, k, wave, n_late) of a streaming table with keys, block_start and samples, in append mode.

    Windows have k and wave, each as soon as its last sample has come: those of plans.build.cut_windows, for any cut of the
    recordings into micro-batches that keeps their order. Inside a micro-batch blocks may come in any order. A block that
    begins no later than one of an earlier micro-batch, or as another one, is late: it is left out and counted in a row with
    n_late alone. A null block_start is late, null samples are an empty block. The state of a channel is smaller than a
    window; a task holds one channel's blocks of one micro-batch, which the trigger's own limits bound.
    """
    if width <= 0:
        raise ValueError("a window needs samples")
    own = blocks.select(*keys, F.coalesce(F.col("block_start").cast("long"), F.lit(-1)).alias("block_start"), F.coalesce(F.col("samples").cast("array<double>"), F.array().cast("array<double>")).alias("samples"))
    out = T.StructType([*[own.schema[k] for k in keys], T.StructField("k", T.LongType()), T.StructField("wave", T.ArrayType(T.DoubleType())), T.StructField("n_late", T.LongType())])

    def cut(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, n, carry = state.get if state.exists else (-1, 0, [])
        found = [(int(s), np.asarray(x, dtype=float)) for b in batches for s, x in zip(b["block_start"], b["samples"], strict=True)]
        last, n, rest, k, waves, late = advance(last, n, np.asarray(carry, dtype=float), found, width, first)
        state.update((last, n, rest.tolist()))
        rows = [(*key, k + i, w.tolist(), None) for i, w in enumerate(waves)] + ([(*key, None, None, late)] if late else [])
        frame = pd.DataFrame(rows, columns=out.fieldNames())
        yield frame.astype({"k": "Int64", "n_late": "Int64"})

    return own.groupBy(*keys).applyInPandasWithState(cut, out, STATE, "append", GroupStateTimeout.NoTimeout)
