"""Temperature scaling and what it does to calibration."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavetable.functions import arrays as A
from wavetable.operators import metrics as M

LOW, HIGH = 0.05, 20.0


def temperature_grid(points: int, low: float = LOW, high: float = HIGH) -> list[float]:
    """points temperatures from low to high, evenly spaced in their logarithm."""
    return [math.exp(math.log(low) + (math.log(high) - math.log(low)) * i / (points - 1)) for i in range(points)]


def grid_nll(df: DataFrame, keys: list[str], k: int, grid: list[float]) -> DataFrame:
    """(keys, t, nll): mean negative log-likelihood at each temperature, in one pass with a sum for each."""
    x = A.items(F.col("logits"), k)
    top, right = F.greatest(*x), A.at(F.col("logits"), F.col("label"))
    shifted = df.select(*keys, F.array(*[a - top for a in x]).alias("d"), (right - top).alias("r"))
    d = A.items(F.col("d"), k)
    floor = -math.log(A.FLOOR)
    sums = [F.avg(F.least(F.log(A.total([F.exp(a / t) for a in d])) - F.col("r") / t, F.lit(floor))).alias(f"_{i}") for i, t in enumerate(grid)]
    wide = shifted.groupBy(*keys).agg(*sums)
    return wide.select(*keys, F.inline(F.array(*[F.struct(F.lit(t).alias("t"), F.col(f"_{i}").alias("nll")) for i, t in enumerate(grid)])))


def best_on_grid(df: DataFrame, keys: list[str], k: int, points: int = 41) -> DataFrame:
    """(keys, best_t): the temperature of a fixed grid with the least loss, the smaller one of equals."""
    return grid_nll(df, keys, k, temperature_grid(points)).groupBy(*keys).agg(F.min(F.struct("nll", "t")).alias("x")).select(*keys, F.col("x.t").alias("best_t"))


def fit_temperature(df: DataFrame, keys: list[str], k: int, rounds: int = 3, points: int = 21) -> DataFrame:
    """(keys, t): each round looks at a finer grid of factors around the best temperature so far, for all keys at once."""
    step = (math.log(HIGH) - math.log(LOW)) / (points - 1)
    found = best_on_grid(df, keys, k, points).withColumnRenamed("best_t", "t")
    for _ in range(rounds):
        factors = temperature_grid(points, math.exp(-step), math.exp(step))
        near = df.join(found, keys) if keys else df.crossJoin(F.broadcast(found))  # without keys one row
        scaled = near.withColumn("logits", F.transform("logits", lambda x: x / F.col("t")))
        by = _factor_nll(scaled, keys, k, factors)
        found = by.groupBy(*keys).agg(F.min(F.struct("nll", "t")).alias("x")).select(*keys, F.least(F.greatest(F.col("x.t"), F.lit(LOW)), F.lit(HIGH)).alias("t"))
        step = 2 * step / (points - 1)
    return found


def _factor_nll(scaled: DataFrame, keys: list[str], k: int, factors: list[float]) -> DataFrame:
    by = grid_nll(scaled.withColumnRenamed("t", "base"), [*keys, "base"], k, factors)
    return by.select(*keys, (F.col("base") * F.col("t")).alias("t"), "nll")


def before_after(df: DataFrame, keys: list[str], k: int, temperature: float) -> DataFrame:
    """ece, nll, brier, mean_conf at temperature 1 (_before) and at temperature (_after), and accuracy."""
    out = None
    for name, t in (("before", 1.0), ("after", temperature)):
        rows = M.with_probabilities(df, k, t)
        scores = M.probability_scores(rows, keys, k).join(M.calibration_error(rows, keys), keys)
        part = scores.select(*keys, *([] if out else ["n", "accuracy"]), *[F.col(c).alias(f"{c}_{name}") for c in ("ece", "nll", "brier", "mean_conf")])
        out = part if out is None else out.join(part, keys)
    return out


def transfer(df: DataFrame, source: str, target: str, part: str, k: int, points: int = 41) -> DataFrame:
    """Temperature fitted in the source part, the target's own, and their ratio."""
    best = best_on_grid(df.filter(F.col(part).isin(source, target)), [part], k, points)
    both = best.groupBy().agg(F.max(F.when(F.col(part) == source, F.col("best_t"))).alias("source_t"), F.max(F.when(F.col(part) == target, F.col("best_t"))).alias("target_t"))
    return both.withColumn("ratio", F.col("target_t") / F.col("source_t"))
