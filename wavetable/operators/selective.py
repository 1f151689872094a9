"""Uncertainty scores, risk against coverage, separation of two sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wavetable.functions import arrays as A
from wavetable.operators.metrics import roc_auc
from wavetable.operators.ranks import running_totals
from wavetable.operators.sums import summed

POINTS = 100
COVERAGES = {"risk_full": 1.0, "risk_half": 0.5, "risk_fifth": 0.2}


def uncertainty(p: Column, k: int) -> dict[str, Column]:
    return {"max_softmax": 1 - F.array_max(p), "entropy": A.entropy(p, k)}


def long_scores(df: DataFrame, k: int, keep: list[str]) -> DataFrame:
    """One row for each row and score: keep, score (its name), value."""
    scores = uncertainty(F.col("p"), k)
    return df.select(*keep, F.inline(F.array(*[F.struct(F.lit(n).alias("score"), c.alias("value")) for n, c in scores.items()])))


def risk_coverage(df: DataFrame, keys: list[str], tie: str, value: str = "value", wrong: str = "wrong", points: int = POINTS) -> DataFrame:
    """(keys, coverage, k, risk): error rate among the k rows of least uncertainty, on a grid of coverages; ties by `tie`."""
    run = running_totals(df.select(*keys, value, tie, F.col(wrong).cast("long").alias("wrong")), [value, tie], {"rank": "1L", "errors": "wrong"}, keys)
    total = df.groupBy(*keys).agg(F.count("*").alias("n"))
    # coverages run evenly from 1/n to 1; numbers are rounded to the even neighbour
    grid = total.select(*keys, "n", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    coverage = 1 / F.col("n") + F.col("i") * (1 - 1 / F.col("n")) / (points - 1)
    grid = grid.withColumn("coverage", coverage).withColumn("rank", F.greatest(F.lit(1), F.bround(F.col("coverage") * F.col("n"))).cast("long"))
    joined = grid.join(run.select(*keys, "rank", "errors"), [*keys, "rank"])
    return joined.select(*keys, "i", "coverage", F.col("rank").alias("k"), (F.col("errors") / F.col("rank")).alias("risk"))


def risk_summary(df: DataFrame, keys: list[str], tie: str, value: str = "value", wrong: str = "wrong") -> DataFrame:
    """aurc (trapezoids over the curve) and the risks at full, half and a fifth of coverage."""
    curve = risk_coverage(df, keys, tie, value, wrong)
    w = W.partitionBy(*keys).orderBy("i")  # POINTS rows for each key
    strips = curve.withColumn("strip", (F.col("coverage") - F.lag("coverage").over(w)) * (F.col("risk") + F.lag("risk").over(w)) / 2)
    area = strips.groupBy(*keys).agg(F.sum("strip").alias("aurc"))
    run = running_totals(df.select(*keys, value, tie, F.col(wrong).cast("long").alias("wrong")), [value, tie], {"rank": "1L", "errors": "wrong"}, keys)
    total = df.groupBy(*keys).agg(F.count("*").alias("n"))
    wanted = total.select(*keys, F.inline(F.array(*[F.struct(F.lit(n).alias("at"), F.greatest(F.lit(1), F.bround(F.col("n") * c)).cast("long").alias("rank")) for n, c in COVERAGES.items()])))
    risks = wanted.join(run, [*keys, "rank"]).groupBy(*keys).agg(*[F.max(F.when(F.col("at") == n, F.col("errors") / F.col("rank"))).alias(n) for n in COVERAGES])
    return area.join(risks, keys) if keys else area.crossJoin(risks)


def separation_auc(inside: DataFrame, outside: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """How well a score tells rows of outside (positive) from rows of inside."""
    both = inside.select(*keys, value, F.lit(False).alias("positive")).unionByName(outside.select(*keys, value, F.lit(True).alias("positive")))
    return roc_auc(both, keys, value, "positive")


def gram(df: DataFrame, vector: str, d: int) -> tuple[int, np.ndarray, np.ndarray, float]:
    """Rows, mean, centred scatter matrix and sum of fourth powers of centred norms; the tasks' sums are added up in tasks."""
    rows = df.select(F.col(vector).cast("array<double>").alias("v"))

    def total(of: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            s = np.zeros(size)
            for b in filter(len, batches):
                s += of(np.stack(b.column(0).to_numpy(zero_copy_only=False)).astype(float))
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([s.tobytes()], pa.binary())], ["config", "sums"])

        return summed(rows.mapInArrow(run, "config int, sums binary")).get(0, np.zeros(size))

    sums = total(lambda x: np.append(x.sum(axis=0), len(x)), d + 1)
    n = int(sums[-1])
    if n < d // 4:
        raise ValueError(f"{n} rows are too few for {d} dimensions")
    mean = sums[:-1] / max(n, 1)

    def scatter(x: np.ndarray) -> np.ndarray:
        x = x - mean
        return np.append((x.T @ x).ravel(), ((x * x).sum(axis=1) ** 2).sum())

    found = total(scatter, d * d + 1)
    return n, mean, found[:-1].reshape(d, d), float(found[-1])


def shrunk_covariance(n: int, scatter: np.ndarray, fourth: float) -> np.ndarray:
    """Ledoit-Wolf: the sample covariance drawn towards a multiple of the identity."""
    p = len(scatter)
    s = scatter / n
    mu = np.trace(s) / p
    delta = float(((s - mu * np.eye(p)) ** 2).sum()) / p
    beta = min(delta, (fourth / n - float((s * s).sum())) / (n * p))
    share = beta / delta if delta else 0.0
    return (1 - share) * s + share * mu * np.eye(p)


def mahalanobis(train: DataFrame, df: DataFrame, vector: str, d: int, keep: list[str]) -> DataFrame:
    """keep and distance of each row from the mean of train, under its shrunk covariance."""
    n, mean, scatter, fourth = gram(train, vector, d)
    inverse = np.linalg.pinv(shrunk_covariance(n, scatter, fourth))

    @F.pandas_udf("double")
    def distance(v):
        import pandas as pd

        x = np.stack(v.to_numpy()).astype(float) - mean
        return pd.Series(np.sqrt(np.maximum(0, ((x @ inverse) * x).sum(axis=1))))

    return df.select(*keep, distance(F.col(vector)).alias("distance"))


def abstention_study(inside: DataFrame, outside: DataFrame, k: int, tie: str, vector: str | None = None, train: DataFrame | None = None, d: int = 0) -> DataFrame:
    """One row for each score: aurc, the risks at full, half and a fifth of coverage (on outside), and how well it tells outside from inside.

    inside, outside: predictions on the known and on the new data, with p and wrong. Scores are those of uncertainty, and with
    vector (d wide) the distance from the mean of train, or of inside where train is not given.
    """
    keep = [tie, "wrong"]

    def scored(df: DataFrame) -> DataFrame:
        rows = long_scores(df, k, keep)
        if vector is None:
            return rows
        far = mahalanobis(inside if train is None else train, df, vector, d, keep)
        return rows.unionByName(far.select(*keep, F.lit("mahalanobis").alias("score"), F.col("distance").alias("value")))

    known, new = scored(inside), scored(outside)
    return risk_summary(new, ["score"], tie).join(separation_auc(known, new, ["score"]).select("score", F.col("auc").alias("in_vs_out_auc")), "score")
