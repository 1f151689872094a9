"""Probability and classification metrics, for every value of the keys in one job.

Predictions have `label` (class number) and `logits` or `p` (one entry for each of k classes). Everything aggregates in
two levels: sums by (keys, bin) or (keys, label, pred), which combine before the shuffle, and then small tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavetable.functions import arrays as A
from wavetable.operators.ranks import quantiles, running_totals
from wavetable.sources.scratch import materialize

BINS = 15


def checked(df: DataFrame, p: str = "p") -> DataFrame:
    """df; a row whose probabilities are not finite or do not sum to one raises."""
    return df.filter(F.when(A.valid_probabilities(F.col(p)), True).otherwise(F.raise_error(F.lit(f"{p}: no finite probabilities that sum to 1")).cast("boolean")))


def violations(df: DataFrame, keys: list[str], p: str = "p") -> DataFrame:
    finite = A.all_finite(F.col(p))
    return df.groupBy(*keys).agg(F.count_if(~finite).alias("n_nonfinite"), F.count_if(finite & ~A.valid_probabilities(F.col(p))).alias("n_bad_sum"))


def with_probabilities(df: DataFrame, k: int, temperature: Column | float = 1.0) -> DataFrame:
    """Adds p, conf (largest of p), pred (class of the largest logit) and hit (1.0 if pred is the label)."""
    pred = A.argmax(F.col("logits"))
    return df.withColumn("p", A.softmax(F.col("logits"), k, temperature)).withColumns({"conf": F.array_max("p"), "pred": pred, "hit": (pred == F.col("label")).cast("double")})


def probability_scores(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    """nll, brier, mean_conf, accuracy of rows that have p, conf and hit."""
    right = A.at(F.col("p"), F.col("label"))
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(-F.log(F.greatest(right, F.lit(A.FLOOR)))).alias("nll"), F.avg(A.brier(F.col("p"), F.col("label"), k)).alias("brier"),
        F.avg("conf").alias("mean_conf"), F.avg("hit").alias("accuracy"),
    )


def bin_of(conf: Column, bins: int = BINS) -> Column:
    """Bins (lower, upper] from 1 on; the first one holds 0, too."""
    return F.greatest(F.lit(1), F.ceil(conf * bins).cast("int"))


def _binned(df: DataFrame, keys: list[str], by: Column) -> DataFrame:
    return df.groupBy(*keys, by.alias("bin")).agg(F.count("*").alias("n"), F.sum("conf").alias("conf"), F.sum("hit").alias("hit"))


def _gap(binned: DataFrame, keys: list[str]) -> DataFrame:
    return binned.groupBy(*keys).agg((F.sum(F.abs(F.col("hit") - F.col("conf"))) / F.sum("n")).alias("ece"))


def calibration_error(df: DataFrame, keys: list[str], bins: int = BINS) -> DataFrame:
    """Expected calibration error over bins of equal width; rows have conf and hit."""
    return _gap(_binned(df, keys, bin_of(F.col("conf"), bins)), keys)


def adaptive_calibration_error(df: DataFrame, keys: list[str], bins: int = BINS, spread: bool = True) -> DataFrame:
    """The same over bins of equal mass: edges are the distinct linear quantiles; with one edge all rows are one bin.

    The quantiles of a key are taken from histograms in rounds (ranks.quantiles), so that no task holds a key's values;
    without spread, where every key is known to be small, from its distinct values in one task. The result is the same.
    conf and hit are written once, as rounds read them again.
    """
    df = materialize(df.select(*keys, "conf", "hit"), "confidences")
    shares = [i / bins for i in range(bins + 1)]
    if spread:
        edges = quantiles(df, keys, "conf", shares)
    else:
        edges = df.groupBy(*keys).agg(F.percentile("conf", F.array(*[F.lit(s) for s in shares])).alias("quantiles"))
    edges = edges.withColumn("edges", F.array_distinct("quantiles"))
    joined = df.join(edges, keys) if keys else df.crossJoin(F.broadcast(edges))  # without keys one row
    below = A.total([F.coalesce((F.get("edges", F.lit(i)) < F.col("conf")).cast("int"), F.lit(0)) for i in range(bins + 1)])
    return _gap(_binned(joined, keys, F.when(F.size("edges") < 2, 1).otherwise(F.greatest(F.lit(1), below))), keys)


def reliability(df: DataFrame, keys: list[str], bins: int = BINS) -> DataFrame:
    """Every bin with its bounds, mean confidence, accuracy and count; empty bins have nulls and 0."""
    spark = df.sparkSession
    binned = _binned(df, keys, bin_of(F.col("conf"), bins))
    frame = spark.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    if keys:
        frame = df.select(*keys).distinct().crossJoin(F.broadcast(frame))
    found = frame.join(binned, [*keys, "bin"], "left")
    return found.select(
        *keys, "bin", ((F.col("bin") - 1) / bins).alias("lower"), (F.col("bin") / bins).alias("upper"),
        (F.col("conf") / F.col("n")).alias("confidence"), (F.col("hit") / F.col("n")).alias("accuracy"), F.coalesce("n", F.lit(0)).alias("n"),
    )


def confusion(df: DataFrame, keys: list[str], k: int | None = None) -> DataFrame:
    """(keys, label, pred, n); with k every one of the k * k cells of each key, 0 where there is no row, else those that have rows."""
    found = df.groupBy(*keys, "label", "pred").agg(F.count("*").alias("n"))
    if k is None:
        return found
    kinds = dict(found.dtypes)
    classes = [F.explode(F.sequence(F.lit(0), F.lit(k - 1)).cast(f"array<{kinds[c]}>")).alias(c) for c in ("label", "pred")]
    of_keys = found.select(*keys).distinct() if keys else found.sparkSession.range(1).select()
    cells = of_keys.select(*keys, classes[0]).select("*", classes[1])
    return cells.join(found, [*keys, "label", "pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def recalls(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Of a confusion table: support, predicted, hits, recall and f1 of each label that is present."""
    right = F.col("n") * (F.col("label") == F.col("pred")).cast("int")
    truth = counts.groupBy(*keys, "label").agg(F.sum("n").alias("support"), F.sum(right).alias("hits"))
    said = counts.groupBy(*keys, F.col("pred").alias("label")).agg(F.sum("n").alias("predicted"))
    return truth.join(said, [*keys, "label"], "left").withColumns({
        "predicted": F.coalesce("predicted", F.lit(0)), "recall": F.col("hits") / F.col("support"),
        "f1": 2 * F.col("hits") / (F.col("support") + F.coalesce("predicted", F.lit(0))),
    })


def class_report(df: DataFrame, keys: list[str]) -> DataFrame:
    """n, accuracy, balanced_accuracy, macro_f1, chance, band, majority, margin; averages are over the classes present."""
    return _class_report(confusion(df, keys), keys)


def _class_report(counts: DataFrame, keys: list[str]) -> DataFrame:
    by = recalls(counts, keys)
    return by.groupBy(*keys).agg(
        F.sum("support").alias("n"), (F.sum("hits") / F.sum("support")).alias("accuracy"), F.avg("recall").alias("balanced_accuracy"), F.avg("f1").alias("macro_f1"),
        (1 / F.count("*")).alias("chance"), (3 * F.sqrt(F.sum(0.25 / F.col("support"))) / F.count("*")).alias("band"), (F.max("support") / F.sum("support")).alias("majority"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("label"), F.col("recall"))))).alias("per_class_recall"),
    ).withColumn("margin", F.col("accuracy") - F.col("majority"))


def full_report(df: DataFrame, keys: list[str], k: int, flags: tuple[str, ...] = ()) -> DataFrame:
    """class_report with nll, brier, mean_conf and ece; rows have p, conf, pred and hit. flags: columns that hold for a key if they hold in all its rows.

    df is read once, into sums by (keys, label, pred, bin); as models may have to be run for each of its rows.
    """
    values = {"nll": -F.log(F.greatest(A.at(F.col("p"), F.col("label")), F.lit(A.FLOOR))), "brier": A.brier(F.col("p"), F.col("label"), k), "mean_conf": F.col("conf")}
    parts = [x for name, v in values.items() for x in (F.sum(v).alias(name), F.count(v).alias(f"_n_{name}"))]
    cells = df.groupBy(*keys, "label", "pred", bin_of(F.col("conf")).alias("bin")).agg(F.count("*").alias("n"), F.sum("conf").alias("conf"), F.sum("hit").alias("hit"), *parts, *[F.bool_and(c).alias(c) for c in flags])
    cells = materialize(cells, "cells")
    scores = cells.groupBy(*keys).agg(*[(F.sum(name) / F.nullif(F.sum(f"_n_{name}"), F.lit(0))).alias(name) for name in values], *[F.bool_and(c).alias(c) for c in flags])
    ece = _gap(cells.groupBy(*keys, "bin").agg(*[F.sum(c).alias(c) for c in ("n", "conf", "hit")]), keys)
    report = _class_report(cells.groupBy(*keys, "label", "pred").agg(F.sum("n").alias("n")), keys)
    if not keys:
        return report.crossJoin(scores).crossJoin(ece)  # one row each
    return report.join(scores, keys).join(ece, keys)


def scorable(df: DataFrame, keys: list[str], rows: int = 2, classes: int = 2) -> DataFrame:
    """Keys with enough rows and classes for a score."""
    return df.groupBy(*keys).agg(F.count("*").alias("_n"), F.count_distinct("label").alias("_k")).filter((F.col("_n") >= rows) & (F.col("_k") >= classes)).select(*keys)


def roc_auc(df: DataFrame, keys: list[str], score: str = "score", positive: str = "positive") -> DataFrame:
    """Area under the ROC curve, ties counted half, from one row for each distinct score; null without both classes."""
    by = df.groupBy(*keys, score).agg(F.count_if(F.col(positive)).alias("pos"), F.count_if(~F.col(positive)).alias("neg"))
    run = running_totals(by, [score], {"upto": "neg"}, keys)
    area = F.sum(F.col("pos") * (F.col("upto") - F.col("neg") / 2))
    return run.groupBy(*keys).agg((area / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("auc"))


def noise_band(df: DataFrame, keys: list[str]) -> DataFrame:
    by = df.groupBy(*keys, "label").agg(F.count("*").alias("n"))
    return by.groupBy(*keys).agg((3 * F.sqrt(F.sum(0.25 / F.col("n"))) / F.count("*")).alias("band"), (1 / F.count("*")).alias("chance"))

