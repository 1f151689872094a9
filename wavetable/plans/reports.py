"""Report tables from fold metrics and run tables. These are small; windows over them need no care."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavetable.operators.calibration import before_after, transfer
from wavetable.operators.geometry import crossing

SUMMARY_KEYS = ["scheme", "view", "features", "model", "control"]
#: Pairs up to which the null distribution of the signed-rank sum is exact.
EXACT = 50
LEAST_FOLDS = 3
#: The seed in the tag of a run.
SEED = r"__seed([0-9]+)(?=__|$)"


def merge_results(old: DataFrame, new: DataFrame, key: str = "features") -> DataFrame:
    """old without the rows of the feature sets in new, and new."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def summarise(folds: DataFrame, keys: list[str] = SUMMARY_KEYS, means: tuple[str, ...] = ("macro_f1", "ece", "nll", "chance")) -> DataFrame:
    """Mean and sample deviation over folds, sorted by accuracy inside scheme and view."""
    out = folds.groupBy(*keys).agg(
        F.count("fold").alias("folds"), F.avg("balanced_accuracy").alias("balanced_accuracy"), F.stddev_samp("balanced_accuracy").alias("balanced_accuracy_sd"),
        *[F.avg(m).alias(m) for m in means if m in folds.columns], F.sum("n_test").alias("n_test"),
    )
    return out.orderBy(*[k for k in keys if k in ("scheme", "view")], F.desc("balanced_accuracy"))


def signed_rank_null(spark: SparkSession, most: int = EXACT) -> DataFrame:
    """(pairs, statistic, p): two-sided exact p of the smaller signed-rank sum; every subset of the ranks is as likely."""
    rows, counts = [], [1]
    for n in range(1, most + 1):
        longer = counts + [0] * n
        for s, c in enumerate(counts):
            longer[s + n] += c
        counts, below = longer, 0
        for s in range(n * (n + 1) // 4 + 1):
            below += counts[s]
            rows.append((n, float(s), min(1.0, 2.0 * below / 2.0**n)))
    return spark.createDataFrame(rows, "pairs int, statistic double, p double")


@F.pandas_udf(T.DoubleType())
def two_sided(z):
    return z.map(lambda x: None if x != x else math.erfc(abs(x) / math.sqrt(2)))


def signed_rank(pairs: DataFrame, keys: list[str], difference: str = "d") -> DataFrame:
    """(keys, statistic, p_value) of the signed-rank test; exact without ties and zeros up to EXACT pairs, else normal; all zeros: p 1."""
    w = W.partitionBy(*keys)
    size = F.abs(F.col(difference))
    some = pairs.withColumn("_all", F.count("*").over(w)).filter(F.col(difference) != 0)
    ranked = some.withColumn("_r", F.rank().over(w.orderBy(size)) + (F.count("*").over(W.partitionBy(*keys, size)) - 1) / 2).withColumn("_t", F.count("*").over(W.partitionBy(*keys, size)))
    by = ranked.groupBy(*keys).agg(
        F.count("*").cast("int").alias("pairs"), F.max("_all").alias("_all"), F.sum(F.when(F.col(difference) > 0, F.col("_r")).otherwise(0.0)).alias("_p"),
        F.sum(F.when(F.col(difference) < 0, F.col("_r")).otherwise(0.0)).alias("_m"), F.sum(F.col("_t") * F.col("_t") - 1).alias("_ties"),
    ).withColumn("statistic", F.least("_p", "_m"))
    n = F.col("pairs")
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("_ties") / 48)
    exact = (n <= EXACT) & (F.col("_ties") == 0) & (F.col("_all") == n)
    found = by.join(F.broadcast(signed_rank_null(pairs.sparkSession)), ["pairs", "statistic"], "left")
    p = F.when(exact, F.col("p")).otherwise(two_sided((F.col("statistic") - n * (n + 1) / 4) / sd))
    every = pairs.select(*keys).distinct()
    return every.join(found.select(*keys, "statistic", p.alias("p_value")), keys, "left").withColumn("p_value", F.coalesce("p_value", F.lit(1.0)))


def paired_comparison(folds: DataFrame, keys: list[str], score: str = "balanced_accuracy", least: int = LEAST_FOLDS) -> DataFrame:
    """Every pair of feature sets on the folds that both have: median difference, wins, signed-rank test."""
    a = folds.select(*keys, "fold", F.col("features").alias("a"), F.col(score).alias("_a"))
    b = folds.select(*keys, "fold", F.col("features").alias("b"), F.col(score).alias("_b"))
    pairs = a.join(b, [*keys, "fold"]).filter("a < b and _a is not null and _b is not null").withColumn("d", F.col("_a") - F.col("_b"))
    own = [*keys, "a", "b"]
    by = pairs.groupBy(*own).agg(F.count("*").alias("folds"), F.median("d").alias("median_difference"), F.count_if(F.col("d") > 0).alias("a_wins")).filter(F.col("folds") >= least)
    return by.join(signed_rank(pairs, own), own)


def baseline_report(summary: DataFrame, leaky: tuple[str, ...] = ("span_fraction",)) -> DataFrame:
    """Ranked table per scheme: each feature set beside its permuted control and chance."""
    model = summary.filter(~F.col("control") & ~F.col("features").isin(*leaky))
    null = summary.filter("control").select("scheme", "features", F.col("balanced_accuracy").alias("permuted"))
    rank = F.row_number().over(W.partitionBy("scheme").orderBy(F.desc("balanced_accuracy"), "features"))
    return model.join(null, ["scheme", "features"], "left").select("scheme", rank.alias("rank"), "features", "balanced_accuracy", "balanced_accuracy_sd", "permuted", "chance", (F.col("permuted") - F.col("chance")).alias("null_bias"))


def baseline_pairs(folds: DataFrame, keys: tuple[str, ...] = ("scheme", "view", "model"), leaky: tuple[str, ...] = ("span_fraction",)) -> DataFrame:
    """paired_comparison of the baselines, without controls and leaky features."""
    return paired_comparison(folds.filter(~F.col("control") & ~F.col("features").isin(*leaky)), list(keys))


def leakage_check(folds: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, folds, permuted, chance, bias): what rows of permuted labels score beside chance."""
    by = folds.filter("control").groupBy(*keys).agg(F.count("*").alias("folds"), F.avg("balanced_accuracy").alias("permuted"), F.avg("chance").alias("chance"))
    return by.withColumn("bias", F.col("permuted") - F.col("chance"))


def latest_run(runs: DataFrame, tags: list[str] | None = None) -> DataFrame:
    """(tag, run_id, path) of the last run of each tag; a tag that is asked for and has none raises."""
    found = runs.groupBy("tag").agg(F.max("run_id").alias("run_id"), F.max_by("path", "run_id").alias("path"))
    if tags is None:
        return found
    asked = runs.sparkSession.createDataFrame([(t,) for t in tags], "tag string").join(found, "tag", "left")
    return asked.withColumn("run_id", F.when(F.col("run_id").isNotNull(), F.col("run_id")).otherwise(F.raise_error(F.concat(F.lit("no run of "), F.col("tag")))))


def config_table(runs: DataFrame, scores: list[str]) -> DataFrame:
    """Tags like <config>__seed<n> or <config>__seed<n>__<variant> across their seeds: mean and sample deviation of each score."""
    named = runs.withColumn("config", F.regexp_replace("tag", SEED, "")).withColumn("seed", F.regexp_extract("tag", SEED, 1))
    return named.groupBy("config", "stage").agg(F.count_distinct("seed").alias("seeds"), *[x for s in scores for x in (F.avg(s).alias(f"{s}_mean"), F.stddev_samp(s).alias(f"{s}_sd"))])


def fix_table(scores: DataFrame, ece: DataFrame, identity: DataFrame, controls: DataFrame) -> DataFrame:
    """config_table of raw accuracy, margin over the majority, balanced accuracy and chance, beside the means over seeds of what is known of their runs.

    scores: tag, stage, raw_accuracy, majority, balanced_accuracy, chance. ece: tag, ece. identity: tag, identity_auc.
    controls: config and a column for each control. What a run or configuration lacks is null.
    """
    table = config_table(scores.withColumn("margin", F.col("raw_accuracy") - F.col("majority")), ["raw_accuracy", "margin", "balanced_accuracy", "chance"])
    tags = scores.select("tag").distinct().join(ece, "tag", "left").join(identity, "tag", "left").withColumn("config", F.regexp_replace("tag", SEED, ""))
    known = tags.groupBy("config").agg(F.avg("ece").alias("ece"), F.avg("identity_auc").alias("identity_auc"))
    return table.join(known, "config", "left").join(controls, "config", "left")


def run_summary(runs: DataFrame) -> DataFrame:
    """(scheme, run, band, groups, and means): runs of true labels. runs: scheme, run, fold, control, balanced_accuracy, chance, ece, lowpass_hz, identity_auc."""
    band = F.when(F.max("lowpass_hz") > 0, F.format_string("<=%d Hz", F.max("lowpass_hz").cast("int"))).otherwise("full")
    return runs.filter(~F.col("control")).groupBy("scheme", "run").agg(
        band.alias("band"), F.count("*").alias("groups"), F.avg("balanced_accuracy").alias("balanced_accuracy"), F.stddev_samp("balanced_accuracy").alias("balanced_accuracy_sd"),
        F.avg("chance").alias("chance"), F.avg("ece").alias("ece"), F.avg("identity_auc").alias("identity_auc"),
    )


def paired_sessions(runs: DataFrame, baselines: DataFrame, least: int = 2) -> DataFrame:
    """(scheme, run, features, sessions, baseline, tuned, difference, wins): runs of true labels against each baseline on the sessions that both have."""
    a = runs.filter(~F.col("control")).select("scheme", "run", "fold", F.col("balanced_accuracy").alias("_a"))
    b = baselines.filter(~F.col("control")).select("scheme", "features", "fold", F.col("balanced_accuracy").alias("_b"))
    gain = F.col("_a") - F.col("_b")
    by = a.join(b, ["scheme", "fold"]).filter(gain.isNotNull()).groupBy("scheme", "run", "features")
    return by.agg(F.count("*").alias("sessions"), F.avg("_b").alias("baseline"), F.avg("_a").alias("tuned"), F.avg(gain).alias("difference"), F.count_if(gain > 0).alias("wins")).filter(F.col("sessions") >= least)


def run_comparison(runs: DataFrame, baselines: DataFrame) -> DataFrame:
    """(run, features, folds, difference, wins, best): each run against each baseline on shared folds, and the best run by its mean."""
    joined = runs.join(baselines.select("fold", "features", F.col("balanced_accuracy").alias("_b")), "fold")
    by = joined.groupBy("run", "features").agg(F.count("*").alias("folds"), F.avg(F.col("balanced_accuracy") - F.col("_b")).alias("difference"), F.count_if(F.col("balanced_accuracy") > F.col("_b")).alias("wins"))
    best = runs.groupBy("run").agg(F.avg("balanced_accuracy").alias("mean"), F.stddev_samp("balanced_accuracy").alias("sd"))
    return by.join(best, "run").withColumn("best", F.rank().over(W.partitionBy("features").orderBy(F.desc("mean"))) == 1)


def pivot_report(rows: DataFrame, keys: list[str], column: str, values: list, score: str) -> DataFrame:
    return rows.groupBy(*keys).pivot(column, values).agg(F.avg(score))


def fusion_gains(folds: DataFrame, base: str = "position", score: str = "balanced_accuracy") -> DataFrame:
    """For each fused source position+x: mean gain over its better part, and folds where it wins."""
    fused = folds.filter(F.col("features").startswith(f"{base}+")).withColumn("signal", F.regexp_replace("features", r"^[^+]*\+", ""))
    one = lambda name: folds.select("scheme", "fold", F.col("features").alias(name), F.col(score).alias(f"_{name}"))
    parts = fused.join(one("signal"), ["scheme", "fold", "signal"]).join(one("other").filter(F.col("other") == base), ["scheme", "fold"])
    gain = F.col(score) - F.greatest("_signal", "_other")
    return parts.groupBy("scheme", "features").agg(F.avg(gain).alias("gain"), F.count_if(gain > 0).alias("wins"), F.count("*").alias("folds"))


def fusion_report(folds: DataFrame, base: str = "position", score: str = "balanced_accuracy") -> DataFrame:
    """For each fused source base+x of a scheme: mean gain over either part, and the folds where it wins."""
    fused = folds.filter(F.col("features").startswith(f"{base}+")).withColumn("signal", F.regexp_replace("features", r"^[^+]*\+", ""))
    one = lambda name: folds.select("scheme", "fold", F.col("features").alias(name), F.col(score).alias(f"_{name}"))
    parts = fused.join(one("signal"), ["scheme", "fold", "signal"]).join(one("base").filter(F.col("base") == base), ["scheme", "fold"])
    over, beyond = F.col(score) - F.col("_base"), F.col(score) - F.col("_signal")
    return parts.groupBy("scheme", "features").agg(
        F.count("*").alias("folds"), F.avg(over).alias("over_base"), F.count_if(over > 0).alias("base_wins"), F.avg(beyond).alias("over_signal"), F.count_if(beyond > 0).alias("signal_wins")
    )


def depth_report(rows: DataFrame) -> DataFrame:
    """(scheme, half_width_um, position, signal, fused, crossing_um, signal_first): means over folds; where the signal becomes the better source, and whether it is so at the least width."""
    mean = rows.groupBy("scheme", "half_width_um").agg(*[F.avg(c).alias(c) for c in ("position", "signal", "fused")])
    at = crossing(mean, ["scheme"], "half_width_um", "position", "signal").withColumnRenamed("crossing", "crossing_um")
    first = mean.groupBy("scheme").agg(F.min_by(F.col("position") < F.col("signal"), "half_width_um").alias("signal_first"))
    return mean.join(at, "scheme").join(first, "scheme")


def position_tables(folds: DataFrame, fusion: DataFrame, depth: DataFrame, boundary: DataFrame, schemes: list[str]) -> dict[str, DataFrame]:
    """The position report by part: sources by scheme, the fused ones too, gains of fusion, depth, boundaries (a boundary_table)."""
    whole = folds.filter(~F.col("control"))
    level = whole.select("scheme", F.lit("chance").alias("features"), F.col("chance").alias("balanced_accuracy"))
    by_scheme = lambda rows: pivot_report(rows, ["features"], "scheme", schemes, "balanced_accuracy")
    return {
        "baselines": by_scheme(whole.select("scheme", "features", "balanced_accuracy").unionByName(level)),
        "fusion": by_scheme(fusion), "gains": fusion_report(fusion), "depth": depth_report(depth), "boundary": boundary,
    }


def calibration_report(df: DataFrame, part: str, source: str, target: str, k: int) -> DataFrame:
    """(split, temperature, accuracy and scores before and after): the source's temperature in the source and in the target, and the target's own (oracle)."""
    found = transfer(df, source, target, part, k).first()  # one row
    out = None
    for split, own, t in (("in_lab", source, found["source_t"]), ("cross_lab", target, found["source_t"]), ("cross_lab_oracle", target, found["target_t"])):
        rows = df.filter(F.col(part) == own).withColumn("split", F.lit(split))
        made = before_after(rows, ["split"], k, t).withColumn("temperature", F.lit(t))
        out = made if out is None else out.unionByName(made)
    return out


def ablation_report(table: DataFrame, models: list[str]) -> DataFrame:
    """(scheme, ablation, each model): what a transform changes; in the row none, the accuracy without any."""
    shown = table.withColumn("_x", F.when(F.col("ablation") == "none", F.col("balanced_accuracy")).otherwise(F.col("delta")))
    return pivot_report(shown, ["scheme", "ablation"], "model", models, "_x")


def gate(score: Column, control: Column, chance: Column, band: Column) -> Column:
    """The model is above chance by more than the band, and its control is not."""
    return (score > chance + band) & (control <= chance + band)


def early_stop(history: DataFrame, keys: list[str], patience: int, score: str = "val_score") -> DataFrame:
    """(keys, best_epoch, best, stopped_at): training ends once `patience` epochs brought no strictly better score."""
    w = W.partitionBy(*keys).orderBy("epoch")  # the epochs of one run
    best_before = F.max(score).over(w.rowsBetween(W.unboundedPreceding, -1))
    better = history.withColumn("_better", F.coalesce(F.col(score) > best_before, F.lit(True)))
    since = better.withColumn("_since", F.col("epoch") - F.max(F.when(F.col("_better"), F.col("epoch"))).over(w.rowsBetween(W.unboundedPreceding, 0)))
    stop = since.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col("_since") >= patience, F.col("epoch"))), F.max("epoch")).alias("stopped_at"))
    seen = since.join(stop, keys).filter(F.col("epoch") <= F.col("stopped_at"))
    return seen.groupBy(*keys, "stopped_at").agg(F.max(F.when(F.col("_better"), F.struct(F.col(score).alias("s"), F.col("epoch").alias("e")))).alias("x")).select(*keys, F.col("x.e").alias("best_epoch"), F.col("x.s").alias("best"), "stopped_at")


def mean_and_error(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("sem"), F.count(value).alias("n"))
