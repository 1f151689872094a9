"""Experiment plans: sweeps over folds with a permuted null, and the studies built on fitted folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavetable.functions import arrays as A
from wavetable.operators import geometry as I
from wavetable.operators import metrics as M
from wavetable.operators import models as E
from wavetable.operators import splits as C
from wavetable.operators.shift import centred_by_group
from wavetable.sources.partitions import save_predictions
from wavetable.sources.scratch import materialize


#: Draws of the permuted null for vectors of two features at most, and for wider ones.
NULL_DRAWS, WIDE_DRAWS = 20, 1


def training_sets(rows: DataFrame, folds: DataFrame, parts: tuple[str, ...] = ("train",)) -> tuple[dict[tuple[str, str], int], DataFrame]:
    """The number of each fold's training set, where it has two classes at least, and (grp, sets). Folds with the same groups share a set. Numbers go by scheme and fold, as draws follow them."""
    small = folds.filter(F.col("part").isin(*parts)).groupBy("scheme", "fold").agg(F.array_sort(F.collect_list("grp")).alias("groups")).orderBy("scheme", "fold").collect()  # folds
    sets: dict[tuple[str, ...], int] = {}
    number = {(x["scheme"], x["fold"]): sets.setdefault(tuple(x["groups"]), len(sets)) for x in small}
    seen: dict[str, set] = {}
    for x in rows.select("grp", "label").distinct().collect():  # groups times classes
        seen.setdefault(x["grp"], set()).add(x["label"])
    good = {n for groups, n in sets.items() if len(set().union(*(seen.get(g, set()) for g in groups))) > 1}
    member: dict[str, list[int]] = {}
    for groups, n in sets.items():
        for g in groups if n in good else ():
            member.setdefault(g, []).append(n)
    table = rows.sparkSession.createDataFrame(list(member.items()), "grp string, sets array<int>")
    return {f: n for f, n in number.items() if n in good}, table


def asked_rows(rows: DataFrame, folds: DataFrame, number: dict[tuple[str, str], int]) -> DataFrame:
    """The test rows of each fold that has a training set, with its number. The folds are written first: their size is known then, and rows stay where they are if it is small."""
    table = rows.sparkSession.createDataFrame([(s, f, n) for (s, f), n in number.items()], "scheme string, fold string, set int")
    asked = materialize(folds.filter("part = 'test'").select("scheme", "fold", "grp").join(table, ["scheme", "fold"]), "asked")
    return rows.join(asked, "grp")


def fitted_folds(
    rows: DataFrame, folds: DataFrame, d: int, k: int, draws: int = 0, seed: int = 0, parts: tuple[str, ...] = ("train",), train: DataFrame | None = None, extra_rows: int | None = None
) -> DataFrame:
    """Test rows of every fold with p, from one model for each distinct training set and draw.

    rows: chunk_id, grp, label, v. folds: scheme, fold, part, grp. Draw 0 has the true labels; draws 1 to `draws` are
    trained on labels that are dealt anew, by a bijection of row numbers, among all the training rows; with extra_rows the
    draws after the first among so many of them at most. Adds scheme, fold, draw. A fold whose training rows have fewer than
    two classes, or that has no test row, gives no rows. train: other rows to train on, such as a capped sample; the test is
    always all of rows.
    Each row is in the training table once, with the numbers of the models that it trains and its labels in them.
    """
    source = (rows if train is None else train).select("chunk_id", "grp", "label", "v")
    number, table = training_sets(source, folds, parts)
    per, sets = draws + 1, sorted(set(number.values()))
    joined = source.join(table, "grp")
    tasks = F.transform("sets", lambda s: F.struct((s * per).alias("config"), F.col("label").cast("int").alias("label")))
    if draws:
        ids = joined.select(F.explode("sets").alias("set"), "chunk_id", "label")
        whole = draws if extra_rows is None else 1  # draws among all rows
        dealt = C.permuted_draws(ids, ["set"], "chunk_id", list(range(1, whole + 1)), seed=seed)
        if draws > whole:
            dealt = dealt.unionByName(C.permuted_draws(C.keyed_sample(ids, extra_rows, ["set"], ["chunk_id"], seed), ["set"], "chunk_id", list(range(2, draws + 1)), seed=seed))
        more = dealt.groupBy("chunk_id").agg(F.collect_list(F.struct((F.col("set") * per + F.col("draw")).alias("config"), F.col("label").cast("int").alias("label"))).alias("more"))
        joined = joined.join(more, "chunk_id", "left")
        tasks = F.concat(tasks, F.coalesce("more", F.slice(tasks, 1, 0)))
    trained = materialize(joined.select("v", tasks.alias("tasks")).select("v", F.col("tasks.config").alias("configs"), F.col("tasks.label").alias("labels")), "training")
    asked = asked_rows(rows, folds, number).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws))))
    asked = asked.withColumn("config", F.col("set") * per + F.col("draw"))
    return predicted(trained, asked, [s * per + i for s in sets for i in range(per)], k * (d + 1), d, k, lambda own, wave: E.grouped_logistic(own, wave, d, k))


def predicted(trained: DataFrame, asked: DataFrame, configs: list[int], weights: int, d: int, k: int, fit) -> DataFrame:
    """asked (with config and set) with p, and whether its model's fit came to an end; models beyond E.MODEL_BYTES are joined, not sent."""
    if len(configs) <= E.wave_size(weights, d):
        models = fit(trained, configs)
        lost = F.col("config").isin(models.unconverged) if models.unconverged else F.lit(False)
        return E.predict_grouped(asked, models, k).withColumn("converged", ~lost).drop("config", "set")
    return E.predict_joined(asked, E.fitted_table(trained, configs, weights, d, fit), d, k).drop("config", "set")


def constant_folds(rows: DataFrame, folds: DataFrame, k: int) -> DataFrame:
    """Test rows of every fold with p: the class frequencies of its training rows; as in fitted_folds."""
    number, table = training_sets(rows, folds)
    p = E.constant(rows.join(table, "grp").withColumn("set", F.explode("sets")), ["set"], k)
    return asked_rows(rows, folds, number).join(p, "set").drop("set").withColumns({"draw": F.lit(0), "converged": F.lit(True)})


def perceptron_folds(rows: DataFrame, folds: DataFrame, d: int, k: int, seed: int = 0, hidden: int = E.HIDDEN) -> DataFrame:
    """Test rows of every fold with p by a perceptron; those of all training sets are fitted in the same passes."""
    number, table = training_sets(rows, folds)
    sets = sorted(set(number.values()))
    trained = materialize(rows.join(table, "grp").select("v", F.col("sets").alias("configs"), F.transform("sets", lambda _: F.col("label").cast("int")).alias("labels")), "training")
    asked = asked_rows(rows, folds, number).withColumns({"config": F.col("set"), "draw": F.lit(0)})
    return predicted(trained, asked, sets, hidden * (d + 1) + k * (hidden + 1), d, k, lambda own, wave: E.grouped_perceptron(own, wave, d, k, seed, hidden))


def judged(predicted: DataFrame) -> DataFrame:
    """Predicted rows with what metrics need."""
    pred = A.argmax(F.col("p"))
    return predicted.withColumns({"conf": F.array_max("p"), "pred": pred, "hit": (pred == F.col("label")).cast("double")})


def sweep(
    features: dict[str, tuple[DataFrame, int]], folds: DataFrame, k: int, draws: int | None = None, seed: int = 0, models: tuple[str, ...] = ("logistic",), views: dict[str, list[int] | None] | None = None
) -> DataFrame:
    """One row for each scheme, fold, feature set, model, view and control (false: true labels; true: mean over the permuted draws), with the most extreme draw.

    draws: of the null of the logistic model; by default NULL_DRAWS for two features at most, else WIDE_DRAWS.
    models: logistic, constant, perceptron. views: by name the labels whose rows count, or None for all.
    """
    out, folds = None, materialize(folds, "folds")  # read several times for each model
    for view, labels in (views or {"all": None}).items():
        for name, (rows, d) in features.items():
            own = rows if labels is None else rows.filter(F.col("label").isin(labels))
            n_train = folds.filter("part = 'train'").select("scheme", "fold", "grp").join(own.groupBy("grp").agg(F.count("*").alias("n")), "grp").groupBy("scheme", "fold").agg(F.sum("n").alias("n_train"))
            for model in models:
                n = (NULL_DRAWS if d <= 2 else WIDE_DRAWS) if draws is None else draws
                fitted = {"logistic": lambda: fitted_folds(own, folds, d, k, n, seed), "constant": lambda: constant_folds(own, folds, k), "perceptron": lambda: perceptron_folds(own, folds, d, k, seed)}[model]
                keys, found = ["scheme", "fold", "draw"], judged(fitted())
                by = M.full_report(found, keys, k, ("converged",)).drop("per_class_recall")
                numbers = [c for c in by.columns if c not in [*keys, "converged"]]
                part = by.groupBy("scheme", "fold", (F.col("draw") > 0).alias("control")).agg(*[F.avg(c).alias(c) for c in numbers], F.max("balanced_accuracy").alias("max_balanced_accuracy"), F.count("*").alias("draws"), F.bool_and("converged").alias("converged"))
                part = part.join(n_train, ["scheme", "fold"]).withColumns({"features": F.lit(name), "model": F.lit(model), "view": F.lit(view)})
                out = part if out is None else out.unionByName(part)
    return out


def identity_probe(rows: DataFrame, folds: DataFrame, d: int, positive: str) -> DataFrame:
    """(fold, auc, balanced_accuracy): can the dataset be told from the vector? Needs a fold with both datasets in its test."""
    coded = rows.withColumn("label", (F.col("dataset") == positive).cast("int"))
    predicted = judged(fitted_folds(coded, folds.withColumn("scheme", F.lit("identity")).withColumn("fold", F.col("fold").cast("string")), d, 2))
    scored = predicted.select("fold", F.col("p")[1].alias("score"), (F.col("label") == 1).alias("positive"))
    return M.roc_auc(scored, ["fold"]).join(M.class_report(predicted, ["fold"]).select("fold", "balanced_accuracy"), "fold").filter("auc is not null")


def discriminator(sets: dict[str, tuple[DataFrame, int]], folds: DataFrame, positive: str) -> tuple[DataFrame, DataFrame]:
    """identity_probe of each feature set, and its mean and sample deviation."""
    out = None
    for name, (rows, d) in sets.items():
        part = identity_probe(rows, folds, d, positive).withColumn("features", F.lit(name))
        out = part if out is None else out.unionByName(part)
    summary = out.groupBy("features").agg(F.avg("auc").alias("auc_mean"), F.stddev_samp("auc").alias("auc_std"), F.avg("balanced_accuracy").alias("balanced_mean"))
    return out, summary


def adaptation(rows: DataFrame, folds: DataFrame, d: int, k: int, save: str | None = None) -> DataFrame:
    """Report for each scheme of the head on vectors as they are and on vectors centred by group, with how well the dataset can be told from them (identity_auc; null with one dataset).

    save: a folder for the predictions of both runs, by run and scheme, as p_<class>.
    """
    out, names = None, sorted(x["dataset"] for x in rows.select("dataset").distinct().collect())  # a row for each dataset
    for name, own in (("uncentred", rows), ("centred", centred_by_group(rows))):
        found = fitted_folds(own, folds, d, k)
        if save:
            found = materialize(found, "adapted")
            kept = found.select("chunk_id", "grp", "label", "scheme", "fold", "draw", "p", F.lit(name).alias("run"))
            save_predictions(kept, save, ["run", "scheme"], [str(i) for i in range(k)])
        part = M.full_report(judged(found), ["scheme"], k).drop("per_class_recall").withColumn("run", F.lit(name))
        if len(names) == 2:
            part = part.crossJoin(F.broadcast(identity_probe(own, C.paired_holdout(own), d, names[1]).agg(F.avg("auc").alias("identity_auc"))))  # one row
        else:
            part = part.withColumn("identity_auc", F.lit(None).cast("double"))
        out = part if out is None else out.unionByName(part)
    return out


def fusion(position: tuple[DataFrame, int], signals: dict[str, tuple[DataFrame, int]], folds: DataFrame, k: int, cap: int = 7500) -> DataFrame:
    """Rows (scheme, fold, chunk_id, source, label, p): position and signals alone, and every two of them multiplied. Folds without a model of all of them have no rows."""
    names = ["position", *signals]
    both = None
    for i, (rows, d) in enumerate([position, *signals.values()]):
        own = fitted_folds(rows, folds, d, k, train=C.balanced_sample(rows, cap, ["chunk_id"])).select("scheme", "fold", "chunk_id", *(["label"] if not i else []), F.col("p").alias(f"p{i}"))
        both = own if both is None else both.join(own, ["scheme", "fold", "chunk_id"])
    training = folds.filter("part = 'train'").select("scheme", "fold", "grp").join(position[0].select("grp", "label"), "grp")
    both = both.join(E.constant(training, ["scheme", "fold"], k).withColumnRenamed("p", "prior"), ["scheme", "fold"])
    found = [F.struct(F.lit(n).alias("source"), F.col(f"p{i}").alias("p")) for i, n in enumerate(names)]
    for i, a in enumerate(names):
        for j in range(i + 1, len(names)):
            found.append(F.struct(F.lit(f"{a}+{names[j]}").alias("source"), I.product_of_experts([F.col(f"p{i}"), F.col(f"p{j}")], F.col("prior")).alias("p")))
    return both.select("scheme", "fold", "chunk_id", "label", F.explode(F.array(*found)).alias("x")).select("scheme", "fold", "chunk_id", "label", "x.*")


def depth_uncertainty(rows: DataFrame, folds: DataFrame, k: int, widths: list[float], copies: int = 4, draws: int = 10, signal: tuple[DataFrame, int] | None = None) -> DataFrame:
    """(scheme, fold, half_width_um, balanced_accuracy, chance): position models under one random shift of depth for each group and draw. rows: v = [depth, lateral].

    With a signal (its rows and width) also signal, its own balanced accuracy, and fused, that of position and signal multiplied.
    """
    out, most = None, max(copies, draws)
    shifted = lambda df, w, seed: df.withColumn("v", F.array(I.jittered_depth(F.col("v")[0], F.col("grp"), w, seed), F.col("v")[1]))
    score = lambda df, keys, name: M.class_report(judged(df), keys).select(*keys, F.col("balanced_accuracy").alias(name))
    if signal:
        training = folds.filter("part = 'train'").select("scheme", "fold", "grp").join(rows.select("grp", "label"), "grp")
        heard = fitted_folds(signal[0], folds, signal[1], k).select("scheme", "fold", F.col("chunk_id").alias("_chunk"), "label", F.col("p").alias("_p"))
        heard = materialize(heard.join(E.constant(training, ["scheme", "fold"], k).withColumnRenamed("p", "prior"), ["scheme", "fold"]), "heard")
    for w in widths:
        many = rows.withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(most - 1)))).withColumn("_chunk", F.col("chunk_id"))
        moved = shifted(many, w, F.concat(F.lit("c"), F.col("_c").cast("string")))
        # copies are rows of their own in training; draws are rows of their own in the test
        tagged = moved.withColumn("chunk_id", F.col("chunk_id") * most + F.col("_c"))
        predicted = judged(fitted_folds(tagged.filter(F.col("_c") < draws), folds, 2, k, train=tagged.filter(F.col("_c") < copies)))
        keys = ["scheme", "fold"]
        part = M.class_report(predicted, [*keys, "_c"]).groupBy(*keys).agg(F.avg("balanced_accuracy").alias("balanced_accuracy"), F.avg("chance").alias("chance"))
        if signal:
            both = predicted.drop("label").join(heard, [*keys, "_chunk"]).withColumn("p", I.product_of_experts([F.col("p"), F.col("_p")], F.col("prior")))
            part = part.join(score(both, [*keys, "_c"], "fused").groupBy(*keys).agg(F.avg("fused").alias("fused")), keys).join(score(heard.withColumn("p", F.col("_p")), keys, "signal"), keys)
        part = part.withColumn("half_width_um", F.lit(float(w)))
        out = part if out is None else out.unionByName(part)
    return out
