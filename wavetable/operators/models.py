"""Small classifiers, many at once.

A configuration is one training set: a fold, a feature set, a permuted draw. Rows carry the list of configurations
they train in, and their label in each, so that no vector is copied; each pass over the rows gives, in every task,
partial sums of the size of the models, which are added up by configuration. Folds that share a training set share a
configuration. Narrow models take Newton steps; wide ones, whose second derivatives would be large, limited-memory BFGS
steps from sums of gradients alone. Both go on until the loss stands still.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavetable.functions import arrays as A
from wavetable.operators.sums import summed
from wavetable.sources.scratch import scratch_path

#: Weights of a configuration, classes times (features + 1), up to which Newton's method is used; beyond, gradients alone.
MOST_WEIGHTS = 200
STEPS, PASSES = 30, 1000
#: The loss stands still when a step gains less than this share of it.
STILL = 1e-9
#: Of all models that are sent to tasks at once, and of the rows that meet their model in one task.
MODEL_BYTES, LOT_BYTES = 32 << 20, 64 << 20
#: Perceptrons: hidden units, penalty, passes, rows from which a tenth is held out, and passes without gain on it after which a fit ends.
HIDDEN, PENALTY, MLP_PASSES, HOLD_OUT_FROM, PATIENCE = 64, 1e-4, 100, 2000, 10
#: Mean loss of a perceptron that is low enough: classes that can be parted would go on lowering it for ever.
ENOUGH = 1e-3
#: Steps that limited-memory BFGS remembers.
MEMORY = 10


def constant(train: DataFrame, keys: list[str], k: int, label: str = "label") -> DataFrame:
    """(keys, p): class frequencies of the training rows."""
    n = train.groupBy(*keys).agg(F.count("*").alias("_n"), *[F.count_if(F.col(label) == i).alias(f"_{i}") for i in range(k)])
    return n.select(*keys, F.array(*[F.col(f"_{i}") / F.col("_n") for i in range(k)]).alias("p"))


def checked_training(train: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """Training rows; a key with fewer than two classes raises."""
    few = train.groupBy(*keys).agg(F.count_distinct(label).alias("_k")).filter("_k < 2").limit(1).collect()
    if few:
        raise ValueError(f"fewer than two classes in {few[0].asDict()}")
    return train


def logistic(n: int, c: float = 1.0) -> Pipeline:
    """Standardised logistic regression with the penalty |w|² / 2 against c times the summed loss of n rows."""
    return Pipeline(stages=[
        StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True),
        LogisticRegression(featuresCol="scaled", labelCol="label", maxIter=300, regParam=1 / (c * n), elasticNetParam=0.0, standardization=False, family="multinomial"),
    ])


def fit_predict(pipeline: Pipeline | Callable[[int], Pipeline], train: DataFrame, test: DataFrame, k: int, vector: str = "v", label: str = "label") -> DataFrame:
    """test with p over the full label space; classes are numbered anew for the fit and spread out again. pipeline: or a function of the number of classes."""
    classes = sorted(x[label] for x in train.select(label).distinct().collect())  # k at most
    if len(classes) < 2:
        raise ValueError("fewer than two classes to train on")
    number = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)) - 1
    model = (pipeline(len(classes)) if callable(pipeline) else pipeline).fit(train.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"), number.cast("double").alias("label")))
    out = model.transform(test.withColumn("features", array_to_vector(F.col(vector).cast("array<double>"))))
    p = vector_to_array("probability")
    return out.select(*test.columns, A.expand(p, F.array(*[F.lit(c) for c in classes]), k).alias("p"))


def _by_config(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(configuration, places of its rows in the batch, their labels in it)."""
    lists = batch.column("configs")
    flat, labels = lists.flatten().to_numpy(), batch.column("labels").flatten().to_numpy()
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
    order = np.argsort(flat, kind="stable")
    found, first = np.unique(flat[order], return_index=True)
    for c, at in zip(found.tolist(), np.split(order, first[1:])):
        yield c, row[at], labels[at]


def _part(c: int, *sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([np.concatenate([np.ravel(x) for x in sums]).tobytes()], pa.binary())], ["config", "sums"])


def _scales(rows: DataFrame, configs: list[int], d: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Mean and deviation of each feature over the rows of each configuration, in two passes."""

    def sums(means: dict[int, np.ndarray] | None) -> dict[int, np.ndarray]:
        sent = rows.sparkSession.sparkContext.broadcast(means)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts: dict[int, np.ndarray] = {}
            for batch in batches:
                x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                for c, at, _ in _by_config(batch):
                    own = x[at] if sent.value is None else (x[at] - sent.value[c]) ** 2
                    parts[c] = parts.get(c, 0.0) + np.append(own.sum(axis=0), len(at))
            for c, own in parts.items():
                yield _part(c, own)

        return summed(rows.mapInArrow(run, "config int, sums binary"))

    means = {c: x[:-1] / x[-1] for c, x in sums(None).items()}
    found = {c: (means[c], np.sqrt(x[:-1] / x[-1])) for c, x in sums(means).items()}
    return {c: (found[c][0], np.where(found[c][1] > 0, found[c][1], 1.0)) if c in found else (np.zeros(d), np.ones(d)) for c in configs}


def _sums(rows: DataFrame, model: dict[int, np.ndarray], scale: dict[int, tuple[np.ndarray, np.ndarray]], d: int, k: int, second: bool = True) -> dict[int, tuple[float, np.ndarray, np.ndarray | None]]:
    """Loss, gradient and (with second) Hessian of each configuration, without the penalty."""
    sent = rows.sparkSession.sparkContext.broadcast((model, scale))
    m = k * (d + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, scales = sent.value
        parts: dict[int, list] = {}
        for batch in batches:
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            for c, at, y in _by_config(batch):
                if c not in models:
                    continue
                mean, sd = scales[c]
                z = np.concatenate([(x[at] - mean) / sd, np.ones((len(at), 1))], axis=1)
                eta = z @ models[c].T
                eta -= eta.max(axis=1, keepdims=True)
                p = np.exp(eta)
                p /= p.sum(axis=1, keepdims=True)
                own = parts.setdefault(c, [np.zeros(1), np.zeros((k, d + 1)), np.zeros((k, d + 1, k, d + 1) if second else 0)])
                own[0] -= np.log(np.maximum(p[np.arange(len(at)), y], 1e-300)).sum()
                r = p.copy()
                r[np.arange(len(at)), y] -= 1
                own[1] += r.T @ z
                for a in range(k if second else 0):
                    for b in range(a, k):
                        h = (z * (p[:, a] * ((a == b) - p[:, b]))[:, None]).T @ z
                        own[2][a, :, b] += h
                        if a != b:
                            own[2][b, :, a] += h.T
        for c, own in parts.items():
            yield _part(c, *own)

    got = summed(rows.mapInArrow(run, "config int, sums binary"))
    return {c: (s[0], s[1 : m + 1], s[m + 1 :].reshape(m, m) if second else None) for c, s in got.items()}


class Models(dict):
    """(weights, mean, sd) by configuration; unconverged: those whose fit ended before its loss stood still."""

    def __init__(self, models: dict, unconverged: list[int]) -> None:
        super().__init__(models)
        self.unconverged = sorted(unconverged)


def _newton(rows: DataFrame, scale: dict, d: int, k: int, keep: np.ndarray) -> tuple[dict[int, np.ndarray], list[int]]:
    w = {n: np.zeros((k, d + 1)) for n in scale}
    step: dict[int, np.ndarray] = {}
    last: dict[int, float] = {}
    live = list(scale)
    for _ in range(STEPS):
        sums = _sums(rows, {n: w[n] for n in live}, scale, d, k)
        going = []
        for n in live:
            if n not in sums:
                continue
            loss, g, h = sums[n]
            flat = w[n].ravel()
            loss += (keep * flat * flat).sum() / 2
            if n in last and loss > last[n] + 1e-9:  # too far: half the step
                step[n] = step[n] / 2
                w[n] = w[n] - step[n]
                going.append(n)
                continue
            done = n in last and last[n] - loss < STILL * max(1.0, abs(loss))
            last[n] = loss
            if not done:
                step[n] = -np.linalg.solve(h + np.diag(keep) + 1e-7 * np.eye(len(flat)), g + keep * flat).reshape(k, d + 1)
                w[n] = w[n] + step[n]
                going.append(n)
        live = going
        if not live:
            break
    return w, live


def _products(rows: DataFrame, asked: dict[int, tuple[np.ndarray, np.ndarray | None]], scale: dict, d: int, k: int) -> dict[int, np.ndarray]:
    """For each configuration asked about: (loss, gradient) at its weights, or, with a vector, the product of the second derivatives with it; one pass for all."""
    sent = rows.sparkSession.sparkContext.broadcast((asked, scale))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points, scales = sent.value
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            for c, at, y in _by_config(batch):
                if c not in points:
                    continue
                mean, sd = scales[c]
                z = np.concatenate([(x[at] - mean) / sd, np.ones((len(at), 1))], axis=1)
                w, v = points[c]
                eta = z @ w.reshape(k, d + 1).T
                p = np.exp(eta - eta.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                if v is None:
                    loss = -np.log(np.maximum(p[np.arange(len(at)), y], 1e-300)).sum()
                    p[np.arange(len(at)), y] -= 1
                    own = np.append(loss, (p.T @ z).ravel())
                else:
                    u = z @ v.reshape(k, d + 1).T
                    own = ((p * (u - (p * u).sum(axis=1, keepdims=True))).T @ z).ravel()
                parts[c] = parts.get(c, 0.0) + own
        for c, own in parts.items():
            yield _part(c, own)

    return summed(rows.mapInArrow(run, "config int, sums binary"))


def _search(size: int, keep: np.ndarray, n: float) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """Newton's method of one configuration by conjugate gradients: yields (weights, vector or None), is sent the sums, returns (weights, whether the loss stood still)."""
    w = np.zeros(size)

    def at(point: np.ndarray):
        sums = yield point, None
        return sums[0] + (keep * point * point).sum() / 2, sums[1:] + keep * point

    loss, g = yield from at(w)
    begin = np.linalg.norm(g)
    rough = n / 4 + keep  # the second derivatives of standardised features, about
    for _ in range(STEPS):
        size_g = np.linalg.norm(g)
        step, left = np.zeros(size), -g
        eased = left / rough
        way, product = eased, left @ eased
        for _ in range(size):
            curve = (yield w, way) + keep * way
            far = product / max(way @ curve, 1e-300)
            step, left = step + far * way, left - far * curve
            if np.linalg.norm(left) <= min(0.5, np.sqrt(size_g / begin)) * size_g:
                break
            eased = left / rough
            way, product = eased + (left @ eased) / product * way, left @ eased
        share = 1.0
        while True:
            new_loss, new_g = yield from at(w + share * step)
            if new_loss <= loss + 1e-4 * share * (g @ step) + 1e-12 * abs(loss):
                break
            share /= 2
            if share < 1e-8:
                return w, False
        gain = loss - new_loss
        w, loss, g = w + share * step, new_loss, new_g
        if gain < STILL * max(1.0, abs(loss)):
            return w, True
    return w, False


def _newton_cg(rows: DataFrame, scale: dict, d: int, k: int, keep: np.ndarray) -> tuple[dict[int, np.ndarray], list[int]]:
    counts = {x["c"]: x["n"] for x in rows.select(F.explode("configs").alias("c")).groupBy("c").agg(F.count("*").alias("n")).collect()}  # a row for each configuration
    runs = {c: _search(k * (d + 1), keep, counts[c]) for c in scale if c in counts}
    w, lost = {c: np.zeros((k, d + 1)) for c in scale}, []
    asked = {c: next(run) for c, run in runs.items()}
    for _ in range(PASSES):
        if not asked:
            break
        for c, sums in _products(rows, asked, scale, d, k).items():
            try:
                asked[c] = runs[c].send(sums)
            except StopIteration as end:
                del asked[c]
                w[c] = end.value[0].reshape(k, d + 1)
                if not end.value[1]:
                    lost.append(c)
    for c, (point, _) in asked.items():
        w[c] = point.reshape(k, d + 1)
    return w, [*lost, *asked]


class _Descent:
    """Limited-memory BFGS of one configuration, told the loss and gradient at its point at, which it then moves."""

    def __init__(self, keep: np.ndarray, start: np.ndarray) -> None:
        self.keep, self.at, self.past = keep, start, []
        self.w = self.g = self.way = None
        self.f, self.step, self.still, self.done = np.inf, 1.0, 0, False

    def tell(self, loss: float, g: np.ndarray) -> None:
        f, g = loss + (self.keep * self.at * self.at).sum() / 2, g + self.keep * self.at
        if self.w is not None and f > self.f + 1e-4 * self.step * (self.g @ self.way):
            self.step /= 2
            self.done = self.step < 1e-8
        else:
            if self.w is not None:
                s, t = self.at - self.w, g - self.g
                if s @ t > 1e-12:
                    self.past = [*self.past[1 - MEMORY :], (s, t)]
                self.still = self.still + 1 if self.f - f < 1e-6 * max(1.0, abs(f)) else 0
                self.done = self.still > 1
            self.w, self.f, self.g, self.step = self.at, f, g, 1.0
            self.way = -self._scaled(g)
        self.at = self.w + self.step * self.way if not self.done else self.w

    def _scaled(self, g: np.ndarray) -> np.ndarray:
        q, shares = g.copy(), []
        for s, t in reversed(self.past):
            shares.append(s @ q / (s @ t))
            q -= shares[-1] * t
        q *= self.past[-1][0] @ self.past[-1][1] / (self.past[-1][1] @ self.past[-1][1]) if self.past else 1 / max(1.0, np.linalg.norm(g))
        for (s, t), share in zip(self.past, reversed(shares)):
            q += (share - t @ q / (s @ t)) * s
        return q


def _trained(rows: DataFrame) -> DataFrame:
    labels = F.col("labels") if "labels" in rows.columns else F.transform("configs", lambda _: F.col("label"))
    return rows.select(F.col("v").cast("array<double>").alias("v"), F.col("configs").cast("array<int>").alias("configs"), labels.cast("array<int>").alias("labels"))


def grouped_logistic(rows: DataFrame, configs: list[int], d: int, k: int, c: float = 1.0) -> Models:
    """(weights, mean, sd) of each configuration, all of them in the same passes. rows: v, configs (array<int>), and labels (an array beside configs) or one label."""
    rows = _trained(rows)
    scale = _scales(rows, configs, d)
    keep = np.tile(np.append(np.ones(d), 0.0), k) / c  # the intercept is free
    w, lost = (_newton if k * (d + 1) <= MOST_WEIGHTS else _newton_cg)(rows, scale, d, k, keep)
    return Models({n: (w[n], *scale[n]) for n in configs}, lost)


def hidden_sums(z: np.ndarray, y: np.ndarray, w: np.ndarray, k: int, hidden: int) -> tuple[float, np.ndarray, np.ndarray]:
    """(loss, gradient, right) of a perceptron with one layer of rectified units, by back-propagation; z: rows with a last column of ones."""
    cut = hidden * z.shape[1]
    first, second = w[:cut].reshape(hidden, -1), w[cut:].reshape(k, hidden + 1)
    before = z @ first.T
    units = np.concatenate([np.maximum(before, 0), np.ones((len(z), 1))], axis=1)
    eta = units @ second.T
    p = np.exp(eta - eta.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    at = np.arange(len(y))
    loss, right = -np.log(np.maximum(p[at, y], 1e-300)).sum(), p.argmax(axis=1) == y
    p[at, y] -= 1
    back = (p @ second[:, :-1]) * (before > 0)
    return loss, np.concatenate([(back.T @ z).ravel(), (p.T @ units).ravel()]), right


def grouped_perceptron(rows: DataFrame, configs: list[int], d: int, k: int, seed: int = 0, hidden: int = HIDDEN) -> Models:
    """Perceptrons with hidden rectified units, all configurations in the same passes.

    A configuration of HOLD_OUT_FROM rows or more holds out a tenth, by a hash of the vector, and keeps the weights that
    are right most often there, ending PATIENCE passes after the last gain; a smaller one goes on until its loss stands still or is ENOUGH.
    """
    held = F.pmod(F.xxhash64(F.col("v").cast("array<double>"), F.lit(seed)), F.lit(10)) == 0
    rows = _trained(rows).withColumn("held", held)
    scale = _scales(rows.drop("held"), configs, d)
    counts = {x["c"]: x["n"] for x in rows.select(F.explode("configs").alias("c")).groupBy("c").agg(F.count("*").alias("n")).collect()}  # a row for each configuration
    early = {c for c, n in counts.items() if n >= HOLD_OUT_FROM}
    keep = PENALTY * np.concatenate([np.tile(np.append(np.ones(d), 0.0), hidden), np.tile(np.append(np.ones(hidden), 0.0), k)])

    def start(c: int) -> np.ndarray:
        rng = np.random.default_rng([seed, c])
        a, b = np.sqrt(6 / (d + hidden)), np.sqrt(6 / (hidden + k))
        return np.concatenate([rng.uniform(-a, a, hidden * (d + 1)), rng.uniform(-b, b, k * (hidden + 1))])

    runs = {c: _Descent(keep, start(c)) for c in configs if c in counts}
    best: dict[int, tuple[float, int, np.ndarray]] = {}
    for i in range(MLP_PASSES):
        live = {c: x.at for c, x in runs.items() if not x.done}
        if not live:
            break
        sent = rows.sparkSession.sparkContext.broadcast((live, scale, early))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            points, scales, holding = sent.value
            parts: dict[int, np.ndarray] = {}
            for batch in batches:
                x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                out = batch.column("held").to_numpy(zero_copy_only=False)
                for c, at, y in _by_config(batch):
                    if c not in points:
                        continue
                    z = np.concatenate([(x[at] - scales[c][0]) / scales[c][1], np.ones((len(at), 1))], axis=1)
                    aside = out[at] & (c in holding)
                    loss, g, _ = hidden_sums(z[~aside], y[~aside], points[c], k, hidden)
                    right = hidden_sums(z[aside], y[aside], points[c], k, hidden)[2].sum() if aside.any() else 0
                    parts[c] = parts.get(c, 0.0) + np.concatenate([[loss, right], g])
            for c, own in parts.items():
                yield _part(c, own)

        for c, sums in summed(rows.mapInArrow(run, "config int, sums binary")).items():
            if c in early and (c not in best or sums[1] > best[c][0]):
                best[c] = (sums[1], i, runs[c].at)
            runs[c].tell(sums[0], sums[2:])
            if sums[0] <= ENOUGH * counts[c] or c in early and i - best[c][1] >= PATIENCE:
                runs[c].done = True
    lost = [c for c, x in runs.items() if not x.done]
    w = {c: best[c][2] if c in best else x.w if x.w is not None else x.at for c, x in runs.items()}
    return Models({c: (w.get(c, np.zeros(len(keep))), *scale[c]) for c in configs}, lost)


def _scores(x: np.ndarray, model: tuple[np.ndarray, np.ndarray, np.ndarray], k: int) -> np.ndarray:
    """Probabilities by a linear model (a matrix) or a perceptron (flat weights)."""
    w, mean, sd = model
    z = np.concatenate([(x - mean) / sd, np.ones((len(x), 1))], axis=1)
    if w.ndim == 1:
        hidden = (len(w) - k) // (z.shape[1] + k)
        cut = hidden * z.shape[1]
        z, w = np.concatenate([np.maximum(z @ w[:cut].reshape(hidden, -1).T, 0), np.ones((len(x), 1))], axis=1), w[cut:].reshape(k, hidden + 1)
    eta = z @ w.T
    p = np.exp(eta - eta.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def wave_size(weights: int, d: int) -> int:
    """Models of so many weights that MODEL_BYTES hold."""
    return max(1, MODEL_BYTES // (8 * (weights + 2 * d)))


def fitted_table(rows: DataFrame, configs: list[int], weights: int, d: int, fit: Callable[[DataFrame, list[int]], Models]) -> DataFrame:
    """(config, weights, shape, mean, sd, converged) of all configurations, fitted in waves of wave_size, each written before the next."""
    spark, path, size = rows.sparkSession, scratch_path(rows.sparkSession, "models"), wave_size(weights, d)
    schema = "config int, weights array<double>, shape array<int>, mean array<double>, sd array<double>, converged boolean"
    for i in range(0, max(1, len(configs)), size):
        wave = configs[i : i + size]
        own = rows if len(configs) <= size else rows.filter(F.exists("configs", lambda c: c.between(min(wave, default=0), max(wave, default=0))))
        models = fit(own, wave)
        table = [(c, w.ravel().tolist(), list(w.shape), mean.tolist(), sd.tolist(), c not in models.unconverged) for c, (w, mean, sd) in models.items()]
        spark.createDataFrame(table, schema).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def predict_joined(rows: DataFrame, table: DataFrame, d: int, k: int, config: str = "config", vector: str = "v") -> DataFrame:
    """rows with p and converged by the model of their configuration, which meets at most LOT_BYTES of their vectors at a time; no model is broadcast."""
    lots = rows.groupBy(config).agg(F.ceil(F.count("*") * F.lit(8 * d) / F.lit(LOT_BYTES)).cast("int").alias("_lots"))
    dealt = rows.join(lots, config).withColumn("_lot", F.pmod(F.xxhash64(vector) + F.spark_partition_id(), F.col("_lots")).cast("int")).drop("_lots")
    each = table.withColumnRenamed("config", config).join(lots, config).withColumn("_lot", F.explode(F.sequence(F.lit(0), F.col("_lots") - 1))).drop("_lots")
    names = rows.columns
    schema = ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes), "p array<double>", "converged boolean"])

    def run(own: pa.Table, models: pa.Table) -> pa.Table:
        own = own.select(names)
        model = models.slice(0, 1).to_pylist()[0] if len(models) else None
        if not len(own) or model is None:
            return own.slice(0, 0).append_column("p", pa.array([], pa.list_(pa.float64()))).append_column("converged", pa.array([], pa.bool_()))
        x = own.column(vector).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)
        p = _scores(x, (np.reshape(model["weights"], model["shape"]), np.array(model["mean"]), np.array(model["sd"])), k)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, k), pa.int32()), pa.array(p.ravel()))
        return own.append_column("p", lists).append_column("converged", pa.array([model["converged"]] * len(own)))

    return dealt.groupBy(config, "_lot").cogroup(each.groupBy(config, "_lot")).applyInArrow(run, schema)


def predict_grouped(rows: DataFrame, models: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], k: int, config: str = "config", vector: str = "v") -> DataFrame:
    """rows with p by the model of their configuration; for models that MODEL_BYTES hold, as all are sent to every task."""
    sent = rows.sparkSession.sparkContext.broadcast(models)

    @F.pandas_udf("array<double>")
    def run(v: pd.Series, which: pd.Series) -> pd.Series:
        parts = []
        for n, own in v.groupby(which, sort=False):
            p = _scores(np.stack(own.to_numpy()).astype(float), sent.value[int(n)], k)
            parts.append(pd.Series(list(p), index=own.index, dtype=object))
        return pd.concat(parts).reindex(v.index) if parts else pd.Series([], dtype=object)

    return rows.withColumn("p", run(F.col(vector).cast("array<double>"), F.col(config)))
