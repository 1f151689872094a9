"""Perceptrons, wide linear heads and models by table, against dense solvers and each other."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_studies import separable
from wavetable.operators import models as E
from wavetable.operators import splits as C
from wavetable.plans import sweep as S


def test_gradients_are_finite_differences():
    rng = np.random.default_rng(0)
    d, k, hidden, n = 3, 4, 5, 30
    z, y = np.concatenate([rng.normal(size=(n, d)), np.ones((n, 1))], axis=1), rng.integers(0, k, n)
    w = rng.normal(size=hidden * (d + 1) + k * (hidden + 1))
    _, g, _ = E.hidden_sums(z, y, w, k, hidden)
    for i in range(len(w)):
        step = np.zeros(len(w))
        step[i] = 1e-6
        slope = (E.hidden_sums(z, y, w + step, k, hidden)[0] - E.hidden_sums(z, y, w - step, k, hidden)[0]) / 2e-6
        assert slope == pytest.approx(g[i], abs=1e-4)


def test_perceptrons_of_all_configurations_at_once(spark):
    """The same steps on dense sums give the same weights; another configuration beside it changes nothing."""
    rows = separable(spark).withColumn("configs", F.array(F.lit(0), F.lit(1))).withColumn("labels", F.array(F.col("label"), (F.col("label") + 1) % 3)).repartition(3)
    got = E.grouped_perceptron(rows, [0, 1], 3, 3, hidden=8)
    data = rows.select("v", "label").collect()
    x, y = np.array([r["v"] for r in data]), np.array([r["label"] for r in data])
    z = np.concatenate([(x - x.mean(axis=0)) / x.std(axis=0), np.ones((len(x), 1))], axis=1)
    keep = E.PENALTY * np.concatenate([np.tile([1.0, 1, 1, 0], 8), np.tile(np.append(np.ones(8), 0.0), 3)])
    rng = np.random.default_rng([0, 0])
    a, b = np.sqrt(6 / 11), np.sqrt(6 / 11)
    run = E._Descent(keep, np.concatenate([rng.uniform(-a, a, 32), rng.uniform(-b, b, 27)]))
    for _ in range(E.MLP_PASSES):
        if not run.done:
            loss, g, _ = E.hidden_sums(z, y, run.at, 3, 8)
            run.tell(loss, g)
            run.done |= loss <= E.ENOUGH * len(y)
    p, q = (E._scores(x, (w, x.mean(axis=0), x.std(axis=0)), 3) for w in (got[0][0], run.w))
    assert np.abs(p - q).max() < 0.02 and (p.argmax(axis=1) == y).mean() > 0.97
    assert (E._scores(x, got[1], 3).argmax(axis=1) == (y + 1) % 3).mean() > 0.97


def test_early_stopping_keeps_the_best_weights(spark, monkeypatch):
    monkeypatch.setattr(E, "HOLD_OUT_FROM", 50)
    monkeypatch.setattr(E, "MLP_PASSES", 60)
    rows = separable(spark).withColumn("configs", F.array(F.lit(0)))
    got = E.grouped_perceptron(rows, [0], 3, 3, hidden=8)
    assert got.unconverged == []
    right = E.predict_grouped(rows.withColumn("config", F.lit(0)), got, 3).filter(F.array_position("p", F.array_max("p")) - 1 == F.col("label")).count()
    assert right > 0.9 * rows.count()


def test_conjugate_gradients_reach_the_newton_optimum(spark, monkeypatch):
    rows = separable(spark).withColumn("configs", F.array(F.lit(0), F.lit(1))).withColumn("labels", F.array(F.col("label"), (F.col("label") + 1) % 3))
    newton = E.grouped_logistic(rows, [0, 1, 7], 3, 3)
    monkeypatch.setattr(E, "MOST_WEIGHTS", 0)
    wide = E.grouped_logistic(rows, [0, 1, 7], 3, 3)
    for n in (0, 1):
        a, b = (x[n][0] - x[n][0].mean(axis=0) for x in (newton, wide))
        assert np.allclose(a, b, atol=2e-4)
    assert newton.unconverged == wide.unconverged == []
    monkeypatch.setattr(E, "PASSES", 4)
    assert E.grouped_logistic(rows, [0, 1], 3, 3).unconverged == [0, 1]


def test_models_in_waves_and_by_join_predict_the_same(spark, monkeypatch):
    rows = separable(spark)
    folds = C.leave_one_out(rows, "A")
    pick = lambda df: {(r["fold"], r["draw"], r["chunk_id"]): (r["p"], r["converged"]) for r in df.collect()}
    want = pick(S.fitted_folds(rows, folds, 3, 3, draws=1))
    monkeypatch.setattr(E, "MODEL_BYTES", 1 << 9)
    monkeypatch.setattr(E, "LOT_BYTES", 1 << 9)
    got = pick(S.fitted_folds(rows, folds, 3, 3, draws=1))
    assert got.keys() == want.keys() and all(np.allclose(got[k][0], want[k][0], atol=1e-6) and got[k][1] == want[k][1] for k in got)


def test_many_wide_models_are_not_broadcast(spark):
    n, d, k = 2000, 768, 5
    weights = F.transform(F.sequence(F.lit(0), F.lit(k * (d + 1) - 1)), lambda i: ((i * 31 + F.col("id") * 17) % 101).cast("double") / 5000 - 0.01)
    table = spark.range(n).select(F.col("id").cast("int").alias("config"), weights.alias("weights"), F.array(F.lit(k), F.lit(d + 1)).alias("shape"), F.array_repeat(F.lit(0.0), d).alias("mean"), F.array_repeat(F.lit(1.0), d).alias("sd"), F.lit(True).alias("converged"))
    v = F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda i: ((i * 7 + F.col("id")) % 13).cast("double"))
    rows = spark.range(n).select((F.col("id") % n).cast("int").alias("config"), F.col("id").alias("chunk_id"), v.alias("v"))
    out = E.predict_joined(rows, table, d, k)
    assert f"sequence(0, {k * (d + 1) - 1}" not in "".join(x for x in out._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[1:])
    got = {r["config"]: r["p"] for r in out.filter("config % 500 = 3").select("config", "p").collect()}
    for c, p in got.items():
        w = (((np.arange(k * (d + 1)) * 31 + c * 17) % 101) / 5000 - 0.01).reshape(k, d + 1)
        x = (np.arange(d) * 7 + c) % 13
        eta = w[:, :-1] @ x + w[:, -1]
        q = np.exp(eta - eta.max())
        assert np.allclose(p, q / q.sum())
    assert len(got) == 4
