"""Hand-computed cases of the metric, calibration and selective operators."""

import math

import pytest
from pyspark.sql import functions as F

from wavetable.operators import calibration as G
from wavetable.operators import metrics as M
from wavetable.operators import selective as S
from wavetable.operators.ranks import ranked, running_totals


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_ece_by_hand(spark):
    df = rows(spark, [(0.9, 1.0 if i < 5 else 0.0) for i in range(10)], "conf double, hit double")
    assert M.calibration_error(df, []).first()["ece"] == pytest.approx(0.4)
    assert M.adaptive_calibration_error(df, []).first()["ece"] == pytest.approx(0.4)
    many = spark.range(500).select((F.col("id") % 3).alias("k"), ((F.col("id") * 37 % 101) / 101).alias("conf"), (F.col("id") % 2).cast("double").alias("hit"))
    one, other = ({r["k"]: round(r["ece"], 9) for r in M.adaptive_calibration_error(many, ["k"], spread=s).collect()} for s in (False, True))
    assert one == other and len(one) == 3


def test_uniform_probabilities(spark):
    df = rows(spark, [(i, i % 5, [0.0] * 5) for i in range(10)], "chunk_id long, label int, logits array<double>")
    got = M.probability_scores(M.with_probabilities(df, 5), [], 5).first()
    assert got["nll"] == pytest.approx(math.log(5))
    assert got["brier"] == pytest.approx(0.8**2 + 4 * 0.2**2)


def test_ties_go_to_the_lower_class(spark):
    df = rows(spark, [(0, [1.0, 2.0, 2.0])], "label int, logits array<double>")
    assert M.with_probabilities(df, 3).first()["pred"] == 1


def test_softmax_is_stable(spark):
    df = rows(spark, [(0, [1e4, 0.0, -1e4])], "label int, logits array<double>")
    assert M.with_probabilities(df, 3).first()["p"] == [1.0, 0.0, 0.0]


def test_report_counts_only_present_classes(spark):
    df = rows(spark, [(0, 0), (0, 1), (2, 2), (2, 2)], "label int, pred int")
    got = M.class_report(df, []).first()
    assert (got["accuracy"], got["balanced_accuracy"], got["chance"], got["majority"], got["margin"]) == (0.75, 0.75, 0.5, 0.5, 0.25)
    assert got["macro_f1"] == pytest.approx((2 / 3 + 1) / 2)
    assert got["per_class_recall"] == {0: 0.5, 2: 1.0}


def test_noise_band(spark):
    df = rows(spark, [(c,) for c in range(4) for _ in range(100)], "label int")
    assert M.noise_band(df, []).first()["band"] == pytest.approx(3 * math.sqrt(4 * 0.25 / 100) / 4)


def test_reliability_gives_every_bin(spark):
    df = rows(spark, [(0.95, 1.0)], "conf double, hit double")
    got = M.reliability(df, []).orderBy("bin").collect()
    assert len(got) == 15 and got[14]["n"] == 1 and got[0]["confidence"] is None and got[0]["n"] == 0


def test_bad_probabilities_raise(spark):
    df = rows(spark, [([0.5, 0.6],), ([0.5, 0.5],)], "p array<double>")
    assert M.violations(df, []).first()["n_bad_sum"] == 1
    with pytest.raises(Exception, match="finite probabilities"):
        M.checked(df).collect()


def test_auc_counts_ties_half(spark):
    df = rows(spark, [(1.0, True), (1.0, False), (2.0, True), (0.0, False)], "score double, positive boolean")
    assert M.roc_auc(df, []).first()["auc"] == pytest.approx(3.5 / 4)


def test_scorable_needs_rows_and_classes(spark):
    df = rows(spark, [("a", 0), ("a", 1), ("b", 0), ("b", 0)], "grp string, label int")
    assert [x["grp"] for x in M.scorable(df, ["grp"]).collect()] == ["a"]


def test_temperature_scales_with_logits(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = rng.integers(0, 4, 2000)
    x[np.arange(2000), y] += 1.5
    both = rows(spark, [(k, int(y[i]), (x[i] * s).tolist()) for k, s in (("one", 1.0), ("three", 3.0)) for i in range(2000)], "k string, label int, logits array<double>")
    t = {r["k"]: r["t"] for r in G.fit_temperature(both, ["k"], 4).collect()}
    assert t["three"] / t["one"] == pytest.approx(3, rel=0.01)


def test_argmax_is_free_of_temperature(spark):
    df = rows(spark, [(0, [0.3, 1.2, -2.0]), (1, [5.0, 4.0, 4.5])], "label int, logits array<double>")
    assert [r["pred"] for r in M.with_probabilities(df, 3, 7.0).collect()] == [r["pred"] for r in M.with_probabilities(df, 3).collect()]


def test_risk_rises_when_the_certain_are_right(spark):
    df = rows(spark, [(i, i / 100, int(i >= 80)) for i in range(100)], "chunk_id long, value double, wrong int")
    got = S.risk_summary(df, [], "chunk_id").first()
    assert (got["risk_full"], got["risk_half"], got["risk_fifth"]) == (0.2, 0.0, 0.0)
    curve = S.risk_coverage(df, [], "chunk_id").orderBy("i").collect()
    assert len(curve) == 100 and curve[-1]["risk"] == pytest.approx(0.2) and curve[0]["k"] == 1


def test_mahalanobis_far_point_is_far(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    train = rows(spark, [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(400, 3)))], "id long, v array<double>")
    asked = rows(spark, [(0, [0.0, 0.0, 0.0]), (1, [9.0, 9.0, 9.0])], "id long, v array<double>")
    d = {r["id"]: r["distance"] for r in S.mahalanobis(train, asked, "v", 3, ["id"]).collect()}
    assert d[0] < 0.5 and d[1] > 10
    with pytest.raises(ValueError, match="too few"):
        S.gram(rows(spark, [([0.0] * 8,)], "v array<double>"), "v", 8)


def test_running_totals_by_key(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    got = {(r["k"], r["id"]): r["rank"] for r in ranked(df, ["id"], ["k"]).collect()}
    assert all(rank == i // 3 + 1 for (k, i), rank in got.items()) and len(got) == 1000
    total = running_totals(df, ["id"], {"s": "id"}).agg(F.max("s")).first()[0]
    assert total == sum(range(1000))


def test_registered_adaptive_error_gathers_no_group(spark, sf):
    from wavetable.plans.queries import QUERIES

    plan = QUERIES["ece_adaptive"](spark, sf)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "percentile(" not in plan
