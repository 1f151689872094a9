"""Quantiles by histograms and running totals against plain ones; nothing stays cached."""

import math

import numpy as np
import pytest

from wavetable.operators import metrics as M
from wavetable.operators import ranks as R

SHARES = [i / 15 for i in range(16)]


def plain(values, share):
    v = sorted(values, key=lambda x: (math.isnan(x), x))
    h = share * (len(v) - 1)
    a, b = v[math.floor(h)], v[math.ceil(h)]
    return a if a == b else a + (b - a) * (h - math.floor(h))


@pytest.mark.parametrize("few", [20, 4096])
def test_quantiles_of_many_shapes(spark, few):
    rng = np.random.default_rng(few)
    sets = {
        "even": rng.uniform(size=700), "normal": rng.normal(size=500) * 1e6, "piled": np.repeat([0.25, 0.5, 1 / 3], [400, 3, 50]), "one": np.array([7.0]), "two": np.array([1.0, 2.0]), "same": np.full(90, -3.5),
        "wide": np.exp(rng.normal(size=300) * 60), "ends": np.array([-1e308, 1e308, 0.0, 5e-324, 1.0]), "infinite": np.array([-np.inf, -np.inf, 1.0, 2.0, np.inf]), "nan": np.array([np.nan, 1.0, 2.0, 3.0] * 5),
    }
    rows = [(k, float(x)) for k, v in sets.items() for x in v] + [("one", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r["k"]: r["quantiles"] for r in R.quantiles(df, ["k"], "v", SHARES, few).collect()}
    assert got.keys() == sets.keys()
    for k, v in sets.items():
        want = [plain(v.tolist(), s) for s in SHARES]
        assert np.allclose(got[k], want, rtol=1e-12, atol=0, equal_nan=True), k
    alone = df.filter("k = 'even'").drop("k")
    assert R.quantiles(alone, [], "v", [0.5], few).first()["quantiles"] == pytest.approx([np.median(sets["even"])], rel=1e-12)
    assert R.quantiles(df.filter("k = 'none'"), ["k"], "v", SHARES, few).count() == 0


def test_nothing_stays_cached(spark):
    held = lambda: spark.sparkContext._jsc.getPersistentRDDs().size()
    before = held()
    df = spark.createDataFrame([(i % 3, (i * 37 % 101) / 101, float(i % 2)) for i in range(300)], "k int, conf double, hit double")
    M.adaptive_calibration_error(df, ["k"]).collect()
    assert R.ranked(df, ["conf"], ["k"]).count() == 300
    M.roc_auc(df.selectExpr("k", "conf score", "hit = 1 positive"), ["k"]).collect()
    assert held() == before


def test_confusion_has_the_whole_label_space(spark):
    df = spark.createDataFrame([("a", 0, 0), ("a", 0, 2), ("b", 1, 1)], "g string, label int, pred int")
    got = {(r["g"], r["label"], r["pred"]): r["n"] for r in M.confusion(df, ["g"], 3).collect()}
    assert len(got) == 18 and got["a", 0, 2] == 1 and got["b", 1, 1] == 1 and sum(got.values()) == 3
    assert M.confusion(df, [], 3).count() == 9 and M.confusion(df, ["g"]).count() == 3
