"""Models, geometry, shift, stores and reports."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavetable.functions import arrays as A
from wavetable.operators import geometry as I
from wavetable.operators import metrics as M
from wavetable.operators import models as E
from wavetable.operators import shift as H
from wavetable.operators import splits as C
from wavetable.plans import reports as K
from wavetable.plans import sweep as S
from wavetable.sources.scratch import materialize, scratch_path
from wavetable.sources import store


def probe(spark, regions, depths):
    return spark.createDataFrame([("a", i, float(d), r) for i, (r, d) in enumerate(zip(regions, depths))], "grp string, channel int, depth_um double, region string")


def distances(df):
    return [r["distance_um"] for r in I.boundary_distance(df).orderBy("channel").collect()]


def test_boundary_between_regions(spark):
    d = distances(probe(spark, ["DG"] * 4 + ["CA1"] * 4, range(0, 160, 20)))
    assert d[3] == d[4] == 10 and d[1] == 30


def test_gap_has_two_edges(spark):
    d = distances(probe(spark, ["CA1"] * 3 + ["VIS"] * 3, [0, 20, 40, 140, 160, 180]))
    assert d[2] == d[3] == 10


def test_span_ends(spark):
    d = distances(probe(spark, ["VIS"] * 9, range(0, 180, 20)))
    assert d[0] == 10 and d[4] == 90


def test_experts_by_hand(spark):
    df = spark.createDataFrame([([0.8, 0.2], [0.6, 0.4], [0.5, 0.5])], "a array<double>, b array<double>, prior array<double>")
    p = df.select(I.product_of_experts([F.col("a"), F.col("b")], F.col("prior")).alias("p")).first()["p"]
    assert p == pytest.approx([0.48 / 0.56, 0.08 / 0.56])
    with pytest.raises(ValueError):
        I.product_of_experts([], F.col("prior"))


def test_jitter_is_rigid(spark):
    df = spark.createDataFrame([("a", 10.0), ("a", 30.0), ("b", 10.0)], "grp string, d double")
    got = [r["x"] for r in df.select(I.jittered_depth(F.col("d"), F.col("grp"), 50.0).alias("x")).collect()]
    assert got[1] - got[0] == pytest.approx(20) and abs(got[0] - 10) <= 50 and got[2] != got[0]
    assert [r["x"] for r in df.select(I.jittered_depth(F.col("d"), F.col("grp"), 0.0).alias("x")).collect()] == [10.0, 30.0, 10.0]


def test_crossing(spark):
    df = spark.createDataFrame([(0.0, 0.9, 0.5), (100.0, 0.7, 0.5), (200.0, 0.3, 0.5)], "x double, y double, level double")
    assert I.crossing(df.withColumn("k", F.lit(1)), ["k"], "x", "y", "level").first()["crossing"] == pytest.approx(150)


def test_centring_zeroes_the_means(spark):
    rows = spark.createDataFrame([(i, f"g{i % 3}", [float(i), float(i * i)]) for i in range(30)], "chunk_id long, grp string, v array<double>")
    means = H.group_means(H.centred_by_group(rows), "v", "grp").collect()
    assert all(abs(x) < 1e-9 for r in means for x in r["_mean"])


def separable(spark, shift=0.0, groups=6, n=40):
    rng = np.random.default_rng(0)
    rows = []
    for g in range(groups):
        for _ in range(n):
            y = int(rng.integers(0, 3))
            v = rng.normal(size=3) * 0.3
            v[y] += 2
            if g >= groups // 2:
                v = v + np.array([4.0, -3.0, 1.0]) * shift
            rows.append((len(rows), f"g{g}", "A" if g < groups // 2 else "B", y, v.tolist()))
    return spark.createDataFrame(rows, "chunk_id long, grp string, dataset string, label int, v array<double>")


def test_grouped_fit_agrees_with_one_fit(spark):
    rows = separable(spark)
    models = E.grouped_logistic(rows.withColumn("configs", F.array(F.lit(0))), [0], 3, 3)
    mine = E.predict_grouped(rows.withColumn("config", F.lit(0)), models, 3).select("chunk_id", F.col("p").alias("a"))
    ml = E.fit_predict(E.logistic(rows.count()), rows, rows, 3).select("chunk_id", F.col("p").alias("b"))
    worst = mine.join(ml, "chunk_id").select(F.max(F.aggregate(F.zip_with("a", "b", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: F.greatest(s, x)))).first()[0]
    assert worst < 0.01


def test_sweep_beats_its_null(spark):
    rows = separable(spark)
    got = S.sweep({"v": (rows, 3)}, C.leave_one_out(rows), 3, draws=2).groupBy("control").agg(F.avg("balanced_accuracy").alias("b"), F.max("draws").alias("d")).collect()
    by = {r["control"]: (r["b"], r["d"]) for r in got}
    assert by[False][0] > 0.9 and by[True][0] < 0.55 and by[True][1] == 2


def test_identity_is_seen_and_then_centred_away(spark):
    rows = separable(spark, shift=1.0)
    auc = S.identity_probe(rows, C.paired_holdout(rows), 3, "B").agg(F.avg("auc")).first()[0]
    after = S.identity_probe(H.centred_by_group(rows), C.paired_holdout(rows), 3, "B").agg(F.avg("auc")).first()[0]
    assert auc > 0.95 and after < 0.75


def test_centring_recovers_a_shifted_lab(spark):
    rows = separable(spark, shift=1.0)
    folds = C.cross_lab_folds(rows, "A", "B")
    path = scratch_path(spark, "adapted")
    got = {r["run"]: r["balanced_accuracy"] for r in S.adaptation(rows, folds, 3, 3, save=path).collect()}
    assert got["uncentred"] < 0.7 < got["centred"]
    saved = spark.read.parquet(path).groupBy("run").agg(F.count("*").alias("n"), F.avg(F.col("p_0") + F.col("p_1") + F.col("p_2")).alias("total")).collect()
    n = rows.filter("dataset = 'B'").count()
    assert {(r["run"], r["n"], round(r["total"], 9)) for r in saved} == {("uncentred", n, 1.0), ("centred", n, 1.0)}


def test_fusion_helps(spark):
    rows = separable(spark)
    place = rows.withColumn("v", F.array(F.col("v")[0], F.lit(1.0) * F.col("chunk_id") % 7))
    fused = S.judged(S.fusion((place, 2), {"v": (rows, 3)}, C.leave_one_out(rows), 3))
    got = {r["source"]: r["accuracy"] for r in M.class_report(fused, ["source"]).collect()}
    assert set(got) == {"position", "v", "position+v"} and got["position+v"] > got["position"] + 0.1


def test_one_class_raises(spark):
    with pytest.raises(ValueError, match="two classes"):
        E.checked_training(spark.createDataFrame([("a", 1), ("a", 1)], "k string, label int"), ["k"])


def test_expand(spark):
    df = spark.createDataFrame([([0.3, 0.7],)], "p array<double>")
    assert df.select(A.expand(F.col("p"), F.array(F.lit(1), F.lit(3)), 5).alias("p")).first()["p"] == [0.0, 0.3, 0.0, 0.7, 0.0]


def test_signed_rank_exact(spark):
    rows = [("k", float(d)) for d in (1, 2, 3, 4, 5, -6)]
    got = K.signed_rank(spark.createDataFrame(rows, "k string, d double"), ["k"]).first()
    assert got["statistic"] == 6.0 and got["p_value"] == pytest.approx(2 * 14 / 64)
    none = K.signed_rank(spark.createDataFrame([("z", 0.0)] * 4, "k string, d double"), ["k"]).first()
    assert none["p_value"] == 1.0 and none["statistic"] is None


def test_signed_rank_normal(spark):
    rows = [("k", 1.0)] * 6 + [("k", -1.0)] * 2
    got = K.signed_rank(spark.createDataFrame(rows, "k string, d double"), ["k"]).first()
    sd = math.sqrt(8 * 9 * 17 / 24 - (8**3 - 8) / 48)
    assert got["statistic"] == 9.0 and got["p_value"] == pytest.approx(math.erfc(abs(9 - 18) / sd / math.sqrt(2)))


def test_early_stop(spark):
    scores = [0.1, 0.5, 0.4, 0.5, 0.3, 0.9]
    df = spark.createDataFrame([("r", i + 1, s) for i, s in enumerate(scores)], "run string, epoch int, val_score double")
    got = K.early_stop(df, ["run"], 3).first()
    assert (got["best_epoch"], got["best"], got["stopped_at"]) == (2, 0.5, 5)


def test_latest_run_of_a_missing_tag(spark):
    runs = spark.createDataFrame([("a", "1", "x"), ("a", "2", "y")], "tag string, run_id string, path string")
    assert K.latest_run(runs).first()["path"] == "y"
    with pytest.raises(Exception, match="no run of b"):
        K.latest_run(runs, ["b"]).collect()


def chunks(spark, n=12, fs=1250.0, width=16, first=0):
    rng = np.random.default_rng(first)
    rows = [(first + i, "d", "s", "p", i % 3, 20.0 * (i % 3), "CA1", "CA1", 3.0 * i, f"g{i % 2}", fs, rng.normal(size=width).tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "chunk_id long, dataset string, session string, probe string, channel int, depth_um double, acronym string, region string, t0_s double, grp string, fs double, wave array<double>")


def test_store_round_trip(spark, tmp_path):
    c = chunks(spark)
    store.write_store(c, str(tmp_path / "s"), 16)
    back = store.open_store(spark, str(tmp_path / "s"))
    assert back.count() == 12
    wanted = spark.createDataFrame([(5, 0), (1, 1)], "chunk_id long, order int")
    got = store.take(back, wanted, microvolts=True).collect()
    assert [r["chunk_id"] for r in got] == [5, 1]
    assert got[0]["wave"] == pytest.approx(c.filter("chunk_id = 5").first()["wave"], abs=1e-5)
    with pytest.raises(Exception, match="unknown chunk 99"):
        store.take(back, spark.createDataFrame([(99, 0)], "chunk_id long, order int")).collect()
    with pytest.raises(Exception, match="not 8 samples"):
        store.write_store(c, str(tmp_path / "t"), 8)


def test_corpus_checks(spark):
    a = store.corpus([chunks(spark), chunks(spark, fs=1249.95)], ["a", "b"])
    assert a.select("chunk_id").distinct().count() == 24 and a.first()["fs"] == pytest.approx(1249.975)
    for stores, message in (([], "needs a store"), ([chunks(spark), chunks(spark, width=8)], "lengths"), ([chunks(spark), chunks(spark, fs=1000.0)], "rates")):
        with pytest.raises(ValueError, match=message):
            store.corpus(stores, ["a", "b"][: len(stores)])


def test_predictions_wide_and_long(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, [0.1, 0.9])], "chunk_id long, label int, logits array<double>")
    store.write_table(store.wide(df, "logits", ["x", "y"], "logit"), str(tmp_path / "run7.parquet"))
    got = store.predictions(spark, str(tmp_path / "run7.parquet"), ["x", "y"]).first()
    assert got["logits"] == [0.1, 0.9] and got["run"] == "run7"
    assert store.markdown(df.select("chunk_id", "label")).splitlines()[-1] == "| 1 | 0 |"


def test_channel_table_mismatch(spark):
    a = spark.createDataFrame([("g", 0), ("g", 1)], "grp string, channel int")
    with pytest.raises(Exception, match="do not match"):
        store.channel_table(a.withColumn("depth_um", F.lit(1.0)), a.limit(1)).collect()


def wide_rows(spark, d, n=240):
    """Three classes that differ in a few of d features, in four groups."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(n):
        y = int(rng.integers(0, 3))
        v = rng.normal(size=d)
        v[y * 5 : y * 5 + 5] += 5
        rows.append((i, f"g{i % 4}", "A" if i % 4 < 2 else "B", y, v.tolist()))
    return spark.createDataFrame(rows, "chunk_id long, grp string, dataset string, label int, v array<double>")


@pytest.mark.parametrize("d", [256, 768])
def test_folds_of_wide_vectors(spark, d):
    rows = wide_rows(spark, d).coalesce(2)
    got = S.judged(S.fitted_folds(rows, C.cross_lab_folds(rows, "A", "B"), d, 3))
    assert M.class_report(got, ["scheme"]).agg(F.min("accuracy")).first()[0] > 0.8


def test_descent_reaches_the_newton_optimum(spark, monkeypatch):
    rows = separable(spark).withColumn("configs", F.array(F.lit(0), F.lit(1))).withColumn("labels", F.array(F.col("label"), (F.col("label") + 1) % 3))
    newton = E.grouped_logistic(rows, [0, 1], 3, 3)
    monkeypatch.setattr(E, "MOST_WEIGHTS", 0)
    descent = E.grouped_logistic(rows, [0, 1], 3, 3)
    for n in (0, 1):
        a, b = (x[n][0] - x[n][0].mean(axis=0) for x in (newton, descent))
        assert np.allclose(a, b, atol=0.02) and all(np.allclose(p, q) for p, q in zip(newton[n][1:], descent[n][1:]))


def test_sums_in_two_levels_are_the_same(spark):
    from wavetable.operators.sums import summed

    parts = spark.range(200, numPartitions=100).select((F.col("id") % 3).cast("int").alias("config"), "id")
    arrays = parts.mapInPandas(lambda it: (f.assign(sums=[np.array([x, 1.0]).tobytes() for x in f["id"]])[["config", "sums"]] for f in it), "config int, sums binary")
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in ("4", "80"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append({c: x.tolist() for c, x in summed(arrays).items()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] == {c: [float(sum(range(c, 200, 3))), float(len(range(c, 200, 3)))] for c in range(3)}


def test_folds_that_cannot_be_trained_are_left_out(spark):
    rows = separable(spark)
    rows = rows.withColumn("label", F.when(F.col("dataset") == "A", 0).otherwise(F.col("label")))
    folds = spark.createDataFrame([("s", "bad", "train", "g0"), ("s", "bad", "test", "g4"), ("s", "empty", "train", "g4"), ("s", "empty", "test", "nowhere"), ("s", "good", "train", "g3"), ("s", "good", "test", "g4")], "scheme string, fold string, part string, grp string")
    assert {r["fold"] for r in S.fitted_folds(rows, folds, 3, 3).select("fold").distinct().collect()} == {"good"}


def test_sweep_over_models_and_views(spark):
    rows = separable(spark)
    folds = C.leave_one_out(rows, "A")
    got = S.sweep({"v": (rows, 3), "one": (rows.withColumn("v", F.slice("v", 1, 1)), 1)}, folds, 3, models=("logistic", "constant", "perceptron"), views={"all": None, "two": [0, 1]}).collect()
    assert {(r["model"], r["view"], r["features"]) for r in got} == {(m, v, f) for m in ("logistic", "constant", "perceptron") for v in ("all", "two") for f in ("v", "one")}
    assert {(r["features"], r["draws"]) for r in got if r["control"]} == {("v", S.WIDE_DRAWS), ("one", S.NULL_DRAWS)} and all(r["n_train"] > 0 for r in got)
    score = {(r["model"], r["fold"]): r["balanced_accuracy"] for r in got if r["view"] == "all" and r["features"] == "v" and not r["control"]}
    assert all(score["constant", f] == pytest.approx(1 / 3) and score["logistic", f] > 0.9 and score["perceptron", f] > 0.8 for m, f in score if m == "constant")


def test_extra_draws_train_on_few_rows(spark):
    rows = separable(spark)
    got = S.fitted_folds(rows, C.leave_one_out(rows, "A"), 3, 3, draws=3, extra_rows=30)
    assert got.groupBy("draw").count().select("count").distinct().count() == 1 and {r["draw"] for r in got.select("draw").distinct().collect()} == {0, 1, 2, 3}


def test_draws_train_on_every_row_of_large_folds(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(S, "materialize", lambda df, name: kept.append((name, materialize(df, name))) or kept[-1][1])
    rows = spark.range(24_500).selectExpr("id chunk_id", "if(id < 24000, 'a', 'b') grp", "cast(id % 3 as int) label", "array(cast(id % 3 + id % 7 as double)) v")
    folds = spark.createDataFrame([("s", "f", "train", "a"), ("s", "f", "test", "b")], "scheme string, fold string, part string, grp string")
    got = {r["control"]: r for r in S.sweep({"one": (rows, 1)}, folds, 3, draws=3).collect()}
    assert got[True]["draws"] == 3 and got[True]["n_train"] == got[False]["n_train"] == 24_000
    (table,) = [t for name, t in kept if name == "training"]
    counts = table.select(F.explode(F.arrays_zip("configs", "labels")).alias("x")).groupBy("x.configs", "x.labels").count().collect()
    assert {(r["configs"], r["labels"]): r["count"] for r in counts} == {(c, y): 8000 for c in range(4) for y in range(3)}
    assert table.select(F.transform("configs", lambda c: F.get(F.col("labels"), F.array_position("configs", c).cast("int") - 1)).alias("x")).filter("x[1] <> x[2]").count() > 12_000


def test_training_sets_have_the_same_numbers_however_folds_are_dealt_out(spark):
    folds = spark.createDataFrame([("s", f"f{i}", "train", f"g{j}") for i in range(12) for j in range(i + 1)], "scheme string, fold string, part string, grp string")
    rows = spark.createDataFrame([(f"g{i}", label) for i in range(12) for label in (0, 1)], "grp string, label int")
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append(S.training_sets(rows, folds.repartition(int(n)))[0])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] and sorted(found[0].values()) == list(range(12))


def test_test_rows_stay_where_they_are(spark):
    rows = separable(spark).repartition(4)
    folds = C.leave_one_out(rows, "A")
    number, _ = S.training_sets(rows, folds)
    asked = S.asked_rows(rows, folds, number)
    assert asked.count() == rows.filter("dataset = 'A'").count()
    assert "hashpartitioning(grp" not in asked._jdf.queryExecution().executedPlan().toString()


def test_identity_auc_after_centring(spark):
    rows = separable(spark, shift=1.0)
    got = {r["run"]: r["identity_auc"] for r in S.adaptation(rows, C.cross_lab_folds(rows, "A", "B"), 3, 3).collect()}
    assert got["uncentred"] > 0.95 > 0.75 > got["centred"]


def test_depth_with_a_signal(spark):
    rows = separable(spark)
    place = rows.withColumn("v", F.array(F.col("label") * 100.0 + F.col("chunk_id") % 7, F.lit(1.0)))
    got = {r["half_width_um"]: r for r in S.depth_uncertainty(place, C.leave_one_out(rows, "A"), 3, [0.0, 800.0], copies=2, draws=2, signal=(rows, 3)).groupBy("half_width_um").agg(F.avg("balanced_accuracy").alias("alone"), F.avg("fused").alias("fused"), F.avg("signal").alias("signal")).collect()}
    assert got[0.0]["alone"] > 0.9 > got[800.0]["alone"] and got[800.0]["fused"] > got[800.0]["alone"] + 0.1 and got[0.0]["signal"] == pytest.approx(got[800.0]["signal"])


def test_abstention_with_distances(spark):
    from wavetable.operators import selective

    rng = np.random.default_rng(1)
    rows = []
    for i in range(300):
        new = i % 2
        p = rng.dirichlet([6.0, 1.0, 1.0] if not new else [1.0, 1.0, 1.0])
        rows.append((i, new, p.tolist(), int(rng.random() > p.max()), (rng.normal(size=4) + 3 * new).tolist()))
    df = spark.createDataFrame(rows, "chunk_id long, new int, p array<double>, wrong int, v array<double>")
    got = {r["score"]: r for r in selective.abstention_study(df.filter("new = 0"), df.filter("new = 1"), 3, "chunk_id", "v", d=4).collect()}
    assert set(got) == {"max_softmax", "entropy", "mahalanobis"} and got["mahalanobis"]["in_vs_out_auc"] > 0.95 > got["entropy"]["in_vs_out_auc"] > 0.5
    assert len({round(r["risk_full"], 9) for r in got.values()}) == 1 and got["max_softmax"]["risk_fifth"] <= got["max_softmax"]["risk_full"]


def test_two_signals_are_fused_without_position(spark):
    rows = separable(spark)
    fused = S.fusion((rows.withColumn("v", F.slice("v", 1, 1)), 1), {"a": (rows, 3), "b": (rows.withColumn("v", F.slice("v", 2, 2)), 2)}, C.leave_one_out(rows, "A"), 3)
    assert {r["source"] for r in fused.select("source").distinct().collect()} == {"position", "a", "b", "position+a", "position+b", "a+b"}


def test_ids_that_would_meet_raise(spark):
    far = chunks(spark, n=2, first=store.STORE_STRIDE)
    with pytest.raises(ValueError, match="do not fit"):
        store.corpus([far, chunks(spark)], ["a", "b"])
    assert store.corpus([far], ["a"]).count() == 2


def test_whole_recordings_are_cut_into_chunks(spark):
    from wavetable.plans import build

    rng = np.random.default_rng(0)
    blocks = spark.createDataFrame([("g", 0, s, rng.normal(size=100).tolist()) for s in range(0, 1000, 100)], "grp string, channel int, block_start int, samples array<double>")
    channels = spark.createDataFrame([("g", 0, "CA1", 20.0, True)], "grp string, channel int, acronym string, depth_um double, valid_data boolean")
    whole, ledger = build.build_chunks(blocks, channels, 1.0, 3.0, 0.0, None)
    assert whole.count() == 333 and ledger.count() == 0
    cut, ledger = build.build_chunks(blocks, channels, 1.0, 3.0, 0.0, None, most_s=600.0)
    assert cut.count() == 200 and [tuple(r) for r in ledger.collect()] == [("g", 0, "cut at 600 s")]


def test_reports_leave_controls_out_and_count_sessions_of_both(spark):
    runs = spark.createDataFrame(
        [("loso", "r", "a", False, 0.5, 0.25, 0.1, 100.0, None), ("loso", "r", "b", False, 0.7, 0.25, 0.3, 100.0, 0.9), ("loso", "r", "c", False, 0.9, 0.25, 0.2, 100.0, None), ("loso", "r", "a", True, 0.3, 0.25, 0.1, 100.0, None)],
        "scheme string, run string, fold string, control boolean, balanced_accuracy double, chance double, ece double, lowpass_hz double, identity_auc double",
    )
    one = K.run_summary(runs).first()
    assert (one["band"], one["groups"], round(one["balanced_accuracy"], 9), one["identity_auc"]) == ("<=100 Hz", 3, 0.7, 0.9)
    check = K.leakage_check(runs, ["scheme"]).first()
    assert (check["folds"], check["permuted"], round(check["bias"], 9)) == (1, 0.3, 0.05)
    base = spark.createDataFrame([("loso", "f", "a", False, 0.4), ("loso", "f", "b", False, 0.8), ("loso", "g", "a", False, 0.4), ("loso", "f", "c", True, 0.1)], "scheme string, features string, fold string, control boolean, balanced_accuracy double")
    got = K.paired_sessions(runs, base).collect()  # g has one session alone
    assert [(r["features"], r["sessions"], r["wins"]) for r in got] == [("f", 2, 1)] and abs(got[0]["difference"]) < 1e-9


def test_seeds_of_a_configuration_are_one_row(spark):
    scores = spark.createDataFrame([("x__seed0__lp", "raw", 0.5, 0.4, 0.5, 0.2), ("x__seed1__lp", "raw", 0.7, 0.4, 0.5, 0.2), ("y", "raw", 0.6, 0.5, 0.4, 0.2)], "tag string, stage string, raw_accuracy double, majority double, balanced_accuracy double, chance double")
    ece = spark.createDataFrame([("x__seed0__lp", 0.1), ("x__seed1__lp", 0.3)], "tag string, ece double")
    identity = spark.createDataFrame([("x__seed1__lp", 0.9)], "tag string, identity_auc double")
    controls = spark.createDataFrame([("x__lp", 0.45)], "config string, uncentred double")
    got = {r["config"]: r for r in K.fix_table(scores, ece, identity, controls).collect()}
    x, y = got["x__lp"], got["y"]
    assert round(x["margin_mean"], 9) == 0.2 and x["seeds"] == 2 and round(x["ece"], 9) == 0.2 and x["identity_auc"] == 0.9 and x["uncentred"] == 0.45
    assert y["ece"] is None and y["uncentred"] is None and round(y["margin_mean"], 9) == 0.1


def test_where_the_signal_becomes_the_better_source(spark):
    depth = spark.createDataFrame([("a", "f", 0.0, 0.8, 0.6, 0.8), ("a", "f", 100.0, 0.4, 0.6, 0.7), ("b", "f", 0.0, 0.5, 0.6, 0.6)], "scheme string, fold string, half_width_um double, position double, signal double, fused double")
    got = {(r["scheme"], r["half_width_um"]): r for r in K.depth_report(depth).collect()}
    assert round(got["a", 0.0]["crossing_um"], 6) == 50.0 and not got["a", 0.0]["signal_first"]
    assert got["b", 0.0]["crossing_um"] is None and got["b", 0.0]["signal_first"]
