"""Queries of the models, sweeps and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavetable.operators import features as D
from wavetable.operators import geometry as I
from wavetable.operators import metrics as M
from wavetable.operators import models as E
from wavetable.operators import splits as C
from wavetable.plans import reports as K_
from wavetable.plans import sweep as S
from wavetable.plans.q_metrics import BIG, SQL_CALIBRATION, sql_report
from wavetable.plans.registry import query, r
from wavetable.sources import partitions
from wavetable.sources import views as V
from wavetable.sources.scratch import scratch_path

K = V.K


#: Samples of a wave, all of which are features.
WIDE = 64


def _rows(spark, sf):
    """Chunks with their whole wave as features."""
    return V.chunks(spark, sf).select("chunk_id", "grp", "dataset", "label", "region_ix", "depth_um", "lateral_um", F.col("wave").cast("array<double>").alias("v"))


def _placed(spark, sf):
    return _rows(spark, sf).withColumn("v", F.array("depth_um", "lateral_um")).withColumn("label", F.col("region_ix"))


@query()
def logreg_folds(spark, sf):
    """Every scheme on whole waves."""
    rows = _rows(spark, sf)
    return M.full_report(S.judged(S.fitted_folds(rows, C.schemes(rows), WIDE, K)), ["scheme", "fold"], K).drop("per_class_recall")


@query()
def logreg_single(spark, sf):
    """One fold through Spark ML."""
    rows = _rows(spark, sf)
    train, test = rows.filter("dataset = 'labA'"), rows.filter("dataset = 'labB'")
    out = E.fit_predict(E.logistic(train.count()), E.checked_training(train, []), test, K)
    return M.full_report(S.judged(out), ["grp"], K).drop("per_class_recall")


@query()
def mlp_fold(spark, sf):
    rows = _rows(spark, sf)
    part = F.when(F.col("dataset") == "labA", "train").otherwise("test")
    folds = rows.select(F.lit("cross_lab").alias("scheme"), F.lit("labA_to_labB").alias("fold"), part.alias("part"), "grp").distinct()
    return M.full_report(S.judged(S.perceptron_folds(rows, folds, WIDE, K)), ["grp"], K).drop("per_class_recall")


@query()
def sweep(spark, sf):
    """Every scheme, two feature sets, two models, two views, with the null of each width."""
    sets = {"samples": (_rows(spark, sf), WIDE), "position": (_rows(spark, sf).withColumn("v", F.array("depth_um", "lateral_um")), 2)}
    return S.sweep(sets, C.schemes(_rows(spark, sf)), K, models=("logistic", "constant"), views={"all": None, "first_four": [0, 1, 2, 3]})


@query()
def sweep_models(spark, sf):
    """Every model on one scheme."""
    rows = _placed(spark, sf)
    return S.sweep({"position": (rows, 2)}, C.leave_one_out(rows, "labB"), K, draws=1, models=("logistic", "constant", "perceptron"))


@query()
def permutation_null(spark, sf):
    """The draws of permuted labels of every scheme: mean and most extreme score of each fold."""
    rows = _placed(spark, sf)
    return S.sweep({"position": (rows, 2)}, C.schemes(rows), K).filter("control").select("scheme", "fold", "draws", "n_train", "balanced_accuracy", "max_balanced_accuracy", "chance")


@query()
def identity_probe(spark, sf):
    rows = _rows(spark, sf)
    return S.identity_probe(rows, C.paired_holdout(rows), WIDE, "labB")


@query()
def discriminator(spark, sf):
    rows = _rows(spark, sf)
    sets = {"samples": (rows, WIDE), "position": (rows.withColumn("v", F.array("depth_um", "lateral_um")), 2)}
    return S.discriminator(sets, C.rotated(rows), "labB")[1]


@query()
def adapt_study(spark, sf):
    rows = _rows(spark, sf)
    return S.adaptation(rows, C.schemes(rows), WIDE, K)


@query()
def fusion_study(spark, sf):
    """Position, wave and spectrum alone and by twos, in every scheme."""
    rows = _rows(spark, sf).withColumn("label", F.col("region_ix"))
    spectrum = rows.withColumn("v", D.log_spectrum(F.col("v"), 64.0, kind=float))
    fused = S.fusion((_placed(spark, sf), 2), {"samples": (rows, WIDE), "spectrum": (spectrum, 32)}, C.schemes(rows), K)
    return M.class_report(S.judged(fused), ["scheme", "fold", "source"]).select("scheme", "fold", "source", "n", "balanced_accuracy", "accuracy", "majority", "chance")


@query()
def depth_study(spark, sf):
    """Widths from none to 1600 um, 4 copies in training, 10 draws in the test, alone and with the wave."""
    rows = _placed(spark, sf)
    heard = _rows(spark, sf).withColumn("label", F.col("region_ix"))
    return S.depth_uncertainty(rows, C.leave_one_out(rows, "labA"), K, [0.0, 100.0, 400.0, 1600.0], signal=(heard, WIDE))


@query()
def head_study(spark, sf):
    """Heads trained on train and validation groups together, beside a permuted control, in every scheme."""
    rows = _rows(spark, sf)
    predicted = S.judged(S.fitted_folds(rows, C.schemes(rows), WIDE, K, draws=1, parts=("train", "val")))
    return M.class_report(predicted, ["scheme", "fold", "draw"]).select("scheme", "fold", "draw", "balanced_accuracy", "chance")


def sql_folds(sets: int) -> str:
    """Fold metrics from the large view: a feature set is the prediction shifted by so many classes, the last one is the control; a fold is a group."""
    return f"""{BIG}, sh AS (SELECT gid, s, label, (pred + s) % 5 pred FROM pr, (VALUES {', '.join(f'({i})' for i in range(sets))}) v(s)), {sql_report('sh', 'gid, s')},
fm AS (SELECT 'big' AS scheme, 'all' AS view, concat('set', s) features, 'rule' AS model, s = {sets - 1} AS control, gid::varchar fold, avg(hits/support) balanced_accuracy, avg(2*hits/(support+predicted)) macro_f1, 1e0/count(*) chance, 3*sqrt(sum(0.25e0/support))/count(*) band, sum(support)::bigint n_test FROM c GROUP BY gid, s)"""


FOLDS = sql_folds(3)


def _folds(spark, sf, sets=3):
    rows = M.with_probabilities(V.big(spark, sf), K).withColumn("s", F.explode(F.array(*[F.lit(i) for i in range(sets)]))).withColumn("pred", (F.col("pred") + F.col("s")) % 5)
    by = M.class_report(rows, ["gid", "s"])
    return by.select(F.lit("big").alias("scheme"), F.lit("all").alias("view"), F.concat(F.lit("set"), "s").alias("features"), F.lit("rule").alias("model"), (F.col("s") == sets - 1).alias("control"), F.col("gid").cast("string").alias("fold"), "balanced_accuracy", "macro_f1", "chance", "band", F.col("n").alias("n_test"))


@query(f"{FOLDS} SELECT scheme, view, features, model, control, count(*) folds, {r('avg(balanced_accuracy)', 'balanced_accuracy')}, {r('stddev_samp(balanced_accuracy)', 'balanced_accuracy_sd')}, {r('avg(macro_f1)', 'macro_f1')}, {r('avg(chance)', 'chance')}, sum(n_test)::bigint n_test FROM fm GROUP BY ALL")
def summarise(spark, sf):
    return K_.summarise(_folds(spark, sf))


SQL_PAIRS = """pr2 AS (SELECT a.scheme, a.features a, b.features b, a.fold, a.balanced_accuracy - b.balanced_accuracy d FROM fm a JOIN fm b ON a.fold = b.fold AND a.features < b.features),
rk AS (SELECT *, rank() OVER (PARTITION BY a, b ORDER BY abs(d)) + (count(*) OVER (PARTITION BY a, b, abs(d)) - 1) / 2e0 k FROM pr2 WHERE d <> 0)"""


@query(f"{FOLDS}, {SQL_PAIRS} SELECT scheme, a, b, count(*) folds, {r('median(d)', 'median_difference')}, count(*) FILTER (d > 0) a_wins, {r('least(sum(CASE WHEN d > 0 THEN k ELSE 0 END), sum(CASE WHEN d < 0 THEN k ELSE 0 END))', 'statistic')} FROM rk GROUP BY 1, 2, 3")
def paired_comparison(spark, sf):
    return K_.paired_comparison(_folds(spark, sf), ["scheme"]).drop("p_value")


#: The exact null: all sign patterns of the ranks are as likely (without ties or zeros, as here; statistics of other pairs are left out).
SQL_SIGNS = f"""st AS (SELECT a, b, count(*) n, min(k) AS low, count(DISTINCT k) AS apart, least(sum(CASE WHEN d > 0 THEN k ELSE 0 END), sum(CASE WHEN d < 0 THEN k ELSE 0 END)) w FROM rk GROUP BY 1, 2),
al AS (SELECT a, b, count(*) folds FROM pr2 GROUP BY 1, 2), sg AS (SELECT m, bits, list_sum(list_transform(range(0, m), lambda i: ((bits >> i) & 1) * (i + 1))) s FROM (SELECT DISTINCT n m FROM st), range(0, 131072) t(bits) WHERE bits < (1 << m))"""


@query(f"{FOLDS}, {SQL_PAIRS}, {SQL_SIGNS} SELECT a, b, folds, {r('w', 'statistic')}, {r('least(1, 2e0 * (SELECT count(*) FROM sg WHERE m = n AND s <= w) / (1 << n))', 'p_value')} FROM st JOIN al USING (a, b)")
def signed_rank_p(spark, sf):
    return K_.paired_comparison(_folds(spark, sf), ["scheme"]).select("a", "b", "folds", "statistic", "p_value")


@query(f"{FOLDS} SELECT features, fold, {r('balanced_accuracy', 'balanced_accuracy')} FROM fm WHERE features <> 'set1' UNION ALL SELECT features, fold, {r('balanced_accuracy / 2', 'balanced_accuracy')} FROM fm WHERE features = 'set1'")
def merge_results(spark, sf):
    f = _folds(spark, sf).select("features", "fold", "balanced_accuracy")
    return K_.merge_results(f, f.filter("features = 'set1'").withColumn("balanced_accuracy", F.col("balanced_accuracy") / 2))


@query(f"{FOLDS}, su AS (SELECT scheme, features, control, avg(balanced_accuracy) b, stddev_samp(balanced_accuracy) s, avg(chance) ch FROM fm GROUP BY ALL), nu AS (SELECT scheme, b FROM su WHERE control) SELECT su.scheme, row_number() OVER (PARTITION BY su.scheme ORDER BY su.b DESC, features) AS rank, features, {r('su.b', 'balanced_accuracy')}, {r('s', 'balanced_accuracy_sd')}, {r('nu.b', 'permuted')}, {r('ch', 'chance')}, {r('nu.b - ch', 'null_bias')} FROM su JOIN nu ON nu.scheme = su.scheme WHERE NOT control")
def baseline_report(spark, sf):
    s = K_.summarise(_folds(spark, sf))
    null = s.filter("control").select("scheme", "view", "model", "control", "balanced_accuracy").join(s.filter("not control").select("scheme", "features"), "scheme")
    return K_.baseline_report(s.filter("not control").unionByName(null, allowMissingColumns=True))


@query(f"{FOLDS} SELECT features, fold, ba > chance + band AND cb <= chance + band AS passed FROM (SELECT features, fold, control, balanced_accuracy ba, chance, band, max(balanced_accuracy) FILTER (control) OVER (PARTITION BY fold) cb FROM fm) WHERE NOT control")
def gates(spark, sf):
    f = _folds(spark, sf)
    null = f.filter("control").select("fold", F.col("balanced_accuracy").alias("cb"))
    return f.filter("not control").join(null, "fold").select("features", "fold", K_.gate(F.col("balanced_accuracy"), F.col("cb"), F.col("chance"), F.col("band")).alias("passed"))


@query(f"{FOLDS} SELECT fold, {', '.join(r(f'avg(balanced_accuracy) FILTER (features = {chr(39)}set{i}{chr(39)})', f'set{i}') for i in range(3))} FROM fm GROUP BY 1")
def pivot_report(spark, sf):
    return K_.pivot_report(_folds(spark, sf), ["fold"], "features", ["set0", "set1", "set2"], "balanced_accuracy")


#: Orders stand for runs: the customer is the tag, the order's number the time of the run.
@query("SELECT o_custkey::varchar AS tag, max(o_orderkey) AS run_id, arg_max(o_orderpriority, o_orderkey) AS path FROM orders GROUP BY 1")
def latest_run(spark, sf):
    return K_.latest_run(V.read(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("tag"), F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("path")))


@query(f"SELECT concat('cfg', o_custkey % 7) AS config, o_orderstatus AS stage, count(DISTINCT o_custkey % 3) seeds, {r('avg(ln(o_totalprice))', 'price_mean')}, {r('stddev_samp(ln(o_totalprice))', 'price_sd')} FROM orders GROUP BY 1, 2")
def config_table(spark, sf):
    o = V.read(spark, sf, "orders")
    tag = F.concat(F.lit("cfg"), (F.col("o_custkey") % 7).cast("string"), F.lit("__seed"), (F.col("o_custkey") % 3).cast("string"))
    return K_.config_table(o.select(tag.alias("tag"), F.col("o_orderstatus").alias("stage"), F.log("o_totalprice").alias("price")), ["price"])


@query(f"{FOLDS}, ru AS (SELECT features run, fold, balanced_accuracy FROM fm), bs AS (SELECT fold, features, balanced_accuracy b FROM fm WHERE features <> 'set2'), me AS (SELECT run, avg(balanced_accuracy) mean, stddev_samp(balanced_accuracy) sd FROM ru GROUP BY 1)\nSELECT run, features, count(*) folds, {r('avg(balanced_accuracy - b)', 'difference')}, count(*) FILTER (balanced_accuracy > b) wins, {r('any_value(mean)', 'mean')}, {r('any_value(sd)', 'sd')}, any_value(mean) = (SELECT max(mean) FROM me) AS best FROM ru JOIN bs USING (fold) JOIN me USING (run) GROUP BY 1, 2")
def run_comparison(spark, sf):
    f = _folds(spark, sf)
    return K_.run_comparison(f.select(F.col("features").alias("run"), "fold", "balanced_accuracy"), f.filter("features <> 'set2'").select("fold", "features", "balanced_accuracy"))


@query(f"{FOLDS}, x AS (SELECT scheme, fold, CASE features WHEN 'set0' THEN 'position' WHEN 'set1' THEN 'sig' ELSE 'position+sig' END f, balanced_accuracy b FROM fm), w AS (SELECT scheme, fold, max(b) FILTER (f = 'position+sig') - greatest(max(b) FILTER (f = 'position'), max(b) FILTER (f = 'sig')) g FROM x GROUP BY 1, 2) SELECT scheme, 'position+sig' AS features, {r('avg(g)', 'gain')}, count(*) FILTER (g > 0) wins, count(*) folds FROM w GROUP BY 1")
def position_report(spark, sf):
    names = F.when(F.col("features") == "set0", "position").when(F.col("features") == "set1", "sig").otherwise("position+sig")
    return K_.fusion_gains(_folds(spark, sf).withColumn("features", names))


P_VALUE = "least(1, 2e0 * (SELECT count(*) FROM sg WHERE m = n AND s <= w) / (1 << n))"


@query(f"""{sql_folds(5)}, pr2 AS (SELECT a.scheme, a.features a, b.features b, a.fold, a.balanced_accuracy - b.balanced_accuracy d FROM fm a JOIN fm b ON a.fold = b.fold AND a.features < b.features WHERE NOT a.control AND NOT b.control AND a.features <> 'set0'),
{SQL_PAIRS[SQL_PAIRS.index('rk AS'):]}, {SQL_SIGNS}, md AS (SELECT a, b, median(d) md, count(*) FILTER (d > 0) wins FROM pr2 GROUP BY 1, 2)
SELECT 'big' AS scheme, 'all' AS view, 'rule' AS model, a, b, folds, {r('md', 'median_difference')}, wins AS a_wins, {r('w', 'statistic')}, {r(P_VALUE, 'p_value')} FROM st JOIN al USING (a, b) JOIN md USING (a, b)""")
def baseline_pairs(spark, sf):
    """Baselines by twos; set0 stands for a leaky feature."""
    return K_.baseline_pairs(_folds(spark, sf, 5), leaky=("set0",))


#: Groups of an even number are one scheme, of an odd number the other; those of the second seven were low-passed.
SQL_RUNS = f"""{sql_folds(4)}, bi AS (SELECT gid, s, greatest(1, ceil(15*conf)::int) bin, sum(conf) conf, sum((label = (pred + s) % 5)::int) hit, count(*) n FROM pr, (VALUES (0), (1), (2), (3)) v(s) GROUP BY 1, 2, 3),
ec AS (SELECT gid::varchar fold, concat('set', s) features, sum(abs(hit-conf))/sum(n) ece FROM bi GROUP BY 1, 2),
ru AS (SELECT concat('loso_', fold::int % 2) AS scheme, features, features run, fold, control, balanced_accuracy, chance, ece FROM fm JOIN ec USING (fold, features))"""


def _runs(spark, sf):
    rows = M.with_probabilities(V.big(spark, sf), K).withColumn("s", F.explode(F.array(*[F.lit(i) for i in range(4)]))).withColumn("hit", (F.col("label") == (F.col("pred") + F.col("s")) % 5).cast("double"))
    ece = M.calibration_error(rows, ["gid", "s"]).select(F.col("gid").cast("string").alias("fold"), F.concat(F.lit("set"), "s").alias("features"), "ece")
    f = _folds(spark, sf, 4).join(ece, ["fold", "features"]).withColumn("scheme", F.concat(F.lit("loso_"), (F.col("fold").cast("int") % 2).cast("string")))
    return f.withColumn("run", F.col("features")).withColumn("lowpass_hz", F.when(F.col("run") == "set1", 100.0)).withColumn("identity_auc", F.when(F.col("run") == "set0", F.col("ece")))


@query(f"""{SQL_RUNS} SELECT scheme, run, CASE run WHEN 'set1' THEN '<=100 Hz' ELSE 'full' END AS band, count(*) AS groups, {r('avg(balanced_accuracy)', 'balanced_accuracy')}, {r('stddev_samp(balanced_accuracy)', 'balanced_accuracy_sd')},
{r('avg(chance)', 'chance')}, {r('avg(ece)', 'ece')}, {r("avg(ece) FILTER (run = 'set0')", 'identity_auc')} FROM ru WHERE NOT control GROUP BY 1, 2""")
def run_summary(spark, sf):
    return K_.run_summary(_runs(spark, sf))


@query(f"{SQL_RUNS} SELECT scheme, count(*) folds, {r('avg(balanced_accuracy)', 'permuted')}, {r('avg(chance)', 'chance')}, {r('avg(balanced_accuracy) - avg(chance)', 'bias')} FROM ru WHERE control GROUP BY 1")
def leakage_check(spark, sf):
    return K_.leakage_check(_runs(spark, sf), ["scheme"])


@query(f"{SQL_RUNS} SELECT a.scheme, a.run, b.features, count(*) sessions, {r('avg(b.balanced_accuracy)', 'baseline')}, {r('avg(a.balanced_accuracy)', 'tuned')}, {r('avg(a.balanced_accuracy - b.balanced_accuracy)', 'difference')}, count(*) FILTER (a.balanced_accuracy > b.balanced_accuracy) wins FROM ru a JOIN ru b USING (scheme, fold) WHERE NOT a.control AND NOT b.control AND fold <> '3' GROUP BY 1, 2, 3")
def paired_sessions(spark, sf):
    """A session that the baselines lack counts for neither."""
    runs = _runs(spark, sf)
    return K_.paired_sessions(runs, runs.filter("fold <> '3'"))


#: Groups are runs: the configuration is the group's rest by four, the seed what it goes into; two stages, of which the second shifts the class.
SQL_FIX = f"""{sql_folds(2)}, ac AS (SELECT gid::varchar fold, s, sum(hits)/sum(support) raw, max(support)/sum(support) majority FROM c GROUP BY 1, 2), bi AS (SELECT gid, greatest(1, ceil(15*conf)::int) bin, sum(conf) conf, sum(hit::int) hit, count(*) n FROM pr GROUP BY 1, 2),
ec AS (SELECT gid::varchar fold, sum(abs(hit-conf))/sum(n) ece FROM bi GROUP BY 1), mc AS (SELECT gid::varchar fold, avg(conf) mc FROM pr WHERE gid % 4 = 1 GROUP BY 1), co AS (SELECT concat('cfg', gid % 4, '__lp') config, max(conf) uncentred FROM pr WHERE gid % 4 < 2 GROUP BY 1),
sc AS (SELECT concat('cfg', fold::int % 4, '__lp') config, fold, concat('stage', s) stage, raw, majority, balanced_accuracy, chance FROM fm JOIN ac USING (fold) WHERE concat('set', s) = features),
kn AS (SELECT concat('cfg', fold::int % 4, '__lp') config, avg(ece) ece, avg(mc) mc FROM ec LEFT JOIN mc USING (fold) GROUP BY 1)"""
FIX_COLUMNS = {"raw_accuracy": "raw", "margin": "raw - majority", "balanced_accuracy": "balanced_accuracy", "chance": "chance"}


@query(f"{SQL_FIX} SELECT config, stage, count(*) seeds, {', '.join(r(f'avg({e})', f'{n}_mean') + ', ' + r(f'stddev_samp({e})', f'{n}_sd') for n, e in FIX_COLUMNS.items())}, {r('any_value(ece)', 'ece')}, {r('any_value(mc)', 'identity_auc')}, {r('any_value(uncentred)', 'uncentred')} FROM sc JOIN kn USING (config) LEFT JOIN co USING (config) GROUP BY 1, 2")
def fix_table(spark, sf):
    """Configurations over seeds; mean confidence stands for how well the dataset can be told, and is known of one configuration."""
    tag = F.concat(F.lit("cfg"), (F.col("gid") % 4).cast("string"), F.lit("__seed"), F.floor(F.col("gid") / 4).cast("string"), F.lit("__lp"))
    rows = M.with_probabilities(V.big(spark, sf), K).withColumn("tag", tag)
    both = rows.withColumn("s", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("pred", (F.col("pred") + F.col("s")) % 5).withColumn("stage", F.concat(F.lit("stage"), "s"))
    scores = M.class_report(both, ["tag", "stage"]).select("tag", "stage", F.col("accuracy").alias("raw_accuracy"), "majority", "balanced_accuracy", "chance")
    identity = rows.filter("gid % 4 = 1").groupBy("tag").agg(F.avg("conf").alias("identity_auc"))
    controls = rows.filter("gid % 4 < 2").groupBy(F.regexp_replace("tag", K_.SEED, "").alias("config")).agg(F.max("conf").alias("uncentred"))
    return K_.fix_table(scores, M.calibration_error(rows, ["tag"]), identity, controls)


#: A fold stands for a transform (group 0 for none), a feature set for a model.
@query(f"{FOLDS}, no AS (SELECT features, balanced_accuracy b FROM fm WHERE fold = '0'), de AS (SELECT CASE fold WHEN '0' THEN 'none' ELSE fold END ablation, features, CASE fold WHEN '0' THEN balanced_accuracy ELSE balanced_accuracy - b END x FROM fm JOIN no USING (features))\nSELECT 'big' AS scheme, ablation, {', '.join(r(f'max(x) FILTER (features = {chr(39)}set{i}{chr(39)})', f'set{i}') for i in range(3))} FROM de GROUP BY 2")
def ablation_report(spark, sf):
    f = _folds(spark, sf)
    none = f.filter("fold = '0'").select("features", F.col("balanced_accuracy").alias("_none"))
    table = f.join(none, "features").select("scheme", F.when(F.col("fold") == "0", "none").otherwise(F.col("fold")).alias("ablation"), F.col("features").alias("model"), "balanced_accuracy", (F.col("balanced_accuracy") - F.col("_none")).alias("delta"))
    return K_.ablation_report(table, ["set0", "set1", "set2"])


@query(SQL_CALIBRATION)
def calibration_report(spark, sf):
    return K_.calibration_report(V.chunks(spark, sf), "dataset", "labA", "labB", K)


#: set0 stands for position, set1 for a signal, set2 for both; the fourth is the control.
SQL_FUSED = f"""{SQL_RUNS}, fu AS (SELECT scheme, fold, max(balanced_accuracy) FILTER (features = 'set0') p, max(balanced_accuracy) FILTER (features = 'set1') s, max(balanced_accuracy) FILTER (features = 'set2') f FROM ru GROUP BY 1, 2)"""


def _fused(spark, sf):
    names = F.when(F.col("features") == "set0", "position").when(F.col("features") == "set1", "sig").when(F.col("features") == "set2", "position+sig")
    return _runs(spark, sf).withColumn("features", names)


def _depth(spark, sf):
    rows = M.with_probabilities(V.big(spark, sf), K).withColumn("half_width_um", (F.col("channel") % 4) * 100.0)
    hit = lambda s: F.avg((F.col("label") == (F.col("pred") + s) % 5).cast("double"))
    return rows.groupBy(F.concat(F.lit("loso_"), (F.col("gid") % 2).cast("string")).alias("scheme"), "gid", "half_width_um").agg(hit(0).alias("position"), hit(1).alias("signal"), hit(2).alias("fused"))


def _position_tables(spark, sf):
    f = _fused(spark, sf)
    boundary = I.boundary_table(I.boundary_distance(V.chunks(spark, sf), "region_ix"), ["dataset"], [])
    return K_.position_tables(f, f.filter("not control"), _depth(spark, sf), boundary, ["loso_0", "loso_1"])


@query(f"""{SQL_RUNS}, al AS (SELECT scheme, CASE features WHEN 'set0' THEN 'position' WHEN 'set1' THEN 'sig' ELSE 'position+sig' END features, balanced_accuracy b FROM ru WHERE NOT control UNION ALL SELECT scheme, 'chance', chance FROM ru WHERE NOT control)
SELECT features, {r("avg(b) FILTER (scheme = 'loso_0')", 'loso_0')}, {r("avg(b) FILTER (scheme = 'loso_1')", 'loso_1')} FROM al GROUP BY 1""")
def position_baselines(spark, sf):
    return _position_tables(spark, sf)["baselines"]


@query(f"{SQL_FUSED} SELECT scheme, 'position+sig' AS features, count(*) folds, {r('avg(f - p)', 'over_base')}, count(*) FILTER (f > p) base_wins, {r('avg(f - s)', 'over_signal')}, count(*) FILTER (f > s) signal_wins FROM fu GROUP BY 1")
def position_gains(spark, sf):
    return _position_tables(spark, sf)["gains"]


@query(f"""{BIG}, dp AS (SELECT concat('loso_', gid % 2) AS scheme, gid, (channel % 4) * 100e0 w, avg((label = pred)::int) p, avg((label = (pred + 1) % 5)::int) s, avg((label = (pred + 2) % 5)::int) f FROM pr GROUP BY 1, 2, 3),
me AS (SELECT scheme, w, avg(p) p, avg(s) s, avg(f) f FROM dp GROUP BY 1, 2), ne AS (SELECT *, p - s g, lead(w) OVER v w2, lead(p - s) OVER v g2 FROM me WINDOW v AS (PARTITION BY scheme ORDER BY w)),
cr AS (SELECT scheme, min(CASE WHEN g >= 0 AND g2 < 0 THEN w + (w2 - w) * g / (g - g2) END) c, arg_min(p < s, w) first FROM ne GROUP BY 1)
SELECT scheme, {r('w', 'half_width_um')}, {r('p', 'position')}, {r('s', 'signal')}, {r('f', 'fused')}, {r('c', 'crossing_um')}, first AS signal_first FROM me JOIN cr USING (scheme)""")
def position_depth(spark, sf):
    return _position_tables(spark, sf)["depth"]


#: Days of one user stand for the epochs of a run, the mean value of a day for its validation score.
@query(f"""WITH h AS (SELECT user_id run, row_number() OVER (PARTITION BY user_id ORDER BY d) epoch, s FROM (SELECT user_id, ts::date d, round(ln(1 + avg(value)), 6) s FROM events GROUP BY 1, 2)),
b AS (SELECT *, coalesce(s > max(s) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) better FROM h),
c AS (SELECT *, epoch - max(CASE WHEN better THEN epoch END) OVER (PARTITION BY run ORDER BY epoch) since FROM b), st AS (SELECT run, coalesce(min(epoch) FILTER (since >= 3), max(epoch)) stopped_at FROM c GROUP BY 1)
SELECT run, arg_max(epoch, s) FILTER (better) AS best_epoch, {r('max(s)', 'best')}, stopped_at FROM c JOIN st USING (run) WHERE epoch <= stopped_at GROUP BY run, stopped_at""")
def early_stop(spark, sf):
    from pyspark.sql import Window as W

    e = V.read(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("d")).agg(F.round(F.log(1 + F.avg("value")), 6).alias("val_score"))
    history = e.select(F.col("user_id").alias("run"), F.row_number().over(W.partitionBy("user_id").orderBy("d")).alias("epoch"), "val_score")
    return K_.early_stop(history, ["run"], 3)


@query(f"{BIG} SELECT gid, label, {r('avg(conf)', 'mean')}, {r('stddev_samp(conf) / sqrt(count(conf))', 'sem')}, count(conf) n FROM pr GROUP BY 1, 2")
def sem_by_level(spark, sf):
    return K_.mean_and_error(M.with_probabilities(V.big(spark, sf), K), ["gid", "label"], "conf")



@query(f"{FOLDS} SELECT features, control, fold, {r("balanced_accuracy / CASE WHEN features = 'set1' THEN 2 ELSE 1 END", 'balanced_accuracy')} FROM fm")
def replaced_results(spark, sf):
    """Fold metrics by feature set on disk, after one set was replaced in place."""
    f, path = _folds(spark, sf).select("features", "control", "fold", "balanced_accuracy"), scratch_path(spark, "results")
    partitions.replace_partitions(f, path, ["features"])
    partitions.replace_partitions(f.filter("features = 'set1'").withColumn("balanced_accuracy", F.col("balanced_accuracy") / 2), path, ["features"])
    return spark.read.parquet(path).select("features", "control", "fold", "balanced_accuracy")


@query(f"{BIG} SELECT gid, count(*) n, {', '.join(r(f'avg(p{i})', f'p_{i}') for i in range(K))} FROM pr GROUP BY 1")
def saved_predictions(spark, sf):
    """Mean probabilities of each group from the saved rows of the real model; those of a permuted control beside them are not saved."""
    rows, path = M.with_probabilities(V.big(spark, sf), K), scratch_path(spark, "predictions")
    both = rows.select("gid", "p", F.explode(F.array(F.lit(0), F.lit(1))).alias("draw"))
    partitions.save_predictions(both.withColumn("p", F.when(F.col("draw") == 0, F.col("p")).otherwise(F.reverse("p"))), path, ["gid"], [str(i) for i in range(K)])
    return spark.read.parquet(path).groupBy(F.col("gid").cast("int").alias("gid")).agg(F.count("*").alias("n"), *[F.avg(f"p_{i}").alias(f"p_{i}") for i in range(K)])
