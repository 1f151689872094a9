"""Queries of the metric, calibration, selective and smoothing operators."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from wavetable.functions import arrays as A
from wavetable.operators import calibration as G
from wavetable.operators import metrics as M
from wavetable.operators import selective as S
from wavetable.operators import smoothing as P
from wavetable.plans.registry import query, r
from wavetable.schema import VIEWS, in_view
from wavetable.sources import views as V

BIG = f"WITH {V.SQL_BIG}, {V.sql_probabilities('big')}"
CHUNKS = f"WITH {V.SQL_CHUNKS}, {V.sql_probabilities('chunks')}"
K = V.K


def _big(spark, sf, t=1.0):
    return M.with_probabilities(V.big(spark, sf), K, t)


def _chunks(spark, sf):
    return M.with_probabilities(V.chunks(spark, sf), K)


@query(f"WITH {V.SQL_BIG}, {V.sql_probabilities('big', 1.0, 'a')}, {V.sql_probabilities('big', 2.0, 'b')} SELECT gid, 1e0 AS t, count(*) n, {r('avg(conf)', 'mean_conf')} FROM a GROUP BY gid UNION ALL SELECT gid, 2e0, count(*), {r('avg(conf)', 'mean_conf')} FROM b GROUP BY gid")
def softmax_conf(spark, sf):
    both = V.big(spark, sf).withColumn("t", F.explode(F.array(F.lit(1.0), F.lit(2.0))))
    return M.with_probabilities(both, K, F.col("t")).groupBy("gid", "t").agg(F.count("*").alias("n"), F.avg("conf").alias("mean_conf"))


@query(f"{CHUNKS} SELECT gid, count(*) FILTER (NOT (isfinite(p0) AND isfinite(p1) AND isfinite(p2) AND isfinite(p3) AND isfinite(p4))) n_nonfinite, count(*) FILTER (abs(p0+p1+p2+p3+p4-1) > 1e-4) n_bad_sum FROM pr GROUP BY gid")
def prob_validation(spark, sf):
    return M.violations(_chunks(spark, sf), ["gid"])


@query(f"{BIG} SELECT gid, {r('avg(-ln(greatest(pt, 1e-12)))', 'nll')}, {r('avg(pow(p0-(label=0)::int,2)+pow(p1-(label=1)::int,2)+pow(p2-(label=2)::int,2)+pow(p3-(label=3)::int,2)+pow(p4-(label=4)::int,2))', 'brier')} FROM pr GROUP BY gid")
def nll_brier(spark, sf):
    return M.probability_scores(_big(spark, sf), ["gid"], K).select("gid", "nll", "brier")


SQL_BINS = "b AS (SELECT {key}, greatest(1, ceil(15*conf)::int) bin, count(*) n, sum(conf) conf, sum(hit::int) hit FROM pr GROUP BY 1, 2)"


@query(f"{BIG}, {SQL_BINS.format(key='gid')} SELECT gid, {r('sum(abs(hit-conf))/sum(n)', 'ece')} FROM b GROUP BY gid")
def ece_fixed(spark, sf):
    return M.calibration_error(_big(spark, sf), ["gid"])


@query(f"""{BIG}, e AS (SELECT gid, list_sort(list_distinct(quantile_cont(conf, [{', '.join(f'{i}/15e0' for i in range(16))}]))) edges FROM pr GROUP BY gid),
b AS (SELECT gid, CASE WHEN len(edges) < 2 THEN 1 ELSE greatest(1, len(list_filter(edges, lambda x: x < conf))) END bin, count(*) n, sum(conf) conf, sum(hit::int) hit FROM pr JOIN e USING (gid) GROUP BY 1, 2)
SELECT gid, {r('sum(abs(hit-conf))/sum(n)', 'ece')} FROM b GROUP BY gid""")
def ece_adaptive(spark, sf):
    return M.adaptive_calibration_error(_big(spark, sf), ["gid"], spread=True)


@query(f"{BIG}, {SQL_BINS.format(key='0 AS z')} SELECT k::int AS bin, {r('(k-1)/15e0', 'lower')}, {r('k/15e0', 'upper')}, {r('conf/n', 'confidence')}, {r('hit/n', 'accuracy')}, coalesce(n, 0) n FROM range(1, 16) t(k) LEFT JOIN b ON bin = k")
def reliability(spark, sf):
    return M.reliability(_big(spark, sf), [])


@query(f"{BIG} SELECT gid, label::int AS label, pred::int AS pred, coalesce(n, 0) n FROM (SELECT gid, label, pred FROM (SELECT DISTINCT gid FROM pr), range(0, {K}) a(label), range(0, {K}) b(pred)) LEFT JOIN (SELECT gid, label, pred, count(*) n FROM pr GROUP BY 1, 2, 3) USING (gid, label, pred)")
def confusion(spark, sf):
    return M.confusion(_big(spark, sf), ["gid"], K)


def sql_report(source: str, keys: str, label: str = "label", pred: str = "pred") -> str:
    """CTE c (by class) and the columns of class_report."""
    on = " AND ".join(f"t.{k.strip()} = s.{k.strip()}" for k in keys.split(","))
    return f"""rt AS (SELECT {keys}, {label} AS label, count(*) support, sum(({label} = {pred})::int) hits FROM {source} GROUP BY ALL),
rs AS (SELECT {keys}, {pred} AS label, count(*) predicted FROM {source} GROUP BY ALL),
c AS (SELECT t.*, coalesce(predicted, 0) predicted FROM rt t LEFT JOIN rs s ON {on} AND t.label = s.label)"""


REPORT = ", ".join([
    "sum(support)::bigint AS n", r("sum(hits)/sum(support)", "accuracy"), r("avg(hits/support)", "balanced_accuracy"), r("avg(2*hits/(support+predicted))", "macro_f1"), r("1e0/count(*)", "chance"),
    r("3*sqrt(sum(0.25e0/support))/count(*)", "band"), r("max(support)/sum(support)", "majority"), r("sum(hits)/sum(support)-max(support)/sum(support)", "margin"),
])


@query(f"{BIG}, {sql_report('pr', 'gid')} SELECT gid, {REPORT} FROM c GROUP BY gid")
def fold_report(spark, sf):
    return M.class_report(_big(spark, sf), ["gid"]).drop("per_class_recall")


@query(f"{BIG}, {sql_report('pr', 'gid')} SELECT gid, label, support, hits::bigint hits, predicted, {r('hits/support', 'recall')}, {r('2*hits/(support+predicted)', 'f1')} FROM c")
def class_recalls(spark, sf):
    return M.recalls(M.confusion(_big(spark, sf), ["gid"]), ["gid"])


@query(f"{BIG}, x AS (SELECT gid, label, count(*) k FROM pr GROUP BY 1, 2) SELECT gid, {r('3*sqrt(sum(0.25e0/k))/count(*)', 'band')}, {r('1e0/count(*)', 'chance')} FROM x GROUP BY gid")
def noise_band(spark, sf):
    return M.noise_band(_big(spark, sf), ["gid"])


@query(f"""{CHUNKS}, v AS (SELECT pr.*, view FROM pr JOIN (VALUES ('4class', [0, 2, 3, 4]), ('5class', [0, 1, 2, 3, 4])) w(view, labels) ON list_contains(labels, label)),
ok AS (SELECT grp, view FROM v GROUP BY 1, 2 HAVING count(*) >= 2 AND count(DISTINCT label) >= 2),
rr AS (SELECT grp, view, label, count(*) n, avg(hit::int) rc FROM v GROUP BY 1, 2, 3),
bb AS (SELECT grp, view, greatest(1, ceil(15*conf)::int) bin, count(*) n, sum(conf) conf, sum(hit::int) hit FROM v GROUP BY 1, 2, 3),
ee AS (SELECT grp, view, sum(abs(hit-conf))/sum(n) ece FROM bb GROUP BY 1, 2)
SELECT grp, view, sum(n)::bigint n, {r('avg(rc)', 'balanced_accuracy')}, {r('any_value(ece)', 'ece')} FROM rr JOIN ee USING (grp, view) JOIN ok USING (grp, view) GROUP BY 1, 2""")
def group_view_report(spark, sf):
    rows, out = _chunks(spark, sf), None
    for view in VIEWS:
        part = in_view(rows, view).withColumn("view", F.lit(view))
        out = part if out is None else out.unionByName(part)
    out = out.join(M.scorable(out, ["grp", "view"]), ["grp", "view"], "left_semi")
    return M.full_report(out, ["grp", "view"], K).select("grp", "view", "n", "balanced_accuracy", "ece")


@query(f"""WITH {V.SQL_SCORES}, k AS (SELECT score, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2e0 rk, quality = 1 pos FROM scores)
SELECT {r('(sum(rk) FILTER (pos) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2e0) / (count(*) FILTER (pos) * count(*) FILTER (NOT pos))', 'auc')} FROM k""")
def roc_auc(spark, sf):
    return M.roc_auc(V.scores(spark, sf).withColumn("positive", F.col("quality") == 1), [])


GRID = ", ".join(f"({t!r}e0)" for t in G.temperature_grid(41))
SQL_GRID = """g AS (SELECT {key} k, t, avg(least(ln(exp((l0-m)/t)+exp((l1-m)/t)+exp((l2-m)/t)+exp((l3-m)/t)+exp((l4-m)/t)) - ((case label when 0 then l0 when 1 then l1 when 2 then l2 when 3 then l3 else l4 end)-m)/t, -ln(1e-12))) nll
FROM pr, (VALUES """ + GRID + """) v(t) GROUP BY 1, 2), best AS (SELECT k, arg_min(t, nll) t FROM g GROUP BY 1)"""


@query(f"{BIG}, {SQL_GRID.format(key='gid')} SELECT k AS gid, {r('t', 'best_t')} FROM best")
def temperature_grid(spark, sf):
    return G.best_on_grid(V.big(spark, sf), ["gid"], K)


def sql_fit(rounds: int = 3, points: int = 21) -> str:
    """Rounds over finer grids of factors around the best temperature of each dataset."""
    loss = "avg(least(ln(exp((l0-m)/{t})+exp((l1-m)/{t})+exp((l2-m)/{t})+exp((l3-m)/{t})+exp((l4-m)/{t})) - ((case label when 0 then l0 when 1 then l1 when 2 then l2 when 3 then l3 else l4 end)-m)/{t}, -ln(1e-12)))"
    values = lambda grid: ", ".join(f"({t!r}::DOUBLE)" for t in grid)
    parts = [f"g0 AS (SELECT dataset k, x t, {loss.format(t='x')} nll FROM pr, (VALUES {values(G.temperature_grid(points))}) v(x) GROUP BY 1, 2), b0 AS (SELECT k, arg_min(t, nll) t FROM g0 GROUP BY 1)"]
    step = (math.log(G.HIGH) - math.log(G.LOW)) / (points - 1)
    for i in range(1, rounds + 1):
        factors = values(G.temperature_grid(points, math.exp(-step), math.exp(step)))
        parts.append(f"g{i} AS (SELECT k, t * x t, {loss.format(t='(t * x)')} nll FROM pr JOIN b{i - 1} ON k = dataset, (VALUES {factors}) v(x) GROUP BY 1, 2), b{i} AS (SELECT k, least(greatest(arg_min(t, nll), {G.LOW}), {G.HIGH}) t FROM g{i} GROUP BY 1)")
        step = 2 * step / (points - 1)
    return ", ".join(parts) + f" SELECT k AS dataset, {r('t', 't')} FROM b{rounds}"


@query(f"{CHUNKS}, {sql_fit()}")
def temperature_fit(spark, sf):
    return G.fit_temperature(V.chunks(spark, sf), ["dataset"], K)


def _sql_scores(name: str) -> str:
    return f"""{name}_b AS (SELECT gid, greatest(1, ceil(15*conf)::int) bin, count(*) n, sum(conf) conf, sum(hit::int) hit FROM {name} GROUP BY 1, 2),
{name}_s AS (SELECT x.gid, n, acc, ece, nll, brier, mc FROM (SELECT gid, sum(abs(hit-conf))/sum(n) ece FROM {name}_b GROUP BY 1) x JOIN
(SELECT gid, count(*) n, avg(hit::int) acc, avg(conf) mc, avg(-ln(greatest(pt, 1e-12))) nll, avg(pow(p0-(label=0)::int,2)+pow(p1-(label=1)::int,2)+pow(p2-(label=2)::int,2)+pow(p3-(label=3)::int,2)+pow(p4-(label=4)::int,2)) brier FROM {name} GROUP BY 1) y ON x.gid = y.gid)"""


@query(f"""WITH {V.SQL_BIG}, {V.sql_probabilities('big', 1.0, 'a')}, {V.sql_probabilities('big', 2.0, 'b')}, {_sql_scores('a')}, {_sql_scores('b')}
SELECT a_s.gid, a_s.n, {r('a_s.acc', 'accuracy')}, {r('a_s.ece', 'ece_before')}, {r('a_s.nll', 'nll_before')}, {r('a_s.brier', 'brier_before')}, {r('a_s.mc', 'mean_conf_before')},
{r('b_s.ece', 'ece_after')}, {r('b_s.nll', 'nll_after')}, {r('b_s.brier', 'brier_after')}, {r('b_s.mc', 'mean_conf_after')} FROM a_s JOIN b_s ON a_s.gid = b_s.gid""")
def calibration_before_after(spark, sf):
    return G.before_after(V.big(spark, sf), ["gid"], K, 2.0)


#: The source's temperature in both datasets, and the target's own: scores of the logits as they are and divided by it.
SQL_CALIBRATION = f"""{CHUNKS}, {SQL_GRID.format(key='dataset')}, sp AS (SELECT split, d, t FROM (VALUES ('in_lab', 'labA', 'labA'), ('cross_lab', 'labB', 'labA'), ('cross_lab_oracle', 'labB', 'labB')) v(split, d, fitted) JOIN best ON k = fitted),
{', '.join(f"{n}_in AS (SELECT split gid, label, {', '.join(f'l{i} / {t} l{i}' for i in range(5))} FROM chunks JOIN sp ON d = dataset)" for n, t in (('a', '1e0'), ('b', 't')))}, {V.sql_probabilities('a_in', 1.0, 'a')}, {V.sql_probabilities('b_in', 1.0, 'b')}, {_sql_scores('a')}, {_sql_scores('b')}
SELECT split, {r('t', 'temperature')}, a_s.n, {r('a_s.acc', 'accuracy')}, {', '.join(r(f'{x}_s.{c}', f'{name}_{when}') for x, when in (('a', 'before'), ('b', 'after')) for c, name in (('ece', 'ece'), ('nll', 'nll'), ('brier', 'brier'), ('mc', 'mean_conf')))} FROM a_s JOIN b_s USING (gid) JOIN sp ON split = gid"""


@query(f"{CHUNKS}, {SQL_GRID.format(key='dataset')} SELECT {r('a.t', 'source_t')}, {r('b.t', 'target_t')}, {r('b.t / a.t', 'ratio')} FROM best a, best b WHERE a.k = 'labA' AND b.k = 'labB'")
def calibrate_transfer(spark, sf):
    return G.transfer(V.chunks(spark, sf), "labA", "labB", "dataset", K)


ENTROPY = "-(" + "+".join(f"p{i}*ln(greatest(p{i}, 1e-12))" for i in range(5)) + ")"


@query(f"{CHUNKS} SELECT chunk_id, {r('1 - conf', 'max_softmax')}, {r(ENTROPY, 'entropy')} FROM pr")
def uncertainty(spark, sf):
    return _chunks(spark, sf).select("chunk_id", *[c.alias(n) for n, c in S.uncertainty(F.col("p"), K).items()])


@query()
def mahalanobis(spark, sf):
    e = V.read(spark, sf, "embeddings")
    return S.mahalanobis(e.filter("label < 5"), e, "embedding", 64, ["vec_id"])


#: Scores are rounded before they are ordered, so that ties fall alike in both engines.
SQL_LONG = f"lg AS (SELECT chunk_id, dataset, 'max_softmax' AS score, round(1 - conf, 9) AS value, (NOT hit)::int AS wrong FROM pr UNION ALL SELECT chunk_id, dataset, 'entropy', round({ENTROPY}, 9), (NOT hit)::int FROM pr)"
SQL_RUN = """ru AS (SELECT score, row_number() OVER w rk, sum(wrong) OVER w er, count(*) OVER (PARTITION BY score) n FROM lg WINDOW w AS (PARTITION BY score ORDER BY value, chunk_id)),
cu AS (SELECT score, i, cov, rk k, er / rk risk FROM (SELECT DISTINCT score, n, i, 1/n::double + i*(1-1/n::double)/99e0 cov FROM ru, range(0, 100) t(i)) g JOIN ru USING (score) WHERE rk = greatest(1, round_even(cov*g.n, 0)))"""


def _long(spark, sf):
    rows = _chunks(spark, sf).withColumn("wrong", (F.col("hit") == 0).cast("int"))
    return S.long_scores(rows, K, ["chunk_id", "dataset", "wrong"]).withColumn("value", F.round("value", 9))


@query(f"{CHUNKS}, {SQL_LONG}, {SQL_RUN} SELECT score, i::int i, {r('cov', 'coverage')}, k, {r('risk', 'risk')} FROM cu")
def risk_coverage(spark, sf):
    return S.risk_coverage(_long(spark, sf), ["score"], "chunk_id")


@query(f"""{CHUNKS}, {SQL_LONG}, {SQL_RUN},
ar AS (SELECT score, sum(st) aurc FROM (SELECT score, (cov - lag(cov) OVER w) * (risk + lag(risk) OVER w) / 2 st FROM cu WINDOW w AS (PARTITION BY score ORDER BY i)) GROUP BY 1),
rk AS (SELECT score, max(er/rk) FILTER (rk = n) f, max(er/rk) FILTER (rk = greatest(1, round_even(n*0.5e0, 0))) h, max(er/rk) FILTER (rk = greatest(1, round_even(n*0.2e0, 0))) q FROM ru GROUP BY 1),
au AS (SELECT score, (sum(k) FILTER (pos) - count(*) FILTER (pos)*(count(*) FILTER (pos)+1)/2e0)/(count(*) FILTER (pos)*count(*) FILTER (NOT pos)) auc FROM
 (SELECT score, dataset = 'labB' pos, rank() OVER (PARTITION BY score ORDER BY value) + (count(*) OVER (PARTITION BY score, value) - 1)/2e0 k FROM lg) GROUP BY 1)
SELECT score, {r('aurc', 'aurc')}, {r('f', 'risk_full')}, {r('h', 'risk_half')}, {r('q', 'risk_fifth')}, {r('auc', 'in_vs_out_auc')} FROM ar JOIN rk USING (score) JOIN au USING (score)""")
def abstain(spark, sf):
    rows = _long(spark, sf)
    apart = S.separation_auc(rows.filter("dataset = 'labA'"), rows.filter("dataset = 'labB'"), ["score"]).withColumnRenamed("auc", "in_vs_out_auc")
    return S.risk_summary(rows, ["score"], "chunk_id").join(apart, "score")


@query()
def abstention_study(spark, sf):
    """The scores of abstain and the distance of the wave from those of the known dataset, on the new one."""
    rows = M.with_probabilities(V.chunks(spark, sf), K).withColumn("wrong", (~F.col("hit").cast("boolean")).cast("int"))
    return S.abstention_study(rows.filter("dataset = 'labA'"), rows.filter("dataset = 'labB'"), K, "chunk_id", "wave", d=64)


#: Mean logits are rounded before the largest is taken, for the same reason; in exact arithmetic ties go to the lower class.
def sql_channels(view: str, group: str, depth: str) -> str:
    means = ", ".join(f"avg(l{i}) a{i}" for i in range(5))
    return f"""mt AS (SELECT {group} AS g, channel, {means}, {depth} AS depth_um FROM {view} GROUP BY 1, 2),
tl AS (SELECT g, channel, depth_um, CASE greatest(a0,a1,a2,a3,a4) WHEN a0 THEN 0 WHEN a1 THEN 1 WHEN a2 THEN 2 WHEN a3 THEN 3 ELSE 4 END tm FROM mt),
od AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY depth_um, channel) o FROM tl),
vt AS (SELECT x.g, x.channel, y.tm v, count(*) c FROM od x JOIN od y ON x.g = y.g AND abs(x.o - y.o) <= 2 GROUP BY 1, 2, 3),
sp AS (SELECT g, channel, arg_min(v, -c*10 + v) sv FROM vt GROUP BY 1, 2)"""


@query(f"WITH {V.SQL_CHUNKS}, {sql_channels('chunks', 'grp', 'min(depth_um)')} SELECT g AS grp, channel, tm::int AS temporal FROM tl")
def temporal_label(spark, sf):
    return P.temporal_labels(V.chunks(spark, sf), K, ["grp", "channel"])


@query(f"WITH {V.SQL_BIG}, {sql_channels('big', 'gid', 'channel')} SELECT g AS gid, channel, tm::int AS temporal, sv::int AS spatial FROM tl JOIN sp USING (g, channel)")
def spatial_vote(spark, sf):
    channels = P.temporal_labels(V.big(spark, sf), K, ["gid", "channel"]).withColumn("depth_um", F.col("channel").cast("double"))
    return P.spatial_vote(channels, "temporal", "gid").drop("depth_um")


SMOOTHED = f"""WITH {V.SQL_CHUNKS}, {V.sql_probabilities('chunks')}, {sql_channels('chunks', 'grp', 'min(depth_um)')},
fl AS (SELECT grp AS g, channel, arg_min(label, chunk_id) label FROM chunks GROUP BY 1, 2),
rw AS (SELECT grp AS g, label, 'chunk' AS level, 'raw' AS stage, pred FROM pr UNION ALL SELECT grp, label, 'chunk', 'temporal', tm FROM pr JOIN tl ON g = grp AND tl.channel = pr.channel
UNION ALL SELECT grp, label, 'chunk', 'spatial', sv FROM pr JOIN sp ON g = grp AND sp.channel = pr.channel UNION ALL SELECT g, label, 'channel', 'temporal', tm FROM fl JOIN tl USING (g, channel)
UNION ALL SELECT g, label, 'channel', 'spatial', sv FROM fl JOIN sp USING (g, channel))"""


@query(f"{SMOOTHED}, r4 AS (SELECT * FROM rw WHERE label IN (0, 2, 3, 4)), {sql_report('r4', 'stage, level')} SELECT stage, level, {REPORT} FROM c GROUP BY 1, 2")
def smoothing_scores(spark, sf):
    rows, channels = P.smooth(V.chunks(spark, sf), K)
    return P.stage_scores(in_view(rows, "4class"), in_view(channels, "4class"), []).drop("per_class_recall")


@query(f"{SMOOTHED}, rc AS (SELECT * FROM rw WHERE level = 'channel'), {sql_report('rc', 'g, stage')} SELECT g AS grp, stage, {REPORT} FROM c GROUP BY 1, 2")
def channel_scores(spark, sf):
    rows, channels = P.smooth(V.chunks(spark, sf), K)
    return P.stage_scores(rows, channels, ["grp"]).filter("level = 'channel'").drop("level", "per_class_recall")


@query(f"{SMOOTHED}, rs_ AS (SELECT * FROM rw WHERE level = 'chunk' AND stage = 'spatial'), {sql_report('rs_', 'g')} SELECT g AS grp, {REPORT} FROM c GROUP BY 1")
def spatial_vote_report(spark, sf):
    """Flagship: a report for each group after both smoothing steps."""
    rows, _ = P.smooth(V.chunks(spark, sf), K)
    return M.class_report(rows.withColumn("pred", F.col("spatial")), ["grp"]).drop("per_class_recall")


@query(f"{CHUNKS} SELECT chunk_id, {', '.join(r(f'ln(greatest(p{i}, 1e-12))', f'l{i}') for i in range(5))} FROM pr")
def log_probabilities(spark, sf):
    rows = P.probabilities_as_logits(_chunks(spark, sf))
    return rows.select("chunk_id", *[x.alias(f"l{i}") for i, x in enumerate(A.items(F.col("logits"), K))])


@query(f"WITH {V.SQL_CHUNKS} SELECT l_orderkey AS chunk_id, count(*) n, any_value(grp) grp, any_value(channel) channel, {r('any_value(depth_um)', 'depth_um')} FROM lineitem LEFT JOIN chunks ON chunk_id = l_orderkey GROUP BY 1")
def enriched_predictions(spark, sf):
    predictions = V.big(spark, sf).select(F.col("l_orderkey").alias("chunk_id"))
    return P.with_index(predictions, V.chunks(spark, sf)).groupBy("chunk_id").agg(F.count("*").alias("n"), F.first("grp").alias("grp"), F.first("channel").alias("channel"), F.first("depth_um").alias("depth_um"))
