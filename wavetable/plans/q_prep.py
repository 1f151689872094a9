"""Queries of the preparation and store operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavetable.functions import labels as L
from wavetable.operators import prep as B
from wavetable.plans import build
from wavetable.plans.registry import query, r
from wavetable.sources import partitions, store
from wavetable.sources import views as V
from wavetable.sources.scratch import scratch_path

S = f"WITH {V.SQL_SAMPLES}"
C = f"WITH {V.SQL_CHUNKS}"
WIDTH = 8


@query(f"{S}, d AS (SELECT channel, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY channel ORDER BY sample_ix) d FROM samples WHERE sample_ix < 10000) SELECT channel, {r('1/median(d)', 'fs')} FROM d GROUP BY 1 HAVING count(d) > 0")
def sample_rate(spark, sf):
    several = V.samples(spark, sf).join(V.samples(spark, sf).groupBy("channel").count().filter("count > 1").select("channel"), "channel", "left_semi")
    return B.sampling_rate(several, ["channel"], F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)


@query(f"{S} SELECT channel, sample_ix, {r('value * 1e6', 'value')} FROM samples WHERE sample_ix >= 6 AND sample_ix < 25")
def slab(spark, sf):
    return B.slab(V.samples(spark, sf), 2.0, 8.2, 3.0).select("channel", "sample_ix", "value")


@query(f"""{S}, n AS (SELECT channel, max(sample_ix) z FROM samples GROUP BY 1) SELECT channel, bool_and(floor(value / 10) = 0) is_dead FROM samples JOIN n USING (channel)
WHERE sample_ix < 4 OR (sample_ix >= z // 2 AND sample_ix < z // 2 + 4) OR (sample_ix >= greatest(0, z - 3) AND sample_ix < greatest(0, z - 3) + 4) GROUP BY 1""")
def dead_screen(spark, sf):
    return B.dead(V.samples(spark, sf).withColumn("value", F.floor(F.col("value") / 10)), ["channel"], 4)


@query(f"""{C}, {V.SQL_CHANNELS}, d AS (SELECT *, depth_um - lag(depth_um) OVER (PARTITION BY grp ORDER BY channel) d FROM channels),
p AS (SELECT grp, count(*) FILTER (k <> 2) n_unpaired FROM (SELECT grp, depth_um, count(*) k FROM channels GROUP BY 1, 2) GROUP BY 1)
SELECT grp, count(*) FILTER (d < 0) n_unordered, count(*) FILTER (d > 0 AND abs(d - 20) > 1e-6) n_bad_pitch, count(DISTINCT lateral_um) n_columns, any_value(n_unpaired) n_unpaired FROM d JOIN p USING (grp) GROUP BY 1""")
def geometry_check(spark, sf):
    return B.geometry_violations(V.channels(spark, sf), ["grp"])


WINDOWS = f"{S}, w AS (SELECT channel, sample_ix // {WIDTH} k, list(value ORDER BY sample_ix) v FROM samples GROUP BY 1, 2 HAVING count(*) = {WIDTH}), z AS (SELECT *, list_avg(v) mean, sqrt(list_avg(list_transform(v, lambda x: pow(x - list_avg(v), 2)))) sd FROM w)"


def _windows(spark, sf):
    return B.windows(V.samples(spark, sf), ["channel"], WIDTH)


@query(f"{WINDOWS} SELECT channel, k, k * {WIDTH} AS start, {r('v[1]', 'first')}, {r('v[8]', 'last')} FROM w")
def chunk_windows(spark, sf):
    return _windows(spark, sf).select("channel", "k", "start", F.col("wave")[0].alias("first"), F.col("wave")[WIDTH - 1].alias("last"))


@query(f"{WINDOWS} SELECT channel, k, {r('mean', 'scale_mean_uv')}, {r('sd', 'scale_std_uv')}, {r('(v[1] - mean) / sd', 'first')} FROM z WHERE sd > 0")
def chunk_scale(spark, sf):
    return B.scaled(_windows(spark, sf)).select("channel", "k", "scale_mean_uv", "scale_std_uv", F.col("wave")[0].alias("first"))


@query(f"{WINDOWS} SELECT channel, k, {r('(v[1] - mean) / (sd + 1e-8)', 'first')}, {r('(v[8] - mean) / (sd + 1e-8)', 'last')} FROM z")
def chunk_zscore(spark, sf):
    z = _windows(spark, sf).withColumn("z", B.zscore(F.col("wave")))
    return z.select("channel", "k", F.col("z")[0].alias("first"), F.col("z")[WIDTH - 1].alias("last"))


@query(f"{WINDOWS} SELECT channel, count(*) n, count(*) FILTER (list_max(v) = list_min(v)) n_flat FROM w GROUP BY 1")
def flat_chunks(spark, sf):
    return B.flat_counts(_windows(spark, sf), ["channel"])


@query(f"{WINDOWS} SELECT channel, k, {r('list_sum(v)', 'total')} FROM z WHERE sd > 0")
def restore_scale(spark, sf):
    back = B.restored(B.scaled(_windows(spark, sf)))
    return back.select("channel", "k", F.aggregate("wave", F.lit(0.0), lambda a, x: a + x).alias("total"))


#: Acronyms to map, one for each channel number of the large view and two blanks.
ACRONYMS = [
    "CA1", "CA1slm", "CA2so", "CA3sp", "DG-mo", "DGsg", "VISp", "VISp2/3", "VISpm6a", "VISrl5", "VISam", "root", "void", "nan", "", "LP", "TH", "VISC", "SUB", "PoST", "VISpor1", "CA", "ca1", "VISli6b", "VIS", "MOp2/3", "VISa4", "CA1sp ", " DG", "VISal2/3",
    "RSPd6a", "HPF", "fiber tracts", "VISl5", "VISmma", "VISmmp1", "VISpl6b", "LGd", "APN", "DG-sg", "CA3slu", "CA2", "CA3", "DG", "VISp6", "VISp5a", "alv", "ccs", "or", "SSp-bfd4", "PRE", "ProS", "POL", "CL", "MB", "VISx", "AVISp", "DGlb", "VIS2/3", "VISm",
]


def _acronyms(spark, sf):
    named = V.big(spark, sf).select("gid", "channel").withColumn("acronym", F.get(F.array(*[F.lit(a) for a in ACRONYMS]), F.col("channel")))
    return named.withColumn("region", L.region(F.col("acronym")))


SQL_REGION = """CASE WHEN trim(a) IN ('', 'root', 'void', 'nan') THEN 'UNK' WHEN regexp_replace(trim(a), '([A-Za-z])[0-9]+(/[0-9]+)?[ab]?$', '\\1') IN ({v}) OR trim(a) IN ({v}) THEN 'VIS'
WHEN trim(a) LIKE 'CA1%' THEN 'CA1' WHEN trim(a) LIKE 'CA2%' THEN 'CA2' WHEN trim(a) LIKE 'CA3%' THEN 'CA3' WHEN trim(a) LIKE 'DG%' THEN 'DG' ELSE 'UNK' END""".format(v=", ".join(f"'{x}'" for x in L.VISUAL))
SQL_NAMED = f"WITH {V.SQL_BIG}, n AS (SELECT gid, channel, ([{', '.join(repr(a) for a in ACRONYMS)}])[channel + 1] a FROM big), m AS (SELECT gid, channel, a, {SQL_REGION} AS region FROM n)"


@query(f"{SQL_NAMED} SELECT a AS acronym, region, count(*) n FROM m GROUP BY 1, 2")
def region_map(spark, sf):
    return _acronyms(spark, sf).groupBy("acronym", "region").agg(F.count("*").alias("n"))


@query(f"{SQL_NAMED} SELECT gid, region, coalesce(n, 0) n FROM (SELECT gid, region FROM (SELECT DISTINCT gid FROM m), (VALUES ('CA1'), ('CA2'), ('CA3'), ('DG'), ('VIS'), ('UNK')) v(region)) LEFT JOIN (SELECT gid, region, count(*) n FROM m GROUP BY 1, 2) k USING (gid, region)")
def region_counts(spark, sf):
    return B.region_counts(_acronyms(spark, sf), ["gid"])


@query(f"{SQL_NAMED} SELECT DISTINCT gid, channel, region FROM m WHERE region <> 'UNK' AND (gid + channel) % 4 = 0")
def usable_channels(spark, sf):
    channels = _acronyms(spark, sf).select("gid", "channel", "region", ((F.col("gid") + F.col("channel")) % 4).alias("quality")).distinct()
    return B.usable(channels).drop("quality")


def _two_stores(spark, sf):
    c = V.chunks(spark, sf).withColumn("fs", F.when(F.col("dataset") == "labA", 1250.02).otherwise(1249.98))
    return store.corpus([c.filter("dataset = 'labA'"), c.filter("dataset = 'labB'")], ["a", "b"])


CORPUS = f"{C}, co AS (SELECT CASE dataset WHEN 'labA' THEN 'a' ELSE 'b' END AS store, chunk_id AS row, chunk_id + CASE dataset WHEN 'labA' THEN 0 ELSE 10000000 END AS chunk_id, grp, avg(CASE dataset WHEN 'labA' THEN 1250.02e0 ELSE 1249.98e0 END) OVER () fs FROM chunks)"


@query(f"{CORPUS} SELECT store, grp, count(*) n, min(chunk_id) first_id, {r('any_value(fs)', 'fs')} FROM co GROUP BY 1, 2")
def corpus_union(spark, sf):
    return _two_stores(spark, sf).groupBy("store", "grp").agg(F.count("*").alias("n"), F.min("chunk_id").alias("first_id"), F.first("fs").alias("fs"))


@query(f"{CORPUS} SELECT (row_number() OVER (ORDER BY md5(chunk_id::varchar))) - 1 AS \"order\", chunk_id, store, row FROM co")
def take_by_id(spark, sf):
    """Every chunk, asked for in a shuffled order."""
    from wavetable.operators.ranks import ranked

    c = _two_stores(spark, sf)
    wanted = ranked(c.select("chunk_id").withColumn("_o", F.md5(F.col("chunk_id").cast("string").cast("binary"))), ["_o", "chunk_id"]).select("chunk_id", (F.col("rank") - 1).alias("order"))
    return store.take(c, wanted).select("order", "chunk_id", "store", "row")


@query(f"{C}, {V.SQL_CHANNELS} SELECT grp, (SELECT count(*) FROM channels h WHERE h.grp = c.grp) n_channels, (SELECT count(*) FROM channels h WHERE h.grp = c.grp AND region_ix <> 1) n_kept, 0::bigint n_unlabelled, count(*) n_chunks, {', '.join(f'count(*) FILTER (region_ix = {i}) region_{i}' for i in range(5))} FROM chunks c GROUP BY grp")
def dataset_card(spark, sf):
    channels = V.channels(spark, sf).withColumn("usable", F.col("region_ix") != 1)
    return B.dataset_card(channels, V.chunks(spark, sf), list(range(5)), "region_ix")


@query(f"{C} SELECT region_ix, count(*) n, {r('avg(l0)', 'mean')}, {r('median(l0)', 'median')} FROM chunks GROUP BY 1")
def region_profile(spark, sf):
    return B.region_profile(V.chunks(spark, sf), "region_ix", F.col("logits")[0])


@query(f"{C} SELECT count(*) n, count(*) FILTER (len(wave) <> 64) n_bad_width, 0::bigint n_nonfinite, count(*) FILTER (list_max(wave) = list_min(wave)) n_flat, count(*) FILTER (label NOT BETWEEN 0 AND 4) n_bad_label, (SELECT min(k) FROM (SELECT count(*) k FROM chunks GROUP BY grp, channel)) min_per_channel, (SELECT max(k) FROM (SELECT count(*) k FROM chunks GROUP BY grp, channel)) max_per_channel FROM chunks")
def quality_checks(spark, sf):
    return B.quality_checks(V.chunks(spark, sf), 64, "label", 5)


@query("SELECT o_orderkey, 'no lines' AS reason FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def skip_ledger(spark, sf):
    return B.skip_ledger(V.read(spark, sf, "orders"), V.read(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", F.lit("no lines"))


@query(f"{C} SELECT count(*) n, bit_xor(cast(concat('0x', substr(md5(concat_ws('|', chunk_id, grp, channel, region_ix)), 1, 12)) as bigint)) fingerprint FROM chunks")
def fingerprint(spark, sf):
    return B.fingerprint(V.chunks(spark, sf), ["chunk_id", "grp", "channel", "region_ix"])


@query(f"{C}, {V.SQL_CHANNELS} SELECT grp, channel, gid, depth_um, lateral_um, count(*) n FROM chunks JOIN channels USING (grp, channel, gid, depth_um, lateral_um) GROUP BY ALL")
def channel_table(spark, sf):
    c = V.chunks(spark, sf)
    data = c.groupBy("grp", "channel").agg(F.count("*").alias("n"))
    return store.channel_table(V.channels(spark, sf).select("grp", "channel", "gid", "depth_um", "lateral_um"), data)


@query("SELECT o_orderkey AS name, o_orderpriority AS session, o_orderstatus = 'O' AS has_lfp_data, count(l_orderkey) size FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'O' GROUP BY 1, 2, 3")
def source_listing(spark, sf):
    o = V.read(spark, sf, "orders").select(F.col("o_orderkey").alias("name"), F.col("o_orderpriority").alias("session"), (F.col("o_orderstatus") == "O").alias("has_lfp_data"))
    sizes = V.read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("name")).agg(F.count("*").alias("size"))
    return store.sources(o, "1-URGENT", sizes).withColumn("size", F.coalesce("size", F.lit(0)))


BUILT = f"""{S}, ac AS (SELECT *, ([{', '.join(repr(a) for a in ACRONYMS)}])[(channel % 60 + 1)::bigint] a FROM (SELECT DISTINCT channel FROM samples)), ch AS (SELECT channel, {SQL_REGION} AS region FROM ac),
w AS (SELECT channel, sample_ix // {WIDTH} k, list(value ORDER BY sample_ix) v FROM samples GROUP BY 1, 2 HAVING count(*) = {WIDTH}),
ok AS (SELECT channel, count(*) n FROM w WHERE list_max(v) > list_min(v) GROUP BY 1)"""


def _recordings(spark, sf):
    """Samples as blocks of seven, users as channels of four groups."""
    s = V.samples(spark, sf).withColumn("grp", F.concat(F.lit("g"), F.col("channel") % 4))
    blocks = s.groupBy("grp", "channel", (F.floor(F.col("sample_ix") / 7) * 7).alias("block_start")).agg(F.transform(F.array_sort(F.collect_list(F.struct("sample_ix", "value"))), lambda x: x["value"]).alias("samples"))
    acronym = F.get(F.array(*[F.lit(a) for a in ACRONYMS]), (F.col("channel") % 60).cast("int"))
    channels = s.select("grp", "channel").distinct().withColumn("acronym", acronym).withColumn("valid_data", F.col("channel") % 5 != 0)
    return build.build_chunks(blocks, channels, 1.0, WIDTH, 0.0, None)


@query(f"""{BUILT}, z AS (SELECT channel, k, v, list_avg(v) m, sqrt(list_avg(list_transform(v, lambda x: pow(x - list_avg(v), 2)))) sd FROM w WHERE list_max(v) > list_min(v))
SELECT concat('g', channel % 4) grp, channel, k::int AS k, region, (i - 1)::int AS place, {r('(x - m) / sd', 'value')}, {r('m', 'scale_mean_uv')}, {r('sd', 'scale_std_uv')}
FROM (SELECT channel, k, m, sd, unnest(v) x, generate_subscripts(v, 1) i FROM z) JOIN ch USING (channel) WHERE region <> 'UNK' AND channel % 5 <> 0""")
def store_build(spark, sf):
    """Every sample of every chunk of the store."""
    return _recordings(spark, sf)[0].select("grp", "channel", "k", "region", F.posexplode("wave").alias("place", "value"), "scale_mean_uv", "scale_std_uv")


@query(f"{BUILT} SELECT concat('g', channel % 4) grp, channel, CASE WHEN region = 'UNK' THEN 'no region' WHEN channel % 5 = 0 THEN 'bad channel' ELSE 'no complete live window' END AS reason FROM ch LEFT JOIN ok USING (channel) WHERE region = 'UNK' OR channel % 5 = 0 OR n IS NULL")
def store_ledger(spark, sf):
    return _recordings(spark, sf)[1]


@query(f"{C} SELECT scheme, count(*) n FROM (SELECT 'cross_session_all' scheme, grp FROM chunks GROUP BY ALL UNION ALL SELECT concat('cross_session_', dataset), grp FROM chunks GROUP BY ALL UNION ALL SELECT unnest(['cross_lab_labA_to_labB', 'cross_lab_labB_to_labA']), grp FROM (SELECT DISTINCT grp FROM chunks)) GROUP BY 1")
def named_splits(spark, sf):
    return build.named_splits(V.chunks(spark, sf)).groupBy("scheme").agg(F.count("*").alias("n"))


def _stored(spark, sf):
    """Chunks with all columns of a store."""
    c = V.chunks(spark, sf)
    return c.select(
        "chunk_id", "dataset", F.lit("s").alias("session"), F.col("grp").alias("probe"), "channel", "depth_um", F.lit("CA1").alias("acronym"), F.concat(F.lit("r"), "region_ix").alias("region"),
        (F.col("chunk_id") * 3.0).alias("t0_s"), "grp", F.lit(1250.0).alias("fs"), "wave",
    )


@query(f"{C}, sc AS (SELECT *, list_avg(wave::DOUBLE[]) m FROM chunks), sd AS (SELECT *, sqrt(list_avg(list_transform(wave::DOUBLE[], lambda x: pow(x - m, 2)))) s FROM sc) SELECT chunk_id, grp, dataset, concat('r', region_ix) AS region, {r('m', 'scale_mean_uv')}, {r('s', 'scale_std_uv')}, (i - 1)::int AS place, round(((x - m) / s)::FLOAT::DOUBLE, 4) + 0e0 AS value FROM (SELECT *, unnest(wave::DOUBLE[]) x, generate_subscripts(wave, 1) i FROM sd WHERE s > 0)")
def store_round_trip(spark, sf):
    """A store written, normalised, and opened again."""
    path = scratch_path(spark, "store")
    store.write_store(_stored(spark, sf), path, 64)
    return store.open_store(spark, path).select("chunk_id", "grp", "dataset", "region", "scale_mean_uv", "scale_std_uv", F.posexplode("wave").alias("place", "value")).withColumn("value", F.round(F.col("value").cast("double"), 4))


@query(f"{C} SELECT chunk_id, label, 'run7' AS run, kind, {', '.join(r(f'l{i}', f'l{i}') for i in range(5))} FROM chunks, (VALUES ('logit'), ('p')) t(kind)")
def prediction_scan(spark, sf):
    """Predictions written with a column for each class, logits or probabilities, and scanned as arrays."""
    c, names, out = V.chunks(spark, sf).select("chunk_id", "label", "logits"), list("abcde"), None
    for kind in ("logit", "p"):
        path = f"{scratch_path(spark, 'predictions')}/run7.parquet"
        store.write_table(store.wide(c, "logits", names, kind), path)
        got = store.predictions(spark, path, names).withColumnRenamed("logits", "p").withColumn("kind", F.lit(kind))
        got = got.select("chunk_id", "label", "run", "kind", *[F.col("p")[i].alias(f"l{i}") for i in range(5)])
        out = got if out is None else out.unionByName(got)
    return out


@query(f"{C} SELECT kind, grp, label::bigint AS label, count(*) n FROM chunks, (VALUES ('csv'), ('json'), ('parquet')) t(kind) GROUP BY ALL")
def sink_tables(spark, sf):
    """A report written as each kind of table and read back."""
    report, out = V.chunks(spark, sf).groupBy("grp", F.col("label").cast("bigint").alias("label")).agg(F.count("*").alias("n")), None
    for kind in ("csv", "json", "parquet"):
        path = scratch_path(spark, f"report-{kind}")
        store.write_table(report, path, kind)
        got = spark.read.schema(report.schema).option("header", True).format(kind).load(path).withColumn("kind", F.lit(kind))
        out = got if out is None else out.unionByName(got)
    return out


@query(f"{C} SELECT row_number() OVER (ORDER BY md5(chunk_id::varchar), chunk_id) - 1 AS \"order\", chunk_id, grp, channel, {r('list_sum(wave::DOUBLE[])', 'total')} FROM chunks WHERE gid = 3")
def take_from_spans(spark, sf):
    """The chunks of one group, in a shuffled order, from a store written by ranges of ids."""
    from wavetable.operators.ranks import ranked

    c, path = V.chunks(spark, sf), scratch_path(spark, "by-id")
    partitions.write_by_id(c, path, span=500)
    ordered = ranked(c.filter("gid = 3").select("chunk_id").withColumn("_o", F.md5(F.col("chunk_id").cast("string").cast("binary"))), ["_o", "chunk_id"])
    found = partitions.take_by_id(spark, path, ordered.select("chunk_id", (F.col("rank") - 1).alias("order")), span=500)
    return found.select("order", "chunk_id", "grp", "channel", F.aggregate("wave", F.lit(0.0), lambda a, x: a + x.cast("double")).alias("total"))


@query("""WITH z AS (SELECT o_orderkey AS source, o_totalprice::DOUBLE size_bytes FROM orders), s AS (SELECT l_orderkey AS source, l_linenumber - 1 AS ix, max(floor(l_discount * 12)) v FROM lineitem GROUP BY 1, 2),
n AS (SELECT source, max(ix) z FROM s GROUP BY 1), d AS (SELECT source, bool_and(v = 0) dead FROM s JOIN n USING (source) WHERE ix < 1 OR (ix >= z // 2 AND ix < z // 2 + 1) OR ix >= z GROUP BY 1)
SELECT source, round(size_bytes, 2) + 0e0 AS size_bytes, size_bytes < 100000 AS looks_dead, size_bytes < 100000 AND coalesce(dead, true) AS is_dead FROM z LEFT JOIN d USING (source)""")
def size_screen(spark, sf):
    """Orders as sources, their lines as samples: only sources below a size are looked into."""
    samples = V.read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("source"), (F.col("l_linenumber") - 1).alias("sample_ix")).agg(F.max(F.floor(F.col("l_discount") * 12)).alias("value"))
    sizes = V.read(spark, sf, "orders").select(F.col("o_orderkey").alias("source"), F.round(F.col("o_totalprice").cast("double"), 2).alias("size_bytes"))
    return B.dead_by_size(samples, sizes, ["source"], 1, most_bytes=100_000)
