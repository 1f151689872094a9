"""Domain views over the star-schema test tables: chunk index with logits, large prediction table, samples, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

K = 5


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_id, gid, grp, dataset, channel, depth_um, lateral_um, region_ix, label, logits, wave (64 samples)."""
    e = read(spark, sf_dir, "embeddings")
    ids = e.select(
        F.col("vec_id").alias("chunk_id"), (F.col("vec_id") % 12).cast("int").alias("gid"), (F.floor(F.col("vec_id") / 12).cast("int") % 12).alias("channel"),
        (F.col("label") % 5).alias("label"), F.transform(F.slice("embedding", 1, 5), lambda x: x.cast("double") * 4).alias("logits"), F.col("embedding").alias("wave"),
    )
    return ids.select(
        "chunk_id", "gid", F.concat(F.lit("p"), (F.col("gid") + 100).cast("string")).alias("grp"), F.when(F.col("gid") < 7, "labA").otherwise("labB").alias("dataset"), "channel",
        (20 * (1 + F.floor(F.col("channel") / 2))).cast("double").alias("depth_um"), F.when(F.col("channel") % 4 == 0, 43.0).when(F.col("channel") % 4 == 1, 11.0).when(F.col("channel") % 4 == 2, 59.0).otherwise(27.0).alias("lateral_um"),
        (F.floor(F.col("channel") / 3) + F.col("gid")).cast("int").__mod__(5).alias("region_ix"), "label", "logits", "wave",
    )


def big(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction table at scale: gid (17 groups), channel (60), label, logits; its key is KEY."""
    d = lambda c, by: F.col(c).cast("double") / F.lit(by)
    return read(spark, sf_dir, "lineitem").select(
        *KEY, (F.col("l_suppkey") % 17).cast("int").alias("gid"), (F.col("l_partkey") % 60).cast("int").alias("channel"), (F.col("l_quantity").cast("int") % 5).alias("label"),
        F.array(d("l_quantity", 10.0), F.col("l_discount").cast("double") * 50.0, F.col("l_tax").cast("double") * 62.5, d("l_extendedprice", 20000.0), d("l_linenumber", 1.4)).alias("logits"),
    )


KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long-form signal: channel (a user), sample_ix in the order of time, ts, value, event_type."""
    from pyspark.sql import Window as W

    e = read(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("channel"), (F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1).alias("sample_ix"), "event_id", "ts", F.col("value").cast("double").alias("value"), "event_type")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, quality, toxic, score (length of the text)."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("score"))
    return read(spark, sf_dir, "labels").join(docs, "doc_id")


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select("grp", "gid", "dataset", "channel", "depth_um", "lateral_um", "region_ix").distinct()


#: The same views for the SQL check, as parts of a WITH clause.
SQL_CHUNKS = """chunks AS (select chunk_id, gid, concat('p', cast(100+gid as varchar)) as grp,
       case when gid < 7 then 'labA' else 'labB' end as dataset, channel,
       cast(20*(1+floor(channel/2)) as double) as depth_um,
       cast(case channel%4 when 0 then 43 when 1 then 11 when 2 then 59 else 27 end as double) as lateral_um,
       cast(floor(channel/3)+gid as int)%5 as region_ix, label5 as label, l0, l1, l2, l3, l4, wave
from (select vec_id as chunk_id, cast(vec_id%12 as int) as gid, embedding as wave,
             cast(floor(vec_id/12) as int)%12 as channel, label%5 as label5,
             4*cast(embedding[1] as double) as l0, 4*cast(embedding[2] as double) as l1,
             4*cast(embedding[3] as double) as l2, 4*cast(embedding[4] as double) as l3,
             4*cast(embedding[5] as double) as l4 from embeddings) x)"""

SQL_BIG = """big AS (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate,
       cast(l_suppkey%17 as int) as gid, cast(l_partkey%60 as int) as channel, cast(l_quantity as int)%5 as label,
       cast(l_quantity as double)/10e0 as l0, cast(l_discount as double)*50e0 as l1, cast(l_tax as double)*62.5e0 as l2, cast(l_extendedprice as double)/20000e0 as l3, cast(l_linenumber as double)/1.4e0 as l4
from lineitem)"""

SQL_SAMPLES = "samples AS (select user_id channel, row_number() over (partition by user_id order by ts, event_id) - 1 sample_ix, event_id, ts, cast(value as double) value, event_type from events)"

SQL_SCORES = "scores AS (select l.doc_id, quality, toxic, n_chars score from labels l join documents d on d.doc_id = l.doc_id)"

SQL_CHANNELS = "channels AS (select distinct grp, gid, dataset, channel, depth_um, lateral_um, region_ix from chunks)"


def sql_probabilities(view: str, temperature: float = 1.0, name: str = "pr") -> str:
    """CTEs that add p0..p4, conf, pred and hit to a view."""
    e = ", ".join(f"exp((l{i} - greatest(l0, l1, l2, l3, l4)) / {temperature}e0) e{i}" for i in range(K))
    p = ", ".join(f"e{i} / (e0 + e1 + e2 + e3 + e4) p{i}" for i in range(K))
    return f"""{name}_e AS (select *, greatest(l0, l1, l2, l3, l4) m, {e} from {view}), {name}_p AS (select *, {p} from {name}_e),
{name} AS (select *, greatest(p0, p1, p2, p3, p4) conf, pred = label hit, case label when 0 then p0 when 1 then p1 when 2 then p2 when 3 then p3 else p4 end pt
 from (select *, case when l0 = m then 0 when l1 = m then 1 when l2 = m then 2 when l3 = m then 3 else 4 end pred from {name}_p))"""
