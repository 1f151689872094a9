"""Chunk stores, corpora of several stores, prediction scans and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavetable.operators.prep import restored, scaled
from wavetable.schema import CHUNK_INDEX, require_columns

#: Ids of store number i begin at i times this.
STORE_STRIDE = 10_000_000


def open_store(spark: SparkSession, path: str) -> DataFrame:
    return require_columns(spark.read.parquet(path), *CHUNK_INDEX.fieldNames(), "fs", "wave")


def write_store(chunks: DataFrame, path: str, width: int, normalise: bool = True, mode: str = "append") -> None:
    """Check, normalise and write chunks, partitioned by dataset and group, so that scans prune by either."""
    require_columns(chunks, *[n for n in CHUNK_INDEX.fieldNames() if not n.startswith("scale_")], "fs", "wave")
    ok = chunks.filter(F.when(F.size("wave") == width, True).otherwise(F.raise_error(F.lit(f"a chunk has not {width} samples")).cast("boolean")))
    rows = scaled(ok) if normalise else ok.withColumn("scale_mean_uv", F.lit(0.0)).withColumn("scale_std_uv", F.lit(1.0))
    rows = rows.withColumn("wave", F.col("wave").cast("array<float>"))
    rows.repartition("dataset", "grp", "channel").sortWithinPartitions("dataset", "grp", "channel", "t0_s").write.mode(mode).partitionBy("dataset", "grp").parquet(path)


def take(chunks: DataFrame, wanted: DataFrame, microvolts: bool = False) -> DataFrame:
    """wanted: (chunk_id, order). Its chunks in that order; an unknown id raises."""
    known = chunks.withColumn("_known", F.lit(True))
    found = wanted.join(known, "chunk_id", "left")
    found = found.filter(F.when(F.col("_known"), True).otherwise(F.raise_error(F.concat(F.lit("unknown chunk "), F.col("chunk_id").cast("string"))).cast("boolean"))).drop("_known")
    return (restored(found) if microvolts else found).orderBy("order")


def corpus(stores: list[DataFrame], names: list[str], tolerance_hz: float = 0.1) -> DataFrame:
    """One index over several stores, with the name of the store, unique ids and the mean rate. Stores that do not fit, or whose ids would meet, raise."""
    if not stores:
        raise ValueError("a corpus needs a store")
    out = None
    for i, (store, name) in enumerate(zip(stores, names, strict=True)):
        part = store.withColumn("store", F.lit(name)).withColumn("row", F.col("chunk_id")).withColumn("chunk_id", F.col("chunk_id") + i * STORE_STRIDE)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    widths, low, high, mean, least, most = out.agg(F.count_distinct(F.size("wave")), F.min("fs"), F.max("fs"), F.avg("fs"), F.min("row"), F.max("row")).first()
    if len(stores) > 1 and least is not None and (least < 0 or most >= STORE_STRIDE):
        raise ValueError(f"ids from {least} to {most} do not fit between 0 and {STORE_STRIDE - 1}")
    if widths > 1:
        raise ValueError(f"chunks of {widths} lengths")
    if high - low > tolerance_hz:
        raise ValueError(f"sampling rates from {low} to {high} Hz")
    return out.withColumn("fs", F.lit(mean))


def sources(table: DataFrame, session: str, sizes: DataFrame | None = None) -> DataFrame:
    """Candidate recordings of a session that have the signal, by name, with their size."""
    found = table.filter((F.col("session") == session) & F.col("has_lfp_data"))
    return (found.join(sizes, "name", "left") if sizes is not None else found).orderBy("name")


def channel_table(channels: DataFrame, data_columns: DataFrame) -> DataFrame:
    """Anatomy and geometry beside each data column; groups whose numbers of channels differ raise."""
    n = channels.groupBy("grp").agg(F.count("*").alias("_a")).join(data_columns.groupBy("grp").agg(F.count("*").alias("_b")), "grp", "full")
    ok = n.filter(F.when(F.col("_a") == F.col("_b"), True).otherwise(F.raise_error(F.concat(F.lit("channels do not match in "), F.col("grp"))).cast("boolean")))
    return data_columns.join(channels, ["grp", "channel"]).join(ok.select("grp"), "grp")


def predictions(spark: SparkSession, paths: str | list[str], classes: list[str]) -> DataFrame:
    """Prediction files, wide (logit_<class> or p_<class>), as rows with an array; run is the file's name."""
    df = spark.read.parquet(*([paths] if isinstance(paths, str) else paths))
    df = df.withColumn("run", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.parquet)?(?:/part-[^/]*)?$", 1))
    for kind, name in (("logit", "logits"), ("p", "p")):
        own = [f"{kind}_{c}" for c in classes]
        if all(c in df.columns for c in own):
            df = df.withColumn(name, F.array(*[F.col(c).cast("double") for c in own])).drop(*own)
    return df


def wide(df: DataFrame, vector: str, classes: list[str], prefix: str) -> DataFrame:
    return df.select(*[c for c in df.columns if c != vector], *[F.get(F.col(vector), F.lit(i)).alias(f"{prefix}_{c}") for i, c in enumerate(classes)])


def write_table(df: DataFrame, path: str, kind: str = "parquet", mode: str = "overwrite") -> None:
    """parquet, csv (with header) or json (one object a line; append keeps a history)."""
    {"parquet": lambda w: w.parquet(path), "csv": lambda w: w.option("header", True).csv(path), "json": lambda w: w.json(path)}[kind](df.write.mode(mode))


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A report table (a small aggregate) as Markdown."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    shown = lambda x: "" if x is None else f"{x:.3f}" if isinstance(x, float) else str(x)
    lines = [df.columns, ["---"] * len(df.columns), *[[shown(x) for x in r] for r in rows]]
    return "\n".join("| " + " | ".join(line) + " |" for line in lines)


SPLITS = T.StructType([T.StructField(c, T.StringType()) for c in ("scheme", "fold", "part", "grp")])


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SPLITS).parquet(path)
