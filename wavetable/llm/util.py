"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that Spark puts into one Arrow batch; whole documents are long, so batches stay small.
ARROW_ROWS = 512

_own_folder: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only where it is unset and driver and tasks share a machine."""
    global _own_folder
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    if _own_folder is None:
        _own_folder = tempfile.mkdtemp(prefix="spark-wavetable-")
    return _own_folder


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Lower the rows of an Arrow batch, so that a batch of whole texts stays small."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(name: str = "text"):
    """The UTF-8 bytes of a text column; null becomes empty."""
    return F.coalesce(F.col(name), F.lit("")).cast("string").cast("binary")


def row_key(docs: DataFrame) -> str:
    """SQL for a digest of all columns: rows are told apart whatever their ids are, and repeated rows have one key."""
    return f"md5(cast(to_json(struct({', '.join('`' + c.replace('`', '``') + '`' for c in docs.columns)}), map('ignoreNullFields', 'false')) as binary))"


def fresh(name: str, taken: list[str]) -> str:
    """name, with underscores in front until no taken column has it."""
    known = {c.lower() for c in taken}
    while name.lower() in known:
        name = "_" + name
    return name
