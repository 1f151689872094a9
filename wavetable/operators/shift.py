"""Domain shift: centring by group, and how well sources can be told apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavetable.functions import arrays as A


def group_means(rows: DataFrame, vector: str, group: str) -> DataFrame:
    long = rows.select(group, F.posexplode(vector).alias("i", "x")).groupBy(group, "i").agg(F.avg("x").alias("m"))
    return long.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("_mean"))


def centred_by_group(rows: DataFrame, vector: str = "v", group: str = "grp") -> DataFrame:
    """Vectors less the mean of their group."""
    means = group_means(rows, vector, group)
    return rows.join(means, group).withColumn(vector, A.centred(F.col(vector), F.col("_mean"))).drop("_mean")
