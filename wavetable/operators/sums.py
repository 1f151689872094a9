"""Sums of arrays that every task has a part of."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tasks whose parts meet first, where there are many tasks.
LOT = 32


def _add(frame: pd.DataFrame) -> pd.DataFrame:
    total = np.frombuffer(frame["sums"].iloc[0]).copy()
    for other in frame["sums"].iloc[1:]:
        total += np.frombuffer(other)
    return pd.DataFrame({"config": frame["config"].iloc[:1], "sums": [total.tobytes()]})


def summed(parts: DataFrame) -> dict[int, np.ndarray]:
    """Sums by config of the rows (config int, sums binary of doubles); with many tasks in two levels. One array for each config comes to the driver."""
    schema = "config int, sums binary"
    if int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")) > 2 * LOT:
        parts = parts.withColumn("lot", F.floor(F.spark_partition_id() / LOT)).groupBy("config", "lot").applyInPandas(_add, schema)
    return {x["config"]: np.frombuffer(x["sums"]) for x in parts.groupBy("config").applyInPandas(_add, schema).collect()}
