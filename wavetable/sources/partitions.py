"""Tables kept by partition: features remade for changed groups only, results and predictions replaced in place, stores looked up by id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids of one directory of a store by id, and directories up to which a lookup names them to the scan.
ID_SPAN, NAMED_SPANS = 100_000, 1_000


def _tagged(c: str) -> Column:
    """A value with its length before it, or - for null, so that neighbours cannot be taken for each other."""
    text = F.col(c).cast("string")
    return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _digest(*columns: str) -> Column:
    return F.md5(F.concat(*[_tagged(c) for c in columns]).cast("binary"))


def _combined(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, fingerprint) from rows with a digest _d, in any order; the sum beside the xor tells repeated rows."""
    head = F.conv(F.substring("_d", 1, 12), 16, 10).cast("long")
    by = df.groupBy(*keys).agg(F.count("*").alias("n"), F.bit_xor(head).alias("_x"), F.sum(head.cast("decimal(38,0)")).alias("_s"))
    return by.withColumn("fingerprint", _digest(*keys, "n", "_x", "_s")).drop("_x", "_s")


def group_fingerprints(index: DataFrame, columns: list[str], group: str = "grp") -> DataFrame:
    """(group, n, fingerprint): the lower level of a fingerprint tree, a row for each group (null is one)."""
    return _combined(index.withColumn("_d", _digest(*columns)), [group])


def store_fingerprint(groups: DataFrame, group: str = "grp") -> DataFrame:
    """(n, fingerprint): the root over group_fingerprints, without reading the store again; an empty store has a root too."""
    root = _combined(groups.withColumn("_d", _digest(group, "fingerprint")), [])
    return root.join(groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))).select(F.col("rows").alias("n"), "fingerprint")  # one row each


class PartitionedCache:
    """Feature tables under path/<set>/fingerprint=<fingerprint of a group>; only groups that are not there are built.

    A directory belongs to the contents of one group, so that nothing that a reader may hold is changed, and a group that
    turns back to what it was is found again. A directory with another number of rows than its group (a job that failed
    while its files were moved) is replaced. A set has as many directories as groups had contents.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _kept(self, name: str) -> DataFrame | None:
        try:
            found = self.spark.read.parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise
        return found.withColumn("fingerprint", F.col("fingerprint").cast("string"))

    def get_or_build(self, name: str, index: DataFrame, columns: list[str], build: Callable[[DataFrame], DataFrame], key: str = "chunk_id", group: str = "grp") -> DataFrame:
        """The features of index: build(rows of the groups that are new or changed) has a row for each key, without a column fingerprint."""
        from wavetable.sources.scratch import materialize

        prints = materialize(group_fingerprints(index, columns, group), "fingerprints")
        kept = self._kept(name)
        lost = prints
        if kept is not None:
            sizes = kept.groupBy("fingerprint").agg(F.count("*").alias("_n"))
            lost = prints.join(sizes, (prints["fingerprint"] == sizes["fingerprint"]) & (prints["n"] == sizes["_n"]), "left_anti")
        lost = materialize(lost.select(F.col(group).alias("_group"), "fingerprint"), "changed")
        if kept is None or not lost.isEmpty():
            changed = index.join(lost, index[group].eqNullSafe(lost["_group"]), "left_semi")
            marks = changed.select(key, group).join(lost, F.col(group).eqNullSafe(F.col("_group"))).select(key, "fingerprint")
            made = build(changed).join(marks, key)
            made.hint("rebalance", "fingerprint").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("fingerprint").parquet(f"{self.path}/{name}")
            kept = self._kept(name)
            if kept is None:  # no groups: a table without rows
                return build(changed)
        asked = prints.filter("n > 0").select("fingerprint")  # a condition, so that the scan is pruned to the asked directories
        return kept.join(asked, "fingerprint", "left_semi").drop("fingerprint")


def replace_partitions(rows: DataFrame, path: str, by: list[str]) -> None:
    """Put rows at path, partitioned by `by`: partitions that rows has are replaced as a whole, others stay as they are.

    New files are staged and moved when all tasks are done, so that a job that fails in its tasks leaves the table as it was.
    A null or empty value of a key, which a directory name cannot tell apart, fails the job. Without rows nothing changes.
    """
    filled = None
    for c in by:
        ok = F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
        filled = ok if filled is None else filled & ok
    checked = rows.filter(F.when(filled, True).otherwise(F.raise_error(F.lit(f"a row without {', '.join(by)}")).cast("boolean")))
    checked.hint("rebalance", *by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def save_predictions(predicted: DataFrame, path: str, by: list[str], classes: list[str], control: str = "draw") -> None:
    """Predictions of real models as p_<class> columns, by partition; rows of controls (a draw above 0, or a true flag) are never saved."""
    from wavetable.sources.store import wide

    real = predicted.filter(F.coalesce(F.col(control).cast("int"), F.lit(0)) == 0).drop(control)
    replace_partitions(wide(real, "p", classes, "p"), path, by)


def write_by_id(chunks: DataFrame, path: str, key: str = "chunk_id", span: int = ID_SPAN, mode: str = "overwrite") -> None:
    """Write a store by ranges of ids, each a directory, sorted inside, so that lookups skip directories, files and row groups."""
    placed = chunks.withColumn("id_span", F.floor(F.col(key) / span).cast("long"))
    placed.repartitionByRange("id_span", key).sortWithinPartitions("id_span", key).write.mode(mode).partitionBy("id_span").parquet(path)


def take_by_id(spark: SparkSession, path: str, wanted: DataFrame, key: str = "chunk_id", span: int = ID_SPAN) -> DataFrame:
    """wanted: (key, order). Its rows of a store that write_by_id made with the same span, in that order; an unknown id raises.

    The directories of wanted ids are named to the scan, which reads no other; beyond NAMED_SPANS of them all are read.
    """
    store = spark.read.parquet(path)
    store = store.withColumn("id_span", F.col("id_span").cast("long")).withColumn("_known", F.lit(True))
    asked = wanted.withColumn("id_span", F.floor(F.col(key) / span).cast("long"))
    spans = [r["id_span"] for r in asked.select("id_span").distinct().limit(NAMED_SPANS + 1).collect()]  # so many numbers at most
    if len(spans) <= NAMED_SPANS:
        store = store.filter(F.col("id_span").isin([s for s in spans if s is not None]))
    found = asked.join(store, ["id_span", key], "left").drop("id_span")
    known = F.when(F.col("_known"), True).otherwise(F.raise_error(F.concat(F.lit("unknown chunk "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("boolean"))
    return found.filter(known).drop("_known").orderBy("order")
