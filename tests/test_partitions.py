"""Tables kept by partition: what is remade, what a failed job leaves, what a lookup reads."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from wavetable.operators import features as D
from wavetable.operators import prep as B
from wavetable.sources import partitions as P
from wavetable.sources.scratch import scratch_path

INDEX = "chunk_id long, grp string, scale_std_uv double, scale_mean_uv double"
COLUMNS = ["chunk_id", "scale_std_uv", "scale_mean_uv"]


def index(spark, changed=None):
    return spark.createDataFrame([(i, [None, "", "a", "b"][i % 4], float(i + 1), 7.0 if i == changed else 0.0) for i in range(20)], INDEX)


def files(path):
    return {str(f): f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")}


def test_only_changed_groups_are_built(spark):
    cache, path, built = P.PartitionedCache(spark, scratch_path(spark, "cache")), None, []

    def build(rows):
        built.append({r["grp"] for r in rows.select("grp").distinct().collect()})
        return D.amplitude(rows)

    def get(df):
        return {r["chunk_id"]: r["v"][1] for r in cache.get_or_build("amplitude", df, COLUMNS, build).collect()}

    assert get(index(spark)) == {i: 0.0 for i in range(20)} and built == [{None, "", "a", "b"}]
    path = f"{cache.path}/amplitude"
    before = files(path)
    assert len(get(index(spark))) == 20 and len(built) == 1 and files(path) == before
    assert get(index(spark, changed=6))[6] == 7.0 and built[1:] == [{"a"}]
    after = files(path)
    assert before.items() <= after.items() and len({Path(f).parent for f in after}) == len({Path(f).parent for f in before}) + 1
    assert sum(scanned(cache.get_or_build("amplitude", index(spark), COLUMNS, build))) <= len(before) + 1  # and the fingerprints
    assert get(index(spark))[6] == 0.0 and len(built) == 2  # back to contents that are there
    assert set(get(index(spark).filter("grp = 'b'"))) == {3, 7, 11, 15, 19} and len(built) == 2  # a group that is gone gives no rows


def test_a_directory_short_of_rows_is_made_again(spark):
    cache, built = P.PartitionedCache(spark, scratch_path(spark, "cache")), []
    build = lambda rows: built.append(1) or D.amplitude(rows)
    rows = index(spark)
    cache.get_or_build("x", rows, COLUMNS, build)
    half = spark.read.parquet(f"{cache.path}/x").filter("chunk_id = 2").collect()
    spark.createDataFrame(half, spark.read.parquet(f"{cache.path}/x").schema).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("fingerprint").parquet(f"{cache.path}/x")
    assert cache._kept("x").count() == 16
    assert cache.get_or_build("x", rows, COLUMNS, build).count() == 20 and len(built) == 2


def test_an_empty_index_has_no_features(spark):
    cache = P.PartitionedCache(spark, scratch_path(spark, "cache"))
    got = cache.get_or_build("x", index(spark).limit(0), COLUMNS, D.amplitude)
    assert got.columns == ["chunk_id", "v"] and got.count() == 0


def test_fingerprints(spark):
    a, b = index(spark), index(spark, changed=6)
    leaf = lambda df: {r["grp"]: (r["n"], r["fingerprint"]) for r in P.group_fingerprints(df, COLUMNS).collect()}
    root = lambda df: tuple(P.store_fingerprint(P.group_fingerprints(df, COLUMNS)).first())
    assert leaf(a) == leaf(a.orderBy(F.desc("chunk_id")).repartition(3))
    assert {g for g in leaf(a) if leaf(a)[g] != leaf(b)[g]} == {"a"}
    assert root(a) != root(b) and root(a)[0] == 20 and root(a.limit(0))[0] == 0
    two = a.filter("chunk_id = 2")
    assert leaf(two.union(two).union(two)) != leaf(two.union(two).union(a.filter("chunk_id = 6").withColumn("grp", F.lit("a"))))
    swapped = spark.createDataFrame([("ab", "c"), ("a", "bc")], "x string, y string").select(P._digest("x", "y").alias("d")).distinct()
    assert swapped.count() == 2


def test_partitions_are_replaced_in_place(spark):
    path = scratch_path(spark, "results")
    rows = spark.createDataFrame([("x", 1, 0.5), ("x", 2, 0.6), ("y", 1, 0.7)], "features string, fold int, score double")
    P.replace_partitions(rows, path, ["features"])
    before = files(path)
    P.replace_partitions(spark.createDataFrame([("x", 3, 0.9), ("z", 1, 0.1)], rows.schema), path, ["features"])
    read = lambda: sorted((r["features"], r["fold"]) for r in spark.read.parquet(path).collect())
    assert read() == [("x", 3), ("y", 1), ("z", 1)]
    assert {f: t for f, t in before.items() if "features=y" in f}.items() <= files(path).items()
    P.replace_partitions(rows.limit(0), path, ["features"])
    assert read() == [("x", 3), ("y", 1), ("z", 1)]


@pytest.mark.parametrize("bad", [("y", None), (None, 0.2), ("", 0.2)])
def test_a_failed_replacement_changes_nothing(spark, bad):
    path = scratch_path(spark, "results")
    P.replace_partitions(spark.createDataFrame([("x", 0.5), ("y", 0.7)], "features string, score double"), path, ["features"])
    before = files(path)
    rows = spark.createDataFrame([("x", 0.1)] * 50 + [bad], "features string, score double").repartition(4)
    failing = rows.withColumn("score", F.when(F.col("score").isNotNull(), F.col("score")).otherwise(F.raise_error(F.lit("no score")).cast("double")))
    with pytest.raises(Exception, match="no score|without features"):
        P.replace_partitions(failing, path, ["features"])
    assert files(path) == before and spark.read.parquet(path).count() == 2


def test_controls_are_never_saved(spark):
    path = scratch_path(spark, "predictions")
    rows = spark.createDataFrame([(1, "s", 0, [0.2, 0.8]), (1, "s", 1, [0.5, 0.5]), (2, "t", 3, [0.1, 0.9])], "chunk_id long, scheme string, draw int, p array<double>")
    P.save_predictions(rows, path, ["scheme"], ["u", "v"])
    assert [(r["chunk_id"], r["scheme"], r["p_u"], r["p_v"]) for r in spark.read.parquet(path).collect()] == [(1, "s", 0.2, 0.8)]
    flagged = rows.withColumn("draw", F.col("draw") > 0).withColumnRenamed("draw", "control")
    P.save_predictions(flagged, path, ["scheme"], ["u", "v"], control="control")
    assert spark.read.parquet(path).count() == 1 and "control" not in spark.read.parquet(path).columns


def scanned(df):
    """Files that the scans of an executed plan read: numbers of all scans, adaptive stages unfolded."""
    df.collect()
    out, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "FileSourceScanExec":
            out.append(node.metrics().apply("numFiles").value())
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        children = node.children()
        todo += [children.apply(i) for i in range(children.length())]
    return out


def test_a_lookup_reads_the_files_of_its_ids(spark, monkeypatch):
    path = scratch_path(spark, "store")
    P.write_by_id(spark.range(1000).select(F.col("id").alias("chunk_id"), (F.col("id") * 2).alias("x")), path, span=100)
    wanted = spark.createDataFrame([(431, 0), (17, 1), (431, 2), (499, 3)], "chunk_id long, order int")
    got = P.take_by_id(spark, path, wanted, span=100)
    assert [(r["order"], r["chunk_id"], r["x"]) for r in got.collect()] == [(0, 431, 862), (1, 17, 34), (2, 431, 862), (3, 499, 998)]
    every = sum(1 for d in Path(path).glob("id_span=*") for _ in d.glob("*.parquet"))
    assert 2 <= sum(scanned(got)) <= every // 3
    assert P.take_by_id(spark, path, wanted.limit(0), span=100).count() == 0
    monkeypatch.setattr(P, "NAMED_SPANS", 1)
    assert [r["x"] for r in P.take_by_id(spark, path, wanted, span=100).collect()] == [862, 34, 862, 998]
    for bad in (1000, -1, None):
        with pytest.raises(Exception, match="unknown chunk"):
            P.take_by_id(spark, path, spark.createDataFrame([(5, 0), (bad, 1)], wanted.schema), span=100).collect()


def test_sources_of_many_bytes_are_live_unread(spark):
    rows = [(s, i, 0.0 if s != "live" or i < 7 else 1.0) for s in ("zeros", "live", "big") for i in range(9)]
    samples = spark.createDataFrame(rows, "source string, sample_ix long, value double")
    sizes = spark.createDataFrame([("zeros", 10), ("live", 20), ("big", 1 << 30), ("none", 5), ("unknown", None)], "source string, size_bytes long")
    got = {r["source"]: (r["looks_dead"], r["is_dead"]) for r in B.dead_by_size(samples, sizes, ["source"], 3).collect()}
    assert got == {"zeros": (True, True), "live": (True, False), "big": (False, False), "none": (True, True), "unknown": (True, True)}
