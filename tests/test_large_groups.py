"""Queries on groups larger than those of the given tables."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from tests.test_queries import rows
from wavetable.functions.hashing import swap_or_not
from wavetable.operators import metrics as M
from wavetable.operators import splits as C
from wavetable.operators.ranks import placed
from wavetable.plans.queries import ORACLE_SQL, QUERIES


def test_whiten_takes_every_chunk_of_a_group_for_its_reference(spark, tmp_path):
    n = 12 * 420
    waves = np.random.default_rng(0).normal(size=(n, 64)).astype(np.float32)
    pq.write_table(pa.table({"vec_id": pa.array(range(n), pa.int64()), "embedding": pa.array(list(waves), pa.list_(pa.float32())), "label": pa.array([i % 10 for i in range(n)], pa.int32())}), tmp_path / "embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet'")
    got = QUERIES["whiten"](spark, str(tmp_path)).filter("chunk_id < 12").toArrow()
    want = con.execute(f"select * from ({ORACLE_SQL['whiten']}) where chunk_id < 12").to_arrow_table()
    assert got.num_rows == 12 * 64
    assert rows(got) == rows(want)


def test_labels_are_dealt_with_one_shuffle_of_rows_and_one_of_labels(spark):
    df = spark.range(500).selectExpr("cast(id as string) id", "id % 3 grp", "cast(id % 5 as int) label")
    for dealt in (C.permuted_labels(df, ["grp"], "id"), C.permuted_draws(df, ["grp"], "id", [1, 2])):
        plan = dealt._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") <= 2 and "Window" not in plan
        assert dealt.count() in (500, 1000)


def test_places_go_on_from_range_to_range(spark):
    df = spark.range(5000).selectExpr("id % 7 k", "cast(id * 37 % 5000 as string) name")
    got = [tuple(x) for x in placed(df, ["k", "name"], "place").orderBy("place").collect()]
    assert [x[2] for x in got] == list(range(5000)) and [x[:2] for x in got] == sorted(x[:2] for x in got)


def test_shuffles_go_back(spark):
    rng = np.random.default_rng(0)
    for high in (3, 10**6, 2**31, 2**45, 2**62):
        for n in (rng.integers(1, high, 3000), np.full(9000, high)):
            x, s = (rng.random(len(n)) * n).astype(np.int64) % n, np.full(len(n), 77)
            assert (swap_or_not(swap_or_not(x, n, s), n, s, back=True) == x).all()


def test_a_report_reads_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.range(300).selectExpr("id % 3 fold", "cast(id % 2 as int) label", "array(0.3D, 0.7D) p", "0.7D conf", "1 pred", "cast(id % 2 as double) hit", "id <> 5 converged")
    got = M.full_report(rows.mapInArrow(counted, rows.schema), ["fold"], 2, ("converged",)).orderBy("fold").collect()
    assert seen.value == 300
    for x in got:
        assert x["n"] == 100 and x["converged"] == (x["fold"] != 2)
        assert abs(x["accuracy"] - 0.5) < 1e-12 and abs(x["ece"] - 0.2) < 1e-12 and abs(x["brier"] - (2 * 0.3**2 + 2 * 0.7**2) / 2) < 1e-12
        assert abs(x["nll"] + (np.log(0.3) + np.log(0.7)) / 2) < 1e-12 and abs(x["mean_conf"] - 0.7) < 1e-12
