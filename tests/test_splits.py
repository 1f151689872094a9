import pytest
from pyspark.sql import functions as F

from wavetable.operators import splits as C


@pytest.fixture(scope="module")
def index(spark):
    return spark.createDataFrame([(i, f"g{i % 9}", "A" if i % 9 < 5 else "B", i % 4) for i in range(900)], "chunk_id long, grp string, dataset string, label int").persist()


def parts(split):
    out = {}
    for r in split.collect():
        out.setdefault(r["part"], set()).add(r["grp"])
    return out


def test_cross_session_parts_are_disjoint(index):
    got = parts(C.cross_session(index))
    assert len(got["test"]) == 1 and len(got["val"]) == 3 and len(got["train"]) == 5
    assert not got["test"] & got["train"] and sum(map(len, got.values())) == 9
    assert {r["part"] for r in C.verify(C.cross_session(index), index).collect()} == {"train", "val", "test"}


def test_same_seed_same_split(index):
    assert parts(C.cross_session(index, 3)) == parts(C.cross_session(index.repartition(7), 3))
    assert any(parts(C.cross_session(index, s)) != parts(C.cross_session(index, 3)) for s in range(5))


def test_cross_lab_keeps_the_target_out(index):
    got = parts(C.cross_lab(index, ["A"], ["B"]))
    assert got["test"] == {"g5", "g6", "g7", "g8"} and not (got["train"] | got["val"]) & got["test"]
    with pytest.raises(ValueError, match="both"):
        C.cross_lab(index, ["A"], ["A"])


def test_leak_is_found(index):
    leaky = C.cross_session(index).unionByName(C.cross_session(index).filter("part = 'test'").withColumn("part", F.lit("train")))
    with pytest.raises(ValueError, match="shared_groups: 1"):
        C.verify(leaky, index)


def test_too_few_groups(index):
    with pytest.raises(Exception, match="at least 3"):
        C.cross_session(index.filter("grp in ('g0', 'g1')")).collect()


def test_leave_one_out(index):
    got = C.leave_one_out(index, "A").collect()
    assert len({r["fold"] for r in got}) == 5 and all((r["part"] == "test") == (r["fold"] == r["grp"]) for r in got)
    assert all(sum(x["part"] == "val" for x in got if x["fold"] == f) == 1 for f in {r["fold"] for r in got})


def test_schemes_and_pooled(index):
    got = {r["scheme"] for r in C.schemes(index).collect()}
    assert got == {"loso_A", "loso_B", "cross_lab_A_to_B", "cross_lab_B_to_A"}
    pooled = parts(C.pooled(C.cross_lab_folds(index, "A", "B")))
    assert pooled["test"] == {"g5", "g6", "g7", "g8"}


def test_paired_folds_go_round(index):
    got = C.paired_holdout(index).filter("part = 'test'").collect()
    assert len({r["fold"] for r in got}) == 5 and {r["grp"] for r in got if r["fold"] == 4} == {"g4", "g5"}
    rot = C.rotated(index)
    assert rot.filter("part = 'val' and fold = 0").count() == 2 and rot.filter("part = 'train' and fold = 0").count() == 5


def test_in_session_sizes(index):
    got = {r["part"]: r["count"] for r in C.in_session(index).groupBy("part").count().collect()}
    assert got == {"test": 135, "val": 270, "train": 495}


def test_samples(index):
    got = C.balanced_sample(index, 50, ["chunk_id"]).groupBy("label").count().collect()
    assert len(got) == 4 and all(r["count"] == 50 for r in got)
    assert C.balanced_sample(index, 10_000, ["chunk_id"]).count() == 900
    assert C.capped_sample(index, 10, ["chunk_id"]).count() == 10


def test_permutation_keeps_the_counts(index):
    got = C.permuted_labels(index, ["grp"], "chunk_id")
    assert got.count() == 900
    same = got.join(index.withColumnRenamed("label", "was"), "chunk_id").filter("label = was").count()
    assert same < 400
    a = {(r["grp"], r["label"]): r["count"] for r in got.groupBy("grp", "label").count().collect()}
    assert a == {(r["grp"], r["label"]): r["count"] for r in index.groupBy("grp", "label").count().collect()}


def test_class_counts_has_absent_classes(index):
    assert {r["label"]: r["n"] for r in C.class_counts(index).collect()}[4] == 0


def test_shuffles_are_bijections_and_even():
    import numpy as np

    from wavetable.functions.hashing import swap_or_not

    for n in (1, 2, 3, 7, 64, 1000):
        for s in (1, 2, 77, 2**28):
            x = np.arange(n)
            assert sorted(swap_or_not(x, np.full(n, n), np.full(n, s)).tolist()) == x.tolist()
    n, draws = 7, 20_000
    starts = np.random.default_rng(0).integers(1, 2**28, draws)
    to = np.stack([swap_or_not(np.full(draws, i), np.full(draws, n), starts) for i in range(n)])
    single = np.stack([np.bincount(to[i], minlength=n) for i in range(n)])
    assert ((single - draws / n) ** 2 / (draws / n)).sum() < 36 + 5 * np.sqrt(2 * 36)  # chi-square of 36 degrees
    pairs = np.bincount(to[0] * n + to[1], minlength=n * n)[[i * n + j for i in range(n) for j in range(n) if i != j]]
    expected = draws / len(pairs)
    assert ((pairs - expected) ** 2 / expected).sum() < 41 + 5 * np.sqrt(2 * 41)
    big = 2**40
    far = swap_or_not(np.arange(4096) * 2**20, np.full(4096, big), np.full(4096, 5))
    assert len(set(far.tolist())) == 4096 and 0 <= far.min() and far.max() < big and abs(far.mean() / big - 0.5) < 0.04


def test_draws_deal_the_labels_of_each_key(spark):
    from collections import Counter

    rows = [(g, i, (i * i + len(g or "")) % 3) for g in ("a", "bb", None) for i in range(60 if g == "a" else 5)]
    df = spark.createDataFrame(rows, "grp string, chunk_id long, label int")
    got = C.permuted_draws(df, ["grp"], "chunk_id", [1, 2, 3]).collect()
    assert len(got) == 3 * len(rows) and len({(r["grp"], r["draw"], r["chunk_id"]) for r in got}) == len(got)
    for g in ("a", "bb", None):
        own = Counter(x[2] for x in rows if x[0] == g)
        assert all(Counter(r["label"] for r in got if r["grp"] == g and r["draw"] == d) == own for d in (1, 2, 3))
    dealt = {d: [r["label"] for r in sorted((r for r in got if r["grp"] == "a" and r["draw"] == d), key=lambda r: r["chunk_id"])] for d in (1, 2, 3)}
    assert dealt[1] != dealt[2] != dealt[3] and dealt[1] != [x[2] for x in rows if x[0] == "a"]
    again = C.permuted_draws(df.repartition(5), ["grp"], "chunk_id", [2]).collect()
    assert {tuple(r) for r in again} == {tuple(r) for r in got if r["draw"] == 2}
    whole = df.filter("grp = 'a'").drop("grp")
    assert Counter(r["label"] for r in C.permuted_draws(whole, [], "chunk_id", [1]).collect()) == Counter(x[2] for x in rows if x[0] == "a")
    assert C.permuted_draws(df.limit(0), ["grp"], "chunk_id", [1]).count() == 0
