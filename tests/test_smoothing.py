import pytest

from wavetable.operators import smoothing as P


def channels(spark, labels, group="a"):
    return spark.createDataFrame([(group, i, 20.0 * i, x) for i, x in enumerate(labels)], "grp string, channel int, depth_um double, temporal int")


def voted(df):
    return [r["spatial"] for r in P.spatial_vote(df, "temporal").orderBy("grp", "channel").collect()]


def test_isolated_error_goes(spark):
    assert voted(channels(spark, [1, 1, 1, 1, 3, 1, 1, 1, 1, 1])) == [1] * 10


def test_boundary_stays(spark):
    assert voted(channels(spark, [0] * 5 + [3] * 5)) == [0] * 5 + [3] * 5


def test_ends_see_fewer_neighbours(spark):
    got = voted(channels(spark, [2, 2, 0, 0, 0]))
    assert got[0] == 2 and got[2] == 0


def test_groups_do_not_mix(spark):
    assert voted(channels(spark, [0, 0], "A").unionByName(channels(spark, [3, 3], "B"))) == [0, 0, 3, 3]


def test_mean_of_logits_not_of_probabilities(spark):
    df = spark.createDataFrame([("a", 0, x) for x in ([10.0, 0.0], [0.0, 1.0], [0.0, 1.0])], "grp string, channel int, logits array<double>")
    assert P.temporal_labels(df, 2, ["grp", "channel"]).first()["temporal"] == 0


def test_prior(spark):
    df = spark.createDataFrame([("a", 0, [1.0, 0.9])] * 2, "grp string, channel int, logits array<double>")
    assert P.temporal_labels(df, 2, ["grp", "channel"]).first()["temporal"] == 0
    assert P.temporal_labels(df, 2, ["grp", "channel"], [1, 2]).first()["temporal"] == 1
    with pytest.raises(ValueError, match="prior"):
        P.temporal_labels(df, 2, ["grp", "channel"], [1])


def test_noisy_session_is_rescued(spark):
    import random

    rng = random.Random(0)
    rows = []
    for g in range(2):
        for c in range(32):
            truth = c // 8
            for k in range(30):
                said = truth if rng.random() > 0.4 else rng.randrange(4)
                rows.append((len(rows), f"g{g}", c, 20.0 * c, truth, [3.0 if i == said else 0.0 for i in range(4)]))
    df = spark.createDataFrame(rows, "chunk_id long, grp string, channel int, depth_um double, label int, logits array<double>")
    got = {(r["stage"], r["level"]): r["accuracy"] for r in P.stage_scores(*P.smooth(df, 4), []).collect()}
    assert got["temporal", "chunk"] > got["raw", "chunk"] + 0.2 and got["spatial", "chunk"] >= got["temporal", "chunk"] and len(got) == 5


def test_missing_columns_raise(spark):
    with pytest.raises(ValueError, match="missing columns"):
        P.smooth(spark.createDataFrame([(1,)], "chunk_id long"), 2)
