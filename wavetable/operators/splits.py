"""Leak-proof splits, folds and samples. Splits live at group grain: rows (scheme, fold, part, grp), joined to chunks.

All randomness is the order of md5(seed:key), so that a split is the same on every partitioning and in every engine.
Windows without a key are used at group grain only; chunk-grain ranks use ranges (operators.ranks).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wavetable.functions.hashing import dealt_place, order_key, shuffle_start
from wavetable.operators.ranks import LOT_BITS, placed, ranked, spans

VAL, TEST = 0.30, 0.15
FOLD_VAL = 0.25


def share(n: Column, fraction: float) -> Column:
    """fraction of n, rounded half to even, 1 at least."""
    return F.greatest(F.lit(1), F.bround(n * F.lit(fraction)).cast("int"))


def _groups(index: DataFrame, grp: str = "grp", *keep: str) -> DataFrame:
    return index.select(F.col(grp).alias("grp"), *keep).distinct()


def _need(df: DataFrame, least: int, what: str, *keys: str) -> DataFrame:
    """df with n, the rows of its key; fewer than least raise."""
    n = F.count("*").over(W.partitionBy(*keys))
    return df.withColumn("n", F.when(n >= least, n).otherwise(F.raise_error(F.lit(f"need at least {least} {what}")).cast("long")))


def in_session(index: DataFrame, key: str = "chunk_id", seed: int = 0, val: float = VAL, test: float = TEST) -> DataFrame:
    """(key, part): a shuffle of chunks; leaky on purpose, an upper bound."""
    rows = ranked(index.select(key).withColumn("_o", order_key(seed, F.col(key))), ["_o", key])
    total = index.agg(F.count("*").alias("n"))
    cut = F.when(F.col("rank") <= share(F.col("n"), test), "test").when(F.col("rank") <= share(F.col("n"), test) + share(F.col("n"), val), "val").otherwise("train")
    return rows.crossJoin(F.broadcast(total)).select(key, cut.alias("part"))  # one row


def in_session_by_hash(index: DataFrame, key: str = "chunk_id", seed: int = 0, val: float = VAL, test: float = TEST) -> DataFrame:
    """The same without any rank: parts by thresholds of the hash, so that sizes are right on average."""
    from wavetable.functions.hashing import uniform

    u = uniform(seed, F.col(key))
    return index.select(key, F.when(u < test, "test").when(u < test + val, "val").otherwise("train").alias("part"))


def cross_session(index: DataFrame, seed: int = 0, val: float = VAL, test: float = TEST) -> DataFrame:
    """(part, grp): whole groups in each part."""
    g = _need(_groups(index), 3, "groups").withColumn("rank", F.row_number().over(W.orderBy(order_key(seed, F.col("grp")))))
    small = share(F.col("n"), test) + share(F.col("n"), val) >= F.col("n")
    n_test, n_val = F.when(small, 1).otherwise(share(F.col("n"), test)), F.when(small, 1).otherwise(share(F.col("n"), val))
    return g.select(F.when(F.col("rank") <= n_test, "test").when(F.col("rank") <= n_test + n_val, "val").otherwise("train").alias("part"), "grp")


def cross_lab(index: DataFrame, train: list[str], test: list[str], seed: int = 0, val: float = VAL) -> DataFrame:
    """(part, grp): validation groups come out of the source datasets, test is all of the target."""
    if both := sorted(set(train) & set(test)):
        raise ValueError(f"datasets in both parts: {both}")
    source = _need(_groups(index.filter(F.col("dataset").isin(train))), 2, "source groups").withColumn("rank", F.row_number().over(W.orderBy(order_key(seed, F.col("grp")))))
    out = source.select(F.when(F.col("rank") <= share(F.col("n"), val), "val").otherwise("train").alias("part"), "grp")
    return out.unionByName(_groups(index.filter(F.col("dataset").isin(test))).select(F.lit("test").alias("part"), "grp"))


def leakage(split: DataFrame, index: DataFrame, kind: str = "cross_session") -> DataFrame:
    """(violation, n): empty parts, groups in several parts, and for cross_lab datasets in both train and test; n is 0 where all is well."""
    parts = split.groupBy("grp").agg(F.collect_set("part").alias("parts"))
    shared = parts.agg(F.count_if(F.size("parts") > 1).alias("n")).select(F.lit("shared_groups").alias("violation"), "n")
    empty = split.agg((3 - F.count_distinct("part")).alias("n")).select(F.lit("empty_parts").alias("violation"), "n")
    out = empty if kind == "in_session" else shared.unionByName(empty)
    if kind == "cross_lab":
        sets = split.join(_groups(index, "grp", "dataset"), "grp").filter("part in ('train', 'test')").groupBy("dataset").agg(F.count_distinct("part").alias("k"))
        out = out.unionByName(sets.agg(F.count_if(F.col("k") > 1).alias("n")).select(F.lit("shared_datasets").alias("violation"), "n"))
    return out


def verify(split: DataFrame, index: DataFrame, kind: str = "cross_session") -> DataFrame:
    """(part, n) chunks of each part; a violation raises."""
    wrong = leakage(split, index, kind).filter("n > 0").collect()  # three rows at most
    if wrong:
        raise ValueError("; ".join(f"{x['violation']}: {x['n']}" for x in wrong))
    return sizes(split, index)


def sizes(split: DataFrame, index: DataFrame) -> DataFrame:
    return index.select("grp").join(split, "grp").groupBy("part").agg(F.count("*").alias("n"), F.count_distinct("grp").alias("n_groups"))


def leave_one_out(index: DataFrame, dataset: str | None = None, val: float = FOLD_VAL, seed: int = 0) -> DataFrame:
    """(scheme, fold, part, grp): each group is the test of one fold; validation groups are drawn from the others."""
    frame = index if dataset is None else index.filter(F.col("dataset") == dataset)
    g = _need(_groups(frame), 3, "groups")
    folds = g.select(F.col("grp").alias("fold"), (F.col("n") - 1).alias("rest")).crossJoin(g.select("grp"))  # groups by groups
    rank = F.row_number().over(W.partitionBy("fold").orderBy(F.col("fold") == F.col("grp"), order_key(seed, F.col("fold"), F.col("grp"))))
    part = F.when(F.col("fold") == F.col("grp"), "test").when(rank <= share(F.col("rest"), val), "val").otherwise("train")
    return folds.select(F.lit(f"loso_{dataset}" if dataset else "loso").alias("scheme"), "fold", part.alias("part"), "grp")


def cross_lab_folds(index: DataFrame, source: str, target: str, val: float = FOLD_VAL, seed: int = 0) -> DataFrame:
    """(scheme, fold, part, grp): one training set, and each group of the target as the test of a fold."""
    if source == target:
        raise ValueError("source and target are the same dataset")
    split = cross_lab(index, [source], [target], seed, val)
    tests = split.filter("part = 'test'").select(F.col("grp").alias("fold"))
    fixed = split.filter("part <> 'test'").crossJoin(tests)  # groups by groups
    out = fixed.select("fold", "part", "grp").unionByName(tests.select("fold", F.lit("test").alias("part"), F.col("fold").alias("grp")))
    return out.select(F.lit(f"cross_lab_{source}_to_{target}").alias("scheme"), "fold", "part", "grp")


def schemes(index: DataFrame, seed: int = 0) -> DataFrame:
    """leave_one_out for every dataset, and cross_lab_folds both ways if there are just two."""
    names = sorted(x["dataset"] for x in index.select("dataset").distinct().collect())  # a row for each dataset
    out = None
    for part in [leave_one_out(index, d, seed=seed) for d in names] + ([cross_lab_folds(index, a, b, seed=seed) for a, b in (names, names[::-1])] if len(names) == 2 else []):
        out = part if out is None else out.unionByName(part)
    return out


def pooled(folds: DataFrame) -> DataFrame:
    """Sibling cross-lab folds as one fold whose test is all target groups: train once, score by group."""
    return folds.filter(F.col("scheme").startswith("cross_lab")).select("scheme", F.lit("all_target_groups").alias("fold"), "part", "grp").distinct()


def _numbered(index: DataFrame) -> DataFrame:
    """dataset, grp, i (place of the group in its dataset), n (groups of the dataset)."""
    g = _groups(index, "grp", "dataset")
    return g.select("dataset", "grp", (F.row_number().over(W.partitionBy("dataset").orderBy("grp")) - 1).alias("i"), F.count("*").over(W.partitionBy("dataset")).alias("n"))


def _rotated(index: DataFrame, offsets: dict[str, int]) -> DataFrame:
    """(fold, part, grp): fold f takes from every dataset its group f + offset, round and round."""
    g = _numbered(index)
    folds = g.agg(F.max("n").alias("m")).select(F.explode(F.sequence(F.lit(0), F.col("m").cast("int") - 1)).alias("fold"))
    out = None
    for part, offset in offsets.items():
        held = folds.crossJoin(g).filter((F.col("fold") + offset) % F.col("n") == F.col("i")).select("fold", F.lit(part).alias("part"), "grp")  # folds by groups
        out = held if out is None else out.unionByName(held)
    rest = folds.crossJoin(g.select("grp")).join(out.select("fold", "grp"), ["fold", "grp"], "left_anti").select("fold", F.lit("train").alias("part"), "grp")
    return out.unionByName(rest)


def paired_holdout(index: DataFrame) -> DataFrame:
    """Fold i tests the i-th group of each of two datasets; the shorter list goes round."""
    return _rotated(index, {"test": 0})


def rotated(index: DataFrame) -> DataFrame:
    """Fold i tests group i of each dataset, validates on the next one and trains on the rest."""
    return _rotated(index, {"test": 0, "val": 1})


def balanced_sample(df: DataFrame, cap: int, key: list[str], label: str = "label", seed: int = 0) -> DataFrame:
    """cap rows of each class at most, in the order of the hash."""
    return keyed_sample(df, cap, [label], key, seed)


def keyed_sample(df: DataFrame, cap: int, by: list[str], key: list[str], seed: int = 0) -> DataFrame:
    """cap rows at most for each value of by. The window keeps only the first rows of a key in each task before the shuffle."""
    rank = F.row_number().over(W.partitionBy(*by).orderBy("_o", *key))
    return df.withColumn("_o", order_key(seed, *[F.col(k) for k in key])).withColumn("_r", rank).filter(F.col("_r") <= cap).drop("_o", "_r")


def capped_sample(df: DataFrame, n: int, key: list[str], seed: int = 0) -> DataFrame:
    """n rows of all, in the order of the hash."""
    return df.withColumn("_o", order_key(seed, *[F.col(k) for k in key])).orderBy("_o", *key).limit(n).drop("_o")


def permuted_labels(df: DataFrame, keys: list[str], key: str, label: str = "label", seed: int = 0) -> DataFrame:
    """df with its labels dealt anew inside each value of keys; rows with a null among keys are left out.

    In the order of (keys, key) and in that of (keys, hash) a value of keys has the same places, so that rows meet their labels by place alone.
    """
    known = df.dropna(subset=keys) if keys else df
    rows = placed(known, [*keys, key], "_place")
    hashed = rows.select(*keys, key, label).withColumn("_o", F.unhex(order_key(seed, F.col(key))))
    return rows.drop(label).join(placed(hashed, [*keys, "_o", key], "_place", keep=[label]), "_place").drop("_place")


def permuted_draws(df: DataFrame, keys: list[str], key: str, draws: list[int], label: str = "label", seed: int = 0) -> DataFrame:
    """(keys, draw, key, label): for each draw the labels dealt anew inside each value of keys, with one ranking for all draws.

    Row number r of n takes the label of row number pi(r), where pi is a bijection of the numbers for each (keys, draw):
    each label goes to the place that pi takes to its own, so that the rows themselves are sorted once and joined once, for
    all draws. key is unique within keys; keys without rows give none; null is a key.
    """
    rows = placed(df.select(*keys, key, label), [*keys, key], "_place")
    names = F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in keys]).cast("array<string>")
    sizes = spans(rows, keys, "_place", F.first(names).alias("_names"))
    starts = [shuffle_start(seed, *[F.get("_names", F.lit(i)) for i in range(len(keys))], F.lit(int(d))) for d in draws]
    sizes = sizes.select(*[F.col(c).alias(f"_key{i}") for i, c in enumerate(keys)], F.col("_lot").alias("_of"), "_start", "_n", F.array(*starts).alias("_starts"))
    same = [F.col(c).eqNullSafe(F.col(f"_key{i}")) for i, c in enumerate(keys)]
    sent = rows.withColumn("_lot", F.shiftright("_place", LOT_BITS)).join(sizes, [F.col("_lot") == F.col("_of"), *same])
    to = lambda i: F.col("_start") + dealt_place(F.col("_place") - F.col("_start"), F.col("_n"), F.get("_starts", F.lit(i)))
    sent = sent.select(label, F.explode(F.array(*[F.struct(F.lit(int(d)).alias("draw"), to(i).alias("_place")) for i, d in enumerate(draws)])).alias("_to"))
    return rows.select(*keys, key, "_place").join(sent.select("_to.*", label), "_place").select(*keys, "draw", key, label)


def class_counts(df: DataFrame, label: str = "label", classes: int = 5) -> DataFrame:
    """Every class with its rows, 0 included."""
    all_ = df.sparkSession.range(classes).select(F.col("id").cast("int").alias(label))
    return all_.join(df.groupBy(label).agg(F.count("*").alias("n")), label, "left").select(label, F.coalesce("n", F.lit(0)).alias("n"))
