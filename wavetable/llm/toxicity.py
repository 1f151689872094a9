"""Toxicity by a classifier chain.

The categories are predicted one after another. Each has a linear model (logistic regression over hashed features of
the distinct words of a text) that also gets the log-odds of all earlier categories; in training those come from
models that have not seen the row (out of fold), so that a later model learns from what it will meet when it is used.
The features of a word are the word and its beginnings of PREFIXES letters. Features are made, folds are fitted and
rows are scored in Spark tasks; only the weights, whose size is fixed, pass through the driver.

The models are fitted on SAMPLE labelled rows at most, taken in the order of a hash of their id. All rows are scored.

Defined cases: a null or empty text has no words and gets the probability of a text without features; very long texts
are read whole; without labelled rows every probability is 0; labels of ids without a row, and labels that lack a category,
are not used; of repeated labels that clash 1 counts, and of rows that share an id the smallest text is fitted on; words are counted once, so that ties of counts do not matter; repeated rows get the same
result; columns in keep are carried whatever their names, and the prefix keeps the results apart from them; an empty
table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavetable.llm.decontam import words_of
from wavetable.llm.util import fresh, materialize, small_batches, text_bytes

#: Labelled rows that models are fitted on, at most.
SAMPLE = 12_000
FOLDS = 5
BUCKETS = 1 << 18
PREFIXES = (5, 7)
#: Training rows that a feature must occur in, and standard errors between its rows' rate of the category and the rate of all.
LEAST_ROWS, LEAST_ERRORS = 6, 5.0
#: Strength of the penalty; steps of the optimiser.
PENALTY, STEPS = 0.1, 40
#: Words that one Python worker remembers.
REMEMBERED = 300_000


def word_features(word: bytes) -> list[int]:
    found = [zlib.crc32(word) % BUCKETS]
    text = word.decode("utf-8", "replace")
    return found + [zlib.crc32(f"{n}{text[:n]}".encode()) % BUCKETS for n in PREFIXES if len(text) > n]


def flat(features: list[np.ndarray], times: list[np.ndarray], place: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, times) of all entries; with place, of those features that have a place, by it. Rows are taken by the hundred."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0))]
    for a in range(0, len(features), 256):
        own = features[a : a + 256]
        row = np.repeat(np.arange(a, a + len(own), dtype=np.int32), [len(f) for f in own])
        col, n = np.concatenate(own).astype(np.int32), np.concatenate(times[a : a + 256]).astype(float)
        if place is not None:
            col = place[col]
            row, n, col = row[col >= 0], n[col >= 0], col[col >= 0]
        out.append((row, col, n))
    return tuple(np.concatenate(x) for x in zip(*out))


def fit_logistic(features: list[np.ndarray], times: list[np.ndarray], extra: np.ndarray, y: np.ndarray, n_features: int) -> np.ndarray:
    """Weights of the features, then of the columns of extra, then the intercept. features, times: for each row its features and how many words have each."""
    n, k, rate = len(y), extra.shape[1], y.mean()
    rows_with, hits = np.zeros(n_features), np.zeros(n_features)
    for own, is_one in zip(features, y > 0.5):
        rows_with[own] += 1
        if is_one:
            hits[own] += 1
    error = np.sqrt(np.maximum(rows_with * rate * (1 - rate) * (1 - rows_with / n), 1e-9))
    live = np.flatnonzero((rows_with >= LEAST_ROWS) & (np.abs(hits - rows_with * rate) / error >= LEAST_ERRORS))
    place = np.full(n_features, -1, np.int32)
    place[live] = np.arange(len(live))
    owner, col, number = flat(features, times, place)
    d = len(live)
    rate = np.clip(rate, 1e-6, 1 - 1e-6)
    w = np.zeros(d + k + 1)
    w[-1] = np.log(rate / (1 - rate))

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.bincount(owner, w[col] * number, n) + extra @ w[d : d + k] + w[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        r = p - y
        g = np.concatenate([np.bincount(col, r[owner] * number, d), extra.T @ r, [r.sum()]])
        g[:-1] += PENALTY * w[:-1]
        return float(np.logaddexp(0, z).sum() - y @ z + PENALTY / 2 * w[:-1] @ w[:-1]), g

    # limited-memory BFGS with halving line search
    f, g = loss(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(STEPS):
        q, alphas = g.copy(), []
        for s, t in reversed(past):
            alphas.append(a := s @ q / (s @ t))
            q -= a * t
        q *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, np.linalg.norm(g))
        for (s, t), a in zip(past, reversed(alphas)):
            q += (a - t @ q / (s @ t)) * s
        step, slope = 1.0, g @ q
        while step > 1e-6:
            f2, g2 = loss(w - step * q)
            if f2 <= f - 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, t = -step * q, g2 - g
        w, done = w + s, f - f2 < 1e-6 * max(1.0, abs(f))
        f, g = f2, g2
        if s @ t > 1e-12:
            past = [*past[-9:], (s, t)]
        if done:
            break
    full = np.zeros(n_features + k + 1)
    full[live], full[n_features:] = w[:d], w[d:]
    return full


class Weigher:
    """Sums of the weights of a text's words, for each model; words are remembered."""

    def __init__(self, weights: list[np.ndarray]) -> None:
        self.live = [{int(i): float(w[i]) for i in np.flatnonzero(w[:BUCKETS])} for w in weights]
        self.known: list[dict[bytes, float]] = [{} for _ in weights]

    def sums(self, words: set[bytes]) -> list[float]:
        first = self.known[0]
        new = [w for w in words if w not in first]
        if len(first) + len(new) > REMEMBERED:
            for known in self.known:
                known.clear()
            new = list(words)
        for w in new:
            features = word_features(w)
            for live, known in zip(self.live, self.known):
                known[w] = sum([live[f] for f in features if f in live])
        return [sum(map(known.__getitem__, words)) for known in self.known]


def _features(rows: DataFrame, keep: list[str]) -> DataFrame:
    """The columns keep, features (those of a row's distinct words) and times (the words that have each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique([f for w in set(words_of(t)) for f in word_features(w)], return_counts=True) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array([x[i].astype(np.int32) for x in found], pa.list_(pa.int32())) for i in (0, 1)]], [*keep, "features", "times"])

    schema = rows.select(*keep).schema
    rows = rows.select(*keep, text_bytes().alias(fresh("text", keep)))
    for name in ("features", "times"):
        schema = schema.add(name, T.ArrayType(T.IntegerType()))
    return rows.mapInArrow(run, schema)


def _fit_folds(rows: DataFrame, category: str, earlier: list[str]) -> dict[int, np.ndarray]:
    """Weights by model: model k has not seen fold k; model FOLDS has seen all. rows: fold, category, earlier log-odds, features."""
    models = F.filter(F.sequence(F.lit(0), F.lit(FOLDS)), lambda m: m != F.col("fold"))

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id")
        w = fit_logistic(list(frame["features"]), list(frame["times"]), frame[earlier].to_numpy(float).reshape(len(frame), len(earlier)), frame[category].to_numpy(float), BUCKETS)
        return pd.DataFrame({"model": [int(frame["model"].iloc[0])], "weights": [w.tobytes()]})

    got = rows.withColumn("model", F.explode(models)).groupBy("model").applyInPandas(fit, "model int, weights binary").collect()  # FOLDS + 1 rows of fixed size
    return {x["model"]: np.frombuffer(x["weights"]) for x in got}


def _log_odds(rows: DataFrame, category: str, earlier: list[str], models: dict[int, np.ndarray]) -> DataFrame:
    """rows with the out-of-fold log-odds of category as column z_<category>."""
    sent = rows.sparkSession.sparkContext.broadcast(models)
    schema = T.StructType([*rows.schema.fields, T.StructField(f"z_{category}", T.DoubleType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            z = np.zeros(len(frame))
            for fold, w in sent.value.items():
                at = np.flatnonzero(frame["fold"].to_numpy() == fold)
                if len(at):
                    part = frame.iloc[at]
                    owner, col, number = flat(list(part["features"]), list(part["times"]))
                    z[at] = np.bincount(owner, w[col] * number, len(at)) + part[earlier].to_numpy(float).reshape(len(at), len(earlier)) @ w[BUCKETS:-1] + w[-1]
            yield frame.assign(**{f"z_{category}": np.clip(z, -30, 30)})

    return rows.mapInPandas(run, schema)


def train_chain(docs: DataFrame, labels: DataFrame, categories: list[str], key: str = "doc_id", sample: int = SAMPLE) -> list[np.ndarray]:
    """One weight vector for each category. labels: key and a 0/1 column for each category."""
    small_batches(docs.sparkSession)
    chosen = labels.filter(" and ".join(f"{c} is not null" for c in [key, *categories])).select(F.col(key).cast("bigint").alias("id"), *[F.col(c).cast("double").alias(f"y_{c}") for c in categories])
    marks = [f"y_{c}" for c in categories]
    chosen = chosen.groupBy("id").agg(*[F.max(y).alias(y) for y in marks]).orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select(F.col(key).cast("bigint").alias("id"), "text").join(F.broadcast(chosen), "id")  # sample bounds it
    rows = rows.groupBy("id", *marks).agg(F.min("text").alias("text"))  # and these, however many rows share an id
    rows = rows.withColumn("fold", F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(FOLDS)).cast("int"))
    rows = materialize(_features(rows, ["id", "fold", *[f"y_{c}" for c in categories]]), "labelled")
    chain, earlier = [], []
    for i, c in enumerate(categories):
        models = _fit_folds(rows, f"y_{c}", earlier)
        chain.append(models.get(FOLDS, np.append(np.zeros(BUCKETS + len(earlier)), -30.0)))
        if i + 1 < len(categories):
            rows = materialize(_log_odds(rows, c, earlier, models), "chained")
            earlier = [*earlier, f"z_{c}"]
    return chain


def score_chain(docs: DataFrame, chain: list[np.ndarray], categories: list[str], keep: list[str], prefix: str = "") -> DataFrame:
    """The columns keep and p_<category> for each category; prefix goes before those names."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigher = Weigher(sent.value)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            sums = np.array([weigher.sums(set(words_of(t))) for t in texts], float).reshape(len(texts), len(sent.value))
            z: list[np.ndarray] = []
            for own, w in zip(sums.T, sent.value):
                own = own + w[-1]
                for v, before in zip(w[BUCKETS:-1], z):
                    own = own + v * before
                z.append(np.clip(own, -30, 30))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(1 / (1 + np.exp(-x))) for x in z]], [*keep, *[f"{prefix}p_{c}" for c in categories]])

    schema = docs.select(*keep).schema
    rows = docs.select(*keep, text_bytes().alias(fresh("text", keep)))
    for c in categories:
        schema = schema.add(f"{prefix}p_{c}", "double")
    return rows.mapInArrow(run, schema)


#: Of the labels table: the chain goes from poor quality to toxicity.
CATEGORIES = ["poor", "toxic"]


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """keep (default: the key), p_poor, p_toxic and toxic (p_toxic of a half or more); prefix goes before these names."""
    own = labels.select(key, (1 - F.col("quality")).alias("poor"), "toxic")
    chain = train_chain(docs, own, CATEGORIES, key)
    return score_chain(docs, chain, CATEGORIES, keep or [key], prefix).withColumn(f"{prefix}toxic", F.col(f"{prefix}p_toxic") >= 0.5)
