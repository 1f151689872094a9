"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased; runs of characters that are no letters become one space; n-grams of one to three characters
are hashed into BUCKETS counters for each language. Training counts all texts of all rows that may be learned from,
in one pass with partial sums in each task; the logarithms of the smoothed shares form a matrix of languages times
BUCKETS, whose size does not depend on the rows and is checked before it is broadcast. Rows are scored in batches.

A text's score is the posterior of its language among the learned ones, so it says nothing of texts in none of them.
That is what fit is for: the mean log share of the text's n-grams, less the mean that the language's own n-grams have,
plus DEVIATIONS standard errors of such a mean; below LEAST_FIT no learned language fits.

Defined cases: a text that is null or has no letter is `und` with score 0, and so is every text if nothing can be
learned (an empty table, or no text with a language); its fit is null; ties go to the language first in alphabetical
order; very long texts are hashed in steps, whole; repeated rows give repeated rows; columns that are not named in keep
are not looked at, and predict names its own so that they clash with none of those; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavetable.llm.util import fresh, small_batches

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: Languages that a model may have; more raise an error, as the matrix is broadcast.
MOST_LANGUAGES = 512
#: Characters that are hashed at once.
STEP = 1 << 20
UNKNOWN = "und"
#: Standard errors that a text's mean log share is raised by before it is judged, and n-grams that count as one (each letter is in six).
DEVIATIONS, OVERLAP = 5.0, 6.0
#: In units of log share; documents of all test tables are above -1.3, letters at random and other scripts below -2 (with 10,000 documents to learn from).
LEAST_FIT = -2.0
#: Odd multipliers of the characters of an n-gram, and the last mixing step.
FACTORS = np.array([2654435761, 2246822519, 3266489917], np.uint32)
MIX = np.uint32(668265263)


@cache
def letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), np.bool_, 0x110000)


def _codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All characters of the texts, each text between spaces and before a zero; the text of each; which texts have letters."""
    parts = [np.frombuffer((" " + (t or "").lower() + " \0").encode("utf-32-le", "replace"), np.uint32) for t in texts]
    codes = np.concatenate(parts)
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    ends = np.cumsum([len(p) for p in parts]) - 1
    is_letter = letters()[codes]
    some = np.zeros(len(texts), bool)
    some[owner[is_letter]] = True
    codes = np.where(is_letter, codes, np.uint32(32))
    codes[ends] = 0
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
    return codes[keep], owner[keep], some


def grams(codes: np.ndarray, owner: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, text) of every n-gram that lies in one text."""
    shift = np.uint32(32 - (BUCKETS - 1).bit_length())
    for a in range(0, len(codes), STEP):
        part, own = codes[a : a + STEP + max(ORDERS) - 1], owner[a : a + STEP]
        for n in ORDERS:
            m = min(len(own), len(part) - n + 1)
            if m <= 0:
                continue
            h, good = np.full(m, n, np.uint32), np.ones(m, bool)
            for i in range(n):
                c = part[i : i + m]
                h = (h ^ (c * FACTORS[i])) * MIX
                good &= c != 0
            h ^= h >> np.uint32(15)
            yield ((h * MIX) >> shift)[good], own[:m][good]


def learned_from(key: str = "doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(5)) != 0


def gram_counts(docs: DataFrame, lang: str = "lang") -> DataFrame:
    """(lang, bucket, n) over all rows with a language and a text; bucket -1 counts the rows."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = (c.to_pylist() for c in batch.columns)
            names = sorted(set(langs))
            number = np.array([names.index(x) for x in langs], np.int64)
            for name, rows in zip(names, np.bincount(number)):
                sums.setdefault(name, np.zeros(BUCKETS + 1, np.int64))[BUCKETS] += rows
            codes, owner, _ = _codes(texts)
            for bucket, own in grams(codes, owner):
                table = np.bincount(number[own] * BUCKETS + bucket, minlength=BUCKETS * len(names)).reshape(len(names), BUCKETS)
                for name, row in zip(names, table):
                    sums[name][:BUCKETS] += row
        for name, row in sums.items():
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(np.where(at == BUCKETS, -1, at), pa.int32()), pa.array(row[at])], ["lang", "bucket", "n"])

    rows = docs.filter(F.col("text").isNotNull() & F.col(lang).isNotNull()).select("text", F.col(lang).cast("string").alias("lang"))
    return rows.mapInArrow(run, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, lang: str = "lang") -> tuple[list[str], np.ndarray, np.ndarray]:
    """Names, log priors, matrix of log shares (BUCKETS, languages)."""
    if docs.filter(F.col("text").isNotNull() & F.col(lang).isNotNull()).select(lang).distinct().limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    got = gram_counts(docs, lang).toArrow()  # MOST_LANGUAGES * (BUCKETS + 1) rows at most
    names = sorted(set(got.column("lang").to_pylist()))
    place = {x: i for i, x in enumerate(names)}
    which = np.array([place[x] for x in got.column("lang").to_pylist()], np.int64)
    bucket, n = got.column("bucket").to_numpy(), got.column("n").to_numpy()
    counts, rows = np.zeros((BUCKETS, len(names))), np.zeros(len(names))
    rows[which[bucket < 0]] = n[bucket < 0]
    counts[bucket[bucket >= 0], which[bucket >= 0]] = n[bucket >= 0]
    counts += 0.5
    return names, np.log(rows / max(rows.sum(), 1)), np.log(counts / counts.sum(axis=0))


def own_shares(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each language mean and standard deviation of the log shares of the n-grams that it was learned from."""
    share = np.exp(matrix)
    share -= share.min(axis=0, initial=1)  # what smoothing adds to each n-gram
    share /= np.maximum(share.sum(axis=0), 1e-12)
    mean = (share * matrix).sum(axis=0)
    return mean, np.sqrt(np.maximum((share * matrix**2).sum(axis=0) - mean**2, 0))


OUTPUT = ("lang_pred", "score", "fit")


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], keep: list[str], names_of: tuple[str, str, str] = OUTPUT) -> DataFrame:
    """The columns named in keep, with lang_pred, score (the posterior of lang_pred) and fit, under the names in names_of."""
    small_batches(docs.sparkSession)
    mean, spread = own_shares(model[2])
    sent = docs.sparkSession.sparkContext.broadcast((*model, mean, spread))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, prior, matrix, mean, spread = sent.value
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            codes, owner, some = _codes(texts)
            if not names:
                some[:] = False
            scores, number = np.zeros((len(texts), len(names))), np.zeros(len(texts))
            for bucket, own in grams(codes, owner):
                number += np.bincount(own, minlength=len(texts))
                for k in range(len(names)):
                    scores[:, k] += np.bincount(own, matrix[bucket, k], len(texts))
            given = scores + prior
            best = given.argmax(axis=1) if names else np.zeros(len(texts), int)
            share = 1 / np.exp(given - given.max(axis=1, keepdims=True)).sum(axis=1) if names else np.zeros(len(texts))
            pred = [names[b] if s else UNKNOWN for b, s in zip(best, some)]
            fit = scores[np.arange(len(texts)), best] / np.maximum(number, 1) - mean[best] + DEVIATIONS * spread[best] * np.sqrt(OVERLAP / np.maximum(number, 1)) if names else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(pred, pa.string()), pa.array(np.where(some, share, 0.0)), pa.array(fit, mask=~some)], [*batch.schema.names[:-1], *names_of])

    rows = docs.select(*keep, F.col("text").alias(fresh("text", keep)))
    schema = docs.select(*keep).schema.add(names_of[0], "string").add(names_of[1], "double").add(names_of[2], "double")
    return rows.mapInArrow(run, schema)


def identify(docs: DataFrame, key: str = "doc_id", lang: str = "lang") -> DataFrame:
    """Per row: doc_id, held_out (the model did not learn from it), lang_pred, score, fit."""
    model = train(docs.filter(learned_from(key)), lang)
    rows = docs.select(F.col(key).alias("doc_id"), (~learned_from(key)).alias("held_out"), "text")
    return predict(rows, model, ["doc_id", "held_out"])
