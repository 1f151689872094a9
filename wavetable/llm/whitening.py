"""Whitening of integer vectors by exact statistics.

Vectors become integers; the distinct ones are the fit list, whose number n, sums S and products are added up in tasks as
integers of any size (blocks of rows that a double holds exactly are multiplied as doubles). M = n * products - S S' is
n * n times the covariance, so that its eigenvalues and vectors are those of the covariance. Its characteristic polynomial
is taken modulo primes that Spark deals out to tasks; what reaches the driver is M and a residue for each prime and
coefficient, both of a size that the width alone gives. The roots are isolated in integer arithmetic (llm.charpoly).

Defined cases: vectors that are null, empty, hold null or non-finite entries or an entry of 2**54 or more in size, whose
integer no long holds, are left out; so are vectors of another width than most have (of two such widths, than the larger);
repeated rows count once in the fit list and are all returned; components whose eigenvalue is zero have no rows, so that
one distinct vector gives an empty result, as an empty table does; a deviation that no long holds is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavetable.llm import charpoly
from wavetable.llm.util import materialize

SCALE, COMPONENTS = 256, 4
LARGEST = 2.0**54
#: Bytes of an exact sum.
WORD = 32
#: Tasks whose sums meet first.
LOT = 32
EXACT = 2**53


def integers(vector: Column) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long"))


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < LARGEST))
    return vector.isNotNull() & (F.size(vector) > 0) & fine


def _packed(values: np.ndarray) -> bytes:
    return b"".join(int(x).to_bytes(WORD, "little", signed=True) for x in np.ravel(values))


def _unpacked(data: bytes) -> np.ndarray:
    return np.array([int.from_bytes(data[i : i + WORD], "little", signed=True) for i in range(0, len(data), WORD)], dtype=object)


def _row(data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["sums"])


def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(-1, d)


def _products(x: np.ndarray) -> np.ndarray:
    """x' x, exact, as integers of any size."""
    largest = int(np.abs(x).max(initial=0))
    rows = EXACT // max(1, largest * largest)
    if not rows:
        y = x.astype(object)
        return y.T @ y
    total = np.zeros((x.shape[1], x.shape[1]), dtype=object)
    for i in range(0, len(x), rows):
        block = x[i : i + rows].astype(float)
        total += (block.T @ block).astype(np.int64)
    return total


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for data in batch.column("sums").to_pylist():
            own = _unpacked(data)
            total = own if total is None else total + own
    if total is not None:
        yield _row(_packed(total))


def moments(fit: DataFrame, d: int) -> tuple[int, list[int], np.ndarray]:
    """(n, S, products) of the rows x of fit, exact; partial sums of tasks meet in lots, and the lots' in one task, each d * d numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, g = 0, np.zeros(d, dtype=object), np.zeros((d, d), dtype=object)
        for batch in batches:
            x = _matrix(batch, d)
            n, s, g = n + len(x), s + x.astype(object).sum(axis=0), g + _products(x)
        if n:
            yield _row(_packed(np.concatenate([[n], s, g.ravel()])))

    parts = fit.mapInArrow(run, "sums binary")
    lots = parts.withColumn("lot", F.floor(F.spark_partition_id() / LOT)).groupBy("lot").applyInArrow(lambda t: pa.Table.from_batches(_added(iter(t.select(["sums"]).to_batches()))), "sums binary")
    data = [bytes(x["sums"]) for x in lots.collect()]  # a row for every LOT tasks
    total = sum((_unpacked(x) for x in data), np.zeros(1 + d + d * d, dtype=object))
    return int(total[0]), [int(x) for x in total[1 : d + 1]], total[d + 1 :].reshape(d, d)


def characteristic_polynomial(spark, matrix: np.ndarray) -> list[int]:
    """Coefficients of det(x I - matrix), lowest first; the primes are dealt out to tasks."""
    d = len(matrix)
    primes = charpoly.primes_for(charpoly.coefficient_bound(int(np.trace(matrix)), d))
    sent = spark.sparkContext.broadcast(matrix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column("id").to_pylist():
                p = primes[i]
                yield pa.RecordBatch.from_pydict({"p": pa.array([p], pa.int64()), "r": pa.array([charpoly.residues((sent.value % p).astype(np.int64), p)], pa.list_(pa.int64()))})

    tasks = min(len(primes), max(2, spark.sparkContext.defaultParallelism))
    found = {x["p"]: list(x["r"]) for x in spark.range(0, len(primes), 1, tasks).mapInArrow(run, "p long, r array<long>").collect()}
    return charpoly.from_residues(found)


def components(spark, matrix: np.ndarray, most: int = COMPONENTS) -> tuple[list[Fraction], list[np.ndarray]]:
    """Eigenvalues of matrix other than zero, falling, and their unit vectors."""
    roots = charpoly.largest_roots(characteristic_polynomial(spark, matrix), most)
    rows, vectors = [[int(x) for x in row] for row in matrix], []
    for root in roots:
        near = [v for v, other in zip(vectors, roots) if abs(other - root) * 10**6 <= root]
        vectors.append(charpoly.null_vector(rows, root, near))
    return roots, vectors


def projected(rows: DataFrame, keep: list[str], n: int, sums: list[int], vectors: list[np.ndarray], values: list[float], d: int) -> DataFrame:
    """(keep, deviation, w) of rows (keep, x): the exact squared distance from the mean, times n * n, and the whitened coordinates."""
    axes = np.array(vectors).T / np.sqrt(values)
    shifts, largest = np.array(sums, dtype=object), max(abs(s) for s in sums)
    schema = ", ".join([*(f"`{c}` {t}" for c, t in rows.select(*keep).dtypes), "deviation long", "w array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, d)
            most = n * int(np.abs(x).max(initial=0)) + largest
            moved = n * x - np.array(sums, np.int64) if most * most * d < 2**63 else n * x.astype(object) - shifts
            deviation = [int(v) for v in (moved * moved).sum(axis=1)]
            w = (moved / n).astype(float) @ axes
            columns = [batch.column(c) for c in keep]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, w.shape[1]), pa.int32()), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([*columns, pa.array([v if v < 2**63 else None for v in deviation], pa.int64()), lists], [*keep, "deviation", "w"])

    return rows.select(*keep, "x").mapInArrow(run, schema)


def identity_error(fit: DataFrame, k: int) -> float:
    """The largest absolute entry of the covariance of w over fit, without the identity; centred before multiplying."""
    mean = fit.agg(*[F.avg(F.col("w")[i]).alias(str(i)) for i in range(k)]).first()
    centred = [F.col("w")[i] - mean[i] for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    cov = fit.agg(*[F.avg(centred[i] * centred[j]).alias(f"{i}_{j}") for i, j in pairs]).first()
    return max(abs(cov[at] - (i == j)) for at, (i, j) in enumerate(pairs))


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitening(vectors: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """A row for each usable row of vectors (vec_id, embedding) and component: see SCHEMA and the module's cases."""
    spark = vectors.sparkSession
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("e")).filter(usable(F.col("e")))
    widths = good.groupBy(F.size("e").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not widths:
        return spark.createDataFrame([], SCHEMA)
    d = widths[0]["d"]
    rows = good.filter(F.size("e") == d).select("vec_id", integers(F.col("e")).alias("x"))
    fit = materialize(rows.select("x").distinct(), "fit")
    n, sums, products = moments(fit, d)
    matrix = n * products - np.outer(np.array(sums, dtype=object), np.array(sums, dtype=object))
    roots, axes = components(spark, matrix, most)
    if not roots:
        return spark.createDataFrame([], SCHEMA)
    trace = int(np.trace(matrix))
    values = [float(r / (n * n)) for r in roots]
    explained = [float(r / trace) for r in roots]
    error = identity_error(projected(fit, [], n, sums, axes, values, d), len(roots))
    found = projected(rows, ["vec_id"], n, sums, axes, values, d)
    each = found.select("vec_id", "deviation", F.posexplode("w").alias("i", "whitened"))
    share = F.element_at(F.array(*[F.lit(x) for x in explained]), F.col("i") + 1)
    return each.select("vec_id", (F.col("i") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error"))
