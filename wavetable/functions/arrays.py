"""Column expressions over fixed-width class vectors; k is the number of classes, so that all of it is generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR = 1e-12


def items(v: Column, k: int) -> list[Column]:
    return [F.get(v, F.lit(i)) for i in range(k)]


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def softmax(logits: Column, k: int, temperature: Column | float = 1.0) -> Column:
    """Stable softmax of logits / temperature."""
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    x = items(logits, k)
    e = [F.exp((a - F.greatest(*x)) / t) for a in x]
    return F.array(*[a / total(e) for a in e])


def softmax_array(v: Column) -> Column:
    """The same for an array of any width; for expressions that are long themselves, as it repeats v less often."""
    e = F.transform(v, lambda x: F.exp(x - F.array_max(v)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def argmax(v: Column) -> Column:
    """Place of the largest entry, the first of equals."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def at(v: Column, label: Column) -> Column:
    return F.get(v, label)


def log_probabilities(p: Column) -> Column:
    return F.transform(p, lambda x: F.log(F.greatest(x, F.lit(FLOOR))))


def entropy(p: Column, k: int) -> Column:
    return -total([x * F.log(F.greatest(x, F.lit(FLOOR))) for x in items(p, k)])


def brier(p: Column, label: Column, k: int) -> Column:
    return total([F.pow(x - F.when(label == i, 1.0).otherwise(0.0), 2) for i, x in enumerate(items(p, k))])


def expand(p: Column, classes: Column, k: int) -> Column:
    """Probabilities of the classes listed, spread over the full label space; absent classes get 0."""
    by = F.map_from_arrays(classes, p)
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.coalesce(F.element_at(by, i), F.lit(0.0)))


def one_sum(p: Column) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda a, x: a + x)


def all_finite(v: Column) -> Column:
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def valid_probabilities(p: Column, tolerance: float = 1e-4) -> Column:
    return all_finite(p) & (F.abs(one_sum(p) - 1.0) <= tolerance)


def centred(v: Column, mean: Column) -> Column:
    return F.zip_with(v, mean, lambda a, b: a - b)
