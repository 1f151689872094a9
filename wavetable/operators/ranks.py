"""Running totals, ranks and the like over orders that no single task can hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wavetable.sources.scratch import materialize


def running_totals(df: DataFrame, order: list[str], totals: dict[str, str], keys: list[str] | None = None) -> DataFrame:
    """df with, for each name in totals, the sum of that expression over the rows up to and with this one.

    order has to be unique within keys. Rows are dealt out by ranges of (keys, order); each range is summed on its
    own, and the sums of the ranges, a row for each range and key, give the offsets. No key is tied to one task.
    """
    keys = keys or []
    parts = df.withColumns({name: F.expr(e) for name, e in totals.items()}).repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id())
    parts = materialize(parts, "ranges")  # a written table, so that a range is the same whoever reads it
    sums = parts.groupBy(*keys, "_part").agg(*[F.sum(n).alias(f"_{n}") for n in totals])
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(*keys, "_part", *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in totals])
    within = W.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    joined = parts.join(offsets, [*keys, "_part"])
    return joined.withColumns({n: F.sum(n).over(within) + F.col(f"_{n}") for n in totals}).drop("_part", *[f"_{n}" for n in totals])


#: Rows of a lot of consecutive places, as a power of two.
LOT_BITS = 20


def placed(df: DataFrame, order: list[str], name: str, keep: list[str] | None = None) -> DataFrame:
    """df (or its columns keep), written once, with each row's place from 0 in the whole order.

    Rows are dealt out by ranges and sorted inside them, which is the only shuffle; the number of a row in its range is that
    which Spark gives the rows of a partition one after another, and the sizes of the ranges come before it.
    """
    spark = df.sparkSession
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = materialize(sorted_rows.select(*(df.columns if keep is None else keep), F.monotonically_increasing_id().alias("_id")), "places")
    part = F.shiftright("_id", 33).cast("int").alias("_part")  # the upper bits are the range
    before, total = [], 0  # as many rows as ranges, which the number of shuffle partitions bounds
    for x in sorted(rows.groupBy(part).count().collect()):  # a row for each range
        before.append((x["_part"], total))
        total += x["count"]
    ahead = spark.createDataFrame(before, "_part int, _before long")
    number = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumn("_part", part).join(F.broadcast(ahead), "_part").withColumn(name, F.col("_before") + number).drop("_part", "_before", "_id")


def spans(rows: DataFrame, keys: list[str], place: str, *more: Column) -> DataFrame:
    """(keys, _lot, _start, _n, more) of rows placed by keys first: the place of a key's first row and its rows, for every lot of places that it has rows in."""
    lots = rows.groupBy(*keys, F.shiftright(place, LOT_BITS).alias("_lot")).agg(F.min(place).alias("_start"), F.count(F.lit(1)).alias("_n"), *more)
    whole = W.partitionBy(*keys)  # rows of lots
    return materialize(lots.withColumns({"_start": F.min("_start").over(whole), "_n": F.sum("_n").over(whole)}), "spans")


def ranked(df: DataFrame, order: list[str], keys: list[str] | None = None, name: str = "rank") -> DataFrame:
    """Row numbers from 1 by a unique order, without one task for a key. Rows with a null among keys have none and are left out."""
    rows = placed(df, [*(keys or []), *order], name)
    if not keys:
        return rows.withColumn(name, F.col(name) + 1)
    numbered = rows.withColumn("_lot", F.shiftright(name, LOT_BITS)).join(spans(rows, keys, name), [*keys, "_lot"])
    return numbered.select(*df.columns, (F.col(name) - F.col("_start") + 1).alias(name))


#: Cells into which a range of values is cut in each round, and values that a cell may have before they are looked at one by one.
CELLS, FEW = 1024, 4096


def _scale(value: Column) -> Column:
    """A rising function of value that spreads orders of magnitude evenly."""
    return F.signum(value) * (F.log2(F.greatest(F.abs(value), F.lit(5e-324))) + 1075)


def _cell_of(value: Column, low: Column, high: Column, level: int) -> Column:
    """The number of value's cell between low and high, the extremes of the finite values about it; rising with value. Infinities and NaN have cells of their own.

    Cells are even in value, or on every second level in its order of magnitude, so that a dozen levels tell any doubles apart.
    """
    v, a, b = (_scale(x) for x in (value, low, high)) if level % 2 else (value / 2, low / 2, high / 2)
    place = F.floor((v - a) / F.nullif(b - a, F.lit(0.0)) * CELLS)
    inside = F.least(F.lit(CELLS - 1), F.greatest(F.lit(0), F.coalesce(place, F.lit(0)))).cast("int")
    infinite = float("inf")
    return F.when(F.isnan(value), CELLS + 1).when(value == infinite, CELLS).when(value == -infinite, -1).otherwise(inside)


def quantiles(df: DataFrame, keys: list[str], value: str, shares: list[float], few: int = FEW) -> DataFrame:
    """(keys, quantiles): linear quantiles, exact, by histograms: nothing is sorted and no task holds a key's values.

    Each round counts the values of the cells in question in CELLS finer ones, combined in tasks before the shuffle, and
    keeps those cells in which a wanted rank lies, each with its own least and largest value, two at most for each share.
    Cells of one value are done; when the others have few values each, these are counted one by one. Null values don't
    count; NaN is the largest value. df is read once more for each round (two, where values are not piled up).
    """
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    finite = F.when(F.abs("_v") < float("inf"), F.col("_v"))
    spans = [F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.min(finite).alias("_flow"), F.max(finite).alias("_fhigh")]
    places = F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(s) * (F.col("_n") - 1)).alias("h")) for i, s in enumerate(shares)])
    total = rows.groupBy(*keys).agg(*spans)
    wanted = total.select(*keys, places.alias("_places"))
    ranks = F.array_distinct(F.flatten(F.transform("_places", lambda p: F.array(F.floor(p["h"]), F.ceil(p["h"])))))
    cells = materialize(total.select(*keys, F.lit(0).cast("long").alias("_before"), "_n", "_low", "_high", "_flow", "_fhigh").filter("_n > 0"), "cells")
    met = lambda table: table.join(wanted, keys) if keys else table.crossJoin(F.broadcast(wanted))  # noqa: E731  without keys one row

    several = ~F.col("_low").eqNullSafe(F.col("_high"))
    levels: list[DataFrame] = []  # the cells with several values, of each round; their numbers in all rounds before tell them

    def inside() -> tuple[DataFrame, list[str]]:
        """The rows of the last round's cells with several values, and what tells these cells."""
        own, names = rows, list(keys)
        for i, level in enumerate(levels):
            begin = level.select(*names, "_before", "_flow", "_fhigh")
            own = own.drop("_before", "_flow", "_fhigh")
            own = own.join(begin, names) if names else own.crossJoin(F.broadcast(begin))  # without keys one row
            if i + 1 < len(levels):
                own, names = own.withColumn(f"_c{i}", _cell_of(F.col("_v"), F.col("_flow"), F.col("_fhigh"), i)), [*names, f"_c{i}"]
        return own, names

    def counted(by: Column | None) -> DataFrame:
        """Counts in each cell by a finer number, or by the values themselves, with the values before each; those with a wanted rank."""
        own, names = inside()
        name = "_value" if by is None else f"_c{len(levels) - 1}"
        found = own.groupBy(*names, "_before", (F.col("_v") if by is None else by).alias(name)).agg(*spans)
        upto = F.sum("_n").over(W.partitionBy(*names, "_before").orderBy(name))  # CELLS + 3 rows, or few
        found = found.withColumn("_before", F.col("_before") + upto - F.col("_n"))
        held = F.exists(ranks, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_n")))
        return met(found).filter(held).drop("_places")

    plain = [*keys, "_before", "_n", "_low", "_high", "_flow", "_fhigh"]
    values = cells.filter(~several).select(plain)
    while True:
        levels.append(cells.filter(several))
        if (levels[-1].agg(F.max("_n")).first()[0] or 0) <= few:
            break
        cells = materialize(counted(_cell_of(F.col("_v"), F.col("_flow"), F.col("_fhigh"), len(levels) - 1)), "cells")
        values = values.unionByName(cells.filter(~several).select(plain))
    values = values.unionByName(counted(None).select(plain))
    placed = met(values).select(*keys, "_low", "_before", "_n", F.explode("_places").alias("_p"))
    hit = lambda rank: F.max(F.when((rank >= F.col("_before")) & (rank < F.col("_before") + F.col("_n")), F.col("_low")))
    h = F.col("_p.h")
    each = placed.groupBy(*keys, F.col("_p.i").alias("i"), h.alias("h")).agg(hit(F.floor(h)).alias("_a"), hit(F.ceil(h)).alias("_b"))
    q = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("h") - F.floor("h")))
    return each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", q.alias("q")))), lambda x: x["q"]).alias("quantiles"))
