"""Embedding near-duplicates: an exact metric range join over cells of pivots.

Cosine similarity of t or more is a distance of sqrt(2 - 2t) or less between unit vectors. Vectors are compared only
within their label. Equal vectors become one member with a count. Each label gets pivots, one for about CELL_ROWS
members; every member belongs to the cell of its nearest pivot. A member within the radius r of x lies in a cell
whose pivot q has d(x, q) <= d(x, own pivot) + 2r, by the triangle inequality, so x is copied to just those cells.
In its own cell a member then meets all members that it can link with, and cells are joined independently; cells
with more members than BLOCK_ROWS are dealt out in blocks of own members times blocks of all members. A further use of
the triangle inequality: inside a cell two members whose distances to the pivot differ by more than r need no look.

Vectors without structure in many dimensions lie about as far from every pivot, and would be copied to nearly all cells.
How many cells a member is copied to is measured on MEASURED members of each label; where it is over half of the label's
cells, the bound excludes too little, and the label is joined as a triangle of blocks instead: each pair of blocks meets
once, and each member is copied to as many tasks as there are blocks.

A block gives each own member its number of links, and a spanning forest of the links; their connected components are
the components of all links. Cosines are computed in double precision. Rows find their member by a 128-bit digest of the
vector, so that vectors are shuffled for the join of cells alone.

Defined cases: vectors that are null, empty, zero or have null or non-finite entries, and rows without a label, link
with nothing and are their own component; vectors of different lengths do not link; ties need no rule; a repeated row
counts as another vector under the same id; a row without an id links with nothing and has no component; very long
vectors are compared whole, in smaller blocks; columns that are not named are not looked at; an empty table gives an
empty result. Ids name vectors: different vectors under one id share their links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavetable.llm.components import connected_components
from wavetable.llm.simhash import forest
from wavetable.llm.util import materialize

THRESHOLD = 0.93
CELL_ROWS = 2048
BLOCK_ROWS = 2048
#: Pivots of all labels together are broadcast; beyond this many, cells grow and are dealt out in more blocks.
MOST_PIVOTS = 8192
#: Members of each label on which the copies are measured, and bytes of vectors in a block of the triangle.
MEASURED, BLOCK_BYTES = 2048, 16 << 20
#: Added to distances where cells and candidates are chosen, against rounding; links are decided by the cosine itself.
SLACK = 1e-9


def _told(rows: DataFrame, vector: str, label: str, key: str) -> DataFrame:
    """id, label, dim, v, and h1, h2 (digest of v) of each row; the digest only of vectors that can link."""
    v = F.transform(F.col(vector).cast("array<double>"), lambda x: x + F.lit(0.0))  # -0.0 becomes 0.0
    usable = F.col(key).isNotNull() & F.col(label).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(v, lambda x: x != 0)
    told = rows.select(F.col(key).alias("id"), F.col(label).cast("string").alias("label"), F.size(v).alias("dim"), v.alias("v"), usable.alias("usable"))
    return told.select("id", "label", "dim", "v", F.when(F.col("usable"), F.xxhash64("v")).alias("h1"), F.when(F.col("usable"), F.xxhash64(F.reverse("v"))).alias("h2"))


def _members(told: DataFrame) -> DataFrame:
    """Distinct usable vectors: label, dim, h1, h2, v, rep (smallest id), n (rows)."""
    return told.filter("h1 is not null").groupBy("label", "dim", "h1", "h2").agg(F.first("v").alias("v"), F.min(F.col("id").cast("bigint")).alias("rep"), F.count("*").alias("n"))


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _drawn():
    return F.pmod(F.xxhash64("rep", "h1"), F.lit(1 << 30)) / float(1 << 30)


def _pivots(members: DataFrame) -> dict[tuple[str, int], np.ndarray]:
    """Unit pivot vectors by (label, dim): members taken in the order of a hash."""
    sizes = {(x["label"], x["dim"]): x["count"] for x in members.groupBy("label", "dim").count().orderBy(F.desc("count")).limit(MOST_PIVOTS).collect()}
    share = min(1.0, MOST_PIVOTS * CELL_ROWS / max(1, sum(sizes.values())))
    wanted = {k: int(n / CELL_ROWS * share) for k, n in sizes.items()}
    wanted = {k: n for k, n in wanted.items() if n > 1}
    found: dict[tuple[str, int], np.ndarray] = {}
    if wanted:
        limits = members.sparkSession.createDataFrame([(a, b, n, min(1.0, 2 * n / sizes[a, b] + 20 / sizes[a, b])) for (a, b), n in wanted.items()], "label string, dim int, wanted int, part double")
        drawn = _drawn()
        some = members.join(F.broadcast(limits), ["label", "dim"]).filter(drawn < F.col("part")).select("label", "dim", "v", drawn.alias("h"))
        for x in some.orderBy("h").collect():  # about twice MOST_PIVOTS at most
            k = (x["label"], x["dim"])
            found.setdefault(k, []).append(x["v"])
    return {k: _unit(np.array(v[: wanted[k]])) for k, v in found.items()}


def _cells(members: DataFrame, pivots, radius: float) -> DataFrame:
    """members in their own cell (home) and copied to each cell within reach; to_pivot: distance to that cell's pivot."""
    fields = "label string, dim int, v array<double>, rep bigint, n bigint, cell int, home boolean, to_pivot double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = batch.to_pandas()
            for (label, dim), part in frame.groupby(["label", "dim"], sort=False):
                at, unit = part.index.to_numpy(), _unit(np.stack(part["v"]))
                own = pivots.value.get((label, int(dim)))
                if own is None:
                    own = np.zeros((1, int(dim)))  # one cell: all members are as far from its pivot
                d = np.sqrt(np.maximum(0, (unit * unit).sum(axis=1)[:, None] + (own * own).sum(axis=1) - 2 * unit @ own.T))
                home = d.argmin(axis=1)
                row, cell = np.nonzero(d <= d[np.arange(len(d)), home][:, None] + 2 * radius + SLACK * 10)
                got = batch.take(pa.array(at[row]))
                yield pa.RecordBatch.from_arrays([*got.columns, pa.array(cell, pa.int32()), pa.array(home[row] == cell), pa.array(d[row, cell])], ["label", "dim", "v", "rep", "n", "cell", "home", "to_pivot"])

    return members.select("label", "dim", "v", "rep", "n").mapInArrow(run, fields)


def _triangles(members: DataFrame, pivots, radius: float) -> list[tuple[str, int, int]]:
    """(label, dim, blocks) of the labels whose members would be copied to over half of their cells."""
    own = pivots.value
    if not own:
        return []
    spark = members.sparkSession
    sizes = {(x["label"], x["dim"]): x["count"] for x in members.join(F.broadcast(spark.createDataFrame(list(own), "label string, dim int")), ["label", "dim"]).groupBy("label", "dim").count().collect()}  # MOST_PIVOTS labels at most
    parts = spark.createDataFrame([(*k, min(1.0, MEASURED / n)) for k, n in sizes.items()], "label string, dim int, part double")
    some = members.join(F.broadcast(parts), ["label", "dim"]).filter(_drawn() < F.col("part"))
    got = _cells(some, pivots, radius).groupBy("label", "dim").agg((F.count("*") / F.count_if("home")).alias("copies")).collect()
    return [(x["label"], x["dim"], -(-sizes[x["label"], x["dim"]] * 8 * x["dim"] // BLOCK_BYTES)) for x in got if 2 * x["copies"] > len(own[x["label"], x["dim"]])]


def _block_links(frame: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links between own members of the block (side 0) and members met (side 1); in a triangle's block of two blocks (cell -1) the members met count theirs, too."""
    own, met = frame[frame["side"] == 0], frame[frame["side"] == 1]
    if not len(own) or not len(met):
        return pd.DataFrame({"rep": [], "links": [], "v": []}).astype("int64")
    radius = np.sqrt(2 - 2 * threshold) + 1e-6
    both = frame["cell"].iloc[0] < 0 and frame["own_block"].iloc[0] != frame["met_block"].iloc[0]
    met = met.sort_values("to_pivot")
    a, b = _unit(np.stack(own["v"])), _unit(np.stack(met["v"]))
    far, n, ids = met["to_pivot"].to_numpy(), met["n"].to_numpy(), met["rep"].to_numpy()
    mine, own_n, links, back = own["rep"].to_numpy(), own["n"].to_numpy(), np.zeros(len(own), np.int64), np.zeros(len(met), np.int64)
    # a forest over the distinct ids of both sides
    names, place = np.unique(np.concatenate([mine, ids]), return_inverse=True)
    left, right = place[: len(mine)], place[len(mine) :]
    root = np.arange(len(names))
    order = np.argsort(own["to_pivot"].to_numpy(), kind="stable")
    for i in range(0, len(order), 256):  # neighbours in distance share a window of met members
        part = order[i : i + 256]
        reach = own["to_pivot"].to_numpy()[part]
        lo, hi = np.searchsorted(far, reach.min() - radius), np.searchsorted(far, reach.max() + radius, "right")
        close = a[part] @ b[lo:hi].T >= threshold
        links[part] += close @ n[lo:hi]
        if both:
            back[lo:hi] += close.T @ own_n[part]
        x, y = np.nonzero(close)
        root = forest(len(names), left[part[x]], right[lo + y], root)
    tied = np.flatnonzero(root != np.arange(len(names)))
    counted = [(mine, links), (ids, back)] if both else [(mine, links)]
    ends, told = (np.concatenate(c) for c in zip(*counted))
    return pd.DataFrame({"rep": np.concatenate([ends, names[tied]]), "links": np.concatenate([told, np.full(len(tied), -1)]), "v": np.concatenate([ends, names[root[tied]]])})


def near_duplicates(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: key, n_links, component_id, kept."""
    spark = rows.sparkSession
    radius = float(np.sqrt(2 - 2 * threshold)) + 1e-6
    told = _told(rows, vector, label, key)
    members = materialize(_members(told), "members")
    pivots = spark.sparkContext.broadcast(_pivots(members))
    triangles = spark.createDataFrame(_triangles(members, pivots, radius), "label string, dim int, blocks int")  # MOST_PIVOTS rows at most
    cells = materialize(_cells(members.join(F.broadcast(triangles), ["label", "dim"], "left_anti"), pivots, radius), "cells")
    sizes = cells.groupBy("label", "dim", "cell").agg(F.ceil(F.count_if("home") / BLOCK_ROWS).cast("int").alias("own_blocks"), F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("met_blocks"))
    sizes = materialize(sizes, "cell-sizes")
    dealt = cells.join(sizes, ["label", "dim", "cell"])
    lot = F.xxhash64("rep", "v")
    everywhere = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    own = dealt.filter("home").withColumn("side", F.lit(0)).withColumn("own_block", F.pmod(lot, F.col("own_blocks")).cast("int")).withColumn("met_block", F.explode(everywhere("met_blocks")))
    met = dealt.filter("own_blocks > 0").withColumn("side", F.lit(1)).withColumn("met_block", F.pmod(lot, F.col("met_blocks")).cast("int")).withColumn("own_block", F.explode(everywhere("own_blocks")))
    # in a triangle the lower block of a pair is the own one; a block paired with itself is on both sides
    mine = F.pmod(lot, F.col("blocks")).cast("int")
    sides = F.explode(F.when(F.col("other") == F.col("mine"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.when(F.col("mine") < F.col("other"), 0).otherwise(1))))
    paired = members.join(F.broadcast(triangles), ["label", "dim"]).withColumn("mine", mine).withColumn("other", F.explode(everywhere("blocks"))).withColumn("side", sides)
    paired = paired.withColumns({"cell": F.lit(-1), "own_block": F.least("mine", "other"), "met_block": F.greatest("mine", "other"), "to_pivot": F.lit(0.0)})
    columns = ["label", "dim", "cell", "own_block", "met_block", "side", "v", "rep", "n", "to_pivot"]
    found = own.select(columns).unionByName(met.select(columns)).unionByName(paired.select(columns))
    found = found.groupBy("label", "dim", "cell", "own_block", "met_block").applyInPandas(lambda f: _block_links(f, threshold), "rep bigint, links bigint, v bigint")
    found = materialize(found, "links")
    counts = found.filter("links >= 0").groupBy("rep").agg(F.sum("links").alias("links"))
    tied = connected_components(found.filter("links < 0").select(F.col("rep").alias("u"), "v"))
    by = members.select("label", "dim", "h1", "h2", "rep").join(counts, "rep", "left").join(tied, F.col("rep") == F.col("vertex"), "left")
    by = materialize(by.select("label", "dim", "h1", "h2", (F.coalesce("links", F.lit(1)) - 1).alias("links"), F.coalesce("component", "rep").alias("component")), "vectors")
    component = F.coalesce("component", "id")
    return told.drop("v").join(by, ["label", "dim", "h1", "h2"], "left").select(
        F.col("id").alias(key), F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept")
    )
