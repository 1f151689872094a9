"""Merkle manifest of a table, with a proof for each row, by exchange between subtrees.

A tree's nodes are numbered in order; every ARITY consecutive ones have one parent, until one node is left. HEIGHT levels
of ARITY ** HEIGHT consecutive nodes are a superblock, which one task reduces at a time: no tree, whatever its share of
the rows, meets in one task. The tops of superblocks are the nodes of a smaller tree, treated in the same way, so that a
few rounds reach the roots; then the roots of the sources are the nodes of the last tree. The way back is a cogroup by
superblock of its nodes with the nodes outside of it that its top needs to reach the root: each task finishes the local
reduction, joins the inner and outer parts of every proof and folds the leaf that it is given up to the root.

Order within a source: doc_id, rows without one first, then the leaf, so that rows that share an id have places; equal
rows are interchangeable. Positions come from ranges of that order and their counts, without a task for a source.

Defined cases: each null column counts as `-`; a null source is a source of its own and comes first; rows without a
doc_id are never tampered with; a table with one row has that leaf as its root and an empty proof; an empty table gives
an empty one; other columns may have any name and do not count.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wavetable.llm.util import materialize

ARITY, HEIGHT = 3, 7
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
PATHS = "tree string, pos long, before array<string>, after array<string>, root string"
RESULT = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def field(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_of(text: Column) -> Column:
    return F.sha2(F.concat(*[field(F.col(c)) for c in COLUMNS[:-1]], field(text)).cast("binary"), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, leaf, given): given is the leaf of the tampered row where the row is tampered with, else null. tree sorts like source, null first."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    tree = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))
    return docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf_of(F.col("text")).alias("leaf"), F.when(tampered, leaf_of(F.replace(F.col("text").cast("string"), F.lit("\n"), F.lit("")))).alias("given"))


def numbered(nodes: DataFrame, order: list[str], name: str) -> DataFrame:
    """nodes with pos (from 0, by order) and n, the nodes of the tree; no task holds a tree."""
    parts = materialize(nodes.repartitionByRange("tree", *order).withColumn("part", F.spark_partition_id()), name)
    counts = parts.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("own"))  # a row for each range and each tree in it
    tree = W.partitionBy("tree")
    upto = F.sum("own").over(tree.orderBy("part").rowsBetween(W.unboundedPreceding, W.currentRow))
    offsets = counts.select("tree", "part", (upto - F.col("own")).alias("before"), F.sum("own").over(tree).alias("n"))
    within = F.row_number().over(W.partitionBy("part", "tree").orderBy(*order))
    placed = parts.withColumn("place", within).join(offsets, ["part", "tree"])
    return placed.withColumn("pos", F.col("before") + F.col("place") - 1).drop("part", "before", "place")


def reduction(nodes: list[str], height: int | None) -> list[list[str]]:
    """The levels above nodes: height of them, or up to the one node that is left."""
    levels = [nodes]
    while len(levels) <= height if height is not None else len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([digest(*below[i : i + ARITY]) for i in range(0, len(below), ARITY)])
    return levels


def _levels(nodes: list[str], n: int, height: int) -> list[list[str]]:
    """A superblock's levels: a tree of several superblocks has all of them, though a block be short."""
    return reduction(nodes, height if n > ARITY**height else None)


def inner_path(levels: list[list[str]], place: int) -> tuple[list[str], list[str]]:
    """What stands before and after the node's own digest in its run, level by level."""
    before, after = [], []
    for level in levels[:-1]:
        first = place - place % ARITY
        before.append("".join(level[first:place]))
        after.append("".join(level[place + 1 : first + ARITY]))
        place //= ARITY
    return before, after


def fold(leaf: str, before: list[str], after: list[str]) -> str:
    for left, right in zip(before, after):
        leaf = digest(left, leaf, right)
    return leaf


def _tops(nodes: DataFrame, height: int) -> DataFrame:
    """The superblocks' tops (tree, pos, n, leaf) as nodes of the next tree."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("pos")
        n = int(frame["n"].iloc[0])
        top = _levels(frame["leaf"].tolist(), n, height)[-1][0]
        return pd.DataFrame({"tree": frame["tree"].iloc[:1].to_numpy(), "pos": frame["pos"].iloc[:1].to_numpy() // ARITY**height, "n": [-(-n // ARITY**height)], "leaf": [top]})

    blocks = nodes.withColumn("block", F.expr(f"pos div {ARITY**height}"))
    return blocks.select("tree", "block", "pos", "n", "leaf").groupBy("tree", "block").applyInPandas(run, "tree string, pos long, n long, leaf string")


def _exchanged(nodes: DataFrame, outer: DataFrame, height: int, finish, schema: str) -> DataFrame:
    """Cogroup of the nodes of each superblock with the path of its top; finish makes rows of (node rows by position, levels, the top's path)."""

    def run(own: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("pos")
        levels = _levels(own["leaf"].tolist(), int(own["n"].iloc[0]), height)
        return finish(own, levels, above.iloc[0])

    blocks = nodes.withColumn("block", F.expr(f"pos div {ARITY**height}"))
    above = outer.withColumnRenamed("pos", "block")
    return blocks.groupBy("tree", "block").cogroup(above.groupBy("tree", "block")).applyInPandas(run, schema)


def paths(nodes: DataFrame, height: int = HEIGHT) -> DataFrame:
    """(tree, pos, before, after, root) of nodes (tree, pos, n, leaf): each node's way to the root of its tree."""
    nodes = materialize(nodes.select("tree", "pos", "n", "leaf"), "nodes")
    if not (nodes.agg(F.max("n")).first()[0] or 0) > 1:
        return nodes.select("tree", "pos", F.expr("cast(array() as array<string>)").alias("before"), F.expr("cast(array() as array<string>)").alias("after"), F.col("leaf").alias("root"))

    def finish(own: pd.DataFrame, levels: list[list[str]], above: pd.Series) -> pd.DataFrame:
        inner = [inner_path(levels, i) for i in range(len(own))]
        return pd.DataFrame({
            "tree": own["tree"].to_numpy(), "pos": own["pos"].to_numpy(), "before": [[*b, *above["before"]] for b, _ in inner], "after": [[*a, *above["after"]] for _, a in inner], "root": above["root"],
        })

    return _exchanged(nodes, paths(_tops(nodes, height), height), height, finish, PATHS)


def manifest(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """A row for each of docs: its leaf, the roots of its source and of all, its proof's digest, and what the leaf that is given folds to."""
    nodes = materialize(numbered(materialize(leaves(docs), "leaves"), ["doc_id", "leaf"], "ranges"), "places")
    tops = materialize(_tops(nodes, height), "tops")
    within = materialize(paths(tops, height), "within")
    subroots = within.filter("pos = 0").select("tree", F.col("root").alias("leaf"))
    sources = numbered(subroots.select(F.lit("all").alias("tree"), F.col("tree").alias("source"), "leaf"), ["source"], "sources")
    sources = materialize(sources, "subroots")
    over = paths(sources, height).join(sources.select("tree", "pos", "source"), ["tree", "pos"])
    over = over.select(F.col("source").alias("tree"), F.col("before").alias("b"), F.col("after").alias("a"), F.col("root").alias("all_root"))
    joined = within.join(over, "tree").select("tree", "pos", F.concat("before", "b").alias("before"), F.concat("after", "a").alias("after"), F.col("root").alias("subroot"), F.col("all_root").alias("root"))

    def finish(own: pd.DataFrame, levels: list[list[str]], above: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(list(_proven(own, levels, above)), columns=[x.split()[0] for x in RESULT.split(", ")])

    def _proven(own: pd.DataFrame, levels: list[list[str]], above: pd.Series) -> Iterator[tuple]:
        outer = [list(above["before"]), list(above["after"])]
        outer_text = "".join(b + a for b, a in zip(*outer))
        for i, (doc_id, leaf, given) in enumerate(zip(own["doc_id"].tolist(), own["leaf"], own["given"])):
            before, after = inner_path(levels, i)
            proof = digest(*(b + a for b, a in zip(before, after)), outer_text)
            folded = fold(given if isinstance(given, str) else leaf, before + outer[0], after + outer[1])
            yield doc_id, leaf, above["subroot"], above["root"], proof, folded, folded == above["root"]

    # ids travel as text: pandas would turn those of a block that has nulls into floating point
    found = _exchanged(nodes.withColumn("doc_id", F.col("doc_id").cast("string")), joined, height, finish, RESULT)
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))
