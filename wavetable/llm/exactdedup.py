"""Exact duplicates of whole texts by skew-safe combining, with DataFrame functions alone.

Texts are equal when they are identical after lower-casing A-Z. Three stages, and each of them compares whole texts,
since the text is a grouping key beside its digest:

1. every task keeps one row for each text that it reads (the partial half of an aggregation), however many copies it has;
2. these rows meet in groups of (salt, digest, text), the salt being the task's number modulo SALTS, so that a text that
   all tasks hold is merged in SALTS places;
3. the winners of the salts, SALTS at most for each text, are combined into one row for each text.

Documents then find their group by the digest alone, where one text has it; adaptive execution splits the join of a hot
digest, as nothing above it needs the rows of a digest together. Digests that several texts share (none with SHA-256, but
the digest is an argument) are joined by digest and whole text.

Defined cases: a null text is empty; rows without a doc_id count in group_size and are kept only where no row of their
group has a doc_id, and keep_id is null then; rows that repeat the kept doc_id are one document and all marked kept
(unique_rows leaves one of them); an empty table gives an empty one; columns other than doc_id and text may have any name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavetable.llm.util import fresh, materialize

SALTS = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """Text with A-Z in lower case; null becomes empty. Where all characters are ASCII, lower() is the same and far quicker."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def winners(texts: DataFrame, salts: int = SALTS) -> DataFrame:
    """(digest, text, keep_id, group_size) from (id, digest, text): stages 1 to 3."""
    local = texts.withColumn("salt", F.spark_partition_id() % salts)
    salted = local.groupBy("salt", "digest", "text").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return salted.groupBy("digest", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def exact_duplicates(docs: DataFrame, digest: Callable[[Column], Column] = sha256, salts: int = SALTS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), a row for each of docs; of equal texts the largest doc_id stays."""
    texts = docs.select(F.col("doc_id").alias("id"), normalised(F.col("text")).alias("text")).withColumn("digest", digest(F.col("text")))
    by = winners(texts, salts).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"))
    by = materialize(by, "groups")  # read back, the join below has nothing but exchanges under it, and a hot digest is split
    marks = texts.select("id", "digest", *([] if digest is sha256 else [sha256(F.col("text")).alias("sha")]))
    found = marks.join(by.filter("n = 1").drop("n"), "digest")
    clashing = by.filter("n > 1").select("digest")
    if not clashing.isEmpty():
        shared = materialize(texts.join(clashing, "digest", "left_semi"), "clashing")
        several = shared.join(winners(shared, salts), ["digest", "text"])
        found = found.unionByName(several.withColumn("sha", sha256(F.col("text"))).select(found.columns))
    sha = F.col("digest" if digest is sha256 else "sha")
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex(sha)).alias("text_sha256"))


def unique_rows(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """docs with one row of each text: the one with the largest doc_id, and of rows that share it any one."""
    digest = fresh("digest", docs.columns)
    keep = fresh("keep_id", [*docs.columns, digest])
    keyed = docs.withColumn(digest, sha256(normalised(F.col("text"))))
    groups = exact_duplicates(docs, salts=salts).filter("kept").select(F.unhex("text_sha256").alias(digest), F.col("keep_id").alias(keep)).distinct()
    groups = materialize(groups, "kept")
    both = keyed.join(groups, digest).filter(F.col("doc_id").eqNullSafe(F.col(keep)))
    return both.dropDuplicates([digest]).select(docs.columns)
