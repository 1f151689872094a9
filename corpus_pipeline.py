"""The corpus pipeline: language, toxicity, near-duplicates, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written and read again before the next one.
Filtering stages keep the columns of documents, whatever else these are: what a stage adds has names that no column has.
Stages that come back to a row know it by a digest of all its columns, so that rows without an id and rows that share
one are judged each on its own.

Defined cases, for all stages: a null or empty text has no letters, and the first stage drops it; very long texts are
read whole; of rows repeated whole the near-duplicate stage keeps one, the others keep or drop all; of equally good
documents the one with the smallest id stays, rows without an id last; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavetable.llm import decontam, langid, packing, simhash, toxicity
from wavetable.llm.queries import tokenizer_path
from wavetable.llm.util import fresh, materialize, row_key, table

#: Shingle and similarity of near-duplicates.
SHINGLE, SIMILARITY = 5, 0.8


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without letters and those that no learned language fits: letters at random, other scripts, other languages."""
    model = langid.train(docs.filter(langid.learned_from()))
    pred, score, fit = (fresh(c, docs.columns) for c in langid.OUTPUT)
    judged = langid.predict(docs, model, docs.columns, (pred, score, fit))
    return judged.filter((F.col(pred) != langid.UNKNOWN) & (F.col(fit) >= langid.LEAST_FIT)).select(docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts that the classifier chain calls toxic."""
    prefix = "_" * max((len(c) - len(c.lstrip("_")) + 1 for c in docs.columns), default=1)
    judged = toxicity.toxicity(docs, table(spark, sf_dir, "labels"), keep=docs.columns, prefix=prefix)
    return judged.filter(~F.col(f"{prefix}toxic")).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts with similar sets of five-word shingles keep the document with the smallest id."""
    row = fresh("row", docs.columns)
    keyed = docs.withColumn(row, F.expr(row_key(docs)))
    kept = materialize(simhash.first_rows(keyed, row, shingle=SHINGLE, similarity=SIMILARITY).withColumnRenamed("row", row), "kept")
    return keyed.join(kept, row, "left_semi").dropDuplicates([row]).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold ten words running of a benchmark item, or a whole shorter one."""
    row = fresh("row", docs.columns)
    keyed = docs.withColumn(row, F.expr(row_key(docs)))
    found = decontam.find_contamination(keyed, table(spark, sf_dir, "benchmark"), key=row)
    dirty = materialize(found.filter(F.size("spans") > 0).select(F.col("doc_id").alias(row)).distinct(), "contaminated")
    return keyed.join(dirty, row, "left_anti").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Power-of-two pieces of each document's tokens."""
    pieces = packing.pack(docs, tokenizer_path(), with_ids=False)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket")


STAGES = [
    ("language", keep_known_language),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: The model stages have no SQL; tests/llm compares the pipeline with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
