"""Packing by power-of-two decomposition.

Each document's tokens, with the end token, are cut into pieces whose lengths are powers of two: as many of the
full length as fit, then the binary digits of what is left, the largest first. Pieces of equal length form a bucket
(column bucket: the exponent), from which a trainer draws batches; a sequence is one piece, so that it crosses no
documents and needs no padding.

Defined cases: null text is empty and gives one piece with the end token alone; repeated rows are packed each on
its own; an empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavetable.llm.util import small_batches, text_bytes
from wavetable.llm.vocabulary import Encoder

LENGTH = 4096
END = 2


def piece_lengths(n: int, length: int = LENGTH) -> list[int]:
    """n as a sum of powers of two, none above length (itself a power of two), the largest first."""
    left = n % length
    return [length] * (n // length) + [1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1]


SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, bucket int, ids array<int>"


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", length: int = LENGTH, end: int = END, with_ids: bool = True) -> DataFrame:
    """One row for each piece; ids: its tokens (left out if with_ids is false); sequence_id and offset place it."""
    small_batches(docs.sparkSession)
    exponent = {1 << b: b for b in range(length.bit_length())}
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("bucket", pa.int32()), ("ids", pa.list_(pa.int32()))])
    if not with_ids:
        schema = schema.remove(6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer)
        tail = np.array([end], "<u4").tobytes()
        for batch in batches:
            out: list[list] = [[] for _ in schema]
            docs_, texts = (c.to_pylist() for c in batch.columns)
            for doc, ids in zip(docs_, encoder.packed(texts)):
                ids += tail
                at, n = 0, len(ids) // 4
                for size in piece_lengths(n, length):
                    piece = ids[4 * at : 4 * (at + size)]
                    row = (doc, at, size, zlib.crc32(piece), n, exponent[size], np.frombuffer(piece, "<i4") if with_ids else None)
                    for column, x in zip(out, row):
                        column.append(x)
                    at += size
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    pieces = docs.select(F.col(key).cast("bigint").alias("key"), text_bytes()).mapInArrow(run, SCHEMA if with_ids else SCHEMA.removesuffix(", ids array<int>"))
    return pieces.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("bigint"))
