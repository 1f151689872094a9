"""Token counts by heap-and-linked-list byte-pair merging.

A piece of text starts as one symbol for each byte, the last with the vocabulary's end mark. The adjacent pair of
lowest rank is taken from a heap, the leftmost of equals first; its two symbols become one in a linked list, and the
new neighbours' pairs enter the heap. The piece has as many tokens as symbols at first less the merges; no token is
ever looked up. Counts of pieces and of white-space chunks are remembered in stores of bounded size.

Defined cases: null text is empty and has no tokens; a special string inside a text is one token, as the library
has it by default; repeated rows give repeated rows; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavetable.llm.util import small_batches, text_bytes
from wavetable.llm.vocabulary import LONGEST, PIECES, PLAIN, PLAIN_PIECES, REMEMBERED, cuts_at_white_space, trimmed

ANY_PIECES = regex.compile(PIECES.replace(r"\s", r"\p{White_Space}"))


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself if printable, else the next one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def merged_length(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Number of symbols left when no pair with a rank is left."""
    n = left = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i]
        if not symbols[i] or j == n or ranks.get((symbols[i], symbols[j])) != rank:
            continue  # one of the two has been merged meanwhile
        symbols[i] += symbols[j]
        symbols[j] = ""
        left -= 1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get((symbols[i], symbols[k]))) is not None:
                heapq.heappush(heap, (r, i))
        if (h := before[i]) >= 0 and (r := ranks.get((symbols[h], symbols[i]))) is not None:
            heapq.heappush(heap, (r, h))
    return left


class Counter:
    """Token counts of texts under a byte-level vocabulary file."""

    @staticmethod
    @cache
    def of(path: str) -> Counter:
        return Counter(path)

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        if not cuts_at_white_space(config) or config["model"].get("ignore_merges") or config["model"].get("unk_token"):
            raise ValueError(f"{path} is no lower-case byte-level vocabulary that cuts at white space")
        merges = [m.split(" ") if isinstance(m, str) else m for m in config["model"]["merges"]]
        self.ranks = {(a, b): i for i, (a, b) in enumerate(merges)}
        self.end = config["model"].get("end_of_word_suffix") or ""
        self.added = [t["content"] for t in config["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, self.added)) or r"(?!)")
        self.symbols = byte_symbols()
        self.pieces: dict[str, int] = {}
        self.chunks: dict[bytes, int] = {}

    def _piece(self, piece: str) -> int:
        if (known := self.pieces.get(piece)) is not None:
            return known
        symbols = [self.symbols[b] for b in piece.encode()]
        symbols[-1] += self.end
        n = merged_length(symbols, self.ranks)
        if len(piece) <= LONGEST:
            if len(self.pieces) >= REMEMBERED:
                self.pieces = trimmed(self.pieces)
            self.pieces[piece] = n
        return n

    def _chunk(self, chunk: bytes) -> int:
        text = chunk.decode("utf-8", "replace")
        if PLAIN.fullmatch(text) and not any(a[:2] in text for a in self.added):
            return sum(map(self._piece, PLAIN_PIECES.findall(text.lower())))
        n = len(self.special.findall(text))
        for part in self.special.split(text):
            part = "".join(c.lower() for c in unicodedata.normalize("NFC", part))
            n += sum(map(self._piece, ANY_PIECES.findall(part)))
        return n

    def count(self, text: bytes) -> int:
        if len(self.chunks) > REMEMBERED:
            self.chunks = trimmed(self.chunks)
        known, chunks = self.chunks, text.split()
        for c in {c for c in chunks if c not in known}:
            known[c] = self._chunk(c)
        n = sum(map(known.__getitem__, chunks))
        for c in [c for c in chunks if len(c) > LONGEST]:
            known.pop(c, None)
        return n


def token_counts(docs: DataFrame, tokenizer: str, key: str = "doc_id", limit: int = 2048) -> DataFrame:
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter.of(tokenizer)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([counter.count(t) for t in texts], pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    counted = docs.select(F.col(key).cast("bigint").alias("doc_id"), text_bytes()).mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
