"""Benchmark decontamination by a distributed positional inverted index.

The training rows are cut into shards of consecutive rows. A shard's row of the index holds, for each test
term that occurs in it, the sorted list of its positions; documents lie one after another in the shard's
position space, with one free position between them, so no phrase crosses documents. The index is a Parquet
table in the shared folder and is made once, whatever the size of the benchmark: up to MOST_TERMS distinct terms
are numbered and sent to the tasks, beyond that every word of the corpus is indexed under a 63-bit hash.

The test phrases go in blocks of BLOCK_CHARS characters of items, so that what the driver and the tasks hold of them is
bounded. A phrase is looked up shard by shard, without any shuffle: its terms are ordered by their count in the whole
corpus, the list of the rarest term gives the candidate starts, and the lists of the others, each shifted by its offset
in the phrase, are intersected with them in turn. With slop, the lists around each place of the rarest term give the
shortest runs that hold all terms of a phrase.

Defined cases: null or empty text has no words; an item without words is never found; an item with fewer words
than the window is one window; an item without an id marks words but is not among the items; items with equal windows
(ties) are all named; repeated rows give one result row each; a very long text is one shard; columns beside the key and
text are not touched, whatever their names; an empty table gives an empty result, an empty benchmark no hits.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavetable.llm.util import materialize, small_batches, text_bytes

#: Bytes of text in a shard (one document at least).
SHARD_BYTES = 4 << 20
#: Characters of benchmark items whose phrases are sent to the tasks at once (about 80 bytes of memory each); more goes in blocks.
BLOCK_CHARS = 1_000_000
#: Distinct terms of the benchmark that are numbered (about 120 bytes of memory each).
MOST_TERMS = 500_000

#: A-Z become a-z; every byte that is no ASCII letter, digit or part of a longer UTF-8 character parts words.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class Terms(dict):
    """Word to term number; -1 for words that no test item has."""

    def __missing__(self, key: bytes) -> int:
        return -1


class HashedTerms:
    """Every word has a number: a hash."""

    def __getitem__(self, key: bytes) -> int:
        return xxhash.xxh3_64_intdigest(key) >> 1


def terms_of(bench: DataFrame) -> Terms | HashedTerms:
    """The numbers of the benchmark's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(sorted({w for t in batch.column(0).to_pylist() for w in words_of(t)}), pa.binary())], ["word"])

    words = bench.select(text_bytes()).mapInArrow(run, "word binary").distinct()
    got = words.limit(MOST_TERMS + 1).collect()
    return Terms((bytes(x["word"]), i) for i, x in enumerate(got)) if len(got) <= MOST_TERMS else HashedTerms()


def _index_schema(kind: str) -> str:
    return f"shard bigint, doc_ids array<{kind}>, n_words array<int>, terms array<bigint>, counts array<bigint>, lists array<binary>"


def _shard(shard: int, ids: list, words: list[list[bytes]], terms: Terms | HashedTerms) -> dict:
    n = np.array([len(w) for w in words], np.int64)
    got = terms.__getitem__
    numbers = np.concatenate([np.fromiter(map(got, w), np.int64, len(w)) for w in words])
    at = np.arange(len(numbers)) + np.repeat(np.arange(len(n)), n)
    have = numbers >= 0
    numbers, at = numbers[have], at[have]
    if isinstance(terms, Terms) and len(terms) < 1 << 15:
        numbers = numbers.astype(np.int16)
    order = np.argsort(numbers, kind="stable")
    numbers, at = numbers[order], at[order].astype("<i4")
    first = np.flatnonzero(np.diff(numbers, prepend=-1))
    ends = np.append(first[1:], len(numbers))
    return {"shard": shard, "doc_ids": ids, "n_words": n.tolist(), "terms": numbers[first].tolist(), "counts": (ends - first).tolist(), "lists": [at[a:b].tobytes() for a, b in zip(first, ends)]}


def _key(docs: DataFrame, key: str) -> tuple[Column, str]:
    """The key column as a string if it is one, else as a bigint."""
    kind = "string" if dict(docs.dtypes)[key] == "string" else "bigint"
    return F.col(key).cast(kind).alias("key"), kind


def build_index(docs: DataFrame, terms, key: str = "doc_id") -> DataFrame:
    """One row for each shard. terms: broadcast Terms or HashedTerms; words without a number get no lists, as no test phrase reads them."""
    small_batches(docs.sparkSession)
    column, kind = _key(docs, key)
    own = {"string": pa.string(), "bigint": pa.int64()}[kind]
    schema = pa.schema([("shard", pa.int64()), ("doc_ids", pa.list_(own)), ("n_words", pa.list_(pa.int32())), ("terms", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("lists", pa.list_(pa.binary()))])

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = terms.value
        shard, ids, words, size = None, [], [], 0
        for batch in batches:
            for row, key_, text in zip(*(c.to_pylist() for c in batch.columns)):
                shard = row if shard is None else shard
                ids.append(key_)
                words.append(words_of(text))
                size += len(text)
                if size >= SHARD_BYTES:
                    yield pa.RecordBatch.from_pylist([_shard(shard, ids, words, known)], schema)
                    shard, ids, words, size = None, [], [], 0
        if ids:
            yield pa.RecordBatch.from_pylist([_shard(shard, ids, words, known)], schema)

    return docs.select(F.monotonically_increasing_id().alias("row"), column, text_bytes()).mapInArrow(shards, _index_schema(kind))


def _lists(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, int, list, dict[int, bytes]]]:
    for x in batch.to_pylist():
        n = np.array(x["n_words"], np.int64)
        starts = np.concatenate([[0], np.cumsum(n + 1)[:-1]]) if len(n) else n
        yield n, starts, x["shard"], x["doc_ids"], dict(zip(x["terms"], x["lists"]))


def _phrase(parts: list[tuple[int, int]], lists: dict[int, bytes]) -> np.ndarray:
    """Start positions of a phrase; parts: (term, offset), the rarest term first."""
    found = None
    for term, offset in parts:
        if (raw := lists.get(term)) is None:
            return np.empty(0, np.int32)
        own = np.frombuffer(raw, "<i4")
        if found is None:
            found = own - offset
            continue
        want = found + offset
        found = found[own[np.minimum(np.searchsorted(own, want), len(own) - 1)] == want]
        if not len(found):
            break
    return found


def _near(parts: list[tuple[int, int]], span: int, lists: dict[int, bytes]) -> list[tuple[int, int]]:
    """(first, last) of the shortest runs, of span words at most, that hold every term of the phrase as often as it does."""
    need: dict[int, int] = defaultdict(int)
    for term, _ in parts:
        need[term] += 1
    if any(t not in lists for t in need):
        return []
    own = {t: np.frombuffer(lists[t], "<i4") for t in need}
    found = set()
    for p in own[parts[0][0]].tolist():
        near = sorted((int(x), t) for t, a in own.items() for x in a[np.searchsorted(a, p - span + 1) : np.searchsorted(a, p + span)])
        have: dict[int, int] = defaultdict(int)
        lacking, left = len(need), 0
        for at, t in near:
            have[t] += 1
            lacking -= have[t] == need[t]
            while not lacking:
                first, u = near[left]
                if have[u] == need[u]:
                    if at - first < span:
                        found.add((first, at))
                    lacking += 1
                have[u] -= 1
                left += 1
    return sorted(found)


def _phrases(items: list, window: int, terms: Terms | HashedTerms) -> dict[tuple[int, ...], list[int]]:
    phrases = defaultdict(set)
    for item in items:
        numbers = [terms[w] for w in words_of((item["text"] or "").encode())]
        n = min(window, len(numbers))
        for i in range(len(numbers) - n + 1 if n else 0):
            phrases[tuple(numbers[i : i + n])].add(item["item_id"])
    return {p: sorted(x for x in own if x is not None) for p, own in phrases.items()}


def _blocks(bench: DataFrame, block_chars: int) -> list[DataFrame]:
    chars = bench.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-int(chars) // block_chars) or 1
    return [bench.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b) if n > 1 else bench for b in range(n)]


def _ordered(counts: DataFrame, phrases: dict[tuple[int, ...], list[int]]) -> dict[int, list[tuple[list[tuple[int, int]], int, list[int]]]]:
    """By rarest term: the phrase's (term, offset) from its rarest term on, its length, its items. counts: term, n of the corpus."""
    asked = counts.sparkSession.createDataFrame([(t,) for t in sorted({t for p in phrases for t in p})], "term bigint")
    known = dict(counts.join(asked, "term").select("term", "n").collect())  # a row for each term of the block at most
    by = defaultdict(list)
    for phrase, items in phrases.items():
        parts = sorted(((t, i) for i, t in enumerate(phrase)), key=lambda x: (known.get(x[0], 0), x))
        if parts[0][0] in known:
            by[parts[0][0]].append((parts, len(phrase), items))
    return dict(by)


def _search(index: DataFrame, by, slop: int) -> DataFrame:
    """shard, place (of the row in its shard), doc_id, n_words, spans, items."""
    kind = index.schema["doc_ids"].dataType.elementType.simpleString()
    own = {"string": pa.string(), "bigint": pa.int64()}[kind]
    span = pa.struct([("first", pa.int64()), ("last", pa.int64())])
    schema = pa.schema([("shard", pa.int64()), ("place", pa.int64()), ("doc_id", own), ("n_words", pa.int64()), ("spans", pa.list_(span)), ("items", pa.list_(pa.int64()))])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = by.value
        for batch in batches:
            for n, starts, shard, ids, lists in _lists(batch):
                hits: dict[int, list] = defaultdict(list)
                items: dict[int, set] = defaultdict(set)
                for rarest in lists.keys() & phrases.keys():
                    for parts, length, own in phrases[rarest]:
                        if slop:
                            found = _near(parts, length + slop, lists)
                        else:
                            found = [(a, a + length - 1) for a in _phrase(parts, lists).tolist()]
                        for first, last in found:
                            doc = int(np.searchsorted(starts, first, "right")) - 1
                            if last < starts[doc] + n[doc]:
                                hits[doc].append((first - int(starts[doc]), last - int(starts[doc])))
                                items[doc].update(own)
                spans = []
                for doc in range(len(ids)):
                    merged: list[list[int]] = []
                    for a, b in sorted(hits.get(doc, ())):
                        if merged and a <= merged[-1][1] + 1:
                            merged[-1][1] = max(b, merged[-1][1])
                        else:
                            merged.append([a, b])
                    spans.append([{"first": a, "last": b} for a, b in merged])
                places = range(len(ids))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(([shard] * len(ids), places, ids, n, spans, [sorted(items.get(d, ())) for d in places]), schema)], schema=schema)

    return index.mapInArrow(look, f"shard bigint, place bigint, doc_id {kind}, n_words bigint, spans array<struct<first:bigint,last:bigint>>, items array<bigint>")


def find_contamination(docs: DataFrame, bench: DataFrame, window: int = 10, slop: int = 0, key: str = "doc_id", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Per row of docs: doc_id, n_words, spans (merged runs of hit words, by word number, both ends included), items found.

    slop 0: exact phrases; more: runs of at most window + slop words that hold all words of a window in any order.
    """
    spark, parts = docs.sparkSession, []
    bench = bench.select("item_id", "text")
    terms = terms_of(bench)
    index = materialize(build_index(docs, spark.sparkContext.broadcast(terms), key), "postings")
    counts = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.counts").alias("n"))
    blocks = _blocks(bench, block_chars)
    counts = materialize(counts, "term-counts") if len(blocks) > 1 else counts
    for block in blocks:
        phrases = _phrases(block.collect(), window, terms)  # block_chars bounds what is collected
        parts.append(_search(index, spark.sparkContext.broadcast(_ordered(counts, phrases)), slop))
    if len(parts) == 1:
        return parts[0].drop("shard", "place")
    found = reduce(DataFrame.unionByName, parts).groupBy("shard", "place")
    found = found.agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.sort_array(F.flatten(F.collect_list("spans"))).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    joined = """aggregate(s, cast(array() as array<struct<first:bigint,last:bigint>>), (a, x) ->
        case when size(a) > 0 and x.first <= element_at(a, -1).last + 1
             then concat(slice(a, 1, size(a) - 1), array(named_struct('first', element_at(a, -1).first, 'last', greatest(element_at(a, -1).last, x.last))))
             else concat(a, array(x)) end)"""
    return found.select("doc_id", "n_words", F.expr(joined).alias("spans"), "items")


def contamination_report(docs: DataFrame, bench: DataFrame, window: int = 10) -> DataFrame:
    found = find_contamination(docs, bench, window)
    hit = F.expr("aggregate(spans, 0L, (a, x) -> a + x.last - x.first + 1)")
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )
