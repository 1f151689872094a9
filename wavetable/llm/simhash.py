"""SimHash near-duplicates through a Gray-ordered hierarchical index.

Fingerprints are made row by row. Distinct fingerprints are then dealt out by shared bit patterns: a node of the
index is a mask with the bits that its members have there. The nodes right under the root have one of radius + 1
equal parts of the bits as mask; two fingerprints that differ in radius bits at most agree on one of the parts, so each
lies in radius + 1 nodes. A node with more members than NODE_ROWS is split likewise by parts of its remaining bits. At
radius 2 that goes on until few bits are left, which few distinct members can have; at wider radii, after LEVELS levels,
what is still large is dealt out in pairs of blocks. Inside a node the members are sorted by Gray rank and grouped in
eights, eights of eights and so on; each group keeps the bits that all of its members share. Two groups are compared by
their shared bits; as soon as the differences pass the radius all pairs of their members are out. What is left is
compared in full.

A node gives no pairs but a spanning forest of its links, so that very large groups of close fingerprints give one
row for each member; connected components of these rows are the components of all links.

`near_duplicates` links by one fingerprint of shingles. `similar_rows` is for whole corpora, where texts are linked if the
cosine of their sets of shingles is the similarity asked for, or above. Two indexes hold independent fingerprints of
the words, weighed by the logarithm of their number, which few edits move little (WORD_RADIUS). Of the pairs that one of them finds,
those whose 512-bit fingerprints of the shingles allow the similarity (DEVIATIONS) tie groups together. A group is dealt out in
blocks of BLOCK_BYTES. Each pair of blocks meets in one task, where pairs as the above, CHUNK at a time and of these the closest first, are counted
out by the hashes of their shingles unless links tie them already; no pair below the similarity is a link.

Defined cases: null and empty texts have no words and fingerprint zero, which links like any other; fewer words
than a shingle make one shingle; very long texts are hashed whole; repeated rows give repeated results; columns besides
the key and text are not looked at, whatever their names (similar_rows tells rows apart by all of them); an empty table
gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavetable.llm.components import connected_components
from wavetable.llm.util import materialize, small_batches, text_bytes

SHINGLE = 3
RADIUS = 2
SEED = 42
#: Members of a node that one task compares; larger nodes are split by more masked bits.
NODE_ROWS = 2048
#: The same where pairs are confirmed by a second fingerprint, and the levels of masks there.
WIDE_ROWS, LEVELS = 16_384, 2
#: Bits by which one of the two 64-bit fingerprints of the words of similar texts may differ.
WORD_RADIUS = 7
#: Standard deviations around the differing bits that a similarity gives on average; within them a pair is doubtful.
DEVIATIONS = 3
#: Bytes of shingle hashes in one block of a group that is counted out.
BLOCK_BYTES = 2 << 20
#: Members of the lowest groups in a node, and groups of each upper group.
FANOUT = 8
#: Pairs of groups, and of members, that are compared at once (a few hundred bytes of memory each).
CHUNK = 1 << 16

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        first = np.concatenate([[0], ends[:-shingle]]).tolist()
        last = (ends[shingle - 1 :] - 1).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(first, last)]
    return int.from_bytes(_majority(np.array(hashes, np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8)), "big")


def _majority(hashes: np.ndarray, weights: np.ndarray | None = None) -> bytes:
    """The bits that are set in over half of the rows of bytes, or of the weight of all rows."""
    ones = np.zeros(8 * hashes.shape[1], np.int64)
    for a in range(0, len(hashes), 255):  # as many ones as a byte counts
        bits = np.unpackbits(hashes[a : a + 255], axis=1)
        ones += bits.sum(axis=0, dtype=np.uint8) if weights is None else weights[a : a + 255] @ bits
    return np.packbits(2 * ones > (len(hashes) if weights is None else weights.sum())).tobytes()


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """The hashes of the distinct shingles in order, none without words."""
    words = text.translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    first = np.concatenate([[0], ends[: max(0, len(words) - shingle)]]).tolist()
    last = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh3_64_intdigest
    return np.unique(np.array([digest(joined[a:b]) for a, b in zip(first, last)], np.uint64))


def _widened(hashes: np.ndarray) -> np.ndarray:
    """Rows of 64 bytes: eight numbers that splitmix64 draws from each hash."""
    x = hashes[:, None] + np.arange(1, 9, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))).view(np.uint8)


def text_fingerprints(text: bytes, shingles: np.ndarray) -> tuple[bytes, bytes]:
    """Of the words, twice 8 bytes, where a word that occurs n times weighs as much as n has binary digits; of the distinct shingles, 64 bytes. No words: zeros."""
    words = text.translate(LOWER).split()
    if not words:
        return bytes(16), bytes(64)
    times = Counter(words)
    of_words = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, times)), np.uint8).reshape(-1, 16)
    return _majority(of_words, np.array([n.bit_length() for n in times.values()])), _majority(_widened(shingles))


def doubtful_bits(similarity: float) -> tuple[int, int]:
    """Differing bits of 512 up to which a pair may have the similarity; and of the first 128, at twice the deviations."""
    p = np.arccos(similarity) / np.pi
    spread = DEVIATIONS * np.sqrt(512 * p * (1 - p))
    return int(np.ceil(512 * p + spread)), int(np.ceil(128 * p + spread))


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether sets as of shingle_set have the cosine."""
    return len(np.intersect1d(a, b, assume_unique=True)) >= similarity * np.sqrt(float(len(a)) * len(b)) - 1e-9


def fingerprints(docs: DataFrame, key: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp has the fingerprint's bits as a bigint."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(key).cast("bigint").alias("doc_id"), text_bytes()).mapInArrow(run, "doc_id bigint, fp bigint")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the binary reflected Gray order."""
    out = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


def _expand(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of n things: the run of each, and its place in it."""
    run = np.repeat(np.arange(len(n)), n)
    return run, np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)


def _levels(codes: np.ndarray, bounds: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """From the root of each node down: (bits that all members have, bits that any has, first child, number of children)."""
    levels = [(codes, codes, np.arange(len(codes)), np.zeros(len(codes), np.int64))]
    sizes = np.diff(bounds)
    while sizes.max() > 1:
        group, _ = _expand(-(-sizes // FANOUT))
        _, place = _expand(-(-sizes // FANOUT))
        first = (np.cumsum(sizes) - sizes)[group] + place * FANOUT
        number = np.minimum(FANOUT, sizes[group] - place * FANOUT)
        every, some = levels[-1][:2]
        levels.append((np.bitwise_and.reduceat(every, first), np.bitwise_or.reduceat(some, first), first, number))
        sizes = -(-sizes // FANOUT)
    return levels[::-1]


def pair_parts(codes: np.ndarray, bounds: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places i < j of codes in the same run (bounds: ends of runs, from 0 on) that differ in radius bits at most, in parts; each run is in Gray order."""
    levels = _levels(codes, bounds)
    roots = np.arange(len(levels[0][0]))
    if len(levels) == 1:
        return
    # the members of each lowest group side by side, the last one again where a group is not full
    _, _, first, number = levels[-2]
    member = first[:, None] + np.minimum(np.arange(FANOUT), number[:, None] - 1)
    block = codes[member]
    work = [(0, roots, roots)]
    while work:
        depth, a, b = work.pop()
        _, _, first, number = levels[depth]
        lowest = depth == len(levels) - 2
        if (total := FANOUT * FANOUT * len(a) if lowest else int((number[a] * number[b]).sum())) > CHUNK and len(a) > 1:
            half = len(a) // 2
            work += [(depth, a[:half], b[:half]), (depth, a[half:], b[half:])]
            continue
        if lowest:
            pair, x, y = np.nonzero(np.bitwise_count(block[a][:, :, None] ^ block[b][:, None, :]) <= radius)
            real = (x < number[a[pair]]) & (y < number[b[pair]])
            x, y = member[a[pair[real]], x[real]], member[b[pair[real]], y[real]]
            if (x < y).any():
                yield x[x < y], y[x < y]
            continue
        pair, place = _expand(number[a] * number[b])
        x = first[a[pair]] + place // number[b[pair]]
        y = first[b[pair]] + place % number[b[pair]]
        ordered = x <= y
        x, y = x[ordered], y[ordered]
        every, some = levels[depth + 1][:2]
        sure = (every[x] & ~some[y]) | (every[y] & ~some[x])
        near = np.bitwise_count(sure) <= radius
        if near.any():
            work.append((depth + 1, x[near], y[near]))


def close_pairs(codes: np.ndarray, bounds: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """All of pair_parts at once."""
    a, b = zip((np.empty(0, np.int64), np.empty(0, np.int64)), *pair_parts(codes, bounds, radius))
    return np.concatenate(a), np.concatenate(b)


def forest(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """For each of n things the smallest one that pairs (a, b), and those that label comes from, lead to."""
    label = np.arange(n) if label is None else label
    while len(a):
        least = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, before[a], least)
        np.minimum.at(label, before[b], least)
        while not np.array_equal(label, jumped := label[label]):
            label = jumped
        if np.array_equal(label, before):
            break
    return label


def parts_of(bits: list[int], n: int) -> list[list[int]]:
    return [bits[len(bits) * i // n : len(bits) * (i + 1) // n] for i in range(n)]


def _mask(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >> 63 else value


NODE = ["mask", "bits", "i", "j"]


#: The 512 bits of a fingerprint of shingles.
WIDE = [f"c{i}" for i in range(8)]


def _bits(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of the columns of x and y."""
    return sum(np.bitwise_count((a ^ b).view(np.uint64)).astype(np.int64) for a, b in zip(x, y))


def _maybe(wide: np.ndarray, a: np.ndarray, b: np.ndarray, limits: tuple[int, int]) -> np.ndarray:
    """Places of the pairs that may be similar; most others go by their first bits."""
    may, few = limits
    near = np.flatnonzero(_bits(wide[:2, a], wide[:2, b]) <= few)
    return near[_bits(wide[:, a[near]], wide[:, b[near]]) <= may]


def _node_links(nodes: DataFrame, radius: int, limits: tuple[int, int] | None) -> DataFrame:
    """(u, v) for a spanning forest of the links inside each node; nodes: NODE, fp, rep, and WIDE where limits, as of doubtful_bits, leave pairs out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def changes(rows: np.ndarray) -> np.ndarray:
            return np.flatnonzero((rows[: len(NODE), 1:] != rows[: len(NODE), :-1]).any(axis=0)) + 1

        def links(rows: np.ndarray) -> pa.RecordBatch:
            bounds = np.concatenate([[0], changes(rows), [rows.shape[1]]])
            codes = rows[len(NODE)].view(np.uint64)
            order = np.lexsort((gray_rank(codes), np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))))
            codes, reps, wide = codes[order], rows[len(NODE) + 1][order], rows[len(NODE) + 2 :][:, order]
            root = np.arange(len(codes))
            for a, b in pair_parts(codes, bounds, radius):
                if limits:
                    new = root[a] != root[b]
                    a, b = a[new], b[new]
                    near = _maybe(wide, a, b, limits)
                    a, b = a[near], b[near]
                root = forest(len(codes), a, b, root)
            tied = np.flatnonzero(root != np.arange(len(codes)))
            return pa.RecordBatch.from_arrays([pa.array(reps[tied]), pa.array(reps[root[tied]])], ["u", "v"])

        for batch in batches:
            held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]))
            if sum(x.shape[1] for x in held) < 1 << 14:
                continue
            rows = np.concatenate(held, axis=1)
            held = [rows]
            if len(change := changes(rows)):  # the last node may go on in the next batch
                yield links(rows[:, : change[-1]])
                held = [rows[:, change[-1] :]]
        if held and sum(x.shape[1] for x in held):
            yield links(np.concatenate(held, axis=1))

    dealt = nodes.repartition(*NODE).sortWithinPartitions(*NODE)
    return dealt.mapInArrow(run, "u bigint, v bigint")


def _children(radius: int, node_rows: int, levels: int) -> dict[int, list[int]]:
    """Each mask of the index that is split, the root's included, with the masks right under it."""
    found, work = {}, [(0, [])]
    while work:
        depth, used = work.pop()
        free = [b for b in range(64) if b not in used]
        if 1 << len(free) > node_rows and depth < levels:
            below = [used + part for part in parts_of(free, radius + 1)]
            found[_mask(used)] = [_mask(m) for m in below]
            work += [(depth + 1, m) for m in below]
    return found


def link_forest(codes: DataFrame, node_rows: int = NODE_ROWS, radius: int = RADIUS, levels: int = 64, limits: tuple[int, int] | None = None) -> DataFrame:
    """codes: distinct (fp, rep). Rows (u, v) of representatives that connect whatever links of codes connect.

    With limits, as of doubtful_bits, codes have WIDE too, and only pairs within the limits are links.
    """
    below = _children(radius, node_rows, levels)
    inner = {m: own for m, own in below.items() if m}
    own = ["fp", "rep", *(WIDE if limits else [])]

    def spread(rows: DataFrame, masks) -> DataFrame:
        return rows.select(F.explode(masks).alias("mask"), *own).select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("bits"), *own)

    def in_blocks(rows: DataFrame, sizes: DataFrame | None) -> DataFrame:
        """Nodes above node_rows that have no masks under them are dealt out in pairs of blocks (i, j), i <= j, each member to all pairs of its block."""
        if sizes is None:
            return rows.select("mask", "bits", F.lit(0).alias("i"), F.lit(0).alias("j"), *own)
        lot, n = F.pmod(F.xxhash64("rep"), F.col("n")).cast("int"), F.coalesce("n", F.lit(1))
        dealt = rows.join(sizes, ["mask", "bits"], "left").select("mask", "bits", F.coalesce(lot, F.lit(0)).alias("own"), F.explode(F.sequence(F.lit(0), n - 1)).alias("other"), *own)
        return dealt.select("mask", "bits", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), *own)

    now = spread(codes, F.array(*[F.lit(m) for m in below[0]]))
    deeper = F.create_map(*[x for m, under in inner.items() for x in (F.lit(m), F.array(*[F.lit(k) for k in under]))]) if inner else None
    links = None
    while True:
        large = materialize(now.groupBy("mask", "bits").count().filter(F.col("count") > node_rows), "large-nodes")
        split = large.filter(F.col("mask").isin(*inner)).select("mask", "bits")
        last = large.filter(~F.col("mask").isin(*inner)).select("mask", "bits", F.ceil(F.col("count") / node_rows).cast("int").alias("n"))
        some_split = bool(split.take(1))
        part = now.join(split, ["mask", "bits"], "left_anti") if some_split else now
        part = _node_links(in_blocks(part, last if last.take(1) else None), radius, limits)
        links = part if links is None else links.unionByName(part)
        if not some_split:
            return links
        now = materialize(spread(now.join(split, ["mask", "bits"], "left_semi"), deeper[F.col("mask")]), "nodes")


def near_duplicates(docs: DataFrame, key: str = "doc_id", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hexadecimal digits), component_id (smallest id that links lead to).

    A row without an id keeps its fingerprint, links with nothing and has no component.
    """
    fp = materialize(fingerprints(docs, key, shingle), "fingerprints")
    codes = materialize(fp.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "codes")
    tied = connected_components(link_forest(codes, radius=radius))
    groups = codes.join(tied, F.col("rep") == F.col("vertex"), "left").select("fp", F.coalesce("component", "rep").alias("component"))
    groups = materialize(groups, "groups")
    return fp.join(groups, "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id")
    )


#: What a block has of each member beside the shingles, and what a member counts for it.
PRINTS, MEMBER_BYTES = ["w1", "w2", *WIDE], 1024


def _sets(docs: DataFrame, row: str, wanted: DataFrame, shingle: int) -> DataFrame:
    """(rep, grams): the shingle_set of each wanted (row, rep), as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = [shingle_set(t, shingle).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(grams, pa.binary())], ["rep", "grams"])

    texts = docs.select(F.col(row).cast("string").alias("row"), text_bytes().alias("text")).join(wanted, "row").select("rep", "text")
    # a row that repeats gives one set, in each task first
    return texts.mapInArrow(run, "rep bigint, grams binary").groupBy("rep").agg(F.first("grams").alias("grams"))


def _block_links(reps: np.ndarray, own: np.ndarray, prints: np.ndarray, grams: list[np.ndarray], i: int, j: int, similarity: float) -> list[tuple[int, int]]:
    """Links between the members of block i and those of block j that tie together all that links there tie."""
    root = list(range(len(reps)))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
    words, wide, limits, links = prints[:2], prints[2:], doubtful_bits(similarity), []
    step = max(1, CHUNK // max(1, len(right)))
    for at in range(0, len(left), step):
        some, tops = left[at : at + step], np.array([top(x) for x in range(len(root))])
        a, b = np.repeat(some, len(right)), np.tile(right, len(some))
        new = tops[a] != tops[b]
        if i == j:
            new &= a < b
        a, b = a[new], b[new]
        near = np.minimum(_bits(words[:1, a], words[:1, b]), _bits(words[1:, a], words[1:, b])) <= WORD_RADIUS
        a, b = a[near], b[near]
        near = _maybe(wide, a, b, limits)
        a, b = a[near], b[near]
        closest = np.argsort(_bits(wide[:, a], wide[:, b]), kind="stable")
        for a, b in zip(a[closest].tolist(), b[closest].tolist()):
            if (x := top(a)) != (y := top(b)) and alike(grams[a], grams[b], similarity):
                root[x] = y
                links.append((int(reps[a]), int(reps[b])))
    return links


def _confirmed(pairs: DataFrame, docs: DataFrame, row: str, codes: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(u, v) of links by count inside what the pairs (u, v) tie together."""
    around = connected_components(pairs)
    members = codes.join(around, F.col("rep") == F.col("vertex")).select("rep", "component", "grams", F.col("first.row").alias("row"), *PRINTS)
    sizes = members.groupBy("component").agg(F.least(F.ceil(F.sum(F.col("grams") * 8 + MEMBER_BYTES) / BLOCK_BYTES), F.count("*")).cast("int").alias("n"))
    members = materialize(members.drop("grams").join(sizes, "component"), "members")
    dealt = members.drop("row").join(_sets(docs, row, members.select("row", "rep"), shingle), "rep")
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("n")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    key = ["component", "i", "j"]
    dealt = dealt.select("component", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), "rep", "own", *PRINTS, "grams")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def links() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                numbers = np.array([x[:-1] for x in held], np.int64).T
                found = _block_links(numbers[0], numbers[1], numbers[2:], [np.frombuffer(x[-1], np.uint64) for x in held], *now[1:], similarity)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["u", "v"])

        for batch in batches:
            for component, i, j, *member in zip(*(c.to_pylist() for c in batch.columns)):
                if (component, i, j) != now:
                    yield from links()
                    now, held = (component, i, j), []
                held.append(member)
        yield from links()

    return dealt.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "u bigint, v bigint")


def _similar_groups(docs: DataFrame, row: str, key: str, shingle: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """All rows with the digest of their shingles; and of each distinct one its component and first row, as (no id, id, row)."""
    small_batches(docs.sparkSession)
    names = ["row", "id", "s1", "s2", "grams", "w1", "w2", *WIDE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, grams = [], []
            for text in batch.column(2).to_pylist():
                own = shingle_set(text, shingle)
                words, wide = text_fingerprints(text, own)
                grams.append(len(own))
                prints.append(xxhash.xxh3_128_digest(own.tobytes()) + words + wide)
            found = np.frombuffer(b"".join(prints), "<i8").reshape(-1, 12)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(found[:, i]) for i in (0, 1)), pa.array(grams, pa.int64()), *(pa.array(found[:, i]) for i in range(2, 12))], names)

    rows = docs.select(F.col(row).cast("string").alias("row"), F.col(key).cast("bigint").alias("id"), text_bytes())
    rows = materialize(rows.mapInArrow(run, "row string, " + ", ".join(f"{c} bigint" for c in names[1:])), "fingerprints")
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row", "w1", "w2")).alias("first")
    same = [F.any_value(c).alias(c) for c in ("grams", *WIDE)]  # functions of the set of shingles
    codes = rows.groupBy("s1", "s2").agg(first, *same).select("*", "first.w1", "first.w2", F.monotonically_increasing_id().alias("rep"))
    codes = materialize(codes, "codes")
    limits = doubtful_bits(similarity)
    found = [link_forest(codes.select(F.col(w).alias("fp"), "rep", *WIDE), WIDE_ROWS, WORD_RADIUS, LEVELS, limits) for w in ("w1", "w2")]
    pairs = materialize(found[0].unionByName(found[1]), "pairs")
    tied = connected_components(_confirmed(pairs, docs, row, codes, shingle, similarity))
    return rows, codes.join(tied, F.col("rep") == F.col("vertex"), "left").withColumn("component", F.coalesce("component", "rep"))


def first_rows(docs: DataFrame, row: str, key: str = "doc_id", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(row) of each group of similar texts the row that comes first, by key (rows without one last), then by row.

    row: a column that tells rows apart; repeated values are one row. Similarity is the cosine of the sets of distinct shingles.
    """
    _, codes = _similar_groups(docs, row, key, shingle, similarity)
    return codes.groupBy("component").agg(F.min("first").alias("f")).select(F.col("f.row").alias("row"))


def similar_rows(docs: DataFrame, row: str, key: str = "doc_id", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(row, first): the distinct rows with the first one of their group; as in first_rows."""
    rows, codes = _similar_groups(docs, row, key, shingle, similarity)
    codes = materialize(codes.select("s1", "s2", "component", "first"), "named")
    firsts = codes.groupBy("component").agg(F.min("first").alias("f")).select("component", F.col("f.row").alias("first"))
    groups = codes.drop("first").join(firsts, "component").drop("component")
    return rows.join(groups, ["s1", "s2"]).select("row", "first").distinct()
