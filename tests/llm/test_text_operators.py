"""Operators over documents against brute force, and their defined cases."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from wavetable.llm import components, decontam, langid, packing, simhash, tokencount, toxicity
from wavetable.llm.queries import tokenizer_path
from wavetable.llm.util import table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

#: Nulls, empty and odd texts, ties and repeated rows; the last column has a name that operators use inside.
ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, "!!! ... ###"), (5, "One"), (6, "two words"), (7, "Éa éa 日本語 straße"), (7, "Éa éa 日本語 straße"), (8, "x" * 30_000), (9, "the end " * 4000), (10, "a<|endoftext|>b it's 12 ok")]


def odd_docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", 0, i) for i, t in ODD], "doc_id long, text string, lang string, source string, n_chars long, row long")


def empty_docs(spark):
    return odd_docs(spark).limit(0)


def text_rows(spark, sf):
    return [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]


# decontamination


def brute_contamination(docs, items, window=10):
    words = lambda t: WORD.findall((t or "").translate(LOWER))
    grams = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for a in range(len(w) - n + 1 if n else 0):
            grams[tuple(w[a : a + n])].add(i)
    sizes = {len(g) for g in grams}
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                if own := grams.get(tuple(w[a : a + n])):
                    hit.update(range(a, a + n))
                    found |= own
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def reported(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect())


def test_contamination_is_that_of_brute_force(spark, sf):
    docs, bench = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    want = brute_contamination(text_rows(spark, sf), [(r["item_id"], r["text"]) for r in bench.collect()])
    assert reported(decontam.contamination_report(docs, bench)) == want and any(x[5] for x in want)


def test_contamination_odd_cases(spark):
    items = [(1, None), (2, ""), (3, "ONE"), (4, "end the end"), (5, "end the end"), (6, "éa É straße")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert reported(decontam.contamination_report(odd_docs(spark), bench)) == brute_contamination(ODD, items)
    assert decontam.contamination_report(empty_docs(spark), bench).count() == 0
    assert not any(x[5] for x in reported(decontam.contamination_report(odd_docs(spark), bench.limit(0))))


@pytest.mark.parametrize("most_terms", [500_000, 3])
def test_contamination_in_blocks(spark, monkeypatch, most_terms):
    monkeypatch.setattr(decontam, "MOST_TERMS", most_terms)
    rng = random.Random(1)
    words = [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 400)))) for i in range(60)]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 5)))) for i in range(25)] + [(99, docs[7][1])]
    monkeypatch.setattr(decontam, "SHARD_BYTES", 2000)
    found = decontam.find_contamination(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), window=3, block_chars=150)
    want = {d: (w, h, n) for d, w, h, n, _, _ in brute_contamination(docs, items, 3)}
    got = {r["doc_id"]: (r["n_words"], sum(s["last"] - s["first"] + 1 for s in r["spans"]), len(r["items"])) for r in found.collect()}
    assert got == want


def test_contamination_of_rows_without_ids(spark):
    """String keys are carried as they are; an item without an id marks words and is not among the items."""
    docs = spark.createDataFrame([("a", "one two three"), ("b", "four"), (None, "one two three"), ("a", "five")], "name string, text string")
    items = spark.createDataFrame([(None, "one two"), (3, "five")], "item_id long, text string")
    got = sorted([(r["doc_id"], r["items"], [(s["first"], s["last"]) for s in r["spans"]]) for r in decontam.find_contamination(docs, items, key="name").collect()], key=str)
    assert got == sorted([("a", [], [(0, 1)]), ("b", [], []), (None, [], [(0, 1)]), ("a", [3], [(0, 0)])], key=str)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x beta y gamma"), (2, "gamma beta alpha"), (3, "alpha x x x beta x gamma"), (4, "alpha beta")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    near = {r["doc_id"]: [(s["first"], s["last"]) for s in r["spans"]] for r in decontam.find_contamination(docs, items, slop=2).collect()}
    assert near == {1: [(0, 4)], 2: [(0, 2)], 3: [], 4: []}


# SimHash


def brute_fingerprint(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if x]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 3 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, linked):
    label = {i: i for i in ids}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        label[b] = a
    return {i: find(i) for i in ids}


def test_groups_are_those_of_brute_force(spark, sf):
    rows = text_rows(spark, sf)
    fp = {d: brute_fingerprint(t) for d, t in rows}
    ids = sorted(fp)
    want = brute_components(ids, [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (fp[a] ^ fp[b]).bit_count() <= 2])
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(table(spark, sf, "documents")).collect()}
    assert got == {d: (f"{fp[d]:016x}", want[d]) for d in ids} and len(set(want.values())) < len(ids)


def test_simhash_odd_cases(spark):
    got = simhash.near_duplicates(odd_docs(spark)).collect()
    assert {(r["doc_id"], r["fingerprint"]) for r in got} == {(d, f"{brute_fingerprint(t):016x}") for d, t in ODD} and len(got) == len(ODD)
    assert {r["component_id"] for r in got if r["doc_id"] in (1, 2, 3)} == {1}
    assert simhash.near_duplicates(empty_docs(spark)).count() == 0
    none = simhash.near_duplicates(spark.createDataFrame([(None, "a b c d"), (3, "a b c d")], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in none) == [(0, 0), (3, 3)]


def test_hot_nodes_are_split_and_lose_nothing(spark):
    rng = random.Random(0)
    base = [rng.getrandbits(64) for _ in range(3)]
    codes = {base[0] ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 5))) for _ in range(500)} | {base[1] ^ (1 << b) for b in range(64)} | {rng.getrandbits(64) for _ in range(300)} | set(base)
    codes = sorted(codes)
    want = brute_components(range(len(codes)), [(i, j) for i in range(len(codes)) for j in range(i + 1, len(codes)) if (codes[i] ^ codes[j]).bit_count() <= 2])
    signed = [(c - (1 << 64) if c >> 63 else c, i) for i, c in enumerate(codes)]
    for limit in (16, 2048):
        edges = simhash.link_forest(spark.createDataFrame(signed, "fp long, rep long"), limit)
        tied = {r["vertex"]: r["component"] for r in components.connected_components(edges).collect()}
        assert {i: tied.get(i, i) for i in want} == want


def test_close_pairs(spark):
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 1 << 12, 700).astype(np.uint64)
    codes = np.unique(codes)
    codes = codes[np.argsort(simhash.gray_rank(codes))]
    bounds = np.array([0, 1, 40, len(codes)])
    a, b = simhash.close_pairs(codes, bounds)
    group = np.searchsorted(bounds, np.arange(len(codes)), "right")
    want = {(i, j) for i in range(len(codes)) for j in range(i + 1, len(codes)) if group[i] == group[j] and int(codes[i] ^ codes[j]).bit_count() <= 2}
    assert set(zip(a.tolist(), b.tolist())) == want and len(a) == len(want)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.random()}"
    return words


@pytest.mark.parametrize(("node_rows", "levels", "block"), [(16_384, 2, 2 << 20), (16, 2, 4096), (16, 1, 1024)])
def test_similar_rows_are_those_of_all_pairs(spark, monkeypatch, node_rows, levels, block):
    from tests.llm.test_other_operators import brute_first

    monkeypatch.setattr(simhash, "WIDE_ROWS", node_rows)
    monkeypatch.setattr(simhash, "LEVELS", levels)
    monkeypatch.setattr(simhash, "BLOCK_BYTES", block)
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(3000)]
    bases = [rng.choices(vocabulary, k=150) for _ in range(12)]
    texts = [" ".join(edited(rng, rng.choice(bases), rng.randrange(0, 6))) for _ in range(160)] + [" ".join(rng.choices(vocabulary, k=100)) for _ in range(60)] + ["", "short one", None, "short one"]
    docs = spark.createDataFrame([(i, t, str(i)) for i, t in enumerate(texts)], "doc_id long, text string, name string")
    want = brute_first(dict(enumerate(texts)))
    assert {int(r["row"]) for r in simhash.first_rows(docs, "name").collect()} == want and len(want) < 120
    named = {int(r["row"]): int(r["first"]) for r in simhash.similar_rows(docs, "name").collect()}
    assert set(named) == set(range(len(texts))) and set(named.values()) == want and all(named[i] == i for i in want)


def test_recall_of_similar_texts():
    """Of pairs with a Jaccard similarity of their five-word shingles of 0.8 or more, nine in ten link; of those below a half, none."""
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(2000)]
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    bits = lambda x, y: (int.from_bytes(x) ^ int.from_bytes(y)).bit_count()
    may, _ = simhash.doubtful_bits(0.8)
    close, far = [], []
    for _ in range(400):
        base = [vocabulary[min(int(rng.paretovariate(0.7)), 1999)] for _ in range(rng.randrange(60, 600))]
        other = edited(rng, base, rng.randrange(1, 2 + len(base) // 20))
        a, b = grams(base), grams(other)
        texts = [" ".join(w).encode() for w in (base, other)]
        sets = [simhash.shingle_set(t, 5) for t in texts]
        assert [len(x) for x in sets] == [len(a), len(b)]
        (p, c), (q, d) = map(simhash.text_fingerprints, texts, sets)
        counted = len(a & b) >= 0.8 * (len(a) * len(b)) ** 0.5
        assert simhash.alike(*sets, 0.8) == counted
        linked = min(bits(p[:8], q[:8]), bits(p[8:], q[8:])) <= simhash.WORD_RADIUS and bits(c, d) <= may and counted
        j = len(a & b) / len(a | b)
        (close if j >= 0.8 else far if j < 0.5 else []).append(linked)
    assert len(close) > 50 and np.mean(close) >= 0.9 and not any(far)


def pairs_by_count(texts, least):
    """(ids of distinct sets of shingles, i, j) with all pairs of such sets whose cosine is least or more, by a list of the texts of each shingle."""
    sets = {}
    for d, t in sorted(texts.items()):
        w = (t or "").translate(str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})).encode().split()
        grams = frozenset(xxhash.xxh64_intdigest(b" ".join(w[i : i + 5]), 5) for i in range(max(1, len(w) - 4))) if w else frozenset()
        sets.setdefault(grams, d)
    ids, n = list(sets.values()), np.array([len(s) for s in sets])
    gram = np.concatenate([np.fromiter(s, np.uint64, len(s)) for s in sets])
    who = np.repeat(np.arange(len(n)), n)[order := np.argsort(gram, kind="stable")]
    cuts = np.flatnonzero(np.diff(gram[order])) + 1
    together = [(x[:, None] * len(n) + x)[np.triu_indices(len(x), 1)] for x in np.split(who, cuts) if len(x) > 1]
    pair, shared = np.unique(np.concatenate(together), return_counts=True)
    i, j = pair // len(n), pair % len(n)
    near = shared >= least * np.sqrt(n[i] * n[j].astype(float)) - 1e-9
    return ids, i[near], j[near]


def test_recall_and_precision_over_a_whole_table(spark):
    """At scale 0.1: of the pairs of different texts with a cosine of 0.8 or more nine in ten are in one group, and no group holds texts that such pairs do not lead to."""
    docs = table(spark, "/root/testdata/sf0.1", "documents").select("doc_id", "text")
    ids, i, j = pairs_by_count({r["doc_id"]: r["text"] for r in docs.collect()}, 0.8)
    got = {int(r["row"]): int(r["first"]) for r in simhash.similar_rows(docs.withColumn("name", F.col("doc_id").cast("string")), "name").collect()}
    group = np.array([got[d] for d in ids])
    assert len(i) > 200 and (group[i] == group[j]).mean() >= 0.9
    want = brute_components(range(len(ids)), list(zip(i.tolist(), j.tolist())))
    place = {d: k for k, d in enumerate(ids)}
    assert all(want[place[d]] == want[place[got[d]]] for d in ids)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(50)] + [(5, 5), (300, 299)]
    got = {r["vertex"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(201)) and got[1049] == 1000 and got[300] == 299
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# tokens


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def strange_texts():
    rng = random.Random(3)
    letters = "aAbéÉ'sS tTdD<|endoftext|>  ́ \x1c\x1d\x85　Σςß12٣中文日x​﻿IİıſK😀ªµ\U0001d400"
    return ["".join(rng.choices(letters, k=60)) for _ in range(300)]


def test_counts_are_those_of_the_library(spark, sf, library):
    rows = text_rows(spark, sf) + ODD + list(enumerate(strange_texts(), 1000))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tokencount.token_counts(docs, tokenizer_path()).collect())
    assert got == sorted((d, len((t or "").encode()), n, n > 2048) for d, t in rows for n in [len(ids_of(library, t))])
    assert tokencount.token_counts(empty_docs(spark), tokenizer_path()).count() == 0


def test_merging_with_a_heap():
    ranks = {("a", "b"): 1, ("b", "c"): 0, ("a", "bc"): 2, ("b", "b"): 3}
    assert tokencount.merged_length(list("abc"), ranks) == 1
    assert tokencount.merged_length(list("abbc"), ranks) == 2
    assert tokencount.merged_length(list("bbbbb"), ranks) == 3
    assert tokencount.merged_length([], ranks) == 0


def test_full_stores_change_nothing(library, monkeypatch):
    from wavetable.llm import vocabulary

    monkeypatch.setattr(vocabulary, "REMEMBERED", 40)
    monkeypatch.setattr(tokencount, "REMEMBERED", 40)
    encoder, counter = vocabulary.Encoder(tokenizer_path()), tokencount.Counter(tokenizer_path())
    for t in [" ".join(f"w{i * j}x" for i in range(60)) for j in range(1, 6)] + strange_texts()[:50]:
        assert np.frombuffer(encoder.packed([t.encode()])[0], "<u4").tolist() == ids_of(library, t)
        assert counter.count(t.encode()) == len(ids_of(library, t))


def test_pieces_make_the_documents_again(spark, sf, library):
    rows = text_rows(spark, sf)[:80] + list(enumerate(strange_texts()[:40], 1000)) + [(5000, None), (5001, ""), (5002, "the end " * 9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    by, seen = defaultdict(list), set()
    for r in packing.pack(docs, tokenizer_path()).collect():
        assert r["length"] == len(r["ids"]) == 1 << r["bucket"] <= 4096 and r["offset"] == 0
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        assert r["sequence_id"] not in seen
        seen.add(r["sequence_id"])
        by[r["doc_id"]].append((r["start"], r["ids"], r["doc_tokens"]))
    for d, t in rows:
        ids, at = [], 0
        for start, piece, n in sorted(by[d]):
            assert start == at
            ids, at = ids + piece, at + len(piece)
        assert ids == [*ids_of(library, t), 2] and n == len(ids)
    assert packing.pack(empty_docs(spark), tokenizer_path()).count() == 0


def test_piece_lengths():
    assert packing.piece_lengths(0) == [] and packing.piece_lengths(13) == [8, 4, 1] and packing.piece_lengths(8193) == [4096, 4096, 1]


# language and toxicity


def test_held_out_languages(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len(held) > 150 and np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.98
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got) and all(0 <= r["score"] <= 1 for r in got)


def test_the_language_is_no_input(spark, sf):
    docs = table(spark, sf, "documents")
    model = langid.train(docs.filter(langid.learned_from()))
    moved = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("y"))
    a, b = (sorted(tuple(r) for r in langid.predict(d, model, ["doc_id"]).collect()) for d in (docs, moved))
    assert a == b


def test_language_against_plain_counts(spark):
    rows = [(i, t, "aa" if i % 2 else "bb") for i, t in enumerate(["ab ab ba", "zz zy", "abba", "yzzy zz"] * 5)]
    names, prior, matrix = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    counts = {n: np.zeros(langid.BUCKETS) for n in names}
    for _, t, lang in rows:
        codes, owner, _ = langid._codes([t])
        for bucket, _ in langid.grams(codes, owner):
            np.add.at(counts[lang], bucket, 1)
    want = np.stack([np.log((counts[n] + 0.5) / (counts[n] + 0.5).sum()) for n in names], axis=1)
    assert np.allclose(matrix, want) and np.allclose(np.exp(prior).sum(), 1)


def brute_language(text, model):
    """(language, posterior, fit) letter by letter."""
    names, prior, matrix = model
    s = re.sub(r" +", " ", "".join(c if c.isalpha() else " " for c in f" {text.lower()} "))
    sums, n = [0.0] * len(names), 0
    for size in (1, 2, 3):
        for i in range(len(s) - size + 1):
            h = size
            for c, factor in zip(s[i : i + size], (2654435761, 2246822519, 3266489917)):
                h = ((h ^ (ord(c) * factor % 2**32)) * 668265263) % 2**32
            h = ((h ^ (h >> 15)) * 668265263 % 2**32) >> 16
            n += 1
            for k in range(len(names)):
                sums[k] += matrix[h, k]
    given = [a + b for a, b in zip(sums, prior)]
    k = max(range(len(names)), key=lambda k: given[k])
    share = np.exp(matrix[:, k]) - np.exp(matrix[:, k]).min()
    share /= share.sum()
    mean = float(share @ matrix[:, k])
    spread = float(np.sqrt(share @ matrix[:, k] ** 2 - mean**2))
    return names[k], 1 / sum(np.exp(g - given[k]) for g in given), sums[k] / n - mean + 5 * spread * (6 / n) ** 0.5


def test_predictions_are_those_of_a_plain_scorer(spark, sf):
    docs = table(spark, sf, "documents").limit(60).unionByName(odd_docs(spark).drop("row").filter("doc_id in (5, 6, 7)"))
    model = langid.train(table(spark, sf, "documents").filter(langid.learned_from()))
    for r in langid.predict(docs, model, ["doc_id", "text"]).collect():
        lang, score, fit = brute_language(r["text"], model)
        assert r["lang_pred"] == lang and np.isclose(r["score"], score) and np.isclose(r["fit"], fit)


def test_language_names_clash_with_nothing(spark, sf):
    docs = table(spark, sf, "documents").selectExpr("*", "'s' as score", "'p' as lang_pred", "0 as held_out", "1 as fit")
    plain = langid.identify(table(spark, sf, "documents")).collect()
    assert sorted(map(tuple, langid.identify(docs).collect())) == sorted(map(tuple, plain))


def test_language_odd_cases(spark):
    got = langid.identify(odd_docs(spark)).collect()
    assert {r["lang_pred"] for r in got if r["doc_id"] <= 4} == {"und"} and all(r["score"] == 0 for r in got if r["doc_id"] <= 4)
    assert {r["lang_pred"] for r in got if r["doc_id"] > 4} == {"en"}
    assert langid.identify(empty_docs(spark)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd_docs(spark).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_toxicity_on_labels_that_it_did_not_see(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    seen, unseen = labels.filter("doc_id % 2 = 0"), labels.filter("doc_id % 2 = 1")
    got = toxicity.toxicity(docs.join(unseen.select("doc_id"), "doc_id").unionByName(docs.join(seen.select("doc_id"), "doc_id")), seen)
    r = got.withColumnRenamed("toxic", "said").join(unseen, "doc_id").agg(F.count_if(F.col("said") & (F.col("toxic") == 1)).alias("tp"), F.count_if("said").alias("p"), F.sum("toxic").alias("t"), F.count("*").alias("n")).first()
    assert r["tp"] / r["t"] > 0.8 and r["tp"] / r["p"] > 0.95


def test_chain_uses_earlier_categories(spark):
    rng = random.Random(0)
    rows, labels = [], []
    for i in range(1500):
        bad = rng.random() < 0.4
        words = rng.choices([f"w{k}" for k in range(40)], k=12) + (["awful"] if bad else [])
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad), int(bad and rng.random() < 0.9)))
    docs, given = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, first int, second int")
    chain = toxicity.train_chain(docs, given, ["first", "second"])
    assert len(chain[1]) == len(chain[0]) + 1 and chain[1][toxicity.BUCKETS] > 0.1
    got = {r["doc_id"]: (r["p_first"], r["p_second"]) for r in toxicity.score_chain(docs, chain, ["first", "second"], ["doc_id"]).collect()}
    assert np.mean([(got[i][0] > 0.5) == bool(a) for i, a, _ in labels]) > 0.98


def labelled(spark, flip=frozenset(), n=400):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        bad = rng.random() < 0.4
        words = rng.choices([f"w{k}" for k in range(30)], k=10) + (["awful", "vile"] if bad and rng.random() < 0.8 else [])
        rows.append((i, i % toxicity.FOLDS, float(bad != (i in flip)), words))
    features = [np.unique([f for w in set(words) for f in toxicity.word_features(w.encode())], return_counts=True) for *_, words in rows]
    data = [(i, fold, y, f.tolist(), t.tolist()) for (i, fold, y, _), (f, t) in zip(rows, features)]
    return spark.createDataFrame(data, "id long, fold int, y_a double, features array<int>, times array<int>")


def test_log_odds_come_from_models_that_have_not_seen_the_row(spark):
    """With all labels of a fold turned round, the log-odds of its rows stay and those of other folds change."""
    fold = 2
    odds = []
    for flip in (frozenset(), frozenset(range(fold, 400, toxicity.FOLDS))):
        rows = labelled(spark, flip)
        models = toxicity._fit_folds(rows, "y_a", [])
        assert set(models) == set(range(toxicity.FOLDS + 1))
        odds.append({r["id"]: (r["fold"], r["z_y_a"]) for r in toxicity._log_odds(rows, "y_a", [], models).collect()})
    same = {i: np.isclose(odds[0][i][1], odds[1][i][1], atol=1e-12) for i in odds[0]}
    assert all(same[i] for i, (f, _) in odds[0].items() if f == fold)
    assert np.mean([same[i] for i, (f, _) in odds[0].items() if f != fold]) < 0.1


def test_fit_is_the_optimum_of_a_dense_solver(monkeypatch):
    """Newton's method on the dense matrix of the features that have a weight reaches no lower loss, and the same weights."""
    rng = np.random.default_rng(0)
    n, d = 500, 40
    x = rng.poisson(0.4, size=(n, d))
    extra = rng.normal(size=(n, 1))
    y = (rng.random(n) < 1 / (1 + np.exp(-(x[:, :5].sum(axis=1) - 1.5 + extra[:, 0])))).astype(float)
    monkeypatch.setattr(toxicity, "LEAST_ERRORS", 1.0)
    got = toxicity.fit_logistic([np.flatnonzero(r).astype(np.int32) for r in x], [r[r > 0] for r in x], extra, y, d)
    live = np.flatnonzero(got[:d])
    a = np.column_stack([x[:, live], extra, np.ones(n)])
    ridge = np.diag([toxicity.PENALTY] * (a.shape[1] - 1) + [0.0])
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ w))
        w -= np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge, a.T @ (p - y) + ridge @ w)
    loss = lambda w: np.logaddexp(0, a @ w).sum() - y @ (a @ w) + w @ ridge @ w / 2
    mine = np.append(got[live], got[d:])
    assert len(live) >= 5 and loss(mine) - loss(w) < 1e-4 * loss(w) and np.allclose(mine, w, atol=0.05)


def test_scores_are_those_of_a_plain_loop(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels").select("doc_id", (1 - F.col("quality")).alias("poor"), "toxic")
    chain = toxicity.train_chain(docs, labels, ["poor", "toxic"])
    docs = docs.filter("doc_id < 200")
    assert np.flatnonzero(chain[0]).size > 1 and len(chain[1]) == len(chain[0]) + 1
    for r in toxicity.score_chain(docs, chain, ["poor", "toxic"], ["text", "doc_id"]).collect():
        words, z = {w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", r["text"].translate(LOWER)) if w}, []
        for w in chain:
            total = w[-1] + sum(w[toxicity.BUCKETS + k] * before for k, before in enumerate(z))
            for word in words:
                forms = [word.encode()] + [f"{n}{word[:n]}".encode() for n in (5, 7) if len(word) > n]
                total += sum(w[zlib.crc32(f) % (1 << 18)] for f in forms)
            z.append(min(30, max(-30, total)))
        assert np.allclose([r["p_poor"], r["p_toxic"]], [1 / (1 + np.exp(-x)) for x in z])


def test_toxicity_names_clash_with_nothing(spark, sf):
    docs = table(spark, sf, "documents").selectExpr("*", "'orig' as toxic", "'p' as p_toxic")
    got = toxicity.toxicity(docs, table(spark, sf, "labels"), keep=docs.columns, prefix="x_")
    assert got.columns == [*docs.columns, "x_p_poor", "x_p_toxic", "x_toxic"] and {r["toxic"] for r in got.collect()} == {"orig"}


def test_toxicity_odd_cases(spark):
    labels = spark.createDataFrame([(5, 1, 0), (6, 0, 1), (99, 1, 1), (None, 1, 1), (7, None, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(odd_docs(spark), labels).collect()
    assert len(got) == len(ODD) and all(0 <= r["p_toxic"] <= 1 for r in got)
    none = toxicity.toxicity(odd_docs(spark), labels.limit(0)).collect()
    assert not any(r["toxic"] for r in none) and max(r["p_toxic"] for r in none) < 1e-9
    assert toxicity.toxicity(empty_docs(spark), labels).count() == 0
